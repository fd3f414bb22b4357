"""Streams whose state is a stored table: sessions, uploads and Q that a restart, a replay or a long silence does not change.

Each micro-batch reads the parts of the table that its keys fall into, works out their new rows as a batch job, and merges them (``tables.KeyedTable``). What else it
finds (duplicates, changes of Q) goes to a log with a folder a batch, written before the commit, so a replay writes it again or, once committed, leaves it alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.constants import DIMS
from tracelake.operators.credit import fold, fold_log
from tracelake.sources.sessions import SEGMENT_STATE, segment_turns, segments_of
from tracelake.streaming.tables import KeyedTable

_Q = ", ".join(f"q_{d} double" for d in DIMS)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Work off what has arrived; a later call with the same ``checkpoint`` goes on from there."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def arrivals(rows: DataFrame, order: list[str], path: str, batches: int) -> Iterator[DataFrame]:
    """``rows`` as a stream of files that arrive in the order of ``order``, in about ``batches`` portions of the same size: each portion is written, then the stream is given to the caller to run."""
    spark = rows.sparkSession
    rows.repartitionByRange(batches, *order).withColumn("portion", F.spark_partition_id()).write.partitionBy("portion").parquet(f"{path}/portions")
    kept = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, portion int").parquet(f"{path}/portions")
    for portion in range(batches):
        kept.where(F.col("portion") == portion).drop("portion").write.mode("append").parquet(f"{path}/arrived")
        yield spark.readStream.schema(rows.schema).parquet(f"{path}/arrived")


def sessions(spark: SparkSession, path: str) -> KeyedTable:
    """Of (agent, session) the snapshot with most turns, the earliest of equal ones."""
    best = lambda: [F.col("turn_count"), -F.unix_micros(F.col("created_at").cast("timestamp")), -F.col("experience_id")]
    return KeyedTable(spark, path, "agent_id long, session_id string, experience_id long, turn_count int, created_at timestamp", ["agent_id", "session_id"], best)


def store_sessions(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """Longer snapshots take the place of stored ones. Rows without a session are not stored here."""

    def each(batch: DataFrame, number: int) -> None:
        table.merge(batch.where("session_id <> ''"), number)

    return each


def uploads(spark: SparkSession, path: str) -> KeyedTable:
    """The first upload of each (agent, fingerprint)."""
    return KeyedTable(spark, path, "agent_id long, fingerprint string, experience_id long, created_at timestamp", ["agent_id", "fingerprint"], lambda: [-F.unix_micros(F.col("created_at").cast("timestamp")), -F.col("experience_id")])


def store_uploads(table: KeyedTable, log: str) -> Callable[[DataFrame, int], None]:
    """New fingerprints are stored; others are logged with the upload that has theirs, which came in an earlier batch or, within one, by time, then id.

    Rows without a fingerprint are never duplicates; they are stored under their own id.
    """

    def each(batch: DataFrame, number: int) -> None:
        if number <= table.last_commit():
            return
        own = F.when(F.coalesce("fingerprint", F.lit("")) == "", F.concat(F.lit("id:"), F.col("experience_id"))).otherwise(F.concat(F.lit("fp:"), F.col("fingerprint")))
        rows = batch.select("agent_id", own.alias("fingerprint"), "experience_id", "created_at")
        first = rows.groupBy("agent_id", "fingerprint").agg(F.min_by(F.struct("experience_id", "created_at"), F.struct("created_at", "experience_id")).alias("x")).select("agent_id", "fingerprint", "x.*")
        old = table.rows_like(rows).select("agent_id", "fingerprint", F.col("experience_id").alias("stored"))
        new = first.join(old, ["agent_id", "fingerprint"], "left_anti")
        known = first.join(old, ["agent_id", "fingerprint"], "left").select("agent_id", "fingerprint", F.coalesce("stored", "experience_id").alias("duplicate_of"))
        found = rows.join(known, ["agent_id", "fingerprint"]).where("experience_id <> duplicate_of").select("experience_id", "duplicate_of")
        found.write.mode("overwrite").parquet(f"{log}/batch={number}")
        table.merge(new, number)

    return each


def learned(spark: SparkSession, path: str) -> KeyedTable:
    """Q of each experience and the number of rewards it has learned from."""
    return KeyedTable(spark, path, f"experience_id long, {_Q}, updates long", ["experience_id"], lambda: [F.col("updates")])


def learn(table: KeyedTable, log: str, start: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """Rewards are folded into stored Q by time, then id; what each changed goes to ``log``. An experience that is not stored yet starts from ``start`` (``experience_id``, ``q_*``), or from 0."""

    def each(batch: DataFrame, number: int) -> None:
        if number <= table.last_commit():
            return
        keys = batch.select("experience_id").distinct()
        stored = table.rows_like(batch)
        state = keys.join(stored, "experience_id", "left")
        if start is not None:
            given = start.select("experience_id", *(F.col(f"q_{d}").alias(f"s_{d}") for d in DIMS))
            state = state.join(given, "experience_id", "left").select("experience_id", *(F.coalesce(f"q_{d}", f"s_{d}").alias(f"q_{d}") for d in DIMS), "updates")
        state = state.select("experience_id", *(F.coalesce(f"q_{d}", F.lit(0.0)).alias(f"q_{d}") for d in DIMS), F.coalesce("updates", F.lit(0).cast("long")).alias("earlier")).persist()
        fold_log(state, batch, "experience_id", ["created_at", "reward_id"], ["reward_id", "created_at"]).write.mode("overwrite").parquet(f"{log}/batch={number}")
        new = fold(state, batch, "experience_id", ["created_at", "reward_id"]).join(state.select("experience_id", "earlier"), "experience_id")
        table.merge(new.withColumn("updates", F.col("updates") + F.col("earlier")), number)
        state.unpersist()

    return each


def segments(spark: SparkSession, path: str) -> KeyedTable:
    """Segments of sessions; the last one of a session grows in place."""
    return KeyedTable(spark, path, SEGMENT_STATE, ["session_id", "segment"], lambda: [F.col("last_turn")], by=["session_id"])


def store_segments(table: KeyedTable, soft: int = 240, soft_bytes: int = 4 << 20) -> Callable[[DataFrame, int], None]:
    """New turns of sessions continue their last stored segment under its number, or begin the next."""

    def each(batch: DataFrame, number: int) -> None:
        if number <= table.last_commit():
            return
        last = table.rows_like(batch).groupBy("session_id").agg(F.max_by(F.struct("segment", "first_turn", "last_turn", "turns", "bytes", "closed"), "segment").alias("x")).select("session_id", "x.*")
        table.merge(segments_of(segment_turns(batch, last, soft, soft_bytes)), number)

    return each


def read_log(spark: SparkSession, log: str, schema: str) -> DataFrame:
    """All batches of a log."""
    rows = spark.read.schema(schema).parquet(log)
    return rows.drop("batch")


LEARN_LOG = f"experience_id long, nth int, reward_id long, created_at timestamp, alpha double, confidence double, {_Q}, {', '.join(f'delta_{d} double' for d in DIMS)}"
