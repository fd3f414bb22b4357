"""Structured Streaming versions of the ingest and learning jobs.

Late data: rows older than the watermark are dropped from windows and from duplicate detection; keyed state (sessions, tasks, Q) takes
rows in the order in which they arrive, and is dropped after ``forget_after`` milliseconds without any, if that is given. What must not be forgotten
is kept in a stored table instead: see ``stored``.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.functions.constants import ALPHA, DIMS
from tracelake.operators.dedup import shared_folder
from tracelake.operators.redaction import redact_tree
from tracelake.operators.turns import fingerprints, rule_cards, structural_metrics
from tracelake.sources.sessions import document_turns


def read_documents(spark: SparkSession, path: str, most_files: int = 1000) -> DataFrame:
    """A stream of JSON documents, one a file."""
    rows = spark.readStream.option("maxFilesPerTrigger", most_files).text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("session_id"), F.col("value").alias("raw"))


def ingest(documents: DataFrame, out: str, checkpoint: str):
    """Each micro-batch: turns, redaction, then cards, metrics and fingerprints, appended as Parquet under ``out``. A batch written twice overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        turns = redact_tree(document_turns(batch), ["text", "tool_calls"]).select("session_id", "turn", "role", "text", F.transform("tool_calls", lambda c: c["name"]).alias("tool_names"), F.col("is_error").alias("is_tool_error"), "redactions").persist()
        turns.write.mode("overwrite").parquet(f"{out}/turns/batch={number}")
        cards = rule_cards(turns, "session_id").join(structural_metrics(turns, "session_id"), "session_id").join(fingerprints(turns, "session_id"), "session_id")
        cards.write.mode("overwrite").parquet(f"{out}/cards/batch={number}")
        turns.unpersist()

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_uploads(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first upload of each (agent, fingerprint) within the watermark; rows without a fingerprint all pass."""
    return rows.withWatermark("created_at", delay).withColumn("__k", F.when(F.coalesce("fingerprint", F.lit("")) == "", F.col("experience_id").cast("string")).otherwise(F.col("fingerprint"))).dropDuplicatesWithinWatermark(["agent_id", "__k"]).drop("__k")


def session_upserts(rows: DataFrame, forget_after: int | None = None) -> DataFrame:
    """Of (agent, session) the snapshot with most turns so far, sent again whenever a longer one arrives. Equal or shorter ones are duplicates."""
    keys = ["agent_id", "session_id"]

    def run(rows: pd.DataFrame, state: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        new = rows.sort_values(["turn_count", "created_at", "experience_id"], ascending=[False, True, True]).drop_duplicates(keys)
        new = new.merge(state, on=keys, how="left")
        sent = new[new["turn_count"] > new["best"].fillna(-1)]
        best = new[keys].assign(best=np.maximum(new["turn_count"].fillna(-1), new["best"].fillna(-1)).astype("int64"))
        return sent[[*keys, "experience_id", "turn_count"]], best

    return _stateful(rows, keys, run, "agent_id long, session_id string, experience_id long, turn_count int", ["best"], "append", forget_after)


def closed_tasks(lines: DataFrame, forget_after: int | None = None) -> DataFrame:
    """Tasks of event logs ``(session_id, line, kind)`` as soon as they end; the number and first line of an open task wait in the state."""
    ends = {"task_complete": "complete", "turn_aborted": "aborted"}

    def run(rows: pd.DataFrame, state: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        at = {session: (task, first) for session, task, first in state.itertuples(index=False)}
        here: dict[str, tuple[int, int]] = {}
        out: list[tuple[Any, ...]] = []
        for session, line, kind in rows.sort_values("line")[["session_id", "line", "kind"]].itertuples(index=False):
            task, first = here.get(session) or at.get(session, (0, -1))
            if kind == "task_started":
                if first >= 0:
                    out.append((session, task, "superseded", first, int(line) - 1))
                task, first = task + 1, int(line)
            elif kind in ends and first >= 0:
                out.append((session, task, ends[kind], first, int(line)))
                first = -1
            here[session] = task, first
        return pd.DataFrame(out, columns=["session_id", "task", "status", "first_line", "last_line"]), pd.DataFrame([(k, *v) for k, v in here.items()], columns=["session_id", "task", "first_line"])

    return _stateful(lines, ["session_id"], run, "session_id string, task int, status string, first_line int, last_line int", ["task", "first_line"], "append", forget_after)


def online_q(rewards: DataFrame, forget_after: int | None = None) -> DataFrame:
    """Q of each experience after each micro-batch of rewards, which are folded in by time, then reward id. A forgotten experience starts from 0; ``stored.learn`` starts from what was stored."""
    names = [f"q_{d}" for d in DIMS]

    def run(rows: pd.DataFrame, state: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        rows = rows.sort_values(["experience_id", "created_at", "reward_id"])
        keys, start, n = np.unique(rows["experience_id"].to_numpy(), return_index=True, return_counts=True)
        old = state.set_index("experience_id").reindex(keys, fill_value=0)
        e = ALPHA * rows["confidence"].fillna(0).to_numpy(float).clip(0.0, 1.0)[:, None]
        r = rows[[f"r_{d}" for d in DIMS]].to_numpy(float)
        q = old[names].to_numpy(float)
        # the i-th rewards of all keys at a time; keys with most of them come first, so those still at it are a prefix
        order = np.argsort(-n, kind="stable")
        going = len(keys) - np.searchsorted(np.sort(n), np.arange(n.max(initial=0)), "right")
        for i, some in enumerate(going):
            k = order[:some]
            at = start[k] + i
            q[k] = (1 - e[at]) * q[k] + e[at] * r[at]
        now = pd.DataFrame(q, columns=names).assign(experience_id=keys, updates=old["updates"].to_numpy(np.int64) + n)[["experience_id", *names, "updates"]]
        return now, now

    return _stateful(rewards, ["experience_id"], run, f"experience_id long, {', '.join(f'{c} double' for c in names)}, updates int", [*names, "updates"], "update", forget_after)


def run_to_table(stream: DataFrame, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there now and give its result table: what each micro-batch sends is written to the shared folder by the executors.

    In complete mode a batch replaces the result, else batches add to it; with ``keys``, the row that the last batch sent for a key is the one that counts.
    A stream that nothing has arrived on gives no rows.
    """
    numbers = set()
    out = f"{shared_folder(stream.sparkSession)}/tracelake/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result" if mode == "complete" else f"{out}/result/batch={number}")
        numbers.add(number)

    conf, retained = stream.sparkSession.conf, "spark.sql.streaming.maxBatchesToRetainInMemory"
    before = conf.get(retained)
    conf.set(retained, 0)  # state is read from the checkpoint by the task that needs it, or executors would hold all of it
    try:
        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    finally:
        conf.set(retained, before)
    query.awaitTermination()
    if not numbers:
        return stream.sparkSession.createDataFrame([], stream.schema)
    found = stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/result")
    if keys and mode != "complete" and len(numbers) > 1:
        batch = F.regexp_extract("_metadata.file_path", r"/batch=(\d+)/", 1).cast("long")
        found = found.withColumn("__batch", batch).groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "__batch").alias("row")).select("row.*")
    return found.select(*stream.columns)


#: Keys are dealt to so many groups, whose state is one value each. It must stay what it is as long as a checkpoint is used.
GROUPS = 1024


def _by_group(keys: list[str], run: Callable[[pd.DataFrame, pd.DataFrame], tuple[pd.DataFrame, pd.DataFrame]], state: list[str], forget_after: int | None):
    """``run`` as Spark calls it: once a group of keys, whose states are one Arrow table."""

    def step(_: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        with pa.ipc.open_stream(kept.get[0]) if kept.exists else contextlib.nullcontext() as stored:
            old = stored.read_pandas() if stored else pd.DataFrame(columns=[*keys, *state, *(["__seen"] if forget_after is not None else [])])
        now = 0 if forget_after is None else kept.getCurrentProcessingTimeMs()
        left = old
        if not kept.hasTimedOut:
            new = pd.concat(list(frames), ignore_index=True).drop(columns="__group")
            known = old.drop(columns="__seen", errors="ignore")
            # of all keys' state, only that of the keys that have rows is looked at
            here = pd.MultiIndex.from_frame(known[keys]).isin(pd.MultiIndex.from_frame(new[keys].drop_duplicates())) if len(known) else np.zeros(0, bool)
            sent, changed = run(new, known[here])
            left = old[~here]
            yield sent
        if forget_after is not None:
            left = left[left["__seen"] + forget_after > now]
        if not kept.hasTimedOut:
            changed = changed if forget_after is None else changed.assign(__seen=now)
            left = pd.concat([left, changed], ignore_index=True) if len(left) else changed
        if not len(left):
            kept.remove()
            return
        table = pa.Table.from_pandas(left, preserve_index=False)
        with pa.BufferOutputStream() as sink:
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            kept.update((sink.getvalue().to_pybytes(),))
        if forget_after is not None:
            kept.setTimeoutDuration(max(1, int(left["__seen"].min()) + forget_after - now))

    return step


def _stateful(rows: DataFrame, keys: list[str], run: Callable[[pd.DataFrame, pd.DataFrame], tuple[pd.DataFrame, pd.DataFrame]], out: str, state: list[str], mode: str, forget_after: int | None) -> DataFrame:
    """``run`` by group of keys: of a group's new rows and the state of its keys (``keys``, ``state``) it makes what is sent and the new state of the keys that have rows. State that saw no row for ``forget_after`` (milliseconds) is dropped, without it state stays for ever.

    Spark calls a stateful function once a group, which costs milliseconds however few rows there are; so a group is not a key but a 1024th of all keys.
    """
    timeout = GroupStateTimeout.NoTimeout if forget_after is None else GroupStateTimeout.ProcessingTimeTimeout
    # keys with a null have groups of their own, so that a column of keys is all null or, as whole numbers, has none
    nulls = sum((F.col(k).isNull().cast("int") * 2**i for i, k in enumerate(keys)), F.lit(0))
    group = F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).cast("int") + nulls * GROUPS
    return rows.withColumn("__group", group).groupBy("__group").applyInPandasWithState(_by_group(keys, run, state, forget_after), out, "kept binary", mode, timeout)


def daily_counts(rows: DataFrame, column: str = "created_at", delay: str = "1 day") -> DataFrame:
    return rows.withWatermark(column, delay).groupBy(F.window(column, "1 day")).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "n")


def trailing_week(rows: DataFrame, column: str = "created_at", delay: str = "1 day") -> DataFrame:
    return rows.withWatermark(column, delay).groupBy(F.window(column, "7 days", "1 day")).agg(F.count("*").alias("n")).select(F.to_date(F.col("window.end") - F.expr("INTERVAL 1 SECOND")).alias("last_day"), "n")


def agent_sessions(rows: DataFrame, column: str = "created_at", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    w = F.session_window(column, gap)
    return rows.withWatermark(column, delay).groupBy("agent_id", w).agg(F.count("*").alias("segments")).select("agent_id", F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("ended_at"), "segments")
