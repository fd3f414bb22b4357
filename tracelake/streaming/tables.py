"""A stored table that streams write by key: each batch changes rows in place, and a batch that comes twice changes nothing.

Rows are dealt to ``parts`` by a hash of their key. A batch reads and rewrites the parts it touches, beside the old ones, and then commits: the commit
names, for each part, the batch that wrote it last. Readers see the parts of the last commit, so a batch that fails halfway is not seen, and its next try
writes over it. Files, folders and commits are written by Spark's own writers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


class KeyedTable:
    """``schema`` is a DDL text; ``keys`` its key columns; ``best`` gives the columns by which the row of a key that stays is the largest; ``by``: the key columns that decide the part, if not all."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], best: Callable[[], list[Column]], parts: int = 64, by: list[str] | None = None):
        self.by = by or keys
        self.spark, self.path, self.schema, self.keys, self.best, self.parts = spark, path.rstrip("/"), schema, keys, best, parts

    def last_commit(self) -> int:
        """The number of the last committed batch, -1 if there is none."""
        files, where = _files(self.spark, f"{self.path}/commits")
        if not files.exists(where):
            return -1
        done = [s.getPath() for s in files.listStatus(where) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(p.getName().partition("=")[2]) for p in done), default=-1)

    def _current(self, parts: list[int] | None = None) -> dict[int, int]:
        """The batch that wrote each part last: at most ``parts`` numbers."""
        last = self.last_commit()
        if last < 0:
            return {}
        rows = self.spark.read.parquet(f"{self.path}/commits/batch={last}").collect()
        return {r["part"]: r["batch"] for r in rows if parts is None or r["part"] in parts}

    def _read(self, current: dict[int, int]) -> DataFrame:
        folders = [f"{self.path}/data/batch={b}/part={p}" for p, b in sorted(current.items())]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self._current())

    def rows_like(self, batch: DataFrame) -> DataFrame:
        """The stored rows of the parts that the keys of ``batch`` fall into."""
        return self._read(self._current(self._touched(batch)))

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.parts)).cast("int")

    def _touched(self, batch: DataFrame) -> list[int]:
        return [r["part"] for r in batch.select(self._part().alias("part")).distinct().collect()]

    def merge(self, batch: DataFrame, number: int) -> bool:
        """Write the batch's rows; of the rows of a key, stored or new, the best stays. False if this batch was committed before."""
        if number <= self.last_commit():
            return False
        names = self.spark.createDataFrame([], self.schema).columns
        touched = self._touched(batch)
        current = self._current()
        both = self._read({p: b for p, b in current.items() if p in touched}).unionByName(batch.select(*names))
        kept = both.groupBy(*self.keys).agg(F.max_by(F.struct(*names), F.struct(*self.best())).alias("row")).select("row.*")
        kept.withColumn("part", self._part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/data/batch={number}")
        current |= dict.fromkeys(touched, number)
        commit = self.spark.createDataFrame(sorted(current.items()), "part int, batch long")
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={number}")
        return True

    def clean(self) -> int:
        """Delete what the last commit does not name: parts written over, batches that failed, earlier commits. Only while nobody reads or writes. Gives the number of folders deleted."""
        last, current, n = self.last_commit(), self._current(), 0
        for kind in ("data", "commits"):
            files, where = _files(self.spark, f"{self.path}/{kind}")
            if not files.exists(where):
                continue
            for folder in files.listStatus(where):
                number = int(folder.getPath().getName().partition("=")[2])
                if kind == "commits":
                    old = [] if number == last else [folder.getPath()]
                else:
                    inside = [s.getPath() for s in files.listStatus(folder.getPath()) if s.isDirectory()]
                    old = [p for p in inside if current.get(int(p.getName().partition("=")[2])) != number]
                    old = [folder.getPath()] if len(old) == len(inside) else old
                for p in old:
                    files.delete(p, True)
                    n += 1
        return n
