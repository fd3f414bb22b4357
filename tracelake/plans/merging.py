"""Queries of what merges do to the rows, over a forest of merges that the ids give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators import dedup
from tracelake.plans.registry import _add, _Roles

#: Most orders merge into the next one of their group of customers, so that there are chains of any length.
_MERGES = """SELECT experience_id, merged_into FROM (SELECT o_orderkey AS experience_id, lead(o_orderkey, 1) OVER (PARTITION BY o_custkey % 500 ORDER BY o_orderkey) AS merged_into FROM orders) x
  WHERE merged_into IS NOT NULL AND experience_id % 4 <> 1"""


def _applied(r: _Roles) -> DataFrame:
    merges = r.spark.sql(_MERGES.replace("FROM orders", "FROM {orders}"), orders=r.orders)
    rows = r.experiences.select("experience_id", "visit_count", "reuse_count", "review_status", F.array(F.lit("old")).alias("tags"))
    return dedup.apply_merges(rows, merges).select("experience_id", "visit_count", "reuse_count", "review_status", F.array_join("tags", ",").alias("tags"))


_add("t13_applied_merges", _applied,
     f"""WITH RECURSIVE m AS ({_MERGES}), above(k, up) AS (SELECT experience_id, merged_into FROM m UNION ALL SELECT a.k, m.merged_into FROM above a JOIN m ON m.experience_id = a.up),
     g AS (SELECT up AS experience_id, sum(visit_count) AS v, sum(reuse_count) AS u FROM above JOIN experiences e ON e.experience_id = k GROUP BY up)
     SELECT e.experience_id, CAST(visit_count + coalesce(v, 0) AS BIGINT) AS visit_count, CAST(reuse_count + coalesce(u, 0) AS BIGINT) AS reuse_count, CASE WHEN merged_into IS NULL THEN review_status ELSE 'rejected' END AS review_status,
     CASE WHEN merged_into IS NULL THEN 'old' ELSE concat('old,merged_into:', merged_into) END AS tags FROM experiences e LEFT JOIN g ON g.experience_id = e.experience_id LEFT JOIN m ON m.experience_id = e.experience_id""")
