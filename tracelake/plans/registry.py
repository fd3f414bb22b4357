"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.plans.roles import ROLES, role, table, with_roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2001-08-01"


class _Roles:
    """``r.experiences`` is the role, ``r.documents`` the table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return role(self.spark, self.sf_dir, name) if name in ROLES else table(self.spark, self.sf_dir, name)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _add(name: str, make: Callable[[_Roles], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: _rounded(make(_Roles(spark, sf_dir)))
    if sql is not None:
        ORACLES[name] = with_roles(sql)
