"""Registry of queries and shared fixtures.

A fixture is a list of SQL expressions that Spark and the checking engine both understand,
so the same nulls, duplicates and outliers are injected on either side.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL twin, if it has one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Report types: 64-bit integers, doubles rounded to ``digits`` with one zero."""
    out = []
    for name, t in df.dtypes:
        c = F.col("`" + name + "`")
        if t in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif t in ("double", "float") or t.startswith("decimal"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(out)


class Fixture:
    """A table with derived columns, readable from Spark and as SQL text."""

    def __init__(self, source: str, *exprs: str, where: str | None = None):
        self.source, self.exprs, self.where = source, exprs, where

    def df(self, spark: SparkSession, sf: str) -> DataFrame:
        out = table(spark, sf, self.source)
        if self.where:
            out = out.where(self.where)
        return out.selectExpr(*self.exprs)

    @property
    def sql(self) -> str:
        where = f" where {self.where}" if self.where else ""
        return f"(select {', '.join(self.exprs)} from {self.source}{where})"


def union_all(items, template: Callable[[str], str]) -> str:
    return " union all ".join(template(i) for i in items)


def scratch(spark: SparkSession) -> str:
    """A new folder for files written by a query, in the shared folder the session names."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LI_NUM]

LI_GAPS = Fixture(
    "lineitem",
    "l_orderkey",
    "l_linenumber",
    "case when l_orderkey % 7 = 0 then null else l_quantity end as qty",
    "case when l_partkey % 11 = 0 then null else l_discount end as disc",
    "case when l_suppkey % 13 = 0 then null else l_returnflag end as flag",
    "case when l_partkey % 29 = 0 then null else l_shipdate end as shipped",
)
EV_GAPS = Fixture(
    "events",
    "event_id",
    "ts",
    "user_id",
    "case when event_id % 5 = 0 then null else event_type end as event_type",
    "case when event_id % 9 = 0 then null else value end as value",
)
LI_SPIKES = Fixture(
    "lineitem",
    "l_orderkey",
    "l_quantity",
    "l_discount",
    "case when l_orderkey % 97 = 0 then l_extendedprice * 50 else l_extendedprice end as price",
    "case when l_orderkey % 89 = 0 then l_quantity * 20 else l_quantity end as qty",
)
CU_PADDED = Fixture(
    "customer",
    "c_custkey",
    "case when c_custkey % 11 = 0 then '' when c_custkey % 17 = 0 then '   ' else concat('  ', c_name, ' ') end as padded",
    "c_mktsegment",
    "c_acctbal",
)
OR_TEXT = Fixture(
    "orders",
    "o_orderkey",
    "case when o_orderkey % 20 = 0 then 'bad' else cast(cast(floor(o_totalprice) as bigint) as varchar(30)) end as num_text",
    "case when o_orderkey % 20 = 0 then 'bad' else cast(cast(o_orderdate as date) as varchar(30)) end as date_text",
    "case when o_orderkey % 2 = 0 then 'yes' else 'No' end as flag_text",
    "case when o_orderkey % 3 = 0 then 'x' when o_orderkey % 3 = 1 then '12' else '1.5' end as mixed_text",
)
