"""Every registered query has a name in the inventory's form; a sample runs next to its SQL."""

import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks import load

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SAMPLE = [
    "src1_csv_quoted_line_breaks",
    "src1_csv_rows_of_any_projection",
    "src8_rejected_records",
    "src8_incremental_ingest",
    "flt9_composite_rows",
    "prf1_profile_columns",
    "dsc1_descriptive_stats",
    "cln10_interpolate",
    "cln15_treat_outliers_remove",
    "qlt9_column_quality",
    "cor2_spearman",
    "cor12_recommendations",
    "dst7_kde",
    "dst11_qq_points",
    "stt1_shapiro_wilk",
    "stt3_anderson_darling",
    "fea2_label",
    "joi4_merge_full",
    "cht12_box",
    "cht19_time_series",
    "eda2_ml_readiness",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def test_registry():
    assert set(oracle_sql()) <= set(queries())
    assert all(re.fullmatch(r"[a-z]{3}[0-9]*_[a-z0-9_]+", n) for n in load()[0])


def test_entry(spark):
    assert entry(spark).count() == 8


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf, con, name):
    df = queries()[name](spark, sf)
    cols = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    res = con.execute(oracle_sql()[name])
    names = [d[0] for d in res.description]
    theirs = sorted((tuple(dict(zip(names, r))[c] for c in cols) for r in res.fetchall()), key=str)
    assert sorted(names) == cols
    assert mine == theirs
