"""Every registered query on tables whose rows lack language, source, text or url, and as folders of part files."""

import os

import duckdb
import pytest

import catalog
from catalog import CATALOG
from tests.conftest import SF001

TABLES = ("documents", "pages", "conversations", "benchmark")


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    from pyspark.sql import functions as F

    base = str(tmp_path_factory.mktemp("awkward"))
    gaps = {"documents": {"lang": 3, "source": 5, "text": 7}, "pages": {"url": 4, "html": 9}, "conversations": {"turn": 5, "text": 6}}
    for name in TABLES:
        df = spark.read.parquet(f"{SF001}/{name}.parquet")
        for column, n in gaps.get(name, {}).items():
            df = df.withColumn(column, F.when(F.xxhash64(df.columns[0], F.lit(column)) % n == 0, F.lit(None)).otherwise(F.col(column)))
        df.repartition(3).write.parquet(f"{base}/{name}.parquet")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{base}/{name}.parquet/*.parquet')")
    return base, con


# every source of paths, and every route of a search, on which a null once did harm
NAMES = [
    "search_literal_ci", "search_regex_multiline", "search_pages", "search_conversations", "search_batch", "search_query_table",
    "search_incremental", "search_stream", "filter_custom_dirs", "corpus_dedup_sorted", "filter_nul_bytes", "finding_markdown",
    "elab_prompt", "cache_hits", "scan_files",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_oracle(spark, awkward, name):
    base, con = awkward
    got = CATALOG[name].run(spark, base)
    want = con.execute(CATALOG[name].sql)
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_names_are_registered():
    assert set(NAMES) <= set(CATALOG) and os.path.exists(catalog.__file__)
