"""The trigram index: equal to a plain search, and texts without a candidate are not read."""

import os
import random
import re
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from trawl import Query, search
from trawl.functions import trigrams as TG
from trawl.operators import trigram_index as TI
from trawl.sources import tables

from tests.conftest import SF001

QUERIES = [
    Query("license"), Query("The", case_sensitive=True), Query("th"), Query("İstanbul"), Query("KELVIN"), Query("straße"), Query("no such words"),
    Query(""), Query(r"licen[sc]e|warrant(y|ies)", regex=True), Query(r"(?:qu)+a?e", regex=True), Query(r"\bAl(ph|f)a\b.*beta", regex=True),
    Query(r"foo$\nbar", regex=True), Query(r"(abc)?xyz", regex=True), Query(r"istanbul", regex=True), Query(r"(?=license)", regex=True),
    Query("a" * 400), Query(r"(?i:pass)word{2,}", regex=True, case_sensitive=True), Query("i̇stan"),
]
TEXTS = [
    "İstanbul and istanbul and ISTANBUL", "Kelvin kelvin", "ſtraße STRASSE straße", "foo\nbar foo$ bar", "ALPHA then beta\nalfa beta",
    "xyz abcxyz", "LICENCE and warranties", None, "", "th", "a" * 1000, "pAssworddd passwordd PASSWORDD", "i̇stanbul", "é" * 50 + "license",
]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    odd = spark.createDataFrame([(f"/odd/{i}", t, 1.0) for i, t in enumerate(TEXTS)] + [(None, "license", None)], "path string, text string, mtime double")
    corpus = tables.documents(spark, SF001).unionByName(odd)
    folder = str(tmp_path_factory.mktemp("index") / "i")
    TI.build_index(corpus, folder, docs_per_block=7)
    return corpus, folder


@pytest.mark.parametrize("no", range(len(QUERIES)))
def test_equal_to_a_plain_search(spark, indexed, no):
    corpus, folder = indexed
    got = sorted(map(tuple, TI.find_indexed(spark, folder, QUERIES[no]).collect()))
    assert got == sorted(map(tuple, search(corpus, QUERIES[no], ordered=False).collect()))


def test_only_files_of_blocks_with_candidates_are_read(spark, indexed):
    corpus, folder = indexed
    blocks = spark.read.parquet(f"{folder}/texts").select("block").distinct().count()
    hits = TI.candidates(spark, folder, Query("warranties"))
    n = hits.select("block").distinct().count()
    assert 0 < n < blocks / 4
    plan = TI.candidate_texts(spark, folder, Query("warranties"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(block#", plan)
    named = [r.block for r in hits.select("block").distinct().collect()]
    size = lambda df: sum(os.path.getsize(urlparse(f).path) for f in df.inputFiles())
    texts = spark.read.schema(TI.TEXTS).parquet(f"{folder}/texts")
    everything = size(texts)
    touched = sum(
        os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{folder}/texts") for f in files
        if f.endswith(".parquet") and int(d.rpartition("block=")[2]) in named
    )
    assert touched < everything / 4  # bytes of the files that hold a candidate, of all
    assert TI.candidates(spark, folder, Query("no such words here")).count() == 0


def test_postings_are_the_trigrams_of_every_text(spark, indexed):
    corpus, folder = indexed
    texts = spark.read.parquet(f"{folder}/texts").where("length(text) > 0")
    want = set()
    for r in texts.select("block", "place", TG.folded(F.col("text")).alias("t")).collect():
        want |= {(r.block, r.place, t) for t in (r.t[i : i + 3] for i in range(len(r.t) - 2)) if t.isascii()}
    got = set()
    for r in spark.read.parquet(f"{folder}/postings").collect():
        assert r.n == len(r.deltas)
        word, place = "".join(chr(r.trigram >> s & 127) for s in (14, 7, 0)), 0
        for d in r.deltas:
            place += d
            got.add((r.block, place, word))
    assert got == want


def test_expressions_hold_for_every_match(spark):
    rng = random.Random(5)
    pieces = ["abc", "de", "f+", "(gh|ij)", "k?", "[lm]", "(?:nop){1,2}", "q{0,3}", "^", r"\b", ".", "(r|)"]
    for _ in range(300):
        pattern = "".join(rng.choices(pieces, k=rng.randint(1, 6)))
        query = Query(pattern, regex=True)
        expression = TG.trigram_query(query)
        for _ in range(20):
            text = "".join(rng.choices(["abc", "de", "f", "gh", "ij", "k", "l", "nop", "NOP", "q", " "], k=8))
            if expression is not None and re.search(pattern, text, query.compiled().flags):
                held = {int(c): [0] for c in TG.codes(text.lower().encode())}
                assert len(TG.evaluate(expression, held)), (pattern, text)


def test_empty_corpus(spark, tmp_path):
    empty = spark.createDataFrame([], "path string, text string")
    TI.build_index(empty, str(tmp_path / "e"))
    assert TI.find_indexed(spark, str(tmp_path / "e"), Query("license")).count() == 0
