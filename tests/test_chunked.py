"""Search in chunks against the search of whole texts, for seams at every place."""

import pytest

from trawl import Query
from trawl.operators import chunked as CH
from trawl.operators.match import python_findings_of

FILES = {
    "/a.txt": "aaaaaaaaa\naaaa a\r\n\r\naa\x0baaa xaaaa\raaaaa",
    "/b.txt": "The cat\nthe CAT\r\n" * 60 + "the end",
    "/c.txt": "", "/d.txt": "\n\n\r\n", "/e.txt": "new\nline new\nline\nnew\nnew\nnew\n", "/f.txt": "İ the cat\nthe i̇ Σ aa",
    "/g.txt": "x" * 500 + "the cat" + "y" * 300 + "\x85the cat\n" + "the cat" * 30,
}
QUERIES = [
    Query("aa"), Query("aa", case_sensitive=True, context_lines=0), Query("aaa", context_lines=1), Query("the cat"),
    Query("The cat", case_sensitive=True, context_lines=70), Query("new\nline"), Query("new\nnew\n", context_lines=1), Query("\n"),
    Query("σ"), Query("i"), Query("zzz"),
]


@pytest.mark.parametrize(("query", "size"), [*((q, 3) for q in QUERIES), (QUERIES[0], 64), (QUERIES[4], 64)])
def test_chunks_find_what_whole_texts_hold(spark, corpus, monkeypatch, query, size):
    monkeypatch.setattr(CH, "BLOCK", 4)
    docs = corpus(FILES)
    docs = docs.union(docs.where("path = '/b.txt'"))  # a path that occurs twice gives its findings twice
    got = sorted(map(tuple, CH.search_chunked(docs, query, size).collect()))
    want = [f for path, text in [*FILES.items(), ("/b.txt", FILES["/b.txt"])] for f in python_findings_of(path, text, query)]
    assert got == sorted(want)


def test_null_rows_and_the_empty_table(spark):
    schema = "path string, text string, extra int"
    docs = spark.createDataFrame([(None, "the cat", 1), ("/n", None, 2)], schema)
    assert [tuple(r)[:3] for r in CH.search_chunked(docs, Query("cat"), 2).collect()] == [("", 1, "cat")]
    assert CH.search_chunked(docs.limit(0), Query("cat")).count() == 0
    assert CH.search_chunked(docs, Query("")).count() == 0
    with pytest.raises(ValueError):
        CH.search_chunked(docs, Query("a+", regex=True))


def test_the_chunks_are_summed_up_in_two_reads(spark, corpus, monkeypatch):
    frame = type(spark.range(1))
    plans, checkpoint = [], frame.checkpoint

    def noted(df, *args, **named):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return checkpoint(df, *args, **named)

    monkeypatch.setattr(frame, "checkpoint", noted)
    assert CH.search_chunked(corpus(FILES), Query("cat"), 64).count() > 0
    assert max(plan.count("LogicalRDD") + plan.count("ExistingRDD") for plan in plans) <= 2
