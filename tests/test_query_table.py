"""Queries given as a table, and source windows of repeated paths, against the one-query search and plain Python."""

import pytest

from trawl import Query, search, search_query_table
from trawl.operators import elaborate as EL
from trawl.operators import query_table as QT

LONG = "a passage that is longer than the key of the automaton by far"
FILES = {
    "/a.txt": "aaaa Aa\nThe cat\r\nthe CAT sat\x0bKelvin K and ſ long",
    "/b.txt": f"{LONG}\n{LONG.upper()} {LONG}{LONG}\nİstanbul ISTANBUL i̇ x1 x22",
    "/c.txt": "", "/d.txt": "\n\n\n", "/e.txt": "new\nline new\nline", "/f.txt": "ſs ſS ıI Iı K k",
}
QUERIES = [
    ("aa", False, False), ("aa", True, False), ("the cat", False, False), (LONG, False, False), (LONG, True, False),
    (LONG[:40] + "!", False, False), ("new\nline", False, False), ("i", False, False), ("İ", False, False), ("k", False, False),
    (r"x\d+", False, True), (r"(?=the)", False, True), (r"s+", False, True), (r"kelvin \w", False, True), (r"is\w+", False, True),
    (r"^new$", True, True), (r"\n", True, True), ("", False, False), ("zzz", False, False), ("aa", False, False),
]


@pytest.mark.parametrize("block", [4_000_000, 30])
def test_a_table_of_queries_finds_what_each_finds(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(QT, "BLOCK_CHARS", block)
    docs = corpus(FILES)
    rows = [(i, *q, 9) for i, q in enumerate(QUERIES)] + [(99, None, False, False, 9)]
    table = spark.createDataFrame(rows, "query_id long, query string, is_case_sensitive boolean, is_regex boolean, path int")
    got = sorted(map(tuple, search_query_table(docs, table, 1).collect()))
    want = []
    for i, (text, case, regex) in enumerate(QUERIES):
        query = Query(text, case_sensitive=case, regex=regex, context_lines=1)
        from trawl.operators.match import python_findings_of

        for path, content in FILES.items():
            want += [(i, *f) for f in python_findings_of(path, content, query, query.compiled() if regex else None)]
    assert got == sorted(want)
    if block > 30:  # and what the search of one query finds
        one = search(docs, Query("the cat", context_lines=1), ordered=False).collect()
        assert sorted(map(tuple, one)) == [f[1:] for f in got if f[0] == 2]


def test_the_plan_does_not_grow_with_the_queries(spark, corpus):
    docs = corpus(FILES)
    sizes = []
    for n in (1, 2000):
        table = spark.createDataFrame([(i, f"needle {i}") for i in range(n)], "query_id long, query string")
        found = search_query_table(docs, table)
        sizes.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(sizes[0] - sizes[1]) < 50


def test_bad_regex_and_no_queries(spark, corpus):
    docs = corpus(FILES)
    with pytest.raises(ValueError):
        search_query_table(docs, spark.createDataFrame([(1, "(", True)], "query_id long, query string, is_regex boolean"))
    assert search_query_table(docs, spark.createDataFrame([], "query_id long, query string")).collect() == []


def test_windows_of_repeated_paths_blocks_and_missing_files(spark):
    lines = [f"line {i}" for i in range(400)]
    corpus = spark.createDataFrame(
        [("/a", "old", 1.0), ("/a", "\n".join(lines), 2.0), ("/a", None, 3.0), ("/b", "", 0.0), ("/n", None, 0.0), ("/c", "x\x0by\n", 0.0)],
        "path string, text string, mtime double",
    )
    asked = [("/a", n) for n in (1, 2, 63, 64, 65, 66, 128, 399, 400, 401, 900)] + [("/b", 1), ("/n", 1), ("/gone", 3), (None, 1), ("/c", 2), ("/a", None)]
    findings = spark.createDataFrame([(i, p, n, "s") for i, (p, n) in enumerate(asked)], "finding_id long, file_path string, line_number long, snippet string")
    for window in (0, 3, 50):
        got = {r.finding_id: r for r in EL.context_lines(findings, corpus, window).collect()}
        assert len(got) == len(asked)
        for i, (path, n) in enumerate(asked):
            source = {"/a": lines, "/c": ["x", "y"]}.get(path, []) if n else []
            near = range(max(0, (n or 0) - 1 - window), min(len(source), (n or 0) + window))
            want = "\n".join(f"{'>> ' if k == n - 1 else '  '}{k + 1:4d}: {source[k]}" for k in near)
            assert (got[i].has_content, got[i].file_context) == (bool(source), want), (path, n, window)
