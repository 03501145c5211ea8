"""Elaboration, result tables, report reading, batches and error isolation."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from trawl import Query, search, search_many
from trawl.operators import cache as C
from trawl.operators import elaborate as EL
from trawl.operators import report as R
from trawl.operators.match import python_findings_of
from trawl.sources import files as FS
from trawl.sources.report import read_report, report_status

FILES = {
    "/w/a.txt": "\n".join(f"row {i} alpha" for i in range(30)),
    "/w/b.txt": "beta alpha\nalpha gamma",
}


def findings(corpus):
    return R.with_finding_ids(search(corpus(FILES), Query("alpha", context_lines=1), ordered=False))


def test_context_matches_original_layout(corpus, spark):
    ids = findings(corpus)
    rows = {r.finding_id: r for r in EL.prompts(ids, corpus(FILES), 2).collect()}
    first_b = [r for r in rows.values() if r.file_path == "/w/b.txt" and r.line_number == 2][0]
    assert first_b.file_context == "     1: beta alpha\n>>    2: alpha gamma"
    assert first_b.context.startswith(EL.SNIPPET_HEAD + first_b.snippet + EL.SNIPPET_TAIL + EL.CONTEXT_HEAD)
    assert first_b.prompt.startswith(EL.PROMPT_HEAD + "/w/b.txt\nLine: 2\n\nContext/Code:\n")


def test_missing_and_empty_sources_fall_back_to_snippet(corpus, spark):
    ids = findings(corpus)
    other = corpus({"/w/a.txt": ""})  # a.txt empty, b.txt missing
    rows = EL.prompts(ids, other, 2).collect()
    assert all(r.context == r.snippet for r in rows)


def test_model_errors_never_fail(corpus, spark):
    def broken(prompts):
        if len(prompts) > 1:
            raise RuntimeError("batch refused")
        p = prompts[0]
        if "b.txt" in p:
            raise TimeoutError("slow")
        return [None if "Line: 1\n" in p else "fine"]

    out = EL.elaborate(findings(corpus), corpus(FILES), broken, 1).collect()
    texts = {r.elaboration for r in out}
    assert EL.ERR_NO_CHOICES in texts and "fine" in texts
    assert any(t.startswith("Error: API error during elaboration for /w/b.txt:") and "TimeoutError - slow" in t for t in texts)
    assert {r.status for r in out} == {"ok", "error"}


def test_validation_marks_missing_keys(corpus, spark):
    ids = findings(corpus).withColumn("match_text", F.when(F.col("finding_id") == 0, None).otherwise(F.col("match_text")))
    out = {r.finding_id: r for r in EL.elaborate(ids, corpus(FILES), EL.stub_model, 1).collect()}
    assert out[0].status == "invalid" and out[0].elaboration.startswith("Error: Finding at index 0 has an invalid structure")
    assert out[1].status == "ok"


def test_elaboration_json(corpus, spark):
    df = spark.createDataFrame([("line1\n\"q\" é",)], "elaboration string")
    text = R.elaboration_json(df).first().elaboration_json
    assert text == json.dumps({"elaboration": "line1\n\"q\" é"}, indent=4)


def test_cached_search_bypass_and_broken_table(corpus, spark, tmp_path):
    c = corpus(FILES, {"/w/a.txt": 1.0, "/w/b.txt": 2.0})
    q = Query("alpha")
    plain = sorted(tuple(r) for r in search(c, q, ordered=False).collect())
    table = C.ResultTable(spark, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in C.cached_search(c, q, table, use_cache=False).collect()) == plain
    assert not (tmp_path / "t").exists()  # bypass neither reads nor writes
    first = sorted(tuple(r) for r in C.cached_search(c, q, table, now=dt.datetime(2026, 1, 1)).collect())
    assert first == plain and table.entries().count() == 2
    hits = C.lookup_keys(c, q, table, now=dt.datetime(2026, 1, 2)).collect()
    assert all(r.hit for r in hits)
    # entries that cannot be read: everything is a miss, the search still answers
    bad = C.ResultTable(spark, str(tmp_path / "bad"))
    broken = tmp_path / "bad" / "search" / "entries" / f"query={C.query_hash(q.params())}" / "batch=b1"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_text("not parquet")
    assert all(not r.hit for r in C.lookup_keys(c, q, bad).collect())
    assert sorted(tuple(r) for r in C.cached_search(c, q, bad).collect()) == plain


def test_delete_and_clear_counts(corpus, spark, tmp_path):
    c = corpus(FILES, {"/w/a.txt": 1.0, "/w/b.txt": 2.0})
    q = Query("alpha")
    table = C.ResultTable(spark, str(tmp_path / "t"))
    C.cached_search(c, q, table, now=dt.datetime(2026, 1, 1)).count()
    keys = C.lookup_keys(c, q, table, now=dt.datetime(2026, 1, 1)).where("path = '/w/a.txt'").select("key")
    assert table.delete(keys) == 1 and table.delete(keys) == 0
    assert [r.hit for r in C.lookup_keys(c, q, table, now=dt.datetime(2026, 1, 1)).orderBy("path").collect()] == [False, True]
    C.cached_search(c, q, table, now=dt.datetime(2026, 1, 1))  # a deleted key can be stored again
    assert table.delete(keys) == 1
    assert table.clear() == 1
    assert table.entries().count() == 0


def test_search_many(corpus, spark):
    qs = [Query("alpha"), Query("gamma", case_sensitive=True), Query(r"row \d+", regex=True)]
    got = search_many(corpus(FILES), qs).collect()
    for i, q in enumerate(qs):
        exp = []
        for p, t in FILES.items():
            exp.extend(python_findings_of(p, t, q, q.compiled() if q.regex else None))
        assert sorted(tuple(r)[1:] for r in got if r.query_id == i) == sorted(exp)


def test_unreadable_files_are_skipped(spark, tmp_path):
    good = tmp_path / "ok.txt"
    good.write_text("fine")
    listing = spark.createDataFrame([(str(good), 1.0), (str(tmp_path / "gone.txt"), 1.0)], "path string, mtime double")
    rows = FS.read_corpus(listing).collect()
    assert [r.text for r in rows] == ["fine"]


def test_read_report(corpus, spark, tmp_path):
    df = search(corpus(FILES), Query("alpha", context_lines=0))
    results = [r.asDict() for r in df.collect()]
    p = tmp_path / "report.json"
    p.write_text(json.dumps(results, indent=4))
    back = read_report(spark, str(p)).orderBy("finding_id").collect()
    assert [r.finding_id for r in back] == list(range(len(results)))
    assert [r.snippet for r in back] == [r["snippet"] for r in results]
    q = tmp_path / "object.json"
    q.write_text('{"a": 1}')
    st = {r.report.rsplit("/", 1)[-1]: r.is_list for r in report_status(spark, str(tmp_path / "*.json")).collect()}
    assert st == {"report.json": True, "object.json": False}


def test_only_edited_files_are_searched_again(corpus, spark, tmp_path):
    c1 = corpus(FILES, {"/w/a.txt": 1.0, "/w/b.txt": 2.0})
    c2 = corpus(FILES, {"/w/a.txt": 1.0, "/w/b.txt": 3.0})  # b edited
    q = Query("alpha")
    table = C.ResultTable(spark, str(tmp_path / "t"))
    first = sorted(tuple(r) for r in C.cached_search(c1, q, table, now=dt.datetime(2026, 1, 1)).collect())
    second = sorted(tuple(r) for r in C.cached_search(c2, q, table, now=dt.datetime(2026, 1, 2)).collect())
    assert first == second
    stored = table.entries().orderBy("stored_at", "file_path").collect()
    assert [(r.file_path, r.mtime) for r in stored] == [("/w/a.txt", 1.0), ("/w/b.txt", 2.0), ("/w/b.txt", 3.0)]
    # another writer that stored the same files leaves one entry a key, and rows are not doubled
    twin = C.ResultTable(spark, str(tmp_path / "u"))
    C.cached_search(c2, q, twin, now=dt.datetime(2026, 1, 2))
    for kind in ("rows", "entries"):
        spark.read.parquet(str(tmp_path / "u" / "search" / kind)).drop("query", "batch").write.parquet(
            str(tmp_path / "t" / "search" / kind / f"query={C.query_hash(q.params())}" / "batch=btwin")
        )
    assert table.entries().count() == 3
    assert sorted(tuple(r) for r in C.cached_search(c2, q, table, now=dt.datetime(2026, 1, 3)).collect()) == second
    # another query has entries of its own
    assert not any(r.hit for r in C.lookup_keys(c2, Query("beta"), table, now=dt.datetime(2026, 1, 3)).collect())


def test_the_newest_entries_stay_within_the_limit(corpus, spark, tmp_path):
    files = {f"/f{i}": "license here" for i in range(6)}
    table = C.ResultTable(spark, str(tmp_path / "t"))
    for i, path in enumerate(files):
        C.cached_search(corpus({path: files[path]}), Query("license"), table, now=dt.datetime(2026, 1, 1 + i))
    one = table.entries().first().bytes
    table.size_limit_bytes = 2 * one
    assert table.delete(table.beyond_limit()) == 4
    assert {r.file_path for r in table.entries().collect()} == {"/f4", "/f5"}


def test_live_keys_beyond_the_broadcast_limit(corpus, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_KEY_BYTES", 0)
    q = Query("alpha")
    table = C.ResultTable(spark, str(tmp_path / "t"))
    plain = sorted(tuple(r) for r in search(corpus(FILES), q, ordered=False).collect())
    C.cached_search(corpus(FILES).where("path = '/w/a.txt'"), q, table)
    assert sorted(tuple(r) for r in C.cached_search(corpus(FILES), q, table).collect()) == plain


def test_search_many_mixed_batch_one_pass(corpus, spark):
    files = {
        "/m/a.txt": "İstanbul alpha\nalpha beta ALPHA\nsecond line",
        "/m/b.txt": "gamma alpha\n\nquick quack\nend",
        "/m/c.txt": "no hits here",
    }
    qs = [
        Query("alpha", context_lines=1),
        Query("ALPHA", case_sensitive=True, context_lines=0),
        Query(r"\bqu\w+", regex=True, context_lines=2),
        Query(r"a\nb", regex=True),  # Python route, own branch
        Query(""),
        Query("beta", context_lines=5),
    ]
    got = search_many(corpus(files), qs).collect()
    for i, q in enumerate(qs):
        exp = []
        for p, t in files.items():
            exp.extend(python_findings_of(p, t, q, q.compiled() if q.regex else None))
        assert sorted(tuple(r)[1:] for r in got if r.query_id == i) == sorted(exp), q
    # the three JVM-routed queries share one scan of the corpus
    plan = search_many(corpus(files), qs[:3])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1


def test_relative_report_paths(corpus, spark):
    c = corpus(FILES)
    df = spark.createDataFrame(
        [(0, "a.txt", 1), (1, "/w/b.txt", 1), (2, "nope.txt", 1)], "finding_id long, file_path string, line_number long"
    )
    got = {r.finding_id: r.file_path for r in EL.resolve_report_paths(df, "/w/", c).collect()}
    assert got == {0: "/w/a.txt", 1: "/w/b.txt", 2: "nope.txt"}


def test_elaborate_one_finding_of_a_json_report(corpus, spark, tmp_path):
    """The original tool's flow: write a JSON report, pick finding n, elaborate it."""
    c = corpus(FILES)
    found = search(c, Query("alpha", context_lines=1))
    p = tmp_path / "report.json"
    p.write_text(json.dumps([r.asDict() for r in found.collect()], indent=4))
    report = read_report(spark, str(p))
    one = R.lookup(report, 2)
    out = EL.elaborate(one, c, EL.stub_model, 10).collect()
    assert len(out) == 1 and out[0].status == "ok" and out[0].finding_id == 2
    prompt = EL.prompts(one, c, 10).first().prompt
    assert out[0].elaboration == EL.stub_reply(prompt)


def test_a_tiny_size_limit_never_cuts_answers(spark, corpus):
    from trawl.model import FINDING_COLUMNS
    from trawl.operators import cache as C
    from trawl.operators import elaborate as EL
    from trawl.operators.report import with_finding_ids
    from trawl.plans.search import find

    files = corpus({f"/f{i}": "license\nno\nLicense" for i in range(5)}, {f"/f{i}": 1.0 for i in range(5)})
    query = Query("license")
    plain = sorted(map(tuple, find(files, query).select(*FINDING_COLUMNS).collect()))
    table = C.scratch_table(spark, "search", size_limit_bytes=1)
    for _ in range(2):
        assert sorted(map(tuple, C.cached_search(files, query, table).collect())) == plain
    ids = with_finding_ids(find(files, query))
    table = C.scratch_table(spark, "elaborate", size_limit_bytes=1)
    for cached in (False, True):
        got = C.cached_elaborate(ids, files, EL.stub_model, table).collect()
        assert len(got) == len(plain) and all(r.from_cache is cached for r in got)
    # a store that cannot be written never fails the call
    broken = C.ResultTable(spark, "file:/proc/nowhere/trawl", "elaborate")
    assert C.cached_elaborate(ids, files, EL.stub_model, broken).count() == len(plain)
    assert C.cached_elaborate(ids, files, EL.stub_model, None, use_cache=False).count() == len(plain)


def test_reply_lists_of_the_wrong_length(spark):
    from trawl.operators import elaborate as EL

    rows = [(i, f"p{i}", "/f", i) for i in range(5)]
    df = spark.createDataFrame(rows, "finding_id long, prompt string, file_path string, line_number long").coalesce(1)
    short = EL.call_model(df, lambda ps: ["ok"] * (len(ps) - 2)).collect()
    assert [r.status for r in sorted(short)] == ["ok"] * 3 + ["error"] * 2
    assert {r.elaboration for r in short if r.status == "error"} == {EL.ERR_NO_CHOICES}
    many = EL.call_model(df, lambda ps: ["ok"] * (len(ps) + 1)).collect()
    assert all(r.status == "error" for r in many)
