"""Path rules as a table: the same decisions as the rules one by one, for many rules and odd patterns."""

import pytest
from pyspark.sql import functions as F

from trawl.operators import rule_table as RT
from trawl.operators.filters import PathRules, excluded_dir, excluded_file

PATHS = [
    "/r/a.txt", "/r/src/a.txt", "/r/src/deep/b.log", "/r/build/x/y.o", "/r/sub/build", "/r/lib/[x].py", "/r/lib/x.py",
    "/r/src5/fr/doc_12.md", "/r/src5/fr/doc_1.md", "/r/e1/k/z", "/r/é/ü.txt", "/r/new\nline/f.txt", "/r", "/r/src/", "/r/.git/config",
]
CUSTOM = ["src/", "src5/*", "src5/fr/", "doc_1?.md", "*/deep/*", "lib/[[]x].py", "lib/[!a]*", "e?", "?", "[ab].txt", "build", "**/y.o",
          "a.txt", "é/*", "new*line", "[", "x[", "*", "/", "src*/f[!a-q]/*", "[]x].py", "sub/build"]


def listing(spark):
    return spark.createDataFrame([(p, "/r") for p in PATHS], "path string, root string")


def rules_df(spark, rows):
    return spark.createDataFrame(rows, "rule_id long, kind string, pattern string")


def expected(spark, rows):
    """The smallest rule of each path, every rule asked alone through the column expressions."""
    empty = dict(excluded_dirs=(), excluded_files=(), binary_extensions=(), exclude_dot_items=False)
    field = {"dir": "excluded_dirs", "file": "excluded_files", "custom": "custom_patterns"}
    df = listing(spark).withColumn("rel", F.when(F.col("path") == "/r", ".").otherwise(F.expr("substring(path, 4)")))
    alone = [PathRules(**{**empty, field[kind]: (p,)}) for _, kind, p in rows]
    hits = [(excluded_dir(F.col("rel"), r) | excluded_file(F.col("rel"), r)).alias(f"h{i}") for i, r in enumerate(alone)]
    out = {}
    for row in df.select("path", *hits).collect():
        out[row.path] = min((rows[i][0] for i in range(len(rows)) if row[f"h{i}"]), default=None)
    return out


@pytest.mark.parametrize("pattern", CUSTOM)
def test_matcher_equals_the_column_rules(spark, pattern):
    rows = [(7, "custom", pattern)]
    matcher = RT.RuleMatcher(rows)
    got = {p: matcher.of_file("." if p == "/r" else p[3:]) for p in PATHS}
    assert got == expected(spark, rows)


def test_smallest_rule_of_a_mixed_table(spark):
    rows = [(i, "custom", p) for i, p in enumerate(CUSTOM, 10) if p != "*"]
    rows += [(3, "dir", "src"), (90, "dir", "fr"), (1, "file", "*.log"), (95, "file", "x.p?"), (2, "dir", ".git")]
    got = {r.path: r.excluded_by for r in RT.with_excluding_rule(listing(spark), rules_df(spark, rows)).collect()}
    assert got == expected(spark, rows)
    assert {r.path for r in RT.filter_by_rules(listing(spark), rules_df(spark, rows)).collect()} == {p for p, no in got.items() if no is None}


def test_blocks_nulls_and_unknown_kinds(spark, monkeypatch):
    rows = [(i, "file", f"doc_{i}.*") for i in range(200)] + [(None, "file", "*"), (1, None, "*"), (2, "file", None), (3, "dir", "")]
    paths = listing(spark).unionByName(spark.createDataFrame([(None, "/r"), ("/r/q", None)], "path string, root string"))
    one = sorted(map(str, RT.with_excluding_rule(paths, rules_df(spark, rows)).collect()))
    monkeypatch.setattr(RT, "BLOCK_CHARS", 1000)
    many = RT.with_excluding_rule(paths, rules_df(spark, rows))
    assert sorted(map(str, many.collect())) == one
    assert sum("excluded_by=12" in r for r in one) == 1 and sum("path=None" in r and "excluded_by=None" in r for r in one) == 1
    none = RT.filter_by_rules(paths, rules_df(spark, []))
    assert none.count() == paths.count() and none.columns == paths.columns
    with pytest.raises(ValueError, match="unknown kinds"):
        RT.filter_by_rules(paths, rules_df(spark, [(1, "glob", "*")]))


def test_the_plan_does_not_grow_with_the_rules(spark):
    sizes = []
    for n in (1, 10_000):
        rules = rules_df(spark, [(i, "custom", f"src{i}/*/doc_?{i}.txt") for i in range(n)])
        plan = RT.filter_by_rules(listing(spark), rules)._jdf.queryExecution().executedPlan().toString()
        sizes.append(len(plan))
    assert abs(sizes[0] - sizes[1]) < 50
