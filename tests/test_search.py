"""Match, position and snippet semantics (cases modelled on the original tool's tests)."""

import pytest
from pyspark.sql import functions as F

from trawl import Query, search
from trawl.functions.regex_dialect import java_line_pattern
from trawl.model import SNIPPET_LINE_MISMATCH
from trawl.operators.match import python_findings_of
from trawl.plans.search import route

FILES = {
    "/p/file1.txt": "Hello world\nThis is a test file\nAnother line with world for testing",
    "/p/file2.py": "# Python code\ndef hello_world():\n    print(\"Hello world from Python\")",
    "/p/empty.txt": "",
    "/p/accent.txt": "Café crème\ncafé CAFÉ",
    "/p/multi.txt": "a world, world, WORLD\nno\nworld",
}


def rows(df):
    return [tuple(r) for r in df.collect()]


def model(files, q):
    out = []
    for p, t in files.items():
        out.extend(python_findings_of(p, t, q, q.compiled() if q.regex else None))
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def test_literal_case_insensitive_default(corpus):
    got = rows(search(corpus(FILES), Query("world", context_lines=1)))
    positions = [(r[0], r[1], r[2], r[3], r[4]) for r in got]
    assert positions == [
        ("/p/file1.txt", 1, "world", 6, 11),
        ("/p/file1.txt", 3, "world", 18, 23),
        ("/p/file2.py", 2, "world", 10, 15),
        ("/p/file2.py", 3, "world", 17, 22),
        ("/p/multi.txt", 1, "world", 2, 7),
        ("/p/multi.txt", 1, "world", 9, 14),
        ("/p/multi.txt", 1, "WORLD", 16, 21),
        ("/p/multi.txt", 3, "world", 0, 5),
    ]
    assert got[0][5] == "   1: Hello >>>world<<<\n   2: This is a test file"


def test_literal_case_sensitive(corpus):
    got = rows(search(corpus(FILES), Query("Hello", case_sensitive=True)))
    assert [(r[0], r[1], r[3]) for r in got] == [("/p/file1.txt", 1, 0), ("/p/file2.py", 3, 11)]


def test_accents_and_case(corpus):
    got = rows(search(corpus(FILES), Query("café")))
    assert [(r[1], r[2], r[3]) for r in got] == [(1, "Café", 0), (2, "café", 0), (2, "CAFÉ", 5)]


def test_regex(corpus):
    q = Query(r"w[o0]rld\b", regex=True, case_sensitive=True)
    assert route(q) == "native"
    got = rows(search(corpus(FILES), q))
    assert got == model(FILES, q)
    assert len(got) == 7


def test_no_match_and_empty_query(corpus):
    assert rows(search(corpus(FILES), Query("nomatchstring"))) == []
    assert rows(search(corpus(FILES), Query(""))) == []
    assert rows(search(corpus(FILES), Query("", regex=True))) == []


def test_invalid_regex_and_negative_context():
    with pytest.raises(ValueError, match="Invalid regex pattern"):
        Query("[", regex=True)
    with pytest.raises(ValueError):
        Query("x", context_lines=-1)


def test_snippet_edges(corpus):
    text = "\n".join(f"line {i}" for i in range(1, 21))
    files = {"/s.txt": text}
    mid = rows(search(corpus(files), Query("line 10", context_lines=2)))[0][5]
    assert mid == "   8: line 8\n   9: line 9\n  10: >>>line 10<<<\n  11: line 11\n  12: line 12"
    first = rows(search(corpus(files), Query("line 1\n", context_lines=2)))
    # a literal holding a newline matches across the line end (Python route)
    assert first == [("/s.txt", 1, "line 1\n", 0, 7, "   1: >>>line 1<<<\n   2: line 2\n   3: line 3")]
    top = rows(search(corpus(files), Query("line 1", case_sensitive=True, context_lines=1)))[0][5]
    assert top == "   1: >>>line 1<<<\n   2: line 2"
    last = rows(search(corpus(files), Query("line 20", context_lines=1)))[0][5]
    assert last == "  19: line 19\n  20: >>>line 20<<<"
    zero = rows(search(corpus(files), Query("line 5", context_lines=0)))[0][5]
    assert zero == "   5: >>>line 5<<<"
    big = rows(search(corpus(files), Query("line 3", context_lines=100)))
    assert big[0][5].count("\n") == 19


def test_literal_with_newline_spans_lines(corpus):
    files = {"/n.txt": "ab\ncd\nab\ncd"}
    q = Query("b\nc")
    assert route(q) == "python"
    got = rows(search(corpus(files), q))
    assert [(r[1], r[2], r[3], r[4]) for r in got] == [(1, "b\nc", 1, 4), (3, "b\nc", 1, 4)]
    assert got[0][5] == "   1: a>>>b<<<\n   2: cd\n   3: ab\n   4: cd"


def test_line_number_prefix_does_not_truncate(corpus):
    text = "x\n" * 10005 + "needle"
    got = rows(search(corpus({"/big.txt": text}), Query("needle", context_lines=1)))
    assert got[0][1] == 10006
    assert got[0][5] == "10005: x\n10006: >>>needle<<<"


def test_zero_width_and_line_mismatch(corpus):
    files = {"/z.txt": "ab\n"}
    q = Query(r"$", regex=True)
    got = rows(search(corpus(files), q))
    # `$` matches before the final newline and at the very end (line 2 does not exist
    # for splitlines(), so that finding carries the fixed error text)
    assert [(r[1], r[3], r[4]) for r in got] == [(1, 2, 2), (2, 0, 0)]
    assert got[0][5] == "   1: ab>>><<<"
    assert got[1][5] == SNIPPET_LINE_MISMATCH


def test_splitlines_and_newline_numbering_disagree(corpus):
    # \x0c splits snippet lines but not match numbering: the reference shows the wrong
    # line in that case, and so do we
    files = {"/f.txt": "one\x0ctwo\nthree two"}
    q = Query("two")
    got = rows(search(corpus(files), q))
    assert got == model(files, q)
    assert got[0][1] == 1 and got[0][3] == 4
    assert got[0][5] == "   1: one>>><<<\n   2: two\n   3: three two"


def test_dotted_capital_i_drift(corpus):
    # lower() turns U+0130 into two characters; offsets after it drift, as in the original
    files = {"/t.txt": "İstanbul is big\nbig city", "/u.txt": "big plain\nbig"}
    q = Query("big")
    got = rows(search(corpus(files), q))
    assert got == model(files, q)
    assert got[0][3] == 13 and got[0][2] == "ig\n"


@pytest.mark.parametrize(
    "pattern,cs",
    [
        (r"\bqu\w+", False),
        (r"th[aeiou][a-z]{2,4}", False),
        (r"qu[a-z]+", True),
        (r"[A-Z][a-z]+ing\b", True),
        (r"(?:der|die|das)\s", False),
        (r"\d+", True),
        (r"é[a-z]?", True),
        (r"en(?=t)", True),
        (r"x*", True),
        (r"^\w+", False),
        (r"(\w)\1", True),
    ],
)
def test_native_and_python_routes_agree_on_documents(spark, pattern, cs):
    from trawl.sources import tables

    corp = tables.documents(spark, "/root/testdata/sf0.001")
    q = Query(pattern, regex=True, case_sensitive=cs)
    got = rows(search(corp, q))
    texts = corp.select("path", "text").collect()
    exp = []
    for r in texts:
        if r.text:
            exp.extend(python_findings_of(r.path, r.text, q, q.compiled()))
    exp.sort(key=lambda r: (r[0], r[1], r[3]))
    assert got == exp


def test_line_safety_classifier():
    safe = [r"abc", r"\bqu\w+", r"[a-z]+", r"a.b", r"(?:ab|cd){1,3}", r"\d{2,4}", r"[^\n]+x"]
    # Java recurses once per repetition of a group, so an unbounded one takes the Python route
    unsafe = [r"(?:ab|cd)+", r"(?:a+b?){2,9}", r"a\sb", r"^a", r"a$", r"x*", r"(?=a)", r"(a)\1", r"[^a]", r"(?s)a.b", r"\Aa", r"a|"]
    for p in safe:
        assert java_line_pattern(Query(p, regex=True, case_sensitive=True)) is not None, p
    for p in unsafe:
        assert java_line_pattern(Query(p, regex=True, case_sensitive=True)) is None, p
    # case-insensitive patterns with non-ASCII letters use the Python route
    assert java_line_pattern(Query("é", regex=True)) is None


def test_no_exchange_before_final_sort(spark, corpus):
    df = search(corpus(FILES), Query("world"), ordered=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # only the optional spreading of an under-partitioned scan may shuffle
    assert plan.count("Exchange") <= 1


def test_case_sets_cover_kelvin_sign_and_dotted_capital_i(corpus):
    # upper-case ranges are where Java's own (?iu) would disagree with Python; the
    # expanded case sets agree by construction
    files = {"/k.txt": "Kelvin K and İ here\nplain K", "/n.txt": "no special K"}
    for pat in ["[J-L]", "[H-J]", "k", "[a-z]+"]:
        q = Query(pat, regex=True)
        assert rows(search(corpus(files), q)) == model(files, q), pat


def test_required_literal_and_one_sided_boundaries():
    from trawl.functions.regex_dialect import required_literal

    assert required_literal(Query(r"\bQu\w+", regex=True)) == "qu"
    assert required_literal(Query(r"ab(c|d)efg", regex=True, case_sensitive=True)) == "efg"
    assert required_literal(Query(r"(?=x)", regex=True)) is None
    assert required_literal(Query("é+x", regex=True)) == "x"
    assert required_literal(Query("éx", regex=True)) is None  # non-ASCII under IGNORECASE
    j = java_line_pattern(Query(r"\bword\b", regex=True, case_sensitive=True))
    assert "(?<=" not in j and "(?<!" in j and "(?!" in j


def test_folded_letters_still_found_by_prefilter(corpus):
    # long s and dotless/dotted i match ASCII letters under IGNORECASE; the literal
    # prefilter must not drop such documents
    files = {"/f.txt": "ſub line\nİt is\nqıx", "/g.txt": "nothing"}
    for pat in [r"sub", r"\bit\b", r"q[a-z]x", r"qix"]:
        q = Query(pat, regex=True)
        assert rows(search(corpus(files), q)) == model(files, q), pat


def test_long_line_with_many_matches(corpus):
    # more than MANY_MATCHES occurrences on one line: offsets come from running totals
    long_line = " ".join(f"the{i} x THE y" for i in range(300))
    files = {"/l.txt": "head\n" + long_line + "\ntail the end", "/s.txt": "the short the"}
    for q in [Query("the", context_lines=1), Query(r"th[ae]\d*", regex=True), Query("THE", case_sensitive=True)]:
        assert rows(search(corpus(files), q)) == model(files, q), q


def test_large_context_fallback_matches_model(corpus):
    from trawl import search_many

    text = "\n".join(f"row {i} {'alpha' if i % 7 == 0 else 'beta'}" for i in range(120))
    files = {"/c.txt": text}
    q = Query("alpha", context_lines=40)  # above the unrolled limit
    assert rows(search(corpus(files), q)) == model(files, q)
    got = search_many(corpus(files), [q, Query("beta", context_lines=2)]).collect()
    assert sorted(tuple(r)[1:] for r in got if r.query_id == 0) == model(files, q)


def test_jvm_only_lowercase_letters_follow_python(corpus):
    # U+1C89 is lower-cased by the JVM but left alone by Python 3.13's str.lower()
    files = {"/u.txt": "xᲉy and xᲊy", "/v.txt": "plain"}
    for q in [Query("xᲉy"), Query("XᲊY")]:
        assert route(q) == "python"
        assert rows(search(corpus(files), q)) == model(files, q), q


def test_regexes_on_which_the_engines_differ(spark, corpus):
    from trawl import search_many

    # letters and digits of newer Unicode versions, characters outside the BMP next to boundaries, inline flags
    files = {
        "/a": "x\U0001F600x \U00010400x é\U00031350y 5٠\U0001D7D8 _x",
        "/b": "License license LICENSE",
        "/c": "ab" * 200 + "c",
    }
    patterns = [r"\bx", r"\B\w", r"\w+", r"\d", r"(?i)license", r"(?i)(?=l)license", r"(?:ab|c)+", r"(?i)\bLIC\w+"]
    queries = [Query(p, regex=True, case_sensitive=True) for p in patterns]
    for q in queries:
        assert rows(search(corpus(files), q)) == model(files, q), q.text
    got = search_many(corpus(files), queries).collect()
    for i, q in enumerate(queries):
        assert sorted(tuple(r)[1:] for r in got if r.query_id == i) == sorted(model(files, q)), q.text


def test_a_repeated_group_over_a_long_line_survives(corpus):
    found = search(corpus({"/long": "ab" * 75_000 + "c"}), Query(r"(?:ab|c)+", regex=True, context_lines=0), ordered=False)
    assert [len(r.match_text) for r in found.select("match_text").collect()] == [150_001]


def test_offsets_on_a_line_with_many_matches(corpus):
    n = 3_000
    for q in (Query("THE", context_lines=0), Query(r"c[a-z]t", regex=True, context_lines=0)):
        found = search(corpus({"/many": "the cat " * n}), q, ordered=False)
        at = sorted(r[0] for r in found.select("char_start_in_line").collect())
        assert at == [8 * i + (0 if not q.regex else 4) for i in range(n)]
