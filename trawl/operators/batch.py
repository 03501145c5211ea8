"""Several queries over one corpus in one pass.

The original tool runs one query per call.  A batch of queries that the JVM can
answer (literals and line-safe regexes) is answered here with a single scan: the
document test is the OR of the queries' tests, every query's hit lines are generated
from the same per-document line arrays, and each hit line carries its ``query_id``.
Per-query patterns are selected with ``CASE query_id``, so every branch keeps a
literal (compiled once) pattern.  Documents whose lower-casing shifts offsets are
answered for all case-insensitive literals by one Arrow UDF inside the same plan.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.regex_dialect import java_line_pattern, jvm_may_differ, literal_test, required_literal
from trawl.functions.text import highlight, java_literal, newline_lines, number_prefix, splitlines
from trawl.model import SNIPPET_LINE_MISMATCH, Query
from trawl.operators.match import LENGTH_CHANGING_LOWER, line_chunks, line_part, prefix_length, python_findings_of, with_block_sums

PY_BATCH_TYPE = (
    "array<struct<query_id:int,line_number:bigint,match_text:string,char_start_in_line:bigint,"
    "char_end_in_line:bigint,snippet:string>>"
)


def _case(qid: Column, values: list[Column], default: Column | None = None) -> Column:
    out = None
    for i, v in enumerate(values):
        out = F.when(qid == i, v) if out is None else out.when(qid == i, v)
    return out.otherwise(default) if default is not None else out


def _python_batch_udf(queries: list[Query], ids: list[int]):
    qs = [(i, queries[i]) for i in ids]

    @F.pandas_udf(PY_BATCH_TYPE)
    def findings_of(texts: pd.Series) -> pd.Series:
        compiled = [(i, q, q.compiled() if q.regex else None) for i, q in qs]
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            rows = []
            for i, q, pattern in compiled:
                for r in python_findings_of("", t, q, pattern):
                    rows.append(
                        {"query_id": i, "line_number": r[1], "match_text": r[2], "char_start_in_line": r[3],
                         "char_end_in_line": r[4], "snippet": r[5]}
                    )
            out.append(rows)
        return pd.Series(out, dtype=object)

    return findings_of


def native_many(docs: DataFrame, queries: list[Query]) -> DataFrame:
    """``query_id`` + findings of every query (all must take the JVM route)."""
    text = F.col("text")
    kinds, pats, needles, lens = [], [], [], []
    for q in queries:
        if q.regex:
            kinds.append("regex")
            pats.append(java_line_pattern(q))
            needles.append(required_literal(q))
        else:
            kinds.append("ci" if not q.case_sensitive else "cs")
            needles.append(q.text.lower() if not q.case_sensitive else q.text)
            pats.append(java_literal(needles[-1]))
        lens.append(len(q.text))
    ci_ids = [i for i, k in enumerate(kinds) if k == "ci"]
    # documents on which the JVM may not mean what Python means, and the queries concerned
    differ = {i: jvm_may_differ(q, text) for i, q in enumerate(queries) if q.regex}
    differ = {i: test for i, test in differ.items() if test is not None}
    py_ids = sorted([*ci_ids, *differ])
    odd_tests = [*([text.contains(LENGTH_CHANGING_LOWER)] if ci_ids else []), *differ.values()]

    # one document test for the whole batch
    tests = []
    for q, k, pat, must in zip(queries, kinds, pats, needles):
        if k == "regex":
            alone = text.rlike(pat) if q not in [queries[i] for i in differ] else text.rlike(pat) | jvm_may_differ(q, text)
            tests.append(literal_test(text, q, must) if must else alone)
        elif k == "ci":
            tests.append(F.lower(text).contains(must))
        else:
            tests.append(text.contains(must))
    cond = tests[0]
    for t in tests[1:]:
        cond = cond | t
    cand = docs.where(cond)

    from trawl.plans.search import spread

    ol = newline_lines(text)
    cols = [F.col("path"), ol.alias("ol"), splitlines(text, ol).alias("sl")]
    if ci_ids:
        cols.append(newline_lines(F.lower(text)).alias("ll"))
    if py_ids:
        odd = odd_tests[0]
        for test in odd_tests[1:]:
            odd = odd | test
        cols += [odd.alias("odd"), _python_batch_udf(queries, py_ids)(F.when(odd, text)).alias("py")]
    lines = spread(cand).select(*cols)
    olc, slc = F.col("ol"), F.col("sl")
    llc = F.col("ll") if ci_ids else olc
    nsl = F.size(slc)
    width = max(q.context_lines for q in queries)

    py_null = F.lit(None).cast(PY_BATCH_TYPE)

    def hit_struct(j: int, py: Column | None = None):
        def one(i):
            first = F.greatest(i - width, F.lit(0))
            count = F.greatest(F.least(nsl, i + width + 1) - first, F.lit(0))
            probe = F.get(llc, i) if j >= 0 and kinds[j] == "ci" else F.get(olc, i)
            return F.struct(
                F.lit(j).alias("qid"), i.alias("li"), F.get(olc, i).alias("line"), probe.alias("probe"),
                first.alias("ctx_first"), F.slice(slc, first + 1, count).alias("ctx"), nsl.alias("nsl"),
                (py if py is not None else py_null).alias("py"),
            )

        return one

    arrays = []
    def line_test(q: Query, k: str, pat: str, must: str | None):
        if k == "regex" and must:
            return lambda i: literal_test(F.get(olc, i), q, must) & F.get(olc, i).rlike(pat)
        if k == "regex":
            return lambda i: F.get(olc, i).rlike(pat)
        if k == "ci":
            return lambda i: F.get(llc, i).contains(must)
        return lambda i: F.get(olc, i).contains(must)

    for j, (q, k, pat, must) in enumerate(zip(queries, kinds, pats, needles)):
        test = line_test(q, k, pat, must)
        arr = F.transform(F.filter(F.sequence(F.lit(0), F.size(olc) - 1), test), hit_struct(j))
        if j in py_ids:  # these documents are answered by Python below
            arr = F.when(F.col("odd"), F.filter(arr, lambda _h: F.lit(False))).otherwise(arr)
        arrays.append(arr)
    if py_ids:
        pseudo = F.transform(
            F.when(F.col("odd"), F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")), hit_struct(-1, F.col("py"))
        )
        arrays.append(pseudo)
    hits = lines.select("path", F.explode(F.concat(*arrays)).alias("h"))

    h = F.col("h")
    qid, li = h["qid"], h["li"]
    ctxs = [q.context_lines for q in queries]

    def slot(idx, d):
        line = F.get(h["ctx"], idx - h["ctx_first"])
        allowed = _case(qid, [F.lit(d <= c) for c in ctxs], F.lit(False))
        return F.when(allowed & (idx >= 0) & line.isNotNull(), F.concat(number_prefix(idx + 1), line))

    hits = hits.select(
        "path", "h",
        F.concat_ws("\n", *[slot(li - d, d) for d in range(width, 0, -1)]).alias("before"),
        F.concat_ws("\n", *[slot(li + d, d) for d in range(1, width + 1)]).alias("after"),
        F.get(h["ctx"], li - h["ctx_first"]).alias("sline"),
        _case(qid, [F.split(h["line"] if kinds[j] == "regex" else h["probe"], pats[j], -1) for j in range(len(queries))]).alias("pieces"),
        _case(qid, [F.regexp_extract_all(h["line"], F.lit(pats[j]), F.lit(0)) if kinds[j] == "regex"
                    else F.array().cast("array<string>") for j in range(len(queries))]).alias("found"),
    )
    hits = with_block_sums(hits, ["pieces", "found"]).withColumn("chunks", line_chunks(F.col("h.line")))
    pyrow = qid < 0
    is_regex = _case(qid, [F.lit(k == "regex") for k in kinds], F.lit(False))
    n_occ = F.when(pyrow, F.size(h["py"])).when(is_regex, F.size("found")).otherwise(F.size("pieces") - 1)
    occ = F.when(n_occ > 0, F.sequence(F.lit(0), n_occ - 1)).otherwise(F.array().cast("array<int>"))
    m = hits.select("path", "h", "before", "after", "sline", "pieces", "found", "pieces_sums", "found_sums", "chunks", F.explode(occ).alias("k"))
    k = F.col("k")
    prefix = prefix_length("pieces", k + 1)
    qlen = _case(qid, [F.lit(n) for n in lens], F.lit(0))
    start = F.when(is_regex, prefix + prefix_length("found", k)).otherwise(prefix + k * qlen)
    m = m.select(
        "path", "h", "before", "after", "sline", "chunks", start.alias("start"),
        F.when(is_regex, F.get(F.col("found"), k)).alias("found_k"),
        F.when(pyrow, F.get(h["py"], k)).alias("f"),
    )
    matched = F.when(is_regex, F.col("found_k")).otherwise(line_part("chunks", F.col("start"), qlen))
    m = m.withColumn("matched", matched)
    st, end = F.col("start"), F.col("start") + F.length("matched")
    body = F.concat_ws(
        "\n", F.nullif(F.col("before"), F.lit("")), F.concat(number_prefix(li + 1), highlight(F.col("sline"), st, end)),
        F.nullif(F.col("after"), F.lit("")),
    )
    f = F.col("f")
    out = {
        "query_id": F.when(pyrow, f["query_id"]).otherwise(qid).cast("long"),
        "file_path": F.col("path"),
        "line_number": F.when(pyrow, f["line_number"]).otherwise((li + 1).cast("long")),
        "match_text": F.when(pyrow, f["match_text"]).otherwise(F.col("matched")),
        "char_start_in_line": F.when(pyrow, f["char_start_in_line"]).otherwise(st.cast("long")),
        "char_end_in_line": F.when(pyrow, f["char_end_in_line"]).otherwise(end.cast("long")),
        "snippet": F.when(pyrow, f["snippet"]).otherwise(F.when(li < h["nsl"], body).otherwise(F.lit(SNIPPET_LINE_MISMATCH))),
    }
    return m.select(*[v.alias(c) for c, v in out.items()])
