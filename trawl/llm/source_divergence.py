"""Source divergence audit: how far the sources of a language are apart in their words, and which
words set a source off from its language.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased.  A language keeps
the V terms that occur in at least ``MIN_DOCS`` of its documents.  A (lang, source) group, and a
language as a whole, gives each kept term p = 1 + floor(10^9 (count + 1) / (N + V)), N being its
count of all kept terms.  The divergence of p from q at one term is
f = floor((p - q)^2 / q); all arithmetic is exact.

* ``pair`` sums f over all kept terms for each two sources of a language.  A term that one or
  both sources lack has the same p for all such terms, so the sum is taken as V times the f of
  two missing terms, plus what the counts of either source change in that (from a histogram
  of its p), plus a correction at terms that both have.  Only the last needs terms with their
  sources side by side; a task adds these up in a table of source pairs.
* ``term`` reports the ``TOP`` kept terms of a group with the largest f among those with p > q.
  f rises with the group's count and falls with the language's, and ties go to the earlier
  term.  So a term that ``TOP`` others dominate (count no lower, language count no higher,
  earlier in UTF-8) cannot be reported: each partition keeps its skyband, the terms dominated
  by fewer than ``TOP`` others; the skybands are merged the same way, and what is left is
  ranked exactly.

Counting: a task counts the terms of a stretch of texts at a time (a very long text is several
stretches) and passes on (lang, source, term, count, documents), which Spark sums up.  Nothing is
gathered by language or source, so a source with a third of all rows is no task of its own.

Defined cases: null text, lang and source are ''; a group without terms appears with its pairs;
a language without kept terms has pair values 0; repeated rows and ids count as documents of their
own; the empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.scratch import Scratch

MIN_DOCS = 3
TOP = 200
SCALE = 10**9
#: Bounds of what a task holds: bytes of text read at once, pairs of sources compared at once, pairs
#: of sources summed up.
STRETCH = 1 << 24
PAIRS_AT_ONCE = 1 << 18
TABLE_PAIRS = 500_000
#: Rows of a group that the skyband looks at together.
RUN = 1024
#: Bundles in which the skybands of a group are merged.
BUNDLES = 8

#: Lower-cases A-Z and turns every other ASCII byte but a-z into a blank; terms are what blanks part.
_BLANKED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_NO_TERM = re.compile(rb"[^A-Za-z\x80-\xff]")
_COUNTS = "lang string, source string, term string, n long, docs long"
_NAMES = ["lang", "source", "term", "n", "docs"]


def _stretches(texts: pa.Array):
    """(rows, data, offsets): the rows of ``texts`` in order, together up to about ``STRETCH`` bytes; a longer
    text comes in several pieces that cut no term."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = memoryview(texts.buffers()[2] or b"")
    row = 0
    while row < len(texts):
        start = int(ends[row])
        upto = max(row + 1, int(np.searchsorted(ends, start + STRETCH, side="right")) - 1)
        if upto > row + 1 or ends[upto] - start <= STRETCH:
            yield np.arange(row, upto), data[start : int(ends[upto])], ends[row : upto + 1] - start
        else:
            end = int(ends[upto])
            while start < end:
                cut = _NO_TERM.search(data, min(start + STRETCH, end), end)
                stop = cut.end() if cut else end
                yield np.array([row]), data[start:stop], np.array([0, stop - start])
                start = stop
        row = upto


def _tokens(data: memoryview, offsets: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(text, term) of every occurrence in the texts that ``offsets`` cut ``data`` into."""
    blanked = pa.py_buffer(bytes(data).translate(_BLANKED))
    texts = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32).tobytes()), blanked)
    parts = pc.ascii_split_whitespace(texts)
    terms = parts.flatten()
    full = pc.not_equal(terms, "")  # blanks at the ends of a text
    return pc.list_parent_indices(parts).filter(full).to_numpy(), terms.filter(full).dictionary_encode()


def _per(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys and the sum of their weights."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[heads], np.add.reduceat(weight[order], heads)


def _term_counts(batches):
    """(lang, source, text) to term counts; a group is also told by a row with the term ''."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
        pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        pairs, group = np.unique(pair, return_inverse=True)
        named = lang.dictionary.take(pa.array(pairs // len(source.dictionary))), source.dictionary.take(pa.array(pairs % len(source.dictionary)))
        zero = pa.array(np.zeros(len(pairs), np.int64))
        yield pa.RecordBatch.from_arrays([*named, pa.array([""] * len(pairs)), zero, zero], names=_NAMES)
        long_row, long_terms = -1, set()
        for rows, data, offsets in _stretches(batch.column(2)):
            text, terms = _tokens(data, offsets)
            if not len(terms):
                continue
            wide = len(terms.dictionary)
            key, n = _per(text.astype(np.int64) * wide + terms.indices.to_numpy(), np.ones(len(text), np.int64))
            docs = np.ones(len(key), np.int64)
            if len(rows) == 1:  # maybe a piece of a long text: a term counts once for the whole of it
                long_terms = long_terms if rows[0] == long_row else set()
                long_row = rows[0]
                found = [t.as_buffer().to_pybytes() for t in terms.dictionary.take(pa.array(key % wide))]
                docs = np.array([t not in long_terms for t in found], np.int64)
                long_terms.update(found)
            where = group[rows[key // wide]] * wide + key % wide
            key, counts = _per(where, n)
            docs = _per(where, docs)[1]
            at = pa.array(key // wide)
            yield pa.RecordBatch.from_arrays(
                [named[0].take(at), named[1].take(at), terms.dictionary.take(pa.array(key % wide)), pa.array(counts), pa.array(docs)],
                names=_NAMES,
            )


def _p(count, total, terms) -> Column:
    """p of a term with ``count``, from the group's ``total`` and its language's number of ``terms``."""
    return F.expr(f"1 + ({SCALE}BD * ({count} + 1)) div ({total} + {terms})")


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _runs(batch):
    """(start, end, group) of the rows of a batch that stand together, ``RUN`` at most."""
    lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
    code = lang.indices.to_numpy().astype(np.int64) * (len(source.dictionary) + 1) + source.indices.to_numpy()
    heads = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
    for head, end in zip(heads, heads[1:]):
        group = (lang[head].as_py(), source[head].as_py())
        for start in range(head, end, RUN):
            yield start, min(start + RUN, end), group


def skyband(batches):
    """Rows (lang, source, term, n, lang_n) sorted by group and term, without those that ``TOP`` earlier
    ones of their group dominate.  Later terms never dominate, so a row that stays is passed on at
    once; domination by rows that stay is all that counts, as it is transitive.  Rows that are alike
    in both counts (a cell) are counted together, and a cell found dominated is so for good."""
    group, cells = None, None
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for start, end, now in _runs(batch) if batch.num_rows else ():
            if now != group:
                group, cells = now, np.zeros((3, 0), np.int64)  # count, language count, rows that stay
            n, lang_n = (batch.column(k).slice(start, end - start).to_numpy() for k in (3, 4))
            wide, of = np.unique(lang_n, return_inverse=True)
            key = np.unique(n, return_inverse=True)[1] * len(wide) + of
            _, first, cell = np.unique(key, return_index=True, return_inverse=True)
            n, lang_n = n[first], lang_n[first]
            over, stay = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            for k in range(0, cells.shape[1], RUN):
                c, w, rows = cells[:, k : k + RUN]
                over += rows @ ((c[:, None] >= n) & (w[:, None] <= lang_n))
            for i in np.flatnonzero(over[cell] < TOP).tolist():
                at = cell[i]
                if over[at] < TOP:
                    keep[start + i] = True
                    stay[at] += 1
                    over += (n <= n[at]) & (lang_n >= lang_n[at])
            cells = np.concatenate([cells, np.stack([n, lang_n, stay])[:, stay > 0]], axis=1)
            if cells.shape[1] > 4 * RUN:  # cells met in several runs become one again
                both, back = np.unique(cells[:2], axis=1, return_inverse=True)
                cells = np.concatenate([both, np.bincount(back.ravel(), cells[2])[None].astype(np.int64)])
        yield batch.filter(pa.array(keep))


def _shared_terms(batches):
    """(lang, array of (sid, p, p0) of the sources that have one term) to (lang, a, b, high, low): for
    each two sources, high * 2^32 + low is the sum over these terms of
    f(pa, pb) - f(pa, p0b) - f(p0a, pb) + f(p0a, p0b)."""
    sums: dict = {}

    def told():
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                    pa.array([k[2] for k in keys], pa.int32()), pa.array([sums[k] >> 32 for k in keys], pa.int64()),
                    pa.array([sums[k] & 0xFFFFFFFF for k in keys], pa.int64()),
                ],
                names=["lang", "a", "b", "high", "low"],
            )
        sums.clear()

    def f(p, q):
        return (p - q) ** 2 // q

    for batch in batches:
        codes = batch.column(0).dictionary_encode()
        names = codes.dictionary.to_pylist()
        lists = batch.column(1)
        sid, p, p0 = (lists.flatten().field(k).to_numpy().astype(np.int64) for k in range(3))
        size = np.asarray(lists.value_lengths().to_numpy(), np.int64)
        lang = np.repeat(codes.indices.to_numpy().astype(np.int64), size)
        mates, first = np.repeat(size, size), np.repeat(np.cumsum(size) - size, size)
        upto = np.cumsum(mates)
        wide = int(sid.max(initial=0)) + 1
        lo = 0
        while lo < len(sid):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")))
            part = mates[lo:hi]
            a = np.repeat(np.arange(lo, hi), part)
            b = np.arange(len(a)) - np.repeat(np.cumsum(part) - part, part) + first[a]
            a, b = a[a != b], b[a != b]
            value = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
            key = (lang[a] * wide + sid[a]) * wide + sid[b]
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
            if len(key):
                high, low = np.add.reduceat(value >> 32, heads), np.add.reduceat(value & 0xFFFFFFFF, heads)
                for k, h, w in zip(key[heads].tolist(), high.tolist(), low.tolist()):
                    name = (names[k // wide // wide], k // wide % wide, k % wide)
                    sums[name] = sums.get(name, 0) + (h << 32) + w
            if len(sums) > TABLE_PAIRS:
                yield from told()
            lo = hi
    yield from told()


def _kept_terms(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(kept, groups): ``kept(lang, source, sid, term, n, lang_n, p, p0, q)`` with a row for each kept term of each
    group that has it, and ``groups(lang, source, sid, total, terms, p0)``."""
    part = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = part.mapInArrow(_term_counts, _COUNTS).groupBy("lang", "source", "term")
    counts = scratch.put(found.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    alike = Window.partitionBy("lang", "term")
    kept = scratch.put(
        counts.where("term <> ''")
        .select(
            "lang", "source", "term", "n", F.sum("n").over(alike).alias("lang_n"), F.sum("docs").over(alike).alias("docs"),
            (F.col("source") == F.min("source").over(alike)).alias("first"),
        )
        .where(f"docs >= {MIN_DOCS}"),
        "terms",
    )
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.when(F.col("first"), 1)).alias("terms"))
    totals = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left")
    totals = totals.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms")])
    lang = Window.partitionBy("lang")
    groups = totals.select(
        "lang", "source", (F.row_number().over(lang.orderBy("source")) - 1).alias("sid"), "total",
        F.sum("total").over(lang).alias("lang_total"), F.sum("terms").over(lang).alias("terms"),
    )
    groups = scratch.put(groups.withColumn("p0", F.when(F.col("terms") > 0, _p("0", "total", "terms"))), "groups")
    rows = kept.drop("first", "docs").join(groups, ["lang", "source"])
    rows = rows.select(
        "lang", "source", "sid", "term", "n", "lang_n", _p("n", "total", "terms").alias("p"), "p0",
        _p("lang_n", "lang_total", "terms").alias("q"),
    )
    return scratch.put(rows, "kept"), groups


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every ordered pair of sources of a language."""
    exact = "cast({} as decimal(38,0))".format
    one = groups.select("lang", F.col("sid").alias("a"), F.col("p0").alias("p0a"), F.col("source"), "terms")
    two = groups.select("lang", F.col("sid").alias("b"), F.col("p0").alias("p0b"), F.col("source").alias("item"))
    pairs = one.join(two, "lang").where("a <> b")
    none = f"coalesce({exact('terms')} * ({_f('p0a', 'p0b')}), 0BD)"
    base = pairs.select("lang", "a", "b", F.expr(exact(none)).alias("value"))
    bars = kept.groupBy("lang", F.col("sid").alias("a"), "p", F.col("p0").alias("p0a")).agg(F.count(F.lit(1)).alias("k"))
    bars = bars.join(two.drop("item"), "lang").where("a <> b")
    ways = [("a", "b", f"{_f('p', 'p0b')} - {_f('p0a', 'p0b')}"), ("b", "a", f"{_f('p0b', 'p')} - {_f('p0b', 'p0a')}")]
    either = bars.select("lang", F.inline(F.array(*[
        F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.expr(exact(f"k * cast({change} as decimal(20,0))")).alias("value"))
        for x, y, change in ways
    ])))
    beside = kept.groupBy("lang", "term").agg(F.collect_list(F.struct("sid", "p", "p0")).alias("have"))
    both = beside.select("lang", "have").mapInArrow(_shared_terms, "lang string, a int, b int, high long, low long")
    both = both.select("lang", "a", "b", F.expr(exact("cast(high as decimal(20,0)) * 4294967296BD + low")).alias("value"))
    sums = base.union(either).union(both).groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value"))
    return pairs.select("lang", "a", "b", "source", "item").join(sums, ["lang", "a", "b"]).select("lang", "source", "item", "value")


def _terms(kept: DataFrame) -> DataFrame:
    """lang, source, item, value of the terms that may rank among the ``TOP`` of their group."""
    band = kept.where("p > q").select("lang", "source", "term", "n", "lang_n", "p", "q")
    by = ("lang", "source", "term")
    band = band.sortWithinPartitions(*by).mapInArrow(skyband, band.schema)
    bundle = F.pmod(F.xxhash64("term"), F.lit(BUNDLES))
    band = band.repartition("lang", "source", bundle).sortWithinPartitions(*by).mapInArrow(skyband, band.schema)
    return band.select("lang", "source", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank`` (see the module) for ``docs(text, lang, source)``."""
    scratch = Scratch(docs.sparkSession, "divergence")
    kept, groups = _kept_terms(docs, scratch)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    parts = []
    for part, rows, most in (("pair", _pairs(kept, groups), None), ("term", _terms(kept), TOP)):
        rows = rows.withColumn("rank", F.row_number().over(order))
        rows = rows if most is None else rows.where(f"rank <= {most}")
        parts.append(rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank"))
    return parts[0].union(parts[1])
