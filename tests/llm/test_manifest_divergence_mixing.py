"""Merkle manifest, source divergence and source mixing against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from trawl.llm import merkle_manifest, queries, source_divergence, source_mixing

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row string, size int, path int, tie int, src string, grp string, rank int, term string, copies int"
)
EXTRA = ("x", 1, 2, 3, "s", "g", 4, "t", 5)


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["", None, "one two\nthree", "One\ttwo", "é𝄞 Ça ça l'eau", "   \n", "a b c d e f g " * 40, "word " * 5000, "x1y2z3", "Ünï"]
    rows = []
    for i in range(140):
        text = texts[i % len(texts)] if i % 3 else f"common words stay common {'rare ' * (i % 7)}w{chr(97 + i % 26)}\nline {i}"
        source = None if i % 11 == 0 else "hot" if i % 2 else f"s{i % 5}"
        rows.append((None if i % 50 == 7 else i, text, None if i % 13 == 0 else "en" if i % 4 else "de", source, None if i % 17 == 0 else i))
    rows += [rows[4]] * 30 + [(4, "another text", "en", "hot", 1), (3000, "lonely one", "fr", "alone", 1), (-5, None, None, None, None)]
    return spark.createDataFrame([r + EXTRA for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    fields = (r.doc_id, r.source, r.lang, r.n_chars, text)
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def tree(leaves):
    """(root, proofs): for each leaf its levels, each (left siblings, right siblings)."""
    level, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            proofs[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            at[k] = i // 3
        level = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], proofs


def manifest_by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted(groups[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text))) for s in names}
    made = {s: tree([leaf(r, r.text) for r in order[s]]) for s in names}
    root, tops = tree([made[s][0] for s in names])
    out = []
    for s, up in zip(names, tops):
        for r, path in zip(order[s], made[s][1]):
            path = path + up
            hit = r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            node = leaf(r, r.text.replace("\n", "") if hit else r.text)
            for left, right in path:
                node = sha(left, node, right)
            out.append((r.doc_id, leaf(r, r.text), made[s][0], root, sha(*[x + y for x, y in path]), node, node == root))
    return Counter(out)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(docs, spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 3**levels)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle_manifest(spark, str(tmp_path)).collect()
    want = manifest_by_hand(docs.collect())
    assert Counter(tuple(r) for r in got) == want
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_nothing_and_of_one_row(docs, empty):
    assert merkle_manifest.manifest(empty).collect() == []
    (r,) = merkle_manifest.manifest(docs.where("source = 'alone'")).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.path == [] and r.verified


def divergence_by_hand(rows, top):
    words = [(r.lang or "", r.source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), r.text or ""))) for r in rows]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, w in words:
        n[lang, source].update(w)
        df[lang].update(set(w))
    out = set()
    for lang in {x[0] for x in words}:
        kept = [t for t, k in df[lang].items() if k >= source_divergence.MIN_DOCS]
        sources = sorted({x[1] for x in words if x[0] == lang})
        count = {s: {t: n[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}

        def p(counts):
            return {t: 1 + 10**9 * (c + 1) // (sum(counts.values()) + len(kept)) for t, c in counts.items()}

        ps, q = {s: p(count[s]) for s in sources}, p(whole)
        for s in sources:
            pair = [(sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in kept), o) for o in sources if o != s]
            term = [((ps[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[s][t] and ps[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(items[:most], 1)}
    return out


@pytest.mark.parametrize("top", [1, 3, 200])
def test_divergence(docs, monkeypatch, top):
    monkeypatch.setattr(source_divergence, "TOP", top)
    monkeypatch.setattr(source_divergence, "STRETCH", 64)
    monkeypatch.setattr(source_divergence, "PAIRS_AT_ONCE", 7)
    got = source_divergence.audit(docs).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert {tuple(r) for r in got} == divergence_by_hand(docs.collect(), top)


def test_divergence_of_nothing_and_without_kept_terms(spark, empty):
    assert source_divergence.audit(empty).collect() == []
    rows = [("a", "en", "x"), (None, "en", "y"), ("b", "de", None)]
    got = source_divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string")).collect()
    assert {tuple(r) for r in got} == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}


def test_skyband_keeps_every_possible_winner():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = 4000
    c, extra = rng.integers(1, 40, n), rng.integers(0, 40, n)
    cols = [pa.array(["en"] * n), pa.array(["s"] * n), pa.array([f"t{i:05d}" for i in range(n)]), pa.array(c), pa.array(c + extra)]
    batch = pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "lang_n"])
    kept = pa.Table.from_batches(list(source_divergence.skyband([batch.slice(0, 1500), batch.slice(1500)])))
    names = set(kept.column("term").to_pylist())
    beaten = lambda i: int(((c[:i] >= c[i]) & ((c + extra)[:i] <= (c + extra)[i])).sum())
    assert names == {f"t{i:05d}" for i in range(n) if beaten(i) < source_divergence.TOP}
    assert len(names) < n


def targets_by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target = Fraction(3 * sum(sizes.values()), 2), {}
    while len(target) < len(names):
        rest = [s for s in names if s not in target]
        aim = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if aim[s] > 2 * sizes[s]]
        for s in above or rest:
            target[s] = 2 * sizes[s] if above else aim[s]
            left -= target[s]
    return target


def test_mixing(docs, empty):
    plan = source_mixing.plan_mix(docs, whole_rows=True).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in plan:
        assert r.size == size(r.row.text) and r.doc_id == r.row.doc_id and 0 <= r.copies <= 2
        s = r.row.source
        sizes[s] += r.size
        taken[s] += r.size * r.copies
        largest[s] = max(largest[s], r.size)
    target = targets_by_hand(sizes)
    for r in plan:
        s = r.row.source
        assert r.source_size == sizes[s] and r.target == pytest.approx(float(target[s]))
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    assert sum(target.values()) == Fraction(3 * sum(sizes.values()), 2)
    again = source_mixing.plan_mix(docs.repartition(2)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.copies, r.target)
    assert sorted(map(key, again)) == sorted(map(key, plan))
    assert source_mixing.plan_mix(empty).collect() == [] and source_mixing.mixture(empty).collect() == []


def test_mixture_holds_the_rows(docs):
    mix = source_mixing.mixture(docs)
    assert mix.columns == docs.columns
    plan = Counter()
    for r in source_mixing.plan_mix(docs, whole_rows=True).collect():
        plan[tuple(r.row)] += r.copies
    assert Counter(map(tuple, mix.collect())) == +plan


def test_targets_are_exact_for_many_sources(spark):
    from trawl.llm.scratch import Scratch

    sizes = {f"={i:03d}": (i * i * 7919) % 1000 + (10**12 if i == 5 else 0) for i in range(100)}
    rows = spark.createDataFrame(list(sizes.items()), "src string, words long")
    want = targets_by_hand(sizes)
    for r in source_mixing.targets(rows, Scratch(spark, "test")).collect():
        assert r.target == pytest.approx(float(want[r.src]), rel=1e-12)
        assert r.words == 0 or abs(r.step - want[r.src] / r.words * 10**12) <= 1


def test_words_are_counted_as_by_the_pattern(spark):
    texts = ["", " ", "a", " a ", "a\x0bb\x0cc\rd\te\nf", "\x1c \x85  ", "x " * 10_000, "𝄞é z", "y" * 2_000_000, None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(source_mixing.count_words(F.col("text"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for t in texts]
