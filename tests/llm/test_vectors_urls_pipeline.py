"""Vector operators, URL filters and the pipeline against brute force."""

import numpy as np
import pytest

from trawl.llm import embedding_dedup, kdtree_search, url_filter


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(300):
        v = base[i % 12] + rng.normal(size=16) * (0.05 if i % 3 else 0.4)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2, "x"))
    rows += [
        (300, rows[0][1], 0, "x"), (301, rows[0][1], 0, "x"), (302, None, 1, "x"), (303, [0.0] * 16, 1, "x"),
        (304, [float("nan")] * 16, 1, "x"), (305, [1.0] * 15 + [None], 0, "x"), (306, rows[0][1], None, "x"),
        (307, [1.0, 2.0], 0, "x"), (308, [], 0, "x"), (None, rows[0][1], 0, "x"), (350, rows[3][1], 1, "x"),
    ]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, list string")


def sound(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


def test_near_duplicates(vectors, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "ROWS_PER_LIST", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rows = vectors.collect()
    good = [r for r in rows if r.vec_id is not None and r.label is not None and sound(r.embedding) and any(r.embedding)]
    links = {r.vec_id: set() for r in rows if r.vec_id is not None}
    for a in good:
        for b in good:
            if a.vec_id != b.vec_id and a.label == b.label and len(a.embedding) == len(b.embedding):
                x, y = np.array(a.embedding), np.array(b.embedding)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[a.vec_id].add(b.vec_id)
    best = {i: i for i in links}
    for _ in range(40):
        for i, others in links.items():
            for j in others:
                best[i] = best[j] = min(best[i], best[j])
    got = embedding_dedup.near_duplicates(vectors).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        else:
            assert (r.n_links, r.component_id, r.kept) == (len(links[r.vec_id]), best[r.vec_id], best[r.vec_id] == r.vec_id)
    assert sum(map(len, links.values())) > 100
    assert embedding_dedup.near_duplicates(vectors.limit(0)).collect() == []


def test_near_duplicates_of_doubles_of_any_size(spark):
    base = [0.3, -0.2, 0.9, 0.1]
    rows = [(i, [x * scale for x in base], 1) for i, scale in enumerate([1e-300, 1.0, 1e200, 1e307])]
    rows += [(4, [1e200, 1e-300, 0.0, 0.0], 1), (5, [5e-324, 0.0, 0.0, 0.0], 1), (6, [-1e307, 0.0, 0.0, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(table).collect())
    assert got == [(0, 3, 0), (1, 3, 0), (2, 3, 0), (3, 3, 0), (4, 1, 4), (5, 1, 4), (6, 0, 6)]


def test_kdtree_search(vectors, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(kdtree_search, "SHARD_ROWS", 60)
    monkeypatch.setattr(kdtree_search, "LEAF", 8)
    monkeypatch.setattr(kdtree_search, "QUERY_BLOCK", 3)
    rows = [(r.vec_id, np.floor(256 * np.array(r.embedding)).astype(int)) for r in vectors.collect() if r.vec_id is not None and sound(r.embedding)]
    expected = []
    for i, q in rows:
        if i % 50 == 0:
            scores = sorted((-int(q @ v), j) for j, v in rows if j != i and len(v) == len(q))[:5]
            expected += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    got = kdtree_search.top_k(vectors, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert kdtree_search.top_k(vectors.limit(0), F.lit(True)).collect() == []
    few = vectors.where("vec_id < 3")
    assert few.count() == 3 and kdtree_search.top_k(few, F.lit(True)).count() == 6


def test_kdtree_search_of_repeated_ids_and_large_components(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(kdtree_search, "SHARD_ROWS", 5)
    monkeypatch.setattr(kdtree_search, "LEAF", 2)
    rng = np.random.default_rng(9)
    ids = [50, 50, 50, 100, *range(1, 15), 7, 7]
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** float(rng.choice([0, 6, 9, 17, 30]))]) for i in ids]
    rows += [(50, rows[0][1]), (150, [1e308, -1e308, 1.0])]
    low, high = -(2**63), 2**63 - 1
    exact = [(i, [min(max(int(np.floor(256 * x)) if abs(x) < 1e300 else int(x), low), high) for x in v]) for i, v in rows]
    expected = []
    for at, (i, q) in enumerate(exact):
        if i % 50 == 0:
            found = sorted(
                (-min(max(sum(a * b for a, b in zip(q, v)), low), high), j) for n, (j, v) in enumerate(exact) if n != at
            )[:5]
            expected += [(i, k + 1, j, -s) for k, (s, j) in enumerate(found)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = kdtree_search.top_k(table, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def rule_of(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, None
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].lower() if rest.isascii() else rest[:cut], rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = (None, None)
    for action, rule in url_filter.RULES:
        at = rule.index("/")
        if (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:]):
            if best[1] is None or len(rule) > len(best[1]):
                best = (action, rule)
    return host, path, *best


def test_url_filter(spark):
    urls = [
        "http://WWW.Example.org/en/14?x#y", "https://example.org/es/", "https://a.example.org/es", "http://org", "http://org/",
        "http://notorg.com/fr/1", "ftp://x.com/de/9", "http://x.com?/de/", "no scheme", None, "", "://", "http://a://b/c",
        "https://casino-win.example.net/en/3", "https://library.example.net/en/3", "http://ex.org\n/en", "http://" + "a" * 5000 + ".net/",
    ]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(0, urls[0], "h", "r")], "page_id long, url string, host string, rule string")
    model = url_filter.fit(url_filter.labelled_table(spark))
    got = url_filter.judge(df, model).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, action, rule = rule_of(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        assert r.verdict == (action or ("block" if r.score >= 0.5 else "allow")) and 0 <= r.score <= 1
    by_url = {urls[r.page_id]: r.verdict for r in got}
    assert by_url[urls[13]] == "block" and by_url[urls[14]] == "allow"
    assert url_filter.judge(df.limit(0), model).collect() == []
    seen = url_filter.judge(url_filter.labelled_table(spark), model, keep=("url", "label"), rules=()).collect()
    assert np.mean([(r.verdict == "block") == bool(r.label) for r in seen]) > 0.97
    empty = url_filter.fit(df.limit(0).selectExpr("url", "1 AS label"))
    assert {r.verdict for r in url_filter.judge(df, empty, rules=()).collect()} == {"allow"}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from trawl.llm import secret_scan

    words = (("größe", "straße"), ("niña", "pequeña"), ("quick", "brown"), ("quick", "fox"))
    texts = [" ".join(f"{a}{k} {b}{k}" for k in range(60)) for a, b in words]
    rows = [(i, texts[i % 4] + f" number {i // 4} token = 'abcdefgh{i}'" if i < 80 else "123", ["de", "es", "en", "en"][i % 4], "s", 0) for i in range(84)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, str(tmp_path))
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert kept.columns == docs.columns
        if name == "language_id":
            assert {r.doc_id for r in kept.collect()} == set(range(80))
        if name == "ngram_jaccard":
            ids = {r.doc_id for r in kept.collect()}
            assert ids < {r.doc_id for r in before.collect()} and 0 in ids
        if name == "secret_scans":
            assert all(secret_scan.MASK in r.text and "abcdefgh" not in r.text and len(r.text) == r.n_chars for r in kept.collect())
    assert {r.doc_id for r in kept.collect()} == ids


def test_near_duplicate_stage_leaves_texts_in_place(spark):
    """The ids to drop go to the texts, whatever size the session broadcasts by itself."""
    from trawl.llm import ngram_join

    rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(30)) + (" end" if i % 2 else "")) for i in range(20)]
    rows += [(0, rows[0][1]), (None, rows[0][1]), (30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ngram_join.representatives(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        got = [r.doc_id for r in kept.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    assert sorted(got, key=str) == sorted([*range(0, 20, 2), 30, None], key=str)


def letters_net(k):
    """A network that is sure of language i at the i-th letter and of nothing at 'z'."""
    from trawl.llm import language_id

    size = language_id.HIDDEN
    net = language_id.Network(
        [f"l{i}" for i in range(k)], np.zeros((2, 257, 3 * size), np.float32), np.zeros((2, size, 3 * size), np.float32),
        np.zeros((2, size, k), np.float32), np.zeros(k, np.float32),
    )
    net.inputs[:, :, :size] = -20
    for i in range(k):
        net.inputs[:, ord("a") + i, 2 * size + i] = 5
        net.out[:, i, i] = 5
    net.least = 0.4
    return net


@pytest.mark.parametrize("k", [2, 3, 4, 8])
def test_language_stage_does_not_depend_on_the_number_of_languages(spark, monkeypatch, k):
    import corpus_pipeline
    from trawl.llm import language_id

    monkeypatch.setattr(language_id, "fit", lambda *a, **b: letters_net(k))
    shared = "".join(chr(ord("a") + i) * 16 for i in range(k)) * 4
    rows = [(0, "z" * 200, None), (1, shared, None), (2, "b" * 100, None), (3, "123", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_stage(spark, docs, "").collect()}
    assert set(got) == {1, 2} and got[2] == "l1"


def test_language_stage_carries_columns_of_any_name(spark, monkeypatch):
    import corpus_pipeline
    from trawl.llm import language_id

    monkeypatch.setattr(language_id, "fit", lambda *a, **b: letters_net(2))
    schema = "doc_id long, text string, lang string, lang_pred string, Score double, sure_ int, confidence int"
    docs = spark.createDataFrame([(1, "aaaa", None, "x", 0.0, 3, 4)], schema)
    got = corpus_pipeline.language_stage(spark, docs, "")
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "aaaa", "l0", "x", 0.0, 3, 4)]


def test_least_confidence_keeps_labelled_and_mixed_texts(spark):
    import corpus_pipeline

    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["über", "straße", "größe"], "cc": ["привет", "город"], "dd": ["quick", "why"]}
    rows = [(10 * i + j, " ".join([w, words[y][0]] * 20), y) for i in range(60) for j, y in enumerate(words) for w in words[y][-1:]]
    mixed = " ".join(" ".join(w * 10) for w in words.values())
    docs = spark.createDataFrame([*rows, (5000, mixed, None)], "doc_id long, text string, lang string")
    got = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, "").collect()}
    assert got == {r[0] for r in rows} | {5000}
