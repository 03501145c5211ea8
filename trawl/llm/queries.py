"""The registered queries of the ``llm`` operators, with their oracles where SQL can
state the result.  Each applies its operator with production parameters to the whole
intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import (
    embedding_dedup,
    kdtree_search,
    language_id,
    license_scan,
    merkle_manifest,
    ngram_join,
    packing,
    secret_scan,
    sentencepiece_codec,
    sharding,
    source_divergence,
    source_mixing,
    url_filter,
)
from trawl.llm.scratch import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(url_filter.labelled_table(spark))
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), model)


def held_out():
    """The fold that is never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language_id.fit(docs, ~held_out())
    out = language_id.predict(docs, net)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), path)


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    carry = {"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(text)}
    placed = sharding.interleave(table(spark, sf_dir, "documents"), carry=carry)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's CRC-32 is even are tampered with: their texts lose the line feeds."""
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").contains("\n")
    bare = {"text": F.replace("text", F.lit("\n"), F.lit(""))}
    proofs = merkle_manifest.manifest(table(spark, sf_dir, "documents"), bare, hit)
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = source_mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_license_scans": op7_license_scans,
    "op8_sharding": op8_sharding,
    "op9_secret_scans": op9_secret_scans,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_source_divergence": op12_source_divergence,
    "op13_source_mixing": op13_source_mixing,
}

_SOUND = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_TOP_K = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND {_SOUND}),
s AS (
  SELECT a.n, a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.n <> b.n AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS r FROM s) x WHERE r <= 5
"""

_DEDUP = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND {_SOUND} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS norm FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= 0.98),
reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION SELECT l.b, reach.root FROM reach JOIN l ON l.a = reach.node),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""

_JACCARD = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS i
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * i >= 75 * (total - i)),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM s
  UNION SELECT l.b, reach.root FROM reach JOIN l ON l.a = reach.node),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN c ON c.node = s.doc_id
"""



def _leaf(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"


_DIGITS = "CAST(doc_id AS VARCHAR)"
_CRC_STEPS = (
    f"flatten(list_transform(range(1, length({_DIGITS}) + 1), "
    f"lambda i: [CAST(ascii(substr({_DIGITS}, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
)
#: CRC-32 of the decimal digits, one bit at a time.
_CRC = (
    f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_CRC_STEPS}), "
    "lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)), 4294967295)"
)


def _fold(name: str, nodes: str, start: str, same: str, top: str) -> str:
    """A recursive table that folds (id, g, i, cur) up the levels of ``nodes``."""
    return f"""{name} AS (
  {start}
  UNION ALL SELECT f.id, f.g, f.lvl + 1, f.i // 3,
    sha256(string_agg(CASE WHEN n.i = f.i THEN f.cur ELSE n.h END, '' ORDER BY n.i)),
    f.sibs || coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (WHERE n.i <> f.i), '')
  FROM {name} f JOIN {nodes} n ON n.lvl = f.lvl AND n.i // 3 = f.i // 3 {same} {top}
  GROUP BY f.id, f.g, f.lvl, f.i, f.cur, f.sibs)"""


_MANIFEST = f"""
WITH RECURSIVE v AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf("replace(text, chr(10), '')")} AS bare, {_CRC} % 2 = 0 AS hit FROM documents),
d AS (
  SELECT *, row_number() OVER () AS id, coalesce('=' || source, '') AS g,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM v),
n AS (
  SELECT g, 0 AS lvl, i, leaf AS h FROM d
  UNION ALL SELECT g, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM n) x WHERE c > 1 GROUP BY g, lvl, i // 3),
t AS (SELECT g, max(lvl) AS top, arg_max(h, lvl) AS subroot FROM n GROUP BY g),
o AS (SELECT g, subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM t),
m AS (
  SELECT 0 AS lvl, i, subroot AS h FROM o
  UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS c FROM m) x WHERE c > 1 GROUP BY lvl, i // 3),
r AS (SELECT max(lvl) AS top, arg_max(h, lvl) AS root FROM m),
{_fold("a", "n", "SELECT id, g, 0 AS lvl, i, CASE WHEN hit THEN bare ELSE leaf END AS cur, '' AS sibs FROM d",
       "AND n.g = f.g", "JOIN t ON t.g = f.g WHERE f.lvl < t.top")},
{_fold("b", "m", "SELECT a.id, a.g, 0 AS lvl, o.i, a.cur, a.sibs FROM a JOIN t ON t.g = a.g AND t.top = a.lvl JOIN o ON o.g = a.g",
       "", "JOIN r ON f.lvl < r.top")}
SELECT d.doc_id, d.leaf, t.subroot, r.root, sha256(b.sibs) AS proof_sha256, b.cur AS folded_root, b.cur = r.root AS verified
FROM b JOIN r ON b.lvl = r.top JOIN d ON d.id = b.id JOIN t ON t.g = d.g
"""

_DIVERGENCE = """
WITH w AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT id, lang, source, unnest(w) AS term FROM w),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM e GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
g AS (SELECT DISTINCT lang, source FROM w),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM e GROUP BY lang, source, term),
x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM g JOIN k ON k.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT *, 1 + 1000000000 * (n + 1) // (sum(n) OVER s + count(*) OVER s) AS p,
         1 + 1000000000 * (lang_n + 1) // (sum(lang_n) OVER s + count(*) OVER s) AS q
  FROM x WINDOW s AS (PARTITION BY lang, source)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source) f
  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
o AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""

_MIXING = """
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '>') AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT src, CAST(sum(size) AS HUGEINT) AS words FROM d GROUP BY src),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS HUGEINT) AS weight FROM s),
o AS (
  SELECT *, 3 * sum(words) OVER () - 4 * coalesce(sum(words) OVER before, 0) AS up,
         2 * (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS down FROM w
  WINDOW before AS (ORDER BY words * 6 // weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, weight * up > 2 * words * down AS held FROM o),
l AS (
  SELECT 3 * (SELECT sum(words) FROM h) - 4 * coalesce(sum(words) FILTER (WHERE held), 0) AS up,
         2 * sum(weight) FILTER (WHERE NOT held) AS down FROM h),
t AS (
  SELECT src, words, CASE WHEN held THEN CAST(2 * words AS DOUBLE)
         ELSE CAST(CAST(weight * l.up AS HUGEINT) AS DOUBLE) / CAST(CAST(l.down AS HUGEINT) AS DOUBLE) END AS target,
         CASE WHEN held THEN 2000000000000 ELSE 1000000000000 * weight * l.up // (greatest(words, 1) * l.down) END AS step,
         CAST('0x' || substr(md5('20240229:' || src), 1, 15) AS BIGINT) % 1000000000000 AS shift FROM h, l),
r AS (
  SELECT *, CAST(row_number() OVER (
    PARTITION BY src ORDER BY size, md5('20240229:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST) AS HUGEINT) AS i
  FROM d JOIN t USING (src))
SELECT doc_id, size, CAST(words AS BIGINT) AS source_size, target,
       CAST(((i * step + shift) // 1000000000000 - ((i - 1) * step + shift) // 1000000000000) * size AS BIGINT) AS taken
FROM r
"""

ORACLE_SQL: dict[str, str] = {
    "op4_exact_top_k": _TOP_K,
    "op5_embedding_dedup": _DEDUP,
    "op10_ngram_jaccard": _JACCARD,
    "op11_merkle_manifest": _MANIFEST,
    "op12_source_divergence": _DIVERGENCE,
    "op13_source_mixing": _MIXING,
}
