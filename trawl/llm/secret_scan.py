"""Secret scans: a trigram inverted index picks the texts each rule has to look at.

From the parsed regex of a rule a Boolean trigram query is derived (an OR of ANDs): every
text that the rule matches holds all trigrams of one alternative.  Postings (trigram, text)
are collected for the trigrams that some query mentions, intersected per rule and
alternative by a grouped count, and only the candidates of a rule are matched against its
regex.  Rules without mandatory trigrams (a bare character class) scan every text.

Native: postings, intersection, matching and offsets are column expressions.  Offsets come
from the lengths of the pieces between matches, summed up in a window over the matches of
a text, so a text with very many matches costs in proportion.

Defined cases: null texts count as empty; repeated rows get equal answers; a null id is an
ordinary id; texts without a span have empty ``spans`` and the hash of the empty string;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as _c
from re import _parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.scratch import Scratch, fits_broadcast
from trawl.operators.match import line_chunks, line_part


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False  # ASCII letters only
    group: int = 0
    least: int = 1  # characters the group must have; shorter matches are dropped


# The base rules.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 20),
    Rule("hex", r"[0-9a-f]+", False, 0, 24),
)
# Rules of the method's own: well-known token formats.
OWN_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
RULES = BASE_RULES + OWN_RULES

#: Alternatives kept apart while a query is derived; beyond it a part counts as unknown.
MAX_ALTERNATIVES = 32


def _sequences(parsed) -> list[list[str | None]] | None:
    """The regex as alternatives of literal runs (None marks anything), or None."""
    options: list[list[str | None]] = [[]]
    for op, arg in parsed:
        if op is _c.LITERAL:
            part: list | None = [[chr(arg)]]
        elif op is _c.IN and all(o is _c.LITERAL for o, _ in arg) and len(arg) <= 6:
            part = [[chr(a)] for _, a in arg]
        elif op is _c.SUBPATTERN:
            part = _sequences(arg[3])
        elif op is _c.BRANCH:
            found = [_sequences(branch) for branch in arg[1]]
            part = None if any(f is None for f in found) else [seq for f in found for seq in f]
        elif op is _c.MAX_REPEAT and arg[0] == 0 and arg[1] == 1 and arg[2][0][0] is _c.LITERAL and len(arg[2]) == 1:
            part = [[], [chr(arg[2][0][1])]]
        elif op is _c.MAX_REPEAT and arg[0] > 0:
            inner = _sequences(arg[2])
            part = None if inner is None else [[*seq, None, *seq] for seq in inner]
        else:
            part = [[None]]
        if part is None or len(options) * len(part) > MAX_ALTERNATIVES:
            part = [[None]]
        options = [a + b for a, b in product(options, part)]
    return options


def trigram_query(rule: Rule) -> list[frozenset[str]]:
    """Alternatives of trigram sets over lower-cased text; empty when some alternative has
    no mandatory trigram (the rule then scans fully)."""
    query = set()
    for sequence in _sequences(_parser.parse(rule.pattern)):
        grams, run = set(), ""
        for piece in [*sequence, None]:
            if piece is None:
                run = run.lower()
                grams.update(run[i : i + 3] for i in range(len(run) - 2))
                run = ""
            else:
                run += piece
        if not grams:
            return []
        query.add(frozenset(grams))
    # an alternative that another one implies adds nothing
    return sorted((q for q in query if not any(o < q for o in query)), key=sorted)


def _java(rule: Rule) -> str:
    re.compile(rule.pattern)
    return ("(?i)" if rule.ignore_case else "") + rule.pattern


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """One row per distinct (id, text) with at least one span: ``key``, ``th`` (xxhash64 of
    the text) and ``found``, the spans (start, kind_no, end, kind) in order; offsets in
    code points, ends exclusive."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "secrets")
    slim = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn(
        "th", F.xxhash64("t")
    )
    queries = {no: trigram_query(rule) for no, rule in enumerate(rules)}
    grams = sorted({g for query in queries.values() for alt in query for g in alt})
    terms = [
        (grams.index(g), no, alt_no, len(alt))
        for no, query in queries.items()
        for alt_no, alt in enumerate(query)
        for g in sorted(alt)
    ]
    scanned = F.array(*[F.lit(no) for no, query in queries.items() if not query]).cast("array<int>")

    if terms:
        low = slim.select("k", "th", F.lower("t").alias("low"))
        held = F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(i)) for i, g in enumerate(grams)])
        postings = low.select("k", "th", F.explode(F.array_compact(held)).alias("gram"))
        wanted = spark.sql(
            "SELECT * FROM VALUES " + ", ".join(map(str, terms)) + " AS q(gram, rule, alternative, needed)"
        )
        # the terms are the rules' own and few: a broadcast bounded by the rule set
        hits = postings.join(F.broadcast(wanted), "gram")
        agreed = (
            hits.groupBy("k", "th", "rule", "alternative")
            .agg(F.count_distinct("gram").alias("n"), F.first("needed").alias("needed"))
            .where("n = needed")
        )
        candidates = scratch.put(agreed.groupBy("k", "th").agg(F.collect_set("rule").alias("rules")), "candidates")
        size = candidates.agg(F.count("th"), F.coalesce(F.max(F.length(F.col("k").cast("string"))), F.lit(0))).first()
        side = candidates.withColumnsRenamed({"k": "ck", "th": "cth"})
        if fits_broadcast(size[0], 64 + 4 * len(rules) + 4 * size[1]):
            side = F.broadcast(side)
        slim = slim.join(side, F.col("k").eqNullSafe(F.col("ck")) & (F.col("th") == F.col("cth")), "left")
        slim = slim.select("k", "t", "th", F.concat(F.coalesce("rules", F.array().cast("array<int>")), scanned).alias("rules"))
    else:
        slim = slim.select("k", "t", "th", scanned.alias("rules"))

    matches = {}
    for no, rule in enumerate(rules):
        regex = _kept_only(rule)
        asked = F.array_contains("rules", no) & F.col("t").rlike(regex)
        matches[f"m{no}"] = F.when(asked, F.regexp_extract_all("t", F.lit(regex), F.lit(0)))
        if rule.group:
            matches[f"g{no}"] = F.when(asked, F.regexp_extract_all("t", F.lit(regex), F.lit(rule.group)))
    slim = slim.withColumns(matches)
    parts = []
    for no, rule in enumerate(rules):
        pieces = F.when(F.size(f"m{no}") > 0, F.split("t", _kept_only(rule)))
        group = f"g{no}" if rule.group else f"m{no}"
        parts.append(F.struct(F.lit(no).alias("no"), F.lit(rule.least).alias("least"), pieces.alias("p"),
                              F.col(f"m{no}").alias("m"), F.col(group).alias("g")))
    slim = slim.select("k", "th", F.explode(F.filter(F.array(*parts), lambda x: F.size(x["m"]) > 0)).alias("x"))
    slim = slim.select("k", "th", "x.no", "x.least", F.posexplode(F.arrays_zip(F.col("x.p"), F.col("x.m"), F.col("x.g"))).alias("i", "y"))
    slim = slim.select("k", "th", "no", "least", "i", F.length("y.p").alias("gap"), F.length("y.m").alias("len"), F.length("y.g").alias("glen"))
    slim = slim.where("len is not null").dropDuplicates(["k", "th", "no", "i"])
    order = Window.partitionBy("k", "th", "no").orderBy("i")
    end = F.sum(F.col("gap") + F.col("len")).over(order)
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    spans = slim.withColumn("end", end).where("glen >= least")
    span = F.struct((F.col("end") - F.col("len")).alias("start"), F.col("no"), F.col("end"), kinds[F.col("no")].alias("kind"))
    return spans.groupBy(F.col("k").alias(key), "th").agg(F.array_sort(F.collect_list(span)).alias("found"))


def _kept_only(rule: Rule) -> str:
    """The Java pattern.  Where a rule is one bare run (after literal capitals that the run's class
    holds), its least length is part of the pattern: a match that begins later in a run is
    shorter still, so the matches are just those that are kept."""
    bare = re.fullmatch(r"((?:[A-Z]*)\[[^\]]+\])\+", rule.pattern)
    if bare and not rule.group and not rule.ignore_case:
        prefix = len(re.match(r"[A-Z]*", rule.pattern).group())
        return f"{bare.group(1)}{{{max(1, rule.least - prefix)},}}"
    return _java(rule)


def _digest_text(found: Column) -> Column:
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, ``n_assign``, ``n_access``, ``n_hex``,
    ``base_sha256`` and ``spans`` (``kind:start:end``, comma-joined, in order)."""
    found = find_secrets(docs, key, text).withColumnsRenamed({key: "fk", "th": "fth"})
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"))
    rows = rows.join(found, F.col("k").eqNullSafe(F.col("fk")) & (F.col("th") == F.col("fth")), "left")
    empty = F.array().cast("array<struct<start:bigint,no:int,end:bigint,kind:string>>")
    rows = rows.select("k", F.coalesce("found", empty).alias("found"))
    base = F.filter("found", lambda s: s["no"] < len(BASE_RULES))

    def count(no: int) -> Column:
        return F.size(F.filter("found", lambda s: s["no"] == no)).cast("long")

    counts = [count(no).alias(f"n_{rule.kind}") for no, rule in enumerate(BASE_RULES)]
    return rows.select(
        F.col("k").alias(key), *counts, F.sha2(_digest_text(base), 256).alias("base_sha256"),
        _digest_text(F.col("found")).alias("spans"),
    )


MASK = "[REDACTED]"


def _covered(found: DataFrame) -> DataFrame:
    """(_sk, _sth, _sm): for each text with spans the stretches that its spans cover, in order; spans that
    overlap are one stretch, spans that only touch are two."""
    spans = found.select("_sk", "_sth", F.explode("_sf").alias("s")).select("_sk", "_sth", "s.start", "s.end")
    order = Window.partitionBy("_sk", "_sth").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    head = F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")
    spans = spans.withColumn("head", head)
    stretch = F.sum("head").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stretches = spans.withColumn("no", stretch).groupBy("_sk", "_sth", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return stretches.groupBy("_sk", "_sth").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_sm"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The rows with every span replaced by ``MASK`` (overlapping spans by one); rows without
    spans are unchanged.  ``length``, if there, is set to the new length of changed texts.

    A text is read as chunks of a fixed number of characters, of which a piece between two
    stretches takes only its own, so a text costs in proportion to its length and its spans."""
    scratch = Scratch(docs.sparkSession, "redact")
    found = find_secrets(docs, key, text).select(F.col(key).alias("_sk"), F.col("th").alias("_sth"), F.col("found").alias("_sf"))
    cut = scratch.put(_covered(found), "stretches")
    n, spans, names = cut.agg(
        F.count("_sth"), F.coalesce(F.sum(F.size("_sm")), F.lit(0)),
        F.coalesce(F.max(F.length(F.col("_sk").cast("string"))), F.lit(0)),
    ).first()
    side = F.broadcast(cut) if fits_broadcast(1, n * (64 + 4 * names) + spans * 32) else cut
    same = F.col(key).eqNullSafe(F.col("_sk")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_sth"))
    rows = docs.join(side, same, "left")
    hit = F.col("_sm").isNotNull()
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("_sm", lambda s: s["end"]))
    stops = F.concat(F.transform("_sm", lambda s: s["start"]), F.array(F.length(text).cast("bigint")))
    gaps = F.arrays_zip(starts.alias("a"), stops.alias("b"))

    def pieces(chunks: Column) -> Column:
        return F.transform(gaps, lambda g: line_part(chunks, g["a"].cast("int"), (g["b"] - g["a"]).cast("int")))

    # the chunks are bound by a lambda of their own, or they would be made again for every piece
    masked = F.array_join(F.transform(F.array(line_chunks(F.col(text))), pieces)[0], MASK)
    out = rows.withColumn("_st", F.when(hit, masked).otherwise(F.col(text)))
    changed = {c: F.col(c) for c in docs.columns}
    changed[text] = F.col("_st")
    if length and length in docs.columns:
        kind = docs.schema[length].dataType
        changed[length] = F.when(hit, F.length("_st").cast(kind)).otherwise(F.col(length))
    return out.select(*[column.alias(name) for name, column in changed.items()])
