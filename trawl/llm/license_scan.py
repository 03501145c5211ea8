"""License scans: a positional rare-token index over licence templates.

Templates are word sequences; their postings are (word, template, position).  The inverse
document frequency of every template word is counted over all documents and gives the posting
its weight, so that the rarest words of a template decide.  A file looks up its template words
with their positions; postings and file words that agree on the relative position (file
position minus template position) are the places where the template's words stand in order.
A (file, template) pair is a candidate where the weights that agree on one relative position
reach ``MIN_SHARE`` of the template; it counts if a mandatory key phrase of the template
stands complete in the file, every word at its relative position.  Base phrases count as they stand.

Native: words are split, intersected and exploded by column expressions.  Only files that
hold all words of some key phrase are exploded into positions, and of them only template
words; groups are (file, template, relative position), so a file or a word that is very
frequent spreads over many groups.  The postings and the IDF table are bounded by the
template list.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Defined cases: null
texts are empty: no words, null positions, empty labels, score 0; repeated rows get equal
answers; null ids are ordinary ids; an empty table gives an empty result; other columns are
ignored.  A template whose phrase stands in other wording (less than ``MIN_SHARE``) gives no label and
no score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.scratch import Scratch, fits_broadcast

#: Share of a template's weight that must agree on one relative position.
MIN_SHARE = 0.5


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]  # mandatory key phrases: one of them must stand complete
    base: bool = False


# The base phrases and their labels.
BASE = (
    Template("mit", "mit license", ("mit license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("gpl", "general public license", ("general public license",), True),
)
# Notices of the method's own: usual wording and the phrases that must stand in it.
OWN = (
    Template("apache", "licensed under the apache license version", ("under the apache license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use in source and binary forms", "bsd license")),
    Template("cc-by", "licensed under cc by", ("under cc by",)),
    Template("cc-by-nc", "licensed under cc by nc", ("under cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa", ("under cc by sa",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("gpl", "this work is licensed under the gnu general public license version", ("gnu general public license",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             ("permission is hereby granted free of charge",)),
    Template("mit", "released under the mit license", ("under the mit license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("permission to use copy modify and or distribute this software", "isc license")),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable",
             ("without any express or implied warranty", "zlib license")),
    Template("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights",
             ("waived all copyright and related or neighboring rights", "cc0 public domain dedication")),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software", "the unlicense")),
    Template("mpl", "subject to the terms of the mozilla public license", ("mozilla public license",)),
)
TEMPLATES = BASE + OWN

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _phrases() -> list[tuple[int, str]]:
    return [(no, phrase) for no, t in enumerate(TEMPLATES) for phrase in t.phrases]


def _inline(spark, columns: str, rows: list[tuple]) -> DataFrame:
    """A bounded table as a broadcast literal relation."""
    return F.broadcast(spark.sql("SELECT * FROM VALUES " + ", ".join(map(repr, rows)) + f" AS t({columns})"))


def _words(text: Column) -> Column:
    """Words with an empty string where the text begins or ends with a gap."""
    return F.split(text, _GAP)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, ``n_words``, ``n_base``, ``first_word``,
    ``last_word``, ``base_labels``, ``labels``, ``score`` (IDF-weighted share of the method's best
    template with a complete key phrase that stands at one relative position)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    slim = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    vocabulary = sorted({w for t in TEMPLATES for w in t.text.split()} | {w for _, p in _phrases() for w in p.split()})

    # one pass: number of words, and which template words the text holds.  lower() may fold more than
    # A-Z; that only adds candidates
    parts = slim.select("k", F.xxhash64("t").alias("th"), _words(F.lower("t")).alias("w"))
    ends = (F.col("w")[0] == "").cast("int") + ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")
    files = scratch.put(
        parts.select(
            "k", "th", (F.size("w") - ends).cast("long").alias("n_words"),
            F.array_intersect("w", F.array(*map(F.lit, vocabulary))).alias("present"),
        ),
        "files",
    )

    total = files.count()
    df = {w: n for w, n in files.select(F.explode("present").alias("w")).groupBy("w").count().collect()}
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in vocabulary}

    # only files that hold all words of a key phrase can have one
    held = [
        F.forall(F.array(*[F.lit(w) for w in sorted(set(p.split()))]), lambda w: F.array_contains("present", w))
        for _, p in _phrases()
    ]
    anyone = held[0]
    for h in held[1:]:
        anyone = anyone | h
    candidates = scratch.put(
        files.where(anyone).select(F.col("k").alias("ck"), F.col("th").alias("cth")).distinct(),
        "candidates",
    )
    size = candidates.agg(
        F.count("cth"), F.coalesce(F.max(F.length(F.col("ck").cast("string"))), F.lit(0))
    ).first()
    side = candidates
    if fits_broadcast(size[0], 64 + 4 * size[1]):
        side = F.broadcast(side)

    # positions of the template words
    texts = slim.withColumn("th", F.xxhash64("t"))
    picked = texts.join(side, F.col("k").eqNullSafe(F.col("ck")) & (F.col("th") == F.col("cth")))
    low = picked.select("k", "th", _words(F.translate("t", _UPPER, _UPPER.lower())).alias("w"))
    low = low.withColumn("skip", (F.col("w")[0] == "").cast("int"))
    spots = low.select("k", "th", "skip", F.posexplode("w").alias("i", "word"))
    spots = spots.where(F.col("word").isin(vocabulary))
    spots = scratch.put(spots.select("k", "th", (F.col("i") - F.col("skip")).alias("pos"), "word").distinct(), "spots")

    # places of key phrases: all words of the phrase at one relative position
    phrases = sorted({p for _, p in _phrases()})
    rows = [(w, no, at, len(p.split())) for no, p in enumerate(phrases) for at, w in enumerate(p.split())]
    hits = spots.join(_inline(spark, "word, phrase, at, needed", rows), "word")
    places = (
        hits.groupBy("k", "th", "phrase", (F.col("pos") - F.col("at")).alias("rel"))
        .agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed"))
        .where("n = needed")
    )
    of_template = [(phrases.index(p), no, t.label, t.base) for no, t in enumerate(TEMPLATES) for p in t.phrases]
    verified = scratch.put(
        places.join(_inline(spark, "phrase, template, label, base", of_template), "phrase")
        .groupBy("k", "th", "template")
        .agg(
            F.first("label").alias("label"), F.first("base").alias("base"), F.count(F.lit(1)).alias("n"),
            F.min("rel").alias("lo"), F.max("rel").alias("hi"),
        ),
        "verified",
    )

    # share of each template that agrees on one relative position, at its best one
    weights = []
    for no, t in enumerate(TEMPLATES):
        words = t.text.split()
        whole = sum(idf[w] for w in words)
        weights += [(w, no, at, idf[w] / whole) for at, w in enumerate(words)]
    aligned = (
        spots.join(_inline(spark, "word, template, at, share", weights), "word")
        .groupBy("k", "th", "template", (F.col("pos") - F.col("at")).alias("rel"))
        .agg(F.sum("share").alias("share"))
        .groupBy("k", "th", "template")
        .agg(F.max("share").alias("share"))
    )
    both = verified.alias("v").join(
        aligned.alias("a"),
        F.expr("v.k <=> a.k and v.th = a.th and v.template = a.template"), "left",
    ).select("v.*", F.least(F.lit(1.0), F.round(F.coalesce("a.share", F.lit(0.0)), 9)).alias("share"))
    both = both.where((F.col("share") >= MIN_SHARE) | F.col("base"))
    found = both.groupBy(F.col("k").alias("fk"), F.col("th").alias("fth")).agg(
        F.sum(F.when(F.col("base"), F.col("n"))).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("lo"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("hi"))).alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max(F.when(~F.col("base"), F.col("share"))).cast("double").alias("score"),
    )
    out = files.join(found, F.col("k").eqNullSafe(F.col("fk")) & (F.col("th") == F.col("fth")), "left")

    def joined(labels: str) -> Column:
        return F.coalesce(F.array_join(F.array_sort(labels), ","), F.lit("")).alias(labels)

    return out.select(
        F.col("k").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        joined("base_labels"), joined("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
