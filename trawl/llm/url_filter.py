"""URL filters: explicit host/path rules, else logistic regression on hashed character
n-grams of host and path, trained from a small labelled URL table.

Native: parsing, rules, features and scoring are column expressions; the model is fitted
on the driver from the collected features of the labelled table, whose size is bounded by
``MAX_LABELLED`` (a larger table is refused).  Scoring is map-only: the weights travel as
one constant array of ``BUCKETS`` doubles, so nothing is shuffled and nothing broadcast
grows with the pages.  The labelled table is made of common words (``labelled_urls``); a user
with urls of their own passes a table of them to ``fit``.

Defined cases: a null url or one without ``://`` has empty host and path, no rule and the
model's verdict on the bias alone; ties between rules of equal length go to the one listed
first; repeated rows are judged alike; very long urls are scored over all their n-grams.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
NGRAMS = (3, 4)
MAX_LABELLED = 20_000
EPOCHS = 300
RATE = 4.0
L2 = 1e-3

# The rules (action, host and path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

# Words of the labelled table (see labelled_urls): common vocabulary of unwanted and of ordinary hosts,
# written down without looking at any table of pages.
BLOCK_WORDS = (
    "casino", "poker", "betting", "freebet", "slots", "jackpot", "roulette", "bingo", "wager", "sportsbook", "lottery",
    "pills", "viagra", "discount-meds", "diet-pill", "cheap-drugs", "spam", "bulk-mail", "link-farm", "content-farm",
    "adserver", "ads", "adclick", "banner-ads", "popads", "tracker", "clicktrack", "tracking-pixel", "porn", "xxx",
    "adult", "adult-video", "hot-singles", "escorts", "sexcam", "payday-loan", "quick-cash", "free-prizes", "win-money",
    "big-win", "replica-watches", "keygen", "warez",
)
ALLOW_WORDS = (
    "news", "wiki", "library", "university", "weather", "science", "garden", "travel", "recipes", "history", "museum",
    "hospital", "school", "council", "railway", "theatre", "orchestra", "bookshop", "bakery", "football", "mountain",
    "journal", "institute", "foundation", "parliament", "observatory", "kitchen", "painting", "architecture", "gazette",
    "harbour", "village", "community", "dictionary", "translation", "northern", "herald", "station", "therapy", "nation",
    "bread", "handball", "window", "address", "adventure", "tradition", "letters", "reader", "online", "shop",
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(action, rule) of the longest rule that fits; nulls when none does."""
    action, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first
        cut = text.index("/")
        fits = ((host == text[:cut]) | host.endswith("." + text[:cut])) & path.startswith(text[cut:])
        action, rule = F.when(fits, F.lit(act)).otherwise(action), F.when(fits, F.lit(text)).otherwise(rule)
    return action, rule


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: every word under common prefixes, endings and paths, dealt alike to both labels."""
    subs = ("", "www.", "blog.", "m.", "shop.", "en.")
    ends = ("com", "net", "org", "info", "io", "co.uk", "de")
    paths = ("", "/", "/index.html", "/en/{n}", "/articles/{n}/", "/fr/page-{n}?q=1", "/2020/07/{n}.html", "/p/{n}#top")
    out = []
    for label, words in ((1, BLOCK_WORDS), (0, ALLOW_WORDS)):
        for i, word in enumerate(words):
            for j, sub in enumerate(subs):
                path = paths[(i + 3 * j) % len(paths)].format(n=17 * i + j)
                out.append((f"https://{sub}{word}.{ends[(i + j) % len(ends)]}{path}", label))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{url}', {label})" for url, label in labelled_urls())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)")


def _with_grams(df: DataFrame, host: Column, path: Column) -> DataFrame:
    """Adds ``_uf_h`` and ``_uf_p`` (arrays of characters) and ``_uf_buckets``."""
    df = df.withColumns(
        {
            "_uf_h": F.split(F.concat(F.lit("^"), host, F.lit("$")), ""),
            "_uf_p": F.split(F.concat(F.lit("^"), path, F.lit("$")), ""),
        }
    )

    def grams(chars: str, n: int, mark: str) -> Column:
        c = F.col(chars)
        at = F.when(F.size(c) >= n, F.sequence(F.lit(0), F.size(c) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            at, lambda i: F.pmod(F.xxhash64(F.lit(mark), *[c[i + k] for k in range(n)]), F.lit(BUCKETS)).cast("int")
        )

    parts = [grams("_uf_h", n, f"h{n}") for n in NGRAMS] + [grams("_uf_p", n, f"p{n}") for n in NGRAMS]
    return df.withColumn("_uf_buckets", F.concat(*parts))


@dataclass(frozen=True)
class UrlModel:
    weights: tuple
    bias: float

    def weights_column(self) -> Column:
        return F.split(F.lit(",".join(repr(w) for w in self.weights)), ",").cast("array<double>")


def fit(labelled: DataFrame, url: str = "url", label: str = "label") -> UrlModel:
    """Full-batch gradient descent with L2 on the collected features.  Rows with a null
    label are left out; a table without rows gives the model that allows everything."""
    slim = labelled.where(F.col(label).isNotNull()).select(
        F.col(url).alias("_uf_url"), F.col(label).cast("int").alias("_uf_y")
    )
    feats = _with_grams(slim, host_of(F.col("_uf_url")), path_of(F.col("_uf_url")))
    got = feats.select("_uf_buckets", "_uf_y").limit(MAX_LABELLED + 1).collect()
    if len(got) > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    rows = []
    for buckets, y in got:
        x: dict[int, float] = {}
        for b in buckets:
            x[b] = x.get(b, 0.0) + 1.0 / math.sqrt(len(buckets))
        rows.append((sorted(x.items()), float(y)))
    rows.sort()
    w, bias = [0.0] * BUCKETS, -2.0 if not rows else 0.0
    for _ in range(EPOCHS):
        grad: dict[int, float] = {}
        grad_bias = 0.0
        for x, y in rows:
            z = bias + sum(w[b] * v for b, v in x)
            err = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))) - y
            grad_bias += err
            for b, v in x:
                grad[b] = grad.get(b, 0.0) + err * v
        n = max(len(rows), 1)
        for b, g in grad.items():
            w[b] -= RATE * (g / n + L2 * w[b])
        bias -= RATE * grad_bias / n * 0.1
    return UrlModel(tuple(w), bias)


def judge(pages: DataFrame, model: UrlModel, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules=RULES) -> DataFrame:
    """``keep`` columns, host, path, rule, verdict (``allow``/``block``), score (the
    model's probability of ``block``)."""
    df = pages.select(*[F.col(c).alias(f"_uf_k{i}") for i, c in enumerate(keep)], F.col(url).alias("_uf_url"))
    df = df.withColumns({"_uf_host": host_of(F.col("_uf_url")), "_uf_path": path_of(F.col("_uf_url"))})
    df = _with_grams(df, F.col("_uf_host"), F.col("_uf_path")).withColumn("_uf_w", model.weights_column())
    total = F.aggregate(F.col("_uf_buckets"), F.lit(0.0), lambda acc, b: acc + F.col("_uf_w")[b])
    z = F.lit(model.bias) + total / F.sqrt(F.greatest(F.size("_uf_buckets"), F.lit(1)))
    action, rule = rule_for(F.col("_uf_host"), F.col("_uf_path"), rules)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return df.select(
        *[F.col(f"_uf_k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("_uf_host").alias("host"),
        F.col("_uf_path").alias("path"),
        rule.alias("rule"),
        F.coalesce(action, F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"),
    )
