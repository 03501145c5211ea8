"""Stored results: the original tool's key/value result cache, as keyed Parquet rows.

For every operation and every set of parameters (a query, a model) there are two folders under the
session's shared ``spark.checkpoint.dir`` (or any other base)::

    <base>/<op>/rows/query=<hash>/batch=<id>/      key + result columns
    <base>/<op>/entries/query=<hash>/batch=<id>/   key, file_path, mtime, stored_at, expires_at, bytes

A call writes the rows it computed and then their entries, in a folder of its own; an entry names the
batch that holds its rows, so rows whose entries were never written are not seen and callers
never touch each other's files.  Keys are per file (search) or per finding (elaboration), so a
changed file only invalidates its own results.

Hits are a ``left_semi`` and misses a ``left_anti`` join of the asked keys with the live entries of
the query.  A failure to read or write stored results never fails the call: every key is a miss then.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import logging
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.model import FINDING_COLUMNS, Query
from trawl.plans.search import find
from trawl.session import checkpoint_dir

log = logging.getLogger(__name__)

# Defaults of the original tool's cache.
DEFAULT_TTL_SECONDS = 7 * 24 * 60 * 60
DEFAULT_SIZE_LIMIT_BYTES = 100 * 1024 * 1024

SEP = "\u001f"
#: Keys are broadcast up to this measured size, else they are shuffled.
KEY_BYTES = 96
BROADCAST_KEY_BYTES = 64 * 1024 * 1024
ENTRY_SCHEMA = "key string, file_path string, mtime double, stored_at timestamp, expires_at timestamp, bytes bigint, batch string"


def mtime_micros(mtime: Column) -> Column:
    return F.round(F.coalesce(mtime, F.lit(0.0)) * F.lit(1_000_000)).cast("long")


def file_key(op: str, params: dict, path: Column, mtime: Column) -> Column:
    """sha256 of (operation, canonical parameters, file, mtime in microseconds)."""
    canon = json.dumps(params, sort_keys=True)
    return F.sha2(F.concat_ws(SEP, F.lit(op), F.lit(canon), F.coalesce(path, F.lit("")), mtime_micros(mtime).cast("string")), 256)


def query_hash(params: dict) -> str:
    """Names the folders of one set of parameters."""
    return hashlib.sha256(json.dumps(params, sort_keys=True).encode("utf-8")).hexdigest()[:32]


def finding_hash(df: DataFrame) -> Column:
    cols = ["file_path", "line_number", "match_text", "char_start_in_line", "char_end_in_line", "snippet"]
    return F.sha2(F.concat_ws(SEP, *[F.col(c).cast("string") for c in cols if c in df.columns]), 256)


def with_partition_offsets(tagged: DataFrame, totals: list[tuple[int, int]]) -> DataFrame:
    """Adds ``_off``, the sum of ``totals`` (partition ``_pid``, value) of all partitions before
    a row's own: a broadcast join with one row per partition."""
    offsets, acc = [], 0
    for pid, value in sorted(totals):
        offsets.append((int(pid), acc))
        acc += int(value)
    table = tagged.sparkSession.createDataFrame(offsets, "_pid int, _off long")
    return tagged.join(F.broadcast(table), "_pid", "left").withColumn("_off", F.coalesce("_off", F.lit(0).cast("long")))


def running_total(df: DataFrame, order: list[Column], value: str, out: str = "running") -> DataFrame:
    """Cumulative sum of ``value`` in ``order`` without a single-partition window.

    The rows are range-sorted and written once (lineage cut); per-partition totals
    (one row per partition) give each partition's offset; the running sum inside a
    partition is a window over that partition alone."""
    checkpoint_dir(df.sparkSession)
    ordered = df.orderBy(*order).checkpoint(eager=True).withColumn("_pid", F.spark_partition_id())
    totals = ordered.groupBy("_pid").agg(F.sum(value).alias("t")).orderBy("_pid").collect()
    ordered = with_partition_offsets(ordered, [(r["_pid"], r["t"] or 0) for r in totals])
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ordered.withColumn(out, F.col("_off") + F.sum(value).over(w)).drop("_pid", "_off")


class ResultTable:
    """The stored results of one operation (``search`` or ``elaborate``)."""

    def __init__(
        self,
        spark: SparkSession,
        base: str | None = None,
        op: str = "search",
        ttl_seconds: int = DEFAULT_TTL_SECONDS,
        size_limit_bytes: int = DEFAULT_SIZE_LIMIT_BYTES,
    ):
        self.spark = spark
        self.base = (base or f"{checkpoint_dir(spark)}/trawl-results").rstrip("/")
        self.op = op
        self.ttl_seconds = ttl_seconds
        self.size_limit_bytes = size_limit_bytes

    def _folder(self, kind: str, query: str | None = None) -> str:
        return f"{self.base}/{self.op}/{kind}" + (f"/query={query}" if query else "")

    def _path(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read(self, folder: str, schema: str) -> DataFrame | None:
        fs, path = self._path(folder)
        return self.spark.read.schema(schema).parquet(folder) if fs.exists(path) else None

    def entries(self, query: str | None = None) -> DataFrame:
        """Entries that were stored and not deleted, of one query (its hash) or of all; one per key, the latest."""
        stored = self._read(self._folder("entries", query), ENTRY_SCHEMA)
        if stored is None:
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        gone = self._read(self._folder("deleted"), "key string, batch string")
        if gone is not None:
            stored = stored.join(gone, ["key", "batch"], "left_anti")
        columns = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")]
        latest = F.max_by(F.struct(*columns), F.struct("stored_at", "batch"))
        return stored.groupBy("key").agg(latest.alias("_e")).select("_e.*")

    def live(self, query: str, now: Column) -> DataFrame | None:
        """C2 + C3: ``(key, batch)`` of the query's entries that have not expired; ``None`` if they cannot be read."""
        try:
            found = self.entries(query).where(F.col("expires_at") > now).select("key", "batch")
            return found.checkpoint(eager=True)
        except Exception as exc:  # noqa: BLE001 - C10: unreadable entries mean "all misses"
            log.warning("stored results under %s are unreadable, every key is a miss: %s", self._folder("entries", query), exc)
            return None

    def rows(self, query: str, live: DataFrame, schema: str) -> DataFrame | None:
        """The stored rows of ``live`` entries."""
        stored = self._read(self._folder("rows", query), f"{schema}, batch string")
        return None if stored is None else stored.join(live, ["key", "batch"], "left_semi").drop("batch")

    def new_batch(self) -> str:
        return f"b{uuid.uuid4().hex}"

    def put_rows(self, query: str, batch: str, rows: DataFrame) -> DataFrame:
        """Writes the rows of a batch and returns them as written; entries make them visible."""
        folder = f"{self._folder('rows', query)}/batch={batch}"
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def put_entries(self, query: str, batch: str, entries: DataFrame) -> None:
        entries.write.parquet(f"{self._folder('entries', query)}/batch={batch}")

    def delete(self, keys: DataFrame) -> int:
        """Forget the given keys; returns how many entries went."""
        gone = self.entries().join(keys.select("key").distinct(), "key", "left_semi").select("key", "batch").checkpoint(eager=True)
        n = gone.count()
        if n:
            gone.write.mode("append").parquet(self._folder("deleted"))
        return n

    def clear(self) -> int:
        """Remove everything; returns how many entries went."""
        n = self.entries().count()
        fs, path = self._path(f"{self.base}/{self.op}")
        fs.delete(path, True)
        return n

    def beyond_limit(self) -> DataFrame:
        """Keys of the entries that do not fit ``size_limit_bytes`` when the newest are kept (ties by key).
        A plain query: ``delete`` takes its result, and no search or elaboration calls it."""
        ranked = running_total(self.entries(), [F.col("stored_at").desc(), F.col("key")], "bytes")
        return ranked.where(F.col("running") > F.lit(self.size_limit_bytes)).select("key")


def _now(now: dt.datetime | None) -> Column:
    return F.lit(now if now is not None else dt.datetime.now()).cast("timestamp")


def _expiry(now: Column, ttl_seconds: int) -> Column:
    return now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds).cast("decimal(18,6)"))


def _small(keys: DataFrame) -> bool:
    return keys.count() * KEY_BYTES <= BROADCAST_KEY_BYTES


def _entries(missed: DataFrame, sizes: DataFrame, t: Column, ttl_seconds: int) -> DataFrame:
    """One entry per key of ``missed`` (``key, file_path, mtime``) with the size of its rows."""
    return missed.dropDuplicates(["key"]).join(sizes, "key", "left").select(
        "key", "file_path", "mtime", t.alias("stored_at"), _expiry(t, ttl_seconds).alias("expires_at"),
        F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"),
    )


# ---------------------------------------------------------------------------- search

ROW_SCHEMA = (
    "key string, file_path string, line_number bigint, match_text string, char_start_in_line bigint, "
    "char_end_in_line bigint, snippet string"
)


def _mtime(corpus: DataFrame) -> Column:
    return F.col("mtime").cast("double") if "mtime" in corpus.columns else F.lit(0.0)


def _without(texts: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose key is not in ``live``.  Live keys of a small measured size meet the texts next to the
    scan; beyond it the keys alone are compared and the texts of the misses are fetched after that."""
    known = live.select("key")
    if _small(known):
        return texts.join(F.broadcast(known), "key", "left_anti")
    wanted = texts.select("key").join(known, "key", "left_anti").distinct().checkpoint(eager=True)
    return texts.join(F.broadcast(wanted) if _small(wanted) else wanted, "key", "left_semi")


def cached_search(
    corpus: DataFrame,
    query: Query,
    table: ResultTable | None,
    now: dt.datetime | None = None,
    use_cache: bool = True,
) -> DataFrame:
    """C4: findings of ``query`` over ``corpus`` (``path, text, mtime``), computing only
    files whose (path, mtime, query) key has no live entry, then storing those (files
    without matches too).  ``use_cache=False`` neither reads nor writes stored results (C9)."""
    if table is None or not use_cache:
        return find(corpus, query).select(*FINDING_COLUMNS)
    t, name = _now(now), query_hash(query.params())
    checkpoint_dir(corpus.sparkSession)
    path = F.coalesce("path", F.lit(""))
    key = file_key(table.op, query.params(), F.col("path"), _mtime(corpus))
    texts = corpus.select(key.alias("key"), path.alias("path"), "text", _mtime(corpus).alias("mtime"))
    live = table.live(name, t)
    stored = None
    if live is not None and not live.isEmpty():
        try:
            stored = table.rows(name, live, ROW_SCHEMA)
        except Exception as exc:  # noqa: BLE001 - C10
            log.warning("stored rows of %s are unreadable: %s", table.op, exc)
    missed = texts if stored is None else _without(texts, live)

    # The search takes ``path`` for a label: with the key inside it the new rows are
    # keyed without a join back to the files.
    labelled = missed.select(F.concat_ws(SEP, "key", "path").alias("path"), "text")
    cut = F.instr("file_path", SEP)
    found = find(labelled, query).select(
        F.substring_index("file_path", SEP, 1).alias("key"),
        F.substring(F.col("file_path"), cut + 1, F.length("file_path")).alias("file_path"),
        *[F.col(c) for c in FINDING_COLUMNS if c != "file_path"],
    )
    try:
        batch = table.new_batch()
        found = table.put_rows(name, batch, found)  # the search runs once; sizes and the answer read what it wrote
        size = F.sum(F.length("snippet") + F.length("match_text") + F.length("file_path") + F.lit(32))
        entered = missed.select("key", F.col("path").alias("file_path"), "mtime")
        table.put_entries(name, batch, _entries(entered, found.groupBy("key").agg(size.alias("bytes")), t, table.ttl_seconds))
    except Exception as exc:  # noqa: BLE001 - C10: a failed store never fails the search
        log.warning("could not store results under %s: %s", table.base, exc)
    answer = found.select(*FINDING_COLUMNS)
    if stored is None:
        return answer
    asked = texts.select("key")
    return stored.join(asked, "key", "left_semi").select(*FINDING_COLUMNS).unionByName(answer)


def lookup_keys(corpus: DataFrame, query: Query, table: ResultTable, now: dt.datetime | None = None) -> DataFrame:
    """``(path, key, hit)`` for every file of the corpus."""
    keyed = corpus.select("path", file_key(table.op, query.params(), F.col("path"), _mtime(corpus)).alias("key"))
    live = table.live(query_hash(query.params()), _now(now))
    if live is None:
        return keyed.withColumn("hit", F.lit(False))
    known = live.select("key", F.lit(True).alias("_live"))
    joined = keyed.join(F.broadcast(known) if _small(known) else known, "key", "left")
    return joined.select("path", "key", F.coalesce("_live", F.lit(False)).alias("hit"))


# ---------------------------------------------------------------------------- elaboration


def elaboration_params(window: int, model_name: str, api_base: str | None) -> dict:
    return {"context_window_lines": window, "model": model_name, "api_base": api_base}


def elaboration_key(findings: DataFrame, window: int, model_name: str, api_base: str | None) -> Column:
    """Finding, window, model and endpoint (never the API secret), plus the
    source's mtime so an edited source is elaborated again."""
    params = elaboration_params(window, model_name, api_base)
    return file_key("elaborate", params, finding_hash(findings), F.col("source_mtime"))


def cached_elaborate(
    findings: DataFrame,
    corpus: DataFrame,
    model_fn,
    table: ResultTable | None,
    model_name: str = "stub",
    api_base: str | None = None,
    window: int = 10,
    now: dt.datetime | None = None,
    use_cache: bool = True,
) -> DataFrame:
    """Elaborate only findings without a live stored elaboration; store the
    successful ones (``Error:`` results are returned but never stored).
    ``use_cache=False`` neither reads nor writes stored results (C9)."""
    from trawl.operators.elaborate import elaborate, one_per_path

    if table is None or not use_cache:
        done = elaborate(findings, corpus, model_fn, window)
        return done.select("finding_id", "elaboration", "status", F.lit(False).alias("from_cache"))
    t, name = _now(now), query_hash(elaboration_params(window, model_name, api_base))
    corpus = one_per_path(corpus)
    mt = corpus.select(F.col("path").alias("file_path"), _mtime(corpus).alias("source_mtime"))
    with_src = findings.join(mt, "file_path", "left")
    keyed = with_src.withColumn("key", elaboration_key(with_src, window, model_name, api_base))
    checkpoint_dir(corpus.sparkSession)
    live = table.live(name, t)
    stored = None
    if live is not None and not live.isEmpty():
        try:
            stored = table.rows(name, live, "key string, elaboration string")
        except Exception as exc:  # noqa: BLE001 - C10
            log.warning("stored elaborations are unreadable: %s", exc)
    misses = keyed if stored is None else keyed.join(live, "key", "left_anti")
    fresh = elaborate(misses.drop("source_mtime", "key"), corpus, model_fn, window)
    # one model call per finding: the replies are written once and read from there
    fresh = fresh.join(misses.select("finding_id", "key", "file_path", "source_mtime"), "finding_id").checkpoint(eager=True)
    ok = fresh.where(F.col("status") == "ok").dropDuplicates(["key"])
    try:
        batch = table.new_batch()
        rows = table.put_rows(name, batch, ok.select("key", "elaboration"))
        size = rows.select("key", (F.length("elaboration") + 32).alias("bytes"))
        table.put_entries(name, batch, _entries(ok.select("key", "file_path", F.col("source_mtime").alias("mtime")), size, t, table.ttl_seconds))
    except Exception as exc:  # noqa: BLE001 - C10: a failed store never fails the elaboration
        log.warning("could not store elaborations under %s: %s", table.base, exc)
    answer = fresh.select("finding_id", "elaboration", "status", F.lit(False).alias("from_cache"))
    if stored is None:
        return answer
    hits = keyed.join(stored, "key").select("finding_id", "elaboration", F.lit("ok").alias("status"), F.lit(True).alias("from_cache"))
    return hits.unionByName(answer)


def scratch_table(spark: SparkSession, op: str, **kw) -> ResultTable:
    """Fresh stored results in the shared checkpoint folder (used by registered queries)."""
    return ResultTable(spark, f"{checkpoint_dir(spark)}/trawl-results-{uuid.uuid4().hex}", op, **kw)
