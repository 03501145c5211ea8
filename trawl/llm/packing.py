"""Best-fit packing of tokenized documents into sequences of at most ``capacity`` tokens.

Tokens come from a byte-level BPE file of the ``tokenizers`` format; each document gets an
end mark (id 0) and, only where it is longer than a sequence, is cut into pieces of full
length, the first of which may be shorter.

The packing is planned on the histogram of piece lengths (at most ``capacity`` numbers,
whatever the size of the corpus): the configuration linear program - least total use of
configurations that covers every length's count - is solved by multiplicative weights.  Each
step prices a configuration by an unbounded knapsack (dynamic program over the capacity)
under the current weights and lowers the weights of the lengths it covers.  The fractional
uses are rounded down against the true counts, and what is left over is packed best-fit
(longest first, then the longest that still fits), again per length and not per piece.

The plan becomes a table of slots: the pieces of a length, numbered 0.., fill the slots of
that length in order.  Numbering is done in buckets of bounded size (a length may hold
most pieces), so no task sees all pieces of a length.  The slot table is bounded by the
number of steps and lengths, not by the corpus.

Defined cases: null texts are empty: one piece holding only the end mark; repeated rows are
packed each; null ids are ordinary; very long texts are cut; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import array
import functools
import json
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.llm.scratch import Scratch

CAPACITY = 2048
END_ID = 0
#: Steps of the multiplicative weights, their rate, and the share of a length a step may cover.
STEPS = 300
RATE = 4.0
STRIDE = 0.5
ROWS_PER_BUCKET = 1000
#: Aligned blocks of so many characters that are white space send a text to ``tokenizers``.
BLANK_BLOCK = 1000


# ------------------------------------------------------------------ tokens


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others, in order,
    as the characters from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _long_blank(text: str) -> bool:
    """Whether a white-space run may be long: every run of 2 * BLANK_BLOCK characters covers an
    aligned block."""
    return any(text[i : i + BLANK_BLOCK].isspace() for i in range(0, len(text) - BLANK_BLOCK + 1, BLANK_BLOCK))


@functools.cache
def encoder(path: str):
    """text -> list of ids, equal to those of ``tokenizers`` for the file.

    A plain byte-level BPE whose ids follow the order of its merges is run through
    ``tiktoken`` (same ids, several times faster), but for texts with a long white-space run,
    on which it panics, and texts that contain an added token, whose id only ``tokenizers``
    gives; these and any other file go through ``tokenizers``."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def exact(text):
        return tokenizer.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, bytes_of = spec["model"], _byte_of_char()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    vocab, pre = model["vocab"], spec.get("pre_tokenizer") or {}
    by_id = {i: t for t, i in vocab.items()}
    plain = (
        model["type"] == "BPE"
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and spec.get("normalizer") is None
        and all(by_id.get(256 + n) == "".join(m) for n, m in enumerate(merges))
    )
    if not plain:
        return exact
    import tiktoken

    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(bytes_of[c] for c in t): i for t, i in vocab.items() if t not in special}
    # the split of byte-level BPE (fixed value)
    split = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("packing", pat_str=split, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: exact(text) if _long_blank(text) or any(t in text for t in special) else fast(text)


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches):
        encode = encoder(path)
        for batch in batches:
            kept, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                tokens = array.array("I", encode(text.as_py() or ""))
                tokens.append(END_ID)
                whole = np.frombuffer(tokens, np.uint32).astype("<u4", copy=False)
                first = len(whole) % capacity or capacity
                for no, at in enumerate([0, *range(first, len(whole), capacity)]):
                    part = whole[at : first if no == 0 else at + capacity]
                    kept.append(row)
                    piece.append(no)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            out = {"k": batch.column(0).take(pa.array(kept, pa.int64())), "piece": pa.array(piece, pa.int32())}
            out |= {n: pa.array(v, pa.int64()) for n, v in (("start", start), ("length", length), ("crc", crc))}
            if with_ids:
                out["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return run


# ------------------------------------------------------------------ plan


def _knapsack(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> dict[int, int]:
    """The most worth that fits (unbounded); {index: how often}.  ``lengths`` ascend."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        n = fitting[c]
        values = best[c - lengths[:n]] + worth[:n]
        j = int(values.argmax())
        if values[j] > best[c - 1]:
            best[c], pick[c] = values[j], j
        else:
            best[c] = best[c - 1]
    found: dict[int, int] = {}
    c = capacity
    while c > 0:
        j = int(pick[c])
        if j < 0:
            c -= 1
        else:
            found[j] = found.get(j, 0) + 1
            c -= int(lengths[j])
    return found


def _solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, steps: int) -> dict[tuple, float]:
    """Fractional uses of configurations, {((index, how often), ...): use}."""
    covered = np.zeros(len(lengths))
    uses: dict[tuple, float] = {}
    for _ in range(steps):
        open_ = np.flatnonzero(covered < counts)
        if not len(open_):
            break
        worth = lengths[open_] * np.exp(-RATE * covered[open_] / counts[open_])
        config = tuple(sorted((int(open_[j]), a) for j, a in _knapsack(lengths[open_], worth, capacity).items()))
        index = np.array([j for j, _ in config])
        often = np.array([a for _, a in config], float)
        use = float(np.min(np.maximum(counts[index] - covered[index], STRIDE * counts[index]) / often)) * STRIDE
        uses[config] = uses.get(config, 0.0) + use
        covered[index] += use * often
    return uses


def plan(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[dict[int, int], int]]:
    """Configurations ({length: how often}) with their whole-number uses; every piece of the
    histogram is in exactly one."""
    left = {length: n for length, n in histogram.items() if n > 0}
    out = []
    if capacity in left:
        out.append(({capacity: 1}, left.pop(capacity)))
    if left:
        lengths = np.array(sorted(left))
        counts = np.array([left[x] for x in lengths.tolist()], float)
        for config, use in sorted(_solve(lengths, counts, capacity, steps).items(), key=lambda x: (-x[1], x[0])):
            named = {int(lengths[j]): a for j, a in config}
            times = min([math.floor(use + 1e-9), *(left.get(x, 0) // a for x, a in named.items())])
            if times:
                out.append((named, times))
                for x, a in named.items():
                    left[x] -= a * times
    # best fit of the rest: the longest, then ever the longest that still fits
    rest = sorted(x for x, n in left.items() if n)
    while rest:
        named, room = {}, capacity
        at = len(rest) - 1
        while at >= 0:
            x = rest[at]
            a = min(left[x], room // x)
            if a:
                named[x] = a
                room -= a * x
            at = min(at, int(np.searchsorted(rest, room, side="right"))) - 1 if room else -1
        times = min(left[x] // a for x, a in named.items())
        out.append((named, times))
        for x, a in named.items():
            left[x] -= a * times
        rest = [x for x in rest if left[x]]
    return out


def _slots(configs) -> list[tuple]:
    """(length, from, to, sequence, often, offset): pieces number ``from`` to ``to`` - 1 of
    a length go ``often`` to a sequence, from ``offset`` on."""
    rows, taken, sequence = [], {}, 0
    for named, times in configs:
        offset = 0
        for x, a in sorted(named.items(), reverse=True):
            first = taken.get(x, 0)
            taken[x] = first + a * times
            rows.append((x, first, taken[x], sequence, a, offset))
            offset += a * x
        sequence += times
    return rows


def _bounded(spark: SparkSession, columns: dict[str, str], rows: list[tuple]) -> DataFrame:
    """A bounded driver-made table, broadcast."""
    schema = ", ".join(f"{name} {kind}" for name, kind in columns.items())
    table = pa.table({name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(columns)})
    return F.broadcast(spark.createDataFrame(table, schema))


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset`` and, ``with_ids``, the ids themselves."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = slim.schema["k"].dataType.simpleString()
    schema = f"k {kind}, piece int, start long, length long, crc long" + (", ids array<int>" if with_ids else "")
    pieces = scratch.put(slim.mapInArrow(_pieces(tokenizer, capacity, with_ids), schema), "pieces")

    histogram = {x: n for x, n in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}
    lengths = _bounded(spark, {"length": "long", "n": "long"}, sorted(histogram.items()))
    slots = _bounded(
        spark,
        {"length": "long", "first": "long", "last": "long", "sequence": "long", "often": "long", "place": "long"},
        _slots(plan(histogram, capacity)),
    )
    mixed = F.xxhash64("k", "piece", "crc")
    bucket = F.pmod(mixed, F.ceil(F.col("n") / ROWS_PER_BUCKET))
    spread = pieces.join(lengths, "length").withColumns({"mixed": mixed, "bucket": bucket})
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.select("length", "bucket", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("mixed", "k", "piece")
    ranked = spread.join(counts, ["length", "bucket"]).withColumn(
        "rank", F.col("before") + F.row_number().over(inside) - 1
    )
    slots = slots.withColumnRenamed("length", "slot_length")
    placed = ranked.join(
        slots, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    )
    within = F.col("rank") - F.col("first")
    return placed.select(
        F.col("k").alias(key), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
        (F.col("sequence") + F.floor(within / F.col("often"))).cast("long").alias("sequence_id"),
        (F.col("place") + F.pmod(within, F.col("often")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
