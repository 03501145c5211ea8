"""Language ID: a bidirectional gated recurrent network over the bytes of a text.

The network reads UTF-8 bytes in windows of ``WINDOW`` positions, forwards and backwards,
labels every position with a probability per language, and pools a document's
probabilities by their mean over all its positions; the language with the highest pooled
probability is the prediction and that probability its score.  The confidence of a text is
the mean over its positions of the highest probability, scaled so that uniform
probabilities give 0 and certain ones 1 whatever the number of languages.  Every byte of every text
is read; windows start with empty states, so long texts run in bounded memory.

Training is numpy backpropagation through time with Adam on the driver, on a bounded
sample: every language, each with ``DOCS_PER_LANG`` labelled documents in expectation (chosen by
a hash of the id) or, beyond ``SAMPLE_DOCS`` in total, an equal part of these, at least one;
``WINDOWS_PER_DOC`` windows of each.  Only text and label are used.

Defined cases: null texts and texts without a letter get ``und`` and score 0; labels that are null
are not learned from; without any labelled document everything is ``und``; repeated
rows get equal answers; null ids and other columns are carried or ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 64
HIDDEN = 8
DOCS_PER_LANG = 400
SAMPLE_DOCS = 25_600
WINDOWS_PER_DOC = 6
STEPS = 500
BATCH = 128
RATE = 0.02
SEED = 7
#: Windows run together in prediction, and rows pooled together; with more than ``WIDE``
#: languages fewer, in proportion.
RUN_WINDOWS = 4096
RUN_ROWS = 10_000
WIDE = 64
#: Steps of the confidences counted in calibration, and the share of the first percentile that
#: the least one of a text is.
CALIBRATION_STEPS = 1 << 16
CALIBRATION_SHARE = 0.5
#: Index of the symbol that fills up windows.
PAD = 256
UNKNOWN = "und"


@dataclass
class Network:
    langs: list
    inputs: np.ndarray  # (2, 257, 3H): what a byte adds to the gates, per direction
    recur: np.ndarray  # (2, H, 3H)
    out: np.ndarray  # (2, H, K)
    bias: np.ndarray  # (K,)
    least: float = 0.0  # confidence below which a text is in none of the languages


def _gates(x: np.ndarray, h: np.ndarray, recur: np.ndarray):
    """One step of both directions: update gate z, reset gate r, candidate n, new state."""
    size = h.shape[2]
    rec = np.matmul(h, recur)
    zr = x[:, :, : 2 * size] + rec[:, :, : 2 * size]
    np.negative(zr, out=zr)
    np.clip(zr, -30, 30, out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    z, r = zr[:, :, :size], zr[:, :, size:]
    n = np.tanh(x[:, :, 2 * size :] + r * rec[:, :, 2 * size :])
    return z, r, n, n + z * (h - n), rec[:, :, 2 * size :]


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-1, keepdims=True)
    return logits


def position_probabilities(net: Network, symbols: np.ndarray) -> np.ndarray:
    """(T, B) symbols to (T, B, K): the probabilities of every position."""
    steps, size = symbols.shape
    h = np.zeros((2, size, net.recur.shape[1]), np.float32)
    logits = np.empty((steps, size, len(net.bias)), np.float32)
    logits[:] = net.bias
    x = np.empty((2, size, net.inputs.shape[2]), np.float32)
    for t in range(steps):
        np.take(net.inputs[0], symbols[t], axis=0, out=x[0], mode="clip")
        np.take(net.inputs[1], symbols[steps - 1 - t], axis=0, out=x[1], mode="clip")
        h = _gates(x, h, net.recur)[3]
        part = np.matmul(h, net.out)
        logits[t] += part[0]
        logits[steps - 1 - t] += part[1]
    return _softmax(logits)


def _loss_gradients(net: Network, symbols: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Backpropagation through time of the mean cross-entropy over all true positions."""
    steps, size = symbols.shape
    hidden = net.recur.shape[1]
    both = np.stack([symbols, symbols[::-1]])  # what each direction reads, in its order
    h = np.zeros((2, size, hidden), np.float32)
    trace = []
    logits = np.empty((steps, size, len(net.bias)), np.float32)
    logits[:] = net.bias
    for t in range(steps):
        x = np.stack([net.inputs[0][both[0, t]], net.inputs[1][both[1, t]]])
        z, r, n, new, rec_n = _gates(x, h, net.recur)
        trace.append((h, z, r, n, new, rec_n))
        h = new
        part = np.matmul(h, net.out)
        logits[t] += part[0]
        logits[steps - 1 - t] += part[1]
    delta = _softmax(logits)
    delta[:, np.arange(size), labels] -= 1
    mask = symbols != PAD
    delta *= (mask / max(mask.sum(), 1))[:, :, None].astype(np.float32)
    g_in, g_rec, g_out = np.zeros_like(net.inputs), np.zeros_like(net.recur), np.zeros_like(net.out)
    carry = np.zeros((2, size, hidden), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, n, new, rec_n = trace[t]
        d_out = np.stack([delta[t], delta[steps - 1 - t]])
        g_out += np.matmul(new.transpose(0, 2, 1), d_out)
        dh = carry + np.matmul(d_out, net.out.transpose(0, 2, 1))
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * rec_n * r * (1 - r)
        dx = np.concatenate([dz, dr, dn], axis=2)
        d_rec = np.concatenate([dz, dr, dn * r], axis=2)
        g_rec += np.matmul(h.transpose(0, 2, 1), d_rec)
        carry = dh * z + np.matmul(d_rec, net.recur.transpose(0, 2, 1))
        for d in range(2):
            np.add.at(g_in[d], both[d, t], dx[d])
    return [g_in, g_rec, g_out, delta.sum(axis=(0, 1))]


def train(windows: list[bytes], labels: np.ndarray, langs: list, steps: int = STEPS, seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    k = len(langs)

    def start(*shape):
        return rng.normal(0, 0.25, shape).astype(np.float32)

    net = Network(
        langs, start(2, 257, 3 * HIDDEN), start(2, HIDDEN, 3 * HIDDEN), start(2, HIDDEN, k), np.zeros(k, np.float32)
    )
    weights = [net.inputs, net.recur, net.out, net.bias]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    symbols = np.full((len(windows), WINDOW), PAD, np.int64)
    for i, window in enumerate(windows):
        got = np.frombuffer(window[:WINDOW], np.uint8)
        symbols[i, : len(got)] = got
    by_lang = [np.flatnonzero(labels == i) for i in range(k)]
    for step in range(1, steps + 1):
        # every language weighs the same
        pick = np.array([rng.choice(by_lang[rng.integers(k)]) for _ in range(BATCH)])
        grads = _loss_gradients(net, np.ascontiguousarray(symbols[pick].T), labels[pick])
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(weights, grads, first, second):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def _at_once(most: int, langs: int) -> int:
    return max(1, min(most, most * WIDE // langs))


def _confidence(highest: np.ndarray, seen: np.ndarray, langs: int) -> np.ndarray:
    """From the sums of the highest probabilities over ``seen`` positions."""
    if langs == 1:
        return np.ones(len(highest))
    return np.clip((highest / np.maximum(seen, 1) - 1 / langs) / (1 - 1 / langs), 0, 1)


def _confidence_counts(shared):
    """Batches (text) to (step, n): the bytes in windows of that confidence, a row per task and step."""

    def run(batches):
        net, counts = shared.value, np.zeros(CALIBRATION_STEPS + 1, np.int64)
        for batch in batches:
            for symbols, _, used in _windows_of(batch.column(0), _at_once(RUN_WINDOWS, len(net.langs))):
                found = position_probabilities(net, symbols).max(axis=2)
                found[symbols == PAD] = 0
                sure = _confidence(found.sum(axis=0, dtype=np.float64), used, len(net.langs))
                np.add.at(counts, np.floor(sure * CALIBRATION_STEPS).astype(np.int64), used)
        step = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(counts[step])], names=["step", "n"])

    return run


def _least_confidence(net: Network, texts: DataFrame) -> float:
    """From every window of every text of the one column of ``texts``, weighed by its bytes."""
    shared = texts.sparkSession.sparkContext.broadcast(net)
    counts = texts.mapInArrow(_confidence_counts(shared), "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).toArrow()
    step, n = (counts.column(c).to_numpy() for c in ("step", "n"))
    order = np.argsort(step)
    upto = np.cumsum(n[order])
    first = int(np.searchsorted(100 * upto, upto[-1])) if len(upto) else 0
    return CALIBRATION_SHARE * float(step[order][first]) / CALIBRATION_STEPS if len(upto) else 0.0


def _windows_of(texts: pa.Array, most: int = RUN_WINDOWS):
    """Per slice of at most ``most`` windows: symbols (T, B), row of each window, and the
    bytes in it."""
    texts = texts.cast(pa.large_binary())
    size = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + size + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    count = -(-np.diff(offsets) // WINDOW)
    ends = np.cumsum(count)
    for lo in range(0, int(ends[-1]) if size else 0, most):
        number = np.arange(lo, min(lo + most, int(ends[-1])))
        row = np.searchsorted(ends, number, side="right")
        begin = offsets[row] + (number - (ends[row] - count[row])) * WINDOW
        used = np.minimum(offsets[row + 1] - begin, WINDOW)
        at = begin[None, :] + np.arange(WINDOW)[:, None]
        symbols = data[np.minimum(at, len(data) - 1)].astype(np.intp)
        symbols[np.arange(WINDOW)[:, None] >= used[None, :]] = PAD
        yield symbols, row, used


def _predict(shared, names):
    """Batches (text to label, columns to keep...) to the kept columns, label, score and, if
    named, confidence."""

    def run(batches):
        net, confident = shared.value, names[-1] == "confidence"
        windows, most = (_at_once(n, len(net.langs)) for n in (RUN_WINDOWS, RUN_ROWS))
        for batch in (whole.slice(lo, most) for whole in batches for lo in range(0, whole.num_rows, most)):
            rows = batch.num_rows
            total = np.zeros((rows, len(net.langs)))
            seen = np.zeros(rows)
            highest = np.zeros(rows)
            for symbols, row, used in _windows_of(batch.column(0), windows):
                found = position_probabilities(net, symbols)
                found[symbols == PAD] = 0
                summed = found.sum(axis=0, dtype=np.float64)
                heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                total[row[heads]] += np.add.reduceat(summed, heads, axis=0)
                seen[row[heads]] += np.add.reduceat(used, heads)
                if confident:
                    highest[row[heads]] += np.add.reduceat(found.max(axis=2).sum(axis=0, dtype=np.float64), heads)
            pooled = total / np.maximum(seen, 1)[:, None]
            best = pooled.argmax(axis=1)
            known = seen > 0
            score = np.where(known, np.clip(pooled[np.arange(rows), best], 0, 1), 0.0)
            langs = [net.langs[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist())]
            columns = [*batch.columns[1:], pa.array(langs, pa.string()), pa.array(score, pa.float64())]
            if confident:
                sure = np.where(known, _confidence(highest, seen, len(net.langs)), 0.0)
                columns.append(pa.array(sure, pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def fit(
    docs: DataFrame, allowed: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", calibrate: bool = False
) -> Network | None:
    """Trains on rows where ``allowed`` holds; None without a labelled row.  With ``calibrate`` the least
    confidence is read off the whole texts of all these rows."""
    rows = docs.where(allowed & F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).cast("string").alias("y"), F.col(text).alias("t"), F.xxhash64(F.lit(SEED), F.col(key)).alias("h")
    )
    rows = rows.withColumn("unit", F.pmod(F.col("h"), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    counts = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("least")).collect()
    if not counts:
        return None
    langs = sorted(y for y, _, _ in counts)
    docs_per_lang = max(1, min(DOCS_PER_LANG, SAMPLE_DOCS // len(langs)))
    # the smallest hash of a language is always in
    shares = pa.table({
        "y": [y for y, _, _ in counts],
        "share": pa.array([docs_per_lang / n for _, n, _ in counts], pa.float64()),
        "least": pa.array([least for _, _, least in counts], pa.float64()),
    })
    sample = rows.join(F.broadcast(docs.sparkSession.createDataFrame(shares)), "y")
    sample = sample.where("unit < share or unit <= least")
    starts = [
        F.substring("t", (1 + F.pmod(F.xxhash64("h", F.lit(i)), F.greatest(F.length("t") - WINDOW, F.lit(1)))).cast("int"), F.lit(WINDOW))
        for i in range(WINDOWS_PER_DOC)
    ]
    got = sample.select("y", "h", "unit", F.array_distinct(F.array(*starts)).alias("w"))
    # rows of equal hash (null ids) come together
    dealt = F.row_number().over(Window.partitionBy("y").orderBy("unit", F.xxhash64("w")))
    got = got.withColumn("dealt", dealt).where(F.col("dealt") <= 2 * docs_per_lang).select("y", "h", "w").collect()
    pairs = sorted((y, h, w) for y, h, ws in got for w in ws if w)
    number = {y: i for i, y in enumerate(langs)}
    labels = np.array([number[y] for y, _, _ in pairs])
    windows = [w.encode()[:WINDOW] for _, _, w in pairs]
    net = train(windows, labels, langs)
    if calibrate and net is not None:
        net.least = _least_confidence(net, rows.select("t"))
    return net


def predict(
    docs: DataFrame,
    net: Network | None,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    into: tuple[str, ...] = ("lang_pred", "score"),
) -> DataFrame:
    """The columns ``keep`` and, named by ``into``, prediction, score and (if it has a third
    name) confidence of every row; kept columns of those names must be left out.  Texts
    without a letter reach the network as nulls."""
    if net is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias(into[0]), *[F.lit(0.0).alias(c) for c in into[1:]])
    letters = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))
    slim = docs.select(letters.alias("_text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    fields = [f"_{i} {slim.schema[f'_{i}'].dataType.simpleString()}" for i in range(len(keep))]
    shared = docs.sparkSession.sparkContext.broadcast(net)
    found = ["lang_pred", "score", "confidence"][: len(into)]
    fields += [f"{c} {'string' if c == 'lang_pred' else 'double'}" for c in found]
    names = [*(f"_{i}" for i in range(len(keep))), *found]
    out = slim.mapInArrow(_predict(shared, names), ", ".join(fields))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(n) for c, n in zip(found, into)])
