"""SentencePiece encoding and decoding by suffix-array matching.

A batch of texts is cut before every run of word marks (no piece of the model crosses such a
cut; models with other pieces are refused), before every run of signs that no piece joins to a
letter before them, and around characters that no piece joins to anything.  The distinct cuts are
joined into one batch text.
Its suffixes are sorted by their first symbols (prefix doubling up to the longest piece); every
piece of the vocabulary finds its range of occurrences in the suffix array by binary
search, for all pieces at once; the resulting edges (position, length, piece) are sorted
by position.

The edges are then relaxed in the order the model prescribes.  For a BPE model that is not
the shortest path but the order of merges: ever the best-scoring edge that spans exactly two
neighbouring symbols, leftmost first, until no edge does.  All cuts of a batch are relaxed
together, one merge per cut and round; long cuts keep a heap of their own.  Characters
without a piece become byte pieces.

Encoded cuts are kept per worker (at most ``CACHED_CUTS``), so repeated words are matched once.
Decoding joins the pieces, turns bytes back into characters, marks into blanks, and takes off
the leading blank that encoding adds.

Defined cases: null and empty texts have no ids; every text comes back exactly, except
that a literal U+2581 in a text is the model's blank and comes back as one; very long texts
are handled cut by cut; repeated rows get equal answers; null ids are ordinary; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MARK = "▁"
#: Characters indexed together, characters of texts cut together (and texts, at most), and encoded
#: cuts kept per worker.
INDEX_CHARS = 1 << 18
TEXT_CHARS, TEXTS = 1 << 22, 2000
CACHED_CUTS = 600_000
#: Cuts longer than this are relaxed one by one with a heap.
LONG_CUT = 48
_NORMAL, _BYTE = 1, 6


class Model:
    """The pieces of a model file, and what matching needs of them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only BPE models without text normalisation are handled")
        self.dummy_prefix = spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        normal = [i for i, p in enumerate(proto.pieces) if p.type == _NORMAL]
        if any(MARK in self.pieces[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece crosses a word mark")
        self.byte_ids = np.zeros(256, np.int64)
        for i, p in enumerate(proto.pieces):
            if p.type == _BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        self.ids = np.array(normal)
        # rank 0 is the best score; equal scores share a rank
        scores = np.array([proto.pieces[i].score for i in normal])
        self.rank = np.unique(-scores, return_inverse=True)[1]
        self.longest = max(len(self.pieces[i]) for i in normal)
        self.cut = _cut([self.pieces[i] for i in normal])
        alphabet = sorted({ord(c) for i in normal for c in self.pieces[i]})
        self.letter = np.ones(0x110000, np.int64)  # 0: end of a cut, 1: no letter of the model
        self.letter[alphabet] = np.arange(2, len(alphabet) + 2)
        self.n_letters = len(alphabet) + 2
        if self.n_letters >= 1 << 16:
            raise ValueError("the alphabet does not fit 16 bits")
        self.width = -(-self.longest // 4) * 4  # symbols a suffix is sorted by
        self.lengths = np.array([len(self.pieces[i]) for i in normal])
        symbols = np.zeros((len(normal), self.width), np.int64)
        for row, i in enumerate(normal):
            symbols[row, : len(self.pieces[i])] = self.letter[[ord(c) for c in self.pieces[i]]]
        self.lower = _packed(symbols)
        inside = np.arange(self.width)[None, :] < self.lengths[:, None]
        self.upper = _packed(np.where(inside, symbols, (1 << 16) - 1))
        self.bytes = [
            bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.encode() if p.type == _NORMAL else b""
            for p in proto.pieces
        ]


def _cut(pieces: list[str]) -> re.Pattern:
    """What matches the cuts of a text one after another.  A merge makes a piece, so two neighbouring characters
    that stand together in no piece are never merged.  The signs are those of
    ASCII and what pieces join before them: small classes match fast."""
    seen = {c for p in pieces for c in p}
    joined = {pair for p in pieces for pair in zip(p, p[1:])}
    alone = {chr(c) for c in range(128)} - {c for pair in joined for c in pair}
    signs = {c for c in seen | alone if not c.isalpha()} - {MARK}
    while crossed := {b for a, b in joined if b in signs and a not in signs and a != MARK}:
        signs -= crossed
    chosen = {c for c in signs if ord(c) < 128}
    while before := {a for a, b in joined if b in chosen and a != MARK} - chosen:
        chosen |= before
    alone, signs = alone & signs, chosen
    first, single = ("".join(map(re.escape, sorted(part))) for part in (signs - alone, alone))
    word = f"[^{MARK}{first}{single}]"
    ways = [f"{MARK}+[{first}]*{word}*", f"[{first}]+{word}*"] if first else [f"{MARK}+{word}*"]
    return re.compile("|".join([*ways, f"{word}+", *([f"[{single}]+"] if single else [])]))


def _packed(symbols: np.ndarray) -> np.ndarray:
    """(n, width) symbols to (width / 4, n) keys of four symbols that compare as they do."""
    out = np.zeros((symbols.shape[1] // 4, len(symbols)), np.uint64)
    for k in range(symbols.shape[1]):
        out[k // 4] = (out[k // 4] << np.uint64(16)) | symbols[:, k].astype(np.uint64)
    return out


@functools.cache
def load(path: str) -> Model:
    return Model(path)


def suffix_array(text: np.ndarray, width: int) -> np.ndarray:
    """Positions of ``text`` ordered by their first ``width`` symbols (a multiple of four)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(width, text.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(4):
        key = (key << np.uint64(16)) | padded[k : n + k]
    order = np.argsort(key)
    have = 4
    while have < width:
        rank = _ranks(key, order)
        after = np.concatenate([rank[have:], np.zeros(min(have, n), np.uint64)])[:n]
        key = (rank << np.uint64(32)) | after
        order = np.argsort(key)
        have *= 2
    return order


def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks from 1; 0 stands for what lies beyond the end."""
    sorted_ = key[order]
    step = np.concatenate([[1], (sorted_[1:] != sorted_[:-1]).astype(np.uint64)])
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(step).astype(np.uint64)
    return rank


def _below(suffixes: np.ndarray, wanted: np.ndarray, strict: bool) -> np.ndarray:
    """For each wanted key the number of sorted suffixes below it (or up to it)."""
    n, m = suffixes.shape[1], wanted.shape[1]
    lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
    while (lo < hi).any():
        mid = np.minimum((lo + hi) // 2, n - 1)
        less = np.zeros(m, bool)
        tied = np.ones(m, bool)
        for part, want in zip(suffixes, wanted):
            here = part[mid]
            less |= tied & (here < want)
            tied &= here == want
        right = (less | (tied & (not strict))) & (lo < hi)
        lo, hi = np.where(right, mid + 1, lo), np.where(right | (lo >= hi), hi, mid)
    return lo


def edges(model: Model, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rows of the piece table) of all occurrences, sorted by position."""
    order = suffix_array(text, model.width)
    padded = np.concatenate([text, np.zeros(model.width, text.dtype)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, model.width)[: len(text)]
    suffixes = _packed(windows[order])
    first, last = _below(suffixes, model.lower, True), _below(suffixes, model.upper, False)
    many = last - first
    piece = np.repeat(np.arange(len(many)), many)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    position = order[at]
    by_place = np.argsort(position)
    return position[by_place], piece[by_place]


def _relax_long(start: int, end: int, spans: np.ndarray, rank: np.ndarray, none: int) -> list[int]:
    """Merge order of one long cut with a heap; the starts of its final symbols."""
    reach = spans.shape[1]
    after = list(range(start + 1, end + 1))  # end of the symbol that starts here
    before = list(range(start - 1, end - 1))  # start of the symbol to the left
    alive = [True] * (end - start)
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i - start]
        if j < end and after[j - start] - i < reach:
            piece = spans[i, after[j - start] - i]
            if piece != none:
                heapq.heappush(heap, (int(rank[piece]), i, after[j - start]))

    for i in range(start, end):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i - start]:
            continue
        j = after[i - start]
        if j >= end or after[j - start] != stop:
            continue
        alive[j - start] = False
        after[i - start] = stop
        if stop < end:
            before[stop - start] = i
        offer(i)
        if before[i - start] >= start:
            offer(before[i - start])
    return [i for i in range(start, end) if alive[i - start]]


def _relax(model: Model, text: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Symbol starts after all merges, and the table of pieces by (position, length)."""
    none = len(model.ids)
    position, piece = edges(model, text)
    spans = np.full((len(text), model.longest + 1), none, np.int32)
    spans[position, model.lengths[piece]] = piece
    rank = np.append(model.rank, np.iinfo(np.int32).max).astype(np.int64)
    worst = rank[none]
    is_start = np.zeros(len(text) + 1, bool)
    size = ends - starts
    for lo, hi in zip(starts[size > LONG_CUT].tolist(), ends[size > LONG_CUT].tolist()):
        is_start[_relax_long(lo, hi, spans, rank, none)] = True
    short = size <= LONG_CUT
    cut = np.repeat(np.arange(int(short.sum())), size[short])
    sym = np.concatenate([[0], np.cumsum(size[short])[:-1]]) if short.any() else np.zeros(0, np.int64)
    sym = np.arange(len(cut)) - np.repeat(sym, size[short]) + np.repeat(starts[short], size[short])
    stop = ends[short]
    while len(sym):
        nxt = np.append(sym[1:], len(text))
        same = np.append(cut[1:] == cut[:-1], False)
        two = np.append(same[1:] & same[:-1], False)
        over = np.where(two, np.append(nxt[1:], len(text)), stop[cut])
        length = over - sym
        fits = same & (length <= model.longest)
        cost = np.where(fits, rank[spans[sym, np.where(fits, length, 0)]], worst)
        heads = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]]))
        best = np.minimum.reduceat(cost, heads)
        group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(cut))))
        going = best < worst
        is_start[sym[~going[group]]] = True  # nothing left to merge in these cuts
        hit = np.flatnonzero((cost == best[group]) & going[group])
        first = hit[np.concatenate([[True], group[hit][1:] != group[hit][:-1]])] if len(hit) else hit
        keep = going[group]
        keep[first + 1] = False
        sym, cut = sym[keep], cut[keep]
    return is_start[:-1], spans


def encode_cuts(model: Model, cuts: list[str]) -> list[bytes]:
    """Ids of each cut, as little-endian 32-bit integers."""
    out: list[bytes] = []
    at = 0
    while at < len(cuts):
        last, chars = at, 0
        while last < len(cuts) and (last == at or chars + len(cuts[last]) < INDEX_CHARS):
            chars += len(cuts[last]) + 1
            last += 1
        points = np.frombuffer("\0".join([*cuts[at:last], ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(c) for c in cuts[at:last]])
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        text = model.letter[points]
        text[ends] = 0
        is_start, spans = _relax(model, text, starts, ends)
        is_start[ends] = False
        symbol = np.flatnonzero(is_start)
        owner = np.searchsorted(ends, symbol, side="right")
        stop = np.minimum(np.append(symbol[1:], len(text)), ends[owner])
        piece = spans[symbol, np.minimum(stop - symbol, spans.shape[1] - 1)]
        known = piece < len(model.ids)
        ids = np.where(known, model.ids[np.where(known, piece, 0)], -1)
        bounds = np.searchsorted(owner, np.arange(last - at + 1)).tolist()
        rare = set(owner[~known].tolist())
        flat = ids.astype("<i4").tobytes()
        for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
            if k not in rare:
                out.append(flat[4 * lo : 4 * hi])
                continue
            whole: list[int] = []
            for s, i in zip(symbol[lo:hi].tolist(), ids[lo:hi].tolist()):
                raw = chr(int(points[s])).encode("utf-8", "replace") if i < 0 else b""
                whole += model.byte_ids[list(raw)].tolist() if i < 0 else [i]
            out.append(np.array(whole, "<i4").tobytes())
        at = last
    return out


class Encoder:
    """Encodes texts, keeping the ids of cuts it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        prefix = MARK if self.model.dummy_prefix else ""
        cut = [self.model.cut.findall(prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > CACHED_CUTS // 2:
            self.older, self.known = self.known, {}
        new = set(itertools.chain.from_iterable(cut)).difference(self.known)
        self.known.update((c, self.older[c]) for c in new.intersection(self.older))
        new = list(new.difference(self.older))
        self.known.update(zip(new, encode_cuts(self.model, new)))
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, cs)), "<i4") for cs in cut]


def decode(model: Model, ids: np.ndarray) -> str:
    text = b"".join(map(model.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(load(path))


_SCHEMA = "n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean"


def _parts(texts: pa.Array):
    """The texts in order, as lists of bounded size."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        held = ends[lo - 1] if lo else 0
        hi = max(lo + 1, min(lo + TEXTS, int(np.searchsorted(ends, held + TEXT_CHARS, side="right"))))
        yield texts.slice(lo, hi - lo).to_pylist()
        lo = hi


def _run(path: str, with_ids: bool):
    def run(batches):
        coder = _encoder(path)
        for batch in batches:
            n, crc, back, same, kept = [], [], [], [], []
            texts = batch.column(1)
            for part in _parts(texts):
                for text, ids in zip(part, coder.encode(part)):
                    again = decode(coder.model, ids)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.tobytes()))
                    back.append(zlib.crc32(again.encode("utf-8", "surrogatepass")))
                    same.append(again == (text or ""))
                    if with_ids:
                        kept.append(ids)
            out = {"k": batch.column(0), "n_ids": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            out |= {"decoded_crc32": pa.array(back, pa.int64()), "round_trip": pa.array(same, pa.bool_())}
            if with_ids:
                out["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return run


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``key``, the number of ids, their crc32 (little-endian unsigned 32-bit), the crc32 of
    the decoded text, whether it equals the text, and, ``with_ids``, the ids."""
    slim = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    schema = f"k {slim.schema['k'].dataType.simpleString()}, {_SCHEMA}" + (", ids array<int>" if with_ids else "")
    return slim.mapInArrow(_run(path, with_ids), schema).withColumnRenamed("k", key)


def decode_documents(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` decoded from an array of ids (null: null)."""
    slim = rows.select(rows[key].alias("k"), rows[ids].alias("i"))

    def run(batches):
        model = load(path)
        for batch in batches:
            texts = [None if i is None else decode(model, np.array(i, np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    kind = slim.schema["k"].dataType.simpleString()
    return slim.mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)
