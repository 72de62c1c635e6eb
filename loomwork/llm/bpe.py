"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation is an automaton over codepoint classes. Each character is a function from state to
state; composition is associative, so the states before all characters come from a blocked scan:
classes are joined in fours, blocks are composed side by side, and the blocks' start states then give
every state, in numpy. The split is that of the pattern of the 50k byte-level vocabularies (optional
leading space, letters, numbers, others, white space that leaves its last space to the next word, and
the English contractions).

The slices feed pair merging behind a cache of pieces. Pieces the cache lacks are merged together: one
matrix per piece length, in which every step takes each row's leftmost lowest-ranked pair. Pieces over
64 bytes are merged one by one with a heap.

Rows keep the byte offset of every piece and the place of its first id next to the ids, so
``decode_range`` gives a range of a document without decoding the rest. Defined cases: a null text gives
no ids and counts as empty; special strings are ordinary text; repeated rows and null ids pass through; of
pairs that tie in rank the leftmost is merged; a very long text is a slice of its own, and a very long
piece is merged with a heap; an empty table gives an empty one. Columns beside the id and the text are
never read.
"""

from __future__ import annotations

import base64
import functools
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import table
from ._words import slices, span_hashes, text_bytes

#: Character classes: letters, numbers, others, an apostrophe before one or two letters of a
#: contraction, and spaces or other white space that end a run before a word, or don't.
_L, _N, _O, _A1, _A2, _SPACE_LAST, _SPACE, _WHITE_LAST, _WHITE = range(9)
_CLASSES = 18  # the same again for the first character of a text
#: States: at a start, in letters, numbers, others, after a space that the next word takes, in white
#: space, before the last two or the last letter of a contraction.
_START, _IN_L, _IN_N, _IN_O, _AFTER_SPACE, _IN_WHITE, _TWO, _ONE = range(8)
_WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BLOCK = 128


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of codepoints; next states and cuts by class and state; next states by four classes."""
    kind = {"L": _L, "N": _N}
    classes = np.frombuffer(bytes(kind.get(unicodedata.category(chr(c))[0], _O) for c in range(sys.maxunicode + 1)), np.uint8).copy()
    classes[_WHITE_SPACE] = _WHITE
    classes[32] = _SPACE
    after = np.zeros((_CLASSES, 8), np.uint8)
    cut = np.zeros((_CLASSES, 8), bool)
    for s in range(8):
        after[_L, s] = {_TWO: _ONE, _ONE: _START}.get(s, _IN_L)
        cut[_L, s] = s not in (_IN_L, _AFTER_SPACE, _TWO, _ONE)
        after[_N, s], cut[_N, s] = _IN_N, s not in (_IN_N, _AFTER_SPACE)
        joins = s in (_IN_O, _AFTER_SPACE)
        for c, to in ((_O, _IN_O), (_A1, _ONE), (_A2, _TWO)):
            after[c, s], cut[c, s] = _IN_O if joins else to, not joins
        after[_SPACE_LAST, s], cut[_SPACE_LAST, s] = _AFTER_SPACE, True
        after[_WHITE_LAST, s], cut[_WHITE_LAST, s] = _IN_WHITE, True
        after[_SPACE, s] = after[_WHITE, s] = _IN_WHITE
        cut[_SPACE, s] = cut[_WHITE, s] = s != _IN_WHITE
    after[9:], cut[9:] = after[:9, :1], True
    two = after[np.arange(_CLASSES)[None, :, None], after[:, None, :]].reshape(-1, 8)
    four = two[np.arange(len(two))[None, :, None], two[:, None, :]].reshape(-1, 8)
    return classes, after, cut, four


def _states(classes: np.ndarray) -> np.ndarray:
    """The state before each character, by a scan over functions."""
    _, after, _, four = _tables()
    n = len(classes)
    quads = -(-n // 4)
    rows = max(1, -(-quads // _BLOCK))
    c = np.zeros((rows * _BLOCK, 4), np.uint8)
    c.reshape(-1)[:n] = classes
    c4 = c.astype(np.int32)
    code = (((c4[:, 0] * _CLASSES + c4[:, 1]) * _CLASSES + c4[:, 2]) * _CLASSES + c4[:, 3]).reshape(rows, _BLOCK).T.copy() * 8
    flat = four.reshape(-1)
    whole = np.tile(np.arange(8, dtype=np.int32), (rows, 1))
    for j in range(_BLOCK):
        whole = flat[code[j][:, None] + whole]
    begin = np.zeros(rows, np.int32)
    for r, f in enumerate(whole[:-1].tolist()):
        begin[r + 1] = f[begin[r]]
    at = np.empty((_BLOCK, rows), np.uint8)
    state = begin
    for j in range(_BLOCK):
        at[j] = state
        state = flat[code[j] + state]
    out = np.empty((rows * _BLOCK, 4), np.uint8)
    out[:, 0] = at.T.reshape(-1)
    for k in range(3):
        out[:, k + 1] = after[c[:, k], out[:, k]]
    return out.reshape(-1)[:n]


def cuts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte places where pieces start, given the bytes of texts one after the other and their offsets."""
    if not len(raw):
        return np.zeros(0, np.int64)
    of, _, cut, _ = _tables()
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    first = np.zeros(len(points) + 1, bool)
    first[np.searchsorted(lead, off)] = True
    c = of[points]
    white = c >= _SPACE
    ends = np.zeros(len(c), bool)  # white space before something else of the same text
    ends[:-1] = white[:-1] & ~white[1:] & ~first[1:-1]
    c[ends] -= 1
    quote = np.flatnonzero(points == 39)
    if len(quote):
        wide = np.append(points, [0, 0])
        one, two = wide[quote + 1], wide[quote + 2]
        same1 = ~first[np.minimum(quote + 1, len(points))]
        same2 = same1 & ~first[np.minimum(quote + 2, len(points))]
        c[quote[same1 & np.isin(one, [ord(x) for x in "stmd"])]] = _A1
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        c[quote[same2 & double]] = _A2
    c[first[:-1]] += 9
    return lead[np.flatnonzero(cut.reshape(-1)[c.astype(np.int16) * 8 + _states(c)])]


class Encoder:
    """Encodes and decodes columns with a vocabulary in the ``.tiktoken`` format."""

    #: Slots of the cache of pieces; it is emptied when half are used.
    SLOTS = 1 << 21

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, k in self.ranks.items():
            self.tokens[k] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self._starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self._bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self._single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, k in self.ranks.items():
            for m in range(1, len(token)):
                a, b = self.ranks.get(token[:m]), self.ranks.get(token[m:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = k
        keys = np.array(sorted(pairs), np.int64)
        self._keys, self._merged = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        self._none = np.int64(size)  # over every rank
        self._clear()

    def _clear(self) -> None:
        self._key = np.zeros(self.SLOTS, np.uint64)  # piece hashes, open addressing; 0 is a free slot
        self._at, self._n = np.zeros(self.SLOTS, np.int64), np.zeros(self.SLOTS, np.int64)
        self._pool = np.zeros(1 << 16, np.int32)
        self._used = self._held = 0

    def _slots(self, key: np.ndarray, insert: bool = False) -> np.ndarray:
        """The slots that hold piece hashes, -1 where there is none."""
        mask = np.uint64(self.SLOTS - 1)
        out, todo, slot = np.full(len(key), -1), np.arange(len(key)), (key & mask).astype(np.int64)
        while len(todo):
            held = self._key[slot]
            if insert:
                free = held == 0
                self._key[slot[free]] = key[todo[free]]
                held = self._key[slot]
            found = held == key[todo]
            out[todo[found]] = slot[found]
            go = ~found & (held != 0)
            todo, slot = todo[go], (slot[go] + 1) & (self.SLOTS - 1)
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        k = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[k] == key) & (a >= 0) & (b >= 0), self._merged[k], self._none)

    def _merge_matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of one length, a row each, and how many each has."""
        sym = self._single[np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, width)]
        out, count = sym.copy(), np.full(len(sym), width)
        alive, rank = np.arange(len(sym)), self._rank(sym[:, :-1], sym[:, 1:])
        while len(alive):
            j = rank.argmin(1) if rank.shape[1] else np.zeros(len(alive), int)
            best = rank[np.arange(len(alive)), j] if rank.shape[1] else np.full(len(alive), self._none)
            done = best == self._none
            if done.any():
                out[alive[done], : sym.shape[1]] = sym[done]
                go = ~done
                alive, sym, rank, j, best = alive[go], sym[go], rank[go], j[go], best[go]
                if not len(alive):
                    break
            rows = np.arange(len(alive))
            count[alive] -= 1
            w = sym.shape[1]
            sym[rows, j] = best
            keep = np.ones(sym.shape, bool)
            keep[rows, j + 1] = False
            sym = sym[keep].reshape(len(rows), w - 1)
            rank = rank[keep[:, 1:]].reshape(len(rows), w - 2)
            right = j < w - 2
            if w > 2:
                rr = rows[right]
                rank[rr, j[right]] = self._rank(sym[rr, j[right]], sym[rr, j[right] + 1])
                left = j > 0
                rl = rows[left]
                rank[rl, j[left] - 1] = self._rank(sym[rl, j[left] - 1], sym[rl, j[left]])
        return out, count

    def _merge_one(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length: a heap of pairs over a linked list."""
        ranks, n = self.ranks, len(piece)
        part = [piece[k : k + 1] for k in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, part[k] + part[k + 1]) for k in range(n - 1) if (r := ranks.get(part[k] + part[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, both = heapq.heappop(heap)
            m = after[k]
            if not part[k] or m >= n or part[k] + part[m] != both:
                continue
            part[k], part[m] = both, b""
            after[k] = after[m]
            if after[m] < n:
                before[after[m]] = k
            for x in (before[k], k):
                y = after[x] if x >= 0 else n
                if x >= 0 and y < n and (r := ranks.get(part[x] + part[y])) is not None:
                    heapq.heappush(heap, (r, x, part[x] + part[y]))
        return [ranks[p] for p in part if p]

    def _learn(self, pieces: list[bytes], key: np.ndarray) -> None:
        """Merges pieces, all different, and puts them into the cache."""
        slot = self._slots(key, insert=True)
        self._held += len(key)
        width = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            group = [pieces[k] for k in rows.tolist()]
            if w > 64:
                each = [self._merge_one(p) for p in group]
                count = np.array([len(x) for x in each])
                at = self._push(np.array([k for x in each for k in x], np.int32))
            else:
                ids, count = self._merge_matrix(group, w)
                at = self._push(ids[np.arange(w) < count[:, None]])
            self._at[slot[rows]] = at + np.cumsum(count) - count
            self._n[slot[rows]] = count

    def _push(self, ids: np.ndarray) -> int:
        at = self._used
        while at + len(ids) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        self._pool[at : at + len(ids)] = ids
        self._used = at + len(ids)
        return at

    def _pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of a string column, its offsets, where pieces start, each row's first piece, and slots."""
        raw, off = text_bytes(column)
        begin = cuts(raw, off)
        end = np.append(begin[1:], len(raw))
        key = span_hashes(raw, begin, end) | np.uint64(1)
        if self._held * 2 > self.SLOTS:
            self._clear()
        slot = self._slots(key)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new, first = np.unique(key[missing], return_index=True)
            data, first = raw.tobytes(), missing[first]
            while self._held + len(new) > self.SLOTS * 3 // 4:
                self.SLOTS *= 2
                self._clear()
                return self._pieces(column)
            self._learn([data[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())], new)
            slot[missing] = self._slots(key[missing])
        return raw, off, begin, np.searchsorted(begin, off), slot

    def count(self, column: pa.Array) -> np.ndarray:
        """How many ids each row has."""
        _, _, _, piece_off, slot = self._pieces(column)
        return np.diff(np.concatenate([[0], np.cumsum(self._n[slot])])[piece_off])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of a string column, where each row's ids start (n + 1), byte places of the pieces in
        their rows, where each row's pieces start (n + 1), and the pieces' first ids in their rows. The ids are decoded again and compared;
        should two pieces share a hash, which that shows, the column is encoded without the cache."""
        raw, off, begin, piece_off, slot = self._pieces(column)
        at, n = self._at[slot], self._n[slot]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self._pool[np.repeat(at - total[:-1], n) + np.arange(total[-1])]
        if not np.array_equal(self.decode(ids), raw):
            data = raw.tobytes()
            each = [self._merge_one(data[a:b]) for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(data)])]
            total = np.concatenate([[0], np.cumsum([len(x) for x in each])])
            ids = np.array([k for x in each for k in x], np.int32)
        row = np.repeat(off[:-1], np.diff(piece_off))
        first = total[:-1] - np.repeat(total[piece_off[:-1]], np.diff(piece_off))
        return ids, total[piece_off], (begin - row).astype(np.int32), piece_off, first.astype(np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        n = self.lengths[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        return self._bytes[np.repeat(self._starts[ids] - total[:-1], n) + np.arange(total[-1])]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and process."""
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, piece_offsets, piece_ids``: the ids, the byte places of the pieces and the
    places of their first ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, starts, places, piece_off, first = bpe.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(starts).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids)),
                        pa.ListArray.from_arrays(pa.array(piece_off.astype(np.int32)), pa.array(places)),
                        pa.ListArray.from_arrays(pa.array(piece_off.astype(np.int32)), pa.array(first)),
                    ],
                    ["doc_id", "n_tokens", "ids", "piece_offsets", "piece_ids"],
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_tokens int, ids array<int>, piece_offsets array<int>, piece_ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` of encoded rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            ids = batch.column("ids").fill_null([])
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            size = np.concatenate([[0], np.cumsum(bpe.lengths[flat])])
            off = np.asarray(ids.offsets)
            places = size[off - off[0]].astype(np.int64)
            text = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(places), pa.py_buffer(bpe.decode(flat).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text.cast(pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def decode_range(encoded: DataFrame, vocabulary: str, begin: int, end: int) -> DataFrame:
    """``doc_id, bytes``: the bytes from ``begin`` up to ``end`` of every encoded row. Only the ids of the
    pieces that lie in the range leave the JVM and are decoded."""
    low = F.greatest(F.size(F.filter("piece_offsets", lambda x: x <= begin)), F.lit(1))
    high = F.size(F.filter("piece_offsets", lambda x: x < end))
    rows = encoded.select("doc_id", "ids", "piece_ids", "piece_offsets", low.alias("low"), high.alias("high")).where("high >= low")
    a = F.element_at("piece_ids", F.col("low"))
    b = F.when(F.col("high") < F.size("piece_ids"), F.try_element_at("piece_ids", F.col("high") + 1)).otherwise(F.size("ids"))
    rows = rows.select("doc_id", F.slice("ids", a + 1, b - a).alias("ids"), F.element_at("piece_offsets", F.col("low")).alias("at"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            out = [bpe.decode(np.array(ids, np.int64)).tobytes()[max(0, begin - at) : max(0, end - at)] for ids, at in zip(batch.column("ids").to_pylist(), batch.column("at").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return rows.mapInArrow(work, "doc_id long, bytes binary")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded; the ids of every slice are decoded again and compared as they are made."""
    return encode(table(spark, sf_dir, "documents"), default_vocabulary())
