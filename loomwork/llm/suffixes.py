"""Suffix-array dedup with a logarithmic index family.

Documents arrive in batches. Every slice of a batch's texts gets its suffix array, over words: suffixes of
all places from which ``min_words`` words are left, ordered to that depth by prefix doubling on ranks of
words. Neighbours of equal rank have a common prefix of ``min_words`` words or more, so all repeats within
a slice are read off it: the first of them stands for all, and the others are known to repeat it.

What is left, one suffix of each rank, is routed by hash to parts of suffix space as an ordered array: by
the codes of the first two words and then by a 64-bit hash of the ``min_words`` words, so that neighbours of
equal keys are those with a common prefix of that length. A part merges its slices' arrays and scans the
result against the part's levels of the family; a suffix that meets an earlier one is a repeat.

A level is a folder of its own with an ordered array of keys for each part. A batch becomes a level of
size 1; while there is a level of equal size the two are merged into one of twice the size; all other
levels are read and stay as they are. So after k batches a key has been written log k times at most.
``Family`` keeps the list of levels in a file that is replaced as a whole when an update has succeeded.

Scale: a suffix is about 12 bytes where it is shuffled, once, whatever the number of levels; levels are
never shuffled. A passage that any number of documents share is one suffix a slice. A task holds a part of
one batch and, one after another, that part's levels.

Defined cases are those of ``substring``, to the same spans: a null text is empty and has no spans; a null
id sorts first; rows equal in id and text count as one document in a batch; of ties the first by (id, text
hash, place) stays; short texts have none; a very long text is a slice of its own; an empty table gives
none; other columns are never read. A document that comes again in a later batch repeats itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import drop, opened, put, shared_path, table
from ._words import Words, slices
from .substring import ORACLE, keyed_texts

#: Bytes of texts that get a suffix array; arrival batches of a table that is there as a whole.
SLICE, BATCHES = 2 << 20, 4
_ROUTED = "part int, size int, n int, n_docs int, block binary, doc long, mark int, ranges array<int>"
_FOUND = "doc long, mark int, ranges array<int>"
_CODEC = "zstd"


def ranks(codes: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes to a depth in words: where each one's group of equals begins in the suffix
    array. By prefix doubling; only groups of several are sorted again. ``left``: words to the text's end."""
    n = len(codes)
    _, rank = np.unique(codes, return_inverse=True)
    count = np.bincount(rank, minlength=1)
    rank = (np.cumsum(count) - count)[rank]
    todo = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    known = 1
    while known < depth and len(todo):
        step = min(known, depth - known)
        after = np.where(left[todo] > step, rank[np.minimum(todo + step, n - 1)] + 1, 0)
        key = rank[todo].astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        key, todo = key[order], todo[order]
        at = np.arange(len(todo))
        old, new = np.ones(len(todo), bool), np.ones(len(todo), bool)
        old[1:] = key[1:] >> np.uint64(32) != key[:-1] >> np.uint64(32)
        new[1:] = key[1:] != key[:-1]
        begins = np.maximum.accumulate(np.where(new, at, 0))
        rank[todo] += begins - np.maximum.accumulate(np.where(old, at, 0))
        todo = todo[np.bincount(begins, minlength=len(todo))[begins] > 1]
        known += step
    return rank


def _ranges(of: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of consecutive places, by the document that they are in: first and last (exclusive), flat."""
    order = np.lexsort([place, of])
    of, place = of[order], place[order]
    begin = np.ones(len(of), bool)
    begin[1:] = (of[1:] != of[:-1]) | (place[1:] > place[:-1] + 1)
    end = np.append(begin[1:], True)[: len(of)]
    flat = np.stack([place[begin], place[end] + 1], 1).astype(np.int32)
    owner = of[begin]
    cut = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), len(owner)]
    for a, b in zip(cut, cut[1:]):
        if b > a:
            yield int(owner[a]), flat[a:b].reshape(-1)


def _planes(a: np.ndarray) -> bytes:
    """The bytes of numbers, those of equal weight together."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _numbers(data: memoryview, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, n).T.copy().view(kind).reshape(-1)


def _order(doc: pa.Array, mark: pa.Array) -> np.ndarray:
    """Ranks of documents by id, nulls first, and text hash."""
    keys = mark.to_numpy(), doc.fill_null(0).to_numpy(), np.asarray(doc.is_valid())
    order = np.lexsort(keys)
    new = np.zeros(len(order), np.int64)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _suffixes(min_words: int, parts: int):
    """The suffix arrays of the slices, routed by part, and the repeats within them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([("part", pa.int32()), ("size", pa.int32()), ("n", pa.int32()), ("n_docs", pa.int32()), ("block", pa.binary()), ("doc", pa.int64()), ("mark", pa.int32()), ("ranges", pa.list_(pa.int32()))])
        for batch in batches:
            for part in slices(batch, "text", limit=SLICE):
                words = Words(part.column("text"))
                at = np.flatnonzero(words.left >= min_words)
                if not len(at):
                    continue
                doc, mark = part.column("doc"), part.column("mark")
                by = _order(doc, mark)
                rank, of, place = ranks(words.hash, words.left, min_words)[at], words.doc[at], words.place[at]
                order = np.lexsort([place, by[of], rank])
                at, rank, of, place = at[order], rank[order], of[order], place[order]
                head = np.ones(len(at), bool)
                head[1:] = rank[1:] != rank[:-1]
                first = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                again = ~head & ((by[of] != by[of[first]]) | (place != place[first]))
                rows: list[tuple] = []
                for d, ranges in _ranges(of[again], place[again]):
                    rows.append((d % parts, 0, 0, 0, None, doc[d].as_py(), mark[d].as_py(), ranges.tolist()))
                at, of, place = at[head], of[head], place[head]
                h = words.windows(at, min_words)
                code = words.hash >> np.uint64(48)
                key = code[at] << np.uint64(48) | code[at + 1] << np.uint64(32) | h >> np.uint64(32)
                low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                to = (h % np.uint64(parts)).astype(np.int32)
                order = np.lexsort([low, key, to])
                key, low, of, place, to = key[order], low[order], of[order], place[order], to[order]
                cut = np.searchsorted(to, np.arange(parts + 1)).tolist()
                for p, (a, b) in enumerate(zip(cut, cut[1:])):
                    if b > a:
                        docs, index = np.unique(of[a:b], return_inverse=True)
                        held = pa.array(docs)
                        ids = doc.take(held)
                        data = b"".join([
                            _planes(key[a:b]), _planes(low[a:b]), _planes(index.astype(np.uint32)), _planes(place[a:b].astype(np.uint32)),
                            ids.fill_null(0).to_numpy().tobytes(), np.asarray(ids.is_valid()).astype(np.uint8).tobytes(), mark.take(held).to_numpy().tobytes(),
                        ])
                        rows.append((p, len(data), b - a, len(docs), pa.compress(data, _CODEC, asbytes=True), None, None, None))
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    return work


def _level(folder: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    """A part's keys in a level, in order; none if there is no file."""
    where, at = opened(f"{folder}/{part}.keys")
    try:
        with where.open_input_stream(at) as file:
            data = file.read()
    except FileNotFoundError:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    n = int.from_bytes(data[:8], "little")
    data = memoryview(pa.decompress(data[8:], 12 * n, _CODEC, asbytes=True))
    return _numbers(data[: 8 * n], "<u8", n), _numbers(data[8 * n :], "<u4", n)


def scan(key: np.ndarray, low: np.ndarray, level: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of a batch's ordered keys lie in a level, which is ordered too."""
    if not len(level[0]):
        return np.zeros(len(key), bool)
    at = np.searchsorted(level[0], key)
    found = np.zeros(len(key), bool)
    todo = np.arange(len(key))
    while len(todo):  # a second step is for keys that agree in the upper 64 bits only
        todo = todo[at[todo] < len(level[0])]
        todo = todo[level[0][at[todo]] == key[todo]]
        hit = level[1][at[todo]] == low[todo]
        found[todo[hit]] = True
        todo = todo[~hit]
        at[todo] += 1
    return found


def _arrive(levels: list[str], merged: list[str], target: str | None):
    """A part's work on a batch: merge its slices' arrays, scan them against all levels, and write the new
    keys, with those of the levels to be merged, as the part's array in ``target``."""

    def arrays(rows: list[tuple]) -> tuple:
        keys, lows, docs, marks, of, places, base = [], [], [], [], [], [], 0
        for size, n, m, block in rows:
            data = memoryview(pa.decompress(block, size, _CODEC, asbytes=True))
            keys.append(_numbers(data[: 8 * n], "<u8", n))
            lows.append(_numbers(data[8 * n : 12 * n], "<u4", n))
            of.append(_numbers(data[12 * n : 16 * n], "<u4", n).astype(np.int64) + base)
            places.append(_numbers(data[16 * n : 20 * n], "<u4", n).astype(np.int64))
            rest = data[20 * n :]
            docs.append(pa.array(np.frombuffer(rest[: 8 * m], np.int64), mask=np.frombuffer(rest[8 * m : 9 * m], np.uint8) == 0))
            marks.append(pa.array(np.frombuffer(rest[9 * m :], np.int32)))
            base += m
        return *(np.concatenate(x) for x in (keys, lows, of, places)), pa.concat_arrays(docs), pa.concat_arrays(marks)

    def one(part: int, rows: list[tuple]) -> list[tuple]:
        out = []
        if rows:
            key, low, of, place, doc, mark = arrays(rows)
            by = _order(doc, mark)
            order = np.argsort(key, kind="stable")
            tie = np.zeros(len(key), bool)
            tie[1:] = key[order[1:]] == key[order[:-1]]
            tie[:-1] |= tie[1:]
            some = order[tie]
            order[tie] = some[np.lexsort([place[some], by[of[some]], low[some], key[some]])]
            key, low, of, place = key[order], low[order], of[order], place[order]
            head = np.ones(len(key), bool)
            head[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1])
            first = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
            repeat = ~head & ((by[of] != by[of[first]]) | (place != place[first]))
            new = np.flatnonzero(head)
            for level in levels:
                seen = scan(key[new], low[new], _level(level, part))
                repeat[new[seen]] = True
                new = new[~seen]
            number = by[of[repeat]]
            sample = np.zeros(int(by.max()) + 1, np.int64)
            sample[by] = np.arange(len(by))
            for k, ranges in _ranges(number, place[repeat]):
                d = int(sample[k])
                out.append((doc[d].as_py(), mark[d].as_py(), ranges.tolist()))
            held = [(key[new], low[new])]
        else:
            held = []
        if target and (rows or merged):
            held += [_level(level, part) for level in merged]
            key, low = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            order = np.lexsort([low, key])
            put(f"{target}/{part}.keys", len(order).to_bytes(8, "little") + pa.compress(_planes(key[order]) + _planes(low[order]), _CODEC, asbytes=True))
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32())]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc", "mark", "ranges"])
        now, held = None, []
        for batch in batches:
            known = batch.filter(pa.compute.is_valid(batch.column("ranges")))
            if known.num_rows:
                yield known.select(["doc", "mark", "ranges"])
            for part, size, n, m, block, named in zip(*(batch.column(c).to_pylist() for c in ("part", "size", "n", "n_docs")), batch.column("block"), batch.column("ranges").is_valid().to_pylist()):
                if part != now:
                    if now is not None and (rows := one(now, held)):
                        yield batch_of(rows)
                    now, held = part, []
                if not named and n:
                    held.append((size, n, m, block.as_buffer()))
        if now is not None and (rows := one(now, held)):
            yield batch_of(rows)

    return work


@dataclass
class Family:
    """The levels of an index: a folder and a number of batches each, largest first."""

    path: str
    parts: int
    min_words: int = 50
    levels: list[tuple[int, str]] = field(default_factory=list)
    batches: int = 0

    @classmethod
    def load(cls, path: str) -> Family:
        where, at = opened(f"{path}/family.json")
        with where.open_input_stream(at) as file:
            return cls(**json.loads(file.read()))

    def update(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
        """Takes in a batch. Returns ``doc, mark, ranges``: of each document with repeats the first and last
        (exclusive) places, flat, at which windows of ``min_words`` words start that a document before it
        holds, of this batch or an earlier one. Without ``keep`` the batch is only compared."""
        spark = docs.sparkSession
        size, merged = 1, []
        while self.levels and len(merged) < len(self.levels) and self.levels[-1 - len(merged)][0] == size:
            merged.append(self.levels[-1 - len(merged)][1])
            size *= 2
        target = f"{self.path}/level-{self.batches:06d}-{size}" if keep else None
        if target:
            where, at = opened(target)
            where.create_dir(at)
        keyed = keyed_texts(docs, id_col, text_col).select("doc", "mark", "text")
        routed = keyed.mapInArrow(_suffixes(self.min_words, self.parts), _ROUTED)
        if merged and keep:  # every part is visited, so that those without new suffixes are merged too
            none = {"block": "binary", "doc": "long", "mark": "int", "ranges": "array<int>"}
            each = spark.range(self.parts).select(F.col("id").cast("int").alias("part"), *(F.lit(0).alias(c) for c in ("size", "n", "n_docs")), *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
            routed = routed.unionByName(each)
        found = routed.repartitionById(self.parts, F.col("part")).sortWithinPartitions("part").mapInArrow(_arrive([f for _, f in self.levels], merged, target), _FOUND)
        path = shared_path(spark, "repeats")
        cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = spark.conf.get(cleanup, "false")
        spark.conf.set(cleanup, "true")  # a batch's suffixes aren't read again
        try:
            found.write.parquet(path)
        finally:
            spark.conf.set(cleanup, before)
        if keep:
            self.levels = [*self.levels[: len(self.levels) - len(merged)], (size, target)]
            self.batches += 1
            put(f"{self.path}/family.json", json.dumps(self.__dict__).encode())
            drop(spark, *merged)
        return spark.read.schema(_FOUND).parquet(path)


def _spans(min_words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("ranges")
            off = np.asarray(flat.offsets) // 2
            pairs = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2).astype(np.int64)
            off = off - off[0]
            of = np.repeat(np.arange(batch.num_rows), np.diff(off))
            order = np.lexsort([pairs[:, 0], of])
            of, begin, end = of[order], pairs[order, 0], pairs[order, 1] - 1 + min_words
            # Running ends, row by row: rows are set apart by more than any place.
            apart = of * np.int64(1 << 32)
            reach = np.maximum.accumulate(end + apart)
            new = np.ones(len(of), bool)
            new[1:] = begin[1:] + apart[1:] > reach[:-1]
            last = np.append(new[1:], True)[: len(of)]
            rows = pa.array(of[new])
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(rows), batch.column("mark").take(rows), pa.array(begin[new].astype(np.int32)), pa.array((reach - apart)[last].astype(np.int32))], ["doc_id", "mark", "start_word", "end_word"])

    return work


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, batches: int = BATCHES) -> DataFrame:
    """The spans of ``substring.spans``, by way of an index family: the documents arrive in ``batches``
    parts by their ids, so that what came earlier is what has the lesser id."""
    spark = docs.sparkSession
    path = shared_path(spark, "family")
    family = Family(path, int(spark.conf.get("spark.sql.shuffle.partitions")), min_words)
    number = F.col(f"`{id_col}`").cast("long")
    shares = [k / batches for k in range(1, batches)]
    cuts = sorted({c for c in docs.select(F.percentile_approx(number, shares, 1000).alias("c")).first()["c"] or [] if c is not None}) if shares else []
    found = None
    for k in range(len(cuts) + 1):
        low = F.coalesce(number >= cuts[k - 1], F.lit(False)) if k else F.lit(True)
        high = F.coalesce(number < cuts[k], F.lit(True)) if k < len(cuts) else F.lit(True)
        here = family.update(docs.where(low & high), id_col, text_col, keep=k < len(cuts))
        found = here if found is None else found.unionByName(here)
    drop(spark, path)
    rows = found.groupBy("doc", "mark").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    return rows.mapInArrow(_spans(min_words), "doc_id long, mark int, start_word int, end_word int")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repeated spans of 50 words or more in documents."""
    return spans(table(spark, sf_dir, "documents")).drop("mark")


__all__ = ["ORACLE", "Family", "op3_suffix_array_dedup", "ranks", "scan", "spans"]
