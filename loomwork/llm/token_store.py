"""Token ids in binary shards with a minimal perfect hash index.

``write`` encodes the documents and gives the ids, as raw little-endian numbers of two bytes (four for
vocabularies over 65,536), to shard files in the shared storage: one for every attempt of a task, under
a name that no other attempt has. Rows refer to the shards of the attempts that Spark committed, so a
lost executor, a retried stage or a speculative copy leaves nothing that is ever read. The payload is
never shuffled; keys, a few bytes each, are, to index partitions by hash.

An index partition is a minimal perfect hash over its keys: levels of bit arrays in which keys that
fall alone into a bit are placed and the others go on to the next level, with bit counts for ranks. A
key's rank is its slot in arrays of fingerprints (32 bits of another hash), shards, offsets and
lengths. A lookup is a few array reads whatever the size, and an absent key is refused by its
fingerprint, but for one in four billion. A table of keys is routed to the partitions that hold them, so
a task has one partition of the index open at a time, memory-mapped where the storage is mounted.

The folder may be a mounted one or any that Arrow's file systems know; others raise.

Defined cases: a null or empty text is a document of no ids; a null id has no key: its ids are stored
and scanned but can't be looked up; of rows that share an id the lookup gives the first by partition
number, shard and offset, though all are stored; a very long text is one entry like others, its ids in
one piece; an empty table gives a store without shards. Columns beside the id and the text are never
read.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from ._io import opened, put, shared_path, table
from ._words import mix, slices

#: Bits of a level for every key that comes to it; keys that an index partition holds at most on
#: average, and at least where there are tasks to share them.
GAMMA, KEYS, FEW = 2.0, 1 << 20, 1 << 12
_LEVELS = 64
_ENTRY = "doc_id long, shard string, offset long, n_tokens int, crc long"


def _hash(keys: np.ndarray, salt: int) -> np.ndarray:
    return mix(keys.view(np.uint64) ^ mix(np.full(1, salt + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (_hash(keys, 1 << 21) % np.uint64(parts)).astype(np.int32)


@dataclass
class PerfectHash:
    """Slots 0 to n - 1 for n different keys."""

    bits: list[np.ndarray]
    ranks: list[np.ndarray]  # keys placed before each word of 64 bits, in all levels

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits, ranks, placed = [], [], 0
        left = keys
        for level in range(_LEVELS):
            if not len(left):
                break
            words = max(1, -(-int(GAMMA * len(left)) // 64))
            at = (_hash(left, level) % np.uint64(words * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=words * 64) == 1
            packed = np.packbits(alone.reshape(-1, 64), axis=1, bitorder="little").view("<u8").reshape(-1)
            count = np.bitwise_count(packed).astype(np.int64)
            bits.append(packed)
            ranks.append(placed + np.cumsum(count) - count)
            placed += int(count.sum())
            left = left[~alone[at]]
        if len(left):
            raise ValueError("the keys aren't all different")
        return cls(bits, ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The keys' slots. A key that isn't in gets any slot or -1."""
        out = np.full(len(keys), -1)
        todo = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks)):
            if not len(todo):
                break
            at = _hash(keys[todo], level) % np.uint64(len(bits) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = (bits[word] >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[here]] = (ranks[word] + below)[here]
            todo = todo[~here]
        return out


def _shards(path: str, vocabulary: str, width: str):
    """Writes a task's ids to a shard and gives an entry for each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(vocabulary)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
        where, folder = opened(path)
        size = np.dtype(width).itemsize
        offset, out = 0, None
        try:
            for batch in batches:
                for part in slices(batch, "text"):
                    out = out or where.open_output_stream(f"{folder}/{name}", buffer_size=1 << 20)
                    ids, starts, *_ = encoder.encode(part.column("text"))
                    data = ids.astype(width).tobytes()
                    out.write(data)
                    cut = (starts * size).tolist()
                    crc = [zlib.crc32(data[a:b]) for a, b in zip(cut, cut[1:])]
                    arrays = [part.column("doc_id"), pa.array([name] * part.num_rows), pa.array(offset + starts[:-1] * size), pa.array(np.diff(starts).astype(np.int32)), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "shard", "offset", "n_tokens", "crc"])
                    offset += len(data)
        finally:
            if out:
                out.close()

    return work


def _packed(about: dict, arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays one after the other, each at a multiple of 64 bytes, behind a line that says where."""
    at, places = 0, {}
    for name, a in arrays.items():
        places[name] = (at, a.dtype.str, len(a))
        at += -(-a.nbytes // 64) * 64
    head = json.dumps({"about": about, "arrays": places}).encode()
    head += b" " * (-(len(head) + 1) % 64) + b"\n"
    out = io.BytesIO(head)
    out.seek(len(head))
    for a in arrays.values():
        out.write(a.tobytes())
        out.write(b"\0" * (-a.nbytes % 64))
    return out.getvalue()


def _unpacked(path: str) -> tuple[dict, dict[str, np.ndarray]] | None:
    where, at = opened(path)
    try:
        data = (pa.memory_map(at) if where.type_name == "local" else where.open_input_file(at)).read_buffer()
    except FileNotFoundError:
        return None
    raw = np.frombuffer(data, np.uint8)
    end = bytes(raw[: 1 << 16]).index(b"\n") + 1
    head = json.loads(bytes(raw[:end]))
    return head["about"], {n: np.frombuffer(data, kind, count, end + a) for n, (a, kind, count) in head["arrays"].items()}


def _index(path: str):
    """Builds one index partition from the entries of its keys."""

    def work(key: tuple, found: pa.Table) -> pa.Table:
        part = key[0].as_py()
        found = found.sort_by([("doc_id", "ascending"), ("shard", "ascending"), ("offset", "ascending")])
        keys = found.column("doc_id").to_numpy()
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        found = found.filter(pa.array(first))
        keys = found.column("doc_id").to_numpy()
        perfect = PerfectHash.build(keys)
        slot = perfect.slots(keys)
        names, shard = np.unique(np.array(found.column("shard").to_pylist()), return_inverse=True)
        by_slot = np.empty(len(keys), np.int64)
        by_slot[slot] = np.arange(len(keys))
        arrays = {f"bits{k}": b for k, b in enumerate(perfect.bits)} | {f"ranks{k}": r for k, r in enumerate(perfect.ranks)}
        arrays |= {"fingerprint": fingerprint(keys)[by_slot], "shard": shard[by_slot].astype(np.int32), "names": np.frombuffer("\n".join(names).encode(), np.uint8)}
        arrays |= {c: found.column(c).to_numpy()[by_slot] for c in ("offset", "n_tokens", "crc")}
        put(f"{path}/{part}.index", _packed({"levels": len(perfect.bits)}, arrays))
        return pa.table({"part": pa.array([part], pa.int32()), "n_keys": pa.array([len(keys)], pa.int64())})

    return work


class Store:
    """A written store: its folder, index partitions and width of ids. Holds one partition open."""

    def __init__(self, path: str, parts: int, width: str):
        self.path, self.parts, self.width = path, parts, width
        self._held: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_held": None}

    def _part(self, part: int) -> tuple[PerfectHash, dict[str, np.ndarray], np.ndarray] | None:
        if self._held is None or self._held[0] != part:
            found = _unpacked(f"{self.path}/{part}.index")
            if found:
                n, a = found[0]["levels"], found[1]
                names = np.array(a["names"].tobytes().decode().split("\n"), object)
                found = PerfectHash([a[f"bits{k}"] for k in range(n)], [a[f"ranks{k}"] for k in range(n)]), a, names
            self._held = part, found
        return self._held[1]

    def locate(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        """For every key its shard, offset, tokens, checksum and slot; a shard of None if it isn't in."""
        keys = np.asarray(keys, np.int64)
        out = {"shard": np.full(len(keys), None, object)} | {c: np.full(len(keys), -1, np.int64) for c in ("offset", "n_tokens", "crc", "slot")}
        part = part_of(keys, self.parts)
        for p in np.unique(part).tolist():
            here = self._part(p)
            if here is None:
                continue
            perfect, arrays, names = here
            rows = np.flatnonzero(part == p)
            slot = perfect.slots(keys[rows])
            ok = slot >= 0
            ok[ok] = arrays["fingerprint"][slot[ok]] == fingerprint(keys[rows][ok])
            rows, slot = rows[ok], slot[ok]
            out["slot"][rows] = slot
            out["shard"][rows] = names[arrays["shard"][slot]]
            for c in ("offset", "n_tokens", "crc"):
                out[c][rows] = arrays[c][slot]
        return out

    def payload(self, shard: str):
        """A shard, open for reading at any place."""
        where, at = opened(f"{self.path}/{shard}")
        return where.open_input_file(at)

    def get(self, key: int) -> np.ndarray | None:
        """A document's ids by its key."""
        at = self.locate(np.array([key]))
        if at["shard"][0] is None:
            return None
        with self.payload(at["shard"][0]) as file:
            return np.frombuffer(file.read_at(int(at["n_tokens"][0]) * np.dtype(self.width).itemsize, int(at["offset"][0])), self.width)


def _routed(parts: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("part", pa.array(part_of(batch.column("doc_id").to_numpy(), parts)))

    return work


def write(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[Store, DataFrame]:
    """Writes a store into a folder that all executors share; returns it and the table of entries."""
    spark = docs.sparkSession
    where, folder = opened(path)
    if where.get_file_info(folder).type.value:
        raise ValueError(f"the folder is there already: {path}")
    where.create_dir(folder)
    width = "<u2" if len(bpe.encoder(vocabulary).tokens) <= 1 << 16 else "<u4"
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows.mapInArrow(_shards(path, vocabulary, width), _ENTRY).write.parquet(f"{path}/entries")
    entries = spark.read.schema(_ENTRY).parquet(f"{path}/entries")
    n, tasks = entries.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-n // KEYS), min(tasks, -(-n // FEW)))
    keyed = entries.where("doc_id is not null").mapInArrow(_routed(parts), f"{_ENTRY}, part int")
    keyed.groupBy("part").applyInArrow(_index(path), "part int, n_keys long").write.parquet(f"{path}/parts")
    return Store(path, parts, width), entries


def lookup(keys: DataFrame, store: Store, key_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, slot, crc, intact`` for keys: where in its index partition each key is, and
    whether what lies at its place has the stored checksum. Keys that aren't in the store, nulls too, give
    no row. Keys are routed to the tasks that hold their index partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.dtype(store.width).itemsize
        for batch in batches:
            at = store.locate(batch.column("doc_id").to_numpy())
            rows = np.array([k for k, s in enumerate(at["shard"]) if s is not None], np.int64)
            order = rows[np.lexsort([at["offset"][rows], at["shard"][rows].astype(str)])] if len(rows) else rows
            intact, held, file = {}, None, None
            for k in order.tolist():
                if at["shard"][k] != held:
                    held = at["shard"][k]
                    file = store.payload(held)
                intact[k] = zlib.crc32(file.read_at(int(at["n_tokens"][k]) * size, int(at["offset"][k]))) == at["crc"][k]
            take = lambda c, t: pa.array(at[c][rows].astype(t))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), take("n_tokens", np.int32), take("slot", np.int64), take("crc", np.int64), pa.array([intact[k] for k in rows.tolist()], pa.bool_())],
                ["doc_id", "n_tokens", "slot", "crc", "intact"],
            )

    found = keys.select(F.col(f"`{key_col}`").cast("long").alias("doc_id")).where("doc_id is not null")
    found = found.mapInArrow(_routed(store.parts), "doc_id long, part int").repartition("part").sortWithinPartitions("part").select("doc_id")
    return found.mapInArrow(work, "doc_id long, n_tokens int, slot long, crc long, intact boolean")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as ids, and each looked up by its key and read back."""
    docs = table(spark, sf_dir, "documents")
    store, _ = write(docs, shared_path(spark, "tokens"), bpe.default_vocabulary())
    return lookup(docs.select("doc_id"), store)
