"""Best-fit packing of documents into training sequences by a configuration linear program.

Documents are measured in tokens. What is over ``capacity`` is cut into full sequences; the rests, and
the shorter documents, are packed. Only their length histogram matters for that: a configuration is a
multiset of lengths that fits a sequence, and the program asks for the least number of configurations,
in fractions, that cover the histogram.

It is solved by multiplicative weights. In every round the price of a length is its share of the capacity
times an exponential of how far its cover lags behind the round's part of the demand; a knapsack dynamic
program over these prices gives, in one table, the dearest configuration that holds each length; and each
length that lags gets as much of its own as it lacks, as long as that puts no other length ahead of the
next round. A configuration that is within a hundredth of the dearest is used again, which keeps the
solution sparse. Rounds go on until all demand is covered. Every round's prices, divided by the value of
their dearest configuration, are a solution of the dual program, so the best of them bounds every packing
from below: ``Packing.bound``.

Then the solution is rounded: configurations of most cover first, each down to whole sequences and to what
is left of its lengths. The residual, which shrinks against the corpus as this grows, is packed best fit,
longest first, also into the room that configurations leave.

Scale: texts are read once; what travels are lengths. The driver gets ``capacity`` histogram rows and
its work doesn't grow with the corpus. Places within a length are handed out by rank, and ranks come
from counts by length and bucket, with as many buckets as keep one at ``RANKED`` pieces or so, so no task
sees all the pieces of one length.

Defined cases: a null or empty text has no tokens and no place in the result; a null id is kept;
repeated rows are packed as often as they occur; pieces that tie in length go by id and part; a very long
text is cut into as many pieces as it fills; an empty table gives an empty result. Columns beside the id
and the text are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe
from ._io import table, written
from ._words import slices

CAPACITY = 2048
#: Parts that the demand is covered in; exponent of a part's lag; how near to the dearest a
#: configuration must be to be used again.
ROUNDS, RATE, NEAR = 48, 0.05, 0.01
#: Pieces of one length that are ranked together.
RANKED = 1 << 16

Patterns = list[tuple[dict[int, int], int]]


@dataclass
class Packing:
    """Configurations and how many sequences each fills; the least number that any packing needs; the
    fractional solution's number, and how many sequences its rounding gave before the residual."""

    patterns: Patterns
    bound: float
    fractional: float
    rounded: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)


def _knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The most value in each room, and the length that the room's filling begins with (-1: none)."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for room in range(int(sizes[0]), capacity + 1):
        k = upto[room]
        value = (best[room - sizes[:k]] + prices[:k])[::-1]
        at = int(value.argmax())  # of equal ones the longest
        if value[at] > best[room - 1]:
            best[room], pick[room] = value[at], k - 1 - at
        else:
            best[room] = best[room - 1]
    return best, pick


def _fillings(sizes: np.ndarray, pick: np.ndarray, capacity: int) -> list[list[int]]:
    """For every length the numbers of the lengths in the dearest configuration that holds it."""
    upto = np.maximum.accumulate(np.where(pick >= 0, np.arange(len(pick)), 0)).tolist()
    chosen, size = pick.tolist(), sizes.tolist()
    out = []
    for k, own in enumerate(size):
        filling, room = [k], upto[capacity - own]
        while room:
            filling.append(chosen[room])
            room = upto[room - size[chosen[room]]]
        out.append(filling)
    return out


def _fractional(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int) -> tuple[dict[tuple, float], float]:
    """How much of each configuration, as (number of a length, times), covers the demand; the dual bound."""
    share, want, size = sizes / capacity, demand.tolist(), sizes.tolist()
    cover = [0.0] * len(sizes)
    used: dict[tuple, float] = {}
    last: list[tuple] = [()] * len(sizes)
    bound, step = 0.0, 0
    while any(c < d * (1 - 1e-9) for c, d in zip(cover, want)):
        step += 1
        goal = min(1.0, step / rounds)
        lag = np.clip((goal - np.array(cover) / demand) * rounds, -8, 8)
        prices = share * np.exp(RATE * lag) if step > 1 else share
        best, pick = _knapsack(prices, sizes, capacity)
        bound = max(bound, float(demand @ prices / best[-1]))
        price, value, made = prices.tolist(), best.tolist(), _fillings(sizes, pick, capacity)
        for k in range(len(size) - 1, -1, -1):
            lack = goal * want[k] - cover[k]
            if lack <= 0:
                continue
            config = last[k]
            if not config or sum(price[j] * n for j, n in config) < (1 - NEAR) * (price[k] + value[capacity - size[k]]):
                last[k] = config = tuple(sorted(Counter(made[k]).items()))
            amount = lack / dict(config)[k]
            if step <= 2 * rounds:  # what still lags after that is covered at any price
                ahead = min(1.0, goal + 1 / rounds)
                amount = min(amount, min((ahead * want[j] - cover[j]) / n for j, n in config))
                if amount <= 0:
                    continue
            for j, n in config:
                cover[j] += amount * n
            used[config] = used.get(config, 0.0) + amount
    return used, bound


def _best_fit(left: dict[int, int], patterns: Patterns, capacity: int) -> Patterns:
    """Packs the lengths left, longest first, each into the fullest sequences that it fits, new ones
    where none is left; like sequences are handled at once."""
    room: list[dict[tuple, int]] = [{} for _ in range(capacity + 1)]
    free = np.zeros(capacity + 1, bool)

    def put(key: tuple, n: int) -> None:
        r = capacity - sum(s * k for s, k in key)
        room[r][key] = room[r].get(key, 0) + n
        free[r] = True

    for config, n in patterns:
        put(tuple(sorted(config.items())), n)
    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            at = size + int(free[size:].argmax())
            if not free[at]:
                fit = capacity // size
                if n >= fit:
                    put(((size, fit),), n // fit)
                if n % fit:
                    put(((size, n % fit),), 1)
                break
            key, count = room[at].popitem()
            free[at] = bool(room[at])
            config = dict(key)
            fit = min(at // size, n)
            take = min(count, n // fit)
            if take < count:
                put(key, count - take)
            config[size] = config.get(size, 0) + fit
            put(tuple(sorted(config.items())), take)
            n -= fit * take
    return [(dict(key), n) for held in room for key, n in held.items()]


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Packing:
    """The packing of a count of every length up to capacity."""
    if any(not 0 < s <= capacity for s in histogram):
        raise ValueError("lengths must be between 1 and the capacity")
    whole = {s: n for s, n in histogram.items() if s == capacity and n}
    sizes = np.array(sorted(s for s, n in histogram.items() if s < capacity and n), np.int64)
    if not len(sizes):
        return Packing([({s: 1}, n) for s, n in whole.items()], sum(whole.values()), sum(whole.values()), sum(whole.values()))
    left = [histogram[s] for s in sizes.tolist()]
    used, bound = _fractional(sizes, np.array(left, np.float64), capacity, rounds)
    rounded: Patterns = []
    for config, amount in sorted(used.items(), key=lambda x: (-x[1], x[0])):
        n = min([int(amount + 1e-9), *(left[j] // k for j, k in config)])
        if n:
            for j, k in config:
                left[j] -= n * k
            rounded.append(({int(sizes[j]): k for j, k in config}, n))
    patterns = _best_fit({int(s): n for s, n in zip(sizes, left) if n}, rounded, capacity)
    full = sum(whole.values())
    return Packing(patterns + [({s: 1}, n) for s, n in whole.items()], bound + full, sum(used.values()) + full, sum(n for _, n in rounded) + full)


def _placed(patterns: Patterns):
    """Where the pieces of each length go, in order of rank."""
    rows = []
    base = 0
    for config, n in patterns:
        offset = 0
        for size in sorted(config, reverse=True):
            rows.append((size, n * config[size], base, config[size], offset))
            offset += size * config[size]
        base += n
    rows.sort(key=lambda r: (r[0], r[2]))
    size, slots, base_of, each, offset = (np.array([r[k] for r in rows], np.int64) for k in range(5))
    before = np.cumsum(slots) - slots
    first = np.searchsorted(size, size)
    start = before - before[first] if len(size) else before  # rank at which a configuration's turn comes
    turn = size << 40 | start

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("n_tokens", "rank"))
            k = np.searchsorted(turn, n.astype(np.int64) << 40 | rank, "right") - 1
            q = rank - start[k]
            arrays = {c: batch.column(c) for c in ("doc_id", "part", "start_token", "n_tokens")}
            yield pa.RecordBatch.from_pydict({"bin_id": pa.array(base_of[k] + q // each[k])} | arrays | {"offset": pa.array((offset[k] + q % each[k] * n).astype(np.int32))})

    return work


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n`` for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(encoder.count(part.column("text")).astype(np.int64))], ["doc_id", "n"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bin_id, doc_id, part, start_token, n_tokens, offset``: for every piece of every document the
    sequence it goes to and its place there."""
    counts = written(token_counts(docs, vocabulary, id_col, text_col), "lengths")
    parts = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))
    pieces = counts.where("n > 0").select("doc_id", "n", F.explode(parts).alias("part"))
    start = F.col("part") * F.lit(capacity).cast("long")
    pieces = pieces.select("doc_id", "part", start.alias("start_token"), F.least(F.lit(capacity), F.col("n") - start).cast("int").alias("n_tokens"))
    histogram = {r["n_tokens"]: r["k"] for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("k")).collect()}
    patterns = solve(histogram, capacity).patterns
    buckets = F.array(*(F.lit(max(1, -(-histogram.get(n, 0) // RANKED))) for n in range(capacity + 1)))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part"), buckets[F.col("n_tokens")]).cast("int"))
    sums = pieces.groupBy("n_tokens", "bucket").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("n_tokens").orderBy("bucket")) - F.col("k")
    sums = sums.select("n_tokens", "bucket", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "part")) - 1
    ranked = pieces.withColumn("rank", rank.cast("long")).join(sums, ["n_tokens", "bucket"])
    ranked = ranked.select("doc_id", "part", "start_token", "n_tokens", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_placed(patterns), "bin_id long, doc_id long, part int, start_token long, n_tokens int, offset int")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), bpe.default_vocabulary())
