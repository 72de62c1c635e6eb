"""Exact vector search, reranking and prompt assembly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vectors as V

#: Queries that are sent to the tasks at once.
QUERIES = 16_384
#: Queries that meet the points in one product, and the scores of a product.
TILE, SCORES = 1024, 1 << 19
NO_CONTEXT = "No relevant information was found."


def condition(spec: dict) -> Column:
    """A payload filter: ``must`` (all), ``should`` (any), ``must_not`` (none) of ``{key, match: {value |
    any}}``, ``{key, range: {gt, gte, lt, lte}}`` or nested filters. Null payloads don't match."""

    def one(x: dict) -> Column:
        if "key" not in x:
            return condition(x)
        c = F.col(x["key"])
        if "match" in x:
            hit = c == x["match"]["value"] if "value" in x["match"] else c.isin(*x["match"]["any"])
        else:
            ops = {"gt": c.__gt__, "gte": c.__ge__, "lt": c.__lt__, "lte": c.__le__}
            hit = F.lit(True)
            for k, v in x["range"].items():
                hit = hit & ops[k](v)
        return F.coalesce(hit, F.lit(False))

    out = F.lit(True)
    for x in spec.get("must", []):
        out = out & one(x)
    for x in spec.get("must_not", []):
        out = out & ~one(x)
    if spec.get("should"):
        some = F.lit(False)
        for x in spec["should"]:
            some = some | one(x)
        out = out & some
    return out


def top_k(points: DataFrame, query: list[float], limit: int = 5, threshold: float = 0.7, where: dict | None = None, metric: str = "cosine", vector: str = "embedding", id_col: str = "vec_id", with_vectors: bool = False) -> DataFrame:
    """The points nearest to a vector, nearest first, with ``score``. Filters run before scores."""
    rows = points.where(condition(where)) if where else points
    rows = rows.withColumn("score", V.similarity(F.col(vector), F.array(*(F.lit(float(x)) for x in query)), metric)).where(F.col("score") >= threshold)
    rows = rows.orderBy(F.desc("score"), id_col).limit(limit)
    return rows if with_vectors else rows.drop(vector)


def _best_of(scores: np.ndarray, ids: np.ndarray, limit: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of scores the ``limit`` highest, ties by id: row, id, score."""
    k = min(limit, scores.shape[1])
    least = np.maximum(np.partition(scores, scores.shape[1] - k, axis=1)[:, -k], threshold) if k else np.zeros(len(scores))
    row, at = np.nonzero(scores >= least[:, None])
    found = scores[row, at]
    order = np.lexsort([ids[at], -found, row])
    row, at, found = row[order], at[order], found[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < limit
    return row[keep], ids[at[keep]], found[keep]


def _merged(best: tuple, new: tuple, limit: int) -> tuple:
    """The ``limit`` best of each row in two of ``_best_of``'s results."""
    row, ids, found = (np.concatenate([a, b]) for a, b in zip(best, new))
    order = np.lexsort([ids, -found, row])
    row, ids, found = row[order], ids[order], found[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < limit
    return row[keep], ids[keep], found[keep]


def top_k_each(points: DataFrame, queries: DataFrame, limit: int = 5, threshold: float = 0.7, metric: str = "cosine", vector: str = "embedding", id_col: str = "vec_id", query_id: str = "query_id", query_vector: str = "query", block: int = QUERIES) -> DataFrame:
    """``query_id, id, score, rank`` for a table of queries against all points, exactly. Queries go in
    blocks of about ``block``, each of which is sent to the tasks as a matrix and meets the points in
    products of matrices of about ``SCORES`` scores, however many queries and points there are; a task keeps
    the best of each query, so what is shuffled is ``limit`` rows a query and task. Scores are rounded to nine decimals, and ties go by id. Null vectors match nothing."""
    named = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vector).cast("array<double>").alias("_q")).where("_q is not null")
    blocks = max(1, -(-named.count() // block))
    kind = "string" if points.schema[id_col].dataType.simpleString() == "string" else "bigint"
    rows = points.select(F.col(id_col).cast(kind).alias("id"), F.col(vector).cast("array<double>").alias("_v")).where("_v is not null and id is not null")

    def against(number: np.ndarray, q: np.ndarray):
        tiles = [(q[at : at + TILE], np.linalg.norm(q[at : at + TILE], axis=1)) for at in range(0, len(q), TILE)]
        step = max(64, SCORES // max(1, min(len(q), TILE)))

        def score(some: np.ndarray, long: np.ndarray, v: np.ndarray, size: np.ndarray) -> np.ndarray:
            out = some @ v.T
            if metric == "euclid":
                out *= 2
                np.subtract((long**2)[:, None] + (size**2)[None, :], out, out=out)
                np.negative(np.sqrt(np.maximum(out, 0, out=out), out=out), out=out)
            elif metric != "dot":
                scale = long[:, None] * size[None, :]
                some_length = scale > 0
                np.divide(out, scale, out=out, where=some_length)
                out[~some_length] = 0.0
            return np.round(out, 9, out=out)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = np.zeros(0, np.int64), np.zeros(0, str if kind == "string" else np.int64), np.zeros(0)
            best = [none] * len(tiles)
            for batch in batches:
                if not batch.num_rows:
                    continue
                every = np.array(batch.column("id").to_pylist())
                flat = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for at in range(0, batch.num_rows, step):
                    v, ids = flat[at : at + step], every[at : at + step]
                    size = np.linalg.norm(v, axis=1)
                    for k, (some, long) in enumerate(tiles):
                        best[k] = _merged(best[k], _best_of(score(some, long, v, size), ids, limit, threshold), limit)
            for k, (row, ids, found) in enumerate(best):
                yield pa.RecordBatch.from_arrays([pa.array(number[row + k * TILE]), pa.array(ids.tolist(), pa.string() if kind == "string" else pa.int64()), pa.array(found)], ["query_id", "id", "score"])

        return work

    out = None
    for k in range(blocks):
        held = named.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).collect() if blocks > 1 else named.collect()
        if held:
            found = rows.mapInArrow(against(np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.float64)), f"query_id long, id {kind}, score double")
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.where("false").select(F.lit(0).cast("long").alias("query_id"), "id", F.lit(0.0).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= limit)


def results(hits: DataFrame) -> DataFrame:
    """``content, source_url, document_id, score`` from hits whose payload may name them otherwise."""
    has = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names if n in hits.columns), F.lit(""))
    return hits.select(has("content", "text").alias("content"), has("url", "source_url").alias("source_url"), *[F.col(c) for c in ("document_id", "score") if c in hits.columns])


def rerank_score(score: Column, query: Column, content: Column) -> Column:
    """0.7 of the score, 0.2 of the query's terms that the content has, 0.1 for brevity."""
    q, c = F.array_distinct(T.words(F.lower(query))), T.words(F.lower(content))
    overlap = F.when(F.size(q) > 0, F.size(F.array_intersect(q, c)) / F.size(q)).otherwise(F.lit(0.0))
    return score * 0.7 + overlap * 0.2 + F.least(F.lit(1.0), F.lit(200.0) / F.greatest(F.size(c), F.lit(1))) * 0.1


def rerank(hits: DataFrame, query: str, limit: int, content: str = "content", order: str = "score") -> DataFrame:
    """Hits by ``rerank_score``, best first, ties in their former order."""
    rows = hits.withColumn("_was", F.col(order)).withColumn("score", rerank_score(F.col("score"), F.lit(query), F.col(content)))
    return rows.orderBy(F.desc("score"), F.desc("_was")).limit(limit).drop("_was")


def rerank_each(hits: DataFrame, queries: DataFrame, limit: int, content: str = "content", id_col: str = "id", block: int = QUERIES) -> DataFrame:
    """``query_id, id, score, rank`` of the best of all hits (``id, score, content``) for each of a table of
    queries (``query_id, query``), by ``rerank_score``. Queries go to the tasks in blocks, as in
    ``top_k_each``; a hit's words are read once for all queries of a block. Scores are rounded to nine
    decimals."""
    named = queries.select(F.col("query_id").cast("long").alias("query_id"), "query").where("query is not null")
    blocks = max(1, -(-named.count() // block))
    rows = hits.select(F.col(id_col).cast("long").alias("id"), F.col("score").cast("double").alias("score"), F.coalesce(F.col(content), F.lit("")).alias("text")).where("id is not null")

    def against(number: np.ndarray, texts: list[str]):
        terms = [set(t.lower().split()) for t in texts]
        code: dict[str, int] = {}
        for t in terms:
            for word in sorted(t):
                code.setdefault(word, len(code))
        size = np.array([max(1, len(t)) for t in terms], np.float64)
        owner = np.array([k for k, t in enumerate(terms) for _ in t], np.int64)
        word_of = np.array([code[w] for t in terms for w in t], np.int64)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    has = np.zeros((part.num_rows, len(code) or 1), bool)
                    length = np.zeros(part.num_rows)
                    for r, text in enumerate(part.column("text").to_pylist()):
                        found = text.lower().split()
                        length[r] = max(1, len(found))
                        has[r, [code[w] for w in set(found) if w in code]] = True
                    common = np.zeros((len(texts), part.num_rows))
                    np.add.at(common, owner, has.T[word_of].astype(np.float64))
                    scores = part.column("score").to_numpy()[None, :] * 0.7 + common / size[:, None] * 0.2 + np.minimum(1.0, 200.0 / length)[None, :] * 0.1
                    best = _merged(best, _best_of(np.round(scores, 9), part.column("id").to_numpy(), limit, -np.inf), limit)
            yield pa.RecordBatch.from_arrays([pa.array(number[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "id", "score"])

        return work

    out = rows.where("false").select(F.lit(0).cast("long").alias("query_id"), "id", "score")
    for k in range(blocks):
        held = (named.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) if blocks > 1 else named).collect()
        if held:
            found = rows.mapInArrow(against(np.array([r[0] for r in held], np.int64), [r[1] for r in held]), "query_id long, id long, score double")
            out = out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= limit)


def context(hits: DataFrame, by: list[str], rank: str = "rank", content: str = "content", limit: int | None = None) -> DataFrame:
    """``context`` for each query: the hits' texts by rank under numbered headings; with ``limit`` the
    first ones, chosen before any are gathered."""
    if limit is not None:
        hits = hits.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(rank))).where(F.col("_k") <= limit)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(content).alias("c")))), lambda x, i: F.concat(F.lit("DOCUMENT "), (i + 1).cast("string"), F.lit(":\n"), x["c"]))
    return hits.groupBy(*by).agg(F.coalesce(F.nullif(F.array_join(parts, "\n\n"), F.lit("")), F.lit(NO_CONTEXT)).alias("context"))


def source_context(hits: DataFrame, by: list[str], limit: int = 3, threshold: float = 0.6, content: str = "content", source: str = "source_url") -> DataFrame:
    """``context`` for each query: the best hits with their sources; those under the threshold are left out."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), source, content))
    best = hits.where(F.col("score") >= threshold).withColumn("_k", rank).where(F.col("_k") <= limit)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col(source).alias("s"), F.col(content).alias("c")))), lambda x: F.concat(F.lit("Source: "), F.coalesce(x["s"], F.lit("")), F.lit("\nContent: "), x["c"]))
    return best.groupBy(*by).agg(F.array_join(parts, "\n\n").alias("context"))


def probe(points: DataFrame, probes: DataFrame, limit: int = 10, each: int = 5, threshold: float = 0.0, **options) -> DataFrame:
    """A preview by several probe vectors: each point that is among the ``each`` best of some probe once,
    by its best score, the ``limit`` best of them."""
    found = top_k_each(points, probes, each, threshold, **options)
    return found.groupBy("id").agg(F.max("score").alias("score"), F.min_by("query_id", F.struct(-F.col("score"), "query_id")).alias("query_id")).orderBy(F.desc("score"), "id").limit(limit)


def history(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Adds ``history`` to each message: those before it as ``ROLE: text`` lines."""
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    lines = F.array_join(F.collect_list(F.concat(F.upper(F.col(role)), F.lit(": "), F.col(text))).over(before), "\n")
    return messages.withColumn("history", F.when(lines == "", F.lit("")).otherwise(F.concat(F.lit("PREVIOUS CONVERSATION:\n"), lines)))
