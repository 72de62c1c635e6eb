"""Embeddings: sparse term weights in SQL, count vectors, pluggable models behind a cache keyed by text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers "
    "him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those "
    "through to too under until up very was we were what when where which while who whom why will with would you your"
).split()

Model = Callable[[list[str]], np.ndarray]
MODELS: dict[str, Model] = {}


def register(name: str, model: Model) -> None:
    """Names a function from texts to rows of a matrix, for ``embed``."""
    MODELS[name] = model


def hashed(dims: int = 64) -> Model:
    """A model that needs no files: counts of words by hash, of length one."""
    import zlib

    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for r, text in enumerate(texts):
            for word in text.lower().split():
                out[r, zlib.crc32(word.encode()) % dims] += 1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)

    return model


register("hashed", hashed())


def model_of(*names: str) -> Model:
    """The first of the named models that is registered and answers; a chain to fall back along."""
    problems = []
    for name in names:
        try:
            MODELS[name](["probe"])
            return MODELS[name]
        except Exception as problem:  # whatever keeps a model from answering, the next one is asked
            problems.append(f"{name}: {type(problem).__name__}: {problem}")
    raise ValueError("no model answers: " + "; ".join(problems))


def _term_sums(pattern: str, stop_words: tuple[str, ...]):
    """``term, total, df`` of a task's texts, summed as far as memory allows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, stop = re.compile(pattern).findall, frozenset(stop_words)
        total: Counter[str] = Counter()
        df: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            terms = [t for t in total if t not in stop]
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([total[t] for t in terms], pa.int64()), pa.array([df[t] for t in terms], pa.int64())], ["term", "total", "df"])

        for batch in batches:
            for text in batch.column("text"):
                counts = Counter(find((text.as_py() or "").lower()))
                total.update(counts)
                df.update(counts.keys())
                if len(total) > 1_000_000:
                    yield out()
                    total.clear()
                    df.clear()
        yield out()

    return work


def _weighted(find: Callable[[str], list[str]], weights: dict[str, float]):
    """``id, term, weight`` of each text's terms that have a weight; rows of length one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms, found = [], [], []
            for r, text in enumerate(batch.column("text")):
                counts = Counter(find((text.as_py() or "").lower()))
                held = [(t, n * weights[t]) for t, n in counts.items() if t in weights]
                length = math.sqrt(sum(w * w for _, w in held))
                for t, w in held:
                    rows.append(r)
                    terms.append(t)
                    found.append(w / length)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(terms, pa.string()), pa.array(found, pa.float64())], ["id", "term", "weight"])

    return work


def tf_idf(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_features: int = 1024) -> DataFrame:
    """``id, term, weight``: smoothed TF-IDF over the terms of most occurrences in the corpus, rows of
    length one. Every document is a row, so its weights are made where it lies: what is shuffled is each
    task's sums by term, and the driver gets the ``max_features`` terms of the vocabulary."""
    pattern = r"[0-9A-Za-z_]{2,}"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    sums = rows.select("text").mapInArrow(_term_sums(pattern, tuple(STOP_WORDS)), "term string, total long, df long")
    terms = sums.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df")).orderBy(F.desc("total"), "term").limit(max_features).collect()
    n = docs.count()
    idf = {r["term"]: math.log((1 + n) / (1 + r["df"])) + 1 for r in terms}
    return rows.mapInArrow(_weighted(re.compile(pattern).findall, idf), f"id {rows.schema['id'].dataType.simpleString()}, term string, weight double")


def _first_words(size: int):
    """``term, id, place`` of the first ``size`` different words of a task's texts by id and place: no
    other word of the task can be among the corpus's first ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple] = {}
        last = None
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                if last is not None and key is not None and key > last:
                    continue
                for place, word in enumerate((text.as_py() or "").lower().split()):
                    at = (key is not None, key, place)
                    if word not in seen or at < seen[word]:
                        seen[word] = at
                if len(seen) > 2 * size:
                    seen = dict(sorted(seen.items(), key=lambda x: x[1])[:size])
                    last = max(seen.values())[1]
        terms = sorted(seen.items(), key=lambda x: x[1])[:size]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in terms], pa.string()), pa.array([x[1] for _, x in terms], pa.int64()), pa.array([x[2] for _, x in terms], pa.int64())], ["term", "id", "place"])

    return work


def count_vectors(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 512) -> DataFrame:
    """``id, term, weight``: counts over the first ``size`` different words of the corpus in reading
    order (by id, nulls first), rows of length one; documents without any have no rows. What is shuffled
    is ``size`` words a task, and the driver gets ``size`` words."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    first = rows.mapInArrow(_first_words(size), "term string, id long, place long").groupBy("term").agg(F.min(F.struct("id", "place")).alias("seen"))
    vocabulary = {r["term"]: 1.0 for r in first.orderBy("seen").limit(size).collect()}
    return rows.mapInArrow(_weighted(str.split, vocabulary), "id long, term string, weight double")


def text_of(content: Column, text: Column) -> Column:
    """What of a chunk is embedded."""
    return F.coalesce(F.nullif(content, F.lit("")), text, F.lit(""))


def embed(rows: DataFrame, model: str | Model = "hashed", text: str = "text", normalize: bool = True) -> DataFrame:
    """Adds ``embedding``; the model is called on whole Arrow batches."""
    call = MODELS[model] if isinstance(model, str) else model
    names = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.asarray(call([x or "" for x in batch.column(names.index(text)).to_pylist()]), np.float32)
            if normalize:
                size = np.linalg.norm(found, axis=1, keepdims=True)
                found = found / np.where(size > 0, size, 1)
            offsets = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1), pa.float32()))], names=[*names, "embedding"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, f"{kept}, embedding array<float>")


def missing(rows: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``text_hash, text``: each different text that a cache ``model, text_hash, embedding`` lacks."""
    keyed = rows.select(F.sha2(F.col(text), 256).alias("text_hash"), F.col(text).alias("text")).where("text_hash is not null").dropDuplicates(["text_hash"])
    return keyed.join(cache.where(F.col("model") == model).select("text_hash"), "text_hash", "left_anti")


def embed_cached(rows: DataFrame, cache: DataFrame, model: str = "hashed", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows with ``embedding``, and the cache with what it lacked."""
    new = embed(missing(rows, cache, model, text), model).select(F.lit(model).alias("model"), "text_hash", "embedding")
    filled = cache.select("model", "text_hash", "embedding").unionByName(new)
    found = filled.where(F.col("model") == model).select(F.col("text_hash").alias("_h"), "embedding")
    return rows.join(found, F.sha2(F.col(text), 256) == F.col("_h"), "left").drop("_h"), filled


def needs_embedding(rows: DataFrame) -> DataFrame:
    """One row: whether all rows say that they have an embedding and none holds one."""
    return rows.agg((F.coalesce(F.every("has_embedding"), F.lit(False)) & (F.count("embedding") == 0)).alias("needs_embedding"))


def unit(rows: DataFrame, column: str = "embedding") -> DataFrame:
    return rows.withColumn(column, V.normalize(F.col(column)))
