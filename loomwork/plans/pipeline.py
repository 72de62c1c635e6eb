"""Pipelines: pages to documents, chunks, embeddings and a store; and lists of declared steps."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls
from ..functions.safety import check_chunking, is_format
from ..operators import chunking, embedding, html, search, sitemaps, store
from ..sources import files, web


@dataclass(frozen=True)
class Config:
    """Settings; later sources win over earlier ones."""

    chunk_size: int = 1000
    chunk_overlap: int = 200
    strategy: str = "semantic"
    model: str = "hashed"
    metric: str = "cosine"
    limit: int = 5
    threshold: float = 0.7
    flags: dict[str, float] = field(default_factory=dict)

    @classmethod
    def load(cls, *paths: str) -> Config:
        """From JSON or ``.env`` files, and all those of a folder in alphabetical order."""
        config = cls()
        for path in paths:
            for name in sorted(os.path.join(path, f) for f in os.listdir(path)) if os.path.isdir(path) else [path]:
                with open(name) as file:
                    if name.endswith(".json"):
                        found = json.load(file)
                    else:
                        pairs = (line.strip().split("=", 1) for line in file if "=" in line and not line.startswith("#"))
                        found = {k.strip().lower(): v.strip().strip("\"'") for k, v in pairs}
                kinds = {f: type(getattr(config, f)) for f in asdict(config)}
                config = replace(config, **{k: kinds[k](v) for k, v in found.items() if k in kinds})
        return config

    def save(self, path: str) -> None:
        with open(path, "w") as file:
            json.dump(asdict(self), file, indent=2)

    def enabled(self, feature: str, user: str | None = None, salt: str = "loomwork") -> bool:
        """Whether a feature is on, for a user if it is on for a part of them (percent)."""
        share = float(self.flags.get(feature, 0))
        if user is None or share >= 100:
            return share >= 100
        return int(hashlib.sha256(f"{salt}:{user}:{feature}".encode()).hexdigest(), 16) % 10_000 / 100 < share


def extract(pages: DataFrame, kind: str = "markdown", limit: int | None = None, ordinal: str = "page_id") -> DataFrame:
    """``url, content, title, format, markdown`` of the pages whose URL is valid, the first ``limit``."""
    rows = pages.where(urls.is_valid(F.col("url")))
    rows = rows.orderBy(ordinal).limit(limit) if limit is not None else rows
    docs = html.convert_to(rows, kind, keep=("url",))
    return docs.select("url", "content", T.title(F.col("markdown"), F.col("url")).alias("title"), F.lit(kind).alias("format"), "markdown")


def chunk(docs: DataFrame, config: Config, text: str = "markdown") -> DataFrame:
    """``id, chunk, source_url, chunk_type`` by the strategy; documents without text have none."""
    check_chunking(config.chunk_size, config.chunk_overlap)
    rows = docs.where(F.length(text) > 0).select("url", F.col(text).alias("content"))
    if config.strategy == "semantic":
        found = chunking.chunk(rows, "content", "url", config.chunk_size, config.chunk_overlap)
    else:
        cut = {"sliding_window": chunking.sliding, "recursive": chunking.recursive}[config.strategy]
        found = cut(rows, "content", config.chunk_size, config.chunk_overlap)
        found = found.select("url", F.concat("url", F.lit("_"), F.col("position").cast("string")).alias("id"), "chunk", F.lit(config.strategy).alias("chunk_type"))
    return found.select("id", "chunk", F.col("url").alias("source_url"), "chunk_type")


def pages_of(spark: SparkSession, urls_in: list[str] | None = None, link_file: str | None = None, site: str | None = None, site_files: DataFrame | None = None, limit: int | None = None, **options) -> DataFrame:
    """``page_id, url, html`` of pages that are fetched: a list of URLs, those of a link file, or those that
    a site's sitemaps list (``site_files`` as in ``sitemaps.discover``); with ``limit`` the first ones."""
    if urls_in is not None:
        rows = spark.createDataFrame(list(enumerate(urls_in)), "ordinal long, url string")
    elif link_file is not None:
        rows = files.link_files(spark, link_file)
    elif site is not None and site_files is not None:
        found = sitemaps.discover(spark.createDataFrame([(site,)], "site string"), site_files)
        rows = found.select(F.xxhash64("loc").alias("ordinal"), F.col("loc").alias("url"))
    else:
        raise ValueError("give URLs, a link file or a site with its files")
    rows = rows.where(urls.is_valid(F.col("url")))
    rows = rows.orderBy("ordinal", "url").limit(limit) if limit is not None else rows
    return web.fetch_table(rows, **options).where("success").select(F.col("ordinal").alias("page_id"), "url", F.col("content").alias("html"))


def run(spark: SparkSession, pages: DataFrame, folder: str, config: Config | None = None, steps: tuple[str, ...] = ("extract", "chunk", "embed", "store")) -> dict:
    """Runs the steps; each is written to the folder as a table, from which a later step goes on that
    runs alone. ``store`` puts its chunks into the folder's collection, in place of those of equal id, and
    keeps what earlier runs have put there. Stops at a step that gives nothing. Returns success, and rows
    and seconds by step."""
    config = config or Config()
    made: dict[str, Callable[[], DataFrame]] = {
        "extract": lambda: extract(pages),
        "chunk": lambda: chunk(spark.read.parquet(f"{folder}/extract"), config),
        "embed": lambda: embedding.embed(spark.read.parquet(f"{folder}/chunk"), config.model, "chunk"),
    }
    counts: dict[str, int] = {}
    took: dict[str, float] = {}
    for step in steps:
        began = time.perf_counter()
        if step == "store":
            rows = spark.read.parquet(f"{folder}/embed")
            dimension = len(embedding.MODELS[config.model](["probe"])[0])
            counts[step] = store.Collection.create(spark, f"{folder}/store", dimension, config.metric).upsert(rows, "chunk")
        else:
            made[step]().write.mode("overwrite").parquet(f"{folder}/{step}")
            counts[step] = spark.read.parquet(f"{folder}/{step}").count()
        took[step] = time.perf_counter() - began
        if not counts[step]:
            break
    return {"success": all(counts.get(s) for s in steps), "steps": {s: bool(counts.get(s)) for s in steps}, "document_counts": counts, "seconds": took}


def semantic_search(points: DataFrame, queries: DataFrame, config: Config | None = None, text: str = "chunk") -> DataFrame:
    """``query_id, rank, id, score, content, source_url`` for a table ``query_id, query``: the queries are
    embedded, twice as many hits as asked for are fetched by vector, and reranked by their texts."""
    config = config or Config()
    asked = embedding.embed(queries.select("query_id", "query"), config.model, "query").withColumnRenamed("embedding", "_q")
    hits = search.top_k_each(points, asked, 2 * config.limit, config.threshold, config.metric, id_col="id", query_vector="_q")
    found = hits.drop("rank").join(points.select(F.col("id"), F.col(text).alias("content"), "source_url"), "id").join(queries.select("query_id", "query"), "query_id")
    score = F.round(search.rerank_score(F.col("score"), F.col("query"), F.col("content")), 9)
    found = found.withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= config.limit).select("query_id", "rank", "id", "score", "content", "source_url")


def answer_context(store_rows: DataFrame, query: str, config: Config | None = None) -> DataFrame:
    """One row: the prompt's context for a question, from the best chunks after reranking."""
    config = config or Config()
    vector = embedding.MODELS[config.model]([query])[0].tolist()
    hits = search.top_k(store_rows, vector, 2 * config.limit, config.threshold, metric=config.metric, id_col="id")
    hits = search.rerank(hits.withColumnRenamed("chunk", "content"), query, config.limit)
    return search.context(hits.withColumn("q", F.lit(query)).withColumn("rank", -F.col("score")), ["q"]).withColumnRenamed("q", "query")


def query_key(query: Column, config: Config, where: str = "") -> Column:
    """A search's key in a cache: every setting that its result depends on, and the text."""
    settings = [config.model, config.metric, str(config.limit), str(config.threshold), where]
    return F.sha2(F.concat_ws("\x1f", query, *map(F.lit, settings)), 256)


def search_cached(points: DataFrame, queries: DataFrame, cache: DataFrame, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """``semantic_search`` behind a cache ``key, rank, id, score, content, source_url``; returns the results
    and the cache with what it lacked. Queries without hits are not cached."""
    config = config or Config()
    keyed = queries.select("query_id", "query", query_key(F.col("query"), config).alias("key"))
    lacking = keyed.join(cache.select("key").distinct(), "key", "left_anti").dropDuplicates(["key"])
    new = semantic_search(points, lacking, config).join(lacking.select("query_id", "key"), "query_id").drop("query_id")
    filled = cache.unionByName(new.select(*cache.columns))
    return keyed.select("query_id", "key").join(filled, "key").drop("key"), filled


def execute(steps: list[dict], tables: dict[str, DataFrame], continue_on_error: bool = False) -> Iterator[dict]:
    """Runs declared steps ``{name, type, config}`` over named tables: ``scrape`` (pages to documents),
    ``chunk``, ``embed``, ``index`` (upsert), ``search``, ``filter_urls``. A step's result is the table
    of its name; a step reads ``config["input"]``. Yields what became of each."""

    def one(kind: str, c: dict) -> DataFrame:
        rows = tables[c["input"]]
        if kind == "scrape":
            return extract(rows, c.get("format", "markdown"), c.get("limit"))
        if kind == "chunk":
            return chunk(rows, Config(**{k: v for k, v in c.items() if k != "input"}))
        if kind == "embed":
            return embedding.embed(rows, c.get("model", "hashed"), c.get("text", "chunk"))
        if kind == "index":
            return store.upsert(tables[c["into"]], rows, c.get("key", "id"), c.get("order"))
        if kind == "search":
            vector = embedding.MODELS[c.get("model", "hashed")]([c["query"]])[0].tolist()
            return search.top_k(rows, vector, c.get("top_k", 5), c.get("threshold", 0.7), c.get("filter"), id_col=c.get("key", "id"))
        if kind == "filter_urls":
            return sitemaps.filter_urls(rows, c.get("min_priority"), tuple(c.get("include", ())), tuple(c.get("exclude", ())), c.get("limit"))
        raise ValueError(f"unknown step type: {kind}")

    for step in steps:
        about = {"step_name": step["name"], "step_type": step["type"]}
        try:
            tables[step["name"]] = result = one(step["type"], step.get("config", {}))
            yield about | {"status": "success", "result": result}
        except (ValueError, KeyError, TypeError) as error:
            yield about | {"status": "error", "error": str(error)}
            if not continue_on_error:
                return


__all__ = ["Config", "answer_context", "chunk", "execute", "extract", "is_format", "pages_of", "query_key", "run", "search_cached", "semantic_search"]
