"""Keyed tables: upsert, delete, eviction, and the lookups of caches and limits."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .search import condition


@dataclass
class Collection:
    """A stored table of points: a folder with a table for each version, and a pointer to the last whole
    one. ``create`` settles the vectors' dimension and distance; rows of another dimension raise."""

    path: str
    dimension: int
    distance: str = "cosine"
    key: str = "id"
    vector: str = "embedding"
    version: str | None = None
    previous: str | None = None

    @classmethod
    def create(cls, spark: SparkSession, path: str, dimension: int, distance: str = "cosine", **names: str) -> Collection:
        """Opens a collection, made if it isn't there. One that is there with another dimension or
        distance raises."""
        if dimension < 1 or distance not in ("cosine", "dot", "euclid"):
            raise ValueError("the dimension must be positive, the distance cosine, dot or euclid")
        asked = cls(path, dimension, distance, **names)
        try:
            held = cls.load(spark, path)
        except FileNotFoundError:
            asked._point(spark)
            return asked
        if (held.dimension, held.distance) != (dimension, distance):
            raise ValueError(f"the collection has dimension {held.dimension} and distance {held.distance}")
        return held

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Collection:
        fs, at = cls._place(spark, f"{path}/collection.json")
        if not fs.exists(at):
            raise FileNotFoundError(path)
        stream = fs.open(at)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return cls(**json.loads(text) | {"path": path})

    @staticmethod
    def _place(spark: SparkSession, path: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()), at

    def _point(self, spark: SparkSession) -> None:
        """Writes the pointer beside the old one and puts it in its place."""
        fs, at = self._place(spark, f"{self.path}/collection.json")
        _, new = self._place(spark, f"{self.path}/collection-{uuid.uuid4().hex}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(asdict(self)).encode()))
        out.close()
        if fs.exists(at):
            fs.delete(at, False)
        if not fs.rename(new, at):
            raise OSError(f"the pointer can't be written: {self.path}")

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The points of the last version; None while there is none."""
        return spark.read.parquet(f"{self.path}/{self.version}") if self.version else None

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Puts rows in as a new version, in place of those of equal key, and returns how many points there
        are then. Readers see the old version until the new one is whole, and may go on with it; the one before
        that is deleted."""
        spark = rows.sparkSession
        wrong = rows.where(F.col(self.vector).isNotNull() & (F.size(self.vector) != self.dimension)).select(self.key).head()
        if wrong:
            raise ValueError(f"a vector isn't of dimension {self.dimension}: {wrong[0]}")
        old = self.read(spark)
        if old is None:
            old = rows.where("false")
        name = f"version-{uuid.uuid4().hex}"
        upsert(old, rows, self.key, order).write.parquet(f"{self.path}/{name}")
        gone, self.previous, self.version = self.previous, self.version, name
        self._point(spark)
        if gone:
            fs, at = self._place(spark, f"{self.path}/{gone}")
            fs.delete(at, True)
        return self.read(spark).count()


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """The old rows whose keys the new ones lack, and of each new key the last row by ``order``."""
    rank = Window.partitionBy(key).orderBy(F.desc(order)) if order else Window.partitionBy(key).orderBy(F.lit(0))
    last = new.withColumn("_k", F.row_number().over(rank)).where("_k = 1").drop("_k")
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(last.select(*old.columns))


def delete_keys(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti").select(*rows.columns)


def delete_where(rows: DataFrame, spec: dict) -> DataFrame:
    """The rows that a filter doesn't match."""
    return rows.where(~condition(spec)) if spec else rows


def count(rows: DataFrame, spec: dict | None = None) -> DataFrame:
    return (rows.where(condition(spec)) if spec else rows).agg(F.count("*").alias("n"))


def evict_count(rows: DataFrame, most: int, ts: str = "ts", key: str = "key", by: str | None = None) -> DataFrame:
    """The ``most`` newest rows, of each group of ``by`` if it is given."""
    if by is None:
        return rows.orderBy(F.desc(ts), F.desc(key)).limit(most)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(ts), F.desc(key)))
    return rows.withColumn("_k", rank).where(F.col("_k") <= most).drop("_k")


def evict_bytes(rows: DataFrame, most: float, size: str = "size", ts: str = "ts", key: str = "key", by: str = "part") -> DataFrame:
    """Of each group, the rows left when the oldest go until the sum of sizes is ``most`` or less."""
    group = Window.partitionBy(by)
    before = group.orderBy(ts, key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_excess": F.sum(size).over(group) - most, "_gone": F.coalesce(F.sum(size).over(before), F.lit(0))})
    return rows.where((F.col("_excess") <= 0) | (F.col("_gone") >= F.col("_excess"))).drop("_excess", "_gone")


def cache_hits(requests: DataFrame, ttl: float, key: str = "key", ts: str = "ts", written: str = "is_write", own_ttl: str | None = None) -> DataFrame:
    """Adds ``hit``: whether the last write of a key before a row is at most ``ttl`` seconds old, or as
    many as the column ``own_ttl`` says of that write, where it isn't null."""
    before = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.col(own_ttl).cast("double"), F.lit(float(ttl))) if own_ttl else F.lit(float(ttl))
    last = F.last(F.when(F.col(written), F.struct(F.col(ts).cast("timestamp").alias("t"), held.alias("ttl"))), True).over(before)
    age = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(last["t"])) / 1e6
    return requests.withColumn("hit", F.coalesce(age <= last["ttl"], F.lit(False)))


def first_match(rows: DataFrame, patterns: list[tuple[str, float]], column: str, default: float, to: str = "ttl") -> DataFrame:
    """Adds the value of the first pattern that is found in a column."""
    value = F.lit(float(default))
    for pattern, v in reversed(patterns):
        value = F.when(F.col(column).rlike(pattern), F.lit(float(v))).otherwise(value)
    return rows.withColumn(to, value)


def domain_limit(rows: DataFrame, limits: dict[str, float], default: float, column: str = "domain", to: str = "limit") -> DataFrame:
    """Adds a domain's limit: its own, else that of the first ``*.suffix``, else the default."""
    value = F.lit(float(default))
    for name, v in reversed([x for x in limits.items() if x[0].startswith("*.")]):
        value = F.when(F.endswith(F.col(column), F.lit(name[1:])), F.lit(float(v))).otherwise(value)
    for name, v in limits.items():
        if not name.startswith("*."):
            value = F.when(F.col(column) == name, F.lit(float(v))).otherwise(value)
    return rows.withColumn(to, value)


def invalidate(rows: DataFrame, older_than=None, pattern: str | None = None, ts: str = "ts", key: str = "key") -> DataFrame:
    """Drops the rows older than a time, if one is given, whose key matches, if a pattern is given."""
    gone = F.lit(True)
    if older_than is not None:
        gone = gone & (F.col(ts) < F.lit(older_than))
    if pattern is not None:
        gone = gone & F.col(key).rlike(pattern)
    return rows.where(~F.coalesce(gone, F.lit(False)))
