"""Statistics of requests: per domain, rolling, error runs, backoff, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def domain_stats(requests: DataFrame, key: str = "domain", ts: str = "ts", tie: str = "id", ok: str = "ok", seconds: str = "seconds", status: str = "status", last: int = 100) -> DataFrame:
    """Requests, successes, errors and success rate of each domain, the mean time of its last requests
    and of all, and how often each status came."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie)))
    main = requests.withColumn("_k", newest).groupBy(key).agg(
        F.count("*").alias("requests"), F.count_if(F.col(ok)).alias("successes"), F.count_if(~F.col(ok)).alias("errors"),
        F.avg(F.when(F.col("_k") <= last, F.col(seconds))).alias("recent_seconds"), F.avg(seconds).alias("mean_seconds"),
    )
    by_status = requests.groupBy(key, status).agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(status, "n")))).alias("statuses"))
    return main.withColumn("success_rate", F.col("successes") / F.col("requests")).join(by_status, key)


def cache_stats(requests: DataFrame, hit: str = "hit", key: str = "key", top: int = 5) -> tuple[DataFrame, DataFrame]:
    """One row of hits, misses and hit rate (0 without requests), and the keys of most requests."""
    total = requests.agg(F.count_if(F.col(hit)).alias("hits"), F.count_if(~F.col(hit)).alias("misses"))
    total = total.withColumn("hit_rate", F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)))
    return total, requests.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(top)


def rate_limit(calls: DataFrame, most: int, period: float, key: str = "key", ts: str = "ts") -> DataFrame:
    """Adds ``in_window``, the calls of the last ``period`` seconds, ``allowed``, and ``wait``, the
    seconds until the window's first call leaves it, for those that aren't."""
    micros = int(period * 1e6)
    window = Window.partitionBy(key).orderBy("_t").rangeBetween(-micros, 0)
    rows = calls.withColumn("_t", _seconds(ts))
    rows = rows.withColumns({"in_window": F.count("*").over(window), "_first": F.min("_t").over(window)})
    rows = rows.withColumn("allowed", F.col("in_window") <= most)
    return rows.withColumn("wait", F.when(F.col("allowed"), F.lit(0.0)).otherwise((F.lit(micros) - (F.col("_t") - F.col("_first"))) / 1e6)).drop("_t", "_first")


def rolling_mean(rows: DataFrame, value: str, key: str = "key", order: tuple[str, ...] = ("ts", "id"), last: int = 100) -> DataFrame:
    return rows.withColumn("rolling", F.avg(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(1 - last, 0)))


def error_runs(rows: DataFrame, ok: str = "ok", key: str = "key", order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """Adds ``errors_in_row``: errors up to here since the last success."""
    running = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("_run", F.sum(F.col(ok).cast("int")).over(running.rowsBetween(Window.unboundedPreceding, 0)))
    so_far = F.sum((~F.col(ok)).cast("int")).over(Window.partitionBy(key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("errors_in_row", so_far).drop("_run")


def backoff(n: Column, delay: float = 2.0, jitter: float = 0.0, parallel: bool = False) -> Column:
    """Seconds to wait after n errors in a row."""
    if parallel:
        return F.when(n >= 3, F.least(F.lit(60.0), F.pow(F.lit(2.0), n - 2))).otherwise(F.lit(0.0))
    return F.when(n > 1, F.least(F.lit(60.0), F.lit(delay) * F.pow(F.lit(2.0), n - 1)) * (1 + jitter)).otherwise(F.lit(0.0))


def adapted_rate(limit: Column, mean: Column, errors: Column) -> Column:
    """A rate limit after one adjustment; changes of a fifth or less aren't made."""
    new = F.when(mean > 2, F.greatest(F.lit(0.1), limit * 0.8)).when((mean < 0.5) & (errors < 0.05), F.least(F.lit(10.0), limit * 1.2)).otherwise(limit)
    new = F.when(errors > 0.1, F.greatest(F.lit(0.1), limit * 0.5)).otherwise(new)
    return F.when(F.round(F.abs(new - limit) / limit, 9) > 0.2, new).otherwise(limit)


def tiered_rate(limit: Column, requests: Column, errors: Column) -> Column:
    share = errors / requests
    return F.when((requests > 10) & (share > 0.2), limit * 0.5).when((requests > 10) & (share > 0.1), limit * 0.75).otherwise(limit)


def gaps(rows: DataFrame, rate: float, key: str = "key", ts: str = "ts", tie: str = "id") -> DataFrame:
    """Adds ``gap`` to the request before, and ``pause`` that a rate of requests a second asks for."""
    t = _seconds(ts)
    gap = (t - F.lag(t).over(Window.partitionBy(key).orderBy(ts, tie))) / 1e6
    return rows.withColumn("gap", gap).withColumn("pause", F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0 / rate) - F.col("gap")), F.lit(0.0)))
