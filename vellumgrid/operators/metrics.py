"""Counters, histograms and alert rules as windowed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the duration histogram, in seconds.
BUCKETS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0]


def histogram(rows: DataFrame, label: str, value: str, buckets: list[float] = BUCKETS) -> DataFrame:
    """Cumulative counts at each bound, the count and the sum of each label."""
    return rows.groupBy(label).agg(
        F.count(value).alias("n"), F.round(F.sum(value), 4).alias("total"), *[F.sum((F.col(value) <= b).cast("long")).alias("le_" + str(b).replace(".", "_")) for b in buckets]
    )


def quantile(q: float, counts: Column, n: Column, bounds: list[float]) -> Column:
    """A quantile read off cumulative counts at ``bounds``: linear within its bucket,
    from 0 in the first, the last bound beyond it. The error is under a bucket."""
    edges = F.array(*[F.lit(float(b)) for b in bounds])
    rank = n * q
    at = F.size(F.filter(counts, lambda c: c < rank))  # buckets wholly below
    low, below = F.coalesce(F.get(edges, at - 1), F.lit(0.0)), F.coalesce(F.get(counts, at - 1), F.lit(0))
    inner = low + (F.get(edges, at) - low) * (rank - below) / (F.get(counts, at) - below)
    return F.when(at >= len(bounds), float(bounds[-1])).otherwise(inner)


def windows(rows: DataFrame, width: str, seconds: int, bounds: list[float] = BUCKETS) -> DataFrame:
    """Per time window (of ts): requests, errors, their rates and ratio, and the
    95th percentile of value from its histogram, so a window is a few counts."""
    w = rows.groupBy(F.window("ts", width).alias("w")).agg(
        F.count("*").alias("n"), F.sum((F.col("event_type") == "error").cast("long")).alias("errors"), F.count("value").alias("n_values"),
        F.array(*[F.sum((F.col("value") <= float(b)).cast("long")) for b in bounds]).alias("counts"),
    )
    return w.select(
        F.col("w.start").alias("start"), "n", "errors", F.round(F.col("n") / seconds, 6).alias("rate"), F.round(F.col("errors") / seconds, 6).alias("error_rate"),
        F.round(F.col("errors") / F.col("n"), 6).alias("error_ratio"), F.round(quantile(0.95, F.col("counts"), F.col("n_values"), bounds), 6).alias("p95"),
    )


def alerts(per_window: DataFrame, rules: dict[str, tuple[str, float]], hold: int = 1, minutes: int = 5) -> DataFrame:
    """alert and start for each window where a rule's column stayed above its
    bound for ``hold`` adjacent windows of ``minutes``; a missing window ends a run.
    Adjacency is an equi-join on time, so no task sees all of it."""
    stack = F.explode(F.array(*[F.struct(F.lit(name).alias("alert"), (F.col(c) > bound).alias("on")) for name, (c, bound) in rules.items()]))
    on = per_window.select("start", stack.alias("r")).select("r.alert", "start", "r.on").filter("on").select("alert", "start")
    held = on
    for k in range(1, hold):
        held = held.join(on.select("alert", (F.col("start") + F.expr(f"interval {k * minutes} minutes")).alias("start")), ["alert", "start"], "left_semi")
    return held


def index_advice(usage: DataFrame, scans: int = 100, rows: int = 1000) -> DataFrame:
    """table_name and advice for tables that are often read whole, though large, of
    (table_name, seq_scan, seq_tup_read); most read first when ordered by seq_scan."""
    mean = F.col("seq_tup_read").cast("long") - F.pmod(F.col("seq_tup_read").cast("long"), F.col("seq_scan"))
    mean = (mean / F.col("seq_scan")).cast("long")
    said = F.concat(F.lit("Table "), "table_name", F.lit(" has "), F.col("seq_scan").cast("string"), F.lit(" sequential scans, averaging "), mean.cast("string"), F.lit(" rows; partition or sort it by its filtered columns"))
    return usage.filter(F.col("seq_scan") > scans).filter(mean > rows).select("table_name", "seq_scan", said.alias("advice"))


def silent(per_window: DataFrame, minutes: int) -> DataFrame:
    """Starts of windows without any event between the first and the last."""
    ends = per_window.agg(F.min("start").alias("a"), F.max("start").alias("b"))
    every = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {minutes} minutes"))).alias("start"))
    return every.join(per_window.select("start"), "start", "left_anti")
