"""Measurements: recorded on the driver, or summarised from a table of them."""

from __future__ import annotations

import time
from collections import defaultdict
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile(values: Column, p: float) -> Column:
    """Of an array: the element at the whole part of n·p/100 when sorted, not interpolated."""
    ordered = F.sort_array(values)
    at = F.least(F.floor(F.size(ordered) * p / 100).cast("int"), F.size(ordered) - 1) + 1
    return F.when(F.size(ordered) > 0, F.element_at(ordered, F.greatest(at, F.lit(1))))


def summary(rows: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """(<name>, n, total, average, median, minimum, maximum, p95) of each measurement; nulls are left out."""
    good = rows.where(F.col(value).isNotNull())
    out = good.groupBy(name).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("average"), F.median(value).alias("median"),
        F.min(value).alias("minimum"), F.max(value).alias("maximum"),
    )
    # the value at the place of the percentile, by cumulative counts of distinct values
    each = good.groupBy(F.col(name).alias("__name"), F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__times"))
    each = each.withColumn("__up_to", F.sum("__times").over(Window.partitionBy("__name").orderBy("__value")))
    at = F.least(F.floor(F.col("n") * 95 / 100), F.col("n") - 1)
    spot = out.select(name, at.alias("__at")).join(each, F.col(name).eqNullSafe(F.col("__name")) & (F.col("__up_to") > F.col("__at")))
    spot = spot.groupBy(F.col(name).alias("__spot")).agg(F.min("__value").alias("p95"))
    return out.join(spot, F.col(name).eqNullSafe(F.col("__spot"))).drop("__spot")


class Metrics:
    def __init__(self) -> None:
        self.values: dict[str, list[float]] = defaultdict(list)
        self.counters: dict[str, int] = defaultdict(int)
        self.gauges: dict[str, float] = {}

    def record(self, name: str, value: float) -> None:
        self.values[name].append(value)

    def count(self, name: str, by: int = 1) -> None:
        self.counters[name] += by

    def gauge(self, name: str, value: float) -> None:
        self.gauges[name] = value

    @contextmanager
    def timer(self, name: str):
        start = time.perf_counter()
        try:
            yield
        finally:
            self.record(name, time.perf_counter() - start)

    def average(self, name: str) -> float:
        v = self.values.get(name)
        return sum(v) / len(v) if v else 0.0

    def median(self, name: str) -> float:
        v = sorted(self.values.get(name, []))
        return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if v else 0.0

    def percentile(self, name: str, p: float) -> float:
        v = sorted(self.values.get(name, []))
        return v[min(int(len(v) * p / 100), len(v) - 1)] if v else 0.0

    def total(self, name: str) -> float:
        return sum(self.values.get(name, []))

    def minimum(self, name: str) -> float:
        return min(self.values.get(name, []), default=0.0)

    def maximum(self, name: str) -> float:
        return max(self.values.get(name, []), default=0.0)

    def report(self) -> dict:
        stats = {n: {"count": len(v), "avg": self.average(n), "median": self.median(n), "min": min(v), "max": max(v), "total": sum(v)} for n, v in self.values.items()}
        return {"metrics": stats, "counters": dict(self.counters), "gauges": dict(self.gauges)}

    def summary(self) -> str:
        lines = [f"{n}: avg={s['avg']:.4f} median={s['median']:.4f} n={s['count']}" for n, s in sorted(self.report()["metrics"].items())]
        return "\n".join(lines + [f"{n}: {v}" for n, v in sorted({**self.counters, **self.gauges}.items())])

    def merge(self, other: Metrics) -> None:
        for n, v in other.values.items():
            self.values[n] += v
        for n, v in other.counters.items():
            self.counters[n] += v
        self.gauges |= other.gauges

    def reset(self) -> None:
        self.values.clear()
        self.counters.clear()
        self.gauges.clear()
