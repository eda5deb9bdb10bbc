"""Counts over extracted documents: per document without a shuffle, per batch
and by source with one, pre-summed on the map side."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from formsift.functions.scoring import badge


def level_counts(entities: Column) -> Column:
    """(total, high, medium, low) of an array of entities."""
    n = lambda level: F.size(F.filter(entities, lambda e: e["confidence_level"] == level)).cast("bigint").alias(level)
    return F.struct(F.size(entities).cast("bigint").alias("total"), n("high"), n("medium"), n("low"))


def of_types(entities: Column, types: Sequence[str] | None) -> Column:
    """The entities of some canonical types; of all types if none are named."""
    return entities if types is None else F.filter(entities, lambda e: e["type"].isin(list(types)))


def document_analytics(extracted: DataFrame, key: str = "doc_id", types: Sequence[str] | None = None) -> DataFrame:
    return extracted.select(key, "status", level_counts(of_types(F.col("entities"), types)).alias("a")).select(key, "status", "a.*")


def batch_analytics(extracted: DataFrame, key: str = "doc_id", types: Sequence[str] | None = None) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("total", "high", "medium", "low")]
    return document_analytics(extracted, key, types).agg(F.count(F.lit(1)).alias("documents_processed"), *sums)


def report(extracted: DataFrame, key: str = "doc_id", types: Sequence[str] | None = None) -> DataFrame:
    """A line for each entity as a report shows it: type, value, source, percent, badge, validated."""
    lines = extracted.select(key, F.posexplode_outer(of_types(F.col("entities"), types)).alias("ord", "e")).where("ord IS NOT NULL")
    return lines.select(key, "ord", "e.type", "e.value", "e.source", badge(F.col("e.confidence")).alias("b"), "e.validated").select(key, "ord", "type", "value", "source", "b.percent", "b.badge", "validated")


def source_distribution(entities: DataFrame, source: str = "source") -> DataFrame:
    """Entities by source, most common first, with percents."""
    counted = entities.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    # One row a source remains, so the window over all of them is small.
    return counted.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy())).orderBy(F.desc("n"), source)


def fallback_rate(extracted: DataFrame) -> DataFrame:
    """Documents with an entity that came from the LLM, of all documents."""
    used = F.exists("entities", lambda e: F.contains(F.lower(e["source"]), F.lit("llm")) | F.contains(F.lower(e["source"]), F.lit("context")))
    return extracted.agg(F.count(F.lit(1)).alias("documents"), F.count_if(used).alias("fallback")).withColumn("rate", F.when(F.col("documents") == 0, 0.0).otherwise(F.col("fallback") / F.col("documents")))


#: Rows of a value range that one task may rank.
RANKED_ROWS = 50_000


def nth_value(df: DataFrame, value: str, index: int, bins: int = 1024) -> float | None:
    """The element of a sorted column at an index from 0, without sorting it.

    Equal slices of the range are counted, the slice that holds the element is
    sliced again, and so on until few rows are left or all are equal. Infinite
    values stand at the ends and are only counted; NaN is the largest."""
    v = F.col(value).cast("double")
    finite = v.between(-sys.float_info.max, sys.float_info.max)
    low, high = F.count_if(v == float("-inf")), F.count_if(v == float("inf"))
    ends = df.agg(F.min(F.when(finite, v)).alias("lo"), F.max(F.when(finite, v)).alias("hi"), F.count_if(finite).alias("n"), low.alias("low"), high.alias("high"), F.count(v).alias("all")).first()
    lo, hi, n = ends["lo"], ends["hi"], ends["n"]
    if not 0 <= index < ends["all"]:
        return None
    if index < ends["low"]:
        return float("-inf")
    index -= ends["low"]
    if index >= n:
        return float("inf") if index < n + ends["high"] else float("nan")
    inside = df.where(finite)
    while lo < hi and n > RANKED_ROWS:
        # Halves, as the difference of two large values may be infinite.
        number = F.least(F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * bins), F.lit(bins - 1))
        slices = inside.where(v.between(lo, hi)).groupBy(number.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect()  # bins rows at most
        for s in sorted(slices, key=lambda s: s["b"]):
            if index < s["n"]:
                break
            index -= s["n"]
        lo, hi, n = s["lo"], s["hi"], s["n"]
    if lo == hi:
        return lo
    counts = inside.where(v.between(lo, hi)).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(W.orderBy("v")))
    return counts.where(F.col("upto") > index).agg(F.min("v").alias("v")).first()["v"]


def order_statistics(df: DataFrame, value: str) -> DataFrame:
    """n, mean, upper median (element n // 2) and p95 (element int(0.95 n), the
    last at most) of a column, nulls left out; of no rows, nulls."""
    kept = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    all_of = kept.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    n = all_of.first()["n"]
    found = {"median": nth_value(kept, "v", n // 2), "p95": nth_value(kept, "v", min(n - 1, int(0.95 * n)))}
    return all_of.select("n", "mean", *[F.lit(x).cast("double").alias(k) for k, x in found.items()])
