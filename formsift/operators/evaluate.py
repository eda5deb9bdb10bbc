"""Predicted against labelled entities: set comparison and grouped metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formsift.functions.text import squeeze


def simple_value(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[ -]", ""))


def value_key(kind: Column, value: Column) -> Column:
    """What counts as the same value of a type; e-mail links lose their markup."""
    kind, v = F.upper(F.coalesce(kind, F.lit(""))), squeeze(value)
    tight = F.regexp_replace(v, r"(?U)[\s-]", "")
    mail = F.regexp_replace(v, r"(?i)\[([^\]]+)\]\(mailto:([^)]+)\)", "$2")
    return (
        F.when(kind == "EMAIL", F.lower(mail))
        .when(kind.isin("AADHAAR", "DRIVING_LICENCE", "VOTER_ID", "PHONE"), F.lower(tight))
        .when(kind == "PAN", F.upper(tight))
        .when(kind == "DOB", F.lower(F.translate(F.replace(v, F.lit(" "), F.lit("")), "-.", "//")))
        .otherwise(F.lower(v))
    )


def key_set(rows: DataFrame, key: str = "doc_id", kind: str = "type", value: str = "value", by=value_key) -> DataFrame:
    """Distinct (doc, type, value) of rows."""
    return rows.select(key, F.upper(kind).alias("type"), by(F.col(kind), F.col(value)).alias("value")).distinct()


def outcomes(gold: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """tp, fp and fn (0 or 1) of each distinct (doc, type, value) in either set."""
    g, f = gold.withColumn("g", F.lit(1)), found.withColumn("f", F.lit(1))
    both = g.join(f, [key, "type", "value"], "full_outer")
    hit = F.col("g").isNotNull() & F.col("f").isNotNull()
    one = lambda c: F.when(c, 1).otherwise(0)
    return both.select(key, "type", "value", one(hit).alias("tp"), one(F.col("g").isNull()).alias("fp"), one(F.col("f").isNull()).alias("fn"))


def rates(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> list[Column]:
    t, p, n = (F.col(c).cast("double") for c in (tp, fp, fn))
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.when(b != 0, b))
    precision, recall = safe(t, t + p), safe(t, t + n)
    return [precision.alias("precision"), recall.alias("recall"), safe(2 * precision * recall, precision + recall).alias("f1")]


def metrics(results: DataFrame, document_type: str | None = None) -> DataFrame:
    """Counts and rates overall, by type and by document type, in one pass."""
    kind = F.lower(F.coalesce(F.col(document_type), F.lit("unknown"))) if document_type else F.lit("unknown")
    rows = results.select("type", kind.alias("document_type"), "tp", "fp", "fn")
    sets = rows.groupingSets([[], ["type"], ["document_type"]], "type", "document_type")
    counted = sets.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.grouping("type").alias("gt"), F.grouping("document_type").alias("gd"))
    level = F.when((F.col("gt") == 1) & (F.col("gd") == 1), "overall").when(F.col("gd") == 1, "type").otherwise("document_type")
    name = F.when(level == "overall", "all").when(level == "type", F.col("type")).otherwise(F.col("document_type"))
    lines = counted.select(level.alias("level"), name.alias("name"), "tp", "fp", "fn")
    # Of an empty input the overall line remains.
    none = results.sparkSession.range(1).select(F.lit("overall").alias("level"), F.lit("all").alias("name"), *[F.lit(0).alias(c) for c in ("tp", "fp", "fn")])
    return lines.union(none).groupBy("level", "name").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")]).select("*", *rates())


def error_sample(results: DataFrame, n: int = 30, key: str = "doc_id") -> DataFrame:
    """The first n wrong entities in a fixed order."""
    wrong = results.where("fp + fn > 0").select(key, "type", "value", F.when(F.col("fp") == 1, "false_positive").otherwise("false_negative").alias("error"))
    return wrong.orderBy(key, "type", "value", "error").limit(n)


def tagged_spans(labels: DataFrame, key: str = "doc_id", position: str = "pos", label: str = "label") -> DataFrame:
    """(doc, type, value) of the runs in token labels, value being their first and last place.

    Runs are islands: a token begins one unless it goes on as I of the same type."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(position)
    kind = F.when(F.contains(label, F.lit("-")), F.substring_index(label, "-", -1))
    rows = labels.where(F.col(label) != "-100").withColumn("k", kind)
    begins = F.col(label).startswith("B-") | F.coalesce(F.lag("k").over(w) != F.col("k"), F.lag("k").over(w).isNull())
    islands = rows.withColumn("begin", (F.col("k").isNotNull() & begins).cast("int")).withColumn("island", F.sum("begin").over(w)).where("k IS NOT NULL")
    found = islands.groupBy(key, "island", F.col("k").alias("type")).agg(F.min(position).alias("a"), F.max(position).alias("b"))
    return found.select(key, "type", F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("value"))


def token_metrics(gold: DataFrame, predicted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Precision, recall and F1 of whole tagged spans."""
    return metrics(outcomes(tagged_spans(gold, key), tagged_spans(predicted, key), key)).where("level = 'overall'")
