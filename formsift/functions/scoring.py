"""Scores of candidates as Spark columns. Entities are struct columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formsift import vocab
from formsift.functions.text import compact, normalize_phone


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def validate(kind: Column, value: Column) -> Column:
    """Whether a value of a canonical type has that type's format; unknown types don't."""
    plain = F.upper(compact(value))
    checks = {
        "PAN": F.upper(F.trim(value)).rlike(r"^[A-Z]{5}[0-9]{4}[A-Z]$"),
        "AADHAAR": plain.rlike(r"(?U)^[2-9]\d{11}$"),
        "PHONE": normalize_phone(value).rlike(r"(?U)^[6-9]\d{9}$"),
        "EMAIL": F.trim(value).rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"),
        "DRIVING_LICENCE": plain.rlike(r"(?U)^[A-Z]{2}\d{2}\d{4,13}$") & F.substring(plain, 1, 2).isin(vocab.STATE_CODES),
        "VOTER_ID": plain.rlike(r"^[A-Z]{3}[0-9]{7}$"),
    }
    out = kind.isin(list(vocab.SEMANTIC_TYPES))
    for k, ok in checks.items():
        out = F.when(kind == k, ok).otherwise(out)
    return F.coalesce(out, F.lit(False))


def simple_validate(kind: Column, value: Column) -> Column:
    """A laxer check: PAN, Aadhaar and Phone by shape, all other types pass."""
    digits = F.regexp_replace(value, r"\D", "")
    local = F.when(digits.startswith("91"), F.right(digits, F.lit(10))).otherwise(digits)
    return F.when(kind == "PAN", F.upper(value).rlike(r"^[A-Z]{5}[0-9]{4}[A-Z]$")).when(kind == "Aadhaar", digits.rlike(r"^\d{12}$")).when(kind == "Phone", local.rlike(r"^[6-9]\d{9}$")).otherwise(True)


def quality(e: Column) -> Column:
    part = lambda c: F.when(F.coalesce(c, F.lit(False)), 0.10).otherwise(0.0)
    bonus = 0.30 * clamp(F.coalesce(e["context_score"], F.lit(0.0)), -1.0, 1.0)
    return F.coalesce(e["confidence"], F.lit(0.0)) + bonus + part(e["format_valid"]) + part(e["methods_agree"])


def source_priority(e: Column) -> Column:
    source, kind = F.lower(F.coalesce(e["source"], F.lit(""))), F.upper(F.coalesce(e["type"], F.lit("")))
    rank = lambda regex, model: F.when(source == "regex", regex).when(source == "deberta", model).when(F.contains(source, F.lit("llm")), 1).otherwise(0)
    return F.when(kind.isin(list(vocab.STRUCTURED_TYPES)), rank(3, 2)).when(kind.isin(list(vocab.SEMANTIC_TYPES)), rank(2, 3)).otherwise(0)


def prefers_second(a: Column, b: Column) -> Column:
    """Whether b beats a: by quality, then priority of its source, then confidence."""
    rank = lambda e: F.struct(quality(e).alias("q"), source_priority(e).alias("p"), F.coalesce(e["confidence"], F.lit(0.0)).alias("c"))
    return rank(b) > rank(a)


def final_confidence(source: Column, raw: Column, valid: Column, agree: Column) -> Column:
    """Confidence to two places by source, format and agreement, added in that order."""
    source, raw = F.lower(F.coalesce(source, F.lit("unknown"))), F.coalesce(raw, F.lit(0.0))
    add = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    or_else = lambda x: F.when(raw == 0, x).otherwise(raw)
    score = (
        F.when(source == "regex", F.lit(0.90) + add(valid, 0.05) + add(agree, 0.05))
        .when(source == "ocr+regex", F.lit(0.75) + add(valid, 0.10) + add(agree, 0.10))
        .when(source == "deberta", raw + add(valid, 0.05) + add(agree, 0.10))
        .when(source == "nlp", or_else(0.65) + add(agree, 0.10) + add(valid, 0.05))
        .when(F.contains(source, F.lit("llm")) | F.contains(source, F.lit("context")), or_else(0.70) + add(agree, 0.10) + add(valid, 0.05))
        .otherwise(F.lit(0.50) + add(agree, 0.10) + add(valid, 0.10))
    )
    return F.round(clamp(score), 2)


def confidence_level(score: Column, high: float = 0.90, medium: float = 0.70) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def badge(score: Column) -> Column:
    """The report's coarser levels and whole percents."""
    return F.struct(confidence_level(score, 0.8, 0.6).alias("badge"), F.floor(score * 100 + 0.5).cast("int").alias("percent"))
