"""Training examples for token models, from tables and labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formsift import vocab
from formsift.operators.synth import exact_split
from formsift.functions.text import lookup, strip

#: Columns of the table, the words before them and their labels (fixed values).
SENTENCE = [("Name", "NAME"), ("Email", "EMAIL"), ("Phone", "PHONE"), ("Address", "ADDRESS"), ("Aadhaar", "AADHAAR"), ("PAN", "PAN"), ("DOB", "DOB")]


def table_examples(rows: DataFrame) -> DataFrame:
    """text and entities (start, end, label) of rows with the seven columns; a
    missing value reads "nan" in the text and has no entity."""
    shown = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("nan")), F.lit(".")) for c, _ in SENTENCE]
    text = rows.select("*", F.concat_ws(" ", *shown).alias("text"))

    def entity(c, label):
        v = strip(F.col(c).cast("string"))
        at = F.call_function("instr", F.col("text"), v) - 1
        return F.when(F.coalesce((v != "") & (at >= 0), F.lit(False)), F.struct(at.cast("int").alias("start"), (at + F.length(v)).cast("int").alias("end"), F.lit(label).alias("label")))

    return text.select("text", F.array_compact(F.array(*[entity(c, k) for c, k in SENTENCE])).alias("entities"))


def external_examples(rows: DataFrame, mask: str = "privacy_mask") -> DataFrame:
    """text and entities of a corpus with its own labels; rows without any known go."""
    kept = F.filter(F.col(mask), lambda e: lookup(e["label"], vocab.EXTERNAL_LABELS).isNotNull())
    named = F.transform(kept, lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), lookup(e["label"], vocab.EXTERNAL_LABELS).alias("label")))
    return rows.select("text", named.alias("entities")).where(F.size("entities") > 0)


def character_labels(text: Column, entities: Column) -> Column:
    """One BIO label a character; malformed and unknown entities are left out and later ones win."""
    n = F.length(text)
    good = F.filter(entities, lambda e: (e["start"] >= 0) & (e["end"] <= n) & (e["start"] < e["end"]) & e["label"].isin(vocab.BIO_TYPES))

    def label(i):
        last = F.try_element_at(F.filter(good, lambda e: (e["start"] <= i) & (i < e["end"])), F.lit(-1))
        return F.when(last.isNull(), "O").when(last["start"] == i, F.concat(F.lit("B-"), last["label"])).otherwise(F.concat(F.lit("I-"), last["label"]))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), label)).otherwise(F.array().cast("array<string>"))


def _id(label: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in vocab.BIO_IDS.items() for x in kv])[label]


def token_labels(offsets: Column, entities: Column) -> Column:
    """Label ids of tokens (start, end): the first entity a token touches, B if the
    token begins at or before it; tokens without width have -100."""

    def one(t):
        hit = F.try_element_at(F.filter(entities, lambda e: (t["start"] < e["end"]) & (t["end"] > e["start"])), F.lit(1))
        label = F.when(hit.isNull(), "O").otherwise(F.concat(F.when(t["start"] <= hit["start"], "B-").otherwise("I-"), hit["label"]))
        return F.when(t["start"] == t["end"], -100).otherwise(_id(label))

    return F.transform(offsets, one)


def token_labels_by_first(offsets: Column, entities: Column) -> Column:
    """The same with B for the first token seen of each known entity."""
    known = F.filter(entities, lambda e: e["label"].isin(vocab.BIO_TYPES))
    touch = lambda t, e: (t["start"] != t["end"]) & (t["start"] < e["end"]) & (t["end"] > e["start"])
    # Which known entity, counted from 1, each token takes; 0 for none.
    taken = F.transform(offsets, lambda t: F.coalesce(F.array_position(F.transform(known, lambda e: touch(t, e)), True), F.lit(0)))

    def one(t, i):
        at = taken[i]
        first = F.array_position(taken, at) == i + 1
        label = F.when(at == 0, "O").otherwise(F.concat(F.when(first, "B-").otherwise("I-"), F.try_element_at(known, F.greatest(at, F.lit(1)).cast("int"))["label"]))
        return F.when(t["start"] == t["end"], -100).otherwise(_id(label))

    return F.transform(offsets, one)


def train_split(df: DataFrame, key: str, train: float = 0.9, seed: int = 42) -> DataFrame:
    """Add `split`: int(train * n) of n rows train, the others validation, by a hash of the key."""
    n = df.count()
    return exact_split(df, key, {"train": int(train * n), "validation": n - int(train * n)}, seed)
