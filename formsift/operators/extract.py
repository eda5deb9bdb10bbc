"""Candidates of a text: patterns, model and LLM output, one array per document.

A candidate is a struct; its order in the array is the order of extraction,
on which reconciliation depends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formsift import vocab
from formsift.functions.text import let, locate_span, regex_value, spans, strip

CANDIDATE = "struct<type:string,value:string,confidence:double,source:string,start:int,end:int,validated:boolean>"
CANDIDATES = f"array<{CANDIDATE}>"


def candidate(kind: Column, value: Column, confidence: Column, source: str, start: Column, end: Column, validated: bool) -> Column:
    return F.struct(kind.alias("type"), value.alias("value"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(validated).alias("validated"))


def matches(text: Column, kind: str) -> Column:
    """Candidates of one type; DOB only where a birth label stands before the date."""
    found = spans(text, vocab.BIRTH_DATE, 1) if kind == "DOB" else spans(text, vocab.PATTERNS[kind])
    value = (lambda v: v) if kind == "DOB" else (lambda v: regex_value(kind, v))
    return F.transform(found, lambda m: candidate(F.lit(kind), value(m["value"]), F.lit(vocab.REGEX_CONFIDENCE), "regex", m["start"], m["end"], True))


def regex_candidates(text: Column) -> Column:
    """Candidates of all patterns by (start, end), equal spans in the patterns' order.

    Patterns only run on texts that have what they all need: an @, four digits
    in a row, or a birth label."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<s:int,e:int,k:int,c:" + CANDIDATE + ">>")
    digits, mail, birth = text.rlike(r"(?U)\d{4}"), F.contains(text, F.lit("@")), text.rlike(r"(?iuU)dob|birth|born")

    def keyed(i, kind):
        return F.transform(matches(text, kind), lambda c: F.struct(c["start"].alias("s"), c["end"].alias("e"), F.lit(i).alias("k"), c.alias("c")))

    lists = {kind: keyed(i, kind) for i, kind in enumerate([*vocab.PATTERNS, "DOB"])}
    numbers = F.concat(*[x for kind, x in lists.items() if kind not in ("Email", "DOB")])
    parts = [F.when(digits, numbers).otherwise(none), F.when(mail, lists["Email"]).otherwise(none), F.when(digits & birth, lists["DOB"]).otherwise(none)]
    return F.sort_array(F.concat(*parts))["c"]


def bio_decode(tokens: Column) -> Column:
    """Entities of tagged tokens (label, score, start, end) as (type, start, end, confidence).

    B starts one; I of the same type goes on, of another type starts anew; O or
    a label without a dash ends it; tokens without width are skipped. Confidence
    is the least score, to four places."""
    real = F.filter(tokens, lambda t: t["start"] != t["end"])
    kind = lambda t: F.when(F.contains(t["label"], F.lit("-")), F.substring_index(t["label"], "-", -1))
    one = lambda t: F.struct(kind(t).alias("type"), t["start"].alias("start"), t["end"].alias("end"), t["score"].alias("confidence"), F.lit(True).alias("open"))

    def step(acc, t):
        last = F.try_element_at(acc, F.lit(-1))
        goes_on = F.coalesce(last["open"] & (last["type"] == kind(t)) & t["label"].startswith("I-"), F.lit(False))
        grown = F.struct(last["type"].alias("type"), last["start"].alias("start"), t["end"].alias("end"), F.least(last["confidence"], t["score"]).alias("confidence"), F.lit(True).alias("open"))
        closed = F.struct(last["type"].alias("type"), last["start"].alias("start"), last["end"].alias("end"), last["confidence"].alias("confidence"), F.lit(False).alias("open"))
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(kind(t).isNull(), F.when(F.size(acc) > 0, F.concat(head, F.array(closed))).otherwise(acc)).when(goes_on, F.concat(head, F.array(grown))).otherwise(F.concat(acc, F.array(one(t))))

    none = F.slice(F.transform(real, one), 1, 0)
    return F.transform(F.aggregate(real, none, step), lambda e: F.struct(F.upper(e["type"]).alias("type"), e["start"].alias("start"), e["end"].alias("end"), F.round(e["confidence"], 4).alias("confidence")))


def model_candidates(text: Column, tokens: Column) -> Column:
    """Candidates of a token model's output."""
    cut = lambda e: strip(F.substring(text, e["start"] + 1, e["end"] - e["start"]))
    return F.transform(bio_decode(tokens), lambda e: candidate(e["type"], cut(e), e["confidence"], "deberta", e["start"], e["end"], False))


def llm_entities(reply: Column) -> Column:
    """(type, value) of an LLM's reply: JSON, or the JSON object inside other text."""
    shape = "entities array<struct<type:string,value:string>>"
    inner = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    found = F.coalesce(F.from_json(reply, shape)["entities"], F.from_json(inner, shape)["entities"], F.array().cast("array<struct<type:string,value:string>>"))
    return F.filter(found, lambda e: e["type"].isin(list(vocab.LLM_TYPES)) & (strip(e["value"]) != ""))


def llm_candidates(text: Column, reply: Column) -> Column:
    """Candidates of an LLM's reply, placed in the text where they can be found."""

    def place(e):
        value = strip(e["value"])
        return let(locate_span(text, value), lambda at: candidate(e["type"], value, F.lit(vocab.LLM_CONFIDENCE), "llm/context", at["start"], at["end"], False))

    return F.transform(llm_entities(reply), place)


def llm_list(reply: Column) -> Column:
    """(type, value, confidence, source) of a reply that is a JSON list of any
    types, maybe inside other text; 0.85 where it gives no confidence."""
    shape = "array<struct<type:string,value:string,confidence:double>>"
    inner = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    found = F.coalesce(F.from_json(F.when(inner != "", inner), shape), F.array().cast(shape))
    good = F.filter(found, lambda e: (strip(F.coalesce(e["type"], F.lit(""))) != "") & (strip(F.coalesce(e["value"], F.lit(""))) != ""))
    return F.transform(good, lambda e: F.struct(e["type"].alias("type"), e["value"].alias("value"), F.coalesce(e["confidence"], F.lit(0.85)).alias("confidence"), F.lit("llm").alias("source")))


def answers(run: Callable[[list], list], asked: list) -> list[tuple]:
    """(value, error) of each of the things asked, None without being asked. If a
    batch fails, its members are asked one by one, so a bad one costs only itself."""

    def ask(some: list) -> list:
        out = list(run(some)) if some else []
        if len(out) != len(some):
            raise ValueError("as many answers as texts are needed")
        return out

    there = [x for x in asked if x is not None]
    try:
        found = [(v, None) for v in ask(there)]
    except Exception as e:
        found = [(None, type(e).__name__)]
        if len(there) > 1:
            found = []
            for x in there:
                try:
                    found.append((ask([x])[0], None))
                except Exception as e:  # the patterns' results stay as they are
                    found.append((None, type(e).__name__))
    left = iter(found)
    return [(None, None) if x is None else next(left) for x in asked]


def opened(function: Callable) -> Callable:
    """What a task calls: made once by the function's method `open`, if it has one."""
    return function.open() if hasattr(function, "open") else function


def plug_in(df: DataFrame, function: Callable[[list[str]], list], text: str, column: str, kind: str, error: str | None = None) -> DataFrame:
    """Add a column made by a Python function over batches of texts (a token
    model, an LLM call, OCR), and one with the name of the exception where it
    failed. Null texts aren't shown to it and get null.

    The function is made once a task if it has a method `open`."""

    @F.pandas_udf(f"value {kind}, error string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run = opened(function)
        for batch in batches:
            found = answers(run, batch.tolist())
            yield pd.DataFrame({"value": pd.Series([v for v, _ in found], dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

    # Not deterministic, so the optimizer neither repeats the call nor moves it into other expressions.
    said = f"__said_{column}"
    made = df.withColumn(said, call.asNondeterministic()(F.col(text)))
    made = made.withColumn(column, F.col(f"{said}.value"))
    return (made.withColumn(error, F.col(f"{said}.error")) if error else made).drop(said)


PREDICTIONS = "array<struct<label:string,probability:double>>"


def predict_roles(df: DataFrame, function: Callable[[list[str]], list], contexts: str, column: str) -> DataFrame:
    """Add a trained classifier's (label, probability) for each of an array of
    contexts; null where there is no context or it failed. It sees a batch's
    contexts of all documents at once."""

    @F.pandas_udf(PREDICTIONS)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = opened(function)
        for batch in batches:
            lists = [[] if x is None else list(x) for x in batch]
            found = iter(answers(run, [c for x in lists for c in x]))
            told = [[next(found)[0] for _ in x] for x in lists]
            yield pd.Series([[None if v is None else {"label": str(v[0]), "probability": None if v[1] is None else float(v[1])} for v in x] for x in told], dtype=object)

    return df.withColumn(column, call.asNondeterministic()(F.col(contexts)))


TOKENS = "array<struct<label:string,score:double,start:int,end:int>>"
