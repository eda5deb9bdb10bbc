"""Documents to entities. Everything stays in the document's row, so the plan has
no exchange until analytics, whatever the number of documents or of candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formsift.functions.scoring import confidence_level, final_confidence, validate
from formsift.functions.text import let, strip
from formsift.operators.context import contexts, filter_roles, with_context
from formsift.operators.extract import CANDIDATES, TOKENS, llm_candidates, model_candidates, plug_in, predict_roles, regex_candidates
from formsift.operators.reconcile import FIELDS, reconcile
from formsift.operators.route import needs_llm

ENTITY_FIELDS = [*FIELDS, "confidence_level"]


def _blank() -> Column:
    return F.array().cast(CANDIDATES)


def settle(candidates: Column, text: Column, predictions: Column | None = None) -> Column:
    """Classify, drop others' values, reconcile."""
    return reconcile(filter_roles(with_context(candidates, text, predictions)))


def settled(df: DataFrame, column: str, candidates: Column, text: Column, roles: Callable | None, only: Column | None = None) -> DataFrame:
    """Add a column of entities; where `only` is false it stays as it is."""
    keep = lambda c: c if only is None else F.when(only, c).otherwise(F.col(column))
    if roles is None:
        return df.withColumn(column, keep(settle(candidates, text)))
    asked = candidates if only is None else F.when(only, candidates)
    made = df.withColumn("__raw", asked).withColumn("__contexts", contexts(F.col("__raw"), text))
    made = predict_roles(made, roles, "__contexts", "__roles")
    return made.withColumn(column, keep(settle(F.col("__raw"), text, F.col("__roles")))).drop("__raw", "__contexts", "__roles")


def enrich(entities: Column) -> Column:
    """Final confidence and its level; validated is the format check."""

    def one(e):
        valid = validate(e["type"], e["value"])
        score = final_confidence(e["source"], e["confidence"], valid, e["methods_agree"])
        new = lambda s: {"confidence": s, "validated": valid, "format_valid": valid, "methods_agree": F.coalesce(e["methods_agree"], F.lit(False)), "confidence_level": confidence_level(s)}
        return let(score, lambda s: F.struct(*[(new(s)[f] if f in new(s) else e[f]).alias(f) for f in ENTITY_FIELDS]))

    return F.transform(entities, one)


def extract(docs: DataFrame, text: str = "text", ner: Callable | None = None, llm: Callable | None = None, roles: Callable | None = None) -> DataFrame:
    """docs with `entities` and `status` (success, or no_text for a blank text); with
    ner or llm also `errors`, the names of their exceptions.

    ner: texts to arrays of tagged tokens; llm: texts to replies; roles: contexts
    to (label, probability) of a trained classifier. Each sees a text once. The LLM
    only gets documents whose first result is ambiguous, which are then settled anew
    from all raw candidates; all in one pass, as texts that it needn't see are null
    to it. Without an LLM the first result is the last. Null text counts as blank."""
    kept = [c for c in docs.columns if c not in ("entities", "status", "errors")]
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn("__regex", regex_candidates(body))
    errors = []
    if ner is not None:
        found = plug_in(found, ner, text, "__tokens", TOKENS, error="__ner_error")
        found = found.withColumn("__ner", F.coalesce(model_candidates(body, F.col("__tokens")), _blank()))
        errors.append(F.concat(F.lit("ner: "), "__ner_error"))
    raw = F.concat("__regex", "__ner") if ner is not None else F.col("__regex")
    found = settled(found, "entities", raw, body, roles)
    if llm is not None:
        found = found.withColumn("__ask", F.when(needs_llm(F.col("entities")), F.col(text)))
        found = plug_in(found, llm, "__ask", "__reply", "string", error="__llm_error")
        more = F.coalesce(llm_candidates(body, F.col("__reply")), _blank())
        found = settled(found, "entities", F.concat(raw, more), body, roles, F.col("__ask").isNotNull())
        errors.append(F.concat(F.lit("llm: "), "__llm_error"))
    status = F.when(strip(body) == "", "no_text").otherwise("success")
    out = found.withColumn("entities", enrich(F.col("entities"))).withColumn("status", status)
    if errors:
        return out.withColumn("errors", F.array_compact(F.array(*errors))).select(*kept, "entities", "status", "errors")
    return out.select(*kept, "entities", "status")


#: What extract() adds to its documents.
RESULT = "entities array<struct<type:string,value:string,confidence:double,source:string,start:int,end:int,validated:boolean,context_role:string,context_label:string,context_score:double,context_model:string,format_valid:boolean,methods_agree:boolean,confidence_level:string>>, status string"


def observed(extracted: DataFrame, observation) -> DataFrame:
    """Count documents and entities while another action runs over them; an
    Observation holds the figures afterwards. Texts and values are never logged."""
    entities = F.coalesce(F.sum(F.size("entities")), F.lit(0)).cast("bigint")
    return extracted.observe(observation, F.count(F.lit(1)).alias("documents"), entities.alias("entities"), F.count_if(F.col("status") == "no_text").alias("no_text"))


def entity_rows(extracted: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row an entity, ord from 0 in document order."""
    # Not posexplode(): for it the optimizer adds a filter that computes all entities a second time.
    return extracted.select(key, F.posexplode_outer("entities").alias("ord", "e")).where("ord IS NOT NULL").select(key, "ord", "e.*")


def redact(extracted: DataFrame, text: str = "text", mask: str = "[{}]") -> DataFrame:
    """The text with each entity's span replaced by its type, overlapping ones once."""
    spans = F.sort_array(F.transform(F.filter("entities", lambda e: e["start"].isNotNull()), lambda e: F.struct(e["start"].alias("s"), e["end"].alias("e"), e["type"].alias("t"))))
    before, after = mask.split("{}")

    def step(acc, x):
        begin = F.substring(F.col(text), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        more = F.concat(acc["out"], begin, F.lit(before), x["t"], F.lit(after))
        return F.when(x["s"] >= acc["at"], F.struct(more.alias("out"), x["e"].alias("at"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["e"]).alias("at")))

    done = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    return extracted.withColumn("redacted", done)
