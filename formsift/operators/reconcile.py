"""Reconciliation of a document's candidates, in place: no row leaves its document.

Validate, fold equal ones in order, merge name and address fragments, sort, and
drop overlapping weaker ones, all on one array of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formsift.functions.scoring import prefers_second, quality, validate
from formsift.functions.text import canonical_type, entity_key, let, running, runs, squeeze

FIELDS = ["type", "value", "confidence", "source", "start", "end", "validated", "context_role", "context_label", "context_score", "context_model", "format_valid", "methods_agree"]
LAST = 10**9
NAME_GAP, ADDRESS_GAP = 1, 2


def put(e: Column, **changes: Column) -> Column:
    return F.struct(*[changes.get(f, e[f]).alias(f) for f in FIELDS])


def overlap(a: Column, b: Column) -> Column:
    """Whether two spans share a place; without all four ends they don't."""
    return F.coalesce((a["start"] < b["end"]) & (b["start"] < a["end"]), F.lit(False))


def canonical(candidates: Column) -> Column:
    """Canonical types and squeezed values; only those whose format is right."""

    def one(c):
        head = F.struct(canonical_type(c["type"]).alias("type"), squeeze(c["value"]).alias("value"))

        def build(h):
            new = {"type": h["type"], "value": h["value"], "format_valid": validate(h["type"], h["value"]), "methods_agree": F.lit(False)}
            return F.struct(*[new.get(f, c[f] if f not in new else None).alias(f) for f in FIELDS])

        return let(head, build)

    return F.filter(F.transform(candidates, one), lambda c: (c["type"] != "") & (c["value"] != "") & c["format_valid"])


def fold_equal(entities: Column) -> Column:
    """One entity a key, in order of first sight; each later one challenges the
    holder, whose bonus for agreement stays once it has it. Candidates are sorted
    by key once, so equal ones stand together."""

    def challenge(held, x):
        winner = F.when(prefers_second(held, x["e"]), x["e"]).otherwise(held)
        return let(winner, lambda w: put(w, methods_agree=F.lit(True), format_valid=held["format_valid"] | x["e"]["format_valid"]))

    def winner(run):
        return F.struct(run[0]["i"].alias("i"), F.aggregate(F.slice(run, 2, F.greatest(F.size(run) - 1, F.lit(0))), run[0]["e"], challenge).alias("e"))

    keyed = F.sort_array(F.transform(entities, lambda e, i: F.struct(entity_key(e["type"], e["value"]).alias("key"), i.alias("i"), e.alias("e"))))
    return let(keyed, lambda o: F.sort_array(F.transform(runs(o, lambda i: o[i]["key"] != o[i - 1]["key"]), winner))["e"])


def merge_fragments(entities: Column, kind: str, gap: int) -> Column:
    """Entities of other types, then those of one type with neighbours joined
    that stand at most gap apart; such without a span are dropped."""

    def joined(last, e):
        return put(
            last,
            value=F.concat(squeeze(last["value"]), F.lit(" "), squeeze(e["value"])),
            end=e["end"],
            confidence=F.least(F.coalesce(last["confidence"], F.lit(0.0)), F.coalesce(e["confidence"], F.lit(0.0))),
            context_score=F.greatest(F.coalesce(last["context_score"], F.lit(0.0)), F.coalesce(e["context_score"], F.lit(0.0))),
        )

    def parts(all_of):
        mine = F.filter(all_of, lambda e: (e["type"] == kind) & e["start"].isNotNull() & e["end"].isNotNull())
        order = F.sort_array(F.transform(mine, lambda e, i: F.struct(e["start"].alias("s"), i.alias("i"), e.alias("e"))))["e"]
        # A joined entity ends where its last part does, so neighbours tell where a new one begins.
        islands = let(order, lambda o: runs(o, lambda i: o[i]["start"] - o[i - 1]["end"] > gap))
        merged = F.transform(islands, lambda run: F.aggregate(F.slice(run, 2, F.greatest(F.size(run) - 1, F.lit(0))), run[0], joined))
        return F.concat(F.filter(all_of, lambda e: e["type"] != kind), merged)

    return let(entities, parts)


def resolve_overlaps(entities: Column) -> Column:
    """By start, better first, each kept unless one already kept overlaps it and
    is the same, or has its type and is at least as good. None kept is taken back.

    Keys and qualities are made once; what begins at or after the end of all before
    it is compared with none of them."""
    ranked = F.transform(
        entities,
        lambda e, i: F.struct(F.coalesce(e["start"], F.lit(LAST)).alias("s"), (-quality(e)).alias("q"), i.alias("i"), entity_key(e["type"], e["value"]).alias("key"), e.alias("e")),
    )

    def step(acc, x):
        beaten = F.exists(acc, lambda k: overlap(x["e"], k["e"]) & ((x["key"] == k["key"]) | ((x["e"]["type"] == k["e"]["type"]) & (k["q"] <= x["q"]))))
        return F.when(beaten, acc).otherwise(F.concat(acc, F.array(x)))

    def clusters(o):
        ends = F.transform(o, lambda x: F.coalesce(x["e"]["end"], F.lit(-1)))
        reach = let(ends, lambda e: running(e, F.lit(-1), lambda a, b: F.greatest(a, b)))
        cut = let(reach, lambda r: runs(o, lambda i: o[i]["s"] >= r[i]))
        return F.flatten(F.transform(cut, lambda run: F.aggregate(run, F.slice(run, 1, 0), step)))["e"]

    return let(F.sort_array(ranked), clusters)


def reconcile(candidates: Column) -> Column:
    """Final entities of an array of candidates with context."""
    folded = fold_equal(canonical(candidates))
    return resolve_overlaps(merge_fragments(merge_fragments(folded, "NAME", NAME_GAP), "ADDRESS", ADDRESS_GAP))
