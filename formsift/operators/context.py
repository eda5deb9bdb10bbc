"""The role of a candidate by the labels before it, as Spark columns.

Kept as is: types are looked up in capitals but not canonical, so spellings
with spaces find no labels; a label inside a longer word counts; a position in
the line is compared with one in the 120 characters before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formsift import vocab
from formsift.functions.text import let, literal, lookup

WINDOW = 120


def clean(x: Column) -> Column:
    return F.translate(F.lower(x), "’`", "''")


def line_before(text: Column, start: Column) -> Column:
    """Text from the start of the line up to a position."""
    return F.substring_index(F.left(text, start), "\n", -1)


def window_before(text: Column, start: Column) -> Column:
    return F.right(F.left(text, start), F.lit(WINDOW))


def last_label(context: Column, backwards: Column, labels: Column) -> Column:
    """(pos, order, label) of the label that begins last; the earlier in the list if two do.

    backwards: the context reversed; labels: structs (label, reversed)."""

    def place(x, i):
        at = F.call_function("instr", backwards, x["reversed"])
        return F.struct(F.when(at > 0, F.length(context) - at - F.length(x["label"]) + 1).alias("pos"), (-i).alias("order"), x["label"].alias("label"))

    return F.array_max(F.filter(F.transform(labels, place), lambda f: f["pos"].isNotNull()))


def _labels(table: dict[str, list[str]], kind: Column) -> Column:
    one = lambda x: f"named_struct('label', {literal(x)}, 'reversed', {literal(x[::-1])})"
    pairs = [f"{literal(k)}, array({', '.join(map(one, v))})" for k, v in table.items()]
    return F.coalesce(F.expr(f"map({', '.join(pairs)})")[kind], F.array().cast("array<struct<label:string,reversed:string>>"))


CONTEXT = "struct<context_role:string,context_label:string,context_score:double,context_model:string>"


def role(kind: Column, text: Column, start: Column) -> Column:
    """Role, label, score and model of a candidate of a type at a position."""
    kind = F.upper(kind)
    result = lambda r, label, score, model: F.struct(F.lit(r).alias("context_role") if isinstance(r, str) else r.alias("context_role"), label.alias("context_label"), score.alias("context_score"), F.lit(model).alias("context_model"))
    unknown = lambda model: result("unknown", F.lit(""), F.lit(0.0), model)

    def nearest(c):
        def of(table, rank):
            def best(labels):
                found = F.coalesce(last_label(c["line"], c["line_back"], labels), last_label(c["near"], c["near_back"], labels))
                return let(found, lambda f: F.when(f.isNotNull(), F.struct(f["pos"].alias("pos"), F.lit(rank).alias("rank"), f["label"].alias("label"))))

            return let(_labels(table, c["kind"]), best)

        # Of equal positions primary stands before negative, then secondary.
        all_three = F.array_compact(F.array(of(vocab.PRIMARY_LABELS, 3), of(vocab.NON_TARGET_LABELS, 2), of(vocab.SECONDARY_LABELS, 1)))

        def named(best):
            r = F.when(best["rank"] == 3, "primary").when(best["rank"] == 2, "non_target").otherwise("secondary_person")
            return F.when(best.isNull(), unknown("nearest_field")).otherwise(result(r, best["label"], F.when(best["rank"] == 3, 1.0).otherwise(-1.0), "nearest_field"))

        return let(F.array_max(all_three), named)

    inputs = F.struct(clean(line_before(text, start)).alias("line"), clean(window_before(text, start)).alias("near"), kind.alias("kind"))
    both_ways = lambda c: F.struct(c["line"].alias("line"), F.reverse(c["line"]).alias("line_back"), c["near"].alias("near"), F.reverse(c["near"]).alias("near_back"), c["kind"].alias("kind"))
    return F.when(start.isNull(), unknown("none")).otherwise(let(let(inputs, both_ways), nearest))


#: What trained classifiers call the roles (fixed values).
LEARNED = {
    "primary": ("primary", "primary_person", "primary_dob", "primary_address", "primary_contact"),
    "secondary_person": ("secondary", "secondary_person", "related_person", "non_primary"),
    "non_target": ("non_target", "contextual", "organization", "unrelated"),
}


def learned_role(label: Column, probability: Column) -> Column:
    """The same from a trained classifier's class; null if it names none of the roles."""
    names = {name: role for role, all_of in LEARNED.items() for name in all_of}
    sure = F.when(F.coalesce(probability, F.lit(0.0)) == 0, 1.0).otherwise(probability)

    def made(role):
        score = F.round(F.when(role == "primary", sure).otherwise(-sure), 3)
        return F.when(role.isNotNull(), F.struct(role.alias("context_role"), F.lit("").alias("context_label"), score.alias("context_score"), F.lit("learned").alias("context_model")))

    return let(lookup(F.lower(label), names), made)


def contexts(candidates: Column, text: Column) -> Column:
    """What a trained classifier sees of each candidate; null without a place."""
    return F.transform(candidates, lambda c: F.when(c["start"].isNotNull(), clean(window_before(text, c["start"]))))


def with_context(candidates: Column, text: Column, predictions: Column | None = None) -> Column:
    """Candidates with their context's four fields: a trained classifier's, where
    it has said something, else those of the labels nearby."""
    fields = ["type", "value", "confidence", "source", "start", "end", "validated"]

    def add(c, said=None):
        found = role(c["type"], text, c["start"])
        if said is not None:
            found = F.when(c["start"].isNull(), found).otherwise(F.coalesce(learned_role(said["label"], said["probability"]), found))
        return let(found, lambda r: F.struct(*[c[f].alias(f) for f in fields], *[r[f].alias(f) for f in ("context_role", "context_label", "context_score", "context_model")]))

    if predictions is None:
        return F.transform(candidates, lambda c: add(c))
    # An argument of let(), as what a Python function gives can't be evaluated inside another function.
    return let(predictions, lambda p: F.transform(candidates, lambda c, i: add(c, F.try_element_at(p, i + 1))))


def keeps(kind: Column, role: Column) -> Column:
    """False for names of other persons and for dates, addresses, phones and e-mails of others."""
    kind = F.upper(kind)
    return ~((role == "secondary_person") & (kind == "NAME")) & ~((role == "non_target") & kind.isin(list(vocab.REJECTED_NON_TARGETS)))


def filter_roles(candidates: Column) -> Column:
    return F.filter(candidates, lambda c: keeps(c["type"], c["context_role"]))
