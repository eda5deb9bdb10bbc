"""Which documents are ambiguous enough for an LLM, as predicates on their entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formsift import vocab
from formsift.functions.text import let

OTHERS = ("secondary_person", "non_target")


def _role(e: Column) -> Column:
    return F.coalesce(e["context_role"], F.lit("unknown"))


def _score(e: Column) -> Column:
    return F.coalesce(e["context_score"], F.lit(0.0))


def low_confidence(entities: Column) -> Column:
    return F.exists(entities, lambda e: (_role(e) != "non_target") & (F.coalesce(e["confidence"], F.lit(0.0)) < 0.70) & (_score(e) <= 0))


def unresolved(entities: Column) -> Column:
    return F.exists(entities, lambda e: (_role(e) == "unknown") & (F.coalesce(e["confidence"], F.lit(0.0)) < 0.80) & (_score(e) <= 0))


def conflicts(entities: Column) -> Column:
    """Types, in order of first sight, with several values that matter: for
    identity numbers any two, for others two with a label of their own."""
    value = lambda e: F.lower(F.trim(e["value"]))
    real = F.filter(entities, lambda e: (F.upper(e["type"]) != "") & (value(e) != ""))

    def clash(kind, all_of):
        mine = F.filter(all_of, lambda e: F.upper(e["type"]) == kind)
        meant = F.filter(mine, lambda e: ~_role(e).isin(*OTHERS))
        strong = F.size(F.filter(meant, lambda e: _score(e) > 0)) > 1
        return (F.size(F.array_distinct(F.transform(mine, value))) > 1) & (F.size(meant) > 1) & (kind.isin(list(vocab.SINGLE_ID_TYPES)) | strong)

    return let(real, lambda a: F.filter(F.array_distinct(F.transform(a, lambda e: F.upper(e["type"]))), lambda k: clash(k, a)))


def name_ambiguity(entities: Column) -> Column:
    names = F.filter(entities, lambda e: (F.upper(e["type"]) == "NAME") & ~_role(e).isin(*OTHERS))
    return let(names, lambda n: (F.size(n) > 1) & (F.size(F.filter(n, lambda e: _role(e) == "primary")) != 1))


def needs_llm(entities: Column) -> Column:
    return low_confidence(entities) | (F.size(conflicts(entities)) > 0) | name_ambiguity(entities) | unresolved(entities)
