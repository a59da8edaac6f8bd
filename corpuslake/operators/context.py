"""Context assembly under a budget, and deterministic routing. Ordered lists are arrays of ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def take(ids: Column, n: Column | int) -> Column:
    """The first n of an array; none for n below 1."""
    count = n if isinstance(n, Column) else F.lit(n)
    return F.slice(ids, F.lit(1), F.greatest(count, F.lit(0)))


def union(*lists: Column) -> Column:
    """Ordered union: the first occurrence of each element stays."""
    return F.array_distinct(F.concat(*lists))


def assemble(explicit: Column, semantic: Column, rules: Column, autos: Column, k: Column | int) -> Column:
    """Ids in order, at most k, none twice.

    Explicit rows come first but leave one slot for semantic ones if there are any and k > 1.
    Semantic rows fill up to k, less one slot while a rule row waits; rule rows come next, then
    semantic rows again, then what is left of the automatic ones."""
    k = k if isinstance(k, Column) else F.lit(k)

    def add(chosen: Column, more: Column, limit: Column) -> Column:
        return F.concat(chosen, take(F.array_except(more, chosen), limit - F.size(chosen)))

    chosen = take(F.array_distinct(explicit), F.when((F.size(semantic) > 0) & (k > 1), k - 1).otherwise(k))
    waiting = F.size(F.array_except(rules, chosen)) > 0
    chosen = add(chosen, semantic, F.when(waiting & (k > 1), k - 1).otherwise(k))
    for more in (rules, semantic, autos):
        chosen = add(chosen, more, k)
    return chosen


def complete_family(context: Column, family: Column, cap: Column | int) -> Column:
    """The context and up to cap rows of the family that it lacks; nothing is evicted."""
    return F.concat(context, take(F.array_except(F.array_distinct(family), context), cap))


def is_hard(cards: Column, keywords: Column) -> Column:
    return (cards >= 2) | ((cards >= 1) & (keywords >= 2))


def routed(flag: Column, hard: Column) -> Column:
    """The routing gate: what production and probes both ask."""
    return flag & hard


def card_count(autos: Column, mentions: Column, ambiguous: Column) -> Column:
    """Names of a question: the distinct detected and mentioned ones, and those that could be several."""
    return F.size(F.array_union(autos, mentions)) + ambiguous


def needs_scaffold(question: Column, cards: Column) -> Column:
    return (cards >= 2) | question.rlike(r"(?iU)\b(?:if|then|simultaneously|whenever|at the same time)\b")


def confidence(best: Column, cited: Column, exact: Column) -> Column:
    """1 on an exact match, 0 without citations, else the best similarity to 4 places (half to even)."""
    return F.when(cited == 0, 0.0).when(exact, 1.0).otherwise(F.bround(F.coalesce(best, F.lit(0.0)), 4))
