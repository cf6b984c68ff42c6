"""Array helpers that evaluate inside one row, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda variable is computed a single time, while a plain column used
    inside another lambda would be recomputed for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(s: Column, term: Callable[[Column], Column], entry: Callable[[Column, Column], Column]) -> Column:
    """One ``entry(first element, count)`` per run of equal terms in a sorted array."""
    starts = F.filter(
        F.transform(s, lambda _, i: i), lambda i: (i == 0) | (term(F.get(s, i)) != term(F.get(s, i - 1))))
    return let(
        starts,
        lambda b: F.transform(b, lambda at, k: entry(F.get(s, at), F.coalesce(F.get(b, k + 1), F.size(s)) - at)))


def term_counts(terms: Column) -> Column:
    """``array<struct<term, n>>``: the count of each distinct term.  Sorting makes equal terms adjacent."""
    return let(
        F.sort_array(terms),
        lambda s: _runs(s, lambda e: e, lambda e, n: F.struct(e.alias("term"), n.alias("n"))))


def first_of_runs(entries: Column, field: str) -> Column:
    """The smallest entry of each value of ``field``, which must be the first field of the structs."""
    return let(F.sort_array(entries), lambda s: _runs(s, lambda e: e[field], lambda e, n: e))


def ranked_terms(terms: Column, k: int) -> Column:
    """The ``k`` most frequent terms, ties by first position."""
    placed = F.sort_array(F.transform(terms, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    counted = let(
        placed,
        lambda s: _runs(
            s, lambda e: e["t"], lambda e, n: F.struct((-n).alias("neg_n"), e["i"].alias("pos"), e["t"].alias("term"))))
    return F.transform(F.slice(F.sort_array(counted), 1, k), lambda e: e["term"])


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs joined by one blank."""
    return let(
        tokens,
        lambda t: F.when(
            F.size(t) > 1,
            F.zip_with(
                F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))),
                F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))),
                lambda a, b: F.concat_ws(" ", a, b),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )


def argmax_entry(scores: Column) -> Column:
    """Key of the largest map value; the alphabetically first key on ties."""
    entries = F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    return F.get(F.sort_array(entries), F.lit(0))["k"]


def entries_by_value(scores: Column) -> Column:
    """Map entries as ``array<struct<v, k>>`` with ``v`` negated, largest value first."""
    return F.sort_array(
        F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    )
