"""Probability algebra on arrays and maps: softmax, checks, argmax, JSON."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-6
TIE = "mixed_tie"


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column) -> Column:
    """Shifted by the largest value; null where a value is null or not finite."""
    finite = F.forall(logits, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.when(finite & (F.size(logits) > 0), F.transform(powers, lambda p: p / total(powers)))


def is_distribution(values: Column) -> Column:
    """Finite, between 0 and 1, and adding up to 1."""
    each = F.forall(values, lambda p: p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p <= 1))
    return F.coalesce((F.size(values) > 0) & each & (F.abs(total(values) - 1) <= TOLERANCE), F.lit(False))


def first_largest(values: Column, labels: tuple[str, ...]) -> Column:
    """The label of the largest value, the first one where several are."""
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(values, F.array_max(values)).cast("int"))


def sole_largest(values: Column, labels: tuple[str, ...]) -> Column:
    """The label of the largest value, or TIE where several are."""
    many = F.size(F.filter(values, lambda x: x == F.array_max(values)))
    return F.when(many > 1, F.lit(TIE)).otherwise(first_largest(values, labels))


def margin(probabilities: Column, up: str, down: str) -> Column:
    """One class's probability less another's."""
    return probabilities[up] - probabilities[down]


def from_logits(labels: tuple[str, ...], probabilities: Column) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, labels)), probabilities)


def encode(probabilities: Column) -> Column:
    """JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(probabilities))))


def decode(text: Column, labels: tuple[str, ...], guard: Column | None = None) -> dict[str, Column]:
    """A column for each label, null where ``guard`` fails, the JSON is broken or a label is missing."""
    parsed = F.from_json(text, "map<string,double>")
    whole = F.forall(F.array(*map(F.lit, labels)), lambda k: F.map_contains_key(parsed, k) & parsed[k].isNotNull())
    ok = F.coalesce(whole & (guard if guard is not None else F.lit(True)), F.lit(False))
    return {k: F.when(ok, parsed[k]) for k in labels}


def decode_lenient(text: Column) -> Column:
    """For display: nothing and broken JSON are an empty map."""
    return F.coalesce(F.from_json(F.nullif(text, F.lit("")), "map<string,double>"), F.create_map().cast("map<string,double>"))


def normalised_labels(probabilities: Column, aliases: dict[str, str]) -> Column:
    """Keys replaced by their standard names; values of keys with the same name are added."""
    named = F.transform(F.map_entries(probabilities), lambda e: F.struct(F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)), F.lower(F.trim(e["key"]))), F.lower(F.trim(e["key"]))).alias("key"), e["value"].alias("value")))
    keys = F.array_distinct(F.transform(named, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: total(F.transform(F.filter(named, lambda e: e["key"] == k), lambda e: e["value"]))))


def regrouped(probabilities: Column, groups: dict[str, str], order: tuple[str, ...]) -> Column:
    """Probabilities of the classes in ``order``, summed over the labels that ``groups`` gives each and made to add
    up to 1; labels of no group are left out, and without any all are 0."""
    sums = [reduce(add, (F.coalesce(probabilities[k], F.lit(0.0)) for k, g in groups.items() if g == name), F.lit(0.0)) for name in order]
    whole = reduce(add, sums)
    return F.map_from_arrays(F.array(*map(F.lit, order)), F.array(*(F.when(whole > 0, s / whole).otherwise(F.lit(0.0)) for s in sums)))
