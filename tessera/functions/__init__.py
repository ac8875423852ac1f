"""Scalar functions: column expressions for what the operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.operators.jsonkb import expand_synonyms, slug, tokens
from tessera.operators.temporal import decayed, quantised
from tessera.operators.vectors import dot, l2, power_mean

__all__ = ["clipped", "cross_name", "decayed", "dot", "expand_synonyms", "first_of_list", "l2", "power_mean", "quantised", "ratio", "seconds_of_day", "seconds_between", "signed_root", "slug", "suffix_match", "tokens"]


def clipped(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def ratio(a: Column, b: Column, guard: float = 1.0) -> Column:
    """a / (b + guard): never by zero for counts."""
    return a / (b + guard)


def signed_root(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def first_of_list(text: Column) -> Column:
    """The first entry of a list written as text, such as ['a', 'b']; null for an empty one."""
    inner = F.split(F.regexp_replace(text, r"[\[\]'\"]", ""), ",")[0]
    return F.when(F.trim(inner) != "", F.trim(inner))


def cross_name(a: Column, b: Column) -> Column:
    """An identity of two strings, told apart by the unit separator."""
    return F.concat_ws("\x1f", F.trim(F.lower(a)), F.trim(F.lower(b)))


def suffix_match(path: Column, dotted: str) -> Column:
    """Whether an array path ends in a dotted key."""
    parts = dotted.split(".")
    return (F.size(path) >= len(parts)) & (F.slice(path, -len(parts), len(parts)) == F.array(*[F.lit(p) for p in parts]))
