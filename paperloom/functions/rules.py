"""Rows against a closed set of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rules: dict[str, Column]) -> Column:
    """array<string>: the names of the rules that a row breaks; what can't be told is broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))


def column_problems(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """Columns that are missing, of another type, or not expected."""
    have = dict(df.dtypes)
    out = [f"missing: {c}" for c in expected if c not in have]
    out += [f"type of {c}: {have[c]}" for c, t in expected.items() if c in have and have[c] != t]
    return out + [f"unexpected: {c}" for c in have if c not in expected]
