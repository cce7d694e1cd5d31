"""Formulas inside sentences: runs of symbols that are taken out and numbered. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What makes a unit part of a formula. Strong units show one, weak ones and glue only go on with one.
STRONG = r"[\p{Sm}\p{InGreek}^_#*$%&|<>]"
GLUE = r"(?:[-+/=,;:]|\d+(?:[.,]\d+)*|\p{L})"

_UNIT = rf"[^\s\[\]]*{STRONG}[^\s\[\]]*"
_RUN = rf"{_UNIT}(?:\s+(?:{_UNIT}|{GLUE}(?=\s+(?:{GLUE}\s+)*{_UNIT})))*"


def formulas(text: Column) -> Column:
    """array<string>: runs that begin and end with a strong unit and hold two of them or more, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit(_RUN), 0), lambda r: F.regexp_count(r, F.lit(_UNIT)) >= 2)


def replaced(text: Column) -> Column:
    """The text with its formulas as [EQ_1], [EQ_2], ..."""
    start = F.struct(F.lit("").alias("done"), text.alias("rest"), F.lit(1).alias("n"))

    def step(acc: Column, run: Column) -> Column:
        at = F.instr(acc["rest"], run)
        done = F.concat(acc["done"], F.substring(acc["rest"], F.lit(1), at - 1), F.lit("[EQ_"), acc["n"].cast("string"), F.lit("]"))
        rest = F.substring(acc["rest"], at + F.length(run), F.length(acc["rest"]))
        return F.struct(done.alias("done"), rest.alias("rest"), (acc["n"] + 1).alias("n"))

    return F.aggregate(formulas(text), start, step, lambda acc: F.concat(acc["done"], acc["rest"]))
