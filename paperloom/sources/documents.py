"""JSON documents: checked reads, canonical form, and what can be saved of truncated ones."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def read_state(raw: Column, schema: str, sha256: Column | None = None) -> Column:
    """not_found, hash_mismatch, invalid_json, schema_mismatch or ok."""
    parsed = F.from_json(raw, schema)
    fields = [f.split(":")[0].split()[0] for f in schema.split(",")]
    whole = F.try_parse_json(raw)
    good = parsed.isNotNull()
    for name in fields:
        good = good & parsed[name].isNotNull()
    state = F.when(raw.isNull(), "not_found")
    if sha256 is not None:
        state = state.when(F.sha2(raw, 256) != sha256, "hash_mismatch")
    return state.when(whole.isNull(), "invalid_json").when(~good, "schema_mismatch").otherwise("ok")


def canonical(raw: Column) -> Column:
    """Keys in order at every depth, indented by two; null for what is no JSON."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for r in rows:
            try:
                out.append(None if r is None else json.dumps(json.loads(r), sort_keys=True, indent=2, ensure_ascii=False))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(raw)


def _complete(text: str, key: str) -> list[str]:
    """The whole objects at the head of the array `key` of a JSON object that may break off."""
    decoder = json.JSONDecoder()
    at = len(text) - len(text.lstrip())
    if text[at : at + 1] != "{":
        return []
    at += 1
    skip = lambda k: next((i for i in range(k, len(text)) if text[i] not in " \t\r\n,"), len(text))
    try:
        while True:
            name, at = decoder.raw_decode(text, skip(at))
            at = skip(at)
            if not isinstance(name, str) or text[at : at + 1] != ":":
                return []
            at = skip(at + 1)
            if name == key:
                break
            _, at = decoder.raw_decode(text, at)
    except ValueError:
        return []
    found: list[str] = []
    if text[at : at + 1] != "[":
        return found
    at += 1
    while text[(at := skip(at)) : at + 1] == "{":
        try:
            _, end = decoder.raw_decode(text, at)
        except ValueError:
            break
        found.append(text[at:end])
        at = end
    return found


def salvaged(raw: Column, key: str) -> Column:
    """array<string>: the whole items of an array in JSON that breaks off."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([[] if r is None else _complete(r, key) for r in rows])

    return run(raw)
