"""JSON, hashes and ids."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udfs import vectorized


def item_id(source: Column | str, kind: Column | str, native: Column) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.concat_ws(":", as_col(source), as_col(kind), native)


def sha_id(*parts: Column) -> Column:
    """SHA-256 of the parts with a zero byte between them."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def short_hash(value: Column, n: int) -> Column:
    return F.substring(F.sha2(value, 256), 1, n)


def incident_id(profile: Column, claim: Column) -> Column:
    """By profile and the claim's words, whatever their case, width and marks."""
    from .text import folded

    words = F.filter(F.split(folded(claim), "(?U)[^\\w]+"), lambda w: w != "")
    return F.concat(F.lit("incident-"), F.substring(F.sha2(F.concat(profile, F.lit("\0"), F.array_join(words, " ")), 256), 1, 20))


@vectorized("string")
def canonical(text: pd.Series) -> pd.Series:
    """JSON with sorted keys and no spaces; null if it isn't JSON or holds NaN."""

    def one(t):
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
        except (TypeError, ValueError):
            return None

    return text.map(one)


def _balanced(text: str) -> str | None:
    """The first object in the text that parses."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            value, end = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        if isinstance(value, dict):
            return text[m.start() : end]
    return None


@vectorized("string")
def _scanned(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else _balanced(t))


def salvaged(text: Column) -> Column:
    """The JSON in a model's answer: all of it, a fenced block, or the first object that parses; else null."""
    whole = F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), "^\\ufeff", "")
    fence = F.regexp_extract(whole, "(?s)```(?:json|JSON)?\\s*(.*?)\\s*```", 1)
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull() & x.rlike("^\\s*[\\{\\[]"), x)
    return F.coalesce(ok(whole), ok(fence), _scanned(whole))


def non_blank_blocks(blocks: Column) -> Column:
    return (F.size(blocks) > 0) & F.forall(blocks, lambda b: F.length(F.btrim(F.coalesce(b["content"], F.lit("")))) > 0)
