"""Replacement of phrases by a table, the longest match first, in one pass: traditional to simplified characters, or any other table."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column

from .udfs import vectorized


def trie(phrases) -> dict:
    """Phrases by their characters; the empty key marks an end."""
    root: dict = {}
    for p in phrases:
        node = root
        for c in p:
            node = node.setdefault(c, {})
        node[""] = {}
    return root


def pattern(node: dict) -> str:
    """A regular expression of a trie that matches the longest phrase: what goes on is tried before an end is taken."""
    more = sorted(k for k in node if k)
    single = [c for c in more if not set(node[c]) - {""}]
    ways = [re.escape(c) + pattern(node[c]) for c in more if c not in single]
    if single:
        ways.append(re.escape(single[0]) if len(single) == 1 else "[" + "".join(map(re.escape, single)) + "]")
    if not ways:
        return ""
    joined = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
    return joined + ("?" if "" in node else "")


@lru_cache(maxsize=8)
def _compiled(table: tuple[tuple[str, str], ...]) -> tuple[re.Pattern, dict[str, str]]:
    known = dict(table)
    return re.compile(pattern(trie(known)) if known else r"(?!)"), known


def replaced(text: str, table: tuple[tuple[str, str], ...]) -> str:
    found, known = _compiled(table)
    return found.sub(lambda m: known[m[0]], text)


def with_phrases(text: Column, phrases: dict[str, str], characters: dict[str, str] | None = None) -> Column:
    """``text`` read once from its start: at each place the longest of ``phrases`` and ``characters`` is replaced, a phrase before an equal character.

    What was put in isn't read again. Empty keys are an error; null stays null.
    """
    table = tuple(sorted(((characters or {}) | phrases).items()))
    if any(not k for k, _ in table):
        raise ValueError("an empty phrase")

    @vectorized("string")
    def over(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else replaced(t, table))

    return over(text)


def normalized_script(text: Column, language: str, phrases: dict[str, str], characters: dict[str, str]) -> Column:
    """Text of the language ``zh`` in simplified characters by the given tables; of other languages as it is."""
    return with_phrases(text, phrases, characters) if language.lower() == "zh" else text
