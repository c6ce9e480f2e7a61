"""Message templates compiled to column expressions.

``#{name}`` is replaced by a value, ``#{name?limit=N&split=D}`` by as many of its segments as fit in N characters, the first always.
A template is parsed once, when it is compiled; what it became is literals and columns, so no value is ever read as a template,
and no Python runs for a row. In a tree of dictionaries and lists every string is a template, and what is put in is escaped as JSON.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.text_packing import truncated_segments
from .text import details_to_markdown

_PLACEHOLDER = re.compile(r"#\{(\w+)(?:\?(\w+=[^}]+))?\}")
#: What divides a value into segments where a placeholder doesn't say, and the kinds of bodies.
SEGMENTS, FORM, JSON = "---", "application/x-www-form-urlencoded", "application/json"


def _parts(template: str, values: dict[str, Column]) -> list[str | Column]:
    out, at = [], 0
    for m in _PLACEHOLDER.finditer(template):
        value = values.get(m[1])
        if value is None:
            continue
        asked = dict(p.split("=", 1) for p in (m[2] or "").split("&") if "=" in p)
        limit, split = int(asked.get("limit", 0)), asked.get("split", SEGMENTS)
        text = value.cast("string")
        made = truncated_segments(text, limit, split) if limit and split else text
        out += [template[at : m.start()], F.coalesce(made, F.lit(m[0]))]  # without a value it stays as it is
        at = m.end()
    return [p for p in [*out, template[at:]] if not isinstance(p, str) or p]


def _joined(parts: list[str | Column]) -> Column:
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat(*columns) if len(columns) > 1 else columns[0] if columns else F.lit("")


def compiled(template: str, values: dict[str, Column]) -> Column:
    """A text with its placeholders replaced; unknown ones and those whose value is null stay."""
    return _joined(_parts(template, values))


def _json_text(x: Column) -> Column:
    whole = F.to_json(F.array(x))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _tree(template: Any, values: dict[str, Column]) -> list[str | Column]:
    if isinstance(template, str):
        parts = _parts(template, values)
        return [json.dumps("".join(parts), ensure_ascii=False)] if all(isinstance(p, str) for p in parts) else [_json_text(_joined(parts))]
    if isinstance(template, dict):
        inside = [[json.dumps(str(k), ensure_ascii=False) + ": ", *_tree(v, values)] for k, v in template.items()]
        ends = "{}"
    elif isinstance(template, list):
        inside, ends = [_tree(v, values) for v in template], "[]"
    else:
        return [json.dumps(template)]
    out: list[str | Column] = [ends[0]]
    for k, parts in enumerate(inside):
        out += [", "] * bool(k) + parts
    return [*out, ends[1]]


def compiled_json(template: dict | list, values: dict[str, Column]) -> Column:
    """A tree as JSON text, every string in it a template; names, numbers, truth values and nulls stay."""
    parts: list[str | Column] = []
    for p in _tree(template, values):
        if parts and isinstance(p, str) and isinstance(parts[-1], str):
            parts[-1] += p
        else:
            parts.append(p)
    return _joined(parts)


def body(template: str | dict | list | None, values: dict[str, Column]) -> Column:
    """``(content, content_type)`` of a request; a summary goes in without its HTML. Without a template there is no content."""
    if not template or isinstance(template, str) and not template.strip():
        return F.struct(F.lit(None).cast("string").alias("content"), F.lit(FORM).alias("content_type"))
    if "summary" in values:
        values = values | {"summary": details_to_markdown(values["summary"].cast("string"))}
    if isinstance(template, str):
        made = compiled(template, values)
        return F.struct(made.alias("content"), F.when(made.rlike("^\\s*[\\[{]") & F.try_parse_json(made).isNotNull(), JSON).otherwise(FORM).alias("content_type"))
    return F.struct(compiled_json(template, values).alias("content"), F.lit(JSON).alias("content_type"))
