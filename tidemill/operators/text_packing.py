"""Order-dependent folds over one row's array: packing, truncation, captions. Sizes are a document's, not the corpus's."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.udfs import let, vectorized

#: Characters of a headline message; floor and ceiling of a spoken chunk.
HEADLINE_CHARS, MIN_CHUNK, MAX_CHUNK = 3900, 120, 400


def packed_lines(lines: Column, limit: int = HEADLINE_CHARS, joint: str = "\n") -> Column:
    """Lines in messages of at most ``limit`` characters, greedily; a longer line is a message by itself."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, line: Column) -> Column:
        fits = F.length(acc["open"]) + len(joint) + F.length(line) <= limit
        none = acc["open"].isNull()
        done = F.when(none | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        opened = F.when(none, line).when(fits, F.concat(acc["open"], F.lit(joint), line)).otherwise(line)
        return F.struct(done.alias("done"), opened.alias("open"))

    return F.aggregate(lines, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def truncated_segments(text: Column, limit: int, separator: str) -> Column:
    """Whole segments until the limit; the first always stays."""
    start = F.struct(F.lit(None).cast("string").alias("s"), F.lit(False).alias("full"))

    def step(acc: Column, part: Column) -> Column:
        longer = F.concat(acc["s"], F.lit(separator), part)
        over = acc["full"] | (F.length(longer) > limit)
        return F.when(acc["s"].isNull(), F.struct(part.alias("s"), F.lit(False).alias("full"))).otherwise(F.struct(F.when(over, acc["s"]).otherwise(longer).alias("s"), over.alias("full")))

    return F.aggregate(F.split(text, re.escape(separator)), start, step, lambda acc: acc["s"])


def sampled_frames(frames: Column, limit: int) -> Column:
    """Evenly spaced, first and last included; half steps round to even."""
    if limit <= 1:
        return F.slice(frames, 1, max(0, limit))
    step = (F.size(frames) - 1) / F.lit(limit - 1)
    return F.when(F.size(frames) <= limit, frames).otherwise(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.element_at(frames, (F.bround(i * step) + 1).cast("int"))))


_SENTENCE_END = re.compile(r"(?<=[.!?…])\s+")


def _sentences(text: str) -> list[str]:
    """Sentences in order; none runs over an empty line, and a line's end within one is a space."""
    out, paragraph = [], []
    for line in [*text.splitlines(), ""]:
        if line.strip():
            paragraph.append(line.strip())
        elif paragraph:
            out += _SENTENCE_END.split(" ".join(paragraph))
            paragraph = []
    return out


def _filled(ends: list[int], limit: float) -> list[int]:
    """Bounds of pieces, each filled before the next is begun.

    A piece takes sentences while it stays within ``limit``, or as long as what it has is under the floor; never beyond the
    ceiling, but one sentence at least. ``ends[j] - ends[i] - 1`` is the size of sentences ``i`` to ``j``, so where a piece ends is
    found by bisection.
    """
    bounds, last = [0], len(ends) - 1
    while bounds[-1] < last:
        base = ends[bounds[-1]] + 1
        within = bisect_right(ends, base + min(limit, MAX_CHUNK)) - 1
        above_floor = bisect_left(ends, base + MIN_CHUNK)
        most = bisect_right(ends, base + MAX_CHUNK) - 1
        bounds.append(min(last, max(bounds[-1] + 1, min(most, max(within, above_floor)))))
    return bounds


def _spoken_chunks(text: str) -> list[str]:
    """Whole sentences in pieces of even sizes.

    Filling to the ceiling says how many pieces there must be; filling again to an even share of that number evens them out, up to
    three times until the number stays. A last piece under the floor joins the one before it, or else takes over sentences from
    its end, while that one keeps to the floor.
    """
    sentences = _sentences(text)
    if not sentences:
        return []
    ends = [0, *accumulate(len(s) + 1 for s in sentences)]
    bounds, before = _filled(ends, MAX_CHUNK), 0
    for _ in range(3):
        if before == len(bounds):
            break
        before, bounds = len(bounds), _filled(ends, (ends[-1] - 1) / (len(bounds) - 1))
    size = lambda i, j: ends[j] - ends[i] - 1
    if len(bounds) > 2 and size(*bounds[-2:]) < MIN_CHUNK:
        first, cut, last = bounds[-3:]
        if size(first, last) <= MAX_CHUNK:
            del bounds[-2]
        else:
            for to in range(cut - 1, first, -1):
                if size(cut, last) >= MIN_CHUNK or size(first, to) < MIN_CHUNK:
                    break
                if sentences[to - 1][-1] in ".!?…":  # what no stop ends isn't told from what follows it
                    cut = to
            bounds[-2] = cut
    return [" ".join(sentences[i:j]) for i, j in pairwise(bounds)]


@vectorized("array<string>")
def spoken_chunks(text: pd.Series) -> pd.Series:
    """Chunks for speech: whole sentences, of even sizes between floor and ceiling where sentences allow it."""
    return text.map(lambda t: None if t is None else _spoken_chunks(t))


def _repeated(before: Column, text: Column) -> Column:
    """Characters at the start of ``text`` that ``before`` ends with, at most; under six only whole words."""

    def fits(k: Column) -> Column:
        first, last = F.substring(before, F.length(before) - k, F.lit(1)), F.substring(text, k + 1, F.lit(1))
        words = ((k == F.length(before)) | (first == " ")) & ((k == F.length(text)) | (last == " "))
        return before.endswith(F.substring(text, F.lit(1), k)) & ((k >= 6) | words)

    most = F.least(F.length(before), F.length(text))
    return F.coalesce(F.array_max(F.filter(F.when(most > 0, F.sequence(F.lit(1), most)), fits)), F.lit(0))


def rolled_captions(segments: Column) -> Column:
    """Rolling captions ``(start, end, text)`` without what they repeat.

    One that is the same as the last, or that ends up empty, makes the last longer; one that begins with the whole
    last and a space takes its place; of another, what the last ends with is cut off. Null gives null.
    """
    made = "struct<start:double,end:double,text:string>"
    caption = lambda start, end, text: F.struct(start.cast("double").alias("start"), end.cast("double").alias("end"), text.alias("text"))
    state = lambda done, last: F.struct(done.alias("done"), last.alias("last"))

    def step(acc: Column, s: Column) -> Column:
        done, last, text = acc["done"], acc["last"], s["text"]
        longer, replaced = caption(last["start"], s["end"], last["text"]), caption(last["start"], s["end"], text)
        new = F.trim(F.substring(text, _repeated(last["text"], text) + 1, F.length(text)))
        apart = let(new, lambda rest: F.when(rest == "", state(done, longer)).otherwise(state(F.concat(done, F.array(last)), caption(s["start"], s["end"], rest))))
        return F.when(last.isNull(), state(done, caption(s["start"], s["end"], text))).when(text == last["text"], state(done, longer)).when(text.startswith(F.concat(last["text"], F.lit(" "))), state(done, replaced)).otherwise(apart)

    start = state(F.array().cast(f"array<{made}>"), F.lit(None).cast(made))
    return F.aggregate(segments, start, step, lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))))
