"""Chat formatting: whole conversations rendered, encoded once with offsets, and masked by binary search.

A turn is rendered as ``### role``, the character START, its text, the character END and a closing tag.
Control strings inside roles and texts are broken by backslashes, which are themselves escaped, so no text can
open or close a turn and every text comes back. A rendered conversation is encoded in one call that also tells
each token's characters; the sorted spans of the turns to learn from are met with the sorted spans of the tokens
by binary search, and tokens that meet one are under the loss mask.

START and END are bytes that no entry of the vocabulary joins with others, which is checked when it is
loaded, so no token lies across a turn's bounds. For that reason a long conversation may also be encoded in parts
cut between turns: they give the same tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import lean, small_batches

OPEN, START, END, CLOSE = "### ", "\x02", "\x03", "</turn>\n"
#: A backslash goes before a backslash, before a # between two of them, and before the slash of a closing tag; in roles also before the bounds of texts.
CONTROL = r"\\|(?<=#)#(?=#)|(?<=<)/(?=turn>)"
CONTROL_OF_ROLE = CONTROL + r"|[\x02\x03]"
_TURN = re.compile(rf"{OPEN}((?:[^\\{START}]|\\.)*){START}(.*?){END}{CLOSE}", re.S)
#: Characters of a part of a conversation; a turn that is longer is a part by itself.
PART = 1 << 18
FORMATTED = "conv_id long, part long, n_turns long, formatted string, token_ids array<int>, loss_mask array<byte>"


def escaped(text: Column, control: str = CONTROL) -> Column:
    """``text`` with control strings broken, reversibly."""
    return F.regexp_replace(text, control, r"\\$0")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer of a file, special strings being ordinary text; one per process."""
    import os

    from tokenizers import Tokenizer, pre_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
    # a byte-level vocabulary writes the bytes 0 to 32 as the characters from U+0100 on
    for bound in (START, END):
        mark = chr(0x100 + ord(bound))
        if mark not in alphabet or any(mark in piece and piece != mark for piece in found.get_vocab()):
            raise ValueError("the vocabulary joins a bound of texts with other bytes, so tokens could lie across it")
    return found


def spans_met(first: np.ndarray, last: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of the spans [first, last) share a character with one of the sorted, disjoint spans [starts, stops)."""
    if not len(starts):
        return np.zeros(len(first), bool)
    at = np.searchsorted(stops, first, side="right")  # the first span that ends after the token begins
    known = at < len(starts)
    return known & (starts[np.minimum(at, len(starts) - 1)] < last) & (first < last)


def encoded(text: str, starts: np.ndarray, stops: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a rendered text, and the mask of those that meet one of the spans."""
    made = load(path).encode(text, add_special_tokens=False)
    at = np.array(made.offsets, np.int64).reshape(-1, 2)
    return np.array(made.ids, np.int32), spans_met(at[:, 0], at[:, 1], starts, stops).astype(np.int8)


def _parts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Sorted turns ``(conv_id, task, head, text, learned)`` to parts of conversations."""
    now, held, size, part = object(), [], 0, 0

    def told():
        text, spans, at = [], [], 0
        for head, body, learned in held:
            at += len(head)
            if learned and body:
                spans.append((at, at + len(body)))
            text += [head, body, END + CLOSE]
            at += len(body) + len(END + CLOSE)
        text = "".join(text)
        starts, stops = np.array(spans, np.int64).reshape(-1, 2).T
        ids, mask = encoded(text, starts, stops, path)
        return now[0], (now[1] << 40) + part, len(held), text, ids, mask

    def batch(rows):
        conv, part, n, text, ids, mask = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(part, pa.int64()), pa.array(n, pa.int64()), pa.array(text, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(mask, pa.list_(pa.int8()))], ["conv_id", "part", "n_turns", "formatted", "token_ids", "loss_mask"])

    done, waiting = [], 0
    for b in batches:
        for conv, task, head, body, learned in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if held and (now[0] != conv or size + len(body) > PART):
                done.append(told())
                waiting += size
                part = part + 1 if now[0] == conv else 0
                held, size = [], 0
            now = conv, task
            held.append((head, body, learned))
            size += len(head) + len(body)
            if waiting > PART:
                yield batch(done)
                done, waiting = [], 0
    if held:
        done.append(told())
    if done:
        yield batch(done)


def formatted(turns: DataFrame, path: str, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: str = "assistant") -> DataFrame:
    """A row for each part of a conversation (one, unless it is long): ``(conv_id, part, n_turns, formatted, token_ids, loss_mask)``.

    Turns go by ``turn_col``, equal ones by role and text, nulls first. A null text or role is an empty one; turns with a
    null conversation are one conversation, whose id is null. Rows that repeat are turns of their own. The loss mask has a 1
    for each token of a text whose role is ``learned``. Other columns aren't read. Turns are dealt out by ranges of
    (conversation, turn), so a conversation of any length is several tasks' and ``part`` ascends with its turns.
    """
    small_batches(turns.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("t"), role.alias("r"), text.alias("x"))
    # a prefix sorts like the text, and is short enough for the sample that ranges come from
    dealt = rows.repartitionByRange(F.col("c"), F.col("t"), F.col("r"), F.substring("x", 1, 32))
    ordered = dealt.sortWithinPartitions("c", "t", "r", "x")
    head = F.concat(F.lit(OPEN), escaped(F.col("r"), CONTROL_OF_ROLE), F.lit(START))
    made = ordered.select("c", F.spark_partition_id().cast("long").alias("task"), head.alias("head"), escaped(F.col("x")).alias("body"), (F.col("r") == learned).alias("learned"))
    return made.mapInArrow(lambda batches: lean(_parts(batches, path)), FORMATTED)


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; what isn't one as a whole is an error."""
    found, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        found.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("not a formatted conversation")
    return found


def learned_text(ids: np.ndarray, mask: np.ndarray, path: str) -> str:
    """What the tokens under the mask say, unescaped; runs of them are taken by themselves."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask != 0, [0]]).astype(np.int8)))
    model = load(path)
    return "".join(unescaped(model.decode(ids[i:j].tolist(), skip_special_tokens=False)) for i, j in edges.reshape(-1, 2))


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Parts sorted by conversation to a row each; hashes go on from part to part, so none is held."""
    now, state, out = object(), None, []

    def told():
        out.append((now, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"]))

    def batch():
        rows = list(zip(*out, strict=True))
        out.clear()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for b in batches:
        for i in range(b.num_rows):
            conv, text = b.column(0)[i].as_py(), b.column(1)[i].as_py()
            if state is None or conv != now:
                if state:
                    told()
                now, state = conv, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
            for role, said in turns_of(text):
                state["n"] += 1
                state["turns"].update(f"{role}\n{said}\n".encode())
            ids, mask = (b.column(k)[i].values.to_numpy() for k in (2, 3))
            loss = learned_text(ids, mask, path)
            state["chars"] += len(loss)
            state["loss"].update(loss.encode())
            state["size"] += len(text)
        if len(out) > 1000:
            yield batch()
    if state:
        told()
    if out:
        yield batch()


def read_back(parts: DataFrame, path: str) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from formatted parts alone: roles and texts from the rendered text, the loss from the tokens under the mask.

    A hash over a whole conversation is taken in order, so its parts pass one task, one after the other; none is held.
    """
    small_batches(parts.sparkSession)
    rows = parts.select("conv_id", "formatted", "token_ids", "loss_mask", "part").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(lambda batches: lean(_digests(batches, path)), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
