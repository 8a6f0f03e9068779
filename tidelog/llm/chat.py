"""Conversations as training windows of a bounded number of tokens.

Every turn is written between marks and its text is escaped, so that no mark can occur in it: a backslash is doubled, and
each mark in a text gets a backslash after its first character. Reading undoes that.

Windows are chosen from prefix sums of the tokens of formatted turns. Turns are first dealt to blocks of a fixed number of
tokens by their prefix sum, which bounds what a task holds of a conversation of any length; inside a block, windows take
turns greedily while they fit. A window keeps the conversation's system turn (if its first turn is one), then repeats the
latest whole turns before it as history, up to a number of tokens, then has its own turns, the targets. Each turn is a
target once. The loss mask has the texts of assistant targets: those of repeated turns stay out.

A turn that does not fit beside the system turn stands alone, its window marked ``over_budget``; texts are never cut.

Edge cases: null role, null text: empty; null turn sorts first; null ``conv_id`` is one conversation; rows that repeat a turn
are turns, ordered by role and text; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.slices import carried, in_slices
from tidelog.llm.tokens import Encoder, tokenizer_path

BUDGET, HISTORY = 1024, 192
BLOCK_BUDGETS = 16

BEGIN, END = "<s>", "</s>"
ASKED, ASKED_END = "[INST]", "[/INST]"
SYSTEM, SYSTEM_END = "<<SYS>>", "<</SYS>>"
_MARKS = re.compile("|".join(map(re.escape, (BEGIN, END, ASKED, ASKED_END, SYSTEM, SYSTEM_END))))
_ROLE = re.compile(re.escape(BEGIN) + r"((?:[^\\\n]|\\.)*)\n", re.DOTALL)


def escape(text: str) -> str:
    return _MARKS.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its escaped text starts and ends in it."""
    open_, close = {"assistant": ("", ""), "system": (SYSTEM, SYSTEM_END)}.get(role, (f"{ASKED} ", f" {ASKED_END}"))
    head = BEGIN + escape(role).replace("\n", "\\\n") + "\n" + open_
    body = escape(text)
    return f"{head}{body}{close}{END}\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    turns, at = [], 0
    while at < len(formatted):
        found = _ROLE.match(formatted, at)
        role = unescape(found[1])
        open_, close = {"assistant": ("", ""), "system": (SYSTEM, SYSTEM_END)}.get(role, (f"{ASKED} ", f" {ASKED_END}"))
        start = found.end() + len(open_)
        end = formatted.index(close + END + "\n", start)
        turns.append((role, unescape(formatted[start:end])))
        at = end + len(close + END) + 1
    return turns


_WINDOWS = [
    ("conv_id", pa.int64()), ("block", pa.int64()), ("window", pa.int32()), ("text", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ("uses", pa.list_(pa.string())), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()),
]
WINDOWS = "conv_id bigint, block bigint, window int, text string, loss array<struct<start:int,end:int>>, uses array<string>, n_tokens bigint, over_budget boolean"


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """Formatted windows: conv_id, (block, window) in order, text, loss (spans of characters), uses (``system``, ``history``
    or ``target`` for each turn in the text), n_tokens and over_budget."""
    file = tokenizer or tokenizer_path()
    span = budget * BLOCK_BUDGETS

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.of(file, literal=True)
        for batch in batches:
            made = [format_turn(r, t) for r, t in zip(batch["role"], batch["text"])]
            batch["formatted"], batch["body"], batch["body_end"] = zip(*made) if made else ([], [], [])
            batch["n"] = [len(x) for x in encoder.encode_batch(batch["formatted"].tolist())]
            yield batch[["conv_id", "turn", "role", "text", "formatted", "body", "body_end", "n"]]

    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # Nulls would turn the integer columns of a pandas batch into floats: they are carried as the least number.
    rows = rows.na.fill(-(1 << 63), ["conv_id", "turn"])
    sized = rows.mapInPandas(measured, "conv_id bigint, turn bigint, role string, text string, formatted string, body int, body_end int, n bigint")
    sliced = in_slices(sized, ["conv_id"], ["turn", "role", "text"], "turns")
    inside = Window.partitionBy("conv_id", "_slice").orderBy("turn", "role", "text")
    earlier = carried(sliced, ["conv_id"], {"n": F.sum("n"), "turns": F.count("*")}, lambda k, w: F.coalesce(F.sum(k).over(w), F.lit(0)))
    placed = sliced.withColumns(
        {"_near": F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), "_rank": F.row_number().over(inside) - 1}
    ).join(earlier, ["conv_id", "_slice"])
    placed = placed.select(
        "conv_id", "role", "formatted", "body", "body_end", "n",
        (F.coalesce("_near", F.lit(0)) + F.col("_before_n")).alias("before"), (F.col("_rank") + F.col("_before_turns")).alias("pos"),
    ).withColumn("own", F.floor(F.col("before") / span))
    # A turn goes to its block, and to the next one if it may be history there.
    ahead = F.when(F.col("before") >= (F.col("own") + 1) * span - history, F.col("own") + 1)
    dealt = placed.withColumn("block", F.explode(F.array_compact(F.array("own", ahead))))
    blocks = dealt.filter("block = own").select("conv_id", "block").distinct()
    system = placed.filter("pos = 0 and role = 'system'").drop("own")
    kept = blocks.filter("block > 0").join(system, "conv_id").withColumn("own", F.lit(0).cast("long")).select(*dealt.columns)
    together = dealt.union(kept).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["conv_id"], row["block"]) != key:
                    out += _windows(group, key, budget, history)
                    group, key = [], (row["conv_id"], row["block"])
                if not group or group[-1]["pos"] != row["pos"]:  # the system turn may come as history and by itself
                    group.append(row)
            yield pa.RecordBatch.from_pylist(out, pa.schema(_WINDOWS))
        yield pa.RecordBatch.from_pylist(_windows(group, key, budget, history), pa.schema(_WINDOWS))

    made = together.mapInArrow(cut, WINDOWS)
    return made.withColumn("conv_id", F.when(F.col("conv_id") != -(1 << 63), F.col("conv_id")))


def _windows(group: list[dict], key: tuple | None, budget: int, history: int) -> list[dict]:
    """The windows of one block; ``group`` has its turns, those that may be history, and the system turn, in order."""
    first = next((k for k, t in enumerate(group) if t["own"] == key[1] and t["block"] == t["own"]), None)
    if first is None:
        return []
    system = group[0] if group[0]["pos"] == 0 and group[0]["role"] == "system" else None
    out, at = [], first
    while at < len(group):
        kept = [system] if system and group[at] is not system else []
        room = budget - sum(t["n"] for t in kept) - group[at]["n"]
        shown, back, most = [], at - 1, min(history, room)
        while back >= 0 and group[back] is not system and group[back]["pos"] == group[back + 1]["pos"] - 1 and group[back]["n"] <= most:
            shown.insert(0, group[back])
            most -= group[back]["n"]
            room -= group[back]["n"]
            back -= 1
        end = at + 1
        while end < len(group) and group[end]["n"] <= room:
            room -= group[end]["n"]
            end += 1
        text, loss, uses = "", [], []
        for use, turns in (("system", kept), ("history", shown), ("target", group[at:end])):
            for t in turns:
                if use == "target" and t["role"] == "assistant":
                    loss.append({"start": len(text) + t["body"], "end": len(text) + t["body_end"]})
                text += t["formatted"]
                uses.append(use)
        out.append(
            {"conv_id": key[0], "block": key[1], "window": len(out), "text": text, "loss": loss, "uses": uses, "n_tokens": budget - room, "over_budget": room < 0}
        )
        at = end
    return out


_DIGESTS = [
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
    ("formatted_chars", pa.int64()), ("n_windows", pa.int64()),
]


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, parsed from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    A digest over a conversation needs its turns in order: they stream through one task, a window at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None

        def ended() -> list[dict]:
            if state is None:
                return []
            return [{"conv_id": key, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4], "n_windows": state[5]}]

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != key or state is None:
                    out += ended()
                    key, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for use, (role, text) in zip(row["uses"], read_turns(row["text"]), strict=True):
                    if use == "target":
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode())
                for s in row["loss"]:
                    under = unescape(row["text"][s["start"] : s["end"]])
                    state[2] += len(under)
                    state[3].update(under.encode())
                state[4] += len(row["text"])
                state[5] += 1
            yield pa.RecordBatch.from_pylist(out, pa.schema(_DIGESTS))
        yield pa.RecordBatch.from_pylist(ended(), pa.schema(_DIGESTS))

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"
    return made.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window").mapInArrow(read, schema)
