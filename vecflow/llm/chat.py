"""Chat formatting by a grammar round trip: render, reparse, compare, escape what conflicts until both are equal."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vecflow.llm.common import column, map_batches

# fixed values: the control strings of the template, opening and closing, per role
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
OTHER, SAYS, END_OTHER = "[ROLE]", "[SAYS]", "[/ROLE]"  # any other role: its name, then its text

_STRINGS = [x for pair in MARKS.values() for x in pair] + [OTHER, SAYS, END_OTHER]
_TAILS = "|".join(re.escape(x[1:]) for x in _STRINGS)
CONTROL = re.compile("|".join(map(re.escape, _STRINGS)))
SITE = re.compile(rf"([<\[])(\\*)({_TAILS})")  # a control string, with any backslashes behind its bracket
MARKED = re.compile(rf"([<\[])\\(\\*)({_TAILS})")
ROLES = {opening: role for role, (opening, _) in MARKS.items()}

Turn = tuple[str, str]


def escape(text: str) -> str:
    """One backslash more behind the bracket of every control string; ``unescape`` takes it away again."""
    return SITE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return MARKED.sub(r"\1\2\3", text)


def render(turns: list[Turn], escaped: set[int]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the places of the assistants' texts in it; turns in ``escaped`` are escaped."""
    parts, loss, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        change = escape if i in escaped else str
        opening, closing = MARKS.get(role) or (f"{OTHER} {change(role)} {SAYS}", END_OTHER)
        body = change(text)
        parts.append(f"{opening} {body} {closing}")
        if role == "assistant":
            start = at + len(opening) + 1
            loss.append((start, start + len(body)))
        at += len(parts[-1]) + 1
    return "\n".join(parts), loss


def parse(formatted: str) -> list[Turn] | None:
    """The turns of a formatted text; None if it isn't in the grammar ``turn ("\\n" turn)*``."""
    turns: list[Turn] = []
    marks = [(m[0], m.start(), m.end()) for m in CONTROL.finditer(formatted)]
    at = i = 0
    while i < len(marks):
        opening, start, end = marks[i]
        if formatted[at:start] != ("\n" if turns else ""):
            return None
        if opening == OTHER:
            if i + 1 >= len(marks) or marks[i + 1][0] != SAYS:
                return None
            name, closing = formatted[end : marks[i + 1][1]], END_OTHER
            if len(name) < 2 or name[0] != " " or name[-1] != " ":
                return None
            role, end, i = unescape(name[1:-1]), marks[i + 1][2], i + 1
        elif opening in ROLES:
            role = ROLES[opening]
            closing = MARKS[role][1]
        else:
            return None
        if i + 1 >= len(marks) or marks[i + 1][0] != closing:
            return None
        body = formatted[end : marks[i + 1][1]]
        if len(body) < 2 or body[0] != " " or body[-1] != " ":
            return None
        turns.append((role, unescape(body[1:-1])))
        at, i = marks[i + 1][2], i + 2
    return turns if at == len(formatted) else None


def format_turns(turns: list[Turn]) -> tuple[str, list[tuple[int, int]], int]:
    """Formatted text, loss places, number of escaped turns: escaping goes on until the parser gives the turns back."""
    escaped: set[int] = set()
    formatted, loss = render(turns, escaped)
    while parse(formatted) != turns:
        conflicts = {i for i, turn in enumerate(turns) if i not in escaped and parse(render([turn], set())[0]) != [turn]}
        escaped |= conflicts or set(range(len(turns)))
        formatted, loss = render(turns, escaped)
    return formatted, loss, len(escaped)


def format_conversations(df: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, formatted, loss, n_escaped): one text per conversation and the places (code points) that carry loss.

    Rows are ordered by turn, nulls first, ties by role and text; repeated rows are repeated turns. A null text or role
    is empty; rows without an id form one conversation; other columns are not read; no rows give no rows. A conversation
    is one output value, so its rows meet in one task; a hot text shared by conversations doesn't.
    """
    rows = df.select(F.col(id).alias("id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("said"))
    whole = rows.groupBy("id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    whole = whole.select("id", F.col("said.role").alias("roles"), F.col("said.text").alias("said"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [format_turns(list(zip(r, t))) for r, t in zip(column(batch, "roles").to_pylist(), column(batch, "said").to_pylist())]
        place = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        loss = pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in out], pa.list_(place))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x[0] for x in out], pa.string()), loss, pa.array([x[2] for x in out], pa.int64())],
            ["id", "formatted", "loss", "n_escaped"],
        )

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, formatted string, loss array<struct<start:long,end:long>>, n_escaped long"
    return map_batches(whole, lambda: work, schema).withColumnRenamed("id", id)


def read_back(formatted: DataFrame, id: str = "conv_id") -> DataFrame:
    """What the formatted texts hold: turns by the parser, the assistants' texts by the loss places."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, loss in zip(column(batch, "formatted").to_pylist(), column(batch, "loss").to_pylist()):
            turns = parse(text)
            said = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
            whole = "".join(f"{role}\n{words}\n" for role, words in turns)
            rows.append((len(turns), hashed(whole), len(said), hashed(said), len(text)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds)), column(batch, "n_escaped")],
            ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_escaped"],
        )

    kind = formatted.schema[id].dataType.simpleString()
    schema = f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_escaped long"
    rows = formatted.select(F.col(id).alias("id"), "formatted", "loss", "n_escaped")
    return map_batches(rows, lambda: work, schema).withColumnRenamed("id", id)


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
