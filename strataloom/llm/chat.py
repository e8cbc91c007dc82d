"""Chat formatting: turn-aligned windows under a token budget, with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Tokens of new turns that a window takes, turns of history it repeats at most, and tokens that these may have.
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 512, 2, 128
#: The template: <|role|>, a line end, the text, <|end|>, a line end.
_END = "<|end|>\n"
_TURN = re.compile(r"<\|([^|]*)\|>\n(.*?)<\|end\|>\n", re.DOTALL)
#: An opener, any backslashes, and what would make it a control string of this or of a common other template.
_CONTROL = re.compile(r"([<\[])(\\*)(?=\||/?s>|/?INST\]|/?SYS>>)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=\||/?s>|/?INST\]|/?SYS>>)")


def escape(text: str) -> str:
    """text without control strings: a backslash more after the opener of each, and of each that is escaped already."""
    return _CONTROL.sub(lambda m: f"{m[1]}\\{m[2]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("|", "%7C").replace("\n", "%0A"))


def _read_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%7C", "|").replace("%25", "%")


def tokens(text: str) -> int:
    """Estimated tokens of a turn: a quarter of its UTF-8 bytes, and 4 for its marks."""
    return 4 + len(text.encode("utf-8", "surrogatepass")) // 4


def windows(turns: Iterator[tuple[str, str]], budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> Iterator[tuple[str, list[tuple[int, int]], int]]:
    """(formatted text, spans of the loss mask, number of repeated turns) for each window of a conversation.

    Prefix sums of turn tokens choose the spans: a window ends before the turn whose sum passes the
    budget counted from the window's start, so a turn is never cut, and a longer turn stands alone. From
    the second window on the leading system turn and the last turns of history that fit come first;
    they are not under the mask, so each assistant text is a target once.
    """
    system: tuple[str, str] | None = None
    recent: list[tuple[str, str]] = []
    fresh: list[tuple[str, str]] = []
    spent, first, started = 0, True, False

    def window() -> tuple[str, list[tuple[int, int]], int]:
        repeated = [] if first else [t for t in (system, *fitting()) if t]
        parts, at, spans = [], 0, []
        for k, (role, text) in enumerate([*repeated, *fresh]):
            head, body = f"<|{_role(role)}|>\n", escape(text)
            if k >= len(repeated) and role == "assistant":
                spans.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, _END]
            at += len(head) + len(body) + len(_END)
        return "".join(parts), spans, len(repeated)

    def fitting() -> list[tuple[str, str]]:
        out, left = [], history_tokens
        for turn in reversed(recent):
            left -= tokens(turn[1])
            if left < 0:
                break
            out.append(turn)
        return out[::-1]

    for turn in turns:
        if not started and turn[0] == "system":
            system = turn
        started = True
        cost = tokens(turn[1])
        if fresh and spent + cost > budget:
            yield window()
            past = [t for t in fresh if t is not system]
            recent = (recent + past)[-history_turns:] if history_turns else []
            fresh, spent, first = [], 0, False
        fresh.append(turn)
        spent += cost
    if fresh:
        yield window()


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(_read_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


_WINDOWS = "conv_id long, window long, formatted string, loss array<struct<start:long,stop:long>>, n_repeated long"


def _runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Consecutive rows of equal first column, as streams: a conversation is never held whole."""
    rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(columns)), strict=True))
    row = next(rows, None)

    def run(key):
        nonlocal row
        while row is not None and row[0] == key:
            yield row
            row = next(rows, None)

    while row is not None:
        key = row[0]
        stream = run(key)
        yield key, stream
        for _ in stream:
            pass


def _format(budget: int, history_turns: int, history_tokens: int):
    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        spans = pa.array([[{"start": a, "stop": b} for a, b in r[3]] for r in out], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string()), spans, pa.array([r[4] for r in out], pa.int64())], ["conv_id", "window", "formatted", "loss", "n_repeated"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, rows in _runs(batches, 4):
            turns = ((r[2] or "", r[3] or "") for r in rows)
            for k, (text, spans, repeated) in enumerate(windows(turns, budget, history_turns, history_tokens)):
                out.append((conv, k, text, spans, repeated))
                size += len(text)
                if size > 4_000_000 or len(out) >= 5_000:
                    yield batch_of(out)
                    out, size = [], 0
        if out:
            yield batch_of(out)

    return run


def formatted(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """conversations(conv_id, turn, role, text), a row a turn, as windows: conv_id, window, formatted, loss, n_repeated.

    loss: code-point spans [start, stop) of formatted that are trained on, one for each assistant turn,
    in its window alone. Turns go by turn (nulls first), then role, then text; repeated rows are turns
    too. Null role or text: empty. Null conv_id: one conversation. Empty table: no rows. Other columns
    are ignored. One shuffle brings a conversation together in order; it streams through its task.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    tasks = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format(budget, history_turns, history_tokens), _WINDOWS)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    out = []
    for conv, rows in _runs(batches, 5):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = chars = total = count = 0
        for _, _, text, spans, repeated in rows:
            found = read_back(text)[repeated:]
            for role, said in found:
                turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for span in spans:
                said = unescape(text[span["start"] : span["stop"]])
                loss.update(said.encode("utf-8", "surrogatepass"))
                chars += len(said)
            n, total, count = n + len(found), total + len(text), count + 1
        out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, count))
        if len(out) >= 5_000:
            yield batch_of(out)
            out = []
    if out:
        yield batch_of(out)


def read_back_digests(windowed: DataFrame) -> DataFrame:
    """A row a conversation, from the output of formatted() alone, which comes in order: nothing is shuffled again."""
    return windowed.mapInArrow(_digest, _DIGESTS)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    return read_back_digests(formatted(rows))
