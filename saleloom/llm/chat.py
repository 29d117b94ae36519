"""Chat formatting in budgeted windows.

A turn reads ``<|im_start|>role``, a line end, its text, ``<|im_end|>`` and a line end. Inside roles and
texts every ``<|`` gets one more ``!`` between its two characters, and so does every ``<!|``, ``<!!|`` and
so on, so texts hold no control string and come back unchanged.

Prefix sums of the turns' tokens choose the spans: a window takes the turns from its start up to the
last whose prefix sum stays within the budget that the system turn and the repeated history leave. The
history are the last turns before the start whose prefix sums stay within its own budget. Turns are
never cut; one that is longer than the budget has a window of its own. The loss covers the assistant
texts of new turns only, so each is a target once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleloom.llm.common import batches_of, ship
from saleloom.llm.token_files import encoder_of
from saleloom.session import stored

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 2048, 512

_MORE, _LESS = re.compile(r"<(!*)\|"), re.compile(r"<!(!*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)

_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_ARROW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("repeated", pa.int64()), ("n_tokens", pa.int64()),
                    ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
WINDOWS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("window", T.LongType()), T.StructField("repeated", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("text", T.StringType()), T.StructField("loss", T.ArrayType(_SPAN))])


def escape(text: str) -> str:
    return _MORE.sub(r"<!\1|", text)


def unescape(text: str) -> str:
    return _LESS.sub(r"<\1|", text)


def format_turn(role: str, text: str) -> str:
    head = escape(role).replace("\\", "\\\\").replace("\n", "\\n")
    return f"{START}{head}\n{escape(text)}{END}\n"


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end enclose the escaped text."""
    out = []
    for m in _TURN.finditer(formatted):
        role = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], m[1])
        out.append((unescape(role), unescape(m[2]), m.start(2), m.end(2)))
    return out


class _Turn:
    __slots__ = ("role", "text", "upto", "size")

    def __init__(self, role: str, text: str, upto: int, size: int):
        self.role, self.text, self.upto, self.size = role, text, upto, size


def windows_of(turns: Iterable[tuple[str, str]], count, budget: int = BUDGET, history: int = HISTORY) -> Iterator[dict]:
    """The windows of one conversation; ``count`` gives the tokens of a formatted turn."""
    return windows_of_sized(((role, text, count(format_turn(role, text))) for role, text in turns), budget, history)


def windows_of_sized(turns: Iterable[tuple[str, str, int]], budget: int = BUDGET, history: int = HISTORY) -> Iterator[dict]:
    """The windows of one conversation, as its turns (role, text, tokens once formatted) come in.

    Holds one window and its history at a time, however long the conversation is.
    """
    system: _Turn | None = None
    kept: list[_Turn] = []  # turns that a coming window may repeat, then the new ones
    new_from, number, total = 0, 0, 0

    def close() -> dict:
        parts = ([system] if system else []) + kept
        repeated = (1 if system and number else 0) + new_from
        text, loss, at = [], [], 0
        for i, turn in enumerate(parts):
            body = format_turn(turn.role, turn.text)
            if turn.role == "assistant" and i >= repeated:
                begin = at + body.index("\n") + 1
                loss.append({"start": begin, "end": at + len(body) - len(END) - 1})
            text.append(body)
            at += len(body)
        return {"window": number, "repeated": repeated, "n_tokens": sum(t.size for t in parts), "text": "".join(text),
                "loss": loss}

    for i, (role, text, size) in enumerate(turns):
        if i == 0 and role == "system":
            system = _Turn(role, text, 0, size)
            continue
        turn = _Turn(role, text, total + size, size)
        room = budget - (system.size if system else 0)
        if len(kept) > new_from and turn.upto - (kept[0].upto - kept[0].size) > room:
            yield close()
            number += 1
            # the longest end of the turns so far whose prefix sums stay within the history's budget
            most = min(history, max(0, room - size))
            begin = len(kept)
            while begin and total - (kept[begin - 1].upto - kept[begin - 1].size) <= most:
                begin -= 1
            kept = kept[begin:]
            new_from = len(kept)
        total = turn.upto
        kept.append(turn)
    if system or kept:
        yield close()


def format_conversations(rows: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, repeated (turns that stood before), n_tokens, text and loss spans of every window.

    Turns of a conversation are ordered by turn, then role, then text; a null turn comes first. Null
    roles and texts are empty; repeated rows are turns of their own; rows without conv_id form one
    conversation. Only a system turn that opens the conversation is retained in later windows.
    """
    ship(rows.sparkSession)
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                bodies = map(format_turn, part.column("role").to_pylist(), part.column("text").to_pylist())
                sizes = [len(ids) // 4 for ids in encoder.encode_all(list(bodies))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes, pa.int64())], names=[*part.schema.names, "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_windows() -> Iterator[dict]:
            for conv, group in _groups(batches, ("role", "text", "size")):
                for window in windows_of_sized(group, budget, history):
                    yield {"conv_id": conv, **window}

        yield from batches_of(all_windows(), _ARROW, 500, weight=lambda w: 4 * len(w["text"]))

    # turns are tokenised where they are read; what a conversation's one task adds up are their sizes
    counted = turns.mapInArrow(sized, "conv_id long, turn long, role string, text string, size long")
    return (counted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(run, WINDOWS))


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """(conv_id, its rows) one after the other; a group has to be read before the next."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield from zip(*(part.column(n).to_pylist() for n in ("conv_id", *names)), strict=True)

    source = rows()
    first = next(source, None)
    while first is not None:
        conv, ahead = first[0], [first, None]

        def group() -> Iterator[tuple]:
            row = ahead[0]
            while row is not None and row[0] == conv:
                yield row[1:]
                row = next(source, None)
            ahead[1] = row

        yield conv, group()
        first = ahead[1]


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the windows' texts."""
    ship(windows.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, group in _groups(batches, ("repeated", "text", "loss")):
            turns, losses, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for repeated, text, loss in group:
                size += len(text)
                for role, said, _, _ in read_turns(text)[repeated:]:
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for span in loss:
                    target = unescape(text[span["start"]:span["end"]])
                    chars += len(target)
                    losses.update(target.encode("utf-8", "surrogatepass"))
            yield {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars,
                   "loss_sha256": losses.hexdigest(), "formatted_chars": size}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(digests(batches), schema)

    return (windows.select("conv_id", "window", "repeated", "text", "loss").repartition("conv_id")
            .sortWithinPartitions("conv_id", "window")
            .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                             "formatted_chars long"))


def conversation_digests(rows: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Format, write the windows, read them back."""
    return read_back(stored(format_conversations(rows, tokenizer, budget, history), "windows"))
