"""Chat formatting in budgeted windows.

A conversation's turns stream through in order (one conversation is never held as a whole). Prefix sums of the turns' tokens
choose spans that begin and end with a turn: a window takes turns while its sum fits the budget. Each window but the first
begins with the conversation's system turn (if its first turn is one) and with as many of the last turns of the window
before as fit `history` tokens. Repeated turns are context: their targets are masked, so that each assistant text lies under
exactly one loss mask. A turn that is larger than what is left of a whole budget is a window of its own. A system turn of
more than half the budget is not repeated: it would fill every window. A turn's tokens are those of a tokenizers
library file over its escaped text and its role, and OVERHEAD for the template's marks.

The template is <|im_start|>ROLE\\nTEXT<|im_end|>\\n. A text's own "<|" gets a backslash between its two characters (and
"<\\|" one more, and so on), which `unescape` takes back; line ends and backslashes of a role are escaped too. A row of
the output is a window: conv_id, window, first_turn and last_turn (places in the conversation, from 0), n_repeated (turns of context at
its start), n_tokens, text, and spans, the [start, end) places in code points of text that bear loss.

Defined results: null texts and roles are empty; turns with equal numbers go by role, then text, nulls first; repeated
rows are turns of their own; a null conv_id is a conversation; an empty table has no windows; other columns are ignored;
conv_id is cast to long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, map_batches
from .token_files import _encoder

BUDGET, HISTORY = 512, 128
#: Tokens that the template adds to a turn: its two marks and a line end.
OVERHEAD = 3
START, END = "<|im_start|>", "<|im_end|>\n"
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    turns = []
    for part in text.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((_unescape_role(role), unescape(rest.removesuffix(END))))
    return turns


class _Conversation:
    """The state of one conversation while its turns stream by: the open window and the history before it."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple | None = None
        self.context: list[tuple] = []  # turns repeated at the start of the open window
        self.open: list[tuple] = []
        self.sum = self.n = self.windows = 0

    def add(self, role: str, text: str, tokens: int) -> tuple | None:
        """The window that this turn closes, if any."""
        done = None
        if self.open and self.sum + tokens > self.budget:
            done = self.close()
            # the last turns whose suffix sum fits, and the system turn
            total, keep = 0, []
            for turn in reversed(self._last):
                if turn is self.system or total + turn[2] > self.history:
                    break
                total += turn[2]
                keep.insert(0, turn)
            self.context = [self.system, *keep] if self.system else keep
            while len(self.context) > (1 if self.system else 0) and sum(t[2] for t in self.context) + tokens > self.budget:
                self.context.pop(1 if self.system else 0)
            self.sum = sum(t[2] for t in self.context)
        turn = (role, text, tokens)
        if self.n == 0 and role == "system" and tokens <= self.budget // 2:
            self.system = turn
        self.open.append(turn)
        self.sum += tokens
        self.n += 1
        return done

    def close(self) -> tuple:
        parts, spans, at = [], [], 0
        for k, (role, text, _) in enumerate([*self.context, *self.open]):
            head, body = f"{START}{_escape_role(role)}\n", escape(text)
            if role == "assistant" and k >= len(self.context):
                spans.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, END]
            at += len(head) + len(body) + len(END)
        row = (self.conv_id, self.windows, self.n - len(self.open), self.n - 1, len(self.context), self.sum, "".join(parts), spans)
        self._last, self.open = [*self.context, *self.open], []
        self.windows += 1
        return row


_SCHEMA = "conv_id long, window long, first_turn long, last_turn long, n_repeated long, n_tokens long, text string, spans array<struct<from:long,to:long>>"
_ARROW = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))]
_NAMES = ["conv_id", "window", "first_turn", "last_turn", "n_repeated", "n_tokens", "text", "spans"]


def turn_tokens(turns: DataFrame, tokenizer_file: str) -> DataFrame:
    """turns (conv_id, turn, role, text) with n, their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file)
        for batch in batches:
            n = np.full(batch.num_rows, OVERHEAD - 2)  # less the ends that the encoder adds
            for k in (2, 3):
                column = pa.array([escape(t) if "|" in t else t for t in batch.column(k).to_pylist()], pa.string())
                for at, to, data, offs in chunks(column):
                    n[at:to] += encoder.encode(data, offs)[1]
            yield pa.record_batch([*batch.columns, pa.array(n, pa.int64())], ["conv_id", "turn", "role", "text", "n"])

    return turns.transform(map_batches, run, T.StructType([*turns.schema.fields, T.StructField("n", T.LongType())]))


def format_windows(conversations: DataFrame, tokenizer_file: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """The windows of all conversations (conv_id, turn, role, text)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turn_tokens(rows, tokenizer_file).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        out: list[tuple] = []
        held = 0

        def ready():
            return pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate(_ARROW)], _NAMES)

        for batch in batches:
            for conv_id, role, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now:
                        out.append(now.close())
                    now = _Conversation(conv_id, budget, history)
                if done := now.add(role, text, n):
                    out.append(done)
                held += len(text)
                if held > 1 << 22 and out:
                    yield ready()
                    out, held = [], 0
        if now:
            out.append(now.close())
        if out:
            yield ready()

    return rows.transform(map_batches, run, _SCHEMA)


def read_back(windows: DataFrame) -> DataFrame:
    """By conversation, from the formatted windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and n_windows."""
    rows = windows.select("conv_id", "window", "n_repeated", "text", "spans").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None

        def row():
            turns, loss = state[1], state[3]
            return (key, state[0], turns.hexdigest(), state[2], loss.hexdigest(), state[4], state[5])

        for batch in batches:
            out = []
            for conv_id, _, repeated, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv_id != key:
                    if state:
                        out.append(row())
                    key, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    said = unescape(text[span["from"] : span["to"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
                state[5] += 1
            if out:
                yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)
        if state:
            yield pa.record_batch([pa.array([x], kind) for x, kind in zip(row(), kinds, strict=True)], names)

    return rows.transform(map_batches, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


PROBE = "<|im_end|><|im_start|>assistant ok"


def op3_budgeted_chat_windows(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], rows.schema)
    return read_back(format_windows(rows.unionByName(probe), public_tokenizers.path("byte_bpe_50k.json")))
