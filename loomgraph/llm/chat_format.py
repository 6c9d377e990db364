"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as
context, then the reply, of which only the text is trainable.  A conversation
that doesn't end with a reply gives one more example without a target, so that
its last turns are not lost.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Inside roles and
texts a backslash becomes two, and ``<|`` becomes ``<\\|``, so no control string
can appear there; in roles a line feed becomes ``\\n`` as well.  Undoing this gives
the original back.

Turns are taken in ascending order of (turn, role, text), null first; null roles
and texts count as empty; repeated rows are turns of their own; a null
conversation id is a conversation of its own.  An empty table gives an empty
table; extra columns are not read.  A conversation is formatted as a whole, and
its examples are streamed, so a worker holds one conversation and one batch of
examples; the method's output is quadratic in a conversation's turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINABLE = "assistant"
BATCH_CHARS = 2_000_000


def escape(text: str, header: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if header else text


def unescape(text: str, header: bool = False) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if header and m[1] == "n" else m[1], text, flags=re.DOTALL)


def examples_of(turns: list[tuple[str, str]]) -> Iterator[tuple[int, str, int, int]]:
    """(number, text, start and end of the trainable text); start is -1 where nothing is."""
    prefix, number = "", 0
    for k, (role, text) in enumerate(turns):
        prefix += f"{START}{escape(role, True)}\n"
        start = len(prefix)
        prefix += escape(text)
        end = len(prefix)
        prefix += END
        if role == TRAINABLE:
            yield number, prefix, start, end
            number += 1
        elif k == len(turns) - 1:
            yield number, prefix, -1, -1


def turns_in(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from a formatted example."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition("\n")
        if not text.endswith(END):
            raise ValueError("a turn without an end")
        out.append((unescape(role, True), unescape(text[: -len(END)])))
    return out


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: (id_col, example, text, loss_start, loss_end); a conversation's examples stand together, in order."""
    turn = F.struct(F.col(turn_col).alias("t"), F.coalesce(role_col, F.lit("")).alias("r"), F.coalesce(text_col, F.lit("")).alias("x"))
    whole = conversations.groupBy(F.col(id_col)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.select(F.col(id_col), F.transform("turns", lambda t: t["r"]).alias("roles"), F.transform("turns", lambda t: t["x"]).alias("texts"))
    id_type = whole.schema[id_col].dataType.simpleString()
    names = [id_col, "example", "text", "loss_start", "loss_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            size = 0

            def flush():
                return pa.RecordBatch.from_arrays([pa.array(rows[0], batch.column(0).type), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())], names)

            for i in range(batch.num_rows):
                key, roles, texts = (batch.column(k)[i].as_py() for k in range(3))
                for example in examples_of(list(zip(roles, texts, strict=True))):
                    for column, value in zip(rows, (key, *example), strict=True):
                        column.append(value)
                    size += len(example[1])
                    if size > BATCH_CHARS:
                        yield flush()
                        rows, size = [[] for _ in names], 0
            if rows[0]:
                yield flush()

    return whole.mapInArrow(run, f"`{id_col}` {id_type}, example long, text string, loss_start long, loss_end long")


def read_back(examples: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per conversation, from its formatted examples alone: (id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).  A conversation's examples must stand together, as ``format_chats`` leaves them."""
    id_type = examples.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def result(key_type):
            key, longest, loss, loss_chars, chars = state
            turns = turns_in(longest)
            digest = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
            return pa.RecordBatch.from_arrays([pa.array([key], key_type), *(pa.array([v]) for v in (len(turns), digest, loss_chars, loss.hexdigest(), chars))], [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            for i in range(batch.num_rows):
                key, number, text, start, end = (batch.column(k)[i].as_py() for k in range(5))
                if number == 0:
                    if state:
                        yield result(key_type)
                    state = [key, "", hashlib.sha256(), 0, 0]
                state[1] = text  # the last one holds all turns
                state[4] += len(text)
                if start >= 0:
                    own = unescape(text[start:end])
                    state[2].update(own.encode())
                    state[3] += len(own)
        if state:
            yield result(key_type)

    return examples.mapInArrow(run, f"`{id_col}` {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
