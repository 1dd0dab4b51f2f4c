"""Chat formatting at the level of tokens: segments encoded separately, reserved ids spliced in, masks by prefix sums."""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callquality.llm.packing import default_vocabulary, load_encoder

#: The control strings of the template. Their ids follow the vocabulary's.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
FIRST_CONTROL = 50257
CONTROL_ID = {c: FIRST_CONTROL + k for k, c in enumerate(CONTROLS)}
#: What stands before and after a turn, by role; any other role is spelled out between the last two controls.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
CHATS = "conv_id long, n_turns long, text string, ids array<int>, loss array<byte>"


def escape(text: str) -> str:
    """Doubles each backslash and puts one behind the first character of each control string, so that none is left."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_tokens(encoder, role: str, text: str) -> tuple[list[int], int, int, str]:
    """Ids of a turn, where its content begins and ends in them, and the turn as a string."""
    content = escape(text)
    if role in MARKS:
        before, after = MARKS[role]
        head, tail, shown = [CONTROL_ID[before]], [CONTROL_ID[after]], before + content + after
    else:
        name = escape(role)
        head = [CONTROL_ID["[ROLE]"], *encoder.encode_ordinary(name), CONTROL_ID["[/ROLE]"]]
        tail, shown = [CONTROL_ID["</s>"]], f"[ROLE]{name}[/ROLE]{content}</s>"
    body = encoder.encode_ordinary(content)
    return head + body + tail, len(head), len(head) + len(body), shown


def format_chats(turns: DataFrame, vocabulary: str | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv_id, n_turns, text (the template filled in), ids and loss (1 on assistants' content).

    Turns are in order of turn, then role and text, nulls first; a null text is empty, a null role is the empty role, a
    null conv_id is a conversation of its own; repeated rows are turns of their own. Other columns are not read, an
    empty table gives no rows. Turns are tokenised where they lie, then sorted by conversation; a task holds the turns
    of one conversation, whatever their number in the partition.
    """
    vocabulary = vocabulary or default_vocabulary()

    def tokenise(batches):
        encoder = load_encoder(vocabulary)
        for batch in batches:
            rows = [turn_tokens(encoder, r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            columns = [np.array(x[0], "<i4").tobytes() for x in rows], [x[1] for x in rows], [x[2] for x in rows], [x[3] for x in rows]
            extra = [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "ids", "begin", "end", "shown"])

    def assemble(batches):
        def row(conv_id, parts):
            ids = np.concatenate([np.frombuffer(p[1], "<i4") for p in parts])
            starts = np.cumsum([0, *[len(p[1]) // 4 for p in parts]])[:-1]
            step = np.zeros(len(ids) + 1, np.int8)
            for start, (assistant, _, begin, end, _) in zip(starts, parts, strict=True):
                if assistant and end > begin:
                    step[start + begin] += 1
                    step[start + end] -= 1
            return conv_id, len(parts), "".join(p[4] for p in parts), ids, np.cumsum(step[:-1], dtype=np.int8)

        def out(rows):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int8()))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["conv_id", "n_turns", "text", "ids", "loss"])

        current, parts, rows, size = None, [], [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "ids", "begin", "end", "shown")]
            for conv_id, who, ids, begin, end, shown in zip(*columns, strict=True):
                if parts and conv_id != current:
                    rows.append(row(current, parts))
                    size, parts = size + len(rows[-1][3]), []
                    if size >= 1 << 20:
                        yield out(rows)
                        rows, size = [], 0
                current = conv_id
                parts.append((who == "assistant", ids, begin, end, shown))
        if parts:
            rows.append(row(current, parts))
        yield out(rows)

    given = turns.select(turns[conv].cast("long").alias("conv_id"), turns[turn].cast("long").alias("turn"), turns[role].cast("string").alias("role"), turns[text].cast("string").alias("text"))
    tokens = given.mapInArrow(tokenise, "conv_id long, turn long, role string, text string, ids binary, begin int, end int, shown string")
    ordered = tokens.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "ids", "begin", "end", "shown")
    return ordered.mapInArrow(assemble, CHATS)


def read_turns(encoder, ids: np.ndarray, loss: np.ndarray) -> list[tuple[str, str, bool]]:
    """(role, text, under the loss mask) of each turn, from ids and mask alone."""
    closes = {CONTROL_ID[b]: (role, CONTROL_ID[a]) for role, (b, a) in MARKS.items()}
    decode = lambda x: unescape(encoder.decode_bytes([int(i) for i in x]).decode())
    at, turns = 0, []
    marks = np.flatnonzero(ids >= FIRST_CONTROL)
    k = 0
    while k < len(marks):
        if ids[marks[k]] == CONTROL_ID["[ROLE]"]:
            role, at, end = decode(ids[marks[k] + 1 : marks[k + 1]]), marks[k + 1] + 1, marks[k + 2]
            k += 3
        else:
            (role, close), at, end = closes[int(ids[marks[k]])], marks[k] + 1, marks[k + 1]
            if ids[end] != close:
                raise ValueError("a turn isn't closed by its own mark")
            k += 2
        turns.append((role, decode(ids[at:end]), bool(end > at and loss[at:end].all())))
    return turns


def loss_texts(encoder, ids: np.ndarray, loss: np.ndarray) -> list[str]:
    """The unescaped texts of the runs of ids under the mask."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loss, [0]])))
    return [unescape(encoder.decode_bytes([int(i) for i in ids[a:b]]).decode()) for a, b in list(pairwise(edges))[::2]]
