"""Chat formatting by columnar byte assembly in numpy, and reading it back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template's control strings. A turn is OPEN role START text END CLOSE.
OPEN, START, END, CLOSE = b"<s>", b"[INST]", b"[/INST]", b"</s>"
#: Stands before the second byte of a control string, and before itself, inside roles and texts.
ESCAPE = ord("\\")
LOSS_ROLE = "assistant"
SCHEMA = "conv_id long, part long, n_turns long, formatted binary, loss_starts array<long>, loss_ends array<long>"
#: A conversation's output comes in parts of whole turns, each of about so many bytes.
PART_BYTES = 8 << 20


def _escapes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Positions before which ESCAPE is put; control strings don't reach from one text into the next."""
    n = len(data)
    found = [np.flatnonzero(data == ESCAPE)]
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    for c in (OPEN, START, END, CLOSE):
        if n >= len(c):
            at = np.flatnonzero(data[: n - len(c) + 1] == c[0])
            for k in range(1, len(c)):
                at = at[data[at + k] == c[k]]
            found.append(at[owner[at] == owner[at + len(c) - 1]] + 1)
    return np.sort(np.concatenate(found))


def assemble(roles: tuple[np.ndarray, np.ndarray], texts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer: the bytes, each turn's start (and the end), each turn's text span.

    ``roles`` and ``texts`` are bytes and offsets of the turns. The lengths of all segments give the
    cumulative offsets where each goes; escaped contents are scattered to their offset plus the number
    of escapes before them, control strings to theirs.
    """
    turns = len(texts[1]) - 1
    esc = [_escapes(*x) for x in (roles, texts)]
    before = [np.searchsorted(e, x[1]) for e, x in zip(esc, (roles, texts))]  # escapes before each offset
    role_len, text_len = (np.diff(x[1]) + np.diff(b) for x, b in zip((roles, texts), before))
    fixed = [len(c) for c in (OPEN, START, END, CLOSE)]
    starts = np.concatenate([[0], np.cumsum(role_len + text_len + sum(fixed))]).astype(np.int64)
    out = np.full(starts[-1], ESCAPE, np.uint8)
    at = starts[:-1]
    places = [at, at + fixed[0] + role_len, at + fixed[0] + role_len + fixed[1] + text_len, at + fixed[0] + role_len + fixed[1] + text_len + fixed[2]]
    for c, p in zip((OPEN, START, END, CLOSE), places):
        out[p[:, None] + np.arange(len(c))] = np.frombuffer(c, np.uint8)
    text_at = at + fixed[0] + role_len + fixed[1]
    for (data, offs), e, b, to in zip((roles, texts), esc, before, (at + fixed[0], text_at)):
        owner = np.repeat(np.arange(turns), np.diff(offs))
        i = np.arange(len(data))
        shift = np.searchsorted(e, i, side="right") - b[:-1][owner]  # escapes of this segment up to here
        out[to[owner] + i - offs[:-1][owner] + shift] = data
    return out, starts, np.stack([text_at, text_at + text_len], 1)


def format_conversations(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, part, n_turns, formatted bytes, and the spans of it that count for the loss.

    The turns of a conversation go by turn (null first), then role and text, so ties and repeated
    rows have one order. Null roles and texts are empty; rows with a null conv_id make one
    conversation of null. The loss mask covers the escaped text of each assistant turn. Long
    conversations come in several parts of whole turns, in order, so no row grows without bound. One
    shuffle by conversation; turns stream through in sorted order, and no group is gathered. An empty
    table gives no rows; other columns are ignored.
    """
    x = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("_turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    x = x.repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .words import chunks, text_bytes

        last, part = None, 0
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
        for table in chunks(batches, "text", PART_BYTES):
            out, starts, text_at = assemble(text_bytes(table.column("role")), text_bytes(table.column("text")))
            ids = table.column("conv_id").combine_chunks()
            number, valid = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
            edge = np.ones(len(ids), bool)
            edge[1:] = (number[1:] != number[:-1]) | (valid[1:] != valid[:-1])
            first = np.flatnonzero(edge)
            parts = np.zeros(len(first), np.int64)
            parts[0] = part + 1 if last == ids[0] else 0
            last, part = ids[len(ids) - 1], parts[-1]
            # the buffer that the turns were scattered into is the column's own; conversations are spans of it
            whole = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(starts[np.append(first, len(ids))].astype(np.int32)), pa.py_buffer(out)])
            loss = np.asarray(pa.compute.equal(table.column("role"), LOSS_ROLE))
            owner = np.cumsum(edge) - 1
            spans = (text_at - starts[first][owner][:, None])[loss]
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[loss], minlength=len(first)))])
            turns = pa.array(np.diff(np.append(first, len(ids))))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(parts), turns, whole, lists(ends, spans[:, 0]), lists(ends, spans[:, 1])], names)

    return x.mapInArrow(run, SCHEMA)


_UNESCAPE = re.compile(rb"\\(.)", re.S)
_TURN = re.compile(re.escape(OPEN) + rb"(.*?)" + re.escape(START) + rb"(.*?)" + re.escape(END) + re.escape(CLOSE), re.S)


def unescape(b: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1", b)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The (role, text) turns of formatted bytes, unescaped."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"not a turn at byte {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a turn at byte {at}")
    return turns


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from ``format_conversations``: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Parts of a conversation follow each other within their partition, so each is parsed, added to the
    running digests, and forgotten.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        now: list | None = None

        def row() -> tuple:
            return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["part"] == 0:
                    if now is not None:
                        done.append(row())
                    now = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                f = r["formatted"]
                for role, text in parse(f):
                    now[1] += 1
                    now[2].update(role + b"\n" + text + b"\n")
                for a, b in zip(r["loss_starts"], r["loss_ends"]):
                    text = unescape(f[a:b])
                    now[3] += len(text.decode())
                    now[4].update(text)
                now[5] += len(f.decode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) or v is None else pa.string()) for v in row()], names)

    return formatted.mapInArrow(run, schema)
