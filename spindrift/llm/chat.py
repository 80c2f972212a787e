"""Chat formatting by columnar byte assembly, and the way back."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings (fixed values).
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = (BEGIN, END, OPEN, CLOSE)
_TURN = re.compile(rb"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
_ESCAPED = re.compile(rb"\\(.)", re.S)
SCHEMA = "conv_id long, part int, formatted string, loss array<struct<start:long,length:long>>"


def escape(column: pa.Array) -> pa.Array:
    """A backslash before each backslash, and after the first letter of each control string, so none is left."""
    if not pc.any(pc.match_substring_regex(column, r"\\|</?s>|\[/?INST\]")).as_py():
        return column
    column = pc.replace_substring(column, "\\", "\\\\")
    for c in CONTROL:
        column = pc.replace_substring(column, c, c[0] + "\\" + c[1:])
    return column


def unescape(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", text)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


def _scatter(out: np.ndarray, at: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> None:
    """Copy value i of a string column to out[at[i]:]."""
    lengths = np.diff(offsets)
    total = int(lengths.sum())
    if total:
        begins = np.cumsum(lengths) - lengths
        out[np.repeat(at - begins, lengths) + np.arange(total)] = data[offsets[0] : offsets[0] + total]


def _fixed(out: np.ndarray, at: np.ndarray, text: str) -> None:
    b = np.frombuffer(text.encode(), np.uint8)
    out[at[:, None] + np.arange(len(b))] = b


def assemble(conv: np.ndarray, role: pa.Array, text: pa.Array, learn: np.ndarray):
    """Formatted text and loss spans of each run of equal ``conv``, in one preallocated buffer.

    A turn is BEGIN OPEN role CLOSE text END, role and text escaped. A loss span
    (bytes of the formatted text) covers the text of a turn with ``learn``.
    """
    (ro, rd), (to, td) = _bytes_of(escape(role)), _bytes_of(escape(text))
    rl, tl = np.diff(ro), np.diff(to)
    head, mid, tail = len(BEGIN + OPEN), len(CLOSE), len(END)
    ends = np.cumsum(head + rl + mid + tl + tail)
    begins = np.r_[0, ends[:-1]]
    out = np.empty(int(ends[-1]), np.uint8)
    text_at = begins + head + rl + mid
    _fixed(out, begins, BEGIN + OPEN)
    _scatter(out, begins + head, ro, rd)
    _fixed(out, begins + head + rl, CLOSE)
    _scatter(out, text_at, to, td)
    _fixed(out, text_at + tl, END)
    first = np.r_[0, np.flatnonzero(conv[1:] != conv[:-1]) + 1]
    bounds = np.r_[begins[first], ends[-1]].astype(np.int64)
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(out)).cast(pa.string())
    which = np.cumsum(np.r_[False, conv[1:] != conv[:-1]])
    counts = np.bincount(which[learn], minlength=len(first))
    spans = pa.StructArray.from_arrays([pa.array((text_at - bounds[which])[learn].astype(np.int64)), pa.array(tl[learn].astype(np.int64))], ["start", "length"])
    loss = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), spans)
    return first, formatted, loss


def format_chats(turns: DataFrame, learn_role: str = "assistant", part_turns: int = 8192, part_bytes: int = 1 << 24) -> DataFrame:
    """(conv_id, part, formatted, loss): each conversation's turns, by turn, in the template.

    Null role or text counts as empty; turns with equal numbers go by role, then
    text; null turns come first and a null conv_id is a conversation of its own.
    No part holds more than ``part_turns`` turns, or ``part_bytes`` bytes unless
    one turn does, so a long conversation comes in several parts and needs no
    more memory than a short one; its text is the parts one after the other.
    Rows come sorted by conversation and part within a partition. Repeated rows
    are turns of their own; an empty table gives no rows; other columns,
    whatever their names, are not read.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        last, part = (), 0

        def slices(b):
            size = np.diff(_bytes_of(b.column("text"))[0])
            at = 0
            while at < len(b):
                n = max(1, min(part_turns, int(np.searchsorted(np.cumsum(size[at:]), part_bytes, "right"))))
                yield b.slice(at, n)
                at += n

        for b in (s for b in batches if len(b) for s in slices(b)):
            ids = b.column("conv_id")
            known = pc.fill_null(ids, 0).to_numpy()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            key = np.unique(np.stack([known, null]), axis=1, return_inverse=True)[1].ravel()
            first, formatted, loss = assemble(key, b.column("role"), b.column("text"), pc.equal(b.column("role"), learn_role).to_numpy(zero_copy_only=False))
            conv = ids.take(pa.array(first))
            part = part + 1 if (conv[0].as_py(),) == last else 0
            parts = np.zeros(len(first), np.int32)
            parts[0] = part
            if len(first) > 1:
                part = 0
            last = (conv[-1].as_py(),)
            yield pa.RecordBatch.from_arrays([conv, pa.array(parts), formatted, loss], ["conv_id", "part", "formatted", "loss"])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The (role, text) turns of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def digests(chats: DataFrame) -> DataFrame:
    """One row per conversation, read back from ``format_chats``: turns and masked text, counted and hashed."""

    def run(batches):
        now, state = (), None

        def row():
            return (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def batch(done):
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if "sha" in n else pa.int64()) for n, x in zip(names, zip(*done))], list(names))

        for b in batches:
            done = []
            for conv, text, loss in zip(*(b.column(i).to_pylist() for i in (0, 1, 2))):
                if (conv,) != now:
                    if now:
                        done.append(row())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(text)
                raw = text.encode()
                for role, said in parse(raw):
                    state[0] += 1
                    state[1].update(role + b"\n" + said + b"\n")
                for span in loss:
                    said = unescape(raw[span["start"] : span["start"] + span["length"]])
                    state[2] += len(said.decode())
                    state[3].update(said)
            if done:
                yield batch(done)
        if now:
            yield batch([row()])

    return chats.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
