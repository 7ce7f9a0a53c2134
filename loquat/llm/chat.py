"""Chat formatting by columnar byte assembly.

Every turn is a header, its escaped text and a footer.  Segment lengths give
cumulative offsets, offsets give scatter indices, and one numpy gather fills
one preallocated buffer with the bytes of a whole batch; the conversations are
slices of it.  The loss mask is a list of (start, length) in code points of the
formatted string that covers the assistant texts.

Control strings cannot occur in a text: `<|` becomes `<\\|`, `<\\|` becomes
`<\\\\|`, and so on, which reading back undoes.  In roles line feeds and
backslashes are escaped too.

Defined results: null role and null text are empty; turns with equal numbers
are ordered by role and text, null numbers come first; rows with null conv_id
form one conversation; a conversation of 2 GiB or more is an error, as no
string of Spark holds it; an empty table gives an empty result; other columns
are not carried."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .shared import bound_batches, n_partitions

START, END = "<|im_start|>", "<|im_end|>\n"
CONSTANTS = (START + "\n" + END).encode()
BYTES = 32 << 20  # of formatted text a batch
FORMATTED = "conv_id long, formatted string, loss array<struct<start:long,length:long>>"


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\\\1|")


def escape_role(column: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "\n", "\\n"))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _column(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array without nulls."""
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all turns in one buffer, and the n + 1 offsets of the turns."""
    pool, bases, lengths = [np.frombuffer(CONSTANTS, np.uint8)], [], []
    at = len(CONSTANTS)
    n = len(roles)
    columns = []
    for a in (roles, texts):
        data, offsets = _column(a)
        pool.append(data)
        columns.append((offsets[:-1] + at, np.diff(offsets)))
        at += len(data)
    full = lambda x: np.full(n, x, np.int64)
    bases = np.stack([full(0), columns[0][0], full(len(START)), columns[1][0], full(len(START) + 1)], 1).ravel()
    lengths = np.stack([full(len(START)), columns[0][1], full(1), columns[1][1], full(len(END))], 1).ravel()
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if n else 0
    # a position's source is its own place plus its segment's shift
    index = np.arange(total) + np.repeat(bases - (ends - lengths), lengths)
    return np.concatenate(pool)[index], np.concatenate([[0], ends[4::5]]) if n else np.zeros(1, np.int64)


def format_batch(conv: np.ndarray, roles: pa.Array, texts: pa.Array, trained: tuple[str, ...] = ("assistant",)):
    """Whole conversations, rows in order -> (first row of each, strings, masks)."""
    n = len(roles)
    mask = pc.is_in(roles, pa.array(list(trained), pa.large_string())).to_numpy(zero_copy_only=False)
    roles, texts = escape_role(roles), escape(texts)
    data, offsets = assemble(roles, texts)
    first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
    edge = np.concatenate([offsets[first], offsets[-1:]]).astype(np.int64)
    strings = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(data)])
    chars_text = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    chars_role = pc.utf8_length(roles).to_numpy(zero_copy_only=False).astype(np.int64)
    size = chars_role + chars_text + len(START) + 1 + len(END)
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    begin = begin - begin[first][of] + len(START) + chars_role + 1
    hit = np.flatnonzero(mask)
    spans = pa.StructArray.from_arrays([pa.array(begin[hit]), pa.array(chars_text[hit])], ["start", "length"])
    cut = np.searchsorted(of[hit], np.arange(len(first) + 1)).astype(np.int32)
    return first, strings, pa.ListArray.from_arrays(pa.array(cut), spans)


def format_conversations(rows: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss.

    Rows are dealt by conversation and sorted, and batches are formatted as
    they stream by; only the conversation that a batch ends in is held back."""

    layout = pa.schema([("conv_id", pa.int64()), ("none", pa.bool_()), ("role", pa.large_string()), ("text", pa.large_string())])

    def form(tables: list) -> Iterator[pa.RecordBatch]:
        now = pa.concat_tables(tables).combine_chunks()
        conv, none = now["conv_id"].to_numpy(), now["none"].to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (none[1:] != none[:-1]), [True]]))
        length = lambda c: pc.binary_length(now[c]).to_numpy().astype(np.int64)
        size = np.concatenate([[0], np.cumsum(length("role") + length("text") + 100)])[edge]
        a = 0
        while a < len(edge) - 1:  # runs of whole conversations of about BYTES bytes
            b = max(a + 1, int(np.searchsorted(size, size[a] + BYTES, "right")) - 1)
            some = now.slice(int(edge[a]), int(edge[b] - edge[a]))
            group = np.repeat(np.arange(b - a), np.diff(edge[a : b + 1]))
            role, text = (pa.concat_arrays(some[c].chunks) for c in ("role", "text"))
            first, strings, loss = format_batch(group, role, text, trained)
            ids = pa.array(conv[edge[a:b]], mask=none[edge[a:b]])
            yield pa.record_batch([ids, strings.cast(pa.string()), loss], ["conv_id", "formatted", "loss"])
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_key = [], None  # parts of the conversation that is not ended
        for batch in flat.released(batches):
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).select(layout.names).cast(layout)
            key = np.stack([table["conv_id"].to_numpy(), table["none"].to_numpy()])
            if held and (key[:, 0] != open_key).any():
                yield from form(held)
                held = []
            last = int(np.flatnonzero((key != key[:, -1:]).any(0)).max(initial=-1)) + 1
            if last:
                yield from form([*held, table.slice(0, last)])
                held = []
            held.append(table.slice(last))
            open_key = key[:, -1]
        if held:
            yield from form(held)

    clean = rows.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("none"),
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = clean.repartition(n_partitions(bound_batches(rows.sparkSession)), "conv_id", "none").sortWithinPartitions("none", "conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(run, FORMATTED)


TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END), re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def digest(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back and sum up what they hold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in flat.released(frames):
            rows = []
            for conv, text, loss in zip(f["conv_id"], f["formatted"], f["loss"]):
                turns = parse(text)
                trained = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in loss)
                rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest(), len(trained), hashlib.sha256(trained.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out["conv_id"] = out["conv_id"].astype("Int64")
            yield out

    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
