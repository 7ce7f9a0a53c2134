"""Fill-in-middle transformation by rank and select over packed boundaries.

A batch's UTF-8 bytes are one buffer.  Bit i of a packed bitvector is set where
byte i begins a code point; a directory holds the set bits before each block of
512 bits.  Rank counts set bits before a byte: its difference over a text is
the number n of its code points.  Select finds the byte of a set bit by binary
search in the directory, then over the words of the block, then in the word;
the two cuts of a text are selects of its first rank plus the unit counts.  No
text is decoded.

Cuts and form come of a hash of the row's id: the first four groups of 8 hex
digits of sha256('<seed>:<id>') as numbers h1 to h4.  The prefix ends after the
smaller of h1 % (n + 1) and h2 % (n + 1) code points, the middle after the
larger.  `plain` (text as it is) are empty texts, texts that hold a sentinel,
and those with h3 % 100 >= `rate`; of the others those with h4 % 100 < `spm`
are suffix-prefix-middle, the rest prefix-suffix-middle.

Defined results: null text is empty, so plain with n = 0; a null id hashes as
the empty string; repeated rows and ids give equal results; a text of one code
point has empty parts; an empty table gives an empty table; other columns pass
through, and an `output` that is a column already is an error.  A row is never
split, so a task holds one batch (bounded by bytes) or one text."""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat
from .shared import bound_batches, fresh

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"  # sentinels of the contract
WORDS = 8  # 64-bit words of a directory block
ADDED = "form: string, n: bigint, prefix_chars: bigint, middle_chars: bigint, text: string"


class Boundaries:
    """Rank and select over the code-point starts of a byte buffer."""

    def __init__(self, data: np.ndarray):
        bits = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        blocks = len(data) // (64 * WORDS) + 1
        room = np.zeros(blocks * WORDS * 8, np.uint8)
        room[: len(bits)] = bits
        self.words = room.view("<u8").reshape(blocks, WORDS)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.within = np.cumsum(counts, 1) - counts  # set bits of the block before each word
        self.before = np.concatenate([[0], np.cumsum(counts.sum(1))])  # and before each block

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that begin before each byte position."""
        at = np.asarray(at, np.int64)
        word = at >> 6
        block, w = word // WORDS, word % WORDS
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + self.within[block, w] + np.bitwise_count(self.words[block, w] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte of the k-th code point, from 0; k below their number."""
        k = np.asarray(k, np.int64)
        block = np.searchsorted(self.before, k, "right") - 1
        left = k - self.before[block]
        w = (self.within[block] <= left[:, None]).sum(1) - 1
        left -= self.within[block, w]
        word, place = self.words[block, w].copy(), np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):  # the half that holds the bit
            low = word & np.uint64((1 << half) - 1)
            count = np.bitwise_count(low).astype(np.int64)
            up = left >= count
            left -= np.where(up, count, 0)
            place += np.where(up, half, 0)
            word = np.where(up, word >> np.uint64(half), low)
        return (block * WORDS + w) * 64 + place


def hashes(ids: list, seed: str) -> np.ndarray:
    """(rows, 4): the first four 8-digit groups of the id's sha256."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, memoryview]:
    """Bytes and offsets of a string column; nulls have length 0."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = memoryview(data or b"")[at[0] : at[-1]]
    return np.frombuffer(data, np.uint8), at - at[0], data


def transform_batch(ids: list, column: pa.Array, seed: str, rate: int, spm: int) -> pa.RecordBatch:
    size = len(column)
    data, at, view = _strings(column)
    marks = Boundaries(data)
    first = marks.rank(at)
    n = np.diff(first)
    h = hashes(ids, seed)
    a, b = np.sort(h[:, :2] % (n + 1)[:, None], 1).T
    held = np.zeros(size, bool)
    for s in (PREFIX, SUFFIX, MIDDLE):
        held |= pc.fill_null(pc.match_substring(column, s.decode()), False).to_numpy(zero_copy_only=False)
    plain = (n == 0) | held | (h[:, 2] % 100 >= rate)
    suffix_first = ~plain & (h[:, 3] % 100 < spm)
    cut = np.full((2, size), len(data), np.int64)  # behind the last code point there is none to select
    for row, units in zip(cut, (a, b)):
        k = first[:-1] + units
        inside = k < first[-1]
        row[inside] = marks.select(k[inside])
    cut = np.minimum(cut, at[1:])  # a cut at a text's end is where the next one begins
    parts = []
    for i in range(size):
        lo, p, m, hi = at[i], cut[0, i], cut[1, i], at[i + 1]
        if plain[i]:
            parts.append(view[lo:hi])
        elif suffix_first[i]:
            parts += [SUFFIX, view[m:hi], PREFIX, view[lo:p], MIDDLE, view[p:m]]
        else:
            parts += [PREFIX, view[lo:p], SUFFIX, view[m:hi], MIDDLE, view[p:m]]
    lengths = np.diff(at) + np.where(plain, 0, len(PREFIX) + len(SUFFIX) + len(MIDDLE))
    out = pa.StringArray.from_buffers(size, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.py_buffer(b"".join(parts)))
    form = pa.array(np.where(plain, "plain", np.where(suffix_first, "spm", "psm")), pa.string())
    return pa.record_batch([form, pa.array(n), pa.array(a, mask=plain), pa.array(b - a, mask=plain), out], ["form", "n", "prefix_chars", "middle_chars", "text"])


def fill_in_middle(docs: DataFrame, seed: str = "1", rate: int = 90, spm: int = 20, id: str = "doc_id", text: str = "text", output: str = "fim") -> DataFrame:
    """Add `output`: struct of form, n, prefix_chars, middle_chars (null if
    plain) and the transformed text."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf(f"struct<{ADDED}>")
    def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
        made = transform_batch(ids.to_pylist(), texts, seed, rate, spm)
        flat.release()
        return pa.StructArray.from_arrays(made.columns, made.schema.names)

    return docs.withColumn(fresh(docs, output), run(F.col(f"`{id}`").cast("string"), F.col(f"`{text}`").cast("string")))


def restore(text: Column, form: Column) -> Column:
    """The original of a transformed text: no text that is cut holds a
    sentinel, so the first one found is the one put in."""
    rest = F.substr(text, F.lit(len(PREFIX) + 1))
    inner = F.when(form == "psm", SUFFIX.decode()).otherwise(PREFIX.decode())
    i = F.position(inner, rest)
    j = F.position(F.lit(MIDDLE.decode()), rest)
    one, two = F.substr(rest, F.lit(1), i - 1), F.substr(rest, i + len(SUFFIX), j - i - len(SUFFIX))
    middle = F.substr(rest, j + len(MIDDLE))
    return F.when(form == "plain", text).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
