"""Blocks as arrays: postings of blocks that go over batches, scores of many groups."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from loquat.operators import blockmax

rng = np.random.default_rng(3)


def impact(f, length, mean):
    return f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))


def test_blocks_may_go_over_batches():
    chunks = [(b, s, [f"w{i}" for i in rng.integers(0, 9, rng.integers(0, 12))]) for b in (1, 2, 5, 6, 9) for s in range(rng.integers(1, 8))]
    table = pa.table({"block": pa.array([c[0] for c in chunks], pa.int64()), "slot": pa.array([c[1] for c in chunks], pa.int32()), "len": pa.array([len(c[2]) for c in chunks], pa.int32()), "w": pa.array([" ".join(c[2]) for c in chunks])})
    want = {}
    for b, s, w in chunks:
        for token, f in Counter(w).items():
            want.setdefault((b, token), []).append({"slot": s, "f": f})
    for size in (1, 2, 3, 7, 100):
        got = [r for x in blockmax._pack(5.0)(iter(table.to_batches(size))) for r in x.to_pylist()]
        assert {(r["block"], r["token"]): r["docs"] for r in got} == want and len(got) == len(want)
        length = {(b, s): len(w) for b, s, w in chunks}
        assert all(r["n"] == len(r["docs"]) and np.isclose(r["impact"], max(impact(d["f"], length[r["block"], d["slot"]], 5.0) for d in r["docs"])) for r in got)
    assert not list(blockmax._pack(5.0)(iter([])))


def blocks(n, terms):
    """(batches, postings): held blocks of eight chunks of `terms` terms."""
    rows, postings = [], {}
    for b in range(n):
        counts = rng.integers(0, 4, (8, terms)) * (rng.random((8, terms)) < 0.5)
        length = counts.sum(1) + rng.integers(1, 30, 8)
        f = [{"term": 10 * t, "n": int((counts[:, t] > 0).sum()), "impact": max(impact(counts[s, t], length[s], 20.0) for s in range(8) if counts[s, t]), "docs": [{"slot": s, "f": int(counts[s, t])} for s in range(8) if counts[s, t]]} for t in range(terms) if counts[:, t].any()]
        rows.append({"block": b, "f": f, "members": [{"slot": s, "id": f"c{b}_{s}", "len": int(length[s]), "kept": s != 3} for s in range(8)]})
        postings |= {f"c{b}_{s}": (counts[s], length[s]) for s in range(8) if s != 3}
    kind = pa.schema([("block", pa.int64()), ("f", pa.list_(pa.struct([("term", pa.int64()), ("n", pa.int32()), ("impact", pa.float64()), ("docs", pa.list_(pa.struct([("slot", pa.int32()), ("f", pa.int32())])))]))), ("members", pa.list_(pa.struct([("slot", pa.int32()), ("id", pa.string()), ("len", pa.int32()), ("kept", pa.bool_())])))])
    return pa.Table.from_pylist(rows, kind).to_batches(3), postings


def test_a_task_makes_few_rows_and_leaves_out_none_of_the_best():
    batches, postings = blocks(300, 12)
    wanted = {g: sorted(rng.choice(12, rng.choice([1, 2, 3, 10]), replace=False)) for g in range(40)} | {40: [0, 12]}
    asked = pa.Table.from_pylist([{"group": g, "mean": 20.0, "parts": [{"term": int(10 * t), "idf": 1.0 + t / 7} for t in ts], "least": float("-inf")} for g, ts in wanted.items()])
    rows = [r for x in blockmax._reached(SimpleNamespace(value=blockmax.Groups(asked)), 5)(iter(batches)) for r in x.to_pylist()]
    every = 0
    for g, ts in wanted.items():
        best = sorted((-sum((1 + t / 7) * impact(f[t], length, 20.0) for t in ts), i) for i, (f, length) in postings.items() if max(ts) < 12 and all(f[t] for t in ts))
        every += len(best)
        got = sorted((-r["score"], r["id"]) for r in rows if r["group"] == g)
        assert [i for _, i in got[:5]] == [i for _, i in best[:5]] and np.allclose([x for x, _ in got[:5]], [x for x, _ in best[:5]])
    assert len(rows) < every / 4
    none = SimpleNamespace(value=blockmax.Groups(asked.slice(0, 0)))  # no group has all its words
    assert not any(x.num_rows for run in (blockmax._reached, blockmax._highest) for x in run(none, 5)(iter(batches)))
