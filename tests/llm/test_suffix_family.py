"""op4 against brute force."""

import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm import suffix_family as S


def brute(rows):
    texts = [(2**63 - 1 if i is None else i, (t or "").encode("utf-8", "surrogatepass")) for i, t in rows]
    first: dict[bytes, int] = {}
    for i, raw in texts:
        for k in range(len(raw) - S.WINDOW + 1):
            w = raw[k : k + S.WINDOW]
            first[w] = min(i, first.get(w, i))
    out = []
    for (i, raw), (given, _) in zip(texts, rows, strict=True):
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - S.WINDOW + 1):
            if first[raw[k : k + S.WINDOW]] < i:
                gone[k : k + S.WINDOW] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((given, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(k) for k in (8, 12, 15, 40)]
    rows = [(i, text(rng.randint(0, 40)) + rng.choice(shared) + text(rng.randint(0, 40)) + rng.choice(["", *shared])) for i in rng.sample(range(10_000), 120)]
    rows += [(20_000, None), (20_001, ""), (20_002, "short"), (None, rows[0][1]), (20_003, "ab" * 400), (20_004, "ab" * 300 + "c"), (20_005, "\0" * 200), (20_006, "x" + "\0" * 120), (20_007, shared[3] * 30), (20_008, rows[5][1]), (20_008, rows[5][1])]
    rng.shuffle(rows)
    return rows


def test_brute(spark):
    rows = made()
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, id int, at string").repartition(3)
    got = [(r.id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in S.dedup(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_small_limits_in_process(monkeypatch):
    """Several pieces, flushes, batches and levels, which workers of a session wouldn't see changed."""
    for k, v in dict(RUN=5, PIECE=300, HELD=50, BATCH=16).items():
        monkeypatch.setattr(S, k, v)
    rows, groups, parts = made(), 3, 2
    every = SimpleNamespace(value=SimpleNamespace(hold=lambda h: np.ones(len(h), bool)))
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in x], pa.int64()), pa.array([r[1] for r in x], pa.string())], names=["id", "text"]) for x in (rows[:40], rows[40:90], rows[90:])]
    sent = pa.Table.from_batches([o for task in (batches[:1], batches[1:]) for o in S._second(every, groups, parts)(iter(task))])
    found = pa.concat_tables([S._group(parts, None, sent.filter(pc.equal(sent["bucket"], k))) for k in range(groups)])
    spans = {}
    for k in range(parts):
        t = S._by_id(None, found.filter(pc.equal(found["part"], k))).to_pylist()
        spans |= {r["id"]: r["at"] for r in t}
    got = []
    for i, t in rows:
        n, removed, count, kept = S._digest(t, spans.get(2**63 - 1 if i is None else i))
        got.append((i, n, removed, count, hashlib.sha256(kept).hexdigest()))
    assert sorted(got, key=str) == brute(rows)


def test_family_keeps_logarithmic_levels():
    rng, family, seen = np.random.default_rng(1), S.Family(), {}
    for batch in range(13):
        ids = np.sort(rng.integers(batch * 10, batch * 10 + 12, 50))
        strings = rng.integers(0, 60, 50).astype("S4")
        got = family.add(strings, ids)
        for s, i in zip(strings, ids, strict=True):
            seen[s] = min(i, seen.get(s, i))
        assert got.tolist() == [bool(i > seen[s]) for s, i in zip(strings, ids, strict=True)]
        assert len(family.levels) == bin(batch + 1).count("1")


def test_empty(spark):
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
