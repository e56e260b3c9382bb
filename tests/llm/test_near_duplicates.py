"""Near-duplicates in regions of many classes, against brute force."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tessera.llm import lsh_forest

from . import brute


def template(rng, name, copies=60, words=400, edits=5):
    """A text and copies with edits of their own: 5 words are 25 of 396 shingles, so 0.88 to the text and 0.78 to each other."""
    base = [f"{name}{k}" for k in range(words)]
    out = [base]
    for c in range(copies):
        w = list(base)
        for at in rng.sample(range(5, words - 5, 6), edits):
            w[at] = f"{name}x{c}x{at}"
        out.append(w)
    return [" ".join(w) for w in out]


def test_template_without_smallest_id(spark):
    rng = random.Random(5)
    docs = []
    for k in range(4):
        ids = rng.sample(range(1000 * k, 1000 * k + 1000), 61)
        low, ids[0] = min(ids), sorted(ids)[30]  # the template is in the middle
        ids = [ids[0], *[i for i in dict.fromkeys([*ids[1:], low]) if i != ids[0]]]
        docs += list(zip(ids, template(rng, "abcd"[k]), strict=False))
    got = lsh_forest.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute.near(docs)


def test_threshold_of_the_stage(spark):
    """4 words of 212 replaced: 188 of 228 shingles, 0.82; a copy with 6 is below 0.8."""
    rng, docs = random.Random(6), []
    for k in range(30):
        base = [f"{k}w{j}" for j in range(212)]
        for c, edits in enumerate((0, 4, 6)):
            w = list(base)
            for at in range(10, 10 + 30 * edits, 30):
                w[at] = f"{k}x{c}x{at}"
            docs.append((3 * k + c, " ".join(w)))
    rng.shuffle(docs)
    assert lsh_forest.region_depth(85) == 4 and lsh_forest.region_depth(80) == 3
    rows = spark.createDataFrame([(i, t, "aa", "web", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    want = {p: sorted(i for i, _, _, kept in brute.near(docs, percent=p) if kept) for p in (80, 85)}
    assert len(want[80]) == 60 and len(want[85]) == 90
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows, "").collect()) == want[80]
    assert sorted(r.id for r in lsh_forest.near_duplicates(rows).where("kept").collect()) == want[85]


def test_family_that_is_not_linked(spark):
    """Copies of a template that are linked in twos only: no pair of a large region is lost."""
    rng, docs, base = random.Random(8), [], [f"t{k}" for k in range(400)]
    for k in range(120):
        one = list(base)
        for at in rng.sample(range(5, 395, 6), 6):
            one[at] = f"d{k}x{at}"
        two = list(one)
        for at in rng.sample(range(8, 395, 6), 5):
            two[at] = f"e{k}x{at}"
        docs += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
    want = brute.near(docs)
    assert len({c for _, _, c, _ in want}) >= 115
    got = lsh_forest.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got)) == want


def test_region_between_two_tasks():
    """Rows of a region of at most SMALL on both sides of a border are given twice, to meet later; others aren't."""
    label = lambda k: np.array([k, 1, 2, 3, 4, 5, 6, 7], ">u4").tobytes()
    rows = [(0, label(k), i, 10) for i, k in enumerate([1, 1, 2, 2, 2, 3, *[4] * 20, 5, 5, 5])]
    for sizes in ([4, 25], [3, 1, 25], [10, 19], [29]):
        batches, at = [], 0
        for n in sizes:
            tree, lab, ids, m = zip(*rows[at : at + n], strict=True)
            batches.append(pa.RecordBatch.from_pydict({"tree": pa.array(tree, pa.int32()), "label": pa.array(lab, pa.binary()), "id": pa.array(ids), "n": pa.array(m)}))
            at += n
        out = [r for b in lsh_forest._neighbours(85, 4, iter(batches)) for r in b.to_pylist()]
        assert sorted(r["id"] for r in out if r["id"] is not None) == [0, 1, 26, 27, 28]
        assert {(r["a"], r["b"]) for r in out if r["small"]} == {(0, 1), (2, 3), (2, 4), (3, 4), (26, 27), (26, 28), (27, 28)}


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([rng.integers(0, 50, rng.integers(0, 40)), rng.integers(0, 10**6, 30), [7] * (k % 2)])).astype(np.uint64) for k in range(60)]
    got = lsh_forest.intersections(sets[:25], sets[25:])
    assert got.astype(int).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[25:]] for a in sets[:25]]
