"""A small folder of tables with awkward rows: nulls, empty and long texts, ties, repeated texts, clashing columns."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def awkward(tmp_path_factory):
    d = tmp_path_factory.mktemp("awkward")
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    passage = lambda n: [word() for _ in range(n)]
    shared, texts = [passage(n) for n in (19, 20, 21, 60)], []
    for k in range(90):
        w = passage(rng.randint(0, 60)) + rng.choice(shared) + passage(rng.randint(0, 60))
        texts.append(" ".join(w))
        if k % 3 == 0:  # a near copy
            at = rng.randrange(len(w))
            texts.append("\t".join([*w[:at], word(), *w[at + 1 :]]).upper() if k % 6 else " ".join(w[: len(w) - 1]))
    texts += [None, "", " \t\n", "one", "ONE", "one two three", "One Two three", " ".join(shared[3]) + " " + " ".join(shared[3]), "x " * 30_000, "  　 naïve É", "same words " * 40, *["copy of a text with more than five words"] * 25]
    ids = rng.sample(range(10_000), len(texts))
    sources = [rng.choice(["web", "web", "web", "books", "étude", "Zine", None]) for _ in texts]
    docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts), "lang": pa.array([rng.choice(["aa", "bb", None]) for _ in texts]), "source": pa.array(sources), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64()), "id": pa.array(range(len(texts))), "key": pa.array(["k"] * len(texts)), "size": pa.array([1] * len(texts)), "n": pa.array([1] * len(texts))})
    pq.write_table(docs, d / "documents.parquet")
    vectors = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(240)]
    vectors += [vectors[3]] * 30 + [None, [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] * 8]
    vec_ids = [50, 100, *rng.sample([i for i in range(5000) if i not in (50, 100)], len(vectors) - 2)]
    pq.write_table(pa.table({"vec_id": pa.array(vec_ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(vectors)), "score": pa.array([1.0] * len(vectors))}), d / "embeddings.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(ids[:60], pa.int64()), "quality": pa.array([1, 0, None] * 20), "toxic": pa.array([0, None, 1, 0] * 15)}), d / "labels.parquet")
    empty = tmp_path_factory.mktemp("empty")
    for name in ("documents", "embeddings", "labels"):
        pq.write_table(pq.read_table(d / f"{name}.parquet").slice(0, 0), empty / f"{name}.parquet")
    return str(d), str(empty)
