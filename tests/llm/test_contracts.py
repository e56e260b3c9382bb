"""The queries against brute force, on a test table and on awkward rows; each on empty tables."""

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece

from tessera.llm import spm_wfst
from tessera.llm.queries import QUERIES

from . import brute
from .conftest import SF


@pytest.fixture(params=["table", "awkward"])
def folder(request, awkward):
    return SF if request.param == "table" else awkward[0]


def docs(folder, *more):
    return [tuple(r.values()) for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text", *more]).to_pylist()]


def run(spark, name, folder, *cols):
    return sorted((tuple(r[c] for c in cols) for r in QUERIES[name](spark, folder).collect()), key=repr)


def vectors(folder):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{folder}/embeddings.parquet").to_pylist()]
    return [(i, v) for i, v in rows if brute.usable(v)]


def test_mix(spark, folder):
    rows = run(spark, "op1_mix_sources", folder, "doc_id", "size", "source_size", "target", "taken")
    want, source, took = brute.targets(docs(folder, "source")), {i: s for i, _, s in docs(folder, "source")}, {}
    text = dict(docs(folder))
    assert sorted(r[0] for r in rows) == sorted(source)
    for i, size, source_size, target, taken in rows:
        assert size == len(brute.words(text[i])) and 0 <= taken <= 2 * size
        assert source_size == want[source[i]][0] and target == pytest.approx(want[source[i]][1])
        took[source[i]] = took.get(source[i], 0) + taken
    for s, n in took.items():
        assert abs(n - want[s][1]) <= 1
    assert rows == run(spark, "op1_mix_sources", folder, "doc_id", "size", "source_size", "target", "taken")


def test_exact_topk(spark, folder):
    rows = vectors(folder)
    x = np.floor(1024 * np.array([v for _, v in rows], np.float64)).astype(np.int64)
    got = run(spark, "op3_exact_topk", folder, "query_id", "rank", "vec_id", "score")
    assert sorted(got) == brute.top(rows, 100, 10, lambda at: x[at] @ x.T)


def test_near_duplicates(spark, folder):
    got = run(spark, "op6_near_duplicates", folder, "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(got) == brute.near(docs(folder))


def test_substrings(spark, folder):
    got = run(spark, "op7_substring_dedup", folder, "doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(got) == brute.windows(docs(folder))


def test_nearest_neighbours(spark, folder):
    rows = [(i, v) for i, v in vectors(folder) if any(v)]
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = sorted(run(spark, "op9_nearest_neighbours", folder, "query_id", "rank", "vec_id", "score"))
    want = brute.top(rows, 50, 5, lambda at: x[at] @ x.T)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    kth = {q: s for q, r, _, s in want if r == 5}
    place = {i: k for k, (i, _) in enumerate(rows)}
    assert sum(s >= kth[q] - 1e-12 for q, _, _, s in got) >= 0.9 * len(want)
    assert all(s == pytest.approx(float(x[place[q]] @ x[place[v]]), abs=1e-12) for q, _, v, s in got)
    assert all((a[3], -a[2]) >= (b[3], -b[2]) for a, b in zip(got, got[1:], strict=False) if a[0] == b[0])


def test_language(spark, folder):
    got = run(spark, "op10_language_id", folder, "doc_id", "held_out", "lang_pred", "score")
    rows = {i: (t, lang) for i, t, lang in docs(folder, "lang")}
    learned = {lang for i, (t, lang) in rows.items() if lang is not None and not brute.held_out(i)}
    assert sorted(r[0] for r in got) == sorted(rows)
    for i, held, lang, score in got:
        assert held == brute.held_out(i) and 0 <= score <= 1
        assert (lang == "und") == (not any(c.isalpha() for c in rows[i][0] or "")) and lang in learned | {"und"}
    if folder == SF:
        known = [lang == rows[i][1] for i, held, lang, _ in got if held and lang != "und" and rows[i][1] is not None]
        assert sum(known) >= 0.95 * len(known)


def test_pieces(spark, folder):
    model = sentencepiece.SentencePieceProcessor(model_file=spm_wfst.MODEL)
    text = dict(docs(folder))
    got = {r.doc_id: r for r in QUERIES["op8_sentencepiece"](spark, folder).collect()}
    assert sorted(got) == sorted(text)
    for i, t in text.items():
        if t is None:
            assert got[i].ids is None and got[i].n_ids == 0 and got[i].round_trip is None
        else:
            assert got[i].ids == model.encode(t) and got[i].n_ids == len(got[i].ids) and got[i].round_trip


def test_resampling(spark, folder):
    rows = QUERIES["op5_importance_resampling"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs(folder))
    taken, left = [r.key for r in rows if r.selected], [r.key for r in rows if not r.selected]
    assert len(taken) == round(0.5 * len(rows)) and min(taken) > max(left)


def test_pseudonyms(spark, folder):
    got = {r.doc_id: r for r in QUERIES["op2_pii_pseudonyms"](spark, folder).collect()}
    for i, t in docs(folder):
        assert (got[i].text is None) == (t is None) and (got[i].n_pii > 0 or got[i].text == t)
        if t is not None and "ip" not in got[i].kinds:  # octets keep their range, not their number of digits
            assert len(got[i].text) == len(t)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, awkward, name):
    assert QUERIES[name](spark, awkward[1]).collect() == []
