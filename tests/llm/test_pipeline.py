"""run() and the stages against plain versions, on the test table and on awkward rows with repeated and null ids."""

import hashlib
import math
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash

import corpus_pipeline
from tessera.llm import langid, pii, spm_wfst

from . import brute, plain_pii
from .conftest import SF
from .test_learned import plain_predictions

NAMES = corpus_pipeline.COLUMNS
PERSONAL = "Call +1 (555) 223-4567 or write to jo.doe@mail.example.org before 2024-05-17, card 4111 1111 1111 1111."


@pytest.fixture(params=["table", "awkward"])
def folder(request, awkward, tmp_path):
    if request.param == "table":
        return SF
    t = pq.read_table(f"{awkward[0]}/documents.parquet")
    rows = t.to_pylist()
    again = [dict(r) for r in rows[:20]]  # whole rows twice
    unnamed = [dict(r, doc_id=None) for r in rows[20:30]]
    named = [dict(rows[k], doc_id=20_000 + k, text=f"{rows[k]['text']} {PERSONAL} {k}") for k in range(5)]
    pq.write_table(pa.Table.from_pylist(rows + again + unnamed + named, t.schema), tmp_path / "documents.parquet")
    return str(tmp_path)


def tuples(df):
    return [tuple(r[c] for c in NAMES) for r in df.collect()]


def plain_near(rows):
    """A document of each group, each of its texts once; rows without an id."""
    kept = {i for i, _, _, k in brute.near([(i, t) for i, t in {(r[0], r[1]) for r in rows} if i is not None], percent=80) if k}
    out, seen = [], set()
    for r in rows:
        if r[0] is None or r[0] in kept and r[:2] not in seen:
            out.append(r)
            seen.add(r[:2])
    return out


def plain_pseudonyms(rows):
    out = []
    for i, text, lang, source, n in rows:
        new, found = plain_pii.pseudonymise(text, pii.KEY)
        out.append((i, new, lang, source, len(new) if found else n))
    return out


def row_hash(row):
    """Spark's hash of a row: one column seeds the next, nulls are passed over."""
    h = 42
    for x in row:
        if x is not None:
            h = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else x.to_bytes(8, "little", signed=True), h)
    return h - (h >> 63 << 64)


def plain_mixture(rows):
    """Whole documents in the order of their hash, up to each source's target, twice at most."""
    target, out = brute.targets([(r[0], r[1], r[3]) for r in rows]), []
    for source, (total, words) in target.items():
        mine = []
        for r in rows:
            if r[3] == source:
                key = f"mix{'' if r[0] is None else r[0]}|{row_hash(r)}"
                mine.append((hashlib.md5(key.encode()).hexdigest(), len(brute.words(r[1])), r))
        for epoch in range(2):
            at = epoch * total
            for _, n, r in sorted(mine, key=lambda m: m[:2]):
                if n and 2 * max(0, math.floor(words + 0.5) - at) >= n:
                    out.append(r)
                at += n
    return out


def check_language(rows, kept):
    """Rows with a clear share of known grams stay or go as they should; the rest is within the filters' error."""
    want = plain_predictions([(k, r[1], r[2] if r[0] is not None and not brute.held_out(r[0]) else None) for k, r in enumerate(rows)])
    unlabelled, labels = Counter(r[:2] + r[3:] for r in kept), {}
    for r in kept:
        labels.setdefault(r[:2], set()).add(r[2])
    for k, r in enumerate(rows):
        votes, n = want[k]
        best, lettered = max(votes.values(), default=0), any(c.isalpha() for c in r[1] or "")
        there = unlabelled[r[:2] + r[3:]] > 0
        if not lettered or not n or best / n < corpus_pipeline.LEAST_SCORE - 0.03 - 1 / n:
            assert not there
        elif best / n >= corpus_pipeline.LEAST_SCORE + 0.03 + 1 / n:
            assert there and all(votes[lang] >= best - 0.02 * n - 1 for lang in labels[r[:2]])
    assert not unlabelled - Counter(r[:2] + r[3:] for r in rows)


def test_run(spark, folder):
    rows = [tuple(r.values()) for r in pq.read_table(f"{folder}/documents.parquet", columns=NAMES).to_pylist()]
    kept = tuples(corpus_pipeline.language_id(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder))
    check_language(rows, kept)
    assert len(kept) >= 20

    def again(rows):
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    near = plain_near(kept)
    assert sorted(tuples(corpus_pipeline.near_duplicates(spark, again(kept), folder)), key=repr) == sorted(near, key=repr)
    clean = plain_pseudonyms(near)
    assert clean != near
    assert sorted(tuples(corpus_pipeline.pseudonyms(spark, again(near), folder)), key=repr) == sorted(clean, key=repr)
    mix = plain_mixture(clean)
    assert Counter(tuples(corpus_pipeline.mixture(spark, again(clean), folder))) == Counter(mix)
    model = sentencepiece.SentencePieceProcessor(model_file=spm_wfst.MODEL)
    want = Counter(r + (tuple(model.encode(r[1])),) for r in mix)
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter(tuple(r[c] for c in NAMES) + (tuple(r.ids),) for r in out) == want
    assert all(r.n_ids == len(r.ids) for r in out)


def test_language_of_texts_without_letters(spark):
    rows = spark.createDataFrame([(1, None, "aa", "web", None), (2, "", "aa", "web", 0), (3, "12 34", "aa", "web", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.language_id(spark, rows, "").collect() == []
    assert langid.FLOOR > 0
