"""Substring dedup with a count-min prefilter.

Every window of N words is hashed. Partitions count their windows in a count-min sketch of DEPTH rows of 2**CELL_BITS
counters, kept sparse and cut into segments of 2**16 counters, which are merged by segment. A window whose counters
all reach 2 is estimated repeated: the sketch never underestimates, so no repeated window is missed. A second
pass sends only those windows, by 96-bit hash, to exact groups in which all but the first occurrence are marked;
a task sends just its own first occurrence and marks the others itself, so a window that a third of all
documents hold costs a row per task. A last pass removes the marked words.

Scale: what is broadcast is DEPTH bitmaps of 2**CELL_BITS bits (64 MB) and a bitmap of ids (4 MB), whatever
the input. Beyond some 10**9 windows the sketch fills and lets more windows through: results stay exact and more
rows are grouped; raise CELL_BITS for larger corpora. Texts without marks never leave their scan task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stow, free_shuffles, table
from .lsh_forest import hit, id_bitmap
from .words import U, batches, mix, windows

N, DEPTH, CELL_BITS, SEGMENT = 20, 2, 28, 16
#: Windows that a task combines at once: hashes alone, and with their places.
RUN, HELD = 1 << 22, 1 << 19
#: Windows estimated repeated in a group of exact counting, about.
GROUP = 1 << 20
#: Marked places in one packed row.
PACK = 1 << 18
LAST = np.int64(2**63 - 1)


def _ids(col: pa.Array) -> np.ndarray:
    """Ids as int64; null ids come after all others."""
    return col.fill_null(int(LAST)).to_numpy(zero_copy_only=False)


def _windows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, more bits of the hash, id, start) of the windows of runs of texts."""
    ids = _ids(batch.column(0))
    for i, j, w in batches(batch.column(1).to_pylist(), 2):
        if len(w.start) < N:
            continue
        doc = np.repeat(np.arange(i, j), w.count)
        start = np.arange(len(doc)) - np.repeat(w.first[:-1], w.count)
        ok = doc[: len(doc) - N + 1] == doc[N - 1 :]
        h = [windows(x, N)[ok] for x in w.hashes]
        at = np.flatnonzero(ok)
        yield h[0], h[1] >> U(32), ids[doc[at]], start[at]


def cells(h: np.ndarray) -> Iterator[np.ndarray]:
    for d in range(DEPTH):
        yield (mix(h + U(d * 0x9E3779B9 + 1)) >> U(64 - CELL_BITS)).astype(np.int64)


def _sketch(strings, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: list[np.ndarray] = []

    def out() -> Iterator[pa.RecordBatch]:
        h = np.concatenate(kept) if kept else np.zeros(0, U)
        kept.clear()
        for d, c in enumerate(cells(h)):
            c, n = np.unique(c, return_counts=True)
            n = np.minimum(n, 255).astype(np.uint8)
            low = (c & ((1 << SEGMENT) - 1)).astype(np.uint16)
            seg, at = np.unique(c >> SEGMENT, return_index=True)
            ends = [*at[1:], len(c)]
            for lo in range(0, len(seg), 512):
                part = range(lo, min(len(seg), lo + 512))
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([d << (CELL_BITS - SEGMENT) | int(seg[k]) for k in part], pa.int32()),
                    "cells": pa.array([low[at[k] : ends[k]].tobytes() for k in part], pa.binary()),
                    "counts": pa.array([None if n[at[k] : ends[k]].max() == 1 else n[at[k] : ends[k]].tobytes() for k in part], pa.binary()),
                })

    for batch in it:
        for h, _, _, _ in strings(batch):
            kept.append(h)
            if sum(map(len, kept)) > RUN:
                yield from out()
    yield from out()


def _merge(key, t):
    total = np.zeros(1 << SEGMENT, np.int64)
    for c, n in zip(t["cells"], t["counts"], strict=True):
        c = np.frombuffer(c.as_buffer(), np.uint16)
        total[c] += np.frombuffer(n.as_buffer(), np.uint8) if n.is_valid else 1
    more = total > 1
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(more).tobytes()], pa.binary()), "n": pa.array([int(total[more].sum())], pa.int64())})


class Repeated:
    """The merged sketch: bitmaps of the counters of at least 2."""

    def __init__(self, docs: DataFrame, strings=_windows):
        got = docs.mapInArrow(partial(_sketch, strings), "segment int, cells binary, counts binary").groupBy("segment").applyInArrow(_merge, "segment int, bits binary, n long").toArrow()
        self.bits = np.zeros((DEPTH << (CELL_BITS - SEGMENT), 1 << (SEGMENT - 3)), np.uint8)
        for s, b in zip(got["segment"].to_pylist(), got["bits"], strict=True):
            self.bits[s] = np.frombuffer(b.as_buffer(), np.uint8)
        self.bits = self.bits.reshape(DEPTH, -1)
        #: Windows estimated repeated, at most.
        self.n = sum(got["n"].to_pylist()) // DEPTH

    def hold(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for row, c in zip(self.bits, cells(h), strict=True):
            out &= (row[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def _firsts(h: np.ndarray, more: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by window, then place; and whether the entry there is its window's first place or level with it."""
    order = np.lexsort((at, doc, more, h))
    h, more, doc, at = h[order], more[order], doc[order], at[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (more[1:] != more[:-1])]) if len(h) else np.zeros(0, bool)
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
    return order, (doc == doc[lead]) & (at == at[lead])


def _packs(doc: np.ndarray, at: np.ndarray, parts: int) -> tuple[list[int], list[bytes]]:
    """Marked places as (part of the ids, packed ids and places), of at most PACK places each, in the order given."""
    part = (mix(doc.view(U)) % U(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    doc, at, part = doc[order], at[order].astype(np.uint32), part[order]
    cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
    spans = [(x, min(y, x + PACK)) for lo, y in zip(cut, cut[1:], strict=False) for x in range(lo, y, PACK)]
    return [int(part[x]) for x, _ in spans], [np.diff(doc[x:y], prepend=np.int64(0)).tobytes() + at[x:y].tobytes() for x, y in spans]


def _by_id(key, t):
    """The marks of a part of the ids as one row per id: (first, last) of each run of consecutive places."""
    packs = [x.as_buffer() for x in t["packed"]]
    doc = np.concatenate([np.frombuffer(x, np.int64, x.size // 12).cumsum() for x in packs])
    at = np.concatenate([np.frombuffer(x, np.uint32, x.size // 12, 8 * (x.size // 12)) for x in packs])
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    other = doc[1:] != doc[:-1]
    cut = np.flatnonzero(other | (at[1:] > at[:-1] + np.uint32(1))) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(doc)]])
    runs = np.stack([at[lo], at[hi - 1]], 1)
    of = doc[lo]
    ends = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)]
    return pa.table({"id": pa.array(of[ends[:-1]], pa.int64()), "runs": pa.array([runs[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)], pa.binary())})


def _second(shared, groups: int, parts: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, kept = shared.value, []

        def out() -> Iterator[pa.RecordBatch]:
            h, more, doc, at = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
            kept.clear()
            order, first = _firsts(h, more, doc, at)
            later = np.sort(order[~first])
            for part, packed in zip(*_packs(doc[later], at[later], parts), strict=True):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([part % groups], pa.int32()), "part": pa.array([part], pa.int32()), "packed": pa.array([packed], pa.binary())})
            lead = order[first]
            lead.sort()
            to = (mix(h[lead] + U(99)) % U(groups)).astype(np.int32)
            lead = lead[np.argsort(to, kind="stable")]
            b, cut = np.unique(np.sort(to), return_index=True)
            ends = [*cut[1:], len(lead)]
            for k, (x, y) in enumerate(zip(cut, ends, strict=False)):
                i = lead[x:y]
                packed = h[i].tobytes() + more[i].astype(np.uint32).tobytes() + np.diff(doc[i], prepend=np.int64(0)).tobytes() + at[i].astype(np.uint32).tobytes()
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b[k]], pa.int32()), "part": pa.nulls(1, pa.int32()), "packed": pa.array([packed], pa.binary())})

        for batch in it:
            for h, more, doc, at in _windows(batch):
                ok = rep.hold(h)
                kept.append((h[ok], more[ok], doc[ok], at[ok]))
                if sum(len(x[0]) for x in kept) > HELD:
                    yield from out()
        yield from out()

    return run


def _group(parts: int, key, t):
    """Marks of a bucket, packed: those passed on, and all but the first place of each window."""
    cols: list[tuple] = []
    for x in t.filter(t["part"].is_null())["packed"]:
        x = x.as_buffer()
        n = x.size // 24
        cols.append((np.frombuffer(x, U, n), np.frombuffer(x, np.uint32, n, 8 * n), np.frombuffer(x, np.int64, n, 12 * n).cumsum(), np.frombuffer(x, np.uint32, n, 20 * n)))
    passed = t.filter(t["part"].is_valid()).select(["part", "packed"])
    if not cols:
        return passed
    h, more, doc, at = (np.concatenate(x) for x in zip(*cols, strict=True))
    order, first = _firsts(h, more, doc, at)
    later = np.sort(order[~first])
    part, packed = _packs(doc[later], at[later], parts)
    return pa.concat_tables([passed, pa.table({"part": pa.array(part, pa.int32()), "packed": pa.array(packed, pa.binary())})])


def _digest(raw: bytes, runs: bytes | None) -> tuple[int, int, bytes]:
    words = raw.split()
    kept = words
    if runs and len(words) >= N:
        marks = np.frombuffer(runs, np.uint32).reshape(-1, 2).astype(np.int64)
        marks = marks[marks[:, 0] + N <= len(words)]  # an id can have texts of several lengths
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, marks[:, 0], 1)
        np.subtract.at(gone, np.minimum(marks[:, 1] + N, len(words)), 1)
        kept = list(compress(words, np.cumsum(gone[:-1]) <= 0))
    return len(words), len(words) - len(kept), b" ".join(kept)


def _rows(ids: pa.Array, done: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *(pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary())))], names=["id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept) per row of docs; kept is the remaining words joined by one space (binary).

    A word goes if a window of N words that covers it starts elsewhere earlier: in a smaller id, or earlier in the same
    one. Null and empty texts have no words. Null ids come after all others and count as one id. Rows that share an
    id share its places: with equal texts neither is earlier than the other. Other columns are ignored.
    """
    spark = docs.sparkSession
    stow = Stow(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rep = Repeated(rows)
    groups = max(1, -(-rep.n // GROUP))
    shared = spark.sparkContext.broadcast(rep)
    # a part of the ids gets a pack from each bucket, not each id one: rows don't grow with ids times buckets
    found = rows.mapInArrow(_second(shared, groups, groups), "bucket int, part int, packed binary").repartition(groups, "bucket")
    packs = found.groupBy("bucket").applyInArrow(partial(_group, groups), "part int, packed binary")
    by_id = stow.put(packs.repartition(groups, "part").groupBy("part").applyInArrow(_by_id, "id long, runs binary"), "marks")
    shared.unpersist()
    del found, packs
    free_shuffles(spark)
    flagged = spark.sparkContext.broadcast(id_bitmap(by_id))

    def touched(part: pa.RecordBatch) -> np.ndarray:
        return hit(flagged.value, _ids(part.column(0)))

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            batch = batch.filter(pa.array(~touched(batch)))
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield _rows(part["id"], [_digest((t or "").encode("utf-8", "surrogatepass"), None) for t in part["text"].to_pylist()])

    def marked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.filter(pa.array(touched(batch)))

    def remove(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield _rows(part["id"], [_digest((t or "").encode("utf-8", "surrogatepass"), a) for t, a in zip(part["text"].to_pylist(), part["runs"].to_pylist(), strict=True)])

    schema = "id long, n_words long, n_removed long, kept binary"
    # by_id grows with the corpus; broadcast, it would also put two Python workers into each task of this stage
    joined = rows.mapInArrow(marked, "id long, text string").withColumn("key", F.coalesce("id", F.lit(int(LAST)))).join(by_id.withColumnRenamed("id", "key").hint("merge"), "key", "left").select("id", "text", "runs")
    return rows.mapInArrow(whole, schema).unionByName(joined.mapInArrow(remove, schema))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's words, words removed and the hash of what is kept."""
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
