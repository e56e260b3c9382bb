"""Long repeated substrings with a logarithmic family of suffix arrays.

Every WINDOW-byte string has a key, the least hash of its GRAM-byte substrings, so equal strings have equal keys and
consecutive strings mostly share one: a text is a sequence of runs. Runs whose key a merged sketch estimates to occur
once are done; the others are dealt to buckets by key. A task sends each distinct run once, with its smallest id, and marks
the other documents that hold it itself, so a passage in a third of all documents is a row per task.

In a bucket, runs come in batches by rising id. A batch gets a suffix array (its strings in order of their bytes), which
is merge-scanned with itself and with the arrays of the family for strings that a smaller id has; then it joins the
family, in which two arrays of as many batches are merged into one, so n batches leave at most log2(n) + 1 arrays.
Comparisons are of whole strings, not of hashes. The marked spans are removed in a last pass over the texts.

Scale: broadcast are the sketch's bitmaps and a bitmap of ids, both of fixed size. The number of buckets follows the
number of runs estimated repeated. Texts are cut into overlapping pieces for hashing, so memory doesn't grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stow, chunks, free_shuffles, table
from .lsh_forest import hit, id_bitmap
from .substring_cms import _ids, Repeated
from .words import U, lane, mix

WINDOW, GRAM = 50, 25
#: Strings of a run, at most; bytes hashed at once; distinct runs that a task holds; runs of a batch; runs of a bucket, about.
RUN, PIECE, HELD, BATCH, GROUP = 64, 1 << 20, 1 << 18, 1 << 13, 1 << 16


def _pieces(texts: list) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """(text of each byte, the bytes, where each text starts in them, and at what place of the text) of runs of texts; long texts are cut, overlapping."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    for i, j in chunks(raw, PIECE):
        if j == i + 1 and len(raw[i]) > PIECE:
            for at in range(0, len(raw[i]) - WINDOW + 1, PIECE):
                part = raw[i][at : at + PIECE + WINDOW - 1]
                yield np.full(len(part), i), part, np.zeros(1, np.int64), np.array([at])
        else:
            n = [len(x) for x in raw[i:j]]
            yield np.repeat(np.arange(i, j), n), b"".join(raw[i:j]), np.cumsum([0, *n[:-1]]), np.zeros(j - i, np.int64)


def runs(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """(key, text, place in the text, place in the bytes, number of strings, bytes) of consecutive strings with one key."""
    own = lane(0)
    for doc, raw, starts, offsets in _pieces(texts):
        if len(raw) < WINDOW:
            continue
        data = np.frombuffer(raw, np.uint8)
        up, down = own.powers(len(data) + 1)
        total = np.concatenate([[U(0)], np.cumsum(own.values[data] * up[: len(data)], dtype=U)])
        least = mix((total[GRAM:] - total[:-GRAM]) * down[: len(total) - GRAM])
        width, span = 1, WINDOW - GRAM + 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        n = len(data) - WINDOW + 1
        ok = doc[:n] == doc[WINDOW - 1 :]
        edge = np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:n] != doc[: n - 1]) | (ok[1:] != ok[:-1])])
        first = np.flatnonzero(edge)
        size = np.diff(np.append(first, n))
        good = ok[first]
        first, size = first[good], size[good]
        text = doc[first]
        k = text - doc[0]
        yield least[first], text, first - starts[k] + offsets[k], first, size, raw


def _keys(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    for key, text, *_ in runs(batch.column(1).to_pylist()):
        # a key counts once for a text, so that periodic texts aren't all candidates
        order = np.lexsort((text, key))
        k, t = key[order], text[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])]) if len(k) else np.zeros(0, bool)
        yield k[new], None, None, None


def spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Disjoint sorted [lo, hi) pairs that cover the same places."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order]) if len(hi) else hi
    cut = np.concatenate([[True], lo[1:] > hi[:-1]]) if len(lo) else np.zeros(0, bool)
    at = np.flatnonzero(cut)
    return np.stack([lo[at], hi[np.append(at[1:], len(lo)) - 1] if len(lo) else hi], 1).astype(np.int64)


def _mark_rows(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, parts: int) -> pa.Table:
    """Marked string starts [lo, hi) as packed triples with their id, a row for each part of the ids."""
    part = (mix(ids.view(U)) % U(parts)).astype(np.int32)
    order = np.lexsort((lo, ids, part))
    part, ids, lo, hi = part[order], ids[order], lo[order], hi[order]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (lo[1:] != hi[:-1])]) if len(ids) else np.zeros(0, bool)
    at = np.flatnonzero(new)  # stretches that follow each other are one
    rows = np.stack([ids[at], lo[at], hi[np.append(at[1:], len(ids)) - 1] if len(ids) else hi], 1)
    own, cut = np.unique(part[at], return_index=True)
    return pa.table({"part": pa.array(own, pa.int32()), "marks": pa.array([x.tobytes() for x in np.split(rows, cut[1:])[: len(own)]], pa.binary())})


def _by_id(key, t):
    """One row for each id of a part: its spans, as packed pairs."""
    m = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in t["marks"]]).reshape(-1, 3)
    m = m[np.argsort(m[:, 0], kind="stable")]
    ids, cut = np.unique(m[:, 0], return_index=True)
    return pa.table({"id": pa.array(ids, pa.int64()), "at": pa.array([spans(x[:, 1], x[:, 2]).tobytes() for x in np.split(m, cut[1:])[: len(ids)]], pa.binary())})


def _second(shared, groups: int, parts: int):
    """Rows of distinct runs for the buckets (packed) and of marks by part."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep = shared.value
        best: dict[bytes, tuple] = {}  # a run's bytes -> (smallest id, its places there, key)
        marks: list[tuple[int, int, int]] = []

        def out() -> Iterator[pa.RecordBatch]:
            m = np.array(marks, np.int64).reshape(-1, 3)
            marks.clear()
            rows = _mark_rows(m[:, 0].copy(), m[:, 1], m[:, 1] + m[:, 2], parts).combine_chunks()
            none = pa.nulls(rows.num_rows, pa.binary())
            # a mark only passes through a bucket: any will do
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(rows["part"].to_numpy() % groups, pa.int32()), "part": rows["part"].combine_chunks(), "marks": rows["marks"].combine_chunks(), "ids": none, "places": none, "sizes": none, "blob": none})
            texts, (own, places, keys) = list(best), zip(*best.values(), strict=True) if best else ((), (), ())
            best.clear()
            own, times, bucket = np.array(own, np.int64), np.array([len(x) for x in places], np.int64), mix(np.array(keys, U)) % U(groups)
            order = np.argsort(bucket, kind="stable")
            buckets, cut = np.unique(bucket[order], return_index=True)
            for b, at in zip(buckets.tolist(), np.split(order, cut[1:]), strict=False):
                mine = at.tolist()
                size = np.array([len(texts[x]) for x in mine], np.uint8)
                p = np.array([q for x in mine for q in places[x]], np.int64)
                one = pa.nulls(1, pa.binary())
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([b], pa.int32()), "part": pa.nulls(1, pa.int32()), "marks": one, "ids": pa.array([np.repeat(own[at], times[at]).tobytes()], pa.binary()),
                    "places": pa.array([p.tobytes()], pa.binary()), "sizes": pa.array([np.repeat(size, times[at]).tobytes()], pa.binary()), "blob": pa.array([b"".join([texts[x] * len(places[x]) for x in mine])], pa.binary()),
                })

        for batch in it:
            ids = _ids(batch.column(0))
            for key, text, place, first, size, raw in runs(batch.column(1).to_pylist()):
                hit = np.flatnonzero(rep.hold(key))
                for k, i, p, f, n in zip(key[hit].tolist(), ids[text[hit]].tolist(), place[hit].tolist(), first[hit].tolist(), size[hit].tolist(), strict=True):
                    for d in range(0, n, RUN):
                        m = min(RUN, n - d)
                        ctx = raw[f + d : f + d + m + WINDOW - 1]
                        had = best.get(ctx)
                        if had is None:
                            best[ctx] = (i, [p + d], k)
                        elif had[0] == i:
                            had[1].append(p + d)
                        elif had[0] < i:
                            marks.append((i, p + d, m))
                        else:
                            marks.extend((had[0], q, m) for q in had[1])
                            best[ctx] = (i, [p + d], k)
                if len(best) >= HELD or len(marks) >= 4 * HELD:
                    yield from out()
        yield from out()

    return run


class Family:
    """Suffix arrays of batches added by rising id: `add` says which strings a smaller id has."""

    def __init__(self):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # (batches, sorted distinct strings, smallest id)

    @staticmethod
    def _least(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Strings that come by rising id: their order, themselves in it, each one's first place there and its number by place. Sorted stretches are merged."""
        order = np.argsort(strings, kind="stable")
        s = strings[order]
        new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        return order, s, np.flatnonzero(new), np.cumsum(new) - 1

    def add(self, strings: np.ndarray, ids: np.ndarray) -> np.ndarray:
        order, s, first, number = self._least(strings)
        own, least = s[first], ids[order][first]
        known = least.copy()
        for _, level, level_ids in self.levels:
            at = np.searchsorted(level, own)
            at[at == len(level)] = 0
            same = level[at] == own
            known[same] = np.minimum(known[same], level_ids[at[same]])
        out = np.zeros(len(ids), bool)
        out[order] = ids[order] > known[number]
        self.levels.append((1, own, least))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a, x), (m, b, y) = self.levels.pop(), self.levels.pop()
            s, i = np.concatenate([b, a]), np.concatenate([y, x])
            order, s, first, _ = self._least(s)
            self.levels.append((n + m, s[first], i[order][first]))
        return out


def _group(parts: int, key, t):
    passed = t.filter(t["part"].is_valid()).select(["part", "marks"])
    t = t.filter(t["ids"].is_valid())
    if not t.num_rows:
        return passed
    join = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t[c]])
    ids, place, size, blob = join("ids", np.int64), join("places", np.int64), join("sizes", np.uint8).astype(np.int64), join("blob", np.uint8)
    at = np.cumsum(size) - size
    order = np.lexsort((place, ids))
    family, found = Family(), []
    for lo in range(0, len(order), BATCH):
        e = order[lo : lo + BATCH]
        n = size[e] - WINDOW + 1
        which = np.repeat(np.arange(len(e)), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        chars = np.ones((len(which), WINDOW + 1), np.uint8)  # the last byte keeps numpy from cutting zero bytes off
        chars[:, :WINDOW] = blob[(at[e][which] + step)[:, None] + np.arange(WINDOW)]
        hit = family.add(chars.view(f"S{WINDOW + 1}").ravel(), ids[e][which])
        found.append((ids[e][which][hit], (place[e][which] + step)[hit]))
    i, p = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.concat_tables([passed, _mark_rows(i, p, p + 1, parts)])


def _digest(text: str | None, marks: bytes | None) -> tuple[int, int, int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not marks:
        return len(raw), 0, 0, raw
    m = np.frombuffer(marks, np.int64).reshape(-1, 2)
    m = m[m[:, 0] <= len(raw) - WINDOW]
    gone = spans(m[:, 0], np.minimum(m[:, 1] + WINDOW - 1, len(raw)))
    parts, at = [], 0
    for a, b in gone.tolist():
        parts.append(raw[at:a])
        at = b
    kept = b"".join([*parts, raw[at:]])
    return len(raw), len(raw) - len(kept), len(gone), kept


SCHEMA = "id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _rows(ids: pa.Array, done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *(pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())))], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) per row of docs; kept is the remaining bytes (binary).

    A byte goes if a WINDOW-byte string that covers it also starts in a text with a smaller id; strings don't cross
    texts. Null texts are empty; texts under WINDOW bytes keep all. Null ids come after all others and count as
    one id. Rows that share an id are not earlier than each other; with different texts they share their marks.
    Repeated rows give repeated results; other columns are ignored.
    """
    spark = docs.sparkSession
    stow = Stow(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rep = Repeated(rows, _keys)
    groups = max(1, -(-rep.n // GROUP))
    shared = spark.sparkContext.broadcast(rep)
    parts = max(1, -(-groups // 4))
    found = rows.mapInArrow(_second(shared, groups, parts), "bucket int, part int, marks binary, ids binary, places binary, sizes binary, blob binary").repartition(groups, "bucket")
    marked_parts = found.groupBy("bucket").applyInArrow(lambda key, t: _group(parts, key, t), "part int, marks binary")
    marks = stow.put(marked_parts.groupBy("part").applyInArrow(_by_id, "id long, at binary"), "marks")
    shared.unpersist()
    del found, marked_parts
    free_shuffles(spark)
    flagged = spark.sparkContext.broadcast(id_bitmap(marks))

    def touched(part: pa.RecordBatch) -> np.ndarray:
        return hit(flagged.value, _ids(part.column(0)))

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            batch = batch.filter(pa.array(~touched(batch)))
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield _rows(part["id"], [_digest(t, None) for t in part["text"].to_pylist()])

    def marked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.filter(pa.array(touched(batch)))

    def remove(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield _rows(part["id"], [_digest(t, a) for t, a in zip(part["text"].to_pylist(), part["at"].to_pylist(), strict=True)])

    by_id = marks.withColumnRenamed("id", "key")
    joined = rows.mapInArrow(marked, "id long, text string").withColumn("key", F.coalesce("id", F.lit(2**63 - 1))).join(by_id, "key", "left").select("id", "text", "at")
    return rows.mapInArrow(whole, SCHEMA).unionByName(joined.mapInArrow(remove, SCHEMA))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's bytes, bytes and spans removed, and the hash of what is kept."""
    return dedup(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
