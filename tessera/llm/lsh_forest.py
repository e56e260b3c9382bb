"""MinHash near-duplicates with an LSH forest.

A document's set is its distinct 5-word shingles. Documents with one set form a class, represented by its
smallest id; a class's signature of TREES * DEPTH minima gives TREES labels of DEPTH hashes. Each tree is the
classes sorted by label: classes that share the first BASE hashes (fewer for a lower similarity) form a region, and inside a region the
depth adapts: a region of at most SMALL classes gives all its pairs, a larger one is split by its next hash as
long as it has one, keeping a pair with its first class for each member, and what can't be split any more gives
each class's neighbours in the order. Where the sort cuts a region of at most SMALL classes between two tasks, its
rows at the border meet in a second, small grouping. Regions larger than WIDE, which the sort may spread over tasks,
get the pairs with their first class from an aggregate besides. At similarity 0.85 a pair shares the first BASE
hashes in a tree with probability 0.52, in one of the TREES trees with 0.99999.

Candidates are confirmed on the full sets, first one candidate for each class (its smallest partner), then those
of regions of at most SMALL classes that still join different components. Links inside a component don't change
it, so no component is lost by not confirming those.

Where a region of more than SMALL classes is left with several components, every member outside its largest one meets all the others in blocks of bounded size that hold their full sets. A
block counts all intersections at once, as products of incidence matrices, and gives only links between different
components, no more than join them; so rows grow with the members, not with the pairs, and no link is lost to
an estimate.

Scale: texts are read twice and never shuffled as a whole; sets are shuffled only for classes with candidates,
found with a bitmap of ids of bounded size. Groups of copies are collapsed by aggregation before anything is joined.
A family of N classes that resemble each other and aren't linked costs N * N / 2 products, in N * N / BLOCK**2 tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stow, free_shuffles, table
from .components import components
from .words import U, batches, mix, windows

TREES, DEPTH, BASE, SMALL, WIDE, SHINGLE, PERCENT = 16, 8, 4, 8, 512, 5, 85
#: Bits of the bitmap of ids, at least and at most (32 MB).
BITS = (20, 28)
#: Sets of a side of a block, and bytes of them, about.
BLOCK, BLOCK_BYTES = 2048, 1 << 24
#: A pair at the least similarity shares no region with at most this probability.
MISS = 2e-5
_MULT = mix(np.arange(TREES * DEPTH, dtype=U) + U(77)) | U(1)
_ADD = mix(np.arange(TREES * DEPTH, dtype=U) + U(7777))


def region_depth(percent: int) -> int:
    """The number of hashes that make a region: the most that keep a pair at percent within MISS, 4 at 85 and 3 at 80."""
    s = percent / 100
    return max(d for d in range(1, BASE + 1) if d == 1 or (1 - s**d) ** TREES <= MISS)


def shingle_sets(texts: list, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; words lower-cased in A-Z; a shorter text is one shingle."""
    for _, _, w in batches(texts, 1, True):
        first, all_windows = w.first, windows(w.hashes[0], n)
        for i, c in enumerate(w.count):
            if c >= n:
                yield np.unique(all_windows[first[i] : first[i + 1] - n + 1])
            elif c:
                yield mix(windows(w.hashes[0][first[i] : first[i + 1]], int(c)) + U(c))
            else:
                yield np.zeros(0, U)


def signature(s: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima (their upper 32 bits) of a set that isn't empty."""
    out = None
    for i in range(0, len(s), 2048):
        low = (s[i : i + 2048, None] * _MULT + _ADD).min(0)
        out = low if out is None else np.minimum(out, low)
    return (out >> U(32)).astype(">u4")


def _sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        n, prints, sigs = [], [], []
        for s in shingle_sets(batch.column(1).to_pylist()):
            n.append(len(s))
            prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            sigs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "n", "print", "sig"])


def _trees(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), f"S{4 * DEPTH}").reshape(-1, TREES)
        raw = sig.tobytes()
        labels = [raw[i : i + 4 * DEPTH] for i in range(0, len(raw), 4 * DEPTH)]
        yield pa.RecordBatch.from_pydict({"tree": pa.array(np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows)), "label": pa.array(labels, pa.binary()), "id": batch["id"].take(pa.array(np.repeat(np.arange(batch.num_rows), TREES))), "n": batch["n"].take(pa.array(np.repeat(np.arange(batch.num_rows), TREES)))})


def region_pairs(labels: np.ndarray, ids: np.ndarray, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Places of candidate pairs of one region: rows sorted by label, sharing the first base hashes."""
    a, b = [], []

    def visit(lo: int, hi: int, d: int) -> None:
        m = hi - lo
        if m <= SMALL:
            i, j = np.triu_indices(m, 1)
            a.append(lo + i)
            b.append(lo + j)
            return
        lead = lo + int(np.argmin(ids[lo:hi]))
        rest = np.delete(np.arange(lo, hi), lead - lo)
        cuts = [lo, *(lo + 1 + np.flatnonzero(labels[lo + 1 : hi, d] != labels[lo : hi - 1, d])), hi] if d < DEPTH else [lo, hi]
        if d in (base, DEPTH):
            a.append(np.full(m - 1, lead))
            b.append(rest)
        if d == DEPTH:
            a.append(np.arange(lo, hi - 1))
            b.append(np.arange(lo + 1, hi))
        else:
            if len(cuts) > 2:  # neighbours on both sides of a cut
                at = np.array(cuts[1:-1])
                a.append(at - 1)
                b.append(at)
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y - x > 1:
                    visit(x, y, d + 1)

    if len(ids) > 1:
        visit(0, len(ids), base)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _neighbours(percent: int, base: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b, small) of sorted rows, and the rows (tree, prefix, id, n) of the first and the last region where they are at most SMALL.

    small: whether the pair's region is at most SMALL as far as it is seen here.
    """
    kept, whole = None, True  # rows not done yet; whether they start at the region's first row here
    first = True

    def out(lab, ids, n):
        a, b = region_pairs(lab, ids, base)
        x, y = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
        ok = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
        return np.unique(np.stack([x[ok], y[ok], np.full(int(ok.sum()), len(ids) <= SMALL)], 1), axis=0)

    def emit(found):
        found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        none = lambda t: pa.nulls(len(found), t)
        return pa.RecordBatch.from_pydict({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1]), "small": pa.array(found[:, 2] == 1), "tree": none(pa.int32()), "prefix": none(pa.binary()), "id": none(pa.int64()), "n": none(pa.int64())})

    def border(tree, lab, ids, n):
        none = pa.nulls(len(ids), pa.int64())
        return pa.RecordBatch.from_pydict({"a": none, "b": none, "small": pa.nulls(len(ids), pa.bool_()), "tree": pa.array(tree), "prefix": pa.array([x.tobytes() for x in np.ascontiguousarray(lab[:, :base])], pa.binary()), "id": pa.array(ids), "n": pa.array(n)})

    for batch in it:
        if not batch.num_rows:
            continue
        lab = np.frombuffer(b"".join(batch["label"].to_pylist()), ">u4").reshape(-1, DEPTH)
        rows = batch["tree"].to_numpy(), lab, batch["id"].to_numpy(), batch["n"].to_numpy()
        rows = rows if kept is None else tuple(np.concatenate(x) for x in zip(kept, rows, strict=True))
        tree, lab, ids, n = rows
        new = np.flatnonzero((tree[1:] != tree[:-1]) | (lab[1:, :base] != lab[:-1, :base]).any(1)) + 1
        edges = np.concatenate([[0], new, [len(ids)]])
        last = edges[-2] if len(ids) - edges[-2] <= 8 * WIDE else len(ids) - 1
        found = [out(lab[x:y], ids[x:y], n[x:y]) for x, y in zip(edges[:-2], edges[1:-1], strict=True) if y - x > 1]
        if last != edges[-2]:  # a large region is taken in stretches
            found.append(out(lab[edges[-2] :], ids[edges[-2] :], n[edges[-2] :]))
        if first and len(edges) > 2:
            if whole and edges[1] <= SMALL:
                yield border(*(x[: edges[1]] for x in rows))
            first = False
        whole = last == edges[-2] and (whole or last > 0)
        kept = tuple(x[last:] for x in rows)
        yield emit(found)
    if kept is not None:
        if whole and len(kept[2]) <= SMALL:
            yield border(*kept)
        if len(kept[2]) > 1:
            yield emit([out(*kept[1:])])


def _cut(near: DataFrame, percent: int) -> DataFrame:
    """Pairs of the regions of at most SMALL rows that lie on both sides of a border."""
    rows = near.where("id is not null").groupBy("tree", "prefix").agg(F.count("*").alias("m"), F.collect_list(F.struct("id", "n")).alias("rows")).where(F.col("m").between(2, SMALL))
    pairs = rows.select(F.explode("rows").alias("x"), "rows").select("x", F.explode("rows").alias("y")).where("x.id < y.id")
    return pairs.where(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of the sets of two lists (sorted distinct hashes): frequent hashes by matrix products, others pair by pair."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    i, j = (np.repeat(np.arange(len(x), dtype=np.int32), [len(s) for s in x]) for x in (left, right))
    both = np.intersect1d(a, b)
    if not len(both):
        return out

    def coded(h, at):
        k = np.minimum(np.searchsorted(both, h), len(both) - 1)
        ok = both[k] == h
        order = np.argsort(k[ok], kind="stable")
        return k[ok][order], at[ok][order]

    (k, i), (m, j) = coded(a, i), coded(b, j)
    nk, nm = np.bincount(k, minlength=len(both)), np.bincount(m, minlength=len(both))
    often = nk * nm > out.size / 64
    place = np.cumsum(often) - 1
    ik, im = often[k], often[m]
    for lo in range(0, int(often.sum()), 1024):
        x, y = np.zeros((len(left), 1024), np.float32), np.zeros((len(right), 1024), np.float32)
        for z, at, code, of in ((x, i, k, ik), (y, j, m, im)):
            c = place[code[of]] - lo
            ok = (c >= 0) & (c < 1024)
            z[at[of][ok], c[ok]] = 1
        out += x @ y.T
    k, i, m, j = k[~ik], i[~ik], m[~im], j[~im]
    starts = np.concatenate([[0], np.cumsum(np.where(often, 0, nm))])
    flat = out.reshape(-1)
    times = np.where(often, 0, nm)[k]
    ends = np.cumsum(times)
    lo = 0
    while lo < len(k):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 22))))
        t = times[lo:hi]
        step = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
        cell = np.repeat(i[lo:hi].astype(np.int64), t) * len(right) + j[np.repeat(starts[k[lo:hi]], t) + step]
        flat += np.bincount(cell, minlength=len(flat)).astype(np.float32) if len(cell) > len(flat) // 8 else 0
        if len(cell) <= len(flat) // 8:
            at, c = np.unique(cell, return_counts=True)
            flat[at] += c
        lo = hi
    return out


def _exact(percent: int, key, t: pa.Table) -> pa.Table:
    """Links of a block between different components, no more than join them."""
    side, ids, c = (t[x].to_numpy() for x in ("side", "id", "c"))
    sets = [np.frombuffer(x.as_buffer(), U) for x in t["set"]]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    a, b = [], []
    if len(left) and len(right):
        common = intersections([sets[x] for x in left], [sets[x] for x in right])
        n = np.array([len(x) for x in sets], np.int64)
        theirs, of = n[right], c[right]
        roots: dict[int, int] = {}

        def root(x):
            while x in roots:
                x = roots[x]
            return x

        for i, x in enumerate(left):
            both = common[i].astype(np.int64)
            at = np.flatnonzero((100 * both >= percent * (n[x] + theirs - both)) & (of != c[x]))
            other, first = np.unique(of[at], return_index=True)
            for y, k in zip(other.tolist(), at[first].tolist(), strict=True):
                p, q = root(y), root(int(c[x]))
                if p != q:
                    roots[max(p, q)] = min(p, q)
                    a.append(ids[x])
                    b.append(ids[right[k]])
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of members (tree, prefix, id, n) of one region and of different components, enough to join all that are linked."""
    region = ["tree", "prefix"]
    named = members.join(labels.select("id", F.col("component").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id"))
    sizes = named.groupBy(*region, "c").agg(F.count("*").alias("k"), F.sum("n").alias("w")).groupBy(*region).agg(F.sum("k").alias("m"), F.sum("w").alias("w"), F.max(F.struct("k", "w", "c")).alias("top")).where("top.k < m")
    blocks = lambda c, w: F.greatest(F.ceil(c / BLOCK), F.ceil(8 * w / BLOCK_BYTES)).cast("int")
    sizes = sizes.select(*region, F.col("top.c").alias("main"), blocks(F.col("m") - F.col("top.k"), F.col("w") - F.col("top.w")).alias("lefts"), blocks(F.col("m"), F.col("w")).alias("rights"))
    dealt = named.join(sizes, region)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), n).cast("int")
    cols = [*region, "id", "c"]
    left = dealt.where("c <> main").select(*cols, F.lit(0).alias("side"), mine("lefts").alias("i"), each("rights").alias("j"))
    right = dealt.select(*cols, F.lit(1).alias("side"), each("lefts").alias("i"), mine("rights").alias("j"))
    full = left.unionByName(right).join(sets, "id").select(*region, "i", "j", "side", "id", "c", "set")
    return full.groupBy(*region, "i", "j").applyInArrow(lambda key, t: _exact(percent, key, t), "a long, b long").where("a <> b").distinct()


def hit(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids have their bit set."""
    at = _bits(ids, len(bitmap).bit_length() + 2)
    return (bitmap[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)


def _bits(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U)) >> U(64 - bits)).astype(np.int64)


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap with a bit set for each id (column id, long): never misses, may give a few more.

    It has 16 bits for an id, at most 2 ** BITS[1] bits; beyond 10**8 ids more and more others pass, and the joins that follow drop them.
    """
    bits = int(min(BITS[1], max(BITS[0], np.ceil(np.log2(16 * ids.count() + 1)))))
    size = 1 << (bits - 9)  # bytes of a part

    def collect(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << bits, bool)
        for batch in it:
            out[_bits(batch.column(0).to_numpy(zero_copy_only=False), bits)] = True
        packed = np.packbits(out)
        own = [(k, packed[k * size : (k + 1) * size]) for k in range(64)]
        own = [(k, x.tobytes()) for k, x in own if x.any()]
        yield pa.RecordBatch.from_pydict({"part": pa.array([k for k, _ in own], pa.int32()), "bits": pa.array([x for _, x in own], pa.binary())})

    def merge(key, t):
        total = np.zeros(size, np.uint8)
        for x in t["bits"]:
            total |= np.frombuffer(x.as_buffer(), np.uint8)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})

    got = ids.select("id").mapInArrow(collect, "part int, bits binary").groupBy("part").applyInArrow(merge, "part int, bits binary").collect()
    out = np.zeros((64, size), np.uint8)
    for r in got:
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _sets_of(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(id, print, set) of the rows whose id has its bit set."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            named = batch.filter(pa.array(hit(shared.value, batch.column(0).to_numpy(zero_copy_only=False))))
            for lo in range(0, named.num_rows, 1024):
                part = named.slice(lo, 1024)
                sets = [s.tobytes() for s in shingle_sets(part.column(1).to_pylist())]
                prints = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.binary()), pa.array(sets, pa.large_binary()).cast(pa.binary())], names=["id", "print", "set"])

    return docs.mapInArrow(run, "id long, print binary, set binary")


def _linked(percent: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        keep = []
        for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
            x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            both = np.concatenate([x, y])
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    a, b = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(partial(_linked, percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of docs; ids are longs.

    Links join sets with 100 * intersection >= percent * union. A text without words (null, empty or blank) has an
    empty set and no link. Rows with one id are one vertex; with different texts they carry each text's links. A
    null id takes no part: component null, kept true. Repeated rows give repeated results. Other columns are ignored.
    """
    spark, base = docs.sparkSession, region_depth(percent)
    stow = Stow(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = stow.put(rows.mapInArrow(_sketch, "id long, n long, print binary, sig binary"), "sketches")
    named = sketches.where("id is not null and n > 0")
    classes = stow.put(named.groupBy("print", "n").agg(F.min("id").alias("id"), F.first("sig").alias("sig")), "classes")
    trees = stow.put(classes.select("id", "n", "sig").mapInArrow(_trees, "tree int, label binary, id long, n long"), "trees")
    shape = "a long, b long, small boolean, tree int, prefix binary, id long, n long"
    near = stow.put(trees.repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id").mapInArrow(partial(_neighbours, percent, base), shape), "near")
    prefix = F.substring("label", 1, 4 * base).alias("prefix")
    # the regions in which not all pairs are candidates
    large = stow.put(trees.groupBy("tree", prefix).agg(F.count("*").alias("m"), F.min("id").alias("lead"), F.min_by("n", "id").alias("lead_n")).where(F.col("m") > SMALL), "large")
    members = stow.put(trees.select("tree", prefix, "id", "n").join(large, ["tree", "prefix"]).select("tree", "prefix", "id", "n", "m", "lead", "lead_n"), "members")
    led = members.where(f"m > {WIDE} and id <> lead and 100 * least(n, lead_n) >= {percent} * greatest(n, lead_n)").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
    # one id can stand for several texts: classes of one id are one vertex
    found = near.where("a is not null").select("a", "b", "small").unionByName(_cut(near, percent).withColumn("small", F.lit(True))).unionByName(led.withColumn("small", F.lit(False)))
    pairs = stow.put(found.where("a <> b").groupBy("a", "b").agg(F.max("small").alias("small")), "pairs")
    stow.drop("trees", "near", "large")
    ends = stow.put(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(members.select("id")).distinct(), "ends")
    wanted = _sets_of(rows.where("id is not null"), id_bitmap(ends)).join(ends, "id", "left_semi")
    sets = stow.put(wanted.groupBy("id", "print").agg(F.first("set").alias("set")).select("id", "set"), "sets")
    free_shuffles(spark)

    copies = named.join(classes.select("print", "n", F.col("id").alias("rep")), ["print", "n"]).where("id <> rep").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b"))
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = stow.put(confirm(first, sets, percent), "links")
    labels = components(links, stow)
    label = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    left = pairs.where("small").join(label("a"), "a", "left").join(label("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    links = stow.put(links.unionByName(confirm(left.join(first, ["a", "b"], "left_anti"), sets, percent)), "more")
    labels = components(links, stow)
    links = stow.put(links.unionByName(_rest(members.select("tree", "prefix", "id", "n"), labels, sets, percent)), "all")
    free_shuffles(spark)
    labels = stow.put(components(links.unionByName(copies), stow), "last")
    stow.only("sketches", "last")
    free_shuffles(spark)
    return sketches.select("id", F.col("n").alias("n_shingles")).join(labels, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Every document's number of shingles, component and whether it stays."""
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
