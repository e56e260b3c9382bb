"""Language identification with bit-sliced Bloom filters over byte n-grams.

Training counts the 4-byte grams of case-folded text per language over all training documents. A language's
filter holds the grams that make up at least FLOOR of its grams and are at least SHARE times as frequent there
as in the language that uses them most; FLOOR bounds a filter at 1 / FLOOR grams whatever the corpus. The
filters of all languages share their bit positions: row h of the table is the bitmask of the languages whose
filter has bit h set, so the AND of K rows returns every language that contains a gram; beyond 64 languages a
bitmask takes several words. A document's votes
are the popcounts per language, corrected for the filter's false positive rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, table

N, K, FLOOR, SHARE, HELD_OUT = 4, 3, 1 / 20_000, 0.3, 5
#: Grams that a task keeps before it passes its counts on.
FLUSH = 1 << 21

_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """4-byte grams of folded texts, one per byte, and whether each counts; a text takes its bytes + 2 places."""
    folded = _FOLD[np.frombuffer(b"".join([b" " + t.encode("utf-8", "surrogatepass") + b" " if t else b"  " for t in texts]) + b"   ", np.uint8)]
    b = folded.astype(np.uint32)
    n = len(b) - 3
    g = b[:n] | b[1 : n + 1] << 8 | b[2 : n + 2] << 16 | b[3 : n + 3] << 24
    gap = folded == 32
    twice = gap[:-1] & gap[1:]
    return g, ~(twice[:n] | twice[1 : n + 1] | twice[2 : n + 2])


def slices(texts: list) -> Iterator[tuple[int, list]]:
    """(index of the first text, texts) in bounded pieces; a very long text comes in several pieces of its own."""
    for i, j in chunks(texts, 1 << 20):
        if j - i == 1 and texts[i] and len(texts[i]) > 1 << 20:
            for k in range(0, len(texts[i]), 1 << 20):
                yield i, [texts[i][k : k + (1 << 20) + 3]]
        else:
            yield i, texts[i:j]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out(lang):
        u, c = kept.pop(lang)
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(u)), "gram": pa.array(u.astype(np.int64)), "n": pa.array(c.astype(np.int64))})

    for batch in batches:
        langs, texts = np.array(batch["lang"].to_pylist(), object), batch["text"].to_pylist()
        for lang in sorted(set(langs)):
            for _, part in slices([texts[i] for i in np.flatnonzero(langs == lang)]):
                g, ok = grams(part)
                u, c = np.unique(g[ok], return_counts=True)
                if lang in kept:
                    old, n = kept[lang]
                    u, at = np.unique(np.concatenate([old, u]), return_inverse=True)
                    c = np.bincount(at, np.concatenate([n, c]), len(u)).astype(np.int64)
                kept[lang] = u, c
            if lang in kept and len(kept[lang][0]) > FLUSH:
                yield out(lang)
    for lang in sorted(kept):
        yield out(lang)


class BloomSlices:
    """Bit-sliced Bloom filters: `rows[w][h]` is the bitmask of the languages 64 * w to 64 * w + 63 with bit h set."""

    def __init__(self, members: dict[str, np.ndarray], prior: dict[str, int]):
        self.langs = sorted(members)
        self.default = max(self.langs, key=lambda x: (prior.get(x, 0), x), default=None)
        most = max([1, *(len(x) for x in members.values())])
        self.bits = max(10, int(np.ceil(np.log2(24 * most))))
        kind = next((t for t in (np.uint8, np.uint16, np.uint32) if len(self.langs) <= np.dtype(t).itemsize * 8), np.uint64)
        self.rows = [np.zeros(1 << self.bits, kind) for _ in range(-(-len(self.langs) // 64) or 1)]
        fill = []
        for k, lang in enumerate(self.langs):
            row, bit = self.rows[k >> 6], kind(1 << (k & 63))
            for at in self.places(members[lang]):
                row[at] |= bit
            fill.append(np.count_nonzero(row & bit) / len(row))
        self.false = np.array(fill) ** K

    def places(self, g: np.ndarray) -> Iterator[np.ndarray]:
        for mult in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[:K]:
            yield ((g.astype(np.uint64) + np.uint64(1)) * np.uint64(mult)) >> np.uint64(64 - self.bits)

    def masks(self, g: np.ndarray) -> list[np.ndarray]:
        out = None
        for at in self.places(g):
            out = [row[at] if out is None else out[w] & row[at] for w, row in enumerate(self.rows)]
        return out

    def votes(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Corrected votes by text and language, and the number of grams by text."""
        votes, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for first, part in slices(texts):
            g, ok = grams(part)
            lens = np.array([len(t.encode("utf-8", "surrogatepass")) + 2 if t else 2 for t in part])
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            n[first : first + len(part)] += np.add.reduceat(ok, starts, dtype=np.int64)
            for w, m in enumerate(self.masks(g)):
                m[~ok] = 0
                for k in range(64 * w, min(64 * w + 64, len(self.langs))):
                    votes[first : first + len(part), k] += np.add.reduceat((m >> m.dtype.type(k & 63)) & m.dtype.type(1), starts, dtype=np.int64)
        return np.maximum(0, (votes - n[:, None] * self.false) / (1 - np.minimum(self.false, 0.999))), n


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> BloomSlices:
    """Filters from all rows with a language and a text. At most 1 / FLOOR grams per language reach the driver."""
    given = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = given.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("by"))  # one entry per language
    total = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not total:
        return BloomSlices({}, {})
    size = F.create_map(*[F.lit(x) for kv in sorted(total.items()) for x in kv])
    by = F.transform("by", lambda x: F.struct(x["lang"].alias("lang"), (x["n"] / size[x["lang"]]).alias("p")))
    kept = rows.select("gram", by.alias("by")).select("gram", F.explode(F.filter("by", lambda x: (x["p"] >= FLOOR) & (x["p"] >= SHARE * F.array_max(F.transform("by", lambda y: y["p"]))))).alias("x")).select("x.lang", "gram").toPandas()
    return BloomSlices({lang: np.sort(kept.gram[kept.lang == lang].to_numpy(np.uint64)) for lang in total}, total)


def predict(docs: DataFrame, model: BloomSlices, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score added (they replace columns of those names).

    Null text or a text without a letter: `und`, score 0. A text with letters but no gram of 4 bytes inside
    a word and its borders, or a model without languages: the most frequent training language (`und` if none),
    score 0. Ties go to the first language by code point.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 1 / FLOOR grams a language
    base = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    names = base.columns
    at, flag = names.index(text_col), "lettered"
    while flag in (x.lower() for x in names):
        flag += "_"
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in base.schema)}, lang_pred string, score double, `{flag}` boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            votes, n = m.votes(batch.column(at).to_pylist())
            if not m.langs:
                lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                best = votes.argmax(1)
                score = np.where(n > 0, np.clip(votes.max(1) / np.maximum(n, 1), 0, 1), 0)
                lang = [m.langs[b] if s > 0 else m.default for b, s in zip(best, score, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score), batch.column(len(names))], names=[*names, "lang_pred", "score", flag])

    out = base.withColumn(flag, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)
    return out.select(*[f"`{c}`" for c in names], F.when(F.col(flag), F.col("lang_pred")).otherwise(F.lit("und")).alias("lang_pred"), F.when(F.col(flag), F.col("score")).otherwise(F.lit(0.0)).alias("score"))


def held_out(doc_id: str = "doc_id"):
    """Whether crc32(doc_id as text) mod 5 is 0; false for a null id, which isn't trained on either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % HELD_OUT == 0, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT != 0)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document; learnt from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(training_rows(docs).select("lang", "text"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
