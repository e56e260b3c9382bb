"""SentencePiece encoding and decoding as weighted finite-state transduction.

The model file is compiled into explicit machines over characters:
  C  the character map, if the model has one: a trie of byte strings, rewritten leftmost and longest first;
  N  the normaliser: states for the start, the inside and pending white space; arcs write the meta symbol for white
     space, the dummy prefix, and nothing for white space to be removed. It has one arc for each state and character;
  P  the piece transducer: a loop over all pieces, states are the nodes of their trie, and the arc that leads back to
     the loop's state writes a piece's id at the piece's weight;
  B  byte fallback: for a character that is no piece, an arc of the loop's state that writes its UTF-8 bytes' ids, or
     the unknown id in models without bytes;
  V  the acceptor of canonical sequences. In unigram models it has one state and accepts everything at weight 0. In
     BPE models its states are pieces and it has an arc from a to b, of weight 0, exactly if merging the text of a b
     gives back a b; other arcs weigh infinity. A sequence is what BPE produces if and only if each neighbouring pair
     is. Arcs are made when first needed.
An input, a chain of characters, is composed with C and N, which give a chain again as they are deterministic, and
with (P + B) and V; the states of that composition are (place, state of V), its arcs go forward only, and the path
of least weight in the tropical semiring is taken in order of place (of paths of one weight, the first found). Pieces of unigram models weigh minus their log
probability.

No piece spans certain borders (before a meta symbol after another character; around characters that are in
no longer piece; between a letter and a mark that follows no letter in any piece). Inputs are cut there, and
the paths of what is between cuts are kept in a bounded cache, by N's state and characters.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

META = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Cut-outs kept by each worker, in two generations.
CACHE = 500_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield tag >> 3, raw[at : at + n]
        at += n


INF = float("inf")


class CharacterMap:
    """C: the double-array trie and the replacements of a model's precompiled character map."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units, self.texts = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, int] | None:
        """(length, place of the replacement) of the longest key that starts at a place."""
        step = lambda u: (u >> 10) << ((u & 512) >> 6)
        node, found = step(self.units[0]), None
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(self.units) or self.units[node] & 0x800000FF != raw[k]:
                break
            u = self.units[node]
            node ^= step(u)
            if u >> 8 & 1:
                found = k + 1 - at, self.units[node] & 0x7FFFFFFF
        return found

    def apply(self, text: str) -> str:
        raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
        while at < len(raw):
            hit = self.longest(raw, at)
            if hit is None:
                n = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
                out.append(raw[at : at + n])
            else:
                n = hit[0]
                out.append(self.texts[hit[1] : self.texts.index(b"\0", hit[1])])
            at += n
        return b"".join(out).decode("utf-8", "surrogatepass")


class Normaliser:
    """N: arcs[state] is {character or None for all others: (what is written before the character, the character's own output or None for itself, next state)}."""

    START = 0

    def __init__(self, prefix: bool, squeeze: bool, escape: bool):
        meta = META if escape else " "
        lead = meta if prefix else ""
        if squeeze:  # 0 before the text, 1 inside, 2 inside with white space pending
            self.arcs = [{" ": ("", "", 0), None: (lead, None, 1)}, {" ": ("", "", 2), None: ("", None, 1)}, {" ": ("", "", 2), None: (meta, None, 1)}]
        else:
            self.arcs = [{" ": (lead, meta, 1), None: (lead, None, 1)}, {" ": ("", meta, 1), None: ("", None, 1)}]

        #: states that all arcs lead back to, with nothing before a character, replace characters only
        self.plain = [{ord(c): own for c, (_, own, _) in arcs.items() if c} if all(x[0] == "" and x[2] == k for x in arcs.values()) else None for k, arcs in enumerate(self.arcs)]

    def run(self, state: int, s: str) -> tuple[str, int]:
        if self.plain[state] is not None:
            return s.translate(self.plain[state]), state
        out = []
        for c in s:
            arcs = self.arcs[state]
            before, own, state = arcs.get(c) or arcs[None]
            out.append(before + (c if own is None else own))
        return "".join(out), state


class Pieces:
    """P and B: `root` is the loop's state; a state is {character: next state}, with under DONE the (id, weight) of its arc back to the loop."""

    DONE = ""

    def __init__(self, weights: dict[str, tuple[int, float]], fallback: float):
        self.root, self.fallback = {}, fallback
        for piece, arc in weights.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[self.DONE] = arc


class Canonical:
    """V of a BPE model: weight(a, b) of the arc from piece a (None: the start) to piece b.

    Merging goes from high to low scores, so the history of a b can be read backwards: of a's and b's last merges the
    one with the lower score came last (level ones: the right one). Before it, the part of that piece at the border
    was beside the other piece; had the two made a piece of a higher score (or, left of it, a level one), that merge
    would have come first and crossed the border. Models whose pieces aren't merged in order of score are simulated.
    """

    MOST = 1 << 20

    def __init__(self, scores: dict[str, float]):
        self.scores, self.made, self.halves = scores, {}, {}
        self.ordered = True
        for p in scores:
            if len(p) > 1 and self.split(p) is not None and any(len(x) > 1 and scores[x] < scores[p] for x in self.split(p)):
                self.ordered = False

    def merged(self, text: str) -> list[str]:
        """What merging the best-scored pair, leftmost first, again and again leaves of a short text."""
        return self._merge(text)[0]

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        parts, last = list(text), None
        while True:
            best = None
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best[0]):
                    best = score, k
            if best is None:
                return parts, last
            last = parts[best[1]], parts[best[1] + 1]
            parts[best[1] : best[1] + 2] = [last[0] + last[1]]

    def split(self, p: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes p; None if merging p's characters doesn't give p."""
        if p not in self.halves:
            parts, last = self._merge(p)
            self.halves[p] = last if len(parts) == 1 else None
        return self.halves[p]

    def _follows(self, a: str, b: str) -> bool:
        scores = self.scores
        if a + b in scores:
            return False
        while len(a) > 1 or len(b) > 1:
            of_a, of_b = (scores[x] if len(x) > 1 else INF for x in (a, b))
            if of_a < of_b:
                a = self.split(a)[1]
                if scores.get(a + b, -INF) > of_a:
                    return False
            else:
                b = self.split(b)[0]
                if scores.get(a + b, -INF) >= of_b:
                    return False
        return True

    def weight(self, a: str | None, b: str) -> float:
        w = self.made.get((a, b))
        if w is None:
            if len(self.made) > self.MOST:
                self.made.clear()
            if len(b) > 1 and self.split(b) is None or a is not None and len(a) > 1 and self.split(a) is None:
                ok = False
            elif a is None:
                ok = True
            else:
                ok = self._follows(a, b) if self.ordered else self.merged(a + b) == [a, b]
            w = self.made[a, b] = 0.0 if ok else INF
        return w


class Everything:
    """V of a unigram model: one state, all arcs of weight 0."""

    def weight(self, a: None, b: str) -> float:
        return 0.0


def shortest(s: str, pieces: Pieces, allowed: Canonical | Everything) -> list[tuple[str, int | None]]:
    """The (piece, id) of the path of least weight through the chain s, composed with P + B and V.

    at[i] is the composition's state at place i: (weight, place before, state of V, id). One state for each place is
    enough: V has one state in unigram models, and in BPE models a place has one path of finite weight, so arcs to a
    place that is reached needn't be made.
    """
    one, n = isinstance(allowed, Everything), len(s)
    at: list[tuple | None] = [None] * (n + 1)
    at[0] = (0.0, 0, None, None)
    weight, made, root, done = allowed.weight, getattr(allowed, "made", {}), pieces.root, Pieces.DONE
    for i in range(n):
        if at[i] is None:
            continue
        cost, _, v, _ = at[i]
        node, j = root.get(s[i]), i + 1
        arc = (None, pieces.fallback) if node is None or done not in node else None  # B's arc
        while True:
            if one or at[j] is None:
                arc = arc or node.get(done)
                if arc is None:
                    pass
                elif one:
                    if at[j] is None or cost + arc[1] < at[j][0]:
                        at[j] = (cost + arc[1], i, None, arc[0])
                else:
                    b = s[i:j]
                    x = made.get((v, b))
                    if (weight(v, b) if x is None else x) < INF:
                        at[j] = (cost + arc[1], i, b, arc[0])
            arc = None
            if j == n or node is None:
                break
            node = node.get(s[j])
            if node is None:
                break
            j += 1
    out, i = [], len(s)
    while i:
        _, j, _, piece_id = at[i]
        out.append((s[j:i], piece_id))
        i = j
    return out[::-1]


class Transducer:
    """encode(text) -> ids and decode(ids) -> text of a SentencePiece model file (its bytes), of type unigram or BPE."""

    def __init__(self, model: bytes):
        pieces, trainer, norm = [], {}, {}
        for k, v in _fields(model):
            if k == 1:
                p = dict(_fields(v))
                pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
            elif k == 2:
                trainer = dict(_fields(v))
            elif k == 3:
                norm = dict(_fields(v))
        self.bpe = trainer.get(3, 1) == 2
        if trainer.get(3, 1) not in (1, 2):
            raise ValueError("the model must be of type unigram or bpe")
        self.map = CharacterMap(norm[2]) if norm.get(2) else None
        self.prefix, squeeze, escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        self.norm = Normaliser(self.prefix, squeeze, escape)
        self.unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        own = {p[0]: (i, p[1]) for i, p in enumerate(pieces) if p[2] == NORMAL}
        user = {p[0]: i for i, p in enumerate(pieces) if p[2] == USER}
        lowest, highest = (f((x for _, x in own.values()), default=0.0) for f in (min, max))
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == BYTE}
        if self.bpe:  # all finite paths weigh 0
            arcs = {p: (i, 0.0) for p, (i, _) in own.items()}
            self.pieces, self.allowed = Pieces(arcs, 0.0), Canonical({p: x for p, (_, x) in own.items()})
        else:  # user-defined pieces beat all others of their length
            arcs = {p: (i, -x) for p, (i, x) in own.items()} | {p: (i, 0.1 - len(p.encode()) * highest) for p, i in user.items()}
            self.pieces, self.allowed = Pieces(arcs, 10.0 - lowest), Everything()
        self.user = {p: np.array([i]) for p, i in user.items()} if self.bpe else {}
        space = (lambda s: s.replace(META, " ")) if escape else (lambda s: s)
        self.out = [bytes([int(p[0][3:5], 16)]) if p[2] == BYTE else b"" if p[2] == CONTROL else " ⁇ ".encode() if p[2] == UNKNOWN else space(p[0]).encode() for p in pieces]
        self.small = np.uint16 if len(pieces) <= 1 << 16 else np.uint32
        self.code = np.dtype(self.small).char
        inner = {c for p in arcs for c in p if len(p) > 1}
        after = {b for p in arcs for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        marks = "".join(re.escape(c) for c in "\n\t.,;:!?()\"'-/|*#%$&+=<>[]{}" if c not in after)
        alone = "".join(re.escape(c) for c in "\n\t" if c not in inner)
        bad = any(META in p.lstrip(META) for p in arcs) or not escape
        blank = f"[ {META}]"  # N writes the meta symbol for either
        units = [rf"[{alone}]"] * bool(alone) + [rf"{blank}*[^\W\d_]+(?=[{marks}])"] * bool(marks) + [rf"{blank}*[^ {META}{alone}]+", f"{blank}+"]
        units = [re.escape(p) for p in sorted(self.user, key=len, reverse=True)] + (units if not bad else [r"(?s:.+)"])
        self.unit = re.compile("|".join(units))
        self.young: list[dict[str, tuple]] = [{} for _ in self.norm.arcs]
        self.old: list[dict[str, tuple]] = [{} for _ in self.norm.arcs]

    def _path(self, state: int, unit: str) -> tuple[bytes, int]:
        """Ids of what lies between two cuts, and N's state after it."""
        if unit in self.user:
            return self.user[unit].astype(self.small).tobytes(), 1
        s, state = self.norm.run(state, unit)
        out: list[int] = []
        for piece, i in shortest(s, self.pieces, self.allowed) if s else ():
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return array(self.code, out).tobytes(), state

    def encode(self, text: str) -> np.ndarray:
        if self.map is not None:
            text = self.map.apply(text)
        state, out, caches = Normaliser.START, [], self.young
        add = out.append
        for u in self.unit.findall(text):
            got = caches[state].get(u)
            if got is None:
                young = caches[state]
                got = self.old[state].get(u) or self._path(state, u)
                if len(u) <= 48:
                    young[u] = got
                    if len(young) > CACHE:
                        self.old[state], self.young[state] = young, {}
            add(got[0])
            state = got[1]
        ids = np.frombuffer(b"".join(out), self.small).astype(np.int32)
        if not self.bytes and len(ids):  # a run of unknown characters is one id, across cuts too
            ids = ids[np.concatenate([[True], (ids[1:] != self.unk) | (ids[:-1] != self.unk)])]
        return ids

    def decode(self, ids) -> str:
        raw = b"".join(map(self.out.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids)).decode("utf-8", "replace")
        return raw[1:] if self.prefix and raw.startswith(" ") else raw


_LOADED: dict[str, Transducer] = {}


def _transducer(name: str) -> Transducer:
    """The transducer of a model file that was sent to the executors; one for each worker."""
    if name not in _LOADED:
        with open(SparkFiles.get(name), "rb") as f:
            _LOADED[name] = Transducer(f.read())
    return _LOADED[name]


def _send(spark: SparkSession, model: str) -> str:
    spark.sparkContext.addFile(model)
    return model.rstrip("/").rsplit("/", 1)[-1]


def _named(df: DataFrame, *drop: str) -> tuple[DataFrame, list[str], str]:
    base = df.drop(*[c for c in df.columns if c in drop])
    return base, base.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text", ids_col: str = "ids", check: bool = False) -> DataFrame:
    """docs with ids_col (array<int>) added, replacing a column of that name; whole texts.

    Null text: null ids; empty text: no ids. With check, round_trip (replaced likewise) says whether decoding gives
    the text back: it does unless the text holds the meta symbol, the model has no bytes to fall back on, or the
    normaliser removes white space. Null text: null.
    """
    base, names, schema = _named(docs, ids_col, *["round_trip"] * check)
    name, at = _send(docs.sparkSession, model), names.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(name)
        for batch in it:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(at).to_pylist()
                ids = [None if x is None else t.encode(x) for x in texts]
                flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
                ends = np.cumsum([0, *(0 if x is None else len(x) for x in ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in ids]))
                more = [pa.array([None if x is None else t.decode(i) == x for x, i in zip(texts, ids, strict=True)], pa.bool_())] if check else []
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *more], names=[*names, ids_col, *["round_trip"] * check])

    return base.mapInArrow(run, f"{schema}, `{ids_col}` array<int>" + ", round_trip boolean" * check)


def decode(df: DataFrame, model: str = MODEL, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with text_col (string) decoded from ids_col. Null ids: null; ids outside the model raise IndexError."""
    base, names, schema = _named(df, text_col)
    name, at = _send(df.sparkSession, model), names.index(ids_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(name)
        for batch in it:
            text = pa.array([None if x is None else t.decode(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*names, text_col])

    return base.mapInArrow(run, f"{schema}, `{text_col}` string")


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document's ids, their number, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, check=True).select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "round_trip")
