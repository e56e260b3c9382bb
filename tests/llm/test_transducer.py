"""The machines of op8 against the sentencepiece library, on models written by hand (no model is trained)."""

import random
import struct

import pytest
import sentencepiece

from tessera.llm import spm_wfst
from tessera.llm.spm_wfst import META


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model(kind, pieces, prefix=True, squeeze=True, chars=b"", fallback=False, user=()):
    rows = [("<unk>", 0.0, spm_wfst.UNKNOWN), ("<s>", 0.0, spm_wfst.CONTROL), ("</s>", 0.0, spm_wfst.CONTROL)]
    rows += [(f"<0x{b:02X}>", 0.0, spm_wfst.BYTE) for b in range(256 * fallback)] + [(u, 0.0, spm_wfst.USER) for u in user]
    rows += [(p, score, spm_wfst.NORMAL) for p, score in pieces]
    out = b"".join(field(1, field(1, p.encode()) + field(2, score) + field(3, t)) for p, score, t in rows)
    out += field(2, field(3, kind) + field(35, int(fallback)) + field(40, 0) + field(41, 1) + field(42, 2) + field(43, (1 << 64) - 1))
    return out + field(3, field(2, chars) * bool(chars) + field(3, int(prefix)) + field(4, int(squeeze)) + field(5, 1))


def char_map():
    """The library's own NFKC map."""
    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    return dict(spm_wfst._fields(dict(spm_wfst._fields(norm.serialized_model_proto()))[3]))[2]


def texts(rng, letters):
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    some = [rng.choice(["", " ", "  "]).join([rng.choice([" ", "", "   "]), *(word() + rng.choice([" ", "  ", ",", "\n", ""]) for _ in range(rng.randint(0, 8)))]) for _ in range(300)]
    return [*some, "", " ", "   ", "a", "a b", "  a   b  ", "xyz☃☃ é", "☃", f"a{META}b", "ab" * 200]


def same(raw, rng, letters):
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=raw), spm_wfst.Transducer(raw)
    for t in texts(rng, letters):
        got, want = own.encode(t).tolist(), lib.encode(t)
        if got != want:  # paths of one weight, between which the library's rounding decides
            assert not own.bpe and len(got) == len(want) and sum(map(lib.get_score, got)) == pytest.approx(sum(map(lib.get_score, want)), abs=1e-6), t
        assert own.decode(lib.encode(t)) == lib.decode(lib.encode(t)), t


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("fallback", [False, True])
def test_unigram(squeeze, prefix, fallback):
    rng = random.Random(squeeze + 2 * prefix + 4 * fallback)
    pieces = {META: -2.5, **{c: -rng.uniform(3, 6) for c in "abcde,"}}
    for _ in range(60):
        pieces[rng.choice(["", META]) + "".join(rng.choice("abcde") for _ in range(rng.randint(2, 5)))] = -rng.uniform(3, 9)
    same(model(1, pieces.items(), prefix, squeeze, fallback=fallback), rng, "abcdef")


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("fallback", [False, True])
def test_merges(squeeze, fallback):
    rng = random.Random(10 + squeeze + 2 * fallback)
    parts, made = [META, *"abcde,"], []
    for _ in range(80):  # merges of what there is, in order
        p = rng.choice(parts) + rng.choice([x for x in parts if META not in x])
        if p not in parts and len(p) < 9:
            parts.append(p)
            made.append(p)
    pieces = [(p, -float(k)) for k, p in enumerate(made)] + [(p, -1000.0 - k) for k, p in enumerate([META, *"abcde,"])]
    raw = model(2, pieces, True, squeeze, fallback=fallback)
    same(raw, rng, "abcdef")
    v = spm_wfst.Transducer(raw).allowed
    assert v.ordered
    for _ in range(3000):
        a, b = rng.choice(parts), rng.choice(parts)
        assert (v.weight(a, b) == 0) == (v.merged(a + b) == [a, b] and v.merged(a) == [a] and v.merged(b) == [b])


def test_character_map():
    rng = random.Random(5)
    pieces = {META: -2.5, **{c: -rng.uniform(3, 6) for c in "abcdefi1234,"}, "fi": -3.0, "ab": -3.5, META + "a": -3.2}
    raw = model(1, pieces.items(), chars=char_map())
    same(raw, rng, "abcde１２ﬁＡｂ 　\t①é́")
    assert spm_wfst.Transducer(raw).encode("ﬁ１").tolist() == spm_wfst.Transducer(raw).encode("fi1").tolist()


def test_path_has_the_least_weight():
    """The shortest path against all paths."""
    rng = random.Random(6)
    weights = {c: (k, 4.0) for k, c in enumerate("ab")} | {"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))): (10 + k, rng.uniform(1, 9)) for k in range(12)}
    pieces = spm_wfst.Pieces(weights, 11.0)

    def every(s):
        if not s:
            yield 0.0
        for n in range(1, len(s) + 1):
            w = weights.get(s[:n], (0, 11.0 if n == 1 else None))[1]
            if w is not None:
                yield from (w + x for x in every(s[n:]))

    for _ in range(100):
        s = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        path = spm_wfst.shortest(s, pieces, spm_wfst.Everything())
        assert "".join(p for p, _ in path) == s
        assert sum(weights.get(p, (0, 11.0))[1] for p, _ in path) == pytest.approx(min(every(s)))
