"""Pseudonyms against a plain Feistel network, valid and invalid values of every kind."""

import itertools
import random

from tessera.llm import pii

from . import plain_pii
from .conftest import SF


def values(rng):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda n: "".join(rng.choice("abcXYZ019") for _ in range(n))
    body = rng.choice("3456") + d(14)
    bank = rng.choice(["DE", "GB", "FR"]), d(18)
    made = f"{bank[0]}{98 - plain_pii.mod97(bank[1] + bank[0] + '00'):02}{bank[1]}"
    card = body + plain_pii.luhn(body)
    return [
        f"{w(5)}.{w(3)}@{w(4)}.{w(6)}.org", f"{w(60)}@{w(30)}.com",
        made, " ".join(made[k : k + 4] for k in range(0, 22, 4)), f"{bank[0]}{d(20)}",
        ".".join(str(rng.randint(0, 300)) for _ in range(4)), f"0.{rng.randint(0, 255)}.0.1",
        f"{d(3)}-{d(2)}-{d(4)}", "666-12-1234", "000-12-1234",
        f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+1{d(10)}", f"+44 20 {d(4)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}",
        f"{rng.randint(1890, 2110)}-{rng.randint(1, 13):02}-{rng.randint(1, 31):02}", f"{rng.randint(1, 14)}/{rng.randint(1, 31)}/{rng.randint(1900, 2100)}", f"{rng.randint(1, 31)}.{rng.randint(1, 12):02}.{rng.randint(1900, 2100)}",
        card, " ".join(card[k : k + 4] for k in range(0, 16, 4)), d(16),
        f"AKIA{'ABCD2345' * 2}", f"ghp_{w(36)}", f"api_key = '{w(40)}'", f"Password: {w(9)}",
    ]


def test_against_plain(spark):
    rng = random.Random(11)
    texts = [None, "", "no value", "ſecret=abcdefgh12"]
    for _ in range(25):
        vs = values(rng)
        texts += vs
        rng.shuffle(vs)
        texts += ["; ".join(vs), f"{vs[0]}, word {vs[1]}\n{vs[2]} x " * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r.k: r for r in pii.pseudonymise(rows, "key").collect()}
    kinds = set()
    for k, t in enumerate(texts):
        text, found = plain_pii.pseudonymise(t, "key")
        assert (got[k].text, [tuple(x) for x in got[k].pii]) == (text, found)
        kinds |= {x[0] for x in found}
    assert kinds == set(pii.KINDS)


def test_query_against_plain(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pii.op2_pii_pseudonyms(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        text, found = plain_pii.pseudonymise(rows[r.doc_id], pii.KEY)
        assert (r.text, r.n_pii, r.kinds) == (text, len(found), sorted({x[0] for x in found}))


def test_permutation():
    """Every value of a format has a pseudonym of its own."""
    for radices in ((21, 487), (10,), (3, 4, 5), (10, 26, 10)):
        domain = list(itertools.product(*map(range, radices)))
        assert sorted(tuple(plain_pii.feistel(v, radices, "key", "t")) for v in domain) == domain
