"""Personal data beside other values."""

import pytest

from tessera.llm import pii

VALUES = {"+1 (555) 123-4567": "phone", "+1 555-123-4567": "phone", "+44 20 7946 0958": "phone", "+354 555 1234": "phone", "192.168.10.20": "ip", "2024-05-17": "date", "17.05.2024": "date", "219-09-9999": "ssn", "4111 1111 1111 1111": "card", "3782 822463 10005": "card", "3782-822463-10005": "card", "(555) 123-4567": "phone"}


def test_adjacent_values(spark):
    phones = [v for v, k in VALUES.items() if v[0] == "+"]
    texts = [[v] for v in VALUES] + [[p, v] for p in phones for v in VALUES if v != p] + [[p, "10:45"] for p in phones]
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "k long, text string").coalesce(1)
    got = {r.k: r for r in pii.pseudonymise(rows, "key").collect()}
    alone = {v: got[k].pii[0].pseudonym for k, v in enumerate(VALUES)}
    for k, t in enumerate(texts):
        assert [(x.kind, x.value) for x in got[k].pii] == [(VALUES[v], v) for v in t if v in VALUES]
        assert got[k].text == " ".join(alone.get(v, v) for v in t)
    for v in ("3782 822463 10005", "3782-822463-10005"):
        digits = [int(c) for c in alone[v] if c.isdigit()]
        assert alone[v][4] == v[4] and alone[v][11] == v[11] and len(alone[v]) == 17 and digits[0] == 3
        assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
