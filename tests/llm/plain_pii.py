"""Pseudonyms in plain Python: the patterns are the operator's, all else is written anew."""

import hashlib
import re
from datetime import date, timedelta

from tessera.llm import pii

ANY = re.compile(pii.ANY, re.ASCII)
SHAPES = {kind: re.compile(shape, re.ASCII) for kind, shape in pii.KINDS.items()}
FIRST, PERIOD = date(1904, 1, 1), 10_227


def feistel(values, radices, key, tag):
    half = len(values) // 2
    sides = [list(values[:half]), list(values[half:])]
    moduli = [radices[:half], radices[half:]]
    for i in range(10):
        mine, other = sides[i % 2], sides[1 - i % 2]
        seed = f"{key}|{tag}|{i}|{len(mine)}|{','.join(map(str, other))}"
        first = hashlib.sha512(seed.encode()).hexdigest()
        stream = "".join((first if k == 0 else hashlib.sha512(f"{first}{k}".encode()).hexdigest())[:120] for k in range(len(mine) // 20 + 1))
        sides[i % 2] = [(x + int(stream[6 * j : 6 * j + 6], 16)) % moduli[i % 2][j] for j, x in enumerate(mine)]
    return sides[0] + sides[1]


def by_class(s, key, tag):
    base = [48 if c in "0123456789" else 65 if "A" <= c <= "Z" else 97 if "a" <= c <= "z" else None for c in s]
    at = [k for k, b in enumerate(base) if b is not None]
    new = feistel([ord(s[k]) - base[k] for k in at], [10 if base[k] == 48 else 26 for k in at], key, tag)
    out = list(s)
    for k, x in zip(at, new, strict=True):
        out[k] = chr(base[k] + x)
    return "".join(out)


def digits(s):
    return "".join(c for c in s if c in "0123456789")


def dress(shape, ds):
    ds = iter(ds)
    return "".join(next(ds) if c in "0123456789" else c for c in shape)


def luhn(body):
    total = sum(x if k % 2 else x * 2 - 9 * (x > 4) for k, x in enumerate(int(c) for c in reversed(body)))
    return str(-total % 10)


def tens(ds, key, tag):
    return "".join(map(str, feistel([int(c) for c in ds], [10] * len(ds), key, tag)))


def card(hit, key):
    d = digits(hit)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != d[-1]:
        return hit
    body = d[0] + tens(d[1:-1], key, "card")
    return dress(hit, body + luhn(body))


def phone(hit, key):
    if not 7 <= len(digits(hit)) <= 15:
        return hit
    head = re.match(r"\+(?:1(?=[^0-9])|[0-9]{1,3}(?=[^0-9])|1(?=[0-9]{10}$)|[0-9]{2})?|", hit)[0]
    d = digits(hit[len(head) :])
    low = [2 * (k in (0, 3) and re.fullmatch("[2-9][0-9]{2}[2-9][0-9]{6}", d) is not None) for k in range(len(d))]
    new = feistel([int(c) - x for c, x in zip(d, low, strict=True)], [10 - x for x in low], key, "phone")
    return head + dress(hit[len(head) :], "".join(str(c + x) for c, x in zip(new, low, strict=True)))


def ip(hit, key):
    v = [int(x) for x in hit.split(".")]
    if max(v) > 255:
        return hit
    low, size = (0, 1) if v[0] == 0 else (1, 223) if v[0] < 224 else (224, 32)
    new = feistel([v[0] - low, *v[1:]], [size, 256, 256, 256], key, "ip")
    return ".".join(map(str, [new[0] + low, *new[1:]]))


def ssn(hit, key):
    areas = [a for a in range(1, 900) if a != 666]
    a, g, s = map(int, hit.split("-"))
    if a not in areas or not g or not s:
        return hit
    x, y, z = feistel([areas.index(a), g - 1, s - 1], [len(areas), 99, 9999], key, "ssn")
    return f"{areas[x]:03}-{y + 1:02}-{z + 1:04}"


def day(hit, key):
    sep = next(c for c in hit if not c.isdigit())
    p = hit.split(sep)
    order = "ymd" if sep == "-" else "mdy" if sep == "/" and int(p[0]) <= 12 else "dmy"
    part = dict(zip(order, p, strict=True))
    try:
        at = date(int(part["y"]), int(part["m"]), int(part["d"]))
    except ValueError:
        return hit
    if not 1904 <= at.year <= 2099:
        return hit
    since = (at - FIRST).days
    x, y = feistel(divmod(since % PERIOD, 487), (21, 487), key, "date")
    to = FIRST + timedelta(since - since % PERIOD + x * 487 + y)
    new = {"y": f"{to.year:04}", "m": str(to.month).zfill(len(part["m"])), "d": str(to.day).zfill(len(part["d"]))}
    return sep.join(new[c] for c in order)


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s.replace(" ", ""))) % 97


def iban(hit, key):
    if not 15 <= len(hit.replace(" ", "")) <= 34 or mod97(hit[4:] + hit[:4]) != 1:
        return hit
    rest = by_class(hit[4:], key, "iban")
    return f"{hit[:2]}{98 - mod97(rest + hit[:2] + '00'):02}{rest}"


def email(hit, key):
    local, domain = hit.split("@")
    name, last = domain.rsplit(".", 1)
    return f"{by_class(local, key, 'email')}@{by_class(name, key, 'domain')}.{last}"


def secret(hit, key):
    head = re.match(r"""AKIA|ASIA|gh[pousr]_|sk-|[A-Za-z_-]+[ \t]*[=:][ \t]*["']?""", hit)[0]
    return head + by_class(hit[len(head) :], key, "secret")


SWAP = {"email": email, "iban": iban, "ip": ip, "ssn": ssn, "phone": phone, "date": day, "card": card, "secret": secret}


def pseudonymise(text, key):
    """(new text, [(kind, value, pseudonym)] of the values that changed)."""
    found = []

    def swap(m):
        kind = next(k for k, shape in SHAPES.items() if shape.fullmatch(m[0]))
        new = SWAP[kind](m[0], key)
        found.append((kind, m[0], new))
        return new

    out = None if text is None else ANY.sub(swap, text)
    return out, [f for f in found if f[1] != f[2]]
