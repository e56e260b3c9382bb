"""Format-preserving Feistel pseudonyms for personal data, in DataFrame expressions only.

A value is read as a list of symbols with a radix each (digits 10, letters 26, octets 256, ...). A balanced
Feistel network over the two halves of that list adds, symbol by symbol and modulo its radix, a keyed SHA-512
stream of the other half; ten such rounds permute exactly the values of that format. So a pseudonym has its
value's format and passes the same validation, equal values get equal pseudonyms in all documents, and
different values of a format get different ones. Nothing is shuffled and no state is kept.

| kind | validated by | kept | permuted |
|-|-|-|-|
| email | shape | last label of the domain, punctuation | letters and digits of the local part; of the domain, as a value of its own |
| iban | mod 97 | country, grouping | account; check digits are computed anew |
| ip | four octets of at most 255 | a first octet of 0; unicast and other ranges | octets |
| ssn | valid area, group and serial | dashes | area, group, serial within their valid ranges |
| phone | 7 to 15 digits | country code, punctuation | digits; North American codes stay valid |
| date | calendar, 1904 to 2099 | format, 28-year period | day within the period; a/b/year is month first unless a > 12 |
| card | 13 to 19 digits, Luhn | first digit, grouping | digits; the check digit is computed anew |
| secret | access key shape, or password, secret, token or key assigned | name and quotes | letters and digits by class |

What fails validation stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

ROUNDS = 10
KEY = "replace this key in production"

EMAIL = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"""(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?:gh[pousr]_|sk-)[A-Za-z0-9]{16,}+|(?i:password|passwd|pwd|secret|token|api[_-]?key)[ \t]{0,2}[=:][ \t]{0,2}["']?[A-Za-z0-9+/_.-]{8,}+["']?"""
IP = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9])|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9])"
CARD = r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}(?![0-9])|[0-9]{13,19}(?![0-9])"
#: What follows a phone number and a blank and isn't its next group: another value, or a time.
_OTHER = " (?:" + "|".join([IP, SSN, DATE, r"[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9]|[ -][0-9])|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])|[0-9]{13,19}(?![0-9])", r"[0-9]{1,2}:[0-9]{2}", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"]) + ")"
PHONE = (
    r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9]|[.-][0-9])"
    r"|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2}(?:(?!" + _OTHER + r")[ .-]?\(?[0-9]{2,4}\)?){0,2}(?![0-9])"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
)
KINDS = {"email": EMAIL, "iban": IBAN, "secret": SECRET, "ip": IP, "ssn": SSN, "phone": PHONE, "date": DATE, "card": CARD}
ANY = r"(?<![A-Za-z0-9_])(?:" + "|".join(KINDS.values()) + ")"
#: A text without any of these can't hold a value; it isn't searched further.
HINT = r"[0-9@]|(?i:password|passwd|pwd|secret|token|api[_-]?key)|A[KS]IA|gh[pousr]_|sk-"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once."""
    return F.try_element_at(F.transform(F.array(value), f), F.lit(1))


def feistel(values: Column, radices: Column, key: str, tag: str) -> Column:
    """Permutes arrays of numbers below their radices; both are array<bigint> of one length."""

    def stir(mine: Column, other: Column, radix: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), F.size(mine).cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ",")), 512)
        block = lambda s, j: F.when(j < 20, s).otherwise(F.sha2(F.concat(s, F.floor(j / 20).cast("string")), 512))
        return let(stream, lambda s: F.transform(mine, lambda x, j: (x + F.conv(F.substr(block(s, j), F.lit(1) + 6 * (j % 20), F.lit(6)), 16, 10).cast("long")) % F.get(radix, j)))

    half = F.floor(F.size(values) / 2).cast("int")
    first, second = (lambda a: F.slice(a, F.lit(1), half)), (lambda a: F.slice(a, half + 1, F.size(a) - half))
    state = F.struct(first(values).alias("a"), second(values).alias("b"))

    def step(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(stir(s["a"], s["b"], first(radices), i).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), stir(s["b"], s["a"], second(radices), i).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step, lambda s: F.concat(s["a"], s["b"]))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _radix(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1).cast("long")


def _base(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).when(c.rlike("[a-z]"), 97).otherwise(F.ascii(c)).cast("long")


def by_class(s: Column, key: str, tag: str) -> Column:
    """Permutes the ASCII letters and digits of a string within their classes; other characters stay."""
    inner = lambda cs: F.filter(cs, lambda c: _radix(c) > 1)

    def fill(cs: Column, new: Column) -> Column:
        start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))
        step = lambda a, c: F.when(_radix(c) > 1, F.struct(F.concat(a["s"], F.char(_base(c) + F.get(new, a["k"]))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k")))
        return F.aggregate(cs, start, step, lambda a: a["s"])

    return let(_chars(s), lambda cs: let(feistel(F.transform(inner(cs), lambda c: F.ascii(c) - _base(c)), F.transform(inner(cs), _radix), key, tag), lambda new: fill(cs, new)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _numbers(digits: Column) -> Column:
    return F.transform(_chars(digits), lambda c: c.cast("long"))


def _dress(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced in order."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["s"], F.substr(digits, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k")))
    return F.aggregate(_chars(shape), start, step, lambda a: a["s"])


def _join(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), "")


def _tens(numbers: Column) -> Column:
    return F.transform(numbers, lambda x: F.lit(10).cast("long"))


def luhn_check(body: Column) -> Column:
    """The digit that follows body (digits) in a valid number."""
    doubled = F.transform(F.reverse(_numbers(body)), lambda x, i: F.when(i % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))
    return ((F.lit(10) - F.aggregate(doubled, F.lit(0).cast("long"), lambda a, x: a + x) % 10) % 10).cast("string")


def _card(hit: Column, key: str) -> Column:
    def swap(d: Column) -> Column:
        body = let(_numbers(F.substr(d, F.lit(2), F.length(d) - 2)), lambda v: F.concat(F.left(d, F.lit(1)), _join(feistel(v, _tens(v), key, "card"))))
        return F.when(F.length(d).between(13, 19) & (luhn_check(F.substr(d, F.lit(1), F.length(d) - 1)) == F.right(d, F.lit(1))), let(body, lambda b: _dress(hit, F.concat(b, luhn_check(b))))).otherwise(hit)

    return let(_digits(hit), swap)


def _phone(hit: Column, key: str) -> Column:
    head = F.regexp_extract(hit, r"^\+(?:1(?=[^0-9])|[0-9]{1,3}(?=[^0-9])|1(?=[0-9]{10}$)|[0-9]{2})?", 0)

    def swap(d: Column) -> Column:
        v = _numbers(d)
        american = d.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
        low = lambda i: F.when(american & i.isin(0, 3), 2).otherwise(0).cast("long")
        new = feistel(F.transform(v, lambda x, i: x - low(i)), F.transform(v, lambda x, i: 10 - low(i)), key, "phone")
        return F.concat(head, _dress(F.substr(hit, F.length(head) + 1), _join(F.transform(new, lambda x, i: x + low(i)))))

    rest = _digits(F.substr(hit, F.length(head) + 1))
    return F.when(F.length(_digits(hit)).between(7, 15), let(rest, swap)).otherwise(hit)


def _ip(hit: Column, key: str) -> Column:
    def swap(v: Column) -> Column:
        first = F.get(v, F.lit(0))
        low = F.when(first == 0, 0).when(first < 224, 1).otherwise(224).cast("long")
        values = F.transform(v, lambda x, i: F.when(i > 0, x).otherwise(x - low))
        radices = F.transform(v, lambda x, i: F.when(i > 0, 256).when(low == 1, 223).when(low == 0, 1).otherwise(32).cast("long"))
        new = F.transform(feistel(values, radices, key, "ip"), lambda x, i: F.when(i > 0, x).otherwise(x + low).cast("string"))
        return F.when(F.forall(v, lambda x: x <= 255), F.array_join(new, ".")).otherwise(hit)

    return let(F.transform(F.split(hit, r"\."), lambda x: x.cast("long")), swap)


def _ssn(hit: Column, key: str) -> Column:
    def swap(v: Column) -> Column:
        a, g, s = (F.get(v, F.lit(i)) for i in range(3))
        values = F.array(F.when(a < 666, a - 1).otherwise(a - 2), g - 1, s - 1)
        new = feistel(values, F.array(*[F.lit(r).cast("long") for r in (898, 99, 9999)]), key, "ssn")
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        text = let(new, lambda n: F.concat_ws("-", pad(F.get(n, F.lit(0)) + F.when(F.get(n, F.lit(0)) < 665, 1).otherwise(2), 3), pad(F.get(n, F.lit(1)) + 1, 2), pad(F.get(n, F.lit(2)) + 1, 4)))
        return F.when(a.between(1, 899) & (a != 666) & (g > 0) & (s > 0), text).otherwise(hit)

    return let(F.transform(F.split(hit, "-"), lambda x: x.cast("long")), swap)


def _date(hit: Column, key: str) -> Column:
    sep = F.regexp_extract(hit, "[^0-9]", 0)

    def swap(parts: Column) -> Column:
        p = [F.get(parts, F.lit(i)) for i in range(3)]
        n = [x.cast("int") for x in p]
        iso, month_first = sep == "-", (sep == "/") & (n[0] <= 12)
        y = F.when(iso, n[0]).otherwise(n[2])
        m = F.when(iso, n[1]).when(month_first, n[0]).otherwise(n[1])
        d = F.when(iso, n[2]).when(month_first, n[1]).otherwise(n[0])
        good = y.between(1904, 2099) & m.between(1, 12) & (d >= 1)
        day = F.when(good, F.when(d <= F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1)))), F.make_date(y, m, d)))

        def moved(at: Column) -> Column:
            since = F.datediff(at, F.lit("1904-01-01").cast("date")).cast("long")
            off = since % 10_227  # days in 28 years; 21 * 487
            new = feistel(F.array(F.floor(off / 487), off % 487), F.array(F.lit(21).cast("long"), F.lit(487).cast("long")), key, "date")
            out = let(new, lambda v: F.date_add(F.lit("1904-01-01").cast("date"), (since - off + F.get(v, F.lit(0)) * 487 + F.get(v, F.lit(1))).cast("int")))
            fit = lambda x, was: F.lpad(x.cast("string"), F.greatest(F.length(was), F.length(x.cast("string"))), F.lit("0"))
            return let(out, lambda o: F.when(iso, F.date_format(o, "yyyy-MM-dd")).when(month_first, F.concat_ws("/", fit(F.month(o), p[0]), fit(F.dayofmonth(o), p[1]), F.year(o).cast("string"))).otherwise(F.concat(fit(F.dayofmonth(o), p[0]), sep, fit(F.month(o), p[1]), sep, F.year(o).cast("string"))))

        return let(day, lambda at: F.when(at.isNotNull(), moved(at)).otherwise(hit))

    return let(F.split(hit, "[^0-9]"), swap)


def mod97(s: Column) -> Column:
    """Letters and digits as IBANs count them, modulo 97."""
    return F.aggregate(_chars(s), F.lit(0).cast("long"), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def _iban(hit: Column, key: str) -> Column:
    bare = lambda s: F.replace(s, F.lit(" "), F.lit(""))
    country, rest = F.left(hit, F.lit(2)), F.substr(hit, F.lit(5))
    valid = F.length(bare(hit)).between(15, 34) & (mod97(F.concat(bare(rest), F.left(hit, F.lit(4)))) == 1)
    new = let(by_class(rest, key, "iban"), lambda r: F.concat(country, F.lpad((98 - mod97(F.concat(bare(r), country, F.lit("00")))).cast("string"), 2, "0"), r))
    return F.when(valid, new).otherwise(hit)


def _email(hit: Column, key: str) -> Column:
    local, domain = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
    last = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    return F.concat(by_class(local, key, "email"), F.lit("@"), by_class(F.substr(domain, F.lit(1), F.length(domain) - F.length(last)), key, "domain"), last)


def _secret(hit: Column, key: str) -> Column:
    head = F.regexp_extract(hit, r"""^(?:AKIA|ASIA|gh[pousr]_|sk-|[A-Za-z_-]+[ \t]*[=:][ \t]*["']?)""", 0)
    return F.concat(head, by_class(F.substr(hit, F.length(head) + 1), key, "secret"))


_SWAP = {"email": _email, "iban": _iban, "secret": _secret, "ip": _ip, "ssn": _ssn, "phone": _phone, "date": _date, "card": _card}


def kind_of(hit: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, shape in reversed(KINDS.items()):
        out = F.when(hit.rlike(f"^(?:{shape})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(hit: Column, kind: Column, key: str) -> Column:
    """The pseudonym of one value; the value itself if it isn't valid."""
    out = hit
    for k, swap in _SWAP.items():
        out = F.when(kind == k, swap(hit, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "pii") -> DataFrame:
    """docs with text_col's values replaced; found_col (replaced if there) lists (kind, value, pseudonym) in order of the text.

    Values that fail validation stay and aren't listed. Null text: null text, empty list. Empty text: as it is.
    Whole texts are searched, however long; other columns pass through.
    """
    t = F.col(f"`{text_col}`")
    hits = F.transform(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), lambda h: let(kind_of(h), lambda k: F.struct(k.alias("kind"), h.alias("value"), pseudonym(h, k, key).alias("pseudonym"))))
    empty = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")
    out = docs.withColumn(found_col, F.when(t.rlike(HINT), hits).otherwise(empty))
    pieces = F.split(t, ANY, -1)
    new = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col(f"`{found_col}`"), i)["pseudonym"], F.lit("")))), "")
    changed = F.filter(found_col, lambda x: x["value"] != x["pseudonym"])
    return out.withColumn(text_col, F.when(F.size(found_col) > 0, new).otherwise(t)).withColumn(found_col, changed)


def op2_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """Every document with its pseudonymised text, and number and kinds of the values replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, KEY)
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), F.array_sort(F.array_distinct(F.transform("pii", lambda x: x["kind"]))).alias("kinds"))
