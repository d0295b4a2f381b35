"""Personal data: found by pattern, checked, and replaced by format-preserving pseudonyms.

Card numbers (Luhn), bank accounts (IBAN), social-security-like numbers, telephone numbers, IPv4 addresses and dates
are permuted by a keyed Feistel network over the values that their format allows, so the pseudonym is a valid value
of the same format, the same value always gets the same pseudonym, and the key holder can undo it. All digits of a
number but its check digits go through one network, so that numbers that begin alike don't stay alike. Where a format
has fewer values than the network permutes, it is applied again until it gives one of them. E-mail addresses, which
have no finite format, get a keyed token.

DataFrame functions only, row by row: no shuffle, no Python.

Defined cases: null text counts as empty; texts of any length are read whole; values that fail their check
(Luhn, octets, calendar) stay; where matches of two kinds overlap, the one that starts first (then the longer,
then by the order of KINDS) is replaced; equal rows get equal results; an empty table gives an empty one; extra
columns pass through `find` and `mask`, whose results replace columns of the same names and no others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import text_or_empty, unwrapped, wrapped
from mosaiq.llm.spans import let, located, matches

_DAY = "(?:[12][0-9]|3[01]|[1-9])"
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
#: The patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|(?:[0-9]{4}[ -]?){3}[0-9]{1,7})(?![0-9])",
    # North American with a separator before the last four; international (8 to 15 digits); ten digits alone
    "phone": r"(?<![0-9+])(?:\+?(?:[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}|\+[1-9](?:[ .()-]{0,2}[0-9]){7,14}|[2-9][0-9]{2}[2-9][0-9]{6})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/])[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}(?![0-9/])"
    rf"|(?<![0-9-]){_DAY} {_MONTH} (?:19|20)[0-9]{{2}}(?![0-9])|\b{_MONTH} {_DAY}, (?:19|20)[0-9]{{2}}(?![0-9])",
}
KINDS = tuple(PATTERNS)
ROUNDS = 8


def prf(key: str, kind: str, i: int, value: Column, modulus: Column) -> Column:
    """A keyed pseudo-random number in [0, modulus): 60 bits of SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{key}|{kind}|{i}|"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % modulus


def halves(l: Column, r: Column, a: Column, b: Column, key: str, kind: str, undo: bool = False) -> Column:
    """struct(l, r): a keyed permutation of the pairs l < a and r < b, which are shifted in turn by functions of each other."""
    sign = -1 if undo else 1
    state = F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))
    left = lambda i: lambda s: F.struct(F.pmod(s["l"] + sign * prf(key, kind, i, s["r"], a), a).alias("l"), s["r"].alias("r"))
    right = lambda i: lambda s: F.struct(s["l"].alias("l"), F.pmod(s["r"] + sign * prf(key, kind, i, s["l"], b), b).alias("r"))
    for i in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        state = let(state, right(i) if i % 2 else left(i))
    return state


def feistel(value: Column, a: int, b: int, key: str, kind: str, undo: bool = False) -> Column:
    """A keyed permutation of the numbers below a * b."""
    x, y = F.lit(a).cast("long"), F.lit(b).cast("long")
    return let(halves(F.floor(value / y), value % y, x, y, key, kind, undo), lambda s: s["l"] * y + s["r"])


def shuffled(digits: Column, key: str, kind: str, undo: bool = False) -> Column:
    """A keyed permutation of the digit strings of each length, up to 36."""

    def of(n: Column) -> Column:
        half = F.ceil(n / 2).cast("int")
        power = lambda k: F.pow(F.lit(10.0), k).cast("long")
        keyed = halves(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n - half), power(half), power(n - half), key, kind, undo)
        return let(keyed, lambda s: F.concat(_padded(s["l"], half), _padded(s["r"], n - half)))

    return F.when(F.length(digits) < 2, digits).otherwise(let(F.length(digits), of))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by those given."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    state = F.aggregate(
        chars,
        F.struct(F.lit(1).alias("i"), F.lit("").alias("out")),
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct((s["i"] + 1).alias("i"), F.concat(s["out"], F.substring(digits, s["i"], F.lit(1))).alias("out"))).otherwise(
            F.struct(s["i"].alias("i"), F.concat(s["out"], c).alias("out"))
        ),
        lambda s: s["out"],
    )
    return state


def luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string whose last digit is the check digit."""
    return F.aggregate(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum")),
        lambda s, c: F.struct(
            (s["i"] + 1).alias("i"),
            (s["sum"] + F.when(s["i"] % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") / 5).cast("int") + (2 * c.cast("int")) % 10)).alias("sum"),
        ),
        lambda s: s["sum"],
    )


def _padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _card(v: Column, key: str, undo: bool) -> Column:
    """All digits but the last are permuted together; the last is the new check digit."""
    body = lambda d: shuffled(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", undo)
    checked = lambda b: F.concat(b, F.pmod(-luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))
    return let(_digits(v), lambda d: _refill(v, let(body(d), checked)))


def mod97(account: Column) -> Column:
    """The remainder by 97 of an account's letters and digits (letters as numbers from 10), its first four moved to the end."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account) - 4), F.substring(account, 1, 4))
    number = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.conv(c, 36, 10).cast("long"))
    return F.aggregate(number, F.lit(0).cast("long"), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)


def _iban(v: Column, key: str, undo: bool) -> Column:
    """Country and letters stay; the digits after the check digits are permuted together, and these follow."""
    plain = F.replace(v, F.lit(" "), F.lit(""))

    def of(p: Column) -> Column:
        rest = F.substring(p, F.lit(5), F.length(p) - 4)
        new = _refill(rest, shuffled(_digits(rest), key, "iban", undo))
        check = lambda r: _padded(98 - mod97(F.concat(F.substring(p, 1, 2), F.lit("00"), r)), 2)
        return let(new, lambda r: F.concat(check(r), _digits(r)))

    return _refill(v, let(plain, of))


def _ssn(v: Column, key: str, undo: bool) -> Column:
    """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999: 898 * 99 * 9999 values."""

    def of(d: Column) -> Column:
        area = F.substring(d, 1, 3).cast("long")
        n = ((F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + F.substring(d, 4, 2).cast("long") - 1) * 9999 + F.substring(d, 6, 4).cast("long") - 1

        def back(x: Column) -> Column:
            place = F.floor(x / F.lit(99 * 9999)).cast("long")
            area = F.when(place >= 665, place + 2).otherwise(place + 1)
            return F.concat(_padded(area, 3), _padded(F.floor(x / 9999).cast("long") % 99 + 1, 2), _padded(x % 9999 + 1, 4))

        return let(feistel(n, 898 * 99, 9999, key, "ssn", undo), back)

    return let(_digits(v), lambda d: _refill(v, of(d)))


def _ten(ten: Column, key: str, undo: bool) -> Column:
    """Ten digits, as a number. Those whose area and exchange start with 2 to 9 (800 * 800 * 10**4) and all others
    are permuted apart, so that what can be a number without separators stays one."""
    area, rest = F.floor(ten / F.lit(10**7)).cast("long"), ten % F.lit(10**7)

    def north_american(x: Column) -> Column:
        return (F.floor(x / F.lit(8 * 10**6)).cast("long") + 200) * F.lit(10**7) + x % F.lit(8 * 10**6) + F.lit(2 * 10**6)

    def other(x: Column) -> Column:
        y = x - F.lit(2 * 10**9)
        return F.when(y < 0, x).otherwise((F.floor(y / F.lit(2 * 10**6)).cast("long") + 200) * F.lit(10**7) + y % F.lit(2 * 10**6))

    n = F.when(area < 200, ten).otherwise(F.lit(2 * 10**9) + (area - 200) * F.lit(2 * 10**6) + rest)
    m = (area - 200) * F.lit(8 * 10**6) + rest - F.lit(2 * 10**6)
    return F.when((area >= 200) & (rest >= 2 * 10**6), let(feistel(m, 80000, 80000, key, "phone", undo), north_american)).otherwise(
        let(feistel(n, 60000, 60000, key, "phone-other", undo), other)
    )


def _phone(v: Column, key: str, undo: bool) -> Column:
    """The last ten digits are permuted; a country code stays. Of international numbers of ten digits or fewer, the
    last seven."""

    def of(d: Column) -> Column:
        n = F.length(d)
        ten = let(F.substring(d, n - 9, F.lit(10)).cast("long"), lambda x: _ten(x, key, undo))
        seven = feistel(F.substring(d, n - 6, F.lit(7)).cast("long"), 10**4, 10**3, key, "phone-7", undo)
        short = F.concat(F.substring(d, F.lit(1), n - 7), _padded(seven, 7))
        return F.when(v.startswith("+") & (n <= 10), short).otherwise(F.concat(F.substring(d, F.lit(1), n - 10), _padded(ten, 10)))

    return let(_digits(v), lambda d: _refill(v, of(d)))


def _ip(v: Column, key: str, undo: bool) -> Column:
    def of(parts: Column) -> Column:
        n = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
        octet = lambda x, i: (F.floor(x / F.lit(256**i)).cast("long") % 256).cast("string")
        return let(feistel(n, 65536, 65536, key, "ip", undo), lambda x: F.concat_ws(".", *[octet(x, i) for i in (3, 2, 1, 0)]))

    return let(F.split(v, r"\."), of)


#: Dates from 1900-01-01 to 2099-12-31, and a network of few more values.
DAYS = 73_049
_A, _B = 271, 270
#: Steps after which a walk is back: there are fewer values that are none, and of late days more than half are.
WALK = 160


#: Ways to write a date: of which texts, and Spark's format. With slashes the month is first where it can be.
WRITTEN = (
    ("^[0-9]{4}-", "yyyy-MM-dd"),
    ("^(?:0[0-9]|1[0-2])/", "MM/dd/yyyy"),
    ("^[0-9]{2}/", "dd/MM/yyyy"),
    ("^[0-9]", "d MMMM yyyy"),
    ("^[A-Z]", "MMMM d, yyyy"),
)


def _by_format(v: Column, of: Callable[[str], Column]) -> Column:
    out = None
    for like, form in WRITTEN:
        out = F.when(v.rlike(like), of(form)) if out is None else out.when(v.rlike(like), of(form))
    return out


def _day(v: Column) -> Column:
    return F.datediff(_by_format(v, lambda form: F.try_to_date(v, form)), F.lit("1900-01-01").cast("date")).cast("long")


def _date(v: Column, key: str, undo: bool) -> Column:
    """Days are permuted, again until the value is a day of the range, and where the day is first because it is above 12
    until it is such a day."""
    date = lambda n: F.date_add(F.lit("1900-01-01").cast("date"), n.cast("int"))
    step = lambda n: feistel(n, _A, _B, key, "date", undo)

    def walked(day: Column) -> Column:
        late = v.rlike("^(?:1[3-9]|[23][0-9])/")
        good = lambda n: (n < DAYS) & (~late | (F.dayofmonth(date(n)) > 12))
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(day), lambda n, _: F.when(good(n), n).otherwise(step(n)))

    return let(let(_day(v), walked), lambda x: _by_format(v, lambda form: F.date_format(date(x), form)))


def _email(v: Column, key: str, undo: bool) -> Column:
    return F.concat(F.lit("user-"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(v)), 256), 1, 16), F.lit("@example.invalid"))


PSEUDONYMS: dict[str, Callable[[Column, str, bool], Column]] = {"email": _email, "iban": _iban, "card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date}


def valid(kind: str, v: Column) -> Column:
    if kind == "card":
        return let(_digits(v), lambda d: F.length(d).between(13, 19) & (luhn(d) % 10 == 0))
    if kind == "iban":
        return let(F.replace(v, F.lit(" "), F.lit("")), lambda p: F.length(p).between(15, 34) & (mod97(p) == 1))
    if kind == "ssn":
        return ~v.rlike("^(000|666|9)|^...-00|-0000$")
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda x: (x.cast("int") < 256) & ((F.length(x) == 1) | ~x.startswith("0")))
    if kind == "date":
        return F.coalesce(_day(v).between(0, DAYS - 1), F.lit(False))
    return F.lit(True)


def _entities(docs: DataFrame) -> DataFrame:
    """docs as one struct beside the text and its entities."""
    text = text_or_empty()
    found = wrapped(docs, "text").withColumns({f"m_{k}": matches(text, p) for k, p in PATTERNS.items()})
    placed = found.withColumns({f"s_{k}": located(text, F.col(f"m_{k}"), p) for k, p in PATTERNS.items()})

    def tagged(i: int, kind: str) -> Column:
        entity = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg_end"), F.lit(i).alias("kind"), s["value"].alias("value"))
        return F.when(F.size(f"s_{kind}") > 0, F.transform(F.filter(f"s_{kind}", lambda s: valid(kind, s["value"])), entity)).otherwise(
            F.array().cast("array<struct<start:int,neg_end:int,kind:int,value:string>>")
        )

    every = F.array_sort(F.concat(*[tagged(i, k) for i, k in enumerate(KINDS)]))
    kind = "array<struct<start:int,end:int,kind:int,value:string>>"
    kept = F.aggregate(
        every,
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda s, e: F.when(
            e["start"] >= s["at"],
            F.struct((-e["neg_end"]).alias("at"), F.array_append(s["out"], F.struct(e["start"].alias("start"), (-e["neg_end"]).alias("end"), e["kind"].alias("kind"), e["value"].alias("value"))).alias("out")),
        ).otherwise(s),
        lambda s: s["out"],
    )
    return placed.select("row", "text", kept.alias("entities"))


def find(docs: DataFrame) -> DataFrame:
    """docs and `entities`: array of (start, end, kind as a number into KINDS, value), valid, in order, without overlaps."""
    return unwrapped(_entities(docs), docs.columns, {"entities": F.col("entities")})


def pseudonym(kind: Column, value: Column, key: str, undo: bool = False) -> Column:
    out = value
    for i, k in enumerate(KINDS):
        out = F.when(kind == i, PSEUDONYMS[k](value, key, undo)).otherwise(out)
    return out


def mask(docs: DataFrame, key: str) -> DataFrame:
    """docs with entities (as of find) and masked_text, in which each entity is its pseudonym."""
    text = text_or_empty()
    found = _entities(docs)

    def joined(x: Column) -> Column:
        """Pieces of the text between the entities, and the pseudonyms between the pieces."""
        n = F.size(x["entities"])
        end = lambda i: F.when(i > 0, F.get(x["entities"], i - 1)["end"]).otherwise(0)
        piece = lambda i: let(end(i), lambda at: F.substring(text, at + 1, F.when(i < n, F.get(x["entities"], i)["start"]).otherwise(F.length(text)) - at))
        return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(piece(i), F.coalesce(F.get(x["new"], i), F.lit("")))), "")

    # bound together: a column named in a lambda may be evaluated for each of its elements
    parts = F.struct("entities", F.transform("entities", lambda e: pseudonym(e["kind"], e["value"], key)).alias("new"))
    masked = F.when(F.size("entities") > 0, let(parts, joined)).otherwise(text)
    return unwrapped(found, docs.columns, {"entities": F.col("entities"), "masked_text": masked})
