"""Secret scans: fixed patterns, and a battery of randomness tests for tokens that no pattern names.

Base kinds: assign (a value given to a password-like name), access (access-key ids), hex (long lower-case hex
runs). The battery takes runs of 20 or more key-like characters, infers the encoding of each from the characters it
uses, and measures three things: the chi-squared statistic of its symbols against a uniform alphabet, the runs of
characters of one class (lower case, capitals, digits, others; vowels and others where there is one class), and the
serial correlation of its symbols. A random token is uniform, changes class as often as chance has it, and doesn't
correlate. A token that is no secret is taken to be structured at least as much as set in ENCODINGS; its p-value is
the chance that a token so structured comes out as random as it does, from the three together. It falls with the
length, and short tokens, which chance may make look random, don't get small ones. A token whose uniformity, runs or
correlation is out of what randomness gives is structured whatever the rest.

Which p-values are small enough is decided over the whole corpus: the Benjamini-Hochberg procedure on the counts of
p-values by steps keeps the share of structured tokens among the reported ones below `level`. Those are reported as
kind random.

All of it is DataFrame functions, row by row but for one aggregate of a fixed number of counts: no shuffle of texts,
no Python.

Defined cases: null text counts as empty and has no spans; texts of any length are read whole; equal rows give
equal results; an empty table gives an empty one; `scan` passes extra columns on, and its results replace
columns of the same names; `redact` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import text_or_empty, unwrapped, wrapped
from mosaiq.llm.spans import SPAN, let, located, matches

#: The patterns of the base kinds. Failing matches are dropped after matching, but for hex, whose
#: maximal runs are the same either way.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"


@dataclass(frozen=True)
class Encoding:
    """like: what a token of it looks like. excess: by how much at least a structured token's sum of squared shares of
    symbols, times the size of the alphabet, is above 1. mixed: it has several classes of characters; where it has
    one, words change between vowels and others as often as chance does, and only uniformity tells them apart."""

    name: str
    like: str
    alphabet: str
    excess: float
    mixed: bool = True


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: The first that fits. Case is one case where a token has but one.
ENCODINGS = (
    Encoding("hex", "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$|^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "0123456789abcdef", 0.7),
    Encoding("base32", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _LOWER + "234567", 0.8),
    Encoding("base36", "^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$|^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", _DIGITS + _LOWER, 0.8),
    Encoding("base26", "^[a-z]+$|^[A-Z]+$", _LOWER, 0.4, mixed=False),
    Encoding("base52", "^(?=.*[A-Z])(?=.*[a-z])[A-Za-z]+$", _UPPER + _LOWER, 1.0),
    Encoding("base62", "^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS, 1.0),
    Encoding("base64", "^(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_-]+$", _UPPER + _LOWER + _DIGITS + "+/", 1.0),
)


@dataclass(frozen=True)
class Battery:
    """level: share of structured tokens among the reported ones. change: how often at most neighbours in a structured
    token are of different classes, as a share of what chance would have. correlation: of the neighbours of a
    structured token at least. random: a token that is random by none of the tests at this level is structured."""

    level: float = 0.05
    change: float = 0.65
    correlation: float = 0.25
    random: float = 0.002


def normal_tail(z: Column) -> Column:
    """P(Z > z), by a logistic approximation good to about 1e-4."""
    return let(F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0)), lambda x: 1 / (1 + F.exp(1.5976 * x + 0.070566 * x * x * x)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _pairs(values: Column, f: Callable[[Column, Column], Column]) -> Column:
    """The sum of f over neighbours."""
    return _sum(F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values)), f))


def chi_squared(codes: Column, k: Column) -> Column:
    n = F.size(codes).cast("double")
    squares = _sum(F.transform(F.array_distinct(codes), lambda x: F.pow(F.size(F.filter(codes, lambda y: y == x)).cast("double"), F.lit(2.0))))
    return F.greatest(k / n * squares - n, F.lit(0.0))


def uniformity(chi2: Column, n: Column, k: Column, excess: Column) -> Column:
    """struct(random, structured): z of the statistic in a random token (Wilson and Hilferty), and in a structured one
    (normal, the statistic's mean and variance shifted by the excess; the sign turned, so that random tokens are high)."""
    of = lambda c: F.struct(
        ((F.pow(c / (k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))).alias("random"),
        ((k - 1 + n * excess - c) / F.sqrt(2 * (k - 1 + 2 * n * excess))).alias("structured"),
    )
    return let(chi2, of)


def runs(classes: Column, change: float) -> Column:
    """struct(random, structured) of the number of neighbours of different classes."""
    n = F.size(classes).cast("double")
    many = F.transform(F.array_distinct(classes), lambda x: F.size(F.filter(classes, lambda y: y == x)).cast("double"))

    def of(x: Column) -> Column:
        z = lambda mean: (x["seen"] - mean) / F.sqrt(F.greatest(mean * (1 - mean / n), F.lit(1e-9)))
        return F.struct(z(x["expected"]).alias("random"), z(change * x["expected"]).alias("structured"))

    # changes among n symbols in random order, given how many are of each class
    expected = let(many, lambda m: n - _sum(F.transform(m, lambda x: x * x)) / n)
    return let(F.struct(_pairs(classes, lambda a, b: (a != b).cast("double")).alias("seen"), expected.alias("expected")), of)


def correlation(codes: Column, least: float) -> Column:
    """struct(random, structured) of the correlation of neighbours."""

    def of(off: Column) -> Column:
        joint = _pairs(off, lambda a, b: a * b)
        root = F.sqrt(F.size(off).cast("double"))
        z = lambda square: let(F.when(square > 0, joint / square).otherwise(1.0), lambda r: F.struct((r * root).alias("random"), ((least - F.abs(r)) * root).alias("structured")))
        return let(_sum(F.transform(off, lambda x: x * x)), z)

    return let(_sum(codes) / F.size(codes), lambda centre: let(F.transform(codes, lambda x: x - centre), of))


def _classes(token: Column) -> Column:
    """The class of each character; of letters of one case alone, vowels and others."""
    one = token.rlike("^(?:[a-z]+|[A-Z]+)$")
    plain = F.when(one, F.translate(F.lower(token), "aeiou" + "bcdfghjklmnpqrstvwxyz", "a" * 5 + "0" * 21)).otherwise(
        F.translate(token, _LOWER + _UPPER + _DIGITS + "+/_-", "a" * 26 + "A" * 26 + "0" * 10 + "-" * 4)
    )
    return F.filter(F.split(plain, ""), lambda c: c != "")


def _encoded(token: Column) -> Column:
    """struct of the encoding that fits a token: its parameters, and the token with one character for each symbol; null
    where none fits."""
    out = F.when(F.lit(False), F.lit(None))
    for e in ENCODINGS:
        plain = F.translate(token, "-_", "+/") if "/" in e.alphabet else token if "A" in e.alphabet else F.lower(token)
        fields = {"plain": plain, "alphabet": F.lit(e.alphabet), "k": F.lit(float(len(e.alphabet))), "excess": F.lit(e.excess), "mixed": F.lit(e.mixed)}
        out = out.when(token.rlike(e.like), F.struct(*[v.alias(n) for n, v in fields.items()]))
    return out


def _tested(token: Column, battery: Battery) -> Column:
    """A token's p-value as a structured one; null where no encoding fits it."""

    def of(e: Column) -> Column:
        codes = F.transform(F.filter(F.split(e["plain"], ""), lambda c: c != ""), lambda c: (F.position(c, e["alphabet"]) - 1).cast("double"))
        stats = lambda c: F.struct(
            uniformity(chi_squared(c, e["k"]), F.size(c).cast("double"), e["k"], e["excess"]).alias("uniform"), runs(_classes(token), battery.change).alias("runs"), correlation(c, battery.correlation).alias("serial")
        )

        def together(t: Column) -> Column:
            # uniform counts on one side: too even a token is no structured one
            out = [normal_tail(t["uniform"]["random"]), 2 * normal_tail(F.abs(t["runs"]["random"])), 2 * normal_tail(F.abs(t["serial"]["random"]))]
            every = (t["uniform"]["structured"] + t["runs"]["structured"] + t["serial"]["structured"]) / F.lit(3**0.5)
            return F.when(F.least(*out) < battery.random, F.lit(1.0)).otherwise(normal_tail(F.when(e["mixed"], every).otherwise(t["uniform"]["structured"])))

        return F.when(e.isNotNull(), let(codes, lambda c: let(stats(c), together)))

    return let(_encoded(token), of)


def tested(spans: Column, battery: Battery = Battery()) -> Column:
    """Those of the spans (SPAN) that some encoding fits, with their p-values."""
    return F.filter(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _tested(s["value"], battery).alias("p"))),
        lambda s: s["p"].isNotNull(),
    )


def _tokens(text: Column, battery: Battery) -> Column:
    """The tested tokens of a text, with their places."""

    def of(found: Column) -> Column:
        fresh = F.filter(located(text, found, TOKEN), lambda s: ~s["value"].rlike("^[0-9a-f]{32,}$"))
        return F.when(F.size(found) > 0, tested(fresh, battery))

    return F.coalesce(let(matches(text, TOKEN), of), F.array().cast("array<struct<start:int,end:int,value:string,p:double>>"))


#: p-values are counted by steps: 1, 1/2, 1/4, and so on.
STEPS = 40


def limit(docs: DataFrame, battery: Battery = Battery(), text: str = "text") -> float:
    """The greatest step at or below which p-values are reported: that at which level times the reported tokens is at
    least what structured ones would give there, the step times all tokens. -1 if there is none.

    The driver gets one row of STEPS counts, whatever the input."""
    values = F.transform(_tokens(text_or_empty(text), battery), lambda s: s["p"])
    each = docs.select(F.explode(values).alias("p"))
    row = each.agg(F.count("*").alias("m"), *[F.count_if(F.col("p") <= 2.0**-i).alias(f"n{i}") for i in range(STEPS)]).first()
    return next((2.0**-i for i in range(STEPS) if row[f"n{i}"] and 2.0**-i * row["m"] <= battery.level * row[f"n{i}"]), -1.0)


SPANS = ("assign_spans", "access_spans", "hex_spans", "random_spans")


def _scanned(docs: DataFrame, battery: Battery) -> tuple[DataFrame, dict[str, Column]]:
    """docs as one struct beside working columns, and the results over these."""
    most = limit(docs.select("text"), battery)
    text = text_or_empty()
    found = wrapped(docs, "text").withColumns({"assign": matches(text, ASSIGN), "access": matches(text, ACCESS), "hex": matches(text, HEX), "tokens": _tokens(text, battery)})
    # group 2 of each assignment decides; extracted only where there is one
    values = F.when(F.size("assign") > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)))
    placed = found.withColumns({"assign_at": located(text, F.col("assign"), ASSIGN), "values": values, "access_at": located(text, F.col("access"), ACCESS), "hex_at": located(text, F.col("hex"), HEX)})
    assign = F.when(F.size("assign") > 0, F.filter("assign_at", lambda s, i: F.length(F.get(F.col("values"), i)) >= 8)).otherwise(F.array().cast(SPAN))
    random = F.transform(F.filter("tokens", lambda s: s["p"] <= most), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return placed, dict(zip(SPANS, (assign, F.filter("access_at", lambda s: F.length(s["value"]) >= 16), F.col("hex_at"), random), strict=True))


def scan(docs: DataFrame, battery: Battery = Battery()) -> DataFrame:
    """docs (with text) and assign_spans, access_spans, hex_spans, random_spans (start, end, value)."""
    found, results = _scanned(docs, battery)
    return unwrapped(found, docs.columns, results)


KINDS = ("assign", "access", "hex", "random")


def span_list(kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    placed = lambda i: F.transform(f"{kinds[i]}_spans", lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))
    every = F.concat(*map(placed, range(len(kinds))))
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[secret]", battery: Battery = Battery()) -> DataFrame:
    """docs with every span of a secret replaced by the mark (overlapping spans by one); n_chars follows."""
    found, results = _scanned(docs, battery)
    every = F.array_sort(F.concat(*[F.transform(x, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for x in results.values()]))
    text = text_or_empty()
    walked = F.aggregate(
        "every",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    some = F.size("every") > 0
    clean = found.select("row", "text", every.alias("every")).select("row", some.alias("some"), F.when(some, walked).otherwise(F.col("text")).alias("clean"))
    results = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        results["n_chars"] = F.when(F.col("some"), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return unwrapped(clean, docs.columns, results)
