import hashlib
import math
import random
import re
import string
from collections import Counter

from pyspark.sql import functions as F

from mosaiq.llm import secrets
from mosaiq.llm.queries import op8_secret_scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(t):
    t = t or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def samples(rng):
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    key = "AKIA" + "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(16))
    return [
        f'pré 🙂 token = "{hexes}" and {hexes}',
        f"{key} AKIASHORT {key}",
        "Password: hunter2 then PASSWD='correct-horse-battery' api_key=abc.token=secret=abcdefghijk",
        "secret: abc token=secret: abcdefgh12345678",
        "deadbeef" * 8 + "g" + "0" * 31,
    ]


def test_base_spans(spark, odd_texts):
    rng = random.Random(3)
    rows = [(i, t) for i, (_, t) in enumerate(odd_texts)] + [(1000 + i, t) for i, t in enumerate(samples(rng))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.scan(docs).select("doc_id", secrets.span_list(("assign", "access", "hex")).alias("s")).collect()
    assert {r.doc_id: r.s for r in found} == {d: base(t) for d, t in rows}


def tail(z):
    z = min(max(z, -8.0), 8.0)
    return 1 / (1 + math.exp(1.5976 * z + 0.070566 * z**3))


def p_value(t, b=secrets.Battery()):
    """The battery in plain Python."""
    e = next((e for e in secrets.ENCODINGS if re.search(e.like, t)), None)
    if e is None:
        return None
    k, n = len(e.alphabet), len(t)
    plain = t.replace("-", "+").replace("_", "/") if "/" in e.alphabet else t if "A" in e.alphabet else t.lower()
    codes = [float(e.alphabet.index(c)) for c in plain]
    chi2 = max(0.0, k / n * sum(c * c for c in Counter(codes).values()) - n)
    df = k - 1.0
    u = ((chi2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5, (df + n * e.excess - chi2) / math.sqrt(2 * (df + 2 * n * e.excess))
    one = t.isalpha() and (t.islower() or t.isupper())
    kind = lambda c: c.lower() in "aeiou" if one else "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-"
    classes = [kind(c) for c in t]
    seen = sum(x != y for x, y in zip(classes, classes[1:]))
    expected = n - sum(c * c for c in Counter(classes).values()) / n
    sd = lambda x: math.sqrt(max(x * (1 - x / n), 1e-9))
    r = (seen - expected) / sd(expected), (seen - b.change * expected) / sd(b.change * expected)
    off = [c - sum(codes) / n for c in codes]
    square = sum(x * x for x in off)
    corr = sum(x * y for x, y in zip(off, off[1:])) / square if square > 0 else 1.0
    s = corr * math.sqrt(n), (b.correlation - abs(corr)) * math.sqrt(n)
    if min(tail(u[0]), 2 * tail(abs(r[0])), 2 * tail(abs(s[0]))) < b.random:
        return 1.0
    parts = [u[1], r[1], s[1]] if e.mixed else [u[1]]
    return tail(sum(parts) / math.sqrt(len(parts)))


def tokens(t):
    return [(m.start(), m.end(), p) for m in re.finditer(secrets.TOKEN, t or "") if not re.fullmatch("[0-9a-f]{32,}", m[0]) if (p := p_value(m[0])) is not None]


def step(values, level=0.05):
    return next((2.0**-i for i in range(secrets.STEPS) if (n := sum(v <= 2.0**-i for v in values)) and 2.0**-i * len(values) <= level * n), -1.0)


UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
#: Alphabet of random keys, and the length from which 0.8 of them must be found among as many structured tokens.
KEYS = {"hex": ("0123456789ABCDEF", 40), "base32": (UPPER + "234567", 40), "base36": (LOWER + DIGITS, 40), "BASE36": (UPPER + DIGITS, 40), "base52": (UPPER + LOWER, 36), "base62": (UPPER + LOWER + DIGITS, 36), "base64": (UPPER + LOWER + DIGITS + "+/", 36), "base26": (LOWER, 128)}
STEMS = "summer holiday beach report final version internationalization configuration manager handler factory service request response account photo vacation december chapter paragraph document archive storage controller".split()


def structured(rng):
    pick = lambda n: [rng.choice(STEMS) for _ in range(n)]
    camel = "".join(w.capitalize() for w in pick(3))
    return rng.choice([f"IMG{rng.randrange(20000101, 20251231)}{camel}", "/".join([*pick(2), str(rng.randrange(1990, 2030)), camel]), camel + str(rng.randrange(1000)) + camel, "-".join(w.capitalize() for w in pick(4)) + "-v2", "".join(pick(4)), "_".join(pick(3)).upper() + "7", "CHAPTER01CHAPTER02CHAPTER08CHAPTER09"])


def test_query_against_plain_version(spark, sf, tmp_path):
    rng = random.Random(5)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    said = lambda t: f"{rng.choice(STEMS)} é {t} {rng.choice(STEMS)}"
    more = [(10_000 + i, said("".join(rng.choices(a, k=n + rng.randrange(-12, 30))))) for i, (a, n) in enumerate(list(KEYS.values()) * 12)]
    more += [(20_000 + i, said(structured(rng)) + " " + said(structured(rng))) for i in range(150)] + [(30_000, None), (30_001, "")]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {d: tokens(t) for d, t in texts.items()}
    most = step([p for own in found.values() for _, _, p in own])
    assert most > 0
    for r in op8_secret_scan(spark, f"file://{tmp_path}").collect():
        spans = [tuple(x.split(":")) for x in base(texts[r.doc_id]).split(",") if x]
        random_ = [("random", str(a), str(b)) for a, b, p in found[r.doc_id] if p <= most]
        every = sorted([*spans, *random_], key=lambda x: (int(x[1]), secrets.KINDS.index(x[0])))
        assert r.spans == ",".join(":".join(x) for x in every)
        assert r.base_sha256 == hashlib.sha256(base(texts[r.doc_id]).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex, r.n_random) == tuple(sum(x[0] == k for x in every) for k in secrets.KINDS)


def test_precision_and_recall(spark):
    """For each encoding at its length, and twice it, among as many structured tokens."""
    rng = random.Random(23)
    rows = [(f"{name} {f * n}", "".join(rng.choices(a, k=f * n))) for name, (a, n) in KEYS.items() for f in (1, 2) for _ in range(60)]
    rows += [("structured", structured(rng)) for _ in range(len(rows))]
    docs = spark.createDataFrame([(i, f"see {t} here") for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    hits = Counter(rows[r.doc_id][0] for r in secrets.scan(docs).filter(F.size("random_spans") > 0).select("doc_id").collect())
    for name in {k for k, _ in rows} - {"structured"}:
        assert hits[name] >= (0.8 if name.endswith(str(KEYS[name.split()[0]][1])) else 0.95) * 60, (name, hits)
    assert hits["structured"] <= 0.05 * sum(hits.values())


def test_keys_beside_many_structured_tokens(spark):
    rng = random.Random(17)
    keys = ["".join(rng.choices(KEYS["base64"][0], k=n)) for n in [64] * 10 + [200] * 10 + [1600] * 10]
    rows = [(i, " ".join([*(structured(rng) for _ in range(25)), k, *(structured(rng) for _ in range(25))])) for i, k in enumerate(keys)]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "random_spans.value").collect()
    hits = {r.doc_id: r.value for r in found}
    assert sum(k in hits[i] for i, k in enumerate(keys)) >= 27
    assert sum(map(len, hits.values())) <= 33


def test_statistics_of_random_tokens(spark):
    """z of random tokens is near standard normal, and high under the structured alternative."""
    rng = random.Random(11)
    df = spark.createDataFrame([([float(rng.randrange(16)) for _ in range(64)],) for _ in range(2000)], "codes array<double>")
    c = F.col("codes")
    halves = F.transform(c, lambda x: x >= 8)
    for z in (secrets.uniformity(secrets.chi_squared(c, F.lit(16.0)), F.size(c).cast("double"), F.lit(16.0), F.lit(0.7)), secrets.runs(halves, 0.65), secrets.correlation(c, 0.25)):
        row = df.select(z.alias("z")).select(F.avg((F.col("z.random") > 1.645).cast("double")).alias("high"), F.stddev("z.random").alias("sd"), F.avg("z.structured").alias("far")).first()
        assert 0.02 < row.high < 0.08 and 0.8 < row.sd < 1.2 and row.far > 1


def test_redact(spark):
    text = samples(random.Random(3))[0]
    docs = spark.createDataFrame([(1, text, len(text)), (2, "plain", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert out[1].text == "pré 🙂 [secret]\" and [secret]" and out[1].n_chars == len(out[1].text)
    assert out[2].text == "plain" and out[3].text is None


def test_empty_and_clashing(spark, none, clash):
    assert secrets.scan(none).count() == 0 and secrets.redact(none).count() == 0
    assert secrets.scan(clash).count() == clash.count()
    assert secrets.redact(clash).columns == clash.columns
    names = ["hex_spans", "_hex", "hex", "tokens", "row", "every", "some", "clean", "values", "assign_at"]
    docs = spark.createDataFrame([(1, samples(random.Random(3))[0], *names), (2, None, *names)], ["doc_id", "text", *names])
    out = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert secrets.redact(docs).columns == docs.columns and all(r[n] == n for r in out.values() for n in names)
    assert out[1].text == "pré 🙂 [secret]\" and [secret]" and out[2].text is None
