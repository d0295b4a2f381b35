import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from mosaiq.llm import pii
from mosaiq.llm.queries import PII_KEY, op2_pii


def luhn_ok(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        s += n - 9 if n > 9 else n
    return s % 10 == 0


def iban_ok(v):
    p = v.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in p[4:] + p[:4])) % 97 == 1


def card(rng, n=16):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn_ok(body + c))


def test_feistel_permutes(spark):
    df = spark.range(97 * 11).withColumn("x", pii.feistel(F.col("id"), 97, 11, "k", "t"))
    df = df.withColumn("back", pii.feistel(F.col("x"), 97, 11, "k", "t", undo=True))
    r = df.agg(F.count_distinct("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_if(F.col("back") != F.col("id")).alias("bad")).first()
    assert (r.n, r.lo, r.hi, r.bad) == (97 * 11, 0, 97 * 11 - 1, 0)


def test_formats_links_and_undo(spark):
    rng = random.Random(1)
    values = [("card", card(rng, n)) for n in (13, 14, 15, 16, 17, 18, 19)]
    c = card(rng)
    values += [("card", f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}"), ("phone", "+1 (017) 555-7713"), ("phone", "212-555-0199"), ("ssn", "123-45-6789"), ("ssn", "899-99-9999"), ("ip", "97.51.17.173"), ("ip", "0.0.0.0"), ("date", "1987-02-28"), ("date", "1900-01-01"), ("date", "2099-08-04"), ("date", "2099-12-31"), ("date", "2099-08-05"), ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"), ("iban", "FR1420041010050500013M02606")]
    df = spark.createDataFrame([(pii.KINDS.index(k), v) for k, v in values], "kind int, v string")
    out = df.withColumn("p", pii.pseudonym(F.col("kind"), F.col("v"), "key")).withColumn("back", pii.pseudonym(F.col("kind"), F.col("p"), "key", undo=True))
    out = out.withColumn("other", pii.pseudonym(F.col("kind"), F.col("v"), "key2")).collect()
    for r in out:
        kind = pii.KINDS[r.kind]
        assert r.back == r.v and r.p != r.v and r.other != r.p
        if kind != "ip":
            assert [c.isdigit() for c in r.p] == [c.isdigit() for c in r.v]
        if kind == "card":
            assert luhn_ok("".join(c for c in r.p if c.isdigit()))
        if kind == "iban":
            assert iban_ok(r.p) and r.p[:2] == r.v[:2] and [c for c in r.p if not c.isdigit()] == [c for c in r.v if not c.isdigit()]
        if kind == "date":
            datetime.date.fromisoformat(r.p)
        if kind == "ssn":
            assert r.p[:3] not in ("000", "666") and r.p[0] != "9" and r.p[4:6] != "00" and r.p[7:] != "0000"
        if kind == "ip":
            assert all(0 <= int(x) < 256 for x in r.p.split("."))


def test_numbers_that_begin_alike(spark):
    rng = random.Random(4)
    head = "453201"
    cards = [next(b + c for c in "0123456789" if luhn_ok(b + c)) for b in (head + "".join(rng.choices("0123456789", k=9)) for _ in range(40))]
    out = spark.createDataFrame([(c,) for c in cards], "v string").select(pii.pseudonym(F.lit(pii.KINDS.index("card")), F.col("v"), "key").alias("p")).collect()
    assert len({r.p[:6] for r in out}) > 35 and len({r.p[-5:-1] for r in out}) > 35


def test_every_day_is_permuted(spark):
    """The whole range of dates, in two ways of writing: each pseudonym is a date of the range, written alike, and no two are the same."""
    days = spark.range(pii.DAYS).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    for form, what in (("yyyy-MM-dd", F.lit(True)), ("dd/MM/yyyy", F.dayofmonth("d") > 12)):
        df = days.filter(what).select(F.date_format("d", form).alias("v")).repartition(8).select("v", pii.pseudonym(F.lit(pii.KINDS.index("date")), F.col("v"), "key").alias("p"))
        r = df.agg(F.count("*").alias("n"), F.count_distinct("p").alias("m"), F.count_if(F.try_to_timestamp("p", F.lit(form)).isNull()).alias("bad"), F.min(F.substring("p", -4, 4)).alias("y")).first()
        assert r.n == r.m and r.bad == 0


# --- a plain version of the whole operator ---


def prf(key, kind, i, value, modulus):
    return int(hashlib.sha256(f"{key}|{kind}|{i}|{value}".encode()).hexdigest()[:15], 16) % modulus


def permuted(l, r, a, b, key, kind):
    for i in range(pii.ROUNDS):
        if i % 2:
            r = (r + prf(key, kind, i, l, b)) % b
        else:
            l = (l + prf(key, kind, i, r, a)) % a  # noqa: E741
    return l, r


def number(n, a, b, key, kind):
    l, r = permuted(n // b, n % b, a, b, key, kind)
    return l * b + r


def digits_of(d, key, kind):
    h = -(-len(d) // 2)
    l, r = permuted(int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h), key, kind)
    return f"{l:0{h}d}{r:0{len(d) - h}d}"


def refill(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


FORMS = (("^[0-9]{4}-", "%Y-%m-%d"), ("^(?:0[0-9]|1[0-2])/", "%m/%d/%Y"), ("^[0-9]{2}/", "%d/%m/%Y"), ("^[0-9]", "%d %B %Y"), ("^[A-Z]", "%B %d, %Y"))


def day(v):
    form = next(f for like, f in FORMS if re.search(like, v))
    try:
        return form, (datetime.datetime.strptime(v, form).date() - datetime.date(1900, 1, 1)).days
    except ValueError:
        return form, -1


def plain_valid(kind, v):
    d = "".join(c for c in v if c.isdigit())
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn_ok(d)
    if kind == "iban":
        return 15 <= len(v.replace(" ", "")) <= 34 and iban_ok(v)
    if kind == "ssn":
        return not re.search("^(000|666|9)|^...-00|-0000$", v)
    if kind == "ip":
        return all(int(x) < 256 and (len(x) == 1 or x[0] != "0") for x in v.split("."))
    return kind != "date" or day(v)[1] >= 0


def plain_pseudonym(kind, v, key):
    d = "".join(c for c in v if c.isdigit())
    if kind == "email":
        return "user-" + hashlib.sha256(f"{key}|email|{v.lower()}".encode()).hexdigest()[:16] + "@example.invalid"
    if kind == "card":
        b = digits_of(d[:-1], key, "card")
        return refill(v, next(b + c for c in "0123456789" if luhn_ok(b + c)))
    if kind == "iban":
        new = digits_of(d[2:], key, "iban")
        return next(x for n in range(2, 99) if iban_ok(x := refill(v, f"{n:02d}" + new)))
    if kind == "ssn":
        area = int(d[:3])
        n = number(((area - 1 - (area > 666)) * 99 + int(d[3:5]) - 1) * 9999 + int(d[5:]) - 1, 898 * 99, 9999, key, "ssn")
        place = n // (99 * 9999)
        return refill(v, f"{place + 1 + (place >= 665):03d}{n // 9999 % 99 + 1:02d}{n % 9999 + 1:04d}")
    if kind == "ip":
        n = number(int.from_bytes(bytes(map(int, v.split(".")))), 65536, 65536, key, "ip")
        return ".".join(map(str, n.to_bytes(4)))
    if kind == "date":
        form, n = day(v)
        late = re.search("^(?:1[3-9]|[23][0-9])/", v)
        while True:
            n = number(n, 271, 270, key, "date")
            at = datetime.date(1900, 1, 1) + datetime.timedelta(n)
            if n < pii.DAYS and not (late and at.day <= 12):
                break
        new = at.strftime(form)
        return new if "/" in form or "-" in form else new.replace(" 0", " ").removeprefix("0")
    if v.startswith("+") and len(d) <= 10:
        return refill(v, d[:-7] + f"{number(int(d[-7:]), 10**4, 10**3, key, 'phone-7'):07d}")
    ten = int(d[-10:])
    area, rest = divmod(ten, 10**7)
    if area >= 200 and rest >= 2 * 10**6:
        n = number((area - 200) * 8 * 10**6 + rest - 2 * 10**6, 80000, 80000, key, "phone")
        ten = (n // (8 * 10**6) + 200) * 10**7 + n % (8 * 10**6) + 2 * 10**6
    else:
        n = number(ten if area < 200 else 2 * 10**9 + (area - 200) * 2 * 10**6 + rest, 60000, 60000, key, "phone-other")
        y = n - 2 * 10**9
        ten = n if y < 0 else (y // (2 * 10**6) + 200) * 10**7 + y % (2 * 10**6)
    return refill(v, d[:-10] + f"{ten:010d}")


def plain_mask(text, key):
    found = sorted((m.start(), -m.end(), i, m[0]) for i, k in enumerate(pii.KINDS) for m in re.finditer(pii.PATTERNS[k], text) if plain_valid(k, m[0]))
    kept, at, out = [], 0, ""
    for a, b, i, v in found:
        if a >= at:
            out += text[at:a] + plain_pseudonym(pii.KINDS[i], v, key)
            kept.append((pii.KINDS[i], a, -b))
            at = -b
    return kept, out + text[at:]


def test_query_against_plain_version(spark, sf, tmp_path):
    rng = random.Random(12)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    some = lambda n: "".join(rng.choices("0123456789", k=n))
    makers = [
        lambda: card(rng, rng.randrange(13, 20)), lambda: f"3782 {some(6)} {some(5)}", lambda: f"+1 ({some(3)}) {some(3)}-{some(4)}", lambda: "+" + str(rng.randrange(1, 99)) + some(9), lambda: some(10), lambda: f"{some(3)}-{some(2)}-{some(4)}",
        lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: f"{rng.randrange(1890, 2110)}-{rng.randrange(14):02d}-{rng.randrange(33):02d}", lambda: f"{rng.randrange(32):02d}/{rng.randrange(20):02d}/20{some(2)}",
        lambda: f"{rng.randrange(1, 32)} March 19{some(2)}", lambda: f"December {rng.randrange(1, 32)}, 20{some(2)}", lambda: f"a.{some(3)}@mail-{some(1)}.example.org", lambda: "DE89 3704 0044 0532 0130 00", lambda: "GB82WEST12345698765432", lambda: "DE88370400440532013000",
    ]
    more = [(10_000 + i, "é " + rng.choice([" ", ", ", " or ", "-", ""]).join(rng.choice(makers)() for _ in range(rng.randrange(1, 6)))) for i in range(400)] + [(20_000, None), (20_001, "")]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in op2_pii(spark, f"file://{tmp_path}").collect():
        kept, masked = plain_mask(texts[r.doc_id], PII_KEY)
        assert r.text == masked and r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in kept), (texts[r.doc_id][:300], r.text[:300], masked[:300])
        assert all(r[f"n_{k}"] == sum(x[0] == k for x in kept) for k in pii.KINDS)


def test_mask(spark):
    c = card(random.Random(2))
    bad = c[:-1] + str((int(c[-1]) + 1) % 10)
    text = f"é Mail jo.doe@mail.example.com or JO.DOE@mail.example.com, card {c}, not {bad}, at 1.2.3.4 and 1.2.3.400 on 2001-02-29 or 2001-02-28."
    docs = spark.createDataFrame([(1, text), (2, f"again {c}"), (3, None), (4, ""), (5, "plain")], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.mask(docs, "key").collect()}
    kinds = [pii.KINDS[e.kind] for e in out[1].entities]
    assert kinds == ["email", "email", "card", "ip", "date"]
    assert all(text[e.start : e.end] == e.value for e in out[1].entities)
    masked = out[1].masked_text
    assert c not in masked and bad in masked and "jo.doe" not in masked.lower() and "1.2.3.400" in masked and "2001-02-29" in masked
    assert masked.count("@example.invalid") == 2 and len(set(w for w in masked.replace(",", "").split() if w.endswith(".invalid"))) == 1
    new = next(w.strip(",") for w in masked.split("card ")[1].split())
    assert out[2].masked_text == f"again {new}"
    assert [out[i].masked_text for i in (3, 4, 5)] == ["", "", "plain"]


def test_other_formats(spark):
    values = {
        "phone": ["4155552671", "+14155552671", "+1 415 555 2671", "(415)555-2671", "415 555 2671", "+44 20 7946 0958", "+372 512 3456"],
        "card": ["3782 822463 10005", "3782-822463-10005"],
        "date": ["25/12/1987", "12/25/1987", "31/01/2024", "25 December 1987", "December 5, 1987"],
    }
    rows = [(f"{k}{i}", k, v, f"it is {v}, or so") for k, vs in values.items() for i, v in enumerate(vs)]
    df = pii.mask(spark.createDataFrame(rows, "id string, name string, v string, text string"), "key")
    df = df.withColumn("new", F.expr("substring(masked_text, 7, length(masked_text) - 13)"))
    again = pii.find(df.select("id", F.col("masked_text").alias("text"))).select("id", F.col("entities").alias("again"))
    df = df.join(again, "id").withColumn("back", F.transform("again", lambda e: pii.pseudonym(e["kind"], e["value"], "key", undo=True)))
    out = {r.v: r for r in df.collect()}
    assert len(out) == len(rows)
    for r in out.values():
        assert [(pii.KINDS[e.kind], e.value) for e in r.entities] == [(r.name, r.v)], r
        assert r.new != r.v and [(pii.KINDS[e.kind], e.value) for e in r.again] == [(r.name, r.new)] and r.back == [r.v], r
    digits = {"".join(c for c in out[v].new if c.isdigit())[-10:] for v in values["phone"][:5]}
    assert len(digits) == 1
    bad = ["1700000000", "3782 822463 10006", "31/02/2024", "00/10/2000", "31 February 2024"]
    left = pii.mask(spark.createDataFrame([(v,) for v in bad], "text string"), "key").collect()
    assert all(r.masked_text == r.text for r in left), left


def test_empty_and_clashing(spark, none, clash, odd):
    assert pii.mask(none, "k").count() == 0
    out = pii.mask(clash, "k")
    assert out.count() == clash.count() and dict(out.dtypes)["entities"].startswith("array")
    assert out.filter("masked_text <> coalesce(text, '')").count() == 0
    names = ["row", "m_card", "s_card", "_new", "new", "_m_ip"]
    kept = pii.mask(spark.createDataFrame([(1, "on 2001-02-28", *names)], ["doc_id", "text", *names]), "k").first()
    assert all(kept[n] == n for n in names) and len(kept.entities) == 1
