import hashlib
import random
from itertools import groupby

import pytest

from mosaiq.llm import chat
from mosaiq.llm.template import Const, Output, TemplateError, Text, compiled, fold, parse


def render(source, **context):
    return "".join(x for x in compiled(source)(context) if isinstance(x, str))


def test_language():
    assert render("{{ 'a' ~ 1 }}{{ 1 + 2 }}|{{ x.y | upper }}|{{ x.z }}", x={"y": "q"}).split("|")[1:] == ["Q", ""]
    assert render("{% for m in ms %}{{ loop.index }}{{ m }}{% if not loop.last %}, {% endif %}{% endfor %}", ms=["a", "b"]) == "1a, 2b"
    assert render("{% if a and b or c %}1{% elif d == 'x' %}2{% else %}3{% endif %}", a=1, b=0, c=0, d="x") == "2"
    assert render("{% set n = 'v' %}{{ n if n != 'w' else 'no' }}{# gone #}") == "v"
    assert render("a \n{%- if true -%}\n b {% endif %}") == "ab "
    assert render("{{ 'don\\'t' }}{{ \"\\n\" }}") == "don't\n"


def test_sandbox():
    for source in ("{{ x.__class__ }}", "{{ x._a }}", "{{ open('f') }}", "{{ x | eval }}", "{% import os %}", "{% for %}{% endfor %}", "{% if x %}", "{{ }}", "{% endif %}"):
        with pytest.raises(TemplateError):
            compiled(source)
    assert render("{{ x.real }}", x=3) == ""  # attributes are keys of records only


def test_constant_folding():
    assert fold(parse("a{{ 'b' ~ 'c' }}{% if 1 < 2 %}d{% else %}e{% endif %}{% if false %}f{% endif %}")) == [Text("abcd")]
    assert fold(parse("{{ x or 'y' }}")) != [Text("y")] and fold(parse("{{ 'y' or x }}")) == [Text("y")]
    assert fold(parse("{{ 'q' if 2 in x else 'r' }}"))[0].__class__ is Output and fold(Const(1)) == Const(1)


def test_escape_is_reversible_and_hides_controls():
    rng = random.Random(1)
    parts = [*chat.CONTROL, "<", "|", "\\", "a", "[", "/INST]", "s>", "\n", "|>", "end"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        out = chat.escape(text)
        assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)
        assert list(chat.turns(f"<|turn|>{out}<|body|>{out}<|end|>\n" * 2)) == [(text, text)] * 2


def digests(rows):
    key = lambda x: (x[0] is not None, x[0] or 0)
    rows = sorted(rows, key=lambda r: (*key(r), r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    out = {}
    for c, own in groupby(rows, key=lambda r: r[0]):
        own = [(r or "", t or "") for _, _, r, t in own]
        said = "".join(t for r, t in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def found(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_conversations(df)).collect()}


def test_query(spark, sf):
    from mosaiq.llm.queries import op5_chat

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op5_chat(spark, sf).collect()} == digests(rows)


def test_odd_rows(spark, monkeypatch):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "tie"), (2, 0, None, "x\r\n\x00"), (2, None, "user\nx", "<|end|>\n<|turn|>"), (None, 0, "assistant", "lost \\")]
    rows += [(3, i, "assistant" if i % 2 else "user", "long " * 30_000) for i in range(40)] + [(4, 0, "user", "same")] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(df.selectExpr("*", "1 AS part", "'x' AS loss")) == digests(rows)
    parts = chat.format_conversations(df).filter("conv_id = 3").collect()
    # parts that were stored and come back in any order
    mixed = chat.format_conversations(df).repartition(7, "part")
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(mixed).collect()} == digests(rows)
    assert len(parts) > 3 and max(len(p.text) for p in parts) < 2 * chat.PART
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
