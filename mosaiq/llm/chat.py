"""Chat formatting with compiled templates.

Rows of a conversation meet in one task by a shuffle on the conversation's id and are rendered in the order of
turns as a stream: no conversation is held whole, the output comes in parts of bounded length, each ending with a
turn. Control strings inside texts are escaped reversibly, so the marks of turns can't be forged, and read_back
recovers the turns from the output alone.

Defined cases: null or empty texts are empty turns; null roles are empty; turns of one number are ordered by role
and text, null turns come first; repeated rows are repeated turns; a null id is a conversation of its own; texts
of any length are kept whole; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.template import GENERATION_START, Marker, compiled

#: What no text may contain as it is, from this and other templates.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
TEMPLATE = (
    "{% for m in messages %}<|turn|>{{ m.role | escape }}<|body|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|end|>\n{% endfor %}"
)
#: Characters after which a part ends with its turn.
PART = 1 << 20

_TO_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """A backslash before every backslash and after the first character of every control string."""
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


PARTS = "conv_id long, part long, text string, loss array<struct<start:long,end:long>>"


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Of rows (conv_id, turn, role, text): the formatted conversations in parts, whose order is that of `part`;
    loss: the code points of the part that the template generates. A conversation's parts follow each other in
    one partition."""
    ordered = (
        rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template, {"escape": escape})
        every = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
        out: list[tuple] = []
        size = 0
        for conv, own in groupby(every, key=lambda x: x[0]):
            for part, (text, loss) in enumerate(_parts(render, ({"role": r, "text": t} for _, r, t in own))):
                out.append((conv, part, text, loss))
                size += len(text)
                if size >= PART:
                    yield _batch(out, kind)
                    out, size = [], 0
        if out:
            yield _batch(out, kind)

    return ordered.mapInArrow(run, PARTS)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    conv, part, text, loss = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(conv, pa.int64()), pa.array(part, pa.int64()), pa.array(text, pa.string()), pa.array(loss, kind)], ["conv_id", "part", "text", "loss"]
    )


def _parts(render, messages: Iterable[dict]) -> Iterator[tuple[str, list[dict]]]:
    held: list[str] = []
    loss: list[dict] = []
    at = start = 0
    for piece in render({"messages": messages}):
        if isinstance(piece, Marker):
            if piece is GENERATION_START:
                start = at
            else:
                loss.append({"start": start, "end": at})
            continue
        held.append(piece)
        at += len(piece)
        if at >= PART and piece.endswith(END + "\n"):
            yield "".join(held), loss
            held, loss, at = [], [], 0
    if held:
        yield "".join(held), loss


_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END) + "\n", re.S)


def turns(part: str) -> Iterator[tuple[str, str]]:
    """role and text of each turn of a part in the standard template."""
    at = 0
    for m in _TURN.finditer(part):
        if m.start() != at:
            raise ValueError("the formatted text isn't a sequence of turns")
        at = m.end()
        yield unescape(m[1]), unescape(m[2])
    if at != len(part):
        raise ValueError("the formatted text doesn't end with a turn")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(parts: DataFrame, in_order: bool = False) -> DataFrame:
    """Digests of each conversation, recovered from the output of format_conversations alone. in_order: the parts are
    still where format_conversations put them, and needn't be brought together and sorted."""
    if not in_order:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (x for b in batches for x in zip(*[c.to_pylist() for c in b.columns], strict=True))
        rows = []
        for conv, own in groupby(every, key=lambda x: x[0]):
            n = lost = chars = 0
            digest, loss_digest = hashlib.sha256(), hashlib.sha256()
            for _, _, text, loss in own:
                chars += len(text)
                for role, said in turns(text):
                    n += 1
                    digest.update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    lost += len(said)
                    loss_digest.update(said.encode())
            rows.append((conv, n, digest.hexdigest(), lost, loss_digest.hexdigest(), chars))
            if len(rows) >= 10_000:
                yield _digests(rows)
                rows = []
        if rows:
            yield _digests(rows)

    return parts.mapInArrow(run, DIGESTS)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in DIGESTS.split(", ")])
