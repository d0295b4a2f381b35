"""Line-first quality rules.

Every line is judged by rules on punctuation, navigation and boilerplate; failing lines are removed; a
document that loses more than half of its words with them, or that fails the base rules, is rejected.

Defined cases: null text counts as empty; an empty text has no words and so fails the base rules; any text is
read whole; equal rows get equal verdicts; an empty table gives an empty table; extra columns are passed on,
but for `judge` where their names are those of its results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import WS, slices

SYMBOLS = "#*$%&|<>"
#: Ends of a sentence or clause, in several scripts; phrases of page furniture in English, German, French and
#: Spanish; calls to the reader; entries of menus. Running text has the phrases and calls, too, so how much of a line they
#: make up decides.
TERMINAL = ".!?…:;,\"'”’»)]}。！？：；，、」』）।॥؟۔"
STOPS = ".!?…。！？।॥؟۔"
BOILERPLATE = (
    "all rights reserved|privacy policy|terms of (?:use|service)|cookie policy|accept (?:all )?cookies|we use cookies|enable javascript|lorem ipsum|subscribe to our|powered by|"
    "alle rechte vorbehalten|datenschutzerkl(?:ä|Ä|ae)rung|nutzungsbedingungen|cookies akzeptieren|wir verwenden cookies|javascript aktivieren|newsletter abonnieren|"
    "tous droits r[eéÉ]serv[eéÉ]s|politique de confidentialit[eéÉ]|conditions d.utilisation|accepter les cookies|nous utilisons des cookies|activer javascript|mentions l[eéÉ]gales|"
    "todos los derechos reservados|pol[iíÍ]tica de (?:privacidad|cookies)|t[eéÉ]rminos de uso|aceptar (?:las )?cookies|(?:usamos|utilizamos) cookies|activar javascript|aviso legal"
)
CALLS = (
    "click here|sign (?:in|up)|log ?in|subscribe now|share this|read more|skip to (?:main )?content|back to top|"
    "hier klicken|finden sie hier|jetzt anmelden|einloggen|registrieren|artikel teilen|weiterlesen|zum inhalt springen|nach oben|"
    "cliquez ici|se connecter|s.inscrire|partager|lire la suite|aller au contenu|haut de page|"
    "haga clic aqu[iíÍ]|iniciar sesi[oóÓ]n|reg[iíÍ]strate|compartir|leer m[aáÁ]s|saltar al contenido|volver arriba"
)
NAVIGATION = (
    "^(?:home|menu|search|next|previous|contact us|about us|sitemap|startseite|suche|weiter|kontakt|impressum|accueil|rechercher|suivant|contactez-nous|"
    "inicio|buscar|siguiente|anterior|contacto)$"
)
#: Phrases as whole words, for engines without look-around: a word's end is one of ASCII letters, or the accented letter that
#: a phrase ends with.
PHRASES = f"\\b(?:(?:{BOILERPLATE}|{CALLS})\\b|haga clic aqu[íÍ]|politique de confidentialit[éÉ])"
#: Marks between entries of a menu stand between blanks; a closing quotation mark is none where there is an opening one.
SEPARATORS = "(?:^|[\\x20\\x09])[›→•·»](?:[\\x20\\x09]|$)"


@dataclass(frozen=True)
class LineRules:
    """short_line: lines of fewer words need an end of sentence. symbols_per_word: at least so many symbols a word
    make a line junk. boilerplate_words: a line of at most so many words is furniture if it has two phrases, or one that is
    half of its words, or if it has two separators and no stop at its end; call_words: a line of at most so many words
    without a stop at its end if it has a phrase at all. most_lost: the share of words that a document may lose with its
    failing lines."""

    short_line: int = 5
    symbols_per_word: float = 0.3
    boilerplate_words: int = 30
    call_words: int = 8
    most_lost: float = 0.5
    min_words: int = 50
    most_repeated: float = 0.5


_PHRASE = re.compile(PHRASES, re.IGNORECASE | re.ASCII)
_NAV = re.compile(NAVIGATION, re.IGNORECASE | re.ASCII)
_SEPARATOR = re.compile(SEPARATORS)
_SYMBOL = re.compile("[" + re.escape(SYMBOLS) + "]")


def line_fails(line: str, rules: LineRules = LineRules()) -> bool:
    """Whether a line that has words fails one of the rules."""
    bare = line.strip(WS)
    words = len(bare.encode().split())
    if bare[-1] not in TERMINAL and words < rules.short_line:
        return True
    if "|" in bare or _SYMBOL.search(bare):
        if len(_SYMBOL.findall(bare)) >= rules.symbols_per_word * words:
            return True
    if words > rules.boilerplate_words:
        return False
    stopped = bare[-1] in STOPS
    if _NAV.search(bare) or (not stopped and "«" not in bare and len(_SEPARATOR.findall(bare)) > 1):
        return True
    found = _PHRASE.findall(bare)
    return len(found) > 1 or (bool(found) and (2 * len(found[0].split()) >= words or (words <= rules.call_words and not stopped)))


def clean(text: str, rules: LineRules = LineRules()) -> tuple[str, int]:
    """The text without failing lines (later copies of a line of the text fail, too), and how many words went."""
    kept, lost, seen = [], 0, set()
    for line in text.split("\n"):
        if line.strip(WS):
            if line in seen or line_fails(line, rules):
                lost += len(line.encode().split())
                continue
            seen.add(line)
        kept.append(line)
    return "\n".join(kept), lost


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in three-word windows found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    codes = dict.fromkeys(words)
    if len(codes) == n:
        return 0
    for i, w in enumerate(codes):
        codes[w] = i
    c = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    pairs = c[:-1] * len(codes) + c[1:]
    if len(codes) > 1_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(pairs[:-1] * len(codes) + c[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def measure(text: str, rules: LineRules = LineRules()) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, kept, cleaned text."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, WS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(WS)]
    repeat = repeated_words(words)
    failed = n < rules.min_words or repeat > rules.most_repeated * n
    cleaned, lost = clean(text, rules)
    kept = not failed and lost <= rules.most_lost * n
    return n, chars, symbols, len(lines) - len(set(lines)), repeat, failed, lost, kept, cleaned


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lost_words long, kept boolean"


def judge(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """docs without their text, and the measures and verdict of each row.

    Row by row in Arrow batches: no shuffle, and no more than one batch in memory."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    keep = [c for c in docs.columns if c not in [*names, "text"]]
    docs = docs.select(*keep, "text")
    schema = docs.select(*keep).withColumns({x.split()[0]: F.lit(None).cast(x.split()[1]) for x in MEASURES.split(", ")}).schema
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(keep)):
            rows = [measure(t or "", rules) for t in batch.column(len(keep)).to_pylist()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*keep, *names])

    return docs.mapInArrow(run, schema)


def clean_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that the rules keep, without their failing lines; n_chars, where there, follows the text.

    All columns of docs stay as they are, whatever their names."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            rows = [measure(t or "", rules) for t in batch.column(at).to_pylist()]
            kept = [i for i, r in enumerate(rows) if r[7]]
            out = batch.take(pa.array(kept, pa.int32()))
            yield out.set_column(at, out.schema.field(at), pa.array([rows[i][8] for i in kept], out.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
