"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside Spark tasks.

Each task splits its texts into words by the vocabulary's pattern and encodes the distinct words that its worker
has not met. Words are cut where no token of the vocabulary could reach across. A recursive query holds
token-position rows of the parts, joins neighbouring tokens with the merge table, contracts the leftmost pair of
least rank of each part, and goes on until no part has a mergeable pair. Long parts are cut into pieces, which go
through the same query, so that the rounds don't grow with the length; then their seams are mended. A sequence of
tokens is the encoding of its bytes if each two neighbours are that of theirs, so a seam holds where its two tokens
do; where they don't, the tokens around it, twice as many each time, are encoded anew, and the ends of what was
encoded are seams in turn. Decoding joins token rows with the vocabulary and aggregates the bytes in the order of
their positions.

Memory is bounded: words go to DuckDB in groups of bounded bytes, decoding takes bounded tokens at a time, and a
worker's table of known words is emptied at a size limit.

Defined cases: null text counts as empty and has no tokens; texts of any length are encoded whole; equal texts
get equal ids; strings that look like special tokens are ordinary text; an empty table gives an empty one;
`encode` passes the id columns asked for and no others.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words of so many bytes together are encoded by one recursive query.
WORD_BYTES = 4 << 20
#: A worker forgets its known words, and apart from them its known stretches of text, beyond so many.
KNOWN_WORDS = 900_000
KNOWN_UNITS = 500_000
KNOWN_PAIRS = 200_000
#: So many tokens are decoded at a time.
DECODE_TOKENS = 2_000_000

#: Parts of so many bytes are cut into pieces of half of them or more.
LONG = 64

#: pos: where a token's bytes begin among those of all parts; its right neighbour begins where they end.
MERGE = """
WITH RECURSIVE step(part, pos, tok, len, done) AS (
    SELECT part, pos, tok, 1, false FROM start
    UNION ALL
    SELECT part, pos, tok, len, done FROM (
        WITH live AS (SELECT part, pos, tok, len FROM step WHERE NOT done),
        best AS (
            SELECT a.part, min(m.merged::BIGINT * 4294967296 + a.pos) AS key,
                   arg_min(b.pos, m.merged::BIGINT * 4294967296 + a.pos) AS gone,
                   arg_min(a.len + b.len, m.merged::BIGINT * 4294967296 + a.pos) AS len
            FROM live a JOIN live b ON b.pos = a.pos + a.len AND b.part = a.part JOIN merges m ON m.pair = a.tok::BIGINT * 65536 + b.tok
            GROUP BY a.part
        )
        SELECT l.part, l.pos,
               CASE WHEN l.pos = best.key % 4294967296 THEN (best.key // 4294967296)::INTEGER ELSE l.tok END AS tok,
               CASE WHEN l.pos = best.key % 4294967296 THEN best.len ELSE l.len END AS len,
               best.part IS NULL AS done
        FROM live l LEFT JOIN best ON best.part = l.part
        WHERE best.part IS NULL OR l.pos <> best.gone
    )
)
SELECT pos, tok FROM step WHERE done
"""

#: The rows come in order, and one thread aggregates them as they come.
DECODE = """
SELECT seq, string_agg(chars, '') AS chars FROM (SELECT seq, chars FROM rows JOIN vocabulary USING (tok) ORDER BY pos) GROUP BY seq ORDER BY seq
"""


class Known:
    """Ids of strings, end to end, with the place of each string in them."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.texts: list[str] = []
        self.offsets = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def add(self, keys: list[str], sizes: np.ndarray, ids: np.ndarray, texts: bool = False) -> None:
        first, ends = len(self.codes), np.cumsum(sizes)
        if texts:
            decimal = ids.astype("U6").tolist()
            self.texts += [" ".join(decimal[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + ends])
        self.ids = np.concatenate([self.ids, ids])
        self.codes.update(zip(keys, range(first, first + len(keys)), strict=True))

    def sizes(self, codes: np.ndarray) -> np.ndarray:
        return self.offsets[codes + 1] - self.offsets[codes]

    def gather(self, codes: np.ndarray) -> np.ndarray:
        sizes = self.sizes(codes)
        where = np.repeat(self.offsets[codes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return self.ids[where]


def _with_spaces(text: str) -> list[str]:
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


class Bpe:
    """A vocabulary of ranks (the tiktoken format: base64 token, rank) in an own in-memory DuckDB."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.doubled = regex.compile(r"\s\x20").search
        self.words, self.units = Known(), Known()
        #: Whether the bytes of two tokens have these two as their encoding.
        self.holds: dict[tuple[int, int], bool] = {}
        ranks = self.ranks
        # a pair merges if its bytes together are a token, whose rank is the pair's
        pairs = [(ranks[t[:i]], ranks[t[i:]], n) for t, n in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        l, r, m = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.bytes_of = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        # which two bytes are a token, and which three stand in one
        self.two, self.three = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
        for t in ranks:
            x = np.frombuffer(t, np.uint8).astype(np.int64)
            if len(x) == 2:
                self.two[x[0] << 8 | x[1]] = True
            self.three[x[:-2] << 16 | x[1:-1] << 8 | x[2:]] = True
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB"})
        self.db.execute("SET temp_directory = ''")
        merges = pa.table({"pair": l * 65536 + r, "merged": m.astype(np.int32)})  # noqa: F841
        # a byte as the character of its number
        tokens = pa.table({"tok": pa.array(np.fromiter(ranks.values(), np.int32)), "chars": [t.decode("latin-1") for t in ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM tokens")

    def learn_words(self, words: list[str]) -> None:
        """Encodes distinct words that aren't known yet."""
        group: list[tuple[int, bytes]] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        weight = 0
        for i, w in enumerate(words):
            raw = w.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                found.append((np.array([i], np.int64), np.array([whole], np.int32)))
                continue
            group.append((i, raw))
            weight += len(raw)
            if weight >= WORD_BYTES:
                found.append(self._merge(group))
                group, weight = [], 0
        if group:
            found.append(self._merge(group))
        at = np.concatenate([x[0] for x in found])
        ids = np.concatenate([x[1] for x in found])[np.argsort(at, kind="stable")]
        self.words.add(words, np.bincount(at, minlength=len(words)), ids)

    def learn_units(self, units: list[str]) -> None:
        """Units are stretches of text whose ends are ends of words whatever surrounds them."""
        split = [self.split(u) for u in units]
        fresh = list(set().union(*split).difference(self.words.codes))
        if fresh:
            self.learn_words(fresh)
        codes = np.fromiter((self.words.codes[w] for words in split for w in words), np.int64)
        per_word = self.words.sizes(codes)
        per_unit = np.bincount(np.repeat(np.arange(len(split)), [len(x) for x in split]), per_word, minlength=len(split)).astype(np.int64)
        self.units.add(units, per_unit, self.words.gather(codes), texts=True)

    def encode_batch(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """Of each text: its ids, and the same as decimal numbers joined by one space."""
        if len(self.words.codes) > KNOWN_WORDS:
            self.words = Known()
        if len(self.units.codes) > KNOWN_UNITS:
            self.units = Known()
        # between a character that is no white space and a space a word always ends, so that texts without other
        # white space before a space are units joined by spaces
        cut = [[t] if self.doubled(t) else _with_spaces(t) for t in texts]
        fresh = list(set().union(*(set(units).difference(self.units.codes) for units in cut)))
        if fresh:
            self.learn_units(fresh)
        out = []
        for units in cut:
            codes = np.fromiter(map(self.units.codes.__getitem__, units), np.int64, len(units))
            out.append((self.units.gather(codes), " ".join(map(self.units.texts.__getitem__, codes.tolist()))))
        return out

    def _parts(self, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether each byte begins a part: it begins a word (first), or no token has it together with the byte before."""
        x = raw.astype(np.int64)
        begins = first.copy()
        begins[1:] |= ~self.two[x[:-1] << 8 | x[1:]]
        inside = self.three[x[:-2] << 16 | x[1:-1] << 8 | x[2:]] & ~first[1:-1] & ~first[2:]
        at = np.flatnonzero(inside)
        begins[at + 1] = begins[at + 2] = False
        return begins | first

    def _merge(self, group: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Word and token of every token, in order."""
        sizes = np.array([len(b) for _, b in group])
        raw = np.frombuffer(b"".join(b for _, b in group), np.uint8)
        first = np.zeros(len(raw), bool)
        first[np.cumsum(sizes) - sizes] = True
        begins = self._parts(raw, first)
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.append(starts, len(raw)))
        # whole pieces, the last of which has what is left over
        offset = np.arange(len(raw)) - np.repeat(starts, lengths)
        cut = (offset % (LONG // 2) == 0) & (offset > 0) & (np.repeat(lengths, lengths) - offset >= LONG // 2) & np.repeat(lengths >= LONG, lengths)
        pos, tok = self._contract(raw, begins | cut)
        if cut.any():
            pos, tok = self._mended(raw, begins, pos, tok, np.flatnonzero(cut))
        word = np.repeat(np.array([i for i, _ in group], np.int64), sizes)
        return word[pos], tok

    def _contract(self, raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of every token, in order, of parts that are encoded apart."""
        start = pa.table({"part": np.cumsum(begins) - 1, "pos": np.arange(len(raw)), "tok": self.bytes_of[raw]})  # noqa: F841
        out = self.db.sql(MERGE).to_arrow_table()
        pos, tok = out["pos"].to_numpy(), out["tok"].to_numpy()
        order = np.argsort(pos)
        return pos[order], tok[order]

    def _mended(self, raw: np.ndarray, begins: np.ndarray, pos: np.ndarray, tok: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the parts (begins), from those (pos, tok) of pieces of them, which begin at the cuts, too."""
        part_of = np.cumsum(begins)
        pending = dict.fromkeys(cuts.tolist(), 2)  # seams, and how many tokens on each side are encoded anew
        while pending:
            ends = np.append(pos[1:], len(raw))
            index = dict(zip(pos.tolist(), range(len(pos)), strict=True))
            spans = {at: (int(pos[index[at] - 1]), int(ends[index[at]])) for at in pending}
            pairs = list({(int(tok[index[at] - 1]), int(tok[index[at]])): raw[a:b].tobytes() for at, (a, b) in spans.items()}.items())
            fresh = [x for x in pairs if x[0] not in self.holds]
            if len(self.holds) > KNOWN_PAIRS:
                self.holds = {}
                fresh = pairs
            for (pair, _), tokens in zip(fresh, self._each([x for _, x in fresh]), strict=True):
                self.holds[pair] = tokens[1].tolist() == list(pair)
            broken = sorted(at for at in pending if not self.holds[int(tok[index[at] - 1]), int(tok[index[at]])])
            waiting: dict[int, int] = {}
            windows, last = [], -1
            for at in broken:
                i, k = index[at], pending[at]
                lo, hi = max(i - k, 0), min(i + k, len(pos))
                own = part_of[at]
                while part_of[pos[lo]] != own:
                    lo += 1
                while part_of[pos[hi - 1]] != own:
                    hi -= 1
                if lo < last:
                    waiting[at] = k  # after the window before it
                    continue
                last = hi
                windows.append((lo, hi, k))
            found = self._each([raw[pos[lo] : ends[hi - 1]].tobytes() for lo, hi, _ in windows])
            new_pos, new_tok, done = [], [], 0
            for (lo, hi, k), (places, tokens) in zip(windows, found, strict=True):
                new_pos += [pos[done:lo], pos[lo] + places]
                new_tok += [tok[done:lo], tokens]
                done = hi
                inside = range(int(pos[lo]) + 1, int(ends[hi - 1]))
                waiting = {at: n for at, n in waiting.items() if at not in inside}
                for at in (int(pos[lo]), int(ends[hi - 1])):
                    if at < len(raw) and not begins[at]:
                        waiting[at] = max(2 * k, waiting.get(at, 0))
            pos, tok = np.concatenate([*new_pos, pos[done:]]), np.concatenate([*new_tok, tok[done:]])
            pending = waiting
        return pos, tok

    def _each(self, strings: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and tokens of each string, encoded as one part."""
        if not strings:
            return []
        sizes = np.array([len(x) for x in strings])
        first = np.cumsum(sizes) - sizes
        raw = np.frombuffer(b"".join(strings), np.uint8)
        begins = np.zeros(len(raw), bool)
        begins[first] = True
        pos, tok = self._contract(raw, begins)
        at = np.searchsorted(pos, np.append(first, len(raw)))
        return [(pos[a:b] - f, tok[a:b]) for a, b, f in zip(at[:-1], at[1:], first, strict=True)]

    def decode_batch(self, sequences: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        out: list[bytes] = []
        at = 0
        while at < len(sequences):
            end, total = at, 0
            while end < len(sequences) and (end == at or total + len(sequences[end]) <= DECODE_TOKENS):
                total += len(sequences[end])
                end += 1
            out += self._decode(sequences[at:end])
            at = end
        return out

    def _decode(self, sequences: list[np.ndarray]) -> list[bytes]:
        sizes = [len(s) for s in sequences]
        if not sum(sizes):
            return [b""] * len(sequences)
        rows = pa.table(  # noqa: F841
            {"seq": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), "pos": np.arange(sum(sizes), dtype=np.int32), "tok": np.concatenate(sequences)}
        )
        found = self.db.sql(DECODE).to_arrow_table()
        out = [b""] * len(sequences)
        for seq, chars in zip(found["seq"].to_pylist(), found["chars"].to_pylist(), strict=True):
            out[seq] = chars.encode("latin-1")
        return out


_loaded: dict[tuple[str, str], Bpe] = {}


def load(path: str, pattern: str) -> Bpe:
    """One per worker process, kept between its tasks."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe(path, pattern)
    return _loaded[path, pattern]


def batches_of_texts(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    from mosaiq.llm.common import slices

    for batch in slices(batches, column, limit):
        yield batch, [t or "" for t in batch.column(column).to_pylist()]


def encode(docs, path: str, pattern: str, keep: list[str], text: str = "text"):
    """keep and ids array<int> of each row's text."""
    from pyspark.sql import functions as F

    rows = docs.select(*keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch, texts in batches_of_texts(batches, len(keep), 4 << 20):
            ids = [x[0] for x in bpe.encode_batch(texts)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], [*keep, "ids"])

    return rows.mapInArrow(run, rows.select(*keep, F.array().cast("array<int>").alias("ids")).schema)


def decode(rows, path: str, pattern: str, keep: list[str], ids: str = "ids"):
    """keep and bytes binary of each row's ids."""
    from pyspark.sql import functions as F

    rows = rows.select(*keep, F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            column = batch.column(len(keep))
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            out = bpe.decode_batch([values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.binary())], [*keep, "bytes"])

    return rows.mapInArrow(run, rows.select(*keep, F.lit(b"").alias("bytes")).schema)


def round_trip(docs, path: str, pattern: str):
    """Per document: n_tokens, ids_sha256 and decoded_sha256, the ids never leaving the task."""
    import hashlib

    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch, texts in batches_of_texts(batches, 1, 4 << 20):
            coded = bpe.encode_batch(texts)
            decoded = bpe.decode_batch([ids for ids, _ in coded])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(ids) for ids, _ in coded], pa.int64()),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s in coded]),
                    pa.array([hashlib.sha256(b).hexdigest() for b in decoded]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
