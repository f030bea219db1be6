"""Token counts of every prefix of a text, for byte-level BPE, by dynamic programming.

The encoding of a prefix ends in exactly one token t for which the encoding of the prefix without t
ends in a token that t may follow; whether t may follow depends on the two tokens alone.  So with
the last token of every shorter prefix at hand, each prefix costs a few look-ups, and its count is
one more than that of the prefix before t.  With the counts stored, "how many tokens are the first
k characters" and "how many characters fit in b tokens" need no further encoding.

Texts are cut before white space that follows something else; the tokenizer never joins across
such a cut, and cuts of a prefix are cuts of the text, so counts add up over pieces.  Latin pieces
are split into pre-tokens by a pattern of our own, all others by the library's pre-tokenizer, and
the dynamic program runs inside each pre-token.  A prefix has the pre-tokens of the text but for
the last one, which is the text's cut short, save in two cases: a contraction cut short (two
characters at most, encoded with the library), and white space whose last character the text, not
the prefix, leaves to the next pre-token (one run of the program over the white space).  Texts
with white space beyond ASCII or with special strings are one piece, as piece boundaries are
uncertain there; special strings are one token each and part what is around them.

Defined cases: null is the empty text, which has 0 tokens.  Ids, repeated or null, are passed on;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernel
from .chunks import PieceTable
from .storage import stored

#: White space outside ASCII, as UTF-8: lead byte, second byte, least and greatest third byte.
WIDE_SPACE = ((0xC2, 0x85, None), (0xC2, 0xA0, None), (0xE1, 0x9A, (0x80, 0x80)), (0xE2, 0x80, (0x80, 0x8A)), (0xE2, 0x80, (0xA8, 0xA9)), (0xE2, 0x80, (0xAF, 0xAF)), (0xE2, 0x81, (0x9F, 0x9F)), (0xE3, 0x80, (0x80, 0x80)))

SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Prefix counts of single pre-tokens; ``whole`` gives the library's count of any text."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = byte_alphabet()
        as_bytes = lambda s: bytes(to_byte[c] for c in s)
        # Ranks: single bytes in the order of their ids, then merges in their order.
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        singles = sorted((t for t in model["vocab"] if len(t) == 1), key=model["vocab"].get)
        self.rank: dict[bytes, int] = {as_bytes(t): k for k, t in enumerate(singles)}
        self.halves: list[tuple[int, int]] = [(k, k) for k in range(len(singles))]
        self.joined: dict[tuple[int, int], int] = {}
        for left, right in merges:
            pair = self.rank[as_bytes(left)], self.rank[as_bytes(right)]
            token = self.rank.setdefault(as_bytes(left + right), len(self.halves))
            if token == len(self.halves):
                self.halves.append(pair)
            self.joined[pair] = token
        self.longest = max(map(len, self.rank))
        self.may: dict[tuple[int, int], bool] = {}
        # The library's pre-tokenizer does not see special strings; longer ones first, as the library does.
        added = sorted((x.content for x in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.short: dict[str, int] = {}
        self.latin = regex.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+|[\t-\r](?=\S)")

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves the neighbours ``a b`` as they are: undo their merges, latest first, and look for one that would have gone across."""
        left, right, limit, answer = a, b, len(self.halves) + 1, True
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < limit:
                answer = False
                break
            inner_left, inner_right = self.halves[left][1], self.halves[right][0]
            if left > right and inner_left != left:
                limit, left = left, inner_left
            elif inner_right != right:
                limit, right = right + 1, inner_right
            elif inner_left != left:
                limit, left = left, inner_left
            else:
                break
        if len(self.may) > 500_000:  # forgetting costs time only
            self.may.clear()
        self.may[a, b] = answer
        return answer

    def pretoken(self, text: bytes) -> list[int]:
        """Counts of the prefixes of 1, 2, ... bytes of one pre-token."""
        # One token alone is right, so the order of trying is free: first the last token grown by a
        # byte, then the shortest tokens.
        rank, may, follows, longest = self.rank, self.may, self.follows, self.longest
        last, count, begun = [-1], [0], 0
        for j in range(1, len(text) + 1):
            for i in (begun, *range(j - 1, max(0, j - longest) - 1, -1)):
                token = rank.get(text[i:j])
                if token is None:
                    continue
                if i:
                    pair = last[i], token
                    fits = may.get(pair)
                    if not (follows(*pair) if fits is None else fits):
                        continue
                last.append(token)
                count.append(count[i] + 1)
                begun = i
                break
        return count[1:]

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def by_character(self, text: str) -> list[int]:
        """Counts of the prefixes of 1, 2, ... characters of one pre-token."""
        raw = text.encode("utf-8")
        inner = self.pretoken(raw)
        return inner if len(raw) == len(text) else [inner[k] for k in range(len(raw)) if k + 1 == len(raw) or raw[k + 1] & 0xC0 != 0x80]

    def contraction(self, text: str) -> list[int]:
        """The same of a contraction, whose prefixes can be two pre-tokens."""
        prefixes = [text[:k] for k in range(1, len(text) + 1)]
        if prefixes[-1] not in self.short:
            self.short.update(zip(prefixes, self.whole(prefixes), strict=True))
        return [self.short[x] for x in prefixes]

    def plain(self, text: str) -> list[int]:
        """Counts of the prefixes of 1, 2, ... characters of a text without special strings."""
        counts: list[int] = []
        done = 0
        blank, before = 0, 0  # where the pre-token before this one begins if it is white space, and the count up to there
        for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text):
            own = text[a:b]
            inner = self.contraction(own) if own[0] == "'" and len(own) > 1 and own[1].isalpha() else self.by_character(own)
            counts += [done + c for c in inner]
            # A prefix that ends in a run of white space has the run as one pre-token.
            if blank < a and own[0] in SPACES:
                counts[a] = before + self.by_character(text[blank : a + 1])[-1]
            blank, before = (a, done) if all(c in SPACES for c in own) else (len(text), 0)
            done += inner[-1]
        return counts

    def counts(self, text: str) -> list[int]:
        """Counts of the prefixes of 1, 2, ... characters of any text."""
        counts: list[int] = []
        at = 0
        for found in self.special.finditer(text) if self.special else ():
            done = counts[-1] if counts else 0
            # Until its last character a special string is text like any other.
            before = self.plain(text[at : found.end() - 1])
            counts += [done + c for c in before]
            counts.append(done + (self.plain(text[at : found.start()])[-1] if found.start() > at else 0) + 1)
            at = found.end()
        done = counts[-1] if counts else 0
        return counts + [done + c for c in self.plain(text[at:])]

    def deltas(self, piece: bytes) -> list[int]:
        """The change of the count with each character of a piece (white space, then other characters)."""
        text = piece.decode("utf-8")
        counts: list[int] = []
        at = 0
        while at < len(text):
            found = self.latin.match(text, at)
            if not found:
                counts = self.plain(text)
                break
            done = counts[-1] if counts else 0
            counts += [done + c for c in self.by_character(found[0])]
            at = found.end()
        return [b - a for a, b in zip([0, *counts], counts)]  # noqa: B905

    def all_deltas(self, pieces: list[bytes]) -> list[list[int]]:
        return [self.deltas(p) for p in pieces]


_tables: dict[str, tuple[PrefixCounter, PieceTable]] = {}


def _table(path: str) -> tuple[PrefixCounter, PieceTable]:
    if path not in _tables:
        counter = PrefixCounter(path)
        _tables[path] = counter, PieceTable(counter.all_deltas, np.int32)
    return _tables[path]


def irregular(texts: kernel.Texts, words_data: np.ndarray) -> np.ndarray:
    """Which texts hold white space beyond ASCII or the beginning of a special string."""
    d = words_data
    n = len(d)
    odd = np.zeros(n, bool)
    if n > 1:
        odd[:-1] |= (d[:-1] == 0x3C) & (d[1:] == 0x7C)  # <|
        for lead, second, third in WIDE_SPACE:
            at = np.flatnonzero(d[:-1] == lead)
            at = at[d[at + 1] == second]
            if third is not None:
                at = at[at + 2 < n]
                at = at[(d[at + 2] >= third[0]) & (d[at + 2] <= third[1])]
            odd[at] = True
    flag = np.zeros(len(texts), bool)
    flag[np.searchsorted(texts.offsets, np.flatnonzero(odd), "right") - 1] = True
    return flag


def pieces(texts: kernel.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each piece: white space and what follows up to the next white space."""
    d = texts.data
    n = len(d)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    space = kernel.IS_SPACE[d]
    cut = np.zeros(n + 1, bool)
    cut[1:n] = space[1:] & ~space[:-1]
    cut[texts.offsets] = True
    start = np.flatnonzero(cut[:n])
    return start, np.append(start[1:], n), np.searchsorted(texts.offsets, start, "right") - 1


def prefix_table(documents: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_chars, n_tokens, prefix_deltas``.

    ``prefix_deltas`` holds one little-endian int16 a character: how the count changes with it (see
    :func:`counts_of`).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("prefix_deltas", pa.binary())])

    def scan(batches):
        counter, table = _table(tokenizer_path)
        for batch in batches:
            for texts in kernel.text_slices(batch.column(1)):
                start, end, doc = pieces(texts)
                odd = irregular(texts, texts.data)
                usual = ~odd[doc]
                start, end, doc = start[usual], end[usual], doc[usual]
                at, size = table.look_up(texts.data, start, end, kernel.span_hashes(texts.data, start, end))
                flat = table.gather(at, size)
                chars = np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(chars)])
                running = np.concatenate([[0], np.cumsum(flat)])
                tokens = running[bounds[1:]] - running[bounds[:-1]]
                narrow = flat.astype("<i2").tobytes()
                encoded = [narrow[2 * a : 2 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                for k in np.flatnonzero(odd):
                    text = texts.data[texts.offsets[k] : texts.offsets[k + 1]].tobytes().decode("utf-8")
                    counts = np.array([0, *counter.counts(text)])
                    chars[k], tokens[k], encoded[k] = len(text), counts[-1], np.diff(counts).astype("<i2").tobytes()
                ids = batch.column(0).slice(texts.first_row, len(texts)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(texts.offsets)), pa.array(chars), pa.array(tokens.astype(np.int64)), pa.array(encoded, pa.binary())], schema=schema)

    docs = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].alias("text"))
    return docs.mapInArrow(scan, "doc_id long, n_bytes long, n_chars long, n_tokens long, prefix_deltas binary")


def counts_of(prefix_deltas: bytes) -> np.ndarray:
    """Token count of the first 0, 1, 2, ... characters."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(prefix_deltas, "<i2"))])


def fit(prefix_deltas: bytes, budget: int) -> int:
    """The greatest number of leading characters that are at most ``budget`` tokens (counts can fall as a prefix grows)."""
    return int(np.flatnonzero(counts_of(prefix_deltas) <= budget)[-1])


def answered(table: DataFrame, budget: int) -> DataFrame:
    """From :func:`prefix_table`, without encoding anything: ``doc_id, n_bytes, n_chars, n_tokens, over_limit, fit_chars``.

    ``n_tokens`` is the count of the last prefix, ``over_limit`` whether it is above ``budget``, and
    ``fit_chars`` the greatest number of leading characters that are at most ``budget`` tokens.
    """
    names = ["doc_id", "n_bytes", "n_chars", "n_tokens", "over_limit", "fit_chars"]

    def scan(batches):
        for batch in batches:
            tokens, chars = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for k, deltas in enumerate(batch.column(3)):
                counts = counts_of(memoryview(deltas.as_buffer()))
                tokens[k] = counts[-1]
                chars[k] = len(counts) - 1 if counts.max() <= budget else np.flatnonzero(counts <= budget)[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(tokens), pa.array(tokens > budget), pa.array(chars)], names)

    return table.select("doc_id", "n_bytes", "n_chars", "prefix_deltas").mapInArrow(scan, "doc_id long, n_bytes long, n_chars long, n_tokens long, over_limit boolean, fit_chars long")


def op8_prefix_counts(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    """The prefix table of all documents is stored; counts and limits are read off it."""
    import public_tokenizers

    table = prefix_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return answered(stored(table, "prefix-counts", **{"parquet.block.size": str(16 << 20)}), limit)
