"""URL filters by a Bloom filter cascade.

Listed keys are ``host + path`` rules.  A URL's keys are its host's suffixes (at label boundaries)
joined with the prefixes of its path that have the length of some listed path.  Level 1 of the
cascade holds the listed keys, level 2 those keys of the corpus that level 1 holds wrongly, level 3
the listed keys that level 2 holds wrongly, and so on until no key is held wrongly.  Over the key
universe it was built on, the cascade answers exactly, and a scan needs no join.

Sizes: level 1 is sized from the rule list so that about as many corpus keys pass it wrongly as
there are rules, so each level is of the order of the rule list, whatever the corpus holds.

Candidate keys take path prefixes of every length that a rule has, and rules may be many: 10,000 are
tested.

Defined cases: a null URL, or one without ``://``, has empty host and path; an empty host or path
matches rules as any other string would, so a rule path other than "" never fits an empty path.
Repeated rows are judged alike; an empty table gives an empty result; further columns are ignored.
A very long URL is hashed whole; only its host and path are kept.  Ties: of fitting rules of one length that
with the longer host counts, of rules with one key the last.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stored


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, path_lengths: Iterable[int]) -> Column:
    """All keys of a URL that could be listed, as (key, host part length) structs."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(path_lengths))]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(F.concat(s, p).alias("key"), F.char_length(s).alias("host_length")))))


def _hash_pair(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each key (an Arrow string column), from which a level's probes are made."""
    from .kernel import mix, span_hashes

    column = keys.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    h = span_hashes(data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], offsets[1:] - offsets[0])
    return h, mix(h ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


@dataclass
class Level:
    """One Bloom filter: ``bits`` cells, ``hashes`` probes, salted by its number in the cascade."""

    number: int
    bits: int
    hashes: int
    cells: np.ndarray

    @classmethod
    def sized(cls, number: int, items: int, rate: float) -> Level:
        bits = max(64, math.ceil(items * -math.log(rate) / math.log(2) ** 2 / 64) * 64)
        return cls(number, bits, max(1, round(-math.log2(rate))), np.zeros(bits // 8, np.uint8))

    def places(self, pair: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        from .kernel import mix

        a = mix(pair[0] + np.uint64(self.number * 0x9E3779B97F4A7C15 % 2**64))
        return (a[:, None] + pair[1][:, None] * np.arange(self.hashes, dtype=np.uint64)) % np.uint64(self.bits)

    def add(self, pair: tuple[np.ndarray, np.ndarray]) -> None:
        at = self.places(pair).ravel()
        np.bitwise_or.at(self.cells, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def holds(self, pair: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at = self.places(pair)
        return ((self.cells[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


class Cascade:
    """Levels in order; a key is listed if the first level that lacks it is an even one (counting from 1)."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def listed(self, keys: pa.Array) -> np.ndarray:
        pair = _hash_pair(keys)
        depth = np.zeros(len(keys), np.int64)
        open_ = np.ones(len(keys), bool)
        for level in self.levels:
            open_ &= level.holds(pair)
            depth += open_
        return depth % 2 == 1


def _strings(keys: Iterable[str]) -> pa.Array:
    return pa.array(list(keys), pa.large_string())


def build_cascade(universe: DataFrame, rules: list[Rule], first_rate: float | None = None, most_wrong: int = 20_000_000) -> Cascade:
    """Build over ``universe`` (distinct ``key`` strings, every key the scan will ask for).

    The wrongly held keys of level 1 are few by the choice of its rate (about one for each rule in
    expectation), so the deeper levels, each half as large, are built on the driver from the rule
    list and that remainder alone.  Their number is counted before they are fetched: while it is above
    ``most_wrong`` and above four for each rule, level 1 is built anew at a hundredth of its rate.
    """
    listed = _strings(sorted({r.key for r in rules}))
    asked = universe.count()
    rate = first_rate or min(0.5, max(1e-9, len(listed) / max(1, asked)))
    spark = universe.sparkSession
    while True:
        first = Level.sized(1, max(1, len(listed)), rate)
        if len(listed):
            first.add(_hash_pair(listed))
        # Rules and level 1 are broadcast: both are of the order of the rule list.
        held = spark.sparkContext.broadcast((first, listed))

        def passing(batches, held=held):
            level, names = held.value
            for batch in batches:
                keys = batch.column(0).cast(pa.large_string())
                wrong = level.holds(_hash_pair(keys)) & ~pc.is_in(keys, value_set=names).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([keys.filter(pa.array(wrong)).cast(pa.string())], ["key"])

        found = stored(universe.mapInArrow(passing, "key string"), "url-wrong")
        n = found.count()
        if n <= max(most_wrong, 4 * len(listed)) or rate <= 1e-12:
            break
        rate /= 100
    levels = [first]
    wrong = _strings(r["key"] for r in found.toLocalIterator())
    while len(wrong):
        if len(levels) > 200:
            raise ValueError("a listed and an unlisted key share their 64-bit hash; no cascade can part them")
        level = Level.sized(len(levels) + 1, len(wrong), 0.5)
        level.add(_hash_pair(wrong))
        levels.append(level)
        listed, wrong = wrong, listed.filter(pa.array(level.holds(_hash_pair(listed)))) if len(listed) else listed
    return Cascade(levels)


def filter_urls(pages: DataFrame, rules: list[Rule], *, default: str = "allow", id_column: str = "page_id", url_column: str = "url", first_rate: float | None = None) -> DataFrame:
    """Judge each URL: the longest listed key it has (the longer host among equals) gives rule and verdict.

    Returns ``id_column, host, path, rule, verdict, n_keys``; without a listed key the rule is null
    and the verdict is ``default``.  One pass of Arrow batches gives rule and verdict together; the
    cascade and the rules are broadcast, so plan and closure stay small for any number of rules.
    """
    lengths = {len(r.path) for r in rules} or {0}
    urls = pages.select(pages[id_column].alias(id_column), pages[url_column].alias("_url"))
    parsed = urls.select(id_column, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    keyed = parsed.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = keyed.select(F.explode("keys.key").alias("key")).distinct()
    universe = stored(universe, "url-keys")
    cascade = build_cascade(universe, rules, first_rate)
    # Of rules with one key the last counts, as a mapping of keys would have it.
    verdict_of = {r.key: r.verdict for r in rules}
    known = pages.sparkSession.sparkContext.broadcast((cascade, verdict_of))

    def judge(batches):
        cascade, verdict_of = known.value
        for batch in batches:
            keys, n = batch.column(3), batch.num_rows
            size = keys.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            inside = keys.flatten()
            flat, host_length = inside.field(0), inside.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(n), size)
            hit = np.flatnonzero(cascade.listed(flat)) if len(flat) else np.zeros(0, np.int64)
            named = flat.take(pa.array(hit)).to_pylist()
            rule: list[str | None] = [None] * n
            rank: dict[int, tuple[int, int]] = {}
            for k, key, length in zip(owner[hit].tolist(), named, host_length[hit].tolist(), strict=True):
                own = (len(key), length)
                if k not in rank or own > rank[k]:
                    rank[k], rule[k] = own, key
            verdict = [default if r is None else verdict_of[r] for r in rule]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(size)], [id_column, "host", "path", "rule", "verdict", "n_keys"])

    schema = T.StructType([keyed.schema[id_column], *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")), T.StructField("n_keys", T.LongType())])
    return keyed.select(id_column, "host", "path", "keys").mapInArrow(judge, schema)


#: The rules that the registered query applies.
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]

ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)\A.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(rule, verdict, rule_host, rule_path) AS (
  VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
         ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
), fits AS (
  SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS place
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict,
       CAST((length(host) - length(replace(host, '.', '')) + 1) * ((length(path) >= 1)::INT + (length(path) >= 4)::INT) AS BIGINT) AS n_keys
FROM fits WHERE place = 1
"""


def op6_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
