"""Toxicity by a weighted finite-state pattern grammar.

Tokens are read as symbols: insult, threat, target, negation, reported speech, clause end, other.
Five small transducers each follow one aspect of a clause (is an insult there and was it negated,
the same for threats, is someone targeted, how far a negation still reaches, is the clause reported)
and are composed into one machine.  At a clause's end the machine emits the clause's outcome, with
the sum of its arcs' weights.  Words alone never score: what is scored is a clause's outcome.

What is learned, from labelled rows of the training fold only: the insults, as words and word
beginnings that labelled texts hold far more often when they are toxic, each with its log-odds as
the weight of its arc; and the weight of each outcome, by logistic regression on each document's
sums of outcomes.  Both use at most ``most_rows`` labelled rows, those whose ids hash lowest, which
bounds what reaches the driver.  Scoring covers every text, whole.

Defined cases: a null or empty text, or one with no scoring clause, gets the score of the intercept.
Rows with a null id take no part in learning and are scored; repeated rows are scored alike, and of
repeated labels each counts.  Without labels of both kinds nothing is learned: fixed insults and
weights are used.  Empty tables give an empty result; further columns are ignored.
A very long text is read whole, as a slice of its own.  Ties: of rows whose ids have equal hashes the
lesser ids are learned from.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .decontaminate import _strip

OTHER, END, INSULT, THREAT, TARGET, NEGATION, REPORT = range(7)

# Words of the closed symbols, in the languages of the corpus.
THREATS = "kill murder hurt stab shoot strangle hang punch töten umbringen schlagen erschießen tuer frapper étrangler matar golpear apuñalar disparar".split()
TARGETS = "you your yours yourself u he him she her they them people du dich dir euch ihr tu toi vous ton tú usted ustedes vosotros ti".split()
NEGATIONS = "not no never neither nor without isn't aren't wasn't don't doesn't nicht kein keine keinen nie niemals ne pas non jamais sans nunca jamás sin tampoco".split()
REPORTS = "said says say told tells called calls claimed claims wrote writes reported quoted sagte sagt nannte schrieb berichtete dit disait appelé écrit dijo dice llamó escribió".split()
INSULTS = "idiot moron stupid scum loser worthless disgusting pathetic trash clown".split()

NEGATION_REACH = 3
#: Shortest and longest learned word beginning, in bytes.
STEM_BYTES = (4, 12)


def compose(*machines: tuple[list, dict]) -> tuple[list[tuple], np.ndarray]:
    """Product of machines, each (states, step) with ``step(state, symbol, all_states)``; the states and the table (state, symbol) -> state."""
    states = list(product(*(m[0] for m in machines)))
    number = {s: k for k, s in enumerate(states)}
    table = np.zeros((len(states), 7), np.int64)
    for k, state in enumerate(states):
        for symbol in range(7):
            table[k, symbol] = number[tuple(m[1](own, symbol, state) for m, own in zip(machines, state, strict=True))]
    return states, table


def _reach(own: int, symbol: int, _all: tuple) -> int:
    return 0 if symbol == END else NEGATION_REACH if symbol == NEGATION else max(0, own - 1)


def _offence(kind: int):
    """0: none so far, 1: negated ones only, 2: at least one that stands."""

    def step(own: int, symbol: int, everything: tuple) -> int:
        if symbol == END:
            return 0
        return max(own, 1 if everything[0] else 2) if symbol == kind else own

    return step


def _flag(kind: int):
    def step(own: int, symbol: int, _all: tuple) -> int:
        return 0 if symbol == END else int(own or symbol == kind)

    return step


STATES, TABLE = compose(
    (list(range(NEGATION_REACH + 1)), _reach), ([0, 1, 2], _offence(INSULT)), ([0, 1, 2], _offence(THREAT)), ([0, 1], _flag(TARGET)), ([0, 1], _flag(REPORT))
)
#: Outcome of a clause that ends in each state: offence (insult, threat, both) x stands x targeted x reported; -1: nothing scored.
OUTCOMES = 24


def _outcome(state: tuple) -> int:
    _, insult, threat, target, report = state
    if not insult and not threat:
        return -1
    offence = 2 if insult and threat else 1 if threat else 0
    return ((offence * 2 + (max(insult, threat) == 2)) * 2 + target) * 2 + report


OUTCOME = np.array([_outcome(s) for s in STATES])
#: Without labels: clauses weigh more if they stand, are targeted, and are not reported.
DEFAULT_WEIGHTS = np.array([(0.2 if not stands else 1.0) * (1.5 if target else 1.0) * (0.3 if report else 1.0) for _ in range(3) for stands in (0, 1) for target in (0, 1) for report in (0, 1)] + [0.0])


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the capitals of Latin-1 (UTF-8 bytes, lengths unchanged)."""
    out = kernel.LOWER[data]
    if len(out) > 1:
        at = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
        out[at] += 0x20
    return out


@dataclass
class Tokens:
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    clause: np.ndarray


def tokens_of(texts: kernel.Texts) -> Tokens:
    """Words without punctuation at the ends, and the clause of each; clauses end at ``.!?;``, line ends and text ends."""
    words = kernel.split_words(texts)
    data = folded(texts.data)
    if not len(words.start):
        none = np.zeros(0, np.int64)
        return Tokens(data, none, none, none, none)
    start, end = _strip(data, words.start, words.end)
    inner = np.where(start < end, end, words.start)  # a word of marks alone is all tail
    end = np.maximum(start, end)
    closing = np.isin(data, np.frombuffer(b".!?;", np.uint8))
    running = np.concatenate([[0], np.cumsum(closing)])
    # The token closes a clause if a mark follows it inside its word, or a line ends before the next word.
    closes = running[words.end] > running[inner]
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.append(words.start[1:], len(data))
    closes |= lines[last] > lines[words.end]
    closes[:-1] |= words.doc[1:] != words.doc[:-1]
    clause = np.concatenate([[0], np.cumsum(closes)[:-1]])
    return Tokens(data, start, end, words.doc, clause)


@dataclass
class Lexicon:
    """Hashes of whole words by symbol, and insults' beginnings by length, each with its weight."""

    words: np.ndarray
    symbols: np.ndarray
    word_weights: np.ndarray
    stems: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, insults: dict[str, float], stems: dict[bytes, float]) -> Lexicon:
        entries: dict[bytes, tuple[int, float]] = {}
        for symbol, listed in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            entries |= {w.encode(): (symbol, 1.0) for w in listed}
        entries |= {w.encode(): (INSULT, weight) for w, weight in insults.items() if w.encode() not in entries}
        hashes = _hashes(list(entries))
        order = np.argsort(hashes)
        values = list(entries.values())
        by_length = {}
        for length in sorted({len(s) for s in stems}):
            own = [s for s in stems if len(s) == length]
            h = _hashes(own)
            by_length[length] = h[np.argsort(h)], np.array([stems[s] for s in own])[np.argsort(h)]
        return cls(hashes[order], np.array([v[0] for v in values])[order], np.array([v[1] for v in values])[order], by_length)

    def read(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and weight of each token."""
        symbol, weight = np.zeros(len(tokens.start), np.int64), np.zeros(len(tokens.start))
        for length, (known, weights) in self.stems.items():
            at = np.flatnonzero(tokens.end - tokens.start >= length)
            h = kernel.span_hashes(tokens.data, tokens.start[at], tokens.start[at] + length)
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[place] == h
            symbol[at[hit]], weight[at[hit]] = INSULT, np.maximum(weight[at[hit]], weights[place[hit]])
        h = kernel.span_hashes(tokens.data, tokens.start, tokens.end)
        place = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = self.words[place] == h
        symbol[hit], weight[hit] = self.symbols[place[hit]], np.maximum(weight[hit], self.word_weights[place[hit]])
        return symbol, weight


def _hashes(words: list[bytes]) -> np.ndarray:
    lengths = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(lengths)
    return kernel.span_hashes(np.frombuffer(b"".join(words), np.uint8), end - lengths, end)


def outcome_sums(texts: kernel.Texts, lexicon: Lexicon) -> np.ndarray:
    """For each text and outcome, the sum over its clauses of their weights, and last its number of clauses; shape (texts, OUTCOMES + 1)."""
    tokens = tokens_of(texts)
    sums = np.zeros((len(texts), OUTCOMES + 1))
    if not len(tokens.start):
        return sums
    sums[:, OUTCOMES] = np.bincount(tokens.doc[np.append(True, np.diff(tokens.clause) > 0)], minlength=len(texts))
    symbol, weight = lexicon.read(tokens)
    scoring = (symbol == INSULT) | (symbol == THREAT)
    if not scoring.any():
        return sums
    live = np.zeros(int(tokens.clause[-1]) + 1, bool)
    live[tokens.clause[scoring]] = True
    at = np.flatnonzero((symbol != OTHER) & live[tokens.clause])
    state, total, before = 0, 0.0, -1
    for k, (i, s, w, clause, doc) in enumerate(zip(at.tolist(), symbol[at].tolist(), weight[at].tolist(), tokens.clause[at].tolist(), tokens.doc[at].tolist(), strict=True)):
        for _ in range(min(i - before - 1, NEGATION_REACH) if before >= 0 else 0):
            state = TABLE[state, OTHER]
        state = TABLE[state, s]
        total += w if s in (INSULT, THREAT) else 0.0
        before = i
        if k + 1 == len(at) or tokens.clause[at[k + 1]] != clause:
            if OUTCOME[state] >= 0:
                sums[doc, OUTCOME[state]] += total
            state, total, before = TABLE[state, END], 0.0, -1
    return sums


@dataclass
class Model:
    lexicon: Lexicon
    intercept: float
    weights: np.ndarray

    def scores(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + np.log1p(sums) @ self.weights, -30, 30)))


def training_rows(documents: DataFrame, labels: DataFrame, most_rows: int, folds: int = 5) -> DataFrame:
    """``text, label`` of at most ``most_rows`` labelled rows outside the held-out fold."""
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("label")).where("label in (0, 1)").where(key % folds != 0)
    # A top-k by hash: each task keeps its lowest, so no exchange holds more than that.
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # At most most_rows ids are broadcast, so that the texts need no exchange.
    return documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "label")


def learn_insults(rows: DataFrame, *, least_support: int = 12, least_odds: float = 2.5) -> tuple[dict[str, float], dict[bytes, float]]:
    """Words and word beginnings that toxic texts hold far more often: their log-odds, capped at 5.

    Counts are of texts that hold a word, summed over the words for beginnings.  A beginning is left
    out if a shorter one does as well.
    """
    from .storage import stored

    def scan(batches):
        for batch in batches:
            label = kernel.ints(batch.column(1))
            for texts in kernel.text_slices(batch.column(0)):
                tokens = tokens_of(texts)
                full = tokens.end > tokens.start
                start, end, doc = tokens.start[full], tokens.end[full], tokens.doc[full]
                h = kernel.span_hashes(tokens.data, start, end)
                _, first = np.unique(kernel.mix(h ^ kernel.mix(doc.astype(np.uint64))), return_index=True)
                word, at, which = np.unique(h[first], return_index=True, return_inverse=True)
                toxic = label[texts.first_row + doc[first]]
                n1 = np.bincount(which, weights=toxic, minlength=len(word)).astype(np.int64)
                n = np.bincount(which, minlength=len(word))
                raw = tokens.data.tobytes()
                spelled = [raw[a:b] for a, b in zip(start[first[at]].tolist(), end[first[at]].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(spelled, pa.binary()), pa.array(n1), pa.array(n - n1)], ["word", "n1", "n0"])

    words = stored(rows.mapInArrow(scan, "word binary, n1 long, n0 long").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "toxicity-words")
    all1, all0 = (words.agg(F.sum("n1"), F.sum("n0")).first()) or (0, 0)
    if not all1 or not all0:
        return dict.fromkeys(INSULTS, 2.0), {}
    odds = F.log((F.col("n1") + 0.5) / F.lit(float(all1))) - F.log((F.col("n0") + 0.5) / F.lit(float(all0)))
    low, high = STEM_BYTES
    lengths = F.sequence(F.lit(low), F.least(F.lit(high), F.octet_length("word") - 1))
    stems = words.where(F.octet_length("word") > low).select(F.explode(lengths).alias("k"), "*").groupBy(F.substring("word", F.lit(1), F.col("k")).alias("word")).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    strong = lambda df: df.withColumn("odds", odds).where((F.col("n1") >= least_support) & (F.col("odds") >= least_odds))
    # At most all1 / least_support words and, for each length, as many beginnings pass.
    whole = {bytes(r["word"]): min(5.0, r["odds"]) for r in strong(words).collect()}
    begun = {bytes(r["word"]): min(5.0, r["odds"]) for r in strong(stems).collect()}
    kept: dict[bytes, float] = {}
    for stem in sorted(begun, key=lambda s: (len(s), s)):
        if not any(stem[:k] in kept and kept[stem[:k]] >= begun[stem] - 1.0 for k in range(low, len(stem))):
            kept[stem] = begun[stem]
    insults = {w.decode("utf-8", "ignore"): odd for w, odd in whole.items() if not any(w[:k] in kept for k in range(low, len(w)))}
    return insults, kept


def fit_weights(sums: np.ndarray, label: np.ndarray, penalty: float = 1.0, steps: int = 30) -> tuple[float, np.ndarray]:
    """Logistic regression on the logarithms of the sums, by Newton steps."""
    x = np.column_stack([np.ones(len(sums)), np.log1p(sums)])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - label) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        change = np.linalg.solve(hessian, gradient)
        w -= change
        if np.abs(change).max() < 1e-8:
            break
    return float(w[0]), w[1:]


def train(documents: DataFrame, labels: DataFrame, *, most_rows: int = 20_000) -> Model:
    from .storage import stored

    rows = stored(training_rows(documents, labels, most_rows), "toxicity-rows")
    lexicon = Lexicon.of(*learn_insults(rows))
    held = documents.sparkSession.sparkContext.broadcast(lexicon)

    def scan(batches):
        for batch in batches:
            label = kernel.ints(batch.column(1))
            for texts in kernel.text_slices(batch.column(0)):
                flat = outcome_sums(texts, held.value)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * (OUTCOMES + 1)), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([lists, pa.array(label[texts.first_row : texts.first_row + len(texts)])], ["sums", "label"])

    found = rows.mapInArrow(scan, "sums array<double>, label long").toPandas()  # at most most_rows rows
    if found["label"].nunique() < 2:
        return Model(lexicon, -3.0, DEFAULT_WEIGHTS)
    return Model(lexicon, *fit_weights(np.stack(found["sums"].to_numpy()), found["label"].to_numpy(np.float64)))


def score(documents: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text", folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_clauses_weight`` of every document."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for batch in batches:
            for texts in kernel.text_slices(batch.column(1)):
                sums = outcome_sums(texts, held.value.lexicon)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first_row, len(texts)), pa.array(held.value.scores(sums)), pa.array(sums[:, :OUTCOMES].sum(axis=1))], ["doc_id", "score", "clause_weight"])

    docs = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].alias("text"))
    scored = docs.mapInArrow(scan, "doc_id long, score double, clause_weight double")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clause_weight")


def remove_toxic(documents: DataFrame, labels: DataFrame, *, most_rows: int = 20_000) -> DataFrame:
    """The documents that the model does not call toxic, with their columns."""
    model = train(documents.select(documents["doc_id"], documents["text"]), labels, most_rows=most_rows)
    held = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("text")

    def scan(batches):
        for batch in batches:
            for texts in kernel.text_slices(batch.column(place)):
                keep = held.value.scores(outcome_sums(texts, held.value.lexicon)) < 0.5
                yield batch.slice(texts.first_row, len(texts)).filter(pa.array(keep))

    return documents.mapInArrow(scan, documents.schema)


def op7_pattern_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(documents, train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
