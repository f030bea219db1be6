"""Fill-in-the-middle, the audit of filter orders and min-max hashing against plain versions."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flightline.llm import fill_middle, filter_audit, kernel, minmax, overlaps

from .brute import ODD_TEXTS, PASSAGE, documents, words

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LONG = "word and another, \n" * 40_000 + " " * 100_000
MARKS = ["a\u0001b \u0002 \u0001\u0001 \u0002d \u0002e x\u0002d\u0001", "half <P> sentinel", "<S", "ends with <", "a <M", "\u0001", "\u0002e"]


# 11 ---------------------------------------------------------------------------------------------
def plain_cut(doc_id, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_markers_cut_as_a_plain_version_and_give_the_text_back(spark):
    texts = [*ODD_TEXTS, *MARKS, LONG] * 4  # other ids give other forms and ranks
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (None, PASSAGE)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "form", "marked", "a", "b", "output", "prefix")})
    done = fill_middle.transformed(docs)
    rows = done.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts) + 2 and len({r["form"] for r in rows}) == 3
    text_of = dict(enumerate(texts)) | {None: PASSAGE}
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_cut(r["doc_id"], text_of[r["doc_id"]])
        assert r["again"] == (text_of[r["doc_id"]] or "")
    assert fill_middle.transformed(docs.limit(0)).count() == 0


def test_markers_stay_in_one_stage_of_the_engine(spark):
    docs = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string")
    plan = fill_middle.transformed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Arrow" not in plan and "BatchEvalPython" not in plan


def test_other_sentinels_and_shares(spark):
    s = fill_middle.Sentinels("<|pre|>", "<|suf|>", "<|mid|>")
    docs = spark.range(300).select(F.col("id").alias("key"), F.concat(F.lit("w "), F.col("id").cast("string"), F.lit(" x y <P>")).alias("body"))
    done = fill_middle.transformed(docs, id_column="key", text_column="body", seed=7, percent=100, suffix_first=0, sentinels=s)
    back = done.select("doc_id", "form", fill_middle.restored(F.col("output"), F.col("form"), s).alias("t")).collect()
    assert {r["form"] for r in back} == {"psm"} and all(r["t"] == f"w {r['doc_id']} x y <P>" for r in back)


# 12 ---------------------------------------------------------------------------------------------
WORDS = st.text(alphabet="ab\x00é ", max_size=40)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), WORDS, st.just("x" * 300 + " " + "x" * 300 + " " + "x" * 299 + "y"), st.just("abcdefghi abcdefghj abcdefghi")), max_size=6))
def test_distinct_words_equal_a_set(texts):
    for part in kernel.text_slices(pa.array(texts, pa.string()), limit=60):
        got = filter_audit.distinct_words(kernel.split_words(part))
        own = texts[part.first_row : part.first_row + len(part)]
        assert got.tolist() == [len(set(words(t))) for t in own]


def test_words_that_share_a_hash_are_told_apart():
    part = next(kernel.text_slices(pa.array(["a b a c", "d d", "", "e f"])))
    w = kernel.split_words(part)
    assert filter_audit.distinct_words(w, np.zeros(len(w.start), np.uint64)).tolist() == [3, 1, 0, 2]


def plain_audit(docs, labels):
    """By going through the documents in every order."""
    firsts = {}
    for i, _, t in docs:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, lang, t in docs:
        t = t or ""
        w = words(t)
        own = set()
        own |= {"A"} if len(w) < 200 else set()
        own |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        own |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t) else set()
        own |= {"D"} if set(t) & set("#$%&*|") else set()
        own |= {"E"} if t in firsts and (i is None or firsts[t] < i) else set()
        fails.append((lang or "", own, i in good, i in toxic))
    out, shares = {}, Counter()
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, letter in enumerate(order):
                before = set(order[:k])
                left = [f for f in own if not f[1] & before]
                gone = [f for f in left if letter in f[1]]
                shares[part, letter] += len(gone)
                out[part, order, k + 1] = (len(left) - len(gone), len(gone), sum(letter in f[1] and bool(f[1] & before) for f in own), sum(f[1] == {letter} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone))
    return {(p, o, s): (*v, shares[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_equals_going_through_every_order(spark):
    varied = [" ".join(f"w{k}" for k in range(250)), " ".join(f"W{k}" for k in range(250)), "SHOUT # " * 150, "word " * 30_000, " ".join(f"w{k}" for k in range(250))]
    docs = documents(spark, [*ODD_TEXTS, *varied])
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 1), (14, 0, 0), (0, None, 1), (None, 1, 1), (999, 1, 1), (35, 1, None)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels).collect()
    expected = plain_audit([(r["doc_id"], r["lang"], r["text"]) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in got} == expected and len(got) == len(expected) == 2 * 600
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


# 13 ---------------------------------------------------------------------------------------------
def shingles(text, n=5):
    w = words(text, lower=True)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def plain_components(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and find(i) != find(j) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        ids = [x for x in (least.get(find(k)), i) if x is not None]
        least[find(k)] = min(ids) if ids else None
    return Counter((i, len(s), least[find(k)] if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def edited(rng, base, n):
    out = list(base)
    for at in rng.integers(0, len(base), n):
        out[at] = f"e{rng.integers(0, 10**9)}"
    return " ".join(out)


def near_texts(seed):
    """Groups of copies with edits, so that many pairs lie near the limit, under it and over it; some groups have no centre."""
    rng = np.random.default_rng(seed)
    texts = []
    for size, copies, most in ((60, 60, 3), (150, 40, 8), (400, 30, 20), (30, 20, 2)):
        base = [f"g{size}w{k}" for k in rng.integers(0, 500, size)]
        texts += [edited(rng, base, rng.integers(1, most + 1)) for _ in range(copies)]
    chain = [f"c{k}" for k in range(120)]
    for k in range(25):  # each near the next, the ends far apart
        chain = chain[2:] + [f"d{k}", f"f{k}"]
        texts.append(" ".join(chain))
    return texts


def checked(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("node", "band", "bands", "root", "a", "b", "least", "key", "shingles")})
    got = minmax.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize(("stretch", "block"), [(1000, 1024), (3, 8)])
def test_min_max_hashing_equals_all_pairs(spark, monkeypatch, stretch, block):
    monkeypatch.setattr(minmax, "STRETCH", stretch)
    monkeypatch.setattr(overlaps, "BLOCK_SETS", block)
    texts = [*ODD_TEXTS, *near_texts(stretch), "word and more words " * 15_000]
    rng = np.random.default_rng(1)
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    rows += [rows[3], rows[30], (None, rows[40][1]), (None, "alone without an id but with words"), (None, None), (rows[50][0], rows[60][1])]
    checked(spark, rows)


def test_min_max_hashing_of_nothing(spark):
    checked(spark, [])
    checked(spark, [(1, None), (2, ""), (None, " \n")])


def test_a_dense_group_without_links_is_decided_exactly(spark, monkeypatch):
    """Copies of one text under the limit of each other share most bands."""
    monkeypatch.setattr(overlaps, "BLOCK_SETS", 64)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(80)]
    checked(spark, [(k, edited(rng, base, 2)) for k in range(150)])


def test_ends_estimate_similarity_without_bias():
    rng = np.random.default_rng(0)
    both, own = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, (2, 50), dtype=np.uint64)
    low, high = minmax.ends(np.concatenate([both, own[0], both, own[1]]), np.array([0, 350, 700]), 256)
    share = np.mean(np.concatenate([low[:, 0] == low[:, 1], high[:, 0] == high[:, 1]]))
    assert abs(share - 300 / 400) < 0.06


def test_all_bands_of_a_pair_at_the_limit_hardly_miss():
    """Of 2,000 pairs at a similarity of 0.85 all share a band (one in 80,000 does not)."""
    rng = np.random.default_rng(7)
    missed = 0
    for _ in range(2000):
        both, own = rng.integers(0, 2**63, 170, dtype=np.uint64), rng.integers(0, 2**63, (2, 15), dtype=np.uint64)
        keys = minmax.band_keys(*minmax.ends(np.concatenate([both, own[0], both, own[1]]), np.array([0, 185, 370]), minmax.PERMUTATIONS), minmax.BANDS)
        missed += not (keys[0] == keys[1]).any()
    assert missed <= 1


def test_empty_documents_table_keeps_the_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert minmax.near_duplicates(empty).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def shuffled(spark):
    """Bytes written to shuffles so far."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_sets_are_exchanged_only_to_be_compared(spark, monkeypatch):
    """Pairs of near copies, each exchanged on both sides of the first join and on one more side of the second: three times all sets, with some room for the rest."""
    rng = np.random.default_rng(5)
    texts = []
    for pair in range(40):
        base = [f"p{pair}w{k}" for k in rng.integers(0, 10**6, 3000)]
        texts += [edited(rng, base, 2), edited(rng, base, 2)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    began = shuffled(spark)
    try:
        checked(spark, list(enumerate(texts)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert shuffled(spark) - began < 3.3 * len(texts) * 3000 * 8
