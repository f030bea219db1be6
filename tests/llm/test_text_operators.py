import bisect
import hashlib
import itertools
import math
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from flightline.llm import decontaminate, divergence, kernel, katz, packing, prefix_counts, repeats, simhash, toxicity

from .brute import ODD_TEXTS, PASSAGE, collected, documents, words

TEXT = st.text(alphabet="ab \n\té€'1.|A", max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_of_a_slice_are_the_words(texts):
    found = []
    for part in kernel.text_slices(pa.array(texts, pa.string()), limit=40):
        w = kernel.split_words(part)
        for k in range(len(part)):
            found.append([w.data[a:b].tobytes().decode() for a, b in zip(w.start[w.doc == k], w.end[w.doc == k], strict=True)])
    assert found == [words(t) for t in texts]


def test_equal_spans_have_equal_hashes_and_others_do_not():
    data = np.frombuffer(b"abc xabc abd", np.uint8)
    h = kernel.span_hashes(data, np.array([0, 5, 9, 12]), np.array([3, 8, 12, 12]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3


# 1 ----------------------------------------------------------------------------------------------
def test_masks_find_every_window_with_two_substitutions():
    for bad in itertools.combinations(range(13), 2):
        assert any(not any(at + p in bad for p in mask) for mask in decontaminate.MASKS for at in range(13 - mask[-1]))


def test_every_allowed_substitution_in_short_items_leaves_a_seed():
    for size in range(1, 14):
        most = size - math.ceil(11 * size / 13)
        masks = decontaminate.masks_for(size, 13, 11)
        for bad in itertools.combinations(range(size), most):
            assert any(not any(at + p in bad for p in places) for _, span, places in masks for at in range(size - span + 1)), (size, bad)


def spans_of(docs, items, window=13, need=11):
    """All diagonals, token by token."""
    tokens = lambda t: [x for x in (w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in words(t, lower=True)) if x]
    found = set()
    for i, text in docs:
        d = tokens(text)
        for j, item in items:
            t = tokens(item)
            size = min(window, len(t))
            least = math.ceil(need * size / window)
            for diagonal in range(-len(t) + 1, len(d)) if t else ():
                low, high = max(0, -diagonal), min(len(t), len(d) - diagonal)
                equal = [t[k] == d[k + diagonal] for k in range(low, high)]
                inside = [False] * len(equal)
                for k in range(len(equal) - size + 1):
                    if sum(equal[k : k + size]) >= least:
                        inside[k : k + size] = [True] * size
                for k in range(len(equal)):
                    if inside[k] and (k == 0 or not inside[k - 1]):
                        n = next((m for m in range(k, len(equal)) if not inside[m]), len(equal)) - k
                        found.add((i, j, low + k + diagonal, low + k, n, sum(equal[k : k + n])))
    return found


def test_decontamination_equals_brute_force_for_items_of_every_length(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{k}" for k in range(60)]
    items, docs = [], []
    for size in [*range(1, 16), 30]:
        item = [vocabulary[k] for k in rng.integers(0, 60, size)]
        items.append((size, " ".join(item)))
        for _ in range(3):
            text = [vocabulary[k] for k in rng.integers(0, 60, 20)]
            copy = list(item)
            for k in rng.integers(0, size, rng.integers(0, 3)):
                copy[k] = "other"
            at = int(rng.integers(0, 20))
            docs.append((len(docs), " ".join([*text[:at], *copy, *text[at:]])))
    items.append((99, None))
    got = decontaminate.contaminated_spans(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {tuple(r) for r in got} == spans_of(docs, items) and len(got) == len(spans_of(docs, items))


def test_decontamination_tolerates_substitutions_and_leaves_clean_documents(spark):
    w = PASSAGE.split()
    changed = [*w[:4], "CAT", *w[5:9], "and", *w[10:]]
    texts = [None, "", f"start {PASSAGE} end", " ".join(changed), " ".join(x[::-1] for x in w), " ".join(w[:7]), "other words " * 40, f"({PASSAGE.title()}!)", " ".join(w[::2])]
    docs = documents(spark, texts, extra=False)
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "too short"), (1, PASSAGE)], "item_id long, text string")
    spans = decontaminate.contaminated_spans(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in spans} == {(14, 1), (21, 1), (49, 1)} and spans
    assert all(r["n_equal"] >= 11 * r["n_tokens"] // 13 for r in spans)
    kept = decontaminate.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(texts) - 3
    assert decontaminate.contaminated_spans(docs.limit(0), items).count() == 0 and decontaminate.contaminated_spans(docs, items.limit(0)).count() == 0


def test_a_long_text_of_equal_words_and_items_of_one_template(spark):
    """Every place of the text meets every place of the items: a row for each item, and every overlap is there."""
    head = "please answer the question that follows in one word and say why you think so"
    items = spark.createDataFrame([(k, f"{head} {k} {'x' * (k % 7)} end{k}") for k in range(300)] + [(1000, "word " * 13), (1001, "word " * 13), (None, "word " * 13)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "word " * 20_000), (2, f"before {head} 7 end7"), (3, f"{head} 299 end299 " * 3), (4, "nothing of it")], "doc_id long, text string")
    spans = decontaminate.contaminated_spans(docs, items).collect()
    long = [r for r in spans if r["doc_id"] == 1]
    assert {r["item_id"] for r in long} == {1000, 1001, None} and len(long) == 3 * 19_988 and all(r["n_tokens"] == r["n_equal"] == 13 for r in long)
    assert {r["item_id"] for r in spans if r["doc_id"] == 2} == set(range(300)) and not any(r["doc_id"] == 4 for r in spans)
    assert decontaminate.remove_contaminated(docs, items).select("doc_id").collect()[0][0] == 4


# 2 ----------------------------------------------------------------------------------------------
def base_of(text):
    w = words(text)
    threes = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_base_counts_equal_brute_force(spark):
    got = divergence.judge(documents(spark))
    expected = sorted(((i, *base_of(t)) for i, t in collected(documents(spark), "doc_id", "text")), key=repr)
    assert collected(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == expected
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert divergence.judge(documents(spark).limit(0)).count() == 0


def test_quality_distances_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    plain = [" ".join(rng.choice(["the", "of", "and", "sea", "stone", "tree"], 120)) for _ in range(20)]
    junk = [" ".join(rng.choice(["$$$", "%%%", "||"], 120)) + " QX" * 60]
    docs = documents(spark, plain + junk, extra=False).drop("lang").selectExpr("*", "'en' as lang")
    rows = {r["doc_id"]: r for r in divergence.judge(docs).collect()}
    share = Counter(w.strip("$%|") for t in plain + junk for w in words(t, True))
    del share[""]
    total = sum(share.values())
    common = sorted(w for w, n in share.items() if n >= 0.002 * total)
    for r in docs.collect():
        own = Counter(w.strip("$%|") for w in words(r["text"], True))
        del own[""]
        p = [own[w] / max(1, sum(own.values())) for w in common] + [sum(n for w, n in own.items() if w not in common)]
        q = [share[w] / total for w in common] + [0]
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)  # noqa: B023, E731
        assert rows[r["doc_id"]]["word_distance"] == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2), abs=1e-9)
    verdict = [rows[7 * k % 101]["kept"] for k in range(len(plain + junk))]
    assert not verdict[-1]


# 3 ----------------------------------------------------------------------------------------------
def fingerprint_of(text):
    w = words(text, True)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def component_of(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn"], 60)) for _ in range(25)]
    near = [" ".join([*t.split()[:-1], "zz"]) for t in base for _ in range(2)]
    docs = documents(spark, base + near + ODD_TEXTS[:8], extra=False)
    prints = {r["doc_id"]: fingerprint_of(r["text"]) for r in docs.collect()}
    component = component_of(prints)
    expected = sorted(((i, f"{p:016x}", component[i]) for i, p in prints.items()), key=repr)
    assert collected(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expected
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(component.values()))


def test_near_duplicates_of_odd_and_empty_tables(spark):
    docs = documents(spark)
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_one_row_of_each_component_stays_under_null_and_repeated_ids(spark):
    other = " ".join(f"z{k}" for k in range(30))
    rows = [(5, PASSAGE, 1), (5, PASSAGE, 2), (9, PASSAGE, 3), (None, PASSAGE, 4), (3, other, 5), (3, PASSAGE[::-1], 6), (8, other, 7), (None, "alone here", 8), (None, "alone here", 9), (None, "", 10), (12, None, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _mark int")
    for options in ({}, {"shingle": 5, "scheme": simhash.WIDE, "least_similarity": 0.8}):
        kept = simhash.keep_one(docs, **options)
        assert kept.columns == docs.columns
        got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
        assert got == sorted([(5, PASSAGE), (3, other), (3, PASSAGE[::-1]), (None, "alone here"), (12, None)], key=repr)


def jaccard(a, b, shingle=5):
    sets = []
    for t in (a, b):
        w = words(t, True)
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_wide_fingerprints_find_texts_that_share_their_shingles(spark):
    rng = np.random.default_rng(21)
    base = [[f"w{k}" for k in rng.integers(0, 3000, 150)] for _ in range(60)]
    texts = []
    for k, w in enumerate(base):
        texts.append(" ".join(w))
        for changes in (1, 2, 3) if k % 2 else (8, 20):
            copy = list(w)
            for at in rng.choice(150, changes, replace=False):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, shingle=5, scheme=simhash.WIDE, least_similarity=0.8).collect()}
    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if jaccard(texts[i], texts[j]) >= 0.8]
    linked = sum(found[i] == found[j] for i, j in near)
    assert len(near) > 80 and linked >= 0.9 * len(near)
    root = {i: i for i in range(len(texts))}
    for i, j in near:
        for k in [k for k in root if root[k] == root[j]]:
            root[k] = root[i]
    assert all(root[i] == root[j] for i, j in found.items())  # nothing is linked that exact similarity does not link


def test_least_spanning_forests(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng = np.random.default_rng(2)
    for _ in range(60):
        base = rng.integers(0, 2**63, (int(rng.integers(1, 4)), 2), dtype=np.uint64)
        fps = base[rng.integers(0, len(base), int(rng.integers(2, 40)))].copy()
        for row in fps:
            for bit in rng.integers(0, 128, rng.integers(0, 9)):
                row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        ask = rng.random(len(fps)) < 0.6
        queries, members = np.flatnonzero(ask), np.flatnonzero(~ask)
        name = {i: tuple(fps[i].tolist()) for i in range(len(fps))}
        d = lambda i, j: int(np.bitwise_count(fps[i] ^ fps[j]).sum())  # noqa: B023, E731
        edges = sorted({(d(i, j), *sorted((name[i], name[j]))) for i in queries for j in members if 0 < d(i, j) <= 12})
        root = {v: v for v in name.values()}

        def find(x):
            while root[x] != x:  # noqa: B023
                x = root[x]  # noqa: B023
            return x

        total = []
        for weight, x, y in edges:
            if find(x) != find(y):
                root[find(x)] = find(y)
                total.append(weight)
        x, y = simhash._forest(fps, queries, members, 12)
        assert sorted(d(i, j) for i, j in zip(x, y, strict=True)) == sorted(total)


SCHEMES = [simhash.NARROW, simhash.Scheme(large=0), simhash.Scheme(bits=128, partitions=16, radius=15, most=1), simhash.Scheme(partitions=8, radius=5, most=2, large=1)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=20), st.integers(0, 2**32), st.sampled_from(SCHEMES))
def test_probes_meet_every_link(fps, seed, scheme):
    rng = np.random.default_rng(seed)
    wide = rng.integers(0, 2**63, (len(fps), scheme.bits // 64), dtype=np.uint64)
    wide[:, 0] = fps
    near = wide.copy()
    for row in near:
        for bit in rng.integers(0, scheme.bits, scheme.radius):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    every = np.unique(np.concatenate([wide, near]), axis=0)
    order = rng.permutation(scheme.bits)
    counts = np.zeros((scheme.partitions, 1 << scheme.width))
    parts = simhash.parts_of(every, order, scheme)
    for p in range(scheme.partitions):
        np.add.at(counts[p], parts[:, p], 1)
    tables = simhash.candidate_tables(counts, scheme)
    thresholds = simhash.allocate(parts, tables, scheme)
    assert (thresholds.sum(axis=1) == scheme.radius - scheme.partitions + 1).all() and thresholds.max() <= scheme.most
    keys, owner, asks = simhash.probes_of(every, order, counts, tables, scheme)
    members, queries = defaultdict(set), defaultdict(set)
    for k, o, a in zip(keys.tolist(), owner.tolist(), asks.tolist(), strict=True):
        (queries if a else members)[k].add(o)
    met = {frozenset((a, b)) for k in queries for a in queries[k] for b in members[k]}
    for a, b in itertools.combinations(range(len(every)), 2):
        if np.bitwise_count(every[a] ^ every[b]).sum() <= scheme.radius:
            assert frozenset((a, b)) in met


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200 + k) for k in range(50)] + [(5, 5)]
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(1, 61)) and all(found[200 + k] == 100 for k in range(50))


# 5 ----------------------------------------------------------------------------------------------
def katz_of(texts, held_out, least):
    tokens = [[*words(t, True), None] for t in texts]
    one, two = Counter(), Counter()
    for t, out in zip(tokens, held_out, strict=True):
        if not out:
            one.update(t)
            two.update(zip(["<s>", *t[:-1]], t, strict=True))
    n = sum(one.values())
    d1, d2 = katz.good_turing(dict(Counter(one.values()))), katz.good_turing(dict(Counter(two.values())), least)
    cut = lambda c, d: c * (d[c] if c <= 5 else 1.0)
    left = n - sum(cut(c, d1) for c in one.values())
    mass = n if left > 0 else n + 1
    unknown = (left if left > 0 else 1) / mass
    p = lambda w: cut(one[w], d1) / mass if w in one else unknown
    history, kept, likely = Counter(), Counter(), Counter()
    for (v, w), c in two.items():
        history[v] += c
        if c >= least:
            kept[v] += cut(c, d2)
            likely[v] += p(w)
    total = {v: c if c - kept[v] > 1e-9 * c else c + 1 for v, c in history.items()}
    alpha = {v: (1 - kept[v] / total[v]) / (1 - likely[v]) for v in history}
    for v in history:
        assert kept[v] / total[v] + alpha[v] * (1 - likely[v]) == pytest.approx(1)
    out = []
    for t in tokens:
        s = sum(math.log10(cut(two[v, w], d2) / total[v] if two.get((v, w), 0) >= least else alpha.get(v, 1.0) * p(w)) for v, w in zip(["<s>", *t[:-1]], t, strict=True))
        out.append((len(t), sum(w in one for w in t), n, sum(math.log10((one[w] + 0.5) / (n + 0.5 * (len(one) + 1))) for w in t), s))
    return out


@pytest.mark.parametrize(("least", "bucket_tokens"), [(1, 1 << 20), (2, 1 << 20), (1, 40)])
def test_katz_scores_equal_brute_force(spark, monkeypatch, least, bucket_tokens):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", bucket_tokens)
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e", "f"], rng.integers(1, 40), p=[0.4, 0.3, 0.1, 0.1, 0.05, 0.05])) for _ in range(60)] + ODD_TEXTS
    docs = documents(spark, texts)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    expected = sorted(((i, h, *x) for (i, _), h, x in zip(rows, held, katz_of([t for _, t in rows], held, least), strict=True)), key=repr)
    got = collected(katz.katz_scores(docs, least_pair=least), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    expected = sorted(expected, key=lambda r: repr((r[0], r[2], round(r[6], 6))))
    got = sorted(got, key=lambda r: repr((r[0], r[2], round(r[6], 6))))
    for a, b in zip(expected, got, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("katz_")]


def test_katz_without_rows_or_training(spark):
    assert katz.katz_scores(documents(spark).limit(0)).count() == 0
    only = spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1), "a b")], "doc_id long, text string")
    row = katz.katz_scores(only).first()
    assert row["held_out"] and row["n_tokens"] == 3 and row["n_known"] == 0 and row["train_tokens"] == 0 and math.isfinite(row["score"])


# 7 ----------------------------------------------------------------------------------------------
def sums(text):
    lexicon = toxicity.Lexicon.of(dict.fromkeys(toxicity.INSULTS, 2.0), {b"ninny": 3.0})
    (part,) = kernel.text_slices(pa.array([text]))
    return toxicity.outcome_sums(part, lexicon)[0]


@pytest.mark.parametrize(
    "text,stands,target,report,weight",
    [("you idiot.", 1, 1, 0, 2.0), ("an idiot", 1, 0, 0, 2.0), ("you are not an idiot", 0, 1, 0, 2.0), ("he said you idiot!", 1, 1, 1, 2.0), ("ninnyhammer", 1, 0, 0, 3.0), ("not that one but you idiot", 1, 1, 0, 2.0)],
)
def test_clause_outcomes(text, stands, target, report, weight):
    s = sums(text)
    assert s[(stands * 2 + target) * 2 + report] == weight and s[: toxicity.OUTCOMES].sum() == weight


def test_clauses_do_not_leak_into_each_other():
    assert sums("not here. you idiot")[(2 + 1) * 2] == 2.0
    assert sums("kill you")[((2 + 1) * 2 + 1) * 2] == 1.0
    assert sums("a calm sentence about nothing")[: toxicity.OUTCOMES].sum() == 0


def test_toxicity_learns_from_the_training_fold_and_holds_on_the_other(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.train(docs.select("doc_id", "text"), labels)).join(labels, "doc_id").toPandas()
    out = scored[scored.held_out]
    assert ((out.predicted == 1) & (out.toxic == 0)).sum() <= 0.02 * len(out)
    assert ((out.predicted == 1) & (out.toxic == 1)).sum() >= 0.6 * (out.toxic == 1).sum()


def sums_of(text, lexicon):
    """The grammar read off clause by clause, without a machine: per outcome the sum of its clauses' weights, and the clauses."""
    strip = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    fold = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in w)
    closed = {}
    for symbol, listed in ((toxicity.THREAT, toxicity.THREATS), (toxicity.TARGET, toxicity.TARGETS), (toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.REPORT, toxicity.REPORTS)):
        closed |= dict.fromkeys(listed, symbol)
    insults, stems = lexicon

    def symbol_of(word):
        own, weight = toxicity.OTHER, 0.0
        raw = word.encode()
        for stem, w in stems.items():
            if raw.startswith(stem):
                own, weight = toxicity.INSULT, max(weight, w)
        if word in closed:
            own, weight = closed[word], max(weight, 1.0)
        elif word in insults:
            own, weight = toxicity.INSULT, max(weight, insults[word])
        return own, weight

    clauses, current = [], []
    for line in (text or "").split("\n"):
        for raw in words(line):
            inner = raw.lstrip(strip).rstrip(strip)
            tail = raw[len(raw.rstrip(strip)) :]
            current.append(symbol_of(fold(inner)))
            if any(c in ".!?;" for c in (tail if inner else raw)):
                clauses.append(current)
                current = []
        if current:
            clauses.append(current)
            current = []
    out = [0.0] * toxicity.OUTCOMES
    for clause in clauses:
        reach, insult, threat, target, report, total = 0, 0, 0, 0, 0, 0.0
        for symbol, weight in clause:
            standing = 1 if reach else 2
            if symbol == toxicity.INSULT:
                insult, total = max(insult, standing), total + weight
            elif symbol == toxicity.THREAT:
                threat, total = max(threat, standing), total + weight
            target |= symbol == toxicity.TARGET
            report |= symbol == toxicity.REPORT
            reach = toxicity.NEGATION_REACH if symbol == toxicity.NEGATION else max(0, reach - 1)
        if insult or threat:
            offence = 2 if insult and threat else 1 if threat else 0
            out[((offence * 2 + (max(insult, threat) == 2)) * 2 + target) * 2 + report] += total
    return [*out, float(len(clauses))]


def test_scores_equal_a_reading_of_the_grammar_without_machines(spark, sf):
    lexicon = {"idiot": 3.0, "scum": 2.0}, {b"moro": 2.5, b"stup": 1.5}
    made = toxicity.Lexicon.of(*lexicon)
    rng = np.random.default_rng(17)
    pool = ["you", "are", "an", "idiot", "idiot.", "not", "scum!", "morons", "stupid;", "kill", "said", "he", "the", "DU", "Étrangler", "never", "...", "a.b", "(moron)", "ok\n", "\n"]
    texts = [" ".join(rng.choice(pool, rng.integers(0, 60))) for _ in range(200)] + ODD_TEXTS + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    got = np.concatenate([toxicity.outcome_sums(part, made) for part in kernel.text_slices(pa.array(texts, pa.string()))])
    assert np.allclose(got, np.array([sums_of(t, lexicon) for t in texts]))
    model = toxicity.Model(made, -1.0, np.linspace(-0.5, 1.0, toxicity.OUTCOMES + 1))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for k, t in enumerate(texts):
        assert score[k] == pytest.approx(1 / (1 + math.exp(1.0 - float(np.log1p(sums_of(t, lexicon)) @ model.weights))))


def test_toxicity_of_odd_tables(spark):
    docs = documents(spark)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(7 * k % 101, 1, int(k == 16)) for k in range(17)] + [(None, 1, 1), (0, 1, None)], "doc_id long, quality int, toxic int")
    for labels in (empty, some):
        model = toxicity.train(docs.select("doc_id", "text"), labels)
        scored = toxicity.score(docs, model)
        assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
        assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.remove_toxic(docs, some).columns == docs.columns


# 8 ----------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def byte_bpe():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_prefix_counts_equal_the_library_at_every_prefix(spark, byte_bpe):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(byte_bpe)
    docs = documents(spark, [t if t is None else t[:300] for t in ODD_TEXTS])
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    for r in prefix_counts.prefix_table(docs, byte_bpe).collect():
        text = next(t for t in texts[r["doc_id"]] if len(t.encode()) == r["n_bytes"])
        counts = prefix_counts.counts_of(r["prefix_deltas"])
        assert counts.tolist() == [count(text[:k]) for k in range(len(text) + 1)] and r["n_tokens"] == count(text)
        for budget in (0, 1, 5):
            assert prefix_counts.fit(r["prefix_deltas"], budget) == max(k for k in range(len(text) + 1) if counts[k] <= budget)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abcdeThrnis' \n\té=1.", max_size=25))
def test_prefix_counts_of_random_pieces(text):
    import public_tokenizers

    counter, table = prefix_counts._table(public_tokenizers.path("byte_bpe_50k.json"))
    (part,) = kernel.text_slices(pa.array([text]))
    start, end, _ = prefix_counts.pieces(part)
    at, size = table.look_up(part.data, start, end, kernel.span_hashes(part.data, start, end))
    assert np.cumsum(table.gather(at, size)).tolist() == counter.whole([text[:k] for k in range(1, len(text) + 1)])


# 9 ----------------------------------------------------------------------------------------------
def repeats_of(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, math.inf), math.inf if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < (math.inf if i is None else i) for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    alphabet = [f"w{k}" for k in range(40)]
    pool = [" ".join(rng.choice(alphabet, 30)) for _ in range(6)]
    texts = [" ".join([*rng.choice(alphabet, rng.integers(0, 20)), pool[rng.integers(6)], *rng.choice(alphabet, 5), pool[rng.integers(6)][: rng.integers(20, 80)]]) for _ in range(40)]
    docs = documents(spark, texts + ODD_TEXTS)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert collected(repeats.deduplicate(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == repeats_of(rows)
    cut = repeats.remove_repeats(docs)
    assert cut.columns == docs.columns
    kept = sorted(((r["doc_id"], hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest()) for r in cut.collect()), key=repr)
    assert kept == sorted(((i, h) for i, _, _, h in repeats_of(rows)), key=repr)
    assert repeats.deduplicate(docs.limit(0)).count() == 0


def test_small_and_busy_shards_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_WINDOWS", 3)
    monkeypatch.setattr(repeats, "SHARD_REGIONS", 4)
    monkeypatch.setattr(repeats, "BUSY_REGIONS", 2)
    docs = documents(spark, [f"{a} {PASSAGE} {b}" for a in "abcdef" for b in "uvw"], extra=False)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert collected(repeats.deduplicate(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == repeats_of(rows)


# 10 ---------------------------------------------------------------------------------------------
def test_packing_holds_every_id_in_order(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    library = Tokenizer.from_file(path)
    docs = documents(spark)
    rows = packing.pack(docs, path, capacity=256).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)]).tolist()]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 256
    expected = []
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            expected.append((r["doc_id"], k // 256, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == sorted(expected, key=repr)
    assert packing.pack(docs.limit(0), path).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), min_size=1, max_size=20))
def test_plans_hold_all_pieces_in_few_sequences(counts):
    chosen = packing.plan(counts, 64)
    held = Counter()
    for config, n in chosen.items():
        assert sum(k * c for k, c in config) <= 64
        for k, c in config:
            held[k] += c * n
    assert held == Counter(counts)
    assert sum(chosen.values()) <= sum(packing.best_fit(Counter(counts), 64).values())


def piece_by_piece(counts, capacity):
    rooms, n = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            k = bisect.bisect_left(rooms, length)
            n += k == len(rooms)
            room = rooms.pop(k) if k < len(rooms) else capacity
            bisect.insort(rooms, room - length)
    return n


def test_best_fit_on_counts_is_best_fit_and_plans_never_lose_to_it():
    rng = np.random.default_rng(7)
    for _ in range(300):
        counts = Counter({int(k): int(rng.integers(1, 200)) for k in rng.integers(1, 65, rng.integers(1, 20))})
        fitted = packing.best_fit(counts, 64)
        held = Counter()
        for config, n in fitted.items():
            assert sum(k * c for k, c in config) <= 64
            for k, c in config:
                held[k] += c * n
        assert held == counts and sum(fitted.values()) == piece_by_piece(counts, 64)
        assert sum(packing.plan(counts, 64).values()) <= sum(fitted.values())
    hard = Counter({6: 181, 41: 109, 45: 65, 8: 158})
    assert sum(packing.plan(hard, 64).values()) <= piece_by_piece(hard, 64)


def test_plan_works_on_counts_not_pieces():
    began = time.perf_counter()
    assert packing.plan({1200: 10**9}, 2048) == Counter({((1200, 1),): 10**9})
    assert packing.plan({}, 2048) == Counter()
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("most", [10**6, 0])
def test_rows_without_listed_ids_whether_broadcast_or_by_a_bitmap(spark, monkeypatch, most):
    from flightline.llm import bitmap

    monkeypatch.setattr(bitmap, "BROADCAST_IDS", most)
    rows = spark.createDataFrame([(k % 50 if k % 11 else None, f"text {k}", k) for k in range(300)], "doc_id long, text string, _id_of int")
    ids = spark.createDataFrame([(3,), (7,), (None,), (10**12,)], "gone long")
    kept = bitmap.without(rows, "doc_id", ids)
    assert kept.columns == rows.columns and sorted(r["_id_of"] for r in kept.collect()) == [k for k in range(300) if k % 11 and k % 50 not in (3, 7)]
    untouched, touched = bitmap.parted(rows, "doc_id", ids)
    assert untouched.count() + touched.count() == 300 and touched.where("doc_id is null").count() == 28 and untouched.where("doc_id in (3, 7)").count() == 0
