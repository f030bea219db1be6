"""The pipeline's stages against plain versions of what each must do, on small and on odd documents."""

import dataclasses
import dataclasses
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from flightline.llm import packing, simhash, toxicity

from .brute import ODD_TEXTS, PASSAGE, words
from .test_text_operators import repeats_of, spans_of, sums_of

STAGE = dict(corpus_pipeline.STAGES)
CLASHES = ("_later", "_leaked", "_mark", "_node", "_root", "_low", "_repeats_key", "_repeats_id", "node", "fp", "words", "anchor", "key", "region")


def rows_of():
    """Ids out of order, repeated and null; null, empty and very long texts; copies, near copies, shared passages, leaks and insults."""
    rng = np.random.default_rng(33)
    vocabulary = [f"word{k}" for k in range(2000)]
    fresh = lambda n: [vocabulary[k] for k in rng.integers(0, 2000, n)]
    texts = list(ODD_TEXTS)
    for _ in range(6):
        base = fresh(120)
        near = list(base)
        near[60] = "changed"
        texts += [" ".join(base), " ".join(near), " ".join(base)]
    shared = " ".join(fresh(40))
    texts += [f"{' '.join(fresh(20))} {shared} {' '.join(fresh(20))}" for _ in range(4)]
    texts += [f"{' '.join(fresh(30))} {ITEM} {' '.join(fresh(30))}" for _ in range(2)]
    texts.append(" ".join(fresh(60_000)))
    texts += [f"You are a worthless idiot and scum, you moron! {' '.join(fresh(5))}" for _ in range(3)]
    rows = [(37 * k % 211, t, "en" if k % 3 else None, f"s{k % 2}") for k, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, PASSAGE + " again", "en", None), (None, None, None, None), (rows[25][0], " ".join(fresh(50)), "en", "x")]
    return rows


ITEM = " ".join(f"bench{k}" for k in range(25))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(*r, len(r[1] or ""), *range(len(CLASHES))) for r in rows_of()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} int" for c in CLASHES)).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def stands_in(kept, before, misses=0):
    """Brute force of the near-copy stage: components by exact similarity, of which one row with the least id stays (``misses``: links that fingerprints may overlook)."""
    spelled = [tuple(words(t, True)) for _, t in before]
    sets = [{w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set() for w in spelled]
    # A text that stands under null ids alone links to its copies only.
    under = defaultdict(bool)
    for (i, _), w in zip(before, spelled, strict=True):
        under[w] |= i is not None
    root = list(range(len(before)))
    for i, j in itertools.combinations(range(len(before)), 2):
        few, many = sorted((len(sets[i]), len(sets[j])))
        alike = few >= 0.8 * many and under[spelled[i]] and under[spelled[j]] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0
        if spelled[i] == spelled[j] or alike:
            a, b = root[i], root[j]
            root = [b if x == a else x for x in root]
    groups = defaultdict(list)
    for k, r in enumerate(root):
        groups[r].append(before[k])
    least = [min((i for i, _ in g if i is not None), default=None) for g in groups.values()]
    assert len(groups) <= len(kept) <= len(groups) + misses
    for (_, g), low in zip(groups.items(), least, strict=True):
        own = [x for x in kept if x in g]
        assert any(x[0] == low for x in own)


def check(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = pairs(docs)
    # 7: the learned words and weights, read without the machine.
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{path}/labels.parquet"))
    insults, stems = toxicity.learn_insults(toxicity.training_rows(docs.select("doc_id", "text"), spark.read.parquet(f"{path}/labels.parquet"), 20_000))
    good = lambda t: model.scores(np.array([sums_of(t, (insults, stems))]))[0] < 0.5
    one = STAGE["toxicity"](spark, docs, path).cache()
    assert one.columns == docs.columns and pairs(one) == [x for x in before if good(x[1])]
    # 3
    two = STAGE["simhash_near_dedup"](spark, one, path).cache()
    assert two.columns == docs.columns
    stands_in(pairs(two), pairs(one))
    # 9
    three = STAGE["substring_dedup"](spark, two, path).cache()
    assert three.columns == docs.columns and three.where("n_chars <> char_length(text)").count() == 0
    expected = repeats_of(pairs(two))
    assert sorted(((i, len(words(t))) for i, t in pairs(three)), key=repr) == sorted(((i, n - gone) for i, n, gone, _ in expected), key=repr)
    # 1
    four = STAGE["decontamination"](spark, three, path).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    leaked = {s[0] for s in spans_of([x for x in pairs(three) if len(words(x[1])) < 5000], items)}
    assert four.columns == docs.columns and pairs(four) == [x for x in pairs(three) if x[0] not in leaked]
    # 10
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    five = STAGE["packing"](spark, four, path).collect()
    wanted = []
    for i, t in pairs(four):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        wanted += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in five), key=repr) == sorted(wanted, key=repr)
    sequences = defaultdict(list)
    for r in five:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048
    return before, pairs(one), pairs(two), pairs(three), pairs(four)


def test_stages_equal_brute_force_on_odd_rows(spark, folder):
    sizes = [len(x) for x in check(spark, folder)]
    assert all(a >= b for a, b in itertools.pairwise(sizes)) and sizes[0] > sizes[1] > sizes[2] and sizes[3] > sizes[4]


def test_stages_take_effect_on_the_small_documents(spark, sf):
    assert list(STAGE) == ["toxicity", "simhash_near_dedup", "substring_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = STAGE["toxicity"](spark, docs, sf).cache()
    two = STAGE["simhash_near_dedup"](spark, one, sf).cache()
    stands_in(pairs(two), pairs(one), 2)
    three = STAGE["substring_dedup"](spark, two, sf).cache()
    expected = repeats_of(pairs(two))
    assert sorted((i, len(words(t))) for i, t in pairs(three)) == sorted((i, n - gone) for i, n, gone, _ in expected)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {s[0] for s in spans_of([x for x in pairs(three) if len(words(x[1])) < 400], items)}
    four = {i for i, _ in pairs(STAGE["decontamination"](spark, three, sf))}
    assert not leaked & four and four <= {i for i, _ in pairs(three)}


def test_an_empty_table_goes_through(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0, name


def test_run_gives_what_the_stages_give(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_near_copies_at_the_limit_are_linked_whatever_a_bucket_holds(spark):
    """Pairs that share 80 to 90 % of their shingles, some only through a third text: all are found, in buckets of any size."""
    rng = np.random.default_rng(8)
    rows = []
    for group in range(40):
        size = int(rng.integers(150, 600))
        base = [f"w{k}" for k in rng.integers(0, 3000, size)]
        for _ in range(3):
            text = list(base)
            for at in rng.integers(0, size, size // int(rng.integers(90, 140))):
                text[at] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    found = []
    for large in (16_384, 2):
        scheme = dataclasses.replace(simhash.WIDE, large=large)
        root = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, shingle=5, scheme=scheme, least_similarity=0.8).collect()}
        assert sum(root[i] == root[j] for i, j in pairs) >= 0.95 * len(pairs) and len(pairs) > 60
        assert all(any(root[k] == root[i] and len(sets[k] & sets[i]) >= 0.8 * len(sets[k] | sets[i]) for k in root if k != i) for i in root if root[i] != i)
        found.append(root)
    assert found[0] == found[1]
