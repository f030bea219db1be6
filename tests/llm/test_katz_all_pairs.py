"""The registered Katz query keeps pairs counted once, under Katz's full formula."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from flightline.llm import katz

from .brute import ODD_TEXTS, collected, documents, words


def full_katz_of(texts, held_out):
    tokens = [[*words(t, True), None] for t in texts]
    one, two = Counter(), Counter()
    for t, out in zip(tokens, held_out, strict=True):
        if not out:
            one.update(t)
            two.update(zip(["<s>", *t[:-1]], t, strict=True))

    def katz_factors(counts):
        n = Counter(counts)
        common = 6 * n[6] / n[1] if n[1] else 0.0
        d = {}
        for r in range(1, 6):
            raw = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
            value = (raw - common) / (1 - common) if common < 1 else 0.0
            d[r] = value if 0 < value <= 1 else (r - 0.5) / r
        return d

    d1, d2 = katz_factors(one.values()), katz_factors(two.values())
    n = sum(one.values())
    cut = lambda c, d: c * d.get(c, 1.0)
    left = n - sum(cut(c, d1) for c in one.values())
    mass = n if left > 0 else n + 1
    p = lambda w: cut(one[w], d1) / mass if w in one else (left if left > 0 else 1) / mass
    history, kept, likely = Counter(), Counter(), Counter()
    for (v, w), c in two.items():
        history[v] += c
        kept[v] += cut(c, d2)
        likely[v] += p(w)
    total = {v: c if c - kept[v] > 1e-9 * c else c + 1 for v, c in history.items()}
    alpha = {v: (1 - kept[v] / total[v]) / (1 - likely[v]) for v in history}
    return [sum(math.log10(cut(two[v, w], d2) / total[v] if (v, w) in two else alpha.get(v, 1.0) * p(w)) for v, w in zip(["<s>", *t[:-1]], t, strict=True)) for t in tokens]


def test_the_query_scores_with_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(4)
    weights = 1 / np.arange(1, 301)
    texts = [" ".join(f"w{k}" for k in rng.choice(300, rng.integers(1, 60), p=weights / weights.sum())) for _ in range(80)] + ODD_TEXTS
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    order = lambda r: repr((r[0], r[1], round(r[2], 6)))
    expected = sorted(((i, h, x) for (i, _), h, x in zip(rows, held, full_katz_of([t for _, t in rows], held), strict=True)), key=order)
    got = sorted(collected(katz.op5_katz_backoff(spark, str(tmp_path)), "doc_id", "held_out", "score"), key=order)
    assert [r[:2] for r in got] == [r[:2] for r in expected]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in expected])
