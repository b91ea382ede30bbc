"""Near copies at other shingles and similarities than those of op 4, against brute force."""

import os
import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tempora.llm import jaccard_join, quality  # noqa: E402
from tempora.llm.shared import written  # noqa: E402

from .test_brute_force import SF, lower, near_copies  # noqa: E402


def shingles(text, n):
    w = lower(text or "").split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def least_linked(rows, words, percent):
    """Id -> least id that links lead to."""
    sets = [shingles(t, words) for _, t in rows]
    label = list(range(len(rows)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for i, s in enumerate(sets):
        for j in range(i):
            if s and min(len(s), len(sets[j])) * 100 >= percent * max(len(s), len(sets[j])) and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("words, percent", [(5, 80), (2, 60)])
def test_components(spark, words, percent):
    rows = near_copies()
    want = least_linked(rows, words, percent)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, words=words, percent=percent).collect()}
    assert got == want


def test_signatures_lose_no_pair_at_80():
    rnd = random.Random(9)
    met = 0
    for _ in range(400):
        n = rnd.choice([6, 9, 12, 19, 26, 40, 90, 300])
        words = [f"v{rnd.randrange(10**9)}" for _ in range(n + 4)]
        other = list(words)
        for _ in range(rnd.randint(1, max(1, n // 40))):
            other[rnd.randrange(len(other))] = f"u{rnd.randrange(10**9)}"
        other = other[: len(other) - rnd.choice([0, 0, 1, n // 12])]
        a, b = shingles(" ".join(words), 5), shingles(" ".join(other), 5)
        if 100 * len(a & b) < 80 * len(a | b) or a == b:
            continue
        met += 1
        sigs = []
        for t in (words, other):
            raw = " ".join(t).encode()
            sigs.append({int(x) for _, s in jaccard_join.Sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 5).signatures(80) for x in s})
        assert sigs[0] & sigs[1]
    assert met > 100


def test_stage_drops_documents_that_differ_in_two_words(spark):
    words = [f"w{i}" for i in range(100)]
    other = ["x" if i in (30, 70) else w for i, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "something else")], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    assert sorted(r.doc_id for r in stage(spark, df, "").collect()) == [1, 3]
    assert sorted(r.doc_id for r in jaccard_join.drop_near_copies(df).collect()) == [1, 2, 3]  # op 4: three words, 90 percent


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stage_against_brute_force(spark):
    docs = written(quality.quality_filter(spark.read.parquet(f"{SF}/documents.parquet")))
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    assert {r.doc_id for r in stage(spark, docs, SF).collect()} == {c for c in least_linked(rows, 5, 80).values()}
