"""SuperMinHash signatures against the algorithm step by step, and groups against brute force."""

import os
import random

import numpy as np
import pytest

from tempora.llm import jaccard_join, queries, superminhash
from tempora.llm import textops as T

from .test_brute_force import SF, near_copies
from .test_near_copies import least_linked, shingles


def one_by_one(elements, m):
    """The signature of one set by an explicit shuffle of each element."""
    out = [2**64 - 1] * m
    for e in elements:
        order = list(range(m))
        for j in range(m):
            x = int(T.mix(np.array([e], np.uint64) + T.U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))[0])
            k = j + ((x >> 32) * (m - j) >> 32)
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(out[order[j]], j << 32 | x & 0xFFFFFFFF)
    return out


def test_signatures_equal_the_shuffle_of_each_element():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 5, 0, 40, 300]
    grams = rng.integers(0, 2**63, sum(sizes), dtype=np.uint64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    got = superminhash.signatures(grams, doc, len(sizes), 32)
    for d in range(len(sizes)):
        assert got[d].tolist() == one_by_one(grams[doc == d].tolist(), 32)


def test_estimates_are_unbiased_and_vary_less_than_independent_minima():
    rng = np.random.default_rng(4)
    m, n, common = 64, 20, 12
    got = []
    for _ in range(1500):
        g = rng.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
        both = np.concatenate([g[:n], g[n - common :]])
        x, y = superminhash.signatures(both, np.repeat([0, 1], n), 2, m)
        got.append(superminhash.similarity(x, y))
    j = common / (2 * n - common)
    assert abs(np.mean(got) - j) < 0.006
    assert np.var(got) < 0.75 * j * (1 - j) / m


def test_bands_lose_no_pair_at_the_threshold():
    rnd = random.Random(9)
    met = 0
    for _ in range(1500):
        n = rnd.choice([5, 6, 9, 12, 19, 26, 40, 90, 300])
        words = [f"v{rnd.randrange(10**9)}" for _ in range(n + 1)]
        other = list(words)
        for _ in range(rnd.randint(1, max(1, n // 18))):
            other[rnd.randrange(len(other))] = f"u{rnd.randrange(10**9)}"
        other = other[: len(other) - rnd.choice([0, 1, 1, n // 12])]
        a, b = shingles(" ".join(words), 2), shingles(" ".join(other), 2)
        if 100 * len(a & b) < 80 * len(a | b) or a == b:
            continue
        met += 1
        raw = [" ".join(t).encode() for t in (words, other)]
        offs = np.cumsum([0, *(len(r) for r in raw)])
        doc, sig = next(superminhash.band_keys(jaccard_join.Sets(np.frombuffer(b"".join(raw), np.uint8), offs, 2), 80))
        assert set(sig[doc == 0].tolist()) & set(sig[doc == 1].tolist())
    assert met > 400


@pytest.mark.parametrize("words, percent", [(2, 80), (5, 80)])
def test_groups_against_brute_force(spark, words, percent):
    rows = [*near_copies(), *((5000 + i, "the same words again and again") for i in range(40))]
    want = least_linked(rows, words, percent)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in superminhash.near_duplicates(df, words=words, percent=percent).collect()}
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.kept == (r.component_id == d) and r.n_shingles == len(shingles(dict(rows)[d], words)) for d, r in got.items())
    kept = superminhash.drop_near_duplicates(df.selectExpr("*", "1 as gone", "2 as _gone"), words=words, percent=percent)
    assert kept.columns == ["doc_id", "text", "gone", "_gone"] and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_union_find_over_tasks(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    label = superminhash.UnionFind()
    for a, b in pairs:
        label.join(a, b)
    got = superminhash.groups(spark.createDataFrame(pairs, "a long, b long").repartition(4)).collect()
    assert {r.node: r.component for r in got} == {a: label.find(a) for p in pairs if p[0] != p[1] for a in p}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_against_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op13_superminhash(spark, SF).collect()}
    want = least_linked(rows, 2, 80)
    assert got == {d: (len(shingles(t, 2)), want[d]) for d, t in rows}
