"""Mixing learns from whole texts and ends at the balance of each domain."""

import random

import numpy as np

from tempora.llm import mixing


def test_classifier_sees_whole_texts(spark):
    rnd = random.Random(6)
    vocabulary = [a + b + c for a in ("ri", "sto", "win", "pa", "mel") for b in ("ver", "ne", "dow", "per", "ti", "ga") for c in ("a", "o", "un", "is", "ek", "al", "ir", "om", "es", "up")]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=2000)) + (" zorgon" if i % 2 else " brimble") * 40) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "bad" if i % 2 else "good") for i in range(200)], "doc_id long, domain string")
    got = mixing.mixing_rates(docs, labels, {"bad": 0.1, "good": 0.9}, "good").collect()
    assert np.mean([(r.p_bad > 0.5) == bool(r.doc_id % 2) for r in got]) > 0.95


def test_each_domain_ends_at_its_balance(spark):
    rng = np.random.default_rng(4)
    p, n = rng.dirichlet([1.0, 0.6, 0.3], 400), rng.integers(1, 500, 400)
    table = spark.createDataFrame([(int(a), [float(x) for x in row]) for a, row in zip(n, p, strict=True)], "n long, p array<double>").coalesce(2).cache()
    weights = np.array([0.95, 0.049, 0.001])
    pulls = mixing.solve(table, weights, 0, 1.1)
    now = n @ p
    target = weights * 1.1 * now[0] / weights[0]
    got = (n * mixing.rates(p, pulls)) @ p
    further = (n * mixing.rates(p, [*pulls, (got - target) / now])) @ p
    assert len(pulls) == mixing.STEPS or (np.abs(further - got) <= 2 * mixing.ENOUGH * target).all()
    rated = spark.createDataFrame([(int(a), float(r), *map(float, row)) for a, r, row in zip(n, mixing.rates(p, pulls), p, strict=True)], "n_tokens long, rate double, p_a double, p_b double, p_c double")
    off = mixing.misfits(rated, dict(zip("abc", weights.tolist(), strict=True)), "a")
    assert np.allclose(list(off.values()), got / target - 1)
