"""The pipeline against plain restatements of its stages, on the smallest tables."""

import os

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tempora.llm import bpe, mixing, quality  # noqa: E402
from tempora.llm.shared import written  # noqa: E402

from .test_brute_force import SF, repeated_bytes  # noqa: E402
from .test_near_copies import shingles  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r for r in df.collect()}

    kept = written(stages["quality rules"](spark, docs, SF))
    verdict = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    assert kept.schema.names == docs.schema.names and set(rows(kept)) == verdict

    single = written(stages["n-gram Jaccard join"](spark, kept, SF))
    sets = {d: shingles(r.text, corpus_pipeline.NEAR_WORDS) for d, r in rows(kept).items()}
    linked = lambda a, b: 100 * len(a & b) >= corpus_pipeline.NEAR_PERCENT * len(a | b) and bool(a | b)
    gone = set(sets) - set(rows(single))
    assert all(any(linked(sets[d], sets[e]) for e in sets if e < d) for d in gone)
    left = sorted(rows(single))
    assert not any(linked(sets[a], sets[b]) for i, a in enumerate(left) for b in left[i + 1 :])

    cut = written(stages["suffix-array dedup"](spark, single, SF))
    want = {d: n - r for d, n, r, *_ in repeated_bytes([(d, r.text.encode()) for d, r in rows(single).items()], corpus_pipeline.REPEAT_BYTES)}
    assert {d: len(r.text.encode()) for d, r in rows(cut).items()} == pytest.approx(want, abs=3)  # cut characters go whole
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    mixed = written(stages["mixing to target weights"](spark, cut, SF))
    labels = mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    copies = {r.doc_id: r.copies for r in mixing.mixing_rates(cut, labels, mixing.TARGETS, "good").collect()}
    found = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert found == {d: n for d, n in copies.items() if n} and mixed.schema.names == docs.schema.names

    ids = stages["BPE encoding"](spark, mixed, SF).collect()
    codec = bpe.Codec(bpe.default_path())
    assert len(ids) == mixed.count()
    assert all(np.array_equal(np.frombuffer(r.ids, "<u4"), np.frombuffer(codec.encode(r.text), "<u4")) for r in ids)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.schema.names == [*spark.read.parquet(f"{SF}/documents.parquet").schema.names, "ids"] and got.count() > 100
