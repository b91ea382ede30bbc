"""What the learned operators bring to one place is bounded, and tables give what plain convolution gives."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempora.llm import langid, lm_score, mixing


def test_tables_equal_plain_convolution():
    net = langid.Network(["a", "b"], seed=3)
    x = np.random.default_rng(5).integers(0, langid.CLASSES, (langid.LENGTH + langid.TAIL, 7))
    want = []
    for k in langid.WIDTHS:
        reply = sum(net.w[k][q][x[q : q + langid.LENGTH]] for q in range(k))
        want.append(reply.max(0))
    assert np.allclose(net.pooled(x, net.tables()), np.concatenate(want, 1), atol=1e-5)


def test_short_texts_are_learned_from(spark):
    rows = [(i, ("gato", "dog")[i % 2], ("es", "en")[i % 2]) for i in range(400)]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    lang, _ = langid.predict(net, pa.array(["gato", "dog"]))
    assert lang == ["es", "en"]


def test_windows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "WINDOWS", 50)
    seen = []
    monkeypatch.setattr(langid.Network, "train", lambda self, x, y: seen.append(x.shape[1]))
    rows = [(i, "palabra " * 500, "es") for i in range(40)]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert seen == [50]


def test_one_text_of_a_repeated_id_is_learned_from(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(mixing.Classifier, "fit", lambda self, parts, domains: sizes.append(len(parts)))
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(2, "other")], "doc_id long, text string")
    labelled = spark.createDataFrame([(1, "good"), (2, "toxic")], "doc_id long, domain string")
    mixing.train(docs, labelled, ["good", "toxic"])
    assert sizes == [2]


@pytest.mark.parametrize("tasks", [1, 300])
def test_sums_of_tasks_in_two_levels(spark, tasks):
    rows = spark.range(tasks).select(
        F.lit(0).alias("part"), (F.col("id") / lm_score.FAN_IN).cast("int").alias("leaf"), F.lit(2.0).alias("weight"), F.unhex(F.lit(np.array([3.0, 5.0]).tobytes().hex())).alias("value"),
    )
    (got,) = lm_score._totals(rows).collect()
    assert got.weight == 2.0 * tasks and np.frombuffer(got.value, "<f8").tolist() == [3.0 * tasks, 5.0 * tasks]
