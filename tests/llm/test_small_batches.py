"""What a task holds at a time: rows sent to Python by the pipeline's stages, bytes whose anchors are found."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tempora.llm import suffix_dedup  # noqa: E402

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_stages_send_few_rows_at_a_time(spark):
    docs = spark.range(1).selectExpr("id AS doc_id", "'a b' AS text", "'en' AS lang", "'x' AS source", "3L AS n_chars")
    before = spark.conf.get(ROWS)
    try:
        for given, want in (("10000", 2000), ("0", 2000), ("500", 500)):
            for name in ("quality rules", "BPE encoding"):
                spark.conf.set(ROWS, given)
                dict(corpus_pipeline.STAGES)[name](spark, docs, "")
                assert int(spark.conf.get(ROWS)) == want
    finally:
        spark.conf.set(ROWS, before)


def test_anchors_are_found_in_half_a_megabyte_at_a_time():
    import pyarrow as pa

    texts = pa.array(["some words of a text " * 500] * 200)
    sizes = [len(buf) for _, (buf, _), _ in suffix_dedup.finder(240)(texts)]
    assert sum(sizes) == 200 * 10_500 and max(sizes) <= 1 << 19
