"""Texts whose hashes are equal, and blocks with very many members."""

from pyspark.sql import functions as F

from tempora.llm import fingerprint


def test_different_texts_of_equal_hashes_differ(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "wide_hash", lambda text: F.substring(F.hex(F.xxhash64(text)), 1, 1))
    texts = ["word " * (i % 40) + "end" for i in range(120)] + [None, "", "  ", "END"]
    df = spark.createDataFrame([(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = fingerprint.fingerprint_pairs(df)
    assert got.count() == len(texts)
    by_text = {}
    for r in got.select("n_chars", "fingerprint").collect():
        by_text.setdefault(r.fingerprint, set()).add(r.n_chars)
    # the texts of one fingerprint are equal but for blanks at their ends
    assert {frozenset(v) for v in by_text.values()} == {frozenset({len("word " * k + "end")}) for k in range(40)} | {frozenset({0, 2})}
    assert len(by_text) == 41


def test_marks_of_a_block_beyond_one_bitmap(spark):
    places = spark.range(1, 40_001).select(F.lit(3).alias("block"), F.col("id").alias("place"))
    bit = fingerprint._bit("place", F.lit(1))
    marked = fingerprint._marked(places.where("place % 3 = 0").select("block", bit.alias("bit")))
    flags = places.join(marked, "block").select("place", fingerprint._is_marked("members", bit).alias("own"), fingerprint._is_marked("members", fingerprint._bit("place", F.lit(0))).alias("other"))
    assert flags.where("own = (place % 3 = 0) and not other").count() == 40_000
