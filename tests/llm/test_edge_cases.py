"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tempora.llm import bpe, fingerprint, jaccard_join, langid, lm_score, mixing, quality, substring_dedup, suffix_dedup, superminhash, toxicity

OPERATORS = {
    "toxicity": lambda d, l: toxicity.toxicity(d, l),
    "langid": lambda d, l: langid.identify_language(d),
    "quality": lambda d, l: quality.quality_rules(d),
    "jaccard": lambda d, l: jaccard_join.jaccard_components(d),
    "fingerprint": lambda d, l: fingerprint.fingerprint_pairs(d),
    "bpe": lambda d, l: bpe.round_trip(d),
    "mixing": lambda d, l: mixing.mixing_rates(d, mixing.label_domains(l), mixing.TARGETS, "good"),
    "lm": lambda d, l: lm_score.score_texts(d),
    "suffix": lambda d, l: suffix_dedup.repeated_bytes(d),
    "substring": lambda d, l: substring_dedup.repeated_words(d),
    "superminhash": lambda d, l: superminhash.near_duplicates(d),
}
CARRYING = {
    "quality": lambda d, l: quality.quality_filter(d),
    "jaccard": lambda d, l: jaccard_join.drop_near_copies(d),
    "superminhash": lambda d, l: superminhash.drop_near_duplicates(d),
    "suffix": lambda d, l: suffix_dedup.drop_repeats(d),
    "mixing": lambda d, l: mixing.mix(d, mixing.label_domains(l), mixing.TARGETS, "good"),
    "bpe": lambda d, l: bpe.encode(d).drop("ids"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(docs, labels, name):
    got = OPERATORS[name](docs, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs.select("doc_id").collect())
    twice = [tuple(r) for r in got if r.doc_id == 9]
    assert twice[0] == twice[1] or name == "fingerprint"  # there they have different next documents


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.where("false"), labels.where("false")).count() == 0


@pytest.mark.parametrize("name", CARRYING)
def test_columns_are_carried(docs, labels, name):
    got = CARRYING[name](docs, labels)
    assert got.schema.names == docs.schema.names
    assert {r.doc_id for r in got.collect()} <= {r.doc_id for r in docs.collect()}
    assert CARRYING[name](docs.where("false"), labels.where("false")).count() == 0


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_defined_results(docs, labels):
    assert by_id(langid.identify_language(docs))[4].lang_pred == "und" and by_id(langid.identify_language(docs))[2].score == 0
    q = by_id(quality.quality_rules(docs))
    assert q[2].n_words == 0 and q[2].base_failed and not q[2].kept and q[9].word_chars == 6
    j = by_id(jaccard_join.jaccard_components(docs))
    assert (j[2].n_shingles, j[2].component_id) == (0, 2) and j[6].component_id == 5 and j[12].component_id == 9 and j[9].n_shingles == 1
    s = by_id(suffix_dedup.repeated_bytes(docs))
    assert s[5].n_removed == s[5].n_bytes and s[6].n_spans == 1 and s[2].n_bytes == 0 and s[3].kept_sha256 == s[2].kept_sha256
    w = by_id(substring_dedup.repeated_words(docs))
    assert w[6].n_removed == w[6].n_words and w[2].n_words == 0
    f = by_id(fingerprint.fingerprint_pairs(docs))
    assert f[2].fingerprint == f[3].fingerprint == f[4].fingerprint and f[5].fingerprint == f[6].fingerprint and f[5].near_next == 1.0
    m = by_id(mixing.mixing_rates(docs, mixing.label_domains(labels.where("false")), mixing.TARGETS, "good"))
    assert {r.rate for r in m.values()} == {1.0}


def test_next_documents_of_ids_of_any_kind(spark, monkeypatch):
    """Far, wide and missing ids: order, blocks of a bounded size, and next texts."""
    monkeypatch.setattr(fingerprint, "BLOCK", 4)
    rnd = random.Random(12)
    wide = [rnd.randrange(-(2**63), 2**63) for _ in range(120)]
    for ids in (wide, [*range(100), 4 * 10**12], [*range(60), *[None] * 20]):
        rows = [(i, f"text {k} " * rnd.randint(0, 4)) for k, i in enumerate(ids)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = fingerprint.with_next(df).collect()
        sizes = collections.Counter(r.block for r in got)
        assert len(sizes) > 8 and max(sizes.values()) <= 24
        order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
        follows = {r.doc_id: r.next_text for r in got if r.doc_id is not None}
        assert all(follows[a] == t for (a, _), (_, t) in zip(order[:-1], order[1:], strict=True))
        if None not in ids:
            assert follows[order[-1][0]] == order[0][1]
        assert sorted(r.next_text for r in got) == sorted(t for _, t in rows)  # a ring through all rows


def test_rows_without_an_id_are_not_held_out(spark, docs, labels):
    assert [r.held_out for r in toxicity.toxicity(docs, labels).where("doc_id is null").collect()] == [False]
    assert [r.held_out for r in langid.identify_language(docs).where("doc_id is null").collect()] == [False]


@pytest.mark.parametrize("name", CARRYING)
def test_columns_that_clash_with_inner_names(docs, labels, name):
    inner = ["_slot", "slot", "mark", "_mark", "_spots", "spots", "_row", "row", "_chance", "chance", "_bpe_text", "encoded", "packed", "ids", "gone", "least", "id", "component_id", "part", "tile"]
    wide = docs.drop("slot").select("*", *(F.lit(k).alias(c) for k, c in enumerate(inner)))
    got = CARRYING[name](wide, labels)
    if name == "bpe":  # beside a column of that name, token ids are in one with underscores
        got = bpe.encode(wide).drop("_ids")
    assert got.columns == wide.columns
    rows = got.collect()
    assert rows and all(r[c] == k for r in rows for k, c in enumerate(inner))


def test_texts_without_an_id_whose_short_hashes_agree(spark):
    """The spots of one such text are not those of another."""
    rnd = random.Random(1)
    passage, other = ("".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in (450, 900))
    n = spark.range(200_000)
    sides = [n.select(F.concat(F.lit(x), F.col("id").cast("string")).alias("text")).withColumn("h", F.hash("text")) for x in (passage + passage, other)]
    pair = sides[0].join(sides[1].withColumnRenamed("text", "clean"), "h").first()
    df = spark.createDataFrame([(None, pair.text), (None, pair.clean), (1, "x y z")], "doc_id long, text string")
    got = {r.n_bytes: r.n_removed for r in suffix_dedup.repeated_bytes(df).collect()}
    assert got[len(pair.clean)] == 0 and got[len(pair.text)] >= 900 and got[5] == 0
    words = substring_dedup.repeated_words(df.withColumn("text", F.regexp_replace("text", "(.)", "$1 "))).collect()
    assert sorted(r.n_removed > 0 for r in words) == [False, False, True]
    kept = suffix_dedup.drop_repeats(df).collect()
    assert pair.clean in {r.text for r in kept}
