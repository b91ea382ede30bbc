"""Document fingerprints: canonical exact digests, built from SQL functions only.

A text's canonical form is its compatibility-composed Unicode normalisation (NFKC), case
folded, with each run of white space as one blank and none at its ends.  Canonical forms are
grouped by a wide (128-bit) xxhash; inside buckets that hold more than one document their
bytes are compared, and canonical forms that differ in spite of equal hashes get different
ordinals, so equal fingerprints mean equal canonical texts.  Likeness of two fingerprints is
1 if they are equal and 0 if not.

The next document of each document comes from a window over blocks of neighbouring ids, so
texts are exchanged once; the few block borders are closed by a join over block minima.  Blocks
are cut at quantiles of the ids that are present, so that each holds about BLOCK documents however
the ids lie (up to some 16 million documents; beyond, blocks grow with the table, as tasks do).

Defined cases: null text counts as empty; repeated ids are ordered by text and then count as
successive documents; with a single document the next one is itself; rows with a null
id come first, in order of a hash of their text; ids are of any integer type; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
BLOCK = 512  # documents of a block of neighbouring ids, about
FAN, LEVELS = 32, 3  # borders that an id is compared with at each of these levels
GROUP = 1024  # blocks


def canonical(text: Column) -> Column:
    """NFKC, case folding (lower case, sharp s as ss, final sigma as sigma), white space folding."""
    nfkc = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    ascii_only = F.octet_length(text) == F.char_length(text)  # NFKC leaves ASCII as it is
    norm = F.when(ascii_only, text).otherwise(nfkc(text))
    lower = F.lower(norm)
    folded = F.when(ascii_only, lower).otherwise(nfkc(F.translate(F.replace(lower, F.lit("ß"), F.lit("ss")), "ς", "σ")))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_hash(text: Column) -> Column:
    """128 bits: two seeded 64-bit xxhashes."""
    return F.concat(*(F.lpad(F.lower(F.hex(F.xxhash64(F.lit(s), text))), 16, "0") for s in SEEDS))


def _blocks(docs: DataFrame, doc_id: str, text_hash: Column) -> Column:
    """Block number of a row: the number of quantiles of the ids at or below its own; rows without an id lie before."""
    i = F.col(doc_id).cast("long")
    n, nulls = docs.agg(F.count(doc_id), F.sum(F.col(doc_id).isNull().cast("long"))).first()
    levels = 1
    while levels < LEVELS and FAN**levels * BLOCK < n:
        levels += 1
    cuts = FAN**levels
    at = docs.agg(F.percentile_approx(i, [k / cuts for k in range(1, cuts)], 20 * cuts).alias("at")).first()[0] if n > BLOCK else []
    borders = sorted(int(x) for x in at or [])
    block = F.lit(0).cast("long")
    if borders:
        literal = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
        # the cuts of a level that fall inside a cell of the level above, by the cell's number
        inner = F.lit(0).cast("long")
        for level in range(1, levels + 1):
            step = FAN ** (levels - level)
            mine = [borders[k - 1] for k in range(step, cuts, step)]
            cells = F.array(*(literal(mine[k : k + FAN - 1]) for k in range(0, len(mine), FAN)))
            inner = inner * FAN + F.size(F.filter(F.element_at(cells, (inner + 1).cast("int")), lambda x: x <= i))
        block = inner
    many = F.lit(max(1, -(-(nulls or 0) // BLOCK))).cast("long")
    return F.when(i.isNull(), F.shiftright((F.shiftright(text_hash, 33) + F.lit(2**30)) * many, 31) - F.lit(2**40)).otherwise(block)


def _followers(blocks: DataFrame) -> DataFrame:
    """(block, follows): the next block that holds documents; the last is followed by the first.

    Blocks are chained inside groups; only the groups' first blocks, the documents divided by
    BLOCK * GROUP, meet in one window.
    """
    grouped = blocks.withColumn("g", F.floor(F.col("block") / GROUP))
    along = Window.orderBy("g")
    heads = grouped.groupBy("g").agg(F.min("block").alias("head"))
    ends = heads.select("g", F.coalesce(F.lead("head").over(along), F.first("head").over(along)).alias("head"))
    inner = grouped.withColumn("inner", F.lead("block").over(Window.partitionBy("g").orderBy("block")))
    return inner.join(ends, "g").select("block", F.coalesce("inner", "head").alias("follows"))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, next_text, block and place in it; ids ascend, the last document's next one is the first.

    Every use of the documents below reads the same exchange, so texts are shuffled once.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    mark = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    base = base.withColumn("block", _blocks(base, "doc_id", mark))
    inside = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), mark, "text")
    rows = base.select("*", F.lead("text").over(inside).alias("lead"), F.row_number().over(inside).alias("place"))
    heads = rows.where("place = 1").select("block", "text")
    border = _followers(heads.select("block")).join(heads.select(F.col("block").alias("follows"), F.col("text").alias("border_text")), "follows").select("block", "border_text")
    return rows.join(border, "block").select("block", "place", "doc_id", "text", F.coalesce("lead", "border_text").alias("next_text"))


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last quarter replaced by as many first characters (or all) of the next one."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(next_text, F.lit(1), cut))


def _bit(place: str, kind: Column) -> Column:
    """Number of a block's own (kind 0) or edited text (kind 1)."""
    return ((F.col(place) - 1) * 2 + kind).cast("long")


def _marked(bits: DataFrame) -> DataFrame:
    """(block, members): the numbers that a block has, as bitmaps of 32,768 numbers each by their high part."""
    maps = bits.groupBy("block", F.shiftright("bit", 15).alias("high")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("bits"))
    return maps.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("high", "bits"))).alias("members"))


def _is_marked(members: str, bit: Column) -> Column:
    """Whether a bitmap holds a number: one byte is read, however many there are."""
    low = bit.bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring(F.element_at(members, F.shiftright(bit, 15)), (F.shiftright(low, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    flag = byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (low.bitwiseAND(F.lit(7)) + 1).cast("int")))
    return F.coalesce(flag > 0, F.lit(False))


def fingerprint_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and likenesses to the edited and the next text."""
    near = with_next(docs, doc_id, text)
    texts = near.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    forms = texts.select(
        "block", "place", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("c0"), canonical(F.col("edited")).alias("c1"), canonical(F.col("next_text")).alias("c2"),
    )
    light = forms.select(
        "block", "place", "doc_id", "n_chars", "edited_sha256", wide_hash(F.col("c0")).alias("d0"), wide_hash(F.col("c1")).alias("d1"),
        (F.col("c0") == F.col("c1")).cast("double").alias("near_edited"), (F.col("c0") == F.col("c2")).cast("double").alias("near_next"),
    )

    # byte comparison inside buckets of two or more: only their members' texts go on, equal ones merged first
    digests = light.select("block", "place", F.posexplode(F.array("d0", "d1")).alias("kind", "digest"))
    shared = digests.groupBy("digest").count().where("count > 1").select("digest")
    members = _marked(digests.join(shared, "digest", "left_semi").select("block", _bit("place", F.col("kind")).alias("bit")))
    form = lambda kind, text: F.when(_is_marked("members", _bit("place", F.lit(kind))), F.col(text))
    held = (
        texts.join(members, "block").select("block", "place", F.posexplode(F.array(form(0, "text"), form(1, "edited"))).alias("kind", "form")).where("form is not null")
        .select("block", "place", "kind", canonical(F.col("form")).alias("canon"))
        .withColumn("digest", wide_hash(F.col("canon")))
    )
    by = Window.partitionBy("digest").orderBy("canon")
    clashes = held.select("digest", "canon").distinct().withColumn("ordinal", F.row_number().over(by) - 1).where("ordinal > 0")
    ordinals = held.join(clashes, ["digest", "canon"]).select("block", "place", "kind", "ordinal")
    own, new = (ordinals.where(F.col("kind") == k).select("block", "place", F.col("ordinal").alias(f"o{k}")) for k in (0, 1))
    named = lambda d, o: F.when(F.col(o).isNull(), F.col(d)).otherwise(F.concat_ws("-", d, o))
    out = light.join(own, ["block", "place"], "left").join(new, ["block", "place"], "left")
    return out.select(F.col("doc_id").alias(doc_id), "n_chars", "edited_sha256", named("d0", "o0").alias("fingerprint"), named("d1", "o1").alias("edited_fingerprint"), "near_edited", "near_next")
