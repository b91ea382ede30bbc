"""Ranked lexical search over a bit-sliced impact index.

The index is a table with a row for each block of at most BLOCK documents, in order of their ids.  A
document's impact for a term, an integer, is cut into bits; slice s of a term is the bitmap of the block's
documents whose impact has bit s.  Only the words of 64 documents in which a term occurs are kept, all
slices of a word side by side.

A search adds the slices of a query's terms by bitwise carry arithmetic, all documents of a block and many queries at
once, and finds the k best by descending from the most significant slice: documents that are
surely in, and those still level with the k-th, of which the least ids fill what is missing.  Each
task passes on k documents a query, and ranks over all tasks decide, first in parts, then whole.

Scores are BM25's with integer arithmetic: a term that df of N documents hold weighs
w = floor(1000 ln((2N + 2) / (2df + 1))); with L terms in all and n in the document, m = 10 + (90 n N) div L, and an
impact is w ((10^9 tf) div (1000 tf + 8 m)).

The vocabulary of the queries is all that documents are searched for: QUERIES_TERMS pairs of a query and
a term at a time, however many there are (a bounded list on the driver; more queries are more passes, and one query
is never split).  A document's text is read once a pass; counts are taken over all documents.
Terms are known by 64 bits of hash and by their length.

Defined cases: a null text, or one without terms, is in no count and is never found; rows with one id (or none)
are documents of their own, ranked by id, none last; rows of one item_id (or none) are one query with all their
terms; a query without terms, or whose terms no document holds, has no rows; fewer documents than k with a score above
0 are all returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm import textops as T
from tempora.llm.divergence import spans
from tempora.llm.shared import written

K = 10
BLOCK = 4096  # documents of a block
POSTINGS = 1_000_000  # postings of a block, about
QUERIES_TERMS = 1 << 20  # pairs of a query and a term in one pass
SLOTS, STRIP = 1 << 14, 8  # words of a slice over the queries that are added at a time; terms of each that are laid out at a time
SCALE = 10**9

LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def term_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each term of the documents of a chunk; the hash takes in the term's length."""
    begin, end, doc = spans(buf, offs, LETTER)
    return T.range_hash(T.prefix_hash(T.LOWER[buf]), begin, end), doc


# -- queries --------------------------------------------------------------------------


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, buf, offs in T.chunks(b.column(1)):
            term, doc = term_hashes(buf, offs)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(term.view(np.int64))], names=["item_id", "term"])


class Queries:
    """Queries by number: the places of their terms in the sorted vocabulary; those of fewer terms first."""

    def __init__(self, rows: list[tuple[object, list[int]]]):
        rows = sorted(rows, key=lambda r: len(r[1]))
        self.ids = [r[0] for r in rows]
        flat = np.array([t for _, ts in rows for t in ts], np.int64).view(np.uint64)
        self.vocabulary, places = np.unique(flat, return_inverse=True)
        self.bounds = np.cumsum([0, *(len(ts) for _, ts in rows)])
        self.places = places


def passes(items: DataFrame, item_id: str, text: str) -> Iterator[Queries]:
    """The queries, in lists of about QUERIES_TERMS pairs of a query and a term."""
    kind = items.schema[item_id].dataType.simpleString()
    pairs = written(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).mapInArrow(_query_terms, f"item_id {kind}, term long").distinct())
    n = -(-pairs.count() // QUERIES_TERMS)
    for k in range(n):
        rows = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
        if rows:
            yield Queries([(r.item_id, r.terms) for r in rows])


# -- counts ---------------------------------------------------------------------------


def _counts(vocabulary: np.ndarray):
    """Texts -> number of terms, and places in the vocabulary with how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in T.chunks(b.column(1)):
                term, doc = term_hashes(buf, offs)
                n = np.bincount(doc, minlength=j - i)
                at = np.minimum(np.searchsorted(vocabulary, term), max(len(vocabulary) - 1, 0))
                hit = vocabulary[at] == term if len(vocabulary) else np.zeros(len(term), bool)
                pair, tf = np.unique((doc[hit].astype(np.int64) << 32) | at[hit], return_counts=True)
                bounds = np.searchsorted(pair >> 32, np.arange(j - i + 1)) * 4
                lists = [pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(bounds.astype("<i4")), pa.py_buffer(np.ascontiguousarray(x).astype("<u4"))]) for x in (pair & 0xFFFFFFFF, tf)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "term", "tf"])

    return run


def _held(size: int):
    """Counted documents -> (term, documents that hold it), added up by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4"), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    return run


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], np.int64)


def length_parts(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents with n terms each."""
    most = int(n.max(initial=0))
    if 90 * most * documents < 1 << 62:
        return 100 - 90 + (90 * n * documents) // total
    return np.array([100 - 90 + 90 * x * documents // total for x in n.tolist()], np.int64)


# -- index ----------------------------------------------------------------------------


def sliced(term: np.ndarray, place: np.ndarray, impact: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings in order of (term, document's place) -> (term, word) of each word in use, and its slices (words x slices)."""
    key = term.astype(np.int64) << 32 | place >> 6
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    out, bit = np.zeros((len(at), slices), np.uint64), (place & 63).astype(np.uint64)
    value = impact.astype(np.uint64)
    for s in range(slices):
        if len(at):
            out[:, s] = np.add.reduceat((value >> T.U(s) & T.U(1)) << bit, at)  # one document a bit: no carries
    return key[at] >> 32, key[at] & 0xFFFFFFFF, out


def _indexed(weight: np.ndarray, documents: int, total: int):
    """Counted documents -> blocks of the index."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.take(pa.compute.sort_indices(rows, [("doc_id", "ascending")], null_placement="at_end"))
        sizes = np.array([len(x) // 4 for x in rows["term"].to_pylist()], np.int64)
        term, tf = (np.frombuffer(b"".join(rows[c].to_pylist()), "<u4").astype(np.int64) for c in ("term", "tf"))
        place = np.repeat(np.arange(len(sizes)), sizes)
        m = length_parts(rows["n"].to_numpy(), documents, total)[place]
        impact = weight[term] * ((SCALE * tf) // (1000 * tf + 8 * m))
        order = np.argsort(term, kind="stable")
        slices = int(impact.max(initial=0)).bit_length()
        t, word, bits = sliced(term[order], place[order], impact[order], slices)
        raw = [zstandard.compress(np.ascontiguousarray(x, k).tobytes(), 1) for x, k in ((t, "<u4"), (word, "<u2"), (bits.T, "<u8"))]
        ids = pa.array([rows["doc_id"].to_pylist()], pa.list_(rows.schema.field("doc_id").type))
        return pa.RecordBatch.from_arrays([ids, pa.array([slices], pa.int32()), *(pa.array([x], pa.binary()) for x in raw)], names=["doc_ids", "slices", "term", "word", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, postings = [], 0, 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                held.append(part)
                n += part.num_rows
                postings += part.column("term").nbytes // 4
                if n + 256 > BLOCK or postings > POSTINGS:
                    yield block(pa.Table.from_batches(held))
                    held, n, postings = [], 0, 0
        if held:
            yield block(pa.Table.from_batches(held))

    return run


def build(docs: DataFrame, vocabulary: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all documents for the terms of a vocabulary (sorted hashes of at most QUERIES_TERMS terms)."""
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    known = spark.sparkContext.broadcast(vocabulary)
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda b: _counts(known.value)(b), f"doc_id {kind}, n long, term binary, tf binary")
    counted = written(counted.where("n > 0"))
    documents, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counted.select("term").mapInArrow(_held(len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(len(vocabulary), np.int64)
    df[held["term"].to_numpy(np.int64)] = held["df"].to_numpy(np.int64)
    weight = spark.sparkContext.broadcast(weights(df, documents))
    rows = counted.where("length(term) > 0").mapInArrow(lambda b: _indexed(weight.value, documents, total)(b), f"doc_ids array<{kind}>, slices int, term binary, word binary, bits binary")
    return written(rows)


# -- search ---------------------------------------------------------------------------


class Block:
    """A block of the index, opened."""

    def __init__(self, n: int, slices: int, term: np.ndarray, word: np.ndarray, bits: np.ndarray):
        self.n, self.words, self.slices = n, -(-n // 64), slices
        self.term, self.word, self.bits = term, word, bits

    def laid_out(self, terms: np.ndarray) -> np.ndarray:
        """Bitmaps of sorted terms: slices x terms x words."""
        lo, hi = np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, "right")
        size = hi - lo
        row = np.repeat(np.arange(len(terms)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        out = np.zeros((self.slices, len(terms), self.words), np.uint64)
        out[:, row, self.word[at]] = self.bits[:, at]
        return out


def added(total: list[np.ndarray], part: np.ndarray) -> None:
    """Adds bit-sliced numbers (slices x ...) to others, slice by slice with a carry; total grows as needed."""
    carry = None
    for s, x in enumerate(part):
        if s == len(total):
            total.append(np.zeros_like(x))
        t = total[s]
        both = t ^ x
        if carry is None:
            total[s], carry = both, t & x
        else:
            total[s], carry = both ^ carry, (t & x) | (both & carry)
    s = len(part)
    while carry is not None and carry.any():
        if s == len(total):
            total.append(np.zeros_like(carry))
        total[s], carry = total[s] ^ carry, total[s] & carry
        s += 1


def best(total: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(queries x words) bitmaps of the documents surely among the k best, and of those level with the k-th; scores above 0."""
    level = np.zeros_like(total[0])
    for t in total:
        level |= t
    sure = np.zeros_like(level)
    for t in reversed(total):
        more = sure | (level & t)
        n = np.bitwise_count(more).sum(1, dtype=np.int64)[:, None]
        level = np.where(n > k, level & t, np.where(n < k, level & ~t, np.uint64(0)))
        sure = np.where(n > k, sure, more)
    return sure, level


def _places(bitmap: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, document's place) of the first ``most`` documents of each query's bitmap."""
    count = np.cumsum(np.bitwise_count(bitmap), axis=1, dtype=np.int64)
    need = np.flatnonzero((most > 0) & (count[:, -1] > 0))
    row, col = np.nonzero((bitmap[need] != 0) & (count[need] - np.bitwise_count(bitmap[need]) < most[need, None]))
    words = bitmap[need][row, col]
    which, bit = np.nonzero(np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    query, place = need[row[which]], col[which] * 64 + bit
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < most[query]
    return query[keep], place[keep]


def top_of(block: Block, queries: Queries, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document's place, score) of each query's k best of a block."""
    out, step = [], max(1, SLOTS // block.words)
    sizes = np.diff(queries.bounds)
    for a in range(0, len(sizes), step):
        n = sizes[a : a + step]
        total: list[np.ndarray] = [np.zeros((len(n), block.words), np.uint64)]
        for t in range(0, int(n.max(initial=0)), STRIP):
            width = np.clip(n - t, 0, STRIP)
            own = np.repeat(np.arange(len(n)), width)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(width) - width, width)
            terms, at = np.unique(queries.places[queries.bounds[a : a + step][own] + t + nth], return_inverse=True)
            laid = np.concatenate([block.laid_out(terms), np.zeros((block.slices, 1, block.words), np.uint64)], axis=1)
            which = np.full((len(n), STRIP), len(terms))  # none
            which[own, nth] = at
            for i in range(int(width.max())):
                added(total, laid[:, which[:, i]])
        sure, level = best(total, k)
        have = np.bitwise_count(sure).sum(1, dtype=np.int64)
        parts = [_places(sure, have), _places(level, k - have)]
        query, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        score = np.zeros(len(query), np.int64)
        for s, x in enumerate(total):
            score += (x[query, place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << s
        out.append((query + a, place, score))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _searched(queries: Queries, k: int, item_kind: pa.DataType | None):
    """Blocks -> the k best documents of each query, of all blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for row in range(b.num_rows):
                ids = b.column("doc_ids")[row].values
                term, word, bits = (np.frombuffer(zstandard.decompress(b.column(c)[row].as_py()), kind) for c, kind in (("term", "<u4"), ("word", "<u2"), ("bits", "<u8")))
                slices = b.column("slices")[row].as_py()
                if not slices:
                    continue
                query, place, score = top_of(Block(len(ids), slices, term, word, bits.reshape(slices, -1)), queries, k)
                new = pa.table({"query": query, "doc_id": ids.take(pa.array(place)), "score": score})
                held = new if held is None else pa.concat_tables([held, new])
                if held.num_rows > 4 * k * len(queries.ids):
                    held = first(held)
        if held is not None:
            held = first(held)
            ids = pa.array(queries.ids, item_kind).take(held["query"].combine_chunks())
            yield from pa.table({"item_id": ids, "doc_id": held["doc_id"], "score": held["score"]}).to_batches()

    def first(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.compute.sort_indices(rows, [("query", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_end"))
        query = rows["query"].to_numpy()
        return rows.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < k))

    return run


def search(index: DataFrame, queries: Queries, item_kind, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: each query's k best documents of an index of its vocabulary."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = index.sparkSession, index.schema["doc_ids"].dataType.elementType.simpleString()
    asked, arrow = spark.sparkContext.broadcast(queries), to_arrow_type(item_kind)
    found = index.mapInArrow(lambda b: _searched(asked.value, k, arrow)(b), f"item_id {item_kind.simpleString()}, doc_id {kind}, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = found.withColumn("part", F.spark_partition_id() % 64)  # tasks of a query are ranked in parts first
    near = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents for each item."""
    out = None
    for queries in passes(items, item_id, item_text):
        found = search(build(docs, queries.vocabulary, doc_id, text), queries, items.schema[item_id].dataType, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        shape = f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id {docs.schema[doc_id].dataType.simpleString()}, score long"
        return docs.sparkSession.createDataFrame([], shape)
    return out


#: the same for another engine
RANKED_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*)::BIGINT AS N, sum(len(ts))::BIGINT AS L FROM d WHERE len(ts) > 0),
t AS (SELECT id, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT id, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY id, doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * s.N + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s GROUP BY term, s.N),
i AS (SELECT t.id, t.doc_id, t.term, w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 90 + (90 * t.n * s.N) // s.L))) AS impact FROM t JOIN w USING (term), s),
r AS (SELECT q.item_id, i.doc_id, sum(i.impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY q.item_id, i.id, i.doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= {K}"""
