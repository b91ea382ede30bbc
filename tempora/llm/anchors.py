"""Content-defined anchors: which places of a corpus can hold a repeated window at all.

A window of ``size`` units (bytes or words) is assigned the leftmost minimum of the hashes of
its first ``span`` k-grams, its anchor.  Equal windows have their anchor at the same offset, so
a window can repeat only if the ``size - span + 1`` units from its anchor on (its *context*) occur
twice.  Windows that share an anchor are consecutive; together they make a *passage*.

Equal passages are known by their hash before their text is exchanged: a context all of whose
passages are equal sends one of them to the index structures of the operators, for all; contexts
with differing passages (*mixed* ones) send each differing one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm import textops as T


class Passages(NamedTuple):
    """Arrays over the passages of a chunk, positions in units of the chunk."""

    doc: np.ndarray
    anchor: np.ndarray
    first: np.ndarray  # start of the first window
    last: np.ndarray  # start of the last window
    end: np.ndarray  # end of the passage
    context: np.ndarray  # hash of the units that all its windows hold from the anchor on
    passage: np.ndarray  # hash of all units of its windows and of the anchor's place in them


def passages(order: np.ndarray, bounds: np.ndarray, total: int, size: int, span: int, spell: Callable[[np.ndarray, np.ndarray], np.ndarray], reach: int | None = None) -> Passages:
    """order: value of the k-gram at each unit; bounds: units of document d are bounds[d]:bounds[d+1]; spell: hashes of unit ranges.

    reach: a passage goes so many units on from its last window's start, as far as its document does (size if None).
    """
    if total < size:
        e = np.zeros(0, np.int64)
        return Passages(e, e, e, e, e, e.astype(np.uint64), e.astype(np.uint64))
    inside = np.flatnonzero(T.windows_inside(bounds, size, total))
    anchor = T.sliding_argmin(order, span)[inside]
    new = np.ones(len(inside), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    at = np.flatnonzero(new)
    first = inside[at]
    last = inside[np.append(at[1:], len(inside)) - 1] if len(at) else first
    anchor = anchor[at]
    doc = np.searchsorted(bounds, first, "right") - 1
    end = np.minimum(last + (reach or size), np.asarray(bounds)[doc + 1])
    whole = T.mix(spell(first, end) + ((anchor - first) + 1).astype(np.uint64))
    return Passages(doc, anchor, first, last, end, spell(anchor, anchor + (size - span + 1)), whole)


#: find(texts) -> (first row, what the operator keeps of the chunk, passages) of each chunk
Find = Callable[[pa.Array], Iterator[tuple[int, object, Passages]]]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


NO_ID = -(2**63)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """slot (the integer id, NO_ID for null), mark (64 bits that tell texts of one id, or of none, apart) and text (null: empty).

    All joins that move texts are on slot and mark of these columns, so that they share one exchange.
    """
    base = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("slot"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return base.select("slot", F.xxhash64("text").alias("mark"), "text")


def packed(rows: DataFrame) -> DataFrame:
    """Keyed rows with their texts compressed one by one, for the exchange: it is the largest there is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in T.slices(batches, 2):
            texts = pa.array([squeeze(t.encode()) for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts], names=["slot", "mark", "packed"])

    # known not to be null, so that inner and outer joins plan the same exchange and share it
    return rows.select("slot", "mark", "text").mapInArrow(run, "slot long, mark long, packed binary").where("slot is not null and mark is not null")


def unpacked(column: pa.Array) -> pa.Array:
    """The texts, as UTF-8 strings."""
    spread = zstandard.ZstdDecompressor().decompress
    return pa.array([spread(z) for z in column.to_pylist()], pa.binary()).cast(pa.string())


def own_id(kind: str) -> Column:
    return F.when(F.col("slot") != NO_ID, F.col("slot")).cast(kind)


def members(values: np.ndarray, rows: np.ndarray, lists: pa.ListArray, i: int, n: int) -> np.ndarray:
    """True where a value is in the list of its row; rows: row of each value, among i .. i + n."""
    lo, held = np.asarray(lists.offsets)[i : i + n + 1], np.asarray(lists.values)
    mine = held[lo[0] : lo[-1]].astype(np.int64).view(np.uint64)
    owner = np.repeat(np.arange(i, i + n), np.diff(lo))
    return np.isin(T.salted(values.view(np.uint64), rows), T.salted(mine, owner))


def repeated_contexts(rows: DataFrame, find: Find) -> DataFrame:
    """(slot, mark, repeats): the repeated contexts of each document of keyed rows that has any.

    repeats holds (context, mixed, first_slot); first_slot is the least document with a context.
    Counting sends one row per passage and chunk, so what a third of all documents share arrives a
    few times only; documents then meet the counts in a join, whose skewed partitions adaptive
    execution splits.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = b.column(0).to_numpy()
            for i, _, p in find(b.column(1)):
                order = np.lexsort((p.passage, p.context))
                c, s = p.context[order], p.passage[order]
                new = np.ones(len(order), bool)
                new[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1])
                at = np.flatnonzero(new)
                least = np.minimum.reduceat(slots[i + p.doc[order]], at) if len(at) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([signed(c[at]), signed(s[at]), pa.array(np.diff(np.append(at, len(order)))), pa.array(least)], names=["context", "passage", "n", "first"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots, marks = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, _, p in find(b.column(2)):
                _, at = np.unique(T.salted(p.context, p.doc), return_index=True)
                row = i + p.doc[at]
                yield pa.RecordBatch.from_arrays([signed(p.context[at]), pa.array(slots[row]), pa.array(marks[row])], names=["context", "slot", "mark"])

    stats = (
        rows.select("slot", "text").mapInArrow(count, "context long, passage long, n long, first long").groupBy("context")
        .agg(F.sum("n").alias("n"), F.min("passage").alias("lo"), F.max("passage").alias("hi"), F.min("first").alias("first_slot")).where("n > 1")
        .select("context", (F.col("lo") < F.col("hi")).alias("mixed"), "first_slot")
    )
    places = rows.select("slot", "mark", "text").mapInArrow(place, "context long, slot long, mark long")
    return places.join(stats, "context").groupBy("slot", "mark").agg(F.collect_list(F.struct("context", "mixed", "first_slot")).alias("repeats"))


def shared_contexts(rows: DataFrame, find: Find) -> DataFrame:
    """(slot, mark, contexts): the repeated contexts of each document of keyed rows that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, p in find(b.column(0)):
                c, n = np.unique(p.context, return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(c), pa.array(np.minimum(n, 2).astype(np.int32))], names=["context", "n"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots, marks = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, _, p in find(b.column(2)):
                _, at = np.unique(T.salted(p.context, p.doc), return_index=True)
                row = i + p.doc[at]
                yield pa.RecordBatch.from_arrays([signed(p.context[at]), pa.array(slots[row]), pa.array(marks[row])], names=["context", "slot", "mark"])

    stats = rows.select("text").mapInArrow(count, "context long, n int").groupBy("context").agg(F.sum("n").alias("n")).where("n > 1").select("context")
    places = rows.select("slot", "mark", "text").mapInArrow(place, "context long, slot long, mark long")
    return places.join(stats, "context").groupBy("slot", "mark").agg(F.collect_list("context").alias("contexts"))


def senders(texts: DataFrame, repeats: DataFrame) -> DataFrame:
    """slot, mark, packed text, mixed, alone: the contexts whose passages a document sends to the index.

    Passages of a mixed context are sent by every task that has them, once each; a context with
    equal passages only (``alone``) is sent by its least document, for all.
    """
    kept = lambda test: F.transform(F.filter("repeats", test), lambda r: r["context"])
    lists = repeats.select("slot", "mark", kept(lambda r: r["mixed"]).alias("mixed"), kept(lambda r: ~r["mixed"] & (r["first_slot"] == F.col("slot"))).alias("alone"))
    return texts.join(lists.where("size(mixed) + size(alone) > 0"), ["slot", "mark"]).select("slot", "mark", "packed", "mixed", "alone")


def holders(texts: DataFrame, repeats: DataFrame) -> DataFrame:
    """slot, mark, packed text, contexts: all repeated contexts of a document."""
    return texts.join(repeats.select("slot", "mark", F.transform("repeats", lambda r: r["context"]).alias("contexts")), ["slot", "mark"]).select("slot", "mark", "packed", "contexts")
