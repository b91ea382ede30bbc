"""Substring deduplication over words by compressed FM-indexes, one per shard.

Every word covered by a window of ``size`` words that also starts earlier (smaller id, or earlier
in the same document) is removed.  Passages whose anchor context repeats (see ``anchors``) are
dealt to shards by that context, so that all occurrences of a window meet in one shard, each distinct
passage once.  Of a context's passages, in order of their places, one half is indexed and the other
half streamed through the index, then the same within each half: whatever two passages share, one of
them is once indexed while the later one is streamed, and no index holds what is streamed through it.
An index is a suffix array by prefix doubling, a Burrows-Wheeler transform in a wavelet matrix of
packed bit vectors, and ranks from word popcounts.  Passages go through backward search from their
last word to their first, all in lockstep; where no occurrence is left, the match is cut to the longest
shorter prefix that other suffixes share, so that each position gets its matching statistic.  Where it
reaches ``size`` words and the interval holds an earlier place, a window is reported.  Hashes deal
passages and tell that passages are equal: all but the first of equal ones repeat as a whole.

Defined cases: null text has no words; rows that repeat an id are the same document, so that
neither's windows start earlier than the other's equal ones; documents with fewer words than
``size`` are kept whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import textops as T
from tempora.llm.anchors import Passages, holders, keyed, members, own_id, packed, passages, repeated_contexts, senders, signed, unpacked

SIZE, SPAN, GRAM = 20, 13, 8  # the context has SIZE - SPAN + 1 = GRAM words
LEAD = 4  # bits of a passage's words before its anchor, at most SPAN - 1
SHARD_BYTES = 32 << 20  # of all texts per shard, which gets those of their passages that may repeat


def find(col) -> Iterator[tuple[int, T.Words, Passages]]:
    """(first row, words, passages in words) of each chunk of a text column."""
    for i, _, buf, offs in T.chunks(col):
        w = T.Words(buf, offs)
        h = w.hashes()
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * T.powers(T._WBASE, len(h)), out=sums[1:])
        inv = T.powers(T._WBASE_INV, len(sums))
        spell = lambda a, e, sums=sums, inv=inv: T.mix((sums[e] - sums[a]) * inv[a] + (e - a).astype(np.uint64))
        order = (T.window_hash(h, GRAM) >> T.U(32)).astype(np.uint32)
        yield i, w, passages(order, w.bounds, len(h), SIZE, SPAN, spell)


# -- index ----------------------------------------------------------------------------


class BitVector:
    """Packed bits with rank by popcounts: a running count per 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.pad(bits, (0, -len(bits) % 64 + 64)), bitorder="little").view(np.uint64)
        self.words = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        mask = (T.U(1) << (i & 63).astype(np.uint64)) - T.U(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    """Symbols by bit planes from the highest bit on, zeros before ones at each level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[BitVector, int]] = []
        self.bits = bits
        for k in range(bits - 1, -1, -1):
            bit = (symbols >> k) & 1
            self.levels.append((BitVector(bit.astype(bool)), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """Places mapped level by level down the symbols' paths; differences to the symbol's start are its ranks."""
        out = list(places)
        for k, (bits, zeros) in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            for j, x in enumerate(out):
                ones = bits.rank1(x)
                out[j] = np.where(one, zeros + ones, x - ones)
        return out


class FMIndex:
    """Index over texts (lists of symbols from 1 on), for matches of up to ``window`` symbols."""

    def __init__(self, texts: np.ndarray, bounds: np.ndarray, window: int):
        n, m = len(texts), len(bounds) - 1
        # each text ends in a separator of its own, smaller than all symbols
        at = bounds[1:] + np.arange(m)
        whole = np.zeros(n + m, np.int64)
        inside = np.ones(n + m, bool)
        inside[at] = False
        whole[inside] = texts
        rank = whole + m
        rank[at] = np.arange(m)
        size, h, ranks = n + m, 1, {1: rank}
        longest = int(np.diff(bounds).max(initial=0))
        while True:
            nxt = np.zeros(size, np.int64)
            nxt[:-h] = rank[h:] + 1
            key = rank * np.int64(max(size, int(rank.max(initial=0))) + 2) + nxt
            last = 2 * h >= longest  # texts that agree so far are whole and equal, and keep the order of their separators
            order = np.argsort(key, kind="stable" if last else None)
            rank = np.empty(size, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            h *= 2
            ranks[h] = rank
            if last:
                break
        self.sa = order
        self.common = self._common(ranks, window)
        self.borders: dict[int, np.ndarray] = {}
        self.counts = np.bincount(whole)
        self.bwt = WaveletMatrix(whole[self.sa - 1], max(1, int(len(self.counts) - 1).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])  # separators sort first
        self.start = self.bwt.rank(np.arange(len(self.counts)), np.zeros(len(self.counts), np.int64))[0]
        self.window = window

    def _common(self, ranks: dict[int, np.ndarray], most: int) -> np.ndarray:
        """Common prefix of each suffix with the one before it in order, at most ``most``; 0 at both ends."""
        i, j = self.sa[:-1], self.sa[1:]
        out = np.zeros(len(i), np.int64)
        for h in sorted(ranks, reverse=True):
            x = np.minimum(np.stack([i, j]) + out, len(self.sa) - 1)
            out += np.where(ranks[h][x[0]] == ranks[h][x[1]], h, 0)
        return np.concatenate([[0], np.minimum(out, most), [0]]).astype(np.uint8)

    def _border(self, length: int) -> np.ndarray:
        """Where suffixes begin to differ from the one before within ``length`` symbols."""
        if length not in self.borders:
            self.borders[length] = np.flatnonzero(self.common < length).astype(np.int32)
        return self.borders[length]

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of symbol + pattern."""
        a, b = self.bwt.rank(symbol, lo, hi)
        base = self.first[symbol] - self.start[symbol]
        return base + a, base + b

    def cut(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The wider intervals of the first ``length`` symbols."""
        lo, hi = lo.copy(), hi.copy()
        for k in np.unique(length).tolist():
            mine, border = np.flatnonzero(length == k), self._border(k) if k else np.array([0, len(self.sa)])
            g = np.searchsorted(border, lo[mine], "right")
            lo[mine], hi[mine] = border[g - 1], border[g]
        return lo, hi

    def statistics(self, texts: np.ndarray, bounds: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position of the given texts, the longest match from there on (``window`` at most), and, of
        matches that long, the least ``place`` of the occurrences (-1 for shorter ones).

        place: a rank of each position of the indexed texts (separators included).
        """
        full = self._border(self.window)
        least = np.minimum.reduceat(place[self.sa], full[:-1])
        lengths = np.diff(bounds)
        stat, out = np.zeros(len(texts), np.int64), np.full(len(texts), -1, np.int64)
        lo, hi, n = np.zeros(len(lengths), np.int64), np.full(len(lengths), len(self.sa), np.int64), np.zeros(len(lengths), np.int64)
        for k in range(int(lengths.max(initial=0))):
            live = np.flatnonzero(lengths > k)
            at = bounds[1:][live] - 1 - k
            symbol, a, b, l = texts[at], lo[live], hi[live], n[live]
            known = symbol < len(self.counts)
            known[known] = self.counts[symbol[known]] > 0
            a[~known], b[~known], l[~known] = 0, len(self.sa), 0  # no match holds a symbol that the index lacks
            todo = np.flatnonzero(known)
            while len(todo):
                x, y = self.step(symbol[todo], a[todo], b[todo])
                some = x < y
                done, todo = todo[some], todo[~some]
                a[done], b[done], l[done] = x[some], y[some], l[done] + 1
                if len(todo):  # no such occurrence: cut the match where other suffixes go on
                    l[todo] = np.maximum(self.common[a[todo]], self.common[b[todo]])
                    a[todo], b[todo] = self.cut(a[todo], b[todo], l[todo])
            stat[at] = l
            hit = np.flatnonzero(l == self.window)
            if len(hit):  # report, then forget the last symbol
                out[at[hit]] = least[np.searchsorted(full, a[hit], "right") - 1]
                l[hit] -= 1
                a[hit], b[hit] = self.cut(a[hit], b[hit], l[hit])
            lo[live], hi[live], n[live] = a, b, l
        return stat, out


# -- tasks ----------------------------------------------------------------------------


_SENT = "part int, context binary, passage binary, slot binary, at binary, words binary"


def _packed(seen: dict[tuple[int, int], list], parts: int) -> pa.RecordBatch:
    """One compressed row a shard: passages in order of their words, so that like ones lie together."""
    by: dict[int, list] = {}
    for (context, passage), (slot, at, words) in seen.items():
        by.setdefault(context % parts, []).append((words, context, passage, slot, at))
    rows = []
    for part, items in by.items():
        words, *numbers = zip(*sorted(items), strict=True)
        rows.append((part, *(np.array(x, "<i8").tobytes() for x in numbers), zstandard.compress(b"\n".join(words), 1)))
    kinds = (pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "context", "passage", "slot", "at", "words"])


def _sent(parts: int):
    """Senders -> the words of each passage, once per task, with its earliest place there, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list] = {}
        for b in T.slices(batches, 2):
            slots = b.column(0).to_pylist()
            for i, w, p in find(unpacked(b.column(2))):
                want = members(p.context, i + p.doc, b.column(3), i, len(w.count)) | members(p.context, i + p.doc, b.column(4), i, len(w.count))
                p = Passages(*(x[want] for x in p))
                raw = w.buf.tobytes()
                at = ((p.first - w.bounds[p.doc]) << LEAD) | (p.anchor - p.first)
                for c, s, d, t, f, e in zip(p.context.view(np.int64).tolist(), p.passage.view(np.int64).tolist(), p.doc.tolist(), at.tolist(), w.start[p.first].tolist(), w.end[p.last + SIZE - 1].tolist(), strict=True):
                    me = (slots[i + d], t)
                    got = seen.get((c, s))
                    if got is None:
                        seen[c, s] = [*me, b" ".join(raw[f:e].split())]
                    elif me < (got[0], got[1]):
                        got[:2] = me
                if len(seen) > 100_000:
                    yield _packed(seen, parts)
                    seen.clear()
        if seen:
            yield _packed(seen, parts)

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the passages of repeated contexts lie."""
    for b in T.slices(batches, 2):
        slots, marks = b.column(0).to_numpy(), b.column(1).to_numpy()
        for i, w, p in find(unpacked(b.column(2))):
            want = members(p.context, i + p.doc, b.column(3), i, len(w.count))
            doc = p.doc[want]
            yield pa.RecordBatch.from_arrays([signed(p.context[want]), signed(p.passage[want]), pa.array(slots[i + doc]), pa.array(marks[i + doc]), pa.array((p.first[want] - w.bounds[doc]).astype(np.int32))], names=["context", "passage", "slot", "mark", "at"])


def _earlier(text: np.ndarray, cut: np.ndarray, place: np.ndarray, context: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Words of passages at which a window starts that an earlier passage of its context holds.

    text, place: words as numbers, and the places of each in the corpus; cut: passage i has words cut[i]:cut[i + 1];
    turn: a number by which the passages of one context are in order of their places.
    """
    order = np.lexsort((turn, context))
    new = np.ones(len(order), bool)
    new[1:] = context[order][1:] != context[order][:-1]
    begin = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rank, many = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - begin[group]
    many[order] = np.diff(np.append(begin, len(order)))[group]
    starts = np.diff(cut) - SIZE + 1  # windows of each passage
    found = np.zeros(len(text), bool)

    def picked(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words of the passages, and their bounds."""
        n = np.diff(cut)[which]
        bounds = np.concatenate([[0], np.cumsum(n)])
        return np.arange(bounds[-1]) + np.repeat(cut[which] - bounds[:-1], n), bounds

    for level in range(int(many.max(initial=1) - 1).bit_length() - 1, -1, -1):
        later = (rank >> level & 1) == 1
        met = np.concatenate([[0], np.cumsum(found)])
        streamed = np.flatnonzero(later & (np.diff(met[cut]) < starts))  # those of which all windows are found are done
        indexed = np.flatnonzero(~later & (((rank >> level) + 1 << level) < many))
        if not len(streamed):
            continue
        inner, bounds = picked(indexed)
        whole = np.full(len(inner) + len(indexed), np.iinfo(np.int64).max)
        inside = np.ones(len(whole), bool)
        inside[bounds[1:] + np.arange(len(indexed))] = False
        whole[inside] = place[inner]
        index = FMIndex(text[inner], bounds, SIZE)
        mine, bounds = picked(streamed)
        _, first = index.statistics(text[mine], bounds, whole)
        found[mine] |= (first >= 0) & (first < place[mine])
    return found


def _search_shard(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """First place of each distinct passage of a shard, and which of its windows start earlier, as runs."""
    context, passage, slot, at = (np.concatenate([np.frombuffer(x, "<i8") for x in rows[c]]) for c in ("context", "passage", "slot", "at"))
    spelled = [w for x in rows["words"] for w in zstandard.decompress(x).split(b"\n")]
    order = np.lexsort((at, slot, passage, context))
    new = np.ones(len(order), bool)
    new[1:] = (context[order][1:] != context[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    keep = order[new]  # one row a passage, its earliest
    context, passage, slot, at = (x[keep] for x in (context, passage, slot, at))
    lead, at = at & (1 << LEAD) - 1, at >> LEAD
    number: dict[bytes, int] = {}
    texts: list[int] = []
    bounds = [0]
    for k in keep.tolist():
        words = spelled[k].split()
        for w in words:
            if w not in number:
                number[w] = len(number) + 1
        texts += map(number.__getitem__, words)
        bounds.append(len(texts))
    text, cut = np.array(texts, np.int64), np.array(bounds)
    del spelled, texts, number
    _, who = np.unique(slot, return_inverse=True)
    own = np.repeat(np.arange(len(keep)), np.diff(cut))
    place = (who[own] << 32) | (at[own] + np.arange(len(text)) - cut[own])  # documents in order, then words in order
    # equal windows lie alike around their anchors, so that the anchors' order is theirs
    holds = np.flatnonzero(_earlier(text, cut, place, context, (who << 32) | (at + lead)))
    o = own[holds]
    begins = np.ones(len(holds), bool)
    begins[1:] = (holds[1:] != holds[:-1] + 1) | (o[1:] != o[:-1])
    b = np.flatnonzero(begins)
    length = np.diff(np.append(b, len(holds)))
    rows_of = np.searchsorted(o[b], np.arange(len(keep) + 1))
    lists = [np.split(x, rows_of[1:-1]) if len(keep) else [] for x in ((holds - cut[o])[b], length)]
    return pd.DataFrame({"context": context, "passage": passage, "first_slot": slot, "first_at": at, "windows": np.diff(cut) - SIZE + 1, **dict(zip(("j", "n"), lists, strict=True))})


def repeats(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(slot, mark, spots): starts of the windows of keyed rows that also start earlier."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    contexts = repeated_contexts(rows, find)
    sent = senders(texts, contexts).mapInArrow(_sent(parts), _SENT)
    found = sent.groupBy("part").applyInPandas(_search_shard, "context long, passage long, first_slot long, first_at int, windows int, j array<int>, n array<int>")
    places = holders(texts, contexts).mapInArrow(_places, "context long, passage long, slot long, mark long, at int")
    # a passage that lies elsewhere before repeats as a whole, its first occurrence where others hold its windows
    again = (F.col("slot") > F.col("first_slot")) | ((F.col("slot") == F.col("first_slot")) & (F.col("at") > F.col("first_at")))
    spot = lambda at, n: F.struct(at.alias("at"), n.alias("n"))
    runs = F.transform(F.arrays_zip("j", "n"), lambda r: spot(F.col("at") + r["j"], r["n"]))
    spots = F.when(again, F.array(spot(F.col("at"), F.col("windows")))).otherwise(runs)
    return places.join(found, ["context", "passage"]).select("slot", "mark", spots.alias("spots")).where(F.size("spots") > 0).groupBy("slot", "mark").agg(F.flatten(F.collect_list("spots")).alias("spots"))


def repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the words kept, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, 1):
            total, gone_n, sha = [], [], []
            for t, spots in zip(unpacked(b.column(1)).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = t.encode().split()  # bytes.split cuts at exactly \x20 and \x09-\x0D
                gone, n = 0, len(words)
                if spots:
                    d = np.zeros(n + 1, np.int64)
                    for s in spots:  # windows from at on, each SIZE words
                        d[s["at"]] += 1
                        d[s["at"] + s["n"] - 1 + SIZE] -= 1
                    covered = np.cumsum(d)[:n] > 0
                    gone = int(covered.sum())
                    words = compress(words, (~covered).tolist())
                total.append(n)
                gone_n.append(gone)
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(sha, pa.string())], names=["slot", "n_words", "n_removed", "kept_sha256"])

    rows = keyed(docs, doc_id, text)
    texts = packed(rows)
    out = texts.join(repeats(rows, texts), ["slot", "mark"], "left").select("slot", "packed", "spots").mapInArrow(run, "slot long, n_words long, n_removed long, kept_sha256 string")
    return out.select(own_id(docs.schema[doc_id].dataType.simpleString()).alias(doc_id), "n_words", "n_removed", "kept_sha256")


#: the same for another engine: every window of 20 words
SUBSTRING_SQL = r"""WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM words),
windows AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS g FROM places),
marked AS (SELECT doc_id, i, word, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM windows),
cover AS (SELECT doc_id, i, word, coalesce(i - max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i) < 20, false) AS gone FROM marked),
found AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM cover GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words w LEFT JOIN found f USING (doc_id)"""
