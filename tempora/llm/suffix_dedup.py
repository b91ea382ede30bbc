"""Suffix-array deduplication of byte strings that occur more than once.

Every byte covered by a ``size``-byte string that also starts anywhere else is removed.  The
suffixes worth sorting are those at anchors (see ``anchors``) whose context repeats.  Each task sorts
its suffixes into a run, front-coded by the common prefix with the suffix before; runs are exchanged
by a hash of the context, which all candidates for a match share, so that each partition merges one
slice of the suffix array.  A loser tree merges the runs: its nodes keep the common prefix with the
string that beat them, and no byte of a known prefix is compared again.

What repeats is read off that order.  A window that starts o bytes left of an anchor repeats if
another suffix has ``size - o`` bytes in common to the right and o bytes to the left.  Suffixes with
so much in common to the right are neighbours in the order, and the texts left of the anchors,
ordered from their ends, give the other half the same way; two suffixes with both classes in
common hold the same window.  Hashes deal contexts to partitions and name passages; they decide nothing.

``size`` is a parameter (400 bytes unless asked otherwise).  Several lengths are read off one order: a
longer window begins with one of the least length, so equal ones share that one's anchor; suffixes then
go on as far as the greatest length asks, and each length looks at its own common prefixes.  Partitions are as many as the bytes of
the suffixes ask for.  Defined cases: null text counts as empty; rows that repeat an id are documents
of their own, so their equal strings count as repeats; matches never cross documents; texts shorter
than ``size`` are kept whole; an empty table gives an empty result; further columns are ignored by
:func:`repeated_bytes` and carried by :func:`drop_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import textops as T
from tempora.llm.anchors import NO_ID, Passages, keyed, members, own_id, packed, passages, shared_contexts, signed, unpacked
from tempora.llm.shared import free_name, written

SIZE, GRAM = 400, 32
RUN_BYTES = 24 << 20  # of the suffixes that a task sorts at a time
PART_BYTES = 16 << 20  # of the suffixes of a partition, about
FIND_BYTES = 1 << 19  # of the texts whose anchors are found at a time


def span(size: int) -> int:
    """Starts of a window's grams among which its anchor is chosen; the rest of the window is the anchor's context."""
    return size * 8 // 25


def finder(size: int, reach: int | None = None):
    """texts -> (first row, (bytes, offsets), passages) of each chunk of a text column."""
    gram = min(GRAM, size - span(size) + 1)

    def find(col) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray], Passages]]:
        for i, _, buf, offs in T.chunks(col, FIND_BYTES):
            h = T.prefix_hash(buf)
            yield i, (buf, offs), passages(T.gram_order(h, gram), offs, len(buf), size, span(size), lambda a, e, h=h: T.range_hash(h, a, e), reach)

    return find


# -- sorted runs ----------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings whose first ``known`` bytes agree."""
    n = min(len(a), len(b))
    h = known
    while h < n:
        x, y = a[h : h + 64], b[h : h + 64]
        if x == y:
            h += 64
            continue
        m = min(len(x), len(y))
        d = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
        return h + (m - (d.bit_length() + 7) // 8 if d else m)
    return n


def front_code(rights: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Common prefix with the string before, and the rest, of sorted strings."""
    lcp, tails, prev = np.zeros(len(rights), np.int32), [], b""
    for k, s in enumerate(rights):
        h = common_prefix(prev, s, 0)
        lcp[k] = h
        tails.append(s[h:])
        prev = s
    return lcp, tails


class Run:
    """A decoded run: its strings in order, and each one's common prefix with the one before."""

    def __init__(self, lcp: np.ndarray, lengths: np.ndarray, tails: bytes):
        self.lcp, self.lengths, self.tails = lcp.tolist(), lengths.tolist(), tails
        self.i, self.at, self.text = -1, 0, b""

    def step(self) -> bool:
        self.i += 1
        if self.i >= len(self.lcp):
            return False
        n = self.lengths[self.i]
        self.text = self.text[: self.lcp[self.i]] + self.tails[self.at : self.at + n]
        self.at += n
        return True


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int, bytes]]:
    """(common prefix with the string before, run, place in the run, string) of all strings in order.

    tree[1..] holds losers as (run, common prefix with the string that beat it); a run that is over
    loses to every other.  A challenger with a longer common prefix with the last winner is the
    smaller one, and only on a tie are bytes compared, from the common prefix on.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    alive = [r.step() for r in runs] + [False] * (k - len(runs))

    def play(a: int, ha: int, b: int, hb: int) -> tuple[int, int, int, int]:
        """(winner, its prefix with the last winner, loser, its prefix with this winner)."""
        if not alive[b]:
            return a, ha, b, 0
        if not alive[a]:
            return b, hb, a, 0
        if ha > hb:
            return a, ha, b, hb
        if hb > ha:
            return b, hb, a, ha
        x, y = runs[a].text, runs[b].text
        h = common_prefix(x, y, ha)
        return (a, ha, b, h) if x[h : h + 1] < y[h : h + 1] or (len(x) == h and len(y) == h and a < b) else (b, ha, a, h)

    tree: list[tuple[int, int]] = [(0, 0)] * k

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, 0
        a, ha = build(2 * node)
        b, hb = build(2 * node + 1)
        w, hw, loser, hl = play(a, ha, b, hb)
        tree[node] = (loser, hl)
        return w, hw

    win, h = build(1) if k > 1 else (0, 0)
    while runs and alive[win]:
        r = runs[win]
        yield h, win, r.i, r.text
        alive[win] = r.step()
        cur, h = win, (r.lcp[r.i] if alive[win] else 0)
        node = (win + k) // 2
        while node >= 1:
            other, ho = tree[node]
            cur, h, loser, hl = play(cur, h, other, ho)
            tree[node] = (loser, hl)
            node //= 2
        win = cur


# -- tasks ----------------------------------------------------------------------------

_RUN = "part int, lcp binary, tail_n binary, tails binary, left_n binary, lefts binary, context binary, passage binary, copies binary"


def _encode_run(part: int, rows: list[tuple[bytes, bytes, int, int, int]]) -> tuple:
    """rows: (right, left, context, passage, copies)."""
    rows.sort(key=lambda r: (r[0], r[1]))
    lcp, tails = front_code([r[0] for r in rows])
    small = lambda xs, kind: zstandard.compress(np.array(xs, kind).tobytes(), 1)
    return (
        part, small(lcp, "<u2"), small([len(t) for t in tails], "<u2"), zstandard.compress(b"".join(tails), 1), small([len(r[1]) for r in rows], "<u2"), zstandard.compress(b"".join(r[1] for r in rows), 1),
        *(np.array([r[k] for r in rows], "<i8").tobytes() for k in (2, 3)), small([min(r[4], 2) for r in rows], "<u1"),
    )


def _sorted_runs(parts: int, size: int, reach: int):
    """Holders -> front-coded sorted runs of the suffixes at their anchors, by partition."""
    names = [f.split()[0] for f in _RUN.split(", ")]

    def encoded(seen: dict) -> pa.RecordBatch:
        by: dict[int, list] = {}
        for (left, right), (context, passage, n) in seen.items():
            by.setdefault(context % parts, []).append((right, left, context, passage, n))
        runs = zip(*(_encode_run(p, rows) for p, rows in by.items()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(runs)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[bytes, bytes], list] = {}
        held = 0
        for b in T.slices(batches, 2):
            for i, (buf, offs), p in finder(size, reach)(unpacked(b.column(2))):
                want = members(p.context, i + p.doc, b.column(3), i, len(offs) - 1)
                p = Passages(*(x[want] for x in p))
                raw = buf.tobytes()
                for c, s, a, f, e in zip(p.context.view(np.int64).tolist(), p.passage.view(np.int64).tolist(), p.anchor.tolist(), p.first.tolist(), p.end.tolist(), strict=True):
                    key = (raw[f:a], raw[a:e])
                    got = seen.get(key)
                    if got is None:
                        seen[key] = [c, s, 1]
                        held += e - f + 300
                    else:
                        got[2] += 1
                if held > RUN_BYTES:
                    yield encoded(seen)
                    seen.clear()
                    held = 0
        if seen:
            yield encoded(seen)

    return run


def _places(size: int, reach: int):
    """Holders -> where the passages of repeated contexts lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, 2):
            slots, marks = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, (_, offs), p in finder(size, reach)(unpacked(b.column(2))):
                want = members(p.context, i + p.doc, b.column(3), i, len(offs) - 1)
                doc = p.doc[want]
                yield pa.RecordBatch.from_arrays([signed(p.context[want]), signed(p.passage[want]), pa.array(slots[i + doc]), pa.array(marks[i + doc]), pa.array((p.first[want] - offs[doc]).astype(np.int32))], names=["context", "passage", "slot", "mark", "at"])

    return run


def repeated_windows(lefts: list[bytes], rights: np.ndarray, lcp: np.ndarray, copies: np.ndarray, sizes: tuple[int, ...] = (SIZE,)) -> list[list[np.ndarray]]:
    """For each length, ascending, which windows of each entry, from its first on, repeat.

    Entries are in the order of their rights; rights: their lengths, lcp: common prefix of each right with
    the one before, lefts: the texts before them, copies: how often each entry occurs.
    """
    n = len(lefts)
    left_n = np.array([len(x) for x in lefts], np.int64)
    reverse = [x[::-1] for x in lefts]
    order = np.array(sorted(range(n), key=reverse.__getitem__), np.int64)
    left_lcp = np.array([0, *(common_prefix(reverse[a], reverse[b], 0) for a, b in zip(order[:-1], order[1:], strict=True))], np.int64)[:n]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    found, known = [], np.ones((n, int(left_n.max(initial=-1)) + 1), bool)
    for size in sizes:
        hits = np.zeros(known.shape, bool)
        hits[copies > 1] = True
        for o in range(hits.shape[1]):
            # a longer window repeats only where the shorter one that it begins with does
            has = np.flatnonzero(known[:, o] & (left_n >= o) & (rights >= size - o))
            if len(has) > 1:
                right_class, left_class = np.cumsum(lcp < size - o)[has], np.cumsum(left_lcp < o)[place[has]]
                hits[has[T.repeated(right_class * np.int64(n + 1) + left_class)], o] = True
        found.append([h[max(0, size - b) : a + 1][::-1] for h, a, b in zip(hits, left_n.tolist(), rights.tolist(), strict=True)])
        known = hits
    return found


def _merge_part(sizes: tuple[int, ...]):
    def run(_: tuple, runs: pd.DataFrame) -> pd.DataFrame:
        plain = zstandard.decompress
        decoded, extra = [], []
        for r in runs.itertuples(index=False):
            decoded.append(Run(np.frombuffer(plain(r.lcp), "<u2"), np.frombuffer(plain(r.tail_n), "<u2"), plain(r.tails)))
            cut = np.concatenate([[0], np.cumsum(np.frombuffer(plain(r.left_n), "<u2").astype(np.int64))]).tolist()
            extra.append((plain(r.lefts), cut, *(np.frombuffer(x, "<i8").tolist() for x in (r.context, r.passage)), np.frombuffer(plain(r.copies), "<u1").tolist()))
        names, lefts, rights, lcps, copies = [], [], [], [], []
        same: dict[bytes, int] = {}  # left -> entry, among those with the last right
        for h, run, i, text in merge(decoded):
            left_all, cut, context, passage, times = extra[run]
            left = left_all[cut[i] : cut[i + 1]]
            if not rights or h < len(text) or rights[-1] != len(text):
                same.clear()
            if left in same:  # the same passage from another task
                copies[same[left]] += times[i]
                continue
            same[left] = len(lefts)
            names.append((context[i], passage[i]))
            lefts.append(left)
            rights.append(len(text))
            lcps.append(h)
            copies.append(times[i])
        masks = repeated_windows(lefts, np.array(rights, np.int64), np.array(lcps, np.int64), np.array(copies, np.int64), sizes)
        keep = [k for k, m in enumerate(masks[0]) if m.any()]
        out = pd.DataFrame({"context": [names[k][0] for k in keep], "passage": [names[k][1] for k in keep]}, dtype="int64")
        for j, flags in enumerate(masks):
            out[f"mask{j}"] = [np.packbits(flags[k]).tobytes() if flags[k].any() else b"" for k in keep]
        del decoded, extra, same, lefts, masks
        T.give_back()
        return out

    return run


def repeats(rows: DataFrame, texts: DataFrame, *sizes: int) -> DataFrame:
    """(slot, mark, spots): (at, mask0, ..) start and window flags, by ascending length, of the passages of keyed rows in which windows repeat."""
    sizes = tuple(sorted(sizes))
    size, reach = sizes[0], sizes[-1]
    masks = [f"mask{j}" for j in range(len(sizes))]
    contexts = written(shared_contexts(rows, finder(size)))
    total = contexts.agg(F.sum(F.size("contexts"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * (reach + span(size)) // PART_BYTES))
    holders = texts.join(contexts, ["slot", "mark"]).select("slot", "mark", "packed", "contexts")
    merged = holders.mapInArrow(_sorted_runs(parts, size, reach), _RUN).groupBy("part").applyInPandas(_merge_part(sizes), "context long, passage long, " + ", ".join(f"{m} binary" for m in masks))
    places = holders.mapInArrow(_places(size, reach), "context long, passage long, slot long, mark long, at int")
    return places.join(merged, ["context", "passage"]).groupBy("slot", "mark").agg(F.collect_list(F.struct("at", *masks)).alias("spots"))


def removed(n: int, at: list[int], masks: list[bytes], size: int = SIZE) -> np.ndarray:
    """True for each of n bytes that a repeated window covers; masks hold the window flags from each start on."""
    flags = np.zeros(n + 8, bool)
    for a, m in zip(at, masks, strict=True):
        f = np.unpackbits(np.frombuffer(m, np.uint8)).view(bool)
        flags[a : a + len(f)] |= f[: len(flags) - a]
    return T.covered(np.flatnonzero(flags[: n + 1]), size, n)


def _kept(b: pa.RecordBatch, text: int, spots: int, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, list[np.ndarray | None]]]:
    """(bytes, for each ascending length the flags of the bytes removed, None for none) of each row."""
    lists = b.column(spots)
    lo, null = np.asarray(lists.offsets), np.asarray(lists.is_null())
    own = lists.values.slice(int(lo[0]), int(lo[-1] - lo[0]))
    lo, at, masks = lo - lo[0], own.field("at").to_pylist(), [own.field(f"mask{j}").to_pylist() for j in range(len(sizes))]
    for i, _, buf, offs in T.chunks(unpacked(b.column(text)) if pa.types.is_binary(b.column(text).type) else b.column(text)):
        for d in range(len(offs) - 1):
            raw, a, e = buf[offs[d] : offs[d + 1]], lo[i + d], lo[i + d + 1]
            none = null[i + d] or a == e
            yield raw, [None if none or not any(m[a:e]) else removed(len(raw), at[a:e], m[a:e], n) for n, m in zip(sizes, masks, strict=True)]


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, also: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the bytes kept, of every document.

    also: a length shorter than ``size``; n_in_passages then counts the bytes that repeated strings of that length cover.
    """
    lengths = (size,) if also is None else (also, size)
    names = ["slot", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_in_passages"][: 4 + len(lengths)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, 1):
            out: list[tuple] = []
            for raw, (*near, gone) in _kept(b, 1, 2, lengths):
                more = [0 if x is None else int(x.sum()) for x in near]
                if gone is None:
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), *more))
                else:
                    out.append((len(raw), int(gone.sum()), int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])), hashlib.sha256(raw[~gone].tobytes()).hexdigest(), *more))
            cols = list(zip(*out, strict=True)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string() if n == "kept_sha256" else pa.int64()) for n, c in zip(names[1:], cols, strict=True))], names=names)

    rows = keyed(docs, doc_id, text)
    texts = packed(rows)
    kinds = ", ".join(f"{n} {'string' if n == 'kept_sha256' else 'long'}" for n in names)
    out = texts.join(repeats(rows, texts, *lengths), ["slot", "mark"], "left").select("slot", "packed", "spots").mapInArrow(run, kinds)
    return out.select(own_id(docs.schema[doc_id].dataType.simpleString()).alias(doc_id), *names[1:])


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """The documents with all their columns, the repeated bytes gone from their texts.

    Bytes of a character that is cut are dropped with it.
    """
    rows = keyed(docs, doc_id, text)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = columns.index(text)
        for b in T.slices(batches, k):
            new = [(raw if gone is None else raw[~gone]).tobytes().decode("utf-8", "ignore") for raw, (gone,) in _kept(b, k, len(columns), (size,))]
            texts = pa.array(new, pa.string())
            if b.column(k).null_count:
                texts = pa.compute.if_else(b.column(k).is_null(), pa.scalar(None, pa.string()), texts)
            yield pa.RecordBatch.from_arrays([*b.columns[:k], texts, *b.columns[k + 1 : len(columns)]], names=columns)

    slot, mark, spots = (free_name(docs, n) for n in ("slot", "mark", "spots"))
    found = repeats(rows, packed(rows), size).withColumnsRenamed({"slot": slot, "mark": mark, "spots": spots})
    own = (F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)) == F.col(slot)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(mark))
    return docs.join(found, own, "left").select(*columns, spots).mapInArrow(run, docs.schema)


def suffix_sql(size: int, also: int) -> str:
    """The same for another engine, with every window by its digest."""
    windows = "CASE WHEN i + {0} <= n THEN md5(h[2 * i + 1:2 * i + 2 * {0}]) END"
    again = "{0} IS NOT NULL AND count(*) OVER (PARTITION BY {0}) > 1"
    gone = "coalesce(i - max(CASE WHEN {1} THEN i END) OVER (PARTITION BY doc_id ORDER BY i) < {0}, false)"
    return f"""WITH sized AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, len(h) // 2 AS n FROM documents),
places AS (SELECT doc_id, unnest(range(n)) AS i, h, n FROM sized),
windows AS (SELECT doc_id, i, h[2 * i + 1:2 * i + 2] AS byte, {windows.format(size)} AS w, {windows.format(also)} AS v FROM places),
marked AS (SELECT doc_id, i, byte, {again.format("w")} AS long, {again.format("v")} AS short FROM windows),
cover AS (SELECT doc_id, i, byte, {gone.format(size, "long")} AS gone, {gone.format(also, "short")} AS near FROM marked),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM cover),
found AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS kept, count(*) FILTER (near) AS n_in_passages FROM edges GROUP BY doc_id)
SELECT s.doc_id, s.n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256, coalesce(n_in_passages, 0) AS n_in_passages
FROM sized s LEFT JOIN found f USING (doc_id)"""
