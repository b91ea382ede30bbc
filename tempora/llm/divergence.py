"""Source divergence audit: how far each source's term distribution is from other sources' and from its language's.

Tasks count terms in radix tries of bytes.  A node's edge holds eight bytes, read as one big number, so
that the children of a node in order of their numbers are in order of their bytes; each term ends in a
leaf with a counter for each group (language and source) and one for the documents of each language.
Tries are built and merged level by level: nodes of equal parents and edges become one, and bytes
above a node are never looked at again.  A task sends its trie in slices, cut at its first edges into
ranges of about equally many terms; each range is merged as the slices stream in.  A walk in order of bytes over a merged
range passes on the terms that enough documents hold, in blocks of at most TERMS, with what each source counts.

Shares are integers, p = 1 + floor(SCALE * (count + 5) / (N + 5 * V)), by long division, so that nothing
overflows below 9e15 terms.  Blocks of terms meet the list of their language's sources, SOURCES of
them at a time against all: part ``pair`` sums |p - q| over all kept terms, part ``term`` takes from each
block a source's first candidates, in order of bytes among equal ones, and ranks those of all blocks.

Defined cases: null text, lang and source count as ''; a text without terms adds its group only; repeated
rows count as often as they come; a language without kept terms has pairs of value 0 and no terms; a
group that is alone in its language has no pairs; an empty table gives an empty result; further columns are ignored.
The sources of one language, whose pairs are the result, are a list in one row; nothing else is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm import textops as T
from tempora.llm.shared import sampled, written

LEAST_DOCUMENTS, TOP, SCALE = 30, 50, 10**9
HELD = 600_000  # nodes and counters that a task holds before it sends them
TERMS = 4096  # terms of a block
SOURCES = 512  # sources that a task compares with all others at a time
SAMPLE = 2_000  # documents whose terms show where to cut ranges

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


# -- tries ----------------------------------------------------------------------------


def _distinct(parent: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (parent, edge) in order, and the place of each row among them."""
    if len(parent) and (parent == parent[0]).all():
        u, inverse = np.unique(edge, return_inverse=True)
        return np.full(len(u), parent[0], np.int64), u, inverse
    order = np.lexsort((edge, parent))
    p, e = parent[order], edge[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (e[1:] != e[:-1])
    inverse = np.empty(len(p), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return p[new], e[new], inverse


def _summed(leaf: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counters with those of the same leaf and key added up."""
    order = np.lexsort((key, leaf))
    leaf, key, n = leaf[order], key[order], n[order]
    new = np.ones(len(leaf), bool)
    new[1:] = (leaf[1:] != leaf[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return leaf[at], key[at], np.add.reduceat(n, at) if len(at) else n


class Trie:
    """Levels of nodes (parent's place in the level above, edge of eight bytes), and counters (leaf, key, n).

    Nodes are numbered level after level.  Edges end with zero bytes where a term ends inside them; no term
    holds a zero byte.  ``counts`` has groups as keys, ``holds`` languages.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], counts: tuple, holds: tuple):
        self.levels, self.counts, self.holds = levels, counts, holds

    def __len__(self) -> int:
        return sum(len(p) for p, _ in self.levels) + len(self.counts[0]) + len(self.holds[0])

    @staticmethod
    def of(buf: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, group: np.ndarray, lang: np.ndarray) -> Trie:
        """The trie of the terms buf[start:end] of documents whose group and language are given."""
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        words = np.ndarray(len(buf) + 1, ">u8", padded, strides=(1,))
        levels, leaf = [], np.zeros(len(start), np.int64)
        rows, parent, at, base = np.arange(len(start)), np.zeros(len(start), np.int64), start, 0
        while len(rows):
            left = end[rows] - at
            drop = (np.maximum(8 - left, 0) * 8).astype(np.uint64)
            edge = words[at].astype(np.uint64) >> drop << drop
            p, e, place = _distinct(parent, edge)
            levels.append((p, e))
            leaf[rows] = base + place
            base += len(p)
            on = left > 8
            rows, parent, at = rows[on], place[on], at[on] + 8
        one = np.ones(len(leaf), np.int64)
        seen = np.unique(leaf * np.int64(len(group) + 1) + doc)  # a document counts once for each of its terms
        held, by = seen // (len(group) + 1), seen % (len(group) + 1)
        return Trie(levels, _summed(leaf, group[doc], one), _summed(held, lang[by], np.ones(len(held), np.int64)))

    @staticmethod
    def merged(tries: list[Trie]) -> Trie:
        levels, base = [], 0
        names = [np.zeros(sum(len(p) for p, _ in t.levels), np.int64) for t in tries]  # a node's number after merging
        above = [np.zeros(1, np.int64)] * len(tries)
        begin = [0] * len(tries)
        for k in range(max((len(t.levels) for t in tries), default=0)):
            own = [i for i, t in enumerate(tries) if k < len(t.levels)]
            parent = np.concatenate([above[i][tries[i].levels[k][0]] for i in own])
            p, e, place = _distinct(parent, np.concatenate([tries[i].levels[k][1] for i in own]))
            levels.append((p, e))
            done = 0
            for i in own:
                n = len(tries[i].levels[k][0])
                above[i] = place[done : done + n]
                names[i][begin[i] : begin[i] + n] = base + above[i]
                begin[i] += n
                done += n
            base += len(p)
        both = []
        for part in ("counts", "holds"):
            cols = [getattr(t, part) for t in tries]
            both.append(_summed(np.concatenate([names[i][c[0]] for i, c in enumerate(cols)]), np.concatenate([c[1] for c in cols]), np.concatenate([c[2] for c in cols])))
        return Trie(levels, *both)

    def cut(self, borders: np.ndarray) -> Iterator[tuple[int, Trie]]:
        """(range, its part of the trie) by the first edges: range r holds those from borders[r - 1] on, below borders[r]."""
        if not self.levels:
            return
        first = np.searchsorted(borders, self.levels[0][1], "right")
        for r in np.unique(first).tolist():
            lo, hi = np.searchsorted(first, [r, r + 1])
            levels, spans, base = [], [], 0
            for parent, edge in self.levels:
                if levels:
                    lo, hi = np.searchsorted(parent, [lo, hi])
                if lo == hi:
                    break
                levels.append((parent[lo:hi] - (spans[-1][0] - spans[-1][2] if spans else 0), edge[lo:hi]))
                spans.append((base + lo, base + hi, base))
                base += len(parent)
            shift = np.concatenate([[0], np.cumsum([e - a for a, e, _ in spans])])
            parts = []
            for leaf, key, n in (self.counts, self.holds):
                cols = []
                for k, (a, e, _) in enumerate(spans):
                    i, j = np.searchsorted(leaf, [a, e])
                    cols.append((leaf[i:j] - a + shift[k], key[i:j], n[i:j]))
                parts.append(tuple(np.concatenate(c) for c in zip(*cols, strict=True)))
            yield r, Trie(levels, *parts)

    def preorder(self) -> np.ndarray:
        """Each node's place in a walk in order of bytes."""
        sizes = [np.ones(len(p), np.int64) for p, _ in self.levels]
        for k in range(len(self.levels) - 1, 0, -1):
            np.add.at(sizes[k - 1], self.levels[k][0], sizes[k])
        places, above = [], np.array([-1], np.int64)
        for (parent, _), size in zip(self.levels, sizes, strict=True):
            before = np.cumsum(size) - size
            first = np.searchsorted(parent, parent)  # a node's first sibling
            places.append(above[parent] + 1 + before - before[first])
            above = places[-1]
        return np.concatenate([np.zeros(0, np.int64), *places])

    def terms(self, leaves: np.ndarray) -> list[str]:
        bases = np.cumsum([0, *(len(p) for p, _ in self.levels)])
        out = []
        for leaf in leaves.tolist():
            k = int(np.searchsorted(bases, leaf, "right")) - 1
            at, edges = leaf - int(bases[k]), []
            for level in range(k, -1, -1):
                parent, edge = self.levels[level]
                edges.append(int(edge[at]).to_bytes(8, "big"))
                at = int(parent[at])
            out.append(b"".join(reversed(edges)).rstrip(b"\0").decode())
        return out

    def dump(self) -> bytes:
        cols = [x for level in self.levels for x in level] + [*self.counts, *self.holds]
        head = np.array([len(self.levels), *(len(c) for c in cols)], "<i8")
        return zstandard.compress(head.tobytes() + b"".join(_planes(c) for c in cols), 1)

    @staticmethod
    def load(raw: bytes) -> Trie:
        raw = zstandard.decompress(raw)
        (n,) = np.frombuffer(raw, "<i8", 1)
        sizes = np.frombuffer(raw, "<i8", 2 * n + 6, 8)
        cols, at = [], 8 * (2 * int(n) + 7)
        for k, size in enumerate(sizes.tolist()):
            plain = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * size, at).reshape(8, -1).T).reshape(-1)
            cols.append(plain.view("<u8" if k < 2 * n and k % 2 else "<i8"))
            at += 8 * size
        levels = [(cols[2 * k], cols[2 * k + 1]) for k in range(n)]
        return Trie(levels, tuple(cols[2 * n : 2 * n + 3]), tuple(cols[2 * n + 3 :]))


def _planes(x: np.ndarray) -> bytes:
    """Numbers by byte planes: their leading zeros cost little once compressed."""
    return np.ascontiguousarray(np.ascontiguousarray(x, x.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, 8).T).tobytes()


# -- counting -------------------------------------------------------------------------


def spans(buf: np.ndarray, offs: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, document) of the maximal runs of such bytes in the documents of a chunk."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = letter[buf]
    begin, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    some = np.diff(offs) > 0
    first, last = offs[:-1][some], offs[1:][some] - 1
    begin[first], end[last] = inside[1:-1][first], inside[1:-1][last]
    begin = np.flatnonzero(begin)
    return begin, np.flatnonzero(end) + 1, np.searchsorted(offs, begin, "right") - 1


def _numbered(known: dict, names: list) -> np.ndarray:
    return np.array([known.setdefault(x, len(known)) for x in names], np.int64)


def _counted(borders: np.ndarray):
    """(lang, source, text) -> slices of tries: range, names of groups and languages, trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, langs, held, size = {}, {}, [], 0

        def out() -> pa.RecordBatch:
            known, rows = (list(groups), list(langs)), []
            for r, t in Trie.merged(held).cut(borders):
                (group, counts), (lang, holds) = (np.unique(x[1], return_inverse=True) for x in (t.counts, t.holds))  # those of the slice only
                t = Trie(t.levels, (t.counts[0], counts, t.counts[2]), (t.holds[0], holds, t.holds[2]))
                own = [known[0][g] for g in group.tolist()]
                rows.append((r, [g[0] for g in own], [g[1] for g in own], [known[1][x] for x in lang.tolist()], t.dump()))
            kinds = (pa.int32(), *[pa.list_(pa.string())] * 3, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["range", "of_lang", "of_source", "langs", "trie"])

        for b in batches:
            names = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for i, j, buf, offs in T.chunks(b.column(2)):
                begin, end, doc = spans(buf, offs, LETTER)
                group, lang = _numbered(groups, names[i:j]), _numbered(langs, [x[0] for x in names[i:j]])
                held.append(Trie.of(T.LOWER[buf], begin, end, doc, group, lang))
                size += len(held[-1])
                if size > HELD:
                    held = [Trie.merged(held)]
                    size = len(held[0])
                    if 2 * size > HELD:
                        yield out()
                        groups, langs, held, size = {}, {}, [], 0
        if held:
            yield out()

    return run


def _kept(least: int):
    """Slices in order of ranges -> blocks of the terms that enough documents of a language hold, in order of bytes."""

    def blocks(trie: Trie, groups: list, langs: list) -> Iterator[tuple]:
        place = trie.preorder()
        leaf, key, n = trie.holds
        group_lang = np.array([langs[g[0]] for g in groups], np.int64) if groups else np.zeros(0, np.int64)
        for name, number in langs.items():
            kept = leaf[(key == number) & (n >= least)]
            kept = kept[np.argsort(place[kept])]
            mine = np.flatnonzero(group_lang[trie.counts[1]] == number)
            for a in range(0, len(kept), TERMS):
                some = kept[a : a + TERMS]
                order = np.argsort(some)
                at = np.minimum(np.searchsorted(some[order], trie.counts[0][mine]), len(some) - 1)
                hit = some[order][at] == trie.counts[0][mine]
                who, sources = trie.counts[1][mine][hit], {}
                source = _numbered(sources, [groups[g][1] for g in who.tolist()])
                yield name, trie.terms(some), list(sources), order[at[hit]].astype("<i4").tobytes(), source.astype("<i4").tobytes(), trie.counts[2][mine][hit].astype("<i8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, groups, langs, held, size, whole = None, {}, {}, [], 0, 0

        def out() -> pa.RecordBatch:
            rows = list(blocks(Trie.merged(held), list(groups), langs))
            kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.binary()] * 3)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["lang", "terms", "sources", "term", "source", "n"])

        for b in batches:
            for r, of_lang, of_source, own, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r != now and held:
                    yield out()
                    groups, langs, held, size, whole = {}, {}, [], 0, 0
                now, t = r, Trie.load(raw)
                lang, group = _numbered(langs, own), _numbered(groups, list(zip(of_lang, of_source, strict=True)))
                t = Trie(t.levels, (t.counts[0], group[t.counts[1]], t.counts[2]), (t.holds[0], lang[t.holds[1]], t.holds[2]))
                held.append(t)
                size += len(t)
                if size > max(HELD, 2 * whole):
                    held = [Trie.merged(held)]
                    size = whole = len(held[0])
        if held:
            yield out()

    return run


def _first_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, buf, offs in T.chunks(b.column(0)):
            begin, end, doc = spans(buf, offs, LETTER)
            none = np.zeros(len(offs) - 1, np.int64)
            t = Trie.of(T.LOWER[buf], begin, end, doc, none, none)
            edges = t.levels[0][1] if t.levels else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((edges >> T.U(1)).astype(np.int64))], names=["edge"])


def _borders(texts: DataFrame, ranges: int) -> np.ndarray:
    """First edges that cut the distinct terms of a bounded sample of documents into ranges of about equally many."""
    some = sampled(texts.select("text", F.monotonically_increasing_id().alias("at")), SAMPLE, "at").select("text").mapInArrow(_first_edges, "edge long").distinct()
    at = some.agg(F.percentile_approx("edge", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else None
    return np.unique(np.array(at or [], np.uint64) << T.U(1))


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Blocks (lang, terms, sources, term, source, n) of the terms that at least so many documents of a language hold.

    docs: lang, source, text without nulls.  n[i] occurrences in source[i] of term[i], by places in the two lists.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 2 * parts
    slices = docs.select("lang", "source", "text").mapInArrow(_counted(_borders(docs, ranges)), "range int, of_lang array<string>, of_source array<string>, langs array<string>, trie binary")
    in_order = slices.repartition(parts, "range").sortWithinPartitions("range")
    return written(in_order.mapInArrow(_kept(least), "lang string, terms array<string>, sources array<string>, term binary, source binary, n binary"))


# -- shares and distances -------------------------------------------------------------


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) by long division in base 1000; total > 0."""
    out, rest = np.divmod(count, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks -> (lang, source, terms in source; source null: terms of the block and occurrences in all sources)."""
    for b in batches:
        rows = []
        for lang, terms, sources, source, n in zip(*(b.column(c).to_pylist() for c in ("lang", "terms", "sources", "source", "n")), strict=True):
            n = np.frombuffer(n, "<i8")
            by = np.zeros(len(sources), np.int64)
            np.add.at(by, np.frombuffer(source, "<i4"), n)
            rows += [(lang, s, 0, int(x)) for s, x in zip(sources, by, strict=True)] + [(lang, None, len(terms), int(n.sum()))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["lang", "source", "v", "n"])


def _distances(top: int):
    """Blocks beside their language's sources and totals -> sums of |p - q| for pairs, candidates for terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sums, lo = None, [], np.zeros((0, 0), np.int64), 0

        def pairs() -> list[tuple]:
            (lang, _), out = now, []
            for i, row in enumerate(sums.tolist()):
                out += [(lang, names[lo + i], "pair", names[j], v) for j, v in enumerate(row) if j != lo + i]
            return out

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k == 4 else pa.string()) for k in range(5)], names=["lang", "source", "part", "item", "value"])

        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in b.schema.names}
            for k in range(b.num_rows):
                key = (cols["lang"][k], cols["tile"][k])
                if key != now:
                    if now is not None:
                        yield batch(pairs())
                    now, names, lo = key, cols["names"][k], SOURCES * key[1]
                    sums = np.zeros((min(SOURCES, len(names) - lo), len(names)), np.int64)
                v, of_lang, totals = cols["v"][k], cols["of_lang"][k], np.array(cols["totals"][k], np.int64) + 5 * cols["v"][k]
                if cols["terms"][k] is None:  # a language's own row: its pairs, whatever its terms
                    continue
                terms, number = cols["terms"][k], {s: i for i, s in enumerate(names)}
                place = np.array([number[s] for s in cols["sources"][k]], np.int64)
                term, source, n = np.frombuffer(cols["term"][k], "<i4"), place[np.frombuffer(cols["source"][k], "<i4")], np.frombuffer(cols["n"][k], "<i8")
                width = max(1, min(len(terms), (1 << 20) // max(1, len(names))))
                for a in range(0, len(terms), width):
                    some = (term >= a) & (term < a + width)
                    count = np.zeros((len(names), min(width, len(terms) - a)), np.int64)
                    count[source[some], term[some] - a] = n[some]
                    p = shares(count + 5, totals[:, None])
                    q = shares(count.sum(0) + 5, np.int64(of_lang + 5 * v))
                    rows = []
                    for i in range(len(sums)):
                        own = p[lo + i]
                        sums[i] += np.abs(p - own).sum(1)
                        more = np.flatnonzero((count[lo + i] > 0) & (own > q))
                        more = more[np.argsort(q[more] - own[more], kind="stable")[:top]]  # in order of bytes among equal ones
                        rows += [(now[0], names[lo + i], "term", terms[a + t], int(own[t] - q[t])) for t in more.tolist()]
                    if rows:
                        yield batch(rows)
        if now is not None:
            yield batch(pairs())

    return run


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: each source against each other one, and its ``top`` terms above its language."""
    plain = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    blocks = kept_terms(plain, least)
    sums = written(blocks.select("lang", "terms", "sources", "source", "n").mapInArrow(_totals, "lang string, source string, v long, n long").groupBy("lang", "source").agg(F.sum("v").alias("v"), F.sum("n").alias("n")))
    groups = plain.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("n")).unionByName(sums)
    groups = groups.groupBy("lang", "source").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    listed = F.sort_array(F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "n"))))
    langs = written(groups.groupBy("lang").agg(listed.alias("s"), F.coalesce(F.max(F.when(F.col("source").isNull(), F.col("v"))), F.lit(0)).alias("v"), F.coalesce(F.max(F.when(F.col("source").isNull(), F.col("n"))), F.lit(0)).alias("of_lang")))
    langs = langs.select("lang", F.col("s.source").alias("names"), F.col("s.n").alias("totals"), "v", "of_lang")
    tiles = F.explode(F.sequence(F.lit(0), F.floor((F.size("names") - 1) / SOURCES).cast("int"))).alias("tile")
    none = langs.select("lang", *(F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in blocks.columns if c != "lang"))
    met = blocks.unionByName(none).join(langs, "lang").select("*", tiles).sortWithinPartitions("lang", "tile")
    found = written(met.mapInArrow(_distances(top), "lang string, source string, part string, item string, value long"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(best)


#: the same for another engine
DIVERGENCE_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCUMENTS}),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
ns AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
nl AS (SELECT lang, sum(n)::HUGEINT AS total FROM c GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 5)) // (ns.total + 5 * v.v))::BIGINT AS p
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) JOIN ns USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, (1 + ({SCALE}::HUGEINT * (n + 5)) // (nl.total + 5 * v.v))::BIGINT AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN nl USING (lang) JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= {TOP}"""
