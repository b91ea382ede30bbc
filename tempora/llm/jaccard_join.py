"""N-gram Jaccard self-join by PartEnum signatures, and its connected components.

Sets of word shingles fall into bands of nearly equal size.  Within a band, two sets of the wanted
Jaccard similarity differ in at most k features.  The feature domain is split into more than k / 2
parts of three cells each, and the three pairs of cells of each part are enumerated: in more than
``spare`` parts the two sets differ in one feature at most, and there one pair of cells agrees.
So each set may leave out its ``spare`` signatures that hold the fewest features: of those that two
sets have in common the best one is left out by neither.  Sets near the upper end of their band
enumerate for the next band as well.  No link is lost.

Equal sets are merged first.  A task sends each signature with the few least sets that have it,
packed and sorted, to a range of signatures; its other sets with that signature form a star about
the least.  The ranges, as many as the shingles ask for, form stars of what the tasks sent.  A ray
goes on if histograms of the two sets (which bound their difference from below) don't rule it out,
and is then verified on the sets themselves.  Large stars whose rays don't hold together get new
centres for what is apart, as long as these take in a good share of it; what is still apart is compared in blocks, by
histograms first, and on the sets only where those leave something.  A bucket is never gathered whole and its pairs are never listed.

Defined cases: null text, or one without words, has an empty set and is linked with nothing;
fewer words than a shingle has count as one shingle; repeated rows and ids are equal sets; an id that
comes with different texts is one document with several sets, and its component is that of all of
them; an empty table gives an empty result; further columns are ignored by
:func:`jaccard_components` and carried by :func:`drop_near_copies`.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm import textops as T
from tempora.llm.anchors import signed
from tempora.llm.components import components
from tempora.llm.shared import free_name, written

WORDS, PERCENT = 3, 90  # unless asked otherwise
RATIO = 1.35  # of a band's sizes, at least
SPARE = 0.1  # parts beyond those that are needed, as a share of them
BLOCK = 256  # sets compared at a time with as many others
HELD = 750_000  # signatures that a task sorts at a time
RANGE = 1_000_000  # signatures of a range, about
SENT = 64  # sets that a task sends with a signature


def linked(inter, a, b, percent: int = PERCENT):
    return 100 * inter >= percent * (a + b - inter)


def above(size: int, percent: int = PERCENT) -> int:
    """Least size of the band after that which begins at a size: linked sets lie in one band or in neighbours."""
    return max(size + 1, int(size * RATIO), -(-100 * size // percent))


def bands(longest: int, percent: int = PERCENT) -> np.ndarray:
    """Least sizes of the bands up to a size, and of the two after it; small bands hold one size."""
    out = [1]
    while out[-1] <= longest:
        out.append(above(out[-1], percent))
    return np.array([*out, above(out[-1], percent), above(above(out[-1], percent), percent)], np.int64)


def most_differences(size, percent: int = PERCENT):
    """Most features in which two linked sets of at most this size differ."""
    return 2 * size * (100 - percent) // (100 + percent)


def cell_size(percent: int = PERCENT) -> float:
    """Features of a histogram cell, such that linked sets differ by about one in two cells and hide few differences."""
    return max(1.0, 0.25 * (100 + percent) / (100 - percent))


class Sets:
    """Distinct shingle hashes of the documents of a chunk, grouped by document."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, words: int = WORDS):
        w = T.Words(buf, offs)
        h, n = w.hashes(lower=True), len(w.start)
        start = np.flatnonzero(T.windows_inside(w.bounds, words, n))
        grams, doc = T.window_hash(h, words)[start], np.searchsorted(w.bounds, start, "right") - 1
        few = np.flatnonzero((w.count > 0) & (w.count < words))
        if len(few):
            whole = np.array([T.window_hash(h[w.bounds[d] : w.bounds[d + 1]], int(w.count[d]))[0] for d in few], np.uint64)
            grams, doc = np.concatenate([grams, whole]), np.concatenate([doc, few])
            order = np.argsort(doc, kind="stable")
            grams, doc = grams[order], doc[order]
        keys = T.salted(grams, doc)
        order = np.argsort(keys)
        s = keys[order]
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        keep = np.zeros(len(s), bool)
        keep[order[first]] = True
        self.grams, self.doc = grams[keep], doc[keep]
        self.size = np.bincount(self.doc, minlength=len(offs) - 1)
        self.bounds = np.concatenate([[0], np.cumsum(self.size)])

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums over the set: with its size, its identity."""
        out = []
        for salt in (0x51A7B3C9, 0x0F1E2D3C4B5A6978):
            acc = np.zeros(len(self.size), np.uint64)
            np.add.at(acc, self.doc, T.mix(self.grams ^ T.U(salt)))
            out.append(T.mix(acc + self.size.astype(np.uint64)))
        return out[0], out[1]

    def histograms(self, percent: int = PERCENT) -> list[bytes]:
        """Features per cell of the hashed domain, one byte each; the number of cells is a power of two."""
        cells = np.full(len(self.size), 8, np.int64)
        while (small := cells * cell_size(percent) < self.size).any():
            cells[small] *= 2
        at = (T.mix(self.grams ^ T.U(0x3C6EF372FE94F82B)) >> T.U(32)).astype(np.int64)
        while True:
            base = np.concatenate([[0], np.cumsum(cells)])
            count = np.bincount(base[self.doc] + ((at * cells[self.doc]) >> 32), minlength=base[-1])
            if count.max(initial=0) < 256:
                break
            cells[np.unique(np.searchsorted(base, np.flatnonzero(count > 255), "right") - 1)] *= 2
        count = count.astype(np.uint8)
        return [count[a:e].tobytes() for a, e in zip(base[:-1], base[1:], strict=True)]

    def signatures(self, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document, signature) arrays."""
        low = bands(int(self.size.max(initial=1)) + 1, percent)
        own = np.searchsorted(low, self.size, "right") - 1
        at = (T.mix(self.grams ^ T.U(0xC2B2AE3D27D4EB4F)) >> T.U(32)).astype(np.int64)
        value = T.mix(self.grams)
        for up in (0, 1):
            band = own + up
            most = most_differences(low[band + 1] - 1, percent)
            use = (self.size > 0) & (most > 0)
            if up:  # only sets that the next band's least size can still be linked with
                use &= 100 * self.size >= percent * low[band]
            need = most // 2 + 1
            spare = (need * SPARE).astype(np.int64)
            parts = np.where(use, need + spare, 0)
            base = np.concatenate([[0], np.cumsum(3 * parts)])
            pick = use[self.doc]
            cell = base[self.doc[pick]] + ((at[pick] * (3 * parts)[self.doc[pick]]) >> 32)
            acc = np.zeros(base[-1], np.uint64)
            np.add.at(acc, cell, value[pick])
            held = np.bincount(cell, minlength=base[-1]).reshape(-1, 3)
            acc = T.mix(acc).reshape(-1, 3)
            doc = np.repeat(np.arange(len(parts)), parts)
            part = np.arange(len(doc)) - (base[:-1] // 3)[doc]
            seed = T.mix((band[doc] * 1_000_003 + part).astype(np.uint64))
            sig = np.concatenate([T.mix(acc[:, i] * T.U(3) + acc[:, j] * T.U(0x9E3779B97F4A7C15) + seed + T.U(c)) for i, j, c in ((0, 1, 1), (0, 2, 2), (1, 2, 3))])
            features = np.concatenate([held[:, i] + held[:, j] for i, j in ((0, 1), (0, 2), (1, 2))])
            doc = np.tile(doc, 3)
            # in order of features (equal ones: of the signature), the first ``spare`` of each document go
            rank = (np.minimum(features, 1023).astype(np.uint64) << T.U(40)) | (sig >> T.U(24))
            order = np.argsort(rank)
            order = order[np.argsort(doc[order], kind="stable")]
            begin = np.concatenate([[0], np.cumsum(3 * parts)])[:-1]
            least = np.zeros(len(parts), np.uint64)
            least[use] = rank[order[(begin + spare)[use]]]
            keep = rank >= least[doc]  # ties stay
            yield doc[keep], sig[keep]


#: (document, signature) arrays of the sets of a chunk; sets that are linked share a signature
Signing = Callable[[Sets], Iterator[tuple[np.ndarray, np.ndarray]]]


def _digests(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in T.chunks(b.column(1)):
                s = Sets(buf, offs, words)
                one, two = s.digests()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(s.size), signed(one), signed(two), pa.array(s.histograms(percent), pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "histogram"])

    return run


# -- signatures by ranges -------------------------------------------------------------

_PACKED = "part int, sigs binary, who binary, ids binary, rays binary"


def _squeezed(x: np.ndarray, kind: str) -> bytes:
    """Numbers by byte planes, so that their leading zeros cost nothing."""
    raw = np.ascontiguousarray(x, kind)
    return zstandard.compress(np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), -1).T).tobytes(), 1)


def _spread(raw: bytes, kind: str) -> np.ndarray:
    plain = np.frombuffer(zstandard.decompress(raw), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(plain.reshape(width, -1).T).reshape(-1).view(kind)


def _stars(sig: np.ndarray, node: np.ndarray, sent: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures in order, nodes) of the ``sent`` least nodes of each signature; distinct rays from the least to all others."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[keep], node[keep]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    at = np.flatnonzero(new)
    begin = at[np.cumsum(new) - 1] if len(at) else at
    first = np.arange(len(sig)) - begin < sent
    return sig[first], node[first], np.unique(np.stack([node[begin][~first], node[~first]], 1), axis=0)


def _signatures(words: int, sign: Signing, ranges: int, bits: int):
    """Texts -> packed signatures (their leading ``bits``) with the least sets that have each, and rays to the others, by range."""

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sig, least, rays = _stars(*(np.concatenate(x) for x in zip(*held, strict=True)), SENT)
        part = ((sig << T.U(64 - bits) >> T.U(32)) * T.U(ranges) >> T.U(32)).astype(np.int64)
        mine = (T.mix(rays[:, 0].view(np.uint64) * T.U(3) + rays[:, 1].view(np.uint64)) % T.U(ranges)).astype(np.int64)
        order = np.argsort(mine, kind="stable")
        rays, mine = rays[order], mine[order]
        rows = []
        for p in np.unique(np.concatenate([part, mine])).tolist():
            a, e = np.searchsorted(part, [p, p + 1])
            f, g = np.searchsorted(mine, [p, p + 1])
            ids, who = np.unique(least[a:e], return_inverse=True)
            rows.append((p, _squeezed(np.diff(sig[a:e], prepend=T.U(0)), "<u8"), _squeezed(who, "<u4"), ids.astype("<i8").tobytes(), rays[f:g].astype("<i8").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["part", "sigs", "who", "ids", "rays"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for _, _, buf, offs in T.chunks(b.column(0)):
                s = Sets(buf, offs, words)
                one = s.digests()[0].view(np.int64)
                for doc, sig in sign(s):
                    if len(sig):
                        held.append((sig >> T.U(64 - bits), one[doc]))
                        n += len(sig)
                if n > HELD:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    return run


def _rays(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The stars of a range: distinct rays, and whether a task formed them."""
    sig = np.concatenate([np.cumsum(_spread(x, "<u8"), dtype=np.uint64) for x in rows["sigs"]])
    node = np.concatenate([np.frombuffer(i, "<i8")[_spread(w, "<u4")] for i, w in zip(rows["ids"], rows["who"], strict=True)])
    own = _stars(sig, node)[2]
    sent = np.unique(np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in rows["rays"]]), axis=0)
    both = np.concatenate([own, sent])
    del sig, node
    T.give_back()
    return pd.DataFrame({"center": both[:, 0], "node": both[:, 1], "local": np.arange(len(both)) >= len(own)})


# -- verification ---------------------------------------------------------------------


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, 1):
            for i, j, buf, offs in T.chunks(b.column(1)):
                s = Sets(buf, offs, words)
                raw = [np.sort(s.grams[a:e]).tobytes() for a, e in zip(s.bounds[:-1], s.bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(raw, pa.binary())], names=["node", "grams"])

    return run


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, grams) of the wanted nodes; an id may come with several texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(written(wanted.distinct()), "node", "left_semi")
    return written(texts.mapInArrow(_sets(words), f"node {kind}, grams binary").distinct())


def _folded(counts: np.ndarray, cells: int) -> np.ndarray:
    return counts.reshape(*counts.shape[:-1], cells, -1).sum(-1)


def _difference(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Features in which sets differ at least, by their histograms; the last axis holds cells."""
    cells = min(x.shape[-1], y.shape[-1])
    return np.abs(_folded(x, cells) - _folded(y, cells)).sum(-1)


def _possible(differ, total, percent: int):
    """Whether sets that differ in so many features or more, of so many in all, can be linked."""
    return differ * (100 + percent) <= total * (100 - percent)


def _close(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hists = [[np.frombuffer(x, np.uint8).astype(np.int32) for x in b.column(k).to_pylist()] for k in (2, 3)]
            ok = [bool(_possible(_difference(x, y), x.sum() + y.sum(), percent)) for x, y in zip(*hists, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["center", "node"]).filter(pa.array(ok, pa.bool_()))

    return run


def _overlap(x: bytes, y: bytes) -> tuple[int, int, int]:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1])), len(a), len(b)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, 2, 4 << 20):
            ok = [bool(linked(*_overlap(x, y), percent)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["center", "node"]).filter(pa.array(ok, pa.bool_()))

    return run


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (center, node) whose sets are linked."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape, hist = f"center {kind}, node {kind}", reps.select(F.col("doc_id").alias("node"), F.col("histogram").alias("y"))
    near = pairs.select("center", "node").join(hist, "node").join(hist.select(F.col("node").alias("center"), F.col("y").alias("x")), "center")
    near = written(near.select("center", "node", "x", "y").mapInArrow(_close(percent), shape).distinct())
    sets = _sets_of(docs, near.select("node").unionByName(near.select(F.col("center").alias("node"))), words)
    full = near.join(sets.withColumnRenamed("grams", "y"), "node").join(sets.select(F.col("node").alias("center"), F.col("grams").alias("x")), "center")
    return written(full.select("center", "node", "x", "y").mapInArrow(_verify(percent), shape).distinct())


# -- what stars leave apart -----------------------------------------------------------


def _cut(members: DataFrame) -> DataFrame:
    """The members with their block among all of their star (v), and among its rest (u: null in its largest component), of about BLOCK each."""
    of = members.join(_largest(members), "center").withColumn("rest", F.col("component") != F.col("largest"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.ceil(n / BLOCK))
    return written(of.select("center", "node", "component", block(F.col("all")).alias("v"), F.when(F.col("rest"), block(F.col("all") - F.col("n"))).alias("u")))


def _meet(cut: DataFrame, held: DataFrame) -> DataFrame:
    """Blocks of the rest of each star beside its blocks: a row a pair of blocks.  held: (node, held), its histogram or its shingles, met once."""
    sides = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("block")) for side in "uv"))).alias("at")
    rows = cut.join(held, "node").select("center", F.struct("node", "component", "held").alias("member"), sides).where("at.block is not null")
    blocks = written(rows.groupBy("center", "at").agg(F.collect_list("member").alias("members")))
    u, v = (blocks.where(F.col("at.side") == side).select("center", F.col("members").alias(side)) for side in "uv")
    return u.join(v, "center")


def _sides(b: pa.RecordBatch) -> Iterator[tuple[object, list]]:
    """(center, [(nodes, components, held) of either block]) of each row."""
    cols = []
    for name in ("u", "v"):
        lists = b.column(name)
        lo = np.asarray(lists.offsets)
        own = lists.values.slice(int(lo[0]), int(lo[-1] - lo[0]))
        cols.append((lo - lo[0], *(own.field(k).to_pylist() for k in ("node", "component", "held"))))
    for k, center in enumerate(b.column("center").to_pylist()):
        yield center, [tuple(x[lo[k] : lo[k + 1]] for x in rest) for lo, *rest in cols]


def _screen(percent: int):
    """Blocks of histograms -> members that may be linked to one of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            centers, found = [], []
            for center, ((un, uc, uh), (vn, vc, vh)) in _sides(b):
                comps, inverse = np.unique(np.array(uc + vc, object).astype(str), return_inverse=True)
                if len(comps) < 2:
                    continue
                uc, vc = inverse[: len(un)], inverse[len(un) :]
                by: dict[int, list[int]] = {}
                for k, h in enumerate(vh):
                    by.setdefault(len(h), []).append(k)
                groups = [(np.array(k), np.frombuffer(b"".join(vh[i] for i in k), np.uint8).reshape(len(k), -1).astype(np.int32)) for k in by.values()]
                groups = [(k, m, m.sum(1)) for k, m in groups]
                hit_u, hit_v = np.zeros(len(un), bool), np.zeros(len(vn), bool)
                for i, h in enumerate(uh):
                    x = np.frombuffer(h, np.uint8).astype(np.int32)
                    for k, m, n in groups:
                        ok = _possible(np.abs(n - x.sum()), n + x.sum(), percent) & (vc[k] != uc[i])
                        if ok.any():
                            ok[ok] = _possible(_difference(m[ok], x), n[ok] + x.sum(), percent)
                            if ok.any():
                                hit_u[i] = True
                                hit_v[k[ok]] = True
                nodes = [n for n, h in zip(un + vn, np.concatenate([hit_u, hit_v]), strict=True) if h]
                centers += [center] * len(nodes)
                found += nodes
            kind = b.schema.field("center").type
            yield pa.RecordBatch.from_arrays([pa.array(centers, kind), pa.array(found, kind)], names=["center", "node"])

    return run


def _intersections(us: list[np.ndarray], vs: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks, by matrix products over their common shingles."""
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(g) for g in x])) for x in (us, vs)]
    common = np.intersect1d(sides[0][0], sides[1][0])
    places = []
    for g, own in sides:
        at = np.searchsorted(common, g)
        at[at == len(common)] = 0
        hit = common[at] == g if len(common) else np.zeros(len(g), bool)
        places.append((own[hit], at[hit]))
    inter = np.zeros((len(us), len(vs)), np.float32)
    for a in range(0, len(common), 4096):
        part = []
        for (own, at), n in zip(places, inter.shape, strict=True):
            m = np.zeros((n, min(4096, len(common) - a)), np.float32)
            inside = (at >= a) & (at < a + 4096)
            m[own[inside], at[inside] - a] = 1
            part.append(m)
        inter += part[0] @ part[1].T
    return np.rint(inter).astype(np.int64)


def _compare(percent: int):
    """Blocks of sets -> links between different components, a spanning set of them only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, out = b.schema.field("center").type, []
            for _, ((un, uc, ug), (vn, vc, vg)) in _sides(b):
                us, vs = ([np.frombuffer(g, np.uint64) for g in x] for x in (ug, vg))
                sizes = [np.array([len(g) for g in x]) for x in (us, vs)]
                i, j = np.nonzero(linked(_intersections(us, vs), sizes[0][:, None], sizes[1][None, :], percent))
                seen = set()
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if uc[x] != vc[y] and (pair := (uc[x], vc[y])) not in seen:
                        seen.add(pair)
                        out.append((un[x], vn[y]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k in (0, 1)], names=["a", "b"])

    return run


def _open(members: DataFrame, label: DataFrame) -> DataFrame:
    """(center, node, component) of the members of stars that lie in several components."""
    members = written(members.select("center", "node").join(label, "node", "left").select("center", "node", F.coalesce("component", "node").alias("component")))
    apart = members.groupBy("center").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    return written(members.join(apart.select("center"), "center", "left_semi"))


def _merged(label: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels of components after further edges."""
    named = lambda df, c: df.join(label.select(F.col("node").alias(c), F.col("component").alias("_name")), c, "left").withColumn(c, F.coalesce("_name", c)).drop("_name")
    between = components(named(named(edges, "a"), "b"))
    lifted = label.join(between.select(F.col("node").alias("component"), F.col("component").alias("_new")), "component", "left").select("node", F.coalesce("_new", "component").alias("component"))
    return written(lifted.unionByName(between).dropDuplicates(["node"]))


def _largest(members: DataFrame) -> DataFrame:
    """The largest component of each star, with the members of it (n) and of the star (all)."""
    sizes = members.groupBy("center", "component").agg(F.count("*").alias("n"))
    top = F.max(F.struct("n", "component")).alias("top")
    return sizes.groupBy("center").agg(top, F.sum("n").alias("all")).select("center", F.col("top.component").alias("largest"), F.col("top.n").alias("n"), "all")


def _rest(members: DataFrame, least: int) -> DataFrame:
    """The members outside the largest component of their star, of stars of more than ``least`` members."""
    return members.join(_largest(members).where(F.col("all") > least), "center").where("component <> largest").drop("largest", "n", "all")


def _new_stars(members: DataFrame) -> DataFrame:
    """Large stars around the least of their rest: center, node, star, apart (whether in another component than the centre)."""
    new = _rest(members, BLOCK).groupBy("center").agg(F.min(F.struct("node", "component")).alias("m")).select("center", F.col("m.node").alias("new"), F.col("m.component").alias("at"))
    return members.join(new, "center").where("node <> new").select(F.col("new").alias("center"), "node", F.col("center").alias("star"), (F.col("component") != F.col("at")).alias("apart"))


def links(docs: DataFrame, reps: DataFrame, words: int = WORDS, percent: int = PERCENT, sign: Signing | None = None, total: int | None = None) -> DataFrame:
    """Edges (a, b) between representatives of differing sets: their components are those of all links.

    docs: doc_id, text; reps: doc_id of the representative, n_shingles, d1, histogram.
    sign: other signatures than PartEnum's, and ``total``, about how many there are.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    sign = sign or functools.partial(Sets.signatures, percent=percent)
    if total is None:  # one or two signatures a shingle
        total = 2 * (reps.agg(F.sum("n_shingles")).first()[0] or 0)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    bits = min(64, max(40, total.bit_length() + 20))
    sigs = docs.select("text").mapInArrow(_signatures(words, sign, ranges, bits), _PACKED)
    rays = sigs.groupBy("part").applyInPandas(_rays, "center long, node long, local boolean").groupBy("center", "node").agg(F.max("local").alias("local"))
    name = reps.select("d1", "doc_id")
    rays = rays.join(name.select(F.col("d1").alias("node"), F.col("doc_id").alias("n")), "node").join(name.select(F.col("d1").alias("center"), F.col("doc_id").alias("c")), "center")
    rays = written(rays.where("c <> n").select(F.col("c").alias("center"), F.col("n").alias("node"), "local"))
    # members of a task's star belong to the stars that its centre is in
    near = rays.where("local").select(F.col("center").alias("via"), F.col("node").alias("far"))
    through = rays.select("center", F.col("node").alias("via")).join(near, "via").where("center <> far").select("center", F.col("far").alias("node"))
    stars = written(rays.select("center", "node").unionByName(through).distinct())
    as_edges = lambda df: df.select(F.col("center").alias("a"), F.col("node").alias("b"))
    sure = [as_edges(verified(docs, reps, stars, words, percent))]
    label = components(sure[0])
    members = _open(stars, label)  # without centres, which have met all others

    # new centres for what large stars leave apart, as long as they take in a tenth of it
    while True:
        again = written(_new_stars(members))
        if again.isEmpty():
            break
        found = as_edges(verified(docs, reps, again.where("apart").select("center", "node").distinct(), words, percent))
        sure.append(found)
        if 10 * found.count() < again.where("apart").count():
            break
        label = _merged(label, found)
        others = members.join(again.select(F.col("star").alias("center")).distinct(), "center", "left_anti").select("center", "node")
        members = _open(again.select(F.col("star").alias("center"), "node").unionByName(others), label)

    # a block of rest members meets each block of its star once: rows hold blocks, not pairs
    shown = reps.select(F.col("doc_id").alias("node"), F.col("histogram").alias("held"))
    marked = written(_meet(_cut(members), shown).mapInArrow(_screen(percent), f"center {kind}, node {kind}").distinct())
    sets = _sets_of(docs, marked.select("node"), words).withColumnRenamed("grams", "held")
    full = members.join(marked, ["center", "node"], "left_semi")
    late = _meet(_cut(full), sets).mapInArrow(_compare(percent), f"a {kind}, b {kind}")
    return written(functools.reduce(DataFrame.unionByName, [*sure, late]).distinct())


def representatives(base: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) -> the digests and histogram of each row, and one row for each distinct set, with its least id."""
    kind = base.schema["doc_id"].dataType.simpleString()
    nodes = written(base.mapInArrow(_digests(words, percent), f"doc_id {kind}, n_shingles long, d1 long, d2 long, histogram binary"))
    reps = written(nodes.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.first("histogram").alias("histogram")))
    return nodes, reps


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable by links) of every document."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    nodes, reps = representatives(base, words, percent)
    return named(nodes, reps, components(links(base, reps, words, percent)), doc_id)


def named(nodes: DataFrame, reps: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, from the components (node, component) of the representatives."""
    # repeated ids with different texts: an id's component is that of each of its rows
    by_set = reps.join(found, F.col("doc_id") == F.col("node"), "left").select("n_shingles", "d1", "d2", F.coalesce("component", "doc_id").alias("component_id"))
    return nodes.join(by_set, ["n_shingles", "d1", "d2"], "left").select(F.col("doc_id").alias(doc_id), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group, that with the least id, with all its columns; rows without an id stay."""
    found = written(jaccard_components(docs, doc_id, text, words, percent).where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), (F.col("component_id") == F.col(doc_id)).alias("least")))
    ids = found.groupBy("id").agg(F.max("least").alias("least"), F.count("*").alias("n"))
    gone, several = (written(ids.where(test).select(F.col("id").alias(doc_id))) for test in ("not least or n > 1", "least and n > 1"))
    one = Window.partitionBy(doc_id, F.xxhash64(text)).orderBy(F.xxhash64(*docs.columns))  # repeated rows stay once
    first = docs.join(several, doc_id, "left_semi").withColumn(row := free_name(docs, "row"), F.row_number().over(one)).where(F.col(row) == 1).drop(row)
    return docs.join(gone, doc_id, "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))


#: the same for another engine: equal sets merged, all sets with a common shingle compared, links followed
JACCARD_SQL = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words),
reps AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY ALL),
cells AS (SELECT rep, n, unnest(s) AS g FROM reps),
common AS (SELECT a.rep AS a, b.rep AS b, a.n AS an, b.n AS bn, count(*) AS i FROM cells a JOIN cells b ON a.g = b.g AND a.rep < b.rep AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * i >= 90 * (an + bn - i)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
named AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(n.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN reps r ON r.s = list_sort(s.s) LEFT JOIN named n ON n.rep = r.rep"""
