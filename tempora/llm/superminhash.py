"""Near-duplicates by SuperMinHash signatures, banding, verification and union-find.

Each element of a set walks a random permutation of the signature's m components, dealt by a
Fisher-Yates shuffle seeded with the element's hash: at step j it offers the value j + r, r in [0, 1),
to the j-th component of its permutation, and each component keeps the least value offered.  An
element's ranks over the components differ, so estimates vary less than with m independent minima.
Step j cannot improve a component that an earlier step has filled; a set stops as soon as none is
empty, after some m log(m) / n steps for n elements.  The steps of all sets of a chunk are taken together.

Components are read in bands of ROWS values, and two sets are candidates if one band agrees.  Two sets of the
wanted similarity s miss each other in all bands with odds of (1 - s^ROWS)^BANDS at most, 5e-9 at 0.8.
Candidates meet as the Jaccard join's do: stars around the least set of a band value, new
centres and blocks for what a star leaves apart, each link confirmed on the full sets; no bucket is
capped and none is gathered whole.  Links become groups by union-find: each task joins its links into trees and
passes on one link a node, and rounds over all tasks' trees name each group by its least id.

Defined cases: as in ``jaccard_join``: null text, or one without words, has an empty set and is linked with
nothing; fewer words than a shingle has count as one shingle; equal sets (repeated rows, ids) are one
node; an id with several texts belongs to the group of each of them; a row without an id is only found equal to others, and is kept if
it is not; an empty table gives an empty result; further columns are ignored by :func:`near_duplicates`
and carried by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import jaccard_join as J
from tempora.llm import textops as T
from tempora.llm.components import components
from tempora.llm.shared import free_name, written

WORDS, PERCENT = 5, 80  # unless asked otherwise
ROWS, BANDS = 5, 48  # values of a band, bands of a signature
EDGES = 1_000_000  # links that a task joins at a time
EMPTY = np.uint64(2**64 - 1)


def signatures(grams: np.ndarray, doc: np.ndarray, n: int, m: int) -> np.ndarray:
    """SuperMinHash signatures (n x m): step above 32 random bits; doc: the set (0 to n - 1) of each element.

    Components of sets without elements stay EMPTY.
    """
    out = np.full((n, m), EMPTY, np.uint64)
    open_ = np.zeros(n, bool)
    open_[doc] = True
    swaps: list[np.ndarray] = []
    for j in range(m):
        x = T.mix(grams + T.U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        swaps.append((j + ((x >> T.U(32)) * T.U(m - j) >> T.U(32))).astype(np.int16))
        place = swaps[j]
        for i in range(j - 1, -1, -1):  # who stood there: the swaps so far, read backwards
            place = np.where(swaps[i] == place, np.int16(i), place)
        np.minimum.at(out, (doc, place), T.U(j << 32) | (x & T.U(0xFFFFFFFF)))
        still = np.flatnonzero(open_)
        open_[still] = (out[still] == EMPTY).any(axis=1)
        keep = open_[doc]
        if not keep.any():
            break
        grams, doc, swaps = grams[keep], doc[keep], [s[keep] for s in swaps]
    return out


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Estimate of the Jaccard similarity of two sets from their signatures."""
    return float((x == y).mean())


def band_keys(s: J.Sets, percent: int, rows: int = ROWS, bands: int = BANDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, hash of a band) arrays; sets too small for a link to any other set have none."""
    use = 100 * s.size >= percent * (s.size + 1)
    picked = use[s.doc]
    new = np.cumsum(use) - 1
    sig = signatures(s.grams[picked], new[s.doc[picked]], int(use.sum()), rows * bands)
    acc = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        acc = T.mix(acc + sig[:, r::rows][:, :bands] * T.U(0xD6E8FEB86659FD93) + T.U(r + 1))
    acc = T.mix(acc + np.arange(bands, dtype=np.uint64)[None, :] * T.U(0xA0761D6478BD642F))
    yield np.repeat(np.flatnonzero(use), bands), acc.reshape(-1)


class UnionFind:
    """Groups of nodes, each known by its least node."""

    def __init__(self):
        self.up: dict = {}

    def find(self, a):
        up = self.up
        up.setdefault(a, a)
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            a, b = (a, b) if a < b else (b, a)
            self.up[b] = a


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links -> one link from each node to the least of its group, EDGES links at a time."""
    found, n, kind = UnionFind(), 0, None

    def out() -> pa.RecordBatch:
        pairs = [(r, a) for a in list(found.up) if (r := found.find(a)) != a]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind) for k in (0, 1)], names=["a", "b"])

    for b in batches:
        kind = b.schema.field(0).type
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found.join(x, y)
        n += b.num_rows
        if n >= EDGES:
            yield out()
            found, n = UnionFind(), 0
    if n:
        yield out()


def groups(links: DataFrame) -> DataFrame:
    """(node, component) of the links (a, b)."""
    kind = links.schema["a"].dataType.simpleString()
    return components(links.select("a", "b").mapInArrow(_trees, f"a {kind}, b {kind}"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links) and kept (whether that is its own) of every row."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    nodes, reps = J.representatives(base, words, percent)
    sign = functools.partial(band_keys, percent=percent, rows=rows, bands=bands)
    links = J.links(base, reps, words, percent, sign, bands * reps.count())
    out = J.named(nodes, reps, groups(links), doc_id)
    return out.withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.col("component_id").isNull()))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of the documents with the least id of their group, with all their columns; rows without an id stay."""
    found = near_duplicates(docs, doc_id, text, words, percent)
    gone = written(found.where(F.col(doc_id).isNotNull() & ~F.col("kept")).select(F.col(doc_id).alias(free_name(docs, "gone"))).distinct())
    return docs.join(gone, docs[doc_id] == gone[gone.columns[0]], "left_anti").select(*(docs[c] for c in docs.columns))


#: op 13 for another engine: equal sets merged, all sets with a common shingle compared, links followed
NEAR_SQL = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN w
  ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
reps AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY ALL),
cells AS (SELECT rep, n, unnest(s) AS g FROM reps),
common AS (SELECT a.rep AS a, b.rep AS b, a.n AS an, b.n AS bn, count(*) AS i FROM cells a JOIN cells b ON a.g = b.g AND a.rep < b.rep AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * i >= 80 * (an + bn - i)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
names AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(n.component_id, s.doc_id) AS component_id, coalesce(n.component_id, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN reps r ON r.s = list_sort(s.s) LEFT JOIN names n ON n.rep = r.rep"""
