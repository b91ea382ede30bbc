"""Mixing documents to target weights of soft domains.

A softmax classifier, fitted on a labelled table, gives each document's posterior over domains.
Nonnegative document rates are then sought whose expected token totals per domain,
sum of tokens * rate * posterior, match the targets in least squares, beginning at rate 1.  Each
step of projected gradient descent is one distributed aggregation over all documents, which gives
the totals and the posteriors' second moments over documents not yet at rate 0; these scale the
gradient (the misfits of a few domains), so that few steps are needed.  Rates are a function of a
document's posterior and the gradients so far, so nothing but one small matrix per step leaves the
executors, and the final pass needs no join.

The classifier is fitted on the whole texts of at most ``sample`` labelled documents (those with the
smallest hash of their id), whose sparse features are summed in tasks; posteriors, totals and
gradients cover all documents.  Descent ends when each domain's total is within ENOUGH of that
domain's own target, or when a step moves none of them any more: targets that no nonnegative rates
meet keep the misfit that :func:`misfits` reports.

A rate is realised as its whole part in copies and one more for a share of the documents, chosen by
a hash of the id, that equals the rest.  Defined cases: null or empty text has no tokens, keeps
the classifier's prior and gets its rate like others; repeated rows are rated alike; without labels
all rates are 1; further columns are carried by :func:`mix`.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm import textops as T
from tempora.llm.shared import free_name, written

SAMPLE = 4000
BUCKETS = 1 << 15
DENSE = 6
EPOCHS, BATCH, STEP = 12, 32, 0.3
STEPS, ENOUGH = 40, 1e-3  # at most, and the misfit of each domain's total, of its target, that ends them

_UPPER, _MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_MARK[list(b"#*$%&|<>!@{}[]=_~^")] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Features:
    """Sparse word and stem buckets and a few dense shares of the documents of a chunk."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        low = T.LOWER[buf]
        w = T.Words(low, offs)
        h = T.prefix_hash(low)
        stem = np.minimum(w.start + 6, w.end)
        self.bounds, self.count = w.bounds, w.count
        self.buckets = np.stack([(T.range_hash(h, w.start, e) >> T.U(49)).astype(np.int64) for e in (w.end, stem)], 1)
        size = np.maximum(np.diff(offs), 1)
        share = lambda m: T.per_doc(m[buf], offs) / size
        self.dense = np.stack([np.ones(len(size)), share(_UPPER), share(_MARK), share(_LETTER), np.log1p(w.count) / 10, np.minimum(size / np.maximum(w.count, 1) / 10, 3)], 1)
        self.scale = 4 / np.sqrt(np.maximum(w.count, 1))

    def scores(self, sparse: np.ndarray, dense: np.ndarray) -> np.ndarray:
        k = sparse.shape[1]
        total = np.zeros((len(self.count), k))
        if len(self.buckets):
            per_word = sparse[self.buckets[:, 0]] + sparse[self.buckets[:, 1]]
            c = np.zeros((len(per_word) + 1, k))
            np.cumsum(per_word, axis=0, out=c[1:])
            total = c[self.bounds[1:]] - c[self.bounds[:-1]]
        return total * self.scale[:, None] + self.dense @ dense


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Classifier:
    def __init__(self, domains: list[str]):
        self.domains = domains
        self.sparse = np.zeros((BUCKETS, len(domains)), np.float32)
        self.dense = np.zeros((DENSE, len(domains)))

    def fit(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 3) -> None:
        """Softmax regression by Adagrad on (buckets, their weights, dense features) of each document."""
        rng = np.random.default_rng(seed)
        y = np.eye(len(self.domains))[labels]
        gs, gd = np.full(self.sparse.shape, 1e-6, np.float32), np.full(self.dense.shape, 1e-6)
        for _ in range(EPOCHS):
            for start in range(0, len(parts), BATCH):
                pick = rng.choice(len(parts), BATCH)
                d_dense, touched = np.zeros_like(self.dense), []
                for i in pick:
                    b, n, dense = parts[i]
                    g = (softmax((n @ self.sparse[b] + dense @ self.dense)[None]) - y[i])[0] / BATCH
                    d_dense += dense[:, None] * g
                    touched.append((b, n, g))
                if touched:
                    b = np.concatenate([t[0] for t in touched])
                    g = np.concatenate([t[1][:, None] * t[2] for t in touched]).astype(np.float32)
                    u, at = np.unique(b, return_inverse=True)
                    acc = np.zeros((len(u), g.shape[1]), np.float32)
                    np.add.at(acc, at, g)
                    acc += 1e-5 * self.sparse[u]
                    gs[u] += acc * acc
                    self.sparse[u] -= STEP * acc / np.sqrt(gs[u])
                gd += d_dense * d_dense
                self.dense -= STEP * d_dense / np.sqrt(gd)

    def posteriors(self, col) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, posterior) of each text."""
        n, p = [np.zeros(0, np.int64)], [np.zeros((0, len(self.domains)))]
        for _, _, buf, offs in T.chunks(col):
            f = Features(buf, offs)
            n.append(f.count.astype(np.int64))
            p.append(softmax(f.scores(self.sparse, self.dense)))
        return np.concatenate(n), np.concatenate(p)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse features of whole texts: distinct buckets and their times, dense features and scale."""
    for b in batches:
        for i, j, buf, offs in T.chunks(b.column(1)):
            f = Features(buf, offs)
            sums = [np.unique(f.buckets[a:e], return_counts=True) for a, e in zip(f.bounds[:-1], f.bounds[1:], strict=True)]
            raw = [pa.array([x.astype(kind).tobytes() for x in xs], pa.binary()) for xs, kind in zip(zip(*sums, strict=True), ("<u2", "<i4"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *raw, pa.array(list(f.dense), pa.list_(pa.float64())), pa.array(f.scale), b.column(2).slice(i, j - i)], names=["doc_id", "buckets", "times", "dense", "scale", "domain"])


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE) -> Classifier | None:
    """labelled: doc_id, domain (rows with other domains, or null ones, are left out); of a repeated id the least text is learned from."""
    known = labelled.where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("domain").alias("domain"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(_sums, f"doc_id {kind}, buckets binary, times binary, dense array<double>, scale double, domain string").orderBy("doc_id", "buckets", "times").collect()
    if not rows:
        return None
    model = Classifier(domains)
    parts = [(np.frombuffer(r.buckets, "<u2"), np.frombuffer(r.times, "<i4") * r.scale, np.array(r.dense)) for r in rows]
    model.fit(parts, np.array([domains.index(r.domain) for r in rows]))
    return model


def rates(p: np.ndarray, pulls: list[np.ndarray]) -> np.ndarray:
    """Rates of documents with posteriors p after the given steps of projected gradient descent."""
    r = np.ones(len(p))
    for pull in pulls:
        r = np.maximum(0.0, r - p @ pull)
    return r


def _rate_column(domains: int, pulls: list[np.ndarray]) -> Column:
    """The same as a Column over p (an array)."""
    if not pulls:
        return F.lit(1.0)
    history = F.array(*(F.array(*(F.lit(float(v)) for v in pull)) for pull in pulls))

    def step(r: Column, pull: Column) -> Column:
        return F.greatest(F.lit(0.0), r - sum((F.col("p")[k] * pull[k] for k in range(1, domains)), F.col("p")[0] * pull[0]))

    return F.aggregate(history, F.lit(1.0), step)


def solve(table: DataFrame, weights: np.ndarray, anchor: int, growth: float) -> list[np.ndarray]:
    """The scaled gradients of projected descent; table: n (tokens), p (posterior).

    Targets are weights of a total at which domain ``anchor`` has ``growth`` times its tokens.
    """
    k = len(weights)

    def totals(pulls: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(token totals by domain, second moments of the posteriors where rates can still fall or rise)."""
        p, rate = F.col("p"), F.col("rate")
        row = table.withColumn("rate", _rate_column(k, pulls)).agg(
            *(F.sum(F.col("n") * rate * p[d]) for d in range(k)),
            *(F.sum(F.when(rate > 0, F.col("n") * p[d] * p[e])) for d in range(k) for e in range(k)),
        ).first()
        x = np.array([v or 0.0 for v in row])
        return x[:k], x[k:].reshape(k, k)

    now, moments = totals([])
    if now.sum() == 0:
        return []
    target = weights * growth * now[anchor] / weights[anchor]
    pulls, got, last = [], now, None
    for _ in range(STEPS):
        if (np.abs(got - target) <= ENOUGH * target).all() or (last is not None and (np.abs(got - last) <= 1e-6 * target).all()):
            break
        pulls.append(np.linalg.solve(moments + np.eye(k) * 1e-9 * moments.trace(), got - target))
        last = got
        got, moments = totals(pulls)
    return pulls


def _plan(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], anchor: str, growth: float, sample: int):
    """(domains, classifier, table of doc_id, n, p, gradients)."""
    domains = sorted(targets)
    model = train(docs, labelled, domains, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, p = model.posteriors(b.column(1)) if model else (T.word_counts(b.column(1)), np.full((b.num_rows, len(domains)), 1 / len(domains)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(list(p), pa.list_(pa.float64()))], names=["doc_id", "n", "p"])

    table = written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, p array<double>"))
    pulls = solve(table, np.array([float(targets[d]) for d in domains]), domains.index(anchor), growth) if model else []
    return domains, model, table, pulls


def _copies(rate: np.ndarray, chance: np.ndarray) -> np.ndarray:
    return np.floor(rate).astype(np.int64) + (chance < rate - np.floor(rate))


def _chance() -> Column:
    """A number in [0, 1) set by the id."""
    return F.pmod(F.xxhash64(F.lit("mixing"), F.col("doc_id")), F.lit(1_000_003)) / F.lit(1_000_003.0)


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], anchor: str, growth: float = 1.1, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_tokens, the posterior of each domain, rate and copies of every document."""
    domains, _, table, pulls = _plan(docs, labelled, targets, anchor, growth, sample)
    rated = table.select("*", _rate_column(len(domains), pulls).alias("rate"), F.coalesce(_chance(), F.lit(0.0)).alias("chance"))
    whole = F.floor("rate")
    copies = whole + (F.col("chance") < F.col("rate") - whole).cast("long")
    return rated.select("doc_id", F.col("n").alias("n_tokens"), *(F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(domains)), "rate", copies.alias("copies"))


def misfits(rated: DataFrame, targets: Mapping[str, float], anchor: str, growth: float = 1.1) -> dict[str, float]:
    """By how much of its target each domain's total is off; rated: what :func:`mixing_rates` returns."""
    total = lambda d, rate: F.sum(F.col("n_tokens") * rate * F.col(f"p_{d}"))
    now, *got = rated.agg(total(anchor, F.lit(1.0)), *(total(d, F.col("rate")) for d in targets)).first()
    return {d: (x or 0.0) / (w * growth * now / targets[anchor]) - 1 if now else 0.0 for (d, w), x in zip(targets.items(), got, strict=True)}


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], anchor: str, growth: float = 1.1, sample: int = SAMPLE) -> DataFrame:
    """The documents with all their columns, each as many times as its rate says."""
    _, model, _, pulls = _plan(docs, labelled, targets, anchor, growth, sample)
    if model is None:
        return docs
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, p = model.posteriors(b.column(at))
            rows = np.repeat(np.arange(b.num_rows), _copies(rates(p, pulls), b.column(len(columns)).to_numpy()))
            for s in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([c.take(pa.array(rows[s : s + 4096])) for c in b.columns[: len(columns)]], names=columns)

    return docs.select(*columns, _chance().alias(free_name(docs, "chance"))).mapInArrow(run, docs.schema)


#: production domains, from the labels table: a corpus of good text, each token of it read 1.1 times, in which
#: low quality and toxic text keep small known shares, so that a model has met what it is to be told apart from
TARGETS = {"good": 0.93, "low": 0.05, "toxic": 0.02}


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of labelled documents: toxic, else low quality, else good."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.where(F.col("doc_id").isNotNull()).select("doc_id", domain.alias("domain"))
