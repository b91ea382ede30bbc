"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are lower-cased words and an end after each text.  Exact training counts of all tokens come
from one distributed aggregation.  The neural model predicts the next *symbol* from the two
before: the commonest tokens are symbols of their own, all others fall into classes by their last
two bytes, and inside a class a token has its count's share, with the mass of the tokens seen once
kept for unknown ones.  So every token has a normalised probability over the training tokens and
one unknown token per class.

Training is numpy in Spark tasks.  Training text is dealt by a hash to logical shards of about
SHARD tokens and to ROUNDS rounds.  In each round every shard runs NCE with Adagrad over its text, in
order of the hash, from the parameters and squared gradients so far; these are then averaged over all
shards, weighted by tokens.  So the model depends on the table, not on its partitions.
Scoring multiplies the distinct contexts of a batch with all symbol vectors for the normaliser.

At most about ``TOP`` commonest tokens (a fixed number) are sent to all tasks, of equally common ones
those with the least hashes; counts of the others meet their documents in a join on the token hash,
to which a document sends a token once, and whose skewed partitions adaptive execution splits.

Tokens are told apart by 64-bit hashes.  Defined cases: null text counts as empty and holds the end
only; repeated rows are scored alike; with no training text the counts are 0 and base_score is that
of unknown tokens (score then follows the same formula); further columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import textops as T
from tempora.llm.anchors import signed
from tempora.llm.shared import written

TOP = 65_536  # tokens whose counts all tasks hold
OWN = 448  # of these, symbols of their own
CLASSES = 192
DIM, BATCH, NOISE, RATE = 32, 1024, 64, 0.08
SHARD, ROUNDS = 1 << 20, 3
FAN_IN = 64  # tasks whose sums are added in one group
END = np.uint64(0x7E3D5A1BC0F48961)

SYMBOLS = OWN + CLASSES
START = SYMBOLS  # context before a text


class Tokens:
    """Token hashes and classes of the documents of a chunk; each document ends in END."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        low = T.LOWER[buf]
        w = T.Words(low, offs)
        h = w.hashes()
        last = low[np.maximum(w.end - 1, 0)].astype(np.int64) if len(h) else np.zeros(0, np.int64)
        before = np.where(w.end - w.start > 1, low[np.maximum(w.end - 2, 0)], 0) if len(h) else last
        cls = T.mix((last * 256 + before).astype(np.uint64)) % T.U(CLASSES)
        n = len(w.count)
        self.bounds = w.bounds + np.arange(n + 1)
        self.hash = np.full(len(h) + n, END, np.uint64)
        self.cls = np.zeros(len(h) + n, np.int64)
        inside = np.ones(len(self.hash), bool)
        inside[self.bounds[1:] - 1] = False
        self.hash[inside], self.cls[inside] = h, cls.astype(np.int64)
        self.doc = np.repeat(np.arange(n), np.diff(self.bounds))


class Lookup:
    """The commonest tokens: hash -> place, count."""

    BITS = 18

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        """In order of falling counts; the first OWN are symbols."""
        self.order = np.argsort(hashes)
        self.hashes, self.counts = np.append(hashes[self.order], T.U(0)), counts
        cell = (hashes[self.order] >> T.U(64 - self.BITS)).astype(np.int64)
        self.begin = np.searchsorted(cell, np.arange((1 << self.BITS) + 1))
        self.most = int(np.diff(self.begin).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place in order of counts, or -1."""
        out = np.full(len(h), -1, np.int64)
        cell = (h >> T.U(64 - self.BITS)).astype(np.int64)
        at, end = self.begin[cell], self.begin[cell + 1]
        live = np.flatnonzero(at < end)
        for _ in range(self.most):
            hit = self.hashes[at[live]] == h[live]
            out[live[hit]] = self.order[at[live[hit]]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


def symbols(t: Tokens, place: np.ndarray) -> np.ndarray:
    return np.where((place >= 0) & (place < OWN), place, OWN + t.cls)


def contexts(sym: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two before each token."""
    one, two = np.full(len(sym), START), np.full(len(sym), START)
    one[1:], two[2:] = sym[:-1], sym[:-2]
    first = bounds[:-1]
    one[first] = START
    two[first] = START
    second = first + 1
    two[second[second < bounds[1:]]] = START
    return one, two


class LogBilinear:
    """score(w | one, two) = (c1 * r[one] + c2 * r[two]) . q[w] + b[w]"""

    def __init__(self, unigram: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = unigram
        self.r = rng.normal(0, 0.1, (SYMBOLS + 1, DIM)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (SYMBOLS, DIM)).astype(np.float32)
        self.b = np.log(unigram).astype(np.float32)
        self.c = np.ones((2, DIM), np.float32)
        self.norm = None

    def parameters(self) -> list[np.ndarray]:
        return [self.r, self.q, self.b[:, None], self.c]

    def train(self, sym, one, two, rng, grads) -> None:
        """One pass of noise-contrastive estimation; grads: squared-gradient sums (Adagrad)."""
        logkp = np.log(NOISE * self.p).astype(np.float32)
        for s in range(0, len(sym), BATCH):
            w, a, b = sym[s : s + BATCH], one[s : s + BATCH], two[s : s + BATCH]
            noise = rng.choice(SYMBOLS, NOISE, p=self.p)
            ra, rb = self.r[a], self.r[b]
            ctx = ra * self.c[0] + rb * self.c[1]
            qw, qn = self.q[w], self.q[noise]
            pos = 1 / (1 + np.exp(np.einsum("ij,ij->i", ctx, qw) + self.b[w] - logkp[w]))  # 1 - P(data)
            neg = 1 / (1 + np.exp(-(ctx @ qn.T + self.b[noise] - logkp[noise])))  # P(data) of noise
            # ascent directions of the log likelihood, means over the batch
            n = len(w)
            pos, neg = (pos / n).astype(np.float32), (neg / n).astype(np.float32)
            g_ctx = pos[:, None] * qw - neg @ qn
            g_q = np.zeros_like(self.q)
            _add_rows(g_q, w, pos[:, None] * ctx)
            drawn = np.zeros((SYMBOLS, NOISE), np.float32)
            drawn[noise, np.arange(NOISE)] = 1
            g_q -= drawn @ (neg.T @ ctx)
            g_b = np.bincount(w, pos, minlength=SYMBOLS) - np.bincount(noise, neg.sum(0), minlength=SYMBOLS)
            g_r = np.zeros_like(self.r)
            _add_rows(g_r, a, g_ctx * self.c[0])
            _add_rows(g_r, b, g_ctx * self.c[1])
            g_c = np.stack([(g_ctx * ra).sum(0), (g_ctx * rb).sum(0)])
            for p, g, acc in zip((self.r, self.q, self.b, self.c), (g_r, g_q, g_b.astype(np.float32), g_c), grads, strict=True):
                acc += g * g
                p += RATE * g / (np.sqrt(acc) + 1e-6)

    def copy(self) -> LogBilinear:
        out = copy.copy(self)
        out.r, out.q, out.b, out.c = (x.copy() for x in (self.r, self.q, self.b, self.c))
        return out

    def new_grads(self) -> list[np.ndarray]:
        return [np.full(p.shape, 1e-8, np.float32) for p in (self.r, self.q, self.b, self.c)]

    def log10(self, sym, one, two) -> np.ndarray:
        """Normalised log10 probability of each symbol in its context; normalisers are kept by context."""
        width = SYMBOLS + 1
        if self.norm is None:
            self.norm = np.full(width * width, np.nan, np.float32)
        pair = one * width + two
        new = np.unique(pair[np.isnan(self.norm[pair])])
        for s in range(0, len(new), 8192):
            p = new[s : s + 8192]
            z = (self.r[p // width] * self.c[0] + self.r[p % width] * self.c[1]) @ self.q.T + self.b
            top = z.max(1)
            z -= top[:, None]
            self.norm[p] = top + np.log(np.exp(z, out=z).sum(1))
        score = np.empty(len(sym))
        for s in range(0, len(sym), 65536):
            cut = slice(s, s + 65536)
            ctx = self.r[one[cut]] * self.c[0] + self.r[two[cut]] * self.c[1]
            score[cut] = np.einsum("ij,ij->i", ctx, self.q[sym[cut]]) + self.b[sym[cut]] - self.norm[pair[cut]]
        return score / np.log(10)


def _add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at.astype(np.int16), kind="stable")
    s = at[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    if len(first):
        out[s[first]] += np.add.reduceat(rows[order], first, axis=0)


# -- distributed steps ----------------------------------------------------------------


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts, merged over a few chunks at a time."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush():
        h, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        held.clear()
        return pa.RecordBatch.from_arrays([signed(h[first]), pa.array(c[order][first].astype(np.int32)), pa.array(np.add.reduceat(n[order], first))], names=["token", "cls", "n"])

    size = 0
    for b in batches:
        for _, _, buf, offs in T.chunks(b.column(0)):
            t = Tokens(buf, offs)
            h, at, n = np.unique(t.hash, return_index=True, return_counts=True)
            held.append((h, t.cls[at], n))
            size += len(h)
            if size > 1_000_000:
                yield flush()
                size = 0
    if held:
        yield flush()


class Model:
    """Counts, classes and neural parameters, as sent to tasks."""

    def __init__(self, top: list, stats: list):
        self.lookup = Lookup(np.array([r.token for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], np.float64))
        self.tokens = sum(r.n for r in stats)
        self.distinct = sum(r.v for r in stats)
        # what classes hold besides the symbols of their own
        n, v, once = (np.zeros(CLASSES) for _ in range(3))
        for r in stats:
            n[r.cls], v[r.cls], once[r.cls] = r.n, r.v, r.once
        for r in top[:OWN]:
            n[r.cls] -= r.n
            once[r.cls] -= r.n == 1
        unknown = np.clip(np.where(n > 0, once / np.maximum(n, 1), 1.0), 1 / (n + 2), 0.5)
        unknown[n <= 0] = 1.0  # an empty class holds unknown tokens only
        self.log_unknown = np.log10(unknown)
        self.log_share = np.log10(np.maximum(1 - unknown, 1e-12) / np.maximum(n, 1))
        mass = np.concatenate([[r.n for r in top[:OWN]], np.zeros(OWN - len(top[:OWN])), n]) + 0.5
        self.net = LogBilinear(mass / mass.sum())


def _train(model: Model, state: list[np.ndarray], begin: int):
    """(shard, text) in order of shards -> sums of what the task's shards end with, weighted by tokens.

    state: squared gradients so far; begin: seed of the round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = [np.zeros(p.shape) for p in (*model.net.parameters(), *state)], 0
        now, seen, net, grads, rng = None, 0, None, None, None

        def close():
            nonlocal total
            if seen:
                for acc, p in zip(sums, (*net.parameters(), *grads), strict=True):
                    acc += seen * p.reshape(acc.shape).astype(np.float64)
                total += seen

        for b in batches:
            shards = b.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hi == lo:
                    continue
                if shards[lo] != now:
                    close()
                    now, seen = shards[lo], 0
                    net, grads, rng = model.net.copy(), [g.copy() for g in state], np.random.default_rng([begin, int(now)])
                for _, _, buf, offs in T.chunks(b.column(1).slice(lo, hi - lo)):
                    t = Tokens(buf, offs)
                    sym = symbols(t, model.lookup.find(t.hash))
                    net.train(sym, *contexts(sym, t.bounds), rng, grads)
                    seen += len(sym)
        close()
        if total:
            leaf = TaskContext.get().partitionId() // FAN_IN
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(sums)), pa.int32()), pa.array([leaf] * len(sums), pa.int32()), pa.array([float(total)] * len(sums)), pa.array([x.astype("<f8").tobytes() for x in sums], pa.binary())],
                names=["part", "leaf", "weight", "value"],
            )

    return run


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, "<f8") for x in rows["value"])
    return pd.DataFrame({"part": rows["part"].iloc[:1], "weight": [rows["weight"].sum()], "value": [total.tobytes()]})


def _totals(tasks: DataFrame) -> DataFrame:
    """part, weight, value: all tasks' sums, those of FAN_IN tasks first so that no group holds them all."""
    kind = "part int, weight double, value binary"
    return tasks.groupBy("part", "leaf").applyInPandas(_summed, kind).groupBy("part").applyInPandas(_summed, kind)


def train(texts: DataFrame, counts: DataFrame) -> Model:
    """texts: doc_id, text of the training documents; counts: token, cls, n."""
    stats = counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum((F.col("n") == 1).cast("int")).alias("once")).collect()
    # levels of counts from the highest on, as far as TOP tokens go; of the next level a share, by hash; only those are fetched
    level = F.floor(F.log("n") * 32)
    sizes = {r.level: r.v for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("v")).collect()}
    wanted, left = F.lit(True), TOP
    for k in sorted(sizes, reverse=True):
        if sizes[k] >= left:
            wanted = (level > k) | ((level == k) & (F.pmod("token", F.lit(1 << 40)) < int(left / sizes[k] * (1 << 40))))
            break
        left -= sizes[k]
    top = sorted(counts.where(wanted).collect(), key=lambda r: (-r.n, r.token)) if sizes else []
    model = Model(top, stats)
    state = model.net.new_grads()
    shards = max(1, -(-model.tokens // SHARD))
    key = F.xxhash64("doc_id", "text")
    dealt = texts.select(F.pmod(key, F.lit(shards)).alias("shard"), F.pmod(F.shiftright(key, 20), F.lit(ROUNDS)).alias("round"), key.alias("key"), "text")
    for k in range(ROUNDS):
        mine = dealt.where(F.col("round") == k).repartition("shard").sortWithinPartitions("shard", "key", "text").select("shard", "text")
        for r in _totals(mine.mapInArrow(_train(model, state, 17 + k), "part int, leaf int, weight double, value binary")).toLocalIterator():
            every = [*model.net.parameters(), *state]
            every[r.part][:] = (np.frombuffer(r.value, "<f8") / r.weight).reshape(every[r.part].shape)
    return model


def _score(model: Model):
    """Per document: what symbols and common tokens add to the scores."""
    n_all = model.tokens + 0.5 * (model.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in T.chunks(b.column(3)):
                t = Tokens(buf, offs)
                place = model.lookup.find(t.hash)
                known = place >= 0
                count = np.where(known, model.lookup.counts[place] if len(model.lookup.counts) else 0.0, 1.0)
                sym = symbols(t, place)
                score = model.net.log10(sym, *contexts(sym, t.bounds))
                score += np.where(known & (sym >= OWN), np.log10(count) + model.log_share[t.cls], 0.0)
                base = np.where(known, np.log10((count + 0.5) / n_all), 0.0)
                n = j - i
                sums = [np.bincount(t.doc, x, minlength=n) for x in (base, score)]
                ints = [np.diff(t.bounds), np.bincount(t.doc, known, minlength=n).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, n) for k in range(3)), *map(pa.array, ints), *map(pa.array, sums)], names=["doc_id", "key", "held_out", "n_tokens", "known", "base", "score"])

    return run


def _rare(model: Model):
    """Tokens that not all tasks know: token, class, document, times; and one row without tokens per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0), b.column(1).to_numpy()
            for i, j, buf, offs in T.chunks(b.column(2)):
                t = Tokens(buf, offs)
                at = np.flatnonzero(model.lookup.find(t.hash) < 0)
                s = T.salted(t.hash[at], t.doc[at])
                _, first, n = np.unique(s, return_index=True, return_counts=True)
                at = at[first]
                doc = np.concatenate([t.doc[at], np.arange(j - i)])
                token = np.concatenate([t.hash[at].view(np.int64), keys[i:j]])
                times = np.concatenate([n, np.zeros(j - i, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.concatenate([t.cls[at], np.zeros(j - i, np.int64)]).astype(np.int32)), ids.take(pa.array(i + doc)), pa.array(keys[i + doc]), pa.array(times.astype(np.int32))], names=["token", "cls", "doc_id", "key", "times"])

    return run


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: int = 1) -> DataFrame:
    """Counts, base score and model score of every document, learned from those not held out."""
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == held_out, F.lit(False))
    texts = base.where(~out)
    counts = written(texts.select("text").mapInArrow(_counts, "token long, cls int, n long").groupBy("token").agg(F.max("cls").alias("cls"), F.sum("n").alias("n")))
    model = train(texts, counts)
    keyed = base.withColumn("key", F.xxhash64("doc_id", "text"))
    main = keyed.select("doc_id", "key", out.alias("held_out"), "text").mapInArrow(_score(model), f"doc_id {kind}, key long, held_out boolean, n_tokens long, known long, base double, score double")

    classes = spark.createDataFrame([(k, float(model.log_unknown[k]), float(model.log_share[k])) for k in range(CLASSES)], "cls int, log_unknown double, log_share double")
    n_all = float(model.tokens + 0.5 * (model.distinct + 1))
    rare = keyed.select("doc_id", "key", "text").mapInArrow(_rare(model), f"token long, cls int, doc_id {kind}, key long, times int")
    met = rare.join(counts.select("token", "n"), "token", "left").join(F.broadcast(classes), "cls")
    n = F.coalesce(F.col("n"), F.lit(0))
    sums = met.groupBy("doc_id", "key").agg(
        F.sum((F.col("times") == 0).cast("long")).alias("rows"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10((n + 0.5) / F.lit(n_all))).alias("rare_base"),
        F.sum(F.col("times") * F.when(F.col("n").isNotNull(), F.log10(n) + F.col("log_share")).otherwise(F.col("log_unknown"))).alias("rare_score"),
    )
    per = lambda c: F.col(c) / F.col("rows")  # noqa: E731  repeated rows have added up
    joined = main.alias("m").join(sums.alias("s"), F.col("m.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("m.key") == F.col("s.key")))
    return joined.select(
        F.col("m.doc_id").alias(doc_id), "held_out", "n_tokens", (F.col("known") + per("rare_known")).cast("long").alias("n_known"), F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + per("rare_base")).alias("base_score"), (F.col("score") + per("rare_score")).alias("score"),
    )
