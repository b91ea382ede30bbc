"""Language identification by a byte convolutional network.

Bytes are one-hot classes; filters of widths 2, 3 and 4 slide over fixed-length windows,
followed by max pooling and softmax.  Training is plain numpy (Adam) on a bounded sample of
labelled documents.  For inference the first layer is folded into look-up tables, so that a
filter bank costs a table read per byte; each text is cut into windows that together cover
all of it, and the windows' log-probabilities are averaged by the bytes they hold.

At most ``sample`` documents (those with the least hashes of their ids), whole, are learned from;
tasks cut them into windows, short ones too, of which the driver gets a byte per place: at most
``WINDOWS`` of them, those with the least hashes, however long the texts are.  Every text is predicted
whole, in one pass without a shuffle.

Defined cases: a text that is null or has no letter gets ``und`` and score 0, as does
every text when nothing could be learned; null languages are not learned from; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import textops as T
from tempora.llm.shared import held_out, sampled

SAMPLE = 2000  # documents learned from
WINDOWS = 1 << 17  # windows learned from
LENGTH, TAIL = 128, 3  # window, and the bytes after it that its last filters see
CLASSES, FILTERS, WIDTHS = 64, 16, (2, 3, 4)
EPOCHS, BATCH, RATE = 4, 128, 0.01

#: byte -> class: letters without case, blanks, digits, other ASCII, and the high bytes folded to 34
CLASS = np.zeros(256, np.int32)
CLASS[97:123] = CLASS[65:91] = np.arange(3, 29)
CLASS[48:58] = 2
CLASS[[32, 9, 10, 13]] = 1
CLASS[128:192] = 29 + np.arange(64) % 17
CLASS[192:256] = 46 + np.arange(64) % 18


def windows(col) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(classes by position and window, document of each window, bytes in it)."""
    for i, _, buf, offs in T.chunks(col, 1 << 20):
        size = np.diff(offs)
        n = -(-size // LENGTH)
        doc = np.repeat(np.arange(len(size)), n)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start, stop = offs[doc] + k * LENGTH, offs[doc + 1]
        cls = np.append(CLASS[buf], 0)
        for a in range(0, len(doc), 4096):
            at = start[a : a + 4096][None, :] + np.arange(LENGTH + TAIL)[:, None]
            inside = at < stop[a : a + 4096][None, :]
            yield np.where(inside, cls[np.minimum(at, len(buf))], 0), doc[a : a + 4096] + i, np.minimum(stop - start, LENGTH)[a : a + 4096]


class Network:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.w = {k: (rng.normal(0, 0.3, (k, CLASSES, FILTERS))).astype(np.float32) for k in WIDTHS}
        self.b = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def tables(self):
        w = self.w
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
        return pair(w[2][0], w[2][1]), pair(w[3][0], w[3][1]), w[3][2], pair(w[4][0], w[4][1]), pair(w[4][2], w[4][3])

    def pooled(self, x: np.ndarray, tables) -> np.ndarray:
        """Max-pooled filter responses (before ReLU) of windows; x: classes by position and window."""
        two, three, three_c, four, four_b = tables
        bi = x[:-1] * CLASSES + x[1:]
        best = [np.full((x.shape[1], FILTERS), -np.inf, np.float32) for _ in WIDTHS]
        for j in range(LENGTH):
            np.maximum(best[0], two[bi[j]], out=best[0])
            r = three[bi[j]]
            r += three_c[x[j + 2]]
            np.maximum(best[1], r, out=best[1])
            r = four[bi[j]]
            r += four_b[bi[j + 2]]
            np.maximum(best[2], r, out=best[2])
        return np.concatenate(best, 1)

    def log_softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.b.ravel(), 0) @ self.out + self.bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        """Adam on cross entropy; x: classes by position and window, y: label numbers."""
        rng, t = np.random.default_rng(seed), 0
        params = [*(self.w[k] for k in WIDTHS), self.b, self.out, self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for _ in range(EPOCHS):
            order = rng.permutation(x.shape[1])
            for s in range(0, len(order), BATCH):
                pick = order[s : s + BATCH]
                xb, yb, n = x[:, pick], y[pick], len(pick)
                tops, best = [], []
                for k in WIDTHS:
                    resp = sum(self.w[k][q][xb[q : LENGTH + q]] for q in range(k))
                    top = resp.argmax(0)
                    tops.append(top)
                    best.append(np.take_along_axis(resp, top[None], 0)[0])
                pre = np.concatenate(best, 1) + self.b.ravel()
                hid = np.maximum(pre, 0)
                z = hid @ self.out + self.bias
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                p[np.arange(n), yb] -= 1
                p /= n
                g_hid = (p @ self.out.T) * (pre > 0)
                grads = []
                for i, k in enumerate(WIDTHS):
                    g = np.zeros_like(self.w[k])
                    gh = g_hid[:, i * FILTERS : (i + 1) * FILTERS]
                    f = np.broadcast_to(np.arange(FILTERS), gh.shape)
                    for q in range(k):
                        np.add.at(g[q], (xb[tops[i] + q, np.arange(n)[:, None]], f), gh)
                    grads.append(g)
                grads += [g_hid.sum(0).reshape(self.b.shape), hid.T @ p, p.sum(0)]
                t += 1
                for q, g in enumerate(grads):
                    m[q] += 0.1 * (g - m[q])
                    v[q] += 0.001 * (g * g - v[q])
                    params[q] -= RATE * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.999**t)) + 1e-8)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of the texts: language, classes of the bytes."""
    for b in batches:
        lang = b.column(0)
        for x, doc, _ in windows(b.column(1)):
            rows = [w.tobytes() for w in np.ascontiguousarray(x.T.astype(np.uint8))]
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(doc)), pa.array(rows, pa.binary())], names=["lang", "window"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network from at most ``sample`` documents that are not held out."""
    known = docs.where(~held_out(F.col("doc_id"), 0) & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", F.xxhash64("text").alias("mark"))
    # repeated rows count once; only ids are ordered
    chosen = sampled(known.distinct(), sample, "doc_id", "lang", "mark")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.lang") == F.col("c.lang")) & (F.xxhash64("d.text") == F.col("c.mark"))
    texts = docs.alias("d").join(F.broadcast(chosen.alias("c")), same).select("c.doc_id", "c.lang", "c.mark", "d.text").dropDuplicates(["doc_id", "lang", "mark"])
    cut = texts.select("lang", "text").mapInArrow(_cut, "lang string, window binary")
    rows = cut.orderBy(F.xxhash64("window"), "window", "lang").limit(WINDOWS).collect()
    labels = sorted({r.lang for r in rows})
    if not labels:
        return None
    rows.sort(key=lambda r: (r.window, r.lang))  # whatever the partitions were
    net, number = Network(labels), {k: i for i, k in enumerate(labels)}
    x = np.frombuffer(b"".join(r.window for r in rows), np.uint8).reshape(len(rows), LENGTH + TAIL)
    net.train(np.ascontiguousarray(x.T.astype(np.int32)), np.array([number[r.lang] for r in rows]))
    return net


def _has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    out = T.per_doc(ascii_letter[buf], offs) > 0
    for d in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[d] = any(c.isalpha() for c in buf[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predict(net: Network | None, col, tables=None) -> tuple[list[str], np.ndarray]:
    n = len(col)
    if net is None:
        return ["und"] * n, np.zeros(n)
    letter = np.concatenate([np.zeros(0, bool), *(_has_letter(buf, offs) for _, _, buf, offs in T.chunks(col))])
    tables = tables or net.tables()
    total = np.zeros((n, len(net.labels)))
    weight = np.full(n, 1e-9)
    for x, doc, size in windows(col):
        lp = net.log_softmax(net.pooled(x, tables)) * size[:, None]
        for k in range(len(net.labels)):
            total[:, k] += np.bincount(doc, lp[:, k], minlength=n)
        weight += np.bincount(doc, size, minlength=n)
    mean = total / weight[:, None]
    p = np.exp(mean - mean.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    top = p.argmax(1)
    return [net.labels[k] if ok else "und" for k, ok in zip(top, letter, strict=True)], np.where(letter, p[np.arange(n), top], 0.0)


def identify_language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    net = train(docs, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for b in batches:
            lang, score = predict(net, b["text"], tables)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
