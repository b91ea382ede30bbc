"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored in context windows.

The lexicon is learned from labelled documents: terms, and stems with many endings, that
occur almost only in toxic texts.  The lexicon trie and the Levenshtein automaton of each
entry are intersected once, on the driver, and made deterministic; tasks then run all words
of a batch through the table in lockstep, so that exact and misspelled terms cost a few table
look-ups each.  Words are runs of letters; letters, edits (one at most: a letter put in, left out,
replaced, or two neighbours swapped) and look-ups are by code point, accents apart.  Every hit is
scored in a window of words around it: hits close together count more, hits between a pair of
quotation marks count as quotation.  A mark opens if no letter comes before it and no blank after it,
closes the other way round, and counts as an apostrophe between letters.  A logistic model over these
window scores gives the probability.

The classifier is fitted on at most ``sample`` labelled documents (those with the least hashes of
their ids).  Its lexicon has at most ``entries`` entries, each in a share of SUPPORT of the toxic
documents or more; stems are of MIN_STEM to MAX_STEM letters before they are grown.  Every document is
scored whole, in one pass without a shuffle.

Defined cases: null text counts as empty; empty texts get the score of a text without hits;
repeated labels of an id count as toxic if any is, and its least text counts in learning; null labels
are not learned from; rows without an id are not held out; with no labels the score is 0; further
columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import textops as T
from tempora.llm.shared import held_out, sampled

SAMPLE = 6000
WINDOW = 8
MIN_STEM, MAX_STEM = 3, 8
MAX_ENTRIES = 96
FUZZY_FROM = 5  # entries of so many letters or more also match at one edit
SUPPORT = 0.015  # least share of the toxic documents that hold an entry
STRONG, WEAK = 0.03, 0.6  # most other documents per toxic one
FEATURES = 10

OPEN_OR_CLOSE = {c: family for family, marks in enumerate(('"“”„‟', "«»", "'‘’‚‛", "‹›")) for c in marks}


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter; the letter it stands for (lower case, without accents); whether it is an accent."""
    n = 0x20000
    letter, folded, accent = np.zeros(n, bool), np.arange(n, dtype=np.uint32), np.zeros(n, bool)
    for c in range(n):
        x = chr(c)
        if unicodedata.combining(x):
            accent[c] = True
        elif x.isalpha():
            letter[c] = True
            y = unicodedata.normalize("NFKD", x.lower())
            if y and y[0].isalpha() and all(unicodedata.combining(z) for z in y[1:]):
                folded[c] = ord(y[0])
            elif len(x.lower()) == 1:
                folded[c] = ord(x.lower())
    return letter, folded, accent


class Folded:
    """The texts of a chunk as code points: folded ones, document offsets, and words (runs of letters)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        letter, folded, accent = _tables()
        if len(buf) and buf.max() < 128:
            self.points, self.offs = buf.astype(np.uint32), offs
        else:
            self.points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
            stays = (self.points >= len(accent)) | ~accent[np.minimum(self.points, len(accent) - 1)]  # accents go
            before = np.zeros(len(buf) + 1, np.int64)
            np.cumsum((buf & 0xC0) != 0x80, out=before[1:])
            self.offs = np.concatenate([[0], np.cumsum(stays)])[before[offs]]
            self.points = self.points[stays]
        near = np.minimum(self.points, len(letter) - 1)
        self.is_letter = letter[near] | (self.points >= len(letter))
        self.text = np.where(self.points < len(letter), folded[near], self.points)
        st, en = self.is_letter.copy(), self.is_letter.copy()
        st[1:] &= ~self.is_letter[:-1]
        en[:-1] &= ~self.is_letter[1:]
        some = np.diff(self.offs) > 0
        first, last = self.offs[:-1][some], self.offs[1:][some] - 1
        st[first], en[last] = self.is_letter[first], self.is_letter[last]
        self.start, self.end = np.flatnonzero(st), np.flatnonzero(en) + 1
        self.bounds = np.searchsorted(self.start, self.offs)

    def words(self, d: int) -> list[str]:
        lo, hi = int(self.offs[d]), int(self.offs[d + 1])
        text = self.text[lo:hi].astype("<u4").tobytes().decode("utf-32-le", "replace")
        k = slice(self.bounds[d], self.bounds[d + 1])
        return [text[a - lo : e - lo] for a, e in zip(self.start[k].tolist(), self.end[k].tolist(), strict=True)]

    def quoted(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of the spans of document d between a mark that opens and the next of its family that closes."""
        lo, hi = int(self.offs[d]), int(self.offs[d + 1])
        p = self.points[lo:hi]
        spans, opened = [], {}
        for k in np.flatnonzero(np.isin(p, _MARKS)).tolist():
            before, after = (self.is_letter[lo + j] if 0 <= j < len(p) else False for j in (k - 1, k + 1))
            blank_before, blank_after = (p[j] <= 32 if 0 <= j < len(p) else True for j in (k - 1, k + 1))
            family = OPEN_OR_CLOSE[chr(p[k])]
            if before and after:
                continue
            closes, opens = not blank_before and not after, not before and not blank_after
            if closes and family in opened:
                spans.append((opened.pop(family) + lo, k + lo))
            elif opens:
                opened[family] = k
        both = np.array(sorted(spans), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


_MARKS = np.array(sorted(map(ord, OPEN_OR_CLOSE)), np.uint32)


# -- lexicon --------------------------------------------------------------------------


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, other = Counter(), Counter()
    for b in batches:
        labels = b["toxic"].to_pylist()
        for i, j, buf, offs in T.chunks(b["text"]):
            f = Folded(buf, offs)
            for d in range(j - i):
                found = set()
                for w in set(f.words(d)):
                    found.add(w + "$")
                    found.update(w[:k] for k in range(MIN_STEM, min(MAX_STEM, len(w)) + 1))
                (toxic if labels[i + d] else other).update(found)
    keys = list(toxic.keys() | other.keys())
    yield pa.RecordBatch.from_pydict({"stem": pa.array(keys, pa.string()), "n_toxic": pa.array([toxic[k] for k in keys], pa.int64()), "n_other": pa.array([other[k] for k in keys], pa.int64())})


def learn_lexicon(labelled: DataFrame, n_toxic: int, entries: int = MAX_ENTRIES) -> list[tuple[str, bool, bool]]:
    """(entry, is_stem, strong): the shortest telling stems or words, each grown to the common part of its words.

    Strong entries occur almost only in toxic texts; weak ones occur in others too, but less often.
    """
    support = max(4, int(SUPPORT * n_toxic))
    # a document has few stems in comparison with 1 / SUPPORT, so the sample bounds these rows
    rows = (
        labelled.dropDuplicates(["text"]).mapInArrow(_stem_counts, "stem string, n_toxic long, n_other long")
        .groupBy("stem").agg(F.sum("n_toxic").alias("t"), F.sum("n_other").alias("o"))
        .where((F.col("t") >= support) & (F.col("o") <= WEAK * F.col("t"))).collect()
    )
    rows.sort(key=lambda r: (-r.t, r.stem))
    strong = _grown({r.stem: r.t for r in rows if r.o <= STRONG * r.t})
    weak = _grown({r.stem: r.t for r in rows if not any(r.stem.startswith(e) or e.startswith(r.stem.rstrip("$")) for e in strong)})
    best = [(e, *v, True) for e, v in strong.items()] + [(e, *v, False) for e, v in weak.items()]
    best.sort(key=lambda x: (not x[3], -x[2], x[0]))
    return [(e, stem, kind) for e, stem, _, kind in best[:entries]]


def _grown(pure: dict[str, int]) -> dict[str, tuple[bool, int]]:
    """entry -> (is_stem, toxic documents) of the shortest of these stems and words."""
    children: dict[str, list[str]] = {}
    for s in pure:
        children.setdefault(s[:-1], []).append(s)
    entries: dict[str, tuple[bool, int]] = {}
    for s in sorted(pure, key=lambda s: (len(s), s)):
        if any((s[:k] in pure) for k in range(MIN_STEM, len(s))):
            continue
        at = s
        while not at.endswith("$"):
            full = [c for c in pure if c.endswith("$") and c.startswith(at) and pure[c] >= 0.9 * pure[at]]
            near = [c for c in children.get(at, ()) if not c.endswith("$") and pure[c] >= 0.9 * pure[at]]
            if not full and not near:
                break
            at = (full or near)[0]
        entries[at.rstrip("$")] = (not at.endswith("$"), pure[at])
    return entries


# -- automaton ------------------------------------------------------------------------


class Automaton:
    """Deterministic product of the lexicon trie and the Levenshtein automata (at most one edit, or swap of neighbours)."""

    def __init__(self, lexicon: list[tuple[str, bool, bool]]):
        nodes: list[dict[int, int]] = [{}]
        ends: dict[int, list[tuple[bool, int, bool]]] = {}
        reach = [-1]  # most edits that an entry below the node allows
        for entry, stem, strong in lexicon:
            word, at = [ord(c) for c in entry], 0
            edits = int(strong and len(word) >= FUZZY_FROM)
            reach[0] = max(reach[0], edits)
            for c in word:
                if c not in nodes[at]:
                    nodes[at][c] = len(nodes)
                    nodes.append({})
                    reach.append(-1)
                at = nodes[at][c]
                reach[at] = max(reach[at], edits)
            ends.setdefault(at, []).append((stem, edits, strong))
        letters = sorted({c for n in nodes for c in n})
        self.letters = np.array(letters, np.uint32)  # class of each: its place + 1; of all others 0
        width = len(letters) + 1

        def close(items: set[tuple[int, int, int]]) -> frozenset:
            """items: (node, edits, letter still due of two that are swapped, or -1)."""
            todo = list(items)
            while todo:
                node, e, due = todo.pop()
                for child in nodes[node].values() if due < 0 else ():
                    if e + 1 <= reach[child] and (child, e + 1, -1) not in items:
                        items.add((child, e + 1, -1))
                        todo.append((child, e + 1, -1))
            return frozenset(items)

        def accept(items) -> tuple[int, int]:
            """(kind at the end of a word, kind that any ending keeps); 1 exact, 2 misspelled, 3 weak."""
            now = held = 9
            for node, e, due in items:
                for stem, edits, strong in ends.get(node, ()):
                    if e <= edits and due < 0:
                        kind = e + 1 if strong else 3
                        now = min(now, kind)
                        if stem:
                            held = min(held, kind)
            return now % 9, held % 9

        start = close({(0, 0, -1)}) if lexicon else frozenset()
        ids, todo, table, kinds, held = {frozenset(): 0, start: 1} if start else {frozenset(): 0}, [start] if start else [], {0: [0] * width}, {0: 0}, {0: 0}
        while todo:
            items = todo.pop()
            me = ids[items]
            kinds[me], held[me] = accept(items)
            row = []
            for k in range(width):
                c = letters[k - 1] if k else -1
                out: set[tuple[int, int, int]] = set()
                for node, e, due in items:
                    if due >= 0:
                        if due == c:
                            out.add((node, e, -1))
                        continue
                    for label, child in nodes[node].items():
                        cost = e + (label != c)
                        if cost <= reach[child]:
                            out.add((child, cost, -1))
                        after = nodes[child].get(c)
                        if after is not None and label != c and e + 1 <= reach[after]:
                            out.add((after, e + 1, label))
                    if e + 1 <= reach[node]:
                        out.add((node, e + 1, -1))
                nxt = close(out)
                if nxt not in ids:
                    ids[nxt] = len(ids)
                    todo.append(nxt)
                row.append(ids[nxt])
            table[me] = row
        n = len(ids)
        self.table = np.array([table[i] for i in range(n)], np.int32)
        self.kind = np.array([kinds[i] for i in range(n)], np.int8)
        self.held = np.array([held[i] for i in range(n)], np.int8)
        self.start = 1 if start else 0

    def match(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Kind of each word of a text of code points: 0 none, 1 exact, 2 misspelled, 3 weak entry."""
        out = np.zeros(len(start), np.int8)
        if not self.start or not len(start):
            return out
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        cls = np.where(self.letters[at] == points, at + 1, 0)
        live, pos, state = np.arange(len(start)), start.copy(), np.full(len(start), self.start, np.int32)
        best = out
        while len(live):
            state = self.table[state, cls[pos]]
            pos += 1
            held = self.held[state]
            if held.any():
                at = live[held > 0]
                best[at] = np.where(best[at] == 0, held[held > 0], np.minimum(best[at], held[held > 0]))
            over = pos >= end[live]
            fin = over & (state > 0)
            if fin.any():
                at, kind = live[fin], self.kind[state[fin]]
                best[at] = np.where(kind == 0, best[at], np.where(best[at] == 0, kind, np.minimum(best[at], kind)))
            go = ~over & (state > 0)
            live, pos, state = live[go], pos[go], state[go]
        return best


# -- features and model ---------------------------------------------------------------


def features(auto: Automaton, col) -> np.ndarray:
    """Window features of each document of a column."""
    found = [np.zeros((0, FEATURES))]
    for i, j, buf, offs in T.chunks(col):
        n = j - i
        f = Folded(buf, offs)
        start, end, bounds = f.start, f.end, f.bounds
        kind = auto.match(f.text, start, end)
        at = np.flatnonzero(kind)
        x = np.zeros((n, FEATURES))
        x[:, 0] = 1
        x[:, 7] = np.log1p(np.diff(bounds))
        if len(at):
            doc = np.searchsorted(bounds, at, "right") - 1
            lo, hi = np.maximum(at - WINDOW, bounds[doc]), np.minimum(at + WINDOW, bounds[doc + 1] - 1)
            near = np.searchsorted(at, hi, "right") - np.searchsorted(at, lo, "left")
            spans = [f.quoted(d) for d in np.unique(doc).tolist()]
            begin, stop = (np.concatenate([x[k] for x in spans]) for k in (0, 1))
            # spans of families may overlap, so both borders are counted
            quoted = np.searchsorted(np.sort(begin), start[at]) > np.searchsorted(np.sort(stop), start[at])
            exact, fuzzy, weak = ((kind[at] == k) & ~quoted for k in (1, 2, 3))
            window = np.where(quoted, 0.2, 1.0) * np.array([0, 1.0, 0.4, 0.3])[kind[at]] * (1 + 0.25 * (near - 1))
            ne, nf, nq = (np.bincount(doc[m], minlength=n) for m in (exact, fuzzy, quoted))
            x[:, 1], x[:, 2], x[:, 3] = np.log1p(ne), np.log1p(nf), np.log1p(nq)
            x[:, 4], x[:, 5] = ne > 0, nf > 0
            nw = np.bincount(doc[weak], minlength=n)
            x[:, 8], x[:, 9] = np.log1p(nw), np.minimum(100 * nw / np.maximum(np.diff(bounds), 20), 5)
            np.maximum.at(x[:, 6], doc, np.minimum(window, 3.0))
        found.append(x)
    return np.concatenate(found)


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 40) -> np.ndarray:
    """Logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], l2)
    reg[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + reg * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(reg)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = MAX_ENTRIES):
    """(automaton, weights) from at most ``sample`` labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = sampled(known, sample, "doc_id")
    labelled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    n_toxic = chosen.agg(F.sum("toxic")).first()[0] or 0
    auto = Automaton(learn_lexicon(labelled, n_toxic, entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(auto, b["text"])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b["toxic"]], names=["x", "y"])

    rows = labelled.mapInArrow(run, "x array<double>, y int").collect() if auto.start else []
    if not rows:
        return auto, None
    return auto, fit(np.array([r.x for r in rows]), np.array([r.y for r in rows], float))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = MAX_ENTRIES) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of unquoted exact, misspelled and quoted hits."""
    auto, weights = train(docs, labels, sample, entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(auto, b["text"])
            score = np.zeros(len(x)) if weights is None else 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500)))
            hits = [pa.array(np.rint(np.expm1(x[:, k])).astype(np.int64)) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), *hits], names=["doc_id", "held_out", "score", "predicted", "n_exact", "n_misspelled", "n_quoted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_exact long, n_misspelled long, n_quoted long")
