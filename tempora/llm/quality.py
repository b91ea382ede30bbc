"""Quality rules by repetition coverage.

Each text is cut into words ``[^\\x20\\x09-\\x0D]+``.  Rolling hashes of several n-gram
lengths find the n-grams that occur twice or more in the same text, and the share of word
characters lying inside such n-grams (and inside repeated lines) decides the verdict.
One pass over the documents, no shuffle: every document is judged on its own.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows are
judged alike; other columns are carried through untouched by :func:`quality_filter` and
ignored by :func:`quality_rules`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import textops as T

#: n-gram length -> largest percentage of word characters inside duplicated n-grams
MAX_COVERAGE: Mapping[int, int] = {5: 40, 7: 35, 10: 30}
#: largest percentage of word characters inside lines that equal an earlier line
MAX_LINE_COVERAGE = 30
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT = 20, 8, 30

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")


def measure(buf: np.ndarray, offs: np.ndarray, lengths=tuple(MAX_COVERAGE)) -> dict[str, np.ndarray]:
    """The counts of each document of a chunk; ``cover_<n>``: characters inside duplicated n-grams."""
    w = T.Words(buf, offs)
    n, doc, chars = len(w.start), w.doc(), w.code_points()
    h = w.hashes()
    out = {"n_words": w.count, "word_chars": T.per_doc(chars, w.bounds)}
    out["n_symbols"] = T.per_doc(SYMBOLS[buf], offs)

    # lines: cut at \n and at document borders; those without a word don't count
    cuts = np.unique(np.concatenate([offs[:-1], np.flatnonzero(buf == 10) + 1]))
    ends = np.append(cuts[1:], len(buf))
    is_nl = np.zeros(len(ends), bool)
    some = ends > cuts
    is_nl[some] = buf[ends[some] - 1] == 10
    first, last = np.searchsorted(w.start, cuts), np.searchsorted(w.start, ends)
    full = last > first
    cuts, ends, first, last = cuts[full], (ends - is_nl)[full], first[full], last[full]
    line_doc = np.searchsorted(offs, cuts, "right") - 1
    keys = T.salted(T.range_hash(T.prefix_hash(buf), cuts, ends), line_doc)
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), bool)
    later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    c = np.zeros(n + 1, np.int64)
    np.cumsum(chars, out=c[1:])
    k = len(offs) - 1
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=k)
    out["dup_line_chars"] = np.bincount(line_doc[later], (c[last] - c[first])[later], minlength=k).astype(np.int64)

    for length in (REPEAT_WINDOW, *lengths):
        starts = np.flatnonzero(T.windows_inside(w.bounds, length, n))
        hit = T.repeated(T.salted(T.window_hash(h, length)[starts], doc[starts]))
        inside = T.covered(starts[hit], length, n)
        if length == REPEAT_WINDOW:
            out["n_repeat_words"] = T.per_doc(inside, w.bounds)
        if length in lengths:
            out[f"cover_{length}"] = T.per_doc(np.where(inside, chars, 0), w.bounds)
    return out


def _verdict(prefix: str = "") -> tuple:
    col = lambda name: F.col(f"{prefix}{name}")
    base = (col("n_words") < MIN_WORDS) | (100 * col("n_repeat_words") > MAX_REPEAT * col("n_words"))
    bad = 100 * col("dup_line_chars") > MAX_LINE_COVERAGE * col("word_chars")
    for length, most in MAX_COVERAGE.items():
        bad = bad | (100 * col(f"cover_{length}") > most * col("word_chars"))
    return base, ~base & ~bad


def _measured(docs: DataFrame, carry: list[str], text: str, prefix: str) -> DataFrame:
    names = [*FIELDS, *(f"cover_{n}" for n in MAX_COVERAGE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(buf, offs) for _, _, buf, offs in T.chunks(batch.column(batch.num_columns - 1))]
            cols = [pa.array(np.concatenate([f[x] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64)) for x in names]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*carry, *(prefix + x for x in names)])

    schema = docs.select(*carry).schema
    for x in names:
        schema = schema.add(prefix + x, "long")
    return docs.select(*carry, F.col(text).alias(f"{prefix}text")).mapInArrow(run, schema)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its counts, ``base_failed`` and the verdict ``kept``."""
    out = _measured(docs, [doc_id], text, "")
    base, kept = _verdict()
    return out.withColumn("base_failed", base).withColumn("kept", kept)


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    columns, prefix = docs.columns, "_quality_"
    while any(c.startswith(prefix) for c in columns):
        prefix = "_" + prefix
    out = _measured(docs, columns, text, prefix)
    return out.where(_verdict(prefix)[1]).select(*columns)


_SQL_COVER = "\n".join(
    f"""g{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS dup FROM (
  SELECT doc_id, i, ws[i:i+{n - 1}] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w WHERE len(ws) >= {n}))),
c{n} AS (SELECT doc_id, sum(len(x)) AS chars, count(*) AS n FROM (
  SELECT DISTINCT t.doc_id, t.i, t.x FROM wt t JOIN (SELECT doc_id, unnest(range(i, i + {n})) AS i FROM g{n} WHERE dup) r ON t.doc_id = r.doc_id AND t.i = r.i) GROUP BY doc_id),"""
    for n in sorted({REPEAT_WINDOW, *MAX_COVERAGE})
)
QUALITY_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
wt AS (SELECT doc_id, i, ws[i] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
{_SQL_COVER}
l AS (SELECT doc_id, sum(n - 1) AS lines, sum((n - 1) * chars) AS chars FROM (
  SELECT doc_id, line, count(*) AS n, any_value(list_sum(list_transform(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), lambda x: len(x)))) AS chars
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: len(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.lines, 0)::BIGINT AS n_dup_lines, coalesce(c{REPEAT_WINDOW}.n, 0)::BIGINT AS n_repeat_words,
  coalesce(l.chars, 0)::BIGINT AS dup_line_chars, {", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS cover_{n}" for n in MAX_COVERAGE)}
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id {" ".join(f"LEFT JOIN c{n} ON w.doc_id = c{n}.doc_id" for n in sorted({REPEAT_WINDOW, *MAX_COVERAGE}))})
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words OR 100 * dup_line_chars > {MAX_LINE_COVERAGE} * word_chars
  {" ".join(f"OR 100 * cover_{n} > {m} * word_chars" for n, m in MAX_COVERAGE.items())}) AS kept
FROM b
"""
