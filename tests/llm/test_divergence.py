"""Radix tries against counted words, and the audit against SQL on awkward fixtures."""

import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tempora.llm import divergence as D
from tempora.llm import textops as T

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall(text.translate(LOWER))


def trie(texts, group, lang):
    raw = [t.encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *(len(r) for r in raw)])
    begin, end, doc = D.spans(buf, offs, D.LETTER)
    return D.Trie.of(T.LOWER[buf], begin, end, doc, np.array(group), np.array(lang))


def contents(t):
    out = []
    for leaf, key, n in (t.counts, t.holds):
        out.append({(w, k): c for w, k, c in zip(t.terms(leaf), key.tolist(), n.tolist(), strict=True)})
    return out


def expected(texts, group, lang):
    counts, holds = collections.Counter(), collections.Counter()
    for t, g, x in zip(texts, group, lang, strict=True):
        ws = words(t)
        counts.update((w, g) for w in ws)
        holds.update((w, x) for w in set(ws))
    return [dict(counts), dict(holds)]


def some_texts(seed, n=60):
    rnd = random.Random(seed)
    stems = ["a", "abcdefgh", "abcdefghi", "abcdefghijklmnopq", "Ünï", "zß", "日本語", "QQ", "x" * 50, "abc", "ab"]
    return [" ".join(rnd.choice(stems) + rnd.choice(["", "", "s", "ed", "日"]) + rnd.choice(["", "!", "7b", "\n"]) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_tries_count_merge_cut_and_walk():
    rnd = random.Random(1)
    parts = []
    for seed in range(5):
        texts = some_texts(seed)
        group, lang = [rnd.randrange(4) for _ in texts], [rnd.randrange(2) for _ in texts]
        t = trie(texts, group, lang)
        assert contents(t) == expected(texts, group, lang)
        assert contents(D.Trie.load(t.dump())) == contents(t)
        parts.append((t, texts, group, lang))
    whole = D.Trie.merged([D.Trie.merged([p[0] for p in parts[:2]]), *(p[0] for p in parts[2:])])
    want = expected(*(sum((p[k] for p in parts), []) for k in (1, 2, 3)))
    assert contents(whole) == want
    place = whole.preorder()
    leaves = np.unique(whole.counts[0])
    walked = whole.terms(leaves[np.argsort(place[leaves])])
    assert walked == sorted(walked, key=str.encode) and len(place) == len(np.unique(place))
    borders = np.unique(whole.levels[0][1][[1, 3, 5]])
    slices = list(whole.cut(borders))
    assert len(slices) == 4
    assert {k: v for _, t in slices for k, v in contents(t)[0].items()} == want[0]
    assert contents(D.Trie.merged([t for _, t in slices])) == want
    for r, t in slices:
        first = [int.from_bytes(w.encode()[:8].ljust(8, b"\0"), "big") for w in t.terms(np.unique(t.counts[0]))]
        assert all((r == 0 or x >= borders[r - 1]) and (r == 3 or x < borders[r]) for x in first)


def test_shares_are_exact():
    for count, total in ((0, 1), (5, 5), (7, 3_000_000_000_000), (2_999_999_999_999, 3_000_000_000_001), (10**12, 9 * 10**15)):
        assert D.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * count // total


def fixture():
    rnd = random.Random(7)
    vocabulary = [f"{a}{b}" for a in ("alpha", "beta", "Gamma", "été", "日", "longword" * 3) for b in ("", "x", "yy", "zzz")]
    rows = []
    for i in range(500):
        lang = rnd.choice(["en", "en", "en", "de", None, "xx"] if i % 50 else ["rare"])
        source = rnd.choice(["a", "a", "a", "b", "c", None, "ü"])
        text = None if i % 41 == 0 else " ".join(rnd.choice(vocabulary[: rnd.choice([5, 24])]) for _ in range(rnd.randint(0, 12)))
        rows.append((i, text, lang, source))
    return [*rows, *rows[:20], (900, "only here", "lonely", "s")]


def audit(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    return sorted(con.sql(D.DIVERGENCE_SQL).select("lang, source, part, item, value, rank").fetchall())


def test_audit_equals_sql(spark):
    df = spark.createDataFrame(fixture(), "doc_id long, text string, lang string, source string").selectExpr("*", "1 as range", "2 as n", "'x' as part").repartition(5)
    got = sorted(map(tuple, D.divergence(df).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == audit(fixture())
    assert {r[0] for r in got} == {"", "en", "de", "xx", "rare"}  # one group alone has nothing to be compared with
    assert all(r[4] == 0 for r in got if r[0] == "rare")
    assert D.divergence(df.where("false")).count() == 0


def test_ties_are_in_order_of_bytes(spark):
    rows = [(i, "Zed apple ähre zed Apple", "en", "a") for i in range(40)] + [(100 + i, "other", "en", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = [(r.item, r.rank) for r in D.divergence(df).where("part = 'term' and source = 'a'").orderBy("rank").collect()]
    assert got == [("apple", 1), ("zed", 2), ("ähre", 3)]


@pytest.mark.parametrize("tile", [1, 2, 512])
def test_sources_are_compared_in_tiles(monkeypatch, tile):
    monkeypatch.setattr(D, "SOURCES", tile)
    rng = np.random.default_rng(6)
    names, terms = [f"s{i}" for i in range(5)], [f"t{i:02}" for i in range(30)]
    n = rng.integers(0, 9, (30, 5))
    term, source = np.nonzero(n)
    row = {"lang": "en", "terms": terms, "sources": names, "term": term.astype("<i4").tobytes(), "source": source.astype("<i4").tobytes(), "n": n[term, source].astype("<i8").tobytes()}
    row |= {"names": names, "totals": n.sum(0).tolist(), "v": 30, "of_lang": int(n.sum())}
    rows = [row | {"tile": k} for k in range(-(-5 // tile))]
    got = pa.Table.from_batches(list(D._distances(50)(iter([pa.RecordBatch.from_pylist(rows)])))).to_pylist()
    p = [[1 + 10**9 * int(n[t, s] + 5) // int(n[:, s].sum() + 150) for t in range(30)] for s in range(5)]
    want = {(names[a], names[b]): sum(abs(x - y) for x, y in zip(p[a], p[b], strict=True)) for a in range(5) for b in range(5) if a != b}
    assert {(r["source"], r["item"]): r["value"] for r in got if r["part"] == "pair"} == want
