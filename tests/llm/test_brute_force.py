"""Each operator against a plain restatement of what it computes, on small fixtures."""

import collections
import hashlib
import math
import os
import random
import re
import struct
import unicodedata
import zlib

import duckdb
import numpy as np
import pytest

from tempora.llm import bpe, fingerprint, jaccard_join, langid, lm_score, mixing, quality, queries, substring_dedup, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(table):
    return {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode()


# -- toxicity -------------------------------------------------------------------------


def edits(a, b):
    """Letters put in, left out or replaced, and neighbours swapped once."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j - 1] + (x != y), rows[-1][j] + 1, row[j - 1] + 1))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def test_automaton_is_trie_times_levenshtein():
    lexicon = [("idiot", False, True), ("scum", False, True), ("lowei", True, True), ("шумно", True, True), ("abcd", True, False)]
    auto = toxicity.Automaton(lexicon)
    rnd = random.Random(4)
    words = [w for e, *_ in lexicon for w in (e, e[1:], e + "s", e[:2] + "x" + e[2:], e[:-1] + "zz", "q" + e, e[1] + e[0] + e[2:], e[:2] + e[3] + e[2] + e[4:])]
    words += ["".join(rnd.choice("idotscumlweabhшу") for _ in range(rnd.randint(1, 9))) for _ in range(3000)]

    def want(word):
        kinds = []
        for entry, stem, strong in lexicon:
            most = int(strong and len(entry) >= toxicity.FUZZY_FROM)
            forms = [word[:k] for k in range(len(word) + 1)] if stem else [word]
            d = min(edits(f, entry) for f in forms)
            if d <= most:
                kinds.append(d + 1 if strong else 3)
        return min(kinds, default=0)

    ends = np.cumsum([len(w) for w in words])
    got = auto.match(np.array([ord(c) for w in words for c in w], np.uint32), ends - [len(w) for w in words], ends)
    assert got.tolist() == [want(w) for w in words]


def test_quotation_scores_lower_than_abuse():
    import pyarrow as pa

    auto = toxicity.Automaton([("idiot", False, True)])
    x = toxicity.features(auto, pa.array(["you are an idiot and an Idiot!", 'he wrote "what an idiot" in the book', "nothing", "an idiet"]))
    assert x[0, 1] > 0 and x[1, 1] == 0 and x[1, 3] > 0 and x[0, 6] > x[3, 6] > x[1, 6] > x[2, 6] == 0


def test_letters_edits_and_quotes_by_code_point():
    import pyarrow as pa

    auto = toxicity.Automaton([("idiot", False, True)])
    hits = lambda *texts: np.rint(np.expm1(toxicity.features(auto, pa.array(texts))[:, 1:4])).astype(int).tolist()  # noqa: E731  exact, misspelled, quoted
    assert hits("idiot—go", "ïdiot", "i\u0308diot", "¡idiot!", "idoit", "idiot\u00a0x") == [[1, 0, 0], [1, 0, 0], [1, 0, 0], [1, 0, 0], [0, 1, 0], [1, 0, 0]]
    assert hits("it\"s \"fine\" you idiot, \"ok\"", "don't, idiot, don't", "", "“a” idiot “b”") == [[1, 0, 0], [1, 0, 0], [0, 0, 0], [1, 0, 0]]
    for a, b in ("“”", "„“", "«»", "»«", "‘’", "‚’", "''", '""'):
        assert hits(f"said {a}what an idiot{b} then") == [[0, 0, 1]], (a, b)


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no larger data")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95 and got[got.toxic == 0].predicted.mean() < 0.01 and got[got.toxic == 1].predicted.mean() > 0.85


def test_language_held_out(spark, table):
    got = langid.identify_language(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95


# -- counts and fingerprints ----------------------------------------------------------


def test_quality_equals_sql(spark, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(quality.QUALITY_SQL).df()
    got = quality.quality_rules(table).toPandas()[list(want.columns)]
    a, b = (x.sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    assert (a == b).all().all() and 0.5 < a.kept.mean() < 1


def test_fingerprints(spark, table):
    rows = sorted((r.doc_id, r.text) for r in table.select("doc_id", "text").collect())
    rows += [(900, "Straße ﬁn  é"), (901, "  STRASSE fin É "), (902, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def canon(x):
        y = unicodedata.normalize("NFKC", x).lower().replace("ß", "ss").replace("ς", "σ")
        return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", y)).strip(" ")

    def wide(x):
        import xxhash

        return "".join(f"{xxhash.xxh64(x.encode(), seed=xxhash.xxh64(struct.pack('<q', s), seed=42).intdigest()).intdigest():016x}" for s in fingerprint.SEEDS)

    got = {r.doc_id: r for r in fingerprint.fingerprint_pairs(df).collect()}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        e = t[: len(t) - cut] + nxt[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), wide(canon(t)), wide(canon(e)))
        assert (r.near_edited, r.near_next) == (canon(t) == canon(e), canon(t) == canon(nxt))
    assert got[900].fingerprint == got[901].fingerprint


def test_bpe_equals_the_library(texts):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    library, codec = Tokenizer.from_file(path), bpe.Codec(path)
    rnd = random.Random(5)
    odd = ["", "<|endoftext|>hi <|startoftext|>x<|", "café ΣΑΣ İx", "日本 語\x1cq", "\x85a​b　\xa0c", "ſ's 'ſ", "é Å", "ﬁ 👍🏽 ½"]
    odd += ["".join(rnd.choice("abXY '’sStT\n\t\x0b\x1c\x85 é́Σς日😀12<|endoftext|>.!‍İẞ") for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    for t in [*texts.values(), *odd]:
        want = library.encode(t, add_special_tokens=False).ids
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_caches_change_nothing(monkeypatch, texts):
    whole = bpe.Codec(bpe.default_path())
    monkeypatch.setattr(bpe, "CACHE", 50)
    small = bpe.Codec(bpe.default_path())
    for t in list(texts.values())[:60]:
        assert small.encode(t) == whole.encode(t)
        assert len(small.words) <= 51 and len(small.pieces) <= 51


# -- joins and repeats ----------------------------------------------------------------


def shingles(text):
    w = lower(text or "").split()
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def near_copies(seed=2):
    rnd = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(3000)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 5, 8, 11, 12, 20, 21, 50, 100, 150]))] for _ in range(40)]
    rows = []
    for i in range(400):
        b = list(rnd.choice(bases[:10] if rnd.random() < 0.5 else bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            k, r = rnd.randint(0, len(b)), rnd.random()
            if r < 0.4:
                b.insert(k, rnd.choice(vocabulary))
            elif r < 0.7 and len(b) > 1:
                b.pop(k % len(b))
            else:
                b[k % len(b)] = rnd.choice(vocabulary)
        rows.append((i, " ".join(b)))
    big = [rnd.choice(vocabulary) for _ in range(148)]
    far = [big[k] if k % 3 else rnd.choice(vocabulary) for k in range(148)]
    rows.append((1990, " ".join(far)))
    for i in range(320):  # stars with many rays that fail, larger than a block
        b = list(big if i % 8 else far)
        for _ in range(rnd.randint(0, 7)):
            b[rnd.randrange(148)] = rnd.choice(vocabulary)
        rows.append((2000 + i, " ".join(b)))
    return rows


def test_jaccard_components(spark):
    rows = near_copies()
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        common = collections.Counter(j for g in s for j in holders[g])
        for g in s:
            holders[g].append(i)
        for j, n in common.items():
            if 100 * n >= 90 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = sorted((d, len(s), rows[find(i)][0]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.jaccard_components(df).collect())) == want
    kept = sorted(r.doc_id for r in jaccard_join.drop_near_copies(df).collect())
    assert kept == sorted({c for _, _, c in want})


def test_signatures_lose_no_pair():
    """Any two sets at the threshold share a signature."""
    rnd = random.Random(8)
    for _ in range(300):
        n = rnd.choice([10, 12, 19, 26, 40, 90, 300])
        words = [f"v{rnd.randrange(10**9)}" for _ in range(n + 2)]
        other = list(words)
        for _ in range(rnd.randint(1, max(1, n // 50))):
            other[rnd.randrange(len(other))] = f"u{rnd.randrange(10**9)}"
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        if 100 * len(a & b) < 90 * len(a | b) or a == b:
            continue
        sigs = []
        for t in (words, other):
            raw = " ".join(t).encode()
            sigs.append({int(x) for _, s in jaccard_join.Sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).signatures() for x in s})
        assert sigs[0] & sigs[1]


def repeated_bytes(rows, size=400):
    count = collections.Counter(x[i : i + size] for _, x in rows for i in range(len(x) - size + 1))
    out = []
    for d, x in rows:
        g = np.zeros(len(x) + 1, int)
        for i in range(len(x) - size + 1):
            if count[x[i : i + size]] > 1:
                g[i] += 1
                g[i + size] -= 1
        m = np.cumsum(g)[: len(x)] > 0
        spans = int(m[:1].sum()) + int((m[1:] & ~m[:-1]).sum())
        out.append((d, len(x), int(m.sum()), spans, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~m])).hexdigest()))
    return sorted(out)


def passages_of_bytes():
    rnd = random.Random(1)
    base = [bytes(rnd.choice(b"abcdefgh ") for _ in range(3000)) for _ in range(6)]
    rows = []
    for i in range(150):
        k, a, n = rnd.random(), rnd.randint(0, 2400), rnd.choice([390, 399, 400, 401, 420, 500, 527, 600])
        pad = [bytes(rnd.choice(b"xyz ") for _ in range(rnd.randint(0, 150))) for _ in range(2)]
        x = pad[0] + rnd.choice(base)[a : a + n] + pad[1]
        x = x + x if k < 0.1 else b"ab" * rnd.randint(0, 800) if 0.93 < k < 0.98 else b"" if k > 0.98 else x
        rows.append((i if rnd.random() > 0.03 else 5, x.decode()))
    return [*rows, (901, rows[3][1]), (901, rows[3][1])]


def test_suffix_dedup(spark, table):
    rows = passages_of_bytes()
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), table):
        want = repeated_bytes([(r.doc_id, r.text.encode()) for r in df.collect()])
        assert sorted(map(tuple, suffix_dedup.repeated_bytes(df).collect())) == want
        short = repeated_bytes([(r.doc_id, r.text.encode()) for r in df.collect()], 240)
        both = [tuple(r) for r in suffix_dedup.repeated_bytes(df, also=240).collect()]
        assert sorted(r[:5] for r in both) == want and sorted((r[0], r[1], r[5]) for r in both) == sorted(r[:3] for r in short)
        assert sum(w[2] for w in want) > 0


def test_loser_tree_merges_with_common_prefixes():
    rnd = random.Random(1)
    for trial in range(150):
        runs, every = [], []
        for _ in range(rnd.randint(1, 6)):
            xs = sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 150 if trial % 2 else 6))) for _ in range(rnd.randint(0, 12)))
            lcp, tails = suffix_dedup.front_code(xs)
            runs.append(suffix_dedup.Run(lcp, np.array([len(t) for t in tails], int), b"".join(tails)))
            every += xs
        got = list(suffix_dedup.merge(runs))
        assert [g[3] for g in got] == sorted(every)
        prev = b""
        for h, _, _, x in got:
            assert h == len(os.path.commonprefix([prev, x]))
            prev = x


def test_substring_dedup(spark, table):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(vocabulary) for _ in range(300)] for _ in range(5)]
    rows = []
    for i in range(200):
        k, a, n = rnd.random(), rnd.randint(0, 250), rnd.choice([18, 19, 20, 21, 25, 33, 34, 40, 50])
        x = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))] + rnd.choice(base)[a : a + n] + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))]
        x = x + x if k < 0.1 else ["é", "b"] * rnd.randint(0, 200) if 0.93 < k < 0.98 else [] if k > 0.98 else x
        rows.append((i, ("\n" if k < 0.5 else " ").join(x)))
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), table):
        words = [(r.doc_id, r.text.encode().split()) for r in df.collect()]
        first = {}
        for d, w in words:
            for i in range(len(w) - 19):
                key = b" ".join(w[i : i + 20])
                first[key] = min(first.get(key, (d, i)), (d, i))
        want = []
        for d, w in words:
            gone = set()
            for i in range(len(w) - 19):
                if first[b" ".join(w[i : i + 20])] < (d, i):
                    gone.update(range(i, i + 20))
            want.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
        assert sorted(map(tuple, substring_dedup.repeated_words(df).collect())) == sorted(want)


@pytest.mark.parametrize("symbols", [2, 3, 6])
def test_matching_statistics_of_texts_that_the_index_lacks(symbols):
    rnd = random.Random(6)
    some = lambda n, k: [[rnd.randint(1, k) for _ in range(rnd.randint(5, 14))] for _ in range(n)]
    flat = lambda ts: (np.array([x for t in ts for x in t]), np.cumsum([0] + [len(t) for t in ts]))
    held, others = some(30, symbols), some(40, symbols + 1)  # a symbol that is not in the index
    text, bounds = flat(held)
    place = np.full(len(text) + len(held), 10**9)
    inside = np.ones(len(place), bool)
    inside[bounds[1:] + np.arange(len(held))] = False
    place[inside] = rnd.sample(range(len(text)), len(text))
    at = np.flatnonzero(inside)
    occurs = collections.defaultdict(list)
    for k, t in enumerate(held):
        for i in range(len(t)):
            for j in range(i + 1, min(len(t), i + 5) + 1):
                occurs[tuple(t[i:j])].append(int(place[at[bounds[k] + i]]))
    stat, first = substring_dedup.FMIndex(text, bounds, 5).statistics(*flat(others), place)
    ends = flat(others)[1]
    for k, t in enumerate(others):
        for i in range(len(t)):
            longest = max((j for j in range(1, 6) if i + j <= len(t) and tuple(t[i : i + j]) in occurs), default=0)
            assert stat[ends[k] + i] == longest
            assert first[ends[k] + i] == (min(occurs[tuple(t[i : i + 5])]) if longest == 5 else -1)


def test_windows_are_found_by_the_search_alone(monkeypatch):
    """Passages of one context in one shard: what the search doesn't match isn't reported."""
    rnd = random.Random(3)
    texts = [[rnd.randint(1, 2) for _ in range(rnd.randint(20, 24))] for _ in range(30)]
    texts += [t[2:] + [3] * 3 for t in texts[::3]] + [[4, *t] for t in texts[1::4]]
    flat, cut = np.array([x for t in texts for x in t]), np.cumsum([0] + [len(t) for t in texts])
    context, seen, want = np.zeros(len(texts), np.int64), set(), np.zeros(len(flat), bool)
    for k, t in enumerate(texts):
        for i in range(len(t) - 19):
            want[cut[k] + i] = tuple(t[i : i + 20]) in seen
        seen |= {tuple(t[i : i + 20]) for i in range(len(t) - 19)}
    run = lambda: substring_dedup._earlier(flat, cut, np.arange(len(flat)), context, np.arange(len(texts)))
    assert want.any() and (run() == want).all()
    monkeypatch.setattr(substring_dedup.FMIndex, "step", lambda self, symbol, lo, hi: (self.first[symbol], self.first[symbol + 1]))
    assert (run() != want).any()


@pytest.mark.parametrize("name", ["op4_jaccard_join", "op9_suffix_dedup", "op10_substring_dedup"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
    a, b = (x.sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) and (a == b).all().all()


# -- models ---------------------------------------------------------------------------


def test_base_scores_and_held_out_gain(spark, table, texts):
    counts, tokens = collections.Counter(), {d: [*lower(t).split(), None] for d, t in texts.items()}
    for d, w in tokens.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm_score.score_texts(table).collect()}
    for d, w in tokens.items():
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w)
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(counts[t] > 0 for t in w), n, zlib.crc32(str(d).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base) and r.score < 0
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_scores_do_not_depend_on_partitions(spark, table):
    scores = []
    for n in (1, 7):
        rows = lm_score.score_texts(table.repartition(n)).select("doc_id", "score").collect()
        scores.append({r.doc_id: r.score for r in rows})
    assert all(scores[1][d] == pytest.approx(x, rel=1e-6) for d, x in scores[0].items())


def test_symbol_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    net = lm_score.LogBilinear(rng.dirichlet(np.ones(lm_score.SYMBOLS)))
    every = np.arange(lm_score.SYMBOLS)
    for one, two in ((3, 7), (lm_score.START, lm_score.START)):
        assert (10 ** net.log10(every, np.full_like(every, one), np.full_like(every, two))).sum() == pytest.approx(1, abs=1e-4)


def test_mixing_meets_targets(spark, table):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = mixing.mixing_rates(table, mixing.label_domains(labels), mixing.TARGETS, "good").toPandas()
    total = {d: (got.n_tokens * got.rate * got[f"p_{d}"]).sum() for d in mixing.TARGETS}
    for d, w in mixing.TARGETS.items():
        assert total[d] / sum(total.values()) == pytest.approx(w, rel=0.02)
    assert all(abs(x) < 0.01 for x in mixing.misfits(spark.createDataFrame(got), mixing.TARGETS, "good").values())
    assert (got.rate >= 0).all() and abs(got.copies.mean() - got.rate.mean()) < 0.1
    p, pulls = np.random.default_rng(0).dirichlet(np.ones(3), 50), [np.array([0.4, -0.2, 0.1]), np.array([0.05, 0.3, -2.0])]
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(p)], "k int, p array<double>")
    column = [r.r for r in df.select("k", mixing._rate_column(3, pulls).alias("r")).orderBy("k").collect()]
    assert np.allclose(column, mixing.rates(p, pulls))
