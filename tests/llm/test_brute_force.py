"""Each corpus operator against a plain version on small tables."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plain import plain_pairs
from rowloom.llm.common import Table, frequent, to_shards
from rowloom.llm import exact, hmm, html, jaccard, mixing, packing, pfp, pii, quality, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, shard string, score string, k0 string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z", "w") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    """Random texts with copies, near copies, shared passages, NULLs, blanks, ties and a long text."""
    rng = random.Random(5)
    vocab = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha") for b in ("l", "m", "nt", "r", "s", "x", "zz")]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    passage, other = say(70), say(55)
    rows = []
    for i in range(60):
        rows.append((i, say(rng.randint(5, 160)), "ab"[i % 2]))
    for i in range(60, 70):
        rows.append((i, f"{say(20)} {passage} {say(30)}", "c"))
    rows.append((70, f"{other} {say(3)} {other}", "c"))
    rows.append((71, other, "c"))
    base = say(90)
    for i in range(72, 80):
        words = base.split()
        words[i - 72] = "changed"
        rows.append((i, " ".join(words), "a"))
    rows += [(80, base, "a"), (81, base, "a"), (82, "", "a"), (83, None, "b"), (84, "  \n ", None), (85, "x", "a"), (86, "x", "a"), (87, say(6000), "d"), (88, " ".join(["same"] * 130), "a"), (89, " ".join(["same"] * 120), "b")]
    return rows


# ---------------------------------------------------------------- 1
def plain_forward(codes, m):
    a, ll = m.start, 0.0
    for t, c in enumerate(codes):
        a = (a if t == 0 else a @ m.move) * m.emit[c]
        ll += math.log(a.sum())
        a = a / a.sum()
    return ll


def plain_counts(codes, m):
    """Expected counts by enumerating all paths."""
    k = len(m.start)
    emits, moves, starts, total = np.zeros_like(m.emit), np.zeros((k, k)), np.zeros(k), 0.0
    for path in itertools.product(range(k), repeat=len(codes)):
        p = m.start[path[0]] * m.emit[codes[0], path[0]]
        for t in range(1, len(codes)):
            p *= m.move[path[t - 1], path[t]] * m.emit[codes[t], path[t]]
        total += p
        starts[path[0]] += p
        for t, s in enumerate(path):
            emits[codes[t], s] += p
            if t:
                moves[path[t - 1], s] += p
    return emits / total, moves / total, starts / total


def test_hmm_recursions():
    rng = np.random.default_rng(1)
    m = hmm.Model(rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 8, 3).T, [])
    sizes = np.array([3, 0, 1, 700, 64, 65, 128])
    codes = rng.integers(0, 8, sizes.sum())
    off = np.concatenate(([0], np.cumsum(sizes)))
    want = [plain_forward(codes[a:b], m) for a, b in itertools.pairwise(off)]
    np.testing.assert_allclose(hmm.log_likelihood(codes, sizes, m), want, rtol=1e-9)
    short = np.array([4, 1, 6])
    codes = rng.integers(0, 8, short.sum())
    parts = [plain_counts(codes[a:b].tolist(), m) for a, b in itertools.pairwise([0, 4, 5, 11])]
    e, a, s, _ = hmm.expectations(codes, short, m)
    for got, i in ((e, 0), (a, 1), (s, 2)):
        np.testing.assert_allclose(got, sum(p[i] for p in parts), atol=1e-9)


def test_hmm_blocks_agree(monkeypatch):
    rng = np.random.default_rng(2)
    m = hmm.Model(rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 8, 3).T, [])
    sizes = np.array([50, 7, 300])
    codes = rng.integers(0, 8, sizes.sum())
    one = hmm.expectations(codes, sizes, m)
    monkeypatch.setattr(hmm, "BLOCK", 5)
    for x, y in zip(one, hmm.expectations(codes, sizes, m)):
        np.testing.assert_allclose(x, y, rtol=1e-8, atol=1e-9)


def test_hmm_query(spark, corpus):
    df = docs_of(spark, corpus)
    encoded = hmm.encode(df, "doc_id", "text")
    model = hmm.train(encoded, states=3, rounds=4, bits=8)
    ll = model.log_likelihood
    assert all(b >= a - 1e-6 * abs(a) for a, b in itertools.pairwise(ll))
    got = {r["doc_id"]: r for r in hmm.score(encoded, model).collect()}
    blobs = {r["id"]: np.frombuffer(r["codes"], np.uint32) >> np.uint32(24) for r in encoded.collect()}
    assert len(got) == len(corpus)
    for i, codes in blobs.items():
        assert got[i]["log_likelihood"] == pytest.approx(plain_forward(codes, model), rel=1e-8)
    assert got[83]["log_likelihood"] == 0 and got[83]["perplexity"] is None and got[87]["n_words"] == 6000
    assert hmm.lm_score(df, bits=6).count() == len(corpus)
    assert hmm.lm_score(df.limit(0), bits=6).count() == 0


def test_hmm_every_word_is_a_symbol(spark, corpus, monkeypatch):
    monkeypatch.setattr(hmm, "CHUNK", 500)
    rare = " ".join(f"once{i}" for i in range(3000))  # far more words than the folded model has symbols for
    rows = [*corpus, (None, "x bal x", "a"), (90, rare, "a")]
    df = docs_of(spark, rows).repartition(3)
    parts = Table(hmm.encode_parts(df, "doc_id", "text")).df
    assert parts.count() == 3
    model = hmm.train_words(parts, states=3, rounds=3, tolerance=-1.0)
    vocab = sorted({w for _, t, _ in rows for w in (t or "").lower().split()})
    assert model.n_symbols == len(vocab)
    # the same rounds on one dense table
    key = np.array([xxhash.xxh3_64_intdigest(w) for w in vocab], np.uint64)
    at = {w: i for i, w in enumerate(vocab)}
    texts = [[at[w] for w in (t or "").lower().split()] for _, t, _ in rows]
    codes, sizes = np.array([c for t in texts for c in t]), np.array([len(t) for t in texts])
    emit = hmm._shake(key, np.bincount(codes, minlength=len(vocab)).astype(float)[:, None], 3)
    m = hmm.Model(np.full(3, 1 / 3), np.full((3, 3), 0.5 / 3) + 0.5 * np.eye(3), emit / emit.sum(0), [])
    for _ in range(3):
        e, a, s, ll = hmm.expectations(codes, sizes, m)
        m = hmm.maximise(e, a, s, [*m.log_likelihood, ll])
    np.testing.assert_allclose(model.log_likelihood, m.log_likelihood, rtol=1e-5)
    np.testing.assert_allclose(model.move, m.move, rtol=1e-3)
    got = {r["doc_id"]: r for r in hmm.score_words(parts, model).collect()}
    assert len(got) == len(rows)
    for (i, _, _), t in zip(rows, texts):
        assert got[i]["n_words"] == len(t)
        assert got[i]["log_likelihood"] == pytest.approx(plain_forward(t, m), rel=1e-4)
    assert got[83]["log_likelihood"] == 0 and got[83]["perplexity"] is None
    # the query itself gives words that occur once the probability of such words
    whole = {r["doc_id"]: r["perplexity"] for r in hmm.lm_score(df, states=3, rounds=3).collect()}
    assert whole[90] == pytest.approx(got[90]["perplexity"], rel=1e-3)
    assert hmm.lm_score(df.limit(0)).count() == 0 and hmm.lm_score(df.where("doc_id in (82, 83)")).count() == 2


# ---------------------------------------------------------------- 2
def plain_passages(rows, m):
    """Spans of which every m words occur in another document."""
    where = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - m + 1):
            where.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = set()
    for i, t in rows:
        w = (t or "").split()
        hit = [len(where[tuple(w[k : k + m])]) > 1 for k in range(len(w) - m + 1)]
        cover = [any(hit[max(0, k - m + 1) : k + 1]) for k in range(len(w))]
        k = 0
        while k < len(w):
            if cover[k]:
                e = k
                while e < len(w) and cover[e]:
                    e += 1
                out.add((i, k, e - k))
                k = e
            else:
                k += 1
    return out


@pytest.mark.parametrize("m", [6, 20, 50])
def test_passages(spark, corpus, m):
    got = {tuple(r) for r in pfp.repeated_passages(docs_of(spark, corpus), m).collect()}
    assert got == plain_passages([(i, t) for i, t, _ in corpus], m)
    assert m != 50 or {61, 71, 80, 88} <= {x[0] for x in got}


def test_corpus_order_is_lexicographic():
    rng = np.random.default_rng(3)
    for p in (2, 3, 6):
        windows = [rng.integers(0, 3, rng.integers(8, 60)).astype(np.uint32) for _ in range(40)]
        cut = np.concatenate(([0], np.cumsum([len(x) for x in windows])))
        text = np.concatenate(windows)
        where = np.concatenate([np.arange(a, b - 5) for a, b in itertools.pairwise(cut.tolist())])
        order = pfp.corpus_order(text, cut, where, 60, 2, p)
        end = dict(zip(range(len(text)), np.repeat(cut[1:], np.diff(cut)).tolist()))
        suffixes = [text[i : end[i]].tolist() for i in where[order].tolist()]
        assert suffixes == sorted(suffixes)


def test_passages_edges(spark):
    df = docs_of(spark, [(1, None, "a"), (None, "a b c", "a"), (2, "", "a")])
    assert pfp.repeated_passages(df).count() == 0
    assert pfp.repeated_passages(df.limit(0)).count() == 0
    twice = docs_of(spark, [(1, "a b c d e f g h", "a"), (1, "a b c d e f g h", "a")])
    assert pfp.repeated_passages(twice, 6).count() == 0


# ---------------------------------------------------------------- 3
def clashing(df):
    """More columns, named as operators might name theirs."""
    return df.withColumns({c: F.lit(77) for c in ("__n", "__rate", "__copies", "__k", "__s", "__g", "__b", "__score", "__gone", "n_copies", "content_hash", "n", "s", "g", "rate", "copies", "nth", "c0", "c1", "a.b")})


def test_mixing(spark, corpus):
    df = clashing(docs_of(spark, corpus))
    rows = mixing.balance(df, weights={"a": 0.5, "b": 0.3, "c": 0.2}).collect()
    n = {s: sum(r["n_tokens"] * r["rate"] for r in rows if r["source"] == s) for s in "abcd"}
    total = sum(n.values())
    assert [round(n[s] / total, 4) for s in "abcd"] == [0.5, 0.3, 0.2, 0.0]
    for r in rows:
        assert r["copies"] in (math.floor(r["rate"]), math.ceil(r["rate"]))
    kept = mixing.repeat_documents(df, floor=1.0)
    assert kept.schema == df.schema
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, _ in corpus} and kept.where("__n <> 77 or n <> 77").count() == 0
    assert mixing.balance(df.limit(0)).count() == 0 and mixing.repeat_documents(df.limit(0), floor=1.0).count() == 0
    assert {r["rate"] for r in mixing.balance(docs_of(spark, [(1, None, "a"), (2, " ", None)])).collect()} == {1.0}
    with pytest.raises(ValueError):
        mixing.balance(df, weights={"nowhere": 1.0})


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_mixing_is_the_entropy_minimum(spark, floor):
    """Against the constraints and the optimality conditions: no feasible direction lowers the objective."""
    rng = np.random.default_rng(12)
    rows = [(i, "w\u3000" * int(rng.integers(1, 60)) + "end", str(rng.choice(["en", "de", "fr"], p=[0.7, 0.2, 0.1])), str(rng.choice(["p", "q", "r"], p=[0.6, 0.3, 0.1]))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = {"p": 0.4, "q": 0.35, "r": 0.25}
    got = {r["doc_id"]: r for r in mixing.balance(df, weights=weights, floor=floor).collect()}
    n = np.array([len(t.split()) for _, t, _, _ in rows], float)
    assert [got[i]["n_tokens"] for i in range(120)] == n.tolist()
    r = np.array([got[i]["rate"] for i in range(120)])
    src, lang = (np.array([x[k] for x in rows]) for k in (3, 2))
    total = float(n @ r)
    raised = {g: n[lang == g].sum() ** mixing.TEMPERATURE for g in ("en", "de", "fr")}
    for s, w in weights.items():
        assert (n * r)[src == s].sum() / total == pytest.approx(w, abs=1e-5)
    for g, w in raised.items():
        assert (n * r)[lang == g].sum() / total == pytest.approx(w / sum(raised.values()), abs=1e-5)
    x = np.log(n) - n @ np.log(n) / n.sum()
    mean = {s: (n * x)[src == s].sum() / n[src == s].sum() for s in weights}
    assert (n * r) @ x / total == pytest.approx(sum(w * mean[s] for s, w in weights.items()), abs=1e-5)
    assert r.min() >= floor - 1e-12
    # log r lies in the span of the constraints where the floor does not hold it, and above that span's value where it does
    z = np.stack([*[(src == s).astype(float) for s in weights], *[(lang == g).astype(float) for g in ("en", "de")], x], 1)
    free = r > floor + 1e-9
    lam = np.linalg.lstsq(z[free], np.log(r[free]), rcond=None)[0]
    np.testing.assert_allclose(z[free] @ lam, np.log(r[free]), atol=1e-6)
    if floor:
        assert (~free).any() and (z[~free] @ lam <= 1e-6).all()


def test_mixing_leaves_languages_that_sources_exclude(spark):
    rows = [(i, "w " * 10, "en" if i < 50 else "de", "p" if i < 50 else "q") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    n = {}
    for r in mixing.balance(df, weights={"p": 0.5, "q": 0.5}).collect():
        n[r["source"]] = n.get(r["source"], 0) + r["rate"] * r["n_tokens"]
    assert n["p"] == pytest.approx(n["q"], rel=1e-4)


# ---------------------------------------------------------------- 4
def plain_classes(rows, n, t):
    """(id, class, links) of each row by all pairs of rows."""
    rows = [(i, x) for i, x in rows if i is not None]
    pairs = plain_pairs([(k, x) for k, (_, x) in enumerate(rows)], n, t)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        return k if parent[k] == k else find(parent[k])

    for a, b, _, _ in pairs:
        links[a] += 1
        links[b] += 1
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, least[find(k)], links[k]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("t", "hot", "nodes"), [(0.5, 64, 1 << 15), (0.5, 3, 2), (0.3, 3, 1 << 15), (1.0, 3, 1 << 15)])
def test_jaccard(spark, corpus, monkeypatch, t, hot, nodes):
    monkeypatch.setattr(jaccard, "HOT_NODES", nodes)
    df = docs_of(spark, corpus)
    texts = [(i, x) for i, x, _ in corpus]
    assert sorted(map(tuple, jaccard.jaccard_classes(df, t=t, hot=hot, tile=4).collect())) == plain_classes(texts, 3, t)
    if t != 0.5:
        return
    # pairs between the smallest ids of equal sets, which are all pairs once copies are put back
    first, copies = {}, {}
    for i, x in texts:
        w = (x or "").lower().split()
        key = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) or tuple(w) or i
        copies.setdefault(first.setdefault(key, i), []).append(i)
    got = {(r["doc_a"], r["doc_b"], r["common"], r["total"]) for r in jaccard.jaccard_pairs(df, t=t, hot=hot, tile=4).collect()}
    assert got == {p for p in plain_pairs(texts, 3, t) if p[0] in copies and p[1] in copies}


def test_jaccard_edges(spark, corpus):
    rows = [*corpus, (None, "x", "a"), (85, "x", "a"), (85, corpus[0][1], "a")]
    df = docs_of(spark, rows).withColumns({c: F.lit(7) for c in ("rep", "node", "text_", "class_id", "__gone", "a.b", "k2")})
    kept = jaccard.drop_near_duplicates(df)
    assert kept.schema == df.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert {82, 83, 84, 85, 72} <= set(ids) and not {73, 80, 81, 86} & set(ids) and None in ids and ids.count(85) == 2
    assert sorted(map(tuple, jaccard.jaccard_classes(df).collect())) == plain_classes([(i, x) for i, x, _ in rows], 3, 0.5)
    empty = df.limit(0)
    assert jaccard.jaccard_pairs(empty).count() == 0 and jaccard.jaccard_classes(empty).count() == 0 and jaccard.drop_near_duplicates(empty).count() == 0
    with pytest.raises(ValueError):
        jaccard.jaccard_classes(df, t=0.1)


def test_frequent_counts_beyond_a_byte(spark):
    keys = np.repeat(np.arange(5, dtype=np.uint64) << np.uint64(44), [1, 2, 300, 70_000, 0])
    rows = [(s, bytearray(p)) for s, p in to_shards(keys, 8)]
    got = frequent(spark.createDataFrame(rows, "shard int, payload binary"), [2], 8, rare=(300, 70_000))
    at = np.arange(5, dtype=np.uint64) << np.uint64(44)
    assert [got.has(i, at).tolist() for i in range(3)] == [[False, True, True, True, False], [False, False, True, True, False], [False, False, False, True, False]]


# ---------------------------------------------------------------- 5
def plain_topk(docs, queries, k):
    bags = [(i, (t or "").lower().split()) for i, t in docs]
    n, average = len(bags), sum(len(w) for _, w in bags) / len(bags)
    out = {}
    for q, text in queries:
        words = set((text or "").lower().split())
        score = {}
        for w in words:
            df = sum(w in b for _, b in bags)
            for i, b in bags:
                if tf := b.count(w):
                    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                    score[i] = score.get(i, 0) + math.floor(idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(b) / average))) * 1_000_000 + 0.5)
        out[q] = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
    return {(q, i, s, r) for q, found in out.items() for r, (i, s) in enumerate(found, 1)}


@pytest.mark.parametrize("k", [1, 3, 200])
def test_topk(spark, corpus, monkeypatch, k):
    monkeypatch.setattr(topk, "STRETCH", 2)
    queries = [(1, "bal cent"), (2, corpus[3][1]), (3, "nowhere"), (4, None), (5, "same X x")]
    df, q = docs_of(spark, corpus), spark.createDataFrame(queries, "item_id long, text string")
    want = plain_topk([(i, t) for i, t, _ in corpus], queries, k)
    assert {tuple(r) for r in topk.top_k(df, q, k).collect()} == want
    if k == 3:  # rows that repeat an id are one query, also where queries take several passes
        monkeypatch.setattr(topk, "PASS_WORDS", 2)
        more = spark.createDataFrame([(1, "bal"), (5, "same"), (2, corpus[3][1]), (3, "nowhere"), (1, "cent"), (5, "X x x")], "item_id long, text string")
        assert {tuple(r) for r in topk.top_k(df, more, k).collect()} == want
    assert topk.top_k(df.limit(0), q, k).count() == 0 and topk.top_k(df, q.limit(0), k).count() == 0


def test_nra_stops_early():
    rng = np.random.default_rng(4)
    lists = []
    for _ in range(3):
        impact = np.sort((rng.pareto(1, 20_000) * 1000).astype(np.int64) + 1)[::-1]
        lists.append((rng.permutation(20_000), impact))
    total = np.zeros(20_000, np.int64)
    for d, i in lists:
        total[d] += i
    at, score, read = topk.nra(lists, 20_000, 5)
    assert score.tolist() == np.sort(total)[::-1][:5].tolist() and read < 60_000
    assert total[at].tolist() == score.tolist()


# ---------------------------------------------------------------- 6
def test_pii(spark):
    long_secret = "a1B2" * 150
    rows = [(1, "card 4111 1111 1111 1111 and card 4111 1111 1111 1112", "a"), (2, "IBAN DE89 3704 0044 0532 0130 00 now, account GB83 WEST 1234 5698 7654 32", "a"), (3, "write to a.b@c.org", "a"), (4, None, "a"), (5, "", "a"), (6, "x " * 50_000 + "a.b@c.org", "a"), (None, "a.b@c.org", "a"), (7, "the order 4111111111111112 is clean", "a"), (8, f"token={long_secret}", "a"), (9, "x@a.b.c.d.e.f.g.h.i.j.k.l.museum", "a")]
    df = clashing(docs_of(spark, rows))
    got = [(r["doc_id"], r["kind"], r["value"]) for r in pii.find_pii(df).collect()]
    want = [(1, "credit_card", "4111 1111 1111 1111"), (2, "iban", "DE89 3704 0044 0532 0130 00"), (3, "email", "a.b@c.org"), (6, "email", "a.b@c.org"), (None, "email", "a.b@c.org"), (8, "secret", long_secret), (9, "email", "x@a.b.c.d.e.f.g.h.i.j.k.l.museum")]
    assert sorted(got, key=str) == sorted(want, key=str)
    for r in pii.find_pii(df).where("doc_id is not null").collect():
        assert dict((i, t) for i, t, _ in rows)[r["doc_id"]][r["start"] : r["end"]] == r["value"]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.mod97("GB82 WEST 1234 5698 7654 32")
    assert pii.find_pii(df.limit(0)).count() == 0


def plain_luhn(digits):
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(odd) + sum(d * 2 - 9 * (d > 4) for d in even)) % 10 == 0


def plain_mod97(text):
    rest = 0
    for c in text[4:] + text[:4]:
        v = ord(c) - 48 if c.isdigit() else ord(c) - 55
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def plain_findings(words):
    """Cards, IBANs, addresses and hosts among words that are split by single spaces, read character by character."""
    out, at = [], 0
    for w in words:
        if w.isdigit() and 13 <= len(w) <= 19 and w[0] in "23456" and plain_luhn([int(c) for c in w]) and len(set(w)) > 1:
            out.append(("credit_card", at, w))
        elif len(w) > 14 and w[:2].isalpha() and w[2:4].isdigit() and plain_mod97(w):
            out.append(("iban", at, w))
        elif w.count("@") == 1:
            user, host = w.split("@")
            parts = host.split(".")
            if user and len(parts) > 1 and all(parts) and parts[-1].isalpha() and len(parts[-1]) > 1:
                out.append(("email", at, w))
        elif w.count(".") == 3 and all(p.isdigit() and p == str(int(p)) and int(p) < 256 for p in w.split(".")):
            out.append(("ip", at, w))
        at += len(w) + 1
    return out


def test_pii_against_a_plain_scanner(spark):
    rng = random.Random(14)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))

    def iban():
        body = digits(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        return f"DE{(check + rng.choice([0, 0, 1])) % 100:02d}{body}"

    def word():
        return rng.choice([lambda: rng.choice("3456") + digits(rng.randint(12, 15)), iban, lambda: f"u{digits(2)}@h{digits(1)}.{rng.choice(['org', 'x', 'co.uk'])}", lambda: f"{rng.randint(0, 300)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 255)}", lambda: rng.choice(["plain", "words", "between"])])()

    texts = [[word() for _ in range(40)] for _ in range(60)]
    df = docs_of(spark, [(i, " ".join(t), "a") for i, t in enumerate(texts)])
    got = {(r["doc_id"], r["kind"], r["start"], r["value"]) for r in pii.find_pii(df).where("kind in ('credit_card', 'iban', 'email', 'ip')").collect()}
    assert got == {(i, *f) for i, t in enumerate(texts) for f in plain_findings(t)}


# ---------------------------------------------------------------- 7
def test_html(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    menu, footer = say(30), say(20)
    body = {i: say(rng.randint(5, 80)) for i in range(12)}
    rows = [(i, f"https://H{i % 2}.org/{i}", f"<html><head><title>t</title></head><script>x<y</script><nav>{menu}</nav><!-- c --><p>{body[i]}</p><div>{footer}</div></html>") for i in range(12)]
    rows += [(12, "http://other.org/", f"<p>{menu}</p>"), (13, None, None), (14, "", ""), (15, "https://h0.org/copy", rows[0][2]), (None, "https://h0.org/z", f"<p>{menu}</p>"), (16, "http://x.org", "<p>a &amp; b<!-- open")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(1), "text": F.lit("t"), "bucket": F.lit(2)})
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    m = html.MIN_TOKENS
    pages = {i: (html.host_of(u), html.tokens_of(h)) for i, u, h in rows}
    for i, (host, tok) in pages.items():
        cover = [False] * len(tok)
        others = [t for j, (h, t) in pages.items() if h == host and j is not None and t != tok] if i is not None else []
        grams = {tuple(t[k : k + m]) for t in others for k in range(len(t) - m + 1)}
        for k in range(len(tok) - m + 1):
            if tuple(tok[k : k + m]) in grams:
                cover[k : k + m] = [True] * m
        assert got[i]["text"].split() == [t for t, c in zip(tok, cover) if not c], i
        assert (got[i]["n_tokens"], got[i]["n_boilerplate"]) == (len(tok), sum(cover))
    assert len(got) == len(rows) and got[16]["text"] == "a & b"
    assert html.extract(df.limit(0)).count() == 0


def test_html_markup():
    for page, want in [
        ("<html><head><title>t</title><body><p>the page text</p></body></html>", "the page text"),
        ("<head><title>t</title><meta charset=utf-8><p>a", "a"),
        ("x<svg><p title='a>b'>c</p>", "x c"),
        ("x<title>y", "x y"),
        ("a<script>var x = '<p>';</script>b<style>c", "a b"),
        ("a<b title=\"1>2\" id=x'y>c</b>", "ac"),
        ("<svg>" * 20_000 + "z", "z"),
        ("<a '" * 20_000 + ">z", "z"),
    ]:
        assert html.tokens_of(page) == want.split(), page[:60]


def test_html_short_blocks(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    phrase = "at the end of the day"  # six words that articles share inside their own sentences
    rows, own = [], {}
    for i in range(24):
        h, n = i % 8, 4 + i % 8  # host h has a menu, an ad and a footer of 4 to 11 tokens on three pages
        menu, foot = [f"m{h}{k}" for k in range(n)], " ".join(f"f{h}{k}" for k in range(n))
        body = [f"{say(9)} {phrase} {say(3 + i % 5)}", say(2), say(30)]
        own[i] = " ".join(body).split()
        rows.append((i, f"http://h{h}.org/{i}", f"<nav><ul>{''.join(f'<li>{x}</li>' for x in menu)}</ul></nav>" + "".join(f"<p>{b}</p>" for b in body) + f"<footer>{foot}\n<b>end</b></footer>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    for i, tok in own.items():
        assert got[i]["text"].split() == tok, i
        assert got[i]["n_boilerplate"] == got[i]["n_tokens"] - len(tok)
    odd = "<p>a &amp b&#0;\0c<!-- x --><a\nhref='<p>'>d\n e</a></p>&lt;f&gt;<td>g</td>h<script>i"
    for page in [odd, *(r[2] for r in rows)]:
        assert [t for b in html.blocks_of(page) for t in b] == html.tokens_of(page)
    # the windows cover exactly the runs of whole blocks that two pages share
    sizes = [[rng.randint(1, 4) for _ in range(rng.randint(0, 9))] for _ in range(60)]
    for size in sizes:
        ends = np.cumsum(size, dtype=np.int64)
        cuts = [0, *ends.tolist()]
        windows = {tuple(w) for w in html.block_windows(ends, 4, 100).tolist()} if size else set()
        for a, b in itertools.combinations(cuts, 2):
            inside = set().union(*(range(x, y) for x, y in windows if a <= x and y <= b))
            assert inside == (set(range(a, b)) if b - a >= 4 else set())


# ---------------------------------------------------------------- 8
def test_quality(spark):
    rng = random.Random(7)
    good = lambda: " ".join(rng.choices(["river", "garden", "letter", "winter", "music", "paper"], k=60)) + "."
    bad = lambda: " ".join(rng.choices(["$$$", "WIN!!!", "click", "free###", "buy", "paper"], k=60))
    rows = [(i, good() if i % 3 else bad(), "a") for i in range(300)] + [(300, None, "a"), (301, "", "a"), (302, good() * 200, "a")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    df = clashing(docs_of(spark, rows))
    labels = clashing(labels)
    model = quality.fit(df, labels, quantile=0.01)
    kept = quality.keep_good(df, model)
    assert kept.schema == df.schema and kept.where("__score <> 77").count() == 0
    ids = {r["doc_id"] for r in kept.collect()}
    held_out = range(150, 300)
    assert sum((i in ids) == (i % 3 > 0) for i in held_out) >= 0.95 * len(held_out) and 300 not in ids
    scored = quality.keep_good(df, model, with_score=True)
    assert dict(scored.dtypes)["score"] == "double" and scored.count() == len(ids)
    assert quality.fit(df, labels.where("quality = 1")) is None and quality.keep_good(df, None).count() == len(rows) - 1
    assert quality.fit(df.limit(0), labels) is None


def test_bradley_terry_is_the_maximum_likelihood():
    """Against plain gradient descent on the same pairs."""
    rng = np.random.default_rng(3)
    n, words = 40, 6
    x = rng.normal(size=(n, 2))
    held = rng.random((n, words)) < 0.4
    doc, col = np.nonzero(held)
    good, bad = np.arange(0, n, 2), np.arange(1, n, 2)
    w, lw = quality._bradley_terry(x, doc, col, words, good, bad, np.random.default_rng(5))
    again = np.random.default_rng(5)
    a = again.choice(good, (len(bad), quality.PAIRS_EACH)).ravel()
    b = np.repeat(bad, quality.PAIRS_EACH)
    z = np.concatenate((x, held), 1)

    def loss(v):
        return np.log1p(np.exp(-(z[a] - z[b]) @ v)).mean() + quality.L2 / 2 * v @ v

    v = np.zeros(z.shape[1])
    for _ in range(20_000):
        p = 1 / (1 + np.exp((z[a] - z[b]) @ v))
        v -= 0.3 * (-(p @ (z[a] - z[b])) / len(a) + quality.L2 * v)
    assert loss(np.concatenate((w, lw))) <= loss(v) + 1e-3
    order = lambda u: np.argsort(z @ u)
    assert (order(np.concatenate((w, lw))) == order(v)).mean() > 0.5


def test_quality_threshold_is_set_on_held_out_documents(spark):
    rng = random.Random(10)
    rows = [(rng.gauss(1, 1), True) for _ in range(400)] + [(rng.gauss(-1, 1), False) for _ in range(300)] + [(0.25, True), (0.25, False)]
    model = quality.Ranker(np.zeros(1))
    quality.set_threshold(model, spark.createDataFrame(rows, "score double, ok boolean"))
    good, bad = (np.array([s for s, o in rows if o == ok]) for ok in (True, False))
    loss = lambda t: (good < t).mean() + (bad >= t).mean()
    cuts = np.quantile(good, quality.QUANTILES)
    assert loss(model.threshold) <= min(loss(t) for t in cuts) + 0.005
    assert model.lost == pytest.approx((good < model.threshold).mean()) and model.caught == pytest.approx((bad < model.threshold).mean())
    assert model.caught > (bad < np.quantile(good, 0.002)).mean() + 0.3  # what the lowest good scores let through
    same = quality.Ranker(np.zeros(1))
    quality.set_threshold(same, spark.createDataFrame([(1.0, True), (1.0, False)], "score double, ok boolean"))
    assert same.threshold == 1.0 and same.lost == 0.0
    # no document that sets the threshold was fitted on
    text = lambda i: "kind river garden" if i % 2 else f"foul mud {'x' * (i % 7)}"
    docs = docs_of(spark, [(i, text(i), "a") for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    fitted = quality.fit(docs, labels)
    assert fitted.caught == 1.0 and fitted.lost == 0.0


# ---------------------------------------------------------------- 9
def test_exact(spark, corpus):
    df = docs_of(spark, [*corpus, (None, "x", "a"), (90, None, "b")])
    got = exact.exact_dedup(df)
    assert got.columns == [*df.columns, "n_copies", "content_hash"]
    want = {}
    for i, t, _ in corpus:
        want.setdefault(t if t is not None else ("null", i), []).append(i)
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == {min(v) for v in want.values()} | {90}
    assert {r["doc_id"]: r["n_copies"] for r in rows}[85] == 3
    assert exact.exact_dedup(df.limit(0)).count() == 0


def test_exact_keeps_rows_whole(spark):
    rows = [(2, "a", {"of": 2}, [{"k": 2}], 9), (1, "a", {"of": 1}, [{"k": 1}], 9), (1, "a", {"of": 0}, [{"k": 3}], 9), (3, None, None, None, 9), (None, "b", {}, [], 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, ms array<map<string,int>>, n_copies int").withColumn("a.b", F.lit(1))
    got = {(r["doc_id"], r["n_copies"]): r for r in exact.exact_dedup(df, counts=False).collect()}
    assert set(got) == {(1, 9), (3, 9), (None, 9)} and exact.exact_dedup(df, counts=False).schema.names == df.columns
    assert (got[1, 9]["m"], got[1, 9]["ms"]) in [({"of": 1}, [{"k": 1}]), ({"of": 0}, [{"k": 3}])]
    assert {r["doc_id"]: r["n_copies"] for r in exact.exact_dedup(df).collect()} == {1: 3, 3: 1, None: 1}


# ---------------------------------------------------------------- 10
def plain_best_fit(sizes, capacity):
    room, out = [], []
    for s in sorted(sizes, reverse=True):
        fits = [(r, b) for b, r in enumerate(room) if r >= s]
        if fits:
            b = min(fits)[1]
            room[b] -= s
        else:
            room.append(capacity - s)
        out.append(s)
    return sorted(room)


def test_packing(spark, corpus):
    rng = random.Random(8)
    sizes = [rng.randint(1, 40) for _ in range(500)]
    where = packing.best_fit_decreasing(sizes, 40)
    used = [0] * (max(where) + 1)
    for s, b in zip(sizes, where):
        used[b] += s
    assert max(used) <= 40 and sorted(40 - u for u in used) == plain_best_fit(sizes, 40)
    rows = packing.pack(docs_of(spark, corpus), 100).collect()
    pieces = [(d, s, n) for r in rows for d, s, n in zip(r["doc_ids"], r["starts"], r["lengths"])]
    want = [(i, s, min(100, len(t.split()) - s)) for i, t, _ in corpus if t for s in range(0, len(t.split()), 100)]
    assert sorted(pieces) == sorted(want)
    assert all(sum(r["lengths"]) == r["used"] <= 100 for r in rows)
    # one shard holds all of these: its bins are those of best fit over all pieces
    assert sorted(100 - r["used"] for r in rows) == plain_best_fit([n for _, _, n in pieces], 100)
    odd = docs_of(spark, [(1, "a b\u3000c\x1fd", "a"), (None, "x y", "a"), (2, None, "a"), (2, " ", "a"), (3, "p", "a"), (3, "p", "a")])
    bins = packing.pack(odd, 100).collect()
    assert len(bins) == 1 and bins[0]["lengths"] == [4, 2, 1, 1] and bins[0]["doc_ids"] == [1, None, 3, 3]
    assert packing.pack(docs_of(spark, corpus).limit(0)).count() == 0
