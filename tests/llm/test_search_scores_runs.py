"""Lexical search (11), Katz scores (12), periodic runs (13), held against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from odd_tables import SCHEMA, frame, odd_rows, prose, random_rows

from plumbline.llm import katz, lexical, packed, periodic


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


@pytest.fixture(scope="module")
def odd_docs(spark, tmp_path_factory):
    """Odd and random rows as a table in files, with their ids and texts."""
    path = str(tmp_path_factory.mktemp("odd") / "documents")
    frame(spark, odd_rows() + random_rows(150, 11)).write.parquet(path)
    docs = spark.read.parquet(path)
    return docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# Search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def plain_search(docs, items, k=50):
    docs = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    count, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c in docs:
            m = 100 - 50 + 50 * sum(c.values()) * count // total
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
                for t in wanted if t in c
            )
            if score > 0:
                scored.append((-score, i))
        out += [(item, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def odd_items(spark, texts):
    rows = [(n, " ".join(words(t)[:30]), "x") for n, (_, t) in enumerate(texts[:12])]
    rows += [(50, None, "x"), (51, "", "x"), (52, "... !!", "x"), (53, "nowhere to be found", "x"), (None, "one two", "x")]
    rows += [(54, "ONE two", "x"), (54, "w1 é漢字ñ", "y")]
    return spark.createDataFrame(rows, "item_id long, text string, portion string"), [r[:2] for r in rows]


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, odd_docs, monkeypatch, small):
    """In one block and portion, and in many; ties, repeated rows, clashing columns."""
    if small:
        monkeypatch.setattr(lexical, "BLOCK_TERMS", 400)
        monkeypatch.setattr(lexical, "PORTION", 3)
    docs, texts = odd_docs
    items, plain = odd_items(spark, texts)
    found = lexical.ranked(docs.withColumn("portion", docs.lang).withColumn("terms", docs.lang), items)
    assert sorted(map(tuple, found.collect())) == plain_search(texts, plain)


def test_search_of_nothing(spark, odd_docs):
    docs, texts = odd_docs
    items, _ = odd_items(spark, texts)
    assert lexical.ranked(docs.limit(0), items).count() == 0
    assert lexical.ranked(docs, items.limit(0)).count() == 0
    assert lexical.ranked(docs.where("text is null"), items).count() == 0


def test_blocks_of_a_file_are_read_one_by_one(spark, monkeypatch):
    """However many blocks a task writes, no row group has more bytes than asked for, or it has one block."""
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 400)
    monkeypatch.setattr(lexical, "ROW_GROUP", 1 << 18)
    rng = random.Random(5)
    texts = [(i, " ".join(f"w{int(rng.paretovariate(0.3)) % 50_000}" for _ in range(20_000))) for i in range(15)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    index, count = lexical.build_index(docs)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    groups = [f.row_group(i) for f in files for i in range(f.num_row_groups)]
    assert len(files) < sum(g.num_rows for g in groups)
    assert all(g.num_rows == 1 or g.total_byte_size <= 1 << 18 for g in groups)
    items = [(1, "w1 w2 w3"), (2, texts[7][1][:500])]
    found = lexical.search(index, count, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect())) == plain_search(texts, items)


@pytest.mark.parametrize("seed", range(20))
def test_treap(seed):
    """Random grids: the best of every item, whatever its weights."""
    rng = np.random.default_rng(seed)
    n_docs, vocabulary = int(rng.choice([1, 2, 3, 40, 300])), int(rng.choice([2, 10, 300]))
    lengths = rng.integers(1, 60, n_docs)
    bounds = np.append(0, np.cumsum(lengths))
    names = np.unique(rng.integers(1, 1 << 48, vocabulary).astype(np.uint64))
    of = names[np.minimum(rng.pareto(1, lengths.sum()).astype(int), len(names) - 1)]
    ids = rng.permutation(10 * n_docs)[:n_docs]
    block = lexical.Block(lexical.build(ids, of, bounds, 3 * n_docs, 3 * len(of)))
    block.open()
    for k in (1, 5, 50):
        wanted = np.unique(rng.choice(names, 20)).astype(np.int64)
        have, at = block.found(wanted)
        assert have.all() == np.isin(wanted, of.astype(np.int64)).all()
        weights = rng.integers(0, 9000, have.sum())
        weight = dict(zip(wanted[have].tolist(), weights.tolist()))
        best = []
        for d in range(n_docs):
            own = Counter(of[bounds[d] : bounds[d + 1]].tolist())
            m = 50 + 50 * int(lengths[d]) * 3 * n_docs // (3 * len(of))
            score = sum(weight[t] * (10**9 * c // (1000 * c + 20 * m)) for t, c in own.items() if t in weight)
            best.append((-score, int(ids[d])))
        columns, scores = block.top(at, weights, k)
        assert sorted(zip((-scores).tolist(), block.doc_ids[columns].tolist())) == sorted(b for b in best if b[0])[:k]


# Scores


def plain_katz(docs):
    texts = [(i, [*words(lower(t)), "\0"], i is not None and zlib.crc32(str(i).encode()) % 5 != 1) for i, t in docs]
    one, two = Counter(), Counter()
    for _, x, learn in texts:
        if learn:
            one.update(x)
            two.update(zip(["", *x[:-1]], x))
    n, v = sum(one.values()), len(one)
    d1, d2 = (katz.discounts([sum(c == r for c in t.values()) for r in range(1, 7)]) for t in (one, two))
    kept = lambda d, c: d[c] * c if c <= 5 else c
    left = sum(c - kept(d1, c) for c in one.values())
    followers = defaultdict(dict)
    for (a, b), c in two.items():
        followers[a][b] = c

    def alone(w):
        top = kept(d1, one[w]) if one[w] else left
        return top / n if left else (one[w] or 1) / (n + 1)

    def pair(a, b):
        f = followers.get(a)
        if not f:
            return alone(b)
        rest = sum(c - kept(d2, c) for c in f.values())
        total = sum(f.values()) + (rest == 0)
        if b in f:
            return kept(d2, f[b]) / total
        return (rest or 1) / total / (1 - sum(map(alone, f))) * alone(b)

    for a in [*list(followers)[:5], "", "no such word"]:
        assert math.isclose(sum(pair(a, w) for w in one) + pair(a, "unknown"), 1, abs_tol=1e-9)
    return [
        (
            i, not learn, len(x), sum(one[w] > 0 for w in x), n,
            sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x),
            sum(math.log10(pair(a, b)) for a, b in zip(["", *x[:-1]], x)),
        )
        for i, x, learn in texts
    ]


def by_row(r):
    return (r[0] is None, r[0] or 0, r[2], round(r[5], 4))


@pytest.mark.parametrize("small", [False, True])
def test_scores(odd_docs, monkeypatch, small):
    """In one block and bucket; and in many, with frequent histories split and one text cut."""
    if small:
        monkeypatch.setattr(katz, "BLOCK", 500)
        monkeypatch.setattr(katz, "BUCKET_BYTES", 3000)
    docs, texts = odd_docs
    found = katz.held_out_scores(docs.withColumn("block", docs.lang).withColumn("learn", docs.lang)).collect()
    assert found[0].asDict().keys() == {
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    }
    expected = plain_katz(texts)
    assert len(found) == len(expected)
    for a, b in zip(sorted(map(tuple, found), key=by_row), sorted(expected, key=by_row)):
        assert a[:5] == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-9)


def test_scores_without_rows(spark, odd_docs):
    docs, _ = odd_docs
    assert katz.held_out_scores(docs.limit(0)).count() == 0
    alone = katz.score(docs, docs.doc_id < 0).where("doc_id = 12 and n_tokens = 3").first()
    assert (alone.held_out, alone.n_tokens, alone.n_known, alone.train_tokens) == (True, 3, 0, 0)
    assert alone.score == alone.base_score == 0


def block_of(texts, learn):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(learn)], ["i", "t", "l"])
    return batch, next(katz.blocks_of(iter([batch]), 1 << 20))


@pytest.mark.parametrize("splits", [{}, {katz.BEGIN: 3}, {katz.BEGIN: 2, "": 4}])
def test_pairs_of_a_block(monkeypatch, splits):
    """Each distinct pair once, with its tokens, by bucket and history; frequent histories in several buckets."""
    monkeypatch.setattr(katz.TaskContext, "get", staticmethod(lambda: type("Context", (), {"partitionId": lambda self: 0})()))
    texts = [prose(300, random.Random(n)) for n in range(9)] + ["", "a a a b"]
    _, block = block_of(texts, [n % 2 == 0 for n in range(11)])
    most = Counter(block.tokens.tolist()).most_common(1)[0][0]
    splits = {k or most: n for k, n in splits.items()}
    pairs = katz.Pairs(block, 5, splits)
    assert sorted(pairs.at.tolist()) == list(range(len(block.tokens)))
    found = Counter()
    for n, part in enumerate(np.split(pairs.at, pairs.heads[1:])):
        assert np.all(np.diff(part) > 0)
        assert set(zip(block.before[part], block.tokens[part])) == {(pairs.history[n], pairs.tokens[n])}
        found[int(pairs.history[n]), int(pairs.tokens[n])] += len(part)
    assert len(found) == len(pairs.heads)
    assert found == Counter(zip(block.before.tolist(), block.tokens.tolist()))
    assert pairs.buckets.tolist() == sorted(set(pairs.bucket.tolist()))
    histories, bounds = pairs.bounds()
    for n, bucket in enumerate(pairs.buckets):
        own = pairs.history[bounds[n] : bounds[n + 1]]
        assert set(pairs.bucket[bounds[n] : bounds[n + 1]]) == {bucket}
        assert list(dict.fromkeys(own)) == pairs.history[pairs.firsts[histories[n] : histories[n + 1]]].tolist()
        assert pairs.followers[histories[n] : histories[n + 1]].tolist() == [np.sum(own == h) for h in dict.fromkeys(own)]
    for history in {int(h) for h in pairs.history}:
        assert len(set(pairs.bucket[pairs.history == history])) <= splits.get(history, 1)


def test_counts_take_few_bytes(monkeypatch):
    """Small counts are sent in a byte each: the work of a block is with its hashes."""
    monkeypatch.setattr(katz.TaskContext, "get", staticmethod(lambda: type("Context", (), {"partitionId": lambda self: 0})()))
    batch, block = block_of([prose(2000, random.Random(n)) for n in range(20)], [True] * 20)
    distinct = len(set(zip(block.before.tolist(), block.tokens.tolist())))
    sent = next(katz._sent(3, {}, 1 << 20)(iter([batch])))
    assert distinct <= sum(map(len, sent["learned"].to_pylist())) <= 2 * distinct + 9
    home = next(katz._at_home(3, {}, 1 << 20)(iter([batch])))
    assert sum(len(home[n][0].as_py()) for n in ("texts", "places", "times")) <= 5 * len(block.tokens)
    for values in ([], [0], [1, 255], [256, 0], [(1 << 40) + 7, 3]):
        values = np.array(values, np.int64)
        assert np.array_equal(katz._planes(katz.planes(values)), values)
        assert [katz._planes(b).tolist() for b in katz.cut(values, np.array([0, 0, len(values)]))] == [[], values.tolist()]
    assert len(katz.planes(np.arange(256))) == 257


def test_keys_too_large_to_sort_with_their_places():
    for top in (9, 1 << 62):
        keys = np.random.default_rng(3).integers(0, 9, 500) * (top // 9)
        at, heads = katz._grouped(keys)
        assert np.array_equal(at, np.argsort(keys, kind="stable"))
        assert np.array_equal(heads, np.unique(keys[at], return_index=True)[1])


def test_discounts():
    """Estimates where they can be used, a fixed loss elsewhere; always a loss."""
    assert np.allclose(katz.discounts([120, 40, 24, 13, 15, 5])[1:3], [(2 * 40 / 120 - 0.25) / 0.75, (3 * 24 / 80 - 0.25) / 0.75])
    for n in ([0] * 6, [7, 0, 0, 0, 0, 0], [5, 9, 1, 0, 3, 80], [10**12, 10**11, 10**10, 10**9, 10**8, 10**7]):
        assert np.all((katz.discounts(n)[1:] > 0) & (katz.discounts(n)[1:] < 1))


# Runs


def plain_runs(x):
    out = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q):
                part = x[i : j + q]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeating(rng):
    """Random stretches, repeated blocks and blocks of repeated blocks."""
    out = []
    for _ in range(rng.randint(0, 5)):
        kind = rng.random()
        sign = lambda: f"s{rng.randrange(rng.choice([1, 2, 3, 50]))}"
        if kind < 0.4:
            out += [sign() for _ in range(rng.randint(0, 60))]
        else:
            block = [sign() for _ in range(rng.randint(1, rng.choice([3, 10, 40, 90])))]
            if kind > 0.9:
                block = block[:5] * 6 + ["s1"]
            out += (block * 8)[: rng.randint(len(block), 7 * len(block))]
    return out


@pytest.mark.parametrize("seed", range(40))
def test_runs(seed):
    rng = random.Random(seed)
    texts = [repeating(rng) for _ in range(rng.randint(1, 5))]
    numbers = {}
    value = lambda w: numbers.setdefault(w, int(np.random.default_rng(len(numbers)).integers(1, 1 << 62)))
    bounds = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    found = periodic.runs_of(np.array([value(w) for t in texts for w in t], np.uint64), bounds)
    expected = [(int(b) + i, n, q) for t, b in zip(texts, bounds) for i, n, q in plain_runs(t)]
    assert list(zip(*(c.tolist() for c in found))) == expected


def plain_digest(doc_id, text):
    x = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and x:
        g = h // 10
        a = g % len(x)
        p = 1 + (len(x) - a) // (3 + g % 8)
        x = x[:a] + [x[a + (i - a) % p] for i in range(a, len(x))]
    runs = plain_runs(x)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *longest, sha(lines), sha(" ".join(w for i, w in enumerate(x) if i not in gone)))


def test_run_digest(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([" ", "\n"]).join(repeating(rng)), "en", "s", 0, 0, "k", 0) for i in range(200)]
    rows += [(i + 1000, prose(rng.randint(1, 90)), "en", "s", 0, 0, "k", 0) for i in range(300)]
    rows = [r for r in odd_rows() if len(r[1] or "") < 9000] + rows
    docs = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"bucket": "runs", "block": "h"})
    found = periodic.digest(docs)
    assert Counter(map(tuple, found.collect())) == Counter(plain_digest(r[0], r[1]) for r in rows)
    assert periodic.digest(docs.limit(0)).count() == 0


def test_runs_of_a_long_text(spark):
    """A text of more bytes than are handled together."""
    unit = [f"w{i}" for i in range(30_000)]
    text = " ".join(["start", *unit * 4, "end", *["again"] * 70_000])
    row = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(1, 120_000, 30_000), (120_002, 70_000, 1)]
    assert row.n_words == 190_002
    assert row.collapsed.split() == ["start", *unit, "end", "again"]


def test_blocks_cut_long_texts(monkeypatch):
    """Blocks hold all tokens in order, each with the one before it, whatever the cuts."""
    context = type("Context", (), {"partitionId": staticmethod(lambda: 5)})
    monkeypatch.setattr(katz.TaskContext, "get", staticmethod(lambda: context))
    monkeypatch.setattr(packed, "CHUNK", 200)
    texts = ["a b", None, " ".join(f"w{i}" for i in range(1000)), "", "c " * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts), pa.array([True, False, True, True, False])], ["i", "t", "l"])
    whole = list(katz.blocks_of(iter([batch, batch]), 1 << 20))
    assert len(whole) == 1 and whole[0].number == 5 << 24
    for limit in (1, 7, 100, 1001, 1500):
        parts = list(katz.blocks_of(iter([batch, batch]), limit))
        assert [b.number for b in parts] == [(5 << 24) + n for n in range(len(parts))]
        for name in ("tokens", "before"):
            assert np.array_equal(np.concatenate([getattr(b, name) for b in parts]), getattr(whole[0], name))
        by_row = Counter()
        for b in parts:
            assert sum(b.lengths) == len(b.tokens)
            by_row.update(dict(zip(b.rows.tolist(), b.lengths.tolist())) if len(set(b.rows.tolist())) == len(b.rows) else {})
        assert by_row[0] == 3 and by_row[2] in (1001, 0)
