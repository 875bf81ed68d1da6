"""Quality (1), personal data (3), languages (4), packing (5), pieces (8), top-k (9)."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from odd_tables import SCHEMA, frame, odd_rows, prose, random_rows

from plumbline.llm import language, packing, pii, quality, sentencepieces, topk

FOLDER = "/root/testdata/sf0.01"
PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_entities(text):
    found = []
    for kind, (name, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if name == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if name == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if name == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), kind, m.end()))
    return sorted(found)


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


# Personal data


@pytest.mark.parametrize("seed", range(4))
def test_entities_of_random_signs(seed):
    rng = np.random.default_rng(seed)
    signs = list("ab@.@-+ 1234567890().%_é")
    for _ in range(400):
        text = "".join(rng.choice(signs, rng.integers(0, 60)))
        assert pii.entities(text) == plain_entities(text)
        number = "".join(rng.choice(list("0123456789 -"), rng.integers(14, 24)))
        assert pii.entities(number) == plain_entities(number)


def test_long_runs_take_linear_time():
    assert pii.entities("a" * 200_000 + " " + "1" * 200_000 + "@" * 1000) == []


def test_pii_digest(spark):
    rows = odd_rows()
    got = [r.asDict() for r in pii.digest(frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    for r in got:
        texts = [t or "" for i, t, *_ in rows if i == r["doc_id"]]
        bases = [",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in plain_entities(t)) for t in texts]
        assert r["base_sha256"] in [hashlib.sha256(b.encode()).hexdigest() for b in bases]
        base = ",".join(s for s in r["spans"].split(",") if not s.startswith("term"))
        assert base in bases and (base or not r["spans"])


def test_a_term_that_gives_an_entity_away(spark):
    common = [(i, f"the quick fox ran over field number {prose(30)}", "en", "s", 0, 0, "k", 0) for i in range(40)]
    told = [(100 + i, f"the secretary Zanzibarov writes bob@mail.example.com today {prose(5)}", "en", "s", 0, 0, "k", 0) for i in range(3)]
    docs = frame(spark, common + told)
    text = told[0][1]
    at = text.index("Zanzibarov")
    for r in pii.digest(docs).where("doc_id >= 100").collect():
        assert f"term:{at}:{at + 10}" in r["spans"].split(",")
        assert "term:0:3" not in r["spans"]  # "the" is everywhere
    assert pii.digest(docs).where("doc_id < 100 and spans <> ''").count() == 0
    masked = {r["doc_id"]: r for r in pii.masked(docs).collect()}
    assert "Zanzibarov" not in masked[100]["text"] and "[EMAIL]" in masked[100]["text"]
    assert masked[5]["text"] == common[5][1] and len(masked) == 43
    assert masked[100]["n_chars"] == len(masked[100]["text"])
    assert pii.masked(docs).schema.names == docs.schema.names


def plain_terms(rows):
    """Spans of the disclosing words of every row, by counting all pairs."""
    texts = [t or "" for _, t, *_ in rows]
    spans = [plain_entities(t) for t in texts]
    words = []
    for t, own in zip(texts, spans):
        runs = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t)]
        words.append([(s, e, t[s:e].lower()) for s, e in runs if all(e <= a or s >= b for a, _, b in own)])
    holds = [{(k, t[a:b].lower()) for a, k, b in own} for t, own in zip(texts, spans)]
    has = [{w for _, _, w in own} for own in words]
    entity_docs = {e: sum(e in h for h in holds) for e in set().union(*holds)}
    term_docs = {w: sum(w in h for h in has) for w in set().union(*has)}
    best = {}
    for e, n in entity_docs.items():
        for w, m in term_docs.items():
            both = sum(e in h and w in x for h, x in zip(holds, has))
            if both and n < len(rows):
                best[w] = max(best.get(w, 0), 1 + math.log2((both if both > 1 else 0.5) / m) / math.log2(len(rows) / n))
    return [[(s, e) for s, e, w in own if best.get(w, 0) >= pii.GENERALISED] for own in words]


def private_rows():
    far = prose(60)
    texts = [prose(40) for _ in range(60)]
    for i in range(0, 18, 3):
        texts[i] += f" Zanzibarov {far} 77A {prose(40)} bob@mail.example.com 10.0.0.1"
    texts[40] += " here ZANZIBAROV stands alone"
    texts[41] = "77a"
    texts += ["alice@x.example.org only " + prose(30), "list " + " ".join(f"u{i}@x.example.net Q{i}" for i in range(50)) + " tail"] * 2
    return [(i, t, "en", "s", len(t), 0, "k", 0) for i, t in enumerate(texts)] + odd_rows()


@pytest.mark.parametrize("known", [50_000, 0, 3])
def test_terms_of_all_documents(spark, known, monkeypatch):
    """Far from the entity, with digits, and where the entity does not stand."""
    monkeypatch.setattr(pii, "KNOWN", known)
    rows = private_rows()
    expected = []
    for (i, *_), text, terms in zip(rows, [t or "" for _, t, *_ in rows], plain_terms(rows)):
        every = sorted([(a, k, b) for a, k, b in plain_entities(text)] + [(a, 4, b) for a, b in terms])
        names = [*(n for n, _ in PATTERNS), "term"]
        expected.append((i, ",".join(f"{names[k]}:{a}:{b}" for a, k, b in every)))
    docs = frame(spark, rows)
    got = [(r["doc_id"], r["spans"]) for r in pii.digest(docs).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    masked = {r["doc_id"]: r["text"] for r in pii.masked(docs.where("doc_id between 30 and 63 or doc_id < 20")).collect()}
    assert "ZANZIBAROV" not in masked[40] and masked[40].startswith(rows[40][1][:20]) and "77" not in masked[41]


def test_an_entity_of_one_document(spark):
    """One meeting counts half: enough to generalise among many documents, not few."""
    rows = [(i, "the quick fox", "en", "s", 0, 0, "k", 0) for i in range(1100)]
    rows[7] = (7, "the fox Quillfeather " + "of the quick fox " * 30 + "writes bob@mail.example.com", "en", "s", 0, 0, "k", 0)
    docs = frame(spark, rows)
    text = {r["doc_id"]: r["text"] for r in pii.masked(docs).collect()}
    assert text[7].startswith("the fox [TERM] [TERM] the quick fox") and text[7].endswith("[TERM] [EMAIL]")
    assert {t for i, t in text.items() if i != 7} == {"the quick fox"}
    assert pii.digest(docs.where("doc_id < 100")).where("spans like '%term%'").count() == 0


# Language


def test_language_of_held_out_documents(spark):
    docs = documents(spark)
    got = language.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_spans_of_mixed_text(spark):
    docs = documents(spark)
    parts = {r["lang"]: r["text"] for r in docs.where("length(text) between 600 and 2000").collect()}
    text = parts["en"] + " " + parts["de"]
    mixed = spark.createDataFrame([(1, text), (2, None), (3, "12 !!"), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.label(mixed, language.learn(docs)).collect()}
    assert [s["lang"] for s in got[1]["__spans"]] == ["en", "de"]
    split = len(language.WORD.findall(parts["en"]))
    assert abs(got[1]["__spans"][1]["first"] - split) <= 3
    assert all(got[i]["__lang"] == "und" and got[i]["__share"] == 0 for i in (2, 3, 4))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    for lengths in ([4, 0, 6, 1], [5], [2, 2, 2]):
        offsets = np.cumsum([0, *lengths])
        scores = rng.normal(0, 3, (offsets[-1], 3)).astype(np.float32)
        path = language.viterbi(scores, offsets, 2.0)
        for a, b in zip(offsets[:-1], offsets[1:]):
            def value(p):
                return sum(scores[a + i, l] for i, l in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))

            best = max((value(p) for p in np.ndindex(*[3] * (b - a))), default=0) if b > a else 0
            assert b == a or math.isclose(value(path[a:b]), best, abs_tol=1e-4)


def test_language_without_anything_to_learn(spark):
    rows = [(0, "some words", None, None, 0, 0, "k", 0)]
    assert [r["lang_pred"] for r in language.predict(frame(spark, rows)).collect()] == ["und"]
    assert language.predict(spark.createDataFrame([], SCHEMA)).collect() == []
    odd = language.predict(frame(spark, odd_rows())).collect()
    assert len(odd) == len(odd_rows())


def test_a_rare_language_is_learned(spark):
    rows = [(i, "plain common words " * 3, "en", "s", 0, 0, "k", 0) for i in range(400)]
    rows += [(1000 + i, "žluťoučký kůň úpěl" if i else None, "cs", "s", 0, 0, "k", 0) for i in range(6)]
    model = language.learn(frame(spark, rows), 20)
    assert model.languages == ["cs", "en"]
    got = language.label(frame(spark, rows), model).where("lang = 'cs' and text is not null")
    assert {r["__lang"] for r in got.collect()} == {"cs"}
    known = frame(spark, rows).where("text is not null")
    assert sorted(r["lang"] for r in language.sampled(known, {"en": 400, "cs": 5}, 20).collect()) == ["cs"] * 5 + ["en"] * 10


def test_documents_with_letters_stay(spark):
    docs = frame(spark, odd_rows())
    kept = language.with_language(docs)
    assert kept.schema.names == docs.schema.names
    gone = {4, 5, 7, 17}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, *_ in odd_rows() if i not in gone}


# Quality


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    docs = documents(spark)
    got = quality.predict(docs, labels)
    assert got.count() == docs.count()
    held = got.where("held_out").join(labels, "doc_id").collect()
    good = [r["score"] for r in held if r["quality"] == 1]
    bad = [r["score"] for r in held if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in held)


def test_quality_of_odd_tables(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.predict(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(3, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.predict(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.predict(spark.createDataFrame([], SCHEMA), labels).collect() == []


def test_attention_gradients():
    rng = np.random.default_rng(0)
    features, bounds = rng.normal(0, 1, (40, 6)), np.array([0, 5, 6, 20, 40])
    labels = np.array([0.0, 1, 0, 1])
    model = quality.fit(features, bounds, labels)
    assert np.array_equal(model.scores(features, bounds) > 0.5, labels == 1)
    attention = model.forward(features, bounds)[4]
    assert np.allclose(np.add.reduceat(attention, bounds[:-1]), 1)


# Packing


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = odd_rows() + random_rows(40, 8)
    got = packing.pack(frame(spark, rows)).collect()
    expected = []
    for i, text, *_ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            expected.append((i, piece, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(expected, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1.05 * math.ceil(sum(r["length"] for r in got) / 4096) + 1
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_words_make_the_tokens_of_the_text():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer, words = Tokenizer.from_file(path), packing.WordTokens(path)
    texts = ["a\x1cb c", "", "İstanbul ΑΣ é <|endoftext|>x don't", "x|y (foo), it's 'tis á 한국어! ²b _a_ 3rd. <b>", "— ,a—, «b»"]
    ids, offsets = words.encode(texts * 2)
    for i, text in enumerate(texts * 2):
        assert list(ids[offsets[i] : offsets[i + 1]]) == tokenizer.encode(text, add_special_tokens=False).ids


def test_the_words_used_most_are_kept():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer, words = Tokenizer.from_file(path), packing.WordTokens(path)
    texts = ["the cat, the Dog the (cat) \u00e9t\u00e9", "", "the\x1ccat the", "rare\u00a0words  cat, cat,"]
    expected = [i for t in texts for i in tokenizer.encode(t, add_special_tokens=False).ids]
    assert words.encode(texts)[0].tolist() == expected
    words.keep(2)
    assert set(words.index) == {"the", "cat,"}
    ids, offsets = words.encode(pa.array(texts))
    assert ids.tolist() == expected and offsets[1] == offsets[2]


def test_the_fullest_bin_closes_first():
    where, offsets = packing.best_fit([6, 7, 5, 3, 4, 2], 10, 2)
    # 6 | 7 | 5 closes the bin of 7 | 3 fits none but 6's 4 | 4 goes to 5 | 2 opens
    assert where == [0, 1, 2, 0, 2, 3] and offsets == [0, 0, 0, 6, 5, 0]


# Pieces


def test_pieces_round_trip(spark):
    rows = odd_rows() + [(50, "▁ literal ▁▁ signs  and\n\nblanks ", "en", "s", 0, 0, "k", 0)]
    whole = {(r["doc_id"], r["text"]): bytes(r["ids"]) for r in sentencepieces.encode(frame(spark, rows)).collect()}
    got = sentencepieces.round_trip(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["exact"] for r in got)
    vocabulary = sentencepieces.Vocabulary(sentencepieces.default_model())

    def value(blob):
        text, total = " " + vocabulary.decode(np.frombuffer(blob, "<u4")).decode(), 0
        scores = {i: s for s, i in vocabulary.pieces.values()}
        return sum(scores.get(i, 0) for i in np.frombuffer(blob, "<u4").tolist())

    # Chunks of any size give cuts of the same score.
    for chunk in (16, 61):
        for r in sentencepieces.encode(frame(spark, rows), chunk=chunk).collect():
            blob = whole[r["doc_id"], r["text"]]
            assert value(bytes(r["ids"])) == value(blob) and len(r["ids"]) == len(blob)
    assert sentencepieces.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_words_are_cut_together_as_alone():
    vocabulary = sentencepieces.Vocabulary(sentencepieces.default_model())
    rng = np.random.default_rng(6)
    signs = list("ab the\n\u2581\u00e9\u6f22\U0001f600xyz@")
    words = ["".join(rng.choice(signs, n)) for n in rng.integers(1, 50, 400)] + ["a" * 300, "\U0001f600"]
    ids, number, scores = vocabulary.best_of(words)
    ends = np.cumsum(number)
    got = [(ids[a:b].tolist(), s) for a, b, s in zip(ends - number, ends, scores.tolist())]
    assert got == [vocabulary.best(w) for w in words]


def test_scan_is_associative():
    rng = np.random.default_rng(1)
    matrices = rng.integers(-50, 0, (9, 4, 4)).astype(np.int64)
    one = matrices[0]
    for i, total in enumerate(sentencepieces.scan(matrices)):
        if i:
            one = (one[:, :, None] + matrices[i][None]).max(axis=1)
        assert np.array_equal(total, one)


# Top-k


@pytest.mark.parametrize("block", [4, 1024])
def test_top_k(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "PORTION", 2)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 3, 4)], 0) for i in range(0, 1000, 25)]
    rows += [(7, None, 0), (100, [1.0, None, 0.0, 0.0], 0), (8, [float("nan"), 0.0, 0.0, 0.0], 0), (9, [float("inf"), 0.0, 0.0, 0.0], 0)]
    rows += [(None, [1.0, 1.0, 1.0, 1.0], 0), (11, [], 0), (13, [1.0, 1.0], 0), (25, [3.0, 3.0, 3.0, 3.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    valid = [(i, v) for i, v, _ in rows if i is not None and v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for i, v in valid:
        if i % 100 == 0:
            scored = sorted((-sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(v, w)), j) for j, w in valid if j != i)
            expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:10])]
    assert sorted(map(tuple, topk.search(table).collect())) == sorted(expected)
    assert topk.search(table.where("false")).collect() == []


def test_all_queries_of_a_block_read_its_lists_together(monkeypatch):
    rng = np.random.default_rng(4)
    values, queries = rng.integers(-500, 500, (300, 8)), rng.integers(-500, 500, (40, 8))
    ids, own = rng.permutation(300), rng.integers(0, 300, 40)
    depths, read = [], topk.SortedLists.read
    monkeypatch.setattr(topk.SortedLists, "read", lambda self, depth: depths.append(depth) or read(self, depth))
    got = list(zip(*(x.tolist() for x in topk.SortedLists(ids, values).top(queries, own, 10))))
    assert depths == [75, 150, 300][: len(depths)]
    scored = queries @ values.T
    for i in range(40):
        best = sorted((-s, j) for s, j in zip(scored[i].tolist(), ids.tolist()) if j != own[i])[:10]
        assert [g for g in got if g[0] == i] == [(i, j, -s) for s, j in best]
