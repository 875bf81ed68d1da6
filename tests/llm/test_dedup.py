"""Passage removal (2, 6), the Jaccard join (10) and fingerprints (7) against brute force."""

import hashlib
import random
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from odd_tables import SCHEMA, components, frame, odd_rows, random_rows, removed_windows, shingles

from plumbline.llm import components as stars
from plumbline.llm import fingerprints, jaccard_join, queries, repeats, substring_dedup, suffix_dedup, suffixes
from plumbline.plans import session

TABLES = [odd_rows(), random_rows(60, 1), random_rows(60, 2)]


def spans(gone):
    return sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))


@pytest.mark.parametrize("rows", TABLES)
def test_bytes(spark, rows):
    expected = []
    for i, x, gone in removed_windows(rows, lambda t: list(t.encode())):
        kept = bytes(b for b, g in zip(x, gone) if not g)
        expected.append((i, len(x), sum(gone), spans(gone), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.digest(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("rows", TABLES)
def test_words(spark, rows):
    expected = []
    for i, x, gone in removed_windows(rows, lambda t: t.encode().split()):
        kept = b" ".join(w for w, g in zip(x, gone) if not g)
        expected.append((i, len(x), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in substring_dedup.digest(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_many_contexts_of_one_gram_are_split(spark, monkeypatch):
    rows = random_rows(60, 3)
    whole = sorted(map(tuple, suffix_dedup.digest(frame(spark, rows)).collect()))
    monkeypatch.setattr(repeats, "TOGETHER", 1)
    assert sorted(map(tuple, suffix_dedup.digest(frame(spark, rows)).collect())) == whole


def test_removed_text_keeps_columns_and_characters(spark):
    docs = frame(spark, odd_rows())
    out = suffix_dedup.removed_text(docs)
    assert out.schema.names == docs.schema.names and out.count() == docs.count()
    for row in out.collect():
        assert row["text"] is None or row["n_chars"] == len(row["text"])
    by_id = {r["doc_id"]: r["text"] for r in out.collect()}
    assert by_id[1] == "" and by_id[0] and by_id[4] is None


@pytest.mark.parametrize("rows", TABLES)
def test_components(spark, rows):
    got = sorted(tuple(r) for r in jaccard_join.classes(frame(spark, rows)).where("doc_id is not null").collect())
    assert got == components(rows)
    assert jaccard_join.classes(frame(spark, rows)).count() == len(rows)


def test_every_size_and_likeness(spark):
    """Pairs around the limit for all small sizes, so light and heavy sets meet."""
    rng = random.Random(9)
    rows = []
    for n in range(1, 40):
        words = [f"{n}v{i}" for i in range(n + 4)]
        for cut in range(0, max(1, n // 3) + 1):
            rows.append((len(rows), " ".join(words[: len(words) - cut]), "en", "s", 0, 0, "k", 0))
        changed = list(words)
        changed[rng.randrange(len(words))] = "other"
        rows.append((len(rows), " ".join(changed), "en", "s", 0, 0, "k", 0))
    got = sorted(tuple(r) for r in jaccard_join.classes(frame(spark, rows)).collect())
    assert got == components(rows)


@pytest.mark.parametrize("light", [0, 12])
def test_either_side_of_the_boundary(spark, light, monkeypatch):
    monkeypatch.setattr(jaccard_join, "boundary", lambda sets: light)
    rows = odd_rows()
    got = sorted(tuple(r) for r in jaccard_join.classes(frame(spark, rows)).where("doc_id is not null").collect())
    assert got == components(rows)


def test_one_of_each_group_stays(spark):
    docs = frame(spark, odd_rows())
    kept = jaccard_join.one_of_each(docs)
    assert kept.schema.names == docs.schema.names
    ids = [r["doc_id"] for r in kept.collect()]
    assert 0 in ids and 1 not in ids and 2 not in ids and {4, 5, 7} <= set(ids) and ids.count(None) == 2


def test_stars(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (7, 7)]
    got = dict(map(tuple, stars.connected(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(51)) and got[102] == got[101] == got[100] == 100


def test_suffix_order():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 30, 500):
        for letters in (1, 2, 4, 250):
            text = rng.integers(0, letters, n).astype(np.uint8)
            raw = text.tobytes()
            assert list(suffixes.suffix_order(text, 1000)) == sorted(range(n), key=lambda i: raw[i:])


@pytest.mark.parametrize("rows", TABLES)
def test_fingerprints(spark, rows):
    got = [r.asDict() for r in fingerprints.fingerprints(frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    named = sorted((i, t or "") for i, t, *_ in rows if i is not None)
    prints = {}
    for k, (i, text) in enumerate(named):
        after = named[(k + 1) % len(named)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        row = next(r for r in got if r["doc_id"] == i and r["n_chars"] == len(text) and r["edited_sha256"] == sha)
        assert prints.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        for other, name in ((edited, "near_edited"), (after, "near_next")):
            x, y = shingles(text), shingles(other)
            true = len(x & y) / len(x | y) if x | y else 1.0
            assert abs(row[name] - true) < 0.25
    assert sum(r["doc_id"] is None and r["fingerprint"] is not None and r["near_next"] is None for r in got) == sum(
        i is None for i, *_ in rows
    )


def test_banded_pairs_are_verified(spark):
    rows = random_rows(60, 4)
    got = dict(map(tuple, fingerprints.near_classes(frame(spark, rows)).collect()))
    true = {i: c for i, _, c in components(rows)}
    for i, c in got.items():
        assert true[i] == true[c]
    linked = [i for i in true if sum(c == true[i] for c in true.values()) > 1]
    assert len([i for i in linked if i in got]) >= 0.9 * len(linked)


def test_the_query_has_the_classes(spark, monkeypatch):
    """Also of copies that are not neighbours, as exact components have them."""
    rows = random_rows(60, 4) + [(200, None, "en", "s", 0, 0, "k", 0)]
    monkeypatch.setattr(queries, "_documents", lambda spark, folder: frame(spark, rows))
    got = queries.op7_minhash(spark, "").collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, c) for i, _, c in components(rows)]
    assert fingerprints.with_classes(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("run", [suffix_dedup.digest, substring_dedup.digest, jaccard_join.classes, fingerprints.fingerprints])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []


def test_entries_of_a_long_set_take_one_byte_each():
    head = np.zeros(601, bool)
    head[[0, 600]] = True
    first = jaccard_join._entries(head)
    assert first.tolist() == [0, 255, 510, 600]
    assert np.diff(np.append(first, 601)).astype(np.uint8).sum(dtype=int) == 601
    assert jaccard_join._entries(np.empty(0, bool)).tolist() == []


def test_the_classes_keep_little_of_texts_without_copies(spark, tmp_path, monkeypatch):
    """Tables for the classes grow with documents and near copies, not with shingles."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(1 << 20)}" for _ in range(800)) for _ in range(200)]
    texts += [" ".join([*texts[0].split()[:-3], "other"]), texts[1]]
    rows = [(i, t, "en", "s", 0, 0, "k", 0) for i, t in enumerate(texts)]
    monkeypatch.setattr(session, "new_folder", lambda spark, name: str(tmp_path / f"{name}-{uuid.uuid4().hex}"))
    got = {r["doc_id"]: r["component_id"] for r in fingerprints.with_classes(frame(spark, rows)).collect()}
    assert {i: c for i, c in got.items() if i != c} == {200: 0, 201: 1}
    written = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert written < sum(map(len, texts)) / 4


def test_dealt_texts_are_read_back(spark, monkeypatch):
    """Compressed by range, whatever a task holds at once; a range's first also as guest."""
    texts = ["", "é漢字ñ " * 50, "plain words " * 90, "x", "words again " * 70]
    batches = [pa.record_batch({"doc_id": [i, i + 5], "text": [t, None]}) for i, t in enumerate(texts)]
    for held in (1, 1 << 25):
        monkeypatch.setattr(fingerprints, "DEAL", held)
        out = pa.Table.from_batches(fingerprints._dealt([3, 6], [(0, 2), (3, 0), (6, 1)])(iter(batches)))
        got = {}
        for r in set(out["home"].to_pylist()):
            got[r] = sorted(fingerprints._read(out.filter(pc.equal(out["home"], r))))
        named = dict(enumerate(texts)) | {i + 5: "" for i in range(5)}
        parts = {0: range(3), 1: range(3, 6), 2: range(6, 10)}
        opens = {0: 3, 1: 6, 2: 0}
        assert got == {r: [(False, i, named[i]) for i in ids] + [(True, opens[r], named[opens[r]])] for r, ids in parts.items()}
