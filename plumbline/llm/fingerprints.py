"""MinHash fingerprints of documents (operator 7)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import packed
from plumbline.llm.components import connected
from plumbline.llm.jaccard_join import LIKE, LOWER, SHINGLE, linking_pairs, shingle_sets
from plumbline.plans.session import materialize

PERMUTATIONS = 128
#: Bands of the join and signature values in each.
BANDS, ROWS = 32, 4
#: Shingles that meet all permutations at a time.
STEP = 1 << 14
#: Bytes of text that a task holds before it deals them, compressed, to their ranges.
DEAL = 1 << 25
LEVEL = 6
#: Words of 64 bits that mark ids whose texts are read again.
MARKS = 1 << 18
#: Words of 64 bits in the parity sketch of a set. With 1,024 bits few pairs below the
#: limit are left to their texts.
SKETCH = 16

_seed = packed.mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Multipliers and offsets of the universal hash functions.
FACTORS, OFFSETS = _seed[:PERMUTATIONS] | np.uint64(1), _seed[PERMUTATIONS:]


def signatures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit minima of every row under every permutation, and the shingle counts."""
    low, high, at = packed.words_of(LOWER[data], offsets)
    rolling = packed.Rolling(packed.word_hashes(LOWER[data], low, high))
    words = np.diff(at)
    number = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    out = np.full((len(words), PERMUTATIONS), np.iinfo(np.uint32).max, np.uint32)
    starts = packed.ragged(at[:-1], number)
    row = np.repeat(np.arange(len(words)), number)
    hashes = rolling.spans(starts, np.minimum(starts + SHINGLE, at[1:][row]))
    for begin in range(0, len(hashes), STEP):
        x, rows = hashes[begin : begin + STEP], row[begin : begin + STEP]
        heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        own = rows[heads]
        for p in range(PERMUTATIONS):
            y = x * FACTORS[p]
            y += OFFSETS[p]
            y >>= np.uint64(32)
            least = np.minimum.reduceat(y, heads).astype(np.uint32)
            out[own, p] = np.minimum(out[own, p], least)
    return out, number


def as_text(signature: np.ndarray, shingles: int) -> str:
    """A byte of every minimum, in hexadecimal; empty without shingles."""
    return (signature & 0xFF).astype(np.uint8).tobytes().hex() if shingles else ""


def likeness(left: str | None, right: str | None) -> float | None:
    """Jaccard estimate of two fingerprints, less the chance that bytes agree."""
    if left is None or right is None:
        return None
    if left == right:
        return 1.0
    if not left or not right:
        return 0.0
    a, b = (np.frombuffer(bytes.fromhex(x), np.uint8) for x in (left, right))
    return float(max(0.0, (np.mean(a == b) - 1 / 256) / (1 - 1 / 256)))


def _fingerprints(texts: list[str]) -> list[str]:
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    out = []
    for low, high in packed.groups_of(offsets, packed.CHUNK):
        rows, number = signatures(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        out += [as_text(r, n) for r, n in zip(rows, number)]
    return out


FIELDS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


DEALT = "home int, guest binary, doc binary, size binary, texts binary"


def _dealt(bounds: list[int], before: list[tuple[int, int]]):
    """Texts by the range of their id, those that open a range also for the range
    before it, as guests. A task compresses what it has for a range."""
    cuts = np.array(bounds, np.int64)
    opens = np.array([first for first, home in before if home is not None], np.int64)
    homes = np.array([home for _, home in before if home is not None], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", LEVEL)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([i for i, _, _ in held])
            size = np.concatenate([np.diff(at) for _, _, at in held])
            data = memoryview(np.concatenate([d for _, d, _ in held]))
            held.clear()
            end = np.cumsum(size)
            guests = np.flatnonzero(np.isin(ids, opens))
            home = np.searchsorted(cuts, ids, "right")
            home = np.append(home, homes[np.searchsorted(opens, ids[guests])] if len(guests) else guests)
            row = np.append(np.arange(len(ids)), guests)
            order = np.argsort(home, kind="stable")
            present, first = np.unique(home[order], return_index=True)
            for r, rows in zip(present, np.split(order, first[1:])):
                who = row[rows]
                text = b"".join(data[e - n : e] for e, n in zip(end[who].tolist(), size[who].tolist()))
                guest = (rows >= len(ids)).astype(np.uint8)
                blobs = [guest, ids[who], size[who].astype(np.uint32)]
                blobs = [b.tobytes() for b in blobs] + [codec.compress(text, asbytes=True) if text else b""]
                columns = [pa.array([r], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in DEALT.split(", ")])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((ids, *packed.utf8(batch.column(1))))
            if sum(len(d) for _, d, _ in held) >= DEAL:
                yield from flush()
        if held:
            yield from flush()
        packed.release()

    return run


def _read(table: pa.Table) -> list[tuple[bool, int, str]]:
    """The rows that were dealt: whether a guest, id, text."""
    codec = pa.Codec("zstd", LEVEL)
    out = []
    for guest, doc, size, blob in zip(*(table[n].to_pylist() for n in ("guest", "doc", "size", "texts"))):
        ends = np.cumsum(np.frombuffer(size, np.uint32), dtype=np.int64).tolist()
        raw = codec.decompress(blob, ends[-1], asbytes=True) if blob else b""
        texts = (raw[low:high].decode() for low, high in zip([0, *ends], ends))
        out += zip(np.frombuffer(guest, bool).tolist(), np.frombuffer(doc, np.int64).tolist(), texts)
    return out


def _edited(table: pa.Table) -> pa.Table:
    """The rows of one range of ids; the last is followed by the guests' first."""
    rows = sorted(_read(table))
    own = [r for r in rows if not r[0]]
    if not own:
        return pa.Table.from_arrays([pa.array([], k) for k in KINDS], names=NAMES)
    after = rows[len(own)][2] if len(rows) > len(own) else own[0][2]
    texts = [t for _, _, t in own] + [after]
    edited = []
    for text, following in zip(texts, texts[1:]):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + following[:half])
    prints, changed = _fingerprints(texts), _fingerprints(edited)
    columns = (
        [doc for _, doc, _ in own],
        [len(t) for t in texts[:-1]],
        [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        prints[:-1],
        changed,
        [likeness(a, b) for a, b in zip(prints, changed)],
        [likeness(a, b) for a, b in zip(prints, prints[1:])],
    )
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], names=NAMES)


def _classed(table: pa.Table, classes: pa.Table) -> pa.Table:
    """The rows of one range with the class of each id, the smallest if it has several."""
    done, least = _edited(table), {}
    for doc, component in zip(classes["doc_id"].to_pylist(), classes["component_id"].to_pylist()):
        least[doc] = min(component, least.get(doc, doc))
    found = [least.get(doc, doc) for doc in done["doc_id"].to_pylist()]
    return done.append_column("component_id", pa.array(found, pa.int64()))


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        columns = [[None] * len(texts) for _ in NAMES]
        columns[1], columns[3] = [len(t) for t in texts], _fingerprints(texts)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], names=NAMES)


def fingerprints(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited form, as the query returns them.

    The next document is the one with the next ``doc_id`` (equal ids in the order
    of their texts), after the last the first. NULL text reads as empty. Texts
    without words have an empty fingerprint, like only to another such. A row
    without ``doc_id`` has no next document, so it gets its own fingerprint only.
    An empty table gives an empty result; other columns are not read.

    Ids are cut into ranges of about equal size; only the range bounds and the
    first id of each range pass through the driver. The row that opens a range is
    also sent to the range before, so texts are shuffled once, compressed.

    With ``classes`` (``doc_id, component_id``) the rows get their ``component_id``
    where the texts meet: the smallest, or their own id if that is smaller.
    """
    spark = docs.sparkSession
    packed.small_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = source.where(F.col("doc_id").isNotNull())
    ranges = packed.bucket_count(spark, 2)
    steps = [i / ranges for i in range(1, ranges)]
    ids = named.select(F.col("doc_id").cast("double").alias("x"))
    bounds = [int(b) for b in sorted(set(ids.approxQuantile("x", steps, 0.25 / ranges)))]
    place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    heads = sorted(named.groupBy(place.alias("r")).agg(F.min("doc_id")).collect())
    # The first id of each range, and the range before it.
    before = [(first, heads[i - 1][0]) for i, (_, first) in enumerate(heads)]
    dealt = named.mapInArrow(_dealt(bounds, before), DEALT).groupBy("home")
    alone = source.where(F.col("doc_id").isNull()).select("text").mapInArrow(_alone, FIELDS)
    if classes is None:
        return dealt.applyInArrow(_edited, FIELDS).unionByName(alone)
    told = classes.select("doc_id", "component_id", place.alias("home")).groupBy("home")
    done = dealt.cogroup(told).applyInArrow(_classed, f"{FIELDS}, component_id long")
    return done.unionByName(alone.withColumn("component_id", F.lit(None).cast("long")))


FILED = "bucket int, key binary, set binary, doc binary, doc_set binary, doc_size binary"
FILED_NAMES = [f.split()[0] for f in FILED.split(", ")]


def _named(data: np.ndarray, offsets: np.ndarray):
    """Row and hash of every shingle, the size of each row's set and its name."""
    row, hashes, size = shingle_sets(data, offsets)
    name = np.zeros(len(size), np.uint64)
    np.add.at(name, row, packed.mix(hashes))
    return row, hashes, size, packed.mix(name + size.astype(np.uint64))


def _banded(buckets: int):
    """The band keys of the sets, packed by key, and the documents with their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, members = packed.Held(["key", "set"]), packed.Held(["doc", "set", "size"])
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            got, who = held.take(), members.take()
            columns = {"doc": who["doc"], "doc_set": who["set"], "doc_size": who["size"].astype(np.uint32)}
            docs = packed.rows_by_bucket(packed.block_of_ids(who["doc"], buckets), buckets, columns)
            none = [pa.array([b""] * docs.num_rows, pa.binary())] * 2
            yield pa.RecordBatch.from_arrays([docs.column(0), *none, *docs.columns[1:]], names=FILED_NAMES)
            if len(got["key"]):
                columns = {"key": packed.to_bytes(got["key"], 5), "set": got["set"]}
                keys = packed.rows_by_bucket(packed.place(got["key"], buckets), buckets, columns)
                none = [pa.array([b""] * keys.num_rows, pa.binary())] * 3
                yield pa.RecordBatch.from_arrays([*keys.columns, *none], names=FILED_NAMES)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = packed.utf8(batch.column(1))
            for low, high in packed.groups_of(offsets, packed.CHUNK):
                part, ends = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                _, _, size, name = _named(part, ends)
                # A task files each set once.
                new = np.zeros(high - low, bool)
                for i, key in enumerate(name.tolist()):
                    if size[i] and key not in seen:
                        seen.add(key)
                        new[i] = True
                some = size > 0
                members.add(doc=ids[low:high][some], set=name[some], size=size[some])
                sign, _ = signatures(part, ends)
                bands = sign[new].reshape(-1, BANDS, ROWS).astype(np.uint64)
                keys = np.zeros((len(bands), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for j in range(ROWS):
                    keys = packed.mix(keys ^ bands[:, :, j])
                held.add(key=keys.ravel(), set=np.repeat(name[new], BANDS))
                if max(held.size, members.size) >= packed.FLUSH:
                    yield from flush()
        if members.size:
            yield from flush()
        packed.release()

    return run


MET = "kind int, key long, set long, size int"


def _met(table: pa.Table) -> pa.Table:
    """The sets that share a key, under a name for all of them (kind 0), and the
    documents with their sets (kind 1)."""
    key = packed.from_bytes(packed.joined(table["key"]), 5)
    sets = packed.joined(table["set"]).view(np.uint64)
    order = np.lexsort((sets, key))
    key, sets = key[order], sets[order]
    if len(key):
        keep = np.append(True, (key[1:] != key[:-1]) | (sets[1:] != sets[:-1]))
        key, sets = key[keep], sets[keep]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        number = np.diff(np.append(heads, len(key)))
        # Keys of the same sets lead to the same pairs.
        group = packed.mix(np.add.reduceat(packed.mix(sets), heads) + number.astype(np.uint64))
        chosen = np.zeros(len(heads), bool)
        chosen[np.unique(group, return_index=True)[1]] = True
        chosen &= number > 1
        key, sets = np.repeat(group[chosen], number[chosen]), sets[np.repeat(chosen, number)]
    doc, own, size = (packed.joined(table[n]) for n in ("doc", "doc_set", "doc_size"))
    columns = (
        np.repeat([0, 1], [len(key), len(doc) // 8]),
        np.append(key.view(np.int64), doc.view(np.int64)),
        np.append(sets.view(np.int64), own.view(np.int64)),
        np.append(np.zeros(len(key), np.int64), size.view(np.uint32)),
    )
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    return pa.Table.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds)], names=["kind", "key", "set", "size"])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text, compressed, with the name, the size and the parity sketch of its set."""
    codec = pa.Codec("zstd", LEVEL)
    for batch in batches:
        data, offsets = packed.utf8(batch.column(0))
        for low, high in packed.groups_of(offsets, packed.CHUNK):
            part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            row, hashes, size, name = _named(part, at)
            cell = (packed.mix(hashes) % np.uint64(64 * SKETCH)).astype(np.int64)
            odd = np.bincount(row * 64 * SKETCH + cell, minlength=(high - low) * 64 * SKETCH) & 1
            words = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
            ends = np.arange(high - low + 1, dtype=np.int32) * SKETCH
            texts = [part[i:j].tobytes() for i, j in zip(at.tolist(), at[1:].tolist())]
            texts = [len(t).to_bytes(4, "little") + codec.compress(t, asbytes=True) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(name.view(np.int64)),
                    pa.array(size, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(words)),
                    pa.array(texts, pa.binary()),
                ],
                names=["set", "size", "sketch", "text"],
            )
    packed.release()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose texts' sets have the likeness of a link."""
    codec = pa.Codec("zstd", LEVEL)

    def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = [codec.decompress(b[4:], int.from_bytes(b[:4], "little"), asbytes=True) for b in column.to_pylist()]
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    for batch in batches:
        (x, at), (y, to) = (plain(batch.column(i)) for i in (2, 3))
        keep = [np.empty(0, bool)]
        for low, high in packed.groups_of(at + to, packed.CHUNK):
            row, hashes, n = shingle_sets(x[at[low] : at[high]], at[low : high + 1] - at[low])
            row2, hashes2, m = shingle_sets(y[to[low] : to[high]], to[low : high + 1] - to[low])
            row, hashes = np.append(row, row2), np.append(hashes, hashes2)
            order = np.lexsort((hashes, row))
            row, hashes = row[order], hashes[order]
            both = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
            common = np.bincount(row[1:][both], minlength=high - low)
            keep.append(100 * common >= LIKE * (n + m - common))
        mask = pa.array(np.concatenate(keep))
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], names=["a", "b"])


def _alike(texts: DataFrame) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Tells the pairs that link by their texts, which are joined by ``row``, where the
    sketches allow it: their distance is at most that of the sets."""

    def overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        first = sets.select(F.col("set").alias("a"), F.col("row").alias("i"), F.col("size").alias("n"), F.col("sketch").alias("x"))
        second = sets.select(F.col("set").alias("b"), F.col("row").alias("j"), F.col("size").alias("m"), F.col("sketch").alias("y"))
        wanted = F.ceil(F.lit(LIKE) * (F.col("n") + F.col("m")) / F.lit(100.0 + LIKE))
        distance = sum((F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(SKETCH)), F.lit(0))
        ends = pairs.join(first, "a").join(second, "b").where(distance <= F.col("n") + F.col("m") - 2 * wanted)
        ends = materialize(ends.select("a", "b", "i", "j"), "ends")
        other = texts.select(F.col("row").alias("j"), F.col("text").alias("y"))
        one = texts.select(F.col("row").alias("i"), F.col("text").alias("x"))
        # Fewer than the others, as most pairs have a centre that others have too.
        one = one.join(ends.select("i").distinct(), "i", "left_semi")
        met = ends.join(other, "j").join(one, "i")
        return met.select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long")

    return overlap


def _texts_of(source: DataFrame, ids: DataFrame) -> DataFrame:
    """``row, set, size, sketch, text`` of the rows of ``source`` with one of ``ids``, and
    of few others. ``row`` numbers them.

    The ids are marked in a bounded number of bits, so texts are not shuffled. More
    ids than bits let more other rows through, and change nothing else.
    """
    word = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)).alias("word")
    bit = F.expr("shiftleft(1L, cast(pmod(shiftright(xxhash64(doc_id), 32), 64L) AS int))")
    marks = ids.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("marks"))
    found = source.withColumn("word", word).join(F.broadcast(marks), "word")
    found = found.where(F.col("marks").bitwiseAND(bit) != 0).select("text")
    found = found.mapInArrow(_sketched, "set long, size int, sketch array<bigint>, text binary")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "texts")


def near_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id`` of the documents with a near copy or an equal set.

    Documents that share a signature band are candidates; a pair counts if its
    exact shingle sets have a Jaccard likeness of 0.75 or more. Equal sets are
    one class, and the sets of a band are first held against one of them.

    Band keys (40 bits and a bucket) are packed by bucket with the 64-bit names of
    their sets. Only texts of sets that meet in a key are read again.
    """
    spark = docs.sparkSession
    packed.small_batches(spark)
    source = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    filed = source.mapInArrow(_banded(packed.bucket_count(spark, 1)), FILED)
    found = materialize(filed.groupBy("bucket").applyInArrow(_met, MET), "bands")
    rows = found.where("kind = 1").select(F.col("key").alias("doc_id"), "set", "size")
    sets = rows.groupBy("set").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("size").alias("size")
    )
    sets = materialize(sets, "sets")
    keys = found.where("kind = 0").select("key", "set").distinct().join(sets, "set")
    keys = materialize(keys.select("key", "set", "size", F.lit(0).alias("place"), "least"), "keys")
    texts = _texts_of(source, keys.select(F.col("least").alias("doc_id")))
    known = texts.groupBy("set").agg(F.min(F.struct("row", "size", "sketch")).alias("t")).select("set", "t.*")
    known = materialize(known.withColumn("shared", F.col("size")), "sketches")
    roots = connected(linking_pairs(keys.drop("least"), known, _alike(texts), SKETCH))
    groups = sets.join(roots.withColumnRenamed("node", "set"), "set", "left")
    linked = F.col("root").isNotNull() | (F.col("n") > 1)
    groups = groups.where(linked).withColumn("root", F.coalesce("root", "set"))
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(groups.join(least, "root"), "set").select("doc_id", "component_id")


def with_classes(docs: DataFrame) -> DataFrame:
    """``fingerprints`` with ``component_id``: the smallest id of the near copies and
    equal sets of every document in the whole table, its own id if it has none. Of
    several texts under one id the smallest counts; without an id it is NULL."""
    return fingerprints(docs, near_classes(docs))
