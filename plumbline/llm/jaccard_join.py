"""Size-aware heavy-light join of documents by the Jaccard likeness of their word
shingles (operator 10).

The join works on distinct sets; documents with one set are its members.

* A task hashes the shingles of its documents and packs them by shingle. A
  shingle of one set only can't support a link, so the reducer returns only the
  others, with the number of sets that hold them. A set needs three quarters of
  its shingles among those, or it is done.
* Light sets (few shingles) are joined on hashes of their fixed-size subsets:
  two small sets that link share a subset as large as the overlap they need.
* Heavy sets scan inverted lists. With the shingles ordered from rare to
  frequent, sets that link share one of the first quarter of their shingles.
* The boundary is the size at which enumerating subsets stops being cheaper than
  the lists that those sets would scan.
* The smallest set of a key is its centre, and every set is first held against one
  of its centres, so that a large group of near copies costs as many checks as it
  has sets. Of the pairs that the links found so far leave apart, one in 64 is
  checked, then all that are still apart, where sizes, positions and the sets'
  parity sketches (whose distance is at most that of the sets) allow the overlap.

Sets are known by 64-bit hashes and shingles by 40 bits and a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import packed
from plumbline.llm.components import connected
from plumbline.plans.session import materialize

SHINGLE = 5
#: Link at 100 * intersection >= LIKE * union.
LIKE = 75
#: The boundary between light and heavy sets lies between 0 and this size.
LARGEST_LIGHT = 12
#: The first pass over pairs takes one of so many, chosen by hash.
PASSES = (64, 1)
#: Bits of the parity sketch of a set, in words of 64.
SKETCH = 8

FILED = "bucket int, shingle binary, set binary, size binary, count binary, doc binary, doc_set binary, doc_size binary"
SHARED = "kind int, bucket int, block int, shingle binary, share binary, set binary, size binary, count binary"
KEYS = (
    "kind int, key long, set long, size int, place int, cost double, shingles array<bigint>, sketch array<bigint>"
)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def need(n: int | np.ndarray, m: int | np.ndarray):
    """The least intersection of linked sets of sizes ``n`` and ``m``."""
    return -(-(LIKE * (n + m)) // (100 + LIKE))


def least_overlap(n):
    """The least intersection of a set of ``n`` with any set that it links to."""
    return -(-(LIKE * n) // 100)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE):
    """Row and hash of every distinct shingle, in order, and the size of each row's set."""
    data = LOWER[data]
    low, high, at = packed.words_of(data, offsets)
    rolling = packed.Rolling(packed.word_hashes(data, low, high))
    words = np.diff(at)
    number = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    starts = packed.ragged(at[:-1], number)
    row = np.repeat(np.arange(len(words)), number)
    hashes = rolling.spans(starts, np.minimum(starts + shingle, at[1:][row]))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    keep = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])) if len(row) else np.empty(0, bool)
    row, hashes = row[keep], hashes[keep]
    return row, hashes, np.bincount(row, minlength=len(words))


def _entries(head: np.ndarray) -> np.ndarray:
    """Where the entries of a list begin: with every set, and again after 255 of its
    shingles, as their number takes one byte."""
    first = np.flatnonzero(head)
    place = np.arange(len(head)) - np.repeat(first, np.diff(np.append(first, len(head))))
    return np.flatnonzero(place % 255 == 0)


def _filed(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = packed.Held(["shingle", "set", "size"])
        members = packed.Held(["doc", "set", "size"])
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            got, who = held.take(), members.take()
            bucket = packed.place(got["shingle"], buckets).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint32), kind="stable")
            bucket, sets, sizes = bucket[order], got["set"][order], got["size"][order]
            # Each bucket lists its sets, with the number of their shingles.
            head = np.append(True, (sets[1:] != sets[:-1]) | (bucket[1:] != bucket[:-1])) if len(sets) else np.empty(0, bool)
            first = _entries(head)
            lists = packed.rows_by_bucket(
                bucket[first],
                buckets,
                {
                    "set": sets[first],
                    "size": sizes[first].astype(np.uint32),
                    "count": np.diff(np.append(first, len(sets))).astype(np.uint8),
                },
            )
            values = packed.rows_by_bucket(bucket, buckets, {"shingle": packed.to_bytes(got["shingle"][order], 5)})
            empty = pa.array([b""] * lists.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [lists.column(0), values.column(1), *lists.columns[1:], empty, empty, empty], names=NAMES
            )
            if len(who["doc"]):
                place = packed.block_of_ids(who["doc"], buckets)
                batch = packed.rows_by_bucket(
                    place, buckets, {"doc": who["doc"], "set": who["set"], "size": who["size"].astype(np.uint32)}
                )
                empty = pa.array([b""] * batch.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), empty, empty, empty, empty, *batch.columns[1:]], names=NAMES
                )

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = packed.utf8(batch.column(1))
            for low, high in packed.groups_of(offsets, packed.CHUNK):
                row, hashes, size = shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                total = np.zeros(high - low, np.uint64)
                np.add.at(total, row, packed.mix(hashes.copy()))
                name = packed.mix(total + size.astype(np.uint64))
                name[size == 0] = 0
                members.add(doc=ids[low:high], set=name, size=size)
                # A task files each set once.
                new = np.zeros(high - low, bool)
                for i, key in enumerate(name.tolist()):
                    if size[i] and key not in seen:
                        seen.add(key)
                        new[i] = True
                pick = new[row]
                held.add(shingle=hashes[pick], set=name[row[pick]], size=size[row[pick]])
                if held.size >= packed.FLUSH:
                    yield from flush()
        if members.size:
            yield from flush()
        packed.release()

    return run


NAMES = ["bucket", "shingle", "set", "size", "count", "doc", "doc_set", "doc_size"]
SHARED_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32())]
    + [(n, pa.binary()) for n in ("shingle", "share", "set", "size", "count")]
)


def _shared(blocks: int):
    """Shingles of several sets, sent on to their sets (kind 0); members (kind 1)."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        bucket = table["bucket"][0].as_py()
        doc = packed.joined(table["doc"])
        if len(doc):
            rows = [pa.array([1], pa.int32()), pa.array([bucket], pa.int32()), pa.array([0], pa.int32())]
            blobs = [doc, b"", packed.joined(table["doc_set"]), packed.joined(table["doc_size"]), b""]
            out.append(pa.RecordBatch.from_arrays(rows + [pa.array([bytes(b)], pa.binary()) for b in blobs], schema=SHARED_SCHEMA))
        shingle = packed.from_bytes(packed.joined(table["shingle"]), 5)
        count = packed.joined(table["count"])
        sets = np.repeat(packed.joined(table["set"]).view(np.uint64), count)
        sizes = np.repeat(packed.joined(table["size"]).view(np.uint32), count)
        order = np.argsort(shingle, kind="stable")
        s = shingle[order]
        several = np.zeros(len(s), bool)
        several[1:] = s[1:] == s[:-1]
        several[:-1] |= several[1:]
        order = order[several]
        order = order[np.lexsort((sets[order], shingle[order]))]
        s, who, size = shingle[order], sets[order], sizes[order]
        if len(s):
            new = np.append(True, s[1:] != s[:-1])
            keep = new | np.append(True, who[1:] != who[:-1])
            s, who, size, new = s[keep], who[keep], size[keep], new[keep]
            heads = np.flatnonzero(new)
            holders = np.diff(np.append(heads, len(s)))
            holders = np.repeat(holders, holders)
            keep = holders > 1
            s, who, size, holders = s[keep], who[keep], size[keep], holders[keep]
        if len(s):
            # Frequency in one byte: exact up to 128, then by eighths of a power of two.
            share = np.where(holders < 128, holders, np.minimum(255, 72 + np.floor(8 * np.log2(holders)))).astype(np.uint8)
            block = packed.place(who, blocks).astype(np.int64)
            order = np.lexsort((s, who, block))
            s, who, size, share, block = (x[order] for x in (s, who, size, share, block))
            first = _entries(np.append(True, who[1:] != who[:-1]))
            values = packed.rows_by_bucket(block, blocks, {"shingle": packed.to_bytes(s, 5), "share": share}, "block")
            lists = packed.rows_by_bucket(
                block[first],
                blocks,
                {
                    "set": who[first],
                    "size": size[first],
                    "count": np.diff(np.append(first, len(who))).astype(np.uint8),
                },
                "block",
            )
            same = pa.array(np.zeros(values.num_rows, np.int32))
            here = pa.array(np.full(values.num_rows, bucket, np.int32))
            out.append(
                pa.RecordBatch.from_arrays([same, here, *values.columns, *lists.columns[1:]], schema=SHARED_SCHEMA)
            )
        return pa.Table.from_batches(out, SHARED_SCHEMA)

    return run


def _candidates(table: pa.Table) -> pa.Table:
    """Keys of the sets of a block that can have a link.

    kind 0 is the set itself with its shared shingles and, if it is small, the
    cost of its subsets less that of its lists; kind 1 are list keys, kind 2
    subset keys.
    """
    count = packed.counts(table["shingle"], 5)
    low = packed.from_bytes(packed.joined(table["shingle"]), 5)
    high = np.repeat(table["bucket"].to_numpy().astype(np.uint64), count)
    shingle = (low | (high << np.uint64(40))).view(np.int64)
    share = packed.joined(table["share"])
    runs = packed.joined(table["count"])
    sets = np.repeat(packed.joined(table["set"]).view(np.int64), runs)
    sizes = np.repeat(packed.joined(table["size"]).view(np.uint32), runs).astype(np.int64)
    have = np.unique(sets, return_inverse=True, return_counts=True)
    keep = have[2][have[1]] >= least_overlap(sizes)
    sets, sizes, share, shingle = sets[keep], sizes[keep], share[keep], shingle[keep]

    heads = _heads(sets, order := np.lexsort((shingle, sets)))
    size, number = sizes[order][heads], np.diff(np.append(heads, len(order)))
    prefix, unique = size - least_overlap(size) + 1, size - number
    ordered = shingle[order]
    arrays = pa.ListArray.from_arrays(pa.array(np.append(heads, len(order)).astype(np.int32)), pa.array(ordered))
    cell = (packed.mix(ordered.view(np.uint64).copy()) >> np.uint64(55)).astype(np.int64)
    bit = np.uint64(1) << (cell % 64).astype(np.uint64)
    words = [np.bitwise_xor.reduceat(np.where(cell // 64 == w, bit, np.uint64(0)), heads) if len(heads) else bit for w in range(SKETCH)]
    sketch = pa.ListArray.from_arrays(
        pa.array(np.arange(len(heads) + 1, dtype=np.int32) * SKETCH), pa.array(np.stack(words, axis=1).ravel().view(np.int64))
    )

    rare = np.lexsort((shingle, share, sets))
    rank = np.arange(len(rare)) - np.repeat(heads, number)
    listed = rank < np.repeat(prefix - unique, number)
    length = np.exp2(np.maximum(share[rare].astype(float) - 72, 0) / 8) * listed
    cost = -np.add.reduceat(length, heads) if len(heads) else np.empty(0)
    key, who, whose, at = [], [], [], []
    for i in np.flatnonzero(size <= LARGEST_LIGHT):
        own, n = ordered[heads[i] : heads[i] + number[i]].tolist(), int(size[i])
        for label in range(int(least_overlap(n)), n + 1):
            wanted = int(need(label, label))
            cost[i] += comb(len(own), wanted)
            for chosen in combinations(own, wanted):
                key.append(xxhash.xxh64_intdigest(np.array(chosen).tobytes(), seed=label))
                who.append(i)
    who = np.array(who, np.int64)
    places = (rank + np.repeat(unique, number))[listed]
    parts = (
        (0, np.zeros(len(heads), np.int64), sets[order][heads], size, number, cost, arrays, sketch),
        (1, shingle[rare][listed], sets[rare][listed], sizes[rare][listed], places, None, None, None),
        (2, np.array(key, np.uint64).view(np.int64), sets[order][heads][who], size[who], np.zeros(len(who)), None, None, None),
    )
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), *[pa.list_(pa.int64())] * 2]
    names = ["kind", "key", "set", "size", "place", "cost", "shingles", "sketch"]
    out = []
    for kind, *columns in parts:
        n = len(columns[0])
        columns = [np.full(n, kind), *columns]
        arrays = [pa.nulls(n, t) if c is None else pa.array(c).cast(t) for c, t in zip(columns, kinds)]
        out.append(pa.Table.from_arrays(arrays, names=names))
    return pa.concat_tables(out)


def _heads(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    v = values[order]
    return np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.empty(0, np.int64)


def _overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) that link, by their shared shingles."""
    left = sets.select(F.col("set").alias("a"), F.col("size").alias("n"), F.col("shingles").alias("x"))
    right = sets.select(F.col("set").alias("b"), F.col("size").alias("m"), F.col("shingles").alias("y"))
    joined = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    return joined.where(common * 100 >= F.lit(LIKE) * (F.col("n") + F.col("m") - common)).select("a", "b")


def _fits(n, m, i, j):
    """Size and position allow the overlap that a link needs."""
    wanted = F.ceil(F.lit(LIKE) * (n + m) / F.lit(100.0 + LIKE))
    return F.least(n - i, m - j) >= wanted


def _apart(keys: DataFrame, links: DataFrame) -> DataFrame:
    """The sets of the keys that hold several components, with their roots.
    Small tables are written so that the join of a hot key can be split."""
    roots = materialize(connected(links), "roots").withColumnRenamed("node", "set")
    rest = keys.drop("root").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    rest = materialize(rest, "keys")
    spread = rest.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    spread = materialize(spread.where("lo != hi").select("key"), "open")
    return materialize(rest.join(spread, "key"), "keys")


def linking_pairs(
    keys: DataFrame,
    sets: DataFrame,
    overlap: Callable[[DataFrame, DataFrame], DataFrame] = _overlap,
    words: int = SKETCH,
) -> DataFrame:
    """Links that connect what all links of the sets under each key would connect.

    ``keys`` has ``key, set, size, place``; ``sets`` has ``set, size``, ``shared``
    (shingles that others may have), ``sketch`` of so many ``words`` and what ``overlap`` reads to tell
    which pairs link: ``shingles``, unless another is given.
    """
    centre = materialize(keys.groupBy("key").agg(F.min(F.struct("set", "size", "place")).alias("c")), "centres")
    met = keys.join(centre, "key").where(F.col("c.set") != F.col("set"))
    met = met.where(_fits(F.col("size"), F.col("c.size"), F.col("place"), F.col("c.place")))
    # Of a set's centres, the one that it shares most keys with.
    votes = met.groupBy("set", F.col("c.set").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("set").agg(F.max(F.struct("n", F.bitwise_not("a").alias("a"))).alias("best"))
    pairs = best.select(F.bitwise_not("best.a").alias("a"), F.col("set").alias("b"))
    links = materialize(overlap(pairs, sets), "links")
    keys = _apart(keys, links)
    if keys.isEmpty():
        return links
    sets = materialize(sets.join(keys.select("set").distinct(), "set"), "apart")
    known = sets.select("set", "shared", "sketch")
    for one_of in PASSES:
        full = keys.join(known, "set")
        names = ("set", "size", "place", "root", "shared", "sketch")
        other = full.select("key", *[F.col(c).alias(f"{c}2") for c in names])
        chosen = F.pmod(F.xxhash64("set", "set2"), F.lit(one_of)) == 0
        apart = (F.col("set") < F.col("set2")) & (F.col("root") != F.col("root2")) & chosen
        fits = _fits(F.col("size"), F.col("size2"), F.col("place"), F.col("place2"))
        both = F.col("size") + F.col("size2")
        wanted = F.ceil(F.lit(LIKE) * both / F.lit(100.0 + LIKE))
        distance = both - F.col("shared") - F.col("shared2")
        for i in range(words):
            distance += F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch2")[i]))
        close = distance <= both - 2 * wanted
        pairs = full.join(other, "key").where(apart & fits & close)
        pairs = pairs.select(F.col("set").alias("a"), F.col("set2").alias("b")).distinct()
        links = materialize(links.unionByName(overlap(pairs, sets)), "links")
        if one_of > 1:
            keys = _apart(keys, links)
            if keys.isEmpty():
                break
    return links


def boundary(sets: DataFrame) -> int:
    """The largest light size: where the summed cost of subsets, less that of the
    lists they spare, is lowest. Reads one row per light size."""
    costs = sets.where(F.col("size") <= LARGEST_LIGHT).groupBy("size").agg(F.sum("cost").alias("cost"))
    best, least, total = 0, 0.0, 0.0
    for row in sorted(costs.collect()):
        total += row["cost"]
        if total < least:
            best, least = row["size"], total
    return best


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Words are as in the contract of the query; a text of fewer than five words is
    one shingle, one without words (or NULL) has an empty set, links to nothing
    and is its own component. Rows of one ``doc_id`` count as one node each with
    the same id. A NULL ``doc_id`` has size and component NULL. An empty table
    gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    packed.small_batches(spark)
    # More buckets would repeat the names of sets more often, up to once for each shingle.
    buckets, blocks = packed.bucket_count(spark, 1), packed.bucket_count(spark, 1)
    source = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    filed = source.mapInArrow(_filed(buckets), FILED)
    shared = materialize(filed.groupBy("bucket").applyInArrow(_shared(blocks), SHARED), "shared")
    found = shared.where("kind = 0").groupBy("block").applyInArrow(_candidates, KEYS)
    found = materialize(found, "candidates")
    sets = found.where("kind = 0").select("set", "size", "cost", "shingles", F.col("place").alias("shared"), "sketch")
    light = boundary(sets)
    # Lists serve pairs with a heavy set; a light set joins them if it is large
    # enough to link to a heavy one.
    lists = found.where("kind = 1").where(F.col("size") >= F.lit(LIKE * (light + 1) / 100.0))
    subsets = found.where("kind = 2").where(F.col("size") <= light)
    subsets = subsets.withColumn("key", F.xxhash64("key", F.lit("subset")))
    keys = lists.unionByName(subsets).select("key", "set", "size", "place")
    roots = connected(linking_pairs(keys, sets))

    members = shared.where("kind = 1").select(
        F.col("shingle").alias("doc"), "set", "size"
    ).mapInArrow(_members, "doc_id long, set long, n_shingles long")
    empty = F.col("n_shingles") == 0
    named = members.where(~empty)
    groups = named.groupBy("set").agg(F.min("doc_id").alias("least"))
    groups = groups.join(roots.withColumnRenamed("node", "set"), "set", "left")
    groups = groups.withColumn("root", F.coalesce("root", "set"))
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    component = groups.join(least, "root").select("set", "component_id")
    out = named.join(component, "set").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(members.where(empty).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    nameless = docs.where(F.col("doc_id").isNull())
    none = F.lit(None).cast("long")
    return out.unionByName(nameless.select(none.alias("doc_id"), none.alias("n_shingles"), none.alias("component_id")))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, sets, size = (packed.joined(batch.column(i)) for i in range(3))
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc.view(np.int64)), pa.array(sets.view(np.int64)), pa.array(size.view(np.uint32).astype(np.int64))],
            names=["doc_id", "set", "n_shingles"],
        )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that link, over any path, to a row of a smaller
    ``doc_id``; rows without an id or without words stay. Columns are unchanged."""
    verdict = classes(docs.select("doc_id", "text"))
    gone = verdict.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
