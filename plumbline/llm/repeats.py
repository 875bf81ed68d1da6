"""Windows of consecutive tokens that also start in an earlier document.

Shared by the two passage removers, which differ in their tokens (words or
bytes) and in how they compare contexts. The steps, for windows of W tokens:

1. Every window is filed under the smallest hash of its k-token grams, so equal
   windows are filed alike. Neighbouring windows filed under one gram form a
   piece, about one for every (W - k) / 2 tokens. A task packs its pieces by
   gram into a few rows for the shuffle.
2. A gram that occurs in one document only is dropped. Pieces with the same
   context (gram, length and hash of all tokens the windows cover) as a smaller
   document's are repeats as a whole. Where a gram has several contexts, the
   smallest document of each is asked for its tokens.
3. The tokens that were asked for are cut from the documents and compared,
   gram by gram. A gram with very many contexts is split into single windows,
   filed under their own hash, so no gram is bound to one task.
4. The marked windows go back to their documents.

Every step is a shuffle over packed rows; nothing passes through the driver.
Rows of a repeated doc_id are told apart by a checksum of their text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import packed
from plumbline.plans.session import materialize

#: Bytes of text for every bucket and block.
BUCKET_BYTES = 8 << 20
#: Windows of a piece at most: bounds the contexts.
LONGEST = 256
#: Contexts of one gram that are compared together; beyond it they are split.
TOGETHER = 4096

PIECES = "bucket int, gram binary, context binary, doc binary, crc binary, at binary, size binary"
FOUND = "kind int, block int, doc binary, crc binary, at binary, size binary, gram binary"
CONTEXTS = "bucket int, doc binary, crc binary, at binary, length binary, gram binary, tokens binary"

#: compare(tokens, starts, lengths, docs, groups, window) marks window starts.
Compare = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def checksums(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    view = memoryview(data)
    return np.array([zlib.crc32(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], np.uint32)


class Bytes:
    """Tokens are the bytes of the text."""

    dtype = np.dtype(np.uint8)

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return data, offsets

    @staticmethod
    def values(tokens: np.ndarray) -> np.ndarray:
        return packed.BYTE_VALUES[tokens]


class Words:
    """Tokens are hashes of the words, as ``words_of`` finds them."""

    dtype = np.dtype(np.uint64)

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high, at = packed.words_of(data, offsets)
        return packed.word_hashes(data, low, high), at

    @staticmethod
    def values(tokens: np.ndarray) -> np.ndarray:
        return tokens


def pieces(values: np.ndarray, offsets: np.ndarray, window: int, k: int):
    """Gram, context, first window and number of windows of every piece."""
    n = len(values) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    rolling = packed.Rolling(values)
    least = packed.sliding_min(rolling.grams(k), window - k + 1)
    change = np.zeros(n + 1, np.int32)
    lasts = offsets[1:] - window + 1
    fits = lasts > offsets[:-1]
    np.add.at(change, offsets[:-1][fits], 1)
    np.add.at(change, lasts[fits], -1)
    inside = np.cumsum(change[:-1]) > 0
    edge = np.ones(n, bool)
    edge[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    starts_doc = offsets[:-1][fits]
    edge[starts_doc] = True
    at = np.flatnonzero(edge)
    size = np.diff(np.append(at, n))
    keep = inside[at]
    at, size = at[keep], size[keep]
    if len(size) and size.max() > LONGEST:
        parts = -(-size // LONGEST)
        first = np.repeat(at, parts)
        step = packed.ragged(np.zeros(len(parts), np.int64), parts) * LONGEST
        size = np.minimum(np.repeat(size, parts) - step, LONGEST)
        at = first + step
    return least[at], rolling.spans(at, at + size + window - 1), at, size


def _filed(tokens, window: int, k: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = packed.Held(["gram", "context", "doc", "crc", "at", "size"])

        def flush() -> pa.RecordBatch:
            got = held.take()
            return packed.rows_by_bucket(
                packed.place(got["gram"], buckets),
                buckets,
                {
                    "gram": packed.to_bytes(got["gram"], 5),
                    "context": packed.to_bytes(got["context"], 6),
                    "doc": got["doc"],
                    "crc": got["crc"],
                    "at": got["at"].astype(np.uint32),
                    "size": got["size"].astype(np.uint16),
                },
            )

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = packed.utf8(batch.column(1))
            for low, high in packed.groups_of(offsets, packed.CHUNK):
                part = data[offsets[low] : offsets[high]]
                ends = offsets[low : high + 1] - offsets[low]
                crc = checksums(part, ends)
                values, bounds = tokens.of(part, ends)
                # A long text goes on in overlapping stretches of windows.
                for begin in range(0, max(1, len(values)), packed.CHUNK):
                    if begin and len(values) - begin < window:
                        break
                    stretch = values[begin : begin + packed.CHUNK + window - 1]
                    limits = np.clip(bounds - begin, 0, len(stretch))
                    gram, context, at, size = pieces(tokens.values(stretch), limits, window, k)
                    if not len(gram):
                        continue
                    row = np.searchsorted(limits, at, "right") - 1
                    held.add(
                        gram=gram,
                        context=context,
                        doc=ids[low:high].astype(np.int64)[row],
                        crc=crc[row],
                        at=at + begin - bounds[row],
                        size=size,
                    )
                    if held.size >= packed.FLUSH:
                        yield flush()
        if held.size:
            yield flush()
        packed.release()

    return run


def _decided(blocks: int):
    """Whole-piece repeats (kind 0) and requests for tokens (kind 1, 2 if many)."""

    def run(table: pa.Table) -> pa.Table:
        gram = packed.from_bytes(packed.joined(table["gram"]), 5)
        context = packed.from_bytes(packed.joined(table["context"]), 6)
        doc = packed.joined(table["doc"]).view(np.int64)
        crc = packed.joined(table["crc"]).view(np.uint32)
        at = packed.joined(table["at"]).view(np.uint32)
        size = packed.joined(table["size"]).view(np.uint16)
        order = np.argsort(gram, kind="stable")
        same = gram[order][1:] == gram[order][:-1]
        other = np.zeros(len(order), bool)
        other[1:] = same
        other[:-1] |= same
        order = order[other]
        inner = np.lexsort((at[order], doc[order], context[order], gram[order]))
        order = order[inner]
        g, c, d, z, p, s = (x[order] for x in (gram, context, doc, crc, at, size))
        if not len(g):
            return _found([], blocks)
        new_gram = np.append(True, g[1:] != g[:-1])
        new_context = new_gram | np.append(True, c[1:] != c[:-1])
        gram_at = np.flatnonzero(new_gram)
        several_docs = np.minimum.reduceat(d, gram_at) != np.maximum.reduceat(d, gram_at)
        contexts = np.add.reduceat(new_context.astype(np.int64), gram_at)
        lengths = np.diff(np.append(gram_at, len(g)))
        live, many = np.repeat(several_docs, lengths), np.repeat(contexts, lengths)
        context_at = np.flatnonzero(new_context)
        smallest = np.repeat(d[context_at], np.diff(np.append(context_at, len(g))))
        repeat = live & (d > smallest)
        # All rows of the smallest document that hold the context, as it may
        # stand at several places of it.
        ask = live & (d == smallest) & (many > 1)
        parts = []
        for kind, rows in ((0, repeat), (1, ask & (many <= TOGETHER)), (2, ask & (many > TOGETHER))):
            parts.append((kind, d[rows], z[rows], p[rows], s[rows], g[rows]))
        return _found(parts, blocks)

    return run


def _found(parts, blocks: int) -> pa.Table:
    batches = []
    for kind, doc, crc, at, size, gram in parts:
        if not len(doc):
            continue
        batch = packed.rows_by_bucket(
            packed.block_of_ids(doc, blocks),
            blocks,
            {
                "doc": doc,
                "crc": crc,
                "at": at,
                "size": size,
                "gram": gram if kind else np.empty((len(doc), 0), np.uint8),
            },
            "block",
        )
        kinds = pa.array(np.full(batch.num_rows, kind, np.int32))
        batches.append(pa.RecordBatch.from_arrays([kinds, *batch.columns], names=["kind", *batch.schema.names]))
    schema = pa.schema(
        [("kind", pa.int32()), ("block", pa.int32())] + [(n, pa.binary()) for n in ("doc", "crc", "at", "size", "gram")]
    )
    return pa.Table.from_batches([b.cast(schema) for b in batches], schema) if batches else schema.empty_table()


def _of_rows(docs: pa.Table, doc: np.ndarray, crc: np.ndarray, key: str, text: str):
    """The row of ``docs`` that each record belongs to, with the rows' bytes."""
    ids = docs[key].to_numpy()
    ids = np.nan_to_num(ids.astype(np.float64), nan=-1).astype(np.int64) if ids.dtype.kind == "f" else ids
    data, offsets = packed.utf8(docs[text])
    sums = checksums(data, offsets)
    both = np.rec.fromarrays([ids.astype(np.int64), sums])
    order = np.argsort(both, order=["f0", "f1"], kind="stable")
    at = np.searchsorted(both[order], np.rec.fromarrays([doc, crc.astype(np.uint32)]))
    return order, at, data, offsets


def _cut(tokens, window: int, buckets: int):
    """Cuts the requested contexts from a block of documents."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema(
            [("bucket", pa.int32())]
            + [(n, pa.binary()) for n in ("doc", "crc", "at", "length", "gram", "tokens")]
        )
        if not asked.num_rows or not docs.num_rows:
            return schema.empty_table()
        kinds = np.repeat(asked["kind"].to_numpy(), packed.counts(asked["doc"], 8))
        doc = packed.joined(asked["doc"]).view(np.int64)
        crc = packed.joined(asked["crc"]).view(np.uint32)
        at = packed.joined(asked["at"]).view(np.uint32).astype(np.int64)
        size = packed.joined(asked["size"]).view(np.uint16).astype(np.int64)
        gram = packed.joined(asked["gram"]).view(np.uint64)
        order, row, data, offsets = _of_rows(docs, doc, crc, "doc_id", "text")
        row = order[row]
        batches = []
        by_row = np.argsort(row, kind="stable")
        row_sorted = row[by_row]
        for low, high in packed.groups_of(offsets, 8 * packed.CHUNK):
            picked = by_row[np.searchsorted(row_sorted, low) : np.searchsorted(row_sorted, high)]
            if not len(picked):
                continue
            values, bounds = tokens.of(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            starts = bounds[row[picked] - low] + at[picked]
            sizes, grams, whole = size[picked], gram[picked], picked
            many = kinds[picked] == 2
            if many.any():
                single = packed.ragged(starts[many], sizes[many])
                own = packed.Rolling(tokens.values(values)).spans(single, single + window)
                whole = np.concatenate([picked[~many], np.repeat(picked[many], sizes[many])])
                shift = packed.ragged(np.zeros(many.sum(), np.int64), sizes[many])
                places = np.concatenate([at[picked[~many]], at[np.repeat(picked[many], sizes[many])] + shift])
                starts = np.concatenate([starts[~many], single])
                grams = np.concatenate([grams[~many], own])
                sizes = np.concatenate([sizes[~many], np.ones(len(single), np.int64)])
            else:
                places = at[picked]
            lengths = sizes + window - 1
            bucket = packed.place(packed.mix(grams.copy()), buckets)
            by = np.argsort(bucket, kind="stable")
            starts, lengths, grams, whole, places, bucket = (
                x[by] for x in (starts, lengths, grams, whole, places, bucket)
            )
            cut = values[packed.ragged(starts, lengths)]
            batch = packed.rows_by_bucket(
                bucket,
                buckets,
                {
                    "doc": doc[whole],
                    "crc": crc[whole],
                    "at": places.astype(np.uint32),
                    "length": lengths.astype(np.uint16),
                    "gram": grams,
                },
            )
            ends = np.cumsum(lengths)
            last = np.searchsorted(bucket, batch.column(0).to_numpy(), "right")
            limits = np.append(0, ends[last - 1]) * tokens.dtype.itemsize
            body = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(),
                batch.num_rows,
                [None, pa.py_buffer(limits.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(cut).view(np.uint8))],
            ).cast(pa.binary())
            batches.append(pa.RecordBatch.from_arrays([*batch.columns, body], schema=schema))
        return pa.Table.from_batches(batches, schema)

    return run


def _compared(tokens, window: int, blocks: int, compare: Compare):
    def run(table: pa.Table) -> pa.Table:
        doc = packed.joined(table["doc"]).view(np.int64)
        crc = packed.joined(table["crc"]).view(np.uint32)
        at = packed.joined(table["at"]).view(np.uint32)
        length = packed.joined(table["length"]).view(np.uint16).astype(np.int64)
        gram = packed.joined(table["gram"]).view(np.uint64)
        body = packed.joined(table["tokens"]).view(tokens.dtype)
        starts = np.cumsum(length) - length
        order = np.argsort(gram, kind="stable")
        marks = []
        cuts = np.flatnonzero(np.append(True, gram[order][1:] != gram[order][:-1]))
        sizes = np.add.reduceat(length[order], cuts)
        # Whole grams together, about a megabyte of tokens at a time.
        batch = np.cumsum(sizes) // (1 << 20)
        for number in np.unique(batch):
            held = np.flatnonzero(batch == number)
            last = cuts[held[-1] + 1] if held[-1] + 1 < len(cuts) else len(order)
            picked = order[cuts[held[0]] : last]
            lengths = length[picked]
            text = body[packed.ragged(starts[picked], lengths)]
            begins = np.cumsum(lengths) - lengths
            windows = compare(text, begins, lengths, doc[picked], gram[picked], window)
            which = np.searchsorted(begins, windows, "right") - 1
            offset = windows - begins[which]
            new = np.append(True, (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1)) if len(which) else which
            heads = np.flatnonzero(new)
            runs = np.diff(np.append(heads, len(which)))
            source = picked[which[heads]]
            marks.append((doc[source], crc[source], at[source] + offset[heads].astype(np.uint32), runs.astype(np.uint16)))
        d, z, p, s = (np.concatenate(x) for x in zip(*marks))
        return _found([(0, d, z, p, s, None)], blocks)

    return run


def marked_windows(docs: DataFrame, tokens, window: int, k: int, compare: Compare) -> tuple[DataFrame, DataFrame]:
    """The documents by block and, packed by block, the windows to remove.

    ``docs`` has ``doc_id`` and ``text`` first; rows with a NULL id take no part.
    """
    spark = docs.sparkSession
    packed.small_batches(spark)
    source = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Buckets hold as much whatever the size of the input, and have a partition each.
    buckets = blocks = max(packed.bucket_count(spark), -(-size // BUCKET_BYTES))
    filed = source.mapInArrow(_filed(tokens, window, k, buckets), PIECES).repartition(buckets, "bucket")
    found = filed.groupBy("bucket").applyInArrow(_decided(blocks), FOUND)
    found = materialize(found, "repeats")
    placed = packed.with_block(docs, blocks).repartition(blocks, "__block")
    asked = found.where("kind > 0").withColumnRenamed("block", "__block").repartition(blocks, "__block")
    cut = (
        placed.where(F.col("doc_id").isNotNull())
        .groupBy("__block")
        .cogroup(asked.groupBy("__block"))
        .applyInArrow(_cut(tokens, window, buckets), CONTEXTS)
    )
    more = cut.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_compared(tokens, window, blocks, compare), FOUND)
    whole = found.where("kind = 0").unionAll(more).select(F.col("block").alias("__block"), "doc", "crc", "at", "size")
    return placed, whole.repartition(blocks, "__block")


def covered(docs: pa.Table, marks: pa.Table, offsets_of, window: int):
    """For a block: which tokens of the concatenated rows are removed.

    ``offsets_of(data, offsets)`` gives the rows' token offsets.
    """
    data, offsets = packed.utf8(docs["text"])
    bounds = offsets_of(data, offsets)
    gone = np.zeros(int(bounds[-1]) + 1, np.int32)
    if marks.num_rows and docs.num_rows:
        doc = packed.joined(marks["doc"]).view(np.int64)
        crc = packed.joined(marks["crc"]).view(np.uint32)
        at = packed.joined(marks["at"]).view(np.uint32).astype(np.int64)
        size = packed.joined(marks["size"]).view(np.uint16).astype(np.int64)
        order, first, _, _ = _of_rows(docs, doc, crc, "doc_id", "text")
        ids = docs["doc_id"].to_numpy()
        # Equal rows share their marks.
        sums = checksums(data, offsets)
        more = np.arange(len(doc))
        rows = first
        while len(more):
            begin = bounds[order[rows]] + at[more]
            np.add.at(gone, begin, 1)
            np.add.at(gone, begin + size[more] + window - 1, -1)
            following = rows + 1
            ok = following < len(order)
            more, following, rows = more[ok], following[ok], rows[ok]
            a, b = order[rows], order[following]
            twin = (ids[a] == ids[b]) & (sums[a] == sums[b])
            more, rows = more[twin], following[twin]
    return data, offsets, bounds, np.cumsum(gone[:-1]) > 0
