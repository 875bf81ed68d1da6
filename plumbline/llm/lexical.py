"""Ranked lexical search over K2-treaps of the term-document grid (operator 11).

The index has one row per block of documents. A block's grid has a row for each of
its terms (frequent ones first) and a column for each document (by id); a cell
holds the impact of the term in the document, before the term's weight. Bands of
as many rows as columns are squares, and each is a quadtree: a cell with several
entries has a byte that tells its quarters (four bits for those with an entry, four
for those with just one) and the greatest impact below. A quarter with one entry
ends there, so that chains of cells are compressed away.

A search holds ranges of documents. For each range and each term of the item it
knows the cell on the term's row path, and the weighted maxima of these cells bound
the score of every document of the range. The best ranges are halved first, all row
paths going down together; when they have come down to documents, their scores are
the threshold for the others.

Terms are compared by 48 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm import packed
from plumbline.plans.session import new_folder

TOP = 50
#: Terms (with repeats) and documents of a block, about.
BLOCK_TERMS, BLOCK_DOCS = 1 << 20, 1 << 16
#: Items that are searched together.
PORTION = 256
#: Ranges that go down first.
BEAM = 64
#: Bytes of a row group of the index: bounds what its writers and readers hold, a block at least.
ROW_GROUP = 16 << 20

#: Lower case for A-Z, blanks for what separates terms.
TERM_BYTES = np.arange(256, dtype=np.uint8)
TERM_BYTES[65:91] += 32
TERM_BYTES[[b for b in range(128) if not chr(b).isalnum()]] = 32

_POPULATION = np.array([bin(b).count("1") for b in range(16)], np.int64)
#: Quarters before each quarter, as a mask.
_BEFORE = np.array([0, 1, 3, 7], np.uint8)

#: Arrays of an index row and their bytes a value.
ARRAYS = {
    "doc_ids": 8, "terms": 6, "term_rows": 4, "documents_of_terms": 4, "sizes": 4, "quarters": 1, "maxima": 3,
    "entry_impacts": 3, "entry_rows": 4, "entry_columns": 2,
}
INDEX = "documents int, " + ", ".join(f"{n} binary" for n in ARRAYS)
_INDEX_SCHEMA = pa.schema([("documents", pa.int32())] + [(n, pa.binary()) for n in ARRAYS])


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes, first all lowest ones and so on: small values compress well."""
    return np.ascontiguousarray(packed.to_bytes(values.astype(np.uint64), width).T).tobytes()


def from_planes(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros(raw.shape[1], np.int64)
    for i in range(width):
        out |= raw[i].astype(np.int64) << (8 * i)
    return out


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 16-bit numbers at the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of the terms of all rows, and the rows' bounds."""
    plain = TERM_BYTES[data]
    low, high, bounds = packed.words_of(plain, offsets)
    return packed.word_hashes(plain, low, high) & np.uint64((1 << 48) - 1), bounds


def build(ids: np.ndarray, terms: np.ndarray, bounds: np.ndarray, total_docs: int, total_terms: int) -> dict:
    """The index row of a block of documents that have a term each."""
    by_id = np.argsort(ids, kind="stable")
    column = np.empty(len(ids), np.int64)
    column[by_id] = np.arange(len(ids))
    lengths = np.diff(bounds)
    names, of = np.unique(terms, return_inverse=True)
    width = max(1, int(len(ids) - 1).bit_length())
    cells, tf = np.unique((of << 16) | np.repeat(column, lengths), return_counts=True)
    term, doc = cells >> 16, cells & 0xFFFF
    documents = np.bincount(term, minlength=len(names))
    row_of = np.empty(len(names), np.int64)
    row_of[np.argsort(-documents, kind="stable")] = np.arange(len(names))
    norm = np.array([100 - 50 + 50 * int(n) * total_docs // total_terms for n in lengths[by_id]], np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * norm[doc])
    row = row_of[term]
    code = (
        ((row >> width).astype(np.uint64) << np.uint64(2 * width))
        | (_spread(row & ((1 << width) - 1)) << np.uint64(1))
        | _spread(doc)
    )
    order = np.argsort(code)
    code, impact, row, doc = code[order], impact[order], row[order], doc[order]
    # Level by level: cells with several entries go on, single entries end.
    alive = np.arange(len(code))
    heads = np.flatnonzero(np.append(True, np.diff(code >> np.uint64(2 * width)) > 0))
    sizes, quarters, maxima, entries = [], [], [], []
    for level in range(width):
        nodes = len(heads)
        sizes.append(nodes)
        maxima.append(np.maximum.reduceat(impact[alive], heads) if nodes else heads)
        node = np.repeat(np.arange(nodes), np.diff(np.append(heads, len(alive))))
        child = code[alive] >> np.uint64(2 * (width - level - 1))
        first = np.flatnonzero(np.append(True, child[1:] != child[:-1])) if len(child) else heads
        count = np.diff(np.append(first, len(alive)))
        bit = np.left_shift(1, (child[first] & np.uint64(3)).astype(np.int64))
        single = count == 1
        parent = node[first]
        marks = np.bincount(parent, bit, nodes) + 16 * np.bincount(parent[single], bit[single], nodes)
        quarters.append(marks.astype(np.uint8))
        entries.append(alive[first[single]])
        alive = alive[np.repeat(~single, count)]
        heads = np.cumsum(count[~single]) - count[~single]
    entry = np.concatenate(entries)
    arrays = {
        "doc_ids": np.asarray(ids, np.int64)[by_id],
        "terms": names, "term_rows": row_of, "documents_of_terms": documents,
        "sizes": np.array(sizes), "quarters": np.concatenate(quarters), "maxima": np.concatenate(maxima),
        "entry_impacts": impact[entry], "entry_rows": row[entry], "entry_columns": doc[entry],
    }
    return {"documents": len(ids)} | {n: planes(x, ARRAYS[n]) for n, x in arrays.items()}


class Block:
    """An index row, opened for searching."""

    def __init__(self, row: dict):
        self.terms = from_planes(row["terms"], ARRAYS["terms"])
        self.rows = from_planes(row["term_rows"], ARRAYS["term_rows"])
        self.row = row

    def found(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``terms`` the block has, and their places among its terms."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        have = self.terms[at] == terms
        return have, at[have]

    def frequencies(self) -> np.ndarray:
        return from_planes(self.row["documents_of_terms"], ARRAYS["documents_of_terms"])

    def open(self) -> None:
        width = {n: from_planes(self.row[n], ARRAYS[n]) for n in ARRAYS if n not in ("terms", "term_rows")}
        self.doc_ids, self.impacts = width["doc_ids"], width["entry_impacts"]
        self.entry_rows, self.columns = width["entry_rows"], width["entry_columns"]
        limits = np.cumsum(width["sizes"])
        self.depth = len(limits)
        self.marks = np.split(width["quarters"].astype(np.uint8), limits[:-1])
        self.maxima = [*np.split(width["maxima"], limits[:-1]), np.empty(0, np.int64)]
        self.inner, self.single, base = [], [], 0
        for marks in self.marks:
            singles, all_ = _POPULATION[marks >> 4], _POPULATION[marks & 15]
            inner = all_ - singles
            self.inner.append(np.cumsum(inner) - inner)
            self.single.append(np.cumsum(singles) - singles + base)
            base += int(singles.sum())

    def halve(self, level: int, ranges: np.ndarray, cells: np.ndarray, rows: np.ndarray):
        """Both halves of every range and, for each term, the cell there: a cell of
        the next level, -2 - e for the single entry e, -1 for none."""
        up = self.depth - 1 - level
        marks = self.marks[level]
        inside = cells >= 0
        node = np.where(inside, cells, 0)
        byte = marks[node]
        have, alone = byte & 15, byte >> 4
        entry = np.where(cells < -1, -2 - cells, 0)
        side = (self.columns[entry] >> up) & 1
        row_bit = ((rows >> up) & 1) * 2
        out = np.empty((2, *cells.shape), np.int64)
        for half in (0, 1):
            quarter = (row_bit + half).astype(np.uint8)
            before = _BEFORE[quarter]
            here = inside & ((have >> quarter) & 1 > 0)
            ends = here & ((alone >> quarter) & 1 > 0)
            single = self.single[level][node] + _POPULATION[alone & before]
            below = self.inner[level][node] + _POPULATION[have & ~alone & before]
            out[half] = np.where(here, below, -1)
            end = single[ends]
            out[half][ends] = np.where(self.entry_rows[end] == np.broadcast_to(rows, cells.shape)[ends], -2 - end, -1)
            kept = (cells < -1) & (side == half)
            out[half][kept] = cells[kept]
        return np.concatenate([2 * ranges, 2 * ranges + 1]), out.reshape(-1, cells.shape[1])

    def bounds(self, level: int, cells: np.ndarray, weights: np.ndarray) -> np.ndarray:
        inner = self.maxima[level]
        best = self.impacts[np.where(cells < -1, -2 - cells, 0)] * (cells < -1)
        if len(inner):
            best = best + inner[np.maximum(cells, 0)] * (cells >= 0)
        return best @ weights

    def top(self, places: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of the ``k`` best documents with a score above 0;
        of equal scores the smaller column counts as better."""
        rows = self.rows[places]
        cells = (rows >> self.depth)[None, :]
        columns, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        threshold = 1
        waiting = [(0, np.zeros(1, np.int64), cells, self.bounds(0, cells, weights))]
        first = True
        while waiting:
            level, ranges, cells, bound = waiting.pop()
            keep = bound >= threshold
            ranges, cells, bound = ranges[keep], cells[keep], bound[keep]
            if not len(ranges):
                continue
            if level == self.depth:
                columns, scores = np.append(columns, ranges), np.append(scores, bound)
                if len(scores) > k:
                    best = np.lexsort((columns, -scores))[:k]
                    columns, scores = columns[best], scores[best]
                if len(scores) == k:
                    threshold = max(threshold, int(scores.min()))
                first = False
                continue
            if first and len(ranges) > BEAM:
                order = np.argsort(-bound, kind="stable")
                rest = order[BEAM:]
                waiting.append((level, ranges[rest], cells[rest], bound[rest]))
                ranges, cells = ranges[order[:BEAM]], cells[order[:BEAM]]
            ranges, cells = self.halve(level, ranges, cells, rows)
            waiting.append((level + 1, ranges, cells, self.bounds(level + 1, cells, weights)))
        return columns, scores


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, total = 0, 0
    for batch in batches:
        data, offsets = packed.utf8(batch.column(1))
        for low, high in packed.groups_of(offsets, packed.CHUNK):
            ends = offsets[low : high + 1] - offsets[low]
            bounds = packed.words_of(TERM_BYTES[data[offsets[low] : offsets[high]]], ends)[2]
            docs += int((np.diff(bounds) > 0).sum())
            total += int(bounds[-1])
    yield pa.RecordBatch.from_pydict({"documents": [docs], "terms": [total]})
    packed.release()


def _indexed(total_docs: int, total_terms: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, lengths, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            counts = np.concatenate(lengths)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            row = build(np.concatenate(ids), np.concatenate(terms), bounds, total_docs, total_terms)
            return pa.RecordBatch.from_pylist([row], _INDEX_SCHEMA)

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = packed.utf8(batch.column(1))
            for low, high in packed.groups_of(offsets, packed.CHUNK):
                got, bounds = terms_of(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                counts = np.diff(bounds)
                some = counts > 0
                if not some.any():
                    continue
                ids.append(keys[low:high][some])
                terms.append(got)
                lengths.append(counts[some])
                size += len(got)
                if size >= limit or sum(map(len, ids)) > BLOCK_DOCS // 2:
                    yield flush()
                    ids, terms, lengths, size = [], [], [], 0
        if ids:
            yield flush()
        packed.release()

    return run


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """The index of all ``docs`` as a table (a row per block), and the number of
    documents with a term.

    Rows without an id and rows without a term (NULL text among them) are in no
    block; rows of the same id are documents of their own. An empty table gives an
    empty index. Other columns are not read.
    """
    spark = docs.sparkSession
    packed.small_batches(spark)
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(text))
    counted = rows.mapInArrow(_counted, "documents long, terms long")
    total = counted.agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).first()
    path = new_folder(spark, "lexical-index")
    index = rows.mapInArrow(_indexed(total["documents"] or 0, total["terms"] or 1, BLOCK_TERMS), INDEX)
    # Looked at after each block: by default that is after 100 rows, nearly a gigabyte.
    sizes = {"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
    index.write.options(**sizes).parquet(path)
    return spark.read.schema(INDEX).parquet(path), total["documents"] or 0


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = packed.utf8(batch.column(1))
        terms, bounds = terms_of(data, offsets)
        item = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(item)), pa.array(terms.astype(np.int64))], names=["item_id", "term"]
        )


def _packed_portion(table: pa.Table) -> pa.Table:
    """One row with all items, terms and weights of a portion, by item."""
    table = table.sort_by([("item_id", "ascending"), ("term", "ascending")])
    return pa.table(
        {
            "portion": table["portion"].slice(0, 1),
            "items": [table["item_id"].to_numpy().astype("<i8").tobytes()],
            "wanted": [table["term"].to_numpy().astype("<i8").tobytes()],
            "weights": [table["weight"].to_numpy().astype("<i8").tobytes()],
        }
    )


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            wanted = np.unique(np.frombuffer(row["wanted"], np.int64))
            block = Block(row)
            have, at = block.found(wanted)
            portion = np.full(len(at), row["portion"], np.int32)
            yield pa.RecordBatch.from_pydict({"portion": portion, "term": wanted[have], "df": block.frequencies()[at]})


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                items, wanted, weights = (np.frombuffer(row[n], np.int64) for n in ("items", "wanted", "weights"))
                block = Block(row)
                have, at = block.found(wanted)
                items, weights = items[have], weights[have]
                if not len(items):
                    continue
                block.open()
                cuts = np.flatnonzero(np.append(True, items[1:] != items[:-1]))
                found = [(np.empty(0, np.int64),) * 3]
                for low, high in zip(cuts, np.append(cuts[1:], len(items))):
                    columns, scores = block.top(at[low:high], weights[low:high], k)
                    found.append((np.full(len(columns), items[low]), block.doc_ids[columns], scores))
                names = ("item_id", "doc_id", "score")
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(np.concatenate, zip(*found)))))
        packed.release()

    return run


def _portions(terms: DataFrame, path: str) -> DataFrame:
    """The packed portions as a small table, whose size decides how it is joined."""
    kinds = "portion int, items binary, wanted binary, weights binary"
    terms.groupBy("portion").applyInArrow(_packed_portion, kinds).write.parquet(path)
    return terms.sparkSession.read.schema(kinds).parquet(path)


def search(
    index: DataFrame, total_docs: int, items: DataFrame, key: str = "item_id", text: str = "text", k: int = TOP
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item.

    A score is the sum over the item's terms, once each, of the term's weight times
    its impact, in integers; only scores above 0 count, and of equal scores the
    smaller id comes first. Items without an id, without a term or without a
    document that has one (NULL texts, an empty index) give no rows; items of the
    same id are one item with the terms of all. Other columns are not read.

    Every portion of items meets every block of documents, and a block hands on at
    most ``k`` documents an item. Portions are joined by their size: a small table
    of them is broadcast by Spark's own threshold.
    """
    spark = items.sparkSession
    packed.small_batches(spark)
    rows = items.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item_id"), F.col(text))
    count = -(-rows.count() // PORTION) or 1
    terms = rows.mapInArrow(_item_terms, "item_id long, term long").distinct()
    terms = terms.withColumn("portion", F.pmod(F.xxhash64("item_id"), F.lit(count)).cast("int"))
    blocks = index.withColumn("portion", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    asked = _portions(terms.withColumn("weight", F.lit(0).cast("long")), new_folder(spark, "lexical-terms"))
    lookup = blocks.select("portion", "terms", "term_rows", "documents_of_terms").join(asked, "portion")
    df = lookup.mapInArrow(_frequencies, "portion int, term long, df long")
    df = df.groupBy("portion", "term").agg(F.sum("df").alias("df"))
    ratio = F.lit(2.0 * total_docs + 2) / (2 * F.col("df") + 1)
    weight = F.floor(F.lit(1000.0) * F.log(ratio)).cast("long")
    weighted = terms.join(df, ["portion", "term"]).select("portion", "item_id", "term", weight.alias("weight"))
    met = blocks.join(_portions(weighted, new_folder(spark, "lexical-weights")), "portion")
    found = met.mapInArrow(_searched(k), "item_id long, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's rows: all items against all documents."""
    return search(*build_index(docs), items)
