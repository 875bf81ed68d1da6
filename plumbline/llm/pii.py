"""Personal data and the terms that give it away (operator 3).

Patterns find the protected entities. Over the whole corpus, the documents that
hold a term and those that hold it together with an entity tell how much the term
reveals: with P the share of a term's documents that hold the entity too and IC
the information of the entity, log2(documents / its documents), a term discloses
1 - log2(1 / P) / IC of it, which is their pointwise mutual information over IC.
Such a term is marked wherever it stands, also where the entity does not.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import packed
from plumbline.plans.session import materialize

#: Kinds in the order of their spans.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: What a term and entity count that stand together in a single document: one meeting
#: may be chance, so such a term is generalised in a large corpus, but not removed.
ONCE = 0.5
#: Disclosure from which a term is generalised, and from which it is removed.
GENERALISED, REMOVED = 0.90, 0.98
#: Words that a task counts before it hands the counts on.
HELD = 200_000
#: Disclosing terms of most documents that every task knows; all others are joined.
KNOWN = 50_000
#: Bytes, at most, of the filter that keeps plain words out of that join.
FILTER = 1 << 24

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A number is taken whole, as a match never begins or ends inside one.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Terms are whole runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every sign is tried once, and its local part read backwards: the leftmost
    match begins where the run of local characters does."""
    done, at = 0, text.find("@")
    while at >= 0:
        match = DOMAIN.match(text, at)
        if match:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                done = match.end()
                yield start, done
                at = text.find("@", done)
                continue
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def entities(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of all protected entities, in their order."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def word_key(word: str) -> int:
    return _signed(xxhash.xxh64_intdigest(word))


def words_outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[re.Match[str]]:
    """All words that touch none of the entities."""
    at, reach = 0, 0
    for m in WORD.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= m.start():
            yield m


def row_key(doc: int | None, crc: int) -> int:
    return xxhash.xxh64_intdigest(f"{doc}:{crc}")


def most_documents(entity_docs: np.ndarray, total: int) -> np.ndarray:
    """Documents that a term may have, at most, to disclose an entity: with more, P
    is too low even if the term stands in every document of the entity."""
    return entity_docs * (total / entity_docs) ** (1 - GENERALISED) * (1 + 1e-9)


ROW = (
    "kind int, doc_id long, crc long, counts array<long>, base array<struct<first:long,kind:int,last:long>>, sha string, "
    "key long, held array<long>, bucket int, terms binary, documents binary, holders binary"
)


def _scanned(buckets: int):
    base_type = pa.list_(pa.struct([("first", pa.int64()), ("kind", pa.int32()), ("last", pa.int64())]))
    schema = pa.schema(
        [
            ("kind", pa.int32()),
            ("doc_id", pa.int64()),
            ("crc", pa.int64()),
            ("counts", pa.list_(pa.int64())),
            ("base", base_type),
            ("sha", pa.string()),
            ("key", pa.int64()),
            ("held", pa.list_(pa.int64())),
            ("bucket", pa.int32()),
            ("terms", pa.binary()),
            ("documents", pa.binary()),
            ("holders", pa.binary()),
        ]
    )

    def handed(kind: int, name: str, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        batch = packed.rows_by_bucket(packed.place(keys, buckets), buckets, {"terms": keys, name: values})
        have = dict(zip(batch.schema.names, batch.columns)) | {"kind": pa.array([kind] * batch.num_rows, pa.int32())}
        columns = [have[f.name] if f.name in have else pa.nulls(batch.num_rows, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        beside = packed.Held(("terms", "holders"))

        def counted() -> pa.RecordBatch:
            raw = [w.encode() for w in words]
            keys = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
            number = np.fromiter(words.values(), np.uint32, len(raw))
            words.clear()
            return handed(1, "documents", keys, number)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for doc, text in zip(ids, batch.column(1).to_pylist()):
                text = text or ""
                spans = entities(text)
                crc = zlib.crc32(text.encode())
                key, held = None, []
                if spans:
                    own = {m.group().lower() for m in words_outside(text, spans)}
                    key = row_key(doc, crc)
                    terms = np.fromiter((xxhash.xxh64_intdigest(w) for w in own), np.uint64, len(own))
                    beside.add(terms=terms, holders=np.full(len(own), key, np.uint64))
                    key = _signed(key)
                    held = sorted({word_key(f"{KINDS[k]}:{text[a:b].lower()}") for a, k, b in spans})
                else:
                    own = set(map(str.lower, set(WORD.findall(text))))
                words.update(own)
                joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                counts = [sum(1 for _, k, _ in spans if k == i) for i in range(len(KINDS))]
                base = [{"first": a, "kind": k, "last": b} for a, k, b in spans]
                sha = hashlib.sha256(joined.encode()).hexdigest()
                rows.append((0, doc, crc, counts, base, sha, key, held, None, None, None, None))
                if len(words) >= HELD:
                    yield counted()
                if beside.size >= packed.FLUSH:
                    yield handed(2, "holders", *beside.take().values())
            columns = list(zip(*rows)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        if words:
            yield counted()
        if beside.size:
            yield handed(2, "holders", *beside.take().values())
        packed.release()

    return run


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return packed.joined(table[name]).view(kind) if table.num_rows else np.empty(0, kind)


def _whole(batch: pa.RecordBatch) -> pa.Table:
    return pa.Table.from_batches([batch])


def _rare(limit: float, buckets: int):
    """Documents of the words of one bucket that stand beside entities, by the rows
    that hold them. Words of more than ``limit`` documents disclose no entity."""

    def run(table: pa.Table) -> pa.Table:
        terms, documents = _column(table, "terms", np.uint64), _column(table, "documents", np.uint32)
        # Records of either kind, in the order of the rows.
        beside = np.repeat(table["kind"].to_numpy() == 2, packed.counts(table["terms"], 8))
        holders = _column(table, "holders", np.uint64)
        unique, at = np.unique(terms[~beside], return_inverse=True)
        total = np.bincount(at, documents, len(unique)).astype(np.int64)
        asked = terms[beside]
        number = total[np.searchsorted(unique, asked)]
        keep = number <= limit
        asked, number, holders = asked[keep], number[keep], holders[keep]
        columns = {"holders": holders, "terms": asked, "documents": number}
        return _whole(packed.rows_by_bucket(packed.place(holders, buckets), buckets, columns))

    return run


PAIRS = pa.schema([("bucket", pa.int32())] + [(n, pa.binary()) for n in ("class", "terms", "documents", "entity_docs", "both")])


def _paired(total: int, buckets: int):
    """How often every class of entities meets every term that may disclose it."""
    names = PAIRS.names[1:]

    def run(rows: pa.Table, table: pa.Table) -> pa.Table:
        holders, terms = _column(table, "holders", np.uint64), _column(table, "terms", np.uint64)
        number = _column(table, "documents", np.int64)
        order = np.argsort(holders, kind="stable")
        holders, terms, number = holders[order], terms[order], number[order]
        keys = rows["key"].to_numpy().view(np.uint64)
        kinds, docs = rows["class"].to_numpy().view(np.uint64), rows["entity_docs"].to_numpy()
        first, last = (np.searchsorted(holders, keys, side) for side in ("left", "right"))
        held, parts = packed.Held(names[:4]), []

        def pack() -> None:
            taken = held.take()
            order = np.lexsort((taken["terms"], taken["class"]))
            taken = {n: v[order] for n, v in taken.items()}
            new = np.append(True, (taken["class"][1:] != taken["class"][:-1]) | (taken["terms"][1:] != taken["terms"][:-1]))
            heads = np.flatnonzero(new)
            both = np.diff(np.append(heads, len(order)))
            columns = {n: v[heads] for n, v in taken.items()} | {"both": both}
            place = packed.place(packed.mix(columns["class"] ^ packed.mix(columns["terms"])), buckets)
            parts.append(packed.rows_by_bucket(place, buckets, columns))

        for low, high, kind, n, most in zip(first, last, kinds, docs, most_documents(docs, total)):
            own = low + np.flatnonzero(number[low:high] <= most)
            size = len(own)
            kind = np.full(size, kind, np.uint64)
            held.add(**{"class": kind, "terms": terms[own], "documents": number[own], "entity_docs": np.full(size, n)})
            if held.size >= packed.FLUSH:
                pack()
        if held.size:
            pack()
        if not parts:
            return PAIRS.empty_table()
        return pa.Table.from_batches(parts)

    return run


def _disclosing(total: int):
    def run(table: pa.Table) -> pa.Table:
        kind, terms = _column(table, "class", np.uint64), _column(table, "terms", np.uint64)
        documents, held, both = (_column(table, n, np.int64) for n in ("documents", "entity_docs", "both"))
        order = np.lexsort((terms, kind))
        heads = np.flatnonzero(np.append(True, np.diff(kind[order]).astype(bool) | np.diff(terms[order]).astype(bool)))
        both = np.add.reduceat(both[order], heads)
        terms, documents, held = (x[order][heads] for x in (terms, documents, held))
        keep = held < total
        terms, documents, held, both = (x[keep] for x in (terms, documents, held, both))
        disclosed = 1 + np.log2(np.where(both == 1, ONCE, both) / documents) / np.log2(total / held)
        keep = disclosed >= GENERALISED
        return pa.table(
            {"term": terms[keep].view(np.int64), "term_docs": documents[keep], "disclosed": disclosed[keep]}
        )

    return run


def _bits(keys: np.ndarray, size: int) -> np.ndarray:
    """Three places of every key among ``size`` bits, a power of two."""
    other = packed.mix(keys)
    return np.stack([keys, other, other >> np.uint64(32)]) & np.uint64(size - 1)


def _filter(most: int):
    def run(table: pa.Table) -> pa.Table:
        keys = table["term"].to_numpy().view(np.uint64)
        size = 512
        while size < 16 * len(keys) and size * 2 <= most:
            size *= 2
        bits = np.zeros(size, bool)
        bits[_bits(keys, size).ravel()] = True
        return pa.table({"bucket": table["bucket"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return run


class Telling:
    """The disclosing terms as tasks know them: the ones of most documents with
    their mark, and a filter that all of the others pass, with few plain words."""

    def __init__(self, known: dict[int, bool], filters: dict[int, bytes], buckets: int):
        self.known, self.buckets = known, buckets
        self.start, self.size = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for bucket, bits in filters.items():
            self.size[bucket] = 8 * len(bits)
        self.start[1:] = np.cumsum(self.size)[:-1]
        self.bits = np.frombuffer(b"".join(filters[b] for b in sorted(filters)), np.uint8)

    def open(self, keys: np.ndarray) -> np.ndarray:
        """Which keys may be of a term that is not known here."""
        bucket = packed.place(keys, self.buckets).astype(np.int64)
        out = self.size[bucket] > 0
        at = np.flatnonzero(out)
        if len(at):
            keys, bucket = keys[at], bucket[at]
            place = self.start[bucket] + (_bits(keys, 1 << 32) & (self.size[bucket] - 1).astype(np.uint64)).astype(np.int64)
            out[at] = ((self.bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).all(axis=0)
        return out


SPOT = (
    "doc_id long, crc long, terms array<struct<first:long,last:long,removed:boolean>>, "
    "bucket int, keys binary, docs binary, named binary, crcs binary, firsts binary, lasts binary"
)
OPEN = {"keys": np.uint64, "docs": np.int64, "named": np.uint8, "crcs": np.int64, "firsts": np.int64, "lasts": np.int64}


def _spotted(sent):
    """Where terms stand: those known, and records of those still to be joined."""
    mark_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("removed", pa.bool_())]))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("crc", pa.int64()), ("terms", mark_type), ("bucket", pa.int32())]
        + [(n, pa.binary()) for n in OPEN]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling = sent.value
        plain: set[str] = set()
        found: dict[str, tuple[int, bool | None]] = {}
        waiting, size = [], 0

        def learn(words: set[str]) -> None:
            if len(plain) + len(found) + len(words) > HELD:
                plain.clear()
                found.clear()
            new = [w for w in words if w not in plain and w not in found]
            keys = np.fromiter((xxhash.xxh64_intdigest(w.lower()) for w in new), np.uint64, len(new))
            for word, key, maybe in zip(new, keys.tolist(), telling.open(keys).tolist()):
                mark = telling.known.get(_signed(key))
                if mark is not None or maybe:
                    found[word] = key, mark
                else:
                    plain.add(word)

        def handed() -> pa.RecordBatch:
            columns = {n: np.array(c, t) for (n, t), c in zip(OPEN.items(), zip(*waiting))}
            waiting.clear()
            batch = packed.rows_by_bucket(packed.place(columns["keys"], telling.buckets), telling.buckets, columns)
            blank = [pa.nulls(batch.num_rows, f.type) for f in list(schema)[:3]]
            return pa.RecordBatch.from_arrays([*blank, *batch.columns], schema=schema)

        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORD.findall(text or ""))
                if not words <= plain:
                    learn(words - plain)
                if words.isdisjoint(found):
                    continue
                crc, marks = zlib.crc32(text.encode()), []
                for m in words_outside(text, entities(text)):
                    if m.group() in found:
                        key, mark = found[m.group()]
                        if mark is None:
                            waiting.append((key, doc or 0, doc is not None, crc, m.start(), m.end()))
                        else:
                            marks.append({"first": m.start(), "last": m.end(), "removed": mark})
                if marks:
                    rows.append((doc, crc, marks))
                if len(waiting) >= HELD:
                    yield handed()
            columns = list(zip(*rows)) or [[]] * 3
            blank = [pa.nulls(len(rows), f.type) for f in list(schema)[3:]]
            kept = [pa.array(c, f.type) for c, f in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays([*kept, *blank], schema=schema)
        if waiting:
            yield handed()
        packed.release()

    return run


def _settled(asked: pa.Table, telling: pa.Table) -> pa.Table:
    """The records of one bucket whose term does disclose an entity."""
    records = {n: _column(asked, n, t) for n, t in OPEN.items()}
    terms = telling["term"].to_numpy().view(np.uint64)
    order = np.argsort(terms)
    terms, removed = terms[order], telling["removed"].to_numpy(zero_copy_only=False)[order]
    if len(terms):
        at = np.minimum(np.searchsorted(terms, records["keys"]), len(terms) - 1)
        keep = terms[at] == records["keys"]
    else:
        at, keep = np.zeros(0, np.int64), np.zeros(len(records["keys"]), bool)
    records = {n: v[keep] for n, v in records.items()}
    return pa.table(
        {
            "doc_id": pa.array(records["docs"], mask=records["named"] == 0),
            "crc": records["crcs"],
            "first": records["firsts"],
            "last": records["lasts"],
            "removed": pa.array(removed[at[keep]] if len(terms) else np.zeros(0, bool)),
        }
    )


def _bucket(column, buckets: int):
    """``packed.place`` of a signed hash, in SQL."""
    upper = F.shiftrightunsigned(column, 32)
    return F.shiftright(upper * F.lit(buckets), 32).cast("int")


def _telling(scanned: DataFrame, buckets: int) -> DataFrame | None:
    """``bucket, term, term_docs, removed`` of the terms that disclose an entity.

    Entities of the same rows are one class, so that a long list of them meets the
    words beside it once. Its number of documents bounds those of the terms that
    can disclose it, which leaves out most words before any pair is formed.
    """
    whole = scanned.where("kind = 0")
    held = whole.select("key", F.explode("held").alias("entity"))
    rows = [F.bit_xor("key"), F.sum(F.col("key").bitwiseAND((1 << 28) - 1)), F.count(F.lit(1))]
    classes = held.groupBy("entity").agg(F.xxhash64(*rows).alias("class"), rows[2].alias("entity_docs"))
    classes = materialize(classes, "entity_classes")
    total, largest = whole.count(), classes.agg(F.max("entity_docs")).first()[0]
    if not largest:
        return None
    limit = float(most_documents(np.float64(largest), total))
    holders = held.join(classes, "entity").select("key", "class", "entity_docs").distinct()
    holders = holders.withColumn("home", _bucket(F.col("key"), buckets))
    words = scanned.where("kind > 0").select("kind", "bucket", "terms", "documents", "holders")
    fields = "bucket int, holders binary, terms binary, documents binary"
    rare = words.groupBy("bucket").applyInArrow(_rare(limit, buckets), fields).withColumnRenamed("bucket", "home")
    fields = "bucket int, class binary, terms binary, documents binary, entity_docs binary, both binary"
    pairs = holders.groupBy("home").cogroup(rare.groupBy("home")).applyInArrow(_paired(total, buckets), fields)
    found = pairs.groupBy("bucket").applyInArrow(_disclosing(total), "term long, term_docs long, disclosed double")
    found = found.groupBy("term", "term_docs").agg((F.max("disclosed") >= REMOVED).alias("removed"))
    return materialize(found.withColumn("bucket", _bucket(F.col("term"), buckets)), "telling")


def _marked(source: DataFrame, telling: DataFrame, buckets: int) -> DataFrame:
    """``doc_id, crc, first, last, removed`` of the terms, wherever they stand."""
    spark = source.sparkSession
    known = telling.orderBy(F.desc("term_docs"), "term").limit(KNOWN).select("term", "removed").collect()
    filters = []
    if len(known) == KNOWN:
        most = max(512, FILTER * 8 // buckets)
        filters = telling.groupBy("bucket").applyInArrow(_filter(most), "bucket int, bits binary").collect()
    sent = Telling({r["term"]: r["removed"] for r in known}, {r["bucket"]: bytes(r["bits"]) for r in filters}, buckets)
    spots = source.mapInArrow(_spotted(spark.sparkContext.broadcast(sent)), SPOT)
    spots = materialize(spots, "spots")
    marked = spots.where("terms is not null").select("doc_id", "crc", F.inline("terms"))
    if filters:
        asked = spots.where("bucket is not null").select("bucket", *OPEN).groupBy("bucket")
        fields = "doc_id long, crc long, first long, last long, removed boolean"
        marked = marked.unionByName(asked.cogroup(telling.groupBy("bucket")).applyInArrow(_settled, fields))
    return marked


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, crc, counts, base, sha, terms`` of every row.

    ``base`` lists the entities, ``terms`` all words outside them that disclose an
    entity of any document, as ``first, last, removed``; offsets count code points.
    NULL text reads as empty. Rows of one ``doc_id`` are told apart by ``crc``; equal
    rows share their terms. Every row is a document in the statistics. An empty
    table gives an empty result; other columns are not read.
    """
    packed.small_batches(docs.sparkSession)
    buckets = packed.bucket_count(docs.sparkSession, 1)
    source = docs.select(F.col("doc_id").cast("long"), "text")
    scanned = materialize(source.mapInArrow(_scanned(buckets), ROW), "entities")
    rows = scanned.where("kind = 0").select("doc_id", "crc", "counts", "base", "sha")
    telling = _telling(scanned, buckets)
    if telling is None:
        return rows.withColumn("terms", F.lit(None).cast("array<struct<first:long,last:long,removed:boolean>>"))
    marked = _marked(source, telling, buckets)
    lists = marked.groupBy("doc_id", "crc").agg(F.sort_array(F.collect_set(F.struct("first", "last", "removed"))).alias("terms"))
    lists = lists.withColumnsRenamed({"doc_id": "d", "crc": "z"})
    joined = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("crc") == F.col("z")), "left")
    return joined.drop("d", "z")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: counts, the hash of the base spans, and all spans."""
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    term = F.transform("terms", lambda t: F.struct(t["first"].alias("first"), F.lit(len(KINDS)).alias("kind"), t["last"].alias("last")))
    every = F.array_sort(F.concat("base", F.coalesce(term, F.slice("base", 1, 0))))
    text = F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["first"], s["last"]))
    found = find(docs)
    counts = [F.element_at("counts", i + 1).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.col("sha").alias("base_sha256"), F.concat_ws(",", text).alias("spans"))


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        out = []
        bases, terms = (batch.column(names.index(n)).to_pylist() for n in ("__base", "__terms"))
        for text, base, term in zip(batch.column(names.index("text")).to_pylist(), bases, terms):
            if not text or not (base or term):
                out.append(text)
                continue
            spans = [(s["first"], s["last"], f"[{KINDS[s['kind']].upper()}]") for s in base or []]
            spans += [(t["first"], t["last"], "" if t["removed"] else "[TERM]") for t in term or []]
            parts, at = [], 0
            for first, last, mask in sorted(spans):
                # An overlapped entity is part of what was masked before it.
                if first >= at:
                    parts += [text[at:first], mask]
                at = max(at, last)
            out.append("".join([*parts, text[at:]]))
        keep = [i for i, n in enumerate(names) if not n.startswith("__")]
        columns = [pa.array(out, pa.string()) if names[i] == "text" else batch.column(i) for i in keep]
        yield pa.RecordBatch.from_arrays(columns, names=[names[i] for i in keep])


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with entities replaced by their kind, disclosing terms generalised
    or removed, and ``n_chars`` to match. All rows and columns stay."""
    found = find(docs).where((F.size("base") > 0) | F.col("terms").isNotNull()).dropDuplicates(["doc_id", "crc"])
    found = found.select(
        F.col("doc_id").alias("__doc"), F.col("crc").alias("__crc"), F.col("base").alias("__base"), F.col("terms").alias("__terms")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.crc32(F.coalesce("text", F.lit(""))) == F.col("__crc"))
    joined = docs.join(found, same, "left").drop("__doc", "__crc")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = joined.mapInArrow(_masked, fields)
    if "n_chars" in docs.columns:
        length = F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", length)
    return out
