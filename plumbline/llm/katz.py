"""Katz backoff scores of texts (operator 12).

A text is its words and one end. A pair of tokens that training texts have has the
probability d c / C (c: count of the pair, C: of its history, d: the Good-Turing
discount of c); for any other pair the history's weight times the probability of the
token alone is taken, and for a token that training texts have not, what discounting
leaves of those. The weight of a history is what discounting leaves of its pairs
over one less the probabilities of the tokens that follow it, so that each history's
probabilities add up to one.

Counts live in two tables of packed rows, by bucket: tokens, and histories with the
tokens that follow them. Nothing is pruned, and no table is broadcast:

1. Blocks of about ``BLOCK`` tokens tell how often they have each token and in which
   buckets of pairs it stands. The token table is made of these counts and answers
   each bucket of pairs with those of its tokens.
2. Blocks send each distinct pair once with its count; a bucket adds these up, writes
   its part of the pair table and answers each block for the pairs it asked about.
3. Each block evaluates its own tokens and adds them up by text.

Buckets grow in number with the text. A history with more than its share of the
tokens is split by the following token into as many buckets as it fills; at most
``2 * buckets`` histories can be so frequent, so the list of them is small and their
totals are put together from one row per bucket.

Tokens are compared by 48 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm import packed
from plumbline.llm.jaccard_join import LOWER
from plumbline.plans.session import materialize, new_folder

#: Counts up to this are discounted.
DISCOUNTED = 5
#: Tokens of a block, and bytes of text for every bucket of pairs.
BLOCK, BUCKET_BYTES = 1 << 20, 8 << 20

CHANGED = "the documents changed between two reads: write them as a table first"
_HASH = np.uint64((1 << 48) - 1)
#: The end of a text, and the history of its first token.
END, BEGIN = (int(packed.mix(np.array([n], np.uint64))[0] & _HASH) for n in (0xE17D, 0xBE61))
_VALUES = packed.BYTE_VALUES[LOWER]

TOTALS = ["tokens", "distinct", *(f"n{r}" for r in range(1, DISCOUNTED + 2))]
PLACES = "bucket int, tokens binary, learned binary, times binary, places binary"
TOKENS = "kind string, bucket int, part int, tokens binary, counts binary, totals array<long>"
PAIRS = "bucket int, block long, histories binary, followers binary, tokens binary, learned binary"
STORED = (
    "kind string, bucket int, block long, histories binary, followers binary, dictionary binary, tokens binary, "
    "pair_counts binary, totals binary, rest binary, mass binary, token_counts binary, hot binary, "
    "counts_of_counts array<long>"
)
SCORES = "part int, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_RESULT = pa.schema(
    [("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_())]
    + [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


def discounts(counts_of_counts) -> np.ndarray:
    """Factor of every count from 0 to ``DISCOUNTED``, less than one for all of these.

    Katz's form of Good-Turing; a count whose estimate is unusable (no such counts,
    or not between 0 and 1) loses a fixed part of one instead.
    """
    n = np.zeros(DISCOUNTED + 2)
    n[1:] = np.asarray(counts_of_counts, float)[: DISCOUNTED + 1]
    fixed = n[1] / (n[1] + 2 * n[2]) if 0 < n[1] and 0 < n[2] else 0.5
    out = np.ones(DISCOUNTED + 1)
    above = (DISCOUNTED + 1) * n[-1] / n[1] if n[1] else 1.0
    for r in range(1, DISCOUNTED + 1):
        share = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        d = (share - above) / (1 - above) if above < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - fixed) / r
    return out


def total(counts: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """What the counts of histories are divided by: one more where discounting
    leaves nothing, as all followers are too frequent. 0 for unknown histories."""
    return counts + ((counts > 0) & ~rest.any(-1))


@dataclass
class Levels:
    """What is known of the whole corpus: totals and discounts of both levels."""

    tokens: int
    distinct: int
    single: np.ndarray
    left: float
    pair: np.ndarray | None = None
    #: Frequent histories: the number of buckets of each, and its totals.
    splits: dict[int, int] = field(default_factory=dict)
    #: Count, sum of the followers' single probabilities, followers by count.
    hot: dict[int, tuple] = field(default_factory=dict)

    @classmethod
    def of(cls, tokens: int, distinct: int, counts_of_counts) -> Levels:
        single = discounts(counts_of_counts)
        r = np.arange(1, DISCOUNTED + 1)
        left = float(np.sum(np.asarray(counts_of_counts[:DISCOUNTED], float) * (1 - single[1:]) * r))
        return cls(tokens, distinct, single, left)

    def alone(self, counts: np.ndarray) -> np.ndarray:
        """Probability of a token by its count; of all unknown ones together for 0."""
        left, total = (self.left, self.tokens) if self.left else (1.0, self.tokens + 1)
        factor = self.single[np.minimum(counts, DISCOUNTED)] * (counts <= DISCOUNTED) + (counts > DISCOUNTED)
        return np.where(counts > 0, factor * counts, left) / total

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def backed_off(self, pairs, counts, which, totals, rest, mass) -> np.ndarray:
        """Probability of tokens after histories. By token: count of the pair, count of
        the token, which history; by history: ``total``, its followers by count (1 to
        ``DISCOUNTED``), the sum of their single probabilities."""
        left = rest @ ((1 - self.pair[1:]) * np.arange(1, DISCOUNTED + 1))
        unseen = np.maximum(1 - mass, self.alone(np.zeros(1, np.int64)))
        known, total = totals > 0, np.maximum(totals, 1)
        weight = np.where(known, np.where(left > 0, left, 1.0) / total / unseen, 1.0)
        factor = self.pair[np.minimum(pairs, DISCOUNTED)] * (pairs <= DISCOUNTED) + (pairs > DISCOUNTED)
        return np.where(pairs > 0, factor * pairs / total[which], weight[which] * self.alone(counts))


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows, the token before each, and the rows' bounds."""
    low, high, bounds = packed.words_of(data, offsets)
    rows = len(bounds) - 1
    words = packed.Rolling(_VALUES[data]).spans(low, high) & _HASH
    ends = bounds[1:] + np.arange(rows)
    out = np.empty(len(words) + rows, np.uint64)
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word], out[ends] = words, END
    bounds = np.append(0, ends + 1)
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[bounds[:-1]] = BEGIN
    return out, before, bounds


@dataclass
class Block:
    """Neighbouring texts of a task, or a stretch of one text."""

    number: int
    tokens: np.ndarray
    before: np.ndarray
    lengths: np.ndarray
    learn: np.ndarray
    rows: np.ndarray
    ids: pa.Array

    def counted(self, places: np.ndarray, n: int, learned: bool) -> np.ndarray:
        weights = np.repeat(self.learn, self.lengths) if learned else None
        return np.bincount(places, weights, n).astype(np.int64)


def blocks_of(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Block]:
    """Blocks of about ``limit`` tokens; the same ones whenever a task reads the same rows."""
    number, row, size = TaskContext.get().partitionId() << 24, 0, 0
    held: list[tuple] = []

    def block() -> Block:
        columns = list(zip(*held))
        return Block(number, *map(np.concatenate, columns[:-1]), pa.concat_arrays(columns[-1]))

    for batch in batches:
        data, offsets = packed.utf8(batch.column(1))
        learn = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for low, high in packed.groups_of(offsets, packed.CHUNK):
            tokens, before, bounds = tokens_of(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            # A text of more tokens than a block is cut.
            for begin in range(0, len(tokens), limit):
                alone = high - low == 1 and len(tokens) > limit
                lengths = np.array([min(limit, len(tokens) - begin)]) if alone else np.diff(bounds)
                part = slice(begin, begin + limit) if alone else slice(None)
                rows = row + np.arange(low, high)
                held.append((tokens[part], before[part], lengths, learn[low:high], rows, batch.column(0).slice(low, high - low)))
                size += len(tokens[part])
                if size >= limit:
                    yield block()
                    number, size, held = number + 1, 0, []
                if not alone:
                    break
        row += batch.num_rows
    if held:
        yield block()


def _bucket_of_token(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """In the order of the tokens."""
    return (((tokens >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _bucket_of_history(history: np.ndarray, part: np.ndarray | int, buckets: int) -> np.ndarray:
    """``part``: which one of the buckets of a frequent history, else 0."""
    part = np.asarray(part, np.uint64) << np.uint64(48)
    return packed.place(packed.mix(history + part + np.uint64(1)), buckets).astype(np.int64)


def _heads(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal neighbours begin."""
    return np.flatnonzero(np.append(np.ones(min(len(values), 1), bool), values[1:] != values[:-1]))


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct numbers in order; sorting plain numbers is faster than hashing them."""
    values = np.sort(values)
    return values[_heads(values)]


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of ``keys`` in their order, equal ones by place, and where each
    distinct key begins there. Key and place are sorted as one number if they fit."""
    bits = len(keys).bit_length()
    if len(keys) and int(keys.max()).bit_length() + bits < 64:
        both = np.sort((keys << bits) | np.arange(len(keys)))
        return both & ((1 << bits) - 1), _heads(both >> bits)
    at = np.argsort(keys, kind="stable")
    return at, _heads(keys[at])


def _numbered(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct names in order, and the number of each name among these."""
    of, distinct = pd.factorize(names)
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], rank[of]


class Histories:
    """The tokens of a block and their histories as small numbers, and the bucket of
    each history; a frequent one has a number for each of its buckets."""

    def __init__(self, block: Block, buckets: int, splits: dict[int, int]):
        heads = np.cumsum(block.lengths) - block.lengths
        # Only the first token of a text, or of a stretch, has a history that is not the token before.
        codes, self.names = pd.factorize(np.append(block.tokens, block.before[heads]))
        #: Of every token of the block: its number, and that of its history.
        self.of = codes[: len(block.tokens)]
        self.first_of = np.append(0, self.of[:-1])
        self.first_of[heads] = codes[len(block.tokens) :]
        self.bucket = _bucket_of_history(self.names, 0, buckets)
        if splits:
            frequent = np.array(sorted(splits), np.uint64)
            times = np.array([splits[int(n)] for n in frequent])
            begin = np.cumsum(times) - times
            at = np.minimum(np.searchsorted(frequent, self.names), len(frequent) - 1)
            split = np.flatnonzero((frequent[at] == self.names)[self.first_of])
            at = at[self.first_of[split]]
            part = packed.mix(block.tokens[split] + np.uint64(1)) % times[at].astype(np.uint64)
            self.first_of[split] = len(self.names) + begin[at] + part.astype(np.int64)
            parts = packed.ragged(np.zeros(len(times), np.int64), times)
            self.bucket = np.append(self.bucket, _bucket_of_history(np.repeat(frequent, times), parts, buckets))
            self.history = np.append(self.names, np.repeat(frequent, times))
        else:
            self.history = self.names


class Pairs:
    """The distinct pairs of a block by bucket and history."""

    def __init__(self, block: Block, buckets: int, splits: dict[int, int]):
        own = Histories(block, buckets, splits)
        rank = np.empty(len(own.bucket), np.int64)
        rank[np.argsort(own.bucket, kind="stable")] = np.arange(len(rank))
        #: The block's tokens pair by pair, in the text's order, and where each pair begins.
        self.at, self.heads = _grouped(rank[own.first_of] * len(own.names) + own.of)
        first = self.at[self.heads]
        self.tokens, history = own.names[own.of[first]], own.first_of[first]
        self.history, self.bucket = own.history[history], own.bucket[history]
        #: Where the histories begin, and the number of each one's pairs.
        self.firsts = _heads(history)
        self.followers = np.diff(np.append(self.firsts, len(history)))
        #: Where the buckets begin among the histories, and the buckets.
        self.cuts = _heads(self.bucket[self.firsts])
        self.buckets = self.bucket[self.firsts[self.cuts]]

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the buckets, among the histories and among the pairs."""
        cuts = np.append(self.cuts, len(self.firsts))
        return cuts, np.append(self.firsts, len(self.history))[cuts]


def _six(values: np.ndarray) -> bytes:
    return packed.to_bytes(values, 6).tobytes()


def _hashes(blob: bytes) -> np.ndarray:
    return packed.from_bytes(blob, 6)


def _joined(table: pa.Table, name: str) -> np.ndarray:
    """The numbers of all rows, one row after the other."""
    parts = [_planes(b) for b in table[name].to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _joined_hashes(table: pa.Table, name: str) -> np.ndarray:
    return packed.from_bytes(packed.joined(table[name]), 6)


def cut(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Numbers of 0 or more between neighbouring bounds, in as many bytes each as the
    largest of all needs: that number of bytes, all lowest bytes, and so on."""
    width = max(int(values.max()).bit_length() + 7 >> 3, 1) if len(values) else 1
    parts = [(values >> (8 * i)).astype(np.uint8).tobytes() for i in range(width)]
    first, at = bytes([width]), bounds.tolist()
    return [b"".join([first, *(p[a:b] for p in parts)]) for a, b in zip(at, at[1:])]


def planes(values: np.ndarray) -> bytes:
    return cut(values, np.array([0, len(values)]))[0]


def _planes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(memoryview(blob)[1:], np.uint8).reshape(blob[0], -1)
    out = raw[0].astype(np.int64)
    for i in range(1, len(raw)):
        out |= raw[i].astype(np.int64) << (8 * i)
    return out


def _cut_six(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return _cut_bytes(_six(values), 6 * bounds)


def _cut_bytes(blob: bytes, bounds: np.ndarray) -> list[bytes]:
    at = bounds.tolist()
    return [blob[a:b] for a, b in zip(at, at[1:])]


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _columns(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A value for all rows, or one for each; columns that are not given are null."""
    rows = max(len(c) for c in columns.values() if isinstance(c, list | np.ndarray))
    arrays = []
    for field_ in schema:
        values = columns.get(field_.name)
        each = isinstance(values, list | np.ndarray)
        arrays.append(pa.array(values, field_.type) if each else pa.repeat(pa.scalar(values, field_.type), rows))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _schema(fields: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds.get(k, pa.binary())) for n, k in (f.split() for f in fields.split(", "))])


def _frequent(buckets: int, limit: int):
    """Tokens that would fill half a bucket of a block's pairs."""

    def run(batches):
        for block in blocks_of(batches, limit):
            names, counts = np.unique(block.tokens, return_counts=True)
            some = counts * 2 * buckets >= len(block.tokens)
            tokens = np.append(names[some].astype(np.int64), -1)
            yield pa.RecordBatch.from_pydict({"token": tokens, "n": np.append(counts[some], len(block.tokens))})
        packed.release()

    return run


def _placed(token_buckets: int, buckets: int, splits: dict[int, int], limit: int):
    """The tokens of a block: how often training texts have each, and in which buckets
    of pairs it stands."""

    def run(batches):
        for block in blocks_of(batches, limit):
            own = Histories(block, buckets, splits)
            order = np.argsort(own.names)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            both = _distinct(rank[own.of] * buckets + own.bucket[own.first_of])
            name, place = np.divmod(both, buckets)
            limits = _heads(name)
            order = order[name[limits]]
            names, learned = own.names[order], block.counted(own.of, len(order), True)[order]
            limits = np.append(limits, len(name))
            times, bucket = np.diff(limits), _bucket_of_token(names, token_buckets)
            cuts = np.append(_heads(bucket), len(bucket))
            yield _columns(
                _schema(PLACES), bucket=bucket[cuts[:-1]], tokens=_cut_six(names, cuts), learned=cut(learned, cuts),
                times=cut(times, cuts), places=cut(place, limits[cuts]),
            )
        packed.release()

    return run


def _answered(asked: pa.Table) -> pa.Table:
    """A bucket of the token table, and the counts of the tokens of each bucket of
    pairs, in the tokens' order."""
    names, of = _numbered(_joined_hashes(asked, "tokens"))
    counts = np.bincount(of, _joined(asked, "learned"), len(names)).astype(np.int64)
    at = np.repeat(of, _joined(asked, "times"))
    place, at = np.divmod(_distinct(_joined(asked, "places") * len(names) + at), len(names))
    cuts = np.append(_heads(place), len(place))
    part = asked["bucket"][0].as_py()
    schema = _schema(TOKENS)
    found = _columns(schema, kind="answers", bucket=place[cuts[:-1]], part=part, counts=cut(counts[at], cuts))
    known = counts > 0
    of_counts = [np.sum(counts == r) for r in range(1, DISCOUNTED + 2)]
    totals = [int(n) for n in (counts.sum(), known.sum(), *of_counts)]
    packed.release()
    row = {"kind": "tokens", "part": part, "tokens": _six(names[known]), "counts": planes(counts[known]), "totals": totals}
    return pa.Table.from_batches([found, _batch([row], schema)])


def _sent(buckets: int, splits: dict[int, int], limit: int):
    """The distinct pairs of every block, with their counts, by bucket."""

    def run(batches):
        for block in blocks_of(batches, limit):
            pairs = Pairs(block, buckets, splits)
            learned = np.add.reduceat(np.repeat(block.learn, block.lengths)[pairs.at].astype(np.int64), pairs.heads)
            histories, bounds = pairs.bounds()
            yield _columns(
                _schema(PAIRS), bucket=pairs.buckets, block=block.number, followers=cut(pairs.followers, histories),
                histories=_cut_six(pairs.history[pairs.firsts], histories),
                tokens=_cut_six(pairs.tokens, bounds), learned=cut(learned, bounds),
            )
        packed.release()

    return run


def _looked_up(levels: Levels):
    """A bucket of pairs: its part of the pair table, and what each block asked for."""
    schema = _schema(STORED)

    def run(asked: pa.Table, answers: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return schema.empty_table()
        counts = _joined(answers.sort_by("part"), "counts")
        followers = _joined(asked, "followers")
        dictionary, token = _numbered(_joined_hashes(asked, "tokens"))
        if len(counts) != len(dictionary):
            raise ValueError(CHANGED)
        histories, which = _numbered(_joined_hashes(asked, "histories"))
        of_pair = np.repeat(which, followers)
        at, heads = _grouped(of_pair * len(dictionary) + token)
        of = np.empty(len(at), np.int64)
        of[at] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(at))))
        learned = np.add.reduceat(_joined(asked, "learned")[at], heads)
        first = at[heads]
        history, token = of_pair[first], token[first]
        del at, heads, first, of_pair
        seen, n = learned > 0, len(histories)
        totals = np.bincount(history, learned, n).astype(np.int64)
        mass = np.bincount(history[seen], levels.alone(counts)[token[seen]], n)
        rare = seen & (learned <= DISCOUNTED)
        rest = np.bincount(history[rare] * DISCOUNTED + learned[rare] - 1, minlength=n * DISCOUNTED).reshape(n, DISCOUNTED)
        # The rest matters only where the block has a pair that is not learned.
        begins = np.cumsum(followers) - followers
        open_ = np.add.reduceat((~seen)[of].astype(np.int64), begins) > 0
        bucket, block = asked["bucket"][0].as_py(), asked["block"].to_numpy()
        rows = np.append(0, np.cumsum(packed.counts(asked["histories"], 6)))
        bounds = np.append(begins, len(of))[rows]
        found = _columns(
            schema, kind="answers", bucket=bucket, block=block, pair_counts=cut(learned[of], bounds),
            totals=cut(total(totals, rest)[which], rows), rest=cut((rest[which] * open_[:, None]).ravel(), DISCOUNTED * rows),
            mass=_cut_bytes((mass[which] * open_).astype("<f8").tobytes(), 8 * rows), token_counts=cut(counts[token][of], bounds),
        )
        known = np.flatnonzero(totals)
        hot = np.isin(histories, np.array(sorted(levels.splits), np.uint64)) & (totals > 0)
        row = {
            "kind": "pairs", "bucket": bucket, "histories": _six(histories[known]),
            "followers": planes(np.bincount(history[seen], minlength=n)[known]),
            "dictionary": _six(dictionary), "tokens": planes(token[seen]), "pair_counts": planes(learned[seen]),
            "hot": np.concatenate(
                [histories[hot].astype("<i8").view("<f8")[:, None], totals[hot][:, None], mass[hot][:, None], rest[hot]], 1
            ).astype("<f8").tobytes(),
            "counts_of_counts": [int(np.sum(learned == r)) for r in range(1, DISCOUNTED + 2)],
        }
        packed.release()
        return pa.Table.from_batches([found, _batch([row], schema)])

    return run


HOME = (
    "block long, ids binary, has_id binary, rows binary, learn binary, lengths binary, texts binary, places binary, "
    "times binary, followers binary, frequent binary, histories binary"
)


def _at_home(buckets: int, splits: dict[int, int], limit: int):
    """What a block needs to add up its answers: for each distinct pair its texts."""
    schema = _schema(HOME)
    frequent = np.array(sorted(splits), np.uint64)

    def run(batches):
        for block in blocks_of(batches, limit):
            pairs = Pairs(block, buckets, splits)
            text = np.repeat(np.arange(len(block.lengths)), block.lengths)[pairs.at]
            fresh = np.append(True, text[1:] != text[:-1])
            fresh[pairs.heads] = True
            begins = np.flatnonzero(fresh)
            first = pairs.history[pairs.firsts]
            row = {
                "block": block.number,
                "ids": block.ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
                "has_id": block.ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
                "rows": planes(block.rows), "learn": block.learn.astype(np.uint8).tobytes(),
                "lengths": planes(block.lengths),
                "texts": planes(np.add.reduceat(fresh.astype(np.int64), pairs.heads)),
                "places": planes(text[begins]), "times": planes(np.diff(np.append(begins, len(text)))),
                "followers": planes(pairs.followers), "frequent": _six(np.where(np.isin(first, frequent), first, 0)),
                "histories": planes(np.diff(np.append(pairs.cuts, len(pairs.firsts)))),
            }
            yield _batch([row], schema)
        packed.release()

    return run


def _scored(levels: Levels):
    """Scores of the texts of a block."""

    def run(home: pa.Table, answers: pa.Table) -> pa.Table:
        if not home.num_rows:
            return _RESULT.empty_table()
        mine, answers = home.to_pylist()[0], answers.sort_by("bucket")
        histories, followers, texts = (_planes(mine[n]) for n in ("histories", "followers", "texts"))
        pairs, totals = ([_planes(b) for b in answers[n].to_pylist()] for n in ("pair_counts", "totals"))
        asked = np.add.reduceat(followers, np.cumsum(histories) - histories)
        if [len(t) for t in totals] != histories.tolist() or [len(p) for p in pairs] != asked.tolist():
            raise ValueError(CHANGED)
        pairs, totals, counts = np.concatenate(pairs), np.concatenate(totals), _joined(answers, "token_counts")
        rest = _joined(answers, "rest").reshape(-1, DISCOUNTED)
        mass = np.frombuffer(b"".join(answers["mass"].to_pylist()), "<f8").copy()
        frequent = _hashes(mine["frequent"])
        for at in np.flatnonzero(frequent):
            count, mass[at], rest[at] = levels.hot.get(int(frequent[at]), (0, 0.0, 0))
            totals[at] = total(np.int64(count), rest[at])
        which = np.repeat(np.arange(len(followers)), followers)
        scores = levels.backed_off(pairs, counts, which, totals, rest, mass)
        lengths, place, times = (_planes(mine[n]) for n in ("lengths", "places", "times"))
        pair = np.repeat(np.arange(len(texts)), texts)

        def added(values: np.ndarray) -> np.ndarray:
            return np.bincount(place, values[pair] * times, len(lengths))

        missing = np.frombuffer(mine["has_id"], np.uint8) == 0
        columns = [
            pa.array(np.full(len(lengths), mine["block"] >> 24, np.int32)),
            pa.array(_planes(mine["rows"])),
            pa.array(np.frombuffer(mine["ids"], "<i8"), mask=missing),
            pa.array(np.frombuffer(mine["learn"], np.uint8) == 0),
            pa.array(lengths),
            pa.array(added((counts > 0).astype(float)).astype(np.int64)),
            pa.array(added(levels.base(counts))),
            pa.array(added(np.log10(scores))),
        ]
        packed.release()
        return pa.Table.from_arrays(columns, schema=_RESULT)

    return run


def _splits(rows: DataFrame, buckets: int) -> dict[int, int]:
    """Into how many buckets the frequent histories are split.

    Counted where a block has them often, which is near enough: splits only level the
    buckets. At most ``2 * buckets`` tokens can have the share asked for.
    """
    seen = rows.mapInArrow(_frequent(buckets, BLOCK), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    seen = materialize(seen, "katz-frequent")
    total = seen.where("token = -1").select("n").first()
    share = (total["n"] if total else 0) / (2 * buckets)
    counts = {r["token"]: r["n"] for r in seen.where((F.col("token") >= 0) & (F.col("n") >= share)).collect()}
    # A text begins as often as it ends; no history is an end.
    counts[BEGIN] = counts.pop(END, 0)
    return {t: int(-(-n // share)) for t, n in counts.items() if n >= share > 0}


def _first_level(tokens: DataFrame) -> Levels:
    """Totals and discounts of single tokens."""
    names = [F.sum(F.element_at("totals", i + 1)).alias(n) for i, n in enumerate(TOTALS)]
    total = [n or 0 for n in tokens.agg(*names).first()]
    return Levels.of(total[0], total[1], total[2:])


def _second_level(levels: Levels, pairs: DataFrame) -> None:
    """Discounts of pairs, and the totals of frequent histories."""
    names = [F.sum(F.element_at("counts_of_counts", r)) for r in range(1, DISCOUNTED + 2)]
    levels.pair = discounts([n or 0 for n in pairs.agg(*names).first()])
    # One small value for each bucket: frequent histories fill at most three times as many.
    for row in pairs.where(F.octet_length("hot") > 0).select("hot").collect():
        for name, total, mass, *rest in np.frombuffer(row["hot"], "<f8").reshape(-1, 3 + DISCOUNTED):
            key = int(np.array([name]).view("<i8")[0])
            before = levels.hot.get(key, (0, 0.0, np.zeros(DISCOUNTED, np.int64)))
            levels.hot[key] = (before[0] + int(total), before[1] + mass, before[2] + np.array(rest, np.int64))


def score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for
    every row of ``docs``; the model learns from the rows where ``learn`` is true.

    Words lie between blanks and the five ASCII controls next to tab, A-Z in lower
    case. ``score`` is the log10 probability of the text, ``base_score`` that of its
    tokens under add-a-half counts, ``n_known`` how many of its tokens training has.

    NULL and empty texts are one end; a NULL ``learn`` counts as false; repeated rows
    each count and each have a result; a NULL id stays NULL; without training rows all
    scores are those of one unknown token. An empty table gives an empty result. No
    other column is read, so their names cannot clash.

    ``docs`` is read several times and must give the same rows in the same order,
    as tables in files do; write other frames as a table first. If it changes all
    the same, the job fails instead of mixing up answers.
    """
    spark = docs.sparkSession
    packed.small_batches(spark)
    learned = F.coalesce(learn, F.lit(False))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), learned.alias("learn"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = -(-size // BUCKET_BYTES) or 1
    token_buckets = -(-buckets // 2)

    def stored_by_kind(df: DataFrame, name: str) -> DataFrame:
        path = new_folder(spark, name)
        df.write.partitionBy("kind").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def dealt(df: DataFrame, parts: int, by: str = "bucket"):
        # As many partitions as buckets: a task then holds few of them, however many Spark would choose.
        return df.repartition(parts, by).groupBy(by)

    splits = _splits(rows, buckets)
    placed = rows.mapInArrow(_placed(token_buckets, buckets, splits, BLOCK), PLACES)
    tokens = stored_by_kind(dealt(placed, token_buckets).applyInArrow(_answered, TOKENS), "katz-tokens")
    levels = _first_level(tokens.where("kind = 'tokens'"))
    levels.splits = splits
    answers = tokens.where("kind = 'answers'").select("bucket", "part", "counts")
    sent = rows.mapInArrow(_sent(buckets, splits, BLOCK), PAIRS)
    looked_up = dealt(sent, buckets).cogroup(dealt(answers, buckets)).applyInArrow(_looked_up(levels), STORED)
    stored = stored_by_kind(looked_up, "katz-pairs")
    _second_level(levels, stored.where("kind = 'pairs'"))
    replies = stored.where("kind = 'answers'").select(
        "bucket", "block", "pair_counts", "totals", "rest", "mass", "token_counts"
    )
    home = rows.mapInArrow(_at_home(buckets, splits, BLOCK), HOME)
    blocks = 2 * buckets
    scores = dealt(home, blocks, "block").cogroup(dealt(replies, blocks, "block")).applyInArrow(_scored(levels), SCORES)
    # A text longer than a block has several rows.
    sums = [F.sum(n).alias(n) for n in ("n_tokens", "n_known", "base_score", "score")]
    whole = scores.groupBy("part", "row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *sums)
    return whole.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(levels.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def held_out_scores(docs: DataFrame) -> DataFrame:
    """The contract's rows: one document in five is held out, by the CRC-32 of its id."""
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1)
