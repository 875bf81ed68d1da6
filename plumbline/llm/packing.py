"""Best-fit packing of tokenised documents into sequences (operator 5)."""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import packed
from plumbline.plans.session import materialize

CAPACITY = 4096
#: Id after the last token of every document.
END = 1
#: Bins that are open at a time.
OPEN_BINS = 4096
#: Pieces that are packed together; more pieces make more groups.
GROUP = 16_000
#: Words that a task remembers, and atoms with their tokens; and how many of the words
#: used most a worker keeps for its next task.
REMEMBERED, ATOMS, KEPT = 1_000_000, 2_000_000, 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    """Token ids of texts, with every different word encoded once.

    The tokenizer drops white space and never joins tokens over it, so a text's
    ids are those of its words. A word of letters between other signs is taken
    apart into atoms there, where the tokenizer splits too, and shares those with
    its other cases. Atoms of letters are encoded many at a time, as each
    ends with a token that says so. Python splits at four separators that the
    tokenizer takes for symbols; a text with one of them is encoded whole.
    """

    #: Signs that make tokens of their own next to letters (an apostrophe does not).
    SIGNS = "".join(c for c in string.punctuation if c not in "'<>")
    TOGETHER = 2000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.closes = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.clear_words()
        self.atoms: dict[str, int] = {"": 0}
        self.starts, self.lengths, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint16)

    def clear_words(self) -> None:
        self.index: dict[str, int] = {}
        self.word_starts, self.word_lengths, self.word_flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
        self.uses = np.zeros(0, np.int64)

    def keep(self, number: int) -> None:
        """Forget all but the words that were used most; other words learn their atoms anew."""
        words, uses = list(self.index), self.uses
        starts, lengths, flat = self.word_starts, self.word_lengths, self.word_flat
        self.clear()
        kept = np.argsort(-uses, kind="stable")[:number]
        self.index = {words[i]: at for at, i in enumerate(kept.tolist())}
        self.word_lengths = lengths[kept]
        self.word_starts = np.cumsum(self.word_lengths) - self.word_lengths
        self.word_flat = flat[packed.ragged(starts[kept], self.word_lengths)]
        self.uses = np.zeros(len(kept), np.int64)

    def _add(self, atoms: list[str], lengths: np.ndarray, flat: np.ndarray) -> None:
        self.atoms.update(zip(atoms, range(len(self.lengths), len(self.lengths) + len(atoms))))
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.flat = np.append(self.flat, flat.astype(np.uint16))

    def _add_plain(self, atoms: list[str]) -> None:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(atoms, add_special_tokens=False)]
        ids, offsets = _flat(lists)
        self._add(atoms, np.diff(offsets), ids)

    def learn(self, words: list[str]) -> None:
        cores = [w.strip(self.SIGNS) for w in words]
        # Python alone lowers the last sigma of a word in its own way.
        plain = [c.isalpha() and "Σ" not in c for c in cores]
        keys = [c.lower() if p else w for c, p, w in zip(cores, plain, words)]
        known = self.atoms
        letters = list({k for k, p in zip(keys, plain) if p}.difference(known))
        others = {k for k, p in zip(keys, plain) if not p}
        edges = []
        for i, (w, c, p) in enumerate(zip(words, cores, plain)):
            if p and len(c) != len(w):
                at = w.index(c)
                edges.append((i, w[:at], w[at + len(c) :]))
        others.update(e for _, before, after in edges for e in (before, after))
        parts = [letters[at : at + self.TOGETHER] for at in range(0, len(letters), self.TOGETHER)]
        done = self.tokenizer.encode_batch_fast([" ".join(part) for part in parts], add_special_tokens=False)
        added = []
        for part, encoding in zip(parts, done):
            ids = np.array(encoding.ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                added.append((part, np.diff(np.append(0, ends)), ids))
            else:
                self._add_plain(part)
        if added:
            part, lengths, ids = zip(*added)
            self._add(list(chain.from_iterable(part)), np.concatenate(lengths), np.concatenate(ids))
        others = list(others.difference(known))
        if others:
            self._add_plain(others)
        rows = np.zeros((len(words), 3), np.int32)
        rows[:, 1] = np.fromiter(map(known.__getitem__, keys), np.int32, len(keys))
        if edges:
            at, before, after = zip(*edges)
            rows[list(at), 0] = [known[x] for x in before]
            rows[list(at), 2] = [known[x] for x in after]
        self.index.update(zip(words, range(len(self.word_lengths), len(self.word_lengths) + len(words))))
        used = rows.ravel()
        used = used[used > 0]
        lengths = self.lengths[rows].sum(axis=1)
        self.word_starts = np.append(self.word_starts, len(self.word_flat) + np.cumsum(lengths) - lengths)
        self.word_lengths = np.append(self.word_lengths, lengths)
        self.uses = np.append(self.uses, np.zeros(len(words), np.int64))
        self.word_flat = np.append(self.word_flat, self.flat[packed.ragged(self.starts[used], self.lengths[used])])

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the n + 1 offsets."""
        column = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(column, "[\x1c-\x1f]")
        # Arrow splits and tells the different words, so that only these become Python strings.
        split = pc.utf8_split_whitespace(pc.if_else(odd, "", column))
        coded = split.flatten().dictionary_encode()
        words, odd = coded.dictionary.to_pylist(), np.flatnonzero(odd)
        new = list(set(words).difference(self.index))
        if len(self.index) + len(new) > REMEMBERED:
            self.clear_words()
            new = words
        if len(self.atoms) > ATOMS:
            self.clear()
            new = words
        if new:
            self.learn(new)
        codes = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        codes = codes[coded.indices.to_numpy()]
        self.uses += np.bincount(codes, minlength=len(self.uses))
        lengths = self.word_lengths[codes]
        ids = self.word_flat[packed.ragged(self.word_starts[codes], lengths)]
        ends = np.cumsum(np.append(0, lengths))
        offsets = ends[np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))]
        if len(odd):
            whole = [ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
            for i in odd:
                whole[i] = self.tokenizer.encode(column[int(i)].as_py(), add_special_tokens=False).ids
            return _flat(whole)
        return ids, offsets


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.cumsum([0, *map(len, lists)])
    parts = [np.asarray(x, np.uint32) for x in lists]
    return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), offsets


_encoders: dict[str, WordTokens] = {}


def _encoder(path: str) -> WordTokens:
    if path not in _encoders:
        _encoders[path] = WordTokens(path)
    return _encoders[path]


def _tokenised(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = np.array([END], "<u4")
        for batch in batches:
            docs = batch.column(0).to_pylist()
            ids, offsets = encoder.encode(pc.fill_null(batch.column(1), ""))
            rows = []
            for doc, low, high in zip(docs, offsets[:-1], offsets[1:]):
                own = np.append(ids[low:high].astype("<u4"), end)
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    rows.append((doc, piece, start, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        # Workers serve other stages next, beside the JVM of their executor.
        if len(encoder.index) > KEPT:
            encoder.keep(KEPT)
        packed.release()

    return run


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of every length, in the order given.

    Open bins are kept in a bitset by free space: bit ``f`` is set while a bin
    with ``f`` free is open. A length goes to the fullest bin that holds it. If
    none does, a bin is opened; when too many are open, the fullest closes.
    """
    bits, free, bins, used = 0, [[] for _ in range(capacity + 1)], 0, 0
    where, offsets = [], []
    for length in lengths:
        fitting = bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            stack = free[space]
            chosen = stack.pop()
            if not stack:
                bits ^= 1 << space
            used -= 1
        else:
            if used >= open_bins:
                fullest = (bits & -bits).bit_length() - 1
                stack = free[fullest]
                stack.pop()
                if not stack:
                    bits ^= 1 << fullest
                used -= 1
            space, chosen, bins = capacity, bins, bins + 1
        where.append(chosen)
        offsets.append(capacity - space)
        left = space - length
        # A full bin closes by itself.
        if left:
            if not free[left]:
                bits |= 1 << left
            free[left].append(chosen)
            used += 1
    return where, offsets


def _packed(capacity: int, open_bins: int):
    def run(table: pa.Table) -> pa.Table:
        group = table["__group"][0].as_py()
        table = table.drop_columns(["__group"])
        lengths = table["length"].to_numpy()
        # Long pieces first while bins for them stay open; then what is left of
        # them serves the short ones. The order within a length is by document.
        order = np.lexsort((table["piece"].to_numpy(), table["doc_id"].to_numpy(), -lengths))
        table = table.take(pa.array(order))
        where, offsets = best_fit(table["length"].to_pylist(), capacity, open_bins)
        sequence = np.array(where, np.int64) + (group << 32)
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its token ids and ``END``; a NULL or empty text is ``END`` only.
    Documents longer than ``capacity`` are cut. Pieces are dealt by hash into
    groups of about ``GROUP``, each packed on its own, so a group wastes a few
    bins of thousands. Repeated rows and NULL ids are documents like any other;
    an empty table gives an empty result. Other columns are not read.
    """
    packed.small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long"), "text")
    pieces = source.mapInArrow(_tokenised(tokenizer or default_tokenizer(), capacity), PIECES)
    pieces = materialize(pieces, "pieces")
    groups = -(-pieces.count() // GROUP) or 1
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(_packed(capacity, open_bins), PACKED)
