"""SentencePiece encoding and decoding by a max-plus scan (operator 8).

A text is cut into the vocabulary's pieces with the greatest sum of scores. That
is a product of max-plus matrices: a chunk of a giant text turns the state at its
start (how many characters the last piece took from it) into the state at its
end. Chunks yield their matrices independently, the matrices are combined
associatively, and every chunk then traces its own pieces back between the two
states it was given. No piece crosses the blank before a word, so texts that fit
one chunk are cut word by word, and each different word once.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import packed

#: Characters of a chunk; longer texts are giants.
CHUNK = 1 << 16
#: Words whose pieces a worker remembers.
REMEMBERED = 500_000
#: Bytes of texts whose words are looked up at a time.
PORTION = 1 << 20
#: Words that are cut together.
TOGETHER = 16_000
NEVER = -(1 << 60)
#: An unknown character scores this much less than the last piece.
UNKNOWN_PENALTY = 10


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces with blanks as they stand in a text, and integer scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, int]] = {}
        self.byte_ids = [0] * 256
        bodies = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                bodies.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                bodies.append(b"")
            else:
                text = piece.replace("▁", " ")
                bodies.append(text.encode())
                self.pieces[text] = (round(model.get_score(i)), i)
        # Runs of blanks score far below all others and would never be chosen.
        real = [s for s, _ in self.pieces.values() if s > -1_000_000]
        self.unknown = min(real) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.pieces))
        self.bodies = np.frombuffer(b"".join(bodies), np.uint8)
        self.body_lengths = np.array([len(b) for b in bodies], np.int64)
        self.body_starts = np.cumsum(self.body_lengths) - self.body_lengths
        # Every beginning of a piece, with what it is itself, to stop early.
        self.begins: dict[str, tuple[int, int] | None] = {p[:i]: None for p in self.pieces for i in range(1, len(p))}
        self.begins |= self.pieces
        self._grow()
        self.lines_apart = not any("\n" in p for p in self.pieces)
        self.segments = re.compile(r" *[^ \n]+| +|\n" if self.lines_apart else r"(?s) *[^ ]+| +")

    def _grow(self) -> None:
        """The beginnings as a trie in arrays, and the place of each node's children:
        ``child[base[node] + sign]`` if ``parent`` there is the node. Signs number the characters of pieces."""
        signs = sorted(set("".join(self.pieces)))
        self.sign_of = np.zeros(sys.maxunicode + 1, np.int32)
        self.sign_of[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        names = ["", *sorted(self.begins)]
        number = {name: i for i, name in enumerate(names)}
        children: dict[int, list[tuple[int, int]]] = {}
        for name in names[1:]:
            children.setdefault(number[name[:-1]], []).append((int(self.sign_of[ord(name[-1])]), number[name]))
        room = 16 * len(names) + len(signs) + 1
        self.base, parent, child = np.zeros(len(names), np.int32), np.full(room, -1, np.int32), np.zeros(room, np.int32)
        # Nodes with many children first, each where all of them find room.
        tries = np.random.default_rng(0)
        for node in sorted(children, key=lambda i: -len(children[i])):
            own = np.array([sign for sign, _ in children[node]])
            at = 0
            while (parent[at + own] >= 0).any():
                at = int(tries.integers(16 * len(names)))
            self.base[node], parent[at + own] = at, node
            child[at + own] = [i for _, i in children[node]]
        self.parent, self.child = parent, child
        found = [self.begins.get(name) for name in names]
        self.gain = np.array([hit[0] if hit else NEVER for hit in found], np.int64)
        self.piece = np.array([hit[1] if hit else -1 for hit in found], np.int32)

    def best_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``best`` of many short texts: all ids one after another, the number of each
        text's ids, and the scores. Texts take a step together; none is empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        signs = self.sign_of[points]
        longest = int(lengths.max(initial=0))
        left = np.repeat(ends, lengths) - np.arange(len(points))
        # What may be read from every place: per length, the places and their nodes.
        at, node, edges = np.arange(len(points)), np.zeros(len(points), np.int32), []
        for n in range(1, self.longest + 1):
            spot = self.base[node] + signs[at + n - 1]
            good = (self.parent[spot] == node) & (signs[at + n - 1] > 0)
            if n == 1:
                unknown = np.flatnonzero(~good | (self.piece[self.child[spot]] < 0))
                edges.append((unknown, np.ones(len(unknown), np.int64), np.full(len(unknown), -1, np.int32), np.full(len(unknown), self.unknown)))
            at, node = at[good], self.child[spot[good]]
            real = self.piece[node] >= 0
            edges.append((at[real], np.full(int(real.sum()), n), self.piece[node[real]], self.gain[node[real]]))
            more = left[at] > n
            at, node = at[more], node[more]
            if not len(at):
                break
        start, size, piece, gain = (np.concatenate(x) for x in zip(*edges))
        # One place more for each text's end; steps go by the place in the text, then by length.
        word = np.repeat(np.arange(len(words)), lengths)
        offset = np.arange(len(points)) - (ends - lengths)[word]
        kind = offset[start] * (self.longest + 1) + size
        order = np.argsort(kind.astype(np.uint32), kind="stable")
        cuts = np.flatnonzero(np.diff(kind[order], prepend=-1, append=-1))
        source, size, piece, gain = (start + word[start])[order], size[order], piece[order], gain[order]
        score = np.full(len(points) + len(words), NEVER, np.int64)
        score[ends - lengths + np.arange(len(words))] = 0
        came, took = np.zeros(len(score), np.int8), np.full(len(score), -1, np.int32)
        for low, high in zip(cuts[:-1], cuts[1:]):
            here, n = source[low:high], int(size[low])
            value, to = score[here] + gain[low:high], here + n
            # Every place can be reached, by unknown characters if not otherwise.
            better = value > score[to]
            to = to[better]
            score[to], came[to], took[to] = value[better], n, piece[low:high][better]
        # Back from the ends, all texts a piece at a time.
        last = ends + np.arange(len(words))
        begin, who, back = last - lengths, np.arange(len(words)), []
        now = last.copy()
        while len(who):
            back.append((who, now, took[now]))
            now = now - came[now]
            more = now > begin[who]
            who, now = who[more], now[more]
        who, now, took = (np.concatenate(x) for x in zip(*back)) if back else [np.empty(0, np.int64)] * 3
        order = np.argsort(now, kind="stable")
        who, now, ids = who[order], now[order], took[order]
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            # An unknown character becomes its bytes.
            raw = [chr(c).encode() for c in points[now[odd] - who[odd] - 1].tolist()]
            times = np.ones(len(ids), np.int64)
            times[odd] = [len(b) for b in raw]
            ids, who = np.repeat(ids, times), np.repeat(who, times)
            ids[ids < 0] = [self.byte_ids[b] for b in b"".join(raw)]
        return ids, np.bincount(who, minlength=len(words)), score[last]

    def choices(self, text: str, at: int) -> Iterator[tuple[int, int, int]]:
        """Length, score and id of every piece at a place; id -1 for an unknown."""
        get = self.pieces.get
        known = False
        for n in range(1, min(self.longest, len(text) - at) + 1):
            hit = get(text[at : at + n])
            if hit:
                known |= n == 1
                yield n, hit[0], hit[1]
        if not known:
            yield 1, self.unknown, -1

    def must_cut(self, text: str, at: int) -> bool:
        """Whether no piece crosses a place: before the blanks of a word, and
        around a line end if no piece has one."""
        if text[at] == " ":
            return text[at - 1] != " "
        return self.lines_apart and (text[at] == "\n" or text[at - 1] == "\n")

    def best(self, text: str, start: int = 0, end: int | None = None, over: int = 0) -> tuple[list[int], int]:
        """Ids and score of the best cut from ``start`` to ``over`` characters past ``end``,
        with no boundary between ``end`` and there; ties take the first found."""
        if end is None:
            return self._best_word(text)
        stop = end + over
        score, came = [NEVER] * (stop + 1), [None] * (stop + 1)
        score[start] = 0
        for at in range(start, end):
            here = score[at]
            if here == NEVER:
                continue
            for n, gain, piece in self.choices(text, at):
                to = at + n
                if (to <= end or to == stop) and here + gain > score[to]:
                    score[to], came[to] = here + gain, (at, piece)
        ids: list[int] = []
        at = stop
        while at > start:
            before, piece = came[at]
            ids += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(text[before:at].encode())]
            at = before
        return ids[::-1], score[stop]

    def _best_word(self, text: str) -> tuple[list[int], int]:
        """``best`` of a whole short text; most texts are single words."""
        n, get = len(text), self.begins.get
        score, came = [NEVER] * (n + 1), [(0, -1)] * (n + 1)
        score[0] = 0
        for at in range(n):
            here = score[at]
            if here == NEVER:
                continue
            to = at + 1
            if not get(text[at:to]):
                # An unknown character, though longer pieces may begin with it.
                if here + self.unknown > score[to]:
                    score[to], came[to] = here + self.unknown, (at, -1)
            while to <= n:
                hit = get(text[at:to], 0)
                if hit:
                    value = here + hit[0]
                    if value > score[to]:
                        score[to], came[to] = value, (at, hit[1])
                elif hit == 0:
                    break
                to += 1
        ids: list[int] = []
        at = n
        while at:
            before, piece = came[at]
            ids += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(text[before:at].encode())]
            at = before
        return ids[::-1], score[n]

    def transfer(self, text: str, size: int) -> np.ndarray:
        """Best scores from every overhang at the start of a chunk of ``size``
        characters to every overhang past its end; ``text`` looks on further."""
        width = self.longest
        reach = np.full((size + width, width), NEVER, np.int64)
        for i in range(min(width, size)):
            reach[i, i] = 0
        for at in range(size):
            here = reach[at]
            if here.max() <= NEVER // 2:
                continue
            for n, gain, _ in self.choices(text, at):
                np.maximum(reach[at + n], here + gain, out=reach[at + n])
        out = reach[size : size + width].T.copy()
        # A piece may reach over all of a short last chunk.
        for i in range(size, width):
            out[i, i - size] = 0
        out[out < NEVER // 2] = NEVER
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, without the blank that encoding put in front."""
        index = packed.ragged(self.body_starts[ids], self.body_lengths[ids])
        return self.bodies[index].tobytes()[1:]


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices."""
    out = np.full(left.shape, NEVER, np.int64)
    for k in range(left.shape[-1]):
        np.maximum(out, left[:, :, k, None] + right[:, None, k, :], out=out)
    return np.maximum(out, NEVER)


def scan(matrices: np.ndarray) -> np.ndarray:
    """Products of all first 1, 2, ... matrices, in a logarithmic number of steps."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = combine(out[:-step].copy(), out[step:])
        step *= 2
    return out


class Encoder:
    """Texts of one chunk, word by word, with the words' pieces remembered."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.scores = np.zeros(0, np.int64)

    def codes(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.index))
        if len(self.index) + len(new) > REMEMBERED:
            self.clear()
            new = list(set(words))
        if new:
            parts = [self.vocabulary.best_of(new[low : low + TOGETHER]) for low in range(0, len(new), TOGETHER)]
            ids, lengths, scores = map(np.concatenate, zip(*parts))
            self.scores = np.append(self.scores, scores)
            self.index.update(zip(new, range(len(self.lengths), len(self.lengths) + len(new))))
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lengths) - lengths)
            self.lengths = np.append(self.lengths, lengths)
            self.flat = np.append(self.flat, ids)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def ids(self, codes: np.ndarray) -> np.ndarray:
        return self.flat[packed.ragged(self.starts[codes], self.lengths[codes])]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the n + 1 offsets."""
        split = [self.vocabulary.segments.findall(" " + t) if t else [] for t in texts]
        codes = self.codes([w for s in split for w in s])
        ends = np.cumsum(np.append(0, self.lengths[codes]))
        return self.ids(codes), ends[np.cumsum([0, *map(len, split)])]

    def _whole_words(self, text: str, size: int) -> tuple[int, int] | None:
        """The first and the last forced cut of a chunk, if it has any."""
        cut = self.vocabulary.must_cut
        size = min(size, len(text) - 1)
        first = next((p for p in range(1, size + 1) if cut(text, p)), None)
        return None if first is None else (first, next(p for p in range(size, 0, -1) if cut(text, p)))

    def transfer(self, text: str, size: int) -> np.ndarray:
        """The matrix of a chunk. All paths meet at the forced cuts, so only what
        is before the first and after the last depends on the states."""
        words = self._whole_words(text, size)
        if words is None:
            return self.vocabulary.transfer(text, size)
        first, last = words
        head = self.vocabulary.transfer(text[:first], first)[:, 0]
        tail = self.vocabulary.transfer(text[last:], size - last)[0]
        codes = self.codes(self.vocabulary.segments.findall(text[first:last]))
        middle = int(self.scores[codes].sum())
        return np.maximum(head[:, None] + middle + tail[None, :], NEVER)

    def trace(self, text: str, size: int, enter: int, leave: int) -> np.ndarray:
        """The pieces of a chunk between two states."""
        if enter >= size:
            return np.empty(0, np.int64)
        words = self._whole_words(text, size)
        best = self.vocabulary.best
        if words is None:
            return np.array(best(text, enter, size, leave)[0], np.int64)
        first, last = words
        middle = self.ids(self.codes(self.vocabulary.segments.findall(text[first:last])))
        head, tail = best(text[:first], enter, first)[0], best(text[last:], 0, size - last, leave)[0]
        return np.concatenate([np.array(head, np.int64), middle, np.array(tail, np.int64)])


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


ENCODED = "doc_id long, text string, ids binary"


def _small(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            blobs = []
            # Few texts at a time, so that their words take little memory.
            _, bounds = packed.utf8(batch.column(1))
            for low, high in packed.groups_of(bounds, PORTION):
                ids, offsets = encoder.encode(batch.column(1)[low:high].to_pylist())
                raw = ids.astype("<u4")
                blobs += [raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["doc_id", "text", "ids"])
        # Several workers of an executor take turns at this and at decoding; only those at work remember.
        encoder.clear()
        packed.release()

    return run


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            sizes, texts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            blobs = [encoder.transfer(t, n).tobytes() for t, n in zip(texts, sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blobs, pa.binary())], names=["doc_id", "crc", "chunk", "matrix"])

    return run


def _states(table: pa.Table) -> pa.Table:
    """The best states at both ends of every chunk of a text."""
    table = table.sort_by("chunk")
    blobs = packed.joined(table["matrix"]).view(np.int64)
    width = int(round((len(blobs) // table.num_rows) ** 0.5))
    matrices = blobs.reshape(table.num_rows, width, width)
    # Best score from the start of the text to every state after every chunk.
    to = scan(matrices)[:, 0, :]
    exits = np.zeros(len(to), np.int64)
    for i in range(len(to) - 1, 0, -1):
        exits[i - 1] = int(np.argmax(to[i - 1] + matrices[i][:, exits[i]]))
    return table.drop_columns(["matrix"]).append_column("enter", pa.array(np.append(0, exits[:-1]))).append_column("leave", pa.array(exits))


def _traced(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            states = zip(*(batch.column(i).to_pylist() for i in (4, 3, 5, 6)))
            blobs = [encoder.trace(*state).astype("<u4").tobytes() for state in states]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blobs, pa.binary())], names=["doc_id", "crc", "chunk", "ids"])

    return run


def encode(docs: DataFrame, model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, text, ids`` of every row; ids are packed as little-endian 32-bit.

    A blank goes in front of a text, characters that no piece has become their
    bytes, and NULL and empty texts have no ids. Repeated rows and rows without an
    id are encoded like any other; an empty table gives an empty result. Other
    columns are not read. The scores are those of the model, summed.
    """
    path = model or default_model()
    packed.small_batches(docs.sparkSession)
    width = _encoder(path).vocabulary.longest
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    small = source.where(F.length("text") < chunk).mapInArrow(_small(path), ENCODED)
    # Equal giants are encoded once.
    giants = source.where(F.length("text") >= chunk).withColumn("crc", F.xxhash64("text"))
    giants = giants.groupBy("doc_id", "crc").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    whole = F.concat(F.lit(" "), F.col("text"))
    count = F.ceil((F.length("text") + 1) / F.lit(chunk)).cast("int")
    chunks = giants.select("doc_id", "crc", whole.alias("text"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"), F.length("text").alias("n"))
    chunks = chunks.select(
        "doc_id",
        "crc",
        F.col("chunk"),
        F.least(F.lit(chunk), F.col("n") + 1 - F.col("chunk") * chunk).cast("int").alias("size"),
        F.substring("text", F.col("chunk") * chunk + 1, F.lit(chunk + width)).alias("part"),
    )
    chunks = chunks.repartition("doc_id", "crc", "chunk")
    key = "doc_id long, crc long, chunk int"
    states = chunks.mapInArrow(_matrices(path), f"{key}, matrix binary").groupBy("doc_id", "crc")
    states = states.applyInArrow(_states, f"{key}, enter long, leave long")
    names = {"doc_id": "d", "crc": "z", "chunk": "c"}
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("crc") == F.col("z")) & (F.col("chunk") == F.col("c"))
    placed = chunks.join(states.withColumnsRenamed(names), same).drop("d", "z", "c")
    traced = placed.mapInArrow(_traced(path), f"{key}, ids binary").groupBy("doc_id", "crc")
    ids = traced.agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    # Binary parts are joined in the order of their chunks.
    ids = ids.select(F.col("doc_id").alias("d"), F.col("crc").alias("z"), F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("crc") == F.col("z"))
    large = giants.join(ids, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return small.unionByName(large.select("doc_id", "text", "ids"))


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _encoder(path).vocabulary
        for batch in batches:
            out = []
            for blob in batch.column("ids"):
                raw = blob.as_buffer()
                out.append(vocabulary.decode(np.frombuffer(raw, "<u4")).decode("utf-8", "replace") if raw.size else "")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])
        packed.release()

    return run


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """All columns with ``decoded``, the text of ``ids``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(_decoded(model or default_model()), f"{fields}, decoded string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, n_chars, n_pieces, ids_crc32, decoded_sha256, exact`` of every row."""
    done = decode(encode(docs, model), model)
    return done.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        (F.length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("exact"),
    )
