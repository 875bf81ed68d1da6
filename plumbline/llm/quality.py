"""Document quality by attention over passages (operator 1).

A document is a bag of passages. Each passage is encoded by counts over its
characters and words; a gated attention layer, learned from the labels of whole
documents, weighs the encoded passages, and their weighted sum is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import packed
from plumbline.llm.language import is_held_out

#: Labelled documents that the model is fitted on, at most, and passages of each.
SAMPLE, BAG = 8000, 64
#: Words of a passage.
PASSAGE = 64
HIDDEN, GATE = 24, 12
STEPS, BATCH, RATE, DECAY = 900, 256, 0.01, 1e-4
ACCEPTED = 0.7

#: The class of every byte: each ASCII sign has its own, letters by case.
CLASSES = np.zeros(256, np.int64)
_signs = [b for b in range(33, 127) if not chr(b).isalnum()]
for _i, _b in enumerate(_signs):
    CLASSES[_b] = _i
_next = len(_signs)
for _n, _bytes in enumerate(
    (range(65, 91), range(97, 123), range(48, 58), (32,), (10, 13), [*range(9), 9, 11, 12, *range(14, 32), 127], range(128, 256))
):
    CLASSES[list(_bytes)] = _next + _n
KINDS = _next + 7
#: Besides the classes: mean word length, distinct words, repeated words, words
#: like the one before, repeated pairs of words, passage length.
FEATURES = KINDS + 6


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and the n + 1 passage offsets of the rows."""
    low, high, at = packed.words_of(data, offsets)
    words = np.diff(at)
    number = -(-words // PASSAGE)
    bounds = np.cumsum(np.append(0, number))
    out = np.zeros((int(bounds[-1]), FEATURES), np.float32)
    if not len(low):
        return out, bounds
    first = packed.ragged(np.zeros(len(number), np.int64), number) * PASSAGE + np.repeat(at[:-1], number)
    row_of_word = np.repeat(np.arange(len(words)), words)
    passage = bounds[row_of_word] + (np.arange(len(low)) - at[row_of_word]) // PASSAGE
    size = np.bincount(passage, minlength=len(out)).astype(float)
    begin, last = low[first], np.append(first[1:], len(low)) - 1
    end = high[last]
    # Every byte between two passages' starts counts for the first.
    edges = np.append(begin, end[-1])
    span = np.repeat(np.arange(len(out)), np.diff(edges))
    inside = data[begin[0] : end[-1]]
    counts = np.bincount(span * KINDS + CLASSES[inside], minlength=len(out) * KINDS).reshape(len(out), KINDS)
    out[:, :KINDS] = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    hashes = packed.word_hashes(data, low, high)
    pair = packed.mix(hashes[:-1] * np.uint64(3) + hashes[1:])
    out[:, KINDS] = np.bincount(passage, high - low, len(out)) / size / 10

    def again(values, group):
        """Whether a value was met before in its group."""
        order = np.lexsort((values, group))
        v, g = values[order], group[order]
        met = np.zeros(len(v), bool)
        met[order[1:]] = (v[1:] == v[:-1]) & (g[1:] == g[:-1])
        return met

    here, earlier = again(hashes, passage), again(hashes, row_of_word)
    out[:, KINDS + 1] = np.bincount(passage, ~here, len(out)) / size
    out[:, KINDS + 2] = np.bincount(passage, earlier, len(out)) / size
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (row_of_word[1:] == row_of_word[:-1]))
    out[:, KINDS + 3] = np.bincount(passage, same, len(out)) / size
    pairs = np.append(False, again(pair, row_of_word[1:]) & (row_of_word[1:] == row_of_word[:-1]))
    out[:, KINDS + 4] = np.bincount(passage, pairs, len(out)) / size
    out[:, KINDS + 5] = np.minimum(1, size / PASSAGE)
    return out, bounds


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages with one of zeros for a row that has none."""
    features, bounds = passages(data, offsets)
    bare = np.flatnonzero(np.diff(bounds) == 0)
    if len(bare):
        features = np.insert(features, bounds[bare], 0, axis=0)
        bounds = bounds + np.searchsorted(bare, np.arange(len(bounds)), "left")
    return features, bounds


@dataclass
class Model:
    """Gated attention: weights w.(tanh(Vh) * sigmoid(Uh)) over encoded passages h."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, features: np.ndarray, bounds: np.ndarray):
        p = self.weights
        x = np.clip((features - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        e = np.exp(e - np.maximum.reduceat(e, bounds[:-1])[owner])
        a = e / np.add.reduceat(e, bounds[:-1])[owner]
        z = np.add.reduceat(a[:, None] * h, bounds[:-1], axis=0)
        logit = z @ p["c"] + p["d"]
        return x, h, t, g, a, owner, z, logit

    def scores(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if len(bounds) < 2:
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.forward(features, bounds)[-1], -30, 30)))


def fit(features: np.ndarray, bounds: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Adam on the logistic loss of whole bags."""
    rng = np.random.default_rng(seed)
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
    n = features.shape[1]
    p = {
        "W": rng.normal(0, n**-0.5, (n, HIDDEN)),
        "b": np.zeros(HIDDEN),
        "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "w": rng.normal(0, GATE**-0.5, GATE),
        "c": rng.normal(0, HIDDEN**-0.5, HIDDEN),
        "d": np.zeros(()),
    }
    model = Model(mean, scale, p)
    one, two = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    sizes = np.diff(bounds)
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(labels), min(BATCH, len(labels)))
        rows = packed.ragged(bounds[pick], sizes[pick])
        local = np.cumsum(np.append(0, sizes[pick]))
        x, h, t, g, a, owner, z, logit = model.forward(features[rows], local)
        off = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[pick]) / len(pick)
        dz = off[:, None] * p["c"]
        # Through the softmax of each bag.
        da = np.sum(h * dz[owner], axis=1)
        mid = np.add.reduceat(a * da, local[:-1])
        de = a * (da - mid[owner])
        dtg = de[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = a[:, None] * dz[owner] + dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - h * h)
        grads = {
            "W": x.T @ dx,
            "b": dx.sum(axis=0),
            "V": h.T @ dt,
            "U": h.T @ dg,
            "w": (t * g).T @ de,
            "c": z.T @ off,
            "d": off.sum(),
        }
        rate = RATE * min(1.0, 2.0 * (1 - step / (STEPS + 1)))
        for k, grad in grads.items():
            grad = grad + DECAY * p[k]
            one[k] = 0.9 * one[k] + 0.1 * grad
            two[k] = 0.999 * two[k] + 0.001 * grad * grad
            p[k] = p[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = packed.utf8(batch.column(0))
        rows = []
        for low, high in packed.groups_of(offsets, packed.CHUNK):
            features, bounds = bags(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            for a, b in zip(bounds[:-1], bounds[1:]):
                some = features[np.unique(np.linspace(a, b - 1, min(BAG, b - a)).astype(int))]
                rows.append((len(some), some.tobytes()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([n for n, _ in rows], pa.int32()),
                pa.array([f for _, f in rows], pa.binary()),
                batch.column(1),
                batch.column(2),
            ],
            names=["n", "features", "label", "h"],
        )


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` labelled rows outside the held-out fold, chosen by a
    hash of the id, and on ``BAG`` evenly spaced passages of each. Their features,
    bounded by these two numbers, are what reaches the driver. None without labels
    of both kinds."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    known = known.select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "label").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("text", "label", "h").mapInArrow(_sampled, "n int, features binary, label int, h long").collect()
    rows = sorted(rows, key=lambda r: (r["h"], r["label"], r["features"]))[:sample]
    wanted = np.array([r["label"] for r in rows], float)
    if len(set(wanted)) < 2:
        return None
    features = np.frombuffer(b"".join(bytes(r["features"]) for r in rows), np.float32).reshape(-1, FEATURES)
    return fit(features.astype(float), np.cumsum([0, *(r["n"] for r in rows)]), wanted)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = packed.utf8(batch.column("text"))
            scores = [np.empty(0)]
            for low, high in packed.groups_of(offsets, packed.CHUNK):
                if model.value is None:
                    scores.append(np.full(high - low, 0.5))
                else:
                    part = bags(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                    scores.append(model.value.scores(*part))
            columns = [*batch.columns, pa.array(np.concatenate(scores), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "__score"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` with ``__score``, the probability of label 1.

    NULL and empty texts are scored as one empty passage; without a model every
    score is 0.5. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    packed.small_batches(spark)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(_scored(spark.sparkContext.broadcast(model)), ", ".join([*fields, "__score double"]))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    done = score(docs.select("doc_id", "text"), learn(docs, labels))
    return done.select(
        "doc_id",
        is_held_out().alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= ACCEPTED).cast("int").alias("predicted"),
    )
