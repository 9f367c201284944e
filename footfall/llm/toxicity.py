"""Toxicity: a logistic model whose score may not depend on the group that a text names.

Features are the distinct words of a text and their beginnings. Sentences that name a group
(identity terms) are paired with the same sentences naming another group of the same kind; the
squared difference of the two scores is added to the loss, so that a mention by itself, which
may go along with toxic labels by chance, gets no weight.

The model is fitted on a bounded sample of labelled rows (``most_toxic`` and ``most_clean``,
those with the smallest hash of their id); every text is scored by tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm.common import held, small_batches, written

MOST_TOXIC, MOST_CLEAN = 1_500, 3_000
SWAP_WEIGHT = 4.0
THRESHOLD = 0.7
# Groups of one kind, whose names may stand for one another.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "locals"), ("old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "deutsche"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "français"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "españoles"),
)
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…¡¿–—"
PREFIXES = (3, 4, 5, 6, 7, 8)
MOST_WORDS = 200_000


def swaps() -> dict[str, str]:
    """Each identity term with the next of its kind."""
    return {a: b for kind in IDENTITY_TERMS for a, b in zip(kind, (*kind[1:], kind[0]))}


def features_of(word: str) -> list[int]:
    """Hashes of a word and of its beginnings; none of a word without letters or digits."""
    import xxhash

    word = word.strip(EDGES)
    names = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)] if word else []
    return [xxhash.xxh64_intdigest(name) & 0x7FFF_FFFF_FFFF_FFFF for name in names]


def text_features(words: set[str]) -> np.ndarray:
    return np.unique(np.array([f for word in words for f in features_of(word)], np.int64))


@dataclass
class Model:
    """``weights`` of the ``features`` that count; a text's score is the logistic of their sum."""

    features: np.ndarray
    weights: np.ndarray
    start: float
    constant: float | None = None

    def lookup(self) -> dict[int, float]:
        return dict(zip(self.features.tolist(), self.weights.tolist()))


def training_rows(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int) -> DataFrame:
    """Features of the sampled labelled texts, as they are and with identity terms swapped."""
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    order = F.xxhash64("doc_id")
    sample = known.where("toxic = 1").orderBy(order, "doc_id").limit(most_toxic).unionAll(
        known.where("toxic = 0").orderBy(order, "doc_id").limit(most_clean))
    # At most most_toxic + most_clean pairs of numbers.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    other = swaps()

    def kernel(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            plain, swapped = [], []
            for text in batch.column("text").to_pylist():
                words = {w.strip(EDGES) for w in (text or "").lower().split()}
                found = words & other.keys()
                plain.append(text_features(words).tobytes())
                swapped.append(
                    text_features(words - found | {other[w] for w in found}).tobytes() if found else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(plain, pa.binary()), pa.array(swapped, pa.binary())],
                ["doc_id", "toxic", "plain", "swapped"],
            )

    return texts.mapInArrow(kernel, "doc_id long, toxic int, plain binary, swapped binary")


class Sparse:
    """Rows of places of features."""

    def __init__(self, rows: list[np.ndarray]):
        self.columns = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
        self.rows = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n = len(rows)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights[self.columns], self.n)

    def spread(self, values: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.columns, values[self.rows], width)


def telling_features(rows: DataFrame, n_toxic: int, n_clean: int) -> np.ndarray:
    """Features whose share differs much between toxic and clean rows, and those of identity terms.

    Features that four or fewer of the texts have are left out. They are counted and chosen by
    tasks; only those that are chosen reach the driver.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(x, np.int64) for x in batch.column("plain").to_pylist()]
            names, at = np.unique(np.concatenate([*texts, np.empty(0, np.int64)]), return_inverse=True)
            toxic = np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False), [len(t) for t in texts])
            found = np.bincount(at, minlength=len(names)), np.bincount(at, toxic, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names, *found)], ["feature", "n", "bad"])

    counts = rows.select("toxic", "plain").mapInArrow(kernel, "feature long, n long, bad long").groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad")).where("n > 4")
    share = F.col("n") / (n_toxic + n_clean)
    gap = F.col("bad") / n_toxic - (F.col("n") - F.col("bad")) / n_clean
    surprise = F.abs(gap) / F.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean) + 1e-12)
    chosen = [r["feature"] for r in counts.where(surprise > 4).select("feature").collect()]
    return np.unique(np.array([*chosen, *(f for word in swaps() for f in features_of(word))], np.int64))


def positions(features: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places in the ordered ``chosen`` of those features that are there."""
    at = np.searchsorted(chosen, features)
    return at[(at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == features)].astype(np.int32)


def in_positions(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """``rows`` with the places of their chosen features instead of all features."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                pa.array([None if x is None else positions(np.frombuffer(x, np.int64), chosen).tobytes()
                          for x in batch.column(name).to_pylist()], pa.binary())
                for name in ("plain", "swapped")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *found], batch.schema.names)

    return rows.mapInArrow(kernel, rows.schema)


def fit(chosen: np.ndarray, toxic: np.ndarray, plain: list[np.ndarray], swapped: list[np.ndarray | None],
        swap_weight: float = SWAP_WEIGHT, ridge: float = 0.02, rounds: int = 400) -> Model:
    """Logistic regression with the swap penalty, by accelerated gradient steps, over texts given
    as places in the ``chosen`` features. Both labels must occur."""
    toxic = toxic.astype(float)
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    x = Sparse(plain)
    pairs = [i for i, s in enumerate(swapped) if s is not None]
    xa, xb = Sparse([plain[i] for i in pairs]), Sparse([swapped[i] for i in pairs])
    # Both kinds weigh alike; ridge keeps weights finite where one feature settles all.
    weight = np.where(toxic > 0, 0.5 / n1, 0.5 / n0)
    width = len(chosen)
    w = previous = np.zeros(width + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def slope(v: np.ndarray) -> np.ndarray:
        miss = weight * (sigmoid(x.sums(v[:-1]) + v[-1]) - toxic)
        out = np.append(x.spread(miss, width) + ridge * 1e-2 * v[:-1], miss.sum())
        if pairs:
            a, b = sigmoid(xa.sums(v[:-1]) + v[-1]), sigmoid(xb.sums(v[:-1]) + v[-1])
            da, db = (a - b) * a * (1 - a), (a - b) * b * (1 - b)
            scale = 2 * swap_weight / len(pairs)
            out[:-1] += scale * (xa.spread(da, width) - xb.spread(db, width))
            out[-1] += scale * (da - db).sum()
        return out

    # A bound of the curvature gives a step that cannot overshoot.
    per_row = np.bincount(x.rows, minlength=x.n) + 1
    step = 1 / (0.25 * float((weight * per_row).sum()) + (swap_weight * per_row.max() * 0.25 if pairs else 0) + ridge)
    for k in range(rounds):
        ahead = w + k / (k + 3) * (w - previous)
        previous, w = w, ahead - step * slope(ahead)
    return Model(chosen, w[:-1], float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN,
          swap_weight: float = SWAP_WEIGHT) -> Model:
    """The model for ``docs``, from labelled rows whose ``crc32(doc_id) % 3`` is not 1.

    Several labels of an id: toxic if one says so. Null ids and null labels teach nothing.
    Without labels of both kinds every score is the toxic share of the labels, 0 if there are none.
    """
    small_batches(docs.sparkSession)
    rows = written(training_rows(docs, labels, most_toxic, most_clean))
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if n_toxic in (0, n):
        return Model(np.empty(0, np.int64), np.empty(0), 0.0, n_toxic / n if n else 0.0)
    chosen = telling_features(rows, n_toxic, n - n_toxic)
    known = in_positions(rows, chosen).collect()
    known.sort(key=lambda r: (r["doc_id"], r["toxic"], bytes(r["plain"])))
    read = lambda b: None if b is None else np.frombuffer(bytes(b), np.int32)
    return fit(chosen, np.array([r["toxic"] for r in known]), [read(r["plain"]) for r in known],
               [read(r["swapped"]) for r in known], swap_weight)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known, weights = model, {}, model.lookup()

        class Words(dict):
            def __missing__(self, word: str):
                if len(self) >= MOST_WORDS:
                    self.clear()
                found = self[word] = tuple(f for f in features_of(word) if weights.get(f))
                return found

        self.words, self.weights = Words(), weights

    def __call__(self, text: str) -> float:
        if self.model.constant is not None:
            return self.model.constant
        found = {f for fs in filter(None, map(self.words.__getitem__, set(text.lower().split()))) for f in fs}
        z = self.model.start + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-max(-40.0, min(40.0, z)))))


def scorer(features: bytes, weights: bytes, start: float, constant: float | None) -> Scorer:
    return Scorer(Model(np.frombuffer(features, np.int64), np.frombuffer(weights), start, constant))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; a row gives a row, null text counts as empty.

    Columns of ``docs`` by these names are replaced.
    """
    docs = docs.drop("score", "predicted")
    small_batches(docs.sparkSession)
    parts = (model.features.tobytes(), model.weights.tobytes(), model.start, model.constant)

    def kernel(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = held(("toxicity", *parts), lambda: scorer(*parts))
        for batch in rows:
            scores = pa.array([score(t or "") for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    scored = docs.mapInArrow(kernel, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
