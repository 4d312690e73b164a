"""Quality classifier: hashed word and character n-gram vectors, averaged per document, with a softmax on top."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import mix64, narrow, ranges, release, tidy, word_hashes, word_slices

#: Bytes of text whose features are held at a time.
SLICE = 1 << 20
#: Rows of the vector table. A training document has at most as many entries.
BUCKETS = 1 << 18
DIM = 8
CHAR_GRAMS = (3, 4)
#: Expected number of labelled documents that the model is fitted on, drawn by a hash of their id.
TRAIN_ROWS = 4_000
#: Passes over the training texts; few texts are passed over more often, until there are enough steps.
EPOCHS = 6
LEAST_STEPS = 6_000
RATE = 0.25
SEED = 8
THRESHOLD = 0.3
_SALT = {k: np.uint64(v) for k, v in (("word", 0x9E3779B97F4A7C15), ("pair", 0xC2B2AE3D27D4EB4F), ("again", 0x165667B19E3779F9), ("char", 0x27D4EB2F165667C5))}


def _bucket(h: np.ndarray, salt: str) -> np.ndarray:
    return (mix64(h ^ _SALT[salt]) % np.uint64(BUCKETS)).astype(np.int32)


def word_features(distinct: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each distinct word (itself and its character n-grams), flat, and how many each word has."""
    marked = "".join(f"<{w}>" for w in distinct.to_pylist())
    chars = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    import pyarrow.compute as pc
    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    first = np.cumsum(length) - length
    owner, found = [np.arange(len(length))], [_bucket(hashes, "word")]
    for n in CHAR_GRAMS:
        many = np.maximum(length - n + 1, 0)
        at = ranges(first, many)
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + chars[at + k]
        found.append(_bucket(h + np.uint64(n), "char"))
        owner.append(np.repeat(np.arange(len(length)), many))
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return found[order], np.bincount(owner, minlength=len(length))


def pair_features(codes: np.ndarray, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each pair of neighbouring words of a text, and the text of each; a word said again is one pair whatever it is."""
    n = np.maximum(np.diff(offsets) - 1, 0)
    at = ranges(offsets[:-1], n)
    a, b = codes[at], codes[at + 1]
    pair = _bucket(hashes[a] * np.uint64(3) + hashes[b], "pair")
    return np.where(a == b, _bucket(np.zeros(1, np.uint64), "again")[0], pair), np.repeat(np.arange(len(n)), n)


@dataclass
class Model:
    """vectors (BUCKETS x DIM), out (DIM x 2) and bias (2): softmax(mean of a text's vectors · out + bias)."""

    vectors: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    trained_on: int

    def gains(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log odds of label 1, and the log odds of a text without words.

        The mean and the output layer are linear, so scoring needs one number a bucket.
        """
        return (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent over (distinct buckets, counts) of each text.

    A step for the vectors is scaled by the text's number of features, so that long
    and short texts move their mean equally far. Vectors start at zero: a feature
    that no training text has adds nothing.
    """
    rng = np.random.default_rng(seed)
    vectors = np.zeros((BUCKETS, DIM), np.float32)
    out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    share = np.clip(np.bincount(labels, minlength=2) / max(len(labels), 1), 0.01, 0.99) if len(labels) else np.array([0.5, 0.5])
    bias = np.log(share).astype(np.float32)
    epochs = max(epochs, -(-LEAST_STEPS // max(len(texts), 1))) if texts else 0
    steps, done = max(1, epochs * len(texts)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            at, counts = texts[i]
            if not len(at):
                continue
            weight = (counts / counts.sum()).astype(np.float32)
            rows = vectors[at]
            mean = weight @ rows
            z = mean @ out + bias
            e = np.exp(z - z.max())
            gap = e / e.sum()
            gap[labels[i]] -= 1
            back = out @ gap
            out -= lr * np.outer(mean, gap)
            vectors[at] = rows - (lr / (weight @ weight)) * np.outer(weight, back)
    return Model(vectors, out, bias, len(texts))


def _training_rows(batches):
    """doc buckets and counts of whole texts, as bytes."""
    for batch in batches:
        for at, _, codes, distinct, offsets in word_slices(batch.column("text"), SLICE):
            hashes = word_hashes(distinct)
            flat, many = word_features(distinct, hashes)
            first = np.cumsum(many) - many
            pairs, doc = pair_features(codes, hashes, offsets)
            ends = np.searchsorted(doc, np.arange(len(offsets)))
            buckets, counts = [], []
            for d in range(len(offsets) - 1):
                c = codes[offsets[d]:offsets[d + 1]]
                every = np.concatenate([flat[ranges(first[c], many[c])], pairs[ends[d]:ends[d + 1]]])
                b, n = np.unique(every, return_counts=True)
                buckets.append(b.astype("<i4").tobytes()), counts.append(n.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(at, len(buckets)), batch.column("key").slice(at, len(buckets)),
                                              pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())], ["label", "key", "buckets", "counts"])


def held_out(id_col: str | Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text is divisible by 5."""
    c = F.col(f"`{id_col}`") if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """A model of ``label_col`` (0 or 1), from labelled rows that are not held out.

    About ``train_rows`` of them are drawn by a hash of the id; with fewer, all are
    used. Their distinct buckets, never their texts, meet in one task that learns from
    them; the driver gets the model. Labels that
    are null or not 0/1 and ids that are null are ignored; an id with several labels
    counts with the smallest. Without any label the model scores every text 0.5.
    """
    key = F.col(f"`{id_col}`")
    known = (narrow(labels, key=key, label=F.col(f"`{label_col}`").cast("int")).filter(F.col("label").isin(0, 1) & F.col("key").isNotNull())
             .filter(~held_out("key")).groupBy("key").agg(F.min("label").alias("label")))
    n = known.count()
    share = min(1.0, train_rows / max(n, 1))
    drawn = known.filter(F.pmod(F.xxhash64(F.lit(seed), F.col("key")), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = narrow(documents, doc=key, text=F.col(f"`{text_col}`").cast("string"))
    joined = texts.join(F.broadcast(drawn), texts["doc"] == drawn["key"]).select(F.col("label"), F.xxhash64("key").alias("key"), "text")
    features = joined.mapInArrow(tidy(_training_rows), "label int, key bigint, buckets binary, counts binary")

    def learned(batches):
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("key", "buckets", "counts", "label"))))
        model = train([(np.frombuffer(b, "<i4"), np.frombuffer(c, "<i4")) for _, b, c, _ in rows], np.array([r[3] for r in rows], np.int64), epochs, rate, seed)
        yield pa.RecordBatch.from_pylist([{"vectors": model.vectors.tobytes(), "out": model.out.tobytes(), "bias": model.bias.tobytes(), "n": model.trained_on}],
                                         pa.schema([("vectors", pa.binary()), ("out", pa.binary()), ("bias", pa.binary()), ("n", pa.int64())]))

    # One task, as gradient steps follow each other; it holds the bounded sample, and another executor can take it over.
    got = features.repartition(1).mapInArrow(tidy(learned), "vectors binary, out binary, bias binary, n bigint").first()
    vectors, out, bias = (np.frombuffer(got[c], np.float32) for c in ("vectors", "out", "bias"))
    return Model(vectors.reshape(BUCKETS, DIM), out.reshape(DIM, 2), bias, got["n"])


def score(model: Model, text: str | Column = "text") -> Column:
    """Probability of label 1 of a whole text, from nothing but the text; null and empty texts get that of no words."""
    gains, start = model.gains()

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        out = []
        for _, _, codes, distinct, offsets in word_slices(texts, SLICE):
            hashes = word_hashes(distinct)
            flat, many = word_features(distinct, hashes)
            each = np.bincount(np.repeat(np.arange(len(many)), many), weights=gains[flat], minlength=len(many))
            pairs, doc = pair_features(codes, hashes, offsets)
            n = len(offsets) - 1
            owner = np.repeat(np.arange(n), np.diff(offsets))
            total = np.bincount(owner, weights=each[codes], minlength=n) + np.bincount(doc, weights=gains[pairs], minlength=n)
            features = np.bincount(owner, weights=many[codes], minlength=n) + np.bincount(doc, minlength=n)
            out.append(1 / (1 + np.exp(-(start + total / np.maximum(features, 1)))))
        release()
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return scored(F.col(text).cast("string") if isinstance(text, str) else text.cast("string"))


def classify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Every row is scored alone: repeated rows get equal scores, an empty table an
    empty result, and other columns are not read.
    """
    rows = narrow(documents, doc_id=id_col, text=F.col(f"`{text_col}`").cast("string"))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), score(model, "text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
