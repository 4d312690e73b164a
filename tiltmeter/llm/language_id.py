"""Language of a text: the nearest of several centroids per language, by cosine of TF-IDF vectors of character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tables import control_table
from .classifier import held_out
from .common import mix64, narrow, ranges, release, tidy, word_slices

#: Length of a vector; n-grams are hashed into it.
BUCKETS = 1 << 14
GRAMS = (1, 2, 3)
#: Expected number of documents that centroids are made of, an equal share for each language, drawn by a hash of their id.
TRAIN_ROWS = 3_000
CENTROIDS = 4
ROUNDS = 12
#: A text is rejected if it is further from its centroid than this share of the training texts there, and SLACK.
FAR_SHARE = 0.99
SLACK = 0.05
#: More different labels than this are not languages.
MOST_LANGUAGES = 5_000
SEED = 12
#: Texts whose vectors are held at a time.
ROWS = 64
UNKNOWN = "und"
RESULT = "struct<nearest:string,similarity:double,rejected:boolean>"


def word_grams(distinct: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word (small letters and marks only, a blank on both sides), flat, and how many each has."""
    letters = pc.replace_substring_regex(pc.utf8_lower(distinct.cast(pa.string())), r"[^\p{L}\p{M}]+", "")
    n = pc.utf8_length(letters).to_numpy(zero_copy_only=False).astype(np.int64)
    length = np.where(n > 0, n + 2, 0)
    chars = np.frombuffer("".join(f" {w} " for w in letters.to_pylist() if w).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first, word = np.cumsum(length) - length, np.arange(len(length))
    found, owner = [], []
    for size in GRAMS:
        # A blank alone says nothing, so single characters leave out the ends.
        many = n if size == 1 else np.maximum(length - size + 1, 0)
        at = ranges(first + (size == 1), many)
        h = np.full(len(at), size, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x100000001B3) + chars[at + k]
        found.append((mix64(h) % np.uint64(buckets)).astype(np.int32))
        owner.append(np.repeat(word, many))
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return found[order], np.bincount(owner, minlength=len(length))


def counted(texts: pa.Array, buckets: int = BUCKETS):
    """(first row, counts of n-grams: a row of ``buckets`` per text) of a few texts at a time, over whole texts."""
    for at, part, codes, distinct, offsets in word_slices(texts):
        flat, many = word_grams(distinct, buckets)
        begin = np.cumsum(many) - many
        n_words = max(len(distinct), 1)
        row = np.repeat(np.arange(len(part)), np.diff(offsets))
        key, times = np.unique(row * n_words + codes, return_counts=True)
        ends = np.searchsorted(key, np.arange(len(part) + 1) * n_words)
        for a in range(0, len(part), ROWS):
            b = min(a + ROWS, len(part))
            k = key[ends[a]:ends[b]]
            word = k % n_words
            cell = np.repeat((k // n_words - a) * buckets, many[word]) + flat[ranges(begin[word], many[word])]
            n = np.bincount(cell, weights=np.repeat(times[ends[a]:ends[b]], many[word]), minlength=(b - a) * buckets)
            yield at + a, n.reshape(b - a, buckets)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length 1 (or 0): square roots of the counts times the inverse document frequencies."""
    x = np.sqrt(counts).astype(np.float32) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def cluster(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """At most ``k`` centroids of length 1 of the rows of ``x``, and the centroid of each row: k-means by cosine.

    The first centroids are rows far from each other, drawn with a seed.
    """
    rng = np.random.default_rng(seed)
    centers = x[rng.integers(len(x))][None]
    while len(centers) < min(k, len(x)):
        gap = np.maximum(1 - (x @ centers.T).max(axis=1), 0).astype(np.float64) ** 2
        if gap.sum() <= 1e-9:
            break
        centers = np.concatenate([centers, x[rng.choice(len(x), p=gap / gap.sum())][None]])
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.stack([x[own == c].sum(axis=0) for c in range(len(centers)) if (own == c).any()])
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = sums / np.where(norm > 0, norm, 1)
    return centers, (x @ centers.T).argmax(axis=1)


@dataclass
class Model:
    """Centroids (one column each) with their language and the greatest distance that is still near; empty without languages."""

    idf: np.ndarray
    centroids: np.ndarray
    language: list[str]
    limit: np.ndarray


def _vectors(batches, buckets):
    for batch in batches:
        for at, n in counted(batch.column("text"), buckets):
            found = [np.flatnonzero(r) for r in n]
            part = batch.slice(at, len(n))
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("key"), pa.array([f.astype("<i4").tobytes() for f in found], pa.binary()),
                                              pa.array([r[f].astype("<f4").tobytes() for r, f in zip(n, found)], pa.binary())], ["lang", "key", "at", "n"])


def _document_frequencies(batches, buckets):
    """One row per bucket and task: documents that have it; bucket -1 counts all of them."""
    seen, rows = np.zeros(buckets, np.int64), 0
    for batch in batches:
        for _, n in counted(batch.column("text"), buckets):
            seen += (n > 0).sum(axis=0)
            rows += len(n)
    at = np.flatnonzero(seen)
    release()
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], rows), pa.int64())], ["bucket", "docs"])


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS,
        centroids: int = CENTROIDS, buckets: int = BUCKETS, far_share: float = FAR_SHARE, slack: float = SLACK, seed: int = SEED) -> Model:
    """Centroids of every language, from documents that are not held out.

    Document frequencies cover all of these; the centroids of a language come from
    about ``train_rows`` divided by the number of languages of its documents (all,
    if it has fewer), drawn by a hash of the id, one text per id. Each language is
    clustered in a task of its own, so only centroids reach the driver. Rows with a
    null id, language or text are not learned from; without any, the model is empty.
    """
    rows = narrow(documents, key=id_col, lang=F.col(f"`{lang_col}`").cast("string"), text=F.col(f"`{text_col}`").cast("string"))
    rows = rows.filter(F.col("key").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("key"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    known = sizes.limit(MOST_LANGUAGES + 1).count()
    if known > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = control_table(sizes.select("lang", F.least(F.lit(1.0), F.lit(train_rows / max(known, 1)) / F.col("n")).alias("share")))
    found = rows.select("text").mapInArrow(tidy(lambda b: _document_frequencies(b, buckets)), "bucket int, docs bigint")
    found = dict(found.groupBy("bucket").agg(F.sum("docs").alias("docs")).collect())
    n = found.pop(-1, 0)
    docs = np.zeros(buckets)
    docs[list(found)] = list(found.values())
    idf = (np.log((1 + n) / (1 + docs)) + 1).astype(np.float32)

    drawn = rows.join(share, "lang").filter(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    drawn = drawn.select("lang", F.xxhash64("key").alias("key"), "text").mapInArrow(tidy(lambda b: _vectors(b, buckets)), "lang string, key bigint, at binary, n binary")
    one = drawn.groupBy("lang", "key").agg(F.min(F.struct("at", "n")).alias("v")).select("lang", "key", "v.at", "v.n")

    def clustered(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        x = np.zeros((len(t), buckets), np.float32)
        for k, (at, count) in enumerate(zip(t.column("at").to_pylist(), t.column("n").to_pylist())):
            x[k, np.frombuffer(at, "<i4")] = np.frombuffer(count, "<f4")
        for a in range(0, len(x), ROWS):
            x[a:a + ROWS] = weighted(x[a:a + ROWS], idf)
        centers, own = cluster(x, centroids, seed)
        far = [float(np.quantile(1 - x[own == c] @ centers[c], far_share)) + slack if (own == c).any() else slack for c in range(len(centers))]
        release()
        return pa.table([[t.column("lang")[0].as_py()] * len(centers), list(range(len(centers))), [c.astype("<f4").tobytes() for c in centers], far],
                        schema=pa.schema([("lang", pa.string()), ("k", pa.int32()), ("center", pa.binary()), ("far", pa.float64())]))

    made = sorted(one.groupBy("lang").applyInArrow(clustered, "lang string, k int, center binary, far double").collect(), key=lambda r: (r.lang.encode(), r.k))
    centers = np.stack([np.frombuffer(r.center, "<f4") for r in made], axis=1) if made else np.zeros((buckets, 0), np.float32)
    return Model(idf, centers, [r.lang for r in made], np.array([r.far for r in made]))


def identify(model: Model, text: str | Column = "text") -> Column:
    """nearest language, similarity (cosine, 0 to 1) and whether the text is too far from its centroid to be trusted, of a whole text.

    A null text, one without a letter, and any text for an empty model have no
    nearest language (null), similarity 0 and are rejected. Ties go to the language
    that is first in byte order. Each text is judged alone, by nothing but itself.
    """
    @F.arrow_udf(RESULT)
    def judged(texts: pa.Array) -> pa.Array:
        near, alike, far = np.full(len(texts), -1, np.int64), np.zeros(len(texts)), np.ones(len(texts), bool)
        if model.language:
            for at, n in counted(texts, len(model.idf)):
                cosine = weighted(n, model.idf) @ model.centroids
                best = cosine.argmax(axis=1)
                rows = slice(at, at + len(n))
                alike[rows] = np.round(np.clip(cosine[np.arange(len(n)), best].astype(np.float64), 0, 1), 5)
                far[rows] = 1 - alike[rows] > model.limit[best]
                near[rows] = np.where(n.any(axis=1), best, -1)
            far[near < 0] = True
        release()
        names = pa.array([*model.language, None], pa.string()).take(pa.array(near % (len(model.language) + 1)))
        return pa.StructArray.from_arrays([names, pa.array(alike), pa.array(far)], ["nearest", "similarity", "rejected"])

    return judged(F.col(text).cast("string") if isinstance(text, str) else text.cast("string"))


def language_of(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred (nearest language; ``und`` without one), score (cosine), rejected, lang_sure (``und`` if rejected).

    Repeated rows get equal results, an empty table an empty one; other columns are
    not read. A row with a null id is not held out.
    """
    rows = narrow(documents, doc_id=id_col, text=F.col(f"`{text_col}`").cast("string"))
    rows = rows.select("doc_id", held_out("doc_id").alias("held_out"), identify(model, "text").alias("r"))
    nearest = F.coalesce("r.nearest", F.lit(UNKNOWN))
    return rows.select("doc_id", "held_out", nearest.alias("lang_pred"), F.col("r.similarity").alias("score"), F.col("r.rejected").alias("rejected"),
                       F.when(F.col("r.rejected"), UNKNOWN).otherwise(nearest).alias("lang_sure"))
