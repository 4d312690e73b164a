"""Helpers shared by the operators of this folder.

Batches of texts are handled as flat Arrow arrays with offsets, so that numpy
works on all words of a batch at once; a batch is cut into slices of a few MB
first, so memory does not depend on how many rows Spark puts into one batch.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tables import stored

SLICE_BYTES = 4 << 20
INNER = "__llm_"

__all__ = ["stored", "narrow", "slices", "words", "word_slices", "worker_cache", "mix64", "word_hashes", "ranges", "release", "tidy", "INNER"]


def narrow(df: DataFrame, **named: str | Column) -> DataFrame:
    """Only the named columns, under the names an operator works with.

    Whatever else the caller's table holds, under whatever name, cannot clash.
    """
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in named.items()])


#: A kept value that no task asked for during so many releases is let go.
IDLE_RELEASES = 2


def worker_cache(name: str, make):
    """A value made once per Python worker process and kept for its later tasks, until other work goes on without it.

    A worker outlives the stage that it was started for; what only earlier stages
    need must not stay beside what the next ones do.
    """
    held = sys.__dict__.setdefault("_tiltmeter_llm", {"clock": 0, "values": {}})
    entry = held["values"].get(name) or [make(), 0]
    entry[1] = held["clock"]
    held["values"][name] = entry
    return entry[0]


def release() -> None:
    """Gives freed memory back to the system, and lets go of kept values that are not used any more."""
    import ctypes
    held = sys.__dict__.setdefault("_tiltmeter_llm", {"clock": 0, "values": {}})
    held["clock"] += 1
    for name in [n for n, (_, used) in held["values"].items() if held["clock"] - used > IDLE_RELEASES]:
        del held["values"][name]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def tidy(run):
    """A function over batches that leaves no memory behind: functions travel by value, so each task brings its own copies."""
    def wrapped(batches):
        import gc
        gc.collect()
        release()
        try:
            for out in run(batches):
                yield out
        finally:
            release()
    return wrapped


def filled(texts: pa.Array) -> pa.Array:
    """Texts as a string array without nulls."""
    return pc.fill_null(texts.cast(pa.string()), "")


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first row, texts without nulls) of consecutive slices of about ``limit`` bytes, at least one text each."""
    texts = filled(texts)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.empty(0, np.int64)
    at, done = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield at, texts.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of every text, separated by ASCII white space: flat, and the offsets of each text's words."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    real = pc.greater(pc.binary_length(flat), 0)
    seen = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))]).astype(np.int64)
    return flat.filter(real), seen[np.concatenate([[0], ends]).astype(np.int64)]


def word_slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first row, texts, code of each word, distinct words, word offsets) of each slice."""
    for at, part in slices(texts, limit):
        flat, offsets = words(part)
        coded = flat.dictionary_encode()
        yield at, part, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers (a bijection), so that their order is as good as random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(distinct: pa.Array) -> np.ndarray:
    import xxhash
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, … of every range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
