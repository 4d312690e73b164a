"""Quality rules: counts of words, symbols and repeats, and bands for the zstandard compression ratio."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from .common import ranges, release, word_slices

SYMBOLS = "[#*$%&|<>]"
RESULT = ("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
          "whole_ratio:double,chunk_ratio:double,base_failed:boolean,kept:boolean>")


@dataclass(frozen=True)
class Bands:
    """Ratios (bytes before / bytes after) that pass, by the length of what is compressed.

    ``whole``: (log2 of the bytes, lowest, highest) points for the ratio of the whole
    text, joined by straight lines and level beyond the ends. ``chunks``: (chunk
    size, lowest, highest) for the mean ratio of the full chunks of a text; a text
    is cut at the largest size that it can fill. ``single``: how far above the
    highest mean a chunk may lie by itself; none may lie below the lowest.
    """

    whole: tuple[tuple[float, float, float], ...]
    chunks: tuple[tuple[int, float, float], ...]
    single: float = 0.05

    def whole_limits(self, n_bytes: int) -> tuple[float, float]:
        x, low, high = zip(*self.whole)
        at = np.log2(n_bytes)
        return float(np.interp(at, x, low)), float(np.interp(at, x, high))

    def chunk_limits(self, n_bytes: int) -> tuple[int, float, float] | None:
        return next((c for c in sorted(self.chunks, reverse=True) if c[0] <= n_bytes), None)


#: Fits the generated texts of ``documents`` at level 3, whose invented syllables compress worse than language; most real prose
#: lies above it, see REAL_PROSE. A ratio below the lowest means close to random (encoded data); one above the highest means
#: that words, lines or marks repeat more than they do in those texts. Ratios grow with length, and so do the bounds.
BANDS = Bands(
    whole=((5, 0.5, 2.2), (8, 1.1, 1.97), (9.5, 1.35, 1.95), (10, 1.45, 2.03), (10.5, 1.5, 2.09), (11, 1.55, 2.14), (11.5, 1.6, 2.21),
           (12, 1.65, 2.29), (12.5, 1.7, 2.37), (13, 1.75, 2.43), (14, 1.8, 2.5), (15, 1.85, 2.6), (16, 1.9, 2.72), (18, 1.95, 2.9)),
    chunks=((512, 1.3, 1.84), (1024, 1.45, 1.98), (2048, 1.6, 2.14)))
#: Real prose in Latin script at level 3: at least 0.08 above the highest ratios of 450 texts (14 licences in English, 436 manual
#: pages in 15 translations without their macros), cut to lengths up to 2^16 bytes; longer ones are extrapolated. Text that
#: repeats outright lies far above (10 and more), generated junk of ``documents`` does not.
REAL_PROSE = Bands(
    whole=((5, 0.5, 2.2), (8, 1.1, 2.2), (9, 1.2, 2.5), (9.5, 1.25, 2.7), (10, 1.4, 2.85), (10.5, 1.5, 2.95), (11, 1.55, 3.05), (11.5, 1.6, 3.1),
           (12, 1.65, 3.15), (12.5, 1.7, 3.2), (13, 1.75, 3.3), (13.5, 1.75, 3.55), (16, 1.9, 3.55), (18, 1.95, 3.6)),
    chunks=((512, 1.3, 2.5), (1024, 1.45, 2.9), (2048, 1.6, 3.05)), single=1.6)
LEVEL = 3
MIN_WORDS = 50
#: Up to as many distinct words three codes make one 64-bit key.
MAX_KEY_CODES = 1 << 21


def _repeat_words(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in a three-word window which the text has at least twice."""
    n = np.diff(offsets)
    starts = np.repeat(offsets[:-1], np.maximum(n - 2, 0))
    at = ranges(offsets[:-1], np.maximum(n - 2, 0))
    if not len(at):
        return np.zeros(len(n), np.int64)
    c = codes.astype(np.uint64)
    n_codes = int(c.max()) + 1
    pair = c[at] * np.uint64(n_codes) + c[at + 1]
    if n_codes > MAX_KEY_CODES:  # three codes are too wide for a key; a number for each pair is not, as there are no more pairs than words
        pair = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
    key = pair * np.uint64(n_codes) + c[at + 2]
    doc = np.searchsorted(offsets, starts, "right")
    order = np.lexsort((key, doc))
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[:-1] |= same
    twice[1:] |= same
    hit = at[order[twice]]
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[hit + k] = True
    return np.diff(np.concatenate([[0], np.cumsum(covered)])[offsets])


def _dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def compression(compress, raw: bytes, bands: Bands) -> tuple[float, float, bool]:
    """(ratio of the whole, mean ratio of its full chunks, both and every chunk inside their bands); 0, 0 and true for no bytes.

    What the full chunks leave at the end is judged with the bytes before it, as one more chunk
    that counts by itself only. A text that fills no chunk has its whole ratio as its chunk ratio.
    """
    if not raw:
        return 0.0, 0.0, True
    whole = len(raw) / len(compress(raw))
    low, high = bands.whole_limits(len(raw))
    fine = low <= whole <= high
    limits = bands.chunk_limits(len(raw))
    if limits is None:
        return whole, whole, fine
    size, low, high = limits
    view = memoryview(raw)
    each = [size / len(compress(view[k:k + size])) for k in range(0, len(raw) - size + 1, size)]
    chunk = sum(each) / len(each)
    if len(raw) % size:
        each.append(size / len(compress(view[len(raw) - size:])))
    return whole, chunk, fine and low <= chunk <= high and low <= min(each) and max(each) <= high + bands.single


def judge(texts: pa.Array, bands=BANDS, min_words: int = MIN_WORDS) -> pa.Array:
    import zstandard
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    out = []
    for _, part, codes, distinct, offsets in word_slices(texts):
        n_words = np.diff(offsets)
        chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        word_chars = np.diff(np.concatenate([[0], np.cumsum(chars[codes])])[offsets])
        repeats = _repeat_words(codes, offsets)
        rows = part.to_pylist()
        shown = [compression(compress, t.encode(), bands) for t in rows]
        failed = (n_words < min_words) | (100 * repeats > 50 * n_words)
        cols = [n_words, word_chars, pc.count_substring_regex(part, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64),
                np.array([_dup_lines(t) for t in rows], np.int64), repeats, np.array([x[0] for x in shown]), np.array([x[1] for x in shown]),
                failed, ~failed & np.array([x[2] for x in shown], bool)]
        out.append(pa.StructArray.from_arrays([pa.array(c) for c in cols],
                                              ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "whole_ratio", "chunk_ratio",
                                               "base_failed", "kept"]))
    return pa.concat_arrays(out)


def quality_rules(text: str | Column = "text", bands=BANDS, min_words: int = MIN_WORDS) -> Column:
    """A struct of counts and verdicts of a text, computed from the whole text, row by row.

    ``base_failed``: fewer than ``min_words`` words, or more than half of its words
    lie in three-word windows that the text has twice or more. ``kept``: not
    base_failed, both compression ratios inside the band for its length, and no
    chunk of it, up to its last byte, outside by itself.

    Words are runs of anything but ASCII white space. A null text has no words, no
    ratio (0) and is base_failed, as is an empty one. Every row is judged alone, so
    repeated rows get equal results; other columns of the table are not touched.
    """
    @F.arrow_udf(RESULT)
    def rules(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.struct([(n, t) for n, t in (
                ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
                ("n_repeat_words", pa.int64()), ("whole_ratio", pa.float64()), ("chunk_ratio", pa.float64()), ("base_failed", pa.bool_()),
                ("kept", pa.bool_()))]))
        out = judge(texts, bands, min_words)
        release()
        return out
    return rules(F.col(text).cast("string") if isinstance(text, str) else text.cast("string"))
