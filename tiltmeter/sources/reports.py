"""Nested JSON reports, one document a file, read from files that are split between tasks.

The text source cuts a file behind every closing brace, whether the document is
spread over lines or not; an object can end nowhere else. What a place in the
file means depends on three things: whether it lies inside a string, how many
brackets are open, and which key of the document it belongs to. A block tells
how it changes each of them, for both cases of the first: its quotes flip
"inside", its brackets add to the depth, and its last key at the lowest depth is
the document's key if that depth turns out to be 1. These changes are composed
along the blocks of a file; then every block knows its beginning, and each task
cuts the objects out of its own block. Only objects that cross the end of a
block are shuffled. The files are scanned three times (changes, objects, objects
that cross a border), and each object is parsed by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .records import BLOCK, join_fragments, read_lines

_CHANGES = ("source_file string, block_start long, block_length long, flips long, deeper array<long>, lowest array<long>, keys array<string>, blank boolean")
_QUOTE, _ESCAPE, _COLON = b'"\\:'


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, np.ndarray, np.ndarray]]:
    """Per stretch of one block in a batch: its block, first row, bytes with the closing braces put back, ends of its lines."""
    file, start = batch.column("source_file"), batch.column("block_start").to_numpy(zero_copy_only=False)
    coded = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    turns = np.flatnonzero((np.diff(start) != 0) | (np.diff(coded) != 0)) + 1
    bounds = [0, *turns.tolist(), len(start)]
    for a, b in zip(bounds, bounds[1:]):
        if a < b:
            kind = pa.large_binary()
            line = pc.binary_join_element_wise(batch.column("line").slice(a, b - a).cast(kind), pa.scalar(b"", kind), pa.scalar(b"}", kind))
            ends = np.cumsum(pc.binary_length(line).to_numpy(zero_copy_only=False))
            yield (file[a].as_py(), int(start[a])), a, np.frombuffer(line.buffers()[2], np.uint8)[:ends[-1]], ends


def _quotes(text: np.ndarray) -> np.ndarray:
    """Places of the quotes that no backslash escapes."""
    at = np.flatnonzero(text == _QUOTE)
    slashes = np.flatnonzero(text == _ESCAPE)
    if len(slashes) == 0 or len(at) == 0:
        return at
    # First backslash of each row of backslashes; a quote right behind an odd number of them is escaped.
    new = np.concatenate([[True], np.diff(slashes) > 1])
    first = slashes[new][np.cumsum(new) - 1]
    k = np.searchsorted(slashes, at) - 1
    behind = (k >= 0) & (slashes[k] == at - 1)
    return at[~(behind & ((at - first[k]) % 2 == 1))]


def _steps(text: np.ndarray, inside: np.ndarray, wanted: int) -> np.ndarray:
    """+1 and -1 at brackets that are not in a string; ``inside`` is the state at each byte, ``wanted`` the one outside strings."""
    up, down = (text == ord("{")) | (text == ord("[")), (text == ord("}")) | (text == ord("]"))
    return (up.astype(np.int64) - down) * (inside == wanted)


def _key(text: np.ndarray, quotes: np.ndarray, colon: int) -> str | None:
    """The string before a colon, None if it begins before this text."""
    k = int(np.searchsorted(quotes, colon)) - 1
    return bytes(text[quotes[k - 1] + 1:quotes[k]]).decode("utf-8", "replace") if k >= 1 else None


def _flips(text: np.ndarray, quotes: np.ndarray) -> np.ndarray:
    odd = np.zeros(len(text), np.int8)
    odd[quotes] = 1
    return np.cumsum(odd, dtype=np.int64) % 2


def _block_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, length, flips, deeper, lowest, keys, blank = None, 0, 0, [0, 0], [None, None], [None, None], False

    def row():
        return pa.RecordBatch.from_pydict(
            {"source_file": [block[0]], "block_start": [block[1]], "block_length": [length], "flips": [flips], "deeper": [deeper], "lowest": [lowest],
             "keys": [keys], "blank": [blank]},
            schema=pa.schema([("source_file", pa.string()), ("block_start", pa.int64()), ("block_length", pa.int64()), ("flips", pa.int64()),
                              ("deeper", pa.list_(pa.int64())), ("lowest", pa.list_(pa.int64())), ("keys", pa.list_(pa.string())), ("blank", pa.bool_())]))

    for batch in batches:
        for here, a, text, ends in _stretches(batch):
            if here != block:
                if block is not None:
                    yield row()
                block, length, flips, deeper, lowest, keys = here, batch.column("block_length")[a].as_py(), 0, [0, 0], [None, None], [None, None]
            quotes = _quotes(text)
            inside = _flips(text, quotes)
            colons = np.flatnonzero(text == _COLON)
            for begun in (0, 1):
                # If the block begins in state ``begun``, bytes with this parity of quotes before them are outside strings.
                outside = (begun + flips) % 2
                depth = deeper[begun] + np.cumsum(_steps(text, inside, outside))
                c = colons[inside[colons] == outside]
                if len(c):
                    low = int(depth[c].min())
                    if lowest[begun] is None or low <= lowest[begun]:
                        lowest[begun], keys[begun] = low, _key(text, quotes, int(c[depth[c] == low][-1]))
                deeper[begun] = int(depth[-1])
            flips = (flips + len(quotes)) % 2
            last = bytes(text[ends[-2] if len(ends) > 1 else 0:-1])
            blank = last.isspace()
    if block is not None:
        yield row()


def block_states(lines: DataFrame) -> DataFrame:
    """State at the beginning of each block: inside a string (0 or 1), open brackets, key of the document. Unclosed documents are an error."""
    changes = lines.mapInArrow(_block_changes, _CHANGES)
    file = Window.partitionBy("source_file")
    before = file.orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)

    def case(name):
        return F.when(F.col("inside") == 1, F.col(name)[1]).otherwise(F.col(name)[0])

    known = changes.withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    known = known.select(*BLOCK, "flips", "inside", case("deeper").alias("deeper"), case("lowest").alias("lowest"), case("keys").alias("key"), "blank")
    known = known.withColumn("depth", F.coalesce(F.sum("deeper").over(before), F.lit(0)))
    # A key that begins in an earlier block holds a closing brace; it counts as a key without a name.
    known = known.withColumn("told", F.when(F.col("depth") + F.col("lowest") == 1, F.coalesce("key", F.lit(""))))
    known = known.withColumn("section", F.coalesce(F.last("told", True).over(before), F.lit("")))
    # The brace put behind blanks at the very end may not be in the file.
    end = F.max_by(F.struct("flips", "blank"), "block_start").over(file)
    closed = (F.sum("flips").over(file) % 2 == 0) & F.sum("deeper").over(file).between(F.when(end["blank"], -1).otherwise(0), 0)
    wrong = F.raise_error(F.concat(F.lit("no whole JSON document in "), "source_file")).cast("long")
    return known.select(*BLOCK, F.when(closed, F.col("inside")).otherwise(wrong).alias("inside"), "depth", "section")


def _cut_objects(batches: Iterator[pa.RecordBatch], torn: bool, key: str, level: int) -> Iterator[pa.RecordBatch]:
    """Objects at a depth below ``key`` that lie whole in a block or, if ``torn``, the parts of those that do not."""
    block, held, begun, place, flips, depth, section, opened = None, [], True, 0, 0, 0, "", False

    def rows(records: list[bytes], begins: list[bool], ends: list[bool]) -> pa.RecordBatch:
        nonlocal place
        n = len(records)
        keep = [i for i in range(n) if torn != (begins[i] and ends[i])]
        out = pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(block[0], pa.string()), len(keep)), pa.repeat(moment, len(keep)).cast(pa.timestamp("us", tz="UTC")), pa.array([block[1]] * len(keep), pa.int64()),
             pa.array([place + i for i in keep], pa.int64()), pa.array([records[i] for i in keep], pa.binary()).cast(pa.string()),
             pa.array([begins[i] for i in keep], pa.bool_()), pa.array([ends[i] for i in keep], pa.bool_())],
            names=["source_file", "file_time", "block_start", "place", "record", "begun", "ended"])
        place += n
        return out

    for batch in batches:
        for here, a, text, _ in _stretches(batch):
            if here != block:
                if opened:
                    yield rows([b"".join(held)], [begun], [False])
                block, moment, place, held, begun = here, batch.column("file_time")[a], 0, [], False
                flips, depth, section = (batch.column(c)[a].as_py() for c in ("inside", "depth", "section"))
                opened = depth is not None and section == key and depth >= level
            if depth is None:
                continue
            quotes = _quotes(text)
            inside = _flips(text, quotes)
            outside = flips
            steps = _steps(text, inside, outside)
            deep = depth + np.cumsum(steps)
            heads = np.flatnonzero((text == _COLON) & (inside == outside) & (deep == 1))
            names = [section, *[_key(text, quotes, int(c)) for c in heads]]
            entered = np.flatnonzero((steps == 1) & (deep == level))
            entered = [int(i) for i in entered if names[int(np.searchsorted(heads, i))] == key]
            above = [int(i) for i in np.flatnonzero((steps == 1) & (deep == 2)) if names[int(np.searchsorted(heads, i))] == key] if level == 3 else []
            if any(text[i] != ord("{") for i in entered) or any(text[i] != ord("[") for i in above):
                raise ValueError(f"{key} in {here[0]} holds something else than objects")
            left = np.flatnonzero((steps == -1) & (deep == level - 1))
            data, out, begins, at = text.tobytes(), [], [], 0
            firsts = iter(entered)
            first = 0 if opened else next(firsts, None)
            while first is not None:
                k = int(np.searchsorted(left, first))
                if k == len(left):
                    held.append(data[first:])
                    begun, opened = begun if opened else True, True
                    break
                piece = data[first:int(left[k]) + 1]
                out.append(b"".join(held) + piece if opened else piece)
                begins.append(begun if opened else True)
                held, opened = [], False
                first = next(firsts, None)
            if out:
                yield rows(out, begins, [True] * len(out))
            flips, depth, section = int((flips + len(quotes)) % 2), int(deep[-1]), names[-1] or ""
    if opened:
        yield rows([b"".join(held)], [begun], [False])


def read_objects(spark: SparkSession, path: str | list[str], key: str, in_array: bool = True, first_of_folder: bool = False, **options) -> DataFrame:
    """One row per object in the array (else: the one object) under ``key`` of each file's document, as JSON text in ``record``.

    Beside it source_file, file_time and place, which grows along the file. The
    files must hold one JSON object each; one that is not closed is an error, as
    is an array where an object belongs, or the reverse. Numbers, texts and nulls
    between the objects are left out; a file without ``key`` or with an empty
    array has no row. ``first_of_folder`` reads only the first file of each folder.
    """
    lines = read_lines(spark, path, end="}", **options)
    blocks = block_states(lines)
    if first_of_folder:
        first = F.min("source_file").over(Window.partitionBy(F.regexp_replace("source_file", "/[^/]*$", "")))
        # A block without a depth is passed over.
        blocks = blocks.withColumn("depth", F.when(F.col("source_file") == first, F.col("depth")))
    cut = partial(_cut_objects, key=key, level=3 if in_array else 2)
    return join_fragments(lines, blocks, cut, "")
