"""Near-duplicate documents: min-max hashing, banding, confirmation on full sets, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import mix64, narrow, ranges, slices, stored, tidy, word_hashes, words
from .components import connected

#: 100 permutations give 200 values, the least and the greatest of each; 40 bands of 5. Two sets with similarity 0.8
#: share no band with a chance of 1e-7.
PERMUTATIONS = 100
BAND_ROWS = 5
SEED = 9
SLICE = 1 << 20
#: Members of a bucket that one task holds when it compares its components.
BLOCK = 1000
STEP = 0x9E3779B97F4A7C15


def _constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, n, np.uint64), rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within it, and offsets; a shorter text is one shingle."""
    flat, offsets = words(pc.ascii_lower(texts))
    coded = flat.dictionary_encode()
    h = word_hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    n = np.diff(offsets)
    many = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    at = ranges(offsets[:-1], many)
    full = np.repeat(n >= size, many)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        there = full | (k < np.repeat(n, many))
        out = np.where(there, out * np.uint64(STEP) + h[np.minimum(at + k, len(h) - 1)] if len(h) else out, out)
    # A short text must differ from a longer text's shingle, so its number of words goes into its hash.
    out = mix64(np.where(full, out, out ^ mix64(np.repeat(n, many).astype(np.uint64) + np.uint64(1))))
    ends = np.concatenate([[0], np.cumsum(many)])
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[ends[:-1][many > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[ends]


def signatures(sets: np.ndarray, offsets: np.ndarray, permutations: int = PERMUTATIONS, seed: int = SEED) -> np.ndarray:
    """Least and greatest value of each set (none may be empty) under each permutation: rows of 2 x permutations values."""
    flips, factors = _constants(permutations, seed)
    out = np.empty((len(offsets) - 1, 2 * permutations), np.uint64)
    first = offsets[:-1]
    for p in range(permutations):
        v = (sets ^ flips[p]) * factors[p]
        out[:, 2 * p] = np.minimum.reduceat(v, first)
        out[:, 2 * p + 1] = np.maximum.reduceat(v, first)
    return out


def bands(signature: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One hash of ``rows`` neighbouring values each, with the band's number in it."""
    n, width = signature.shape
    out = np.empty((n, width // rows), np.uint64)
    for b in range(width // rows):
        h = np.full(n, (b + 1) * STEP & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in range(rows):
            h = mix64(h ^ signature[:, b * rows + k]) * np.uint64(STEP)
        out[:, b] = h
    return out


def _hashed(size: int, permutations: int, rows: int, seed: int):
    width = 2 * permutations // rows

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for at, part in slices(batch.column("text"), SLICE):
                sets, offsets = shingle_sets(part, size)
                n = np.diff(offsets)
                some = n > 0
                where = np.concatenate([[0], np.cumsum(np.where(some, width, 0))])
                found = bands(signatures(sets, np.concatenate([offsets[:-1][some], offsets[-1:]]), permutations, seed), rows) if some.any() else np.empty(0, np.uint64)
                sums = []
                for salt in (1, 2):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets + np.uint64(salt * STEP & 0xFFFFFFFFFFFFFFFF)))])
                    sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), pa.array(n), pa.array(sums[0]), pa.array(sums[1]),
                     pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(found.ravel().view(np.int64)))],
                    ["doc_id", "n", "s1", "s2", "bands"])
    return run


def _alike(size: int, similarity: int):
    """Keeps the pairs (a, b, text_a, text_b) whose full sets have 100 x intersection >= similarity x union."""
    def run(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            ta, tb = batch.column("text_a"), batch.column("text_b")
            at = 0
            while at < len(a):
                # A few pairs at a time; a representative of many pairs is hashed once for a run of them.
                to = min(len(a), at + 256)
                part = pa.concat_arrays([ta.slice(at, to - at), tb.slice(at, to - at)]).dictionary_encode()
                code = part.indices.to_numpy(zero_copy_only=False)
                sets, offsets = shingle_sets(part.dictionary, size)
                keep = []
                for k in range(to - at):
                    i, j = code[k], code[k + to - at]
                    x, y = sets[offsets[i]:offsets[i + 1]], sets[offsets[j]:offsets[j + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= similarity * (len(x) + len(y) - both):
                        keep.append(at + k)
                take = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([a.take(take), b.take(take)], ["a", "b"])
                at = to
    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, kind: str, size: int, similarity: int) -> DataFrame:
    first = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    second = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(first, "b").join(second, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(tidy(_alike(size, similarity)), f"a {kind}, b {kind}")


def _short_sets(size: int):
    """Each document's set as 32-bit values: enough to tell which pairs may be links."""
    def run(batches):
        for batch in batches:
            ids = batch.column("rep")
            for at, part in slices(batch.column("text"), SLICE):
                sets, offsets = shingle_sets(part, size)
                short = (sets >> np.uint64(32)).astype("<u4")
                raw = [np.unique(short[a:b]).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(raw, pa.binary())], ["rep", "short"])
    return run


def _across(similarity: int, kind: str):
    """Pairs that may be links, of an outsider and a home row of the same (key, block) but of another component.

    Rows come sorted by (key, block), home rows first. Home rows of one block are
    held; outsiders pass by one at a time, each against all of them at once.
    """
    def links(home, row, found):
        comp, raw, rep = row
        own = np.frombuffer(raw, "<u4")
        mark = np.zeros(len(home["values"]), bool)
        where = np.searchsorted(home["values"], own)
        inside = where < len(mark)
        hit = where[inside][home["values"][where[inside]] == own[inside]]
        mark[hit] = True
        both = np.add.reduceat(mark[home["codes"]], home["first"], dtype=np.int64)
        union = home["size"] + len(own) - both
        # Two shingles of a set may share a 32-bit value, hence the one.
        for k in np.flatnonzero((100 * (both + 1) >= similarity * (union - 1)) & (home["component"] != comp)).tolist():
            a, b = sorted((rep, home["rep"][k]))
            found.append((a, b))

    def ready(rows):
        flat = np.concatenate([np.frombuffer(r[1], "<u4") for r in rows])
        values, codes = np.unique(flat, return_inverse=True)
        size = np.array([len(r[1]) // 4 for r in rows], np.int64)
        return {"values": values, "codes": codes, "size": size, "first": np.cumsum(size) - size, "component": np.array([r[0] for r in rows], object),
                "rep": [r[2] for r in rows]}

    def run(batches):
        place, rows, home = None, [], None
        for batch in batches:
            found = []
            cols = [batch.column(c).to_pylist() for c in ("key", "block", "home", "outsider", "component", "short", "rep")]
            for key, block, at_home, outsider, component, short, rep in zip(*cols):
                if (key, block) != place:
                    if place is not None and home is None and rows:
                        home = ready(rows)
                        for r in (r for r in rows if r[3]):
                            links(home, r[:3], found)
                    place, rows, home = (key, block), [], None
                if at_home:
                    rows.append((component, short, rep, outsider))
                elif rows:
                    if home is None:
                        home = ready(rows)
                        for r in (r for r in rows if r[3]):
                            links(home, r[:3], found)
                    links(home, (component, short, rep), found)
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], batch.column("rep").type), pa.array([f[1] for f in found], batch.column("rep").type)], ["a", "b"])
            last = batch
        if place is not None and home is None and rows:
            home, found = ready(rows), []
            for r in (r for r in rows if r[3]):
                links(home, r[:3], found)
            kind_ = last.column("rep").type
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], kind_), pa.array([f[1] for f in found], kind_)], ["a", "b"])
    return run


def _torn_links(shared: DataFrame, parts: DataFrame, texts: DataFrame, kind: str, size: int, similarity: int, block: int) -> DataFrame:
    """Pairs that may be links between different components that meet in a bucket.

    A bucket's members are dealt to blocks of about ``block``. Those outside the
    bucket's largest component go to all of its blocks, where each is held against
    the members at home there. No pair is made that cannot be a link, and no task
    holds more than a block.
    """
    placed = shared.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    counts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    torn = (counts.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.sum("n").alias("members"), F.count("*").alias("parts"))
            .filter("parts > 1").select("key", "main", F.ceil(F.col("members") / block).cast("int").alias("blocks")))
    rows = placed.join(torn, "key").withColumns({"outsider": F.col("component") != F.col("main"), "own": F.pmod(F.xxhash64("rep"), "blocks").cast("int")})
    where = F.when(F.col("outsider"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    rows = rows.select("key", "rep", "component", "outsider", "own", F.explode(where).alias("block"))
    rows = rows.select("key", "block", "rep", "component", "outsider", (F.col("own") == F.col("block")).alias("home"))
    short = (texts.join(rows.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").select(F.col("doc_id").alias("rep"), "text")
             .mapInArrow(tidy(_short_sets(size)), f"rep {kind}, short binary"))
    met = rows.join(short, "rep").repartition("key", "block").sortWithinPartitions("key", "block", F.desc("home"))
    return met.mapInArrow(tidy(_across(similarity, kind)), f"a {kind}, b {kind}").filter("a <> b").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: int = 80,
                    permutations: int = PERMUTATIONS, band_rows: int = BAND_ROWS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two documents are linked if 100 x intersection >= ``similarity`` x union of their
    sets of distinct shingles (``shingle_words`` lower-cased words each; a text with
    fewer words is one shingle). component_id is the smallest id that links reach,
    kept marks the row whose own id that is.

    Rows with equal sets are one class from the start, so a group of copies of any
    size is one row further on. Classes that share a band are compared in stars:
    with the smallest class of the bucket and with its largest. Only where a bucket
    still holds several components, the members outside its largest one are held
    against the others, block by block, and pairs that may be links are emitted.
    Every link is confirmed on full sets computed from the texts.

    A null text, an empty one or one without words has an empty set and is linked
    with nothing. Rows of one id are one document, and a link of any of its texts is
    a link of it. A row without an id is linked only with rows of an equal
    set. An empty table gives an empty result. Columns besides id and text are not read.
    """
    rows = narrow(df, doc_id=id_col, text=F.col(f"`{text_col}`").cast("string"))
    kind = dict(rows.dtypes)["doc_id"]
    hashed = stored(rows.mapInArrow(tidy(_hashed(shingle_words, permutations, band_rows, seed)),
                                    f"doc_id {kind}, n bigint, s1 bigint, s2 bigint, bands array<bigint>"))
    classes = hashed.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    reps = hashed.select("doc_id", "n", "s1", "s2", "bands").join(
        classes.select("n", "s1", "s2", F.col("rep").alias("doc_id")), ["doc_id", "n", "s1", "s2"], "left_semi").dropDuplicates(["doc_id", "n", "s1", "s2"])
    buckets = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"))
    ends = buckets.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("members")).filter("members > 1").drop("members")
    shared = stored(buckets.join(ends, "key").select("key", "rep", "low", "high"))
    if (hashed.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > 1:
        rows = rows.dropDuplicates(["doc_id", "text"])
    # Only documents that share a bucket are ever compared; their texts are set aside once.
    rows = stored(rows.join(shared.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    stars = (shared.select("rep", F.explode(F.array("low", "high")).alias("end")).filter("rep <> end")
             .select(F.least("rep", "end").alias("a"), F.greatest("rep", "end").alias("b")).distinct())
    links = stored(_confirmed(stars, rows, kind, shingle_words, similarity))
    parts = connected(links, kind)
    # Buckets that still hold more than one component.
    more = stored(_confirmed(_torn_links(shared, parts, rows, kind, shingle_words, similarity, block), rows, kind, shingle_words, similarity))
    if not more.isEmpty():
        parts = connected(links.union(more), kind)
    named = classes.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = hashed.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
