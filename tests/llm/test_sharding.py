import zlib
from collections import defaultdict

import numpy as np
from llm_odd import documents, empty, frame

from tiltmeter.llm import sharding


def check(spark, rows, n_shards):
    got = sharding.shard_by_bytes(frame(spark, rows), n_shards).collect()
    texts = dict(rows)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < n_shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    for v in slots.values():
        assert sorted(v) == list(range(len(v)))
    return [sizes[s] for s in range(n_shards)], max(len((t or "").encode()) + 8 for _, t in rows)


def test_shards_are_even(spark):
    rows = [r for r in documents(n=400) if len(r[1] or "") < 5000]
    sizes, largest = check(spark, rows, 6)
    assert max(sizes) - min(sizes) <= 2 * largest


def test_hot_text_is_split(spark):
    rows = [(i, "the same text for all of them" * 3) for i in range(3000)] + [(3000 + i, f"other {i} " * (i % 9)) for i in range(1500)]
    sizes, largest = check(spark, rows, 24)
    assert max(sizes) - min(sizes) <= 2 * largest


def test_overfull_ranges_are_divided(spark):
    """Splitters from a sample that misses half of the keys still end in ranges near their share."""
    from pyspark.sql import functions as F
    rows = spark.range(20_000).select(F.xxhash64("id").alias("key"), F.lit(10).cast("bigint").alias("size"))
    splitters, sizes = sharding.splitters_for(rows, 200_000.0, 16)
    assert sizes["n"].sum() == 20_000 and sizes["bytes"].max() <= sharding.OVERFULL * 200_000 / 16
    assert (np.diff(splitters) > 0).all()


def test_odd_rows(spark):
    check(spark, documents(), 24)
    check(spark, [(None, None), (1, "x" * 200_000), (1, "x" * 200_000), (2, "")], 3)


def test_empty_table(spark):
    assert sharding.shard_by_bytes(empty(spark)).count() == 0
