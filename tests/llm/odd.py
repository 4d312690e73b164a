"""Small tables with every odd case, and brute-force versions of the operators."""

import hashlib
import random
import re

WORDS = "the of and to in is on that by it with as was for are be this have from or had an they which one you were all her she there would their we him been has".split()


def prose(rng, n):
    out = []
    for _ in range(n):
        w = rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice(["ka", "lo", "mi", "ter", "un", "é", "ven"]) for _ in range(rng.randint(1, 4)))
        out.append(w + rng.choice(["", "", "", "", ",", ".", ".\n"]))
    return " ".join(out)


def documents(seed=0, n=60):
    """(doc_id, text) rows: prose, copies, near copies, shared passages, nulls, blanks, one long text, repeated rows."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(5, 260))) for i in range(n)]
    passage = prose(rng, 70)
    for i in range(8):
        rows.append((n + i, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30)))
    for i in range(6):
        rows.append((n + 10 + i, rows[rng.randrange(n)][1]))
    for i in range(6):
        words = rows[i][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((n + 20 + i, " ".join(words)))
    rows += [(n + 30, None), (n + 31, ""), (n + 32, " \t\n "), (n + 33, "one"), (n + 34, "one"), (n + 35, "日本語 текст 🙂 ½ Σίσυφος"),
             (n + 36, "ab " * 40), (n + 37, prose(rng, 20_000))]
    rows += [rows[3], rows[n + 1]]  # repeated rows
    return rows


#: Columns whose names operators might use for themselves.
CLASH = ["key", "n", "rep", "bands", "doc", "tie", "gram", "bucket", "score", "kept", "label", "size", "r", "piece", "length", "a", "b", "component"]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    if extra:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)}).withColumn("lang", F.lit(None).cast("string"))
    return df


def empty(spark):
    return frame(spark, [])


def split_words(text):
    return (text or "").encode().split()


def shingles(text, size):
    w = [bytes(x) for x in (text or "").encode()
         .translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()]
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def components(rows, size, similarity=80):
    """doc_id -> (set size, smallest reachable id), for unique non-null ids."""
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if 100 * both >= similarity * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def removed(rows, length=100):
    """doc_id -> (bytes, removed, spans, digest of the rest, kept bytes), for unique ids."""
    first, out = {}, {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k:k + length], (i, k))
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k:k + length]] < (i, k):
                gone[k:k + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out
