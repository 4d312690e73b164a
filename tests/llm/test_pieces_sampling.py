from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_odd import documents, empty, frame

from tiltmeter.llm import pieces_sampling as S

PATH = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return S.Pieces(PATH)


def test_round_trip_and_reproducible(spark):
    rows = documents() + [(None, "no id"), (950, "a ▁ b▁"), (951, "  two  blanks "), (952, "\x00\x7f́\U0010ffff"), (953, "x" * 3000)]
    a = S.sampled_segmentations(frame(spark, rows), PATH).collect()
    b = {(r.doc_id, r.text): r.ids for r in S.sampled_segmentations(frame(spark, rows[::-1]).repartition(7), PATH).collect()}
    assert len(a) == len(rows)
    for r in a:
        assert r.decoded == (r.text or "") and b[(r.doc_id, r.text)] == r.ids
    assert {len(r.ids) for r in a if not r.text} == {0}


def test_other_seeds_give_other_segmentations(spark):
    rows = [(1, "reproducible segmentations of several longer words")]
    found = {tuple(S.sampled_segmentations(frame(spark, rows), PATH, seed=s).first().ids) for s in range(8)}
    assert len(found) > 1


def every_path(word, pieces, sp):
    """All segmentations of one unit with their weights."""
    if not word:
        return [((), 1.0)]
    out = []
    for k in range(1, len(word) + 1):
        i = sp.piece_to_id(word[:k])
        if i != sp.unk_id() and np.isfinite(pieces.weight[i]) and "▁" not in word[1:k]:
            out += [((i, *rest), np.exp(pieces.weight[i]) * w) for rest, w in every_path(word[k:], pieces, sp)]
    return out


def test_paths_are_drawn_by_their_weight(pieces):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    paths = every_path("▁then", pieces, sp)
    total = sum(w for _, w in paths)
    n = 20_000
    ids = S.encode_batch(pa.array(["then"] * n), np.arange(n).astype(np.uint64), pieces)
    seen = Counter(tuple(x) for x in ids.to_pylist())
    assert set(seen) <= {p for p, _ in paths}
    for p, w in paths:
        share = w / total
        assert abs(seen[p] / n - share) < 4 * np.sqrt(share * (1 - share) / n) + 2 / n


def test_plain_encodings_decode_too(spark, pieces):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = ["Hello world", "a  b", "日本 x"]
    assert S.decode_batch(pa.array([sp.encode(t) for t in texts]), pieces).to_pylist() == texts
    df = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(S.decode(PATH, "ids")).collect()] == ["", ""]


def test_empty_table(spark):
    assert S.sampled_segmentations(empty(spark), PATH).count() == 0
