"""The registered queries on the smallest tables: against their SQL, and by their columns."""

import pytest
from check import compare, connect

from tiltmeter.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op2": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op7": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8": ["doc_id", "held_out", "score", "predicted"],
    "op9": ["doc_id", "n_shingles", "component_id", "kept"],
    "op11": ["lang", "source", "part", "item", "value", "rank"],
    "op12": ["doc_id", "held_out", "lang_pred", "score"],
    "op13": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    message, n = compare(spark, duck, name, queries()[name], oracle_sql().get(name), SF)
    assert message is None, message
    assert n > 0
    assert set(COLUMNS.get(name.split("_")[0], [])) <= set(queries()[name](spark, SF).columns)


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 14)}
    import __spark_entry__ as e
    assert set(queries()) | {"pipeline"} <= set(e.queries())
