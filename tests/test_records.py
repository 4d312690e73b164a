"""CSV records with line breaks, read from files that several tasks share."""

import csv
import io
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from tiltmeter.sources import readers as R, schemas
from tiltmeter.sources.records import read_lines

NAMES = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("c", T.StringType())])


@pytest.fixture
def small_blocks(spark):
    """A setter of the size of blocks; files are otherwise not split below some megabytes."""
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def text_of(rows, header=("a", "b", "c"), end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL)
    w.writerow(header)
    w.writerows(rows)
    return out.getvalue()


def read(spark, path, **kw):
    return [tuple(r) for r in R.read_csv(spark, path, NAMES, **kw).collect()]


def random_rows(n, seed):
    rnd = random.Random(seed)
    piece = ["x", '"', "\n", ",", "\n\n", '""', "word ", "é", "\n\"\n", " "]
    return [(str(i), "z" + "".join(rnd.choices(piece, k=rnd.randrange(12))), "y" + "".join(rnd.choices(piece, k=rnd.randrange(4)))) for i in range(n)]


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_as_one_task_reads_it(spark, tmp_path, small_blocks, size):
    rows = random_rows(150, size)
    (tmp_path / "f.csv").write_text(text_of(rows), encoding="utf-8")
    small_blocks(size)
    got = read(spark, str(tmp_path / "f.csv"))
    assert sorted(got) == sorted(rows)
    assert sorted(got) == sorted(read(spark, str(tmp_path / "f.csv"), split=False))


def test_every_place_of_a_border(spark, tmp_path, small_blocks):
    rows = [("1", 'p\nq""r', ""), ("2", "\n\n", 'a,"b"\n'), ("3", "plain", "s")]
    want = [tuple(v or None for v in r) for r in rows]
    body = text_of(rows)
    (tmp_path / "f.csv").write_text(body)
    for size in range(1, len(body) + 1, 5):
        small_blocks(size)
        got = sorted(tuple(v or None for v in r) for r in read(spark, str(tmp_path / "f.csv")))
        assert got == sorted(want), size


def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_blocks):
    (tmp_path / "f.csv").write_text(text_of(random_rows(400, 5)))
    small_blocks(1000)
    assert read_lines(spark, str(tmp_path / "f.csv")).select("block_start").distinct().count() > 8
    assert read_lines(spark, str(tmp_path / "f.csv")).rdd.getNumPartitions() > 8


def test_a_record_over_many_blocks_and_long_texts(spark, tmp_path, small_blocks):
    rows = [("1", "l\n" * 5000, "e"), ("2", "w" * 200_000, "e"), ("3", '"\n"' * 999, "e")]
    (tmp_path / "f.csv").write_text(text_of(rows))
    small_blocks(500)
    assert sorted(read(spark, str(tmp_path / "f.csv"))) == rows


def test_several_files_empty_lines_and_crlf(spark, tmp_path, small_blocks):
    for i in range(4):
        end = "\r\n" if i % 2 else "\n"
        body = end * (i // 2) + text_of([(f"{i}-{k}", f"n\n{k}", "v") for k in range(30)], end=end)
        (tmp_path / f"f{i}.csv").write_text(body + end * 3, newline="")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text("a,b,c\n")
    small_blocks(100)
    want = sorted((f"{i}-{k}", f"n\n{k}", "v") for i in range(4) for k in range(30))
    assert sorted(read(spark, str(tmp_path))) == want


def test_nulls_numbers_and_short_rows(spark, tmp_path):
    (tmp_path / "f.csv").write_text('event_id_cnty,notes,event_type,country,actor1,inter1,source,source_scale,fatalities\nE1,,"",x,y,no,,,7\nE2,only\n')
    got = [tuple(r) for r in R.read_raw_events(spark, str(tmp_path)).orderBy("event_id_cnty").collect()]
    assert got == [tuple(r) for r in R.read_raw_events(spark, str(tmp_path), split=False).orderBy("event_id_cnty").collect()]


def test_what_is_refused(spark, tmp_path):
    for name, body, message in (("odd", 'a,b,c\n1,"x,y\n', "not closed"), ("head", "a,c,b\n1,2,3\n", "header"), ("more", "a,b,c,d\n1,2,3,4\n", "header"),
                                ("inch", 'a,b,c\n5" nail,x,y\n6" nail,x,y\n', "inside a field")):
        (tmp_path / f"{name}.csv").write_text(body)
        with pytest.raises(Exception, match=message):
            read(spark, str(tmp_path / f"{name}.csv"))


def test_no_control_table(spark, tmp_path, small_blocks, monkeypatch):
    """Blocks that are too many to be broadcast are joined by a shuffle, with the same rows."""
    from tiltmeter.sources import records
    monkeypatch.setattr(records, "sized_table", lambda df: (df, False))
    rows = random_rows(200, 9)
    (tmp_path / "f.csv").write_text(text_of(rows))
    small_blocks(300)
    assert sorted(read(spark, str(tmp_path / "f.csv"))) == sorted(rows)


def test_rows_keep_their_order(spark, tmp_path, small_blocks):
    head = "model,event_id,true_label,pred_label,pred_conf,logits,reasoning,latency_sec,actor_norm,notes\n"
    lines = "".join(f'm,{i % 50},V,B,0.5,,,{i},A,"n\n{i}"\n' for i in range(500))
    (tmp_path / "results_m_cmr.csv").write_text(head + lines)
    small_blocks(700)
    files = R.read_model_results(spark, str(tmp_path), r"results_(.+)_cmr\.csv")
    assert [r["latency_sec"] for r in files.orderBy("row_in_run").collect()] == list(range(500))
    assert {int(r["event_id"]): r["latency_sec"] for r in R.combine_model_results(files).collect()} == {k: 450 + k for k in range(50)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab\",\n ", min_size=1, max_size=9), st.text("\"\n,x", max_size=9)), min_size=1, max_size=8), st.integers(1, 60))
def test_random_texts(spark, tmp_path, small_blocks, rows, size):
    rows = [(str(i), "k" + a, "k" + b) for i, (a, b) in enumerate(rows)]
    (tmp_path / "r.csv").write_text(text_of(rows))
    small_blocks(size)
    assert sorted(read(spark, str(tmp_path / "r.csv"))) == sorted(rows)
