"""The keyed table against a dictionary: merges, repeats, crashes, compaction, and a batch's cost while the table grows."""

import random

import pytest

from sparrowyard.streaming.keyed_table import KeyedTable

SCHEMA = "k long, seq long, v string"


def puts(spark, table, model, rng, batches, rows, keys):
    for b in batches:
        batch = [(rng.randrange(keys), rng.randrange(1000), f"{b}-{i}") for i in range(rows)]
        # of rows of one key and order in a batch none is first, so there is only one
        batch = list({(k, s): (k, s, v) for k, s, v in batch}.values())
        table.upsert(spark.createDataFrame(batch, SCHEMA), b)
        for k, s, v in batch:
            if k not in model or s > model[k][0]:
                model[k] = (s, v)


def rows_of(df):
    return {r.k: (r.seq, r.v) for r in df.collect()}


def test_equals_a_dictionary_through_compaction(spark, tmp_path):
    rng, model = random.Random(1), {}
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], "seq", buckets=3, fan=3)
    assert table.read() is None and table.lookup(spark.range(3).withColumnRenamed("id", "k")) is None
    puts(spark, table, model, rng, range(11), 40, 60)
    again = KeyedTable(spark, str(tmp_path / "t"), fan=3)  # keys and order are stored
    assert rows_of(again.read()) == model and [r[0] for r in again.runs()] == [2, 0, 0]
    some = spark.createDataFrame([(5,), (17,), (999,)], "k long")
    assert rows_of(again.lookup(some)) == {k: model[k] for k in (5, 17) if k in model}
    again.upsert(spark.createDataFrame([(5, 5000, "late")], SCHEMA), 4)  # batch 4 is in the table
    assert rows_of(again.read()) == model
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "t"), ["k"], "v")


def test_a_writer_that_dies_leaves_the_table_whole(spark, tmp_path):
    rng, model = random.Random(2), {}
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], "seq", buckets=2, fan=3)
    puts(spark, table, model, rng, range(2), 20, 30)
    # a run and a compaction without their end
    table._write(table._newest(table._read(table.runs())), (1, 0, 1))
    (tmp_path / "t" / "L1_0_1" / "_SUCCESS").unlink()
    table._write(table._newest(table._read(table.runs())), (0, 2, 2))
    (tmp_path / "t" / "L0_2_2" / "_SUCCESS").unlink()
    assert rows_of(table.read()) == model
    puts(spark, table, model, rng, range(2, 6), 20, 30)
    assert rows_of(table.read()) == model


def test_a_batch_costs_the_same_while_the_table_grows_tenfold(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], "seq", buckets=2, fan=4)
    first, own, all_ = None, [], 0
    for b in range(20):
        batch = spark.range(b * 500, b * 500 + 500).selectExpr("id AS k", "1L AS seq", "md5(string(id)) AS v")
        seen = set(table._complete())
        table.upsert(batch, b)
        fresh = [r for r in table._complete() if r not in seen]
        own.append(next(table.bytes_of(r) for r in fresh if r[0] == 0))
        all_ += sum(table.bytes_of(r) for r in fresh)
        first = first or own[0]
    assert table.read().count() == 10_000 and max(own) < 1.2 * first
    assert all_ < 3.2 * sum(own)  # a row is written once a level; snapshots would have written 10.5 times the batches
    assert len(table.runs()) <= 6
