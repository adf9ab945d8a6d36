"""Splits, digests and checks of partitions that no small table shows."""

import hashlib
import inspect

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from httplens.functions import digests
from httplens.operators import partition
from httplens.plans.oracle import split_sql


@pytest.mark.parametrize("n", [90, 100, 170, 350])
def test_split_sql_cuts_at_the_same_rows(spark, n):
    """90 * 0.7 is below 63 in double precision, but 63 as a decimal."""
    got = partition.stratified(spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic")), "toxic", [F.col("doc_id")])
    con = duckdb.connect()
    con.sql(f"create view labels as select range as doc_id, 0 as toxic from range({n})")
    want = con.sql(f"WITH {split_sql('toxic')} SELECT doc_id, split FROM t").fetchall()
    assert sorted((r.doc_id, r.split) for r in got.collect()) == sorted(want)


def test_digests_of_large_groups_come_from_ranges(spark):
    """Groups of more rows than one task sorts: the same digest, repeated ids once, null keys too."""
    rows = [(k, f"{i * 7919 % 5003:05d}") for k in ("a", None) for i in range(5003)] + [("a", "00001"), ("b", "2"), ("b", "1"), ("c", None)]
    df = spark.createDataFrame(rows, "k string, id string").repartition(5)
    assert "large" in inspect.signature(digests.set_digests).parameters
    got = {r.k: r.digest for r in digests.set_digests(df, ["k"], "id", large=1000).collect()}
    told = {}
    for k, i in rows:
        if i is not None:
            told.setdefault(k, set()).add(i)
    assert got == {k: hashlib.sha256("".join(f"{i}\n" for i in sorted(v)).encode()).hexdigest() for k, v in told.items()}
    assert got == {r.k: r.digest for r in digests.set_digests(df, ["k"], "id").collect()}
    n = spark.range(30_000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 30_011).alias("i"))
    want = {r.k: partition.reference_digest(np.array(r.x)) for r in n.groupBy("k").agg(F.collect_list("i").alias("x")).collect()}
    assert want == {r.k: r.digest for r in digests.index_digests(n, ["k"], "i", large=1000).collect()}


def test_rows_of_one_text_are_not_multiplied(spark):
    """Two equal rows met twice each before: four rows of two."""
    df = spark.createDataFrame([("d", 1, "x"), ("d", 1, "x"), ("d", 2, "y"), ("e", 1, "x"), (None, 3, "z")], "dataset string, sequence bigint, content_sha256 string")
    got = partition.select_top(df, 2)
    assert got.count() == 5 and got.where("dataset is null").first().partition == "reserved"
    assert " SortMergeJoin" not in got._jdf.queryExecution().toString()


def test_multiplicities_tell_what_the_checks_find(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "b")], "k bigint, p string")
    m = partition.multiplicities(df, "k", {"a": F.col("p") == "a", "b": F.col("p") == "b"})
    a, b = df.where("p = 'a'"), df.where("p = 'b'")
    assert m.where("a > 0 and b > 0").count() == partition.overlap(a, b, "k").count() == 1
    assert m.where("whole > 1").count() == partition.repeated(df, "k").count() == 2
    assert m.agg(F.sum(F.abs(F.col("whole") - F.col("a")))).first()[0] == partition.incomplete([a], df, "k").count() == 2
