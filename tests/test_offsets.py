"""Look-ups of records by byte offset."""

import json
import os

import pytest

from httplens.sources import offsets

SCHEMA = "record_id string, n bigint, text string"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.jsonl", "b c.jsonl"):
        with open(tmp_path / "in" / name, "w", encoding="utf-8") as f:
            for n in range(400):
                f.write(json.dumps({"record_id": f"{name[0]}{n:03d}", "n": n, "text": "é🙂\n" * (n % 7)}, ensure_ascii=n % 2 == 0) + "\n")
            f.write('{"other": 1}\n\n' if name[0] == "a" else '{"record_id": "last", "n": -1}')
    return tmp_path


def test_only_the_record_is_read(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        offsets.write_index(spark, str(folder / "in"), str(folder / "index"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rows = spark.read.parquet(str(folder / "index")).collect()
    assert len(rows) == 801
    for r in rows:
        name = "a.jsonl" if r.path.endswith("a.jsonl") else "b c.jsonl"
        raw = (folder / "in" / name).read_bytes()[r.offset : r.offset + r.length]
        assert json.loads(raw)["record_id"] == r.id
    found, n = offsets.look_up(spark, str(folder / "index"), ["b006", "last", "a399"], SCHEMA)
    assert [(r.record_id, r.n, r.text) for r in found.orderBy("record_id").collect()] == [("a399", 399, ""), ("b006", 6, "é🙂\n" * 6), ("last", -1, None)]
    assert n == sum(r.length for r in rows if r.id in ("b006", "last", "a399"))
    with pytest.raises(KeyError, match="zzz"):
        offsets.look_up(spark, str(folder / "index"), ["a001", "zzz"], SCHEMA)


def test_a_stale_index_is_refused(spark, folder):
    offsets.write_index(spark, str(folder / "in"), str(folder / "index"))
    own = folder / "in" / "a.jsonl"
    at = os.stat(own)
    text = own.read_text()
    own.write_text(text + '{"record_id": "new"}\n')
    with pytest.raises(ValueError, match="older"):
        offsets.look_up(spark, str(folder / "index"), ["a001"], SCHEMA)
    own.write_text(text.replace("a001", "x001"))
    os.utime(own, ns=(at.st_atime_ns, at.st_mtime_ns))
    with pytest.raises(ValueError, match="fit"):
        offsets.look_up(spark, str(folder / "index"), ["a001"], SCHEMA)
    assert offsets.look_up(spark, str(folder / "index"), ["b001"], SCHEMA)[0].count() == 1


def test_look_ups_prune_row_groups(spark, folder):
    offsets.write_index(spark, str(folder / "in"), str(folder / "index"))
    plan = spark.read.parquet(str(folder / "index")).where("id in ('a001')")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "id" in plan.split("PushedFilters: [")[1].split("]")[0]
