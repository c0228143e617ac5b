"""Files as streams: digests, headers, exclusions and named columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ramplake.sources import audit, files, readers


def test_digests_are_read_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BLOCK", 7)
    rng = random.Random(1)
    want = {}
    for name, size in {"a.bin": 1, "b b.bin": 5000, "sub/c.bin.gz": 333, "d.txt": 10}.items():
        place = tmp_path / name
        place.parent.mkdir(exist_ok=True)
        place.write_bytes(rng.randbytes(size))
        want[place.name] = (size, hashlib.sha256(place.read_bytes()).hexdigest())
    got = {r["name"]: (r["bytes"], r["sha256"]) for r in audit.file_digests(spark, str(tmp_path)).collect()}
    assert got == want
    assert {r["name"] for r in audit.file_digests(spark, str(tmp_path), "*.txt").collect()} == {"d.txt"}


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    plan = files.listed(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan and "content:binary" not in plan


def write(folder, name, header, row, encoding="utf-8"):
    (folder / name).write_bytes(f"{header}\n{row}\n".encode(encoding))


def test_headers_and_exclusions(spark, tmp_path):
    write(tmp_path, "a.csv", "turbine_id,time,wind_speed,power", "1,2020-01-01 00:00:00,5,7")
    write(tmp_path, "b.csv", "fan_id,time,speed,active" + " " * 9000, "2,2020-01-01 00:00:00,6,8")  # longer than a block
    write(tmp_path, "notes.csv", "who,what", "x,y")
    write(tmp_path, "sites.csv", "turbine_id,time,wind_speed,power", "9,2020-01-01 00:00:00,1,1")
    (tmp_path / "empty.csv").write_bytes(b"")
    got = readers.read_scada_csv(spark, str(tmp_path), exclude=("sites.csv",)).collect()
    assert sorted(r["turbine_id"] for r in got) == ["1", "2"]
    heads = {r["path"].rsplit("/", 1)[1]: r["header"] for r in files.headers(files.listed(spark, str(tmp_path))).collect()}
    assert set(heads) == {"a.csv", "b.csv", "notes.csv", "sites.csv"} and len(heads["b.csv"]) > 9000


def test_a_file_without_a_named_column_is_an_error(spark, tmp_path):
    write(tmp_path, "a.csv", "turbine_id,time,wind_speed,power,fan", "1,2020-01-01 00:00:00,5,7,11")
    assert [r["turbine_id"] for r in readers.read_scada_csv(spark, str(tmp_path), overrides={"id": "fan"}).collect()] == ["11"]
    write(tmp_path, "b.csv", "turbine_id,time,wind_speed,power", "2,2020-01-01 00:00:00,6,8")
    with pytest.raises(readers.MissingOverride):
        readers.read_scada_csv(spark, str(tmp_path), overrides={"id": "fan"})
    write(tmp_path, "notes.csv", "who,what", "x,y")  # has none of the columns: left out, before names are looked at
    assert readers.read_scada_csv(spark, str(tmp_path)).select(F.count("*")).first()[0] == 2


def test_encoded_headers(spark, tmp_path):
    write(tmp_path, "a.csv", "机组,时间,风速,有功功率", "3,2020-01-01 00:00:00,5,7", "gbk")
    assert list(readers.files_by_header(spark, str(tmp_path), "*.csv", "gbk", False)) == ["机组,时间,风速,有功功率"]
