"""Files with outcomes, and folder batches in several runs."""

import gzip

import pytest

from corridor.sources import files
from corridor.streaming import day_batches

SCHEMA = "id int, name string, n int"


def lay_out(folder):
    (folder / "步骤 _240101.csv").write_text("id,name,n\n1,a,5\n2,b,6\n", encoding="utf-8")
    (folder / "x_240102.csv").write_text("id,name,n\r\n3,c,7\r\nbad,row,x\r\n", encoding="utf-8")
    (folder / "cut_240103.csv").write_text("id,name,n\n4,d,8\n5,e", encoding="utf-8")
    (folder / "open_240104.csv").write_text("id,name,n\n6,f,9", encoding="utf-8")
    (folder / "latin_240105.csv").write_bytes("id,name,n\n7,é,1\n".encode("latin-1"))
    (folder / "empty_240106.csv").write_text("")
    (folder / "head_240107.csv").write_text("id,name,n\n")
    whole = gzip.compress(b"id,name,n\n" + b"".join(b"%d,g,1\n" % i for i in range(10, 20_000)))
    (folder / "whole_240108.csv.gz").write_bytes(whole)
    (folder / "half_240109.csv.gz").write_bytes(whole[: len(whole) // 2])
    (folder / "noise_240110.csv.gz").write_bytes(b"\x00\x01no gzip at all")
    (folder / "many_240111.csv.gz").write_bytes(gzip.compress(b"id,name,n\n8,h,2\n") + gzip.compress(b"9,i,3\n"))


def names(rows):
    return {r.file.rsplit("/", 1)[1]: r.error for r in rows}


WANTED = {
    "步骤 _240101.csv": None, "x_240102.csv": None, "cut_240103.csv": "truncated", "open_240104.csv": None, "latin_240105.csv": "encoding",
    "empty_240106.csv": "empty", "head_240107.csv": "empty", "whole_240108.csv.gz": None, "half_240109.csv.gz": "truncated",
    "noise_240110.csv.gz": "unreadable", "many_240111.csv.gz": None,
}


def test_one_outcome_for_each_file(spark, tmp_path):
    lay_out(tmp_path)
    rows, broken, found = files.read_files(spark, [str(p) for p in tmp_path.iterdir()], SCHEMA)
    assert names(found.collect()) == WANTED
    assert sorted(r.id for r in rows.collect()) == [1, 2, 3, 6, 8, 9, *range(10, 20_000)]
    assert [(r.file.rsplit("/", 1)[1], r[files.CORRUPT]) for r in broken.collect()] == [("x_240102.csv", "bad,row,x")]


def run(spark, tmp_path, **more):
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    day_batches.run_day_batches(
        spark, str(tmp_path / "landing"), out, marks, SCHEMA, lambda df: df.withColumn("twice", df.n * 2), glob="*_*.csv*", **more
    )
    return out


def test_two_arrivals_one_of_them_repeated(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    for day in ("240101", "240102", "240103"):
        (landing / f"a_{day}.csv").write_text(f"id,name,n\n1,{day},1\n2,{day},2\n")
    tries = []

    def fail_once(number):
        tries.append(number)
        if len(tries) == 2:
            raise RuntimeError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        run(spark, tmp_path, files_per_batch=1, after_write=fail_once)
    out = run(spark, tmp_path, files_per_batch=1, after_write=fail_once)
    assert tries == [0, 1, 1, 2]
    (landing / "late_240102.csv").write_text("id,name,n\n3,late,9\n")
    (landing / "none.csv").write_text("id,name,n\n4,none,9\n")
    (landing / "undated_.csv").write_text("id,name,n\n4,none,9\n")
    (landing / "latin_240104.csv").write_bytes("id,name,n\n7,é,1\n".encode("latin-1"))
    run(spark, tmp_path)
    run(spark, tmp_path)
    rows = spark.read.parquet(f"{out}/rows")
    assert sorted((r.date.isoformat(), r.id, r.twice) for r in rows.collect()) == sorted(
        [(f"2024-01-0{d}", i, 2 * i) for d in (1, 2, 3) for i in (1, 2)] + [("2024-01-02", 3, 18)]
    )
    told = day_batches.outcomes(spark, out).collect()
    assert len(told) == 6 and names(told)["undated_.csv"] == "no date" and names(told)["latin_240104.csv"] == "encoding"
    assert {r.rows for r in told if r.batch < 3} == {2}
