"""Zip data source, counted loads, incremental table, stage reuse."""

from __future__ import annotations

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from panelyard.operators import clean
from panelyard.sources import increments, loads, scratch, stages, zips


def test_many_members_and_archives(spark, tmp_path):
    for a in range(3):
        with zipfile.ZipFile(tmp_path / f"prices_file-{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for m in range(20):
                z.writestr(f"m{m:02d}.csv", "d,t\n" + "".join(f"{a}-{m}-{i},\"x, {i}\"\n" for i in range(50)))
            z.writestr("empty.csv", "")
            z.writestr("header.csv", "d,t\n")
            z.writestr("read.me", "no,csv\n")
    (tmp_path / "prices_KEY_9.zip").write_bytes(b"not read")
    df = zips.read_zips(spark, str(tmp_path), "prices", split=5000)
    assert df.columns == ["d", "t", "file_no"] and df.rdd.getNumPartitions() > 6  # several tasks an archive
    got = sorted(map(tuple, df.collect()))
    assert got == sorted((f"{a}-{m}-{i}", f"x, {i}", a) for a in range(3) for m in range(20) for i in range(50))
    some = zips.read_zips(spark, str(tmp_path), "prices", contains="FILE-1", columns=["t", "lacks"])
    assert some.columns == ["t", "lacks", "file_no"] and some.count() == 1000 and some.filter("lacks is not null or file_no <> 1").isEmpty()


def test_stored_members_are_cut_at_lines(spark, tmp_path):
    lines = [f"{i},{'x' * (i * 37 % 211)}" for i in range(3000)]
    for end in ("\n", "\r\n"):
        folder = tmp_path / str(len(end))
        folder.mkdir()
        with zipfile.ZipFile(folder / "a1.zip", "w", zipfile.ZIP_STORED) as z:
            z.writestr("m.csv", end.join(["i,x", *lines]))  # no line end behind the last line
        for split in (50, 997, 10_000, 10_000_000):
            df = zips.read_zips(spark, str(folder), "a", split=split).withColumn("p", F.spark_partition_id()) if split > 900 else None
            if df is None:  # ranges shorter than a line, without Spark
                with zips.store(str(folder))[0].open_input_file(f"{folder}/a1.zip") as f:
                    parts = [r for p in zips.planned(zips.members(str(folder), f"{folder}/a1.zip"), split) for r in p]
                    assert len(parts) > 3000 and b"".join(b"".join(zips.own_lines(f, r)) for r in parts) == end.join(["i,x", *lines]).encode()
                continue
            rows = df.collect()
            assert sorted((int(r["i"]), r["x"] or "") for r in rows) == [(i, x.split(",")[1]) for i, x in enumerate(lines)]
            assert len({r["p"] for r in rows}) > 1 or split == 10_000_000


def test_a_member_above_two_gigabytes(spark, tmp_path):
    pad = b"," + b"p" * (1 << 20) + b"\n"
    with zipfile.ZipFile(tmp_path / "big_1.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        with z.open("big.csv", "w", force_zip64=True) as f:
            f.write(b"i,pad\n")
            for i in range(2100):
                f.write(str(i).encode() + pad)
        for m in range(4):
            z.writestr(f"small{m}.csv", f"i,pad\n{-1 - m},x\n")
    found = zips.members(str(tmp_path), f"{tmp_path}/big_1.zip")
    assert max(m.size for m in found) > 2 << 30 and len(zips.planned(found, 1 << 20)) == 2  # the small ones together
    out = zips.read_zips(spark, str(tmp_path), "big", columns=["i"]).agg(F.sum(F.col("i").cast("long")), F.count(F.lit(1))).first()
    assert tuple(out) == (2100 * 2099 // 2 - 10, 2104)


def test_damaged_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("m.csv", "a\n1\n2\n")
    raw = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "a.zip").write_bytes(raw.replace(b"a\n1\n2\n", b"a\n1\n3\n"))
    with zips.store(str(tmp_path))[0].open_input_file(f"{tmp_path}/a.zip") as f, pytest.raises(ValueError, match="checksum"):
        list(zips.own_lines(f, zips.members(str(tmp_path), f"{tmp_path}/a.zip")[0]))
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_BZIP2) as z:
        z.writestr("m.csv", "a\n1\n")
    with pytest.raises(ValueError, match="deflated"):
        zips.members(str(tmp_path), f"{tmp_path}/b.zip")


def test_zip_round_trip(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").cast("string").alias("a"), F.when(F.col("id") % 7 > 0, F.concat(F.lit('q"'), F.col("id"), F.lit(", ü"))).alias("b")).repartition(3)
    zips.write_zips(df, str(tmp_path / "z"), "out", member_rows=700)
    back = zips.read_zips(spark, str(tmp_path / "z"), "out", split=20_000)
    key = lambda r: (r["a"], r["b"] or "")
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))
    assert len(zips.archives(str(tmp_path / "z"))) == 3 and not [x for x in os.listdir(tmp_path / "z") if x.startswith("_")]
    zips.write_zips(df.limit(10), str(tmp_path / "z"), "out", mode="overwrite")
    assert zips.read_zips(spark, str(tmp_path / "z"), "out").count() == 10


RAW = [("2024-01-02", "A", "5", 1), ("2024-01-02", "A", "6", 2), ("not-a-date", "A", "5", 3), ("2024-01-02", " ", "5", 4), ("2024-01-02", "A", "0", 5), ("2024-01-02", "A", "x", 6), ("2024-01-03", "A", "5", 7), (None, None, None, 8)]


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_tasks_without_rows_and_archives_without_members(spark, tmp_path):
    df = spark.range(0, 100, 1, 4).filter("id < 25").select(F.col("id").cast("string").alias("id"))  # three of four tasks have no rows
    for name in ("z", "none"):
        (tmp_path / name).mkdir()
        zipfile.ZipFile(tmp_path / name / "lines-0_file-9.zip", "w").close()  # 22 bytes, as earlier versions left them
    zips.write_zips(df, str(tmp_path / "z"), "lines")
    assert len(zips.archives(str(tmp_path / "z"))) == 2 and not [x for x in os.listdir(tmp_path / "z") if x.startswith("_")]
    assert sorted(int(r["id"]) for r in zips.read_zips(spark, str(tmp_path / "z"), "lines").collect()) == list(range(25))
    zips.write_zips(df.filter("id < 0"), str(tmp_path / "none"), "lines")
    assert zips.read_zips(spark, str(tmp_path / "none"), "lines", columns=["id"]).count() == 0


def test_load_report_equals_counts(spark, tmp_path):
    spark.createDataFrame(RAW, "DATE string, TICKER string, ADJ_CLOSE string, n int").write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    report = loads.load_prices(raw, f"{tmp_path}/out")
    assert report == {"rows_in": 8, "rows_out": 2, "duplicates": 1, "bad_date": 2, "missing_ticker": 1, "bad_adj_close": 2}
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {r["status"]: r["count"] for r in out.groupBy("status").count().collect()} == {"ok": 2, "duplicate": 1, "bad_date": 2, "missing_ticker": 1, "bad_adj_close": 2}
    assert sorted(r["n"] for r in out.filter("status = 'ok'").collect()) == [2, 7]
    df = clean.clean_prices(raw).withColumnRenamed("quarantine_reason", "status")
    assert scans(loads.mark_duplicates(df, ["date", "ticker"], [F.col("n")])) == 1
    assert loads.load_prices(raw.filter("false"), f"{tmp_path}/none")["rows_in"] == 0


def test_vintage_report_counts_skipped_periods(spark, tmp_path):
    rows = [("A", "2024-01-01", None, "FY", 1), ("A", "2024-01-01", None, "FY", 2), ("A", None, None, "FY", 3), ("B", "2024-01-01", None, "Q1", 4), ("B", "2024-01-01", None, "Q2YTD", 5), ("B", None, None, "Q1", 6), ("B", None, None, None, 7)]
    raw = spark.createDataFrame(rows, "ticker string, filing_date string, first_calculable_at string, fiscal_period string, x int")
    report = loads.load_vintages(raw, f"{tmp_path}/v")
    assert report == {"rows_in": 7, "rows_out": 1, "duplicates": 1, "skipped_period": 4, "no_availability": 1, "skipped_periods": {"Q1": 2, "Q2YTD": 1, "": 1}}


def test_incremental_table(spark, tmp_path):
    inputs, table = tmp_path / "in", str(tmp_path / "table")
    inputs.mkdir()
    put = lambda name, *lines: (inputs / name).write_text("\n".join(("k,v", *lines)) + "\n")
    put("a.csv", "a,1", "b,2")
    put("b.csv", "c,3")

    def build(paths):
        return spark.read.csv(paths, header=True, schema="k string, v int").select("*", F.col("_metadata.file_path").alias("input_path")).filter("v > 0")

    rows = lambda: sorted((r["k"], r["v"]) for r in increments.read_committed(spark, table).collect())
    run = lambda **o: increments.ingest(spark, table, str(inputs), build, **o)
    assert run() == {"new": 2, "changed": 0, "unchanged": 0, "dropped": 0} and rows() == [("a", 1), ("b", 2), ("c", 3)]
    assert run() == {"new": 0, "changed": 0, "unchanged": 2, "dropped": 0}  # again: nothing is done
    put("a.csv", "a,9")
    put("c.csv", "d,4")
    # a run that dies between the data and the manifest
    commit, increments._commit = increments._commit, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt)
    try:
        with pytest.raises(KeyboardInterrupt):
            run()
    finally:
        increments._commit = commit
    assert ("d", 4) not in rows()  # not committed
    assert run() == {"new": 1, "changed": 1, "unchanged": 1, "dropped": 0} and rows() == [("a", 9), ("c", 3), ("d", 4)]
    put("a.csv", "a,-1", "a,-22")  # no row is left of it
    assert run()["changed"] == 1 and rows() == [("c", 3), ("d", 4)]
    (inputs / "b.csv").unlink()
    assert run()["dropped"] == 0 and run(drop_missing=True)["dropped"] == 1 and rows() == [("d", 4)]
    assert len(increments._texts(spark, f"{table}/_manifest")) == 4 and json.loads(increments._texts(spark, f"{table}/_manifest")[0])["gone"] == []


def test_stages_are_reused_by_fingerprint(spark, tmp_path):
    source, out = f"{tmp_path}/source", f"{tmp_path}/stage"
    spark.range(10).write.parquet(source)
    plan = lambda least=3: spark.read.parquet(source).filter(F.col("id") > least).select((F.col("id") * 2).alias("twice"))
    assert stages.stage_key(plan()) == stages.stage_key(plan()) != stages.stage_key(plan(4))
    assert stages.stage_key(plan(), {"v": 1}) != stages.stage_key(plan(), {"v": 2})
    files = lambda: sorted(x for x in os.listdir(out) if x.startswith("part"))
    assert stages.reuse(spark, out, plan).count() == 6
    first = files()
    assert stages.reuse(spark, out, plan).count() == 6 and files() == first  # equal: kept
    assert stages.reuse(spark, out, lambda: plan(4)).count() == 5 and files() != first  # another plan
    second = files()
    spark.range(20).write.mode("overwrite").parquet(source)
    assert stages.reuse(spark, out, lambda: plan(4)).count() == 15 and files() != second  # other input
    third = files()
    os.remove(f"{out}/_SUCCESS")
    assert stages.reuse(spark, out, lambda: plan(4)).count() == 15 and files() != third  # it died half-way
    assert stages.reuse(spark, out, lambda: plan(4), rebuild=True).count() == 15
    local = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError, match="parameter"):
        stages.stage_key(local)
    assert stages.stage_key(local, {"rows": 1})


def test_scratch(spark):
    df = scratch.written(spark.range(5), "test")
    assert df.count() == 5
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    scratch.delete(spark, path)
    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))
