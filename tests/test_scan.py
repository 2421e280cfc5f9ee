"""Scan semantics on generated files of several row groups: goldens in closed form, strict mode, narrowing, statistics."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException

from lodestar.functions.settings import Settings
from lodestar.operators.relational import multiset_difference, salted_join, same_rows, top_k
from lodestar.plans import profile
from lodestar.sources import footer, hosted
from lodestar.sources.scan import aggregating_scan, cardinality, describe, narrow, scan, sql, with_batch_index, write_table


@pytest.fixture(scope="session")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    n = 65536
    i = list(range(n))
    pq.write_table(pa.table({"c_int32": pa.array(i, pa.int32()), "c_int64": pa.array([1_000_000 * x for x in i], pa.int64()), "c_float": pa.array([0.5 * x for x in i], pa.float32()), "c_double": pa.array([1.25 * x for x in i])}), d / "mixed_small.parquet", row_group_size=8192, use_dictionary=False)
    m = 20000
    pq.write_table(pa.table({"a": pa.array(range(m), pa.int32()), "b": pa.array([10**6 * x for x in range(m)]), "s": [f"str{x}" for x in range(m)], "g": [["alpha", "beta", "gamma", "delta"][x % 4] for x in range(m)]}), d / "strings.parquet", row_group_size=8192)
    pq.write_table(pa.table({"a": pa.array(range(1000), pa.int32()), "b": pa.array([7 * x for x in range(1000)]), "c": pa.array([3 * x for x in range(1000)], pa.int32()), "d": pa.array([11 * x for x in range(1000)])}), d / "ints.parquet", compression="none")
    pq.write_table(pa.table({"a": pa.array(range(100), pa.int32())}), d / "zstd.parquet", compression="zstd")
    pq.write_table(pa.table({"a": pa.array([1], pa.int32()), "d": pa.array([1], pa.decimal128(38, 2))}), d / "flba.parquet")
    pq.ParquetWriter(d / "empty.parquet", pa.schema([("a", pa.int32())])).close()
    pq.write_table(pa.table({"n": pa.array([1, None, 3, None, 2**40]), "t": pa.array([True, None, False, True, None])}), d / "nulls.parquet", row_group_size=2)
    pq.write_table(pa.table({"x": pa.array([1, 2, 3])}), d / "nostats.parquet", write_statistics=False)
    # Groups that fit 32 bits one by one, but for the last of x.
    pq.write_table(pa.table({"x": pa.array([1, 2, -3, 4, 2**31, 5]), "y": pa.array([1, 2, -3, 4, 2**31 - 1, -(2**31)])}), d / "groups.parquet", row_group_size=2)
    return d


def one(df):
    return tuple(df.first())


@pytest.mark.parametrize(
    ("where", "count"),
    [("c_int32 >= 40960", 24576), ("c_int32 between 8192 and 16383", 8192), ("c_int32 > 100000", 0), ("c_int32 % 2 = 0", 32768), ("c_int32 in (0, 8192, 65535)", 3), ("c_int32 < 10 or c_int32 > 65530", 15), ("c_int32 < 10 and c_int32 > 20", 0), ("c_float < 4.0", 8), ("cast(c_int32 as bigint) < 60000", 60000)],
)
def test_filters(spark, files, where, count):
    assert scan(spark, str(files / "mixed_small.parquet")).where(where).count() == count


def test_goldens(spark, files):
    f = f"read_scan('{files}/mixed_small.parquet')"
    assert one(sql(spark, f"select sum(c_int32), sum(c_double), sum(cast(c_float as double)) from {f}")) == (2147450880, 2684313600.0, 1073725440.0)
    assert one(sql(spark, f"select sum(c_int64) from {f} where c_int32 >= 40960")) == (1308610560000000,)
    assert sql(spark, f"select c_int32 div 8192 as k, count(*) as n from {f} group by 1").where("n = 8192").count() == 8
    s = f"read_scan('{files}/strings.parquet')"
    assert one(sql(spark, f"select min(s), max(s), count(distinct g) from {s}")) == ("str0", "str9999", 4)
    assert one(sql(spark, f"select count(*) from {s} where s like 'str1999%'")) == (11,)
    assert one(sql(spark, f"select count(*) from {s} where s like '%99' and g = 'delta'")) == (200,)
    i = f"read_scan('{files}/ints.parquet')"
    assert one(sql(spark, f"select count(*) from {i} where a < b and d > 1000")) == (909,)
    assert [r[0] for r in sql(spark, f"select c_int32 from {f} order by c_int32 desc limit 3").collect()] == [65535, 65534, 65533]


def test_pushdown_reaches_the_scan(spark, files):
    df = sql(spark, f"select c_double from read_scan('{files}/mixed_small.parquet') where c_int32 >= 40960")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(c_int32,40960)" in plan and "c_int64" not in plan
    rows = {r["metric"]: r["value"] for r in profile.scan_metrics(df).where("operator like 'Scan%'").collect()}
    assert rows["numOutputRows"] == 24576  # three of eight row groups


def test_same_rows_and_difference(spark, files):
    df = scan(spark, str(files / "ints.parquet"))
    assert same_rows(df, df.orderBy("a")) and not same_rows(df, df.where("a > 0"))
    assert multiset_difference(df, df.where("a >= 10")).count() == 10
    assert top_k(df, 2, df["a"].desc()).count() == 2
    assert salted_join(df, df.select("a", "b").withColumnRenamed("b", "e"), "a", 3).count() == 1000


@pytest.mark.parametrize(("name", "text"), [("zstd", "compression codec ZSTD"), ("flba", "physical type FIXED_LEN_BYTE_ARRAY"), ("empty", "no row groups")])
def test_strict_refuses(spark, files, name, text):
    with pytest.raises(footer.ScanError, match=text):
        scan(spark, str(files / f"{name}.parquet"), strict=True)
    scan(spark, str(files / f"{name}.parquet")).count()


def test_missing_file(spark, files):
    with pytest.raises(FileNotFoundError, match="IO Error"):
        scan(spark, str(files / "none.parquet"), strict=True)
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        scan(spark, str(files / "none.parquet"))


def test_nulls(spark, files):
    df = scan(spark, str(files / "nulls.parquet"))
    assert df.where("n > 0").count() == 3 and df.where("t").count() == 2
    assert one(footer.footer_agg(spark, str(files / "nulls.parquet"), "n")) == (3, 1, 2**40)


def test_footer_answers(spark, files):
    path = str(files / "mixed_small.parquet")
    assert cardinality(spark, path) == 65536
    assert one(footer.footer_agg(spark, path, "c_int32")) == (65536, 0, 65535)
    assert one(footer.footer_agg(spark, path, "c_int32", 8192, 16383)) == (8192, 8192, 16383)
    assert one(footer.footer_agg(spark, path, "c_int32", 10, 8200)) == (8191, 10, 8200)
    assert one(footer.footer_agg(spark, path, "c_int32", 10**6)) == (0, None, None)
    assert one(footer.footer_agg(spark, str(files / "nostats.parquet"), "x")) == (3, 1, 3)
    assert footer.rowgroup_stats(spark, path).count() == 32


def test_aggregates_are_pushed(spark, files):
    df = aggregating_scan(spark, str(files / "mixed_small.parquet")).selectExpr("count(*)", "min(c_int32)", "max(c_int64)")
    assert "PushedAggregation: [COUNT(*), MIN(c_int32), MAX(c_int64)]" in df._jdf.queryExecution().executedPlan().toString()
    assert one(df) == (65536, 0, 65535 * 10**6)


def test_narrow(spark, files):
    s = Settings(spark)
    path = str(files / "ints.parquet")
    assert dict(narrow(spark, path, "b", "int").dtypes)["b"] == "bigint"
    s.set("cast_pushdown", True)
    assert dict(narrow(spark, path, "b", "smallint").dtypes)["b"] == "smallint"
    assert dict(narrow(spark, path, "a", "bigint").dtypes)["a"] == "int" and dict(narrow(spark, path, "a", "uint").dtypes)["a"] == "int"
    groups = str(files / "groups.parquet")
    assert dict(narrow(spark, groups, "x", "int").dtypes)["x"] == "bigint" and dict(narrow(spark, groups, "y", "int").dtypes)["y"] == "int"
    assert dict(narrow(spark, path, "d", "tinyint").dtypes)["d"] == "bigint"
    assert dict(narrow(spark, str(files / "nulls.parquet"), "n", "int").dtypes)["n"] == "bigint"
    assert dict(narrow(spark, str(files / "nostats.parquet"), "x", "int").dtypes)["x"] == "bigint"
    assert one(narrow(spark, path, "b", "int").selectExpr("sum(b)")) == (7 * 999 * 500,)
    s.reset("cast_pushdown")


def test_settings(spark):
    s = Settings(spark)
    assert (s.get("prefetch_depth"), s.get("scan_groups_in_flight"), s.get("hosted_root"), s.get("scheduler_num_streams")) == (2, 16, None, 0)
    for name, bad in (("scheduler_num_streams", 0), ("scheduler_num_streams", 10**6), ("scheduler_queue_depth", 0), ("prefetch_depth", -1), ("scan_groups_in_flight", 0), ("logging_level", "loud"), ("enable_yield", "maybe"), ("prefetch_depth", "x")):
        with pytest.raises(ValueError, match=r".+"):
            s.set(name, bad)
    with pytest.raises(ValueError, match="Unknown log_level"):
        s.set("logging_level", "loud")
    s.set("logging_level", "error")
    s.set("prefetch_depth", 0)
    assert s.get("prefetch_depth") == 0 and s.get("logging_level") == "ERROR"
    s.reset("prefetch_depth")
    assert s.get("prefetch_depth") == 2 and s.table().count() == 9
    with pytest.raises(KeyError):
        s.get("nothing")


def test_hosted(spark, files, tmp_path):
    with pytest.raises(hosted.HostedError, match="hosted_root"):
        scan(spark, "hosted://ints.parquet")
    s = Settings(spark)
    s.set("hosted_root", str(files))
    assert scan(spark, "hosted://ints.parquet").count() == 1000
    assert sql(spark, "select count(*) from read_scan('hosted://ints.parquet')").first()[0] == 1000
    assert hosted.glob(spark, "hosted://*s.parquet") == ["groups.parquet", "ints.parquet", "nostats.parquet", "nulls.parquet", "strings.parquet"]
    with pytest.raises(hosted.HostedError, match="not found in hosted directory"):
        scan(spark, "hosted://none.parquet")
    with pytest.raises(hosted.HostedError, match="read-only"):
        hosted.open_for_write("hosted://x")
    s.reset("hosted_root")
    pq.write_table(pa.table({"a": [1]}), tmp_path / "ints.parquet")
    with pytest.raises(hosted.HostedError, match="duplicate"):
        hosted.catalog(spark, [str(files), str(tmp_path)])
    rows = hosted.catalog(spark, [str(files)]).collect()
    assert [r["name"] for r in rows] == sorted(r["name"] for r in rows) and rows[1]["offset"] == rows[0]["offset"] + rows[0]["size"]
    assert rows[0]["offset"] == hosted.directory_size([r["name"] for r in rows])


def test_directory_bytes():
    # Written out by hand: the size field counts itself, offsets are those in the region.
    raw = bytes.fromhex("42000000000000000900000000000000612e7061727175657442000000000000000a00000000000000") + bytes.fromhex("0100000000000000624c000000000000000500000000000000")
    assert len(raw) == 66
    entries = [("a.parquet", 66, 10), ("b", 76, 5)]
    assert hosted.pack_directory(entries) == raw and hosted.parse_directory(raw + b"files") == entries
    assert hosted.parse_directory((8).to_bytes(8, "little")) == [] and hosted.pack_directory([]) == (8).to_bytes(8, "little")
    for cut in (4, 20, 65):
        with pytest.raises(hosted.HostedError, match="truncated"):
            hosted.parse_directory(raw[:cut])
    with pytest.raises(hosted.HostedError, match="name/offset/size"):
        hosted.parse_directory((64).to_bytes(8, "little") + raw[8:])


def test_hosted_file(spark, files, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.parquet").write_bytes(b"0123456789")
    with Settings(spark).held({"hosted_root": str(tmp_path)}):
        assert hosted.glob(spark, "hosted://*") == ["deep/x.parquet"]
        f = hosted.HostedFile(spark, "hosted://deep/x.parquet")
        assert f.size == 10 and abs(f.modified - (tmp_path / "deep" / "x.parquet").stat().st_mtime) < 2
        assert f.read_at(3, 4) == b"456" and f.read(4) == b"0123" and f.tell() == 4
        f.seek(8)
        assert f.read(100) == b"89" and f.read(1) == b"" and f.read_at(0, 10) == b""
        for bad, text in ((lambda: f.read(-1), "negative"), (lambda: f.read_at(-1, 0), "negative"), (lambda: f.read_at(5, 6), "past end"), (lambda: f.seek(11), "seek past end")):
            with pytest.raises(hosted.HostedError, match=text):
                bad()
        f.close()
    assert Settings(spark).get("hosted_root") is None


def test_partitioned_folders(spark, tmp_path):
    path = str(tmp_path / "t é%20x")
    spark.range(1000).selectExpr("id * 10000000 as v", "id as n", "id % 3 as k").repartition(6).write.partitionBy("k").parquet(path)
    assert len(footer.data_files(spark, path)) > footer.DRIVER_FILES
    assert cardinality(spark, path) == 1000 and scan(spark, path, strict=True).count() == 1000
    assert one(footer.footer_agg(spark, path, "n")) == (1000, 0, 999)
    assert one(footer.footer_agg(spark, path, "n", 5, 700)) == (696, 5, 700)
    assert one(footer.footer_agg(spark, path, "k", 1)) == (666, 1, 2)
    assert footer.rowgroup_stats(spark, path).agg({"num_rows": "sum"}).first()[0] == 2000
    with Settings(spark).held({"cast_pushdown": True}):
        assert dict(narrow(spark, path, "v", "int").dtypes)["v"] == "bigint"
        assert dict(narrow(spark, path, "n", "smallint").dtypes)["n"] == "smallint"
    pq.write_table(pa.table({"v": [1], "n": [1]}), path + "/k=1/z.parquet", compression="zstd")
    with pytest.raises(footer.ScanError, match="codec ZSTD"):
        scan(spark, path, strict=True)


@pytest.mark.parametrize(
    ("kind", "values", "where", "count"),
    [(pa.int8(), [-128, 0, 127, None], "x > 0", 1), (pa.int16(), [-(2**15), 5, 2**15 - 1, None], "x < 6", 2), (pa.uint8(), [0, 255, 3, None], "x >= 3", 2), (pa.uint16(), [0, 65535, 7, None], "x = 65535", 1), (pa.uint32(), [0, 2**32 - 1, 7, None], "x > 7", 1)],
)
def test_integer_widths(spark, tmp_path, kind, values, where, count):
    pq.write_table(pa.table({"x": pa.array(values, kind)}), tmp_path / "w.parquet")
    df = scan(spark, str(tmp_path / "w.parquet"), strict=True)
    assert df.where(where).count() == count and df.where("x is null").count() == 1


def test_other_types(spark, tmp_path):
    from datetime import date, datetime
    from decimal import Decimal

    pq.write_table(pa.table({"d": [date(2020, 1, 2), None], "t": [datetime(2020, 1, 2, 3), None], "m": pa.array([Decimal("1.25"), None], pa.decimal128(9, 2)), "l": [[1, 2], None], "s": [{"a": 1, "b": "x"}, None], "p": pa.array([[("k", 1)], None], pa.map_(pa.string(), pa.int64()))}), tmp_path / "o.parquet")
    df = scan(spark, str(tmp_path / "o.parquet"))
    assert df.where("d = date'2020-01-02' and m = 1.25 and l[1] = 2 and s.b = 'x' and p['k'] = 1").count() == 1
    assert df.where("d is null and t is null and l is null and s is null and p is null").count() == 1


def test_calls_in_literals_and_comments(spark, files):
    text = f"select 'read_scan(''x'')' as a, \"scan_profile()\" as b, count(*) as n -- read_scan('none')\n from /* read_scan('no') */ read_scan('{files}/ints.parquet')"
    assert tuple(sql(spark, text).first()) == ("read_scan('x')", "scan_profile()", 1000)


def test_streams_bound_the_scan(spark, files):
    with Settings(spark).held({"scheduler_num_streams": 1}):
        assert scan(spark, str(files)+"/*s.parquet").rdd.getNumPartitions() == 1
        df = sql(spark, f"select a from read_scan('{files}/ints.parquet') where b > 6986")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Coalesce 1" in plan and "GreaterThan(b,6986)" in plan and df.count() == 1


def test_runtime_join_filter_in_the_plan(spark, tmp_path):
    spark.range(200_000).selectExpr("id as k", "id % 7 as v").write.parquet(str(tmp_path / "big"))
    spark.range(200_000).selectExpr("id as k", "id % 1000 as w").write.parquet(str(tmp_path / "small"))
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df = sql(spark, f"select count(*) as n, sum(v) as s from read_scan('{tmp_path}/big') join read_scan('{tmp_path}/small') using (k) where w = 3")
        assert "might_contain" in df._jdf.queryExecution().optimizedPlan().toString()
        assert df.first()["n"] == 200
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_progress_of_a_running_query(spark):
    import threading
    import time

    def slow(batches):
        for b in batches:
            time.sleep(0.8)
            yield b

    run = threading.Thread(target=lambda: spark.range(0, 16, 1, 16).mapInArrow(slow, "id long").count())
    seen = []
    run.start()
    while run.is_alive():
        seen.append(profile.progress(spark))
        time.sleep(0.05)
    run.join()
    assert any(0 < p < 100 for p in seen) and all(0 <= p <= 100 for p in seen) and profile.progress(spark) == 100


def test_write_groups_and_index(spark, files, tmp_path):
    out = str(tmp_path / "copy")
    write_table(scan(spark, str(files / "mixed_small.parquet")).coalesce(1), out, rows_per_group=8192)
    parts = footer.data_files(spark, out)
    assert [footer.read_footer(spark, p).group_rows for p in parts] == [(8192,) * 8]
    assert with_batch_index(scan(spark, out)).selectExpr("max(batch_row)").first()[0] == 65535
    assert [tuple(r) for r in describe(scan(spark, out)).collect()][0] == ("c_int32", "int")


def test_write_leaves_no_file_without_rows(spark, tmp_path):
    out = str(tmp_path / "c {1,2} [a-b] é%20x")
    write_table(spark.range(0, 100, 1, 4).where("id >= 25"), out)
    kept = footer.data_files(spark, str(tmp_path / "c*"))
    assert len(kept) == 3 and all(footer.read_footer(spark, f).group_rows for f in kept)
    # Files of earlier writes stay, and so does the only file of a table without rows.
    spark.range(0, 100, 1, 2).where("id >= 50").write.parquet(str(tmp_path / "old"))
    write_table(spark.range(0, 100, 1, 2).where("id >= 50"), str(tmp_path / "old"), mode="append")
    assert [bool(footer.read_footer(spark, f).group_rows) for f in footer.data_files(spark, str(tmp_path / "old"))].count(False) == 1
    write_table(spark.range(0), str(tmp_path / "none"))
    assert scan(spark, str(tmp_path / "none")).dtypes == [("id", "bigint")]


def test_roundtrip_copy_of_splits_without_rows(spark, tmp_path):
    from lodestar.plans import catalog

    orders = pa.table({"o_orderkey": range(1000), "o_custkey": range(1000), "o_orderstatus": ["FO"[i % 2] for i in range(1000)]})
    for name, n, want in (("split", 1000, [("F", 500, 249_500), ("O", 500, 250_000)]), ("none", 0, [])):
        (tmp_path / name).mkdir()
        pq.write_table(orders.slice(0, n), tmp_path / name / "orders.parquet")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        try:
            assert (spark.read.parquet(str(tmp_path / name)).rdd.getNumPartitions() > 1) == (n > 0)
            assert sorted(map(tuple, catalog.roundtrip_copy(spark, str(tmp_path / name)).collect())) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_profile(spark, files):
    profile.run_measured(scan(spark, str(files / "mixed_small.parquet")).where("c_int32 > 5"))
    assert [r["in_handshakes_cycles"] for r in sql(spark, "select * from scan_profile()").collect()][0] > 0
    # One of eight columns' bytes are read, not the file's.
    wide = str(files / "mixed_small.parquet")
    narrowed, whole = [], []
    for cols, into in ((["c_int32"], narrowed), (["c_int32", "c_int64", "c_float", "c_double"], whole)):
        profile.run_measured(scan(spark, wide).select(*cols))
        into.append(sql(spark, "select sum(in_handshakes_cycles) from scan_profile()").first()[0])
    assert narrowed[0] < 0.6 * whole[0] and whole[0] * 64 <= 1.2 * (files / "mixed_small.parquet").stat().st_size
    rows = sql(spark, "select * from scan_profile()").collect()
    assert len(rows[0]) == 15 and rows[-1]["in_handshakes_cycles"] is None and [r["stream"] for r in rows] == list(range(len(rows)))
    for r in rows[:-1]:
        assert 0 <= r["in_throughput_gbps"] <= r["in_throughput_excl_idle_gbps"] <= 16
    assert profile.throughput(10, 10) == 16 and profile.throughput(0, 0) == 0 and profile.progress(spark) == 100
