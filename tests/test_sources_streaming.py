import gzip

import pytest
from pyspark.sql import functions as F

from sitewise.operators import clients, series
from sitewise.sources import audit, sinks, tables
from sitewise.streaming import hourly


def put(path, text, zipped=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    with (gzip.open(path, "wt") if zipped else open(path, "w")) as f:
        f.write(text)
    return str(path)


def test_locating_tables_ends_at_the_first_level_with_a_match(spark, tmp_path, monkeypatch):
    """A store with very many files elsewhere: the driver is never given their names."""
    root = tmp_path / "data"
    for i in range(300):
        put(root / "icu" / f"old{i % 3}" / f"part{i}" / "b.csv", "k\n1\n")
    near = put(root / "icu" / "b.csv.gz", "k\n1\n", True)
    monkeypatch.setattr(tables, "_listing", None)
    assert tables.find_table(spark, str(root), "b", "icu") == near
    assert tables.find_table(spark, str(root), "B", "icu/old1") is not None
    assert tables.find_table(spark, str(root), "b", "icu/old1", depth=0) is None
    put(root / "odd" / "a[1].csv", "k\n1\n")
    assert tables.find_table(spark, str(root), "a[1]", "odd").endswith("a[1].csv")


def test_locating_tables(spark, tmp_path):
    root = tmp_path / "data"
    assert tables.find_table(spark, str(root), "a", "icu") is None
    deep = put(root / "icu" / "x" / "a.csv", "k\n1\n")
    assert tables.find_table(spark, str(root), "a", "icu") == deep
    own = put(root / "icu" / "a.csv" / "a.csv.gz", "k\n1\n", True)
    assert tables.find_table(spark, str(root), "a", "icu") == own               # same depth: compressed first
    flat = put(root / "icu" / "A.csv2", "k\n1\n")
    assert flat and tables.find_table(spark, str(root), "a", "icu") == own      # other names do not count
    put(root / "hosp" / "Patient.csv", "k\n1\n")
    assert tables.find_table(spark, str(root), "patient", "hosp").endswith("Patient.csv")


def test_pinned_types(spark, tmp_path):
    p = put(tmp_path / "t.csv", 'id,note,v\n1,"a, b",\n2,c,2.5\n')
    df = tables.read_csv(spark, p, {"v": "double", "id": "bigint"})
    assert df.dtypes == [("id", "bigint"), ("note", "string"), ("v", "double")]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "a, b", None), (2, "c", 2.5)]
    bad = put(tmp_path / "bad.csv", "id,v\n1,2.5\nx,3\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILFAST|malformed"):
        tables.read_csv(spark, bad, {"id": "bigint"}).collect()


def test_gzip_rows_are_spread(spark, tmp_path):
    p = put(tmp_path / "z.csv.gz", "id\n" + "\n".join(map(str, range(100))) + "\n", True)
    df = tables.read_csv(spark, p, {"id": "int"}, spread=4)
    assert df.count() == 100 and df.rdd.getNumPartitions() == 4


def test_damaged_rows_are_kept_apart(spark, tmp_path):
    p = put(tmp_path / "t.csv", "id,a,v\n1,x,1.5\n2,y\n3,z,oops\n4,w,4\n")
    good, bad = tables.read_csv_tolerant(spark, p, {"id": "int", "v": "double"})
    assert [r["id"] for r in good.orderBy("id").collect()] == [1, 4] and good.count() == 2
    assert {r["row_text"] for r in bad.collect()} == {"2,y", "3,z,oops"} and bad.count() == 2


def test_malformed_rows_and_sizes(spark, tmp_path):
    p = put(tmp_path / "t.csv", 'id,note,v\n1,"a, b",1\n2,c\n\n3,d,3\n')
    assert [(r["row_text"], r["n_fields"]) for r in audit.malformed_rows(spark, p).collect()] == [("2,c", 2)]
    r = audit.file_report(spark, p, {"t.csv": 10_000}).first()
    assert (r["n_rows"], r["n_malformed"], r["small"]) == (3, 1, 1)


def test_gzip_audit(spark, tmp_path):
    whole = put(tmp_path / "ok.gz", "a\nb\nc", True)
    long = put(tmp_path / "long.gz", "\n".join(str(i * 7919) for i in range(50_000)), True)
    cut = tmp_path / "cut.gz"
    cut.write_bytes(open(long, "rb").read()[:-4000])
    junk = tmp_path / "junk.gz"
    junk.write_bytes(b"not gzip at all")
    two = tmp_path / "two.gz"
    two.write_bytes(gzip.compress(b"a\n") + gzip.compress(b"b\n"))
    got = {r["path"].rsplit("/", 1)[1]: r for r in audit.gzip_audit(spark, [whole, str(cut), str(junk), str(two)]).collect()}
    assert (got["ok.gz"]["ok"], got["ok.gz"]["n_lines"]) == (True, 3) and (got["two.gz"]["ok"], got["two.gz"]["n_lines"]) == (True, 2)
    assert not got["cut.gz"]["ok"] and 0 < got["cut.gz"]["n_lines"] < 50_000 and not got["junk.gz"]["ok"]


def test_optional_tables(spark, tmp_path):
    empty = tables.read_optional(spark, str(tmp_path), "none", "stay_id bigint, v double")
    assert empty.count() == 0 and empty.dtypes == [("stay_id", "bigint"), ("v", "double")]
    put(tmp_path / "some.csv", "v,extra,stay_id\n1.5,x,7\n")
    assert [tuple(r) for r in tables.read_optional(spark, str(tmp_path), "some", "stay_id bigint, v double").collect()] == [(7, 1.5)]
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path), "none")


def test_latest_run(spark, tmp_path):
    import os
    for i, run in enumerate(("run_b", "run_a")):
        os.utime(put(tmp_path / run / "m.csv", f"auroc\n0.{i}\n"), (1e9 + i * 1000, 1e9 + i * 1000))
    rows = {r["run"]: r for r in tables.latest_run(spark, str(tmp_path), "m.csv").collect()}
    assert rows["run_a"]["is_latest"] and not rows["run_b"]["is_latest"] and rows["run_a"]["auroc"] == "0.1"
    with pytest.raises(FileNotFoundError):
        tables.latest_run(spark, str(tmp_path), "other.csv")


def test_assignments_belong_to_their_cohort(spark, tmp_path):
    c = spark.range(50).select(F.col("id").alias("stay_id"), F.col("id").alias("subject_id"), F.lit("u").alias("unit"),
                               (F.col("id") % 2).cast("int").alias("label"))
    split = clients.grouped_split(clients.by_category(c, "unit", 1))
    sinks.write_assignment(split, c, str(tmp_path / "a"))
    assert sinks.read_assignment(spark, str(tmp_path / "a"), c).count() == 50
    with pytest.raises(ValueError, match="made for cohort"):
        sinks.read_assignment(spark, str(tmp_path / "a"), c.where("stay_id > 0"))


def test_sinks_round_trip(spark, tmp_path):
    g = spark.createDataFrame([(1, "m", 0, 1.0), (1, "m", 1, None)], "stay_id long, feature string, hr int, value double")
    sinks.write_packed(series.pack_series(g), str(tmp_path / "p"))
    assert series.unpack_series(sinks.read_packed(spark, str(tmp_path / "p"))).exceptAll(g).count() == 0
    sinks.write_parquet(g, str(tmp_path / "q"), ["feature"], ["stay_id"])
    assert spark.read.parquet(str(tmp_path / "q")).where("feature = 'm'").count() == 2
    sinks.write_result_csv(g, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    ev = spark.range(3000).select((F.col("id") % 40).alias("stay_id"), F.element_at(F.array(*map(F.lit, "usm")), (F.col("id") % 3 + 1).cast("int")).alias("feature"),
                                  (F.col("id") % 17).cast("double").alias("value"), (F.col("id") % 53 / 2).alias("hours_in"))
    src = str(tmp_path / "src")
    for i in range(3):
        ev.where(F.col("stay_id") % 3 != i).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(ev.schema).parquet(src)
    for _ in range(2):                                        # a restart adds nothing
        hourly.start_bins(stream, 24, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    got = hourly.read_bins(spark, str(tmp_path / "out"), ["u"], ["s"]).select("stay_id", "feature", "hr", F.round("value", 9))
    want = series.hourly_bins(spark.read.parquet(src), 24, ["u"], ["s"]).select("stay_id", "feature", "hr", F.round("value", 9))
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
