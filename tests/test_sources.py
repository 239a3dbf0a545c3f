from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import columns as C
from tallyscope.session import FREE_SHUFFLES, checkpointed, materialise, shared_folder
from tallyscope.sources import csv_files as S
from tallyscope.sources.tables import business


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text(
        'id,amount,flag,note,day,empty,big\n'
        '1,1.5,True,"a ""quoted"" word",2025-01-01,,1\n'
        '2, 2 ,false,"two\nlines",2025-01-02,,NA\n'
        '3,N/A,TRUE,null,2025-01-03,,3\n'
    )
    return str(path)


def test_scan_keeps_text_and_reads_missing_tokens(spark, csv):
    rows = S.scan_csv(spark, csv).orderBy("id").collect()
    assert rows[0].note == 'a "quoted" word' and rows[1].note == "two\nlines"
    assert rows[2].amount is None and rows[2].note is None and rows[1].big is None


def test_types(spark, csv):
    got = {r.column_name: r.data_type for r in S.inferred_types(S.scan_csv(spark, csv)).collect()}
    assert got == {"id": "bigint", "amount": "double", "flag": "boolean", "note": "string",
                   "day": "string", "empty": "double", "big": "bigint"}
    frame = S.read_csv(spark, csv)
    assert [r.amount for r in frame.orderBy("id").collect()] == [1.5, 2.0, None]
    assert [r.flag for r in frame.orderBy("id").collect()] == [True, False, True]
    bucket = {r.column_name: r.bucket for r in C.column_profile(frame).collect()}
    assert bucket["day"] == "datetime" and bucket["empty"] == "numeric" and bucket["flag"] == "categorical"


def test_quoted_line_breaks_are_found_only_where_they_are(spark, csv, tmp_path):
    assert [f.rsplit("/", 1)[1] for f in S.open_quotes(spark, csv)] == ["rows.csv"]
    plain = tmp_path / "plain.csv"
    plain.write_text('a,b\n1,"x ""y"" z"\n2,w\n')
    assert not S.open_quotes(spark, [str(plain)])
    assert S.scan_csv(spark, str(plain), multi_line=False).count() == 2


def test_a_stray_quote_leaves_the_other_files_splittable(spark, tmp_path):
    folder = tmp_path / "some files"
    folder.mkdir()
    for name, note in (("a b.csv", "plain"), ("b+1.csv", '"two\nlines"'), ("c%20.csv", "plain")):
        rows = "".join(f"{name[0]}{i},{note}\n" for i in range(2000))
        (folder / name).write_text("id,note\n" + rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        frame = S.scan_csv(spark, str(folder)).withColumn("task", F.spark_partition_id())
        parts = frame.groupBy(F.substring("id", 1, 1).alias("file")).agg(
            F.countDistinct("task").alias("tasks"), F.count("*").alias("n"),
            F.count_if(F.col("note") == "two\nlines").alias("broken"),
        )
        got = {r.file: (r.tasks, r.n, r.broken) for r in parts.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got["b"] == (1, 2000, 2000)
    assert all(got[f][0] > 3 and got[f][1:] == (2000, 0) for f in "ac")
    assert frame.select("id").distinct().count() == 6000


def test_manifest(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x" * 1023)
    (tmp_path / "b.csv").write_bytes(b"x" * 1536)
    (tmp_path / "c.csv").write_bytes(b"x" * (1024 * 1024 + 1))
    rows = S.source_manifest(spark, str(tmp_path / "*.csv")).orderBy("file_name").collect()
    assert [(r.file_name, r.file_size_display) for r in rows] == [
        ("a.csv", "1023 B"), ("b.csv", "1.5 KB"), ("c.csv", "1.0 MB")]


def test_materialise_uses_the_shared_folder(spark):
    frame = materialise(spark.range(5))
    assert frame.count() == 5 and shared_folder(spark)
    assert "Range" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_materialised_rows_leave_no_shuffle_files(spark):
    """Lineage is cut, so nothing reads these files again; on large tables they are most of the disk."""

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in map(str, (files.apply(i).getName() for i in range(files.size()))) if name.startswith("shuffle_")}

    rows = spark.range(5000).selectExpr("id % 7 as k", "cast(id as decimal(18,4)) as v", "if(id = 1, null, 'x') as t")
    sums = rows.groupBy("k", "t").agg(F.sum("v").alias("v"), F.array_sort(F.collect_set("t")).alias("ts"))
    wanted = sorted(map(str, sums.collect()))
    for write in (materialise, checkpointed):
        before = shuffled()
        kept = write(sums.select("*"))
        end = time.time() + 20
        while shuffled() - before and time.time() < end:  # they are deleted in the background
            time.sleep(0.2)
        assert not shuffled() - before
        assert kept.dtypes == sums.dtypes and sorted(map(str, kept.collect())) == wanted
    assert spark.conf.get(FREE_SHUFFLES) == "false"
    nothing = materialise(spark.range(3).select(F.lit(None).alias("k"), "id"))
    assert nothing.dtypes[0] == ("k", "void") and nothing.count() == 3


def test_lines_of_an_order_end_in_one_task(spark):
    """Lines meet their part first: texts of orders aren't shuffled with them, and folds by order are small."""
    with_these = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in with_these}
    for k, v in with_these.items():
        spark.conf.set(k, v)
    try:
        plan = business(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        assert "order_id" in plan.outputPartitioning().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_whole_numbers_keep_every_digit(spark, tmp_path):
    path = tmp_path / "ids.csv"
    path.write_text(
        "id,huge,over\n"
        "1234567890123456789,12345678901234567890,1\n"
        "1234567890123456788,12345678901234567891,1" + "0" * 40 + "\n"
    )
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    try:
        frame = S.read_csv(spark, str(path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert dict(frame.dtypes) == {"id": "bigint", "huge": "decimal(38,0)", "over": "string"}
    assert {r["id"] for r in frame.collect()} == {1234567890123456789, 1234567890123456788}
    assert len({r["huge"] for r in frame.collect()}) == 2
