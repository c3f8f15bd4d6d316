import datetime as dt

from pyspark.sql import functions as F

from millrace.operators.dataset import Dataset
from millrace.streaming import drain, stream_files, sum_by_key_in_windows

SCHEMA = "ts timestamp, k string, v bigint"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_windowed_sums_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rows = [(at(m), "ab"[m % 2], m) for m in range(30)]
    src = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame(rows[10 * i : 10 * i + 10], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = stream_files(spark, src, SCHEMA, files_each=1).filter(lambda ts, k, v: v >= 0)
    sums = sum_by_key_in_windows(stream, "ts", "k", "v", "10 minutes", "5 minutes")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    drain(sums, out, check)
    # a row far ahead closes all windows before it; a late one is dropped
    spark.createDataFrame([(at(500), "a", 1)], SCHEMA).write.mode("append").parquet(src)
    drain(sums, out, check)
    spark.createDataFrame([(at(1), "a", 1000)], SCHEMA).write.mode("append").parquet(src)
    drain(sums, out, check)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    want = sum_by_key_in_windows(Dataset(spark.createDataFrame(rows, SCHEMA)), "ts", "k", "v", "10 minutes", "5 minutes")
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) == 6
    counts = sum_by_key_in_windows(Dataset(spark.createDataFrame(rows, SCHEMA)), "ts", [], "v", "10 minutes", "0 minutes", "5 minutes", F.count("*"), "n")
    assert sum(r.n for r in counts.collect()) == 60
