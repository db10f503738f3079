import datetime as dt

from axisframe.streaming import resample_stream


def test_windows_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), float(m)) for m in (0, 1, 6, 7, 12)]
    table = spark.createDataFrame(rows, "ts timestamp, value double")
    table.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    query = resample_stream(stream, "ts", "5 minutes", "value").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    got = sorted(map(tuple, spark.sql("select * from windows").collect()))
    query.stop()
    assert got == sorted(map(tuple, resample_stream(table, "ts", "5 minutes", "value").collect()))
    assert [r[2] for r in got] == [1.0, 13.0, 12.0]
