"""Rows that wait for a label are kept on disk, and the session keeps its settings."""

import datetime as dt

from pyspark.ml.classification import NaiveBayes

from foldwise.streaming import batches as T


def test_state_is_kept_on_disk(spark, tmp_path):
    schemas = {"rows": "id long, batch_no int, num double, cat string, arrived timestamp", "labels": "id long, y int, arrived timestamp"}
    for b in range(3):
        at = dt.datetime(2024, 1, 1 + b)
        rows = [(100 * b + k, b, float(k % 7), "abc"[k % 3], at) for k in range(40)]
        late = [(100 * (b - 1) + k, k % 2, at) for k in range(40) if b]
        for name, data in (("rows", rows), ("labels", late)):
            spark.createDataFrame(data, schemas[name]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    streams = [spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}") for n, s in schemas.items()]
    before = spark.conf.getAll
    T.prequential_late(*streams, f"{tmp_path}/run", NaiveBayes(), ["num"], ["cat"], bound="5 days").awaitTermination()
    assert spark.conf.getAll == before
    kept = list((tmp_path / "run/progress/state").rglob("*"))
    assert any(f.suffix in (".zip", ".changelog") for f in kept)
    assert not any(f.suffix == ".delta" for f in kept)  # files of the store that keeps its rows on the heap
    assert {r["id"] for r in spark.read.parquet(f"{tmp_path}/run/judged").collect()} == {100 + k for k in range(40)}
