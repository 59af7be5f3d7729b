"""The whole past as text, written: each value begins with the one before it."""

import datetime
import os
from hashlib import md5

from pyspark.sql import functions as F

from __spark_entry__ import queries

MODES = {"click": "0", "error": "1", "purchase": "2", "signup": "3", "view": "4"}


def test_written_histories_do_not_grow_with_the_square(spark, tmp_path):
    n = 9000
    kinds = list(MODES)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=i), 10 if i % 9 else i % 7, kinds[i * i % 5], 1.0, "{}") for i in range(n)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in/events.parquet")

    found = queries()["w2_history_list"](spark, f"{tmp_path}/in")
    found.write.parquet(f"{tmp_path}/out")
    size = sum(os.path.getsize(f"{tmp_path}/out/{f}") for f in os.listdir(f"{tmp_path}/out"))
    assert size < 1_000_000  # the texts are 67 MB
    assert spark.conf.get("parquet.writer.version", None) is None

    past, want = {}, {}
    for sid, _, user, kind, _, _ in rows:
        own = past.setdefault(user if user % 10 else -1, [])
        want[sid] = ",".join(own)
        own.append("-1" if sid % 61 == 0 else MODES[kind])
    kept = spark.read.parquet(f"{tmp_path}/out").select("sid", F.md5("history").alias("h")).collect()
    assert len(kept) == n
    assert all(r["h"] == md5(want[r["sid"]].encode()).hexdigest() for r in kept)
