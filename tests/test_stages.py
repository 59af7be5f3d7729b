"""Encoders inside Spark ML pipelines: saved, loaded, and equal rows."""

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from foldwise.encoders.categorical import OrdinalEncode
from foldwise.encoders.numeric import Scale
from foldwise.encoders.stages import EncoderStage


def test_pipeline_of_encoders_and_ridge_is_saved_and_loaded(spark, tmp_path):
    rng = random.Random(4)
    data = [(i, rng.choice(["A", "B", "AA", "C"]), rng.random(), rng.random()) for i in range(200)]
    rows = spark.createDataFrame(data, "id long, a string, x double, loss double")
    pipeline = Pipeline(
        stages=[
            EncoderStage(OrdinalEncode(["a"])),
            EncoderStage(Scale(["x"])),
            VectorAssembler(inputCols=["a_code", "x_scaled"], outputCol="features"),
            LinearRegression(labelCol="loss", regParam=0.1, elasticNetParam=0.0, solver="normal"),
        ]
    )
    read = lambda df: sorted(df.select("id", "a_code", "x_scaled", "prediction").collect())
    model = pipeline.fit(rows)
    expected = read(model.transform(rows))
    assert len(expected) == 200
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert read(loaded.transform(rows)) == expected
    assert loaded.stages[0].feature_names() == ["a_code"]
    assert [s.uid for s in loaded.stages] == [s.uid for s in model.stages]
    pipeline.save(str(tmp_path / "pipeline"))
    assert read(Pipeline.load(str(tmp_path / "pipeline")).fit(rows).transform(rows)) == expected
