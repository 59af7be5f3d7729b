"""Encoders as stages of a Spark ML ``Pipeline``, saved and loaded with it."""

from __future__ import annotations

import importlib

from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from foldwise.encoders.base import Fitted


def _name(held: object) -> str:
    return f"{type(held).__module__}:{type(held).__qualname__}"


def _class(name: str) -> type:
    module, _, kind = name.partition(":")
    return getattr(importlib.import_module(module), kind)


class _StageWriter(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, self.stage._described())
        self.stage._save_held(self.sparkSession, path)


class _StageReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind._restored(self.sparkSession, path, metadata)
        stage._resetUid(metadata["uid"])
        return stage


class _Stage(MLWritable, MLReadable):
    def write(self) -> MLWriter:
        return _StageWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StageReader(cls)


class EncoderStage(_Stage, Estimator):
    """An encoder whose ``fit`` takes one table; its settings are saved as JSON."""

    def __init__(self, encoder):
        super().__init__()
        self.encoder = encoder

    def _fit(self, dataset: DataFrame) -> "EncoderModel":
        return EncoderModel(self.encoder.fit(dataset))

    def _described(self) -> dict:
        return {"encoder": _name(self.encoder), "settings": vars(self.encoder)}

    def _save_held(self, spark, path: str) -> None:
        pass

    @classmethod
    def _restored(cls, spark, path: str, metadata: dict) -> "EncoderStage":
        kind = _class(metadata["encoder"])
        encoder = kind.__new__(kind)
        vars(encoder).update(metadata["settings"])
        return cls(encoder)


class EncoderModel(_Stage, Model):
    """A fitted encoder; its parameters and dictionary are saved beside the metadata."""

    def __init__(self, fitted: Fitted):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset)

    def feature_names(self) -> list[str]:
        return self.fitted.feature_names()

    def _described(self) -> dict:
        return {"fitted": _name(self.fitted)}

    def _save_held(self, spark, path: str) -> None:
        self.fitted.save(spark, f"{path}/fitted")

    @classmethod
    def _restored(cls, spark, path: str, metadata: dict) -> "EncoderModel":
        return cls(_class(metadata["fitted"]).load(spark, f"{path}/fitted"))
