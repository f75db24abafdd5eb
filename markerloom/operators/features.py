"""Features of detected taxa for a classifier, and scoring with an ONNX model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ("f_coverage", "f_strength", "f_depth", "f_share")


def classifier_features(profile: DataFrame) -> DataFrame:
    """The profile with four logarithmic features; every count is taken as at least 1, the total over the profile's rows of the sample."""
    s, r, t = (F.greatest(F.col(c).cast("double"), F.lit(1.0)) for c in ("sequenced_tag_num", "sequenced_reads_num", "theoretical_tag_num"))
    total = F.greatest(F.sum("sequenced_reads_num").over(W.partitionBy("sample")).cast("double"), F.lit(1.0))
    values = (F.ln(s / t), F.ln(F.sqrt(s * r)), F.ln(r / s), F.ln(r / s * t / total))
    return profile.withColumns({n: v.cast("float") for n, v in zip(NAMES, values, strict=True)})


def _predict_task(model: bytes):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        session = onnxruntime.InferenceSession(model, options)
        name = session.get_inputs()[0].name
        for df in frames:
            if len(df):
                labels = session.run(None, {name: df[list(NAMES)].to_numpy(np.float32)})[0]
                yield df.assign(prediction=np.asarray(labels).reshape(-1).astype(np.int64))

    return run


def predict_presence(features: DataFrame, model: bytes) -> DataFrame:
    """Adds the model's label; the model takes [n, 4] floats and its first output is one integer per row."""
    schema = T.StructType([*features.schema.fields, T.StructField("prediction", T.LongType())])
    return features.mapInPandas(_predict_task(model), schema)
