"""Model boundaries: JSON answers with retries, narratives for the strongest items, and a trainable text classifier as stand-in.

Models are functions from texts to answers, injected by the caller. Their results are written before they are reused.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, NGram, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed
from ..operators.calibration import confidence
from .readers import with_retry


def _json_answer(answer: Callable[[str], str], text: str, retries: int, wait: Callable[[float], None]) -> dict:
    return with_retry(lambda: json.loads(answer(text)), retries, wait, (json.JSONDecodeError, KeyError))


def json_answers(df: DataFrame, column: str, out: str, answer: Callable[[str], str], retries: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """One JSON object a row as text; an answer that is no JSON is asked for again after 1, 2, 4... seconds, and is null after the last time. No retries give {}."""

    @F.pandas_udf("string")
    def ask(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            got = []
            for t in s:
                try:
                    got.append(json.dumps(_json_answer(answer, t, retries, wait), ensure_ascii=False))
                except (json.JSONDecodeError, KeyError):
                    got.append(None)
            yield pd.Series(got, dtype=object)

    return df.withColumn(out, ask(column))


def narrative_prompt() -> Column:
    """What a model is asked about a scored item: title, category and score."""
    return F.concat_ws(" | ", F.coalesce("title", F.lit("")), F.coalesce("sub_category", F.lit("?")), fixed(F.col("composite_score"), 3, plus=True))


def narratives(top: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    """(announcement_id, narrative) for a report's few strongest items; where the model fails the narrative is null, and the report says so."""
    text = narrative_prompt()

    @F.pandas_udf("string")
    def ask(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            got = []
            for t in s:
                try:
                    got.append(answer(t))
                except Exception:  # a narrative never fails the report
                    got.append(None)
            yield pd.Series(got, dtype=object)

    return top.select("announcement_id", text.alias("_t")).withColumn("narrative", ask("_t")).drop("_t")


def train_classifier(labelled: DataFrame, features: int = 1 << 14, rounds: int = 50) -> PipelineModel:
    """A text classifier of (text, sub_category) rows: characters' 1- and 2-grams, hashed and weighted, with logistic regression."""
    rows = labelled.where("sub_category is not null and text is not null")
    stages = [
        StringIndexer(inputCol="sub_category", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"),
        RegexTokenizer(inputCol="text", outputCol="_chars", gaps=False, pattern=r"\S", minTokenLength=1),
        NGram(inputCol="_chars", outputCol="_pairs", n=2),
        HashingTF(inputCol="_pairs", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_idf"),
        LogisticRegression(featuresCol="_idf", labelCol="label", maxIter=rounds, regParam=1e-4),
    ]
    model = Pipeline(stages=stages).fit(rows)
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=model.stages[0].labels)
    return PipelineModel([*model.stages[1:], names])


def predict(model: PipelineModel, df: DataFrame, temperature: float = 1.0) -> DataFrame:
    """The rows with predicted sub-category and confidence at a temperature."""
    out = model.transform(df)
    return out.withColumn("confidence", confidence(vector_to_array("rawPrediction"), temperature)).select(*df.columns, F.col("predicted").alias("sub_category"), "confidence")


def require_model(path: str) -> PipelineModel:
    """A trained model, or an error at once, before anything is planned."""
    try:
        return PipelineModel.load(path)
    except Exception as e:
        raise FileNotFoundError(f"no trained model at {path}") from e
