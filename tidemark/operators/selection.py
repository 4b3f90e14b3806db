"""Training in rounds with validation: each round goes on from the last one's weights, the round of the best macro-F1 is kept, and rounds without a better one end it.

The classifier is a softmax regression (a perceptron without hidden layers, whose weights Spark lets a fit begin from). Every pass is a distributed one over
all training rows; the driver holds the weights (features times classes) alone. After each round its weights and figures are written, so that a run that broke off
goes on where it was; only the best and the last round's weights stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import calibration, labelling
from .lineage import stored

FIGURES = "round int, accuracy double, macro_f1 double, weighted_f1 double"


@dataclass
class Selection:
    spark: SparkSession
    folder: str
    rounds: int = 5
    patience: int = 2
    steps: int = 10
    seed: int = 42

    def history(self) -> list[dict]:
        """The figures on the validation rows of the rounds so far, in order."""
        rows = [self.spark.read.schema(FIGURES).json(f"{self.folder}/figures/{n}").first().asDict() for n in self._names("figures")]
        return sorted(rows, key=lambda r: r["round"])

    def best(self) -> dict:
        """The round of the greatest macro-F1, the first of equal ones."""
        return max(self.history(), key=lambda r: (r["macro_f1"], -r["round"]))

    def model(self, number: int | None = None) -> MultilayerPerceptronClassificationModel:
        return MultilayerPerceptronClassificationModel.load(f"{self.folder}/weights/{self.best()['round'] if number is None else number}")

    def over(self) -> bool:
        said = self.history()
        return bool(said) and (len(said) >= self.rounds or said[-1]["round"] - self.best()["round"] >= self.patience)

    def fit(self, rows: DataFrame, features: str = "features", label: str = "label") -> Selection:
        """Trains on rows of split `train` and judges by rows of split `validation`; `label` counts the classes from 0.

        Rows with a null label or vector are left out. No training or validation rows, or fewer than two classes, are an error. A class that only validation
        rows have can't be learnt and counts as wrong. Repeated rows weigh as often as they occur.
        """
        rows = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull())
        known = stored(rows.select(F.col(label).cast("double").alias("label"), F.col(features).alias("features"), "split"))
        train, validation = known.where("split = 'train'"), known.where("split = 'validation'")
        first, classes = train.first(), known.agg(F.max("label")).first()[0]
        if first is None or validation.isEmpty() or not classes:
            raise ValueError("training needs labelled rows of at least two classes in both splits")
        layers = [len(first["features"]), int(classes) + 1]
        while not self.over():
            said = self.history()
            number = len(said) + 1
            start = self.model(number - 1).weights if said else None
            model = self._round(train, layers, start)
            model.write().overwrite().save(f"{self.folder}/weights/{number}")
            report = calibration.class_report(model.transform(validation).select(F.col("label").alias("truth"), F.col("prediction").alias("predicted")))
            figures = calibration.averages(report).select(F.lit(number).alias("round"), "accuracy", "macro_f1", "weighted_f1")
            figures.coalesce(1).write.mode("overwrite").json(f"{self.folder}/figures/{number}")  # one row
            self._keep({self.best()["round"], number})
        return self

    def _round(self, train: DataFrame, layers: list[int], start: Vector | None) -> MultilayerPerceptronClassificationModel:
        learner = MultilayerPerceptronClassifier(layers=layers, maxIter=self.steps, tol=0.0, seed=self.seed)
        return (learner if start is None else learner.setInitialWeights(start)).fit(train)

    def _keep(self, numbers: set[int]) -> None:
        for name in self._names("weights"):
            if int(name) not in numbers:
                self._fs().delete(self._path(f"{self.folder}/weights/{name}"), True)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        """Finished entries alone: a round whose files were not all written is done again."""
        found = self._fs().globStatus(self._path(f"{self.folder}/{folder}/*{'/_SUCCESS' if folder == 'figures' else ''}")) or []
        return [(f.getPath().getParent() if folder == "figures" else f.getPath()).getName() for f in found]


def split_labelled(rows: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """The rows with their class's number among the sorted labels (`label_id`) and their stratified `split`; rows without a label go."""
    named = rows.where(F.col(label).isNotNull()).withColumn("sub_category", F.col(label))
    ids = labelling.label_ids(named).withColumnRenamed("label", "_l")
    parted = labelling.split(named, key, seed=seed)
    return parted.join(F.broadcast(ids), parted["sub_category"] == ids["_l"]).drop("_l", *({"sub_category"} - {label}))
