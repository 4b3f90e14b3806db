"""Classifier outputs and their quality: softmax, argmax, accuracy, F1, confusion, calibration error, temperature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 10
TEMPERATURES = tuple(0.10 + 0.05 * i for i in range(19))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Probabilities of an array of logits over a temperature."""
    t = F.lit(temperature) if isinstance(temperature, float) else temperature
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def confidence(logits: Column, temperature: Column | float = 1.0) -> Column:
    """The largest probability: 1 / sum(exp((x - max) / T))."""
    t = F.lit(temperature) if isinstance(temperature, float) else temperature
    top = F.array_max(logits)
    return 1.0 / F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp((x - top) / t))


def argmax(values: Column) -> Column:
    """The first place of the largest value, from 0."""
    return F.array_position(values, F.array_max(values)) - 1


def top_k(probabilities: Column, k: int = 3) -> Column:
    """The k most probable classes as structs (p, i), the smaller index first among equals."""
    pairs = F.transform(probabilities, lambda p, i: F.struct((-p).alias("m"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct((-s["m"]).alias("p"), s["i"].alias("i")))


def valid_temperature(t: float | None) -> float:
    return 1.0 if t is None or t <= 0 else t


def class_report(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of every class that occurs in either column; divisions by zero give 0."""
    both = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))  # a confusion matrix: small
    sides = both.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit("t").alias("side")), F.struct(F.col("p").alias("label"), F.lit("p").alias("side")))).alias("s"), "t", "p", "n")
    per = sides.groupBy(F.col("s.label").alias("label")).agg(
        F.sum(F.when((F.col("s.side") == "t") & (F.col("t") == F.col("p")), F.col("n")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("s.side") == "t", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.side") == "p", F.col("n")).otherwise(0)).alias("predicted"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    return per.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def averages(report: DataFrame) -> DataFrame:
    """accuracy, macro_f1 and weighted_f1 of a class report."""
    return report.agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1")
    )


def confusion(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """All (truth, predicted) cells over the union of the labels, with zeros; labels are few."""
    labels = rows.select(F.col(truth).alias("v")).union(rows.select(F.col(predicted))).distinct()
    counts = rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    names = labels.agg(F.sort_array(F.collect_set("v")).alias("v"))
    grid = names.select(F.explode("v").alias("truth"), "v").select("truth", F.explode("v").alias("predicted"))
    return grid.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ece_bin(conf: Column, bins: int = BINS) -> Column:
    """The bin of a confidence: how many inner edges i * (1 / bins), as doubles, it reaches."""
    out = F.lit(0)
    for i in range(1, bins):
        out = out + F.when(conf >= i * (1.0 / bins), 1).otherwise(0)
    return out


def ece(rows: DataFrame, by: tuple[str, ...] = (), bins: int = BINS) -> DataFrame:
    """Expected calibration error of (confidence, correct) rows: the mean distance of accuracy and confidence, by equal bins."""
    cells = rows.groupBy(*by, ece_bin(F.col("confidence"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("acc"), F.avg("confidence").alias("conf"))
    return cells.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def temperature_search(rows: DataFrame, temperatures: tuple[float, ...] = TEMPERATURES) -> DataFrame:
    """(logits, label) rows to the calibration error at each temperature: one pass, a row being tried at every one of them."""
    tried = rows.withColumn("correct", argmax(F.col("logits")) == F.col("label")).withColumn("temperature", F.explode(F.array(*map(F.lit, temperatures))))
    return ece(tried.select("temperature", "correct", confidence(F.col("logits"), F.col("temperature")).alias("confidence")), ("temperature",))


def best_temperature(errors: DataFrame) -> DataFrame:
    """The temperature of the least error, the first one among equals."""
    return errors.agg(F.min(F.struct("ece", "temperature")).alias("m")).select(F.round("m.temperature", 2).alias("temperature"), F.col("m.ece").alias("ece"))


def diagnostics(rows: DataFrame) -> DataFrame:
    """Mean, least and largest confidence, the means when right and when wrong (0 if never), and the hits."""
    c = F.col("confidence")
    return rows.agg(
        F.avg(c).alias("mean"), F.coalesce(F.avg(F.when(F.col("correct"), c)), F.lit(0.0)).alias("mean_right"), F.coalesce(F.avg(F.when(~F.col("correct"), c)), F.lit(0.0)).alias("mean_wrong"),
        F.count_if("correct").alias("hits"), F.min(c).alias("least"), F.max(c).alias("most"),
    )
