"""Labelled training data: reading, validating, exporting, merging, splitting."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import taxonomy as T
from .lineage import cut, stored
from .ranking import hash_rank


def with_major(labelled: DataFrame) -> DataFrame:
    """The major category, by default the first character of the sub-category."""
    return labelled.withColumn("major_category", F.coalesce(F.nullif("major_category", F.lit("")), F.substring("sub_category", 1, 1)))


def valid(labelled: DataFrame) -> DataFrame:
    """valid and invalid row counts: valid rows have a sub-category and a text."""
    ok = F.coalesce((F.col("sub_category") != "") & (F.col("text") != ""), F.lit(False))
    return labelled.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def export_unlabelled(announcements: DataFrame, labelled: DataFrame, count: int = 200, status: str | None = None) -> DataFrame:
    """The newest rows, those with a body first, cut to `count`; of these, the ones that are not labelled yet and long enough."""
    df = announcements if status is None else announcements.where(F.col("processing_status") == status)
    df = df.orderBy(F.col("full_text").isNull(), F.desc("published_date"), "id").limit(count)
    df = df.join(labelled.select("announcement_id").where("announcement_id <> ''").distinct(), "announcement_id", "left_anti")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("full_text", F.lit("")))
    df = df.select("announcement_id", text.alias("text")).where(F.length(F.trim(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))) >= 10)
    return df.select("announcement_id", F.substring("text", 1, 3000).alias("text"), F.lit("").alias("sub_category"), F.lit("").alias("major_category"))


def candidates(labelled: DataFrame) -> DataFrame:
    """Rows that may be merged: labelled, with a text, of a sub-category that the taxonomy has."""
    ok = labelled.where((F.col("sub_category") != "") & (F.col("text") != ""))
    return ok.join(F.broadcast(T.events_df(labelled.sparkSession).select(F.col("sub").alias("sub_category"))), "sub_category", "left_semi")


#: Rows that one task walks through in order, and distributed rounds before a walk.
WALK_ROWS, ROUNDS = 200_000, 1


def _round(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that come first under both of their keys are kept, and all later rows of those keys go: (kept, rows still open)."""
    by_k = rows.groupBy("_k").agg(F.min("_o").alias("_fk"))
    by_t = rows.groupBy("_t").agg(F.min("_o").alias("_ft"))
    sure = stored(rows.join(by_k, "_k").join(by_t, "_t").where((F.col("_o") == F.col("_fk")) & (F.col("_o") == F.col("_ft"))).select("_o", "_k", "_t"))
    return sure, stored(rows.join(sure.select("_k"), "_k", "left_anti").join(sure.select("_t"), "_t", "left_anti").select("_o", "_k", "_t"))


def _components(rows: DataFrame) -> DataFrame:
    """The rows with a number of the component of keys that share rows, by contraction (large-star and small-star steps) in about a logarithm of its length."""
    ends = rows.withColumns({"_u": F.xxhash64(F.lit("k"), "_k"), "_v": F.xxhash64(F.lit("t"), "_t")})  # equal hashes only join components, which is harmless
    pair = lambda a, b: (F.greatest(a, b).alias("_u"), F.least(a, b).alias("_v"))
    links, state = stored(ends.select(*pair("_u", "_v")).where("_u <> _v").distinct()), None
    while True:
        both = links.unionByName(links.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        least = both.groupBy("_u").agg(F.min("_v").alias("_m")).select("_u", F.least("_u", "_m").alias("_m"))
        large = both.join(least, "_u").where("_v > _u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).where("_u <> _v").distinct()
        least = large.groupBy("_u").agg(F.min("_v").alias("_m"))
        small = large.join(least, "_u").where("_v <> _m").select(*pair("_v", "_m")).unionByName(least.select("_u", F.col("_m").alias("_v"))).distinct()
        links = stored(small)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("_u", "_v").cast("decimal(20,0)"))).first())
        if now == state:
            break
        state = now
    root = links.select("_u", F.col("_v").alias("_c"))  # a star each: every key but the least points to the least
    return ends.join(root, "_u", "left").select("_o", "_k", "_t", F.coalesce("_c", "_u").alias("_c"))


def _walked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept rows of components that come one after the other, each in its order."""
    component, keys, texts = None, set(), set()
    for batch in batches:
        keep = []
        for c, k, t in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("_c", "_k", "_t")), strict=True):
            if c != component:
                component, keys, texts = c, set(), set()
            keep.append(k not in keys and t not in texts)
            if keep[-1]:
                keys.add(k)
                texts.add(t)
        yield batch.filter(pa.array(keep, pa.bool_()))


def first_wins(rows: DataFrame, order: str = "place", walk: int = WALK_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Ordered first-wins deduplication on two keys: a row goes if its id, or its text, is that of a row kept before.

    Whether a row stays depends on earlier rows only through shared ids and texts. A few distributed rounds decide all rows but those in chains (a row first under both
    keys is kept, later rows of its keys go). Of the rest at most `walk` rows are walked through in order by one task. More are contracted into the
    components that shared ids and texts connect; components of at most `walk` rows are walked through each by itself, the rows of larger ones
    go through rounds again. So a chain of any length up to `walk` costs a fixed number of jobs, and no task holds more than that. `order` must be unique.
    """
    key = F.coalesce(F.nullif("announcement_id", F.lit("")), F.concat(F.lit("text:"), F.col("text")))
    keyed = rows.withColumns({"_k": F.sha2(key, 256), "_t": F.sha2("text", 256), "_o": F.col(order)})
    left, kept = keyed.where("_k is not null and _t is not null").select("_o", "_k", "_t"), []
    while True:
        for _ in range(rounds):
            sure, left = _round(left)
            kept.append(sure.select("_o"))
        n = left.count()
        if n <= walk:
            dealt = left.withColumn("_c", F.lit(0).cast("long")).repartition(1).sortWithinPartitions("_o") if n else None
            larger = None
        else:
            parts = stored(_components(left))
            sizes = parts.groupBy("_c").agg(F.count("*").alias("_n")).where(F.col("_n") > walk).select("_c")
            larger = stored(parts.join(sizes, "_c", "left_semi").select("_o", "_k", "_t"))
            dealt = parts.join(sizes, "_c", "left_anti").select("_o", "_k", "_t", "_c").repartition("_c").sortWithinPartitions("_c", "_o")
        if dealt is not None:
            kept.append(stored(dealt.mapInArrow(_walked, dealt.schema).select("_o")))
        if larger is None or larger.isEmpty():
            break
        left = larger
    return keyed.join(functools.reduce(DataFrame.unionByName, kept), "_o", "left_semi").drop("_k", "_t", "_o")


def merge(inputs: list[DataFrame]) -> tuple[DataFrame, dict[str, int]]:
    """Several labelled sets in order as one, without repeats; how many rows were kept, skipped and of an unknown category."""
    rows = None
    for i, df in enumerate(inputs):
        df = df.select("announcement_id", "text", "sub_category", "major_category", F.struct(F.lit(i), F.col("place") if "place" in df.columns else F.monotonically_increasing_id()).alias("place"))
        rows = df if rows is None else rows.unionByName(df)
    rows = cut(rows)
    said = rows.where((F.col("sub_category") != "") & (F.col("text") != ""))
    merged = cut(first_wins(candidates(rows)))
    total, labelled, known, kept = rows.count(), said.count(), candidates(rows).count(), merged.count()
    return merged, {"merged": kept, "skipped": total - labelled + known - kept, "invalid": labelled - known}


def label_ids(labelled: DataFrame) -> DataFrame:
    """Each label's index in the sorted list of labels; the labels are few (30)."""
    distinct = labelled.select(F.col("sub_category").alias("label")).where("label is not null").distinct()
    return distinct.withColumn("label_id", (F.row_number().over(W.orderBy("label")) - 1).cast("long"))


def split(labelled: DataFrame, key: str, train: float = 0.70, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """A stratified split: in each class rows are ranked by a seeded hash, and cut at the shares."""
    place = F.col("_rank") / F.col("_size")
    part = F.when(place < train, "train").when(place < train + validation, "validation").otherwise("test")
    return hash_rank(labelled, "sub_category", key, seed).withColumn("split", part).drop("_rank", "_size")


def template_difference(templates: DataFrame) -> DataFrame:
    """Sub-categories that only the templates, or only the taxonomy, have."""
    ev = T.events_df(templates.sparkSession).select(F.col("sub").alias("sub_category"))
    own = templates.select("sub_category").distinct()
    return own.subtract(ev).withColumn("side", F.lit("unknown")).unionByName(ev.subtract(own).withColumn("side", F.lit("missing")))


def seed_rows(templates: DataFrame, fillers: dict[str, list[str] | tuple[int, int]], each: int = 32, seed: int = 42) -> DataFrame:
    """`each` filled rows of each sub-category of (sub_category, title, body): sub_category, i and text (title, line feed, body).

    A filler is a list of values or a range of whole numbers; it replaces all of its placeholders `{name}` of a title or body by one draw. Longer names are filled
    first, so that none is taken for the start of another. Template and draws come from the md5 of (seed, sub-category, row, part, name), so rows are the
    same in every run. Rows without a sub-category are no templates; a null title or body is empty.
    """
    draw = lambda n, *what: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "sub_category", F.col("i").cast("string"), *map(F.lit, what)).cast("binary")), 1, 8), 16, 10).cast("long") % n

    def filled(text: Column, part: str) -> Column:
        text = F.coalesce(text, F.lit(""))
        for name in sorted(fillers, key=lambda n: (-len(n), n)):
            values = fillers[name]
            if isinstance(values, tuple):
                value = (draw(values[1] - values[0] + 1, part, name) + values[0]).cast("string")
            else:
                value = F.get(F.array(*map(F.lit, values)), draw(len(values), part, name).cast("int"))
            text = F.replace(text, F.lit("{" + name + "}"), value)
        return text

    by = templates.where("sub_category is not null").groupBy("sub_category").agg(F.array_sort(F.collect_set(F.struct(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body")))).alias("_t"))
    rows = by.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    rows = rows.withColumn("_t", F.get("_t", draw(F.size("_t"), "template").cast("int")))
    return rows.select("sub_category", "i", F.concat(filled(F.col("_t.title"), "title"), F.lit("\n"), filled(F.col("_t.body"), "body")).alias("text"))
