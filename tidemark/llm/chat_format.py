"""Chat formatting with Spark expressions only.

A conversation's turn structs are collected and sorted (turn, then role, then text), each run of one role is merged by
aggregating its slice of the array, and the merged turns are concatenated:

    <s>[ROLE user]text[NEXT]text[/ROLE]...</s>

Inside texts and roles the escape character and the template's bracket characters are replaced by codes,
so no control string can occur in escaped text: "\\" becomes "\\b", "[" becomes "\\o", "]" becomes "\\c", "<" becomes "\\l". [NEXT] parts the
original turns inside a merged one, so reading back gives every row again. The loss mask is the list of (start, length)
spans, in code points, of the escaped assistant texts in the formatted string.

Null roles and texts are read as empty. Repeated (conv_id, turn) rows all stay, ordered by role and text. A null conv_id is
a conversation of its own. Empty tables give no rows; extra columns are ignored. A conversation is one output row, so its
turns are gathered in one row; nothing larger than a conversation is ever gathered. The work grows in
proportion to a conversation's turns, but for sums over parts of `PART` turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PART = 128
BEGIN, END = "<s>", "</s>"
OPEN, NEXT, CLOSE = "[ROLE ", "[NEXT]", "[/ROLE]"
#: The escape character first, so that codes written later are never read as escaped ones.
CODES = (("\\", "\\b"), ("[", "\\o"), ("]", "\\c"), ("<", "\\l"))


def escape(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows to (conv_id, formatted, loss_spans)."""
    clean = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(clean)).alias("_t"))
    told = F.transform(
        "_t",
        lambda t, i: F.struct(
            escape(t["role"]).alias("role"),
            escape(t["text"]).alias("text"),
            F.coalesce(F.get("_t", i - 1)["role"] != t["role"], F.lit(True)).alias("opens"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )
    chats = chats.withColumn("_e", told)
    chats = chats.withColumn("_s", F.filter(F.sequence(F.lit(0), F.size("_e") - 1), lambda i: F.get("_e", i)["opens"]))

    def block(s: Column, k: Column) -> Column:
        """One merged turn: the texts of the run that starts at s, up to the next run's start."""
        run = F.slice(F.col("_e"), s + 1, F.coalesce(F.get("_s", k + 1), F.size("_e")) - s)
        return F.concat(F.lit(OPEN), F.get("_e", s)["role"], F.lit("]"), F.array_join(F.transform(run, lambda t: t["text"]), NEXT), F.lit(CLOSE))

    # what stands between a text and the one before it
    head = lambda t, i: F.when(t["opens"], F.when(i > 0, len(CLOSE)).otherwise(len(BEGIN)) + len(OPEN) + F.length(t["role"]) + 1).otherwise(len(NEXT)).cast("long")
    sizes = F.transform("_e", lambda t, i: F.struct(head(t, i).alias("head"), F.length(t["text"]).cast("long").alias("length"), t["loss"].alias("loss")))
    chats = chats.select("conv_id", F.concat(F.lit(BEGIN), F.array_join(F.transform("_s", block), ""), F.lit(END)).alias("formatted"), sizes.alias("_z"))
    # running sums in parts, so that no list is copied once a turn
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("_z") - 1) / PART).cast("int")), lambda k: F.slice("_z", k * PART + 1, F.lit(PART)))
    chats = chats.withColumn("_p", parts)
    chats = chats.withColumn("_w", F.transform("_p", lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda n, t: n + t["head"] + t["length"])))
    none = F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)")

    def walk(acc: Column, t: Column) -> Column:
        start = acc["at"] + t["head"]
        span = F.array(F.struct(start.alias("start"), t["length"].alias("length")))
        return F.struct((start + t["length"]).alias("at"), F.when(t["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    before = lambda k: F.aggregate(F.slice("_w", F.lit(1), k), F.lit(0).cast("long"), lambda n, w: n + w)
    spans = F.flatten(F.transform("_p", lambda p, k: F.aggregate(p, F.struct(before(k).alias("at"), none.alias("spans")), walk)["spans"]))
    return chats.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns, as structs (role, text), from the formatted string alone."""
    body = F.expr(f"substr(formatted, {len(BEGIN) + 1}, length(formatted) - {len(BEGIN) + len(END)})")
    blocks = F.filter(F.split(body, r"\[/ROLE\]"), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.regexp_replace(b, r"^\[ROLE [^\]]*\]", ""), r"\[NEXT\]", -1),
                lambda t: F.struct(unescape(F.regexp_extract(b, r"^\[ROLE ([^\]]*)\]", 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    return formatted.withColumn("turns", turns)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = read_back(format_chats(turns.unionByName(own)))
    said_under = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    back = back.withColumn("_loss", said_under)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = r"replace(replace(replace(replace({0}, '\', '\b'), '[', '\o'), ']', '\c'), '<', '\l')"
OP6_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS same FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         sum(length({_ESC.format('text')}) + CASE WHEN same THEN {len(NEXT)} ELSE {len(OPEN) + 1 + len(CLOSE)} + length({_ESC.format('role')}) END)::BIGINT AS chars
  FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars + {len(BEGIN) + len(END)} AS formatted_chars FROM g
"""
