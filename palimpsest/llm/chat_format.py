"""Chat formatting in Spark expressions alone: sort the turns of a conversation, merge neighbours of one role, concatenate.

Layout of a formatted conversation, for every run of turns of one role:

    <s>ROLE[INST]TEXT[INST]TEXT ... [/INST]</s>

Roles and texts are escaped (& < [ become &amp; &lt; &lsqb;), so that none of the four control strings can come from a
text, and the layout can be read back into the turns it was made from.

Defined results: a null role or text counts as empty; turns are ordered by (turn, role, text), a null turn first, so
ties and repeated rows come out alike on every run; rows of a null conv_id form one conversation; a
conversation is one row, however long (as the result asks); an empty table gives
no rows; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import table

OPEN, PART, END, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))  # & first, and last on the way back


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, segments, formatted): segments array<struct<text, loss>> join to formatted; loss marks the escaped texts of loss_role."""
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    sorted_turns = (
        turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("t")).alias("turns"))
    )

    def pieces(t: Column, i: Column) -> Column:
        here = t["role"]
        starts = ~here.eqNullSafe(F.get("turns", i - 1)["role"])
        ends = ~here.eqNullSafe(F.get("turns", i + 1)["role"])
        head = F.concat(F.when(starts, F.concat(F.lit(OPEN), escape(here))).otherwise(""), F.lit(PART))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (here == loss_role).alias("loss")),
            F.struct(F.when(ends, END + CLOSE).otherwise("").alias("text"), F.lit(False).alias("loss")),
        )

    segments = sorted_turns.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"))
    return segments.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text, formatted) out of what format_chats gives."""
    blocks = F.filter(F.split("formatted", CLOSE), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        parts = F.split(F.replace(block, F.lit(END), F.lit("")), r"\[INST\]")
        role = unescape(F.substring(parts[0], len(OPEN) + 1, 1 << 30))
        return F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return chats.select("conv_id", F.flatten(F.transform(blocks, turns_of)).alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -7, formatted, with digests of what is read back from the output."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    back = read_chats(format_chats(told.unionByName(odd)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS etext,
    replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS erole,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(6 + length(etext) + CASE WHEN before IS DISTINCT FROM role THEN 14 + length(erole) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
