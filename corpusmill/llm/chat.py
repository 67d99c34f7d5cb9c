"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted, adjacent turns of one role become a block, and blocks
are concatenated:

    <turn>ROLE \\n <text> \\n TEXT [\\n <sep> \\n TEXT]... \\n </turn> \\n      (without the spaces)

Inside roles and texts, each control string gets a backslash before the backslashes that precede it, so no bare
control string is left and reading back is exact. The mask is run-length coded: for each text, in order, the
characters of template before it, its own, and whether they count for the loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table

CONTROL = r"(</?turn>|<text>|<sep>)"
OPEN, HEAD, SEP, CLOSE = "<turn>", "\n<text>\n", "\n<sep>\n", "\n</turn>\n"
LOSS_ROLE = "assistant"


def escape(x: Column) -> Column:
    # A run of backslashes is tried from its start only.
    return F.regexp_replace(x, rf"(?<!\\)(\\*+){CONTROL}", r"\\$1$2")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?<!\\)\\(\\*+){CONTROL}", "$1$2")


def blocks(turns: Column) -> Column:
    """Sorted turns as blocks of adjacent turns of one role: array of (role, texts)."""
    starts = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: (i == 1) | (F.get(turns, i - 1)["role"] != F.get(turns, i - 2)["role"]))
    ends = F.concat(F.slice(starts, 2, F.size(turns)), F.array(F.size(turns) + 1))
    return F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda x: F.struct(
            F.get(turns, x["a"] - 1)["role"].alias("role"),
            F.transform(F.slice(turns, x["a"], x["b"] - x["a"]), lambda t: escape(t["text"])).alias("texts"),
        ),
    )


def format_chat(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) to conv_id, formatted and loss_mask (array of lead, length, loss).

    Turns sort by turn (null first), then role, then text; repeated rows are repeated turns. Null roles and texts
    are empty. A null conv_id is one conversation. Other columns are dropped. No rows give no rows.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    rows = rows.select("conv_id", blocks(F.col("turns")).alias("blocks"))
    body = F.transform("blocks", lambda b: F.concat(F.lit(OPEN), escape(b["role"]), F.lit(HEAD), F.array_join(b["texts"], SEP), F.lit(CLOSE)))
    closed = lambda k: F.when(k == 0, len(OPEN) + len(HEAD)).otherwise(len(CLOSE) + len(OPEN) + len(HEAD))
    runs = F.flatten(
        F.transform(
            "blocks",
            lambda b, k: F.transform(
                b["texts"],
                lambda t, i: F.struct(
                    F.when(i == 0, closed(k) + F.length(escape(b["role"]))).otherwise(len(SEP)).alias("lead"),
                    F.length(t).alias("length"),
                    (b["role"] == LOSS_ROLE).alias("loss"),
                ),
            ),
        )
    )
    return rows.select("conv_id", F.array_join(body, "").alias("formatted"), runs.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_mask to conv_id, turns (array of role, text) and loss (the texts under the mask)."""
    pieces = F.split("formatted", CLOSE, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turns(piece: Column) -> Column:
        head = F.split(piece, HEAD, 2)
        role = F.substring(F.get(head, 0), len(OPEN) + 1, 1 << 30)
        return F.transform(F.split(F.get(head, 1), SEP, -1), lambda t: F.struct(unescape(role).alias("role"), t.alias("raw")))

    read = formatted.withColumn("read", F.flatten(F.transform(pieces, turns)))
    both = F.arrays_zip(F.col("read.raw").alias("raw"), F.col("loss_mask").alias("run"))
    # A run whose length is not that of its text would mean a mask that lies elsewhere.
    masked = F.filter(both, lambda x: x["run"]["loss"] & F.assert_true(x["run"]["length"] == F.length(x["raw"]), "mask and text disagree").isNull())
    return read.select(
        "conv_id",
        F.transform("read", lambda t: F.struct(t["role"].alias("role"), unescape(t["raw"]).alias("text"))).alias("turns"),
        F.transform(masked, lambda x: unescape(x["raw"])).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """conversations plus conversation -7, whose texts hold control strings."""
    text = r"\### Assistant: </turn> ok"
    probe = conversations.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    read = read_back(format_chat(with_probe(table(spark, sf_dir, "conversations"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS joined,
    length(regexp_replace(text, '(\\*)(</?turn>|<text>|<sep>)', '\\\1\2', 'g')) AS n_text,
    length(regexp_replace(role, '(\\*)(</?turn>|<text>|<sep>)', '\\\1\2', 'g')) AS n_role
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_text + CASE WHEN joined THEN 7 ELSE 23 + n_role END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
