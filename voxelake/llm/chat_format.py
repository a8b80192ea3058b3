"""Chat formatting with Spark expressions only.

A conversation's turns are sorted, adjacent turns of one role are merged into a block by array
aggregation, and the blocks are concatenated:

    <|role:user|>text<|turn|>text<|end|><|role:assistant|><|loss|>text<|end|>

``<|turn|>`` keeps merged turns apart and ``<|loss|>`` opens what a model is trained on.  In texts and
roles ``~ < [ |`` become ``~0 ~1 ~2 ~3``, so no control string of this or of a bracketed template
(``</s>``, ``[INST]``) can occur in them, and `read_back` undoes it.

A long conversation is first folded in ranges of CHUNK_TURNS turn numbers, which are spread over tasks;
only the folded pieces of a conversation meet in one row, the formatted string itself.

Edge cases: null text or role is empty; null turns come first; rows equal in (conv_id, turn) are ordered
by role, then text, and repeated rows are all kept; a null conv_id is a conversation of its own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_TURNS = 64
LOSS_ROLE = "assistant"
TURN, END, LOSS = "<|turn|>", "<|end|>", "<|loss|>"
_ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("|", "~3"))


def escape(c: Column) -> Column:
    for raw, safe in _ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in reversed(_ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def _open(role: Column) -> Column:
    return F.concat(F.lit("<|role:"), escape(role), F.lit("|>"), F.when(role == LOSS_ROLE, F.lit(LOSS)).otherwise(F.lit("")))


def _joint(last: Column, role: Column) -> Column:
    """What stands between two turns."""
    return F.when(last == role, F.lit(TURN)).otherwise(F.concat(F.lit(END), _open(role)))


def format_conversations(conv: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """conv_id and `formatted`, one row per conversation."""
    turns = conv.select(
        "conv_id",
        F.floor(F.col("turn") / chunk_turns).alias("chunk"),
        F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    folded = turns.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("t")).alias("ts")).select(
        "conv_id",
        F.struct(
            "chunk",
            F.element_at("ts", 1)["role"].alias("first"),
            F.element_at("ts", -1)["role"].alias("last"),
            F.aggregate(
                F.slice("ts", F.lit(2), F.size("ts")),
                F.struct(F.element_at("ts", 1)["role"].alias("role"), escape(F.element_at("ts", 1)["text"]).alias("body")),
                lambda a, t: F.struct(t["role"].alias("role"), F.concat(a["body"], _joint(a["role"], t["role"]), escape(t["text"])).alias("body")),
                lambda a: a["body"],
            ).alias("body"),
        ).alias("piece"),
    )
    whole = folded.groupBy("conv_id").agg(F.sort_array(F.collect_list("piece")).alias("ps"))
    pieces = F.transform(
        "ps",
        lambda p, i: F.concat(F.when(i == 0, _open(p["first"])).otherwise(_joint(F.get(F.col("ps"), i - 1)["last"], p["first"])), p["body"]),
    )
    return whole.select("conv_id", F.concat(F.array_join(pieces, ""), F.lit(END)).alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted and `turns`: array of (role, text, loss) parsed from the formatted string."""
    blocks = F.slice(F.split("formatted", r"<\|end\|>", -1), F.lit(1), F.size(F.split("formatted", r"<\|end\|>", -1)) - 1)

    def parse(block: Column) -> Column:
        head = F.substring_index(block, "|>", 1)
        rest = F.substr(block, F.length(head) + 3)
        loss = F.startswith(rest, F.lit(LOSS))
        body = F.when(loss, F.substr(rest, F.lit(len(LOSS) + 1))).otherwise(rest)
        role = unescape(F.substr(head, F.lit(len("<|role:") + 1)))
        return F.transform(F.split(body, r"<\|turn\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"), loss.alias("loss")))

    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, parse)).alias("turns"))


def digest(parsed: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return parsed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


ORACLE_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(replace(replace(replace(replace(text, '~', '~0'), '<', '~1'), '[', '~2'), '|', '~3')) AS n,
         length(replace(replace(replace(replace(role, '~', '~0'), '<', '~1'), '[', '~2'), '|', '~3')) AS rn,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE WHEN before = role THEN 8 ELSE 7 + 9 + rn + CASE WHEN role = 'assistant' THEN 8 ELSE 0 END END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
