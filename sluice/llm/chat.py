"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation (each speaker but ``system``) the dialogue is rendered once: that speaker is the
assistant, the others are users with their names, system messages stay what they are. ``masks`` are the spans of the
assistant's own words, in code points of the rendered text, end exclusive; only these are to be learnt from.

A conversation is rendered in parts of ``part_turns`` turn numbers, which follow each other: the parts' texts in order of
``part`` are the dialogue, and ``masks`` count from the part's beginning. So a conversation that has a third of all
rows is dealt out to many tasks, of which none gathers more than a part. Only DataFrame functions are used.

Turns are in order of turn, then speaker, then text; repeated rows are turns of their own. A null turn comes first, in a
part of its own; a null speaker is called ``unknown``, a null text is empty; null conversations are one conversation.
Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_TURNS = 64


def rotate(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """``conversation``, participant, part, n_turns, rendered, masks (``start-end``, comma-joined), n_masked."""
    turns = df.select(
        F.col(conversation).alias("conversation"),
        F.floor(F.col(turn) / part_turns).cast("long").alias("part"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(speaker, F.lit("unknown")).alias("speaker"), F.coalesce(text, F.lit("")).alias("text")).alias("said"),
    )
    parts = turns.groupBy("conversation", "part").agg(F.array_sort(F.collect_list("said")).alias("said"))
    speakers = turns.filter("said.speaker != 'system'").select(F.col("conversation").alias("c"), F.col("said.speaker").alias("participant")).distinct()
    views = parts.join(speakers, F.col("conversation").eqNullSafe(F.col("c")))
    head = lambda m: (
        F.when(m["speaker"] == F.col("participant"), F.lit("<|assistant|>\n"))
        .when(m["speaker"] == "system", F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), m["speaker"], F.lit("|>\n")))
    )
    tail = "\n<|end|>\n"
    pieces = F.transform("said", lambda m: F.struct(head(m).alias("head"), m["text"].alias("text"), (m["speaker"] == F.col("participant")).alias("own")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans"), F.lit(0).cast("long").alias("n"))

    def step(state, p):
        begin = state["at"] + F.length(p["head"])
        end = begin + F.length(p["text"])
        span = F.concat(F.when(state["spans"] == "", F.lit("")).otherwise(F.lit(",")), begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(
            (end + len(tail)).cast("long").alias("at"),
            F.when(p["own"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
            (state["n"] + F.when(p["own"], end - begin).otherwise(F.lit(0))).cast("long").alias("n"),
        )

    shown = views.withColumn("pieces", pieces).withColumn("masked", F.aggregate("pieces", start, step))
    return shown.select(
        F.col("conversation").alias(conversation),
        "participant",
        "part",
        F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], F.lit(tail))), "").alias("rendered"),
        F.col("masked.spans").alias("masks"),
        F.col("masked.n").alias("n_masked"),
    )


#: The same for DuckDB, over ``conversations``.
ORACLE = """
    WITH t AS (SELECT conv_id, turn, CAST(floor(turn / 64) AS BIGINT) AS part, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations),
    s AS (SELECT DISTINCT conv_id AS c, speaker AS participant FROM t WHERE speaker <> 'system'),
    v AS (SELECT t.*, participant,
                 CASE WHEN speaker = participant THEN '<|assistant|>' || chr(10) WHEN speaker = 'system' THEN '<|system|>' || chr(10) ELSE '<|user name=' || speaker || '|>' || chr(10) END AS head
          FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.c),
    p AS (SELECT *, sum(length(head) + length(body) + 9) OVER w - length(body) - 9 AS pos, row_number() OVER w AS n
          FROM v WINDOW w AS (PARTITION BY conv_id, participant, part ORDER BY turn NULLS FIRST, speaker, body ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, participant, part, count(*) AS n_turns,
           string_agg(head || body || chr(10) || '<|end|>' || chr(10), '' ORDER BY n) AS rendered,
           coalesce(string_agg(CAST(CAST(pos AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY n) FILTER (WHERE speaker = participant), '') AS masks,
           CAST(coalesce(sum(length(body)) FILTER (WHERE speaker = participant), 0) AS BIGINT) AS n_masked
    FROM p GROUP BY conv_id, participant, part"""
