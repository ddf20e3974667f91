"""Chat formatting with Column expressions only.

The turns of a conversation are collected as structs and sorted. Adjacent turns of one role share a
block, each text a part of it:

    <turn>role<text>first text<next>second text</turn>\\n

`&` and `<` of roles and texts become `&amp;` and `&lt;`, so markers, which all start with `<`, never
occur inside a text and the turns can be read back exactly. The loss mask is a list of code point spans
of the formatted string, one for each assistant text.

Defined cases: a null text or role is empty; a null turn sorts first; turns with equal numbers are
ordered by role, then text, and repeated rows stay. A null conv_id is a conversation of its own. A
conversation is one string, so all its turns meet in one row; the work on it grows as its length. Only
conv_id, turn, role and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weekwatch.llm.registry import query, table

OPEN, TEXT, NEXT, CLOSE = "<turn>", "<text>", "<next>", "</turn>\n"
LOSS_ROLE = "assistant"
CHUNK = 128


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def earlier_sums(numbers: Column) -> Column:
    """For each number the sum of those before it, by sums of chunks, so long arrays stay cheap."""

    def chunked(v: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int"))
        return let(
            F.transform(chunks, lambda c: _sum(F.slice(v, c * CHUNK + 1, CHUNK))),
            lambda sums: F.flatten(
                F.transform(
                    chunks,
                    lambda c: let(
                        F.struct(_sum(F.slice(sums, F.lit(1), c)).alias("before"), F.slice(v, c * CHUNK + 1, CHUNK).alias("part")),
                        lambda s: F.transform(s["part"], lambda _, i: s["before"] + _sum(F.slice(s["part"], F.lit(1), i))),
                    ),
                )
            ),
        )

    return let(numbers, chunked)


def format_chats(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_spans): spans are structs of start (from 0) and length in code points."""
    empty = F.lit("")
    turn = F.struct(
        F.col("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text")
    )
    sorted_turns = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def parts(ts: Column) -> Column:
        """What stands before each text, and the text itself escaped."""

        def part(t: Column, i: Column) -> Column:
            merged = (i > 0) & (F.get(ts, i - 1)["role"] == t["role"])
            opening = F.concat(F.lit(OPEN), escape(t["role"]), F.lit(TEXT))
            lead = F.when(merged, F.lit(NEXT)).when(i > 0, F.concat(F.lit(CLOSE), opening)).otherwise(opening)
            return F.struct(lead.alias("lead"), escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss"))

        return F.transform(ts, part)

    def spans(ps: Column) -> Column:
        ends = earlier_sums(F.transform(ps, lambda p: (F.length(p["lead"]) + F.length(p["body"])).cast("long")))
        placed = F.transform(
            F.arrays_zip(ps.alias("p"), ends.alias("before")),
            lambda z: F.struct(
                (z["p"]["loss"]).alias("loss"),
                (z["before"] + F.length(z["p"]["lead"])).alias("start"),
                F.length(z["p"]["body"]).cast("long").alias("length"),
            ),
        )
        return F.transform(F.filter(placed, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))

    out = let(
        F.col("turns"),
        lambda ts: let(
            parts(ts),
            lambda ps: F.struct(
                F.concat(F.array_join(F.transform(ps, lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(CLOSE)).alias("formatted"),
                spans(ps).alias("loss_spans"),
            ),
        ),
    )
    return sorted_turns.select("conv_id", out.alias("o")).select("conv_id", "o.formatted", "o.loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as structs of role and text."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        head = F.split(F.substring(block, len(OPEN) + 1, 2147483647), TEXT, 2)
        return let(
            head,
            lambda h: F.transform(
                F.split(F.get(h, F.lit(1)), NEXT), lambda t: F.struct(unescape(F.get(h, F.lit(0))).alias("role"), unescape(t).alias("text"))
            ),
        )

    return F.flatten(F.transform(blocks, turns_of))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, with nothing between."""
    cut = F.transform(spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(cut, unescape), "")


def digests(chats: DataFrame) -> DataFrame:
    turns = let(
        read_turns(F.col("formatted")),
        lambda ts: F.struct(
            F.size(ts).cast("long").alias("n"),
            F.sha2(F.array_join(F.transform(ts, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("sha"),
        ),
    )
    loss = let(
        loss_text(F.col("formatted"), F.col("loss_spans")), lambda t: F.struct(F.length(t).cast("long").alias("n"), F.sha2(t, 256).alias("sha"))
    )
    return chats.select("conv_id", turns.alias("t"), loss.alias("l"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", F.col("t.n").alias("n_turns"), F.col("t.sha").alias("turns_sha256"),
        F.col("l.n").alias("loss_chars"), F.col("l.sha").alias("loss_sha256"), "formatted_chars",
    )


PLANTED_TEXT = r"\### Assistant: </turn> ok"

_ESC = "replace(replace({}, '&', '&amp;'), '<', '&lt;')"
ORACLE = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED_TEXT}'
  UNION ALL SELECT -7, 1, 'assistant', '{PLANTED_TEXT}'
),
o AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev FROM t
),
w AS (
  SELECT *, CASE WHEN prev = role THEN length('{NEXT}')
                 ELSE length('{OPEN}') + length({_ESC.format('role')}) + length('{TEXT}') + length('</turn>') + 1 END
            + length({_ESC.format('text')}) AS chars
  FROM o
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""


@query("op3_format_chats", ORACLE)
def op3(spark, sf_dir):
    """All conversations and conversation -7, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED_TEXT).alias("text"),
    )
    return digests(format_chats(turns.unionByName(planted)))
