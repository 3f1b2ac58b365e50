"""Quotation linking: replies, their originals, and conversations without quotes.

Only DataFrame functions. Quoted lines start with one or more ">"; their number is the
level. Neighbouring lines of one level form a passage, ended by a blank line or another level;
a passage, and each line of a longer one, is normalised (case, white space) and joined by
hash to the first message of the conversation that wrote the same words itself. A
message replies to the latest original among its least nested linked passages. Threads
come from doubling the known stretch of each chain of replies, and a conversation is
ordered by thread, depth and turn, so every reply follows what it answers.

Only conversations with a quote are taken apart. Originals are reduced to the first turn
for each hash before the join, so words that many messages share cost one row.

Defined cases: a null text counts as empty; messages without a conversation or turn take
no part in linking and start a thread of their own; rows that share conversation and turn
are one message for linking, each row stays; a quote that nobody wrote earlier links to
nothing; a message never links to itself or to a later one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.sources.shared import staged

# White space inside a line, the quote prefix, and lines that announce a quote.
BLANK = r"[ \t\r\f\x0B]+"
QUOTED = r"^[ \t]*>[ \t>]*"
ANNOUNCES = r"^(On|Am|Le|El) .*(wrote|schrieb|écrit|escribió) ?:[ \t\r]*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), BLANK, " "))


def parsed_lines(text: Column) -> Column:
    """The lines of a text: (level, line, content, announces)."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda x: F.struct(
            F.regexp_count(F.regexp_extract(x, QUOTED, 0), F.lit(">")).alias("level"),
            x.alias("line"),
            normalised(F.regexp_replace(x, QUOTED, "")).alias("content"),
            x.rlike(ANNOUNCES).alias("announces"),
        ),
    )


def own_lines(lines: Column) -> Column:
    """Lines that the message wrote itself: not quoted, and not announcing a quote that follows."""
    def own(x: Column, k: Column) -> Column:
        following = F.coalesce(F.try_element_at(lines, k + 2)["level"], F.lit(0))
        return (x["level"] == 0) & ~(x["announces"] & (following > 0))

    return F.filter(lines, own)


def has_quote(text: Column) -> Column:
    return F.coalesce(text.rlike(f"(?m){QUOTED}"), F.lit(False))


def units(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, passage, hash): passages and lines of every level, own ones at level 0."""
    lines = messages.select("conv_id", "turn", parsed_lines(F.col("text")).alias("lines"))
    leveled = lines.select(
        "conv_id", "turn", "lines", F.explode(F.array_distinct(F.col("lines.level"))).alias("level")
    )
    # Lines of other levels become blank, so that a passage is what stands between blank lines.
    only = F.array_join(
        F.transform("lines", lambda x: F.when(
            (x["level"] == F.col("level")) & ~((x["level"] == 0) & x["announces"]), x["content"]
        ).otherwise("")), "\n",
    )
    found = leveled.select(
        "conv_id", "turn", "level", F.posexplode(F.split(only, "\n\n+")).alias("passage", "words")
    ).withColumn("words", F.trim(F.translate("words", "\n", "\r"))).withColumn(
        "parts", F.filter(F.split("words", "\r"), lambda x: x != "")
    ).where(F.size("parts") > 0)
    whole = F.array(F.array_join("parts", " "))
    return found.select(
        "conv_id", "turn", "level", "passage",
        F.explode(F.array_distinct(F.concat(whole, "parts"))).alias("unit"),
    ).select("conv_id", "turn", "level", "passage", F.xxhash64("unit").alias("hash"))


def linked_passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, passage, origin): quoted passages; ``origin`` is null where unlinked."""
    known = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quoting = known.where(has_quote(F.col("text"))).select("conv_id").distinct()
    parts = staged(
        units(known.select("conv_id", "turn", "text").join(quoting, "conv_id", "left_semi")).distinct(),
        "chat-units",
    )
    originals = parts.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    quoted = parts.where("level > 0")
    return (
        quoted.join(originals, ["conv_id", "hash"], "left")
        .withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
        .groupBy("conv_id", "turn", "level", "passage").agg(F.max("origin").alias("origin"))
    )


def replies(linked: DataFrame) -> DataFrame:
    """(conv_id, turn, n_quotes, n_linked, parent_turn): one row a message that quotes."""
    nearest = F.min(F.when(F.col("origin").isNotNull(), F.struct("level", (-F.col("origin")).alias("back"))))
    return linked.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quotes"), F.count("origin").alias("n_linked"),
        (-nearest["back"]).alias("parent_turn"),
    )


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) of replies, in as many rounds as the logarithm of the depth."""
    known = staged(
        parents.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")),
        "chat-threads",
    )
    while True:
        above = known.select(
            "conv_id", F.col("turn").alias("root_turn"),
            F.col("root_turn").alias("higher"), F.col("depth").alias("further"),
        )
        met = known.join(above, ["conv_id", "root_turn"], "left")
        # A root quotes nobody: chains are done when no known end has a parent itself.
        if met.where(F.col("higher").isNotNull()).isEmpty():
            return known
        known = staged(
            met.select(
                "conv_id", "turn", F.coalesce("higher", "root_turn").alias("root_turn"),
                (F.col("depth") + F.coalesce("further", F.lit(0).cast("long"))).alias("depth"),
            ),
            "chat-threads",
        )


def conversations(messages: DataFrame) -> DataFrame:
    """Messages without their quotes, with what they reply to, in the order of replies.

    Columns: those of ``messages`` (``text`` without quotes), ``n_quotes``, ``n_linked``,
    ``parent_turn``, ``root_turn``, ``depth``; columns of these names are replaced.
    """
    added = ["n_quotes", "n_linked", "parent_turn", "root_turn", "depth"]
    messages = messages.drop(*added)
    replying = staged(replies(linked_passages(messages)), "chat-replies")
    chains = threads(replying.where(F.col("parent_turn").isNotNull()))
    facts = replying.join(chains, ["conv_id", "turn"], "left")
    lines = parsed_lines(F.col("text"))
    own = F.regexp_replace(
        F.array_join(F.transform(own_lines(lines), lambda x: x["line"]), "\n"), r"^\n+|\n+$", ""
    )
    zero = F.lit(0).cast("long")
    shown = [c for c in messages.columns]
    return (
        messages.withColumn("text", F.when(has_quote(F.col("text")), own).otherwise(F.col("text")))
        .join(facts, ["conv_id", "turn"], "left")
        .withColumns({
            "n_quotes": F.coalesce("n_quotes", zero), "n_linked": F.coalesce("n_linked", zero),
            "root_turn": F.coalesce("root_turn", F.col("turn").cast("long")), "depth": F.coalesce("depth", zero),
        })
        .select(*shown, *added)
        .orderBy("conv_id", "root_turn", "depth", "turn")
    )


ORACLE = r"""
WITH RECURSIVE messages AS (SELECT conv_id, turn, role, text FROM conversations),
known AS (
  SELECT DISTINCT conv_id, turn, text FROM messages WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), cut AS (
  SELECT conv_id, turn, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM known
), lines AS (
  SELECT conv_id, turn, text, pos,
         length(regexp_replace(regexp_extract(line, '^[ \t]*>[ \t>]*'), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*>[ \t>]*', '')), '[ \t\r\f\x0B]+', ' ', 'g')) AS content,
         regexp_matches(line, '^(On|Am|Le|El) .*(wrote|schrieb|écrit|escribió) ?:[ \t\r]*$') AS announces
  FROM cut
), runs AS (
  SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn, text, level ORDER BY pos) AS run
  FROM lines WHERE content <> '' AND NOT (level = 0 AND announces)
), passages AS (
  SELECT conv_id, turn, level, text, run, string_agg(content, ' ' ORDER BY pos) AS whole, list(content) AS parts
  FROM runs GROUP BY ALL
), units AS (
  SELECT conv_id, turn, level, text, run, unnest(list_distinct(list_append(parts, whole))) AS unit FROM passages
), originals AS (
  SELECT conv_id, unit, min(turn) AS origin FROM units WHERE level = 0 GROUP BY ALL
), linked AS (
  SELECT u.conv_id, u.turn, u.level, u.text, u.run, max(o.origin) FILTER (o.origin < u.turn) AS origin
  FROM units u LEFT JOIN originals o ON u.conv_id = o.conv_id AND u.unit = o.unit
  WHERE u.level > 0 GROUP BY ALL
), replies AS (
  SELECT conv_id, turn, count(*) AS n_quotes, count(origin) AS n_linked,
         -min({'level': level, 'back': -origin}) FILTER (origin IS NOT NULL)['back'] AS parent_turn
  FROM linked GROUP BY ALL
), chains AS (
  SELECT conv_id, turn, parent_turn AS root_turn, 1 AS depth FROM replies WHERE parent_turn IS NOT NULL
  UNION ALL
  SELECT c.conv_id, c.turn, r.parent_turn, c.depth + 1
  FROM chains c JOIN replies r ON c.conv_id = r.conv_id AND c.root_turn = r.turn WHERE r.parent_turn IS NOT NULL
), ends AS (
  SELECT conv_id, turn, arg_max(root_turn, depth) AS root_turn, max(depth) AS depth FROM chains GROUP BY ALL
), marked AS (
  SELECT *, regexp_matches(coalesce(text, ''), '(^|\n)[ \t]*>') AS quoting,
         list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '^[ \t]*>')) AS q,
         string_split(coalesce(text, ''), chr(10)) AS l
  FROM messages
)
SELECT m.conv_id, m.turn, m.role,
  CASE WHEN quoting THEN regexp_replace(array_to_string(
    [l[i] FOR i IN range(1, len(l) + 1) IF NOT q[i]
      AND NOT (regexp_matches(l[i], '^(On|Am|Le|El) .*(wrote|schrieb|écrit|escribió) ?:[ \t\r]*$') AND coalesce(q[i + 1], false))],
    chr(10)), '^\n+|\n+$', '', 'g') ELSE m.text END AS text,
  coalesce(r.n_quotes, 0) AS n_quotes, coalesce(r.n_linked, 0) AS n_linked,
  r.parent_turn, coalesce(e.root_turn, m.turn) AS root_turn, cast(coalesce(e.depth, 0) AS BIGINT) AS depth
FROM marked m LEFT JOIN replies r ON m.conv_id = r.conv_id AND m.turn = r.turn
LEFT JOIN ends e ON m.conv_id = e.conv_id AND m.turn = e.turn
"""
