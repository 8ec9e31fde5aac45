"""Chat formatting by quotation linking (operator 9), in DataFrame functions alone.

Lines that start with ``>`` are quoted; the number of ``>`` is the nesting
level. Runs of lines at one level are passages, runs of such lines between blank
lines are paragraphs. Lines, paragraphs and whole passages are normalised (lower
case, one space for white space) and hashed. A quoted hash is joined to the first
message of the conversation that holds the same text unquoted. The message that
the shallowest quotes point to, by most quoted characters and then the latest
turn, is the parent. Chains of parents end in a thread's root; replies follow
what they quote because originals have smaller turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import prepare, text_or_empty, written

#: Fixed value: quote marks at the start of a line.
MARKS = r"^[ \t]*>[> \t]*"
#: Turns of a stretch in which positions are counted at once.
STRETCH = 1024


def _lines(text: Column) -> Column:
    """array of (level, body) of a text's lines."""

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 0)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.when(marks == "", x).otherwise(F.substring(x, F.length(marks) + 1, F.length(x))).alias("body"))

    return F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), line)


def normalised(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")))


def _runs(lines: Column, starts: Column, count: Column) -> Column:
    """array of (level, text): the runs that begin at ``starts`` (0-based), their bodies joined by blanks."""
    return F.transform(
        starts,
        lambda s, k: F.struct(
            F.get(lines, s)["level"].alias("level"),
            F.array_join(F.transform(F.slice(lines, s + 1, F.coalesce(F.get(starts, k + 1), count) - s), lambda x: x["body"]), " ").alias("text"),
        ),
    )


def _parsed(messages: DataFrame) -> DataFrame:
    """messages plus lines, passages, paragraphs, own (the text without quotes) and row_id."""
    blank = lambda x: F.btrim(x["body"], F.lit(" \t")) == ""
    with_lines = messages.withColumn("lines", _lines(F.col("text"))).withColumn("n", F.size("lines"))
    every = F.sequence(F.lit(0), F.col("n") - 1)
    here, before = (lambda i: F.get("lines", i)), (lambda i: F.get("lines", i - 1))
    new_level = lambda i: (i == 0) | (here(i)["level"] != before(i)["level"])
    starts = with_lines.withColumns({"by_level": F.filter(every, new_level), "by_blank": F.filter(every, lambda i: new_level(i) | (blank(here(i)) != blank(before(i))))})
    runs = starts.withColumns({"passages": _runs(F.col("lines"), F.col("by_level"), F.col("n")), "paragraphs": _runs(F.col("lines"), F.col("by_blank"), F.col("n"))})
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return runs.withColumn("own", F.btrim(own, F.lit(" \t\n")))


def _units(parsed: DataFrame, quoted: bool) -> DataFrame:
    """(conv_id, turn, level, hash, weight) of the quoted or own lines, paragraphs and passages; distinct."""
    lines = F.transform("lines", lambda x: F.struct(x["level"].alias("level"), x["body"].alias("text")))
    parts = [lines, F.col("paragraphs"), F.col("passages")]
    if not quoted:
        parts.append(F.array(F.struct(F.lit(0).alias("level"), F.col("own").alias("text"))))
    wanted = F.filter(F.concat(*parts), lambda x: (x["level"] > 0) if quoted else (x["level"] == 0))
    unit = parsed.select("conv_id", "turn", F.explode(wanted).alias("u")).select("conv_id", "turn", F.col("u.level").alias("level"), normalised(F.col("u.text")).alias("t"))
    return unit.filter("t <> ''").select("conv_id", "turn", "level", F.md5("t").alias("hash"), F.length("t").cast("long").alias("weight")).distinct()


def reply_links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn): at most one row a message, the original is always earlier."""
    quotes = _units(parsed.filter(F.exists("lines", lambda x: x["level"] > 0)), True)
    asked = quotes.select("conv_id", "hash").distinct()
    originals = _units(parsed, False).join(asked, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("parent_turn"))
    votes = quotes.join(originals, ["conv_id", "hash"]).filter("parent_turn < turn").groupBy("conv_id", "turn", "parent_turn", "level").agg(F.sum("weight").alias("weight"))
    best = F.max(F.struct((-F.col("level")).alias("shallow"), "weight", "parent_turn")).alias("best")
    return votes.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", "best.parent_turn")


def _roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, root_turn, depth) by pointer doubling: as many rounds as the depth has binary digits."""
    current = written(links.withColumns({"root_turn": F.col("parent_turn"), "depth": F.lit(1).cast("long")}), "replies")
    while True:
        above = current.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("above"), F.col("depth").alias("more"))
        if current.join(above, ["conv_id", "root_turn"], "left_semi").isEmpty():
            return current
        step = current.join(above, ["conv_id", "root_turn"], "left")
        current = written(step.select("conv_id", "turn", "parent_turn", F.coalesce("above", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "replies")


def chat_threads(conversations: DataFrame) -> DataFrame:
    """Per row of ``conversations (conv_id, turn, role, text, ...)``: its place in the replies, without quotes.

    Columns: conv_id, turn, role, text (own lines, ends trimmed), quote_levels
    (deepest level), parent_turn (null if nothing is linked), thread_turn (the
    root's turn), depth (0 for a root), position (from 1, within the thread, by
    turn). Threads of a conversation follow each other by thread_turn. A null
    text counts as empty; a row whose conv_id or turn is null links to nothing
    and is a thread of its own, at position 1; repeated rows stay, at neighbouring
    positions. An empty table gives no rows. No line of a text is dropped but
    quoted ones.
    """
    prepare(conversations)
    messages = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", text_or_empty().alias("text"))
    parsed = _parsed(messages)
    replies = _roots(reply_links(parsed.filter("conv_id is not null and turn is not null")))
    shown = parsed.select("conv_id", "turn", "role", F.col("own").alias("text"), F.array_max(F.transform("lines", lambda x: x["level"])).alias("quote_levels"))
    placed = shown.join(replies, ["conv_id", "turn"], "left").withColumns({"thread_turn": F.coalesce("root_turn", "turn"), "depth": F.coalesce("depth", F.lit(0).cast("long"))})
    columns = ["conv_id", "turn", "role", "text", "quote_levels", "parent_turn", "thread_turn", "depth"]
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    alone = placed.filter(~known).select(*columns, F.lit(1).cast("long").alias("position"))
    # Positions in two steps: within a stretch of turns, and the rows of the stretches before; so no task holds a long thread.
    part = ["conv_id", "thread_turn", "stretch"]
    dealt = placed.filter(known).withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    before = Window.partitionBy("conv_id", "thread_turn").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*part).agg(F.count("*").alias("rows")).select(*part, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(*part).orderBy("turn", "role", "text"))
    ranked = dealt.withColumn("inside", inside).join(starts, part)
    return ranked.select(*columns, (F.col("start") + F.col("inside")).alias("position")).unionByName(alone)


CHAT_SQL = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS text FROM conversations),
raw AS (SELECT id, conv_id, turn, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS x FROM m),
l AS (
  SELECT id, conv_id, turn, i, length(regexp_replace(regexp_extract(x, '^[ \t]*>[> \t]*'), '[^>]', '', 'g')) AS level,
         substr(x, length(regexp_extract(x, '^[ \t]*>[> \t]*')) + 1) AS body FROM raw),
f AS (
  SELECT *, CASE WHEN i = 0 OR level <> lag(level) OVER w THEN 1 ELSE 0 END AS a,
         CASE WHEN i = 0 OR level <> lag(level) OVER w OR (trim(body, ' ' || chr(9)) = '') <> (trim(lag(body) OVER w, ' ' || chr(9)) = '') THEN 1 ELSE 0 END AS b
  FROM l WINDOW w AS (PARTITION BY id ORDER BY i)),
g AS (SELECT *, sum(a) OVER w AS run, sum(b) OVER w AS para FROM f WINDOW w AS (PARTITION BY id ORDER BY i)),
own AS (SELECT id, trim(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), ' ' || chr(9) || chr(10)) AS own, max(level) AS quote_levels FROM l GROUP BY id),
u0 AS (
  SELECT conv_id, turn, level, body AS t FROM l
  UNION ALL SELECT conv_id, turn, level, string_agg(body, ' ' ORDER BY i) FROM g GROUP BY id, conv_id, turn, level, run
  UNION ALL SELECT conv_id, turn, level, string_agg(body, ' ' ORDER BY i) FROM g GROUP BY id, conv_id, turn, level, para
  UNION ALL SELECT conv_id, turn, 0, own FROM m JOIN own USING (id)),
u AS (
  SELECT DISTINCT conv_id, turn, level, lower(trim(regexp_replace(t, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS t FROM u0 WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT conv_id, t, min(turn) AS parent_turn FROM u WHERE level = 0 AND t <> '' GROUP BY ALL),
v AS (
  SELECT q.conv_id, q.turn, o.parent_turn, q.level, sum(length(q.t)) AS weight
  FROM u q JOIN o ON q.conv_id = o.conv_id AND q.t = o.t WHERE q.level > 0 AND o.parent_turn < q.turn GROUP BY ALL),
p AS (SELECT conv_id, turn, parent_turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, weight DESC, parent_turn DESC) AS k FROM v) WHERE k = 1),
c AS (
  SELECT conv_id, turn, parent_turn AS root_turn, 1 AS depth FROM p
  UNION ALL SELECT c.conv_id, c.turn, p.parent_turn, c.depth + 1 FROM c JOIN p ON c.conv_id = p.conv_id AND c.root_turn = p.turn),
r AS (SELECT conv_id, turn, arg_max(root_turn, depth) AS root_turn, max(depth) AS depth FROM c GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, coalesce(own.own, '') AS text, own.quote_levels::INTEGER AS quote_levels, p.parent_turn, coalesce(r.root_turn, m.turn) AS thread_turn,
       coalesce(r.depth, 0)::BIGINT AS depth,
       CASE WHEN m.conv_id IS NULL OR m.turn IS NULL THEN 1
            ELSE row_number() OVER (PARTITION BY m.conv_id, coalesce(r.root_turn, m.turn) ORDER BY m.turn NULLS FIRST, m.role NULLS FIRST, coalesce(own.own, '')) END AS position
FROM m JOIN own USING (id) LEFT JOIN p ON m.conv_id = p.conv_id AND m.turn = p.turn LEFT JOIN r ON m.conv_id = r.conv_id AND m.turn = r.turn
"""
