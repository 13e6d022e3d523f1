"""Conversations rebuilt from messages that quote each other, in DataFrame functions only.

A line that starts with '>' marks is a quotation; the number of marks is its level. Consecutive quoted lines of one level
form a passage. Passages are normalised (marks stripped, blanks collapsed, lower case) and hashed, and so are the messages' own
texts: whole, by paragraph and by line. Within a conversation each hash is reduced to the first message
that wrote it, so the join is many-to-one. A passage belongs to that message if it came earlier; if the whole passage
is not found its lines are looked up, and the latest author among them counts. A message answers the author of its shallowest linked
passage, the latest one on ties; without a link it begins a thread. Threads come in the order of their first message, inside them
messages by turn: every answer follows what it answers, and quotes are gone from the body.

Defined cases: a null conv_id is a conversation of its own; a null turn comes first and is never an author; a null
text is empty; a passage without letters or digits links to nothing; messages that share conv_id and turn are ordered by role and
body, and the author of a hash is the turn, not the row; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.rank import prefix_sums
from .common import stored, text_of

MARKS = r"^((?:[ \t]*>)+)[ \t]?"


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """conv, conv_id, turn, role, lines (level and body of each) and own, the text without quotes."""
    lines = F.transform(F.split(text_of("text"), r"\r\n|\n|\r"), lambda line: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", "")).alias("level"),
        F.regexp_replace(line, MARKS, "").alias("body")))
    rows = messages.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")).alias("conv"), "conv_id", "turn", "role", lines.alias("lines"))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return rows.withColumn("own", F.trim(own))


def _first_authors(rows: DataFrame) -> DataFrame:
    """(conv, hash) -> the first turn that wrote the text itself: whole, one paragraph or one line."""
    own = F.col("own")
    units = F.concat(F.array(own), F.split(own, r"\n[ \t]*\n"), F.split(own, "\n"))
    texts = rows.where(F.col("turn").isNotNull()).select("conv", "turn", F.explode(F.array_distinct(F.transform(units, _normal))).alias("t"))
    return (texts.where(F.col("t").rlike(r"[\p{L}\p{N}]")).groupBy("conv", F.md5("t").alias("hash"))
            .agg(F.min("turn").alias("author")))


def _passages(rows: DataFrame) -> DataFrame:
    """One row per quoted passage: its level and lines."""
    lines = rows.where(F.exists("lines", lambda x: x["level"] > 0)).select("conv", "turn", "uid", F.posexplode("lines").alias("pos", "line"))
    inside = Window.partitionBy("uid").orderBy("pos")  # one message, so bounded by its text
    level = F.col("line.level")
    runs = lines.withColumn("new", (level != F.coalesce(F.lag("line.level").over(inside), F.lit(-1))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(inside)).where(level > 0)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line.body"))), lambda x: x["body"]), "\n")
    return runs.groupBy("conv", "turn", "uid", "run").agg(F.first(level).alias("level"), body.alias("body"))


def quote_links(rows: DataFrame) -> DataFrame:
    """One row per linked passage: conv, turn, uid, run, level, author (an earlier turn)."""
    authors = _first_authors(rows)
    passages = _passages(rows).where(F.col("body").rlike(r"[\p{L}\p{N}]"))
    units = F.concat(F.array(F.struct(F.lit(0).alias("kind"), F.col("body").alias("t"))),
                     F.transform(F.split("body", "\n"), lambda x: F.struct(F.lit(1).alias("kind"), x.alias("t"))))
    asked = passages.select("conv", "turn", "uid", "run", "level", F.explode(units).alias("unit"))
    asked = asked.withColumn("t", _normal(F.col("unit.t"))).where(F.col("t").rlike(r"[\p{L}\p{N}]"))
    asked = asked.select("conv", "turn", "uid", "run", "level", F.col("unit.kind").alias("kind"), F.md5("t").alias("hash"))
    found = asked.join(authors, ["conv", "hash"]).where(F.col("author") < F.col("turn"))
    whole, line = F.max(F.when(F.col("kind") == 0, F.col("author"))), F.max(F.when(F.col("kind") == 1, F.col("author")))
    return (found.groupBy("conv", "turn", "uid", "run", "level").agg(F.coalesce(whole, line).alias("author")))


def _thread_roots(parents: DataFrame) -> DataFrame:
    """(conv, turn, up, depth): parents point to earlier turns; pointers double until all reach a root."""
    at = parents.select("conv", "turn", F.coalesce("reply_to", "turn").alias("up"),
                        F.when(F.col("reply_to").isNull(), 0).otherwise(1).alias("depth"))
    at = stored(at, "chat-roots")
    moved = at.where("depth > 0").limit(1).count()
    while moved:
        above = at.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        step = at.join(above, (F.col("conv") == F.col("c")) & F.col("up").eqNullSafe(F.col("t")))
        at = stored(step.select("conv", "turn", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"),
                                (F.col("d2") > 0).alias("moved")), "chat-roots")
        moved, at = at.where("moved").limit(1).count(), at.drop("moved")
    return at


def reply_ordered(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, position (from 0 in its conversation), thread, depth, reply_to, n_quotes, n_linked, body."""
    rows = stored(parsed(messages), "chat-rows").withColumn("uid", F.monotonically_increasing_id())
    links = stored(quote_links(rows), "chat-links")
    # the shallowest linked passage decides; min of (level, -author) takes the latest author on ties
    best = links.groupBy("uid").agg(F.min(F.struct("level", (-F.col("author")).alias("back"))).alias("best"),
                                    F.count(F.lit(1)).alias("n_linked"))
    best = best.select("uid", (-F.col("best.back")).alias("reply_to"), "n_linked")
    runs = F.aggregate("lines", F.struct(F.lit(0).alias("n"), F.lit(0).alias("at")), lambda acc, x: F.struct(
        (acc["n"] + F.when((x["level"] > 0) & (x["level"] != acc["at"]), 1).otherwise(0)).alias("n"), x["level"].alias("at")))
    rows = rows.withColumn("n_quotes", runs["n"]).drop("lines").join(best, "uid", "left")
    turns = rows.groupBy("conv", "turn").agg(F.max("reply_to").alias("reply_to"))
    roots = _thread_roots(turns).withColumnsRenamed({"up": "thread"})
    # the key of the order, one long per turn: threads by first turn, then turns
    ordered = rows.join(roots.withColumnsRenamed({"conv": "c", "turn": "t"}),
                        (F.col("conv") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))).drop("c", "t")
    return _positions(ordered)


def _positions(rows: DataFrame) -> DataFrame:
    """Positions from turn counts: a prefix sum over threads, one over turns; a hot conversation is spread over buckets of turns."""
    null_first = F.lit(-(2**53))
    rows = rows.withColumns({"__thread": F.coalesce("thread", null_first), "__turn": F.coalesce("turn", null_first)})
    per_turn = stored(rows.groupBy("conv", "__thread", "__turn").agg(F.count(F.lit(1)).alias("n")), "chat-turns")
    threads = prefix_sums(per_turn.groupBy("conv", "__thread").agg(F.sum("n").alias("n")), "__thread", ["n"], ["conv"])
    inside = prefix_sums(per_turn, "__turn", ["n"], ["conv", "__thread"])
    base = inside.select("conv", "__thread", "__turn", F.col("n_before").alias("in_thread")).join(
        threads.select("conv", "__thread", F.col("n_before").alias("of_thread")), ["conv", "__thread"])
    same = Window.partitionBy("conv", "__thread", "__turn").orderBy(F.col("role").asc_nulls_first(), "own", "uid")
    out = rows.join(base, ["conv", "__thread", "__turn"]).withColumn(
        "position", F.col("of_thread") + F.col("in_thread") + F.row_number().over(same) - 1)
    return out.select("conv_id", "turn", "role", F.col("position").cast("long").alias("position"), "thread",
                      F.col("depth").cast("long").alias("depth"), "reply_to", F.col("n_quotes").cast("long").alias("n_quotes"),
                      F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("own").alias("body"))
