"""Quotation linking of conversations, in DataFrame operations only.

A message's lines are parsed into runs of equal quote level (`>` marks). Each
quoted passage is normalised and hashed and joined to the message of the same
conversation that first said it: as its whole text, a paragraph or a line. The
latest message quoted at the first level is a message's parent. Messages are
returned without quotes and attribution lines, in reply order: threads by their
first turn, and turns within a thread, so that a reply comes after its original.

Defined results: a null text is empty; a null conversation is one of its own; a
null turn comes first and is never an original; repeated rows stay, each with a
place; passages without a word link nothing; an empty table gives no row; runs of
marks or of white space may be of any length and cost their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm.shared import cut
from traceloom.llm.sharding import ranked

#: The quote marks of a line.
MARKS = r"^((?:[ \t]{0,3}>)+)[ \t]?"
#: MARKS without giving back what it has taken: Java's matcher recurses for each mark that it could give back, so that a line of thousands overflows its stack.
TAKEN = MARKS.replace(">)+)", ">)++)")
#: Lines that introduce a quotation, in four languages (fixed patterns).
ATTRIBUTION = r"(?i)^\s*(?:(?:on|am|le|el)\b.{0,200}\b(?:wrote|schrieb|a écrit|escribió)|.{0,100}\b(?:wrote|schrieb|a écrit|escribió))\b.{0,60}:\s*$"


def normalised(text: Column) -> Column:
    """Lower case, words and digits only, one space between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def stripped(text: Column) -> Column:
    """Without white space at either end, in one pass from each."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def parsed_lines(text: Column) -> Column:
    """array<struct<level, line>>: quote level of each line and the line without its marks."""
    return F.transform(
        F.split(text, "\r?\n"),
        lambda line: F.struct(
            F.length(F.translate(F.regexp_extract(line, TAKEN, 1), " \t", "")).alias("level"),
            F.regexp_replace(line, TAKEN, "").alias("line"),
        ),
    )


def passages(lines: Column) -> Column:
    """array<struct<level, text>>: runs of lines of equal level over 0, in order."""
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    starts = F.filter(places, lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))
    runs = F.transform(
        starts,
        lambda s, k: F.struct(
            F.get(lines, s)["level"].alias("level"),
            F.array_join(F.transform(F.slice(lines, s + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - s), lambda x: x["line"]), "\n").alias("text"),
        ),
    )
    return F.filter(runs, lambda r: r["level"] > 0)


def unattributed(lines: Column) -> Column:
    """Lines without the quoted attributions that a quotation one level deeper follows."""
    return F.filter(lines, lambda x, i: ~((x["level"] > 0) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) == x["level"] + 1) & x["line"].rlike(ATTRIBUTION)))


def own_text(lines: Column) -> Column:
    """Lines of level 0 but for attributions that a quotation follows."""
    kept = F.filter(
        F.transform(lines, lambda x, i: F.struct(x["level"].alias("level"), x["line"].alias("line"), F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)).alias("next"))),
        lambda x: (x["level"] == 0) & ~((x["next"] > 0) & x["line"].rlike(ATTRIBUTION)),
    )
    return stripped(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))


def _hash(text: Column) -> Column:
    return F.sha2(text, 256)


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body (own text) and quotes (array of level, key) of each message."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parsed = messages.select("conv_id", "turn", "role", text.alias("text"))
    quoted = F.col("text").rlike("(?m)" + TAKEN)
    lines = parsed_lines(F.col("text"))
    parsed = parsed.withColumn("lines", F.when(quoted, lines))
    parsed = parsed.withColumn("quoted", unattributed(F.col("lines")))
    keys = F.filter(
        F.transform(passages(F.col("quoted")), lambda p: F.struct(p["level"].alias("level"), normalised(p["text"]).alias("text"))),
        lambda p: p["text"] != "",
    )
    quotes = F.transform(keys, lambda p: F.struct(p["level"].alias("level"), _hash(p["text"]).alias("key")))
    empty = F.array().cast("array<struct<level:int,key:string>>")
    return parsed.select(
        "conv_id", "turn", "role",
        F.when(quoted, own_text(F.col("lines"))).otherwise(stripped(F.col("text"))).alias("body"),
        F.when(quoted, quotes).otherwise(empty).alias("quotes"),
    )


def originals(parsed: DataFrame) -> DataFrame:
    """(conv_id, key, origin): the first turn that says each passage of a conversation."""
    parts = F.concat(F.array(F.col("body")), F.split("body", r"\n\s*\n"), F.split("body", "\n"))
    said = parsed.where(F.col("turn").isNotNull()).select("conv_id", "turn", F.explode(F.array_distinct(F.transform(parts, normalised))).alias("text"))
    return said.where("text <> ''").groupBy("conv_id", _hash(F.col("text")).alias("key")).agg(F.min("turn").alias("origin"))


def link(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, n_linked, max_level, parent_turn, thread_turn, reply_order) of each message.

    text is the message without quotes; thread_turn is the turn at the root of its
    parents, its own if it has none; reply_order counts a conversation's messages
    from 0.
    """
    parsed = cut(spark, parse(messages), "messages")
    quotes = parsed.where(F.size("quotes") > 0)
    asked = quotes.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.key").distinct()
    # Only passages that are quoted are looked up, so what is said but never quoted is not shuffled twice.
    told = originals(parsed.join(quotes.select("conv_id").distinct(), parsed["conv_id"].eqNullSafe(quotes["conv_id"]), "left_semi"))
    a, b = asked.alias("a"), told.alias("b")
    on = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.key") == F.col("b.key")) & (F.col("b.origin") < F.col("a.turn"))
    found = a.join(b, on).groupBy("a.conv_id", "a.turn").agg(
        F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("first_level"), F.max("origin").alias("any_level"), F.count("*").alias("n_linked")
    )
    found = cut(spark, found.select("conv_id", "turn", F.coalesce("first_level", "any_level").alias("parent_turn"), "n_linked"), "links")
    # Roots by doubling: each round doubles the length of the path that is followed.
    up = found.select("conv_id", "turn", F.col("parent_turn").alias("root"))
    while True:
        x, y = up.alias("x"), up.alias("y")
        step = x.join(y, F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x.root") == F.col("y.turn")), "left")
        step = cut(spark, step.select("x.conv_id", "x.turn", F.coalesce("y.root", "x.root").alias("root"), F.col("y.root").isNotNull().alias("moved")), "roots")
        up = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    p, f, r = parsed.alias("p"), found.alias("f"), up.alias("r")
    rows = p.join(f, F.col("p.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("p.turn") == F.col("f.turn")), "left")
    rows = rows.join(r, F.col("p.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("p.turn") == F.col("r.turn")), "left")
    rows = rows.select(
        "p.conv_id", "p.turn", "p.role", F.col("p.body").alias("text"), F.size("p.quotes").alias("n_quotes"),
        F.coalesce("f.n_linked", F.lit(0)).alias("n_linked"), F.coalesce(F.array_max(F.transform("p.quotes", lambda q: q["level"])), F.lit(0)).alias("max_level"),
        "f.parent_turn", F.coalesce("r.root", "p.turn").alias("thread_turn"),
    )
    placed, _ = ranked(spark, rows, ["conv_id", "thread_turn", "turn", "role", "text"])
    first = placed.groupBy("conv_id").agg(F.min("rank").alias("first_rank"))
    s, t = placed.alias("s"), first.alias("t")
    out = s.join(t, F.col("s.conv_id").eqNullSafe(F.col("t.conv_id")))
    return out.select("s.*", (F.col("rank") - F.col("first_rank")).alias("reply_order")).drop("rank")
