"""Chat formatting by quotation linking (operator 9), in DataFrame operations only.

A message's lines are parsed into quote levels (leading `>` signs, spaces between them allowed).
Neighbouring lines of one level are a passage; its normalised form is hashed: lower case, white
space as one space, line starts dropped. What a message says itself (level 0) is hashed as a
whole, by passage and by line. A quoted passage, or else one of its lines, is joined by its hash to the
latest earlier message of the conversation that says the same; normalised texts are compared, not
only hashes. The first line at the lowest level that finds its message names the parent.

The result is a row for each message, without its quotes, with its position in its thread: sorted by
(conv_id, root, position), each reply stands after its parent and before the parent's next reply, and
replies of one parent stand by turn (`in_order`). Depths and roots come from pointer doubling, as many rounds as
the longest chain has bits. Positions come from a tour around each thread, in which every message is entered and left
once: pointer doubling along the tour counts the messages entered before. Neither a path for each message nor a
list for each thread is made, so long chains cost no more rows than short ones.

Keys hold the conversation and the hash; for the latest earlier message the keys are ordered by
turn in a window, so no pairs are made where a line is very common. Windows hold a row for each turn, and are over
stretches of turns; what stretches hold is looked through in the same way. So a line that is common in one very
long conversation, or in very many messages of one turn, is dealt to many tasks.

Defined results: a null text says nothing; a null conversation is a conversation of its own; null
turns come first and are nobody's parent; rows that repeat a conversation and turn are all kept
and share the links of the first by text, and its position; a message that quotes nothing known is a root; quotes that
find no message are dropped like others and counted in n_unlinked; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import cut

_QUOTE = r"^[ \t>]*"  # one class, no repeated group: any number of signs


def _norm(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def _lines(text: Column) -> Column:
    """array<struct<level, text>> of the lines of a text."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1)
    mark = lambda x: F.when(x.rlike(r"^[ \t]*>"), F.regexp_extract(x, _QUOTE, 0)).otherwise(F.lit(""))
    return F.transform(lines, lambda x: F.struct((F.length(mark(x)) - F.length(F.replace(mark(x), F.lit(">"), F.lit("")))).alias("level"), F.substr(x, F.length(mark(x)) + 1).alias("text")))


def _passages(lines: Column) -> Column:
    """array<struct<level, lines>>: neighbouring lines of one level; a blank line ends a passage.

    Passages are slices between the places where they start and end, so time is linear in the lines.
    """
    n = F.size(lines)
    blank = lambda i: F.trim(F.get(lines, i)["text"]) == ""
    apart = lambda i, j: blank(j) | (F.get(lines, i)["level"] != F.get(lines, j)["level"])
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~blank(i))
    starts = F.filter(at, lambda i: (i == 0) | apart(i, i - 1))
    ends = F.filter(at, lambda i: (i == n - 1) | apart(i, i + 1))
    return F.zip_with(starts, ends, lambda i, j: F.struct(F.get(lines, i)["level"].alias("level"), F.transform(F.slice(lines, i + 1, j - i + 1), lambda x: x["text"]).alias("lines")))


def parse(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, reply (the text without quotes), passages.

    A text without any `>` at a line's start is one passage and skips the parse.
    """
    x = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    quoted = F.coalesce(F.col("text"), F.lit("")).rlike(r"(?m)^[ \t]*>")
    lines = F.when(quoted, _lines(F.col("text")))
    x = x.withColumn("quoted", quoted).withColumn("lines", lines)
    own = F.array_join(F.transform(F.filter("lines", lambda p: p["level"] == 0), lambda p: p["text"]), "\n")
    reply = F.when(F.col("quoted"), F.regexp_replace(F.regexp_replace(own, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")).otherwise(F.coalesce("text", F.lit("")))
    return x.select("conv_id", "turn", "role", reply.alias("reply"), F.when(F.col("quoted"), _passages(F.col("lines"))).alias("passages"))


def _said(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, norm): what a message says itself, whole, by paragraph and by line."""
    parts = F.flatten(F.array(F.array("reply"), F.split("reply", r"\n[ \t]*\n"), F.split("reply", "\n")))
    texts = F.array_distinct(F.filter(F.transform(parts, _norm), lambda x: x != ""))
    return parsed.select("conv_id", "turn", F.explode(texts).alias("norm"))


def _quoted(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, level, place, part, norm): quoted passages whole (part 0), then their lines."""
    p = parsed.where("passages IS NOT NULL").select("conv_id", "turn", F.posexplode("passages").alias("place", "p")).where("p.level > 0")
    texts = F.transform(F.concat(F.array(F.array_join("p.lines", "\n")), F.col("p.lines")), _norm)
    return p.select("conv_id", "turn", F.col("p.level").alias("level"), "place", F.posexplode(texts).alias("part", "norm")).where("norm <> ''")


#: Bits of the turn in one stretch: 65,536 turns of a line in a window at most.
STRETCH = 16


def _latest(rows: DataFrame, at: str, bits: int) -> DataFrame:
    """rows(conv_id, h, norm, at, source, ..) with parent, the largest source at earlier places of the key.

    Rows of one place stand together, so a message is not its own source: only earlier ones count.
    """
    key = ["conv_id", "h", "norm"]
    top, group = bits <= STRETCH, f"{at}_"
    x = rows if top else rows.withColumn(group, F.shiftright(at, STRETCH))
    w = Window.partitionBy(*key, *([] if top else [group])).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("parent", F.max("source").over(w))
    if top:
        return x.select(*rows.columns, "parent")
    sums = rows.groupBy(*key, F.shiftright(at, STRETCH).alias(group)).agg(F.max("source").alias("source"))
    before = _latest(sums, group, bits - STRETCH).toDF(*[f"b_{c}" for c in (*key, group, "source", "parent")])
    both = x.join(before, F.col("conv_id").eqNullSafe(F.col("b_conv_id")) & (F.col("h") == F.col("b_h")) & (F.col("norm") == F.col("b_norm")) & F.col(group).eqNullSafe(F.col(f"b_{group}")), "left")
    return both.select(*[F.col(c) for c in rows.columns], F.coalesce("parent", "b_parent").alias("parent"))


def links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, parent, n_unlinked of the messages that quote.

    Only what is quoted somewhere is looked for: what is said is first cut down to the hashes that
    quotes ask for, so messages without quotes in their conversation are not shuffled.
    """
    asked = cut(_quoted(parsed).withColumn("h", F.xxhash64("norm")))
    kinds = "conv_id long, turn long, parent long, n_unlinked long"
    if asked.isEmpty():
        return parsed.sparkSession.createDataFrame([], kinds)
    said = _said(parsed).withColumn("h", F.xxhash64("norm"))
    keys = asked.select(F.col("conv_id").alias("kc"), F.col("h").alias("kh")).distinct()
    said = said.join(keys, F.col("conv_id").eqNullSafe(F.col("kc")) & (F.col("h") == F.col("kh")), "left_semi").where("turn IS NOT NULL")
    # a row for each turn that says or asks for a text, however often it does, so a stretch of turns bounds a window
    said = said.groupBy("conv_id", "h", "norm", "turn").agg(F.max("turn").alias("source"), F.lit(False).alias("asks"))
    turns = asked.groupBy("conv_id", "h", "norm", "turn").agg(F.lit(None).cast("long").alias("source"), F.lit(True).alias("asks"))
    latest = _latest(said.union(turns), "turn", 64).where("asks").select(*[F.col(c).alias(f"l_{c}") for c in ("conv_id", "h", "norm", "turn")], "parent")
    same = F.col("conv_id").eqNullSafe(F.col("l_conv_id")) & (F.col("h") == F.col("l_h")) & (F.col("norm") == F.col("l_norm")) & F.col("turn").eqNullSafe(F.col("l_turn"))
    found = asked.join(latest, same).select("conv_id", "turn", "level", "place", "part", "parent")
    rank = F.struct(F.col("parent").isNull(), "level", "place", "part", "parent")
    # a passage is linked if it or one of its lines is
    by = found.groupBy("conv_id", "turn", "place").agg(F.min(rank).alias("best"))
    by = by.groupBy("conv_id", "turn").agg(F.min("best").alias("best"), F.sum(F.col("best.parent").isNull().cast("long")).alias("n_unlinked"))
    return by.select("conv_id", "turn", F.col("best.parent").alias("parent"), "n_unlinked")


def roots(links_: DataFrame) -> DataFrame:
    """conv_id, turn, root, depth of the messages that have a parent, by pointer doubling."""
    at = cut(links_.where("parent IS NOT NULL").select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = at.select(F.col("conv_id").alias("uc"), F.col("turn").alias("ut"), F.col("root").alias("ur"), F.col("depth").alias("ud"))
        step = at.join(up, F.col("conv_id").eqNullSafe(F.col("uc")) & (F.col("root") == F.col("ut")), "left")
        at = cut(step.select("conv_id", "turn", F.coalesce("ur", "root").alias("root"), (F.col("depth") + F.coalesce("ud", F.lit(0))).alias("depth"), F.col("ur").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def positions(links_: DataFrame) -> DataFrame:
    """conv_id, turn, position of the messages that have a parent: how many of the thread stand before, depth first.

    The tour goes from a message to its first reply, from a reply that is left to the next one, and from the last one
    back to the parent. Each item points to the one before it, so no two items share a target and no key is hot.
    """
    edges = links_.where("parent IS NOT NULL").select("conv_id", "turn", "parent")
    same = F.col("conv_id").eqNullSafe(F.col("uc"))
    sisters = _latest(edges.select("conv_id", F.col("parent").alias("h"), F.lit("").alias("norm"), "turn", F.col("turn").alias("source")), "turn", 64)
    sister = F.col("parent")  # the reply before, to the same message
    enters = sisters.select("conv_id", "turn", F.lit(False).alias("leaves"), F.coalesce(sister, "h").alias("to"), sister.isNotNull().alias("to_leaves"), sister.isNull().cast("long").alias("n"))
    last = edges.groupBy("conv_id", "parent").agg(F.max("turn").alias("child")).toDF("uc", "ut", "child")
    child = F.col("child")
    exits = edges.join(last, same & (F.col("turn") == F.col("ut")), "left").select("conv_id", "turn", F.lit(True).alias("leaves"), F.coalesce(child, "turn").alias("to"), child.isNotNull().alias("to_leaves"), child.isNull().cast("long").alias("n"))
    # an item whose target is no item has come to the root's entry
    at = cut(enters.union(exits).withColumn("open", F.lit(True)))
    while not at.where("open").isEmpty():
        up = at.toDF("uc", "ut", "ul", "u_to", "u_to_leaves", "un", "u_open")
        step = at.where("open").join(up, same & (F.col("to") == F.col("ut")) & (F.col("to_leaves") == F.col("ul")), "left")
        step = step.select("conv_id", "turn", "leaves", F.coalesce("u_to", "to").alias("to"), F.coalesce("u_to_leaves", "to_leaves").alias("to_leaves"), (F.col("n") + F.coalesce("un", F.lit(0))).alias("n"), F.coalesce("u_open", F.lit(False)).alias("open"))
        at = cut(at.where("NOT open").union(step))
    return at.where("NOT leaves").select("conv_id", "turn", F.col("n").alias("position"))


def in_order(replies: DataFrame) -> DataFrame:
    """Rows of reply_order() as conversations: thread by thread, replies after what they answer. Ranges are sorted, so
    a thread of any size is never one list or one task's group."""
    return replies.orderBy("conv_id", "root", "position")


def reply_order(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, reply, parent, root, depth, n_unlinked, position of each message; see in_order()."""
    parsed = parse(messages, conv_col, turn_col, role_col, text_col)
    found = cut(links(parsed))
    out = parsed.drop("passages")
    if found.isEmpty():
        zero = F.lit(0).cast("long")
        return out.select("*", F.lit(None).cast("long").alias("parent"), F.col("turn").alias("root"), zero.alias("depth"), zero.alias("n_unlinked"), zero.alias("position"))
    deep = roots(found).toDF("rc", "rt", "root", "depth")
    place = positions(found).toDF("pc", "pt", "position")
    joined = found.join(deep, F.col("conv_id").eqNullSafe(F.col("rc")) & F.col("turn").eqNullSafe(F.col("rt")), "left")
    joined = joined.join(place, F.col("conv_id").eqNullSafe(F.col("pc")) & F.col("turn").eqNullSafe(F.col("pt")), "left").drop("rc", "rt", "pc", "pt").withColumnsRenamed({"conv_id": "fc", "turn": "ft"})
    out = out.join(joined, F.col("conv_id").eqNullSafe(F.col("fc")) & F.col("turn").eqNullSafe(F.col("ft")), "left").drop("fc", "ft")
    rest = [F.coalesce(c, F.lit(0)).alias(c) for c in ("depth", "n_unlinked", "position")]
    return out.select("conv_id", "turn", "role", "reply", "parent", F.coalesce("root", "turn").alias("root"), *rest)
