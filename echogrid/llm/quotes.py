"""Quotation linking: who answers whom, from the passages that messages quote.

Quoted lines begin with ">" once per level.  A quoted line is normalised and
hashed, and joined to the message of the same conversation that first said it.
A message answers the one that it quotes most at its outermost level.
Everything is DataFrame expressions; hot lines and conversations are combined
before they are shuffled, and no conversation is gathered in one task: messages are numbered by ranges of
threads, of which even the longest has few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .balance import attach
from .components import settle

QUOTED = r"^(\s?>)+"
ATTRIBUTION = r"^(?i:on|am|le|el|il) .*(?i:wrote|schrieb|a écrit|escribió|ha scritto)\s*:?\s*$"
CELL_TURNS = 1024
RANGE_THREADS = 65_536  # turns that begin threads numbered in one window


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def level(line: Column) -> Column:
    """How often the line is quoted; 0 for the message's own words."""
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTED, 0), "[^>]", ""))


def normal(line: Column) -> Column:
    """The line without quote marks, in small letters, white space single."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(line, QUOTED, ""), r"\s+", " ")))


def body(text: Column) -> Column:
    """The message without quoted lines and without the attribution that announces them."""
    lines = split_lines(text)
    own = lambda x: ~x.rlike(QUOTED)
    kept = F.filter(lines, lambda x, i: own(x) & ~(x.rlike(ATTRIBUTION) & F.coalesce(F.get(lines, i + 1).rlike(QUOTED), F.lit(False))))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\n+|\n+$", "")


def said_lines(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, hash) of every line that has words, from columns conv, turn, text."""
    lines = messages.select("conv", "turn", F.explode(split_lines(F.col("text"))).alias("line")).select("conv", "turn", level(F.col("line")).alias("level"), normal(F.col("line")).alias("line"))
    return lines.filter("line != ''").select("conv", "turn", "level", F.unhex(F.md5("line")).alias("hash"))


def links(messages: DataFrame) -> DataFrame:
    """One row per quoting (conv, turn): ``n_linked`` quoted lines whose origin was found, and ``parent``.

    The origin of a line is the earliest turn that says it itself; a line is
    linked if that comes before the quote.  Rows that share conversation and
    turn count together.
    """
    lines = said_lines(messages)
    origins = lines.filter("level = 0").groupBy("conv", "hash").agg(F.min("turn").alias("origin"))
    quoted = lines.filter("level > 0").groupBy("conv", "turn", "level", "hash").agg(F.count(F.lit(1)).alias("n"))
    found = attach(settle(quoted), origins, ["conv", "hash"]).filter("origin < turn")
    votes = found.groupBy("conv", "turn", "level", "origin").agg(F.sum("n").alias("n"))
    best = F.max_by("origin", F.struct(-F.col("level"), F.col("n"), F.col("origin")))
    return votes.groupBy("conv", "turn").agg(F.sum("n").alias("n_linked"), best.alias("parent"))


def threads(linked: DataFrame) -> DataFrame:
    """``root`` and ``depth`` of every linked message: the end of its chain of parents, and the chain's length.

    Chains are halved in each round, so rounds grow with the logarithm of the
    longest; each is written to the shared folder.
    """
    held = settle(linked.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = held.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("above"), F.col("depth").alias("more"))
        step = held.join(up, (F.col("conv") == F.col("c")) & (F.col("root") == F.col("t")), "left")
        held = settle(step.select("conv", "turn", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")))
        if held.filter("moved").isEmpty():
            return held.drop("moved")
        held = held.drop("moved")


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every message without its quotes, and where it stands in its conversation.

    ``body``; ``n_quoted`` lines and ``n_linked`` of them traced; ``reply_to``,
    the quoted turn or else the turn before; ``thread`` and ``depth``, the
    message at the end of the chain of quotes and the chain's length (itself
    and 0 without a quote); ``position``, gapless from 0, by thread, then turn,
    so answers by quotation follow what they answer.  Null texts are empty; a
    null conversation or turn is linked to nothing; rows that repeat a turn
    share its links and have positions of their own, by role and text.
    """
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    linked = settle(links(rows))
    rooted = threads(linked).select("conv", "turn", "root", "depth")
    known = linked.join(rooted, ["conv", "turn"])
    quoted = F.size(F.filter(split_lines(F.col("text")), lambda x: x.rlike(QUOTED) & (normal(x) != ""))).cast("long")
    placed = rows.select("conv", "turn", "role", "text", body(F.col("text")).alias("body"), quoted.alias("n_quoted")).join(known, ["conv", "turn"], "left")
    placed = placed.withColumn("thread", F.coalesce("root", "turn")).withColumn("cell", F.floor(F.col("turn") / CELL_TURNS))
    keys = ["conv", "thread", "cell"]
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.floor(F.col("thread") / RANGE_THREADS))
    # first by ranges of threads, of which a conversation has few, then within each range
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv", "range").orderBy("thread", "cell").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy("conv", "range").agg(F.sum("n").alias("n"))
    bases = ranges.select(F.col("conv").alias("b_conv"), F.col("range").alias("b_range"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = sizes.select(*[F.col(k).alias(f"s_{k}") for k in keys], "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("inner"))
    based = within.join(bases, F.col("s_conv").eqNullSafe(F.col("b_conv")) & F.col("range").eqNullSafe(F.col("b_range")))
    starts = based.select(*[f"s_{k}" for k in keys], (F.col("base") + F.col("inner")).alias("start"))
    inside = Window.partitionBy(*keys).orderBy("turn", "role", "text")
    numbered = placed.withColumn("at", F.row_number().over(inside) - 1)
    same = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys]
    return numbered.join(starts, same[0] & same[1] & same[2]).select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "body", "n_quoted",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("parent", F.when(F.col("turn") > 0, F.col("turn") - 1)).alias("reply_to"),
        "thread", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), (F.col("start") + F.col("at")).cast("long").alias("position"),
    )
