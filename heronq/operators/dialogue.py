"""Conversations put together from their turns by a state machine that holds for any number of turns.

In order of turn a conversation may begin with a system turn, then user and assistant take turns, user first. A turn whose
role is not due is left out and does not change what is due. Turns are cut into parts of PART numbers; a part's turns are
folded in order from each state that it might begin in, and parts are folded in the same way level by level, so that no group is ever
longer than PART, whatever the length of a conversation. Back down the levels every part learns the state it begins in.

Defined results: of rows with equal conversation and turn one counts, the least by role, then text, nulls last, the
others are repeated; rows whose turn is null or negative are stray and in no transcript; missing are the numbers from 0 to the last
turn that no row has; unknown and null roles are never due; null texts are empty; a null conv_id is a conversation
of its own; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronq.sources.scratch import settled

PART = 512
#: Next state from each state (nothing yet, after system, user, assistant) by role (system, user, assistant); -1: not due.
NEXT = [[1, 2, -1], [-1, 2, -1], [-1, -1, 3], [-1, 2, -1]]
ROLES = ("system", "user", "assistant")
_IDENTITY = "array(" + ", ".join(f"named_struct('end', {s}, 'out', 0L)" for s in range(4)) + ")"


def role_code(role: Column) -> Column:
    code = F.lit(3)
    for k, name in enumerate(ROLES):
        code = F.when(role == name, k).otherwise(code)
    return code


def step(state: Column, code: Column) -> Column:
    """The state that a role leads to, or -1."""
    table = F.array(*[F.lit(x) for row in NEXT for x in [*row, -1]])
    return F.get(table, state * 4 + code)


def fold_turns(codes: Column) -> Column:
    """What a run of roles does from each state: the state it ends in and how many turns are left out."""

    def one(held, code):
        def move(s):
            to = step(s["end"], code)
            return F.struct(F.when(to < 0, s["end"]).otherwise(to).alias("end"), (s["out"] + F.when(to < 0, 1).otherwise(0)).alias("out"))

        return F.transform(held, move)

    return F.aggregate(codes, F.expr(_IDENTITY), one)


def fold_parts(parts: Column) -> Column:
    """The same of a run of parts, each with what it does."""

    def one(held, part):
        def move(s):
            does = F.get(part["does"], s["end"])
            return F.struct(does["end"].alias("end"), (s["out"] + does["out"]).alias("out"))

        return F.transform(held, move)

    return F.aggregate(parts, F.expr(_IDENTITY), one)


def distinct_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, n, role, text): one row a turn with the number of its rows; stray rows have turn null."""
    turn = F.when(F.col("turn") >= 0, F.col("turn").cast("long"))
    least = F.min(F.struct(F.col("role").isNull().alias("a"), "role", F.col("text").isNull().alias("b"), "text")).alias("v")
    return conversations.select("conv_id", turn.alias("turn"), "role", "text").groupBy("conv_id", "turn").agg(F.count("*").alias("n"), least).select("conv_id", "turn", "n", "v.role", "v.text")


def parted(turns: DataFrame, part: int) -> DataFrame:
    """(conv_id, part, turns, does): the turns of each part in order and what they do."""
    at = turns.where("turn is not null").select("conv_id", F.floor(F.col("turn") / part).cast("long").alias("part"), F.struct("turn", role_code(F.col("role")).alias("code"), "role", F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    lists = at.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return lists.withColumn("does", fold_turns(F.transform("turns", lambda t: t["code"])))


def levels(parts: DataFrame, part: int) -> list[DataFrame]:
    """Tables (conv_id, up, part, does), each level's parts grouped under `up`, the parts of the next; the last has one part a conversation."""
    out = []
    while True:
        now = settled(parts.select("conv_id", F.floor(F.col("part") / part).cast("long").alias("up"), "part", "does"), "level")
        out.append(now)
        if not now.where("part > 0").head(1):
            return out
        lists = now.groupBy("conv_id", "up").agg(F.sort_array(F.collect_list(F.struct("part", "does"))).alias("held"))
        parts = lists.select("conv_id", F.col("up").alias("part"), fold_parts(F.col("held")).alias("does"))


def begun(tiers: list[DataFrame]) -> DataFrame:
    """(conv_id, part, state): the state that each part of the first level begins in."""
    state = tiers[-1].select("conv_id", "part", F.lit(0).alias("state"))
    for tier in reversed(tiers[:-1]):
        lists = tier.groupBy("conv_id", "up").agg(F.sort_array(F.collect_list(F.struct("part", "does"))).alias("held"))
        above = state.select(F.col("conv_id").alias("c"), F.col("part").alias("up_part"), F.col("state").alias("s"))
        met = lists.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("up_part")))

        def go(held, p):
            end = F.get(p["does"], held["now"])["end"]
            return F.struct(end.alias("now"), F.concat(held["all"], F.array(F.struct(p["part"].alias("part"), held["now"].alias("state")))).alias("all"))

        none = F.struct(F.col("s").alias("now"), F.expr("cast(array() as array<struct<part: bigint, state: int>>)").alias("all"))
        state = met.select("conv_id", F.inline(F.aggregate("held", none, go, lambda x: x["all"])))
        state = settled(state, "begun")
    return state


def conversation_report(conversations: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, n_rows, n_turns, n_missing, n_repeated, n_stray, n_out_of_role, last_role, complete), one row a conversation.

    complete: nothing missing, repeated, stray or out of role, and an assistant has the last word."""
    turns = settled(distinct_turns(conversations), "turns")
    top = levels(parted(turns, part), part)[-1]
    last = F.get(F.array(F.lit(None), *[F.lit(r) for r in ROLES]), F.col("does")[0]["end"])
    ends = top.select(F.col("conv_id").alias("c"), F.col("does")[0]["out"].alias("out"), last.alias("last_role"))
    real = F.col("turn").isNotNull()
    sums = turns.groupBy("conv_id").agg(
        F.sum("n").alias("n_rows"), F.count("turn").alias("n_turns"), F.coalesce(F.max("turn") + 1, F.lit(0)).alias("numbers"),
        F.sum(F.when(real, F.col("n") - 1).otherwise(0)).alias("n_repeated"), F.sum(F.when(real, 0).otherwise(F.col("n"))).alias("n_stray"),
    )
    got = sums.join(ends, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    got = got.select("conv_id", "n_rows", "n_turns", (F.col("numbers") - F.col("n_turns")).alias("n_missing"), "n_repeated", "n_stray", F.coalesce("out", F.lit(0)).cast("long").alias("n_out_of_role"), "last_role")
    whole = (F.col("n_missing") + F.col("n_repeated") + F.col("n_stray") + F.col("n_out_of_role") == 0) & F.coalesce(F.col("last_role") == "assistant", F.lit(False))
    return got.withColumn("complete", whole)


def transcripts(conversations: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, first_turn, n_kept, n_left_out, transcript): the turns that are due, `part` numbers at a time."""
    parts = settled(parted(settled(distinct_turns(conversations), "turns"), part), "parts")
    state = begun(levels(parts, part)).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "state")
    met = parts.join(state, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))

    def go(held, t):
        to = step(held["now"], t["code"])
        said = F.concat(F.lit("<|"), t["role"], F.lit("|>"), t["text"])
        return F.struct(F.when(to < 0, held["now"]).otherwise(to).alias("now"), F.when(to < 0, held["said"]).otherwise(F.concat(held["said"], F.array(said))).alias("said"))

    none = F.struct(F.col("state").alias("now"), F.expr("cast(array() as array<string>)").alias("said"))
    told = met.select("conv_id", "part", "turns", F.aggregate("turns", none, go, lambda x: x["said"]).alias("said"))
    return told.select("conv_id", "part", F.col("turns")[0]["turn"].alias("first_turn"), F.size("said").cast("long").alias("n_kept"), (F.size("turns") - F.size("said")).cast("long").alias("n_left_out"), F.array_join("said", "\n").alias("transcript"))
