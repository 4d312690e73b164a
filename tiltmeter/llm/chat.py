"""Chat formatting: keep only the longest snapshot of every logged conversation, then render it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import narrow

#: Turns per rendered piece; a conversation of any length is a sequence of such pieces.
BLOCK = 256


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    on = None
    for k in keys:
        same = left[k].eqNullSafe(right[k])
        on = same if on is None else on & same
    return left.join(right, on, how)


def turn_prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rolling hashes of (conv, block, turn, role, text) rows after each turn, and block totals.

    The hash of a prefix is the XOR of two 64-bit hashes of each of its (turn,
    role, text), so it rolls forward in a window, adds up over blocks, and needs
    no window over more than one block of turns.
    """
    order = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    said = F.struct("turn", "role", "text")
    once = (turns.withColumn("again", F.lag(said).over(order).eqNullSafe(said) & (F.row_number().over(order) > 1))
            .filter(~F.col("again")).drop("again"))
    parts = [F.coalesce(F.col("turn"), F.lit(-1)), F.col("role").isNull(), F.coalesce(F.col("role"), F.lit("")), F.col("text").isNull(),
             F.coalesce(F.col("text"), F.lit(""))]
    hashed = once.withColumns({"a": F.xxhash64(F.lit(1), *parts), "b": F.xxhash64(F.lit(2), F.lit("turn"), *parts)})
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = hashed.withColumns({"k": F.row_number().over(order), "ra": F.bit_xor("a").over(so_far), "rb": F.bit_xor("b").over(so_far),
                                 "end": F.lead(F.lit(1)).over(order).isNull()})
    blocks = hashed.groupBy("conv", "block").agg(F.count("*").alias("n"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"))
    return rolled, blocks


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv and n_turns of the conversations that are no prefix of a longer one, one of each set of equal ones."""
    rolled, blocks = turn_prefixes(turns)
    whole = blocks.groupBy("conv").agg(F.sum("n").alias("n"), F.bit_xor("xa").alias("ha"), F.bit_xor("xb").alias("hb"))
    # Copies go first: one row a content from here on, however often it was logged.
    distinct = whole.groupBy("n", "ha", "hb").agg(F.min("conv").alias("conv"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    by_block = Window.partitionBy("conv").orderBy("block")
    zero = F.lit(0).cast("bigint")
    at = blocks.select("conv", "block", F.coalesce(F.sum("n").over(earlier), zero).alias("n0"), F.coalesce(F.bit_xor("xa").over(earlier), zero).alias("a0"),
                       F.coalesce(F.bit_xor("xb").over(earlier), zero).alias("b0"), F.lead(F.lit(1)).over(by_block).isNull().alias("last_block"))
    at = at.select(F.col("conv").alias("c2"), F.col("block").alias("b2"), "n0", "a0", "b0", "last_block")
    inside = rolled.select("conv", "block", "k", "ra", "rb", "end")
    proper = inside.join(at, inside["conv"].eqNullSafe(at["c2"]) & (inside["block"] == at["b2"])).filter(~(F.col("end") & F.col("last_block")))
    prefixes = proper.select((F.col("n0") + F.col("k")).alias("n"), F.col("ra").bitwiseXOR(F.col("a0")).alias("ha"),
                             F.col("rb").bitwiseXOR(F.col("b0")).alias("hb")).distinct()
    return distinct.join(prefixes, ["n", "ha", "hb"], "left_anti").select("conv", F.col("n").alias("n_turns"))


def rendered_turn(role, text):
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def format_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """Maximal conversations as chat markup: conv_id, part, n_turns (of the whole conversation), text.

    A conversation is the set of its (turn, role, text) rows in that order. It is
    dropped if a longer one starts with it, or if one with a smaller id is equal
    to it. What remains is rendered in parts of 256 turn numbers, so that no
    conversation has to fit in one row; concatenated in order of ``part`` they
    are the whole text.

    Repeated rows count once. Two rows of one turn that differ are both kept,
    ordered by role and text. A null id is an id like any other; a null turn sorts
    first, a null role renders as "unknown" and a null text as empty (but null and
    empty are different when conversations are compared). An empty table gives an empty result.
    Other columns are not read.
    """
    turn = F.col(f"`{turn_col}`").cast("bigint")
    turns = narrow(conversations, conv=conv_col, turn=turn, role=F.col(f"`{role_col}`").cast("string"), text=F.col(f"`{text_col}`").cast("string"),
                   block=F.coalesce(F.floor(turn / BLOCK).cast("bigint"), F.lit(-(1 << 40))))
    kept = maximal_conversations(turns).select(F.col("conv").alias("c2"), "n_turns")
    rows = turns.join(kept, turns["conv"].eqNullSafe(kept["c2"])).drop("c2")
    line = F.struct("turn", "role", "text")
    # A set of lines: repeated rows once, and sorted as the turns are.
    lines = F.array_sort(F.collect_set(line))
    shown = F.array_join(F.transform(lines, lambda x: rendered_turn(x["role"], x["text"])), "")
    return rows.groupBy("conv", "block", "n_turns").agg(shown.alias("text")).select(
        F.col("conv").alias("conv_id"), F.col("block").cast("bigint").alias("part"), "n_turns", "text")
