"""Chat logs to training texts: snapshots that a longer conversation continues are dropped, the rest rendered.

A log holds a conversation again each time it grew.  Hashes of the turns up to each turn, summed along the
conversation, identify every prefix; conversations whose whole hash is the prefix of a longer one go by an
anti-join, and of equal conversations the one with the least identifier stays.  All in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext.llm.common import running, same, staged
from bitext.plans.ordered import running_before

LANES = ["h0", "h1", "h2", "h3"]  # 128 bits as four sums of 32-bit words
PIECE_TURNS = 1024


def turn_lanes(position: Column, role: Column, text: Column) -> list[Column]:
    """Four 32-bit words that tell a turn at its position from any other; null is told from empty."""
    digest = F.md5(F.to_json(F.struct(position.alias("p"), role.alias("r"), text.alias("t"))))
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def collapse(
    turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Numbered turns (id, pos, role, text) and the maximal conversations (id, n_turns, snapshots).

    ``snapshots`` counts the conversations that are equal to it.  Turns stand in the order of ``turn``, null first,
    equal ones by hash of role and text; repeated rows are turns of their own.  Rows without
    identifier are one conversation.  Roles and texts compare exactly, null apart from empty.
    """
    rows = turns.select(
        F.col(id).alias("id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), F.xxhash64(role, text).alias("tie")
    )
    numbered = staged(running(rows, ["id"], ["turn", "tie"], {"pos": F.lit(1)}, "turns").select("id", "pos", "role", "text"), "turns")
    lanes = turn_lanes(F.col("pos"), F.col("role"), F.col("text"))
    hashed = numbered.select("id", "pos", *[v.alias(f"own_{n}") for v, n in zip(lanes, LANES, strict=True)])
    summed = staged(running_before(hashed, ["id"], "pos", {n: ("sum", F.col(f"own_{n}")) for n in LANES}), "prefixes")
    # What stands before a turn is a prefix that goes on.
    continued = summed.where("pos > 0").select(F.col("pos").alias("n_turns"), *LANES).distinct()
    whole = F.struct((F.col("pos") + 1).alias("n_turns"), *[(F.col(n) + F.col(f"own_{n}")).alias(n) for n in LANES])
    whole = summed.groupBy("id").agg(F.max_by(whole, "pos").alias("w")).select("id", "w.*")
    once = whole.groupBy("n_turns", *LANES).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("snapshots"))
    return numbered, once.join(continued, ["n_turns", *LANES], "left_anti").select("id", "n_turns", "snapshots")


def format_chats(
    turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece_turns: int = PIECE_TURNS
) -> DataFrame:
    """Maximal conversations as texts: the id column, piece, n_turns, snapshots, text.

    A conversation of more than ``piece_turns`` turns is several pieces, whose texts follow each other, so that
    no conversation has to fit into a row.  Null roles and texts are rendered empty.  Other columns play no part.
    An empty table gives an empty one.  See ``collapse`` for ties, nulls and repeated rows.
    """
    numbered, maximal = collapse(turns, id, turn, role, text)
    kept = maximal.withColumnRenamed("id", "kept")
    return (
        numbered.join(kept, same(F.col("id"), F.col("kept")))
        .groupBy("id", F.expr(f"pos div {piece_turns}").cast("int").alias("piece"), "n_turns", "snapshots")
        .agg(F.sort_array(F.collect_list(F.struct("pos", render_turn(F.col("role"), F.col("text")).alias("t")))).alias("turns"))
        .select(F.col("id").alias(id), "piece", "n_turns", "snapshots", F.array_join(F.col("turns.t"), "").alias("text"))
    )
