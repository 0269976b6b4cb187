"""Exact dedup by distributed MSD radix partitioning.

Documents are split by their first bytes, then the members of each group that still has several are
split by the next bytes, and so on until a group is a singleton or its texts have ended. What makes two
texts equal is that they went the same way through all digits; no digest decides. A digit is a run of
bytes, and each run is ``GROWTH`` times as long as the one before, so a text of n bytes takes log(n)
rounds. A round shuffles only the row id, the group and the digit of rows whose group has another
member; texts without a fellow leave after the first round.

Large groups: a group is counted with partial aggregation, and rows get their new group by a join that
adaptive execution can split, so no task has to hold a group.

Defined results: a null text counts as empty, empty texts equal each other; only A-Z are lower-cased; null
ids sort below all others; of rows with the same text and id, one (any of these equal rows) stays; an
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.llm.common import ascii_lower, maybe_broadcast, remove, save

FIRST, GROWTH = 64, 8


def _split(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """All rows (rid, id, carried, sha), and of those with a fellow (rid, keep, n), where ``keep`` is (id, rid) of the row that stays."""
    text = F.col(text_col)
    whole = ascii_lower(text).cast("binary")
    head = F.substring(ascii_lower(F.substring(text, 1, FIRST)).cast("binary"), 1, FIRST)

    shared = save(
        docs.select(head.alias("head")).groupBy("head").agg(F.count("*").alias("n")).filter("n > 1").select("head", F.monotonically_increasing_id().alias("gid")),
        "radix-heads",
    )
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.struct(*carry).alias("carried") if carry else F.lit(None).cast("int").alias("carried"), whole.alias("bin"), head.alias("head")
    )
    first = save(
        # A merge join at any size: a broadcast would be cheaper only while few heads are shared.
        rows.join(shared.hint("merge"), "head", "left").select("rid", "id", "carried", "gid", F.sha2("bin", 256).alias("sha"), F.when(F.col("gid").isNotNull(), F.col("bin")).alias("bin")),
        "radix-rows",
    )
    remove(docs.sparkSession, shared)

    open_rows = first.filter(F.col("gid").isNotNull())
    state, done, at, width = None, [], FIRST, FIRST * GROWTH
    while True:
        digit = F.substring("bin", at + 1, width).alias("digit"), (F.octet_length("bin") <= at + width).alias("ended")
        if state is None:
            level = open_rows.select("rid", "id", "gid", *digit)
        else:
            level = open_rows.select("rid", "id", *digit).join(state, "rid")
        groups = save(
            level.groupBy("gid", "digit", "ended")
            .agg(F.count("*").alias("n"), F.max(F.struct("id", "rid")).alias("keep"))
            .filter("n > 1")
            .withColumn("next", F.monotonically_increasing_id()),
            "radix-groups",
        )
        placed = save(level.join(groups, ["gid", "digit", "ended"]).select("rid", F.col("next").alias("gid"), "keep", "n", "ended"), "radix-level")
        remove(docs.sparkSession, groups)
        done.append(placed.filter("ended").select("rid", "keep", "n"))
        state = placed.filter("not ended").select("rid", "gid")
        if state.isEmpty():
            break
        at, width = at + width, width * GROWTH
    members = reduce(DataFrame.unionByName, done)
    return first.select("rid", "id", "carried", "sha"), members


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``. Of equal texts the row with the largest id stays."""
    rows, members = _split(docs, id_col, text_col, ())
    out = rows.join(members, "rid", "left")
    alone = F.col("n").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep.rid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, without the rows whose text another, kept row has."""
    rows, members = _split(docs, id_col, text_col, tuple(docs.columns))
    dropped = members.filter("rid != keep.rid").select("rid")
    return rows.join(maybe_broadcast(dropped, 2_000_000), "rid", "left_anti").select("carried.*")
