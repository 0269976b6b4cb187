"""Exact sets, counts, spectra, differences and similarities of tokens.

Sides and groups are columns, so one aggregation answers for all of them; membership of two sides is one group-by with conditional
sums, which costs a single shuffle where a full outer join would cost two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setweave.functions import dna


def token_set(tokens: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return tokens.select(*by, "token").distinct()


def canonical_set(tokens: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return tokens.select(*by, dna.canonical(F.col("token")).alias("token")).distinct()


def token_counts(tokens: DataFrame, by: tuple[str, ...] = (), canonical: bool = False) -> DataFrame:
    """(by..., token, cnt); tokens that come with counts of their own (``packed_kmers``) have these summed."""
    token = dna.canonical(F.col("token")) if canonical else F.col("token")
    many = F.sum("cnt") if "cnt" in tokens.columns else F.count("*")
    return tokens.withColumn("token", token).groupBy(*by, "token").agg(many.alias("cnt"))


def spelled(rows: DataFrame, k: int) -> DataFrame:
    """Rows of packed tokens with their letters instead."""
    return rows.withColumn("token", dna.spelled(F.col("token"), k))


def count_range(counts: DataFrame, least: int, most: int) -> DataFrame:
    return counts.filter(F.col("cnt").between(least, most))


def without_frequency(counts: DataFrame, cnt: int) -> DataFrame:
    return counts.filter(F.col("cnt") != cnt)


def l0(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count("*").alias("l0"))


def l1(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("l1"))


def approximate_l0(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.approx_count_distinct("token", 0.01).alias("l0"))


def spectrum(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How many tokens have each count."""
    return counts.groupBy(*by, "cnt").agg(F.count("*").alias("tokens"))


def spectrum_stats(found: DataFrame) -> DataFrame:
    """Of a spectrum: different tokens, all tokens, entropy in bits, the commonest count (the smallest of equals), and two hints of spare room."""
    n, share = F.col("tokens"), F.col("tokens") / F.col("all")
    total = found.agg(F.sum("tokens").alias("all"))
    rows = found.crossJoin(F.broadcast(total))  # one row: the grand total
    out = rows.agg(
        F.sum("tokens").alias("l0"),
        F.sum(n * F.col("cnt")).alias("l1"),
        F.max("tokens").alias("mode_tokens"),
        F.min_by("cnt", F.struct(-n, F.col("cnt"))).alias("mode"),
        (-F.sum(share * F.log2(share))).alias("entropy"),
    )
    eps = (F.col("l0") - F.col("mode_tokens")) / F.col("mode_tokens")
    return out.select(
        "l0", "l1", "mode", "mode_tokens", "entropy", F.when(F.col("l0") == F.col("mode_tokens"), F.lit(float("inf"))).otherwise(eps).alias("eps_hint"),
        F.when(F.col("l0") == F.col("mode_tokens"), F.lit(float("inf"))).otherwise(eps * F.col("entropy")).alias("eps_scaled"),
    )


def sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both inputs with ``side`` i or j."""
    return a.withColumn("side", F.lit("i")).unionByName(b.withColumn("side", F.lit("j")))


def _in(both: DataFrame, side: str) -> Column:
    """Whether a row is in a side: rows name their side in ``side``, or have a flag for each in ``in_i`` and ``in_j``, so that one row may stand for both."""
    return F.col("side") == side if "side" in both.columns else F.col(f"in_{side}")


def membership(both: DataFrame) -> DataFrame:
    """(token, in_i, in_j): whether each token is in a side. Repeats do no harm, so nothing is made distinct before."""
    return both.groupBy("token").agg(*(F.coalesce(F.max(_in(both, s)), F.lit(False)).alias(f"in_{s}") for s in "ij"))


def side_counts(both: DataFrame) -> DataFrame:
    """(token, ci, cj): how often each token is in each side, from one grouping."""
    n = F.col("cnt") if "cnt" in both.columns else F.lit(1)
    return both.groupBy("token").agg(*(F.sum(F.when(_in(both, s), n).otherwise(0)).alias(f"c{s}") for s in "ij"))


def symmetric_difference(both: DataFrame) -> DataFrame:
    """(side, token) of tokens in one side only."""
    one = membership(both).filter(F.col("in_i") != F.col("in_j"))
    return one.select(F.when(F.col("in_i"), "i").otherwise("j").alias("side"), "token")


def set_summary(both: DataFrame) -> DataFrame:
    """Sizes, intersection, union, differences, Jaccard and both containments; two empty sides are alike."""
    m = membership(both)
    i, j = F.col("in_i"), F.col("in_j")
    sums = m.agg(F.count_if(i).alias("size_i"), F.count_if(j).alias("size_j"), F.count_if(i & j).alias("shared"), F.count("*").alias("all_tokens"))
    one = F.lit(1.0)
    return sums.select(
        "size_i", "size_j", "shared", "all_tokens",
        (F.col("size_i") - F.col("shared")).alias("only_i"), (F.col("size_j") - F.col("shared")).alias("only_j"),
        F.when(F.col("all_tokens") == 0, one).otherwise(F.col("shared") / F.col("all_tokens")).alias("jaccard"),
        F.when(F.col("size_i") == 0, one).otherwise(F.col("shared") / F.col("size_i")).alias("c_ij"),
        F.when(F.col("size_j") == 0, one).otherwise(F.col("shared") / F.col("size_j")).alias("c_ji"),
        (F.col("size_i") == F.col("shared")).alias("i_in_j"),
    )


def count_difference(a: DataFrame, b: DataFrame, symmetric: bool = False) -> DataFrame:
    """``count_difference_of`` two count tables."""
    return count_difference_of(side_counts(sides(a.select("token", "cnt"), b.select("token", "cnt"))), symmetric)


def count_difference_of(counts: DataFrame, symmetric: bool = False) -> DataFrame:
    """(side, token, delta) of ``side_counts``: what side i has more (or, with ``symmetric``, also what j has), a token missing on the other side whole."""
    sums = counts.filter((F.col("ci") > 0) | (F.col("cj") > 0))
    delta = F.col("ci") - F.col("cj")
    changed = sums.filter((delta != 0) & (F.lit(symmetric) | (F.col("ci") > 0)))
    present = F.array_compact(F.array(
        F.when(F.col("ci") > 0, F.struct(F.lit("i").alias("side"), delta.alias("delta"))),
        F.when(F.lit(symmetric) & (F.col("cj") > 0), F.struct(F.lit("j").alias("side"), (-delta).alias("delta"))),
    ))
    return changed.select("token", F.explode(present).alias("d")).select("d.side", "token", "d.delta")


def weighted_summary(a: DataFrame, b: DataFrame, parity: bool = False) -> DataFrame:
    """``weighted_summary_of`` two count tables."""
    return weighted_summary_of(side_counts(sides(a.select("token", "cnt"), b.select("token", "cnt"))), parity)


def weighted_summary_of(counts: DataFrame, parity: bool = False) -> DataFrame:
    """(j, wj, symdiff) of ``side_counts``. ``parity`` counts one shared token too many, as a merge that starts on a dummy does."""
    sums = counts.filter((F.col("ci") > 0) | (F.col("cj") > 0))
    shared = F.count_if((F.col("ci") > 0) & (F.col("cj") > 0))
    extra = 1 if parity else 0
    t = sums.agg(shared.alias("s"), F.count("*").alias("n"), F.sum(F.least("ci", "cj")).alias("lo"), F.sum(F.greatest("ci", "cj")).alias("hi"))
    return t.select(
        F.when(F.col("n") + extra == 0, F.lit(1.0)).otherwise((F.col("s") + extra) / (F.col("n") + extra)).alias("j"),
        F.when(F.coalesce("hi", F.lit(0)) == 0, F.lit(1.0)).otherwise(F.col("lo") / F.col("hi")).alias("wj"),
        (F.col("n") - F.col("s")).alias("symdiff"),
    )


def pairwise(sets: DataFrame, key: str, upper: bool = True) -> DataFrame:
    """(key_i, key_j, size_i, size_j, shared, jaccard) of all pairs of groups, for a moderate number of groups.

    Tokens are grouped once; different sets of groups, with how many tokens have each, are few, and give all sizes and shared numbers. A null
    group is none.
    """
    # Dealt out by token, rows need no second shuffle for what is grouped by token.
    groups = sets.select(key, "token").repartition("token").groupBy("token").agg(F.array_sort(F.collect_set(key)).alias("keys"))
    kinds = groups.groupBy("keys").agg(F.count("*").alias("n"))
    sizes = kinds.select("n", F.explode("keys").alias(key)).groupBy(key).agg(F.sum("n").alias("size"))
    first = kinds.filter(F.size("keys") > 1).select("n", "keys", F.posexplode("keys").alias("at", f"{key}_i"))
    later = first.select("n", f"{key}_i", F.explode(F.slice("keys", F.col("at") + 2, F.size("keys"))).alias(f"{key}_j"))
    shared = later.groupBy(f"{key}_i", f"{key}_j").agg(F.sum("n").alias("shared"))
    i, j = (sizes.select(F.col(key).alias(f"{key}_{s}"), F.col("size").alias(f"size_{s}")) for s in "ij")
    order = F.col(f"{key}_i") < F.col(f"{key}_j")
    every = i.join(j, order)  # the groups themselves: small, whatever their sets
    out = every.join(shared, [f"{key}_i", f"{key}_j"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    out = out.withColumn("jaccard", F.col("shared") / (F.col("size_i") + F.col("size_j") - F.col("shared")))
    if upper:
        return out
    swapped = out.select(F.col(f"{key}_j").alias(f"{key}_i"), F.col(f"{key}_i").alias(f"{key}_j"), F.col("size_j").alias("size_i"), F.col("size_i").alias("size_j"), "shared", "jaccard")
    same = sizes.select(F.col(key).alias(f"{key}_i"), F.col(key).alias(f"{key}_j"), F.col("size").alias("size_i"), F.col("size").alias("size_j"), F.col("size").alias("shared"), F.lit(1.0).alias("jaccard"))
    return out.unionByName(swapped).unionByName(same)


def capacity(pairs: DataFrame) -> DataFrame:
    """The largest difference of any pair: the keys a sketch must list."""
    return pairs.agg(F.max(F.col("size_i") + F.col("size_j") - 2 * F.col("shared")).alias("capacity"))


def lookup(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """The tokens with their counts, 0 if absent."""
    return tokens.join(counts, "token", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def counters_of_reads(reads: DataFrame, counts: DataFrame, k: int, key: str, seq: str = "seq", canonical: bool = False) -> DataFrame:
    """(key, counters): the count of each window of a read, in order; 0 for an unknown one or one with other than bases."""
    from setweave.operators.fragments import windows

    token = dna.canonical(F.col("token")) if canonical else F.col("token")
    seen = lookup(windows(reads.select(key, seq), k, seq).withColumn("token", token), counts)
    return seen.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "cnt"))).alias("c")).select(key, F.col("c.cnt").alias("counters"))


def query_split(files: DataFrame, name: str, share: float | None = None, k: int | None = None, seed: int = 42) -> DataFrame:
    """Each name as query or reference: a fixed choice by hash, of k or a share; all are references too if all are queries."""
    order = Window.orderBy(F.xxhash64(F.lit(seed), F.col(name)), F.col(name))
    ranked = files.select(name).distinct().withColumn("rank", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy()))
    most = F.lit(k) if k is not None else F.ceil(F.lit(share) * F.col("n"))
    return ranked.select(name, (F.col("rank") <= most).alias("is_query"), ((F.col("rank") > most) | (most >= F.col("n"))).alias("is_reference"))
