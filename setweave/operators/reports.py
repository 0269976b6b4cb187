"""Tables of experiment results: joins, reshaping, means, errors; and the experiments that make them."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setweave.functions import dna
from setweave.functions.planning import IbltSpec
from setweave.functions.session import checkpointed
from setweave.functions.kernels import minimizer_positions, syncmer_positions
from setweave.operators import exchange, fragments, iblt, sets


def join_results(*tables: DataFrame, on: tuple[str, ...] = ("reference", "query")) -> DataFrame:
    """Result tables side by side; each has one row for each value of ``on``."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, list(on), "inner")
    return out


def stack(*tables: DataFrame) -> DataFrame:
    """Result tables one below the other; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def group_mean(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Means that pass over nulls and NaN."""
    return df.groupBy(*by).agg(*(F.avg(F.when(~F.isnan(F.col(v).cast("double")), F.col(v))).alias(v) for v in values))


def group_missing(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.sum(F.col(v).isNull().cast("int")).alias(v) for v in values))


def complete(df: DataFrame, peelable: str | None = None) -> DataFrame:
    """Rows without nulls, and with ``peelable``, only those whose sketch could be listed."""
    out = df.na.drop()
    return out if peelable is None else out.filter(F.col(peelable))


def errors(df: DataFrame, exact: str, estimates: list[str], digits: int = 3) -> DataFrame:
    """Adds each estimate's absolute error, rounded."""
    return df.select("*", *(F.round(F.abs(F.col(e) - F.col(exact)), digits).alias(f"{e}_error") for e in estimates))


def trial_summary(df: DataFrame, by: list[str], exact: str, estimates: list[str]) -> DataFrame:
    """Mean of each estimate, its mean squared error and the variance of its error over trials."""
    parts = []
    for e in estimates:
        error = F.col(e) - F.col(exact)
        parts += [F.avg(e).alias(f"{e}_mean"), F.avg(error * error).alias(f"{e}_mse"), F.var_pop(error).alias(f"{e}_var")]
    return df.groupBy(*by).agg(F.avg(exact).alias(f"{exact}_mean"), *parts)


def describe(df: DataFrame, column: str) -> DataFrame:
    """(statistic, value): count, mean, standard deviation, extremes and quartiles."""
    c = F.col(column).cast("double")
    names = ("count", "mean", "stddev", "min", "25%", "50%", "75%", "max")
    values = (F.count(c).cast("double"), F.avg(c), F.stddev_samp(c), F.min(c), *(F.percentile(c, p) for p in (0.25, 0.5, 0.75)), F.max(c))
    one = df.agg(*(v.alias(f"s{i}") for i, v in enumerate(values)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("statistic"), F.col(f"s{i}").alias("value")) for i, n in enumerate(names)))).alias("x")).select("x.*")


def in_list(files: DataFrame, names: DataFrame, path: str = "path", name: str = "name") -> DataFrame:
    """The files whose stem is in a list of names."""
    return files.join(names.select(F.col(name).alias("__name")), dna.file_stem(F.col(path)) == F.col("__name"), "left_semi")


def pretty(listed: DataFrame) -> DataFrame:
    return listed.select("side", "token").orderBy("side", "token")


def total_length(df: DataFrame, seq: str = "seq", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.sum(F.length(seq)), F.lit(0)).cast("long").alias("total_length"))


def similarity_by_method(sides: DataFrame, k: int, z: int, rate: int = 1, seq: str = "seq") -> DataFrame:
    """(method, jaccard): exact k-mers, sampled k-mers, minimizers and syncmers of two sides: a column ``side``, or a flag for each in ``in_i`` and ``in_j``.

    Up to 31 bases, all four come from one exchange of packed k-mers; case is folded there, and U counts as T.
    """
    if k <= 31 and "in_i" in sides.columns:
        found = exchange.marks(sides, k, [lambda s: minimizer_positions(s, k, k - z + 1), lambda s: syncmer_positions(s, k, z)], seq)
        kept = fragments.in_sample(F.col("token"), max(1, rate), bases=k)
        bits = {"exact": 0, "sampled": 0, "minimizers": 2, "syncmers": 4}
        has = {name: F.shiftright("mask", bit).bitwiseAND(F.lit(3)) for name, bit in bits.items()} | {"sampled": F.when(F.col("kept"), F.col("mask").bitwiseAND(F.lit(3))).otherwise(0)}
        sums = found.withColumn("kept", kept).agg(*(F.struct(F.lit(name).alias("method"), F.count_if(h == 3).alias("s"), F.count_if(h != 0).alias("n")).alias(name) for name, h in has.items()))
        each = sums.select(F.explode(F.array(*has)).alias("x")).select("x.*")
        return each.select("method", F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.col("s") / F.col("n")).alias("jaccard"))
    rows = sides.select("side", seq)
    token_sets = {
        "exact": fragments.kmers(rows, k, seq),
        "sampled": fragments.hash_sample(fragments.kmers(rows, k, seq), max(1, rate)),
        "minimizers": fragments.minimizers(rows, k, w=k - z + 1, seq=seq),
        "syncmers": fragments.syncmers(rows, k, z, seq=seq),
    }
    out = None
    for name, tokens in token_sets.items():
        one = sets.set_summary(tokens.select("side", "token").distinct()).select(F.lit(name).alias("method"), "jaccard")
        out = one if out is None else out.unionByName(one)
    return out


def extended_covers(sides: DataFrame, k: int, z: int, g: int, seq: str = "seq") -> DataFrame:
    """(missing): k-mers of the exact difference that the difference of extended syncmers does not hold; 0 if it covers all.

    Sides are a column ``side``, or a flag for each in ``in_i`` and ``in_j``; with flags, and up to 27 bases in all, both differences come from exchanges of packed tokens,
    where case is folded, U counts as T, and all else is one letter.
    """
    if k + g <= 27 and "in_i" in sides.columns:
        left = exchange.covered(sides, k, g, lambda s: syncmer_positions(s, k, z), seq)
        side = F.col("mask").bitwiseAND(F.lit(3))
        return left.agg(F.count_if(side.isin(1, 2) & (F.shiftright("mask", 2).bitwiseAND(side) == 0)).alias("missing"))
    exact = sets.symmetric_difference(fragments.kmers(sides.select("side", seq), k, seq).select("side", "token").distinct())
    listed = sets.symmetric_difference(fragments.syncmers(sides.select("side", seq), k, z, g, seq=seq).select("side", "token").distinct())
    found = fragments.unpack_extended(listed, k, ["side"])
    return exact.join(found, ["side", "token"], "left_anti").agg(F.count("*").alias("missing"))


def sketch_experiment(a: DataFrame, b: DataFrame, spec: IbltSpec) -> dict[str, float | int | bool | None]:
    """Build, subtract and list two token sets; seconds of each step, bytes, sizes and similarity."""
    out: dict[str, float | int | bool | None] = {"ibfsize": spec.sketch_bytes}
    began = time.perf_counter()
    cells_a = checkpointed(iblt.build(a, spec))
    out["obtime"] = time.perf_counter() - began
    began = time.perf_counter()
    cells_b = checkpointed(iblt.build(b, spec))
    out["mbtime"] = time.perf_counter() - began
    began = time.perf_counter()
    row = iblt.jaccard(cells_a, cells_b, spec).first()
    out["ltime"] = time.perf_counter() - began
    return out | row.asDict()


def rate_of(df: DataFrame, j: str, k: int) -> DataFrame:
    rate: Column = dna.mutation_rate(F.col(j), k)
    return df.withColumn("mutation_rate", rate)
