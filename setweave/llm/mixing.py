"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share, by weight, of ``budget`` times all words, at most ``cap`` times its own
words; what a capped source cannot take is shared again by weight until none is above. That is
min(cap * size, level * weight) for the one level at which the targets add up, found in a few passes
over the table of sources.

A source with target / size = whole + part takes ``whole`` certain copies of each of its documents. For the
part, which is ``need`` words, a document of ``size`` words is included with probability p = min(1, c * (size + 1) ** length_power), c being the one number per source with
which sizes times probabilities add up to the need; it follows from a table of the source's sizes. Documents get the rank odds(U) / odds(p), U being uniform by a hash of
seed, id and text, and are taken in order of rank until the need is reached; those with p = 1 come first. Of the
documents not taken, the one that best closes the remaining gap is taken too. ``inclusion`` is whole + p, the expected number of copies.

A source may hold most rows. Sizes and ranks are therefore counted first, ranks in 1024 wide bins and then, where the cut falls, in 1024 finer ones (partial aggregation);
only the fine bin in which the cut falls is sorted. The cut and the closing document, one row per source, are all
that selection needs, and rows are decided on their own values.

Defined results: a null text has size 0, and a document of size 0 takes 0 words; null is a source of its
own, last in order; rows that agree in id and text share their rank and are taken together; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setweave.llm.common import maybe_broadcast, ordinal, save, word_count

WEIGHTS = (5.0, 2.0, 1.0)
BINS, FINE = 1 << 20, 10


def uniform(seed: int, *cols: Column) -> Column:
    """In the open interval (0, 1), from a hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12) + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """Of (source, size): source, source_size, n_docs, target. Sources in code-point order, null last, weigh as ``weights``, repeating."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    placed = ordinal(totals, [F.col("source").asc_nulls_last()], "place")
    table = save(placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))).drop("place"), "mix-sources")
    s, w = cap * F.col("source_size"), F.col("weight")
    words, weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    total = budget * (words or 0)
    level = total / weight if weight else 0.0
    while True:
        full, rest = table.agg(F.sum(F.when(s <= level * w, s)), F.sum(F.when(s > level * w, w))).first()
        if not rest:
            break
        higher = (total - (full or 0.0)) / rest
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return table.withColumn("target", F.least(s, level * w)).drop("weight")


def _calibrated(sizes: DataFrame, shares: DataFrame, power: float) -> DataFrame:
    """The sources with ``scale``: the c with which the words of min(1, c * (size + 1) ** power) of each document add up to ``need``."""
    kinds = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    kinds = kinds.withColumn("words", F.col("n") * F.col("size")).withColumn("grown", F.pow(F.col("size") + 1, power))
    side = shares.select(F.col("source").alias("__source"), "source_size", "need")
    upto = Window.partitionBy("source").orderBy("size")
    rows = kinds.join(maybe_broadcast(side), F.col("source").eqNullSafe(F.col("__source")))
    rows = rows.withColumn("open", F.sum(F.col("words") * F.col("grown")).over(upto)).withColumn("rest", F.col("need") - F.col("source_size") + F.sum("words").over(upto))
    # If sizes up to this one are not certain and larger ones are, the scale is rest / open; the largest size for which that fits is the border.
    fits = rows.filter((F.col("need") > 0) & (F.col("open") > 0) & (F.col("rest") > 0) & (F.col("rest") / F.col("open") * F.col("grown") <= 1))
    found = fits.groupBy("source").agg(F.max_by(F.col("rest") / F.col("open"), "size").alias("scale")).withColumnRenamed("source", "__source")
    return shares.join(maybe_broadcast(save(found, "mix-borders")), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source").withColumn("scale", F.coalesce("scale", F.when(F.col("need") > 0, F.lit(1.0)).otherwise(0.0)))


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = 1.5,
    cap: float = 2.0,
    seed: int = 42,
    length_power: float = 0.5,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: the id, ``size``, ``source_size``, ``target``, ``inclusion``, ``copies``, ``taken`` and the carried columns (in one struct)."""
    own = F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    slim = save(docs.select(*own), "mix-sizes")
    shares = targets(slim.select("source", "size"), weights, budget, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = save(
        shares.withColumn("whole", F.floor(ratio + 1e-9))
        .withColumn("part", F.greatest(F.lit(0.0), ratio - F.col("whole")))
        .withColumn("need", F.col("part") * F.col("source_size")),
        "mix-shares",
    )
    shares = save(_calibrated(slim, shares, length_power), "mix-scales")

    def ranked(rows: DataFrame, side: DataFrame) -> DataFrame:
        """Add ``rank``, which orders as odds(U) / inclusion odds does and lies in (0, 1) for any part."""
        side = side.withColumnRenamed("source", "__source")
        joined = rows.join(maybe_broadcast(side), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
        u, p = uniform(seed, F.col("id"), F.col("mark")), F.least(F.lit(1.0), F.col("scale") * F.pow(F.col("size") + 1, length_power))
        odds = u / (1 - u) * (1 - p)
        return joined.withColumn("p", F.coalesce(p, F.lit(0.0))).withColumn("rank", F.coalesce(odds / (odds + p), F.lit(1.0))).withColumn("bin", F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)).cast("int"))

    def cut_in(found: DataFrame, name: str) -> DataFrame:
        """Of (source, bin, words, need, before): the bin in which the words, with those before, reach the need, and the words below it."""
        running = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
        first = found.withColumn("upto", running).filter("upto >= need").groupBy("source").agg(F.min(F.struct("bin", "upto", "words")).alias("c"))
        return first.select("source", F.col("c.bin").alias(name), (F.col("c.upto") - F.col("c.words")).alias("below"))

    rows = ranked(slim, shares).filter("need > 0").select("source", "size", "need", "bin")
    wide = rows.groupBy("source", F.shiftright("bin", FINE).alias("bin")).agg(F.sum("size").alias("words"), F.first("need").alias("need")).withColumn("before", F.lit(0))
    high = save(cut_in(wide, "high").withColumnRenamed("source", "__high"), "mix-high")
    inner = rows.join(maybe_broadcast(high), F.col("source").eqNullSafe(F.col("__high")) & (F.shiftright("bin", FINE) == F.col("high")))
    fine = inner.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("need").alias("need"), F.first("below").alias("before"))
    cut_bin = save(cut_in(fine, "cut_bin"), "mix-bins")

    def beside(rows: DataFrame, side: DataFrame) -> DataFrame:
        side = side.withColumnRenamed("source", "__side")
        return rows.join(maybe_broadcast(side), F.col("source").eqNullSafe(F.col("__side")), "left").drop("__side")

    with_bins = save(beside(shares, cut_bin), "mix-cuts")
    order = F.struct("rank", "id", "mark")
    inside = ranked(slim, with_bins).filter("bin = cut_bin and need > 0")
    upto = F.col("below") + F.sum("size").over(Window.partitionBy("source").orderBy("rank", "id", "mark").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    cut = inside.withColumn("upto", upto).filter("upto <= need").groupBy("source").agg(F.max(order).alias("cut"), F.max("upto").alias("reached"))
    with_cut = save(beside(with_bins, cut).withColumn("gap", F.col("need") - F.coalesce("reached", "below")), "mix-cut")
    before = (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & F.coalesce(order <= F.col("cut"), F.lit(False)))
    left = F.abs(F.col("size") - F.col("gap"))
    closing = ranked(slim, with_cut).filter("need > 0").filter(~before & (left < F.col("gap"))).groupBy("source").agg(F.min(F.struct(left.alias("left"), F.col("rank"), F.col("id"), F.col("mark"))).alias("c"))
    final = save(beside(with_cut, closing.select("source", F.struct("c.rank", "c.id", "c.mark").alias("closing"))), "mix-final")

    rows = docs.select(*own, F.struct(*carry).alias("carried")) if carry else slim
    out = ranked(rows, final)
    chosen = (F.col("need") > 0) & (before | F.coalesce(order == F.col("closing"), F.lit(False)))
    copies = (F.col("whole") + F.coalesce(chosen, F.lit(False)).cast("long")).cast("long")
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("whole") + F.when(F.col("need") > 0, F.col("p")).otherwise(0.0)).alias("inclusion"), copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["carried"] if carry else [])
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each document as often as it was taken, with its own columns."""
    rows = mixture(docs, id_col, text_col, source_col, carry=tuple(docs.columns), **options)
    # A filter on copies would move into the join and repeat the rank's expression there; rows without a copy are left out after they are dealt.
    dealt = rows.select(F.explode_outer(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("__copy"), "carried")
    return dealt.filter("__copy is not null").select("carried.*")
