"""Writing tokens, sketches and results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.functions.planning import IbltSpec
from setweave.sources.readers import pack_minhash, pack_sketch, pack_weighted


def fasta_lines(df: DataFrame, seq: str = "token", name: str | None = None) -> DataFrame:
    """(value): a FASTA record for each row, named by a column or by running numbers in the rows' order of partitions."""
    label = F.col(name).cast("string") if name else F.monotonically_increasing_id().cast("string")
    return df.select(F.concat(F.lit(">"), label, F.lit("\n"), F.col(seq)).alias("value"))


def write_fasta(df: DataFrame, path: str, seq: str = "token", name: str | None = None) -> None:
    fasta_lines(df, seq, name).write.text(path)


def write_tokens(df: DataFrame, path: str) -> None:
    df.select("token").write.text(path)


def write_counts(df: DataFrame, path: str, sep: str = ",") -> None:
    df.select("token", "cnt").write.csv(path, sep=sep)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


def debug_lines(positions: DataFrame, sequences: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """(key, value): each sequence, and on the next line its positions."""
    return sequences.join(positions, key, "left").select(key, F.concat(F.col(seq), F.lit("\n"), F.concat_ws(",", F.transform(F.coalesce("positions", F.array().cast("array<bigint>")), lambda p: p.cast("string")))).alias("value"))


def write_cells(cells: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A sketch as Parquet: the form in which sketches are merged and subtracted."""
    w = cells.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file in any store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def sketch_bytes(cells: DataFrame, spec: IbltSpec) -> bytes:
    """A sketch as its file; its size follows from ``spec``, not from the data."""
    found = cells.select("row", "col", "counter", *spec.words).toArrow()
    row, col, counter, *words = (found.column(c).to_numpy() for c in found.column_names)
    return pack_sketch(spec.r, spec.epsilon, spec.chunk, spec.length, spec.seeds, row, col, counter, np.stack(words, axis=1))


def minhash_bytes(sketch: DataFrame, seed: int) -> bytes:
    return pack_minhash(seed, [bytes(r["h"]) for r in sketch.select("h", "rank").orderBy("rank").toLocalIterator()])


def weighted_bytes(sketch: DataFrame, seed: int, k: int) -> bytes:
    return pack_weighted(seed, k, [tuple(r[c] & (1 << 64) - 1 for c in ("lo", "hi")) for r in sketch.select("lo", "hi", "rank").orderBy("rank").toLocalIterator()])
