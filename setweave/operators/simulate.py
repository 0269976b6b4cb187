"""Random sequences and their mutants.

Each record has its own random stream, seeded by seed and record number, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.functions.kernels import codes
from setweave.functions.planning import OptionError

LOG = "seq string, mr double, idf double, ep double, s long, i long, d long, tidl long"
_LETTERS = np.frombuffer(b"ACGTN", np.uint8)


def mutate_one(seq: bytes, rate: float, indels: float, extend: float, rng: np.random.Generator) -> tuple[bytes, int, int, int, int]:
    """A mutant, its numbers of substitutions, insertions and deletions, and the net length of its indels.

    Every base outside a running deletion mutates with probability ``rate``: into one of the three others, or, for a share ``indels``, into an
    insertion (in its place) or a deletion of geometric length.
    """
    code = codes(seq)
    hit = np.flatnonzero((code < 4) & (rng.random(len(code)) < rate))
    parts, at, subs, ins, dels, net = [], 0, 0, 0, 0, 0
    for p in hit.tolist():
        if p < at:
            continue
        parts.append(_LETTERS[code[at:p]])
        if rng.random() >= indels:
            parts.append(_LETTERS[[(code[p] + 1 + int(rng.integers(3))) & 3]])
            subs, at = subs + 1, p + 1
            continue
        length = int(rng.geometric(1 - extend)) if extend < 1 else 1
        if rng.random() < 0.5:
            dels, net, at = dels + 1, net - length, p + length
        else:
            parts.append(_LETTERS[rng.integers(0, 5, length)])
            ins, net, at = ins + 1, net + length, p + 1
    parts.append(_LETTERS[code[at:]])
    return np.concatenate(parts).tobytes(), subs, ins, dels, net


def mutate(df: DataFrame, rate: float = 0.05, indels: float = 0.15, extend: float = 0.3, seed: int = 42, key: str = "rec_no", seq: str = "seq", random_rates: bool = False) -> DataFrame:
    """The records' keys with their mutants and logs. With ``random_rates`` the three parameters are bounds, drawn anew for each record."""
    if not (0 <= rate <= 1 and 0 <= indels <= 1 and 0 <= extend < 1):
        raise OptionError("rates are shares")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, s in zip(b.column("key").to_pylist(), b.column("seq").cast(pa.binary()).to_pylist(), strict=True):
                rng = np.random.default_rng((seed, k & (1 << 63) - 1))
                m, i, e = (x * rng.random() if random_rates else x for x in (rate, indels, extend))
                new, *counts = mutate_one(s or b"", m, i, e, rng)
                out.append((k, new, m, i, e, *counts))
            columns = list(zip(*out, strict=True)) or [()] * 9
            kinds = (pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), *(pa.int64(),) * 4)
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            arrays[1] = arrays[1].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "seq", "mr", "idf", "ep", "s", "i", "d", "tidl"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(seq).alias("seq")).mapInArrow(run, f"key long, {LOG}").withColumnRenamed("key", key)


def random_sequences(spark: SparkSession, n: int, length: int, seed: int = 42) -> DataFrame:
    """(rec_no, seq): n random sequences over ACGT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("rec_no").to_pylist()
            made = [_LETTERS[np.random.default_rng((seed, i)).integers(0, 4, length)].tobytes().decode() for i in ids]
            yield pa.RecordBatch.from_arrays([b.column("rec_no"), pa.array(made, pa.string())], names=["rec_no", "seq"])

    return spark.range(n).withColumnRenamed("id", "rec_no").mapInArrow(run, "rec_no long, seq string")


def founder_and_mutants(spark: SparkSession, n: int, length: int, rate: float = 0.01, indels: float = 0.15, extend: float = 0.3, seed: int = 42) -> DataFrame:
    """(rec_no, seq): a random founder, number 0, and n mutants of it."""
    founder = random_sequences(spark, 1, length, seed)
    copies = founder.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("rec_no"), "seq")
    return founder.unionByName(mutate(copies, rate, indels, extend, seed).select("rec_no", "seq"))
