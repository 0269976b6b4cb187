"""Sketches of streams: the cells of a table, distinct tokens, bottom-s sets.

A table's cells are sums and XORs, so a stream of insertions and deletions keeps them up to date in any order. Spark's state
store makes each micro-batch count once, also when it is run again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from setweave.functions import dna
from setweave.functions.planning import IbltSpec
from setweave.functions.session import fresh_folder
from setweave.operators.iblt import addresses, packed_words
from setweave.operators.minhash import least_of_batches


def stream_cells(tokens: DataFrame, spec: IbltSpec, sign: Column | None = None) -> DataFrame:
    """Cells over all tokens so far, for the update or complete mode. A token may come once (with sign -1, be taken out again)."""
    token = F.col("token")
    kept = tokens.filter(dna.is_genomic(token) & (F.length(token) == spec.length))
    rows = kept.select(*packed_words(token, spec), (F.lit(1) if sign is None else sign).cast("long").alias("counter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [b.column(w).to_numpy(zero_copy_only=False).astype(np.int64) for w in spec.words]
            counter = b.column("counter").to_numpy(zero_copy_only=False)
            keys = np.stack(words, axis=1) if len(words) > 1 else words[0]
            cols = addresses(keys.view(np.uint64), spec)
            row = np.tile(np.arange(spec.r, dtype=np.int32), len(keys))
            each = (pa.array(np.repeat(x, spec.r)) for x in (counter, *words))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(cols.ravel()), *each], names=["row", "col", "counter", *spec.words])

    cells = rows.mapInArrow(run, ", ".join(["row int, col bigint, counter bigint", *(f"{w} bigint" for w in spec.words)]))
    return cells.groupBy("row", "col").agg(F.sum("counter").alias("counter"), *(F.bit_xor(w).alias(w) for w in spec.words))


def stream_distinct(tokens: DataFrame, event_time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Each token once; with an event time, once within a watermark, so that state stays bounded."""
    if event_time is None:
        return tokens.dropDuplicates(["token"])
    return tokens.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["token"])


def stream_bottom(tokens: DataFrame, s: int, width: int = 8, seed: int = 42) -> DataFrame:
    """(rank, h): the s smallest different hashes so far, those of ``minhash.sketch``, whole after each batch, for the update mode.

    The state is s hashes, whatever the stream's length; batches are cut to their s smallest before they meet.
    """

    def merge(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = bytes(state.get[0]) if state.exists else b""
        have = {kept[i : i + width] for i in range(0, len(kept), width)}
        for f in frames:
            have = set(heapq.nsmallest(s, have.union(map(bytes, f["h"]))))
        hs = sorted(have)
        state.update((b"".join(hs),))
        yield pd.DataFrame({"rank": np.arange(1, len(hs) + 1, dtype=np.int32), "h": hs})

    least = least_of_batches(tokens, s, width, seed).withColumn("all", F.lit(0))
    return least.groupBy("all").applyInPandasWithState(merge, "rank int, h binary", "hs binary", "update", GroupStateTimeout.NoTimeout)


def read_table_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table's file as a stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is and return its result, a table in the shared folder: in complete mode that of the last batch, in update mode that of the last batch with rows, in append mode all."""
    if mode not in ("complete", "update", "append"):
        raise ValueError("complete, update or append mode")
    spark = stream.sparkSession
    folder, done = fresh_folder(spark, name), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/{number}")
        if mode != "update" or not spark.read.schema(stream.schema).parquet(f"{folder}/result/{number}").isEmpty():
            done.append(number)

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    paths = [f"{folder}/result/{n}" for n in (sorted(set(done)) if mode == "append" else done[-1:])]
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)
