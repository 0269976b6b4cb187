"""Reconciling two collections of sequences: which members of either side the other lacks.

Every member gets a bottom-s sketch. Within a side, members with the sketch of another are duplicates; across, those with a common
sketch are in both. A sketch is a sample, so members that differ little may share one; where their contents are given, these must agree too. What is left is told from a difference of two small invertible tables over sketch digests, as two parties
would that exchange nothing else.

``sequence_digests`` makes sketch and digest of a whole sequence where its row is, so that no k-mer is exchanged; ``digests`` are of sketches of any tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setweave.functions import dna
from setweave.functions.hashing import U, murmur_x64
from setweave.functions.kernels import letters
from setweave.functions.planning import IbltSpec, OptionError, UnpeelableError
from setweave.functions.session import checkpointed
from setweave.operators.exchange import slices, windows_of
from setweave.operators.iblt import _cells, addresses_of, key_of, list_any
from setweave.operators.minhash import sketch

#: A digest fills the 62 bits of a key of 31 bases.
DIGEST_LENGTH = 31
#: Tokens that are hashed at once, and how often a table that can't be listed is doubled.
HASHED, DOUBLINGS = 1 << 17, 16


def digests(sketches: DataFrame, side: str, name: str, contents: DataFrame | None = None) -> DataFrame:
    """(side, name, key): one packed key for each member's whole sketch, and for its ``contents`` (side, name, content) where these are given."""
    whole = sketches.groupBy(side, name).agg(F.array_sort(F.collect_list(F.struct("rank", "h"))).alias("s"))
    told = [F.transform("s", lambda x: F.hex(x["h"]))]
    if contents is not None:
        own = contents.groupBy(F.col(side).alias("__side"), F.col(name).alias("__name")).agg(F.array_sort(F.collect_list(F.sha2("content", 256))).alias("__own"))
        whole = whole.join(own, F.col(side).eqNullSafe(F.col("__side")) & F.col(name).eqNullSafe(F.col("__name")), "left")
        told.append(F.col("__own"))
    return whole.select(side, name, F.shiftleft(F.xxhash64(*told).bitwiseAND(F.lit((1 << 62) - 1)), 2).alias("key"))


def placed_hashes(token: np.ndarray, pos: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The hashes of packed k-mers with their positions, written ``ACGT/12``."""
    out = np.zeros(len(token), U)
    for begin in range(0, len(token), HASHED):
        own, at = token[begin : begin + HASHED], pos[begin : begin + HASHED]
        digits = np.searchsorted(10 ** np.arange(1, 19), at, side="right") + 1
        for n in np.unique(digits).tolist():
            some = np.flatnonzero(digits == n)
            rows = np.empty((len(some), k + 1 + n), np.uint8)
            rows[:, :k], rows[:, k], left = letters(own[some], k), ord("/"), at[some]
            for i in range(k + n, k, -1):
                rest = left // 10
                rows[:, i], left = left - 10 * rest + ord("0"), rest
            out[begin + some] = murmur_x64(rows, seed)[0]
    return out


def _least(h: np.ndarray, s: int) -> np.ndarray:
    """The s smallest different hashes, ascending."""
    most = s
    while True:
        found = np.unique(np.partition(h, most - 1)[:most] if most < len(h) else h)
        if len(found) >= s or most >= len(h):
            return found[:s]
        most *= 2


def least_of_sequences(raws: list[bytes], k: int, s: int, width: int = 8, seed: int = 42) -> list[np.ndarray]:
    """For each sequence the s smallest different hashes of its k-mers with their positions, as ``sketch`` has them; none without a k-mer."""
    out = [np.zeros(0, U)] * len(raws)
    for row, pos, token in windows_of(raws, k):
        h = placed_hashes(token, pos, k, seed).byteswap() >> U(8 * (8 - width))  # ascending as bytes
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(row)], strict=False):
            out[row[a]] = _least(np.concatenate((out[row[a]], h[a:b])), s)
    return out


def sequence_digests(rows: DataFrame, k: int, s: int = 1000, width: int = 8, seed: int = 42, seq: str = "seq") -> DataFrame:
    """The other columns and ``key``, for each row with a k-mer of up to 31 bases: one packed key for the whole sketch of the sequence's k-mers with their positions, and for
    its content. Case is folded, U counts as T in the k-mers, not in the content."""
    if not 1 <= width <= 8:
        raise OptionError("hashes of 1 to 8 bytes")
    if s < 1:
        raise OptionError("a sketch has at least one hash")
    rest = [c for c in rows.columns if c not in (seq, "key")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raws = b.column("__seq").cast(pa.binary()).fill_null(b"").to_pylist()
            at, keys = [], []
            for i, h in enumerate(least_of_sequences(raws, k, s, width, seed)):
                if len(h):
                    own = np.ascontiguousarray(h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]).tobytes()
                    told = hashlib.sha256(own + hashlib.sha256(raws[i]).digest()).digest()
                    at.append(i)
                    keys.append(int.from_bytes(told[:8], "big") << 2 & (1 << 64) - 1)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in rest), pa.array(np.array(keys, U).view(np.int64))], names=[*rest, "key"])

    shape = T.StructType([*(rows.schema[c] for c in rest), T.StructField("key", T.LongType())])
    return rows.select(*rest, F.col(seq).alias("__seq")).mapInArrow(run, shape)


def reconcile(tokens: DataFrame, n: int, *, side: str = "side", name: str = "name", s: int = 1000, width: int = 8, seed: int = 42, r: int = 3, epsilon: float = 0.0, contents: DataFrame | None = None) -> DataFrame:
    """``reconcile_keys`` of members given by their tokens.

    With ``contents`` (side, name, content), members are alike only if their whole contents are equal too; without, equal sketches are enough.
    """
    return reconcile_keys(digests(sketch(tokens, s, width, seed, (side, name)), side, name, contents), n, side=side, name=name, seed=seed, r=r, epsilon=epsilon)


def reconcile_keys(keys: DataFrame, n: int | None = None, *, side: str = "side", name: str = "name", seed: int = 42, r: int = 3, epsilon: float = 0.0) -> DataFrame:
    """(side, name, status) of the members (side, name, key) of sides i and j: duplicate (of an earlier one of its side, by name), common, or only (found in the difference of the tables).

    The tables are for ``n`` differing keys, or for as many as there are, and are doubled until the difference can be listed and lists the members that the exact comparison does.
    """
    keys = checkpointed(keys.select(side, name, "key"))
    in_i, in_j = F.col("in_i"), F.col("in_j")
    firsts = (F.min(F.when(F.col(side) == x, F.col(name))).alias(f"first_{x}") for x in "ij")
    members = checkpointed(keys.groupBy("key").agg(*(F.bool_or(F.col(side) == x).alias(f"in_{x}") for x in "ij"), *firsts))
    unique = members.select("key", F.explode(F.array_compact(F.array(*(F.when(x, F.lit(y).cast("long")) for x, y in ((in_i, 1), (in_j, -1)))))).alias("counter"))
    exact = members.filter(in_i != in_j).select("key", F.when(in_i, "i").otherwise("j").alias("own"))
    n = max(1, exact.count()) if n is None else n
    for _ in range(DOUBLINGS):
        spec = IbltSpec(DIGEST_LENGTH, n, r, epsilon, seed)
        rows = unique.select("key", "counter", F.explode(addresses_of(key_of(spec), spec)).alias("a")).select("key", "counter", "a.row", "a.col")
        only = checkpointed(list_any(_cells(rows, spec, ()), spec).select(dna.pack(F.col("token"), DIGEST_LENGTH).alias("found"), F.col("side").alias("found_side")))
        both = exact.join(only, (F.col("key") == F.col("found")) & (F.col("own") == F.col("found_side")), "full_outer")
        if both.filter("key is null or found is null").isEmpty():
            break
        n *= 2
    else:
        raise UnpeelableError("the collections differ in more members than the table can list")
    # Written out, so that the join with all members has an exchange on both sides and a key of many copies can be split.
    told = checkpointed(members.join(only, F.col("key") == F.col("found"), "left").select("key", "first_i", "first_j", "found"))
    first = F.when(F.col(side) == "i", F.col("first_i")).otherwise(F.col("first_j"))
    status = F.when(F.col(name) != first, "duplicate").when(F.col("found").isNotNull(), "only").otherwise("common")
    return keys.join(told, "key").select(side, name, status.alias("status"))


def common(keys: DataFrame, side: str = "side", name: str = "name") -> DataFrame:
    """(name_i, name_j): members of the two sides with the same sketch."""
    a, b = (keys.filter(F.col(side) == x).select(F.col(name).alias(f"{name}_{x}"), "key") for x in "ij")
    return a.join(b, "key").select(f"{name}_i", f"{name}_j")
