"""SimHash near-dedup with pigeonring filtering.

Two fingerprints at distance <= t have, of their m segments laid in a ring, a start from which every run of l
consecutive segments differs in at most l * t / m bits. So the chain's first segments (budget below 1) are equal, and
of the following ones, whose joint budget is 1, all but one are. Those equal segments make the keys under
which fingerprints meet: for t = 3 and m = 8, 24 keys of 32 bits. Where two meet, the differences summed along the chain
must stay within every budget; only then does the full distance count.

Only different fingerprints are compared: documents of one fingerprint are one class and count once. Of a
bucket's links a spanning forest is kept, which loses no connection and grows with the bucket, not with its square.
A bucket of over ``HOT`` members is dealt out as pairs of blocks, so no task gets it whole.

Defined results: a null text counts as empty; a text without words has fingerprint zero; fewer words than a shingle
needs make one shingle; repeated rows share a class; a null id never names a class that has another, and a class without any other has a null name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setweave.llm.common import maybe_broadcast, pieces, save, texts
from setweave.llm.components import components
from setweave.llm.repeats import mix

HOT = 20_000
#: Buckets up to this size are compared pair by pair; larger ones also count how dense their links are.
SMALL = 16


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64, seed 42, of each run of ``width`` words joined by spaces, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits, of rows of 64-bit words, that are set in over half the rows; one row of words."""
    hashes = hashes if hashes.ndim == 2 else hashes[:, None]
    counts = np.zeros(hashes.shape[1] * 64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = np.ascontiguousarray(hashes[at : at + (1 << 15)])
        counts += np.unpackbits(block.view(np.uint8).reshape(len(block), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each document, as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            found = np.array([majority(shingle_hashes(x, width))[0] for x in texts(b.column("text")).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.selectExpr(f"`{id_col}` AS id", f"cast(`{text_col}` AS string) AS text").mapInArrow(run, schema)


class Ring:
    """Segments, budgets and keys for fingerprints of 64 bits at distance <= ``tau``."""

    def __init__(self, tau: int, segments: int):
        if not 0 <= tau < segments <= 64:
            raise ValueError("a ring needs more segments than differences")
        self.tau, self.m = tau, segments
        cuts = [round(i * 64 / segments) for i in range(segments + 1)]
        self.masks = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.budgets = [(i + 1) * tau // segments for i in range(segments)]
        zero, one = self.budgets.count(0), self.budgets.count(1)
        #: (start of the chain, mask of the bits that are equal)
        self.variants: list[tuple[int, int]] = []
        for start in range(segments):
            seg = [self.masks[(start + i) % segments] for i in range(zero + one)]
            same, rest = sum(seg[:zero]), seg[zero:]
            self.variants += [(start, same + sum(rest) - drop) for drop in rest] if len(rest) > 1 else [(start, same)]
        #: Bits of the first l segments of the chain from each start.
        self.chain = np.array([[sum(self.masks[(s + i) % segments] for i in range(n + 1)) for n in range(segments)] for s in range(segments)], np.uint64)

    def near(self, differences: np.ndarray, start: np.ndarray | int) -> np.ndarray:
        """Places of differences that keep to every budget of the chain, the last of which is ``tau`` for the whole."""
        at = np.arange(len(differences))
        for n, most in enumerate(self.budgets):
            mask = self.chain[start if np.isscalar(start) else start[at], n]
            at = at[np.bitwise_count(differences[at] & mask) <= most]
        return at


def _forest(a: list[int], b: list[int]) -> list[int]:
    """Places of the edges that join two trees."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    out = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if (x := find(x)) != (y := find(y)):
            root[y] = x
            out.append(i)
    return out


def group_links(fp: np.ndarray, start: int, ring: Ring, test=None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one bucket's links, as places. ``test`` may reject pairs that keep to the chain."""
    n = len(fp)
    lefts, rights, found = [], [], 0
    dense = False
    step = max(1, (1 << 18) // n)
    for at in range(0, n, step):
        rows = fp[at : at + step]
        i, j = np.nonzero(np.tri(len(rows), n, at, dtype=bool) == 0) if n <= 512 else (np.repeat(np.arange(len(rows)), n), np.tile(np.arange(n), len(rows)))
        if n > 512:
            upper = j > i + at
            i, j = i[upper], j[upper]
        ok = ring.near(rows[i] ^ fp[j], start)
        i, j = i[ok] + at, j[ok]
        if test is not None and len(i):
            ok = test(i, j)
            i, j = i[ok], j[ok]
        found += len(i)
        if found > 8 * n:
            dense = True
            break
        lefts.append(i)
        rights.append(j)
    if not dense:
        i, j = np.concatenate(lefts), np.concatenate(rights)
        keep = _forest(i.tolist(), j.tolist())
        return i[keep], j[keep]
    # Many links: search outwards, so that a member already reached is never compared again.
    open_rows, lefts, rights = np.arange(n), [], []
    while len(open_rows):
        queue, open_rows = [open_rows[0]], open_rows[1:]
        while queue and len(open_rows):
            x = queue.pop()
            ok = ring.near(fp[open_rows] ^ fp[x], start)
            if test is not None and len(ok):
                ok = ok[test(np.full(len(ok), x), open_rows[ok])]
            if len(ok):
                new = open_rows[ok]
                lefts.append(np.full(len(new), x))
                rights.append(new)
                queue += new.tolist()
                open_rows = np.delete(open_rows, ok)
    return (np.concatenate(lefts), np.concatenate(rights)) if lefts else (np.zeros(0, np.int64),) * 2


def bucket_links(table: pa.Table, ring: Ring, test=None) -> pa.RecordBatch:
    """Links within the buckets of a sorted table (bucket, part, start, id, fp and what ``test`` reads); ``test(table)`` gives the test of pairs of rows."""
    bucket, part, start = (table.column(c).to_numpy() for c in ("bucket", "part", "start"))
    ids, fp = table.column("id").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
    test = test and test(table)
    new = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]) | (start[1:] != start[:-1])) + 1
    begin, end = np.concatenate(([0], new)), np.concatenate((new, [len(bucket)]))
    size = np.repeat(end - begin, end - begin)
    upto = np.repeat(end, end - begin)
    lefts, rights = [], []
    rows = np.flatnonzero((size > 1) & (size <= SMALL))
    for d in range(1, SMALL):
        rows = rows[rows + d < upto[rows]]
        if not len(rows):
            break
        ok = ring.near(fp[rows] ^ fp[rows + d], start[rows])
        i, j = rows[ok], rows[ok] + d
        if test is not None and len(i):
            ok = test(i, j)
            i, j = i[ok], j[ok]
        lefts.append(i)
        rights.append(j)
    for g in np.flatnonzero(end - begin > SMALL):
        a, b = begin[g], end[g]
        i, j = group_links(fp[a:b], int(start[a]), ring, None if test is None else lambda i, j, a=a: test(i + a, j + a))
        lefts.append(i + a)
        rights.append(j + a)
    i, j = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (lefts, rights))
    edges = np.unique(np.stack((np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j])), axis=1), axis=0)
    edges = edges[edges[:, 0] != edges[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])


def links(members: DataFrame, tau: int = 3, segments: int = 8, bins: str | None = None, extra: tuple[str, ...] = (), test=None, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect all ids of ``members`` (id, fp, ...) whose fingerprints differ in at most ``tau`` bits.

    Members may be told apart further by ``bins``, a column with an array of bins in which they may meet, and by
    ``test`` on ``extra`` columns. Fingerprints, or ids, need not be unique.
    """
    ring = Ring(tau, segments)
    return links_of(keyed(members, ring, bins, extra), ring, extra, test, hot)


def keyed(members: DataFrame, ring: Ring, bins: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, extra..., start, bucket): the rows under the keys at which fingerprints that the ring links meet."""
    variants = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("same")) for v, (s, m) in enumerate(ring.variants)))
    rows = members.select("id", "fp", *extra, *([F.explode(bins).alias("bin")] if bins else [F.lit(0).alias("bin")])).select("*", F.explode(variants).alias("x"))
    return rows.select("id", "fp", *extra, F.col("x.start").alias("start"), F.xxhash64("x.v", "bin", "x.same").alias("bucket"))


def links_of(rows: DataFrame, ring: Ring, extra: tuple[str, ...] = (), test=None, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect all ids of ``rows`` (id, fp, start, bucket, ...) that link within a bucket."""
    crowded = save(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > hot), "hot-buckets")
    if crowded.isEmpty():
        dealt = rows.withColumn("part", F.lit(0).cast("long"))
    else:
        blocks = F.ceil(F.col("n") / hot).cast("int")
        own = F.pmod(F.xxhash64("id", "fp"), blocks).cast("int")
        parts = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(own, j).cast("long") * (1 << 31) + F.greatest(own, j))
        dealt = rows.join(crowded, "bucket", "left").withColumn("part", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(parts))).drop("n")
    columns = ["bucket", "part", "start", "id", "fp", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows_held = bytes_held = 0
        for b in batches:
            held.append(b)
            rows_held += b.num_rows
            bytes_held += b.nbytes
            if rows_held < 1 << 16 and bytes_held < 64 << 20:
                continue
            table = pa.Table.from_batches(held)
            bucket, part = table.column("bucket").to_numpy(), table.column("part").to_numpy()
            last = np.flatnonzero((bucket != bucket[-1]) | (part != part[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if cut:
                yield bucket_links(table.slice(0, cut).combine_chunks(), ring, test)
            held = table.slice(cut).combine_chunks().to_batches()
            rows_held = bytes_held = 0
        if held:
            yield bucket_links(pa.Table.from_batches(held).combine_chunks(), ring, test)

    return dealt.select(*columns).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "start").mapInArrow(run, "a long, b long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, tau: int = 3, segments: int = 8) -> DataFrame:
    """One row per document: the id, ``fp`` and ``component_id``, the smallest id that links lead to."""
    prints = save(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = save(prints.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-classes")
    found = components(links(classes.select(F.col("fp").alias("id"), "fp"), tau, segments))
    rooted = classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Only classes with a link need their component's smallest id.
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = save(rooted.join(smallest, "root").select("fp", "component_id"), "fingerprint-labels")
    return prints.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


#: Bands of keys and least hashes in a key: two sets of Jaccard similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS.
BANDS, ROWS = 16, 4
_TIMES = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: its least hashes over a set of 64-bit hashes, mixed."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[at : at + (1 << 12), None] * _TIMES).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for x in least.reshape(BANDS, ROWS).T:
        key = mix(key ^ x)
    return key


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Of (id, text): (id, fp, keys, hashes), the fingerprint, the band keys and the set of 32-bit hashes of the shingles, ascending; without texts that have no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            prints, keys, sets, some = [], [], [], []
            for k, x in enumerate(texts(b.column("text")).cast(pa.binary()).to_pylist()):
                s = shingle_hashes(x, width)
                if len(s):
                    some.append(k)
                    prints.append(majority(shingle_hashes(x, 3))[0])
                    sets.append(np.unique(s.astype(np.uint32)).tobytes())
                    keys.append(least_hashes(mix(s)).view(np.int64))
            at = pa.array(np.arange(len(some) + 1) * BANDS, pa.int32())
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(some, pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.ListArray.from_arrays(at, flat), pa.array(sets, pa.binary())], names=["id", "fp", "keys", "hashes"])

    return docs.mapInArrow(run, "id long, fp long, keys array<bigint>, hashes binary")


def alike(similarity: float):
    """The test of pairs of rows of a table with ``hashes``: a Jaccard similarity of at least ``similarity``."""

    def test(table: pa.Table):
        sets = [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
        size = np.fromiter(map(len, sets), np.int64, len(sets))

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = []
            for k in np.flatnonzero(np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])).tolist():
                a, b = sets[i[k]], sets[j[k]]
                shared = np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b)
                if shared >= similarity * (len(a) + len(b) - shared) - 1e-9:
                    out.append(k)
            return np.array(out, np.int64)

        return near

    return test


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without those that a link of at least this similarity leads to from a smaller row.

    Candidates are fingerprints at 3 or fewer differing bits, found by chains of the ring, and rows with a common key of least hashes over shingles of ``width`` words, which
    also find the many pairs of that similarity whose fingerprints differ more; the sets of shingles, by 32-bit hashes, decide. Sets travel only to keys that several
    different sets have, and to keys of fingerprints only where the least hashes left several groups. Of each group the row with the smallest id stays; a null id counts as
    the largest. Texts without a word are left alone.
    """
    rows = save(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("rid")), "near-rows")
    sets = save(_sets(rows.select(F.col("rid").alias("id"), F.col(f"doc.{text_col}").cast("string").alias("text")), width).withColumn("digest", F.xxhash64("hashes")), "near-sets")
    # Equal sets are one class, named by its smallest row, and only that is compared.
    classes = save(sets.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")), "near-classes")
    same = sets.select("id", "digest").join(classes.filter("n > 1"), "digest").filter("id != least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    own = sets.join(same, sets.id == same.a, "left_anti")
    buckets = save(own.select("id", F.explode("keys").alias("bucket")), "near-keys")
    met = buckets.join(buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "bucket", "left_semi")
    members = save(met.groupBy("id").agg(F.collect_list("bucket").alias("buckets")).join(sets.select("id", "hashes"), "id"), "near-members")
    candidates = members.select("id", F.lit(0).cast("long").alias("fp"), "hashes", F.lit(0).alias("start"), F.explode("buckets").alias("bucket"))
    first_links = save(links_of(candidates, Ring(0, 1), ("hashes",), alike(similarity)), "near-links")
    by_keys = components(first_links.union(same))
    ring = Ring(3, 8)
    grouped = own.select("id", "fp").join(by_keys, F.col("id") == F.col("node"), "left").select("id", "fp", F.coalesce("root", "id").alias("root"))
    prints = save(keyed(grouped, ring, extra=("root",)), "near-prints")
    apart = prints.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("bucket")
    printed = prints.join(apart, "bucket", "left_semi").drop("root").join(sets.select("id", "hashes"), "id")
    found = components(links_of(save(printed, "near-printed"), ring, ("hashes",), alike(similarity)).union(by_keys.select("node", "root")))
    keys = rows.select("rid", F.col(f"doc.{id_col}").alias("id"))
    grouped = found.join(keys, found.node == keys.rid).select("root", "rid", "id").union(found.select(F.col("root").alias("r")).distinct().join(keys, F.col("r") == keys.rid).select("r", "rid", "id"))
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "rid")).alias("first"))
    dropped = grouped.join(first, "root").filter("rid != first.rid").select("rid")
    return rows.join(maybe_broadcast(save(dropped, "near-dropped"), 2_000_000), "rid", "left_anti").select("doc.*")
