"""Exchanges of packed tokens against plain versions."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from setweave.functions.hashing import counted_hashes
from setweave.functions.kernels import minimizer_positions, syncmer_positions
from setweave.operators import exchange, fragments, reports

K, Z, G = 15, 6, 5
RNG = random.Random(7)
BASE = ["".join(RNG.choice("ACGT") for _ in range(n)) for n in (400, 90, 15, 30)]
#: Repeated ids and rows, a null id, a break, short and empty sequences, and a null.
READS = [(1, BASE[0]), (2, BASE[0][100:300]), (2, BASE[1]), (3, BASE[1][:40] + "." + BASE[0][:40]), (4, BASE[2]), (5, "ACGT"), (6, ""), (7, None), (None, BASE[3]), (None, BASE[3] + "A"), (8, "A" * 60), (9, "ACG.ACG.ACG.ACG.ACG"), (9, BASE[1])]
FLAGS = [(True, False), (True, True), (False, True), (True, True), (True, False), (True, True), (True, True), (True, True), (False, True), (True, True), (True, False), (True, False), (False, True)]


def mers(seq, k=K):
    return [(p, seq[p : p + k]) for p in range(len(seq or "") - k + 1) if "." not in seq[p : p + k]]


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame(READS, "doc_id long, seq string").repartition(3)


@pytest.fixture(scope="module")
def flagged(spark):
    return spark.createDataFrame([(*f, *r) for f, r in zip(FLAGS, READS, strict=True)], "in_i boolean, in_j boolean, doc_id long, seq string").repartition(3)


def test_own_counters(reads):
    counts = collections.Counter(t for _, s in READS for _, t in mers(s))
    want = sorted((str(i), [counts[s[p : p + K]] for p in range(len(s) - K + 1)]) for i, s in READS if len(s or "") >= K)
    assert sorted((str(r["doc_id"]), r["counters"]) for r in exchange.own_counters(reads, K, "doc_id").collect()) == want


def test_side_counts(flagged):
    want = collections.defaultdict(lambda: [0, 0])
    for flags, (_, s) in zip(FLAGS, READS, strict=True):
        for _, t in mers(s):
            for k in (0, 1):
                want[t][k] += flags[k]
    got = exchange.side_counts(flagged, K).selectExpr("token", "ci", "cj").collect()
    code = lambda t: int(t.translate(str.maketrans("ACGT", "0123")), 4)
    assert len(got) == len(want) and {r["token"]: [r["ci"], r["cj"]] for r in got} == {code(t): n for t, n in want.items()}


def test_hashes_are_cut_to_the_smallest_of_a_batch(spark):
    counts = spark.range(5000).select((F.col("id") % 2).alias("side"), F.col("id").alias("token"), F.lit(3).cast("long").alias("cnt")).coalesce(1)
    assert counted_hashes(counts, 20, ("side",), 15).count() == 40


def test_similarities_equal_those_of_letters(flagged):
    of = F.explode(F.array_compact(F.array(F.when(F.col("in_i"), F.lit("i")), F.when(F.col("in_j"), F.lit("j")))))
    sided = flagged.select(of.alias("side"), "seq")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(reports.similarity_by_method(flagged, K, Z, 3)) == rows(reports.similarity_by_method(sided, K, Z, 3))
    want = reports.extended_covers(sided, K, Z, G).first()["missing"]
    assert want > 0 and reports.extended_covers(flagged, K, Z, G).first()["missing"] == want


@pytest.mark.parametrize("k", [15, 31])
def test_kmer_summary(reads, k):
    own = collections.defaultdict(list)
    for i, s in READS:
        own[i] += mers(s, k)
    want = sorted((str(i), len(f), min(t for _, t in f), max(t for _, t in f), sum(p for p, _ in f), len({t for _, t in f})) for i, f in own.items() if f)
    got = fragments.kmer_summary(reads, k, "doc_id").collect()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == want


def test_little_is_shuffled(spark, tmp_path):
    """The k-mers of a row are counted where it is; before, each went out with its letters."""
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit(BASE[0]), 10).alias("seq"))
    plan = fragments.kmer_summary(df, 31, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 2


def test_stretches_and_gathering_do_not_matter(monkeypatch):
    raws = [(s or "").encode() for _, s in READS]
    whole = [np.concatenate(x) for x in zip(*exchange.windows_of(raws, K), strict=True)]
    assert [(int(r), int(p)) for r, p in zip(*whole[:2], strict=True)] == [(i, p) for i, (_, s) in enumerate(READS) for p, _ in mers(s)]
    monkeypatch.setattr(exchange, "STRETCH", 37)
    cut = [np.concatenate(x) for x in zip(*exchange.windows_of(raws, K), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))
    monkeypatch.setattr(exchange, "GATHERED", 10)
    parts = [exchange.rows_of(exchange.cut(*exchange.folded(exchange.mixed(whole[2][a : a + 100], 30), [np.ones(len(whole[2][a : a + 100]), np.uint64)], np.add), 30, 3), 0) for a in range(0, len(whole[2]), 100)]
    table = pa.Table.from_batches(parts).sort_by("cell").combine_chunks().to_batches()
    got = {int(t): int(n) for token, (many,) in exchange.merged(iter(table), 1, 30, np.add) for t, n in zip(token, many, strict=True)}
    assert got == collections.Counter(whole[2].tolist())
    text = pa.RecordBatch.from_arrays([pa.array(["abc", None, "x" * 50, "", "yy"])], names=["__seq"])
    assert [b.column(0).to_pylist() for b in exchange.slices(iter([text, text]), 10)] == [["abc", None], ["x" * 50], ["", "yy", "abc", None], ["x" * 50], ["", "yy"]]


def test_positions_in_lines_joined_are_those_of_each():
    raws = [(s or "").encode() for _, s in READS]
    starts = np.cumsum([0, *(len(r) + 1 for r in raws)])
    for find in (lambda s: minimizer_positions(s, K, K - Z + 1), lambda s: syncmer_positions(s, K, Z)):
        assert sorted(find(b"\n".join(raws)).tolist()) == sorted(int(starts[i]) + p for i, r in enumerate(raws) for p in find(r).tolist())
