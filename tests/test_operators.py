"""Operators on small inputs with known results."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from setweave.functions import dna, hashing, kernels, planning
from setweave.operators import exchange, fragments, iblt, minhash, reconcile, reports, sets, simulate
from setweave.sources import readers, writers


def seqs(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, seq string")


def tokens(spark, values):
    return spark.createDataFrame([(v,) for v in values], "token string")


def values(df, column="token"):
    return sorted(r[column] for r in df.collect())


def random_dna(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_murmur_known_values():
    rows = np.frombuffer(b"hello", np.uint8).reshape(1, -1)
    a, b = hashing.murmur_x64(rows, 0)
    assert (int(a[0]), int(b[0])) == (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19)
    assert int(hashing.murmur_32(rows, 0)[0]) == 0x248BFA47
    assert int(hashing.murmur_32(np.zeros((1, 0), np.uint8), 1)[0]) == 0x514E28B7
    long = np.frombuffer(b"The quick brown fox jumps over the lazy dog", np.uint8).reshape(1, -1)
    a, b = hashing.murmur_x64(long, 0)
    assert (int(a[0]), int(b[0])) == (0xE34BBC7BBC071B6C, 0x7A433CA9C49A9347)
    assert int(hashing.murmur_32(long, 0)[0]) == 0x2E4FF723


def test_kmers_break_at_other_letters(spark):
    df = seqs(spark, "ACGTNACG", "acgu", "AC", "", None, "NNN")
    assert values(fragments.kmers(df, 3)) == sorted(["ACG", "CGT", "ACG", "acg", "cgu"])
    assert values(fragments.kmers(df, 4)) == ["ACGT", "acgu"]


def test_long_sequences_are_cut_without_loss(spark):
    s = random_dna(1000, 1)
    got = fragments.windows(seqs(spark, s), 7, chunk=64).orderBy("pos").collect()
    assert [(r["pos"], r["token"]) for r in got] == [(i, s[i : i + 7]) for i in range(994)]


def brute_hashes(s, m):
    comp = str.maketrans("ACGT", "TGCA")
    code = lambda t: int(t.translate(str.maketrans("ACGT", "0123")), 4)
    least = [min(code(s[i : i + m]), code(s[i : i + m].translate(comp)[::-1])) for i in range(len(s) - m + 1)]
    return kernels.mix(np.array(least, np.uint64), m, 42).tolist()


@pytest.mark.parametrize("m,w", [(4, 12), (9, 7), (15, 1)])
def test_minimizers_by_definition(m, w):
    s = random_dna(600, m)
    h = brute_hashes(s, m)
    want = {j for i in range(len(h) - w + 1) for j in range(i, i + w) if h[j] == min(h[i : i + w])}
    assert kernels.minimizer_positions(s.encode(), m, w).tolist() == sorted(want)


@pytest.mark.parametrize("k,z", [(15, 4), (15, 8), (31, 11)])
def test_syncmers_by_definition(k, z):
    s = random_dna(3000, k + z)
    h = brute_hashes(s, z)
    want = [i for i in range(len(s) - k + 1) if min(h[i : i + k - z + 1]) in (h[i], h[i + k - z])]
    assert kernels.syncmer_positions(s.encode(), k, z).tolist() == want
    streamed = kernels.syncmer_positions_streamed(s.encode(), k, z).tolist()
    assert set(streamed) <= set(want)
    if z > 10:  # no ties
        assert streamed == want


def test_short_runs_have_their_last_smallest():
    assert kernels.minimizer_positions(b"AAAAA", 3, 10).tolist() == [2]
    assert kernels.minimizer_positions(b"NN", 3, 10).tolist() == []


def test_native_hash_equals_kernel(spark):
    ts = [random_dna(11, i) for i in range(50)]
    got = {r["token"]: r["h"] for r in tokens(spark, ts).select("token", dna.hash_of(F.col("token"), 11).alias("h")).collect()}
    assert all(got[t] == brute_hashes(t, 11)[0] for t in ts)


def test_pack_and_unpack(spark):
    ts = ["ACGT", "TTTT", "acgu"]
    rows = tokens(spark, ts).select("token", dna.pack(F.col("token"), 4).alias("p"), dna.unpack(dna.pack(F.col("token"), 4), 4).alias("u")).collect()
    assert [(r["p"], r["u"]) for r in rows] == [(0b00011011, "ACGT"), (255, "TTTT"), (0b00011011, "ACGT")]
    t31 = "T" * 31
    assert tokens(spark, [t31]).select(dna.unpack(dna.pack(F.col("token"), 31), 31).alias("u")).first()["u"] == t31


def test_fold_ambiguous(spark):
    assert tokens(spark, ["URYKMSWBDHVw"]).select(dna.fold_ambiguous(F.col("token")).alias("t")).first()["t"] == "TTGGAGAACGTw"


def test_set_summary_of_empty_sides(spark):
    none = spark.createDataFrame([], "side string, token string")
    row = sets.set_summary(none).first()
    assert row["jaccard"] == 1.0 and row["all_tokens"] == 0


def test_count_difference(spark):
    a = spark.createDataFrame([("x", 3), ("y", 1), ("z", 2)], "token string, cnt long")
    b = spark.createDataFrame([("x", 1), ("z", 2), ("w", 5)], "token string, cnt long")
    assert sorted(map(tuple, sets.count_difference(a, b).collect())) == [("i", "x", 2), ("i", "y", 1)]
    assert sorted(map(tuple, sets.count_difference(a, b, symmetric=True).collect())) == [("i", "x", 2), ("i", "y", 1), ("j", "w", 5), ("j", "x", -2)]
    row = sets.weighted_summary(a, b).first()
    assert (row["j"], row["symdiff"]) == (0.5, 2) and row["wj"] == pytest.approx(3 / 11)
    assert sets.weighted_summary(a, b, parity=True).first()["j"] == 3 / 5


SPEC = planning.IbltSpec(11, 300, epsilon=0.6)


def two_sets(spark, shared=2000, only_i=80, only_j=60):
    pool = list(dict.fromkeys(random_dna(11, i) for i in range(shared + only_i + only_j + 50)))
    i, j = pool[:shared] + pool[shared : shared + only_i], pool[:shared] + pool[shared + only_i : shared + only_i + only_j]
    return i, j, tokens(spark, i), tokens(spark, j)


def cells_of(df):
    return sorted((r["row"], r["col"], r["counter"], r["key"]) for r in df.collect())


@pytest.mark.parametrize("check", [False, True])
def test_iblt_lists_the_difference(spark, check):
    spec = planning.IbltSpec(11, 300, epsilon=0.6, check=check)
    i, j, a, b = two_sets(spark)
    ca, cb = iblt.build(a, spec), iblt.build(b, spec)
    listed = iblt.list_keys(iblt.difference(ca, cb, spec), spec).collect()
    assert all(r["peelable"] for r in listed)
    assert {(r["side"], r["token"]) for r in listed} == {("i", t) for t in set(i) - set(j)} | {("j", t) for t in set(j) - set(i)}
    row = iblt.jaccard(ca, cb, spec).first()
    assert row["jaccard"] == pytest.approx(len(set(i) & set(j)) / len(set(i) | set(j)))
    assert (row["n_i"], row["n_j"]) == (len(i), len(j))


def test_iblt_in_rounds(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    i, j, a, b = two_sets(spark, 300, 40, 30)
    found = iblt.list_keys_in_rounds(iblt.difference(iblt.build(a, SPEC), iblt.build(b, SPEC), SPEC), SPEC)
    assert {tuple(r) for r in found.collect()} == {("i", t) for t in set(i) - set(j)} | {("j", t) for t in set(j) - set(i)}


def test_iblt_linear(spark):
    i, j, a, b = two_sets(spark, 200, 20, 20)
    ca = iblt.build(a, SPEC)
    assert iblt.delete(ca, a, SPEC).isEmpty()
    assert iblt.difference(ca, ca, SPEC).isEmpty()
    assert cells_of(iblt.build(a.union(a), SPEC)) == cells_of(ca) == cells_of(iblt.build(a.repartition(5), SPEC))
    only = tokens(spark, sorted(set(j) - set(i)))
    assert cells_of(iblt.merge(ca, iblt.build(only, SPEC), SPEC)) == cells_of(iblt.build(tokens(spark, sorted(set(i) | set(j))), SPEC))


def test_iblt_too_small(spark):
    spec = planning.IbltSpec(11, 5)
    i, j, a, b = two_sets(spark, 50, 80, 60)
    row = iblt.jaccard(iblt.build(a, spec), iblt.build(b, spec), spec).first()
    assert row["peelable"] is False and row["jaccard"] is None
    assert iblt.find_capacity(a, b, spec) >= 70


def test_spec_checks():
    for bad in ({"r": 2}, {"n": 0}, {"epsilon": -1}):
        with pytest.raises(planning.OptionError):
            planning.IbltSpec(**({"length": 15, "n": 10} | bad))
    with pytest.raises(planning.IncompatibleError):
        iblt.difference(None, None, planning.IbltSpec(15, 10), planning.IbltSpec(15, 10, seed=1))
    assert planning.IbltSpec(15, 1000).chunk == 409
    assert planning.payload_length("minimizers", 15, 9) == 21


def test_minhash_of_equal_and_disjoint_sets(spark):
    i, j, a, b = two_sets(spark, 0, 300, 300)
    assert minhash.jaccard(minhash.sketch(a, 100), minhash.sketch(a, 100), 100).first()["jaccard"] == 1.0
    assert minhash.jaccard(minhash.sketch(a, 100), minhash.sketch(b, 100), 100).first()["jaccard"] == 0.0
    i, j, a, b = two_sets(spark, 2000, 500, 500)
    assert minhash.jaccard(minhash.sketch(a, 500), minhash.sketch(b, 500), 500).first()["jaccard"] == pytest.approx(2 / 3, abs=0.1)


def test_weighted_sketch(spark):
    a = spark.createDataFrame([(random_dna(9, i), 1 + i % 3) for i in range(300)], "token string, cnt long").dropDuplicates(["token"])
    sk = minhash.weighted_sketch(a, 50)
    lo, hi = hashing.murmur_x86(np.frombuffer(b"ACGTACGTA", np.uint8).reshape(1, -1), 1)[:2], None
    assert len(lo) == 2 and hi is None
    assert sk.count() == 50
    assert minhash.weighted_compare(sk, sk, 50).first()["wj"] == 1.0
    brute = set()
    for r in a.collect():
        for s in range(r["cnt"]):
            h = [int(x[0]) for x in hashing.murmur_x86(np.frombuffer(r["token"].encode(), np.uint8).reshape(1, -1), s)]
            brute.add((h[0] | h[1] << 32, h[2] | h[3] << 32))
    want = sorted(brute)[:50]
    got = sorted((r["lo"] & (1 << 64) - 1, r["hi"] & (1 << 64) - 1) for r in sk.collect())
    assert got == want


def test_weighted_samples_agree_as_similarity(spark):
    a = spark.createDataFrame([(f"t{i}", 1 + i % 4) for i in range(100)], "token string, cnt long")
    b = a.withColumn("cnt", F.when(F.col("token") < "t5", F.col("cnt")).otherwise(F.lit(0))).filter("cnt > 0")
    x = {r["column"]: (r["token"], r["t"]) for r in minhash.weighted_samples(a, 400).collect()}
    y = {r["column"]: (r["token"], r["t"]) for r in minhash.weighted_samples(b, 400).collect()}
    wj = sets.weighted_summary(a, b).first()["wj"]
    assert sum(x[c] == y[c] for c in x) / 400 == pytest.approx(wj, abs=0.12)


def test_reconcile(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    s = [random_dna(200, i) for i in range(5)]
    rows = [("i", "a", s[0]), ("i", "b", s[1]), ("i", "c", s[1]), ("j", "d", s[0]), ("j", "e", s[2]), ("j", "f", s[3])]
    df = spark.createDataFrame(rows, "side string, name string, seq string")
    got = {(r["side"], r["name"]): r["status"] for r in reconcile.reconcile(fragments.kmers(df, 15), 20, epsilon=0.6).collect()}
    assert got == {("i", "a"): "common", ("i", "b"): "only", ("i", "c"): "duplicate", ("j", "d"): "common", ("j", "e"): "only", ("j", "f"): "only"}


def test_reconcile_doubles_a_table_that_is_too_small(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [(side, f"{side}{i}", random_dna(60, i + 100 * (side == "j" and i % 5 == 0))) for side in "ij" for i in range(40)]
    df = spark.createDataFrame(rows, "side string, name string, seq string")
    want = {(side, f"{side}{i}"): "common" if i % 5 else "only" for side in "ij" for i in range(40)}
    for n in (1, 16):
        assert {(r["side"], r["name"]): r["status"] for r in reconcile.reconcile(fragments.kmers(df, 15), n).collect()} == want


def test_sketches_of_whole_sequences(spark, monkeypatch):
    """Of the sequence where it is, in stretches, as of its exploded k-mers with their positions; the digest has content and sketch."""
    monkeypatch.setattr(exchange, "STRETCH", 500)
    seqs = [random_dna(3000, 1), random_dna(40, 2) + "." + random_dna(40, 3), "ACGT" * 300, random_dna(15, 4), random_dna(14, 5), "", None, random_dna(3000, 1)[:-1] + ".", random_dna(3000, 1)]
    df = spark.createDataFrame(list(enumerate(seqs)), "name int, seq string")
    tokens = fragments.kmers(df, 15).select("name", F.concat("token", F.lit("/"), "pos").alias("token"))
    for s, width in ((50, 8), (2000, 8), (100, 2)):
        want = {}
        for r in minhash.sketch(tokens, s, width, by=("name",)).orderBy("name", "rank").collect():
            want.setdefault(r["name"], []).append(bytes(r["h"]))
        got = reconcile.least_of_sequences([(x or "").encode() for x in seqs], 15, s, width)
        assert {i: [int(h).to_bytes(width, "big") for h in x] for i, x in enumerate(got) if len(x)} == want
    keys = {r["name"]: r["key"] for r in reconcile.sequence_digests(df, 15).collect()}
    assert set(keys) == {0, 1, 2, 3, 7, 8} and keys[0] == keys[8] and len(set(keys.values())) == 5


def test_mutants(spark):
    df = simulate.random_sequences(spark, 20, 5000)
    log = simulate.mutate(df, 0.02, 0.0).collect()
    origin = {r["rec_no"]: r["seq"] for r in df.collect()}
    for r in log:
        assert len(r["seq"]) == 5000 and r["i"] == r["d"] == 0
        assert sum(a != b for a, b in zip(r["seq"], origin[r["rec_no"]], strict=True)) == r["s"]
    assert np.mean([r["s"] for r in log]) == pytest.approx(100, rel=0.2)
    again = simulate.mutate(df.repartition(7), 0.02, 0.0).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, log))
    indels = simulate.mutate(df, 0.02, 1.0, 0.5).collect()
    assert all(len(r["seq"]) >= 5000 + r["tidl"] - r["i"] - 64 and r["s"] == 0 for r in indels)
    assert simulate.founder_and_mutants(spark, 3, 100).count() == 4


FASTQ = "@r1 first\nACGT\nAC\n+\n@@@@\nII\n@r2\nGG\n+\n>I\n>r3\nTT\nTT\n"


def test_fastx(spark, tmp_path):
    assert list(readers.parse_fastx(FASTQ)) == [("r1", "first", "ACGTAC", "@@@@II"), ("r2", None, "GG", ">I"), ("r3", None, "TTTT", None)]
    assert list(readers.parse_fastx("@r\nACGT\n+\nII\n")) == [("r", None, "ACGT", None)]
    with pytest.raises(ValueError):
        list(readers.parse_fastx("@r\nACGT\n+\nII\n", strict=True))
    import gzip

    (tmp_path / "x.fa").write_text(">a one\nAC\nGT\n>b\nTT\n")
    (tmp_path / "y.fq.gz").write_bytes(gzip.compress(FASTQ.encode()))
    got = readers.read_fasta(spark, str(tmp_path / "x.fa")).orderBy("rec_no").collect()
    assert [(r["name"], r["comment"], r["seq"]) for r in got] == [("a", "one", "ACGT"), ("b", None, "TT")]
    assert readers.read_folder(spark, str(tmp_path)).count() == 5
    assert readers.format_of("A.FASTQ.GZ") == ("fastq", True) and readers.is_gzipped(b"\x1f\x8b\x08")


def test_token_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("AC;GT;;TT")
    assert values(readers.read_tokens(spark, str(tmp_path / "t.txt"), ";")) == ["AC", "GT", "TT"]
    df = spark.createDataFrame([("AC", 2)], "token string, cnt long")
    writers.write_counts(df, str(tmp_path / "c"), ";")
    assert [tuple(r) for r in readers.read_counts(spark, str(tmp_path / "c"), ";").collect()] == [("AC", 2)]
    writers.write_fasta(df, str(tmp_path / "f"), "token", "cnt")
    assert [r["seq"] for r in readers.read_fasta(spark, str(tmp_path / "f")).collect()] == ["AC"]
    writers.append_results(df, str(tmp_path / "r"))
    writers.append_results(df, str(tmp_path / "r"))
    assert readers.read_results(spark, str(tmp_path / "r")).count() == 2


def test_sketch_files(spark, tmp_path):
    _, _, a, _ = two_sets(spark, 30, 5, 0)
    spec = planning.IbltSpec(11, 20)
    cells = iblt.build(a, spec)
    raw = writers.sketch_bytes(cells, spec)
    assert len(raw) == spec.r * (spec.chunk * (spec.wsize + 8) + 4) + 14
    writers.write_bytes(spark, f"file://{tmp_path}/s.bin", raw)
    back = readers.read_sketches(spark, f"{tmp_path}/s.bin", spec.wsize)
    assert cells_of(back) == cells_of(cells)
    assert back.first()["seeds"] == spec.seeds
    sk = minhash.sketch(a, 10)
    writers.write_bytes(spark, f"file://{tmp_path}/m.bin", writers.minhash_bytes(sk, 42))
    assert [bytes(r["h"]) for r in readers.read_minhash(spark, f"{tmp_path}/m.bin").orderBy("rank").collect()] == [bytes(r["h"]) for r in sk.orderBy("rank").collect()]
    w = minhash.weighted_sketch(a.withColumn("cnt", F.lit(2).cast("long")), 10)
    writers.write_bytes(spark, f"file://{tmp_path}/w.bin", writers.weighted_bytes(w, 42, 11))
    assert sorted((r["lo"], r["hi"]) for r in readers.read_weighted(spark, f"{tmp_path}/w.bin").collect()) == sorted((r["lo"], r["hi"]) for r in w.collect())


def test_keys_of_several_words(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    for n in (32, 33, 41, 64, 70):
        pool = [random_dna(n, i) for i in range(160)] + ["T" * n, "A" * n, "G" + "A" * (n - 1)]
        packed = tokens(spark, pool).select("token", F.array(*dna.pack_words(F.col("token"), n)).alias("w"), dna.unpack_words(dna.pack_words(F.col("token"), n), n).alias("u")).collect()
        whole = 4 * dna.key_bytes(n)
        for r in packed:
            value = 0
            for w in r["w"]:
                value = value << 64 | w & (1 << 64) - 1
            assert r["u"] == r["token"] and value == int(r["token"].ljust(whole, "A").translate(str.maketrans("ACGT", "0123")), 4)
        spec = planning.IbltSpec(n, 100, epsilon=0.6, check=n == 41)
        i, j = set(pool[:130]), set(pool[30:])
        ca, cb = iblt.build(tokens(spark, sorted(i)), spec), iblt.build(tokens(spark, sorted(j)), spec)
        gone = iblt.difference(ca, cb, spec)
        want = {("i", t) for t in i - j} | {("j", t) for t in j - i}
        assert {(r["side"], r["token"]) for r in iblt.list_keys(gone, spec).collect()} == want
        if n == 41:
            assert {tuple(r) for r in iblt.list_keys_in_rounds(gone, spec).collect()} == want
            key = {r["key_hex"] for r in iblt.dump(iblt.build(tokens(spark, ["G" + "A" * 39 + "C"]), spec), spec).collect()}
            assert key == {"80" + "00" * 9 + "40"}
        writers.write_bytes(spark, f"file://{tmp_path}/{n}.bin", writers.sketch_bytes(ca, spec))
        back = readers.read_sketches(spark, f"{tmp_path}/{n}.bin", spec.wsize)
        columns = ["row", "col", "counter", *spec.words]
        assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, ca.select(columns).collect()))


def test_sketch_file_with_lengths_and_positions():
    import struct

    cells = b"".join(struct.pack(">q2sBI", c, k, n, p) for c, k, n, p in ((1, b"\x1b\x00", 5, 77), (0, b"\0\0", 0, 0), (-1, b"\0\x01", 8, 1 << 31), (2, b"\x1b\x01", 13, 3)))
    head, found = readers.unpack_sketch(struct.pack(">BfQ", 2, 0.5, 2) + cells + struct.pack(">2I", 42, 43), 2, 1, 4)
    assert head == {"repetitions": 2, "epsilon": 0.5, "chunk_size": 2, "key_len": None, "seeds": [42, 43]}
    assert {c: v.ravel().tolist() for c, v in found.items()} == {"row": [0, 1, 1], "col": [0, 0, 1], "counter": [1, -1, 2], "words": [0x1B00, 1, 0x1B01], "len": [5, 8, 13], "pos": [77, 1 << 31, 3]}


@pytest.mark.parametrize("version", [0, 0x200])
def test_database_versions_and_lookups(spark, tmp_path, version):
    kmers = {random_dna(36, i): 1 + i for i in range(300)}
    pre, suf = readers.pack_database(kmers, 36, version=version)
    (tmp_path / "d.kmc_pre").write_bytes(pre)
    (tmp_path / "d.kmc_suf").write_bytes(suf)
    assert {r["token"]: r["cnt"] for r in readers.read_databases(spark, f"{tmp_path}/d.kmc_pre").collect()} == kmers
    assert sum(b.num_rows for b in readers.unpack_database(pre, suf, 5, 204, at_once=7)) == 200
    info = readers.read_database_info(spark, f"{tmp_path}/d.kmc_pre").first()
    assert (info["version"], info["kmer_length"], info["total_kmers"], info["min_count"], info["both_strands"]) == (version, 36, 300, 1, True)
    assert all(readers.find_in_database(pre, suf, t) == c for t, c in kmers.items())
    t, c = next(iter(kmers.items()))
    assert readers.find_in_database(pre, suf, t, c + 1) == 0 == readers.find_in_database(pre, suf, t[1:] + "N") == readers.find_in_database(pre, suf, "A" * 36)


def test_distances_and_lengths(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("a.fa\tb.fa\t0.1\t0\t250/1000\na.fa\tc.fa\t1\t1\t0/0\n")
    got = readers.read_distances(spark, str(tmp_path / "d.tsv"))
    assert sorted(map(tuple, got.collect())) == [("a.fa", "b.fa", 0.25), ("a.fa", "c.fa", None)]
    assert readers.token_length(tokens(spark, ["ACG"])) == 3 and readers.token_length(tokens(spark, [])) is None


def test_count_database(spark, tmp_path):
    kmers = {random_dna(16, i): 1 + i for i in range(200)}
    pre, suf = readers.pack_database(kmers, 16)
    (tmp_path / "d.kmc_pre").write_bytes(pre)
    (tmp_path / "d.kmc_suf").write_bytes(suf)
    info = readers.database_info(pre)
    assert (info["kmer_length"], info["total_kmers"], info["both_strands"]) == (16, 200, True)
    got = {r["token"]: r["cnt"] for r in readers.read_databases(spark, f"{tmp_path}/d.kmc_pre", 10, 100).collect()}
    assert got == {k: c for k, c in kmers.items() if 10 <= c <= 100}
    with pytest.raises(ValueError):
        readers.database_info(b"XXXX" + pre[4:])


def test_reports(spark):
    df = spark.createDataFrame([("a", 0.5, 0.4, True), ("a", 0.5, 0.7, True), ("b", 0.1, None, False)], "q string, exj double, est double, peelable boolean")
    assert reports.trial_summary(df.na.drop(), ["q"], "exj", ["est"]).first()["est_mse"] == pytest.approx(0.025)
    assert reports.complete(df, "peelable").count() == 2
    assert reports.errors(df, "exj", ["est"]).first()["est_error"] == 0.1
    files = spark.createDataFrame([("/x/a.fa.gz",), ("/x/b.fq",)], "path string")
    assert reports.in_list(files, spark.createDataFrame([("a",)], "name string")).count() == 1
    assert reports.stack(df, files).count() == 5
    row = spark.range(1).select(dna.human_number(F.lit(1500)).alias("a"), dna.number(F.lit("x")).alias("b"), dna.mutation_rate(F.lit(0.0), 15).alias("c")).first()
    assert tuple(row) == ("1.5K", None, 1.0)


def test_query_split(spark):
    files = spark.createDataFrame([(f"f{i}",) for i in range(10)], "name string")
    got = sets.query_split(files, "name", k=3).collect()
    assert sum(r["is_query"] for r in got) == 3 and all(r["is_query"] != r["is_reference"] for r in got)
    assert all(r["is_query"] and r["is_reference"] for r in sets.query_split(files, "name", share=1.0).collect())


def test_syncmer_filter_hashers(spark):
    ts = list({random_dna(15, i) for i in range(100)})
    kept = values(fragments.syncmer_filter(tokens(spark, ts), 15, 8))
    first = [t for t in ts if (h := brute_hashes(t, 8)).index(min(h)) in (0, 7)]
    assert kept == sorted(first)
    other = fragments.syncmer_filter(tokens(spark, ts), 15, 8, hasher=lambda c: F.xxhash64(c))
    assert 0 < other.count() < 100


def test_check_length(spark):
    assert fragments.check_length(tokens(spark, ["ACG"]), 3).count() == 1
    with pytest.raises(Exception, match="longer than the payload"):
        fragments.check_length(tokens(spark, ["ACGT"]), 3).collect()
    assert values(fragments.valid_tokens(tokens(spark, ["AN", "ACGT", "AC"]), 3)) == ["AC"]
    assert re.fullmatch("ok", "ok")


def test_streamed_bottom_keeps_the_smallest_over_batches(spark, tmp_path):
    from setweave.streaming import sketches

    folder = tmp_path / "files"
    for i in range(3):
        spark.createDataFrame([(f"t{n % 70}x{i}",) for n in range(200)], "token string").coalesce(1).write.mode("append").parquet(str(folder))
    everything = spark.read.parquet(str(folder))
    stream = spark.readStream.schema("token string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    for s in (1, 20, 1000):
        got = sketches.run_to_end(sketches.stream_bottom(stream, s), "bottom", "update")
        want = minhash.sketch(everything, s)
        assert sorted((r["rank"], bytes(r["h"])) for r in got.collect()) == sorted((r["rank"], bytes(r["h"])) for r in want.collect())
