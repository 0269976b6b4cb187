"""The queries over the engine's operators, and SQL that gives the same rows where SQL can.

Bases are derived from the documents' texts. Two sides, i and j, are the documents not labelled toxic and those not labelled
of low quality. Every query reads its tables whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.functions import dna, hashing
from setweave.functions.planning import CELLS_PER_KEY, IbltSpec, sampled_size
from setweave.functions.session import checkpointed, fresh_folder
from setweave.operators import exchange, fragments, iblt, minhash, reconcile, reports, sets, simulate
from setweave.plans import oracles as sql
from setweave.plans.oracles import DNA, G, K, M, SIDES, Z
from setweave.sources import readers, writers
from setweave.streaming import sketches as streams

QUERIES, ORACLES = {}, {}
S = 200  # hashes in a bottom-s sketch
SPEC = IbltSpec(K, 50_000, epsilon=0.6)


def query(expected: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if expected is not None:
            ORACLES[f.__name__] = expected
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, seq), in enough partitions for what is made of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select("doc_id", "source", dna.dna_of(F.col("text")).alias("seq"))


def _marked(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows with a doc_id, with the sides ``in_i`` and ``in_j`` that they are in; those in none are left out."""
    labels = table(spark, sf_dir, "labels")
    marks = labels.groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("toxic"), F.max(F.col("quality") == 0).alias("low"))
    marked = rows.join(marks, "doc_id", "left")
    in_i, in_j = ~F.coalesce("toxic", F.lit(False)), ~F.coalesce("low", F.lit(False))
    return marked.select(in_i.alias("in_i"), in_j.alias("in_j"), *rows.columns).filter("in_i or in_j")


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(in_i, in_j, doc_id, source, seq): each document once, with the sides it is in."""
    return _marked(spark, sf_dir, bases(spark, sf_dir))


def _by_side(rows: DataFrame) -> DataFrame:
    """A row for each side that a row is in."""
    of = F.array_compact(F.array(F.when(F.col("in_i"), F.lit("i")), F.when(F.col("in_j"), F.lit("j"))))
    return rows.withColumn("side", F.explode(of)).drop("in_i", "in_j")


def sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(side, doc_id, source, seq)."""
    return _by_side(flagged(spark, sf_dir)).select("side", "doc_id", "source", "seq")


def packed(spark: SparkSession, sf_dir: str, canonical: bool = False) -> DataFrame:
    """(token, cnt) of all documents."""
    return fragments.packed_kmers(bases(spark, sf_dir), K, canonical=canonical)


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments.packed_kmers(bases(spark, sf_dir), K, ("source",))


def both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(in_i, in_j, token, cnt)."""
    return fragments.packed_kmers(flagged(spark, sf_dir), K, ("in_i", "in_j"))


def sided_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(side, token), each once, from one grouping of both sides."""
    return _by_side(sets.membership(both_sides(spark, sf_dir))).select("side", "token")


def one_side(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    return sided_sets(spark, sf_dir).filter(F.col("side") == side).select("token")


def sided_cells(spark: SparkSession, sf_dir: str, spec: IbltSpec) -> DataFrame:
    """The cells of both sides' tables, told apart by ``side``."""
    return iblt.build(sided_sets(spark, sf_dir), spec, by=("side",), distinct=False)


def _of(cells: DataFrame, side: str) -> DataFrame:
    return cells.filter(F.col("side") == side).drop("side")


KMERS = f"WITH {DNA}, {sql.windows('w', K)} "
SIDED = f"WITH {DNA}, {SIDES}, {sql.windows('w', K, 'sided', 'side, doc_id, source')}, t AS (SELECT DISTINCT side, token FROM w) "
MEMBERS = SIDED + ", m AS (SELECT token, bool_or(side = 'i') AS in_i, bool_or(side = 'j') AS in_j FROM t GROUP BY token) "
COUNTS = KMERS + ", c AS (SELECT token, count(*) AS cnt FROM w GROUP BY token) "
SIDE_COUNTS = SIDED + """, c AS (SELECT token, count(*) FILTER (side = 'i') AS ci, count(*) FILTER (side = 'j') AS cj FROM w GROUP BY token) """
PER_DOC = "SELECT doc_id, count(*) AS n, min(token) AS first_token, max(token) AS last_token, sum(pos)::BIGINT AS pos_sum, count(DISTINCT token) AS different FROM {0} GROUP BY doc_id"


def per_doc(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("token").alias("first_token"), F.max("token").alias("last_token"), F.sum("pos").alias("pos_sum"), F.countDistinct("token").alias("different"))


# Fragments


@query(KMERS + PER_DOC.format("w"))
def kmers_per_document(spark, sf_dir):
    return per_doc(fragments.kmers(bases(spark, sf_dir), K))


@query(f"WITH {DNA}, {sql.windows('w', 31)} " + PER_DOC.format("w"))
def kmers_31_per_document(spark, sf_dir):
    return fragments.kmer_summary(bases(spark, sf_dir), 31, "doc_id")


@query(f"WITH {DNA}, {sql.minimizers('p', K, 10)} SELECT doc_id, pos, substr(seq, pos + 1, {K}) AS token FROM p")
def minimizer_index(spark, sf_dir):
    return fragments.minimizers(bases(spark, sf_dir), K, w=10).select("doc_id", "pos", "token")


_GROUP = f"""CASE WHEN pos < {K - M} THEN rpad(repeat('A', ({K - M} - pos)::INT) || substr(seq, 1, pos + {K}), {2 * K - M}, 'A') ELSE rpad(substr(seq, pos - {K - M} + 1, {2 * K - M}), {2 * K - M}, 'A') END"""


@query(f"WITH {DNA}, {sql.minimizers('p', M, K - M + 1)} SELECT doc_id, pos, {_GROUP} AS token FROM p")
def minimizer_groups(spark, sf_dir):
    return fragments.minimizers(bases(spark, sf_dir), K, M).select("doc_id", "pos", "token")


@query(f"WITH {DNA}, {sql.minimizers('p', M, K - M + 1)}, g AS (SELECT doc_id, pos, {_GROUP} AS token FROM p) SELECT doc_id, pos, unnest([substr(token, {K - M + 1}, {K}), substr(token, 1, {K})]) AS token FROM g")
def minimizer_split(spark, sf_dir):
    return fragments.minimizers(bases(spark, sf_dir), K, M, split=True).select("doc_id", "pos", "token")


@query(f"WITH {DNA}, {sql.minimizers('p', M, K - M + 1)}, {sql.segments('g', 'p', K)} SELECT doc_id, pos, token FROM g")
def minimizer_segments(spark, sf_dir):
    return fragments.minimizers(bases(spark, sf_dir), K, M, segment=True).select("doc_id", "pos", "token")


@query(f"WITH {DNA}, {sql.syncmers('p', K, Z)} SELECT doc_id, pos, substr(seq, pos + 1, {K}) AS token FROM p")
def syncmers(spark, sf_dir):
    return fragments.syncmers(bases(spark, sf_dir), K, Z).select("doc_id", "pos", "token")


@query()
def syncmers_streamed(spark, sf_dir):
    return fragments.syncmers(bases(spark, sf_dir), K, Z, streamed=True).select("doc_id", "pos", "token")


@query(f"""WITH {DNA}, {sql.syncmers('p', K, Z)}, e AS (SELECT doc_id, pos, seq FROM p WHERE pos + {K + G} < length(seq)
  UNION ALL SELECT doc_id, 0, seq FROM dna WHERE length(seq) >= {K + G} UNION ALL SELECT doc_id, length(seq) - {K + G}, seq FROM dna WHERE length(seq) >= {K + G})
SELECT doc_id, pos, substr(seq, pos + 1, {K + G}) AS token FROM e""")
def syncmers_extended(spark, sf_dir):
    return fragments.syncmers(bases(spark, sf_dir), K, Z, G).select("doc_id", "pos", "token")


@query(f"WITH {DNA}, {sql.syncmers('p', K, Z)}, {sql.segments('g', 'p', K)} SELECT doc_id, pos, token FROM g")
def syncmer_segments(spark, sf_dir):
    return fragments.syncmers(bases(spark, sf_dir), K, Z, segment=True).select("doc_id", "pos", "token")


@query(f"WITH {DNA}, {sql.syncmers('p', K, Z)} SELECT doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM p GROUP BY doc_id")
def syncmer_debug(spark, sf_dir):
    found = fragments.syncmer_positions_of(bases(spark, sf_dir), K, Z)
    return found.select("doc_id", F.concat_ws(",", F.transform("positions", lambda p: p.cast("string"))).alias("positions"))


_FILTER = ", ".join(f"h{i}" for i in range(K - M + 1))


def _leftmost(n: int) -> str:
    least = "least(" + ", ".join(f"h{i}" for i in range(n)) + ")"
    return f"(h0 = {least} OR (h{n - 1} = {least} AND " + " AND ".join(f"h{i} > {least}" for i in range(n - 1)) + "))"


_MERS = ", ".join(f"m{i}.h AS h{i}" for i in range(K - M + 1))
_JOINS = " ".join(f"JOIN z m{i} ON m{i}.token = substr(s.token, {i + 1}, {M})" for i in range(K - M + 1))


@query(KMERS + f""", s AS (SELECT DISTINCT {sql.canonical('token')} AS token FROM w),
zd AS (SELECT DISTINCT substr(token, i, {M}) AS token FROM s, range(1, {K - M + 2}) AS r(i)), zc AS (SELECT token, least({sql.code('token', M)}, {sql.code(sql.revcomp('token'), M)})::BIGINT AS c FROM zd),
{sql.mix_steps('z', 'zc', 'c', M, 'token')}, j AS (SELECT s.token, {_MERS} FROM s {_JOINS}) SELECT token FROM j WHERE {_leftmost(K - M + 1)}""")
def table_syncmer_filter(spark, sf_dir):
    tokens = sets.spelled(packed(spark, sf_dir, canonical=True).select("token").distinct(), K)
    return fragments.syncmer_filter(tokens, K, M)


@query(KMERS + f""", d AS (SELECT DISTINCT token FROM w), {sql.murmur_x86('h', 'd', 'token', K, 0, 'token')}
SELECT token FROM h WHERE (h1::UHUGEINT + h2::UHUGEINT * 4294967296::UHUGEINT) % 50::UHUGEINT = 0""")
def hash_sample(spark, sf_dir):
    return sets.spelled(fragments.hash_sample(sets.token_set(packed(spark, sf_dir)), 50, bases=K), K)


@query(f"""WITH {DNA} SELECT doc_id, regexp_matches(seq, '^[ACGTUacgtu]+$') AS genomic, length(regexp_extract(seq, '^[ACGTU]*')) AS prefix, length(seq) AS n, len(regexp_extract_all(seq, '[ACGT]+')) AS runs FROM dna""")
def base_runs(spark, sf_dir):
    seq = F.col("seq")
    return bases(spark, sf_dir).select("doc_id", dna.is_genomic(seq).alias("genomic"), dna.genomic_prefix_length(seq).cast("long").alias("prefix"), F.length(seq).cast("long").alias("n"), F.regexp_count(seq, F.lit("[ACGT]+")).cast("long").alias("runs"))


# Sets, counts, spectra


@query(KMERS + "SELECT count(DISTINCT token) AS l0, count(*) AS total FROM w")
def kmer_set_size(spark, sf_dir):
    return sets.token_counts(packed(spark, sf_dir)).agg(F.count("*").alias("l0"), F.sum("cnt").alias("total"))


@query(KMERS + f"SELECT source, count(DISTINCT {sql.canonical('token')}) AS n, min({sql.canonical('token')}) AS first_token FROM w GROUP BY source")
def canonical_sets(spark, sf_dir):
    found = fragments.packed_kmers(bases(spark, sf_dir), K, ("source",), canonical=True).select("source", "token").distinct()
    return found.groupBy("source").agg(F.count("*").alias("n"), dna.spelled(F.min("token"), K).alias("first_token"))


@query(COUNTS + "SELECT token, cnt FROM c WHERE cnt BETWEEN 10 AND 1000000")
def kmer_count_range(spark, sf_dir):
    return sets.spelled(sets.count_range(sets.token_counts(packed(spark, sf_dir)), 10, 1_000_000), K)


@query(COUNTS + "SELECT token, cnt FROM c WHERE cnt <> 1")
def without_singletons(spark, sf_dir):
    return sets.spelled(sets.without_frequency(sets.token_counts(packed(spark, sf_dir)), 1), K)


@query(f"WITH {DNA}, {sql.windows('w', K)}, c AS (SELECT {sql.canonical('token')} AS token, count(*) AS cnt FROM w GROUP BY 1) SELECT cnt, count(*) AS tokens FROM c GROUP BY cnt")
def spectrum(spark, sf_dir):
    return sets.spectrum(sets.token_counts(packed(spark, sf_dir, canonical=True)))


@query(COUNTS + """, s AS (SELECT cnt, count(*) AS tokens FROM c GROUP BY cnt), a AS (SELECT sum(tokens) AS n, max(tokens) AS top FROM s)
SELECT a.n::BIGINT AS l0, sum(tokens * cnt)::BIGINT AS l1, min(cnt) FILTER (tokens = top) AS mode, max(tokens) AS mode_tokens, round(-sum(tokens / n * log2(tokens / n)), 6) AS entropy,
 round((a.n - top) / top, 6) AS eps_hint FROM s, a GROUP BY a.n, top""")
def spectrum_stats(spark, sf_dir):
    found = sets.spectrum_stats(sets.spectrum(sets.token_counts(packed(spark, sf_dir))))
    return found.select("l0", "l1", "mode", "mode_tokens", F.round("entropy", 6).alias("entropy"), F.round("eps_hint", 6).alias("eps_hint"))


@query(MEMBERS + "SELECT CASE WHEN in_i THEN 'i' ELSE 'j' END AS side, token FROM m WHERE in_i <> in_j")
def symmetric_difference(spark, sf_dir):
    return sets.spelled(sets.symmetric_difference(both_sides(spark, sf_dir)), K)


@query(MEMBERS + """SELECT count(*) FILTER (in_i) AS size_i, count(*) FILTER (in_j) AS size_j, count(*) FILTER (in_i AND in_j) AS shared, count(*) AS all_tokens,
 count(*) FILTER (in_i AND NOT in_j) AS only_i, count(*) FILTER (in_j AND NOT in_i) AS only_j, round(count(*) FILTER (in_i AND in_j) / count(*), 9) AS jaccard,
 round(count(*) FILTER (in_i AND in_j) / count(*) FILTER (in_i), 9) AS c_ij, round(count(*) FILTER (in_i AND in_j) / count(*) FILTER (in_j), 9) AS c_ji FROM m""")
def symdiff_summary(spark, sf_dir):
    out = sets.set_summary(both_sides(spark, sf_dir)).drop("i_in_j")
    return out.select(*(F.round(c, 9).alias(c) if c in ("jaccard", "c_ij", "c_ji") else c for c in out.columns))


@query(SIDE_COUNTS + "SELECT 'i' AS side, token, ci - cj AS delta FROM c WHERE ci > 0 AND ci <> cj")
def count_difference(spark, sf_dir):
    return sets.spelled(sets.count_difference_of(sets.side_counts(both_sides(spark, sf_dir))), K)


@query(SIDE_COUNTS + "SELECT 'i' AS side, token, ci - cj AS delta FROM c WHERE ci > 0 AND ci <> cj UNION ALL SELECT 'j', token, cj - ci FROM c WHERE cj > 0 AND ci <> cj")
def count_difference_symmetric(spark, sf_dir):
    return sets.spelled(sets.count_difference_of(sets.side_counts(both_sides(spark, sf_dir)), symmetric=True), K)


@query(SIDE_COUNTS + "SELECT round(count(*) FILTER (ci > 0 AND cj > 0) / count(*), 9) AS j, round(sum(least(ci, cj)) / sum(greatest(ci, cj)), 9) AS wj, count(*) FILTER (ci = 0 OR cj = 0) AS symdiff FROM c")
def weighted_jaccard(spark, sf_dir):
    return sets.weighted_summary_of(sets.side_counts(both_sides(spark, sf_dir))).select(F.round("j", 9).alias("j"), F.round("wj", 9).alias("wj"), "symdiff")


PAIRS = KMERS + """, t AS (SELECT DISTINCT source, token FROM w), s AS (SELECT source, count(*) AS size FROM t GROUP BY source),
x AS (SELECT a.source AS source_i, b.source AS source_j, count(*) AS shared FROM t a JOIN t b ON a.token = b.token AND a.source < b.source GROUP BY ALL),
p AS (SELECT i.source AS source_i, j.source AS source_j, i.size AS size_i, j.size AS size_j, coalesce(x.shared, 0) AS shared FROM s i JOIN s j ON i.source < j.source LEFT JOIN x ON x.source_i = i.source AND x.source_j = j.source) """


@query(PAIRS + "SELECT *, round(shared / (size_i + size_j - shared), 9) AS jaccard FROM p")
def pairwise_jaccard(spark, sf_dir):
    found = sets.pairwise(by_source(spark, sf_dir), "source")
    return found.withColumn("jaccard", F.round("jaccard", 9))


@query(PAIRS + "SELECT max(size_i + size_j - 2 * shared) AS capacity FROM p")
def pairwise_capacity(spark, sf_dir):
    return sets.capacity(sets.pairwise(by_source(spark, sf_dir), "source"))


@query(COUNTS + "SELECT doc_id, sum(c.cnt)::BIGINT AS counter_sum, max(c.cnt) AS counter_max FROM w JOIN c USING (token) GROUP BY doc_id")
def counters_of_reads(spark, sf_dir):
    found = exchange.own_counters(bases(spark, sf_dir), K, "doc_id")
    total = F.aggregate("counters", F.lit(0).cast("long"), lambda a, x: a + x)
    reads = found.select("doc_id", total.alias("n"), F.array_max("counters").alias("most"))
    return reads.groupBy("doc_id").agg(F.sum("n").alias("counter_sum"), F.max("most").alias("counter_max")).filter("counter_sum > 0")


# Functions on tokens


@query(KMERS + f""", d AS (SELECT DISTINCT token FROM w), e AS (SELECT token, {sql.code('token', K)}::BIGINT AS code FROM d), {sql.mix_steps('x', 'e', 'code', K, 'token, code')}
SELECT count(*) AS n, sum(code)::BIGINT AS code_sum, bit_xor(code * 4) AS key_xor, bit_xor(h) AS mix_xor, min({sql.revcomp('token')}) AS first_revcomp, count(DISTINCT h) AS hashes FROM x""")
def token_functions(spark, sf_dir):
    t = F.col("token")
    rows = sets.spelled(sets.token_set(packed(spark, sf_dir)), K).select("token", dna.code(t).alias("code"), dna.pack(t, K).alias("key"), dna.mix64(dna.code(t), K).alias("h"))
    back = rows.filter(dna.unpack(F.col("key"), K) == t)
    return back.agg(F.count("*").alias("n"), F.sum("code").alias("code_sum"), F.bit_xor("key").alias("key_xor"), F.bit_xor("h").alias("mix_xor"), F.min(dna.reverse_complement(t)).alias("first_revcomp"), F.countDistinct("h").alias("hashes"))


@query(KMERS + f""", d AS (SELECT DISTINCT token FROM w), {sql.murmur_x64('h', 'd', sql.bytes_of('token', 1, 8), sql.bytes_of('token', 9, 7), K, '42', 'token')}
SELECT count(*) AS n, bit_xor((lo % 9223372036854775808::UHUGEINT)::BIGINT) AS low_xor FROM h""")
def murmur_128(spark, sf_dir):
    tokens = sets.token_set(packed(spark, sf_dir))
    h = hashing.murmur128(F.col("token"), bases=K)["lo"].bitwiseAND(F.lit((1 << 63) - 1))
    return tokens.select(h.alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("low_xor"))


# Invertible tables

_A = SIDED + ", ta AS (SELECT token FROM t WHERE side = 'i'), tb AS (SELECT token FROM t WHERE side = 'j'), "
CELLS = _A + sql.cells("a", "ta", K, SPEC.r, SPEC.chunk) + " "
BOTH = SIDED + ", ts AS (SELECT token, CASE side WHEN 'i' THEN 1 ELSE -1 END AS sgn FROM t), " + sql.cells("x", "ts", K, SPEC.r, SPEC.chunk, "sgn") + " "


@query(CELLS + "SELECT * FROM a")
def iblt_cells(spark, sf_dir):
    return iblt.build(one_side(spark, sf_dir, "i"), SPEC, distinct=False)


@query(CELLS + "SELECT sum(counter)::BIGINT AS n FROM a WHERE row = 0")
def iblt_count(spark, sf_dir):
    return iblt.count(iblt.build(one_side(spark, sf_dir, "i"), SPEC, distinct=False))


@query(_A + "rest AS (SELECT token FROM ta EXCEPT SELECT token FROM tb), " + sql.cells("a", "rest", K, SPEC.r, SPEC.chunk) + " SELECT * FROM a")
def iblt_delete(spark, sf_dir):
    """Cells of i after what it shares with j was deleted."""
    both = sets.membership(both_sides(spark, sf_dir))
    return iblt.delete(iblt.build(both.filter("in_i").select("token"), SPEC, distinct=False), both.filter("in_i and in_j").select("token"), SPEC)


@query(BOTH + "SELECT * FROM x")
def iblt_difference(spark, sf_dir):
    cells = sided_cells(spark, sf_dir, SPEC)
    return iblt.difference(_of(cells, "i"), _of(cells, "j"), SPEC, SPEC)


@query(CELLS + f"SELECT row, col, counter, lpad(lower(hex(key)), {2 * SPEC.wsize}, '0') AS key_hex FROM a")
def iblt_dump(spark, sf_dir):
    return iblt.dump(iblt.build(one_side(spark, sf_dir, "i"), SPEC, distinct=False), SPEC)


@query(CELLS + f""", g AS (SELECT r.row::INT AS row, c.col FROM range(0, {SPEC.r}) AS r(row), range(0, {SPEC.chunk}) AS c(col))
SELECT g.row, string_agg(coalesce(a.counter, 0)::VARCHAR, ' ' ORDER BY g.col) AS counters FROM g LEFT JOIN a ON a.row = g.row AND a.col = g.col GROUP BY g.row""")
def iblt_row_print(spark, sf_dir):
    return iblt.row_print(iblt.build(one_side(spark, sf_dir, "i"), SPEC, distinct=False), SPEC)


def _fitting(both: DataFrame, length: int, bases: int) -> tuple[DataFrame, DataFrame, IbltSpec]:
    """Tables of the sides of (token, in_i, in_j), sized by an estimate of their difference and doubled until it can be listed."""
    both = checkpointed(both)
    n = iblt.estimated_difference(both, bases=bases)
    while True:
        spec = IbltSpec(length, n, epsilon=0.6)
        cells = checkpointed(iblt.build(_by_side(both).select("side", "token"), spec, by=("side",), distinct=False))
        if iblt.fits(iblt.difference(_of(cells, "i"), _of(cells, "j"), spec), spec):
            return _of(cells, "i"), _of(cells, "j"), spec
        n *= 2


def _sized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, IbltSpec]:
    return _fitting(sets.membership(both_sides(spark, sf_dir)), K, K)


@query(ORACLES["symmetric_difference"])
def iblt_list(spark, sf_dir):
    a, b, spec = _sized(spark, sf_dir)
    return iblt.list_any(iblt.difference(a, b, spec), spec).select("side", "token")


@query(MEMBERS + """SELECT count(*) FILTER (in_i) AS n_i, count(*) FILTER (in_j) AS n_j, count(*) FILTER (in_i AND NOT in_j) AS only_i, count(*) FILTER (in_j AND NOT in_i) AS only_j,
 round(count(*) FILTER (in_i AND in_j) / count(*), 9) AS jaccard, round(count(*) FILTER (in_i AND in_j) / count(*) FILTER (in_i), 9) AS c_ij, round(count(*) FILTER (in_i AND in_j) / count(*) FILTER (in_j), 9) AS c_ji, true AS peelable FROM m""")
def iblt_jaccard(spark, sf_dir):
    a, b, spec = _sized(spark, sf_dir)
    out = iblt.jaccard(a, b, spec)
    return out.select("n_i", "n_j", "only_i", "only_j", *(F.round(c, 9).alias(c) for c in ("jaccard", "c_ij", "c_ji")), "peelable")


@query(SIDED + f""", n AS (SELECT count(*) AS n FROM (SELECT token FROM t GROUP BY token HAVING count(*) = 1))
SELECT n, (ceil(({CELLS_PER_KEY[3]}::FLOAT + 0.6::FLOAT) * n::FLOAT / 3::FLOAT + 1::FLOAT))::BIGINT AS chunk FROM n""")
def iblt_plan(spark, sf_dir):
    counted = sets.symmetric_difference(sided_sets(spark, sf_dir)).agg(F.count("*").alias("n"))
    per_key = F.lit(CELLS_PER_KEY[3]).cast("float") + F.lit(0.6).cast("float")
    return counted.select("n", F.ceil((per_key * F.col("n").cast("float") / F.lit(3).cast("float")).cast("float") + F.lit(1).cast("float")).cast("long").alias("chunk"))


# Bottom-s sketches

_H = sql.murmur_x64("h", "d", sql.bytes_of("token", 1, 8), sql.bytes_of("token", 9, 7), K, "42", "source, token")
_SWAP = " + ".join(f"((lo // {256**i}::UHUGEINT) % 256::UHUGEINT) * {256 ** (7 - i)}::UHUGEINT" for i in range(8))
SKETCH = KMERS + f", d AS (SELECT DISTINCT source, token FROM w), {_H}, b AS (SELECT DISTINCT source, {_SWAP} AS v FROM h), k AS (SELECT source, v, row_number() OVER (PARTITION BY source ORDER BY v) AS rank FROM b QUALIFY rank <= {S}) "


@query(SKETCH + "SELECT source, rank::INT AS rank, lpad(lower(hex(v::UBIGINT)), 16, '0') AS h FROM k")
def minhash_sketch(spark, sf_dir):
    found = minhash.sketch(by_source(spark, sf_dir), S, by=("source",), bases=K)
    return found.select("source", "rank", F.lower(F.hex("h")).alias("h"))


@query(SKETCH + f""", n AS (SELECT source, count(*) AS n FROM k GROUP BY source),
u AS (SELECT i.source AS source_i, j.source AS source_j, least({S}, i.n, j.n) AS most FROM n i JOIN n j ON i.source < j.source),
m AS (SELECT source_i, source_j, most, v, count(*) AS c FROM u JOIN k ON k.source = u.source_i OR k.source = u.source_j GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source_i, source_j ORDER BY v) AS rank FROM m QUALIFY rank <= most)
SELECT source_i, source_j, count(*) AS seen, count(*) FILTER (c = 2) AS shared, round(count(*) FILTER (c = 2) / count(*), 9) AS jaccard FROM r GROUP BY ALL""")
def minhash_pairs(spark, sf_dir):
    found = minhash.pairs(minhash.sketch(by_source(spark, sf_dir), S, by=("source",), bases=K), S, "source")
    return found.select("source_i", "source_j", "seen", F.col("shared").cast("long").alias("shared"), F.round("jaccard", 9).alias("jaccard"))


@query()
def weighted_samples(spark, sf_dir):
    counts = sets.spelled(sets.token_counts(by_source(spark, sf_dir), ("source",)), K)
    return minhash.weighted_samples(counts, 8, by=("source",))


@query()
def weighted_sketch(spark, sf_dir):
    counts = sets.spelled(sets.token_counts(by_source(spark, sf_dir), ("source",)), K)
    return minhash.weighted_sketch(counts, S, ("source",))


@query()
def weighted_compare(spark, sf_dir):
    counts = exchange.side_counts(flagged(spark, sf_dir), K)
    of = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"c{s}").alias("cnt")) for s in "ij"))).alias("x")
    found = checkpointed(minhash.weighted_sketch(counts.select("token", of).select("x.side", "token", "x.cnt").filter("cnt > 0"), S, ("side",), K))
    return minhash.weighted_compare(_of(found, "i"), _of(found, "j"), S)


@query(f"""WITH {DNA}, {SIDES}, q AS (SELECT side, doc_id, min(doc_id) OVER (PARTITION BY side, seq) AS first_id, seq FROM sided)
SELECT side, doc_id AS name, CASE WHEN doc_id <> first_id THEN 'duplicate' WHEN seq IN (SELECT seq FROM sided o WHERE o.side <> q.side) THEN 'common' ELSE 'only' END AS status
FROM q WHERE regexp_matches(seq, '[ACGT]{{{K},}}')""")
def collection_reconcile(spark, sf_dir):
    """Members are documents, told apart by sketches of their k-mers and by their whole sequences."""
    keys = reconcile.sequence_digests(bases(spark, sf_dir).select("doc_id", "seq"), K, s=1000)
    members = _by_side(_marked(spark, sf_dir, keys)).select("side", F.col("doc_id").alias("name"), "key")
    return reconcile.reconcile_keys(members, epsilon=0.6)


# Result tables, simulation, streams

RESULTS = PAIRS + ", res AS (SELECT source_i AS reference, source_j AS query, shared / (size_i + size_j - shared) AS exj, size_i + size_j - 2 * shared AS s FROM p) "


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sets.pairwise(by_source(spark, sf_dir), "source")
    return p.select(F.col("source_i").alias("reference"), F.col("source_j").alias("query"), F.col("jaccard").alias("exj"), (F.col("size_i") + F.col("size_j") - 2 * F.col("shared")).alias("s"))


@query(RESULTS + f"SELECT reference, query, round(exj, 9) AS exj, s, round(CASE WHEN exj = 0 THEN 1.0 ELSE -ln(2 * exj / (1 + exj)) / {K} END, 9) AS mutation_rate FROM res")
def result_mutation_rates(spark, sf_dir):
    found = reports.rate_of(_results(spark, sf_dir), "exj", K)
    return found.select("reference", "query", F.round("exj", 9).alias("exj"), "s", F.round("mutation_rate", 9).alias("mutation_rate"))


@query(RESULTS + "SELECT reference, query, 'exj' AS variable, round(exj, 9) AS value FROM res UNION ALL SELECT reference, query, 's', s::DOUBLE FROM res")
def result_melt(spark, sf_dir):
    wide = _results(spark, sf_dir).withColumn("s", F.col("s").cast("double"))
    return reports.melt(wide, ["reference", "query"], ["exj", "s"]).withColumn("value", F.round("value", 9))


@query(RESULTS + "SELECT reference, round(avg(exj), 9) AS exj, round(avg(s), 6) AS s FROM res GROUP BY reference")
def result_group_mean(spark, sf_dir):
    found = reports.group_mean(_results(spark, sf_dir), ["reference"], ["exj", "s"])
    return found.select("reference", F.round("exj", 9).alias("exj"), F.round("s", 6).alias("s"))


@query("SELECT o_orderpriority, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def result_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "custkey")
    found = reports.join_results(orders, customers, on=("custkey",))
    return found.groupBy("o_orderpriority", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT unnest(['count', 'mean', 'stddev', 'min', '25%', '50%', '75%', 'max']) AS statistic,
 unnest([count(l_quantity)::DOUBLE, round(avg(l_quantity), 6), round(stddev_samp(l_quantity), 6), min(l_quantity), quantile_cont(l_quantity, 0.25), quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.75), max(l_quantity)]) AS value FROM lineitem""")
def result_describe(spark, sf_dir):
    return reports.describe(table(spark, sf_dir, "lineitem"), "l_quantity").select("statistic", F.round("value", 6).alias("value"))


@query("SELECT p_brand, sum(CASE WHEN l_orderkey IS NULL THEN 1 ELSE 0 END)::BIGINT AS l_orderkey FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand")
def result_missing(spark, sf_dir):
    joined = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return reports.group_missing(joined, ["p_brand"], ["l_orderkey"])


@query(f"WITH {DNA} SELECT source, sum(length(seq))::BIGINT AS total_length FROM dna GROUP BY source")
def total_length(spark, sf_dir):
    return reports.total_length(bases(spark, sf_dir), by=("source",))


@query(f"WITH {DNA} SELECT doc_id, '>' || doc_id || chr(10) || seq AS value FROM dna")
def fasta_records(spark, sf_dir):
    rows = bases(spark, sf_dir)
    return writers.fasta_lines(rows, "seq", "doc_id").withColumn("doc_id", F.regexp_extract("value", r"^>(\d+)\n", 1).cast("long"))


_SIDE_OF = "sd AS (SELECT DISTINCT side, doc_id FROM sided)"


@query(f"""WITH {DNA}, {SIDES}, {_SIDE_OF}, {sql.windows('w', K)}, d AS (SELECT DISTINCT token FROM w), {sql.murmur_x86('h', 'd', 'token', K, 0, 'token')},
kept AS (SELECT token FROM h WHERE (h1::UHUGEINT + h2::UHUGEINT * 4294967296::UHUGEINT) % 10::UHUGEINT = 0), {sql.minimizers('p', K, K - Z + 1)}, {sql.syncmers('q', K, Z)},
t AS (SELECT 'exact' AS method, doc_id, token FROM w UNION ALL SELECT 'sampled', doc_id, token FROM w WHERE token IN (SELECT token FROM kept)
  UNION ALL SELECT 'minimizers', doc_id, substr(seq, pos + 1, {K}) FROM p UNION ALL SELECT 'syncmers', doc_id, substr(seq, pos + 1, {K}) FROM q),
m AS (SELECT method, token, count(DISTINCT side) AS n FROM t JOIN sd USING (doc_id) GROUP BY method, token)
SELECT method, round(count(*) FILTER (n = 2) / count(*), 9) AS jaccard FROM m GROUP BY method""")
def similarity_by_method(spark, sf_dir):
    return reports.similarity_by_method(flagged(spark, sf_dir), K, Z, 10).withColumn("jaccard", F.round("jaccard", 9))


@query(f"""WITH {DNA}, {SIDES}, {_SIDE_OF}, {sql.windows('w', K)}, {sql.syncmers('q', K, Z)},
e AS (SELECT doc_id, substr(seq, pos + 1, {K + G}) AS token FROM q WHERE pos + {K + G} < length(seq)
  UNION ALL SELECT doc_id, substr(seq, 1, {K + G}) FROM dna WHERE length(seq) >= {K + G} UNION ALL SELECT doc_id, substr(seq, length(seq) - {K + G} + 1) FROM dna WHERE length(seq) >= {K + G}),
x AS (SELECT token, min(side) AS side FROM w JOIN sd USING (doc_id) GROUP BY token HAVING count(DISTINCT side) = 1),
y AS (SELECT token, min(side) AS side FROM e JOIN sd USING (doc_id) GROUP BY token HAVING count(DISTINCT side) = 1),
z AS (SELECT DISTINCT side, substr(token, i, {K}) AS token FROM y, range(1, {G + 2}) AS r(i))
SELECT count(*) AS missing FROM x WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.side = x.side AND z.token = x.token)""")
def extended_syncmers_cover(spark, sf_dir):
    """k-mers of the exact difference that the difference of extended syncmers does not hold, by side."""
    return reports.extended_covers(flagged(spark, sf_dir), K, Z, G)


@query()
def mutants(spark, sf_dir):
    return simulate.mutate(bases(spark, sf_dir).select("doc_id", "seq"), 0.01, key="doc_id")


@query("SELECT i AS rec_no, 1000::BIGINT AS n FROM range(0, 100) AS r(i)")
def random_sequences(spark, sf_dir):
    return simulate.random_sequences(spark, 100, 1000).select("rec_no", F.length("seq").cast("long").alias("n"))


STREAM_SPEC = IbltSpec(16, 1000, epsilon=0.6)


@query(f"""WITH e AS (SELECT event_id::BIGINT AS key, unnest(range(0, {STREAM_SPEC.r})) AS row FROM events), {sql.murmur_x64("h", "e", sql.SWAPPED, None, 4, "42 + row", "*")}
SELECT row::INT AS row, (lo % {STREAM_SPEC.chunk})::BIGINT AS col, count(*) AS counter, bit_xor(key) AS key FROM h GROUP BY ALL""")
def stream_iblt(spark, sf_dir):
    """Cells of the set of events, from their stream; an event's number in base four is its token."""
    events = streams.read_table_stream(spark, sf_dir, "events")
    tokens = events.select(F.translate(F.lpad(F.conv(F.col("event_id").cast("string"), 10, 4), 16, "0"), "0123", "ACGT").alias("token"))
    return streams.run_to_end(streams.stream_cells(tokens, STREAM_SPEC), "stream_iblt_cells")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def stream_counts(spark, sf_dir):
    events = streams.read_table_stream(spark, sf_dir, "events")
    per_user = streams.run_to_end(events.groupBy("event_type", "user_id").agg(F.count("*").alias("n")), "stream_event_counts")
    return per_user.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("users"))



@query(f"""WITH d AS (SELECT DISTINCT lpad(event_id::VARCHAR, 15, '0') AS token FROM events), {sql.murmur_x64("h", "d", sql.bytes_of("token", 1, 8), sql.bytes_of("token", 9, 7), 15, "42", "*")},
b AS (SELECT DISTINCT {_SWAP} AS v FROM h), k AS (SELECT v, row_number() OVER (ORDER BY v) AS rank FROM b QUALIFY rank <= {S})
SELECT rank::INT AS rank, lpad(lower(hex(v::UBIGINT)), 16, '0') AS h FROM k""")
def stream_bottom(spark, sf_dir):
    """The smallest hashes of the events' numbers, from their stream."""
    tokens = streams.read_table_stream(spark, sf_dir, "events").select(F.lpad(F.col("event_id").cast("string"), 15, "0").alias("token"))
    return streams.run_to_end(streams.stream_bottom(tokens, S), "stream_bottom", "update").select("rank", F.lower(F.hex("h")).alias("h"))


@query("SELECT DISTINCT user_id::VARCHAR AS token FROM events")
def stream_distinct(spark, sf_dir):
    tokens = streams.read_table_stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("token"))
    return streams.run_to_end(streams.stream_distinct(tokens), "stream_users", "append")


# Keys of several words

K2, Z2, G2 = 31, 11, 10
WIDE = K2 + G2


@query(f"""WITH {DNA}, {SIDES}, {_SIDE_OF}, {sql.syncmers('q', K2, Z2)},
e AS (SELECT doc_id, substr(seq, pos + 1, {WIDE}) AS token FROM q WHERE pos + {WIDE} < length(seq)
  UNION ALL SELECT doc_id, substr(seq, 1, {WIDE}) FROM dna WHERE length(seq) >= {WIDE} UNION ALL SELECT doc_id, substr(seq, length(seq) - {WIDE} + 1) FROM dna WHERE length(seq) >= {WIDE}),
t AS (SELECT DISTINCT side, token FROM e JOIN sd USING (doc_id) WHERE NOT contains(token, '.')) SELECT min(side) AS side, token FROM t GROUP BY token HAVING count(*) = 1""")
def iblt_list_wide(spark, sf_dir):
    """The difference of extended syncmers of 41 bases, from tables whose keys are two words."""
    tokens = fragments.valid_tokens(fragments.syncmers(sided(spark, sf_dir), K2, Z2, G2).select("side", "token"))
    a, b, spec = _fitting(sets.membership(tokens), WIDE, 0)
    return iblt.list_any(iblt.difference(a, b, spec), spec).select("side", "token")


# Files written and read back


@query(CELLS + "SELECT * FROM a")
def iblt_file(spark, sf_dir):
    path = f"{fresh_folder(spark, 'sketch')}/i.bin"
    writers.write_bytes(spark, path, writers.sketch_bytes(iblt.build(one_side(spark, sf_dir, "i"), SPEC, distinct=False), SPEC))
    return readers.read_sketches(spark, path, SPEC.wsize).select("row", "col", "counter", "key")


_WHOLE = sql.murmur_x64("h", "d", sql.bytes_of("token", 1, 8), sql.bytes_of("token", 9, 7), K, "42", "token")


@query(KMERS + f""", d AS (SELECT DISTINCT token FROM w), {_WHOLE}, b AS (SELECT DISTINCT {_SWAP} AS v FROM h), k AS (SELECT v, row_number() OVER (ORDER BY v) AS rank FROM b QUALIFY rank <= {S})
SELECT rank::INT AS rank, lpad(lower(hex(v::UBIGINT)), 16, '0') AS h FROM k""")
def minhash_file(spark, sf_dir):
    path = f"{fresh_folder(spark, 'minhash')}/all.bin"
    writers.write_bytes(spark, path, writers.minhash_bytes(minhash.sketch(packed(spark, sf_dir), S, bases=K), 42))
    return readers.read_minhash(spark, path).select("rank", F.lower(F.hex("h")).alias("h"))


_PAIRS_OUT = "SELECT source_i, source_j, count(*) AS seen, count(*) FILTER (c = 2) AS shared, round(count(*) FILTER (c = 2) / count(*), 9) AS jaccard"


@query(ORACLES["minhash_pairs"].replace(_PAIRS_OUT, "SELECT source_i AS reference, source_j AS query, round(count(*) FILTER (c = 2) / count(*), 9) AS mhj"))
def distance_table(spark, sf_dir):
    path = fresh_folder(spark, "distances")
    found = minhash.pairs(minhash.sketch(by_source(spark, sf_dir), S, by=("source",), bases=K), S, "source")
    found.select("source_i", "source_j", F.lit(0.0), F.lit(0.0).alias("p"), F.concat_ws("/", "shared", "seen")).write.csv(path, sep="\t")
    return readers.read_distances(spark, path).withColumn("mhj", F.round("mhj", 9))


_RECORDS = f"WITH {DNA} SELECT doc_id, length(seq) AS n, md5(seq) AS digest FROM dna"


def _written_records(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_folder(spark, "records")
    writers.write_fasta(bases(spark, sf_dir), path, "seq", "doc_id")
    return path


def _digests(records: DataFrame) -> DataFrame:
    return records.select(F.col("name").cast("long").alias("doc_id"), F.length("seq").cast("long").alias("n"), F.md5("seq").alias("digest"))


@query(_RECORDS)
def fasta_file(spark, sf_dir):
    return _digests(readers.read_fasta(spark, _written_records(spark, sf_dir)))


@query(_RECORDS)
def fastx_file(spark, sf_dir):
    return _digests(readers.read_fastx(spark, _written_records(spark, sf_dir)))


@query(COUNTS + "SELECT token, cnt FROM c WHERE cnt >= 5")
def count_file(spark, sf_dir):
    path = fresh_folder(spark, "counts")
    writers.write_counts(sets.spelled(sets.token_counts(packed(spark, sf_dir)).filter("cnt >= 5"), K), path, ";")
    return readers.read_counts(spark, path, ";")


@query(KMERS + "SELECT DISTINCT token FROM w WHERE starts_with(token, 'ACG')")
def token_file(spark, sf_dir):
    path = fresh_folder(spark, "tokens")
    writers.write_tokens(sets.spelled(sets.token_set(packed(spark, sf_dir)), K).filter(F.startswith("token", F.lit("ACG"))), path)
    return readers.read_tokens(spark, path)


# Small parts of the engine


@query(KMERS + PER_DOC.format("w"))
def minimizers_of_length_k(spark, sf_dir):
    """Without a length, the minimizer of a k-mer is itself."""
    return per_doc(fragments.minimizers(bases(spark, sf_dir), K, 0))


@query(KMERS + PER_DOC.format("w"))
def valid_windows(spark, sf_dir):
    return per_doc(fragments.check_length(fragments.valid_tokens(fragments.windows(bases(spark, sf_dir), K), K), K))


@query(KMERS + f""", d AS (SELECT DISTINCT {sql.canonical('token')} AS token FROM w), {sql.murmur_x86('h', 'd', 'token', K, 0, 'token')}
SELECT token FROM h WHERE (h1::UHUGEINT + h2::UHUGEINT * 4294967296::UHUGEINT) % 10::UHUGEINT = 0""")
def canonical_sample(spark, sf_dir):
    return fragments.pipeline(bases(spark, sf_dir), K, canonical=True, rate=10)


@query(KMERS + f""", d AS (SELECT DISTINCT token FROM w), x AS (SELECT token, min(substr(token, i, {M})) AS minimizer FROM d, range(1, {K - M + 2}) AS r(i) GROUP BY token)
SELECT token, minimizer, substr(token, 1, strpos(token, minimizer) - 1) || '|' || substr(token, strpos(token, minimizer) + {M}) AS rest FROM x""")
def minimizer_and_rest(spark, sf_dir):
    tokens = sets.spelled(sets.token_set(packed(spark, sf_dir)), K)
    return tokens.select("token", dna.minimizer_and_rest(F.col("token"), M, dna.code).alias("x")).select("token", "x.*")


@query(KMERS + f"SELECT count(DISTINCT token) AS n, round(count(DISTINCT token) / ({(K - Z + 1) / 2} * 10), 6) AS planned FROM w")
def sampled_plan(spark, sf_dir):
    counted = sets.token_set(packed(spark, sf_dir)).agg(F.count("*").alias("n"))
    return counted.select("n", F.round(sampled_size(F.col("n"), K, Z, 10), 6).alias("planned"))


@query(f"SELECT c_custkey, translate(c_mktsegment, '{dna.AMBIGUOUS}', '{dna.FOLDED}') AS folded, translate(upper(c_mktsegment), 'U', 'T') AS upper_bases, CASE WHEN v >= 1000 THEN printf('%.1fK', v / 1000.0) ELSE printf('%.1f', v::DOUBLE) END AS short, CASE WHEN c_custkey > 10000 THEN 3 WHEN c_custkey > 10 THEN 2 WHEN c_custkey > 0 THEN 1 ELSE 0 END AS magnitude, TRY_CAST(c_mktsegment AS DOUBLE) AS number FROM (SELECT *, c_custkey % 9000 * 100 AS v FROM customer)")
def formats(spark, sf_dir):
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", dna.fold_ambiguous(segment).alias("folded"), dna.upper_bases(segment).alias("upper_bases"), dna.human_number(key % 9000 * 100).alias("short"), dna.time_magnitude(key * 100_000).alias("magnitude"), dna.number(segment).alias("number"))


@query("SELECT l_returnflag, round(sum(round(abs(l_tax - l_discount), 3))::DOUBLE, 3) AS errors FROM lineitem GROUP BY l_returnflag")
def result_errors(spark, sf_dir):
    found = reports.errors(table(spark, sf_dir, "lineitem"), "l_discount", ["l_tax"])
    return found.groupBy("l_returnflag").agg(F.sum("l_tax_error").alias("errors")).withColumn("errors", F.round("errors", 3))


@query("""SELECT l_returnflag, round(avg(l_discount), 9) AS l_discount_mean, round(avg(l_tax), 9) AS l_tax_mean, round(avg((l_tax - l_discount) * (l_tax - l_discount)), 9) AS l_tax_mse,
 round(var_pop(l_tax - l_discount), 9) AS l_tax_var FROM lineitem GROUP BY l_returnflag""")
def result_trials(spark, sf_dir):
    found = reports.trial_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", ["l_tax"])
    return found.select("l_returnflag", *(F.round(c, 9).alias(c) for c in found.columns if c != "l_returnflag"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def result_stack_complete(spark, sf_dir):
    """Orders, which have no segment, are below customers and fall out as incomplete."""
    both = reports.stack(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")))
    return reports.complete(both).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT '/x/' || doc_id || '.fa.gz' AS path FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def files_in_list(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("/x/"), F.col("doc_id").cast("string"), F.lit(".fa.gz")).alias("path"))
    return reports.in_list(files, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("name")))


@query("SELECT least(100, count(*)) AS n_queries, count(*) - least(100, count(*)) AS n_references FROM customer")
def query_split(spark, sf_dir):
    found = sets.query_split(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name")), "name", k=100)
    return found.agg(F.count_if("is_query").alias("n_queries"), F.count_if("is_reference").alias("n_references"))
