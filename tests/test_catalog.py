"""Every query of the catalogue against its SQL, on the smallest tables given."""

import numpy as np
import pytest

from setweave.plans import catalog
from tests.compare import duck_rows, spark_rows

GIVEN = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder():
    return GIVEN


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, folder, name):
    assert spark_rows(catalog.QUERIES[name](spark, folder)) == duck_rows(catalog.ORACLES[name], folder)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_rows(spark, folder, name):
    assert catalog.QUERIES[name](spark, folder).count() > 0


def test_members_of_one_sketch_are_told_apart(spark, tmp_path):
    """Long documents that differ in a word, or after the last k-mer, have the same k-mers among the smallest hashes."""
    rng = np.random.default_rng(5)
    words = ["".join(w) for w in rng.choice(list("abcdefghijklmnop"), (4000, 6)).tolist()]
    texts = [" ".join(words), *(" ".join([*words[:n], "changed", *words[n + 1 :]]) for n in (3000, 3500, 3998)), " ".join([*words, ". no"]), " ".join([*words, ". to"]), " ".join(words)]
    spark.createDataFrame([(i, t, "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 0, 0), (6, 0, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    found = spark_rows(catalog.QUERIES["collection_reconcile"](spark, str(tmp_path)))
    assert found == duck_rows(catalog.ORACLES["collection_reconcile"], str(tmp_path), ("documents", "labels"))


def test_reconciling_exchanges_no_tokens(spark, tmp_path):
    """What is shuffled is the texts once and little for each member. Texts that are null, short or of a repeated id are members, or none, as in SQL."""
    rng = np.random.default_rng(6)
    texts = [" ".join("".join(w) for w in rng.choice(list("abcdefghijklmnop"), (3000, 6)).tolist()) for _ in range(40)]
    rows = [*enumerate(texts), (100, texts[3]), (101, None), (102, ""), (103, "too short"), (104, texts[4]), (104, texts[5]), (105, texts[6] + " more")]
    spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 0, 0), (2, 0, 0), (7, 1, 1), (100, 0, 1), (104, 0, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    found = spark_rows(catalog.QUERIES["collection_reconcile"](spark, str(tmp_path)))
    assert shuffled() - before < 1.5 * sum(len(t or "") for _, t in rows)
    assert found == duck_rows(catalog.ORACLES["collection_reconcile"], str(tmp_path), ("documents", "labels"))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
