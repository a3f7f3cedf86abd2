"""Steps whose tasks do not grow with the table."""

import pytest

from helpers import KEY, MASTER_DDL, ROWS_DDL, bag, taxon_row
from kicknet.operators import redundancy as R
from kicknet.operators.matching import shuffle_partitions
from kicknet.plans.presets import LEGACY, LEGACY_ROLES
from kicknet.plans.samples import score_samples
from kicknet.sources import workspace
from kicknet.sources.workspace import ADVISORY, PARTITIONS, bounded


def test_settings_follow_the_rows_and_are_put_back(spark, monkeypatch):
    monkeypatch.setattr(workspace, "TASK_ROWS", 10)
    before = spark.conf.get(PARTITIONS), spark.conf.get(ADVISORY, None)
    seen = []

    def step(df):
        seen.append((shuffle_partitions(df), int(spark.conf.get(ADVISORY))))
        return df.where("id % 2 = 0")

    assert bounded(spark.range(95), step, "even").count() == 48
    assert seen == [(10, workspace.TASK_BYTES)]
    assert (spark.conf.get(PARTITIONS), spark.conf.get(ADVISORY, None)) == before
    with pytest.raises(ZeroDivisionError):
        bounded(spark.range(5), lambda df: 1 / 0, "none")
    assert (spark.conf.get(PARTITIONS), spark.conf.get(ADVISORY, None)) == before


def test_smaller_settings_are_left(spark):
    spark.conf.set(ADVISORY, "20KB")
    try:
        with workspace.task_sizes(spark, 1):
            assert int(spark.conf.get(ADVISORY)) == 20 << 10 and int(spark.conf.get(PARTITIONS)) == 4
        assert spark.conf.get(ADVISORY) == "20KB"
    finally:
        spark.conf.unset(ADVISORY)


def test_rows_without_double_counts_are_the_same_in_many_tasks(spark, monkeypatch):
    fam = dict(family="F", order_="O", class_="C", phylum="P", id=1.0)
    rows = [taxon_row(i, "F", float(i % 5), site="AB"[i % 2], **fam) for i in range(60)]
    rows += rows[:20] + [(None, *rows[0][1:])]
    df = spark.createDataFrame(rows, ROWS_DDL)
    want = bag(R.drop_redundant(df, KEY, ["seq"]))
    monkeypatch.setattr(workspace, "TASK_ROWS", 7)
    assert bag(bounded(df, lambda kept: R.drop_redundant(kept, KEY, ["seq"]), "counted")) == want


def test_scores_derive_the_observations_once(spark):
    """Every branch of the double-count step used to standardise them anew."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    columns = [
        "Monitoring Location ID", "Activity Start Date", "Activity Start Time", "Equipment ID",
        "Result Value", "Taxonomic Name", "Biological Individual ID", "Tolerance Value", "line",
    ]
    rows = [("A", "d", "t", "20-jab", 4.0, "n", "1", 5.0, i) for i in range(6)]
    obs = spark.createDataFrame(rows, columns).mapInPandas(passed, spark.createDataFrame(rows, columns).schema)
    master = spark.createDataFrame([(1.0, "F", 3.0, None, "O", "F", None, None, None, "C", "P")], MASTER_DDL)
    got = score_samples(obs, master, LEGACY_ROLES, LEGACY, ["line"]).collect()
    assert [(r[0], r["TotalTaxa_Value"], r["MBI"]) for r in got] == [("A", 1, 3.0)] and seen.value == len(rows)
