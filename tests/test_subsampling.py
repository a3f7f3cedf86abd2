from collections import defaultdict

import pytest

from helpers import bag, physical_plan
from kicknet.operators import subsampling
from kicknet.operators.subsampling import expand_individuals, rarefy

DDL = "site string, id double, label string, count double"


def test_only_samples_above_the_target_are_drawn(spark):
    rows = (
        [("359", 1.0, "a", 359.0)]
        + [("360", 1.0, "a", 180.0), ("360", 1.0, "a", 180.0)]
        + [("361", 1.0, "a", 200.0), ("361", 2.0, "b", 161.0)]
        + [(None, 1.0, "a", 500.0)]
    )
    got = rarefy(spark.createDataFrame(rows, DDL), ["site"], "id")
    found = bag(got)
    assert found["359", 1.0, "a", 359.0] == 1 and found["360", 1.0, "a", 180.0] == 2
    totals = defaultdict(float)
    for (site, *_, n), times in found.items():
        totals[site] += n * times
    assert totals == {"359": 359.0, "360": 360.0, "361": 360.0, None: 360.0}


def test_draws_are_repeatable_and_within_the_counts(spark):
    rows = [("s", float(i), "x", 20.0 + i) for i in range(40)]
    df = spark.createDataFrame(rows, DDL)
    first = bag(rarefy(df, ["site"], "id", seed=1))
    assert first == bag(rarefy(df.repartition(7), ["site"], "id", seed=1))
    assert first != bag(rarefy(df, ["site"], "id", seed=2))
    assert all(n <= 20 + i for (_, i, _, n) in first) and sum(r[-1] for r in first) == 360


def test_rows_of_one_taxon_carry_its_whole_draw(spark):
    rows = [("s", 1.0, "a", 300.0), ("s", 1.0, "b", 300.0), ("s", 2.0, "a", 300.0)]
    got = rarefy(spark.createDataFrame(rows, DDL), ["site"], "id").collect()
    by_label = {(r.id, r.label): r["count"] for r in got}
    assert by_label[1.0, "a"] == by_label[1.0, "b"]
    assert by_label[1.0, "a"] + by_label[2.0, "a"] == 360


def test_fractions_are_cut(spark):
    rows = [("s", float(i), "x", 1.9) for i in range(200)]
    got = rarefy(spark.createDataFrame(rows, DDL), ["site"], "id").collect()
    assert len(got) == 200 and {r["count"] for r in got} == {1.0}


@pytest.mark.parametrize("bad", [None, -1.0, float("nan")])
def test_unusable_counts_are_refused(spark, bad):
    df = spark.createDataFrame([("s", 1.0, "x", 500.0), ("s", 2.0, "x", bad)], DDL)
    with pytest.raises(Exception, match="neither missing nor negative"):
        rarefy(df, ["site"], "id").collect()


def test_a_sample_of_billions(spark):
    df = spark.createDataFrame([("s", 1.0, "x", 3e9), ("s", 2.0, "x", 1e9), ("s", 3.0, "x", 1.0)], DDL)
    got = {r.id: r["count"] for r in rarefy(df, ["site"], "id", seed=4).collect()}
    assert sum(got.values()) == 360 and 230 < got[1.0] < 310


def test_draws_are_uniform(spark):
    """Mean and variance of the number drawn of a taxon over many samples."""
    rows = [(f"s{i}", 1.0, "x", 30.0) for i in range(1500)] + [(f"s{i}", 2.0, "x", 70.0) for i in range(1500)]
    got = rarefy(spark.createDataFrame(rows, DDL), ["site"], "id", target=40, seed=3).where("id = 1")
    drawn = [r["count"] for r in got.collect()]
    mean = sum(drawn) / len(drawn)
    variance = sum((x - mean) ** 2 for x in drawn) / len(drawn)
    # hypergeometric: 40 out of 100, 30 marked
    assert mean == pytest.approx(12.0, abs=0.25)
    assert variance == pytest.approx(40 * 0.3 * 0.7 * 60 / 99, rel=0.15)


def test_limit_is_applied_before_the_shuffle(spark):
    df = spark.createDataFrame([("s", 1.0, "x", 500.0)], DDL)
    plan = physical_plan(rarefy(df, ["site"], "id"))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_individuals(spark):
    df = spark.createDataFrame([("s", 1.0, "x", 2.7), ("s", 2.0, "x", 0.0)], DDL)
    assert bag(expand_individuals(df, "count"), "id", "individual") == {(1.0, 1): 1, (1.0, 2): 1}


def test_tasks_of_the_draw_follow_from_the_number_of_times(spark, monkeypatch):
    rows = [(f"s{s}", float(i), "x", 30.0) for s in range(20) for i in range(20)]
    df = spark.createDataFrame(rows, DDL)
    usual = rarefy(df, ["site"], "id", seed=1)
    monkeypatch.setattr(subsampling, "TIMES_PER_TASK", 1000)
    spread = rarefy(df, ["site"], "id", seed=1)
    # 20 samples of 20 kinds with 30 times each
    assert "hashpartitioning(site" in physical_plan(spread) and ", 12), REPARTITION_BY_NUM" in physical_plan(spread)
    assert bag(spread) == bag(usual)
