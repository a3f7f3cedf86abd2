import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import KEY, MASTER_DDL, ROWS_DDL, bag, physical_plan, taxon_row
from kicknet.operators import matching, taxa
from kicknet.operators import redundancy as R
from kicknet.operators.matching import anti_join_all, keep_first, null_safe_join, repeat_rows
from kicknet.operators.taxa import OVERRIDES, join_taxa_by_id, standardize_taxa
from kicknet.plans.presets import CURRENT, LEGACY


def test_anti_join_matches_nulls_and_keeps_copies(spark):
    ddl = "a int, b string, c double"
    left = spark.createDataFrame([(1, None, 0.0), (1, None, 0.0), (2, "x", None), (2, "x", None), (3, "y", 1.0)], ddl)
    right = spark.createDataFrame([(1, None, -0.0), (1, None, 0.0), (3, "y", None)], ddl)
    assert bag(anti_join_all(left, right)) == {(2, "x", None): 2, (3, "y", 1.0): 1}
    other = right.withColumn("d", F.lit(1)).select("d", "a")
    assert bag(anti_join_all(left, other)) == {(2, "x", None): 2}
    plan = physical_plan(anti_join_all(left, right))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_null_safe_join_of_unlike_types(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    right = spark.createDataFrame([(1.0, 10), (None, 20), (1.5, 30)], "k double, w int")
    assert bag(null_safe_join(left, right, ["k"], "left", ["w"])) == {(1, "a", 10): 1, (None, "b", 20): 1}


def test_keep_first_takes_the_row_entire(spark):
    df = spark.createDataFrame(
        [("s", None, 3, "late"), ("s", None, 1, None), ("s", "n", 2, "only"), ("t", None, 9, "t")],
        "site string, name string, seq int, note string",
    )
    got = keep_first(df, ["site", "name"], ["seq"])
    assert bag(got) == {("s", None, 1, None): 1, ("s", "n", 2, "only"): 1, ("t", None, 9, "t"): 1}
    assert physical_plan(got).count("Exchange ") == 1 and "partial_min" in physical_plan(got)


def test_repeated_rows_are_numbered_across_spans(spark):
    df = spark.createDataFrame([("a", 3), ("b", 0), ("c", 11), ("d", None), ("e", -2)], "k string, n int")
    got = bag(repeat_rows(df, F.col("n"), "i", chunk=4), "k", "i")
    assert got == Counter([("a", i) for i in (1, 2, 3)] + [("c", i) for i in range(1, 12)])


def master(spark):
    return spark.createDataFrame(
        [
            (1.0, "Gen sp. 1", 5.0, "SC", "ORD", "FAM", "GEN", "GRP", None, "INSECTA", "P"),
            (1.0, "Gen sp. 1 again", 6.0, "CG", "ORD", "FAM", "GEN", None, None, "INSECTA", "P"),
            (2.0, "GEN", 4.0, "SC", "ORD", "FAM", "GEN", None, None, "INSECTA", "P"),
            (3.0, "GEN", 7.0, None, "ORD", "FAM", "GEN", None, None, "INSECTA", "P"),
            (4.0, "Mussel", 2.0, None, None, "Unionidae", None, None, None, "BIVALVIA", "M"),
            (5.0, "semi", 99.9, None, "ORD", None, "SEMI", None, None, None, "P"),
            (6.0, "unrated", None, None, "ORD", None, "UNR", None, None, None, "P"),
            (None, None, 3.0, "PR", None, None, None, None, None, None, None),
            (7.0, "Odd clam", 8.0, None, None, "F", None, None, None, "Pisidiidae", "M"),
            (8.0, "SPHAERIIDAE", 99.9, "CF", None, "SPHAERIIDAE", None, None, None, None, "M"),
        ],
        MASTER_DDL,
    )


def literal_standard(obs, taxa_df, overrides, chain, identified_only):
    """Two joins on the observations, one after the other."""
    joined = join_taxa_by_id(obs, taxa_df)
    if identified_only:
        joined = joined.where(taxa.identified())
    named = joined.select("site", "n", taxa.standard_name(overrides, chain).alias("std"))
    return named.join(taxa_df, F.col("std").eqNullSafe(F.col("biosname")), "left").drop("biosname")


@pytest.mark.parametrize("preset,identified_only", [(CURRENT, True), (LEGACY, False)])
@pytest.mark.parametrize("small", [True, False])
def test_standardised_rows_equal_two_joins(spark, monkeypatch, preset, identified_only, small):
    if not small:
        monkeypatch.setattr(matching.broadcast_if_small, "__defaults__", (None, 0, 0))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = [1.0, 2.0, 4.0, 4.0, 5.0, 6.0, 7.0, 99.0, None]
        obs = spark.createDataFrame([("A", float(i), x) for i, x in enumerate(ids)], "site string, n double, id double")
        m = master(spark)
        got = standardize_taxa(obs, m, OVERRIDES, preset.rank_chain, identified_only)
        want = literal_standard(obs, m, OVERRIDES, preset.rank_chain, identified_only)
        names = ["site", "n", "id", "tolerance", "ffg", "family", "genus", "class_"]
        assert bag(got, *names) == bag(want, *names)
        plan = physical_plan(got)
        assert ("BroadcastHashJoin" in plan) == small and "NestedLoop" not in plan
        if identified_only and small:
            # a repeated id, and a standard name listed twice: four rows out of one
            assert sum(n for row, n in bag(got, "n", "biosname").items() if row == (0.0, "GEN")) == 4
            assert bag(got, "biosname", "tolerance")["SPHAERIIDAE", 99.9] == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_master_order_is_carried(spark):
    m = master(spark).withColumn("line", F.monotonically_increasing_id())
    obs = spark.createDataFrame([("A", 1.0, 2.0)], "site string, n double, id double")
    got = standardize_taxa(obs, m, OVERRIDES, CURRENT.rank_chain, True, ["line"])
    assert got.columns[-2:] == taxa.standard_order(["line"]) and got.count() == 2


def test_redundancy_compares_whole_rows(spark):
    fam = dict(family="F", order_="O", class_="C", phylum="P", id=1.0)
    rows = spark.createDataFrame(
        [taxon_row(1, "F", 4.0, **fam), taxon_row(2, "F", 4.0, **fam), taxon_row(3, "F", 5.0, **fam)], ROWS_DDL
    )
    assert bag(R.redundant_family(rows, KEY, ["seq"]), "seq") == {(3,): 1}
    assert bag(R.drop_redundant(rows, KEY, ["seq"]), "seq") == {(1,): 1, (2,): 1}
    later = rows.withColumn("seq", 10 - F.col("seq"))
    assert bag(R.drop_redundant(later, KEY, ["seq"]), "seq") == {(7,): 1}


def test_first_rows_of_a_name_only(spark):
    order = dict(order_="O", class_="C", phylum="P")
    rows = spark.createDataFrame(
        [
            taxon_row(1, "O", 4.0, id=1.0, **order),
            taxon_row(2, "O other", 4.0, id=2.0, **order),
            taxon_row(3, "O other", 9.0, id=2.0, **order),
            taxon_row(4, "G", 1.0, id=3.0, genus="G", family="F", **order),
        ],
        ROWS_DDL,
    )
    # the second row of a name is never taken off, though its order was seen
    assert bag(R.drop_redundant(rows, KEY, ["seq"]), "seq") == {(1,): 1, (3,): 1, (4,): 1}


def by_anti_joins(rows):
    """The rules one after the other, each as an anti-join."""
    found = [R.redundant_tribe(rows, KEY, ["seq"]), R.redundant_family(rows, KEY, ["seq"])]
    found += [R.redundant_rank(rows, KEY, ["seq"], missing) for missing in R.COARSE_RANKS]
    for doubles in found:
        rows = anti_join_all(rows, doubles, ["seq"])
    return rows


def random_rows(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        ranks = {r: rng.choice([None, None, f"{r[0]}1", f"{r[0]}2"]) for r in ("genus", "group_", "tribe_etc", "family", "order_", "class_", "phylum")}
        rows.append(taxon_row(rng.randrange(n), rng.choice(["a", "b", "c", None]), rng.choice([1.0, 2.0, None]), rng.choice("ABC"), id=rng.choice([1.0, None]), **ranks))
    return rows + rows[: n // 4]


def test_drop_redundant_equals_anti_joins(spark):
    rows = spark.createDataFrame(random_rows(3), ROWS_DDL).cache()
    got, want = bag(R.drop_redundant(rows, KEY, ["seq"])), bag(by_anti_joins(rows))
    assert got == want and sum(got.values()) < rows.count()


def test_one_sample_with_most_rows(spark):
    """A sample that dwarfs the others reaches the shuffle as a few rows per task."""
    fam = dict(genus=None, family="F", order_="O", class_="C", phylum="P", id=1.0)
    constants = dict(zip([f.split()[0] for f in ROWS_DDL.split(", ")], taxon_row(0, "F", 4.0, **fam)))
    constants.update(seq=F.expr("cast(id % 20000 as int)"), result_val=F.expr("(id % 20000) % 7 + 0.0d"))
    types = {f.split()[0]: f.split()[1] for f in ROWS_DDL.split(", ")}
    rows = spark.range(30000).select(
        *[(v if hasattr(v, "cast") else F.lit(v)).cast(types[c]).alias(c) for c, v in constants.items()]
    )
    kept = R.drop_redundant(rows, KEY, ["seq"])
    assert bag(kept.groupBy("result_val").count()) == bag(rows.where("result_val = 0").groupBy("result_val").count())


def test_a_table_beyond_the_bounds_is_not_broadcast(spark):
    left = spark.createDataFrame([(1, "a")], "k int, v string")
    large = matching.broadcast_if_small(spark.createDataFrame([(1, "b")], "k int, w string"), max_rows=0)
    joined = left.join(large, "k", "left")
    assert "SortMergeJoin" in physical_plan(joined) and bag(joined) == {(1, "a", "b"): 1}


def test_first_rows_are_sorted_in_as_many_tasks_as_a_shuffle_has(spark):
    fam = dict(family="F", order_="O", class_="C", phylum="P", id=1.0)
    rows = spark.createDataFrame([taxon_row(i, "F", float(i), **fam) for i in range(20)], ROWS_DDL).coalesce(1)
    got = R.drop_redundant(rows, KEY, ["seq"])
    assert "REPARTITION_BY_NUM" in physical_plan(got) and bag(got, "result_val") == {(0.0,): 1}
