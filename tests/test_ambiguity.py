import random
from collections import Counter, defaultdict

import pytest

from helpers import bag, physical_plan
from kicknet.operators import ambiguity
from kicknet.operators.ambiguity import APTC, DPAC, METHODS, RPKC, resolve_ambiguous

DDL = "site string, genus string, tribe string, family string, order_ string, count double, seq int"
RANKS = ["genus", "tribe", "family", "order_"]


def checker(rows, method):
    """The rule row by row: [(keep, new count, ambiguous for a tie)] per row; ties take any."""
    result = {}
    by_site = defaultdict(list)
    for i, row in enumerate(rows):
        by_site[row[0]].append(i)
    for members in by_site.values():
        keep = {i: rows[i][1] is not None for i in members}
        new = {i: float(rows[i][5]) for i in members}
        for level in range(2, len(RANKS) + 1):
            parents = defaultdict(list)
            for i in members:
                if not keep[i] and rows[i][level] is not None and not any(rows[i][1:level]):
                    parents[rows[i][level]].append(i)
            for value, lines in parents.items():
                below = [i for i in members if keep[i] and rows[i][level] == value]
                if not below:
                    for i in lines:
                        keep[i] = True
                    continue
                given = sum(rows[i][5] for i in lines)
                if method == DPAC:
                    held = sum(new[i] for i in below)
                    for i in below:
                        new[i] += given * new[i] / held
                elif method == APTC:
                    new[max(below, key=lambda i: new[i])] += given
        result.update({i: (keep[i], new[i]) for i in members})
    return [result[i] for i in range(len(rows))]


def random_rows(seed, n=500, distinct_counts=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ranks = [rng.choice([None, None, f"{r}{rng.randrange(3)}"]) for r in "gtfo"]
        count = i * 1.7 + 1 + rng.random() if distinct_counts else float(rng.randrange(1, 6))
        rows.append((rng.choice(["A", "B", "C", "D", None]), *ranks, count, i))
    return rows


@pytest.mark.parametrize("method", METHODS)
def test_against_the_rule_row_by_row(spark, method):
    rows = random_rows(5, distinct_counts=True)
    want = checker(rows, method)
    df = spark.createDataFrame(rows, DDL)
    flagged = {r.seq: r for r in resolve_ambiguous(df, "site", RANKS, method=method, to_filter=False, order_cols=["seq"]).collect()}
    assert len(flagged) == len(rows)
    for row, (keep, new) in zip(rows, want):
        got = flagged[row[-1]]
        assert got.is_ambiguous == (not keep), row
        if method != RPKC:
            assert got.new_count == pytest.approx(new if keep else row[5]), row
    kept = resolve_ambiguous(df, "site", RANKS, method=method, order_cols=["seq"])
    assert bag(kept, "seq") == Counter((r[-1],) for r, (keep, _) in zip(rows, want) if keep)
    if method != RPKC:
        assert sum(r.new_count for r in kept.collect()) == pytest.approx(sum(n for k, n in want if k))


def test_total_is_conserved_with_ties_and_copies(spark):
    rows = [r[:-1] + (0,) for r in random_rows(9)]
    rows += rows[:200]
    df = spark.createDataFrame(rows, DDL)
    some_rank = sum(r[5] for r in rows if any(r[1:5]))
    for method in (DPAC, APTC):
        kept = resolve_ambiguous(df, ["site"], RANKS, method=method).collect()
        assert sum(r.new_count for r in kept) == pytest.approx(some_rank)
    assert bag(resolve_ambiguous(df, "site", RANKS, method=APTC), *df.columns) == bag(
        resolve_ambiguous(df, "site", RANKS), *df.columns
    )


def test_one_of_two_equal_copies_receives(spark):
    rows = [("A", "g", "t", None, None, 3.0, 1)] * 2 + [("A", None, "t", None, None, 5.0, 2)]
    got = resolve_ambiguous(spark.createDataFrame(rows, DDL), "site", RANKS, method=APTC, order_cols=["seq"])
    assert bag(got, "genus", "count", "new_count") == {("g", 3.0, 8.0): 1, ("g", 3.0, 3.0): 1}


def test_ties_depend_on_the_seed_only(spark):
    rows = [("A", f"g{i}", "t", None, None, 3.0, i) for i in range(8)] + [("A", None, "t", None, None, 5.0, 9)]
    df = spark.createDataFrame(rows, DDL)

    def winner(seed, partitions=1):
        got = resolve_ambiguous(df.repartition(partitions), "site", RANKS, method=APTC, order_cols=["seq"], seed=seed)
        return [r.genus for r in got.where("new_count > 3").collect()]

    winners = [winner(seed) for seed in range(6)]
    assert all(len(w) == 1 for w in winners) and len({w[0] for w in winners}) > 1
    assert winner(2, 5) == winners[2]


def test_zero_and_missing_counts(spark):
    zero = [("A", "g1", "t", None, None, 0.0, 1), ("A", "g2", "t", None, None, 0.0, 2), ("A", None, "t", None, None, 5.0, 3)]
    got = resolve_ambiguous(spark.createDataFrame(zero, DDL), "site", RANKS, method=DPAC)
    assert bag(got, "genus", "new_count") == {("g1", "nan"): 1, ("g2", "nan"): 1}
    missing = [("A", "g1", "t", None, None, None, 1), ("A", "g2", "t", None, None, 2.0, 2), ("A", None, "t", None, None, 5.0, 3)]
    df = spark.createDataFrame(missing, DDL)
    got = resolve_ambiguous(df, "site", RANKS, method=DPAC)
    assert bag(got, "genus", "new_count") == {("g1", None): 1, ("g2", None): 1}
    got = resolve_ambiguous(df, "site", RANKS, method=APTC)
    assert bag(got, "genus", "new_count") == {("g1", None): 1, ("g2", 2.0): 1}
    given = [("A", "g1", "t", None, None, 1.0, 1), ("A", None, "t", None, None, None, 3)]
    got = resolve_ambiguous(spark.createDataFrame(given, DDL), "site", RANKS, method=APTC)
    assert bag(got, "genus", "new_count") == {("g1", None): 1}
    with pytest.raises(Exception, match="not negative"):
        resolve_ambiguous(
            spark.createDataFrame([("A", "g", None, None, None, -1.0, 1)], DDL), "site", RANKS, method=APTC
        ).collect()


def test_rows_without_ranks_and_single_rank(spark):
    rows = [("A", None, None, None, None, 1.0, 1), ("A", "g", None, None, None, 1.0, 2)]
    df = spark.createDataFrame(rows, DDL)
    for method in METHODS:
        assert bag(resolve_ambiguous(df, "site", RANKS, method=method), "seq") == {(2,): 1}
        assert bag(resolve_ambiguous(df, "site", ["genus"], method=method), "seq") == {(2,): 1}
        flagged = resolve_ambiguous(df, "site", RANKS, method=method, to_filter=False)
        assert bag(flagged, "seq", "is_ambiguous") == {(1, True): 1, (2, False): 1}


def test_refusals(spark):
    df = spark.createDataFrame(random_rows(1, 3), DDL)
    with pytest.raises(ValueError, match="RPKC-S"):
        resolve_ambiguous(df, "site", RANKS, method="RPKC")
    with pytest.raises(ValueError, match="nowhere"):
        resolve_ambiguous(df, "site", ["genus", "nowhere"])
    with pytest.raises(ValueError, match="already has"):
        resolve_ambiguous(df.withColumnRenamed("seq", "new_count"), "site", RANKS)


def test_column_order_and_plan(spark):
    df = spark.createDataFrame(random_rows(1, 3), DDL)
    got = resolve_ambiguous(df, ["order_", "site"], RANKS[:3], method=DPAC, to_filter=False)
    assert got.columns == ["order_", "site", "genus", "tribe", "family", "count", "seq", "is_ambiguous", "new_count"]
    plan = physical_plan(resolve_ambiguous(df, "site", RANKS))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # one exchange of the aggregated lines serves all levels
    assert plan.count("REPARTITION_BY_COL") == 1 and plan.count("Window [") >= len(RANKS) - 1


@pytest.mark.parametrize("method", METHODS)
def test_tasks_follow_from_the_number_of_lines(spark, monkeypatch, method):
    rows = [(f"s{s}", f"g{i}" if i % 3 else None, "t", "f", "o", 1.0 + i, i) for s in range(20) for i in range(6)]
    df = spark.createDataFrame(rows, DDL)
    usual = resolve_ambiguous(df, "site", RANKS, "count", method, False, ["seq"])
    monkeypatch.setattr(ambiguity, "LINES_PER_TASK", 10)
    spread = resolve_ambiguous(df, "site", RANKS, "count", method, False, ["seq"])
    # 20 groups of four genera and a tribe
    assert ", 10), REPARTITION_BY_NUM" in physical_plan(spread)
    assert bag(spread) == bag(usual)
