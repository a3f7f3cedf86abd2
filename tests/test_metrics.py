import pytest

from helpers import KEY, ROWS_DDL, bag, physical_plan, taxon_row
from kicknet.operators import metrics as M
from kicknet.operators.scoring import INDEX, classify_index, score_index, score_metrics
from kicknet.plans.samples import score_table


def table(spark, rows, **options):
    df = spark.createDataFrame(rows, ROWS_DDL)
    out = M.assemble_metrics(df, KEY, "result_val", **options)
    return {r.site: r.asDict() for r in out.collect()}


def sample(site, *rows):
    return [taxon_row(i, name, n, site=site, **attributes) for i, (name, n, attributes) in enumerate(rows)]


def test_a_plain_sample(spark):
    rows = sample(
        "A",
        ("b1", 10.0, dict(id=1.0, tolerance=2.0, ffg="SC", order_="Coleoptera")),
        ("b1", 5.0, dict(id=1.0, tolerance=2.0, ffg="SC", order_="Coleoptera")),
        ("b2", 5.0, dict(id=2.0, tolerance=99.9, order_="COLEOPTERA")),
        ("m", 20.0, dict(id=3.0, tolerance=3.0, order_="EPHEMEROPTERA")),
        ("s", 10.0, dict(id=4.0, tolerance=6.0, order_="Plecoptera")),
    )
    got = table(spark, rows)["A"]
    assert (got["TotalTaxa_Value"], got["ColeopteraTaxa_Value"]) == (4, 1)
    assert (got["EphemeropteraTaxa_Value"], got["IntolerantTaxa_Value"]) == (1, 2)
    assert got["PercentScrapers"] == 30.0 and got["Percent_EPT"] == 60.0
    assert got["MBI"] == pytest.approx((15 * 2 + 5 * 99.9 + 20 * 3 + 10 * 6) / 50)


def test_missing_values(spark):
    base = dict(id=1.0, tolerance=4.0, ffg="SC", order_="Trichoptera")
    rows = (
        sample("no tolerance", ("x", 3.0, base), ("y", 1.0, dict(id=2.0)))
        + sample("no count", ("x", None, base), ("y", 1.0, dict(id=2.0, tolerance=1.0)))
        + sample("no id", ("x", 3.0, base), ("y", 1.0, {}), ("z", 1.0, {}))
        + sample("all zero", ("x", 0.0, base))
        + sample("bare", ("x", 3.0, dict(id=9.0, tolerance=5.0)))
    )
    got = table(spark, rows)
    assert got["no tolerance"]["MBI"] == 0 and got["no tolerance"]["PercentScrapers"] == 75.0
    assert got["no count"]["MBI"] == got["no count"]["PercentScrapers"] == got["no count"]["Percent_EPT"] == 0
    assert got["no id"]["TotalTaxa_Value"] == 2
    assert got["all zero"]["MBI"] == got["all zero"]["Percent_EPT"] == 0
    assert got["bare"]["PercentScrapers"] == got["bare"]["ColeopteraTaxa_Value"] == 0
    strict = table(spark, rows, strict=True)
    assert strict["no tolerance"]["MBI"] is None and strict["no count"]["Percent_EPT"] is None
    assert strict["bare"]["PercentScrapers"] == 0 and strict["bare"]["MBI"] == 5.0


def test_one_pass_equals_full_joins(spark):
    base = dict(id=1.0, tolerance=4.0, ffg="SC", order_="Trichoptera")
    rows = sample("A", ("x", None, base)) + sample("B", ("x", 2.0, {}), ("y", 3.0, base)) + [
        taxon_row(1, "q", 2.0, site=None, id=5.0, tolerance=1.0)
    ]
    df = spark.createDataFrame(rows, ROWS_DDL)
    one = M.assemble_metrics(df, KEY, "result_val")
    assert bag(one) == bag(M.assemble_metrics_full_join(df, KEY, "result_val"), *one.columns)


def test_metrics_combine_before_both_shuffles(spark):
    df = spark.createDataFrame(sample("A", ("x", 1.0, {})), ROWS_DDL)
    plan = physical_plan(M.assemble_metrics(df, KEY, "result_val"))
    assert plan.count("Exchange ") == 2 and plan.count("partial_sum") >= 2 and "Expand" not in plan


def test_totals_spread_missing(spark):
    rows = sample("A", ("x", 1.0, {}), ("y", 2.0, {})) + sample("B", ("x", 1.0, {}), ("y", None, {}))
    df = M.sample_totals(spark.createDataFrame(rows, ROWS_DDL), KEY, "result_val", "total")
    assert bag(df, "site", "total") == {("A", 3.0): 2, ("B", None): 2}


def test_bands(spark):
    values = [0.0, 20.8, 20.85, 20.9, 41.8, 72.9, 72.95, 73.0, 100.0, -5.0, None]
    df = classify_index(spark.createDataFrame([(v,) for v in values], f"{INDEX} double"))
    assert [r.Narrative_Description for r in df.collect()] == [
        "Poor", "Poor", None, "Fair", "Good", "Good", None, "Exceptional", "Exceptional", None, None,
    ]
    labels = {r.Narrative_Description: r.Comparison_to_Reference for r in df.collect()}
    assert labels == {
        "Poor": "bisect 10th percentile (lower)", "Fair": "bisect 10th percentile (upper)",
        "Good": "> 10th percentile", "Exceptional": ">75th percentile", None: None,
    }


def test_scores_and_cap(spark):
    names = [m.name for m in M.METRICS]
    good = (92, 10, 102, 18, 0.0, 59.2, 74.0)
    plain = (23, 1, 0, 0, 7.95, 14.8, 10.0)
    df = spark.createDataFrame([good, plain], names)
    scored = score_index(score_metrics(df)).collect()
    assert scored[0][INDEX] == 100.0
    assert scored[0]["MBI_score"] == pytest.approx(11 / 6.1 * 100)
    assert scored[0]["TotalTaxa_Score"] == 200.0 and scored[0]["PercentScraper_Score"] == 200.0
    assert scored[1][INDEX] == pytest.approx((20 + 0 + 50 + 0 + 50 + 50 + 10) / 7)


def test_column_order(spark):
    rows = sample("A", ("x", 1.0, dict(id=1.0, tolerance=2.0)))
    out = score_table(M.assemble_metrics(spark.createDataFrame(rows, ROWS_DDL), KEY, "result_val"))
    assert out.columns[3:] == [
        "TotalTaxa_Value", "ColeopteraTaxa_Value", "EphemeropteraTaxa_Value", "IntolerantTaxa_Value",
        "MBI", "PercentScrapers", "Percent_EPT", "ColeopteraTaxa_Score", "EphemeropteraTaxa_Score",
        "TotalTaxa_Score", "IntolerantTaxa_Score", "MBI_score", "PercentScraper_Score", "mIBI",
        "Comparison_to_Reference", "Narrative_Description",
    ]


def test_the_full_join_derives_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = sample("A", ("x", 3.0, dict(id=1.0, tolerance=2.0, ffg="SC")), ("y", 1.0, dict(id=2.0)))
    df = spark.createDataFrame(rows, ROWS_DDL)
    got = M.assemble_metrics_full_join(df.mapInPandas(passed, df.schema), KEY, "result_val")
    assert bag(got) == bag(M.assemble_metrics(df, KEY, "result_val")) and seen.value == 2
