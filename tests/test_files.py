import gzip
from datetime import date

import pytest
from pyspark.sql import functions as F

from helpers import bag
from kicknet.plans.presets import LEGACY, LEGACY_ROLES
from kicknet.plans.samples import preview_scores, score_samples
from kicknet.functions.names import clean_names
from kicknet.operators.selection import ColumnRoles
from kicknet.sources.driver_tables import write_export
from kicknet.sources.master import prune_master, scan_taxa
from kicknet.sources.observations import ROW_ORDER, header_of, headers_of, preview_columns, scan_observations
from kicknet.sources.scores import write_scores
from kicknet.sources.workspace import once, written

MASTER_CSV = """ID,BIOSNAME,CODE,TOLERANCE,FFG,ORDER,FAMILY,GENUS,GROUP,TRIBE_ETC,CLASS,PHYLUM
1,Gen sp.,x,2.5,SC,Coleoptera,FAM,GEN,,,INSECTA,P
2,GEN,x,3,SC,Coleoptera,FAM,GEN,,,INSECTA,P
x,broken,x,n/a,,,,,,,,
"""
HEADER = "Monitoring Location ID,Activity Start Date,Activity Start Time,Equipment ID,Biological Individual ID,Taxonomic Name,Result Value,Characteristic Name,Result Comment\n"
EXPORT = (
    "Exported by hand\n"
    + HEADER
    + 'AB-01,45000,0.4375,20-jab,1,"Gen, sp. ""a""",12,Count,\n'
    + "AB-01,45000,0.4375,20-jab,1,Gen,x,Count,\n"
    + "AB-01,45000,0.4375,20-jab,1,Gen,7,Count,rare\n"
    + "AB-02,45001,10:30,spade,1,Gen,7,Count,\n"
    + "\n"
)


@pytest.fixture
def export(tmp_path):
    (tmp_path / "a.csv").write_text(EXPORT)
    (tmp_path / "b.csv").write_text("Another preamble, with a comma\n" + HEADER + "AB-03,45002,0.5,Multiplate,2,GEN,4,Count,\n")
    return str(tmp_path)


def test_scan_skips_preamble_and_header_of_each_file(spark, export):
    df = scan_observations(spark, export)
    assert preview_columns(df) == HEADER.strip().split(",")
    got = bag(df, "Monitoring Location ID", "Taxonomic Name", "Result Value", "Result Comment")
    assert got == {
        ("AB-01", 'Gen, sp. "a"', "12", None): 1, ("AB-01", "Gen", "x", None): 1,
        ("AB-01", "Gen", "7", "rare"): 1, ("AB-02", "Gen", "7", None): 1, ("AB-03", "GEN", "4", None): 1,
    }
    ordered = df.orderBy(*ROW_ORDER).select("Result Value").collect()
    assert [r[0] for r in ordered] == ["12", "x", "7", "7", "4"]


def test_parquet_scan_has_a_row_order(spark, tmp_path):
    spark.range(5).selectExpr("10 - id as x").coalesce(1).write.parquet(str(tmp_path / "p"))
    df = scan_observations(spark, str(tmp_path / "p"), "parquet")
    assert [r.x for r in df.orderBy(*ROW_ORDER).collect()] == [10, 9, 8, 7, 6]


def test_other_formats_are_refused(spark, tmp_path):
    for call in (
        lambda: scan_observations(spark, str(tmp_path), "xlsx"),
        lambda: scan_taxa(spark, str(tmp_path), "xls"),
        lambda: write_scores(spark.range(1), str(tmp_path), "xlsx"),
    ):
        with pytest.raises(ValueError, match="format"):
            call()
    with pytest.raises(ValueError, match="no column"):
        prune_master(spark.range(1))


def scan_master(spark, tmp_path):
    (tmp_path / "master.csv").write_text(MASTER_CSV)
    return scan_taxa(spark, str(tmp_path / "master.csv"))


def test_master_scan(spark, tmp_path):
    got = bag(scan_master(spark, tmp_path), "id", "biosname", "tolerance", "group_", "class_")
    assert got == {
        (1.0, "Gen sp.", 2.5, None, "INSECTA"): 1, (2.0, "GEN", 3.0, None, "INSECTA"): 1,
        (None, "broken", None, None, None): 1,
    }


def test_from_export_to_written_scores(spark, export, tmp_path_factory):
    folder = tmp_path_factory.mktemp("out")
    obs = clean_names(scan_observations(spark, export).withColumnsRenamed({"_file": "f", "_block": "b", "_line": "l"}))
    roles = ColumnRoles(
        "monitoring_location_id", "activity_start_date", "activity_start_time", "equipment_id",
        "biological_individual_id", "taxonomic_name", "result_value",
    )
    scores = score_samples(obs, scan_master(spark, folder), roles, order_cols=["f", "b", "l"])
    rows = {r[0]: r for r in scores.collect()}
    assert set(rows) == {"AB-01", "AB-03"}
    assert rows["AB-01"]["activity_start_date"] == date(2023, 3, 15)
    assert rows["AB-01"]["activity_start_time"] == "10:30"
    # one count could not be read, so the sums are missing and count as 0
    assert rows["AB-01"]["MBI"] == 0 and rows["AB-03"]["MBI"] == 3.0
    path = write_scores(scores, str(folder), "csv", date(2024, 5, 1))
    assert path.endswith("mIBI_scores-2024-05-01.csv")
    assert spark.read.option("header", True).csv(path).columns == scores.columns
    assert write_scores(preview_scores(scores, roles.sample_key), str(folder), dated=False).endswith("mIBI_scores.parquet")
    with pytest.raises(Exception, match="(?i)exists"):
        write_scores(scores, str(folder), "csv", date(2024, 5, 1))


def test_legacy_columns(spark, tmp_path):
    columns = [
        "Monitoring Location ID", "Activity Start Date", "Activity Start Time", "Equipment ID",
        "Characteristic Name", "Result Value", "Result Unit", "Taxonomic Name",
        "Biological Individual ID", "Tolerance Value", "line",
    ]
    rows = [
        ("A", "d", "t", "20-jab", "any", 4.0, "u", "n", "1", 5.0, 1),
        ("A", "d", "t", "20-jab", "any", 4.0, "u", "n", "77", 5.0, 2),
        ("A", "d", "t", "20-jab", "any", 4.0, "u", "n", "1", 99.9, 3),
        ("A", "d", "t", "Multiplate", "any", 4.0, "u", "n", "1", 5.0, 4),
        ("B", "d", "t", "20-jab", "any", -1.0, "u", "n", "1", 5.0, 5),
    ]
    obs = spark.createDataFrame(rows, columns)
    got = score_samples(obs, scan_master(spark, tmp_path), LEGACY_ROLES, LEGACY, ["line"]).collect()
    # the record without a master row is a taxon of its own, without tolerance
    assert [(r[0], r["TotalTaxa_Value"], r["MBI"]) for r in got] == [("A", 2, 0.0)]
    text = obs.withColumn("Result Value", F.col("Result Value").cast("string"))
    got = score_samples(text, scan_master(spark, tmp_path), LEGACY_ROLES, LEGACY, ["line"]).collect()
    assert [(r[0], r["TotalTaxa_Value"], r["MBI"]) for r in got] == [("A", 2, 0.0)]
    text = text.withColumn("Tolerance Value", F.when(F.col("line") == 2, "n/a").otherwise(F.col("Tolerance Value").cast("string")))
    got = score_samples(text, scan_master(spark, tmp_path), LEGACY_ROLES, LEGACY, ["line"]).collect()
    assert [(r[0], r["TotalTaxa_Value"]) for r in got] == [("A", 1)]


def test_headers_in_another_order_and_other_headers(spark, tmp_path):
    (tmp_path / "1.csv").write_text("pre\na,b\n1,2\n")
    (tmp_path / "2.csv").write_text("pre\nb,a\n4,3\n")
    assert bag(scan_observations(spark, str(tmp_path)), "a", "b") == {("1", "2"): 1, ("3", "4"): 1}
    (tmp_path / "3.csv").write_text("pre\na,c\n4,3\n")
    with pytest.raises(ValueError, match="has the columns"):
        scan_observations(spark, str(tmp_path))


def test_written_exports_scan_back(spark, tmp_path):
    df = spark.range(20, numPartitions=3).selectExpr("cast(id as string) as a", "if(id % 2 = 0, 'x,y', null) as b")
    write_export(df, str(tmp_path / "e"), "preamble")
    assert bag(scan_observations(spark, str(tmp_path / "e")), "a", "b") == bag(df)


def test_the_header_pass_reads_the_heads_of_files_only(spark, tmp_path):
    wide = ",".join(f"column {i}" for i in range(20_000))  # a header longer than one read
    (tmp_path / "long").mkdir()
    (tmp_path / "long" / "1.csv").write_text(f"pre\n{wide}\r\n" + "x,y\n" * 10)
    assert len(header_of(spark, str(tmp_path / "long"), 2)) == 20_000
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "1.csv").write_text("pre\na,b\n" + "1,2\n" * 2_000_000)
    (tmp_path / "big" / "2.csv").write_text("pre\na,b")
    (tmp_path / "big" / "3.csv").write_text("pre")
    files = spark._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics()
    before = files.get("file").getLong("bytesRead")
    found = headers_of(spark, str(tmp_path / "big"), 2)
    assert files.get("file").getLong("bytesRead") - before < 300_000
    assert [name[-5:] for name in found[("a", "b")]] == ["1.csv", "2.csv"] and len(found) == 1


def test_compressed_exports_have_headers(spark, tmp_path):
    with gzip.open(tmp_path / "1.csv.gz", "wt") as f:
        f.write("pre\na,b\n1,2\n")
    assert bag(scan_observations(spark, str(tmp_path)), "a", "b") == {("1", "2"): 1}


def test_a_table_kept_for_the_session_is_made_once(spark, tmp_path):
    source, made = tmp_path / "source", []

    def make():
        made.append(1)
        return spark.read.text(str(source))

    source.write_text("a\n")
    for _ in range(2):
        assert bag(once(spark, "lines", [str(source)], make)) == {("a",): 1}
    source.write_text("a\nb\n")
    assert once(spark, "lines", [str(source)], make).count() == 2 and len(made) == 2
    assert bag(written(spark.range(3))) == {(0,): 1, (1,): 1, (2,): 1}
