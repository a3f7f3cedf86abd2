"""One query per operator over the generated tables: (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kicknet.functions.conversions import serial_to_clock, serial_to_date
from kicknet.functions.names import clean_names
from kicknet.operators import metrics as M
from kicknet.operators import redundancy as R
from kicknet.operators.ambiguity import APTC, DPAC, RPKC, resolve_ambiguous
from kicknet.operators.matching import anti_join_all, keep_first
from kicknet.operators.scoring import score_index, score_metrics
from kicknet.operators.selection import bind_roles, coerce_numeric, type_times
from kicknet.operators.subsampling import expand_individuals, rarefy
from kicknet.operators.taxa import (
    CLASS, FAMILY, GENUS, GROUP, ID, NAME, ORDER, PHYLUM, TOLERANCE, TRIBE, join_taxa_by_id,
)
from kicknet.plans import samples as S
from kicknet.plans.presets import LEGACY
from kicknet.sources import driver_tables as D
from kicknet.sources.master import SOURCE_NAMES, scan_taxa
from kicknet.sources.observations import ROW_ORDER as SCAN_ORDER
from kicknet.sources.observations import scan_observations
from kicknet.sources.workspace import bounded, work_folder

KEY = D.ROLES.sample_key
COUNT = D.ROLES.result_val
RANKS = [GENUS, GROUP, TRIBE, FAMILY, ORDER, CLASS, PHYLUM]
LEGACY_HERE = replace(LEGACY, tolerance_col=D.TOLERANCE_COL)
SEED = 17
DIGITS = 6

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def _standardized(spark: SparkSession, sf_dir: str, preset=S.CURRENT) -> DataFrame:
    return S.standardized_rows(
        D.observations(spark, sf_dir), D.taxa(spark, sf_dir), D.ROLES, preset, D.ROW_ORDER
    )


def _of_counted(spark: SparkSession, sf_dir: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a step makes of the rows without double counts."""
    rows = _standardized(spark, sf_dir)
    return bounded(rows, lambda kept: step(R.drop_redundant(kept, KEY, D.ROW_ORDER)), "counted")


def _content(df: DataFrame) -> DataFrame:
    return df.drop(*D.ROW_ORDER)


# --- sources and columns ---------------------------------------------------------------


def q_scan_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "export")
    D.write_export(D.observations(spark, sf_dir), folder, "Export, one line per organism count")
    return scan_observations(spark, folder).drop(*SCAN_ORDER)


def q_scan_observations_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "exports")
    obs = D.observations(spark, sf_dir)
    even = F.col("l_orderkey") % 2 == 0
    D.write_export(obs.where(even), f"{folder}/a", "Export, one line per organism count")
    other = obs.where(~even).select(*reversed(obs.columns))
    D.write_export(other, f"{folder}/b", "Export with its columns in another order")
    return scan_observations(spark, folder).drop(*SCAN_ORDER)


def q_scan_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "master")
    master = D.derive_taxa(spark, sf_dir).select(
        *[F.col(name).alias(source) for source, name in SOURCE_NAMES.items()],
        F.lit("not in use").alias("REMARK"),
    )
    master.write.option("header", True).csv(folder)
    return scan_taxa(spark, folder)


def q_clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = D.observations(spark, sf_dir).select(
        F.col("site").alias("Monitoring Location ID"),
        F.col("start_date").alias("Activity Start-Date"),
        F.col("result_val").alias("Result Value (#)"),
        (F.col("l_quantity") / 50).alias("% of Max"),
        F.col("bio_id").alias("1st ID"),
        F.col("l_orderkey").alias("Order Key"),
        F.col("l_linenumber").alias("Order.Key"),
        F.col("equip").alias("equipmentID"),
    )
    return clean_names(raw)


def q_bind_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind_roles(D.observations(spark, sf_dir), D.ROLES)


def q_coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = D.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_linenumber") == 3, "n/a")
        .when(F.col("l_linenumber") == 5, F.lit(None))
        .otherwise(F.col("l_quantity").cast("string"))
        .alias("amount"),
        F.concat(F.col("l_partkey").cast("string"), F.lit(".5")).alias("part"),
    )
    return coerce_numeric(text, ["amount", "part"])


def q_excel_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1899-12-30").cast("date"))
    return D.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        *[
            convert(days + F.col("l_linenumber") / 24.0).alias(name)
            for name, convert in (("start_date", serial_to_date), ("start_time", serial_to_clock))
        ],
    )


def q_type_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and times that are text, of every kind that an export may hold."""
    dates = ("45000", "2023-03-15", "20230315123456", "x", "45000.9", "45000d", "1e3")
    times = ("9:05", "10:30:00", "abc", "0.4375", "25:00", "23:59", "45000.5")

    def text(values: tuple[str, ...]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("l_linenumber"))

    table = D.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", text(dates).alias("start_date"), text(times).alias("start_time")
    )
    return type_times(table, D.ROLES)


# --- selection and standardisation -----------------------------------------------------


def q_filter_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.filter_observations(
        D.observations(spark, sf_dir), D.taxa(spark, sf_dir), D.ROLES, S.CURRENT, D.ROW_ORDER
    )


def q_legacy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.filter_observations(
        D.observations(spark, sf_dir), D.taxa(spark, sf_dir), D.ROLES, LEGACY_HERE, D.ROW_ORDER
    )


def q_legacy_filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legacy filter over text, as a csv scan gives it."""
    obs = D.observations(spark, sf_dir)
    text = obs.withColumns({c: F.col(c).cast("string") for c in ("result_val", D.TOLERANCE_COL)})
    return S.filter_observations(text, D.taxa(spark, sf_dir), D.ROLES, LEGACY_HERE, D.ROW_ORDER)


def q_join_taxa_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a part of the ids is beyond the master, so unmatched rows occur
    obs = D.observations(spark, sf_dir).select(
        *KEY, COUNT, (F.col("bio_id") * 1.5).alias(ID), *D.ROW_ORDER
    )
    return join_taxa_by_id(obs, D.taxa(spark, sf_dir))


def q_standardize_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _standardized(spark, sf_dir)


def q_legacy_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _standardized(spark, sf_dir, LEGACY_HERE)


# --- rows: matching and redundancy -----------------------------------------------------


def q_antijoin_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _content(_standardized(spark, sf_dir))
    return anti_join_all(rows, rows.where(F.col(GENUS).isNull() | (F.col(COUNT) < 12)))


def q_dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_first(_standardized(spark, sf_dir), [*KEY, NAME], D.ROW_ORDER)


def q_distinct_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample_keys(_standardized(spark, sf_dir), KEY)


def q_window_sample_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _standardized(spark, sf_dir).select(*KEY, NAME, COUNT, *D.ROW_ORDER)
    return M.sample_totals(rows, KEY, COUNT, "Total_ABUNDANCE")


def q_redundant_tribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.redundant_tribe(_standardized(spark, sf_dir), KEY, D.ROW_ORDER)


def q_redundant_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.redundant_family(_standardized(spark, sf_dir), KEY, D.ROW_ORDER)


def _redundant_rank(missing: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return R.redundant_rank(_standardized(spark, sf_dir), KEY, D.ROW_ORDER, missing)

    return query


def q_drop_redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_counted(spark, sf_dir, lambda counted: counted)


# --- metrics and scores ----------------------------------------------------------------


def _single(metric, raw: bool = False) -> Query:
    def of(rows: DataFrame) -> DataFrame:
        return M.single_metric(rows, KEY, COUNT, metric)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = of(_standardized(spark, sf_dir)) if raw else _of_counted(spark, sf_dir, of)
        return table if isinstance(metric, M.Richness) else _rounded(table, metric.name)

    return query


FRACTIONS = (M.BIOTIC_INDEX.name, M.PERCENT_SCRAPERS.name, M.PERCENT_EPT.name)
SCORED = (
    *FRACTIONS,
    "ColeopteraTaxa_Score",
    "EphemeropteraTaxa_Score",
    "TotalTaxa_Score",
    "IntolerantTaxa_Score",
    "MBI_score",
    "PercentScraper_Score",
)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_counted(spark, sf_dir, lambda counted: M.assemble_metrics(counted, KEY, COUNT))


def q_assemble_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_metrics(spark, sf_dir), *FRACTIONS)


def q_assemble_metrics_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _of_counted(spark, sf_dir, lambda counted: M.assemble_metrics_full_join(counted, KEY, COUNT))
    return _rounded(table, *FRACTIONS)


def q_score_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(score_metrics(_metrics(spark, sf_dir)), *SCORED)


def q_score_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = score_index(score_metrics(_metrics(spark, sf_dir)))
    return _rounded(table.select(*KEY, "mIBI"), "mIBI")


def q_classify_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score_table(_metrics(spark, sf_dir)).select(
        *KEY, "Comparison_to_Reference", "Narrative_Description"
    )


def _scores(spark: SparkSession, sf_dir: str, preset=S.CURRENT) -> DataFrame:
    return S.score_samples(
        D.observations(spark, sf_dir), D.taxa(spark, sf_dir), D.ROLES, preset, D.ROW_ORDER
    )


def q_score_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scores(spark, sf_dir), *SCORED, "mIBI")


def q_score_samples_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scores(spark, sf_dir, LEGACY_HERE), *SCORED, "mIBI")


def q_preview_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.preview_scores(_scores(spark, sf_dir), KEY), *SCORED, "mIBI")


# --- ambiguity and subsampling ---------------------------------------------------------


def _hierarchy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    count: Column = (F.col(COUNT) + 1).alias("count")
    return _standardized(spark, sf_dir).select(*KEY, NAME, *RANKS, count, *D.ROW_ORDER)


def _resolved(method: str, to_filter: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        resolved = resolve_ambiguous(
            _hierarchy_rows(spark, sf_dir), KEY, RANKS, "count", method, to_filter,
            order_cols=D.ROW_ORDER, seed=SEED,
        )
        return resolved if method == RPKC else _rounded(resolved, "new_count")

    return query


def q_resolve_rpkc_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence lists: no column of counts."""
    rows = _hierarchy_rows(spark, sf_dir).drop("count")
    return resolve_ambiguous(rows, KEY, RANKS, method=RPKC, order_cols=D.ROW_ORDER)


def _countable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _standardized(spark, sf_dir)
    return rows.select(*KEY, ID, NAME, TOLERANCE, F.col(COUNT).alias("count"))


def q_expand_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _standardized(spark, sf_dir).select(*D.ROW_ORDER[:3], COUNT)
    return expand_individuals(rows, COUNT).drop(COUNT)


def q_rarefy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rarefy(_countable_rows(spark, sf_dir), KEY, ID, "count", seed=SEED)


QUERIES: dict[str, Query] = {
    "scan_observations": q_scan_observations,
    "scan_observations_mixed_headers": q_scan_observations_mixed_headers,
    "scan_taxa": q_scan_taxa,
    "clean_names": q_clean_names,
    "bind_roles": q_bind_roles,
    "coerce_numeric": q_coerce_numeric,
    "excel_serial": q_excel_serial,
    "type_times": q_type_times,
    "filter_observations": q_filter_observations,
    "legacy_filter": q_legacy_filter,
    "legacy_filter_text": q_legacy_filter_text,
    "join_taxa_by_id": q_join_taxa_by_id,
    "standardize_taxa": q_standardize_taxa,
    "legacy_standardize": q_legacy_standardize,
    "antijoin_all_columns": q_antijoin_all_columns,
    "dedupe_keep_first": q_dedupe_keep_first,
    "distinct_samples": q_distinct_samples,
    "window_sample_total": q_window_sample_total,
    "richness_raw": _single(M.TOTAL_TAXA, raw=True),
    "redundant_tribe": q_redundant_tribe,
    "redundant_family": q_redundant_family,
    "redundant_order": _redundant_rank(FAMILY),
    "redundant_class": _redundant_rank(ORDER),
    "redundant_phylum": _redundant_rank(CLASS),
    "drop_redundant": q_drop_redundant,
    "metric_total_taxa": _single(M.TOTAL_TAXA),
    "metric_coleoptera_taxa": _single(M.COLEOPTERA_TAXA),
    "metric_ephemeroptera_taxa": _single(M.EPHEMEROPTERA_TAXA),
    "metric_intolerant_taxa": _single(M.INTOLERANT_TAXA),
    "metric_percent_scrapers": _single(M.PERCENT_SCRAPERS),
    "metric_percent_ept": _single(M.PERCENT_EPT),
    "metric_biotic_index": _single(M.BIOTIC_INDEX),
    "assemble_metrics": q_assemble_metrics,
    "assemble_metrics_full_join": q_assemble_metrics_full_join,
    "score_metrics": q_score_metrics,
    "score_index": q_score_index,
    "classify_index": q_classify_index,
    "score_samples": q_score_samples,
    "score_samples_legacy": q_score_samples_legacy,
    "preview_scores": q_preview_scores,
    "resolve_rpkc": _resolved(RPKC, True),
    "flag_rpkc": _resolved(RPKC, False),
    "resolve_rpkc_presence": q_resolve_rpkc_presence,
    "resolve_dpac": _resolved(DPAC, True),
    "flag_dpac": _resolved(DPAC, False),
    "resolve_aptc": _resolved(APTC, True),
    "flag_aptc": _resolved(APTC, False),
    "expand_individuals": q_expand_individuals,
    "rarefy": q_rarefy,
}
