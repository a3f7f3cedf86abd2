"""From observations and a taxa master to scored samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kicknet.operators.metrics import assemble_metrics
from kicknet.operators.redundancy import drop_redundant
from kicknet.operators.scoring import classify_index, score_index, score_metrics
from kicknet.operators.selection import (
    ColumnRoles,
    bind_roles,
    coerce_numeric,
    countable,
    not_semi_aquatic,
    numeric_counts,
    taken_with,
    type_times,
)
from kicknet.operators.taxa import ID, identified, join_taxa_by_id, standard_order, standardize_taxa
from kicknet.plans.presets import CURRENT, Preset
from kicknet.sources.workspace import bounded


def select_observations(
    obs: DataFrame, roles: ColumnRoles, preset: Preset = CURRENT, order_cols: Sequence[str] = ()
) -> DataFrame:
    """The observations a preset takes in, typed, before any look at the master."""
    if preset.tolerance_col:
        picked = bind_roles(not_semi_aquatic(obs, preset.tolerance_col), roles, order_cols)
        picked = numeric_counts(coerce_numeric(picked, [ID]), roles.result_val)
    else:
        picked = bind_roles(countable(obs), roles, order_cols)
        picked = type_times(coerce_numeric(picked, [ID, roles.result_val]), roles)
    return taken_with(picked, roles, preset.gears)


def filter_observations(
    obs: DataFrame,
    taxa: DataFrame,
    roles: ColumnRoles,
    preset: Preset = CURRENT,
    order_cols: Sequence[str] = (),
) -> DataFrame:
    """Selected observations with the master's attributes of the recorded taxon."""
    joined = join_taxa_by_id(select_observations(obs, roles, preset, order_cols), taxa)
    return joined if preset.tolerance_col else joined.where(identified())


def standardized_rows(
    obs: DataFrame,
    taxa: DataFrame,
    roles: ColumnRoles,
    preset: Preset = CURRENT,
    order_cols: Sequence[str] = (),
    taxa_order: Sequence[str] = (),
) -> DataFrame:
    """Sample key, count and index taxon of every observation, and the order columns."""
    picked = select_observations(obs, roles, preset, order_cols)
    picked = picked.select(
        *[F.col(f"`{c}`") for c in [*roles.sample_key, roles.result_val]], ID, *order_cols
    )
    return standardize_taxa(
        picked,
        taxa,
        preset.overrides,
        preset.rank_chain,
        identified_only=preset.tolerance_col is None,
        taxa_order=taxa_order,
    )


def counted_rows(
    obs: DataFrame,
    taxa: DataFrame,
    roles: ColumnRoles,
    preset: Preset = CURRENT,
    order_cols: Sequence[str] = (),
    taxa_order: Sequence[str] = (),
) -> DataFrame:
    """The standardised rows without double counts: what the metrics are computed from."""
    return _of_counted_rows(
        standardized_rows(obs, taxa, roles, preset, order_cols, taxa_order),
        roles, order_cols, taxa_order, lambda counted: counted, "counted",
    )


def _of_counted_rows(rows: DataFrame, roles: ColumnRoles, order_cols, taxa_order, step, name: str):
    """What a step makes of the rows without double counts, in tasks of bounded size."""
    order = [*order_cols, *standard_order(taxa_order)]
    return bounded(rows, lambda kept: step(drop_redundant(kept, roles.sample_key, order)), name)


def score_table(metrics: DataFrame) -> DataFrame:
    """Scores, index and labels from a metric table."""
    return classify_index(score_index(score_metrics(metrics)))


def score_samples(
    obs: DataFrame,
    taxa: DataFrame,
    roles: ColumnRoles,
    preset: Preset = CURRENT,
    order_cols: Sequence[str] = (),
    taxa_order: Sequence[str] = (),
    strict: bool = False,
) -> DataFrame:
    """One row per sample: seven metrics, their scores, the index and two labels.

    ``order_cols`` give the row order of the file, which decides what a first
    row is; ``taxa_order`` the master's, where ids or names repeat in it. The metrics are
    worked out when this is called, in tasks of bounded size, and kept in a work folder.
    """

    def metrics(counted: DataFrame) -> DataFrame:
        return assemble_metrics(counted, roles.sample_key, roles.result_val, strict=strict)

    rows = standardized_rows(obs, taxa, roles, preset, order_cols, taxa_order)
    return score_table(_of_counted_rows(rows, roles, order_cols, taxa_order, metrics, "metrics"))


def preview_scores(scores: DataFrame, sample_key: Sequence[str], n: int = 6) -> DataFrame:
    """The first samples by key."""
    return scores.orderBy(*sample_key).limit(n)


def sample_keys(rows: DataFrame, sample_key: Sequence[str]) -> DataFrame:
    return rows.select(*sample_key).distinct()
