"""The taxa master and the standardisation of records to index taxa.

Inside the engine a master row has the columns of ``MASTER_COLUMNS``; three rank
names are SQL keywords and carry an underscore.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kicknet.operators.matching import broadcast_if_small

ID = "id"
NAME = "biosname"
TOLERANCE = "tolerance"
FEEDING = "ffg"
GENUS, GROUP, TRIBE, FAMILY = "genus", "group_", "tribe_etc", "family"
ORDER, CLASS, PHYLUM = "order_", "class_", "phylum"

MASTER_COLUMNS = (
    ID, NAME, TOLERANCE, FEEDING, ORDER, FAMILY, GENUS, GROUP, TRIBE, CLASS, PHYLUM,
)

# Fixed value: tolerance that marks semi-aquatic taxa
SEMI_AQUATIC = 99.9


@dataclass(frozen=True)
class Override:
    """Records whose ``rank`` is one of ``values`` count as ``name``."""

    rank: str
    values: tuple[str, ...]
    name: str


# Taxa that are scored above genus, first match wins. The fourth
# line looks for a family name in the class column; results depend on it.
OVERRIDES = (
    Override(CLASS, ("TURBELLARIA", "Turbellaria"), "TURBELLARIA"),
    Override(CLASS, ("OLIGOCHAETA", "Oligochaeta"), "OLIGOCHAETA"),
    Override(CLASS, ("HIRUDINEA", "Hirudinea"), "HIRUDINEA"),
    Override(CLASS, ("PISIDIIDAE", "Pisidiidae"), "SPHAERIIDAE"),
    Override(FAMILY, ("SPHAERIIDAE", "Sphaeriidae"), "SPHAERIIDAE"),
    Override(FAMILY, ("UNIONIDAE", "Unionidae"), "UNIONIDAE"),
    Override(FAMILY, ("CAMBARIDAE", "Cambaridae"), "CAMBARIDAE"),
)


def standard_name(overrides: Sequence[Override], chain: Sequence[str]) -> Column:
    """Name of the index taxon: an override, else the first rank of the chain that has a value."""
    named = [F.when(F.col(o.rank).isin(*o.values), F.lit(o.name)) for o in overrides]
    return F.coalesce(*named, *[F.col(rank) for rank in chain]).cast("string")


def identified() -> Column:
    """Records of a known name that are not semi-aquatic; an unknown tolerance fails as well."""
    return (F.col(TOLERANCE) != F.lit(SEMI_AQUATIC)) & F.col(NAME).isNotNull()


def join_taxa_by_id(obs: DataFrame, taxa: DataFrame) -> DataFrame:
    """Every observation with the attributes of the master records of its id."""
    master = broadcast_if_small(
        taxa.select(F.col(ID).alias("_id"), *[c for c in taxa.columns if c != ID])
    )
    return obs.join(master, F.col(ID).eqNullSafe(F.col("_id")), "left").drop("_id")


def standard_order(taxa_order: Sequence[str]) -> list[str]:
    """Columns that order the rows an observation fans out to, given the master's row order."""
    return [f"_record_{c}" for c in taxa_order] + [f"_standard_{c}" for c in taxa_order]


def _records(taxa: DataFrame, overrides, chain, taxa_order) -> DataFrame:
    return taxa.select(
        F.col(ID).alias("_record_id"),
        standard_name(overrides, chain).alias("_standard_name"),
        *[F.col(c).alias(f"_record_{c}") for c in taxa_order],
    )


def _standards(taxa: DataFrame, taxa_order) -> DataFrame:
    return taxa.select(
        F.col(NAME).alias("_name"),
        *[F.col(c) for c in MASTER_COLUMNS if c != NAME],
        *[F.col(c).alias(f"_standard_{c}") for c in taxa_order],
    )


def crosswalk(
    taxa: DataFrame,
    overrides: Sequence[Override],
    chain: Sequence[str],
    taxa_order: Sequence[str] = (),
    identified_only: bool = True,
) -> DataFrame:
    """Record id, of identified records or all, to the attributes of its index taxon.

    The standard name depends on the master record alone, so the look-up of the
    standard taxon is a join of the master with itself and the observations
    need one join instead of two. The index taxon need not be an identified one.
    """
    return (
        _records(taxa.where(identified()) if identified_only else taxa, overrides, chain, taxa_order)
        .join(
            broadcast_if_small(_standards(taxa, taxa_order), source=taxa),
            F.col("_standard_name").eqNullSafe(F.col("_name")),
            "left",
        )
        .drop("_name")
    )


def standardize_taxa(
    obs: DataFrame,
    taxa: DataFrame,
    overrides: Sequence[Override],
    chain: Sequence[str],
    identified_only: bool = True,
    taxa_order: Sequence[str] = (),
) -> DataFrame:
    """Replace each record's taxon by its index taxon and attach that taxon's attributes.

    ``identified_only`` drops records of unknown or semi-aquatic taxa; otherwise
    records without a master row stay, unnamed. The attributes are those of the
    index taxon, null where the master lists none of that name. Repeated ids or
    names in the master multiply rows; ``taxa_order`` then tells their order
    (see ``standard_order``).
    """
    columns = [
        *[c for c in obs.columns if c != ID],
        F.col("_standard_name").alias(NAME),
        *[c for c in MASTER_COLUMNS if c != NAME],
        *standard_order(taxa_order),
    ]
    by_record = F.col("_obs_id").eqNullSafe(F.col("_record_id"))
    obs = obs.withColumnRenamed(ID, "_obs_id")
    known = broadcast_if_small(
        crosswalk(taxa, overrides, chain, taxa_order, identified_only), source=taxa
    )
    if identified_only:
        return obs.join(known, by_record, "inner").select(*columns)
    # records without a master row have no name and match master rows that have none either
    attributes = [c for c in known.columns if c not in ("_record_id", "_standard_name")]
    attributes = [c for c in attributes if c not in {f"_record_{o}" for o in taxa_order}]
    nameless = _standards(taxa.where(F.col(NAME).isNull()), taxa_order).select(
        "_name", *[F.col(c).alias(f"_nameless_{c}") for c in attributes]
    )
    # null only where there was no match; the others are spread
    listed = F.when(F.col("_listed"), F.coalesce(F.col("_record_id").cast("string"), F.lit("")))
    joined = obs.join(known.withColumn("_listed", F.lit(True)), by_record, "left").join(
        broadcast_if_small(nameless), listed.eqNullSafe(F.col("_name")), "left"
    )
    filled = {c: F.coalesce(F.col(c), F.col(f"_nameless_{c}")) for c in attributes}
    return joined.withColumns(filled).select(*columns)
