"""Observations and a taxa master derived from the generated test tables.

One text serves Spark and DuckDB; ``//`` (integer division) and the first day
of a year are the two places where the dialects differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kicknet.operators.selection import ColumnRoles
from kicknet.sources.workspace import once

ROLES = ColumnRoles(
    mlid="site",
    start_date="start_date",
    start_time="start_time",
    equip_id="equip",
    bio_id="bio_id",
    taxon_name="taxon_name",
    result_val="result_val",
)
# the first and third columns tell most rows apart; all five together all of them
ROW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
TOLERANCE_COL = "tolerance_value"

_TOLERANCE = """case when {k}%29=0 then cast(99.9 as double)
    {missing}else cast({k}%23 as double)/2 end"""

TAXA_SQL = f"""
with b as (select p_partkey k, (p_partkey // 8) % 128 g, p_partkey % 8 m from {{part}}),
r as (select *,
    case when k>=1024 then 0 when m=0 then 1 when m=4 and g%2=0 then 2 when m=5 and g%4=0 then 3
         when m=6 and g%8=0 then 4 when m=7 and g%16=0 then 5 when m=7 and g in (8,120) then 6
         when m=7 and g=24 then 7 else 0 end lv,
    g // 2 g2, g // 4 g4, g // 8 g8, g // 16 g16 from b),
n as (select k, lv,
    case when lv=0 and k%401=0 then concat('GEN_UNLISTED_',k)
         when lv<=1 then concat('GEN_',g) end genus,
    case when lv=2 or (lv<2 and g%3<>0) then concat('GRP_',g2) end grp,
    case when lv<=3 then concat('TRB_',g4) end tribe,
    case when lv<=4 and not (lv=1 and g%2=0 and g16 in (4,5,6)) then
      case g8 when 9 then 'SPHAERIIDAE' when 10 then 'Unionidae' when 11 then 'CAMBARIDAE'
              else concat('FAM_',g8) end end family,
    case when lv<=5 and not (lv=1 and g%2=0 and g16 in (4,5)) then
      case g16 when 0 then 'COLEOPTERA' when 1 then 'Ephemeroptera' when 2 then 'PLECOPTERA'
               when 3 then 'Trichoptera' when 4 then 'DIPTERA' else concat('ORD_',g16) end end ord,
    case when lv<=6 and not (lv=1 and g%2=0 and g16=4) then
      case when g16<4 then 'INSECTA' when g16=7 then 'Oligochaeta' else 'CLS_1' end end cls,
    'ARTHROPODA' phy from r)
select cast(k as double) as id,
    case lv when 0 then concat('SP_',k) when 1 then genus when 2 then grp when 3 then tribe
            when 4 then upper(family) when 5 then ord when 6 then upper(cls) else phy end as biosname,
    {_TOLERANCE.format(k="k", missing="when k%31=0 then null ")} as tolerance,
    case k%5 when 0 then 'SC' when 1 then 'CG' when 2 then 'PR' when 3 then 'SH' end as ffg,
    ord as order_, family, genus, grp as group_, tribe as tribe_etc, cls as class_, phy as phylum
from n
"""

OBSERVATIONS_SQL = f"""
select cast(l_suppkey as varchar(20)) as site, {{year}} as start_date,
    case when l_linenumber%2=0 then '10:30' else '09:15' end as start_time,
    case when l_returnflag='A' then '20-jab' when l_returnflag='N' then 'Net Jab + Dredge'
         when l_linestatus='F' then 'Multiplate' else 'Other' end as equip,
    l_partkey as bio_id, concat('Taxon ', l_partkey) as taxon_name,
    l_quantity % 25 as result_val,
    case when l_tax=0.08 then 'rare' end as result_comment,
    case when l_linenumber=7 then 'Biomass' else 'Count' end as characteristic_name,
    {_TOLERANCE.format(k="l_partkey", missing="")} as {TOLERANCE_COL},
    {", ".join(ROW_ORDER)}
from {{lineitem}}
"""

SPARK_YEAR = "trunc(l_shipdate, 'YEAR')"
DUCKDB_YEAR = "cast(date_trunc('year', l_shipdate) as date)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = TAXA_SQL.replace("//", "div")
    return spark.sql(text, part=table(spark, sf_dir, "part"))


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taxa master, derived once a session."""
    return once(spark, "taxa", [f"{sf_dir}/part.parquet"], lambda: derive_taxa(spark, sf_dir))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = OBSERVATIONS_SQL.replace("{year}", SPARK_YEAR)
    return spark.sql(text, lineitem=table(spark, sf_dir, "lineitem"))


def write_export(df: DataFrame, folder: str, preamble: str) -> None:
    """Text exports as the scan expects them: a preamble line, a header line, data lines.

    Every task writes the file of its own partition.
    """
    header = ",".join(df.columns)
    lines = df.select(F.to_csv(F.struct("*")).alias("value"))

    def with_head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [preamble, header]})
        yield from batches

    lines.mapInPandas(with_head, "value string").write.text(folder)
