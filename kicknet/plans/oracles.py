"""The registered queries as plain SQL over the generated tables.

The SQL takes the long way round on purpose: one anti-join per redundancy rule,
one table per metric put together by full joins, windows over the rows of a
sample, every individual written out.
"""

from __future__ import annotations

from kicknet.plans.registered import DIGITS, RANKS, SEED
from kicknet.sources import driver_tables as D

KEY = "site, start_date, start_time"
ORDER = ", ".join(D.ROW_ORDER)
ATTRIBUTES = "id, tolerance, ffg, order_, family, genus, group_, tribe_etc, class_, phylum"
CONTENT = f"{KEY}, biosname, result_val, {ATTRIBUTES}"
ROW = f"{CONTENT}, {ORDER}"

TAXA = D.TAXA_SQL.replace("{part}", "part")
OBS = D.OBSERVATIONS_SQL.replace("{year}", D.DUCKDB_YEAR).replace("{lineitem}", "lineitem")
BASE = f"with taxa as ({TAXA}), obs as ({OBS})"


def _same(columns: str, a: str, b: str) -> str:
    return " and ".join(f"{a}.{c} is not distinct from {b}.{c}" for c in columns.split(", "))


SAMPLED = "site is not null and start_date is not null and start_time is not null"
PICKED = f"""picked as (
    select {KEY}, equip, cast(bio_id as double) as id, taxon_name, result_val, {ORDER} from obs
    where characteristic_name like '%Count%' and result_comment is null and {SAMPLED}
      and equip in ('20-jab', 'Net Jab + Dredge', 'Multiplate'))"""
LEGACY_PICKED = f"""picked as (
    select {KEY}, equip, cast(bio_id as double) as id, taxon_name, result_val, {ORDER} from obs
    where {D.TOLERANCE_COL} <> cast(99.9 as double) and result_val > -1 and {SAMPLED}
      and equip = '20-jab')"""
TAXON = ATTRIBUTES.replace("id, ", "", 1)
IDENTIFIED = """matched as (
    select p.*, t.biosname, {t} from picked p left join taxa t on p.id is not distinct from t.id
    {where})"""
_t = ", ".join(f"t.{c}" for c in TAXON.split(", "))
MATCHED = IDENTIFIED.format(
    t=_t, where="where t.tolerance <> cast(99.9 as double) and t.biosname is not null"
)
LEGACY_MATCHED = IDENTIFIED.format(t=_t, where="")


def _standard(chain: str) -> str:
    return f"""named as (
    select {KEY}, result_val, {ORDER},
      coalesce(case when class_ in ('TURBELLARIA','Turbellaria') then 'TURBELLARIA'
                    when class_ in ('OLIGOCHAETA','Oligochaeta') then 'OLIGOCHAETA'
                    when class_ in ('HIRUDINEA','Hirudinea') then 'HIRUDINEA'
                    when class_ in ('PISIDIIDAE','Pisidiidae') then 'SPHAERIIDAE'
                    when family in ('SPHAERIIDAE','Sphaeriidae') then 'SPHAERIIDAE'
                    when family in ('UNIONIDAE','Unionidae') then 'UNIONIDAE'
                    when family in ('CAMBARIDAE','Cambaridae') then 'CAMBARIDAE' end,
               {chain}) as biosname
    from matched),
std as (select {", ".join(f"n.{c}" for c in f"{KEY}, biosname, result_val, {ORDER}".split(", "))},
    t.id, {_t} from named n left join taxa t on n.biosname is not distinct from t.biosname)"""


CURRENT_STD = ", ".join(
    [BASE, PICKED, MATCHED, _standard("genus, group_, tribe_etc, family, order_, class_, phylum")]
)
LEGACY_STD = ", ".join(
    [
        BASE,
        LEGACY_PICKED,
        LEGACY_MATCHED,
        _standard("genus, tribe_etc, family, order_, class_, phylum"),
    ]
)


def _first(source: str, where: str, key: str) -> str:
    """First row by file order per sample and key."""
    return f"""(select {ROW} from (select *, row_number() over (
        partition by {KEY}, {key} order by {ORDER}) as place from {source} where {where})
      where place = 1)"""


def _minus(left: str, right: str) -> str:
    """Rows of left without those that equal a row of right in all content columns."""
    return f"""(select {ROW} from {left} l where not exists (
        select 1 from {right} r where {_same(CONTENT, "l", "r")}))"""


AT_TRIBE = "genus is null and group_ is not null and tribe_etc is not null"
AT_FAMILY = "genus is null and family is not null"
REDUNDANT = f"""
tribe_rows as (select {ROW} from std where {AT_TRIBE}),
tribe_first as {_first("std", AT_TRIBE, "tribe_etc")},
tribe_doubles as {_minus("tribe_rows", "tribe_first")},
family_rows as (select {ROW} from std where {AT_FAMILY}),
family_first as {_first("std", AT_FAMILY, "family")},
family_doubles0 as {_minus("family_rows", "family_first")},
family_doubles as {_minus("family_doubles0", "tribe_first")},
order_named as {_first("std", "family is null", "biosname")},
order_rows as (select * from order_named where order_ is not null),
order_first as {_first("order_rows", "true", "order_")},
order_doubles as {_minus("order_rows", "order_first")},
class_named as {_first("std", "order_ is null", "biosname")},
class_rows as (select * from class_named where class_ is not null),
class_first as {_first("class_rows", "true", "class_")},
class_doubles as {_minus("class_rows", "class_first")},
phylum_named as {_first("std", "class_ is null", "biosname")},
phylum_rows as (select * from phylum_named where phylum is not null),
phylum_first as {_first("phylum_rows", "true", "phylum")},
phylum_doubles as {_minus("phylum_rows", "phylum_first")},
kept1 as {_minus("std", "tribe_doubles")},
kept2 as {_minus("kept1", "family_doubles")},
kept3 as {_minus("kept2", "order_doubles")},
kept4 as {_minus("kept3", "class_doubles")},
kept as {_minus("kept4", "phylum_doubles")}"""


def _richness(name: str, where: str = "true", source: str = "kept") -> str:
    return f"""select {KEY}, count(distinct id) + max(case when id is null then 1 else 0 end) as {name}
      from {source} where {where} group by {KEY}"""


def _all_sum(value: str) -> str:
    return f"(case when count(*) = count({value}) then sum({value}) end)"


def _part(value: str, where: str) -> str:
    return f"""(case when count(*) filter (where {where} and {value} is null) = 0
        then sum({value}) filter (where {where}) end)"""


def _share(name: str, where: str) -> str:
    return f"""select {KEY}, case when total = 0 then null else part / total * 100 end as {name}
      from (select {KEY}, {_all_sum("result_val")} as total, {_part("result_val", where)} as part,
              count(*) filter (where {where}) as present
            from kept group by {KEY}) where present > 0"""


EPT = """order_ in ('Ephemeroptera','EPHEMEROPTERA','Plecoptera','PLECOPTERA',
        'Trichoptera','TRICHOPTERA')"""
METRICS = {
    "TotalTaxa_Value": _richness("TotalTaxa_Value"),
    "ColeopteraTaxa_Value": _richness(
        "ColeopteraTaxa_Value",
        "tolerance <> cast(99.9 as double) and order_ in ('Coleoptera','COLEOPTERA')",
    ),
    "EphemeropteraTaxa_Value": _richness(
        "EphemeropteraTaxa_Value", "order_ in ('Ephemeroptera','EPHEMEROPTERA')"
    ),
    "IntolerantTaxa_Value": _richness("IntolerantTaxa_Value", "tolerance <= 3"),
    "MBI": f"""select {KEY}, case when total = 0 then null else part / total end as MBI
      from (select {KEY}, {_all_sum("result_val")} as total,
              {_all_sum("result_val * tolerance")} as part from kept group by {KEY})""",
    "PercentScrapers": _share("PercentScrapers", "ffg = 'SC'"),
    "Percent_EPT": _share("Percent_EPT", EPT),
}
FRACTIONS = ("MBI", "PercentScrapers", "Percent_EPT")


def _assembled() -> str:
    parts = [f"m{i} as ({sql})" for i, sql in enumerate(METRICS.values())]
    joins = " ".join(
        f"full join m{i} using (site, start_date, start_time)" for i in range(1, len(METRICS))
    )
    columns = ", ".join(f"coalesce({name}, 0) as {name}" for name in METRICS)
    return f"""{", ".join(parts)}, metrics as (select {KEY}, {columns} from m0 {joins})"""


def _rounded(columns) -> str:
    return ", ".join(f"round({c}, {DIGITS}) as {c}" for c in columns)


SCORES = """scores as (select *,
    ColeopteraTaxa_Value / cast(5 as double) * 100 as ColeopteraTaxa_Score,
    EphemeropteraTaxa_Value / cast(10.2 as double) * 100 as EphemeropteraTaxa_Score,
    TotalTaxa_Value / cast(46 as double) * 100 as TotalTaxa_Score,
    IntolerantTaxa_Value / cast(9 as double) * 100 as IntolerantTaxa_Score,
    (cast(11 as double) - MBI) / (cast(11 as double) - cast(4.9 as double)) * 100 as MBI_score,
    PercentScrapers / cast(29.6 as double) * 100 as PercentScraper_Score
  from metrics),
mean as (select *, (ColeopteraTaxa_Score + EphemeropteraTaxa_Score + TotalTaxa_Score
    + IntolerantTaxa_Score + MBI_score + PercentScraper_Score + Percent_EPT) / cast(7 as double)
    as uncapped from scores),
capped as (select * exclude (uncapped), case when uncapped > 100 then 100 else uncapped end as mIBI
  from mean)"""


def _bands(exceptional: str, good: str, fair: str, poor: str) -> str:
    return f"""case when mIBI >= 73 and mIBI <= 100 then '{exceptional}'
      when mIBI >= cast(41.8 as double) and mIBI <= cast(72.9 as double) then '{good}'
      when mIBI >= cast(20.9 as double) and mIBI <= cast(41.8 as double) then '{fair}'
      when mIBI >= 0 and mIBI <= cast(20.8 as double) then '{poor}' end"""


LABELS = f"""labelled as (select *,
    {_bands(">75th percentile", "> 10th percentile", "bisect 10th percentile (upper)",
            "bisect 10th percentile (lower)")} as Comparison_to_Reference,
    {_bands("Exceptional", "Good", "Fair", "Poor")} as Narrative_Description
  from capped)"""
SCORE_COLUMNS = (
    "ColeopteraTaxa_Score",
    "EphemeropteraTaxa_Score",
    "TotalTaxa_Score",
    "IntolerantTaxa_Score",
    "MBI_score",
    "PercentScraper_Score",
)
COUNTS = "TotalTaxa_Value, ColeopteraTaxa_Value, EphemeropteraTaxa_Value, IntolerantTaxa_Value"
TABLE = f"{KEY}, {COUNTS}, {_rounded(FRACTIONS)}"
SCORED_TABLE = f"{TABLE}, {_rounded(SCORE_COLUMNS)}"
FULL_TABLE = f"{SCORED_TABLE}, {_rounded(['mIBI'])}, Comparison_to_Reference, Narrative_Description"


def _scored(std: str) -> str:
    return f"{std}, {REDUNDANT}, {_assembled()}, {SCORES}, {LABELS}"


# --- ambiguity -------------------------------------------------------------------------

GROUP = KEY
RANK_LIST = ", ".join(RANKS)
INPUT = f"{KEY}, biosname, {RANK_LIST}, count, {ORDER}"


def _levels() -> str:
    whens = " ".join(f"when {r} is not null then {i}" for i, r in enumerate(RANKS, 1))
    return f"""level1 as (select *, case {whens} else 99 end as lv, {RANKS[0]} is not null as keep,
      count as new_count from (select {KEY}, biosname, {RANK_LIST}, result_val + 1 as count, {ORDER}
      from std))"""


TIE = f"md5(concat_ws('|', {', '.join(f'cast({c} as varchar)' for c in f'{GROUP}, {ORDER}'.split(', '))}, '{SEED}'))"


def _resolution(method: str) -> str:
    """One step per level over the rows themselves."""
    steps = [_levels()]
    for i, rank in enumerate(RANKS[1:], 2):
        over = f"over (partition by {GROUP}, {rank})"
        takes = f"keep and {rank} is not null and parents > 0"
        if method == "DPAC-S":
            grown = f"case when {takes} then given * (new_count / held) + new_count else new_count end"
        elif method == "APTC-S":
            grown = f"case when {takes} and place = 1 then new_count + given else new_count end"
        else:
            grown = "new_count"
        steps.append(f"""look{i} as (select *,
      bool_or(keep) {over} as has_child,
      count(*) filter (where lv = {i}) {over} as parents,
      sum(count) filter (where lv = {i}) {over} as given,
      sum(new_count) filter (where keep) {over} as held,
      row_number() over (partition by {GROUP}, {rank}
        order by keep desc, new_count desc, {TIE}, {ORDER}) as place
    from level{i - 1}),
level{i} as (select {INPUT}, lv, keep or (lv = {i} and not has_child) as keep,
      {grown} as new_count from look{i})""")
    return ", ".join(steps)


def _resolved(method: str, to_filter: bool) -> str:
    added = [] if to_filter else ["not keep as is_ambiguous"]
    if method != "RPKC-S":
        added.append(f"round(new_count, {DIGITS}) as new_count")
    columns = ", ".join([INPUT, *added])
    where = " where keep" if to_filter else ""
    return f"{CURRENT_STD}, {_resolution(method)} select {columns} from level{len(RANKS)}{where}"


# --- subsampling -----------------------------------------------------------------------

KIND = f"{KEY}, id, biosname, tolerance"
_kind_text = " || ".join(
    f"coalesce(length(cast({c} as varchar)) || ':' || cast({c} as varchar), 'n')"
    for c in KIND.split(", ")
)
RAREFIED = f"""{CURRENT_STD},
rows as (select {KIND}, result_val as count from std),
totals as (select {KEY}, sum(count) as total from rows group by {KEY}),
small as (select r.* from rows r join totals t on {_same(KEY, "r", "t")} where t.total <= 360),
kinds as (select {", ".join(f"r.{c}" for c in KIND.split(", "))}, cast(sum(floor(r.count)) as bigint) as n
    from rows r join totals t on {_same(KEY, "r", "t")} where t.total > 360
    group by {", ".join(f"r.{c}" for c in KIND.split(", "))}),
individuals as (select *, md5({_kind_text}) as kind, unnest(range(1, n + 1)) as number
    from kinds where n >= 1),
gaps as (select *, -ln(1 - cast(cast('0x' || substr(md5(concat_ws('|', kind, cast(number as varchar),
    '{SEED}')), 1, 13) as bigint) as double) / cast(4503599627370496 as double)) / (n - number + 1) as gap
    from individuals),
times as (select *, sum(gap) over (partition by {KIND} order by number
    rows between unbounded preceding and current row) as time from gaps),
places as (select *, row_number() over (partition by {KEY} order by time, kind, number) as place
    from times),
drawn as (select *, count(*) over (partition by {KEY}, id) as drawn from places where place <= 360)
select * from small
union all
select distinct {KIND}, cast(drawn as double) as count from drawn"""


def _simple() -> dict[str, str]:
    return {
        "scan_observations": f"""{BASE} select {", ".join(
            f"cast({c} as varchar) as {c}" for c in
            f"{KEY}, equip, bio_id, taxon_name, result_val, result_comment, characteristic_name, "
            f"{D.TOLERANCE_COL}, {ORDER}".split(", "))} from obs""",
        "scan_taxa": f"{BASE} select * from taxa",
        "clean_names": f"""{BASE} select site as monitoring_location_id,
            start_date as activity_start_date, result_val as result_value_number,
            l_quantity / 50 as percent_of_max, bio_id as x1st_id, l_orderkey as order_key,
            l_linenumber as order_key_2, equip as equipment_id from obs""",
        "bind_roles": f"""{BASE} select {KEY}, equip, bio_id as id, taxon_name, result_val from obs""",
        "coerce_numeric": """select l_orderkey,
            case when l_linenumber in (3, 5) then null else l_quantity end as amount,
            cast(l_partkey as double) + 0.5 as part from lineitem""",
        "excel_serial": """select l_orderkey, l_linenumber, cast(l_shipdate as date) as start_date,
            lpad(cast(l_linenumber as varchar), 2, '0') || ':00' as start_time from lineitem""",
        "filter_observations": f"""{BASE}, {PICKED}, {MATCHED} select * from matched""",
        "legacy_filter": f"""{BASE}, {LEGACY_PICKED}, {LEGACY_MATCHED} select * from matched""",
        "join_taxa_by_id": f"""{BASE} select {", ".join(f"o.{c}" for c in KEY.split(", "))},
            o.result_val, o.bio_id * cast(1.5 as double) as id,
            {", ".join(f"o.{c}" for c in D.ROW_ORDER)}, t.biosname, {_t}
            from obs o left join taxa t
            on o.bio_id * cast(1.5 as double) is not distinct from t.id""",
        "standardize_taxa": f"{CURRENT_STD} select {ROW} from std",
        "legacy_standardize": f"{LEGACY_STD} select {ROW} from std",
        "antijoin_all_columns": f"""{CURRENT_STD}, known as (
            select * from std where genus is null or result_val < 12)
            select {CONTENT} from std l where not exists (
              select 1 from known r where {_same(CONTENT, "l", "r")})""",
        "dedupe_keep_first": f"{CURRENT_STD} select * from {_first('std', 'true', 'biosname')}",
        "distinct_samples": f"{CURRENT_STD} select distinct {KEY} from std",
        "window_sample_total": f"""{CURRENT_STD} select {KEY}, biosname, result_val, {ORDER},
            sum(result_val) over (partition by {KEY}) as Total_ABUNDANCE from std""",
        "richness_raw": f"{CURRENT_STD} {_richness('TotalTaxa_Value', source='std')}",
        "expand_individuals": f"""{CURRENT_STD} select {", ".join(D.ROW_ORDER[:3])},
            unnest(range(1, cast(floor(result_val) as bigint) + 1)) as individual from std""",
        "rarefy": RAREFIED,
    }


def _redundant() -> dict[str, str]:
    named = {f"redundant_{r}": f"{r}_doubles" for r in ("tribe", "family", "order", "class", "phylum")}
    named["drop_redundant"] = "kept"
    return {
        query: f"{CURRENT_STD}, {REDUNDANT} select {ROW} from {source}"
        for query, source in named.items()
    }


def _metric_queries() -> dict[str, str]:
    names = {
        "metric_total_taxa": "TotalTaxa_Value",
        "metric_coleoptera_taxa": "ColeopteraTaxa_Value",
        "metric_ephemeroptera_taxa": "EphemeropteraTaxa_Value",
        "metric_intolerant_taxa": "IntolerantTaxa_Value",
        "metric_percent_scrapers": "PercentScrapers",
        "metric_percent_ept": "Percent_EPT",
        "metric_biotic_index": "MBI",
    }
    return {
        query: f"""{CURRENT_STD}, {REDUNDANT}, metric as ({METRICS[name]})
          select {KEY}, {_rounded([name]) if name in FRACTIONS else name} from metric"""
        for query, name in names.items()
    }


def _score_queries() -> dict[str, str]:
    scored = _scored(CURRENT_STD)
    return {
        "assemble_metrics": f"{scored} select {TABLE} from metrics",
        "assemble_metrics_full_join": f"{scored} select {TABLE} from metrics",
        "score_metrics": f"{scored} select {SCORED_TABLE} from scores",
        "score_index": f"{scored} select {KEY}, {_rounded(['mIBI'])} from capped",
        "classify_index": f"""{scored}
            select {KEY}, Comparison_to_Reference, Narrative_Description from labelled""",
        "score_samples": f"{scored} select {FULL_TABLE} from labelled",
        "score_samples_legacy": f"{_scored(LEGACY_STD)} select {FULL_TABLE} from labelled",
        "preview_scores": f"{scored} select {FULL_TABLE} from labelled order by {KEY} limit 6",
    }


def _ambiguity_queries() -> dict[str, str]:
    return {
        f"{prefix}_{method[:4].lower()}": _resolved(method, prefix == "resolve")
        for method in ("RPKC-S", "DPAC-S", "APTC-S")
        for prefix in ("resolve", "flag")
    }


ORACLES: dict[str, str] = {
    **_simple(),
    **_redundant(),
    **_metric_queries(),
    **_score_queries(),
    **_ambiguity_queries(),
}
ORACLES["scan_observations_mixed_headers"] = ORACLES["scan_observations"]
ORACLES["legacy_filter_text"] = ORACLES["legacy_filter"]
ORACLES["resolve_rpkc_presence"] = f"select * exclude (count) from ({ORACLES['resolve_rpkc']})"
ORACLES["type_times"] = """select l_orderkey, l_linenumber,
    case when l_linenumber in (1, 2, 5) then date '2023-03-15'
        when l_linenumber = 7 then date '1902-09-26' end as start_date,
    case l_linenumber when 1 then '09:05' when 2 then '10:30' when 4 then '10:30'
        when 6 then '23:59' when 7 then '12:00' end as start_time from lineitem"""
