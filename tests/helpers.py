"""Small tables and readable comparisons."""

from __future__ import annotations

from collections import Counter


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    return v


def bag(df, *columns):
    """The rows as a multiset."""
    rows = df.select(*columns).collect() if columns else df.collect()
    return Counter(tuple(_plain(v) for v in row) for row in rows)


def physical_plan(df) -> str:
    """The plan before execution, whether or not the table has been run."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[-1]


MASTER_DDL = (
    "id double, biosname string, tolerance double, ffg string, order_ string, family string, "
    "genus string, group_ string, tribe_etc string, class_ string, phylum string"
)
ROWS_DDL = (
    "site string, start_date string, start_time string, biosname string, result_val double, "
    + MASTER_DDL.replace("biosname string, ", "")
    + ", seq int"
)
KEY = ["site", "start_date", "start_time"]


def taxon_row(seq, name, count, site="A", **attributes):
    """A standardised row; attributes not named are null."""
    names = [f.split()[0] for f in ROWS_DDL.split(", ")][5:-1]
    return (site, "2020-01-01", "10:30", name, count, *[attributes.get(n) for n in names], seq)
