"""Column names to snake_case."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

# Symbols that are spelled out in a cleaned name
SPELLED_OUT = {"%": "_percent_", "#": "_number_"}


def clean_name(name: str) -> str:
    for symbol, word in SPELLED_OUT.items():
        name = name.replace(symbol, word)
    name = re.sub(r"['\"]", "", name)
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    name = re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_").lower()
    if not name or name[0].isdigit():
        name = "x" + name
    return name


def clean_name_list(names: Sequence[str]) -> list[str]:
    """Cleaned names; the second and later ones of a kind get ``_2``, ``_3``, ..."""
    seen: dict[str, int] = {}
    taken: set[str] = set()
    cleaned = []
    for name in map(clean_name, names):
        candidate = name
        while candidate in taken:
            seen[name] = seen.get(name, 1) + 1
            candidate = f"{name}_{seen[name]}"
        taken.add(candidate)
        cleaned.append(candidate)
    return cleaned


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_name_list(df.columns))
