"""The registered queries as DuckDB SQL over the same tables, for the result check."""

from panelspark_check.base import WITH
from panelspark_check.forest import FOREST
from panelspark_check.texts import FOREST_TEXTS, TEXTS


def oracle_sql() -> dict[str, str]:
    plain = {name: f"{WITH}\n{text.strip()}" for name, text in TEXTS.items()}
    return plain | {name: f"{WITH}{FOREST}\n{text.strip()}" for name, text in FOREST_TEXTS.items()}
