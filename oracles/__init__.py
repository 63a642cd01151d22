"""Independent SQL for every query: the canonical tables as CTEs over the Parquet files, then the answer."""

from oracles.answers import ANSWERS
from oracles.views import with_views


def all_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in ANSWERS.items()}
