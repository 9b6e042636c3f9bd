"""All registered queries by name."""

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from billweave.plans import charge_queries, kpi_queries, reconcile_queries, subscription_queries, task_queries

MODULES: list[ModuleType] = [task_queries, kpi_queries, reconcile_queries, charge_queries, subscription_queries]

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """The public functions of the plan modules: each takes (spark, folder) and returns a DataFrame."""
    found: dict[str, Query] = {}
    for module in MODULES:
        for name, function in vars(module).items():
            is_query = callable(function) and getattr(function, "__module__", None) == module.__name__
            if is_query and not name.startswith("_"):
                if name in found:
                    raise ValueError(f"query {name} is registered twice")
                found[name] = function
    return found
