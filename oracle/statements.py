"""All statements by query name."""

from oracle import (
    charge_statements,
    kpi_statements,
    reconcile_statements,
    subscription_statements,
    task_statements,
)

PARTS = [
    task_statements.STATEMENTS,
    kpi_statements.STATEMENTS,
    reconcile_statements.STATEMENTS,
    charge_statements.STATEMENTS,
    subscription_statements.STATEMENTS,
]


def all_statements() -> dict[str, str]:
    merged: dict[str, str] = {}
    for part in PARTS:
        merged.update(part)
    return merged
