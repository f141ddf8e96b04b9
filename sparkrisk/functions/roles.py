"""Which column of a table plays which part."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    """Column names by role; an operator uses only the roles it needs."""

    id: str = "id"
    time: str = "time"
    entity: str = "entity"
    amount: str = "amount"
    label: str = "label"


def require_columns(df, names, what="operator") -> None:
    """Fail on the driver, before planning, when columns are absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing required column(s) {missing}")


def forbid_columns(df, names, what="operator") -> None:
    """Fail on the driver when a column that must not be seen (the label) is present."""
    present = [n for n in names if n in df.columns]
    if present:
        raise ValueError(f"{what}: input must not contain {present}")
