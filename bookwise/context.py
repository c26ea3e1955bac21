"""Who asks (Scope), as of when, and with which thresholds (Settings)."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from bookwise import constants as K


def as_of_column(as_of: date | str | None) -> Column:
    """The reference day as a foldable expression (None: today)."""
    return F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")


def months_before(as_of: date | str | None, months: int) -> Column:
    """Calendar months back; clamps to the month end."""
    return F.add_months(as_of_column(as_of), -months)


def days_before(as_of: date | str | None, days) -> Column:
    return F.date_sub(as_of_column(as_of), days)


def normalise_login(login: str | None) -> str:
    return (login or "").strip().lower()


@dataclass(frozen=True)
class Settings:
    """List thresholds. A missing key is None: comparisons with it yield no rows."""

    values: dict[str, Decimal | None] = field(default_factory=lambda: dict(K.LIST_SETTINGS))

    @classmethod
    def load(cls, table: DataFrame) -> "Settings":
        # at most the 15 known keys reach the driver
        known = table.where(F.col("key").isin(list(K.LIST_SETTINGS))).select("key", "value")
        return cls({row["key"]: row["value"] for row in known.collect()})

    def replace(self, **changes) -> "Settings":
        return Settings({**self.values, **{k: None if v is None else Decimal(str(v)) for k, v in changes.items()}})

    def get(self, key: str) -> Decimal | None:
        return self.values.get(key)

    def column(self, key: str) -> Column:
        value = self.get(key)
        return F.lit(None if value is None else float(value)).cast("double")

    def days(self, key: str) -> Column:
        # numeric -> int rounds, as the cast in the settings lookup does
        return F.round(self.column(key), 0).cast("int")

    def required_int(self, key: str) -> int:
        value = self.get(key)
        if value is None:
            raise ValueError(f"list setting {key!r} is missing")
        return int(value.to_integral_value())


@dataclass(frozen=True)
class Scope:
    """What one login may see. The default sees nothing."""

    login: str = ""
    role: str | None = None
    salesrep_id: str | None = None

    @property
    def sees_all(self) -> bool:
        return self.role in ("manager", "admin")

    @property
    def is_admin(self) -> bool:
        return self.role == "admin"

    @property
    def my_rep(self) -> str | None:
        return self.salesrep_id if self.role == "rep" else None

    @property
    def enabled(self) -> bool:
        """May read class aggregates: a manager, an admin or a rep with an id."""
        return self.sees_all or self.my_rep is not None

    @classmethod
    def resolve(cls, user_access: DataFrame, login: str | None) -> "Scope":
        """Look up one enabled row; an empty, unknown or disabled login sees nothing."""
        name = normalise_login(login)
        if not name:
            return cls()
        row = (
            user_access.where((F.col("login") == name) & F.col("enabled"))
            .select("role", "salesrep_id")
            .limit(1)
            .collect()
        )
        return cls(name, row[0]["role"], row[0]["salesrep_id"]) if row else cls(name)
