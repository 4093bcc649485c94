"""The table bundle every operator takes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

TABLE_NAMES = ("event_catalog", "company", "distributer", "customer", "ticket", "purchase",
               "cust_of")


@dataclass(frozen=True)
class Tables:
    event_catalog: DataFrame
    company: DataFrame
    distributer: DataFrame
    customer: DataFrame
    ticket: DataFrame
    purchase: DataFrame
    cust_of: DataFrame
    # intermediates persisted while building the tables (see ``release``)
    cached: tuple = field(default=(), compare=False)

    def names(self) -> list[str]:
        return list(TABLE_NAMES)

    def get(self, name: str) -> DataFrame:
        return getattr(self, name)

    def with_table(self, name: str, df: DataFrame) -> "Tables":
        return replace(self, **{name: df})

    def release(self) -> None:
        for df in self.cached:
            df.unpersist()
