"""Listing scans (S1-S7) and narrow projections (P1-P5). Each is a plain
``select``; Catalyst prunes the parquet read to the listed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marquee.schemas import TABLE_SCHEMAS
from marquee.tables import Tables


def scan(t: Tables, name: str) -> DataFrame:
    """Full listing of one table in its declared column order."""
    return t.get(name).select(*[f.name for f in TABLE_SCHEMAS[name].fields])


def ticket_narrow(t: Tables) -> DataFrame:
    """The admin ticket listing without the availability counters."""
    return t.ticket.select("ID", "type", "price", "event_id", "distributer_id")


def cust_of_pairs(t: Tables) -> DataFrame:
    """company/customer pairs."""
    return t.cust_of.select("company_id", "customer_id")


def event_cards(t: Tables) -> DataFrame:
    """The public event card."""
    return t.event_catalog.select("name", "location", "type", "datetime", "general_price",
                                  "vip_price", "details")


def event_picker(t: Tables) -> DataFrame:
    """Event choices of the purchase and edit forms."""
    return t.event_catalog.select("ID", "name")


def distributer_picker(t: Tables) -> DataFrame:
    """P5: distributer choices."""
    return t.distributer.select("ID", "name")
