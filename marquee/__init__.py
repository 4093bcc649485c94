"""marquee: ticketing analytics (catalog, sales reports, purchase intake,
table change folding) expressed as PySpark DataFrame jobs."""

from marquee.tables import Tables

__all__ = ["Tables"]
