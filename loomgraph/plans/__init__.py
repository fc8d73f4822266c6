"""Query language, table projections and planning helpers."""
