"""Fact tables on Spark: clean, check, aggregate, report, model and log."""

from factmill.spec import DEFAULT_SPEC, FactSpec

__all__ = ["DEFAULT_SPEC", "FactSpec"]
