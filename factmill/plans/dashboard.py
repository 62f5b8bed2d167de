"""All dashboard tables over the aggregated table, under one set of filters."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factmill import fixed_values as fixed
from factmill.operators import aggregate
from factmill.spec import DEFAULT_SPEC, FactSpec

TAGS = (fixed.TAG_DISTRICTS, fixed.TAG_TOP_MINORS, fixed.TAG_TREND)


def dashboard(
    totals: DataFrame,
    district: str | None = None,
    major: str | None = None,
    year: int | None = None,
    spec: FactSpec = DEFAULT_SPEC,
) -> dict[str, DataFrame]:
    """Lazy tables by name. Choice lists ignore the filters; all else obeys them."""
    shown = aggregate.filter_facts(totals, district, major, year, spec)
    return {
        "districts": aggregate.distinct_values(totals, spec.district),
        "majors": aggregate.distinct_values(totals, spec.major),
        "years": aggregate.distinct_values(totals, spec.year),
        "minors": aggregate.minors_of(totals, major, spec),
        "counts": aggregate.distinct_counts(totals, spec.district, spec.major),
        "total": aggregate.grand_total(shown, spec),
        "by_district": aggregate.ranking(shown, spec.district, spec=spec),
        "by_major": aggregate.ranking(shown, spec.major, spec=spec),
        "top_minors": aggregate.ranking(shown, spec.minor, 10, spec),
        "leading_district": aggregate.leader(shown, spec.district, spec),
        "leading_major": aggregate.leader(shown, spec.major, spec),
        "trend": aggregate.monthly_trend(shown, spec),
        "year_span": aggregate.year_span(shown, spec),
        "district_by_year": aggregate.matrix_map(shown, spec.district, spec.year, spec),
        "export_filtered": aggregate.export_rows(shown, spec),
        "export_aggregated": aggregate.summary_union(shown, TAGS, spec=spec),
        "export_complete": aggregate.export_rows(totals, spec),
    }
