"""Column roles and rules of a fact table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from factmill import fixed_values as fixed


@dataclass(frozen=True)
class FactSpec:
    """Names the role of each column and carries the rules applied to it.

    Defaults describe a monthly incident table; any table with two levels of
    category, a place, a year, a month and a numeric measure can be described.
    """

    district: str = "borough"
    major: str = "major_category"
    minor: str = "minor_category"
    year: str = "year"
    month: str = "month"
    measure: str = "value"
    total: str = "total_crimes"
    date: str = "date"

    null_tokens: tuple[str, ...] = fixed.NULL_TOKENS
    corrections: Mapping[str, str] = field(
        default_factory=lambda: dict(fixed.DISTRICT_CORRECTIONS)
    )
    year_min: int = fixed.YEAR_MIN
    year_max: int | None = None  # None: the current year
    month_min: int = fixed.MONTH_MIN
    month_max: int = fixed.MONTH_MAX

    iqr_factor: float = fixed.IQR_FACTOR
    z_limit: float = fixed.Z_LIMIT
    quartiles: tuple[float, float] = (fixed.QUARTILE_LOW, fixed.QUARTILE_HIGH)
    report_quantiles: tuple[float, float] = (fixed.REPORT_LOW, fixed.REPORT_HIGH)

    dedup: str = "exact"  # or "none"
    null_measure: str = "keep"  # or "drop"
    strict_whole: bool = False  # a fractional year or month: fail instead of null

    def __post_init__(self) -> None:
        if self.dedup not in ("exact", "none"):
            raise ValueError(f"dedup must be 'exact' or 'none', not {self.dedup!r}")
        if self.null_measure not in ("keep", "drop"):
            raise ValueError(
                f"null_measure must be 'keep' or 'drop', not {self.null_measure!r}"
            )

    @property
    def dims(self) -> list[str]:
        return [self.district, self.major, self.minor]

    @property
    def keys(self) -> list[str]:
        return [*self.dims, self.year, self.month]

    @property
    def critical(self) -> list[str]:
        """Columns that may not be missing. The minor category is not one of them."""
        return [self.district, self.major, self.measure, self.year, self.month]

    @property
    def raw_columns(self) -> list[str]:
        return [*self.keys, self.measure]

    @property
    def processed_columns(self) -> list[str]:
        return [*self.keys, self.total, self.date]

    @property
    def processed_schema(self) -> T.StructType:
        return T.StructType(
            [T.StructField(c, T.StringType()) for c in self.dims]
            + [
                T.StructField(self.year, T.LongType()),
                T.StructField(self.month, T.LongType()),
                T.StructField(self.total, T.DoubleType()),
                T.StructField(self.date, T.DateType()),
            ]
        )

    def but(self, **changes) -> FactSpec:
        """The same spec with some fields changed."""
        return replace(self, **changes)


DEFAULT_SPEC = FactSpec()
