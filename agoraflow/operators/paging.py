"""Ordered pages with counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Page:
    """A requested page. Numbers below 1 count as 1; size 0 means all rows."""

    number: int = 1
    size: int = 20
    descending: bool = True

    @staticmethod
    def requested(number: str | int | None, size: str | int | None, order: str | None, default_size: int = 20) -> Page:
        """A page from request texts: what is no number or no order falls back to the default."""
        as_int = lambda x, d: int(x) if str(x).lstrip("-").isdigit() else d
        return Page(max(1, as_int(number, 1)), max(0, as_int(size, default_size)), (order or "desc").lower() != "asc")

    def count(self, total: int) -> int:
        return max(1, -(-total // self.size)) if self.size else 1

    def clamped(self, total: int) -> Page:
        return Page(min(self.number, self.count(total)), self.size, self.descending)

    def label(self, total: int) -> tuple[int, int]:
        """The ordinals of the first and last row of the page."""
        first = (self.number - 1) * self.size + 1 if total else 0
        return first, min(total, first + self.size - 1) if self.size else total


def page_of(df: DataFrame, order: str, key: str, page: Page) -> DataFrame:
    """The rows of a page; key breaks ties, always ascending."""
    by = [F.col(order).desc_nulls_last() if page.descending else F.col(order).asc_nulls_first(), F.col(key).asc()]
    ordered = df.orderBy(*by)
    return ordered.offset((page.number - 1) * page.size).limit(page.size) if page.size else ordered


def page_links(number: Column, pages: Column, reach: int) -> Column:
    """Page numbers around a page, within 1 and the last."""
    return F.sequence(F.greatest(F.lit(1), number - reach), F.least(pages, number + reach))


def parity(df: DataFrame, order: list, partition: list, name: str = "odd") -> DataFrame:
    """Alternating flag by position in order within each partition."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*partition).orderBy(*order)) % 2)


def newest(df: DataFrame, keys: list[str], at: str, cap: int, tie: str) -> DataFrame:
    """The newest `cap` rows of each key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(tie).desc()))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")
