"""Ordinal vocabularies: ranks, agreement, severity and worst verdicts as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scale:
    """values rank from worst to best; off values are answers without a rank."""

    values: tuple[str, ...]
    off: tuple[str, ...]
    labels: dict[str, str] = field(default_factory=dict, compare=False, hash=False)

    def rank(self, x: Column) -> Column:
        """Place on the scale, null off it."""
        out = F.when(F.lit(False), F.lit(0))
        for i, v in enumerate(self.values):
            out = out.when(x == v, F.lit(i))
        return out

    def label(self, x: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for v in (*self.values, *self.off):
            out = out.when(x == v, F.lit(self.labels.get(v, v.replace("_", " ").capitalize())))
        return out.otherwise(x)

    def coerce(self, x: Column) -> Column:
        """A value, trimmed and in lower case; anything else is the first off value and never a place on the scale."""
        said = F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
        return F.when(said.isin(*self.values, *self.off), said).otherwise(F.lit(self.off[0]))

    def flagged(self, x: Column) -> Column:
        """Below the top, or the first off value."""
        return x.isin(*self.values[:-1], self.off[0])

    def distance(self, a: Column, b: Column, unrankable: int = 9) -> Column:
        """Steps between two values; unrankable for those off the scale."""
        return F.coalesce(F.abs(self.rank(a) - self.rank(b)), F.lit(unrankable))

    def agreement(self, x: Column) -> Column:
        """G10, an aggregate: empty answers don't count; equal ones agree, even off the scale."""
        said = F.when(x != "", x)
        return (
            F.when(F.count(said) == 0, "UNRANKABLE")
            .when(F.min(said) == F.max(said), "AGREE")
            .when(F.bool_or(said.isNotNull() & self.rank(said).isNull()), "UNRANKABLE")
            .when(F.max(self.rank(said)) - F.min(self.rank(said)) <= 1, "ADJACENT")
            .otherwise("DISAGREE")
        )

    def pair(self, a: Column, b: Column) -> Column:
        """Two judges of one row."""
        none_a, none_b = F.coalesce(a, F.lit("")) == "", F.coalesce(b, F.lit("")) == ""
        return (
            F.when(none_a & none_b, "UNRANKABLE")
            .when(none_a | none_b, "ONE JUDGE ONLY")
            .when(a == b, "AGREE")
            .when(self.rank(a).isNull() | self.rank(b).isNull(), "UNRANKABLE")
            .when(F.abs(self.rank(a) - self.rank(b)) <= 1, "ADJACENT")
            .otherwise("DISAGREE")
        )

    def table(self, spark: SparkSession) -> DataFrame:
        """The dimension (value, rank, off_scale, label)."""
        rows = [(v, i, False, self.labels.get(v, v)) for i, v in enumerate(self.values)] + [(v, None, True, self.labels.get(v, v)) for v in self.off]
        return spark.createDataFrame(rows, "value string, rank int, off_scale boolean, label string")


# The two scales, cluster weights and the order of badness.
REVIEW = Scale(("not_addressed", "partial", "addressed"), ("unclear",), {"not_addressed": "Unaddressed", "partial": "Partial", "addressed": "Addressed", "unclear": "Unclear"})
COVERAGE = Scale(("unmet", "partial", "met"), ("unverifiable", "not_applicable"), {"unmet": "Unmet", "partial": "Partial", "met": "Met", "unverifiable": "Unverifiable", "not_applicable": "Not applicable"})
WEIGHTS = {"unmet": 1.0, "partial": 0.6, "unverifiable": 0.4}
BADNESS = {"met": 0, "unverifiable": 1, "partial": 2, "unmet": 3}


def lookup(x: Column, table: dict, otherwise=None) -> Column:
    out = F.when(F.lit(False), F.lit(next(iter(table.values()))))
    for k, v in table.items():
        out = out.when(x == k, F.lit(v))
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def worst(verdict: Column, position: Column) -> Column:
    """G15, an aggregate: the worst verdict; not_applicable only where it came first and nothing worse than met follows."""
    top = F.max(lookup(verdict, BADNESS))
    first = F.min_by(verdict, position)
    named = F.when(F.lit(False), F.lit(""))
    for k, v in BADNESS.items():
        named = named.when(top == v, F.lit(k))
    return F.when((first == "not_applicable") & F.coalesce(top == 0, F.lit(True)), "not_applicable").otherwise(named)
