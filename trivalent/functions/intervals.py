"""Inclusive spans: literal lookups, distances and a range join on bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, small_side
from . import fixed_values as fv
from .text import _col, flag

#: Powers of two by which the bins of :func:`range_join` are narrower or wider than its width.
NARROWEST, WIDEST = -40, 40


def span_name(position, spans=fv.DOMAIN_SPANS) -> Column:
    """Name of the span holding ``position``; below 1 is Signal, elsewhere Unknown."""
    pos = _col(position)
    out = F.when(pos < 1, "Signal")
    for name, lo, hi in spans:
        out = out.when(pos.between(lo, hi), name)
    return out.otherwise("Unknown")


def in_span(position, lo, hi) -> Column:
    return flag(_col(position).between(lo, hi))


def span_flags(position, spans, prefix: str = "in_") -> list[Column]:
    return [in_span(position, lo, hi).alias(f"{prefix}{name}") for name, lo, hi in spans]


def in_any_span(position, spans) -> Column:
    hits = [_col(position).between(lo, hi) for _, lo, hi in spans]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return flag(out)


def span_distance(position, lo, hi) -> Column:
    pos = _col(position)
    return F.greatest(lo - pos, pos - hi, F.when(pos.isNotNull(), 0.0))


def nearest_span_distance(position, spans=fv.EPITOPE_SPANS) -> Column:
    """Distance to the closest span, 0 inside; NULL for an unknown position."""
    return F.least(*[span_distance(position, lo, hi) for _, lo, hi in spans])


def range_join(rows: DataFrame, position: str, spans: DataFrame, bin_width: float,
               lo: str = "lo", hi: str = "hi", how: str = "left") -> DataFrame:
    """Rows with every span that holds ``position``, as an equi-join on bins of the spans' own sizes.

    Bins are ``bin_width`` times a power of two. A span is listed in the bins that it
    touches among those of a quarter to an eighth of its size; a row looks into one bin
    of each width in use. So candidates are about as many as the pairs found, however
    many spans there are. An exact bound check follows. Pairs are not stored; rows
    without a span are found by their distinct positions.
    """
    size = F.col(hi).cast("double") - F.col(lo).cast("double")
    level = F.when(size > bin_width * 2.0 ** WIDEST, WIDEST + 1).otherwise(
        F.greatest(F.coalesce(F.ceil(F.log2(size / bin_width)) - 3, F.lit(NARROWEST)), F.lit(NARROWEST))).cast("int")
    # What is wider than all bins stands in one bin for every position.
    cell = lambda value, level: F.when(level > WIDEST, F.lit(0)).otherwise(
        F.floor(value.cast("double") / (F.lit(float(bin_width)) * F.pow(F.lit(2.0), level)))).cast("long")
    known = spans.where(F.col(lo) <= F.col(hi)).select(
        F.struct(*spans.columns).alias("_span"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), level.alias("_level"))
    found = known.agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.collect_set("_level").alias("levels")).first()
    bins = F.explode(F.sequence(cell(F.col("_lo"), F.col("_level")), cell(F.col("_hi"), F.col("_level"))))
    listed = small_side(known.withColumn("_bin", bins))

    def placed(df: DataFrame) -> DataFrame:
        near = df.where(F.col("_at").between(F.lit(found["lo"]), F.lit(found["hi"])))
        levels = F.explode(F.array(*[F.lit(x) for x in sorted(found["levels"])]).cast("array<int>"))
        return near.withColumn("_level", levels).withColumn("_bin", cell(F.col("_at"), F.col("_level"))).alias("a")

    spanned = (F.col("a._level") == F.col("b._level")) & (F.col("a._bin") == F.col("b._bin")) & F.col("_at").between(F.col("_lo"), F.col("_hi"))
    each = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.col(position).alias("_at"))
    of_row, of_span = ([F.col(f"{side}.`{c}`").alias(c) for c in df.columns] for side, df in (("_row", rows), ("_span", spans)))
    pairs = placed(each).join(listed.alias("b"), spanned).select(*of_row, *of_span)
    if how == "inner":
        return pairs
    held = materialise(placed(each.select("_at").distinct()).join(listed.alias("b"), spanned, "left_semi").select("_at").distinct(), "held")
    alone = each.join(small_side(held), "_at", "left_anti").select(
        *of_row, *[F.lit(None).cast(f.dataType).alias(f.name) for f in spans.schema.fields])
    return pairs.union(alone)
