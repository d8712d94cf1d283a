"""Per-period counts and comparisons between periods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from caudal.functions.dates import year_in
from caudal.functions.text import change_pct, change_text


def yearly(df: DataFrame, on: str, years: list[int], *measures: Column) -> DataFrame:
    """One row per year of ``years`` that has data."""
    return (
        df.filter(year_in(F.col(on), years))
        .groupBy(F.year(on).alias("anio"))
        .agg(*measures)
        .orderBy("anio")
    )


def yearly_by(
    df: DataFrame, on: str, years: list[int], part: str, of: Column, *measures: Column
) -> DataFrame:
    """One row per year and sub-period (quarter or month)."""
    return (
        df.filter(year_in(F.col(on), years))
        .groupBy(F.year(on).alias("anio"), of.cast("int").alias(part))
        .agg(*measures)
        .orderBy("anio", part)
    )


def yearly_counts(
    df: DataFrame, on: str, years: list[int], metrics: dict[str, Column]
) -> DataFrame:
    """(metrica, anios) with one {anio, valor} per year of ``years``, zero where there is none.

    One conditional aggregation over one scan; complete even for an empty table.
    """
    rows = [
        F.struct(
            F.lit(name).alias("metrica"),
            F.array(
                *[
                    F.struct(
                        F.lit(y).alias("anio"),
                        F.count_if(keep & (F.year(on) == y)).alias("valor"),
                    )
                    for y in years
                ]
            ).alias("anios"),
        )
        for name, keep in metrics.items()
    ]
    return (
        df.filter(year_in(F.col(on), years))
        .agg(F.array(*rows).alias("r"))
        .select(F.explode("r").alias("r"))
        .select("r.*")
    )


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def year_over_year(counts: DataFrame) -> DataFrame:
    """Each year against the one before it in the list."""
    pairs = F.transform(
        F.sequence(F.lit(2), F.size("anios")),
        lambda i: F.struct(
            F.element_at("anios", i).getField("anio").alias("anio"),
            F.element_at("anios", i).getField("valor").alias("valor"),
            F.element_at("anios", i - 1).getField("valor").alias("previo"),
        ),
    )
    return (
        counts.select("metrica", F.explode(pairs).alias("p"))
        .select("metrica", "p.*")
        .withColumn("cambio_pct", change_pct(F.col("valor"), F.col("previo")).cast("double"))
        .withColumn("texto", change_text(F.col("valor"), F.col("previo")))
        .orderBy("metrica", "anio")
    )


def best_year(counts: DataFrame) -> DataFrame:
    """The year with the largest value; the earliest one wins a tie."""
    ranked = F.transform(
        "anios", lambda e: F.struct(e.getField("valor").alias("valor"), (-e.getField("anio")).alias("neg"))
    )
    return (
        counts.select("metrica", F.array_max(ranked).alias("m"))
        .select("metrica", (-F.col("m.neg")).alias("anio"), F.col("m.valor").alias("valor"))
        .orderBy("metrica")
    )


def compare_two_years(
    df: DataFrame,
    on: str,
    now: int,
    before: int,
    part: str,
    of: Column,
    size: int,
    metrics: dict[str, Column],
) -> DataFrame:
    """Metrics of each sub-period 1..``size`` in two years, with zero where there is none."""
    measures = []
    for name, keep in metrics.items():
        measures.append(F.count_if(keep & (F.year(on) == now)).alias(f"{name}_actual"))
        measures.append(F.count_if(keep & (F.year(on) == before)).alias(f"{name}_previo"))
    grouped = (
        df.filter(year_in(F.col(on), [before, now]))
        .groupBy(of.cast("int").alias(part))
        .agg(*measures)
    )
    periods = df.sparkSession.range(1, size + 1).select(F.col("id").cast("int").alias(part))
    filled = periods.join(grouped, part, "left").fillna(0)
    for name in metrics:
        a, b = F.col(f"{name}_actual"), F.col(f"{name}_previo")
        filled = filled.withColumn(f"{name}_cambio", change_text(a, b))
    return filled.orderBy(part)
