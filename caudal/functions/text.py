"""Text rendering of numbers and changes, and case-insensitive matching."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Labels that must read as users of the dashboards know them.
MESES = (
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
)
TRIMESTRES = ("Q1 (Ene-Mar)", "Q2 (Abr-Jun)", "Q3 (Jul-Sep)", "Q4 (Oct-Dic)")


def contains_ci(c: Column, fragment: str) -> Column:
    """Case-insensitive "contains"; the fragment has no wildcards."""
    return F.contains(F.lower(c), F.lower(F.lit(fragment)))


def like_ci(c: Column, pattern: str) -> Column:
    return F.lower(c).like(pattern)


def plain_number(value: Column) -> Column:
    """At most two decimals and no trailing zeros: 20, 9.5, 3.27."""
    return F.regexp_replace(value.cast("decimal(20,2)").cast("string"), r"\.?0+$", "")


def thousands(value: Column) -> Column:
    """Whole number with comma grouping."""
    return F.format_number(F.round(value.cast("decimal(38,6)"), 0).cast("decimal(32,0)"), 0)


def money(value: Column) -> Column:
    """``$1,234.50``"""
    return F.concat(F.lit("$"), F.format_number(F.round(value.cast("decimal(38,6)"), 2), 2))


def money_compact(value: Column) -> Column:
    """``$1.23B MXN``, ``$4.56M MXN``, ``$7.8K MXN`` or ``$900 MXN``."""
    exact = value.cast("decimal(38,6)")
    size = F.abs(exact)

    def scaled(divisor: int, digits: int, suffix: str) -> Column:
        shown = F.round(exact / F.lit(divisor), digits).cast(f"decimal(30,{digits})")
        return F.concat(F.lit("$"), shown.cast("string"), F.lit(f"{suffix} MXN"))

    return (
        F.when(size >= 10**9, scaled(10**9, 2, "B"))
        .when(size >= 10**6, scaled(10**6, 2, "M"))
        .when(size >= 10**3, scaled(10**3, 1, "K"))
        .otherwise(F.concat(F.lit("$"), thousands(value), F.lit(" MXN")))
    )


def percent(value: Column) -> Column:
    """``12.30%``; NULL reads as zero."""
    shown = F.round(F.coalesce(value.cast("decimal(20,6)"), F.lit(0)), 2)
    return F.concat(shown.cast("decimal(18,2)").cast("string"), F.lit("%"))


def change_pct(now: Column, before: Column) -> Column:
    """Percent change of two counts, one decimal; NULL when ``before`` is 0."""
    ratio = F.try_divide(
        (now.cast("decimal(20,0)") - before.cast("decimal(20,0)")) * 100,
        before.cast("decimal(20,0)"),
    )
    return F.round(ratio, 1).cast("decimal(30,1)")


def change_text(now: Column, before: Column) -> Column:
    change = change_pct(now, before)
    rise = now.cast("decimal(20,0)") >= before.cast("decimal(20,0)")
    shown = F.concat(F.abs(change).cast("string"), F.lit("%"))
    return (
        F.when((before == 0) & (now > 0), F.lit("aumentó 100%"))
        .when(before == 0, F.lit("sin cambio"))
        .when(rise, F.concat(F.lit("aumentó "), shown))
        .otherwise(F.concat(F.lit("bajó "), shown))
    )


def name_at(names: tuple[str, ...], index: Column) -> Column:
    """The ``index``-th name (1-based)."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def month_of_label(mes: Column) -> Column:
    """The month digits of ``YYYY-MM``."""
    return F.substring(mes, 6, 2)
