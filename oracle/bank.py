"""The banking tables as SQL common table expressions over the sample tables."""

from __future__ import annotations

from caudal.sources.sample_bank import PROJECTIONS

_RATES = """
    SELECT CAST(ts AS DATE) AS fecha,
           CAST(CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS DECIMAL(10,4)) AS rate
    FROM events
    GROUP BY CAST(ts AS DATE)"""


def table(name: str, timed: bool = False) -> str:
    if name == "tipo_cambio":
        return _RATES
    source, columns = PROJECTIONS["transacciones_con_hora" if timed and name == "transacciones" else name]
    return f"SELECT {', '.join(columns)} FROM {source}"


def bank(*names: str, timed: bool = False) -> list[tuple[str, str]]:
    return [(name, table(name, timed)) for name in names]


def query(ctes: list[tuple[str, str]], body: str) -> str:
    head = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes)
    return f"WITH {head}\n{body}"


def half_up(numerator: str, denominator: str, digits: int = 2) -> str:
    """numerator / denominator rounded half-up in integer arithmetic (both non-negative)."""
    scale = 10**digits
    n, d = f"CAST({numerator} AS HUGEINT)", f"CAST({denominator} AS HUGEINT)"
    return (
        f"CASE WHEN {d} = 0 THEN NULL ELSE "
        f"CAST((2 * {scale} * {n} + {d}) // (2 * {d}) AS DOUBLE) / {scale} END"
    )


def pct(part: str, whole: str) -> str:
    return half_up(f"100 * ({part})", f"({whole})")


def cents(amount: str) -> str:
    """A two-decimal amount as an integer."""
    return f"CAST(({amount}) * 100 AS HUGEINT)"
