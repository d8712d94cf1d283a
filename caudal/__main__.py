"""``spark-submit … -m caudal etl``: scores all transactions and reloads the fraud mart."""

from __future__ import annotations

import argparse

from caudal.plans.fraud import etl_run
from caudal.plans.fraud_mart import etl_resumen, mart_views
from caudal.session import build_session
from caudal.sources.tables import Tables, read_exchange_rates


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="caudal", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    etl = commands.add_parser("etl", help="extract, score and load")
    etl.add_argument("--tables", required=True, help="folder with one Parquet or CSV folder per table")
    etl.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    etl.add_argument("--rates", help="exchange-rate CSV (dd/mm/yyyy, rate), if not among the tables")
    etl.add_argument("--mart", required=True, help="folder whose etl_* tables are replaced")
    etl.add_argument("--staging", help="folder to copy the source tables to first")
    args = parser.parse_args(argv)

    spark = build_session(app="caudal-etl")
    reader = Tables.from_parquet if args.format == "parquet" else Tables.from_csv
    tables = reader(spark, args.tables)
    if args.rates:
        tables = tables.replacing(tipo_cambio=read_exchange_rates(spark, args.rates))
    etl_run(spark, tables, args.mart, staging=args.staging)
    etl_resumen(mart_views(spark)).show(truncate=False, vertical=True)


if __name__ == "__main__":
    main()
