"""python -m graphloom list | run QUERY FOLDER [--rows N] | save QUERY FOLDER TARGET."""

import argparse


def main() -> None:
    parser = argparse.ArgumentParser(prog="graphloom")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="show the rows of a query over a folder of tables")
    run.add_argument("query"), run.add_argument("folder"), run.add_argument("--rows", type=int, default=20)
    save = sub.add_parser("save", help="write the rows of a query as Parquet")
    save.add_argument("query"), save.add_argument("folder"), save.add_argument("target")
    given = parser.parse_args()
    from pyspark.sql import SparkSession

    from . import catalog

    if given.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return
    if given.query not in catalog.QUERIES:
        parser.error(f"no query {given.query}")
    spark = SparkSession.builder.appName(f"graphloom {given.query}").getOrCreate()
    rows = catalog.QUERIES[given.query](spark, given.folder)
    if given.command == "run":
        rows.show(given.rows, truncate=False)
    else:
        rows.write.mode("overwrite").parquet(given.target)


if __name__ == "__main__":
    main()
