"""Command line: python -m tidepanel DATA [--settings FILE] [--methods a,b] [--draws N] [--cost-bps X] [--band-only] [--out DIR]."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from . import catalogue
from .config import Settings, load
from .operators import study


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidepanel", description="Methods of allocation on the same walk-forward windows.")
    parser.add_argument("data", help="folder of the tables")
    parser.add_argument("--settings", help="YAML file")
    parser.add_argument("--methods", default="alignment,equal_weight,sector", help="of " + ", ".join(study.METHODS))
    parser.add_argument("--draws", type=int, default=catalogue.DRAWS)
    parser.add_argument("--cost-bps", type=float)
    parser.add_argument("--band-only", action="store_true", help="only the clusters of the last window by band")
    parser.add_argument("--out", help="folder for the tables, as parquet")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    methods = tuple(m.strip() for m in given.methods.split(","))
    if unknown := set(methods) - set(study.METHODS):
        parser.error(f"unknown methods: {', '.join(sorted(unknown))}")
    settings = load(given.settings) if given.settings else Settings()
    spark = SparkSession.builder.appName("tidepanel").getOrCreate()
    found = catalogue.report(spark, given.data, methods, given.draws, settings, given.cost_bps, given.band_only)
    for name, df in found.items():
        logging.info("%s", name)
        df.show(200, False)
        if given.out:
            df.write.mode("overwrite").parquet(f"{given.out}/{name}")


if __name__ == "__main__":
    main(sys.argv[1:])
