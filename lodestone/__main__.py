"""python -m lodestone parse|download [--config FILE]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lodestone.plans import prepare
from lodestone.plans.config import load_config
from lodestone.plans.session import importable


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lodestone", description="Prepare and download source code for language-model training")
    parser.add_argument("command", choices=["parse", "download"])
    parser.add_argument("--config", default="config/config.yaml")
    args = parser.parse_args(argv)
    config = load_config(args.config)
    prepare.setup_logging(config.layout().logs)
    spark = importable(spark or SparkSession.builder.appName("lodestone").getOrCreate())
    if args.command == "parse":
        with prepare.timer("Parsing dataset"):
            prepare.prepare_dataset(spark, config)
    else:
        with prepare.timer("Downloading data"):
            prepare.download_data(spark, config)


if __name__ == "__main__":
    main()
