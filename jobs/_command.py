"""The command line that the jobs share: a configuration file, whose values options of the same names replace."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def main(run: Callable[..., dict], module: str, about: str) -> None:
    """Reads the options, starts a session, runs the job with them, and ends the session."""
    beside = Path(module).with_suffix(".json")
    parser = argparse.ArgumentParser(description=about, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--config", default=str(beside), help="a JSON object of the job's options (default: the file beside the job)")
    defaults = json.loads(beside.read_text())
    for name in defaults:
        parser.add_argument(f"--{name}", help=f"default: {defaults[name]}" if not isinstance(defaults[name], list) else "JSON, or see the file")
    asked = vars(parser.parse_args())
    options = defaults | json.loads(Path(asked.pop("config")).read_text())
    for name, value in asked.items():
        if value is not None:
            options[name] = value if isinstance(defaults[name], str) else json.loads(value)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(beside.stem).getOrCreate()
    try:
        run(spark, **options)
    finally:
        spark.stop()
