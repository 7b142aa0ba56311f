"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from lexmill.session import session


def settings(spark: SparkSession, path: str | None) -> dict[str, Any]:
    """A JSON file of settings, read through Spark so that its path may be remote."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}


def main(job: Callable[..., Any], paths: list[str], argv: list[str] | None = None) -> None:
    """Runs ``job(spark, *paths, **settings)``; makes the session and stops it."""
    parser = argparse.ArgumentParser(description=(job.__doc__ or "").split("\n")[0])
    for name in paths:
        parser.add_argument(f"--{name}", help="path; in the configuration file where it isn't given")
    parser.add_argument("--config", help="JSON file of settings")
    parser.add_argument("--master")
    given = vars(parser.parse_args(argv))
    spark = session(job.__module__, given.pop("master"))
    try:
        values = settings(spark, given.pop("config"))
        values |= {name: path for name, path in given.items() if path}
        if missing := [name for name in paths if name not in values]:
            parser.error(f"missing: {', '.join(missing)}")
        job(spark, *(values.pop(name) for name in paths), **values)
    finally:
        spark.stop()
