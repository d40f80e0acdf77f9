"""What the jobs share: settings, the session's temporary settings, the command line."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def settings_of(name: str, given: dict | None = None) -> dict:
    """The job's config file beside it, with `given` over it; an unknown name is an error."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json")) as f:
        known = json.load(f)
    if wrong := set(given or {}) - set(known):
        raise ValueError(f"unknown settings of {name}: {sorted(wrong)}")
    return known | (given or {})


@contextmanager
def during(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings ('__' for '.') for a while; then they are as before."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def replace_partitions(df: DataFrame, path: str, by: list[str], kind: str = "parquet") -> None:
    """Write `df`, replacing just the partitions that it has rows of; large partitions have several files."""
    df.hint("rebalance", *by).write.format(kind).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).save(path)


def main(name: str, about: str, paths: list[str], work: Callable[..., object]) -> None:
    """Command line: one option for each path, and --set name=value over the config file or --config."""
    parser = argparse.ArgumentParser(prog=f"jobs/{name}.py", description=about)
    for path in paths:
        parser.add_argument(f"--{path}", required=True)
    parser.add_argument("--config", help="JSON file with settings, in place of the one beside the job")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="one setting, as JSON")
    given = parser.parse_args()
    own: dict = {}
    if given.config:
        with open(given.config) as f:
            own = json.load(f)
    for pair in given.set:
        key, _, value = pair.partition("=")
        own[key] = json.loads(value)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    spark = SparkSession.builder.appName(f"jobs.{name}").getOrCreate()
    try:
        work(spark, *[getattr(given, p) for p in paths], settings=own)
    finally:
        spark.stop()
