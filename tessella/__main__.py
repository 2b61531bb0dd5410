"""python -m tessella --input FILE [--output FILE] [--config FILE] [--verbose]; python -m tessella encode FILE -o OUT [--k N] [--profile v1|v2]"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import SparkSession

from .plans import encode as E
from .plans import normalize as N
from .sources import tables


def load_config(path: str | None) -> dict:
    """A JSON configuration; YAML where its library is there."""
    if not path:
        return {}
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f) or {}


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    encode_only = args[:1] == ["encode"]
    parser = argparse.ArgumentParser(prog="tessella", description=__doc__)
    if encode_only:
        parser.add_argument("input_file")
        parser.add_argument("-o", "--output")
        parser.add_argument("--k", type=int, default=2)
        parser.add_argument("--profile", choices=("v1", "v2"), default="v1")
    else:
        parser.add_argument("-i", "--input", required=True)
        parser.add_argument("-o", "--output")
        parser.add_argument("-c", "--config")
        parser.add_argument("-v", "--verbose", action="store_true")
    given = parser.parse_args(args[1:] if encode_only else args)
    path = given.input_file if encode_only else given.input
    if not os.path.exists(path):
        print(f"no such file: {path}", file=sys.stderr)
        return 1
    if not path.lower().endswith((".csv", ".xlsx")):
        print(f"{path}: neither .csv nor .xlsx", file=sys.stderr)
        return 1
    logging.basicConfig(level=logging.DEBUG if not encode_only and given.verbose else logging.INFO)
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    if encode_only:
        encoding = E.encode(tables.read_cells(spark, path, given.profile == "v2"), E.Options(profile=given.profile, k=given.k), os.path.basename(path))
        tables.write_json(given.output or f"{os.path.splitext(path)[0]}_encoding.json", encoding)
        print(json.dumps(encoding["compression_metrics"]["overall"], indent=2))
        return 0
    try:
        print(N.summary(N.Normalizer(spark, N.Config.from_dict(load_config(given.config))).normalize(path, given.output)))
    except Exception as e:  # noqa: BLE001
        logging.exception("failed")
        print(f"failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
