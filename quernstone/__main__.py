"""python -m quernstone [--root DIR] METHOD [name=value ...]: one request, answered as JSON; serve answers lines of them."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from . import api


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quernstone")
    p.add_argument("--root", default=".")
    p.add_argument("method")
    p.add_argument("arguments", nargs="*")
    a = p.parse_args(argv)
    args = {}
    for x in a.arguments:
        k, _, v = x.partition("=")
        try:
            args[k] = json.loads(v)
        except ValueError:
            args[k] = v
    spark = SparkSession.builder.appName("quernstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.method == "serve":
        api.serve(lambda root: api.Engine(spark, api.discover(api.inside(a.root, os.path.join(a.root, root)))), sys.stdin, lambda x: print(x, flush=True))
        return
    print(json.dumps(api.request(api.Engine(spark, api.discover(a.root)), {"method": a.method, **args}), default=str, ensure_ascii=False))


if __name__ == "__main__":
    main()
