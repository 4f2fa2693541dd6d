"""Command line: ``python -m rillflow.cli -c FILE -s SECTION SKETCH`` evaluates a sketch; ``--list`` names the sketches and queries; ``--query NAME -d DIR`` shows a query."""

from __future__ import annotations

import argparse
import logging

from .operators import sketch

LEVELS = {"VERBOSE": logging.DEBUG, "DEBUG": logging.DEBUG, "INFO": logging.INFO, "WARNING": logging.WARNING, "ERROR": logging.ERROR, "FATAL": logging.CRITICAL}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("sketch", nargs="?", choices=sketch.names())
    p.add_argument("-c", "--config", default="sketch_config.toml")
    p.add_argument("-s", "--section", default="CM")
    p.add_argument("-q", "--query")
    p.add_argument("-d", "--data", default="/root/testdata/sf0.01")
    p.add_argument("-l", "--log", default="INFO", choices=LEVELS)
    p.add_argument("--list", action="store_true")
    a = p.parse_args(args)
    logging.basicConfig(level=LEVELS[a.log], format="%(levelname)s %(filename)s:%(lineno)d %(message)s")
    from .plans import registry

    if a.list:
        print("sketches:", *sketch.names(), "\nqueries:", *registry.queries())
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("rillflow").getOrCreate()
    if a.query:
        registry.queries()[a.query](spark, a.data).show(truncate=False)
    elif a.sketch:
        from .operators.evaluate import report
        from .plans.evaluation import evaluate

        print(report(evaluate(spark, a.config, a.section, a.sketch)))
    else:
        p.print_help()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
