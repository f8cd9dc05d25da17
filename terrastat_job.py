"""Submit script for the whole study."""

import argparse

from pyspark.sql import SparkSession

from terrastat.plans.job import run_study

if __name__ == "__main__":
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("register", "centres", "population", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--buckets", type=int)
    run_study(SparkSession.builder.getOrCreate(), **vars(parser.parse_args()))
