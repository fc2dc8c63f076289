"""``python -m countloom list | run NAME SF_DIR [OUT] | explain NAME SF_DIR | verify FOLDER SEALED``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from countloom.plans.catalogue import QUERIES
from countloom.plans.provenance import verify
from countloom.sources.files import write_csv


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print(*sorted(QUERIES), sep="\n")
        return 0
    spark = SparkSession.builder.appName("countloom").getOrCreate()
    if args[:1] == ["run"] and len(args) in (3, 4):
        df = QUERIES[args[1]](spark, args[2])
        if len(args) == 4:
            write_csv(df, args[3])
        else:
            df.show(50, truncate=False)
        return 0
    if args[:1] == ["explain"] and len(args) == 3:
        QUERIES[args[1]](spark, args[2]).explain("formatted")
        return 0
    if args[:1] == ["verify"] and len(args) == 3:
        wrong = verify(spark, args[1], spark.read.parquet(args[2]))
        wrong.show(truncate=False)
        return int(not wrong.isEmpty())
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
