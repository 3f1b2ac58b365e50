"""Run an analysis over raw folders: python -m stationlake COMMAND --raw FOLDER ...

Results are shown, or written as parquet under --out (one folder per table).
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from stationlake.functions.vocabulary import normalise_parameter
from stationlake.operators import completeness, wide
from stationlake.plans import analyses
from stationlake.session import get_session
from stationlake.sources import locations, pages

COMMANDS = ["pca", "violations", "tails", "exposure", "stations", "missing", "coverage", "compare"]


def arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="stationlake", description=__doc__)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("--raw", required=True, help="folder of station=ID folders, or glob of long CSV")
    parser.add_argument("--layout", choices=["bare", "long"], default="bare")
    parser.add_argument("--metadata", help="location metadata (JSON array); needed for bare files")
    parser.add_argument("--density", help="parquet with location_name, pop_density (exposure)")
    parser.add_argument("--pages", help="landed JSON pages to compare with (compare)")
    parser.add_argument("--station", help="location name (tails)")
    parser.add_argument("--start", default="2025-01-01")
    parser.add_argument("--end", default="2026-01-01")
    parser.add_argument("--out")
    parser.add_argument("--scratch", help="folder shared by all executors, if spark.checkpoint.dir is not set")
    return parser.parse_args()


def results(spark, args) -> dict:
    if args.layout == "bare":
        readings = analyses.load_bare(spark, args.raw, args.metadata)
    else:
        readings, rejects = analyses.load_long(spark, args.raw)
    if args.command == "pca":
        found = analyses.pca_analysis(readings)
        return {name: getattr(found, name) for name in ("kpi", "loadings", "variance", "centroids", "scores")}
    if args.command == "tails":
        found = analyses.tail_analysis(readings, args.station)
        return {name: getattr(found, name) for name in ("kpi", "histogram", "survival", "exceedance")}
    if args.command in ("violations", "exposure"):
        names = (
            locations.station_names(locations.read_locations(spark, args.metadata))
            if args.metadata
            else None  # every reading counts under the name it carries
        )
        if args.command == "violations":
            return {"heatmap": analyses.violation_analysis(readings, names)}
        return {"exposure": analyses.exposure_analysis(readings, names, spark.read.parquet(args.density))}
    if args.command == "stations":
        known = readings.filter(F.col("value").isNotNull()).withColumn(
            "parameter", normalise_parameter(F.col("parameter"), "other")
        ).filter("parameter <> 'other'")
        return {
            "size": wide.table_size(readings, "location_name"),
            "stations": completeness.stations_with_all(known, ["location_name"]),
        }
    if args.command == "missing":
        return {"missing": completeness.missing_report(readings, ruleset="narrow")}
    if args.command == "coverage":
        keys = ["station_id", "parameter"]
        return {
            "coverage": completeness.coverage(readings, args.start, args.end, keys),
            "gaps": completeness.missing_hours(readings, args.start, args.end, keys),
        }
    landed = pages.land_measurements(pages.read_pages(spark, args.pages))
    compared, summary = analyses.compare_sources(landed, readings)
    return {"summary": summary, "compared": compared}


def main() -> None:
    args = arguments()
    spark = get_session(**({"spark.checkpoint.dir": args.scratch} if args.scratch else {}))
    for name, table in results(spark, args).items():
        if args.out:
            table.write.mode("overwrite").parquet(f"{args.out}/{name}")
        else:
            print(name)
            table.show(truncate=False)


if __name__ == "__main__":
    main()
