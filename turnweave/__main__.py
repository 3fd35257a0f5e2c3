"""python -m turnweave apply | benchmark: pipelines over annotation and score files.

apply SCORES INTO        Parquet scores (uri, frame, score) to RTTM lines of activity
benchmark REF HYP INTO   RTTM files to reports of errors and numbers of speakers
optimise SCORES REF INTO  thresholds of the activity detector by trials, with a journal and the best ones
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="turnweave")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("apply")
    a.add_argument("scores")
    a.add_argument("into")
    for name, value in (("onset", 0.5), ("offset", 0.5), ("step", 0.016875), ("duration", 0.0619375), ("min-duration-on", 0.0), ("min-duration-off", 0.0)):
        a.add_argument(f"--{name}", type=float, default=value)
    b = sub.add_parser("benchmark")
    for name in ("reference", "hypothesis", "into"):
        b.add_argument(name)
    b.add_argument("--uem")
    b.add_argument("--bucket", type=float, default=60.0)
    o = sub.add_parser("optimise")
    for name in ("scores", "reference", "into"):
        o.add_argument(name)
    for name, kind, value in (("trials", int, 10), ("seed", int, 0), ("step", float, 0.016875), ("duration", float, 0.0619375), ("bucket", float, 60.0)):
        o.add_argument(f"--{name}", type=kind, default=value)
    args = p.parse_args(argv)

    from turnweave.plans import pipelines
    from turnweave.sources import formats

    spark = SparkSession.builder.getOrCreate()
    if args.command == "apply":
        params = pipelines.ActivityParams(args.onset, args.offset, args.min_duration_on, args.min_duration_off)
        formats.write_rttm(pipelines.activity_detection(spark.read.parquet(args.scores), params, args.step, args.duration), args.into)
        return
    if args.command == "optimise":
        from turnweave.operators import metrics
        from turnweave.plans.config import Journal, Space, Uniform

        scores, reference = spark.read.parquet(args.scores).persist(), formats.read_rttm(spark, args.reference).persist()
        space = Space({"onset": Uniform(0.05, 0.95), "offset": Uniform(0.05, 0.95)})
        run = lambda onset, offset: pipelines.activity_detection(scores, pipelines.ActivityParams(onset, min(onset, offset), 0.0, 0.0), args.step, args.duration)

        def loss(found) -> float:
            parts = metrics.detection(reference, found, None, args.bucket)
            total = parts.selectExpr("sum(false_alarm + missed_detection) / sum(total) AS e").first().e
            return float("inf") if total is None else float(total)

        pipelines.optimise(list(space.trials(args.trials, args.seed)), run, loss, journal=Journal(args.into))
        return
    uem = formats.read_uem(spark, args.uem).select("uri", "start", "end") if args.uem else None
    reports = pipelines.benchmark(formats.read_rttm(spark, args.reference), formats.read_rttm(spark, args.hypothesis), uem, args.bucket)
    for name, df in reports.items():
        df.write.mode("errorifexists").csv(f"{args.into}/{name}", header=True)


if __name__ == "__main__":
    main()
