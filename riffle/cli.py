"""riffle review DIFF... | extract DIFF... | profile FOLDER | rescore RUN | gate BASE CURRENT | compare RUN... | version.

Exit codes: review 1 flagged, 0 approved; gate 1 failed, 0 passed; 2 for any error, runs that can't be compared among them.
"""

from __future__ import annotations

import argparse
import sys

import riffle


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="riffle")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("review", "extract"):
        sub = commands.add_parser(name)
        sub.add_argument("diffs", nargs="+", help="paths that Spark can read")
        sub.add_argument("--out", help="folder for the artifacts")
        sub.add_argument("--config", help="JSON file with toggles and limits")
    sub = commands.add_parser("profile")
    sub.add_argument("folder", help="tree of Python sources that Spark can read")
    sub.add_argument("--out", help="folder for the tables of the profile")
    for name, args in (("rescore", ("run",)), ("gate", ("base", "current")), ("compare", ("runs",))):
        sub = commands.add_parser(name)
        for a in args:
            sub.add_argument(a, **({"nargs": "+"} if a == "runs" else {}), help="folder of a stored run")
        sub.add_argument("--emits", default="", help="CWEs that some detector can name, with commas")
    commands.add_parser("version")
    return parser


def _review(args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from riffle import config
    from riffle.plans.review import review
    from riffle.session import local_session
    from riffle.sinks import reports
    from riffle.telemetry import Telemetry

    spark, clock = local_session(), Telemetry()
    diffs = spark.read.text(args.diffs, wholetext=True).select(F.col("_metadata.file_name").alias("run_id"), F.col("value").alias("text"))
    chosen = config.Config()
    if args.config:
        chosen = config.load(spark.read.text(args.config, wholetext=True).first()[0])
    with clock.phase("review"):
        result = review(diffs, config=chosen)
        rows = result.verdicts.orderBy("run_id").collect()  # one row for each diff given
    if args.out and args.command == "review":
        reports.write_run(result, args.out, clock.frame(spark, rows[0].run_id) if rows else None)
    elif args.out:
        for name in ("manifest", "dep_deltas"):
            reports.write_artifact(getattr(result, name), args.out, name)
    if args.command == "extract":
        result.manifest.show(truncate=False)
        return 0
    for r in rows:
        print(f"{r.run_id}\t{r.verdict}\t{r.triggers}")
    return int(any(r.verdict == "flagged" for r in rows))


def _profile(args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from riffle.operators import evaluate, profile
    from riffle.session import local_session
    from riffle.sources import python_code
    from riffle.storage import materialize

    spark = local_session()
    tree = spark.read.text(args.folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.py")
    root = spark._jvm.org.apache.hadoop.fs.Path(args.folder).toUri().getPath().rstrip("/")
    files = tree.select(F.substr(F.element_at(F.split("_metadata.file_path", root, 2), -1), F.lit(2)).alias("path"), F.col("value").alias("text"))
    facts, _ = materialize(python_code.scan_sources(files), "facts")
    g, ep = profile.build_graph(facts), profile.endpoints(facts)
    if args.out:
        profile.save_graph(g, f"{args.out}/graph")
        for name, table in (("access_matrix", profile.access_matrix(ep)), ("io_channels", profile.io_channels(ep)), ("sensitive_fields", profile.sensitive_fields(g.nodes))):
            table.write.mode("errorifexists").parquet(f"{args.out}/{name}")
    for r in evaluate.graph_stats(g.nodes, g.edges).orderBy("what", "name").collect():  # a row for each kind
        print(f"{r.what}\t{r.name}\t{r.n}")
    return 0


def _stored(args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from riffle.plans import benchmark
    from riffle.session import local_session
    from riffle.sinks import scorecards

    spark = local_session()
    emits = spark.createDataFrame([(c,) for c in args.emits.split(",") if c], "cwe string")
    show = lambda rows: [print("\t".join(map(str, r))) for r in rows]
    if args.command == "rescore":
        show(scorecards.rendered(benchmark.measures(benchmark.rescore(benchmark.load_run(spark, args.run), emits))).select("measure", "text").collect())
        return 0
    if args.command == "gate":
        found, verdict = benchmark.compare(benchmark.load_run(spark, args.base), benchmark.load_run(spark, args.current), emits)
        show(found.orderBy("kind", "name").collect())  # some dozen checks
        v = verdict.first()
        print(v.verdict, *v.failed, *v.problems, sep="\t")
        return {"passed": 0, "failed": 1}.get(v.verdict, 2)
    arms = None
    for run in args.runs:
        one = scorecards.rendered(benchmark.measures(benchmark.rescore(benchmark.load_run(spark, run), emits)))
        rows = one.select(F.lit(1).alias("section_no"), F.lit("Measures").alias("section"), F.lit(run.rstrip("/").rsplit("/", 1)[-1]).alias("arm"), F.col("measure").alias("measure_no"), "measure", "text")
        arms = rows if arms is None else arms.unionByName(rows)
    print(scorecards.comparison_page(arms, "Comparison").first().html)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "version":
        print(riffle.__version__)
        return 0
    try:
        return {"review": _review, "extract": _review, "profile": _profile}.get(args.command, _stored)(args)
    except Exception as error:  # noqa: BLE001
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
