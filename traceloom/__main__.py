"""python -m traceloom: run, check and status of recipes, models and cleaning, and reports.

Tables are Parquet paths that Spark reads. Progress goes to the standard output as
text or, with --json, as one JSON object a line.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Sequence
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TextReporter:
    """Progress as lines of text."""

    def __init__(self, out: TextIO | None = None) -> None:
        self.out, self.began = out or sys.stdout, time.monotonic()

    def event(self, name: str, **values: object) -> None:
        said = ", ".join(f"{k} {v}" for k, v in values.items())
        print(f"{time.monotonic() - self.began:8.1f} s  {name}" + (f": {said}" if said else ""), file=self.out, flush=True)


class JsonReporter(TextReporter):
    """Progress as JSON lines."""

    def event(self, name: str, **values: object) -> None:
        print(json.dumps({"event": name, "seconds": round(time.monotonic() - self.began, 3), **values}, default=str), file=self.out, flush=True)


#: What init writes.
EXAMPLE = """[bands]
alpha = [8.0, 13.0]

[windows]
all = []

[[features]]
measure = "variance"
windows = ["all"]
"""


def _shape(traces: DataFrame) -> tuple[float, int, list[str]]:
    one = traces.agg(F.max("sfreq").alias("sfreq"), F.max(F.size("x")).alias("n")).first()
    return one["sfreq"], one["n"], [r[0] for r in traces.select("channel").distinct().orderBy("channel").collect()]


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """The command's exit code: 0, or 2 for a recipe with problems."""
    from traceloom.model import workflow
    from traceloom.operators import cleaning, table
    from traceloom.plans import recipe

    parser = argparse.ArgumentParser(prog="traceloom")
    parser.add_argument("--json", action="store_true", help="progress as JSON lines")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, extra in (("init", ()), ("run", ("table", "output")), ("check", ("table",)), ("status", ("table", "output")), ("model", ("table", "output")), ("check-model", ("table",)), ("preprocess", ("table", "output")), ("report", ("table", "output"))):
        one = commands.add_parser(name)
        if name != "report":
            one.add_argument("recipe")
        for e in extra:
            one.add_argument(e)
        if name == "run":
            one.add_argument("--resume", action="store_true")
        if name == "preprocess":
            one.add_argument("--events")
    a = parser.parse_args(argv)
    report = (JsonReporter if a.json else TextReporter)()
    if a.command == "init":
        with open(a.recipe, "x") as f:
            f.write(EXAMPLE)
        report.event("written", recipe=a.recipe)
        return 0
    try:
        spark = spark or SparkSession.builder.appName("traceloom").getOrCreate()
        rows = spark.read.parquet(a.table)
        if a.command in ("run", "check", "status"):
            r = recipe.load_recipe(a.recipe)
            if a.command == "status":
                for state, n in recipe.status(rows, r, a.output).groupBy("state").count().collect():
                    report.event("status", state=state, recordings=n)
                return 0
            shape = _shape(rows)
            if a.command == "check":
                report.event("check", **recipe.check(rows, r, *shape))
            else:
                report.event("running", entries=len(r.entries))
                recipe.run(rows, r, a.output, *shape, resume=a.resume)
                report.event("done", output=a.output)
        elif a.command in ("model", "check-model"):
            import tomllib
            from pathlib import Path

            m = workflow.load_model_recipe(tomllib.loads(Path(a.recipe).read_text()))
            report.event("check", **workflow.check_model(rows, m))
            if a.command == "model":
                keep = [c for c in ("row", "row_id") if c in rows.columns]
                predictions, scores = workflow.run_model(rows, m, keep)
                predictions.write.parquet(f"{a.output}/predictions")
                scores.write.parquet(f"{a.output}/scores")
                for s in scores.collect():
                    report.event("score", **s.asDict())
        elif a.command == "preprocess":
            tables = {"events": spark.read.parquet(a.events)} if a.events else {}
            cleaning.preprocess(rows, a.recipe, tables).write.parquet(a.output)
            report.event("done", output=a.output)
        else:
            table.feature_quality(rows).write.parquet(a.output)
            report.event("done", output=a.output)
    except (recipe.RecipeError, workflow.ModelRecipeError, cleaning.CleaningError) as e:
        for line in str(e).splitlines():
            report.event("problem", what=line)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
