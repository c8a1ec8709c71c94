"""python -m quillworks check PATH... | rules | eval PATH... : the command line over the plans."""

from __future__ import annotations

import argparse
import json
import os
import sys


def session():  # noqa: ANN201
    from pyspark.sql import SparkSession

    s = SparkSession.builder.appName("quillworks").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_folder(spark) -> None:  # noqa: ANN001
    """Checkpoints go to the folder that the cluster names; to one of our own only where one machine runs all."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not f"{spark.sparkContext.master}[".startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(where or os.path.join(os.getcwd(), ".quillworks-work"))


def main(argv: list[str] | None = None) -> int:
    """0 no flags, 1 flags, 2 failure, also of a judge that answered nothing it was asked."""
    from .plans import report
    from .sources import drafts as D
    from .sources import ruleset as R

    p = argparse.ArgumentParser(prog="quillworks")
    p.add_argument("command", choices=("check", "rules", "eval"))
    p.add_argument("paths", nargs="*")
    p.add_argument("--rules")
    p.add_argument("--only", help="tags, comma-separated")
    p.add_argument("--skip")
    p.add_argument("--threshold", type=float)
    p.add_argument("--replay", help="a recording that answers the judgment rules")
    p.add_argument("--json", action="store_true")
    p.add_argument("--out", help="folder for an evaluation's results")
    p.add_argument("--seed", type=int, default=1)
    a = p.parse_args(argv)
    tags = lambda x: [t.strip() for t in x.split(",") if t.strip()] if x else None
    try:
        rules = R.resolve(".", a.rules)
        kept, dropped = R.select(rules, tags(a.only), tags(a.skip))
        for w in rules.warnings:
            print(w, file=sys.stderr)
        if a.command == "rules":
            for r in kept.rules:
                print(f"{r.id}\t{r.kind}\t{', '.join(r.tags)}")
            for why, ids in R.dropped_by_reason(dropped).items():
                print(f"left out ({why}): {', '.join(ids)}")
            return 0
        spark = session()
        texts, rejects = D.read_drafts(spark, a.paths or ["."], os.getcwd())
        for r in rejects.toLocalIterator():
            print(f"{r.file}: not read, it {r.reason}", file=sys.stderr)
        judge = None
        if a.replay:
            from .sources.files import load_recording

            judge = load_recording(os.path.dirname(os.path.abspath(a.replay)), os.path.basename(a.replay)).judge()
        if a.command == "check":
            from .operators import flags as G
            from .plans.check import check

            if judge:
                shared_folder(spark)
            found = check(texts, rules, tags(a.only), tags(a.skip), judge, bar=a.threshold)
            out = G.json_out(found.flags) if a.json else G.lines_out(found.flags)
            n = 0
            for row in out.orderBy("file", "line", "rule").toLocalIterator():
                print(row[3])
                n += 1
            if found.outcomes is None:
                return 1 if n else 0
            for row in G.skip_lines(found.skipped).orderBy("unsent", "text").toLocalIterator():
                print(row.text, file=sys.stderr)
            print(G.usage(found.outcomes, found.hits).first().text, file=sys.stderr)
            asked, answered = found.outcomes.selectExpr("count(*)", "count_if(outcome = 'answered')").first()
            return 2 if asked and not answered else 1 if n else 0
        from pyspark.sql import functions as F

        from .operators.chunk import chunk_drafts
        from .plans.evaluate import evaluate

        shared_folder(spark)
        chunks = chunk_drafts(texts).where("kind = 'prose'")
        bases = chunks.select(F.concat(F.lit("C"), F.lpad(F.conv(F.hex(F.xxhash64("file", "line")), 16, 10), 20, "0")).alias("id"), "file", "line", "text")
        tables = evaluate(bases, rules, judge, a.seed).tables(a.threshold or rules.bar)
        if a.out:
            report.write(a.out, tables, "Evaluation")
        found, text = report.render(tables, "Evaluation")
        print(json.dumps(found) if a.json else text)
        return 0
    except (R.RulesetError, D.SourceError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
