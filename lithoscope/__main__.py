"""The command line: python -m lithoscope VERB [--root DIR] [--out DIR] ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from lithoscope import config
from lithoscope.operators import export, graph, integrity, topology
from lithoscope.plans import pipeline

WRITING = ("scan", "map", "gaps", "essence", "run", "pipeline", "self")
READING = ("status", "init", "inspect", "metrics", "verify", "snapshot-contracts", "export", "rank", "impact", "duplicates", "health", "diff", "delta", "risk", "focus", "audit")


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lithoscope").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def show(rows, *order: str) -> None:
    """A bounded report's rows, one JSON object a line."""
    for r in pipeline.records(rows, *(order or rows.columns[:1])):
        print(json.dumps(r, ensure_ascii=False))


def needed(value, name: str):
    if not value:
        sys.exit(f"--{name} is needed")
    return value


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lithoscope")
    p.add_argument("verb", choices=(*WRITING, *READING))
    for name in ("root", "out", "clock", "target", "node", "format", "first", "second"):
        p.add_argument(f"--{name}")
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--max-files", type=int)
    p.add_argument("--max-bytes", type=int)
    p.add_argument("--budget", type=float, default=1.0)
    p.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    c = config.merged({"repo_root": a.root, "output_dir": a.out, "clock_iso": a.clock, "max_files": a.max_files, "max_bytes": a.max_bytes})
    if a.verb == "status":
        print(json.dumps({"root": c.repo_root, "out": c.output_dir, "version": pipeline.TOOL_VERSION}))
    elif a.verb == "init":
        print(config.create(c.repo_root, c, a.force))
    elif a.verb == "inspect":
        print(json.dumps(pipeline.inspect(c.output_dir)))
    elif a.verb == "verify":
        got = integrity.verify(c.output_dir)
        print(json.dumps(got))
        return 0 if got["hashMatch"] and got["schemaValid"] else 1
    elif a.verb == "snapshot-contracts":
        print(json.dumps(integrity.snapshot_contracts(c.output_dir, Path(__file__).parent, c.clock_iso)))
    elif a.verb == "audit":
        return 0 if 0 < a.budget <= 5 else 1
    elif a.verb in WRITING:
        if a.verb == "self" and not c.clock_iso:
            sys.exit("self needs --clock")
        print(json.dumps(pipeline.run(session(), c.repo_root, c.output_dir, c.clock_iso, c.max_files, c.max_bytes, a.force, a.verb)))
    else:
        report(session(), a, c)
    return 0


def report(spark, a, c) -> None:
    from lithoscope.sources.tree import read_tree

    if a.verb == "health":
        print(Path(c.output_dir, "rc_metrics.json").read_text(encoding="utf-8"))
        return
    if a.verb == "diff":
        show(pipeline.compare(spark, c.output_dir, a.first, a.second))
        return
    tree = pipeline.Analysis(read_tree(spark, c.repo_root))
    if a.verb == "metrics":
        ranks, between, _ = tree.metrics()
        show(ranks.join(between, "id"), "id")
    elif a.verb == "rank":
        for r in tree.rank(a.top).collect():
            print(json.dumps(r.asDict()))
    elif a.verb == "impact" and a.node:
        show(topology.top_by(graph.reach_counts(tree.nodes, tree.in_repo), "total", 10), "id")
    elif a.verb == "impact":
        show(tree.impact(needed(a.target, "target")), "relation", "id")
    elif a.verb == "risk":
        show(tree.risk(needed(a.target, "target")))
    elif a.verb == "focus":
        show(tree.focus(needed(a.target, "target")))
    elif a.verb == "duplicates":
        show(tree.duplicates(), "path_a", "path_b")
    elif a.verb == "delta":
        from pyspark.sql import functions as F

        from lithoscope.schemas import read_artifact

        before = read_artifact(spark, f"{c.output_dir}/snapshots/{needed(a.first, 'first')}/fileIndex.json").select(F.inline("files"))
        for rows in tree.delta(before).values():
            show(rows)
    elif a.verb == "export":
        fmt = needed(a.format, "format")
        export.write_lines(tree.export(fmt), str(Path(c.output_dir, "export", fmt)))


if __name__ == "__main__":
    sys.exit(main())
