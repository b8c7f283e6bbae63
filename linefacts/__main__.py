"""Counts a source tree: python -m linefacts [OPTIONS] [PATH]."""

from __future__ import annotations

import json
import os
import sys

from linefacts.operators.accounting import MEASURES, summed
from linefacts.plans import snapshot
from linefacts.plans.request import Selection, UsageError, parser, selection

#: Fixed value: the environment's folder for snapshots.
CACHE = "LINEFACTS_CACHE"


def prepared(s: Selection, root: str, tool, metrics: snapshot.Metrics):
    """Packages and contexts; None for a tree without packages."""
    from linefacts.plans.configure import configure
    from linefacts.plans.discover import SelectionError, discover
    from linefacts.sources.tree import manifests

    if not manifests(root):
        for what in (*s.packages, *s.features, *(x for x in s.includes if ":" in x)):
            raise SelectionError(f"`{what}` matches nothing: there is no package below the root")
        return None
    inventory = metrics.timed("discover", lambda: discover(s, tool))
    return metrics.timed("configure", lambda: configure(s, inventory, tool))


def counted(spark, s: Selection, tool=None, metrics: snapshot.Metrics | None = None, cache: str | None = None) -> tuple[str, str]:
    """(report, warnings in lines) of a request; JSON holds its warnings itself. ``cache``: where results by content are kept between counts."""
    from pyspark.sql import functions as F

    from linefacts.plans import count, report
    from linefacts.plans.configure import provenance
    from linefacts.sources.toolchain import Live

    metrics, root = metrics or snapshot.Metrics(), os.path.realpath(s.root)
    tool = tool or Live()
    configured = prepared(s, root, tool, metrics)
    at = os.path.join(cache, "results") if cache else None
    old = spark.read.schema(count.RESULT).parquet(at) if at and os.path.isdir(at) else None
    out = metrics.timed("count", lambda: count.counted(spark, root, configured, s.root_files, old))
    if at:  # marked and swept: the next count finds what this one asked for
        fresh = f"{at}-{os.getpid()}"
        out.results.coalesce(1).write.mode("overwrite").parquet(f"file://{os.path.abspath(fresh)}")
        snapshot.replace_folder(fresh, at)
    named = count.scopes_of(spark, root, configured)
    rows = summed(out.facts, "scope", "language", "engine", "precision").join(named, "scope")
    rows = rows.select(F.col("scope").alias("scope_id"), F.col("label").alias("scope"), "name", "project_root", "manifest_path", "language", "engine", "precision", *MEASURES, "test")
    warnings = out.warnings
    if configured is None:
        warnings = sorted(set(warnings) | {("unmatched-target-exclusion", f"target exclusion `{x}` matched nothing") for x in s.excludes})
    told = "".join(f"warning[{code}]: {message}\n" for code, message in warnings)
    if not s.json:
        return metrics.timed("report", lambda: report.totals(rows) if s.totals else report.table(rows)), told
    configuration = {"package_selectors": s.packages, "workspace": s.workspace, "package_exclude_selectors": s.excluded, "root_files": "include" if s.root_files else "exclude"}
    configuration |= provenance(configured) if configured else {"host_targets": [], "targets": [], "project_targets": [], "feature_contexts": []}
    configuration |= {"all_features": s.all_features, "no_default_features": s.no_default_features, "features": s.features, "target_includes": s.includes, "target_excludes": s.excludes, "requested_targets": s.targets}
    return metrics.timed("report", lambda: report.document(rows, root, configuration, warnings)), ""


class Resident:
    """Counts a request again and again: equal inputs give the stored report, a change of sources alone keeps packages, contexts and results of unchanged files."""

    def __init__(self, s: Selection, spark, tool, folder: str | None = None):
        self.s, self.spark, self.tool, self.folder = s, spark, tool, folder
        self.preparation = snapshot.Preparation(folder)
        self.session = snapshot.Session(s, self._count, folder)

    @property
    def metrics(self) -> snapshot.Metrics:
        return self.session.metrics

    def _count(self) -> str:
        key = snapshot.preparation_fingerprint(self.s, os.path.realpath(self.s.root), self.session.manifest)
        tool = self.tool()
        self.metrics.add("prepared" if self.preparation.recall(key, tool) else "unprepared")
        out = counted(self.spark(), self.s, tool, self.metrics, self.folder)
        self.preparation.keep(key, tool)
        return json.dumps(out)

    def refresh(self) -> tuple[str, str]:
        out, told = json.loads(self.session.refresh())
        return out, told


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("linefacts").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    args = parser().parse_args(argv[1:] if argv[:1] == ["sloc"] else argv)
    try:
        s = selection(args)
    except UsageError as e:
        print(f"linefacts: {e}", file=sys.stderr)
        return 2
    try:
        from linefacts.sources import toolchain

        if args.metadata:
            with open(args.metadata) as f:
                text = f.read()
            tool = lambda: toolchain.captured(text)
        else:
            tool = toolchain.Live
        folder = args.cache or os.environ.get(CACHE)
        out, told = Resident(s, session, tool, folder).refresh() if folder else counted(session(), s, tool())
    except Exception as e:  # nothing is printed of a count that failed
        print(f"linefacts: {e}", file=sys.stderr)
        return 1
    sys.stderr.write(told)
    sys.stdout.write(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
