"""A normalised request: packages, features, targets, and what to print."""

from __future__ import annotations

import argparse
import re
from dataclasses import dataclass

# Kinds of targets in their order, and the option that includes each.
KINDS = ("lib", "bin", "example", "test", "bench", "build-script")


class UsageError(ValueError):
    """A request that can't be understood; exit code 2."""


@dataclass(frozen=True)
class Selection:
    root: str = "."
    packages: tuple[str, ...] = ()
    workspace: bool = False
    excluded: tuple[str, ...] = ()
    root_files: bool = True
    all_features: bool = True
    no_default_features: bool = False
    features: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    includes: tuple[str, ...] = ("all-targets",)
    excludes: tuple[str, ...] = ()
    json: bool = False
    totals: bool = False


def split_features(lists: list[str]) -> tuple[str, ...]:
    return tuple(sorted({f for x in lists for f in re.split(r"[, \t\n\r]", x) if f}))


def exclusion(selector: str) -> str:
    """``kind`` or ``kind:name``; build scripts have no name."""
    kind, colon, name = selector.partition(":")
    if kind not in KINDS or colon and (not name or ":" in name) or kind == "build-script" and colon:
        raise UsageError(f"not a target selector: {selector}")
    return selector


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linefacts", description="Lines of code of a source tree by scope and language. By default all packages, features and targets count, and files that no package owns.")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("-p", "--package", action="append", default=[])
    p.add_argument("--workspace", action="store_true")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--root-files", choices=("include", "exclude"), default="include")
    p.add_argument("-F", "--features", action="append")
    p.add_argument("--all-features", action="store_true")
    p.add_argument("--no-default-features", action="store_true")
    p.add_argument("--target", action="append", default=[])
    p.add_argument("--all-targets", action="store_true")
    for kind in ("bin", "example", "test", "bench"):
        p.add_argument(f"--{kind}", action="append", default=[])
        p.add_argument(f"--{kind}s" if kind != "bench" else "--benches", action="store_true", dest=f"all_{kind}")
    p.add_argument("--lib", action="store_true")
    p.add_argument("--exclude-target", action="append", default=[])
    form = p.add_mutually_exclusive_group()
    form.add_argument("--json", action="store_true")
    form.add_argument("--totals", action="store_true")
    p.add_argument("--metadata", help="a capture of what the build tool and the compiler say, instead of asking them")
    p.add_argument("--cache", help="a folder for snapshots of reports, preparations and results")
    p.add_argument("-V", "--version", action="version", version="linefacts 2")
    return p


def selection(a: argparse.Namespace) -> Selection:
    """Lists are sorted sets. No feature option means all features; an empty list is one. A named package leaves the root's own files out."""
    if a.exclude and not a.workspace:
        raise UsageError("--exclude goes with --workspace")
    includes = {"lib"} if a.lib else set()
    for kind in ("bin", "example", "test", "bench"):
        plural = f"{kind}s" if kind != "bench" else "benches"
        includes |= {f"{kind}:{n}" for n in getattr(a, kind)} | ({plural} if getattr(a, f"all_{kind}") else set())
    if a.all_targets or not includes:
        includes.add("all-targets")
    asked = a.features is not None or a.all_features or a.no_default_features
    return Selection(
        a.path,
        tuple(sorted(set(a.package))),
        a.workspace,
        tuple(sorted(set(a.exclude))),
        a.root_files == "include" and not a.package,
        a.all_features or not asked,
        a.no_default_features,
        split_features(a.features or []),
        tuple(sorted(set(a.target))),
        tuple(sorted(includes)),
        tuple(sorted({exclusion(x) for x in a.exclude_target})),
        a.json,
        a.totals,
    )
