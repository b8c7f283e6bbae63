"""Package metadata, compiler options and manifests, from captured text or a bounded process."""

from __future__ import annotations

import json
import re
import subprocess
import tomllib

from pyspark.sql import DataFrame, SparkSession

TIMEOUT, LIMIT = 120, 64 << 20
#: Target kinds in order of precedence.
KINDS = {"custom-build": "build-script", "test": "test", "bench": "bench", "example": "example", "bin": "bin"}
LIBRARIES = {"lib", "rlib", "dylib", "cdylib", "staticlib", "proc-macro"}
PACKAGES = "id string, name string, manifest_path string, features array<string>, member boolean"
TARGETS = "package_id string, name string, kind string, source_path string, edition string, crate_types array<string>, required_features array<string>"


class ProcessError(RuntimeError):
    pass


def run(command: list[str], purpose: str, timeout: float = TIMEOUT, limit: int = LIMIT) -> str:
    """A process's standard output; too long, too much, or a failure raises."""
    try:
        done = subprocess.run(command, capture_output=True, timeout=timeout, start_new_session=True)
    except subprocess.TimeoutExpired as e:
        raise ProcessError(f"{purpose}: no end after {timeout:g} s") from e
    except OSError as e:
        raise ProcessError(f"{purpose}: {e}") from e
    if max(len(done.stdout), len(done.stderr)) > limit:
        raise ProcessError(f"{purpose}: more than {limit} bytes of output")
    if done.returncode:
        raise ProcessError(f"{purpose}: exit code {done.returncode}: {done.stderr[-500:].decode(errors='replace')}")
    return done.stdout.decode()


def metadata_document(output: str) -> dict:
    """The first line that begins with a brace."""
    for line in output.splitlines():
        if line.startswith("{"):
            return json.loads(line)
    raise ProcessError("no metadata document")


def target_kind(kinds: list[str]) -> str | None:
    for k, name in KINDS.items():
        if k in kinds:
            return name
    return "lib" if LIBRARIES & set(kinds) else None


def packages_and_targets(spark: SparkSession, document: dict) -> tuple[DataFrame, DataFrame]:
    members = set(document.get("workspace_members", ()))
    packages = [(p["id"], p["name"], p["manifest_path"], sorted(p.get("features", {})), p["id"] in members) for p in document["packages"]]
    targets = [
        (p["id"], t["name"], kind, t["src_path"], t.get("edition", "2015"), sorted(t.get("crate_types", ())), sorted(t.get("required-features", ())))
        for p in document["packages"]
        for t in p.get("targets", ())
        if (kind := target_kind(t["kind"]))
    ]
    return spark.createDataFrame(packages, PACKAGES), spark.createDataFrame(targets, TARGETS)


def cfg_options(output: str) -> list[tuple[str, str | None]]:
    """(name, value) of each line ``name`` or ``name="value"``."""
    out = set()
    for line in filter(None, map(str.strip, output.splitlines())):
        name, eq, value = line.partition("=")
        out.add((name, json.loads(value) if eq else None))
    return sorted(out, key=lambda x: (x[0], x[1] or ""))


def host_of(output: str) -> str:
    if m := re.search(r"^host: (\S+)$", output, re.M):
        return m[1]
    raise ProcessError("no host line")


def closure(features: dict[str, list[str]], wanted: set[str], default: bool = True) -> set[str]:
    """The features that ``wanted`` enables within one package, through its own feature table."""
    seen: set[str] = set()
    todo = sorted(wanted | ({"default"} if default and "default" in features else set()))
    while todo:
        f = todo.pop()
        if f in features and f not in seen:
            seen.add(f)
            todo += [x for x in features[f] if "/" not in x and not x.startswith("dep:")]
    return seen


def manifest_flags(manifest: str, kind: str, name: str) -> dict[str, bool]:
    """test, bench and harness of a target as its manifest has them, with Cargo's defaults."""
    doc = tomllib.loads(manifest)
    table = doc.get("lib", {}) if kind == "lib" else next((t for t in doc.get(kind, ()) if t.get("name") == name), {})
    return {"test": table.get("test", kind in ("lib", "bin", "test")), "bench": table.get("bench", kind in ("lib", "bin", "bench")), "harness": table.get("harness", True)}


def resolver_of(root_manifest: str) -> int | None:
    """The workspace's own resolver, if it names one."""
    got = tomllib.loads(root_manifest).get("workspace", {}).get("resolver")
    return None if got is None else int(got)
