"""Projects, packages and targets that a request selects, from what the build tool says of them."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, replace

from linefacts.operators.selection import glob_pattern
from linefacts.plans.request import Selection
from linefacts.sources import cargo
from linefacts.sources.tree import manifests

#: The option that asks for all targets of a kind.
PLURAL = {"lib": "lib", "bin": "bins", "example": "examples", "test": "tests", "bench": "benches", "build-script": "build-script"}
ORDER = ("lib", "bin", "example", "test", "bench", "build-script")
CONTEXTS = ("production", "test", "bench")


class SelectionError(ValueError):
    """A request that names what isn't there."""


@dataclass(frozen=True)
class Target:
    name: str
    kind: str
    path: str
    edition: str
    crate_types: tuple[str, ...]
    required: frozenset[str]
    contexts: tuple[str, ...]
    harness: bool

    @property
    def selector(self) -> str:
        return f"{self.kind}:{self.name}"

    @property
    def crate_type(self) -> str:
        return "bin" if self.kind == "build-script" else (self.crate_types or ("lib",))[0]


@dataclass(frozen=True)
class Package:
    id: str
    name: str
    manifest: str
    features: dict[str, list[str]] = field(hash=False)
    targets: tuple[Target, ...] = ()

    @property
    def folder(self) -> str:
        return os.path.dirname(self.manifest)


@dataclass(frozen=True)
class Project:
    root: str
    manifest: str
    document: dict = field(hash=False)
    edition: str | None
    packages: tuple[Package, ...]


@dataclass(frozen=True)
class Inventory:
    projects: tuple[Project, ...]
    unselected: tuple[str, ...]
    warnings: tuple[tuple[str, str], ...]


def below(path: str, root: str) -> bool:
    return path == root or path.startswith(root.rstrip("/") + "/")


def loaded(root: str, tool) -> dict[str, tuple[str, dict]]:
    """(manifest, metadata) of each workspace that a manifest below the root leads to, by its root; each is asked for once."""
    projects: dict[str, tuple[str, dict]] = {}
    known: set[str] = set()
    for manifest in (os.path.realpath(os.path.join(root, m)) for m in manifests(root)):
        if manifest in known:
            continue
        doc = tool.metadata(manifest)
        top = os.path.realpath(doc.get("workspace_root") or os.path.dirname(manifest))
        if top in projects:
            continue
        own = os.path.join(top, "Cargo.toml")
        doc = doc if own == manifest else tool.metadata(own)
        members = set(doc.get("workspace_members", ()))
        known |= {os.path.realpath(p["manifest_path"]) for p in doc["packages"] if p["id"] in members} | {manifest}
        projects[top] = own, doc
    return dict(sorted(projects.items()))


def members_of(doc: dict, root: str) -> list[dict]:
    """Workspace members whose manifests lie below the root."""
    members = set(doc.get("workspace_members", ()))
    return [p for p in doc["packages"] if p["id"] in members and below(os.path.realpath(p["manifest_path"]), root)]


def resolved(projects: dict, specs: tuple[str, ...], eligible: set[str], tool) -> set[str]:
    """Ids that selectors name in any project; a selector that names nothing eligible raises."""
    out: set[str] = set()
    for spec in specs:
        found = {i for manifest, doc in projects.values() if (i := tool.package_id(manifest, spec, doc["packages"])) in eligible and i}
        if not found:
            raise SelectionError(f"package selector `{spec}` matches no package of a workspace below the root")
        out |= found
    return out


def selected_ids(projects: dict, s: Selection, root: str, tool) -> set[str]:
    """Every eligible package, or those that are named, or both with ``--workspace``; less exclusions."""
    eligible = {p["id"] for _, doc in projects.values() for p in members_of(doc, root)}
    out = set(eligible) if s.workspace or not s.packages else set()
    out |= resolved(projects, s.packages, eligible, tool)
    return out - resolved(projects, s.excluded, eligible, tool) if s.workspace and s.excluded else out


def names(selector: str, kind: str, name: str) -> bool:
    """Whether ``kind:glob`` names a target. One grammar of globs for options and queries."""
    k, colon, pattern = selector.partition(":")
    return bool(colon) and k == kind and re.match(glob_pattern(pattern), name) is not None


def flags_of(manifest: dict, kind: str, target: dict) -> tuple[bool, bool, bool]:
    """(test, bench, harness) as the manifest has them; the tool's own ``test`` where it says nothing of the target."""
    table = manifest.get("lib") if kind == "lib" else next((t for t in manifest.get(kind, ()) if t.get("name") == target["name"]), None)
    table = {} if table is None else table
    test = table.get("test", target.get("test", kind in ("lib", "bin", "test")))
    return test, table.get("bench", kind in ("lib", "bin", "bench")), table.get("harness", True)


def contexts_asked(s: Selection, kind: str, name: str, test: bool, bench: bool) -> tuple[set[str], set[str]]:
    """(contexts in which a target takes part, named selectors that it answers)."""
    everything = "all-targets" in s.includes
    named = {x for x in s.includes if names(x, kind, name)}
    built = kind in ("lib", "bin", "example")
    out = set()
    if kind not in ("test", "bench") and (everything or named or PLURAL[kind] in s.includes):
        out.add("production")
    for word, own, enabled in (("test", "tests", test), ("bench", "benches", bench)):
        asked = everything or own in s.includes
        if kind == word and (named or asked) or asked and built and enabled:
            out.add(word)
    return out, named


def less(contexts: set[str], excludes: tuple[str, ...], kind: str, name: str) -> tuple[set[str], set[str]]:
    """(contexts that exclusions leave, exclusions that took something)."""
    left, used = set(contexts), set()
    for x in excludes:
        if x in ("test", "bench") and x in left:
            left.remove(x)
            used.add(x)
        elif x == kind and kind not in ("test", "bench") or names(x, kind, name):
            left.clear()
            used.add(x)
    return left, used


def targets_of(package: dict, s: Selection) -> tuple[list[Target], set[str], set[str]]:
    """(selected targets, named selectors that matched, exclusions that matched) of one package."""
    try:
        with open(package["manifest_path"], "rb") as f:
            manifest = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise SelectionError(f"manifest {package['manifest_path']}: {e}") from e
    out, seen, used = [], set(), set()
    for t in package.get("targets", ()):
        kind = cargo.target_kind(t["kind"])
        if kind is None:
            continue
        test, bench, harness = flags_of(manifest, kind, t)
        asked, named = contexts_asked(s, kind, t["name"], test, bench)
        if not asked:
            continue
        seen |= named
        left, gone = less(asked, s.excludes, kind, t["name"])
        used |= gone
        if left:
            contexts = tuple(c for c in CONTEXTS if c in left)
            out.append(Target(t["name"], kind, t["src_path"], t.get("edition", "2015"), tuple(t.get("crate_types", ())), frozenset(t.get("required-features", ())), contexts, harness))
    return sorted(out, key=lambda t: (ORDER.index(t.kind), t.name, t.path)), seen, used


def discover(s: Selection, tool) -> Inventory:
    """What a request selects. Members that aren't selected, and path packages that are no members, bound what others own."""
    root = os.path.realpath(s.root)
    projects = loaded(root, tool)
    chosen = selected_ids(projects, s, root, tool)
    out, unselected, seen, used = [], set(), set(), set()
    for top, (manifest, doc) in projects.items():
        members, packages = set(doc.get("workspace_members", ())), []
        for p in doc["packages"]:
            at = os.path.realpath(p["manifest_path"])
            if not below(at, root):
                continue
            if p["id"] not in members or p["id"] not in chosen:
                unselected.add(os.path.dirname(at))
                continue
            targets, found, gone = targets_of(p, s)
            seen |= found
            used |= gone
            packages.append(Package(p["id"], p["name"], at, p.get("features", {}), tuple(targets)))
        if packages:
            edition = next((p.get("edition") for p in doc["packages"] if os.path.realpath(p["manifest_path"]) == manifest), None)
            out.append(Project(top, manifest, doc, edition, tuple(sorted(packages, key=lambda p: (p.name, p.manifest, p.id)))))
    for x in s.includes:
        if ":" in x and x not in seen:
            raise SelectionError(f"target selector `{x}` matches nothing")
    warnings = [("unmatched-target-exclusion", f"target exclusion `{x}` matched nothing") for x in s.excludes if x not in used]
    return Inventory(tuple(out), tuple(sorted(unselected)), tuple(sorted(warnings)))


def without_targets(p: Package) -> Package:
    return replace(p, targets=())
