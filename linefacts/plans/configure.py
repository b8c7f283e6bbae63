"""Build contexts of the selected targets: role, provenance, features and options of each."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, replace

from linefacts.plans import features
from linefacts.plans.discover import Inventory, Package, Project, SelectionError, names
from linefacts.plans.request import Selection
from linefacts.sources.process import ProcessError
from linefacts.sources.toolchain import Option

# Option names that the compiler knows on every platform, and its operating systems.
KNOWN_NAMES = (
    "debug_assertions", "doc", "doctest", "feature", "overflow_checks", "panic", "proc_macro", "relocation_model", "sanitize", "target_abi", "target_arch", "target_endian", "target_env",
    "target_family", "target_feature", "target_has_atomic", "target_has_atomic_equal_alignment", "target_has_atomic_load_store", "target_os", "target_pointer_width", "target_thread_local",
    "target_vendor", "test", "ub_checks", "unix", "windows",
)
KNOWN_SYSTEMS = (
    "aix", "android", "bitrig", "darwin", "dragonfly", "emscripten", "espidf", "freebsd", "fuchsia", "haiku", "hermit", "horizon", "hurd", "illumos", "ios", "l4re", "linux", "macos", "netbsd", "none",
    "nto", "openbsd", "psp", "redox", "solaris", "solid_asp3", "teeos", "trusty", "tvos", "uefi", "unknown", "visionos", "vxworks", "wasi", "watchos", "windows", "xous",
)


@dataclass(frozen=True, order=True)
class BuildContext:
    target: str
    kind: str
    role: str
    provenance: str
    triple: str
    crate_type: str
    edition: str
    path: str
    features: tuple[str, ...]
    options: tuple[tuple[str, str], ...]  # a name alone has the value ""; no option has an empty value and no name
    bare: tuple[str, ...]
    harness: bool

    def semantic(self) -> tuple:
        """What results depend on: targets that agree on it are evaluated once."""
        return self.edition, self.options, self.bare, self.provenance, self.harness


@dataclass(frozen=True)
class ConfiguredPackage:
    package: Package
    contexts: tuple[BuildContext, ...]
    names: frozenset[str]
    pairs: frozenset[tuple[str, str]]


@dataclass(frozen=True)
class ConfiguredProject:
    project: Project
    host: str
    targets: tuple[str, ...]
    packages: tuple[ConfiguredPackage, ...]


@dataclass(frozen=True)
class Configured:
    projects: tuple[ConfiguredProject, ...]
    unselected: tuple[str, ...]
    warnings: tuple[tuple[str, str], ...]


def known_names(active: set[Option]) -> frozenset[str]:
    return frozenset(KNOWN_NAMES) | {n for n, _ in active}


def known_pairs(active: set[Option]) -> frozenset[tuple[str, str]]:
    return frozenset((n, v) for n, v in active if v is not None) | {("target_os", s) for s in KNOWN_SYSTEMS}


def resolver_of(project: Project) -> int:
    """The workspace's own resolver, else by the root package's edition; a workspace without root package has the first."""
    try:
        with open(project.manifest, "rb") as f:
            told = tomllib.load(f).get("workspace", {}).get("resolver")
    except FileNotFoundError:
        told = None
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise SelectionError(f"manifest {project.manifest}: {e}") from e
    return int(told) if told is not None else {"2024": 3, "2021": 2}.get(project.edition, 1)


def wanted_features(s: Selection, project: Project) -> tuple[dict[str, set[str]], set[str]]:
    """(features asked of each package, requests that some package answers)."""
    out: dict[str, set[str]] = {}
    matched = set()
    for p in project.packages:
        out[p.id] = set(p.features) if s.all_features else set() if s.no_default_features else {"default"} & set(p.features)
        for request in s.features:
            of, slash, f = request.rpartition("/")
            if (not slash or of == p.name) and f in p.features:
                out[p.id].add(f)
                matched.add(request)
    return out, matched


def roles(kind: str, crate_types: tuple[str, ...], context: str, on_target: set | None, on_host: set | None) -> list[tuple[str, set]]:
    """Where a target is compiled: build scripts for the host with the target's features, macros for the host, the rest for the target; a library that the host needs is there too."""
    if kind == "build-script":
        return [] if on_target is None else [("host", on_target)]
    if "proc-macro" in crate_types:
        return [] if on_host is None else [("host", on_host)]
    out = [] if on_target is None else [("target", on_target)]
    return out + ([("host", on_host)] if kind == "lib" and context == "production" and on_host is not None else [])


def configure_project(s: Selection, project: Project, tool) -> tuple[ConfiguredProject, list[tuple[str, str]], set[str]]:
    config, host = tool.config(project.root), tool.host(project.root)
    triples = tuple(dict.fromkeys(s.targets or config.targets or (host,)))
    resolver, (wanted, matched) = resolver_of(project), wanted_features(s, project)
    needs_dev = any(c != "production" for p in project.packages for t in p.targets for c in t.contexts)
    found: dict[str, set[BuildContext]] = {p.id: set() for p in project.packages}
    universe: dict[str, tuple[set, set]] = {p.id: (set(), set()) for p in project.packages}
    missing: dict[tuple[str, str], set[str]] = {}
    for triple in triples:
        platform = {features.HOST: (host, tool.options(project.root, host, "lib")), features.TARGET: (triple, tool.options(project.root, triple, "lib"))}
        for dev in (False, True) if needs_dev else (False,):
            build = features.resolve(project.document, resolver, dev, wanted, platform)
            for p in project.packages:
                sides = build.features(p.id, features.TARGET), build.features(p.id, features.HOST)
                for t in p.targets:
                    for context in t.contexts:
                        if (context != "production") != dev:
                            continue
                        for role, on in roles(t.kind, t.crate_types, context, *sides):
                            if lacks := t.required - on:
                                if any(names(x, t.kind, t.name) for x in s.includes):
                                    missing.setdefault((p.id, t.selector), set()).update(lacks)
                                continue
                            at = host if role == "host" else triple
                            active = tool.options(project.root, at, t.crate_type)
                            universe[p.id][0].update(known_names(active))
                            universe[p.id][1].update(known_pairs(active))
                            test = context != "production"
                            bare = {n for n, v in active if v is None} | ({"test"} if test and t.harness else set())
                            pairs = {(n, v) for n, v in active if v is not None} | {("feature", f) for f in on}
                            found[p.id].add(BuildContext(t.name, t.kind, role, "test" if test else "production", at, t.crate_type, t.edition, t.path, tuple(sorted(on)), tuple(sorted(pairs)), tuple(sorted(bare)), t.harness))
    packages = []
    for p in project.packages:
        have = {(c.kind, c.target) for c in found[p.id]}
        for t in p.targets:
            if (t.kind, t.name) not in have and (p.id, t.selector) in missing:
                raise SelectionError(f"target `{t.selector}` needs features that aren't enabled: {', '.join(sorted(missing[p.id, t.selector]))}")
        left = tuple(t for t in p.targets if (t.kind, t.name) in have)
        packages.append(ConfiguredPackage(replace(p, targets=left), tuple(sorted(found[p.id])), frozenset(universe[p.id][0]), frozenset(universe[p.id][1])))
    warnings = [("unmodeled-rustflags", f"Project `{project.root}` configures rustflags that may alter cfg values")] if config.rustflags else []
    return ConfiguredProject(project, host, triples, tuple(packages)), warnings, matched


def configure(s: Selection, inventory: Inventory, tool) -> Configured:
    """Contexts of every project; a feature that no selected package declares raises."""
    out, warnings, matched = [], list(inventory.warnings), set()
    owner: dict[str, str] = {}
    for project in inventory.projects:
        done, more, hit = configure_project(s, project, tool)
        for p in done.packages:
            if owner.setdefault(p.package.id, project.root) != project.root:
                raise ProcessError(f"package `{p.package.id}` belongs to both `{owner[p.package.id]}` and `{project.root}`")
        out.append(done)
        warnings += more
        matched |= hit
    for f in s.features:
        if f not in matched:
            raise SelectionError(f"feature `{f}` is declared by no selected package")
    return Configured(tuple(out), inventory.unselected, tuple(sorted(set(warnings))))


def provenance(c: Configured) -> dict:
    """Host and target triples and the feature contexts, as the report tells them."""
    projects = sorted(c.projects, key=lambda p: p.project.root)
    rows = {(p.project.root, q.package.id, q.package.name, x.target, x.kind, x.role, x.provenance, x.triple, x.crate_type, x.features) for p in projects for q in p.packages for x in q.contexts}
    keys = ("project_root", "package_id", "package_name", "target_name", "target_kind", "build_role", "provenance", "compilation_target", "crate_type", "features")
    return {
        "host_targets": sorted({p.host for p in projects}),
        "targets": sorted({t for p in projects for t in p.targets}),
        "project_targets": [{"project_root": p.project.root, "host_target": p.host, "targets": sorted(set(p.targets))} for p in projects],
        "feature_contexts": [dict(zip(keys, (*r[:-1], list(r[-1])))) for r in sorted(rows)],
    }
