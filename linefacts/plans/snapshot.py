"""Cached results: one file a key, written whole or not at all, checked before use."""

from __future__ import annotations

import hashlib
import json
import os
import resource
import shutil
import tempfile
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from linefacts.operators.incremental import POLICY
from linefacts.plans.request import Selection
from linefacts.sources.toolchain import config_files
from linefacts.sources.tree import STRUCTURAL


class UnstableInputs(RuntimeError):
    """Inputs changed while they were counted, twice."""


def digest(*parts: str) -> str:
    h = hashlib.sha256()
    for p in parts:
        raw = p.encode("utf-8", "surrogateescape")
        h.update(len(raw).to_bytes(8, "little") + raw)
    return h.hexdigest()


def stamps(root: str, own: str | None = None) -> dict[str, tuple[int, int, int]]:
    """(size, mtime, inode) of every file below a root, ignored ones too; excluded directories and the snapshots' ``own`` folder aside."""
    out, own = {}, own and os.path.abspath(own)
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if n not in STRUCTURAL and os.path.abspath(os.path.join(folder, n)) != own)
        for f in files:
            p = os.path.join(folder, f)
            s = os.lstat(p)
            out[os.path.relpath(p, root)] = (s.st_size, s.st_mtime_ns, s.st_ino)
    return out


#: Files that say how a tree is built, by name or suffix, and where targets are found by place.
PREPARATION = {"Cargo.toml", "Cargo.lock", "config", "config.toml", ".gitignore", ".ignore", "rust-toolchain", "rust-toolchain.toml"}
PLACES = ("src/bin", "examples", "tests", "benches")
MAIN = ("src/lib.rs", "src/main.rs", "build.rs")
VARIABLES = ("CARGO", "RUSTC", "RUSTFLAGS", "CARGO_ENCODED_RUSTFLAGS", "CARGO_BUILD_RUSTFLAGS", "CARGO_BUILD_TARGET", "CARGO_BUILD_RUSTC", "CARGO_HOME", "RUSTUP_TOOLCHAIN")


def content(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def surroundings(selection: Selection, root: str) -> list[str]:
    """What counts besides the tree: environment, configuration above it, files named as targets, and which toolchain there is."""
    out = [f"{k}={os.environ[k]}" for k in VARIABLES if k in os.environ]
    out += [f"{k}={v}" for k, v in sorted(os.environ.items()) if k.startswith("CARGO_TARGET_") and k.endswith("_RUSTFLAGS")]
    for path in [*config_files(os.path.dirname(os.path.realpath(root))), *(t for t in selection.targets if t.endswith(".json") and os.path.isfile(t))]:
        out += [path, content(path)]
    for name in ("cargo", "rustc"):
        at = os.environ.get(name.upper()) or shutil.which(name)
        if at and os.path.exists(at):
            s = os.stat(at)
            out.append(f"{os.path.realpath(at)} {s.st_size} {s.st_mtime_ns}")
    return out


def fingerprint(selection: Selection, root: str, known: dict[str, tuple[tuple, str]] | None = None, own: str | None = None) -> tuple[str, dict[str, tuple[tuple, str]]]:
    """(digest of the request, surroundings and files, manifest): contents whose stamp is known aren't read again."""
    manifest = {}
    for path, stamp in sorted(stamps(root, own).items()):
        had = (known or {}).get(path)
        full = os.path.join(root, path)
        if had and had[0] == stamp:
            manifest[path] = had
        elif os.path.islink(full):
            manifest[path] = (stamp, digest(os.readlink(full), content(full) if os.path.isfile(full) else ""))
        else:
            manifest[path] = (stamp, content(full))
    return digest(POLICY, json.dumps(asdict(selection)), *surroundings(selection, root), *(x for p, (_, d) in manifest.items() for x in (p, d))), manifest


def preparation_fingerprint(selection: Selection, root: str, manifest: dict[str, tuple[tuple, str]]) -> str:
    """Digest of what packages, targets and contexts depend on: build files with their contents, and the names, not the contents, of sources that are targets by their place."""
    parts = []
    folders = {os.path.dirname(p) for p in manifest if os.path.basename(p) == "Cargo.toml"}
    for path, (_, d) in manifest.items():
        if os.path.basename(path) in PREPARATION or path.endswith(".json"):
            parts += [path, d]
        elif path.endswith(".rs") and any(below(path, f) for f in folders):
            parts.append(path)
    return digest("preparation", POLICY, json.dumps(asdict(selection)), *surroundings(selection, root), *parts)


def below(path: str, folder: str) -> bool:
    """Whether a source is a target by its place in a package's folder."""
    inside = os.path.relpath(path, folder or ".")
    return inside in MAIN or any(inside.startswith(p + "/") for p in PLACES)


class Preparation:
    """The toolchain's answers, kept while the preparation fingerprint stays: a change of sources alone starts no process."""

    def __init__(self, folder: str | None = None):
        self.folder, self.key, self.kept = folder, None, []

    def recall(self, key: str, tool) -> bool:
        """Gives earlier answers back to a tool, from memory or from the folder."""
        if key != self.key:
            text = load(self.folder, key) if self.folder else None
            if text is None:
                return False
            self.key, self.kept = key, json.loads(text)
        tool.remember(self.kept)
        return True

    def keep(self, key: str, tool) -> None:
        self.key, self.kept = key, tool.answers()
        if self.folder:
            store(self.folder, key, json.dumps(self.kept))


def store(folder: str, key: str, output: str) -> str:
    """Writes a record beside its place and renames it."""
    os.makedirs(folder, exist_ok=True)
    record = {"policy": POLICY, "key": key, "output": output, "check": digest(POLICY, key, output)}
    fd, tmp = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w") as f:
        json.dump(record, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path := os.path.join(folder, f"{key}.json"))
    return path


def load(folder: str, key: str) -> str | None:
    """The output stored under a key; None if there is none or it isn't whole."""
    try:
        with open(os.path.join(folder, f"{key}.json")) as f:
            r = json.load(f)
    except (OSError, ValueError):
        return None
    whole = isinstance(r, dict) and r.get("policy") == POLICY and r.get("key") == key and isinstance(r.get("output"), str) and r.get("check") == digest(POLICY, key, r["output"])
    return r["output"] if whole else None


def replace_folder(fresh: str, at: str) -> None:
    """Puts a folder in another's place."""
    old = f"{at}-old-{os.getpid()}"
    if os.path.isdir(at):
        os.replace(at, old)
    os.replace(fresh, at)
    shutil.rmtree(old, ignore_errors=True)


@dataclass
class Metrics:
    """Seconds by phase, how caches did, and the most memory of this process in KB."""

    seconds: dict[str, float] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    peak: int = 0

    def timed(self, phase: str, f: Callable):
        began = time.perf_counter()
        try:
            return f()
        finally:
            self.seconds[phase] = self.seconds.get(phase, 0.0) + time.perf_counter() - began
            self.peak = max(self.peak, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)

    def add(self, what: str) -> None:
        self.counts[what] = self.counts.get(what, 0) + 1


class Session:
    """Counts again only what changed requires: equal inputs give the stored output."""

    def __init__(self, selection: Selection, count: Callable[[], str], folder: str | None = None):
        self.selection, self.count, self.folder = selection, count, folder
        self.manifest: dict = {}
        self.key = self.output = None
        self.metrics = Metrics()

    def _now(self) -> str:
        key, self.manifest = self.metrics.timed("fingerprint", lambda: fingerprint(self.selection, self.selection.root, self.manifest, self.folder))
        return key

    def refresh(self) -> str:
        for _ in range(2):
            key = self._now()
            if key == self.key:
                self.metrics.add("resident")
                return self.output
            if self.folder and (got := load(self.folder, key)) is not None and self._now() == key:
                self.metrics.add("stored")
                self.key, self.output = key, got
                return got
            out = self.metrics.timed("count", self.count)
            if self._now() == key:
                self.metrics.add("counted")
                self.key, self.output = key, out
                if self.folder:
                    store(self.folder, key, out)
                return out
        raise UnstableInputs(self.selection.root)
