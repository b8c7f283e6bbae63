"""What the build tool and the compiler say: metadata, package ids, configuration, host and cfg options.

``Live`` asks processes; ``Captured`` reads a document of answers, so that a
count runs where no toolchain is installed. Answers are remembered by question.
"""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field

from linefacts.sources import cargo
from linefacts.sources.process import ProcessError, run, text_of

Option = tuple[str, str | None]


@dataclass(frozen=True)
class Config:
    """The build configuration that holds for a project: compiler, targets, and whether flags are set that aren't modelled."""

    rustc: str = "rustc"
    targets: tuple[str, ...] = ()
    rustflags: bool = False


def config_files(project: str) -> list[str]:
    """The configuration files above a project, nearest first, and the home's."""
    out, at = [], os.path.realpath(project)
    while True:
        out += [p for n in ("config.toml", "config") if os.path.isfile(p := os.path.join(at, ".cargo", n))]
        if at == os.path.dirname(at):
            break
        at = os.path.dirname(at)
    home = os.environ.get("CARGO_HOME") or os.path.join(os.path.expanduser("~"), ".cargo")
    return out + [p for n in ("config.toml", "config") if os.path.isfile(p := os.path.join(home, n)) and p not in out]


def _flag_line(line: str) -> bool:
    key, eq, _ = line.partition("#")[0].partition("=")
    return bool(eq) and key.strip().strip("'\"") == "rustflags"


def load_config(project: str, environment: dict[str, str] | None = None) -> Config:
    """The nearest file that says something wins; the environment wins over files.

    Flags count as set by the environment, or by a line ``rustflags = ...``
    anywhere in a configuration file, whatever table it is in.
    """
    env = os.environ if environment is None else environment
    rustc = targets = None
    flags = any(v and (k in ("RUSTFLAGS", "CARGO_ENCODED_RUSTFLAGS", "CARGO_BUILD_RUSTFLAGS") or k.startswith("CARGO_TARGET_") and k.endswith("_RUSTFLAGS")) for k, v in env.items())
    for path in config_files(project):
        with open(path, encoding="utf-8", errors="replace") as f:
            text = f.read()
        try:
            build = tomllib.loads(text).get("build", {})
        except tomllib.TOMLDecodeError as e:
            raise ProcessError(f"configuration {path}: {e}") from e
        flags = flags or any(map(_flag_line, text.splitlines()))
        rustc = rustc or build.get("rustc")
        if targets is None and "target" in build:
            targets = build["target"] if isinstance(build["target"], list) else [build["target"]]
    if env.get("CARGO_BUILD_TARGET"):
        targets = [env["CARGO_BUILD_TARGET"]]
    beside = os.path.join(os.path.dirname(env["CARGO"]), "rustc") if env.get("CARGO") else ""
    default = beside if beside and os.path.isfile(beside) else "rustc"
    return Config(env.get("RUSTC") or env.get("CARGO_BUILD_RUSTC") or rustc or default, tuple(targets or ()), flags)


# What the parts of a target triple say of the platform.
WIDTHS = {"x86_64": "64", "aarch64": "64", "riscv64gc": "64", "powerpc64le": "64", "s390x": "64", "i686": "32", "i586": "32", "armv7": "32", "arm": "32", "wasm32": "32", "thumbv7em": "32"}
ARCHES = {"i686": "x86", "i586": "x86", "armv7": "arm", "thumbv7em": "arm", "riscv64gc": "riscv64", "powerpc64le": "powerpc64"}
UNIX = ("linux", "macos", "ios", "freebsd", "netbsd", "openbsd", "dragonfly", "android", "illumos", "solaris")


def options_of_triple(triple: str) -> set[Option]:
    """The platform's options as far as a triple tells them; for captures that lack a compiler's answer."""
    parts = triple.split("-")
    arch, rest = parts[0], parts[1:]
    system = next((s for s in (*UNIX, "windows", "wasi", "unknown", "none") if s in rest), "macos" if "darwin" in rest else "none")
    out: set[Option] = {("debug_assertions", None), ("panic", "unwind"), ("target_arch", ARCHES.get(arch, arch)), ("target_endian", "big" if arch == "s390x" else "little"), ("target_os", system), ("target_pointer_width", WIDTHS.get(arch, "64")), ("target_vendor", rest[0] if rest else "unknown"), ("target_env", rest[-1] if rest and rest[-1] in ("gnu", "musl", "msvc") else "")}
    family = "unix" if system in UNIX else "windows" if system == "windows" else "wasm" if arch.startswith("wasm") else None
    if family:
        out |= {("target_family", family)} | ({(family, None)} if family != "wasm" else set())
    return out


def spec_matches(spec: str, package: dict) -> bool:
    """A package id specification: the id, a name, ``name@version``, or a URL with either behind ``#``."""
    name, version = package["name"], package.get("version", "")
    known = {package["id"], name, f"{name}@{version}", f"{name}:{version}"}
    url = re.sub(r"^[a-z]+\+", "", package["id"]).partition("#")[0]
    return spec in known or spec.startswith(url + "#") and spec.partition("#")[2] in {name, version, f"{name}@{version}"} or spec == url


@dataclass
class Live:
    """Answers of processes."""

    environment: dict[str, str] | None = None
    asked: dict = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)

    def _once(self, kind: str, key: tuple, answer):
        if (kind, key) not in self.asked:
            self.counts[kind] = self.counts.get(kind, 0) + 1
            self.asked[kind, key] = answer()
        return self.asked[kind, key]

    def _cargo(self) -> str:
        return (self.environment or os.environ).get("CARGO") or "cargo"

    def metadata(self, manifest: str) -> dict:
        purpose = f"metadata of {manifest}"
        command = [self._cargo(), "metadata", "--all-features", "--format-version", "1", "--manifest-path", manifest]
        return self._once("metadata", (manifest,), lambda: cargo.metadata_document(text_of(run(command, purpose, cwd=os.path.dirname(manifest)), purpose)))

    def package_id(self, manifest: str, spec: str, packages: list[dict]) -> str | None:
        """The id that a specification names; None if it names nothing there. Every other failure raises."""
        purpose = f"package selector {spec} in {manifest}"

        def ask() -> str | None:
            done = run([self._cargo(), "pkgid", "--manifest-path", manifest, spec], purpose, cwd=os.path.dirname(manifest))
            none = done.code and "package ID specification" in done.complaint and "did not match any packages" in done.complaint
            return None if none else text_of(done, purpose).strip()

        return self._once("pkgid", (manifest, spec), ask)

    def config(self, project: str) -> Config:
        return load_config(project, self.environment)

    def host(self, project: str) -> str:
        rustc = self.config(project).rustc
        purpose = f"host of {rustc}"
        return self._once("host", (project, rustc), lambda: cargo.host_of(text_of(run([rustc, "-vV"], purpose, cwd=project), purpose)))

    def options(self, project: str, triple: str, crate_type: str) -> set[Option]:
        rustc = self.config(project).rustc
        purpose = f"cfg of {triple}, {crate_type}"
        command = [rustc, "--print", "cfg", "--crate-type", crate_type, "--target", triple]
        return self._once("cfg", (project, triple, crate_type), lambda: set(cargo.cfg_options(text_of(run(command, purpose, cwd=project), purpose))))


    def answers(self) -> list:
        """All answers so far, as JSON can hold them."""
        return [[kind, list(key), sorted(map(list, a), key=str) if isinstance(a, set) else a] for (kind, key), a in self.asked.items()]

    def remember(self, answers: list) -> None:
        self.asked |= {(kind, tuple(key)): {tuple(x) for x in a} if kind == "cfg" else a for kind, key, a in answers}


class Captured(Live):
    """Answers from a document: a metadata document itself, or ``{"metadata": {manifest: document}, "host": triple, "cfg": {triple: text}}``."""

    def __init__(self, document: dict, environment: dict[str, str] | None = None):
        super().__init__({} if environment is None else environment)
        one = "packages" in document
        self.documents: dict | None = None if one else document.get("metadata", {})
        self.only = document if one else None
        self.host_triple = document.get("host", "x86_64-unknown-linux-gnu")
        self.texts: dict[str, str] = document.get("cfg", {})

    def metadata(self, manifest: str) -> dict:
        self.counts["metadata"] = self.counts.get("metadata", 0) + 1
        if self.only is not None:
            return self.only
        if manifest not in self.documents:
            raise ProcessError(f"no captured metadata of {manifest}")
        return self.documents[manifest]

    def package_id(self, manifest: str, spec: str, packages: list[dict]) -> str | None:
        found = [p["id"] for p in packages if spec_matches(spec, p)]
        if len(found) > 1:
            raise ProcessError(f"package selector {spec} in {manifest} is ambiguous: {', '.join(sorted(found))}")
        return found[0] if found else None

    def host(self, project: str) -> str:
        return self.host_triple

    def options(self, project: str, triple: str, crate_type: str) -> set[Option]:
        text = self.texts.get(f"{triple} {crate_type}", self.texts.get(triple))
        return self._once("cfg", (project, triple, crate_type), lambda: options_of_triple(triple) if text is None else set(cargo.cfg_options(text)))


def captured(text: str) -> Captured:
    """From the text of a capture; lines before the document are skipped."""
    try:
        return Captured(json.loads(text))
    except ValueError:
        return Captured(cargo.metadata_document(text))
