"""A source tree as a Spark data source, with ignore files honoured.

One sorted walk on the driver lists paths (ignore rules depend on the
directories above); executors read the bytes, but only the first of a file that
has no extension, no known name and no interpreter line. Ignored files with the suffix in
``KEPT`` are listed too, and marked: modules may lead to them. What can't be
read or identified, or leads out of the root, has no bytes but a ``problem``. Directories named in STRUCTURAL
are pruned below the root; dot-files are visible; symlinked directories aren't
followed; empty files are files. The tree must be reachable from every
executor, as any file path.

    spark.dataSource.register(TreeSource)
    spark.read.format("tree").load(root)
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linefacts.functions.languages import SPECIAL_NAMES

# Directories that are never part of a source tree.
STRUCTURAL = {"target", ".git", ".hg", ".svn", ".linefacts"}
#: Files that are listed although they are ignored.
KEPT = ".rs"
IGNORE_FILES = (".gitignore", ".ignore")
#: Fixed value: bytes that are read of a file whose name tells no language.
PROBE = 128
#: Bytes, or files, of one read task.
TASK_BYTES, TASK_FILES = 32 << 20, 2000


class Rules:
    """The patterns of one ignore file, relative to its directory."""

    def __init__(self, lines: list[str]):
        self.rules: list[tuple[bool, bool, re.Pattern]] = []
        for line in lines:
            line = line.rstrip("\r\n")
            line = re.sub(r"(?<!\\)[ \t]+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            if line.startswith(("\\#", "\\!")):
                line = line[1:]
            folder = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            self.rules.append((keep, folder, re.compile(("" if anchored else "(?:.*/)?") + _glob(line.lstrip("/")) + r"\Z", re.S)))

    def verdict(self, path: str, folder: bool) -> bool | None:
        """Whether a path relative to the directory is ignored; None: no rule says. The last rule that matches wins."""
        out = None
        for keep, only_folders, pattern in self.rules:
            if (folder or not only_folders) and pattern.match(path):
                out = not keep
        return out


def _glob(g: str) -> str:
    out, i = "", 0
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif g.startswith("/**", i) and i + 3 == len(g):
            out, i = out + "/.*", i + 3
        elif g[i] == "*":
            while i < len(g) and g[i] == "*":
                i += 1
            out += "[^/]*"
        elif g[i] == "?":
            out, i = out + "[^/]", i + 1
        elif g[i] == "[" and (end := g.find("]", i + 2)) > 0:
            body = g[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif g[i] == "\\" and i + 1 < len(g):
            out, i = out + re.escape(g[i + 1]), i + 2
        else:
            out, i = out + re.escape(g[i]), i + 1
    return out


def walk(root: str) -> Iterator[tuple[str, bool]]:
    """(path relative to the root, is it a symlink) of the files of a tree, in order."""
    return ((path, link) for path, link, ignored in listed(root) if not ignored)


def listed(root: str, kept: str | None = None) -> Iterator[tuple[str, bool, bool]]:
    """(path, is it a symlink, is it ignored); ignored files only with the suffix ``kept``."""
    root = os.path.realpath(root)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)

    def visit(folder: str, above: list[tuple[str, Rules]], gone: bool) -> Iterator[tuple[str, bool, bool]]:
        held = list(above)
        for name in IGNORE_FILES:
            p = os.path.join(root, folder, name)
            if os.path.isfile(p):
                with open(p, encoding="utf-8", errors="replace") as f:
                    held.append((folder, Rules(f.readlines())))
        for e in sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name):
            path = f"{folder}/{e.name}" if folder else e.name
            is_dir = e.is_dir(follow_symlinks=False)
            ignored = gone or _ignored(path, is_dir, held)
            if is_dir and e.name in STRUCTURAL or ignored and kept is None:
                continue
            if is_dir:
                yield from visit(path, held, ignored)
            elif e.is_file() and (not ignored or e.name.endswith(kept)):
                yield path, e.is_symlink(), ignored

    yield from visit("", [], False)


def _ignored(path: str, is_dir: bool, held: list[tuple[str, Rules]]) -> bool:
    for folder, rules in reversed(held):  # deeper files first, and .ignore over .gitignore
        got = rules.verdict(path[len(folder) + 1 :] if folder else path, is_dir)
        if got is not None:
            return got
    return False


def manifests(root: str) -> list[str]:
    """The root's manifest alone if it has one, else every one below."""
    if os.path.isfile(os.path.join(root, "Cargo.toml")):
        return ["Cargo.toml"]
    return [p for p, link in walk(root) if p.rsplit("/", 1)[-1] == "Cargo.toml" and not link]


class _Files(InputPartition):
    def __init__(self, paths: list[tuple[str, bool, bool]]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = os.path.realpath(root)

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for path, link, ignored in listed(self.root, KEPT):
            held.append((path, link, ignored))
            size += os.stat(os.path.join(self.root, path)).st_size
            if size > TASK_BYTES or len(held) >= TASK_FILES:
                out.append(_Files(held))
                held, size = [], 0
        return [*out, _Files(held)] if held or not out else out

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path, link, ignored in partition.paths:
            full = os.path.join(self.root, path)
            try:
                real = os.path.realpath(full, strict=True)
                s = os.stat(full)
            except OSError as e:
                yield path, None, None, link, ignored, False, None, None, b"", "source-identity", f"could not establish physical identity: {e.strerror}"
                continue
            outside = os.path.commonpath([self.root, real]) != self.root
            raw, problem, detail = b"", None, None
            if outside:
                problem, detail = "source-outside-root", f"canonical target `{real}` is outside the Root"
            else:
                try:
                    with open(full, "rb") as f:
                        raw = f.read(PROBE)
                        # A name that tells nothing: only a first line with an interpreter makes it a source.
                        if "." in os.path.basename(path).lstrip(".") or os.path.basename(path).lower() in SPECIAL_NAMES or raw.startswith(b"#!"):
                            raw += f.read()
                except OSError as e:
                    problem, detail = "source-unreadable", f"could not read it: {e.strerror}"
            yield path, s.st_dev, s.st_ino, link, ignored, outside, s.st_size, int(s.st_mtime_ns), raw, problem, detail


class TreeSource(DataSource):
    """(path, dev, ino, is_symlink, ignored, outside, size, mtime_ns, bytes, problem, detail); ``outside``: a link that leads out of the root."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, dev bigint, ino bigint, is_symlink boolean, ignored boolean, outside boolean, size bigint, mtime_ns bigint, bytes binary, problem string, detail string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"])
