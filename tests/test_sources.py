"""The tree source, captured metadata, lexical counts, and report text."""

import os

import pytest

from linefacts.functions.languages import lexical_counts
from linefacts.sources import cargo
from linefacts.sources.tree import Rules, TreeSource, manifests, walk


def put(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)


def test_walk_honours_ignore_files(tmp_path):
    put(tmp_path, {".gitignore": "*.log\n/build\nkeep/*\n!keep/me.txt\n", "a.py": "", "b.log": "", "build/x": "", "sub/build/x": "", "keep/me.txt": "", "keep/no.txt": "", ".dot": "", "_u": "", "target/t": "", ".git/c": "", "sub/.ignore": "!y.log\n", "sub/y.log": ""})
    assert [p for p, _ in walk(str(tmp_path))] == [".dot", ".gitignore", "_u", "a.py", "keep/me.txt", "sub/.ignore", "sub/build/x", "sub/y.log"]


@pytest.mark.parametrize(("rule", "path", "folder", "want"), [("a/**/b", "a/x/y/b", False, True), ("**/z", "q/z", False, True), ("d/", "d", False, None), ("d/", "d", True, True), ("[!a]x", "bx", False, True), ("\\#f", "#f", False, True), ("!k", "k", False, False)])
def test_rules(rule, path, folder, want):
    assert Rules([rule]).verdict(path, folder) is want


def test_tree_source(spark, tmp_path):
    put(tmp_path, {"a.txt": "x\n", "empty": "", "d/b.txt": "y"})
    os.link(tmp_path / "a.txt", tmp_path / "hard.txt")
    os.symlink("a.txt", tmp_path / "soft.txt")
    os.symlink("/etc/hostname", tmp_path / "out.txt")
    spark.dataSource.register(TreeSource)
    got = {r.path: r for r in spark.read.format("tree").load(str(tmp_path)).collect()}
    assert set(got) == {"a.txt", "empty", "d/b.txt", "hard.txt", "soft.txt", "out.txt"}
    assert got["a.txt"].ino == got["hard.txt"].ino == got["soft.txt"].ino and got["soft.txt"].is_symlink
    assert got["empty"].size == 0 and got["out.txt"].outside and bytes(got["out.txt"].bytes) == b""


def test_manifests(tmp_path):
    put(tmp_path, {"a/Cargo.toml": "", "b/c/Cargo.toml": "", "target/Cargo.toml": ""})
    assert manifests(str(tmp_path)) == ["a/Cargo.toml", "b/c/Cargo.toml"]
    put(tmp_path, {"Cargo.toml": ""})
    assert manifests(str(tmp_path)) == ["Cargo.toml"]


def test_captured_metadata(spark):
    doc = cargo.metadata_document('note\n{"packages": [{"id": "p", "name": "n", "manifest_path": "m", "features": {"b": [], "a": ["b"]}, "targets": [{"name": "n", "kind": ["proc-macro"], "src_path": "s", "crate_types": ["proc-macro"]}, {"name": "b", "kind": ["custom-build"], "src_path": "b"}, {"name": "u", "kind": ["odd"], "src_path": "u"}]}], "workspace_members": ["p"]}')
    packages, targets = cargo.packages_and_targets(spark, doc)
    assert packages.first().features == ["a", "b"] and packages.first().member
    assert sorted(r.kind for r in targets.collect()) == ["build-script", "lib"]
    assert cargo.closure({"default": ["a"], "a": ["b", "dep:x", "y/z"], "b": []}, set()) == {"default", "a", "b"}
    assert cargo.cfg_options('unix\ntarget_os="linux"\nunix\n') == [("target_os", "linux"), ("unix", None)]
    assert cargo.host_of("x\nhost: a-b\n") == "a-b" and cargo.resolver_of('[workspace]\nresolver = "2"\n') == 2
    assert cargo.manifest_flags("[lib]\nbench = false\n", "lib", "n") == {"test": True, "bench": False, "harness": True}
    with pytest.raises(cargo.ProcessError):
        cargo.run(["sleep", "5"], "waiting", timeout=0.2)


@pytest.mark.parametrize(("text", "language", "want"), [("", "C", (0, 0, 0, 0)), ("int a; /* x */\n/* y */\n", "C", (2, 0, 1, 1)), ("s = '# no'\n# yes\n", "Python", (2, 0, 1, 1)), ("'''\n# in\n'''\n", "Python", (3, 0, 0, 3)), ("{-\n\n-}\nx\n", "Haskell", (4, 0, 3, 1)), ("<p>\n<script>\n// c\n\nx\n</script>\n<style lang=\"scss\">\n// s\n</style>\n", "HTML", (9, 1, 2, 6)), ("<script>x</script>\n", "HTML", (1, 0, 0, 1)), ("# t\n```rust\n// c\nfn f() {}\n\n```\n\ntext\n```\nplain\n```\n", "Markdown", (11, 2, 8, 1))])
def test_lexical(text, language, want):
    assert lexical_counts(text.encode(), language) == want
