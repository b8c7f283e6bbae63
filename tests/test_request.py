"""Requests, snapshots and sessions, and the command line."""

import json
import os

import pytest

from linefacts import __main__ as cli
from linefacts.plans import snapshot
from linefacts.plans.discover import contexts_asked, less, names
from linefacts.plans.request import Selection, UsageError, exclusion, parser, selection
from linefacts.sources.toolchain import Captured


def asked(*argv):
    return selection(parser().parse_args(argv))


def test_normalised():
    s = asked("-F", "b,a a", "-F", "c", "--target", "y", "--target", "x", "--bin", "m", "--exclude-target", "test", "d")
    assert (s.features, s.targets, s.includes, s.excludes, s.root) == (("a", "b", "c"), ("x", "y"), ("bin:m",), ("test",), "d")
    assert asked().all_features and not asked("--features", "").all_features and not asked("--no-default-features").all_features
    assert asked().root_files and not asked("-p", "x").root_files and asked().includes == ("all-targets",)


@pytest.mark.parametrize("bad", ["odd", "bin:", "bin:a:b", "build-script:x", ""])
def test_bad_selectors(bad):
    with pytest.raises(UsageError):
        exclusion(bad)


def test_usage_errors_exit_with_two(capsys):
    assert cli.main(["--exclude", "x"]) == 2
    with pytest.raises(SystemExit) as e:
        cli.main(["--json", "--totals"])
    assert e.value.code == 2 and capsys.readouterr().out == ""


def test_contexts():
    everything, lib, named = Selection(), Selection(includes=("lib",)), Selection(includes=("bin:m*", "test:[ab]?"))
    assert contexts_asked(everything, "lib", "l", True, True) == ({"production", "test", "bench"}, set())
    assert contexts_asked(everything, "test", "t", True, False) == ({"test"}, set()) and contexts_asked(everything, "build-script", "b", True, True) == ({"production"}, set())
    assert contexts_asked(named, "bin", "main", True, True) == ({"production"}, {"bin:m*"}) and contexts_asked(named, "test", "b1", True, False) == ({"test"}, {"test:[ab]?"})
    assert contexts_asked(lib, "bin", "m", True, True) == (set(), set()) and contexts_asked(asked("--tests"), "bin", "m", True, True) == ({"test"}, set())
    assert less({"production", "test", "bench"}, ("test", "bin:x"), "bin", "y") == ({"production", "bench"}, {"test"}) and less({"production"}, ("bin",), "bin", "y") == (set(), {"bin"})
    assert less({"test"}, ("test:t.1",), "test", "t.1") == (set(), {"test:t.1"}) and not names("test:t.1", "test", "tx1")


def test_snapshots_are_whole_or_not_there(tmp_path):
    path = snapshot.store(str(tmp_path), "k", "out")
    assert snapshot.load(str(tmp_path), "k") == "out" and snapshot.load(str(tmp_path), "other") is None
    record = json.load(open(path))
    json.dump(record | {"output": "changed"}, open(path, "w"))
    assert snapshot.load(str(tmp_path), "k") is None


def test_a_session_counts_only_after_changes(tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("1")
    calls = []
    s = snapshot.Session(Selection(str(tmp_path / "t")), lambda: calls.append(1) or str(len(calls)), str(tmp_path / "cache"))
    assert [s.refresh(), s.refresh()] == ["1", "1"]
    (tmp_path / "t/a.txt").write_text("22")
    assert s.refresh() == "2"
    (tmp_path / "t/target").mkdir()
    (tmp_path / "t/target/x").write_text("not an input")
    assert s.refresh() == "2"
    assert snapshot.Session(Selection(str(tmp_path / "t")), lambda: "never", str(tmp_path / "cache")).refresh() == "2"
    turn = snapshot.Session(Selection(str(tmp_path / "t")), lambda: (tmp_path / "t/a.txt").write_text("3" * len(calls)) and calls.append(1) or "x")
    with pytest.raises(snapshot.UnstableInputs):
        turn.refresh()


def test_a_package_by_its_metadata(spark, tmp_path, capsys):
    root = tmp_path / "w"
    for path, text in {"p/Cargo.toml": "[package]\n", "p/src/lib.rs": "#[cfg(feature = \"x\")]\nfn x() {}\n#[cfg(test)]\nfn t() {}\n", "p/tests/i.rs": "fn i() {}\n", "o.py": "1\n"}.items():
        os.makedirs((root / path).parent, exist_ok=True)
        (root / path).write_text(text)
    doc = {"packages": [{"id": "p", "name": "p", "manifest_path": str(root / "p/Cargo.toml"), "features": {"x": []}, "targets": [{"name": "p", "kind": ["lib"], "src_path": str(root / "p/src/lib.rs")}, {"name": "i", "kind": ["test"], "src_path": str(root / "p/tests/i.rs")}]}], "workspace_members": ["p"]}
    name = lambda r: r["scope"].get("name", "<root>")
    out = json.loads(cli.counted(spark, asked("--json", str(root)), Captured(doc))[0])
    rows = {(name(r), r["language"]): r for r in out["rows"]}
    assert (rows[("p", "Rust")]["files"], rows[("p", "Rust")]["code"], rows[("p", "Rust")]["test"]) == (2, 2, 3) and ("<root>", "Python") in rows
    less = json.loads(cli.counted(spark, asked("--json", "--no-default-features", "-p", "p", "--exclude-target", "test", str(root)), Captured(doc))[0])
    assert {(name(r), r["language"]): r["code"] for r in less["rows"]} == {("p", "Rust"): 0, ("p", "Rust (unconfigured)"): 1, ("p", "TOML"): 1}


def test_warnings_are_told(spark, tmp_path, capsys):
    (tmp_path / "w").mkdir()
    (tmp_path / "far.rs").write_text("fn f() {}\n")
    (tmp_path / "w/near.rs").symlink_to(tmp_path / "far.rs")
    (tmp_path / "w/o.py").write_text("1\n")
    text, told = cli.counted(spark, asked("--json", "--exclude-target", "bench", str(tmp_path / "w")))
    assert [w["code"] for w in json.loads(text)["warnings"]] == ["source-outside-root", "unmatched-target-exclusion"] and told == ""
    _, told = cli.counted(spark, asked("--exclude-target", "bench", str(tmp_path / "w")))
    assert told.endswith("warning[unmatched-target-exclusion]: target exclusion `bench` matched nothing\n")
