"""Whole counts of workspaces: selection, features, contexts, ownership, warnings, errors, snapshots."""

import json
import os
import signal
import sys
import threading
import time

import pytest

from linefacts import __main__ as cli
from linefacts.operators import incremental
from linefacts.plans import configure, features, snapshot
from linefacts.plans.discover import SelectionError, discover
from linefacts.plans.request import Selection, parser, selection
from linefacts.sources import process, workdir
from linefacts.sources.toolchain import Captured, Live, load_config, options_of_triple, spec_matches


def put(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)


def asked(root, *argv):
    return selection(parser().parse_args([*argv, str(root)]))


def target(root, name, path, kind="lib", **more):
    return {"name": name, "kind": [kind], "crate_types": ["lib" if kind == "lib" else "bin"], "src_path": str(root / path), "edition": "2021", **more}


def package(root, i, name, folder, targets, features=None, **more):
    return {"id": i, "name": name, "version": "0.1.0", "edition": "2021", "manifest_path": str(root / folder / "Cargo.toml"), "features": features or {}, "targets": targets, **more}


@pytest.fixture
def three(tmp_path):
    """Packages a, b, and another a; a reaches into b; o.py belongs to nobody."""
    root = tmp_path / "w"
    put(root, {
        "Cargo.toml": "[workspace]\nmembers = [\"a\", \"b\", \"c\"]\nresolver = \"2\"\n",
        "a/Cargo.toml": "[package]\n[lib]\nbench = false\n", "b/Cargo.toml": "[package]\n", "c/Cargo.toml": "[package]\n",
        "a/src/lib.rs": "#[cfg(unix)]\nfn u() {}\n#[cfg(windows)]\nfn w() {}\n#[cfg(feature = \"x\")]\nmod x;\n#[cfg(odd)]\nfn o() {}\n#[path = \"../../b/src/shared.rs\"]\nmod shared;\nmod gen;\n",
        "a/src/x.rs": "fn x() {}\n", "a/.gitignore": "gen.rs\n", "a/src/gen.rs": "fn g() {}\n",
        "b/src/lib.rs": "mod shared;\n#[cfg(test)]\nfn t() {}\n", "b/src/shared.rs": "fn s() {}\n", "b/n.py": "1\n",
        "c/src/lib.rs": "fn c() {}\n", "o.py": "1\n2\n",
    })
    doc = {
        "workspace_root": str(root),
        "workspace_members": ["ida", "idb", "idc"],
        "packages": [
            package(root, "ida", "a", "a", [target(root, "a", "a/src/lib.rs"), target(root, "need", "a/src/x.rs", "bin", **{"required-features": ["x"]})], {"x": [], "y": []}),
            package(root, "idb", "b", "b", [target(root, "b", "b/src/lib.rs")]),
            package(root, "idc", "a", "c", [target(root, "a", "c/src/lib.rs")]),
        ],
    }
    return root, Captured(doc)


def counts(spark, root, tool, *argv):
    doc = json.loads(cli.counted(spark, asked(root, "--json", *argv), tool)[0])
    return {(r["scope"].get("package_id", "<root>"), r["language"]): (r["files"], r["code"], r["test"]) for r in doc["rows"]}, doc


def test_three_packages(spark, three):
    root, tool = three
    got, doc = counts(spark, root, tool)
    # a: two cfg(unix) lines, three lines of x, path and mod shared, gen; x.rs twice reached; the ignored gen.rs is claimed.
    assert got[("ida", "Rust")] == (3, 9, 0) and got[("idb", "Rust")] == (2, 2, 2) and got[("idc", "Rust")] == (1, 1, 0)
    assert got[("<root>", "Python")] == (1, 2, None) and got[("idb", "Python")] == (1, 1, None) and got[("<root>", "TOML")][0] == 1
    codes = [(w["code"], w["message"]) for w in doc["warnings"]]
    assert [c for c, _ in codes] == ["source-shared-between-packages", "unknown-cfg"] and "`odd` in Package `a`" in codes[1][1] and "b/src/shared.rs" in codes[0][1]
    conf = doc["configuration"]
    assert conf["host_targets"] == conf["targets"] == ["x86_64-unknown-linux-gnu"] and conf["requested_targets"] == []
    contexts = [c for c in conf["feature_contexts"] if c["package_id"] == "ida"]
    assert [(c["target_name"], c["provenance"], c["features"]) for c in contexts] == [("a", "production", ["x", "y"]), ("a", "test", ["x", "y"]), ("need", "production", ["x", "y"]), ("need", "test", ["x", "y"])]
    table = cli.counted(spark, asked(root), tool)[0]
    assert "a (a)" in table and "a (c)" in table


def test_excluded_packages_bound_what_others_own(spark, three):
    root, tool = three
    got, _ = counts(spark, root, tool, "--workspace", "--exclude", "b")
    # b's files belong to nobody, but shared.rs is reached by a alone, which owns it.
    assert {k for k in got if k[0] == "idb"} == set() and got[("<root>", "Python")] == (1, 2, None) and got[("ida", "Rust")] == (4, 10, 0)
    only, _ = counts(spark, root, tool, "-p", "a@0.1.0" if False else "idc")
    assert only == {("idc", "Rust"): (1, 1, 0), ("idc", "TOML"): (1, 1, None)}
    windows, _ = counts(spark, root, tool, "-p", "ida", "--target", "x86_64-pc-windows-msvc", "--no-default-features", "--lib")
    assert windows[("ida", "Rust")][1] == 7  # two cfg(windows) lines, path and mod shared, gen, shared.rs, gen.rs


def test_requests_that_match_nothing_raise(spark, three, capsys):
    root, tool = three
    for argv in (["-p", "nosuch"], ["-F", "nosuch"], ["--bin", "nosuch"], ["--bin", "need", "--no-default-features"], ["--workspace", "--exclude", "nosuch"]):
        with pytest.raises(SelectionError):
            cli.prepared(asked(root, *argv), str(root), tool, snapshot.Metrics())
    with pytest.raises(process.ProcessError):
        cli.prepared(asked(root, "-p", "a"), str(root), tool, snapshot.Metrics())  # two packages are named so
    inventory = discover(asked(root, "--exclude-target", "example", "--exclude-target", "bin:need"), tool)
    assert inventory.warnings == (("unmatched-target-exclusion", "target exclusion `example` matched nothing"),)
    assert [t.contexts for p in inventory.projects[0].packages if p.id == "ida" for t in p.targets] == [("production", "test")]


def test_packages_without_targets_go_with_their_files(spark, three):
    root, tool = three
    got, _ = counts(spark, root, tool, "--bin", "need")
    assert set(got) == {("ida", "Rust"), ("ida", "Rust (unconfigured)"), ("ida", "TOML"), ("<root>", "Python"), ("<root>", "TOML")}


def test_modules_out_of_the_root_raise_and_links_warn(spark, tmp_path):
    root = tmp_path / "w"
    put(root, {"Cargo.toml": "[package]\n", "src/lib.rs": "mod l;\n"})
    put(tmp_path, {"far.rs": "fn f() {}\n"})
    os.symlink(tmp_path / "far.rs", root / "src/l.rs")
    tool = Captured({"workspace_root": str(root), "workspace_members": ["i"], "packages": [package(root, "i", "p", "", [target(root, "p", "src/lib.rs")])]})
    got, doc = counts(spark, root, tool)
    assert got[("i", "Rust")] == (1, 1, 0) and [w["code"] for w in doc["warnings"]] == ["source-symlink-outside-root"]
    put(root, {"src/lib.rs": "#[path = \"../../far.rs\"]\nmod f;\n"})
    with pytest.raises(Exception, match="outside the root"):
        counts(spark, root, tool)


def app(resolver_deps):
    dep = lambda name, feature, **more: {"name": name, "features": [feature], "uses_default_features": False, "kind": None, "target": None, "optional": False, **more}
    names = {f: [] for f in ("normal", "dev", "build", "unix", "windows")}
    root = {"id": "app", "name": "app", "features": {"more": ["dep:opt", "opt/z"], "faint": ["opt?/z"]}, "targets": [], "dependencies": [dep("shared", "normal"), dep("shared", "dev", kind="dev"), dep("shared", "build", kind="build"), dep("shared", "unix", target="cfg(unix)"), dep("shared", "windows", target="cfg(windows)"), dep("opt", "o", optional=True)]}
    opt = {"id": "opt", "name": "opt", "features": {"o": [], "z": [], "default": ["o"]}, "targets": [], "dependencies": []}
    return {"packages": [root, {"id": "shared", "name": "shared", "features": names, "targets": [], "dependencies": []}, opt], "resolve": {"nodes": [{"id": "app", "deps": [{"pkg": "shared"}, {"pkg": "opt"}]}, {"id": "shared", "deps": []}]}}


@pytest.mark.parametrize(("resolver", "dev", "on_target", "on_host"), [
    (1, True, {"normal", "dev", "build", "unix", "windows"}, {"normal", "dev", "build", "unix", "windows"}),
    (2, True, {"normal", "dev", "unix"}, {"build"}), (3, True, {"normal", "dev", "unix"}, {"build"}), (2, False, {"normal", "unix"}, {"build"}),
])
def test_resolvers(resolver, dev, on_target, on_host):
    linux = ("x86_64-unknown-linux-gnu", options_of_triple("x86_64-unknown-linux-gnu"))
    sides = {features.HOST: linux, features.TARGET: linux}
    b = features.resolve(app(None), resolver, dev, {"app": set()}, sides)
    assert (b.features("shared", features.TARGET), b.features("shared", features.HOST)) == (on_target, on_host)
    assert b.features("opt", features.TARGET) is None
    assert features.resolve(app(None), resolver, dev, {"app": {"faint"}}, sides).features("opt", features.TARGET) is None
    assert features.resolve(app(None), resolver, dev, {"app": {"more", "faint"}}, sides).features("opt", features.TARGET) == {"o", "z"}


def test_roles_and_universe():
    assert configure.roles("build-script", ("bin",), "production", {"t"}, None) == [("host", {"t"})]
    assert configure.roles("lib", ("proc-macro",), "test", {"t"}, {"h"}) == [("host", {"h"})]
    assert configure.roles("lib", ("lib",), "production", {"t"}, {"h"}) == [("target", {"t"}), ("host", {"h"})] and configure.roles("lib", ("lib",), "test", {"t"}, {"h"}) == [("target", {"t"})]
    active = {("unix", None), ("odd", None), ("target_os", "plan9")}
    assert {"unix", "odd", "feature", "target_os"} <= configure.known_names(active) and {("target_os", "plan9"), ("target_os", "linux")} <= configure.known_pairs(active)
    assert spec_matches("p@1.0", {"id": "path+file:///p#1.0", "name": "p", "version": "1.0"}) and spec_matches("file:///p", {"id": "path+file:///p#1.0", "name": "p", "version": "1.0"})


def test_configuration_files(tmp_path):
    put(tmp_path, {".cargo/config.toml": "[build]\ntarget = [\"t1\", \"t2\"]\n", "p/.cargo/config.toml": "[build]\nrustc = \"r\"\n[target.x]\nrustflags = []\n"})
    env = {"CARGO_HOME": str(tmp_path / "none")}
    assert load_config(str(tmp_path), env).targets == ("t1", "t2") and not load_config(str(tmp_path), env).rustflags
    assert (load_config(str(tmp_path / "p"), env).rustc, load_config(str(tmp_path / "p"), env).rustflags) == ("r", True)
    assert load_config(str(tmp_path), env | {"RUSTFLAGS": "-C x", "CARGO_BUILD_TARGET": "t3"}).targets == ("t3",)


def fake_tools(folder, root, doc):
    """Executables that answer as the build tool and the compiler would."""
    put(folder, {"doc.json": json.dumps(doc)})
    put(folder, {"cargo": f"#!{sys.executable}\nimport sys, pathlib\npathlib.Path('{folder}/calls').open('a').write(sys.argv[1] + chr(10))\nif sys.argv[1] == 'metadata':\n    print(open('{folder}/doc.json').read())\nelif sys.argv[-1] == 'p':\n    print('i')\nelse:\n    sys.exit('error: package ID specification `x` did not match any packages')\n"})
    put(folder, {"rustc": f"#!{sys.executable}\nimport sys, pathlib\npathlib.Path('{folder}/calls').open('a').write('rustc' + chr(10))\nprint('host: fake-unknown-linux' if '-vV' in sys.argv else 'unix\\ntarget_os=\"linux\"')\n"})
    for name in ("cargo", "rustc"):
        os.chmod(folder / name, 0o755)


def test_processes_are_asked_once_and_a_change_of_sources_asks_none(spark, tmp_path, monkeypatch):
    root, tools = tmp_path / "w", tmp_path / "bin"
    put(root, {"Cargo.toml": "[package]\n", "src/lib.rs": "#[cfg(unix)]\nfn u() {}\n", "n.py": "1\n"})
    fake_tools(tools, root, {"workspace_root": str(root), "workspace_members": ["i"], "packages": [package(root, "i", "p", "", [target(root, "p", "src/lib.rs")])]})
    monkeypatch.setenv("CARGO", str(tools / "cargo"))
    monkeypatch.setenv("RUSTC", str(tools / "rustc"))
    calls = lambda: (tools / "calls").read_text().split()
    s = asked(root, "-p", "p", "--json")
    r = cli.Resident(s, lambda: spark, Live, str(tmp_path / "cache"))
    first = json.loads(r.refresh()[0])
    assert first["rows"][0]["language"] in ("Rust", "TOML") and sorted(calls()) == ["metadata", "pkgid", "rustc", "rustc"]
    assert r.refresh()[0] and r.metrics.counts == {"unprepared": 1, "counted": 1, "resident": 1}
    put(root, {"src/lib.rs": "fn a() {}\nfn b() {}\nfn c() {}\n"})
    changed = {x["language"]: x["code"] for x in json.loads(r.refresh()[0])["rows"]}
    assert changed["Rust"] == 3 and len(calls()) == 4 and r.metrics.counts["prepared"] == 1
    put(root, {"Cargo.toml": "[package]\nname = \"p\"\n"})
    r.refresh()
    assert len(calls()) == 8 and r.metrics.counts["unprepared"] == 2
    again = cli.Resident(s, lambda: 1 / 0, Live, str(tmp_path / "cache"))
    assert again.refresh() == r.refresh() and again.metrics.counts == {"stored": 1}
    with pytest.raises(SelectionError):
        cli.prepared(asked(root, "-p", "nosuch"), str(root), Live(), snapshot.Metrics())


def test_preparation_depends_on_names_of_targets_and_not_on_sources(tmp_path, monkeypatch):
    monkeypatch.setenv("CARGO_HOME", str(tmp_path / "none"))
    put(tmp_path, {"Cargo.toml": "", "src/lib.rs": "", "src/other.rs": "", "x.json": "1"})
    s = Selection(str(tmp_path))
    key = lambda: snapshot.preparation_fingerprint(s, str(tmp_path), snapshot.fingerprint(s, str(tmp_path))[1])
    one = key()
    put(tmp_path, {"src/lib.rs": "fn f() {}", "src/new.rs": ""})
    assert key() == one
    put(tmp_path, {"tests/t.rs": ""})
    two = key()
    put(tmp_path, {"x.json": "2"})
    assert len({one, two, key()}) == 3


def test_results_are_marked_and_swept(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int")
    now = spark.createDataFrame([("b", "x"), ("c", "xyz"), ("c", "xyz")], "key string, t string")
    made = []
    out = incremental.swept(old, now, lambda rows: made.append(rows.count()) or rows.selectExpr("key", "CAST(length(t) AS INT) AS n"), "key")
    assert sorted(map(tuple, out.collect())) == [("b", 2), ("c", 3)] and made == [1]


def test_bounded_processes(tmp_path, monkeypatch):
    with pytest.raises(process.ProcessError, match="bytes of output"):
        process.run([sys.executable, "-c", "while True: print('x' * 1000)"], "shouting", timeout=20, limit=10_000)
    mark = tmp_path / "alive"
    code = f"import subprocess, sys; subprocess.Popen([sys.executable, '-c', \"import time; time.sleep(1.5); open('{mark}', 'w')\"]); print('done')"
    assert process.run([sys.executable, "-c", code], "leaving one behind", timeout=20).stdout == b"done\n"
    time.sleep(2)
    assert not mark.exists()
    monkeypatch.setenv(process.TIMEOUT_NAME, "0.3")
    with pytest.raises(process.ProcessError, match="no end"):
        process.run(["sleep", "5"], "waiting")
    monkeypatch.setenv(process.TIMEOUT_NAME, "odd")
    with pytest.raises(process.ProcessError, match="positive"):
        process.run(["true"], "x")
    monkeypatch.delenv(process.TIMEOUT_NAME)
    got = []
    before = signal.signal(signal.SIGTERM, lambda *_: got.append(1))
    try:
        threading.Timer(0.4, os.kill, (os.getpid(), signal.SIGTERM)).start()
        with pytest.raises(process.ProcessError, match="interrupted"):
            process.run(["sleep", "5"], "waiting")
    finally:
        signal.signal(signal.SIGTERM, before)
    assert got == [1]


def test_a_cluster_without_a_shared_folder_raises(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://far:7077", "x"
        getConf = staticmethod(dict)

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})()

    with pytest.raises(workdir.NoSharedFolder):
        workdir.shared_dir(Session())
    assert workdir.is_local("local[4]") and not workdir.is_local("yarn")
