"""Whole counts of small trees, and the text of reports."""

import json
import os

import pytest

from pyspark.sql import functions as F

from linefacts.operators import ledger, rust
from linefacts.operators.accounting import summed
from linefacts.plans import count, report


def put(root, files):
    for path, text in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
        with open(os.path.join(root, path), "w") as f:
            f.write(text)


FILES = {
    "p/Cargo.toml": "[package]\nname = \"p\"\nversion = \"0\"\n\n",
    "p/src/lib.rs": "// top\n\nmod a;\n#[cfg(test)]\nmod t {}\n",
    "p/src/a.rs": "pub fn f() {}\n",
    "p/src/stray.rs": "fn s() {}\n",
    "p/q/x.py": "# c\nx = 1\n",
    "run": "#!/usr/bin/env python3\nprint(1)\n",
    "data.bin": "?",
    "empty.js": "",
}


def test_a_tree_with_a_package(spark, tmp_path):
    put(tmp_path, FILES)
    os.link(tmp_path / "run", tmp_path / "run2")
    files = count.scanned(spark, str(tmp_path))
    packages = spark.createDataFrame([("p", "pkg-p"), ("p/q", "pkg-q")], "root string, pkg string")
    ctx = [("p/src/lib.rs", "pkg-p", 0, [], False, True), ("p/src/lib.rs", "pkg-p", 1, ["test"], True, True)]
    targets = spark.createDataFrame(ctx, count.TARGETS)
    tree = files.where("path LIKE '%.rs'").selectExpr("path", "decode(bytes, 'UTF-8') AS text")
    reached = rust.reachable_files(tree, targets).select("path", "ctx_id").distinct().join(targets.select("ctx_id", "options", "test", "harness"), "ctx_id")
    contexts = reached.selectExpr("path", "struct(ctx_id, options, test, harness) AS c").groupBy("path").agg(F.array_sort(F.collect_list("c")).alias("contexts"))
    book = files.groupBy("identity").agg(F.min("path").alias("path"), F.collect_set("path").alias("aliases"), F.first("bytes").alias("bytes"))
    scopes = ledger.resolve_scope(book, ledger.deepest_owner(files, packages, "identity"), book.where("false").selectExpr("identity", "path AS pkg"))
    facts, _ = count.contributions(book.join(scopes, "identity").join(contexts, "path", "left"))
    got = {(r.scope, r.language): tuple(r)[2:] for r in summed(facts, "scope", "language").collect()}
    assert got == {
        ("pkg-p", "Rust"): (2, 6, 1, 1, 2, 2),
        ("pkg-p", "Rust (unconfigured)"): (1, 1, 0, 0, 1, None),
        ("pkg-p", "TOML"): (1, 4, 1, 0, 3, None),
        ("pkg-q", "Python"): (1, 2, 0, 1, 1, None),
        ("<root>", "Python"): (1, 2, 0, 1, 1, None),
        ("<root>", "JavaScript"): (1, 0, 0, 0, 0, None),
    }
    assert ledger.partition_violations(files, facts.select("identity", "files")).count() == 0


def test_sums_beyond_64_bits_raise_whatever_the_session_says(spark):
    rows = spark.createDataFrame([("a", 2**62, 1, 1, 1, 1, 1), ("a", 2**62, 1, 1, 1, 1, 1)], "scope string, files long, lines long, blanks long, comments long, code long, test long")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            with pytest.raises(Exception, match="64 bits"):
                summed(rows, "scope").collect()
            assert summed(rows.limit(1), "scope").first().files == 2**62
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")


def test_tables_and_json(spark):
    rows = spark.createDataFrame([("b\tx", "Rust", 1, 3, 1, 1, 1, 0), ("b\tx", "TOML", 1, 4, 0, 0, 4, None), ("a", "C", 2, 1, 0, 0, 1, None)], "scope string, language string, files long, lines long, blanks long, comments long, code long, test long")
    lines = report.table(rows).splitlines()
    assert lines[0].split() == ["Package", "Language", "Files", "Lines", "Blanks", "Comments", "Code", "Test"]
    assert [x.split()[0] for x in lines if "-" * 9 not in x] == ["Package", "b\\tx", "Rust", "a", "Total"]
    assert sum(set(x) == {"-"} for x in lines) == 3 and lines[-1].split() == ["Total", "All", "4", "8", "1", "1", "6", "n/a"]
    assert report.totals(rows).splitlines()[2].split()[0] == "TOML"
    more = rows.selectExpr("*", "'id' AS scope_id", "scope AS name", "'/p' AS project_root", "'/p/Cargo.toml' AS manifest_path", "'rust' AS engine", "'lexical' AS precision")
    doc = json.loads(report.document(more, "/", {}, [("b", "2"), ("a", "1"), ("a", "1")]))
    assert doc["rows"][0]["test"] is None and doc["total"]["lines"] == 8 and [w["code"] for w in doc["warnings"]] == ["a", "b"]
    assert doc["rows"][0]["scope"] == {"kind": "package", "name": "b\tx", "package_id": "id", "project_root": "/p", "manifest_path": "/p/Cargo.toml"}
    with pytest.raises(ValueError):
        report.document(more, "/\udcff", {}, [])
    none = report.table(rows.where("false")).splitlines()
    assert none[-1].split() == ["Total", "All", *["0"] * 6]
    assert report.sanitize("a\x1bb|\\") == "a\\u{001B}b|\\"
