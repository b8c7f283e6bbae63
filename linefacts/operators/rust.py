"""Configuration-aware line facts of Rust files, and the module graph.

Files come as (path, text) and contexts as arrays of structs (ctx_id, options,
test, harness); an option is ``name`` or ``name=value``. The lexer runs once a
file for all its contexts, in Arrow batches.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linefacts.functions import rustlex
from linefacts.sources.workdir import ship, written

CONTEXTS = "array<struct<ctx_id:int,options:array<string>,test:boolean,harness:boolean>>"


def _context(c: dict) -> rustlex.Context:
    options = frozenset(tuple(o.split("=", 1)) if "=" in o else o for o in c["options"])
    return rustlex.Context(options, c["test"], c["harness"])


def with_counts(files: DataFrame) -> DataFrame:
    """(path, files, lines, blanks, comments, code, test) from (path, text, contexts); null contexts: unconfigured, test unavailable."""

    ship(files.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = []
            for path, text, contexts in zip(*(b.column(c).to_pylist() for c in ("path", "text", "contexts"))):
                try:
                    got = (*rustlex.unconfigured_counts(text or ""), None) if contexts is None else rustlex.counts([(text or "", [_context(c) for c in contexts])])
                except rustlex.RustError as e:
                    raise rustlex.RustError(f"{path}: {e}") from e
                rows.append((path, *got))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_pydict({"path": pa.array(cols[0], pa.string())} | {n: pa.array(c, pa.int64()) for n, c in zip(("files", "lines", "blanks", "comments", "code", "test"), cols[1:])})

    return files.select("path", "text", "contexts").mapInArrow(run, "path string, files long, lines long, blanks long, comments long, code long, test long")


def line_flags(files: DataFrame) -> DataFrame:
    """(path, ctx_id, production, line_no, blank, comment, code): every line that a context touches."""

    ship(files.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = []
            for path, text, contexts in zip(*(b.column(c).to_pylist() for c in ("path", "text", "contexts"))):
                source = rustlex.Source(text or "")
                gone = source.inactive_in([_context(c) for c in contexts or ()])
                for c, ranges in zip(contexts or (), gone):
                    blank, comment, code = source.line_flags(_context(c), ranges)
                    rows += [(path, c["ctx_id"], not c["test"], n + 1, n in blank, n in comment, n in code) for n in sorted(blank | comment | code)]
            cols = list(zip(*rows)) or [()] * 7
            types = (pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_())
            names = ("path", "ctx_id", "production", "line_no", "blank", "comment", "code")
            yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(names, cols, types)})

    return files.select("path", "text", "contexts").mapInArrow(run, "path string, ctx_id int, production boolean, line_no int, blank boolean, comment boolean, code boolean")


def declared_modules(text: str, path: str, base: str, context: rustlex.Context) -> list[tuple[str, str, str | None]]:
    """(name, directory, explicit path) of the external modules that are active in a context.

    Inline modules around a declaration extend the directory; an explicit path
    counts from the file's own directory, or from the inline one.
    """
    source, out = rustlex.Source(text), []
    gone = source.inactive(context)
    for m in source.modules:
        if any(a <= m.at < b for a, b in gone):
            continue
        folder, at = base, posixpath.dirname(path)
        for name, effects in m.inline:
            step = context.path(effects) or name
            folder = posixpath.normpath(posixpath.join(folder, step))
            at = folder
        explicit = context.path(m.effects)
        out.append((m.name, folder, None if explicit is None else posixpath.normpath(posixpath.join(at, explicit))))
    return out


def module_base(path: str, root: bool) -> str:
    folder, name = posixpath.split(path)
    return folder if root or name == "mod.rs" else posixpath.join(folder, name.rsplit(".", 1)[0])


def reachable_files(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, base, ctx_id) of every Rust file that a target's root (path, ctx_id, options, test, harness) reaches.

    Each round analyses the files that are new in a context; a missing or
    ambiguous module raises, and so does a path out of the root. A file that
    the tree marks as a link out of the root (``outside``) is reached and goes
    no further. Rounds are written to the shared folder.
    """
    ship(tree.sparkSession)
    if "outside" not in tree.columns:
        tree = tree.withColumn("outside", F.lit(False))
    ctx = roots.select("ctx_id", "options", "test", "harness").distinct()
    first = roots.select("path", F.regexp_replace("path", "/?[^/]*$", "").alias("base"), "ctx_id").distinct()
    seen = frontier = written(first, "modules")

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["outside"]:
                    continue
                if r["text"] is None:
                    far = r["path"].startswith("../")
                    raise rustlex.RustError(f"{r['path']}: {'outside the root' if far else 'not found'}")
                for name, folder, explicit in declared_modules(r["text"], r["path"], r["base"], _context(r)):
                    rows.append((r["path"], r["ctx_id"], name, folder, explicit))
            c = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int32() if n == "ctx_id" else pa.string()) for n, v in zip(("parent", "ctx_id", "name", "folder", "explicit"), c)})

    paths = tree.select(F.col("path").alias("found"))
    while frontier.limit(1).count():
        each = frontier.join(ctx, "ctx_id").join(tree.select("path", "text", "outside"), "path", "left")
        declared = each.select("path", "base", "ctx_id", "options", "test", "harness", "text", "outside").mapInArrow(find, "parent string, ctx_id int, name string, folder string, explicit string")
        plain = F.concat_ws("/", F.nullif("folder", F.lit("")), F.concat("name", F.lit(".rs")))
        nested = F.concat_ws("/", F.nullif("folder", F.lit("")), "name", F.lit("mod.rs"))
        declared = declared.withColumn("a", F.coalesce("explicit", plain)).withColumn("b", F.when(F.col("explicit").isNull(), nested))
        held = declared.join(paths.withColumnRenamed("found", "fa"), F.col("a") == F.col("fa"), "left").join(paths.withColumnRenamed("found", "fb"), F.col("b") == F.col("fb"), "left")
        wrong = F.when(F.col("fa").isNotNull() & F.col("fb").isNotNull(), "ambiguous").when(F.col("a").startswith("../"), "outside the root").when(F.col("fa").isNull() & F.col("fb").isNull(), "not found")
        path = F.when(wrong.isNotNull(), F.raise_error(F.concat_ws(" ", "parent", F.lit("module"), "name", wrong))).otherwise(F.coalesce("fa", "fb"))
        held = held.select(path.alias("path"), "ctx_id")
        stem = F.regexp_replace("path", r"\.[^./]*$", "")
        base = F.when(F.col("path").rlike("(^|/)mod\\.rs$"), F.regexp_replace("path", "/?mod\\.rs$", "")).otherwise(stem)
        step = held.select("path", base.alias("base"), "ctx_id").distinct()
        frontier = written(step.join(seen, ["path", "base", "ctx_id"], "left_anti"), "modules")
        seen = seen.unionByName(frontier)
    return seen


def held_predicates(rows: DataFrame, predicate: str, options: str, name: str) -> DataFrame:
    """Adds whether a predicate holds under an array of options; a malformed one raises."""
    ship(rows.sparkSession)
    columns = rows.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parsed: dict[str, list] = {}
        for b in batches:
            out = []
            for p, o in zip(b.column(predicate).to_pylist(), b.column(options).to_pylist()):
                if p not in parsed:
                    parsed[p] = rustlex.Source(f"#[cfg({p})] fn f() {{}}").groups[0].effects
                out.append(_context({"options": o, "test": False, "harness": True}).active(parsed[p]))
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in columns} | {name: pa.array(out, pa.bool_())})

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {name} boolean")


def unknown_cfgs(files: DataFrame, known: dict[str, tuple[frozenset, frozenset, frozenset]]) -> DataFrame:
    """Distinct (pkg, predicate): options that files (pkg, path, text, contexts) ask for and their package doesn't know.

    known: option names, (name, value) pairs and declared features of each
    package. Attributes inside what is inactive in all contexts don't count,
    nor does what a false cfg_attr would generate.
    """
    ship(files.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: set[tuple[str, str]] = set()
        for b in batches:
            for r in b.to_pylist():
                universe = known[r["pkg"]]
                found |= {(r["pkg"], p) for p in unknown_options(r["text"] or "", [_context(c) for c in r["contexts"]], *universe)}
        yield pa.RecordBatch.from_pydict({"pkg": pa.array([p for p, _ in found], pa.string()), "predicate": pa.array([x for _, x in found], pa.string())})

    return files.select("pkg", "path", "text", "contexts").mapInArrow(run, "pkg string, predicate string").distinct()


def unknown_options(text: str, contexts: list[rustlex.Context], names: frozenset, pairs: frozenset, features: frozenset) -> set[str]:
    """The options of one file's active predicates that aren't known, as they are written."""
    found: set[str] = set()

    def ask(p: tuple) -> None:
        if p[0] == "option":
            name, value = p[1], p[2]
            fine = name in names if value is None else value in features if name == "feature" else (name, value) in pairs
            if not fine:
                found.add(name if value is None else f"{name} = {json.dumps(value, ensure_ascii=False)}")
        elif p[0] in ("all", "any", "not"):
            for x in p[1:]:
                ask(x)

    def visit(effects, context: rustlex.Context) -> None:
        for e in effects:
            if e[0] == "cfg":
                ask(e[1])
            elif e[0] == "cfg_attr":
                ask(e[1])
                if context.holds(e[1]):
                    visit(e[2], context)

    source = rustlex.Source(text)
    for c in contexts:
        gone = source.inactive(c)
        for g in source.groups:
            if not any(a <= g.start and g.end <= b and (a, b) != (g.start, g.end) for a, b in gone):
                visit(g.effects, c)
    return found
