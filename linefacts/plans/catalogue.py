"""The catalogue of runnable queries and their SQL.

Driver tables stand in for the accounting model: ``documents`` are files
(identity: digest of the text; scope: source; language: lang), ``pages`` are
paths and markup, ``lineitem`` gives lines, contexts and spans, ``labels`` an
optional measure, ``conversations`` contexts, ``events`` manifests and timings.
Cases that these tables lack come as inline rows on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefacts.functions import languages, text
from linefacts.operators import accounting, graph, incremental, ledger, lines, selection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def inline(rows: str, columns: str) -> str:
    return f"(SELECT * FROM (VALUES {rows}) t({columns}))"


def files(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return t.select("doc_id", F.md5(F.col("text").cast("binary")).alias("identity"), path.alias("path"), F.col("source").alias("scope"), F.col("lang").alias("language"), "text")


FILES = "(SELECT doc_id, md5(text) AS identity, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, source AS scope, lang AS language, text FROM documents)"
LINES = "CAST(CASE WHEN text IS NULL OR text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS BIGINT)"


def facts(spark: SparkSession, d: str) -> DataFrame:
    """A contribution for each file: blank lines are empty ones; documents have no comments; test is an optional label."""
    f = files(spark, d)
    n = text.physical_lines(F.col("text"))
    blanks = F.size(F.filter(text.lines_of(F.col("text")), lambda x: x == "")).cast("long")
    label = table(spark, d, "labels").select("doc_id", F.col("toxic").cast("long").alias("test"))
    one = f.select("doc_id", "identity", "scope", "language", F.lit(1).cast("long").alias("files"), n.alias("lines"), blanks.alias("blanks"), F.lit(0).cast("long").alias("comments"), (n - blanks).alias("code"))
    return one.join(label, "doc_id", "left")


FACTS = f"""(SELECT f.doc_id, identity, scope, language, CAST(1 AS BIGINT) AS files, lines, blanks, CAST(0 AS BIGINT) AS comments, lines - blanks AS code, CAST(l.toxic AS BIGINT) AS test
 FROM (SELECT *, {LINES} AS lines, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x = '')) - CASE WHEN text IS NULL OR text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS blanks FROM {FILES}) f
 LEFT JOIN labels l ON f.doc_id = l.doc_id)"""
SUMS = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in accounting.MEASURES)
POISON = "CASE WHEN bool_or(test IS NULL) THEN NULL ELSE CAST(coalesce(sum(test), 0) AS BIGINT) END AS test"


# --- ledger ------------------------------------------------------------------


@query(f"SELECT identity, min(path) AS rep_path, count(*) AS n_aliases, min(scope) AS scope FROM {FILES} GROUP BY identity")
def ledger_dedup(spark, d):
    return ledger.dedup(files(spark, d), least=("scope",)).select("identity", "rep_path", "n_aliases", "scope")


@query(f"SELECT identity, array_to_string(list_sort(list(DISTINCT path)), ',') AS aliases, count(*) AS n_aliases FROM {FILES} GROUP BY identity HAVING count(*) > 1")
def alias_groups(spark, d):
    return ledger.dedup(files(spark, d)).where("n_aliases > 1").select("identity", F.array_join("aliases", ",").alias("aliases"), "n_aliases")


@query(f"SELECT scope, CAST(sum({LINES}) AS BIGINT) AS lines, count(*) AS files FROM {FILES} GROUP BY scope")
def physical_lines(spark, d):
    return files(spark, d).groupBy("scope").agg(F.sum(text.physical_lines(F.col("text"))).alias("lines"), F.count(F.lit(1)).alias("files"))


EDGES = "(1, ''), (2, 'a'), (3, 'a\n'), (4, '\n'), (5, '\n\n'), (6, 'a\n\nb'), (7, 'a\r\nb\r\n'), (8, CAST(NULL AS VARCHAR(9)))"


@query(f"SELECT id, {LINES} AS lines FROM {inline(EDGES, 'id, text')}")
def physical_lines_edge(spark, d):
    return values(spark, EDGES, "id, text").select("id", text.physical_lines(F.col("text")).alias("lines"))


@query("SELECT doc_id, line_no, md5(line) AS line FROM (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line, text, len(string_split(text, chr(10))) AS n FROM documents) WHERE text <> '' AND NOT (line = '' AND line_no = n)")
def line_explode(spark, d):
    return lines.exploded(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "line_no", F.md5(F.col("line").cast("binary")).alias("line"))


@query("""SELECT doc_id, line_no, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
 CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + strlen(line) AS BIGINT) AS "end"
 FROM (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line, text, len(string_split(text, chr(10))) AS n FROM documents) WHERE text <> '' AND NOT (line = '' AND line_no = n)""")
def line_offsets(spark, d):
    return lines.with_offsets(table(spark, d, "documents"), "doc_id")


@query("""SELECT CASE WHEN trim(line) = '' THEN 'blank' WHEN starts_with(ltrim(line), '<!--') THEN 'comment' ELSE 'code' END AS kind, count(*) AS n
 FROM (SELECT unnest(string_split(html, chr(10))) AS line FROM pages) GROUP BY 1""")
def line_classify(spark, d):
    each = table(spark, d, "pages").select(F.explode(F.split("html", "\n")).alias("line"))
    return each.groupBy(lines.classified(F.col("line"), "<!--").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


CLAMP = "(1, 10, 2, 3, 5), (2, 10, 4, 8, 9), (3, 3, 5, 1, 1), (4, 10, 0, 12, 4), (5, 10, 1, 0, 0), (6, 0, 1, 1, 1)"


@query(f"""SELECT id, b AS blanks, c - (x - least(k, x)) AS comments, r - (c - (x - least(k, x))) AS code FROM (
 SELECT id, b, r, least(comments, r) AS c, least(code, r) AS k, greatest(least(comments, r) + least(code, r) - r, 0) AS x FROM (
 SELECT *, least(blanks, lines) AS b, lines - least(blanks, lines) AS r FROM {inline(CLAMP, 'id, lines, blanks, comments, code')} UNION ALL
 SELECT *, least(blanks, lines) AS b, lines - least(blanks, lines) AS r FROM (SELECT CAST(l_orderkey * 10 + l_linenumber AS INTEGER) AS id, CAST(l_quantity AS INTEGER) AS lines, l_linenumber AS blanks, CAST(floor(l_quantity / 2) AS INTEGER) AS comments, CAST(l_quantity AS INTEGER) AS code FROM lineitem)))""")
def category_clamp(spark, d):
    item = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("int").alias("id"), F.col("l_quantity").cast("int").alias("lines"), F.col("l_linenumber").alias("blanks"), F.floor(F.col("l_quantity") / 2).cast("int").alias("comments"), F.col("l_quantity").cast("int").alias("code"))
    both = values(spark, CLAMP, "id, lines, blanks, comments, code").unionByName(item)
    b, c, k = text.clamp_categories(*(F.col(x) for x in ("lines", "blanks", "comments", "code")))
    return both.select("id", b.alias("blanks"), c.alias("comments"), k.alias("code"))


# --- languages ---------------------------------------------------------------

#: Names of files, dealt to customers' folders; what each says of its language is a table on the SQL's side.
NAMES = ("BUILD", "Makefile", "CMakeLists.txt", "meson.build", "rakefile", "Snakefile", "none", "PKGBUILD", "nuget.config", "Dockerfile", "a.py", "b.js", "x.h", "x.m", "x.inc", "x.scm", "x.s", "x.S", "x.rs", "x.toml", ".py", "x.unknown", "lib.rs", "mod.rs", "GNUmakefile", "Justfile", "SConstruct")
LANGUAGES = "('build', 'Bazel'), ('makefile', 'Makefile'), ('gnumakefile', 'Makefile'), ('cmakelists.txt', 'CMake'), ('meson.build', 'Meson'), ('rakefile', 'Rakefile'), ('snakefile', 'Snakemake'), ('pkgbuild', 'Pacman Makepkg'), ('nuget.config', 'NuGet Config'), ('dockerfile', 'Dockerfile'), ('justfile', 'Just'), ('sconstruct', 'SCons')"
EXTENSIONS = "('py', 'Python'), ('js', 'JavaScript'), ('h', 'C Header'), ('m', 'Objective-C'), ('inc', 'Bitbake'), ('scm', 'Scheme'), ('s', 'GNU Style Assembly'), ('toml', 'TOML')"
NAMED = f"(SELECT c_custkey AS id, 'd' || CAST(c_custkey % 9 AS VARCHAR) || '/' || CAST(c_custkey AS VARCHAR) || '/' || list_extract({list(NAMES)}, CAST(c_custkey % {len(NAMES)} + 1 AS BIGINT)) AS path FROM customer)"


def named_paths(spark, d):
    c = table(spark, d, "customer")
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("c_custkey") % len(NAMES)).cast("int"))
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("d"), (F.col("c_custkey") % 9).cast("string"), F.lit("/"), F.col("c_custkey").cast("string"), F.lit("/"), name).alias("path"))


@query(f"SELECT id, l.language FROM {NAMED} p JOIN {inline(LANGUAGES, 'name, language')} l ON lower(regexp_extract(p.path, '[^/]*$')) = l.name")
def special_names(spark, d):
    found = named_paths(spark, d).withColumn("language", languages.language_of(F.col("path"), F.lit("")))
    return found.where(~F.element_at(F.split("path", "/"), -1).rlike(r"\.(py|js|h|m|inc|scm|s|toml)$")).where("language IS NOT NULL").select("id", "language")


@query(f"SELECT id, l.language FROM {NAMED} p LEFT JOIN {inline(EXTENSIONS, 'ext, language')} l ON regexp_extract(p.path, '[^/]\\.([^./]*)$', 1) = l.ext WHERE regexp_matches(p.path, '/[a-z]\\.[^./]*$')")
def extension_lang(spark, d):
    return named_paths(spark, d).where(F.col("path").rlike(r"/[a-z]\.[^./]*$")).select("id", languages.language_of(F.col("path"), F.lit("")).alias("language"))


#: (what interprets, its language): exact first words, and beginnings of the word after env.
EXACT = "('#!/bin/bash', 'BASH'), ('#!/bin/sh', 'Shell'), ('#!/usr/bin/perl', 'Perl'), ('#!/bin/awk -f', 'AWK')"
ENV = "('python', 'Python'), ('perl', 'Perl'), ('perl6', 'Raku'), ('bash', 'BASH')"
BANGS = ("#!/bin/bash", "#!/usr/bin/bash", "#!/usr/bin/env python3", "#!/bin/awk -f", "#!/bin/awk", "#!/usr/bin/env perl6", "#!/bin/sh -e", "no", "#!/usr/bin/perl", "#!/bin/bash -x")
HEADS = f"(SELECT p_partkey AS id, list_extract({list(BANGS)}, CAST(p_partkey % {len(BANGS)} + 1 AS BIGINT)) AS head FROM part)"


@query(f"""SELECT id, coalesce(x.language, (SELECT e.language FROM {inline(ENV, 'word, language')} e WHERE starts_with(h.head, '#!/usr/bin/env ' || e.word) ORDER BY length(e.word) DESC LIMIT 1)) AS language
 FROM {HEADS} h LEFT JOIN {inline(EXACT, 'words, language')} x ON h.head = x.words OR starts_with(h.head, x.words || ' ')""")
def shebang_lang(spark, d):
    head = F.get(F.array(*map(F.lit, BANGS)), (F.col("p_partkey") % len(BANGS)).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), languages.shebang_language(head).alias("language"))


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '\\.(html|js|css|json|xml|md|txt)$')")
def candidate_filter(spark, d):
    return table(spark, d, "pages").where(languages.is_candidate(F.col("url"))).select("page_id")


NULS = "(1, 'abc'), (2, 'a?c'), (3, '')"


@query(f"SELECT id FROM {inline(NULS, 'id, t')} WHERE NOT contains(t, '?')")
def binary_filter(spark, d):
    t = values(spark, NULS, "id, t").withColumn("t", F.replace("t", F.lit("?"), F.lit("\0")))
    return t.where(~F.contains(F.col("t"), F.lit("\0"))).select("id")


# --- ownership ---------------------------------------------------------------

PATHS = "(SELECT c_custkey AS id, r_name || '/' || n_name || '/' || CAST(c_custkey % 7 AS VARCHAR) || '/' || CAST(c_custkey AS VARCHAR) AS path, r_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def paths(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat_ws("/", "r_name", "n_name", (F.col("c_custkey") % 7).cast("string"), F.col("c_custkey").cast("string"))
    return c.select(F.col("c_custkey").alias("id"), path.alias("path"), "r_name", "n_name")


def nations(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


@query(f"SELECT id FROM {PATHS} p JOIN nation n ON p.n_name = n.n_name WHERE n.n_nationkey % 3 <> 0 OR n.n_nationkey % 2 = 0")
def boundary_filter(spark, d):
    n = nations(spark, d)
    below = n.select(F.concat_ws("/", "r_name", "n_name").alias("root"), ((F.col("n_nationkey") % 3 != 0) | (F.col("n_nationkey") % 2 == 0)).alias("selected"))
    above = n.select(F.col("r_name").alias("root"), F.lit(True).alias("selected")).distinct()
    return ledger.within_selected(paths(spark, d), above.unionByName(below), "id").select("id")


@query(f"SELECT id, CASE WHEN n.n_nationkey % 2 = 0 THEN 'n:' || p.n_name ELSE 'r:' || p.r_name END AS owner FROM {PATHS} p JOIN nation n ON p.n_name = n.n_name")
def deepest_owner(spark, d):
    n = nations(spark, d)
    deep = n.where("n_nationkey % 2 = 0").select(F.concat_ws("/", "r_name", "n_name").alias("root"), F.concat(F.lit("n:"), "n_name").alias("pkg"))
    high = n.select(F.col("r_name").alias("root"), F.concat(F.lit("r:"), "r_name").alias("pkg")).distinct()
    return ledger.deepest_owner(paths(spark, d), high.unionByName(deep), "id")


@query("SELECT l_partkey AS identity, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN CAST(min(l_suppkey) AS VARCHAR) ELSE '<root>' END AS scope FROM lineitem GROUP BY l_partkey")
def single_claimant(spark, d):
    claims = table(spark, d, "lineitem").select(F.col("l_partkey").alias("identity"), F.col("l_suppkey").cast("bigint").alias("pkg"))
    owners = claims.where("false").select("identity", F.lit("").alias("owner"))
    one = claims.groupBy("identity").agg(F.count_distinct("pkg").alias("n"), F.min("pkg").cast("string").alias("p"))
    strings = one.where("n = 1").select("identity", F.col("p").alias("pkg"))
    return ledger.resolve_scope(claims.select("identity").distinct(), owners, strings)


#: Claims of files that no scan lists.
IGNORED = "(CAST(-1 AS BIGINT)), (CAST(-2 AS BIGINT))"


@query(f"""SELECT coalesce(d.doc_id, l.doc_id) AS identity, CAST(d.doc_id IS NULL AS BOOLEAN) AS added, CAST(l.doc_id IS NOT NULL AS BOOLEAN) AS claimed
 FROM documents d FULL OUTER JOIN (SELECT doc_id FROM labels UNION ALL SELECT * FROM {inline(IGNORED, 'doc_id')}) l ON d.doc_id = l.doc_id""")
def claims_full_outer(spark, d):
    held = table(spark, d, "documents").select(F.col("doc_id").alias("identity"), F.array(F.col("doc_id").cast("string")).alias("aliases"))
    claims = table(spark, d, "labels").select("doc_id").unionByName(values(spark, IGNORED, "doc_id")).select(F.col("doc_id").alias("identity"), F.lit("x").alias("path"), F.lit("p").alias("pkg"))
    return ledger.reconcile(held, claims).select("identity", "added", (F.size("pkgs") > 0).alias("claimed"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def selected_semi(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return selection.members(table(spark, d, "customer"), ids, "c_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unselected_anti(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return selection.unmatched(table(spark, d, "customer"), ids, "c_custkey").select("c_custkey")


@query("SELECT l_partkey AS identity, count(DISTINCT l_suppkey) AS n_pkgs FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def shared_sources(spark, d):
    return ledger.shared_sources(table(spark, d, "lineitem").select(F.col("l_partkey").alias("identity"), F.col("l_suppkey").alias("pkg")))


@query(f"""SELECT identity, CASE WHEN count(*) > 1 THEN 'duplicate' END AS problem FROM {FILES} GROUP BY identity HAVING count(*) > 1 UNION ALL SELECT 'ghost', 'unknown'""")
def partition_violations(spark, d):
    f = files(spark, d)
    facts_ = f.select("identity", F.lit(1).alias("files")).unionByName(values(spark, "('ghost', 1)", "identity, files"))
    return ledger.partition_violations(f.select("identity").distinct(), facts_)


@query(f"SELECT identity, 'x' AS problem FROM {FILES} WHERE false")
def partition_clean(spark, d):
    one = files(spark, d).select("identity").distinct()
    return ledger.partition_violations(one, one.withColumn("files", F.lit(1)))


LABELS = "('p1', 'dup', 'a'), ('p2', 'dup', 'b'), ('p3', 'sole', 'c'), ('p4', 'top', ''), ('p5', 'top', 'x')"


@query(f"SELECT id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (' || CASE WHEN qualifier = '' THEN id ELSE qualifier END || ')' ELSE name END AS label FROM {inline(LABELS, 'id, name, qualifier')}")
def label_qualify(spark, d):
    return ledger.qualified_labels(values(spark, LABELS, "id, name, qualifier")).select("id", "label")


CLASH = "('q1', 'same', 'z'), ('q2', 'same', 'z'), ('q3', 'else', 'z')"


@query(f"SELECT id, CASE WHEN name = 'same' THEN 'same (z) [scope:package:' || upper(hex(id)) || ']' ELSE name END AS label FROM {inline(CLASH, 'id, name, qualifier')}")
def label_disambiguate(spark, d):
    return ledger.qualified_labels(values(spark, CLASH, "id, name, qualifier")).select("id", "label")


ROUTES = "(1, true, 'a.rs', true), (2, false, 'b.rs', true), (3, false, 'c.py', true), (4, false, 'd.bin', false)"


@query(f"SELECT id, CASE WHEN claimed THEN 'configured-rust' WHEN ends_with(path, '.rs') THEN 'unconfigured-rust' WHEN known THEN 'lexical' END AS route FROM {inline(ROUTES, 'id, claimed, path, known')}")
def route_choice(spark, d):
    return values(spark, ROUTES, "id, claimed, path, known").select("id", ledger.route(F.col("claimed"), F.array("path"), F.col("known")).alias("route"))


# --- lines and contexts ------------------------------------------------------

FLAGS = "(SELECT l_orderkey AS file, l_linenumber AS line_no, l_returnflag <> 'R' AS production, l_quantity < 5 AS blank, l_discount > 0.08 AS comment, l_quantity >= 5 AS code FROM lineitem)"


def flags(spark, d):
    t = table(spark, d, "lineitem")
    return t.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line_no"), (F.col("l_returnflag") != "R").alias("production"), (F.col("l_quantity") < 5).alias("blank"), (F.col("l_discount") > 0.08).alias("comment"), (F.col("l_quantity") >= 5).alias("code"))


MASK = f"(SELECT file, line_no, bool_or(blank) AS blank, bool_or(comment) AS comment, bool_or(code AND production) AS is_code, bool_or(code AND NOT production) AND NOT bool_or(code AND production) AS is_test FROM {FLAGS} GROUP BY file, line_no)"


@query(f"SELECT * FROM {MASK}")
def mask_production_wins(spark, d):
    return lines.production_wins(flags(spark, d), "file", "line_no")


@query(f"SELECT file, count(*) FILTER (blank OR comment OR is_code OR is_test) AS lines, count(*) FILTER (blank) AS blanks, count(*) FILTER (comment) AS comments, count(*) FILTER (is_code) AS code, count(*) FILTER (is_test) AS test FROM {MASK} GROUP BY file")
def line_totals(spark, d):
    return lines.counted(lines.production_wins(flags(spark, d), "file", "line_no"), "file")


RANGES = "(SELECT l_orderkey AS file, l_linenumber % 2 AS ctx, CAST(l_linenumber * 10 AS BIGINT) AS start, CAST(l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS BIGINT) AS \"end\" FROM lineitem)"


def ranges(spark, d):
    t = table(spark, d, "lineitem")
    s = (F.col("l_linenumber") * 10).cast("long")
    return t.select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") % 2).alias("ctx"), s.alias("start"), (s + F.col("l_quantity").cast("long")).alias("end"))


@query(f"""WITH r AS {RANGES}, f AS (SELECT DISTINCT file, ctx FROM r), e AS (
 SELECT file, ctx, start AS off, 1 AS d FROM r UNION ALL SELECT file, ctx, "end", -1 FROM r UNION ALL SELECT file, ctx, 0, 0 FROM f UNION ALL SELECT file, ctx, 200, 0 FROM f),
 g AS (SELECT file, ctx, off, sum(d) AS d FROM e GROUP BY file, ctx, off),
 w AS (SELECT file, ctx, off, sum(d) OVER (PARTITION BY file, ctx ORDER BY off) AS depth, lead(off) OVER (PARTITION BY file, ctx ORDER BY off) AS e FROM g),
 o AS (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY file, ctx ORDER BY off) = off THEN 0 ELSE 1 END AS fresh FROM w WHERE e IS NOT NULL AND depth = 0),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY file, ctx ORDER BY off) AS run FROM o)
 SELECT file, ctx, min(off) AS start, max(e) AS "end" FROM n GROUP BY file, ctx, run""")
def interval_sweep(spark, d):
    r = ranges(spark, d)
    return lines.active_spans(r, r.select("file", "ctx").distinct().withColumn("size", F.lit(200)), "file")


@query(f"""WITH t AS (SELECT file, ctx AS tok, start, "end" FROM {RANGES} WHERE ctx = 0), s AS (SELECT file, ctx AS span, start, "end" FROM {RANGES} WHERE ctx = 1)
 SELECT t.file, tok, span, greatest(t.start, s.start) AS start, least(t."end", s."end") AS "end" FROM t JOIN s ON t.file = s.file AND t.start < s."end" AND s.start < t."end" """)
def span_overlap(spark, d):
    r = ranges(spark, d)
    return lines.overlaps(r.where("ctx = 0").withColumnRenamed("ctx", "tok"), r.where("ctx = 1").withColumnRenamed("ctx", "span"), "file", "tok", "span")


SPANS = "(1, 1, 3), (2, 5, 5), (3, 2, 4)"


@query(f"SELECT id, CAST(unnest(range(first_line, last_line + 1)) AS INTEGER) AS line_no FROM {inline(SPANS, 'id, first_line, last_line')}")
def span_lines(spark, d):
    return lines.touched_lines(values(spark, SPANS, "id, first_line, last_line")).select("id", "line_no")


#: Contexts beyond one word of 63 bits.
CTX_NO = "CAST(l_linenumber * 20 + l_suppkey % 7 AS BIGINT)"


@query(f"""SELECT l_orderkey, c // 63 AS word, CAST(bit_or(CAST(1 AS BIGINT) << CAST(c % 63 AS INTEGER)) AS BIGINT) AS "any", CAST(bit_and(9223372036854775807 - (CAST(1 AS BIGINT) << CAST(c % 63 AS INTEGER))) AS BIGINT) AS "none"
 FROM (SELECT l_orderkey, {CTX_NO} AS c FROM lineitem) GROUP BY l_orderkey, c // 63""")
def bitset_ops(spark, d):
    return lines.context_bits(table(spark, d, "lineitem").withColumn("c", F.expr(CTX_NO)), "l_orderkey", "c")


# --- accounting and report ---------------------------------------------------


@query(f"SELECT scope, language, {SUMS}, {POISON} FROM {FACTS} GROUP BY scope, language")
def contributions_agg(spark, d):
    return accounting.summed(facts(spark, d), "scope", "language")


@query(f"SELECT scope, {POISON} FROM {FACTS} GROUP BY scope")
def poisoning_sum(spark, d):
    return facts(spark, d).groupBy("scope").agg(text.poisoning_sum(F.col("test")).alias("test"))


@query(f"SELECT language, {SUMS}, {POISON} FROM {FACTS} GROUP BY language")
def totals_by_language(spark, d):
    return accounting.summed(accounting.summed(facts(spark, d), "scope", "language"), "language")


@query(f"SELECT scope, language, {SUMS}, {POISON} FROM {FACTS} GROUP BY scope, language UNION ALL SELECT 'Total', 'All', {SUMS}, {POISON} FROM {FACTS}")
def grand_total(spark, d):
    return accounting.with_total(accounting.summed(facts(spark, d), "scope", "language"))


@query("SELECT 'Total' AS scope, 'All' AS language, " + ", ".join(f"CAST(0 AS BIGINT) AS {m}" for m in (*accounting.MEASURES, "test")))
def grand_total_empty(spark, d):
    return accounting.with_total(accounting.summed(facts(spark, d).where("false"), "scope", "language"))


ORDERED = f"""(SELECT *, row_number() OVER (ORDER BY scope_lines DESC, scope, lines DESC, language) AS pos FROM (
 SELECT *, CAST(sum(lines) OVER (PARTITION BY scope) AS BIGINT) AS scope_lines FROM (SELECT scope, language, {SUMS}, {POISON} FROM {FACTS} GROUP BY scope, language)))"""


@query(f"SELECT scope, language, files, lines, blanks, comments, code, test, scope_lines, CAST(pos AS INTEGER) AS pos FROM {ORDERED}")
def report_order(spark, d):
    return accounting.report_order(accounting.summed(facts(spark, d), "scope", "language"))


@query(f"SELECT CAST(pos AS INTEGER) AS pos, CASE WHEN lag(scope) OVER (ORDER BY pos) = scope THEN '' ELSE scope END AS label, language FROM {ORDERED}")
def first_row_label(spark, d):
    return accounting.first_row_labels(accounting.report_order(accounting.summed(facts(spark, d), "scope", "language"))).select("pos", "label", "language")


CELLS = "(1, 'plain'), (2, 'a\tb'), (3, 'a\nb\rc'), (4, 'x|y')"


@query(f"SELECT id, replace(replace(replace(cell, chr(13), '\\r'), chr(10), '\\n'), chr(9), '\\t') AS cell FROM {inline(CELLS, 'id, cell')}")
def sanitize_cells(spark, d):
    return values(spark, CELLS, "id, cell").select("id", text.sanitized(F.col("cell")).alias("cell"))


@query(f"SELECT CAST(to_json({{'scope': scope, 'language': language, 'counts': {{'files': files, 'lines': lines, 'blanks': blanks, 'comments': comments, 'code': code, 'test': test}}}}) AS VARCHAR) AS row FROM (SELECT scope, language, {SUMS}, {POISON} FROM {FACTS} GROUP BY scope, language)")
def json_rows(spark, d):
    rows = accounting.summed(facts(spark, d), "scope", "language")
    return rows.select(F.to_json(F.struct("scope", "language", F.struct(*accounting.MEASURES, "test").alias("counts")), {"ignoreNullFields": "false"}).alias("row"))


PART_ROWS = "SELECT scope, {lang} AS language, " + SUMS + ", {test} FROM " + FACTS + " WHERE language {op} 'en' GROUP BY scope, {lang}"


@query(PART_ROWS.format(lang="'Rust'", op="=", test=POISON).replace("GROUP BY scope, 'Rust'", "GROUP BY scope") + " UNION ALL " + PART_ROWS.format(lang="language", op="<>", test="CAST(NULL AS BIGINT) AS test"))
def package_rows(spark, d):
    """Rows of counts by package: one language's with test counts, the others' without."""
    f = facts(spark, d)
    rust_ = accounting.summed(f.where("language = 'en'"), "scope")
    return accounting.package_rows(rust_, accounting.summed(f.where("language <> 'en'"), "scope", "language").drop("test"))


# --- selection ---------------------------------------------------------------

FEATS = "('serde'), ('p1/simd'), ('p2/simd'), ('none')"
PKGS = "('i1', 'p1', 'serde,simd'), ('i2', 'p2', 'serde')"


@query(f"""WITH p AS (SELECT id, name, unnest(string_split(fs, ',')) AS f FROM {inline(PKGS, 'id, name, fs')}), r AS (SELECT request, CASE WHEN contains(request, '/') THEN split_part(request, '/', 1) END AS pkg, CASE WHEN contains(request, '/') THEN split_part(request, '/', 2) ELSE request END AS f FROM {inline(FEATS, 'request')})
 SELECT request, id FROM r LEFT JOIN p ON r.f = p.f AND (r.pkg IS NULL OR r.pkg = p.name)""")
def feature_requests(spark, d):
    p = values(spark, PKGS, "id, name, fs").select("id", "name", text.split_features(F.col("fs")).alias("features"))
    return selection.requested_features(values(spark, FEATS, "request"), p)


LISTS = "(1, 'a,b a'), (2, ''), (3, ' z,, y'), (4, 'one')"


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(s, '[, ]'), lambda x: x <> ''))), ',') AS features FROM {inline(LISTS, 'id, s')}")
def feature_split(spark, d):
    return values(spark, LISTS, "id, s").select("id", F.array_join(text.split_features(F.col("s")), ",").alias("features"))


KINDS = "('lib', 'production'), ('lib', 'test'), ('build-script', 'production'), ('bench', 'bench')"


@query(f"""SELECT DISTINCT n_name AS target, kind, CASE WHEN kind = 'build-script' THEN 'host' ELSE r_name END AS triple, CASE WHEN kind = 'build-script' THEN 'host' ELSE 'target' END AS role,
 CASE WHEN context = 'production' THEN 'production' ELSE 'test' END AS provenance FROM nation CROSS JOIN {inline(KINDS, 'kind, context')} CROSS JOIN region""")
def context_cross(spark, d):
    t = table(spark, d, "nation").select(F.col("n_name").alias("target")).crossJoin(values(spark, KINDS, "kind, context")).withColumn("crate_type", F.lit("lib"))
    return selection.contexts(t, table(spark, d, "region").select(F.col("r_name").alias("triple")))


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def target_context_join(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return selection.with_contexts(table(spark, d, "lineitem"), orders, "l_orderkey").select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("SELECT DISTINCT conv_id, role, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY role) - 1 AS INTEGER) AS ctx_id FROM conversations")
def intern_contexts(spark, d):
    return selection.interned(table(spark, d, "conversations"), "conv_id", "role")


@query("SELECT DISTINCT c_custkey AS id FROM customer WHERE (c_custkey % 2 = 0 OR c_custkey % 3 = 0) AND c_custkey % 5 <> 0")
def selection_setops(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return selection.selected(c.where("id % 2 = 0"), c.where("id % 3 = 0"), c.where("id % 5 = 0"))


#: Kinds of targets, dealt to customers, and their contexts.
KIND_OF = "list_extract(['lib', 'bin', 'test', 'example', 'bench'], CAST(c_custkey % 5 + 1 AS BIGINT))"
TARGETS = f"(SELECT c_custkey AS id, 't' || CAST(c_custkey % 11 AS VARCHAR) AS target, {KIND_OF} AS kind, CASE {KIND_OF} WHEN 'test' THEN ['test'] WHEN 'bench' THEN ['bench'] ELSE ['production', 'test', 'bench'] END AS contexts FROM customer)"
RULES = "('test', CAST(NULL AS VARCHAR(9))), ('example', CAST(NULL AS VARCHAR(9))), ('bin', 't3')"


@query(f"""SELECT id, kind, array_to_string(list_filter(contexts, lambda x: x <> 'test'), ',') AS contexts FROM {TARGETS}
 WHERE kind <> 'example' AND NOT (kind = 'bin' AND target = 't3') AND len(list_filter(contexts, lambda x: x <> 'test')) > 0""")
def target_exclusions(spark, d):
    c = table(spark, d, "customer")
    kind = F.get(F.array(*map(F.lit, ("lib", "bin", "test", "example", "bench"))), (F.col("c_custkey") % 5).cast("int"))
    all_ = F.array(F.lit("production"), F.lit("test"), F.lit("bench"))
    t = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("t"), (F.col("c_custkey") % 11).cast("string")).alias("target"), kind.alias("kind")).withColumn("contexts", F.when(F.col("kind").isin("test", "bench"), F.array("kind")).otherwise(all_))
    return selection.less_exclusions(t, values(spark, RULES, "kind, name")).select("id", "kind", F.array_join("contexts", ",").alias("contexts"))


REQ = "(1, 'a,b', 'a'), (2, 'a', 'a,b'), (3, '', ''), (4, 'x,y', 'z')"


@query(f"SELECT id, array_to_string(list_sort(list_filter(string_split(need, ','), lambda x: x <> '' AND NOT list_contains(string_split(have, ','), x))), ',') AS missing FROM {inline(REQ, 'id, need, have')}")
def required_missing(spark, d):
    t = values(spark, REQ, "id, need, have")
    return t.select("id", F.array_join(selection.missing_features(text.split_features(F.col("need")), text.split_features(F.col("have"))), ",").alias("missing"))


GLOBS = "('test_a'), ('test_b'), ('x.test'), ('testing'), ('tent')"


@query(f"SELECT name FROM {inline(GLOBS, 'name')} WHERE name LIKE 'te_t%' ")
def target_glob(spark, d):
    return values(spark, GLOBS, "name").where(F.col("name").rlike(selection.glob_pattern("te?t*")))


WARN_A, WARN_B = "('unknown-cfg', 'x'), ('unmodeled-rustflags', 'y')", "('source-identity', 'z'), ('unknown-cfg', 'x')"


@query(f"SELECT * FROM {inline(WARN_A, 'code, message')} UNION ALL SELECT * FROM {inline(WARN_B, 'code, message')}")
def warnings_union(spark, d):
    return accounting.united(values(spark, WARN_A, "code, message"), values(spark, WARN_B, "code, message"))


RES = "(1, CAST(NULL AS INTEGER), '2024'), (2, CAST(NULL AS INTEGER), '2021'), (3, CAST(NULL AS INTEGER), '2018'), (4, 1, '2024'), (5, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR(9)))"


@query(f"SELECT id, CAST(coalesce(explicit, CASE edition WHEN '2024' THEN 3 WHEN '2021' THEN 2 ELSE 1 END) AS INTEGER) AS resolver FROM {inline(RES, 'id, explicit, edition')}")
def resolver_default(spark, d):
    return values(spark, RES, "id, explicit, edition").select("id", text.resolver_version(F.col("explicit"), F.col("edition")).alias("resolver"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'n' || CAST(p_partkey AS VARCHAR) ELSE 'feature = "' || replace(replace(p_name || chr(92) || '"', chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' END AS shown FROM part""")
def cfg_format(spark, d):
    even = F.col("p_partkey") % 2 == 0
    name = F.when(even, F.concat(F.lit("n"), F.col("p_partkey").cast("string"))).otherwise("feature")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.cfg_text(name, F.when(~even, F.concat("p_name", F.lit('\\"')))).alias("shown"))


@query(f"SELECT id, CASE WHEN regexp_matches(path, '/mod\\.rs$') THEN regexp_replace(path, '/mod\\.rs$', '') ELSE regexp_replace(path, '\\.[^./]*$', '') END AS base FROM {NAMED} WHERE regexp_matches(path, '\\.rs$')")
def child_bases(spark, d):
    return named_paths(spark, d).where(F.col("path").endswith(".rs")).select("id", text.child_base(F.col("path")).alias("base"))


@query("SELECT c_custkey AS id, '/a/' || CASE c_custkey % 4 WHEN 0 THEN 'x' || CAST(c_custkey AS VARCHAR) WHEN 1 THEN CAST(c_custkey AS VARCHAR) WHEN 2 THEN 'x' ELSE 'x/z' END AS path FROM customer")
def normalized_paths(spark, d):
    """Paths with ``.``, ``..`` and empty parts."""
    k = F.col("c_custkey").cast("string")
    c = F.col("c_custkey") % 4
    path = F.when(c == 0, F.concat(F.lit("/a/./x"), k)).when(c == 1, F.concat(F.lit("/../a//y/../"), k)).when(c == 2, F.concat(F.lit("/a/x/"), k, F.lit("/.."))).otherwise(F.concat(F.lit("/b/../a/x/"), k, F.lit("/../z/")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.normalized(path).alias("path"))


@query("SELECT p_partkey AS id, 'n' || CAST(p_partkey AS VARCHAR) AS name FROM part")
def plain_identifiers(spark, d):
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, "r#n").otherwise("n"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.plain_identifier(raw).alias("name"))


@query(f"SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'bin' WHEN 1 THEN 'cdylib' ELSE 'lib' END AS crate_type FROM customer")
def crate_types(spark, d):
    c = F.col("c_custkey") % 3
    types = F.when(c == 1, F.array(F.lit("cdylib"), F.lit("rlib"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.crate_type(F.when(c == 0, "build-script").otherwise("lib"), types).alias("crate_type"))


@query("SELECT l_partkey AS path FROM lineitem UNION SELECT ps FROM (SELECT l_suppkey AS ps FROM lineitem) UNION SELECT o_orderkey FROM orders")
def dependency_union(spark, d):
    t = table(spark, d, "lineitem")
    return incremental.dependencies(t.select(F.col("l_partkey").cast("long").alias("path")), t.select(F.col("l_suppkey").cast("long").alias("path")), table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("path")))


@query("SELECT md5(text) AS key, CAST(length(text) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL GROUP BY text")
def results_swept(spark, d):
    """Results by content: those of some languages are in the cache already, with others that nothing asks for."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select(F.md5(F.col("text").cast("binary")).alias("key"), "text", "lang")
    count = lambda rows: rows.select("key", F.length("text").cast("long").alias("n"))
    cache = count(t.where("lang = 'en'").dropDuplicates(["key"])).unionByName(values(spark, "('gone', CAST(1 AS BIGINT))", "key, n"))
    return incremental.swept(cache, t, count, "key")


@query(f"""WITH f AS (SELECT id, path || CASE WHEN id % 4 = 0 THEN '.rs' ELSE '.txt' END AS path, r_name, n_name FROM {PATHS}), n AS (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)
 SELECT path, r_name AS owner FROM f WHERE id % 4 <> 0 AND n_name NOT IN (SELECT n_name FROM n) AND r_name IN (SELECT r_name FROM region WHERE r_regionkey % 2 = 0)""")
def package_projection(spark, d):
    """Files of the packages at every other region; every other nation's folder has a manifest of its own, in no package."""
    rs = F.when(F.col("id") % 4 == 0, ".rs").otherwise(".txt")
    f = paths(spark, d).select(F.concat("path", rs).alias("path"))
    packages = table(spark, d, "region").where("r_regionkey % 2 = 0").select(F.col("r_name").alias("root"), F.col("r_name").alias("pkg"))
    manifests = nations(spark, d).where("n_nationkey % 2 = 0").select(F.concat_ws("/", "r_name", "n_name").alias("folder")).unionByName(packages.select(F.col("root").alias("folder")))
    return ledger.package_projection(f, packages, manifests)


# --- graph -------------------------------------------------------------------

GRAPH = "(SELECT DISTINCT CAST(l_partkey AS BIGINT) AS src, CAST(l_suppkey AS BIGINT) AS dst FROM lineitem)"


@query(f"WITH RECURSIVE e AS {GRAPH}, r AS (SELECT CAST(l_partkey AS BIGINT) AS root, CAST(l_partkey AS BIGINT) AS node FROM lineitem WHERE l_orderkey = 1 UNION SELECT r.root, e.dst FROM r JOIN e ON r.node = e.src) SELECT root, node FROM r")
def reachability(spark, d):
    """What the parts of the first order reach over all lineitems, part to supplier; a supplier's key is a part's key too."""
    t = table(spark, d, "lineitem")
    e = t.select(F.col("l_partkey").cast("long").alias("src"), F.col("l_suppkey").cast("long").alias("dst"))
    first = t.where("l_orderkey = 1").select(F.col("l_partkey").cast("long").alias("root"), F.col("l_partkey").cast("long").alias("node"))
    return graph.reachable(e, first)


#: Every part is a module that some files may hold; a seventh has an explicit path.
FOUND = "(SELECT p_partkey AS id, p_partkey % 7 = 0 AS own, p_partkey % 2 = 0 OR p_partkey % 7 = 0 AS plain, p_partkey % 3 = 0 AND p_partkey % 7 <> 0 AS nested FROM part)"


@query(f"""SELECT id, CASE WHEN own THEN 'o/' || CAST(id AS VARCHAR) || '.rs' WHEN plain AND nested OR NOT plain AND NOT nested THEN NULL WHEN plain THEN 'src/m' || CAST(id AS VARCHAR) || '.rs' ELSE 'src/m' || CAST(id AS VARCHAR) || '/mod.rs' END AS path,
 CASE WHEN own THEN NULL WHEN plain AND nested THEN 'ambiguous' WHEN NOT plain AND NOT nested THEN 'not-found' END AS problem FROM {FOUND}""")
def module_resolution(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("k"))
    own = F.col("id") % 7 == 0
    declared = p.select("id", F.lit("src").alias("base"), F.concat(F.lit("m"), "k").alias("name"), F.when(own, F.concat(F.lit("o/"), "k", F.lit(".rs"))).alias("explicit"))
    have = [p.where(own).select(F.concat(F.lit("o/"), "k", F.lit(".rs")).alias("path")), p.where("id % 2 = 0 OR id % 7 = 0").select(F.concat(F.lit("src/m"), "k", F.lit(".rs")).alias("path")), p.where("id % 3 = 0").select(F.concat(F.lit("src/m"), "k", F.lit("/mod.rs")).alias("path"))]
    return graph.module_files(declared, have[0].unionByName(have[1]).unionByName(have[2]))


# --- incremental -------------------------------------------------------------

HALF = "(SELECT ts FROM events ORDER BY event_id LIMIT 1)"


@query("""SELECT coalesce(b.user_id, a.user_id) AS path, CASE WHEN b.user_id IS NULL THEN 'added' WHEN a.user_id IS NULL THEN 'removed' WHEN a.stamp = b.stamp THEN 'unchanged' ELSE 'changed' END AS change
 FROM (SELECT user_id, max(event_id) AS stamp FROM events WHERE event_id % 2 = 0 GROUP BY user_id) b FULL OUTER JOIN (SELECT user_id, max(event_id) AS stamp FROM events WHERE event_id % 2 = 1 OR user_id % 3 = 0 GROUP BY user_id) a ON a.user_id = b.user_id""")
def manifest_diff(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("path"), "event_id")
    stamp = lambda df: df.groupBy("path").agg(F.max("event_id").alias("stamp"))
    return incremental.manifest_diff(stamp(e.where("event_id % 2 = 0")), stamp(e.where("event_id % 2 = 1 OR path % 3 = 0")))


PRINTED = """WITH f AS (SELECT sha256(CAST(length(path) AS VARCHAR) || chr(0) || path || chr(0) || sha256(coalesce(text, ''))) AS d FROM FILES_)
SELECT sha256('POLICY_' || '|' || CAST(count(*) AS VARCHAR) || '|' || PARTS_) AS fingerprint FROM f"""


@query(PRINTED.replace("FILES_", FILES).replace("POLICY_", incremental.POLICY).replace("PARTS_", " || '|' || ".join(f"CAST(sum(CAST(CAST('0x' || substr(d, {1 + 15 * i}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(4))))
def fingerprint(spark, d):
    return incremental.fingerprint(files(spark, d), "path", "text")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS peak, count(*) AS n FROM events GROUP BY event_type")
def phase_percentiles(spark, d):
    return accounting.percentiles(table(spark, d, "events"), "event_type", "value")


# --- Rust and lexical sources: goldens, whose SQL holds counts worked out by hand, and sources made of the documents, whose counts SQL works out

from linefacts.operators import rust  # noqa: E402

#: (path, text): small sources whose lines are counted by hand below.
RUST = (
    ("a.rs", "// one\nfn live() {}\n\n#[cfg(any())]\nfn gone() {}\n#[cfg(test)]\nmod tests {\n    fn t() {}\n}\n"),
    ("b.rs", "struct S {\n    #[cfg(feature = \"x\")]\n    x: u8,\n    y: u8, // kept\n}\n"),
    ("c.rs", "const T: &str = r#\"// no comment\n\n\"#;\n/* a\n\n /* b */ */\n"),
    ("d.rs", "#![cfg(windows)]\nfn w() {}\n"),
    ("e.rs", ""),
    ("f.rs", "fn m(v: u8) {\n    match v {\n        #[cfg(any())]\n        0 => (),\n        _ => (),\n    }\n}\n"),
)
CTX = "array(struct(0 AS ctx_id, CAST(array() AS ARRAY<STRING>) AS options, false AS test, true AS harness), struct(1 AS ctx_id, array('test') AS options, true AS test, true AS harness))"


def rust_files(spark):
    return spark.createDataFrame(RUST, "path string, text string").withColumn("contexts", F.expr(CTX))


@query("SELECT path, files, lines, blanks, comments, code, test FROM (VALUES ('a.rs', 1, 7, 1, 1, 1, 4), ('b.rs', 1, 3, 0, 1, 3, 0), ('c.rs', 1, 6, 0, 3, 3, 0), ('d.rs', 1, 0, 0, 0, 0, 0), ('e.rs', 1, 0, 0, 0, 0, 0), ('f.rs', 1, 5, 0, 0, 5, 0)) t(path, files, lines, blanks, comments, code, test)".replace("SELECT path, files, lines, blanks, comments, code, test", "SELECT path, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("files", "lines", "blanks", "comments", "code", "test"))))
def rust_goldens(spark, d):
    return rust.with_counts(rust_files(spark))


@query("SELECT path, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("files", "lines", "blanks", "comments", "code", "test")) + " FROM (VALUES ('a.rs', 1, 9, 1, 1, 7, NULL), ('b.rs', 1, 5, 0, 1, 5, NULL), ('c.rs', 1, 6, 0, 3, 3, NULL), ('d.rs', 1, 2, 0, 0, 2, NULL), ('e.rs', 1, 0, 0, 0, 0, NULL), ('f.rs', 1, 7, 0, 0, 7, NULL)) t(path, files, lines, blanks, comments, code, test)")
def rust_unconfigured_goldens(spark, d):
    return rust.with_counts(rust_files(spark).withColumn("contexts", F.lit(None).cast(rust.CONTEXTS)))


@query("SELECT path, CAST(lines AS BIGINT) AS lines, CAST(code AS BIGINT) AS code, CAST(test AS BIGINT) AS test FROM (VALUES ('a.rs', 7, 1, 4), ('b.rs', 3, 3, 0), ('c.rs', 6, 3, 0), ('f.rs', 5, 5, 0)) t(path, lines, code, test)")
def rust_context_goldens(spark, d):
    """The same counts by the relational way: line flags of every context, joined by line."""
    return lines.counted(lines.production_wins(rust.line_flags(rust_files(spark)), "path", "line_no"), "path").select("path", "lines", "code", "test")


TREE = (
    ("src/lib.rs", "mod a;\n#[cfg(any())]\nmod never;\n#[path = \"odd/b.rs\"]\nmod b;\nmod inner { mod deep; }\n#[cfg(test)]\nmod only;\n"),
    ("src/a.rs", "mod sub;\n"),
    ("src/a/sub/mod.rs", "fn f() {}\n"),
    ("src/odd/b.rs", "\n"),
    ("src/inner/deep.rs", "\n"),
    ("src/only.rs", "\n"),
    ("src/never.rs", "\n"),
)


@query("SELECT path, CAST(n AS BIGINT) AS n FROM (VALUES ('src/lib.rs', 2), ('src/a.rs', 2), ('src/a/sub/mod.rs', 2), ('src/odd/b.rs', 2), ('src/inner/deep.rs', 2), ('src/only.rs', 1)) t(path, n)")
def module_goldens(spark, d):
    tree = spark.createDataFrame(TREE, "path string, text string")
    roots = tree.where("path = 'src/lib.rs'").select("path", F.explode(F.expr(CTX)).alias("c")).select("path", "c.*")
    return rust.reachable_files(tree, roots).groupBy("path").agg(F.count_distinct("ctx_id").alias("n"))


#: Every document as a Rust file: its lines as comments, a blank line, a function, and by its id a test and a function that never is.
MADE = (("3", "#[cfg(test)]\nfn t() {}\n"), ("5", "#[cfg(any())]\nfn gone() {}\n"))
FEEDS = "CAST(1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS BIGINT)"


def made_rust(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("body"))
    more = [F.when(F.col("doc_id") % int(m) == 0, x).otherwise("") for m, x in MADE]
    return t.select("path", F.concat(F.lit("// "), F.replace("body", F.lit("\n"), F.lit("\n// ")), F.lit("\n\nfn p() {}\n"), *more).alias("text"), F.expr(CTX).alias("contexts"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS path, CAST(1 AS BIGINT) AS files, {FEEDS} + 2 + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS lines, CAST(1 AS BIGINT) AS blanks, {FEEDS} AS comments, CAST(1 AS BIGINT) AS code, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS test FROM documents")
def rust_line_counts(spark, d):
    return rust.with_counts(made_rust(spark, d))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS path, CAST(1 AS BIGINT) AS files, {FEEDS} + 2 + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS lines, CAST(1 AS BIGINT) AS blanks, {FEEDS} AS comments, CAST(1 + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS BIGINT) AS code, CAST(NULL AS BIGINT) AS test FROM documents")
def rust_unconfigured(spark, d):
    return rust.with_counts(made_rust(spark, d).withColumn("contexts", F.lit(None).cast(rust.CONTEXTS)))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS path, {FEEDS} + 2 + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS lines, CAST(1 AS BIGINT) AS code, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS test FROM documents")
def rust_lines_by_context(spark, d):
    """The same counts by the relational way: line flags of every context, joined by line."""
    return lines.counted(lines.production_wins(rust.line_flags(made_rust(spark, d)), "path", "line_no"), "path").select("path", "lines", "code", "test")


@query("""SELECT 'src/lib.rs' AS path, CAST(2 AS BIGINT) AS n UNION ALL SELECT 'src/n' || CAST(n_nationkey AS VARCHAR) || '.rs', CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END FROM nation
 UNION ALL SELECT 'src/n' || CAST(c_nationkey AS VARCHAR) || '/c' || CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 3 = 0 THEN '/mod.rs' ELSE '.rs' END, CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE 1 END FROM customer WHERE c_custkey % 5 <> 0""")
def module_graph(spark, d):
    """A tree of modules: nations under a library, every other one for tests alone, and customers under nations, every fifth of them never."""
    n, c = table(spark, d, "nation").select("n_nationkey"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    joined = lambda x, by: F.array_join(F.array_sort(F.collect_list(x)), "\n").alias("text")
    top = n.agg(joined(F.concat(F.when(F.col("n_nationkey") % 2 == 1, "#[cfg(test)] mod n").otherwise("mod n"), F.col("n_nationkey").cast("string"), F.lit(";")), None)).select(F.lit("src/lib.rs").alias("path"), "text")
    declared = F.concat(F.when(F.col("c_custkey") % 5 == 0, "#[cfg(any())] mod c").otherwise("mod c"), F.col("c_custkey").cast("string"), F.lit(";"))
    mid = n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_nationkey").agg(joined(declared, None)).select(F.concat(F.lit("src/n"), F.col("n_nationkey").cast("string"), F.lit(".rs")).alias("path"), "text")
    low = c.select(F.concat(F.lit("src/n"), F.col("c_nationkey").cast("string"), F.lit("/c"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "/mod.rs").otherwise(".rs")).alias("path"), F.lit("fn f() {}\n").alias("text"))
    tree = top.unionByName(mid).unionByName(low)
    roots = spark.range(1).select(F.lit("src/lib.rs").alias("path"), F.explode(F.expr(CTX)).alias("c")).select("path", "c.*")
    return rust.reachable_files(tree, roots).groupBy("path").agg(F.count_distinct("ctx_id").alias("n"))


#: Predicates, dealt to orders by key; an order's options are its status and whether it is urgent.
ASKED = ("any(all(f, not(all(urgent, any()))), all(f, urgent))", "not(any(f, urgent))", "all()", "any()", 'all(status = "O", not(urgent))')


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN f AND (NOT (u AND false)) OR f AND u WHEN 1 THEN NOT (f OR u) WHEN 2 THEN true WHEN 3 THEN false ELSE o_orderstatus = 'O' AND NOT u END AS holds
 FROM (SELECT *, o_orderstatus = 'F' AS f, o_orderkey % 3 = 0 AS u FROM orders)""")
def cfg_truth(spark, d):
    """Predicates over option sets: nested, negated, key-value, and the empty all and any."""
    p = F.get(F.array(*map(F.lit, ASKED)), (F.col("o_orderkey") % len(ASKED)).cast("int"))
    options = F.filter(F.array(F.when(F.col("o_orderstatus") == "F", "f"), F.when(F.col("o_orderkey") % 3 == 0, "urgent"), F.concat(F.lit("status="), "o_orderstatus")), lambda x: x.isNotNull())
    rows = table(spark, d, "orders").select("o_orderkey", p.alias("p"), options.alias("options"))
    return rust.held_predicates(rows, "p", "options", "holds").select("o_orderkey", "holds")


@query("SELECT 'p' || CAST(n_regionkey AS VARCHAR) AS pkg, 'n' || CAST(n_nationkey AS VARCHAR) AS predicate FROM nation WHERE n_nationkey % 2 = 0")
def unknown_cfgs(spark, d):
    """Every nation asks for an option; odd ones are known, and features are declared."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey").cast("string")
    text_ = F.concat(F.lit('#[cfg(any(unix, feature = "f", n'), k, F.lit(", not(target_os = \"linux\")))]\nfn f() {}\n#[cfg(any())]\nmod gone { #[cfg(never)] fn g() {} }\n"))
    rows = n.select(F.concat(F.lit("p"), F.col("n_regionkey").cast("string")).alias("pkg"), k.alias("path"), text_.alias("text"), F.expr(CTX).alias("contexts"))
    known = frozenset({"unix", *(f"n{i}" for i in range(1, 99, 2))}), frozenset({("target_os", "linux")}), frozenset({"f"})
    return rust.unknown_cfgs(rows, {f"p{r.n_regionkey}": known for r in n.select("n_regionkey").distinct().collect()})  # five regions


# --- whole counts and resolutions; goldens, worked out by hand -------------------

#: A workspace: a reaches into b and has an ignored module; c's package is named as a's; o.py belongs to nobody.
WORKSPACE = {
    "Cargo.toml": "[workspace]\nmembers = [\"a\", \"b\", \"c\"]\nresolver = \"2\"\n",
    "a/Cargo.toml": "[package]\n",
    "a/.gitignore": "gen.rs\n",
    "a/src/lib.rs": "#[cfg(unix)]\nfn u() {}\n#[cfg(windows)]\nfn w() {}\n#[cfg(feature = \"x\")]\nmod x;\n#[path = \"../../b/src/shared.rs\"]\nmod shared;\nmod gen;\n",
    "a/src/x.rs": "fn x() {}\n",
    "a/src/gen.rs": "fn g() {}\n",
    "b/Cargo.toml": "[package]\n",
    "b/src/lib.rs": "mod shared;\n#[cfg(test)]\nfn t() {}\n",
    "b/src/shared.rs": "fn s() {}\n",
    "c/Cargo.toml": "[package]\n",
    "c/src/lib.rs": "fn c() {}\n",
    "o.py": "1\n2\n",
}


def workspace_rows(spark, *argv):
    """Report rows of the workspace for a command line, by label."""
    import os
    import tempfile

    from linefacts.plans import count, request
    from linefacts.plans.configure import configure
    from linefacts.plans.discover import discover
    from linefacts.sources import workdir
    from linefacts.sources.toolchain import Captured

    top = workdir.new_path(spark, "workspace").removeprefix("file://").removeprefix("file:")
    root = os.path.realpath(top if "://" not in top else tempfile.mkdtemp())
    for path, content in WORKSPACE.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write(content)
    package = lambda i, name, folder, features: {"id": i, "name": name, "version": "1.0.0", "edition": "2021", "manifest_path": f"{root}/{folder}/Cargo.toml", "features": features, "targets": [{"name": name, "kind": ["lib"], "crate_types": ["lib"], "src_path": f"{root}/{folder}/src/lib.rs", "edition": "2021"}]}
    tool = Captured({"workspace_root": root, "workspace_members": ["ia", "ib", "ic"], "packages": [package("ia", "a", "a", {"x": []}), package("ib", "b", "b", {}), package("ic", "a", "c", {})]})
    s = request.selection(request.parser().parse_args([*argv, root]))
    configured = configure(s, discover(s, tool), tool)
    facts_ = count.counted(spark, root, configured, s.root_files).facts
    rows = accounting.summed(facts_, "scope", "language").join(count.scopes_of(spark, root, configured), "scope")
    return rows.select(F.col("label").alias("scope"), "language", "files", "lines", "code", "test")


def golden_rows(*rows: tuple) -> str:
    return "SELECT scope, language, CAST(files AS BIGINT) AS files, CAST(lines AS BIGINT) AS lines, CAST(code AS BIGINT) AS code, CAST(test AS BIGINT) AS test FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in rows) + ") t(scope, language, files, lines, code, test)"


@query(golden_rows(("a (a)", "Rust", 3, 9, 9, 0), ("a (a)", "TOML", 1, 1, 1, None), ("b", "Rust", 2, 4, 2, 2), ("b", "TOML", 1, 1, 1, None), ("a (c)", "Rust", 1, 1, 1, 0), ("a (c)", "TOML", 1, 1, 1, None), ("<root>", "Python", 1, 2, 2, None), ("<root>", "TOML", 1, 3, 3, None)))
def workspace_goldens(spark, d):
    """Every package with all features: cfg(unix) holds and cfg(windows) doesn't, ignored modules count, shared ones count where they lie."""
    return workspace_rows(spark)


@query(golden_rows(("a (a)", "Rust", 4, 10, 10, 0), ("a (a)", "TOML", 1, 1, 1, None), ("a (c)", "Rust", 1, 1, 1, 0), ("a (c)", "TOML", 1, 1, 1, None), ("<root>", "Python", 1, 2, 2, None), ("<root>", "TOML", 1, 3, 3, None)))
def excluded_package_goldens(spark, d):
    """Without b: its files are nobody's and don't count, but for the one that a alone reaches, which is a's."""
    return workspace_rows(spark, "--workspace", "--exclude", "b")


@query(golden_rows(("a", "Rust", 3, 7, 7, 0), ("a", "Rust (unconfigured)", 1, 1, 1, None), ("a", "TOML", 1, 1, 1, None)))
def named_package_goldens(spark, d):
    """The package a alone, without features, for Windows: x.rs is reached by nothing."""
    return workspace_rows(spark, "-p", "ia", "--no-default-features", "--target", "x86_64-pc-windows-msvc")


SIDES = ((1, "target", "build,dev,normal,unix,windows"), (1, "host", "build,dev,normal,unix,windows"), (2, "target", "dev,normal,unix"), (2, "host", "build"), (3, "target", "dev,normal,unix"), (3, "host", "build"))


@query("SELECT CAST(resolver AS INTEGER) AS resolver, side, features FROM (VALUES " + ", ".join(map(str, SIDES)) + ") t(resolver, side, features)")
def resolver_goldens(spark, d):
    """A dependency that a package asks for five features in five ways, as each resolver sees it on either platform."""
    from linefacts.plans import features
    from linefacts.sources.toolchain import options_of_triple

    ask = lambda feature, **how: {"name": "shared", "features": [feature], "uses_default_features": False, "kind": None, "target": None, **how}
    asks = [ask("normal"), ask("dev", kind="dev"), ask("build", kind="build"), ask("unix", target="cfg(unix)"), ask("windows", target="cfg(windows)")]
    doc = {"packages": [{"id": "app", "name": "app", "features": {}, "targets": [], "dependencies": asks}, {"id": "shared", "name": "shared", "features": {a["features"][0]: [] for a in asks}, "targets": [], "dependencies": []}]}
    triple = "x86_64-unknown-linux-gnu"
    sides = dict.fromkeys((features.HOST, features.TARGET), (triple, options_of_triple(triple)))
    rows = []
    for resolver in (1, 2, 3):
        build = features.resolve(doc, resolver, True, {"app": set()}, sides)
        rows += [(resolver, side, ",".join(sorted(build.features("shared", side)))) for side in (features.TARGET, features.HOST)]
    return spark.createDataFrame(rows, "resolver int, side string, features string")


SOURCES = (
    ("x.js", b"// c\n\nlet a = 1; // d\n", "JavaScript"),
    ("run", b"#!/usr/bin/env python3\nprint(1)\n", "Python"),
    ("p.html", b"<p>\n<!-- c -->\n</p>\n", "HTML"),
    ("n.c", b"int a;\0\n", "C"),
    ("u.py", b"\xff = 1\n", "Python"),
    ("r.md", b"# t\n\ntext\n", "Markdown"),
    ("s.c", b"/* a\n\n b */\nchar *s = \"/* no */\";\n", "C"),
)


@query("SELECT path, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("lines", "blanks", "comments", "code")) + " FROM (VALUES ('x.js', 3, 1, 1, 1), ('run', 2, 0, 1, 1), ('p.html', 3, 0, 1, 2), ('u.py', 1, 0, 0, 1), ('r.md', 3, 1, 2, 0), ('s.c', 4, 0, 3, 1)) t(path, lines, blanks, comments, code)")
def lexical_goldens(spark, d):
    t = spark.createDataFrame(SOURCES, "path string, bytes binary, language string")
    return languages.with_lexical_counts(t).select("path", "lines", "blanks", "comments", "code")


#: Every document as a source of one of these languages: (language, what begins a comment).
MARKS = (("Python", "# "), ("JavaScript", "// "), ("SQL", "-- "))


@query(f"SELECT doc_id, {FEEDS} + 2 AS lines, CAST(1 AS BIGINT) AS blanks, {FEEDS} AS comments, CAST(1 AS BIGINT) AS code FROM documents")
def lexical_counts(spark, d):
    pick = lambda k: F.get(F.array(*(F.lit(m[k]) for m in MARKS)), (F.col("doc_id") % len(MARKS)).cast("int"))
    t = table(spark, d, "documents").withColumn("mark", pick(1))
    body = F.concat("mark", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.concat(F.lit("\n"), "mark")), F.lit("\n\nx\n"))
    return languages.with_lexical_counts(t.select("doc_id", body.cast("binary").alias("bytes"), pick(0).alias("language"))).select("doc_id", "lines", "blanks", "comments", "code")


@query(f"SELECT scope, language, count(*) AS files, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes, CAST(sum({LINES}) AS BIGINT) AS lines FROM {FILES} GROUP BY scope, language")
def tree_scan(spark, d):
    """A tree with a file for every document, some that ignore files hide and some in folders that are never part of a tree."""
    from linefacts.sources import workdir
    from linefacts.sources.tree import TreeSource

    workdir.ship(spark)
    root = workdir.new_path(spark, "made-tree").removeprefix("file://").removeprefix("file:")
    if "://" in root:
        raise workdir.NoSharedFolder("a source tree is in a file system that all machines mount; spark.checkpoint.dir is elsewhere")

    def put(batches):
        import os

        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                for path in (f"{r['scope']}/{r['language']}/{r['doc_id']}.txt", *((f"target/{r['doc_id']}", f"{r['scope']}/{r['doc_id']}.log") if r["doc_id"] % 100 == 0 else ())):
                    os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
                    with open(f"{root}/{path}", "wb") as f:
                        f.write((r["text"] or "").encode())
            with open(f"{root}/.ignore", "w") as f:
                f.write("*.log\n")
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    files(spark, d).select("doc_id", "scope", "language", "text").mapInArrow(put, "n long").agg(F.sum("n")).collect()
    spark.dataSource.register(TreeSource)
    tree = spark.read.format("tree").load(root).where("NOT outside AND NOT ignored AND path <> '.ignore'")
    # Files are told apart by device and inode; each has a path here.
    one = tree.groupBy("dev", "ino").agg(F.min("path").alias("path"), F.first("bytes").alias("bytes"))
    part = F.split("path", "/")
    n = text.physical_lines(F.decode("bytes", "ISO-8859-1"))
    return one.groupBy(part[0].alias("scope"), part[1].alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("bytes")).alias("bytes"), F.sum(n).alias("lines"))


@query(f"SELECT scope, language, CAST(sum(lines) AS BIGINT) AS lines, count(*) AS files FROM {FACTS} GROUP BY scope, language")
def incremental_refresh(spark, d):
    """Rows by scope and language from two rounds of a stream of changed files; equal to a full count."""
    from linefacts.streaming.refresh import refreshed

    f = facts(spark, d).select("doc_id", "scope", "language", "lines")
    return refreshed(spark, [f.where("doc_id % 2 = 0").withColumn("lines", F.lit(-1).cast("long")), f])
