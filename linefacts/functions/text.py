"""Column functions over source text, names and labels; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def physical_lines(text: Column) -> Column:
    """Lines end at LF; a last line without one counts if it isn't empty. Null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    feeds = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.when(t == "", 0).otherwise(feeds + F.when(t.endswith("\n"), 0).otherwise(1)).cast("long")


def lines_of(text: Column) -> Column:
    """The physical lines as an array."""
    t = F.coalesce(text, F.lit(""))
    parts = F.split(t, "\n")
    return F.when(t == "", F.array().cast("array<string>")).when(t.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def clamp_categories(lines: Column, blanks: Column, comments: Column, code: Column) -> tuple[Column, Column, Column]:
    """(blanks, comments, code) that add up to ``lines``: blanks first, code gives way before comments and takes what is over."""
    b = F.least(blanks, lines)
    rest = lines - b
    c, k = F.least(comments, rest), F.least(code, rest)
    excess = F.greatest(c + k - rest, F.lit(0))
    c = c - (excess - F.least(k, excess))
    return b, c, rest - c


def poisoning_sum(x: Column) -> Column:
    """Null if any value is unavailable, else the sum; 0 of nothing."""
    return F.when(F.coalesce(F.bool_or(x.isNull()), F.lit(False)), F.lit(None)).otherwise(F.coalesce(checked_sum(x), F.lit(0))).cast("long")


def checked_sum(x: Column) -> Column:
    """The sum of longs, null of nothing; one beyond 64 bits raises whatever the session's arithmetic does."""
    total = F.sum(x.cast("decimal(20,0)"))
    return F.when(F.abs(total) > F.lit((1 << 63) - 1).cast("decimal(30,0)"), F.raise_error(F.lit("sum beyond 64 bits"))).otherwise(total).cast("long")


def split_features(list_: Column) -> Column:
    """Feature names separated by commas or white space, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(list_, "[, \t\n\r]"), lambda v: v != "")))


def plain_identifier(name: Column) -> Column:
    """Without the mark of a raw identifier."""
    return F.regexp_replace(name, "^r#", "")


def child_base(path: Column) -> Column:
    """The directory where a file's child modules live."""
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    stem = F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1)
    return F.when(path.rlike("(^|/)mod\\.rs$"), folder).otherwise(F.concat_ws("/", folder, stem))


def sanitized(cell: Column) -> Column:
    """Control characters made visible, so that a cell stays on one line."""
    c = F.replace(F.replace(F.replace(cell, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    code = lambda ch: F.lpad(F.hex(F.ascii(ch)), 4, "0")
    shown = F.transform(F.split(c, ""), lambda ch: F.when(ch.rlike(r"^\p{Cc}$"), F.concat(F.lit("\\u{"), code(ch), F.lit("}"))).otherwise(ch))
    return F.when(c.rlike(r"\p{Cc}"), F.array_join(shown, "")).otherwise(c)


def cfg_text(name: Column, value: Column) -> Column:
    """``name`` or ``name = "value"``."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(value.isNull(), name).otherwise(F.concat(name, F.lit(" = "), quoted))


def crate_type(kind: Column, types: Column) -> Column:
    """Build scripts are binaries; else the first type, or a library."""
    return F.when(kind == "build-script", F.lit("bin")).otherwise(F.coalesce(F.get(types, F.lit(0)), F.lit("lib")))


def resolver_version(explicit: Column, edition: Column) -> Column:
    """The workspace's own resolver, else by the root package's edition; a virtual workspace has the first."""
    return F.coalesce(explicit, F.when(edition == "2024", 3).when(edition == "2021", 2).otherwise(1)).cast("int")


def normalized(path: Column) -> Column:
    """An absolute path without ``.`` and empty components, and with ``..`` applied; above the root there is nothing."""
    none = F.array().cast("array<string>")
    kept = F.aggregate(F.split(path, "/"), none, lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def ancestors(path: Column) -> Column:
    """Every directory above a path, the path itself included: keys for an equi-join on containment."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
