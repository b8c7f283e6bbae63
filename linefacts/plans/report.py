"""Text of a report: the terminal table, the totals table, and JSON.

Report rows are a handful; only they come to the driver, ordered by Spark.
"""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import DataFrame

from linefacts.operators.accounting import MEASURES, report_order, summed

HEAD = ("Package", "Language", "Files", "Lines", "Blanks", "Comments", "Code", "Test")


def sanitize(value: str) -> str:
    """Control characters made visible; everything else as it is."""
    named = {"\r": "\\r", "\n": "\\n", "\t": "\\t"}
    return "".join(named.get(c) or (f"\\u{{{ord(c):04X}}}" if unicodedata.category(c) == "Cc" else c) for c in value)


def _width(s: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _cells(counts: dict) -> list[str]:
    return [str(counts[m]) for m in MEASURES] + ["n/a" if counts["test"] is None else str(counts["test"])]


def table(rows: DataFrame) -> str:
    """Rows (scope, language, measures, test) as a table: a scope's name on its first row, dividers between scopes, and a total."""
    held = [r.asDict() for r in report_order(rows).orderBy("pos").collect()]
    total = summed(rows).first().asDict()
    body, scopes, last = [], [], None
    for r in held:
        body.append([sanitize(r["scope"]) if r["scope"] != last else "", r["language"], *_cells(r)])
        scopes.append(r["scope"])
        last = r["scope"]
    return _drawn(list(HEAD), [*body, ["Total", "All", *_cells(total)]], [*scopes, None])


def totals(rows: DataFrame) -> str:
    """The same summed by language."""
    by = summed(rows, "language")
    held = [r.asDict() for r in by.orderBy(by.lines.desc(), by.language).collect()]
    body = [[r["language"], *_cells(r)] for r in held]
    return _drawn(list(HEAD[1:]), [*body, ["Total", *_cells(summed(rows).first().asDict())]], [*["one"] * len(body), None])


def _drawn(head: list[str], body: list[list[str]], groups: list) -> str:
    """Cells padded to their column, text to the left and numbers to the right; a rule where the group changes."""
    texts = len(head) - 6
    width = [max(_width(r[k]) for r in [head, *body]) for k in range(len(head))]

    def line(r: list[str]) -> str:
        return " ".join(" " + (c + " " * (w - _width(c)) if k < texts else " " * (w - _width(c)) + c) + " " for k, (c, w) in enumerate(zip(r, width))).rstrip() + "\n"

    rule = "-" * (sum(width) + 3 * len(width) - 1) + "\n"
    out = line(head) + rule
    for k, r in enumerate(body):
        out += line(r)
        if k + 1 < len(body) and groups[k + 1] != groups[k]:
            out += rule
    return out


def lossless(path: str) -> str:
    """The path itself; one that isn't UTF-8 raises, since JSON couldn't tell it."""
    try:
        path.encode()
    except UnicodeEncodeError as e:
        raise ValueError(f"path {path!r} isn't UTF-8 and can't be told in JSON") from e
    return path


def scope_object(r: dict) -> dict:
    if r["scope_id"] == "<root>":
        return {"kind": "root", "path": "."}
    return {"kind": "package", "name": r["name"], "package_id": r["scope_id"], "project_root": lossless(r["project_root"]), "manifest_path": lossless(r["manifest_path"])}


def document(rows: DataFrame, root: str, configuration: dict, warnings: list[tuple[str, str]]) -> str:
    """JSON with configuration, rows, total and warnings; an unavailable test count is null.

    rows have, besides those of the tables, scope_id, name, project_root,
    manifest_path, engine and precision.
    """
    held = [r.asDict() for r in report_order(rows).orderBy("pos").collect()]
    counts = lambda r: {m: r[m] for m in (*MEASURES, "test")}
    doc = {
        "schema_version": 3,
        "root": lossless(root),
        "configuration": configuration,
        "rows": [{"scope": scope_object(r), "language": r["language"], "accounting_engine": r["engine"], "accounting_precision": r["precision"], **counts(r)} for r in held],
        "total": counts(summed(rows).first().asDict()),
        "warnings": [{"code": c, "message": m} for c, m in sorted(set(warnings))],
    }
    return json.dumps(doc, indent=2, ensure_ascii=False) + "\n"
