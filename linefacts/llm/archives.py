"""Legacy archive converter: ARC files in, equivalent WARC files out.

An ARC file opens with a version block whose second line gives the version and
whose third names the header fields; each record is one header line with those
fields, the last being the length in bytes, then so many bytes and a line feed.
Version 1 has five fields, version 2 ten. The converter takes fields from the
right, so a URL may hold spaces, and trusts nothing but the declared length.

For each record it synthesises what WARC asks for: an identifier (a name-based
UUID of the archive's name and the record's place, so that reruns agree), a
timestamp from the fourteen digits, a type, and SHA-256 digests. The version
block becomes a warcinfo record, an HTTP message a response, and anything else
(a DNS answer, a file) a resource with its own content type. Of responses with
equal payloads of at least ``least`` bytes, the one with the smallest page id
(then archive, then place) stays a response; the others become revisits that
refer to it. Every record is a gzip member of its own.

Cases: null html is an empty payload. A null page id sorts last and comes back
as null. Null or odd URLs are percent-encoded. Rows that repeat a page id are
records of their own. No rows: no records. A record cut short raises
ValueError. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefacts.llm._shared import filesystem, new_path, written

#: Bytes of records after which a new file begins.
FILE = 32 << 20
LEAST = 100
#: Compressed bytes that are read at a time.
STEP = 8 << 10
#: The field lines of the two ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
STAMP = "20010203040506"


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def members(raw: bytes) -> Iterator[bytes]:
    """The contents of each gzip member; a step at a time, so that the rest of the file isn't copied for each."""
    view, at = memoryview(raw), 0
    while at < len(view):
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            part = view[at : at + STEP]
            if not part:
                raise ValueError("gzip member cut short")
            out.append(d.decompress(part))
            at += len(part) - len(d.unused_data)
        yield out[0] if len(out) == 1 else b"".join(out)


# --- ARC ---------------------------------------------------------------------


def arc_head(version: int, name: str) -> bytes:
    body = f"{version} 0 linefacts\n{FIELDS[version]}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {STAMP} text/plain " + ("" if version == 1 else "200 - - 0 " + name + " ")
    return f"{line}{len(body)}\n".encode() + body + b"\n"


def stamp_after(seconds: int) -> str:
    return (datetime.strptime(STAMP, "%Y%m%d%H%M%S") + timedelta(seconds=seconds)).strftime("%Y%m%d%H%M%S")


def arc_block(version: int, url: str, content_type: str, block: bytes, name: str, at: int, stamp: str = STAMP) -> bytes:
    """A record of any block, HTTP or not."""
    more = "" if version == 1 else f"200 - - {at} {name} "
    return f"{url} 0.0.0.0 {stamp} {content_type} {more}{len(block)}\n".encode() + block + b"\n"


def arc_record(version: int, url: str | None, page_id: int | None, payload: bytes, name: str, at: int, stamp: str = STAMP) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if page_id is not None:
        head += f"X-Page-Id: {page_id}\r\n".encode()
    block = head + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    safe = quote(url or "unknown:", safe=":/?#[]@!$&'()*+,;=%~-._")
    return arc_block(version, safe, "text/html", block, name, at, stamp)


def parse_arc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by name, block) of each record; the version block comes first, with the fields that every version has."""
    at, names = 0, FIELDS[1].split()
    first = True
    while at < len(raw):
        if raw[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = raw.index(b"\n", at)
        line = raw[at:end].rstrip(b"\r").decode("utf-8", "replace")
        if first:  # the version block has its own version's fields, which its body names
            (url, address, date, kind), size, body = line.split(" ")[:4], int(line.rsplit(" ", 1)[1]), raw[end + 1 :]
            if len(body) < size:
                raise ValueError("version block cut short")
            told = body[:size].decode("utf-8", "replace").splitlines()
            names = FIELDS[int(told[0].split()[0])].split() if len(told) < 2 or "Archive-length" not in told[1] else told[1].split()
            yield {"URL": url, "IP-address": address, "Archive-date": date, "Content-type": kind, "Archive-length": str(size)}, body[:size]
            at, first = end + 1 + size, False
            continue
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"header line with {len(values)} fields")
        size = int(values[-1])
        block = raw[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError("record cut short")
        yield dict(zip(names, values)), block
        at = end + 1 + size


def kind_of(fields: dict[str, str], block: bytes) -> str:
    """What a record becomes: warcinfo of a version block, response of an HTTP message, resource of anything else (a DNS answer, a file)."""
    if fields["URL"].startswith("filedesc:"):
        return "warcinfo"
    return "response" if fields["URL"].partition(":")[0].lower() not in ("dns", "ftp", "whois") and block.startswith(b"HTTP/") else "resource"


def payload_of(kind: str, block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(HTTP headers, HTTP head, payload): all of the block where there is no HTTP message."""
    return http_parts(block) if kind in ("response", "revisit") else ({}, b"", block)


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers by lower-case name, head with its blank line, payload)."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, head + mark, payload


# --- WARC --------------------------------------------------------------------


def record_id(archive: str, seq: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{seq}')}"


def date_of(digits: str) -> str:
    d = (digits + "19700101000000"[len(digits) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, ident: str, fields: dict[str, str], block: bytes, payload_digest: str, more: list[tuple[str, str]] = ()) -> bytes:
    info, url = kind == "warcinfo", fields["URL"]
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{ident}>"),
        ("WARC-Date", date_of(fields["Archive-date"])),
        *([("WARC-Filename", url.partition("://")[2])] if info else [("WARC-Target-URI", url), ("WARC-IP-Address", fields["IP-address"])]),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("WARC-Payload-Digest", "sha256:" + payload_digest),
        *more,
        ("Content-Type", "application/warc-fields" if info else "application/http; msgtype=response" if kind != "resource" else fields["Content-type"]),
        ("Content-Length", str(len(block))),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        block = raw[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("record cut short")
        yield fields, block
        at = end + 4 + size + 4


# --- Spark -------------------------------------------------------------------


class _Writer:
    """Files of about ``FILE`` bytes of records; a gzip member for each record, so that one can be read by its offset."""

    def __init__(self, root: str, ending: str):
        self.root, self.ending, self.mark, self.n = root, ending, uuid.uuid4().hex[:12], 0
        self.out, self.path, self.bytes = None, "", 0

    def open(self) -> str:
        self.path = f"{self.root}/{TaskContext.get().partitionId():06d}-{self.n:04d}-{self.mark}{self.ending}"
        self.n, self.bytes = self.n + 1, 0
        fs, p = filesystem(self.path)
        fs.create_dir(p.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(p, compression=None)
        return self.path

    def put(self, raw: bytes) -> None:
        self.out.write(_member(raw))
        self.bytes += len(raw)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _read(path: str) -> bytes:
    fs, p = filesystem(path)
    with fs.open_input_stream(p, compression=None) as s:
        return b"".join(members(s.read()))


def write_arcs(pages: DataFrame, root: str, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Legacy archives of the pages, versions 1 and 2 in turn: (arc_path, version, records)."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        w, n, version, name = _Writer(root, ".arc.gz"), 0, 1, ""
        done: list[tuple[str, int, int]] = []
        for b in batches:
            for i, u, h in zip(b.column("i").to_pylist(), b.column("u").to_pylist(), b.column("h").cast("binary").to_pylist()):
                if w.out is None or w.bytes > FILE:
                    if w.out is not None:
                        w.close()
                        done.append((w.path, version, n))
                    name, n = w.open().rpartition("/")[2], 0
                    version = 1 + (TaskContext.get().partitionId() + w.n) % 2
                    w.put(arc_head(version, name))
                w.put(arc_record(version, u, i, h or b"", name, w.bytes, stamp_after(n)))
                n += 1
        if w.out is not None:
            w.close()
            done.append((w.path, version, n))
        if done:
            yield pa.RecordBatch.from_pydict({"arc_path": [x[0] for x in done], "version": pa.array([x[1] for x in done], pa.int32()), "records": pa.array([x[2] for x in done], pa.int64())})

    rows = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("h"))
    return written(rows.mapInArrow(write, "arc_path string, version int, records long"), "arcs")


def convert(arcs: DataFrame, root: str, least: int = LEAST) -> DataFrame:
    """WARC files of the ARC files: (warc_path, records). Payloads never leave their archive's task; digests do."""
    spark = arcs.sparkSession

    def survey(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for path in b.column("arc_path").to_pylist():
                rows = []
                for seq, (fields, block) in enumerate(parse_arc(_read(path))):
                    kind = kind_of(fields, block)
                    head, _, payload = payload_of(kind, block)
                    page = head.get("x-page-id")
                    rows.append((seq, kind, int(page) if page is not None else None, len(payload), hashlib.sha256(payload).digest()))
                seqs, kinds, ids, sizes, digests = zip(*rows) if rows else ((), (), (), (), ())
                yield pa.RecordBatch.from_pydict({"arc_path": [path] * len(rows), "seq": pa.array(seqs, pa.int64()), "kind": pa.array(kinds, pa.string()), "page_id": pa.array(ids, pa.int64()), "payload_bytes": pa.array(sizes, pa.int64()), "digest": pa.array(digests, pa.binary())})

    files = max(1, arcs.count())
    each = arcs.select("arc_path").repartition(files, "arc_path")  # a task for each file or few
    found = written(each.mapInArrow(survey, "arc_path string, seq long, kind string, page_id long, payload_bytes long, digest binary"), "arc-records")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "arc_path", "seq")
    first = found.where((F.col("payload_bytes") >= least) & (F.col("kind") == "response")).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    told = found.join(first, "digest", "left").select("arc_path", "seq", "digest", "first.page_id", F.col("first.arc_path").alias("ref_path"), F.col("first.seq").alias("ref_seq"), ((F.col("payload_bytes") >= least) & (F.col("kind") == "response")).alias("long_enough"))

    def turn(table):
        import pyarrow as pa

        table = table.sort_by("seq")
        path = table.column("arc_path")[0].as_py()
        archive = path.rpartition("/")[2]
        w = _Writer(root, ".warc.gz")
        w.open()
        cols = [table.column(c).to_pylist() for c in ("digest", "page_id", "ref_path", "ref_seq", "long_enough")]
        n = 0
        for seq, ((fields, block), digest, ref_page, ref_path, ref_seq, long_enough) in enumerate(zip(parse_arc(_read(path)), *cols, strict=True)):
            ident, kind = record_id(archive, seq), kind_of(fields, block)
            if long_enough and ref_path is not None and (ref_path, ref_seq) != (path, seq):
                more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_id(ref_path.rpartition('/')[2], ref_seq)}>")]
                if ref_page is not None:
                    more.append(("X-Refers-To-Page", str(ref_page)))
                w.put(warc_record("revisit", ident, fields, http_parts(block)[1], digest.hex(), more))
            else:
                w.put(warc_record(kind, ident, fields, block, digest.hex()))
            n += kind != "warcinfo"
        w.close()
        return pa.table({"warc_path": [w.path], "records": pa.array([n], pa.int64())})

    # Few small rows and much work each: a task for each file or few, whatever their size.
    return written(told.repartition(files, "arc_path").groupBy("arc_path").applyInArrow(turn, "warc_path string, records long"), "warcs")


def read_warcs(warcs: DataFrame) -> DataFrame:
    """What the records of WARC files say."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for path in b.column("warc_path").to_pylist():
                rows = []
                for f, block in parse_warc(_read(path)):
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    head, _, payload = payload_of(f["WARC-Type"], block)
                    digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                    if f["WARC-Type"] != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload digest differs in {path}")
                    page, ref = head.get("x-page-id"), f.get("X-Refers-To-Page")
                    rows.append((None if page is None else int(page), int(head.get("content-length", len(payload))), digest, f["WARC-Type"], None if ref is None else int(ref), f["WARC-Record-ID"], f["WARC-Date"], f["WARC-Target-URI"]))
                c = list(zip(*rows)) or [()] * 8
                yield pa.RecordBatch.from_pydict({"page_id": pa.array(c[0], pa.int64()), "payload_bytes": pa.array(c[1], pa.int64()), "payload_digest": pa.array(c[2], pa.string()), "record_type": pa.array(c[3], pa.string()), "refers_to": pa.array(c[4], pa.int64()), "record_id": pa.array(c[5], pa.string()), "warc_date": pa.array(c[6], pa.string()), "target_uri": pa.array(c[7], pa.string())})

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, target_uri string"
    return warcs.select("warc_path").repartition(max(1, warcs.count()), "warc_path").mapInArrow(read, schema)


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "archives")
    arcs = write_arcs(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return read_warcs(convert(arcs, root)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
