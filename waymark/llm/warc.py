"""WARC archives of page captures and their globally ordered index.

Writing: each task appends its pages as gzip-compressed WARC/1.1 records to
files of bounded size in the shared folder, and returns the captures of
each file as a run sorted by URL key, time and id. The runs are committed
as a table, so that files of failed attempts are never referred to.

Merging: the runs are dealt to ranges of (URL key, time, id); each task
merges the pieces of its k runs with a loser tree, which gives an index
in global order, one range after another.

Of pages with equal payloads of at least ``min_bytes`` the one with the
smallest id is a response and the others are revisits that refer to it.
Rows that share that smallest id are all responses; pages with null ids
can be revisits, never be referred to. Null payloads are empty, null URLs
sort first under an empty key, URLs that can't be parsed are keyed as
they are.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm.common import new_folder, small_batches, written

MIN_BYTES = 100
#: A new file, and with it a new run, begins above so many bytes; so many captures make a range; so many bytes of a file are read by one task.
ROLL_BYTES, RANGE_ROWS, READ_BYTES = 256 << 20, 200_000, 64 << 20
NO_ID = (1 << 63) - 1
RUNS = "url_key string, ts string, order_id long, run string, file string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, part int, pos long"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """The host's parts reversed, then path and query, in lower case; without scheme, port 80/443, user and fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")"
    return (key + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def record(page_id: int | None, url: str | None, date: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One compressed record: a response, or a revisit if it refers to a page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packed = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packed.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packed.flush()


def read_record(data: bytes) -> dict:
    """The fields of a compressed record: header names in lower case, ``payload`` (None for a revisit) and ``full_length``."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    out: dict = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    http, _, payload = rest[: int(out["content-length"])].partition(b"\r\n\r\n")
    out["full_length"] = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    out["payload"] = payload if out["warc-type"] == "response" else None
    return out


def page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def merged(runs: list[Iterable[tuple]]) -> Iterator[tuple]:
    """The rows of sorted ``runs`` in order, by a loser tree; equal rows in the order of their runs."""
    sources = [iter(r) for r in runs]
    heads = [next(s, None) for s in sources]
    k = len(sources)
    if not k:
        return
    tree: list[int | None] = [None] * k  # the losers of the inner nodes; the overall winner at 0

    def loses(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[b] is not None
        return (heads[b], b) < (heads[a], a)

    def climb(run: int) -> None:
        at = (run + k) // 2
        while at:
            other = tree[at]
            if other is None:
                tree[at] = run
                return
            if loses(run, other):
                tree[at], run = run, other
            at //= 2
        tree[0] = run

    for run in range(k):
        climb(run)
    while heads[tree[0]] is not None:
        best = tree[0]
        yield heads[best]
        heads[best] = next(sources[best], None)
        climb(best)


def decide(pages: DataFrame, page_id: str, url: str, html: str, ts: Column, min_bytes: int) -> DataFrame:
    """(page_id, url, ts, html, digest, refers_to): each page with the page it revisits, or null.

    What is a revisit is found on ids and digests alone. Payloads are dealt once, by id and digest, so that pages of equal
    payload don't meet in one task.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), ts.alias("ts"), F.coalesce(F.col(html), F.lit("")).alias("html")
    ).withColumn("digest", F.sha2(F.col("html"), 256))
    small = written(rows.where(F.octet_length("html") >= min_bytes).groupBy("page_id", "digest").agg(F.count("*").alias("n_rows")), "digests")
    shared = small.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.sum("n_rows").alias("n_pages")).where("n_pages > 1 and first_id is not null").select("digest", "first_id")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id"))
    revisits = small.join(shared, "digest").where(other).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("first_id").alias("refers_to"))
    same = rows["page_id"].eqNullSafe(revisits["_id"]) & (rows["digest"] == revisits["_digest"]) & (F.octet_length(rows["html"]) >= min_bytes)
    return rows.join(revisits, same, "left").select("page_id", "url", "ts", "html", "digest", "refers_to")


def write_archives(decided: DataFrame, root: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the records below ``root``; gives the committed runs (see ``RUNS``)."""

    small_batches(decided.sparkSession)

    def wrote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        out, at, run, name = None, 0, [], ""

        def closed():
            out.close()
            run.sort()
            columns = list(zip(*run, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2]), pa.array([name] * len(run)), pa.array([name] * len(run)), pa.array(columns[3]), pa.array(columns[4])],
                names=[c.split()[0] for c in RUNS.split(", ")],
            )

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name, at, run = f"{uuid.uuid4().hex}.warc.gz", 0, []
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                ts = r["ts"]
                data = record(r["page_id"], r["url"], f"{ts[:4]}-{ts[4:6]}-{ts[6:8]}T{ts[8:10]}:{ts[10:12]}:{ts[12:14]}Z", r["html"].encode(), r["digest"], r["refers_to"])
                out.write(data)
                run.append((url_key(r["url"]), ts, NO_ID if r["page_id"] is None else r["page_id"], at, len(data)))
                at += len(data)
                if at >= roll_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return written(decided.mapInArrow(wrote, RUNS), "capture-runs")


def merge_index(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures in global order: (part, pos) number the ranges and the rows inside, ``RUNS`` are the rest."""
    parts = max(1, -(-runs.count() // range_rows))
    dealt = runs.repartitionByRange(parts, "url_key", "ts", "order_id").sortWithinPartitions("run", "url_key", "ts", "order_id", "offset")
    names = [c.split()[0] for c in RUNS.split(", ")]

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[tuple]] = {}
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                pieces.setdefault(r[3], []).append(r)
        part, pos, rows = TaskContext.get().partitionId(), 0, []
        flush = lambda: pa.RecordBatch.from_arrays(
            [pa.array([part] * len(rows), pa.int32()), pa.array(range(pos - len(rows), pos), pa.int64()), *(pa.array(c) for c in zip(*rows, strict=True))],
            names=["part", "pos", *names],
        )
        for r in merged([pieces[k] for k in sorted(pieces)]):
            rows.append(r)
            pos += 1
            if len(rows) == 10_000:
                yield flush()
                rows = []
        if rows:
            yield flush()

    return written(dealt.mapInArrow(ordered, f"part int, pos long, {RUNS}"), "capture-index")


def read_archives(index: DataFrame, root: str) -> DataFrame:
    """The records that the index names, see ``RECORDS``, each with its place (part, pos) in the index; a response's digest and
    size are those of the payload read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        name, source = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["file"] != name:
                    if source:
                        source.close()
                    name = r["file"]
                    source = store.open_input_file(f"{base}/{name}")
                x = read_record(source.read_at(r["length"], r["offset"]))
                digest, payload = x["warc-payload-digest"].removeprefix("sha256:"), x["payload"]
                if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{name} at {r['offset']}: the payload differs from its digest")
                refers = x.get("warc-refers-to")
                rows.append((page_of(x["warc-record-id"]), x["full_length"], digest, x["warc-type"], page_of(refers) if refers else None, r["part"], r["pos"]))
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in RECORDS.split(", ")])

    block = F.floor(F.col("offset") / READ_BYTES)
    dealt = index.select("file", "offset", "length", "part", "pos").repartition(F.col("file"), block).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, RECORDS)


def with_position(records: DataFrame, index: DataFrame) -> DataFrame:
    """``records`` with ``position``, their place in the whole index: the rows of earlier ranges and the place in their own."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    sizes = index.groupBy("part").agg(F.count("*").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return records.join(sizes, "part").withColumn("position", F.col("_before") + F.col("pos")).drop("_before")


def archive_pages(
    pages: DataFrame, ts: Column, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES, root: str | None = None
) -> tuple[DataFrame, str]:
    """Writes all pages below ``root``; gives the ordered index and the folder. ``ts`` is 14 digits, yyyyMMddHHmmss."""
    root = root or new_folder(pages.sparkSession, "warc")
    return merge_index(write_archives(decide(pages, page_id, url, html, ts, min_bytes), root)), root
