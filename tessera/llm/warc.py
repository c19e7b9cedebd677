"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. A reading task gets a byte range, scans
it for gzip magic, takes a candidate for a member only if it decodes to a WARC
header, and owns the records that start inside the range, whose ends it reads
beyond it. Archives lie in a folder that all executors share (any file system
that pyarrow opens by URI); tables are read and written by Spark alone.

Defined cases: a null html is an empty payload; null ids and urls come back as
null; repeated rows each get a record, and all rows that share the largest id of
a payload are responses; empty tables make no archive and no record; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, new_path, small_batches

MAGIC = b"\x1f\x8b\x08"
#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 1000
SPLIT_BYTES = 4 << 20
CHUNK = 256 << 10
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"


def mark_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, html, refers_to): the id of the response for rows that repeat
    its payload. Payloads are grouped by digest in narrow rows; html moves once,
    by id, and only where it is needed."""
    payload = F.encode(F.coalesce(html_col, F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).alias("page_id"), "url", F.coalesce(html_col, F.lit("")).alias("html"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n"))
    narrow = rows.where(F.col("n") >= least).groupBy("sha1", "n", "page_id").count()
    groups = narrow.groupBy("sha1", "n").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("ids")).where(F.col("ids") > 1).select(F.col("sha1").alias("g_sha1"), F.col("n").alias("g_n"), "response")
    again = narrow.join(groups, (F.col("sha1") == F.col("g_sha1")) & (F.col("n") == F.col("g_n"))).where(~F.col("page_id").eqNullSafe(F.col("response"))).select(F.col("page_id").alias("a_id"), F.col("sha1").alias("a_sha1"), "response")
    joined = rows.join(again.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("a_id")) & (F.col("sha1") == F.col("a_sha1")), "left")
    return joined.select("page_id", "url", "html", F.col("response").alias("refers_to"))


def _record(page_id, url, html: str, refers_to) -> bytes:
    payload = html.encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in url or "\n" in url else f"WARC-Target-URI: {url}")
        head += ["X-Target-URI-Escaped: yes"] * ("\r" in url or "\n" in url)
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def write_archives(spark: SparkSession, marked: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``mark_revisits`` under ``folder``, one archive for each
    task; returns (path, bytes, records) of the archives of finished tasks."""
    small_batches(spark)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        name, out, n, size = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", None, 0, 0
        for batch in batches:
            for page_id, url, html, refers in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"]):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = _member(_record(None if pd.isna(page_id) else int(page_id), url if isinstance(url, str) else None, html, None if pd.isna(refers) else int(refers)))
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    # page ids are passed as decimals so that pandas keeps them whole beside nulls
    rows = marked.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"))
    return materialize(spark, rows.mapInPandas(write, "path string, bytes bigint, records bigint"), "warc-manifest")


class _Range:
    """Bytes of a file from ``start`` on, read as far as they are asked for."""

    def __init__(self, file, start: int, size: int):
        self.file, self.at, self.end, self.data = file, start, size, bytearray()

    def ensure(self, to: int) -> bool:
        """Whether the file has bytes up to offset ``to``; what it has is loaded."""
        while self.at + len(self.data) < to and self.at + len(self.data) < self.end:
            here = self.at + len(self.data)
            self.file.seek(here)
            got = self.file.read(min(max(CHUNK, to - here), self.end - here))
            if not got:
                break
            self.data += got
        return self.at + len(self.data) >= to

    def get(self, a: int, b: int) -> bytes:
        self.ensure(b)
        return bytes(self.data[a - self.at : b - self.at])

    def drop(self, to: int) -> None:
        del self.data[: max(0, to - self.at)]
        self.at = max(self.at, to)


def _decode(source: _Range, at: int) -> tuple[bytes, int] | None:
    """The member that starts at ``at`` and the place after it, if it is one and
    decodes to a WARC header."""
    z, parts, held, here, sure = zlib.decompressobj(31), [], 0, at, False
    while not z.eof:
        chunk = source.get(here, here + CHUNK)
        if not chunk:
            return None
        try:
            out = z.decompress(chunk)
        except zlib.error:
            return None
        parts.append(out)
        held += len(out)
        if not sure and held >= 7:
            head = b"".join(parts)
            if not head.startswith(b"WARC/1."):
                return None
            sure = b"\r\n\r\n" in head
            parts = [head]
        here += len(chunk) - len(z.unused_data)
    return (b"".join(parts), here) if sure else None


def members(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records whose members start in [start, end)."""
    source, at = _Range(file, start, size), start
    while at < end:
        source.ensure(min(end, at + CHUNK) + 2)
        k = source.data.find(MAGIC, at - source.at, min(end, at + CHUNK) + 2 - source.at)
        if k < 0:
            at = min(end, at + CHUNK)
            source.drop(at)
            continue
        at = source.at + k
        if found := _decode(source, at):
            yield found[0]
            at = found[1]
        else:
            at += 1
        source.drop(at)


def parse(record: bytes) -> tuple:
    """(page_id, url, type, payload bytes, digest, refers_to, payload or None)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        key, _, value = line.partition(": ")
        fields[key.lower()] = value
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    url = fields.get("warc-target-uri")
    if "x-target-uri-escaped" in fields:
        url = url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    if fields["warc-type"] == "revisit":
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
        return number(fields["warc-record-id"]), url, "revisit", size, fields["warc-payload-digest"].removeprefix("sha1:"), number(fields["warc-refers-to"]), None
    return number(fields["warc-record-id"]), url, "response", len(payload), hashlib.sha1(payload).hexdigest(), None, payload


def read_archives(spark: SparkSession, manifest: DataFrame, split: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """The records of archives (path, bytes); with ``payload`` also the bytes of
    each response's payload."""
    total = manifest.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 0
    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start")).repartition(max(1, math.ceil(total)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["bytes"], batch["start"]):
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(name) as file:
                    for record in members(file, int(size), int(start), min(int(size), int(start) + split)):
                        row = parse(record)
                        rows.append(row if payload else row[:-1])
                        held += len(record) if payload else 200
                        if held > 16 << 20:
                            yield _frame(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    return ranges.mapInPandas(read, RECORD + (", payload binary" if payload else ""))


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names[: len(rows[0])])
    for c in ("page_id", "payload_bytes", "refers_to"):
        out[c] = pd.array([r[names.index(c)] for r in rows], dtype="Int64")
    return out


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None, payload: bool = False) -> DataFrame:
    """Write ``pages`` to archives and read them back, record by record; raises where
    not as many come back as the manifest has."""
    folder = folder or new_path(spark, "warc")
    manifest = write_archives(spark, mark_revisits(pages), folder)
    records = materialize(spark, read_archives(spark, manifest, payload=payload), "warc-records")
    written, read = manifest.agg(F.sum("records")).first()[0] or 0, records.count()
    if read != written:
        raise ValueError(f"{written} records were written and {read} were read")
    return records


def digest(records: DataFrame) -> DataFrame:
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, n, max(page_id) AS r FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
CASE WHEN g.r IS NULL OR g.r = page_id THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN g.r <> page_id THEN g.r END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n = g.n
"""
