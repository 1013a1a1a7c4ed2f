"""WARC archives: a native writer and a Python data source that reads them.

Writing is a text sink whose line separator is the blank line that ends a
record, so Spark's own commit protocol, file systems and retries apply.
Reading is the data source ``warc``: partitions are planned from file sizes,
predicates on record type and other headers are decided from the header block
alone, and the payload of a record that is not wanted is skipped by its length
without being read into memory or decoded.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, Not
from pyspark.sql.types import StructType

from factloom import scratch
from factloom.llm.rows import filesystem, finder, with_places
from factloom.ship import ship

#: Payloads of this many bytes or more are stored once.
REVISIT_BYTES = 1000

_CRLF = "\r\n"

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, "
    "content_type string, headers map<string,string>, http_length bigint, block_length bigint, payload binary, payload_sha1 string"
)


# ---------------------------------------------------------------- writing


def plan_revisits(rows: DataFrame, file: str, at: str, id_col: str, payload_col: str, at_least: int = REVISIT_BYTES) -> DataFrame:
    """file, at and response (an id) of each row that revisits another's payload; ``rows`` have their places.

    Of the rows whose payloads are equal and of ``at_least`` bytes, those with
    the largest id are responses. Null payloads are empty; a null id counts as
    smaller than any other and is the response only where all ids of its group
    are null. Payloads are compared by SHA-256, since SHA-1 values can be made
    to collide; only digests, ids and places are dealt out, and a payload that
    very many rows share is summed up before it is.
    """
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    marked = rows.select(F.col(id_col).alias("id"), body.alias("body"), F.col(file), F.col(at)).where(F.octet_length("body") >= at_least)
    marked = scratch.materialise(marked.select("id", F.sha2("body", 256).alias("sha256"), file, at), "warc-digests")
    groups = marked.groupBy("sha256").agg(F.max("id").alias("response"), F.count("*").alias("copies")).where("copies > 1 and response is not null")
    return marked.join(groups, "sha256").where("id is null or id < response").select(file, at, "response")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", date: str = "2000-01-01T00:00:00Z", at_least: int = REVISIT_BYTES) -> None:
    """Write one WARC/1.1 record for each row to files below ``path``.

    Of the rows whose payloads are equal and at least ``at_least`` bytes, those
    with the largest id are responses and the others revisit them; shorter ones
    are all responses. Ids are whole numbers. A null payload is empty, a null
    URI is left out, control characters in a URI are percent-encoded. Rows that
    repeat are a record each. An empty table writes no record. Columns that are
    not named are ignored. Payloads are not dealt out.
    """
    rows, file, at = with_places(pages)
    find = finder(plan_revisits(rows, file, at, id_col, payload_col, at_least), file, at, ["response"], "warc-revisits")
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = rows.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), body.alias("body"), find(F.col(file), F.col(at)).alias("hit"))
    rows = rows.select("id", "uri", "body", F.col("hit.found").alias("revisit"), F.col("hit.response").alias("response"))
    revisit = F.col("revisit")
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("uri", "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x20\\x7f]", "%20")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.octet_length("body").cast("string"), F.lit(_CRLF * 2)
    )
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("body"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("response"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length("body"))).cast("string")),
        F.lit(_CRLF),
    )
    record = F.concat(header.cast("binary"), http.cast("binary"), F.when(revisit, F.lit(b"")).otherwise(F.col("body")))
    # The string type only carries the bytes here: the sink writes them as they are.
    rows.select(record.cast("string").alias("value")).write.option("lineSep", _CRLF * 2).text(path)


# ---------------------------------------------------------------- reading


@dataclass
class Files(InputPartition):
    """Whole files for one task: (path, bytes)."""

    files: tuple[tuple[str, int], ...]


def _listed(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    store, at = filesystem(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    prefix = path[: len(path) - len(at)] if path.endswith(at) else "file://"
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((prefix + x.path, x.size) for x in found if x.type == fs.FileType.File and x.base_name[:1] not in "_." and x.size)


def headers(stream) -> dict[str, str] | None:
    """The header block of the next record by lower-case name; None at the end. Blank lines ahead are skipped."""
    while line := stream.readline():
        if line.strip():
            break
    else:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not the start of a WARC record: {line[:60]!r}")
    out: dict[str, str] = {}
    last = None
    while (line := stream.readline()).strip():
        if line[:1] in b" \t" and last:  # a continued value
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, _, value = line.decode("utf-8", "replace").partition(":")
        last = name.strip().lower()
        out[last] = value.strip()
    if not line:
        raise ValueError("a WARC record ends within its header")
    return out


def _skip(stream, length: int) -> None:
    """Move past bytes that must be there: a seek alone would go past the end of a cut file unnoticed."""
    if length > 0:
        stream.seek(length - 1, io.SEEK_CUR)
        if not stream.read(1):
            raise ValueError("a WARC record ends before its length")


#: Columns that a header holds, so that predicates on them need no payload.
_HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type"}


def _holds(tests: list[tuple], head: dict[str, str]) -> bool:
    for kind, name, value, negated in tests:
        held = head.get(name)
        if kind == "null":
            ok = held is None
        elif kind == "notnull":
            ok = held is not None
        elif held is None:
            return False
        else:
            ok = held in value
        if ok == negated:
            return False
    return True


def records(stream, tests: list[tuple] = (), payload: str = "keep"):
    """Rows of SCHEMA from an uncompressed stream. payload: keep, digest (SHA-1 only) or skip."""
    while (head := headers(stream)) is not None:
        length = int(head.get("content-length", 0))
        if not _holds(tests, head):
            _skip(stream, length)
            continue
        http_length, body, sha1 = None, None, None
        left = length
        if head.get("content-type", "").startswith("application/http"):
            while left > 0 and (line := stream.readline()):
                left -= len(line)
                if not line.strip():
                    break
                name, _, value = line.partition(b":")
                if name.lower() == b"content-length":
                    http_length = int(value)
        if payload == "skip" or head.get("warc-type") == "revisit":
            _skip(stream, left)
        else:
            if len(data := stream.read(left)) != left:
                raise ValueError("a WARC record ends before its length")
            sha1 = hashlib.sha1(data).hexdigest()
            body = data if payload == "keep" else None
        yield (head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-payload-digest"), head.get("warc-refers-to"), head.get("content-type"), list(head.items()), http_length, left, body, sha1)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"]
        self.payload = options.get("payload", "keep")
        self.target = int(options.get("partitionbytes", 64 << 20))
        self.tests: list[tuple] = []
        if self.payload not in ("keep", "digest", "skip"):
            raise ValueError("payload is one of keep, digest, skip")

    def pushFilters(self, filters):
        """Takes equality, membership and null tests on header columns; Spark keeps the rest."""
        for whole in filters:
            f, negated = (whole.child, True) if isinstance(whole, Not) else (whole, False)
            name = _HEADER_OF.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if name and isinstance(f, (EqualTo, In)) and not (isinstance(f, EqualTo) and f.value is None):
                values = frozenset([f.value] if isinstance(f, EqualTo) else [v for v in f.value if v is not None])
                if isinstance(f, In) and negated and len(values) != len(f.value):
                    yield whole
                    continue
                self.tests.append(("in", name, values, negated))
            elif name and isinstance(f, (IsNull, IsNotNull)):
                self.tests.append(("null" if isinstance(f, IsNull) else "notnull", name, None, negated))
            else:
                if name and isinstance(f, EqualNullSafe) and f.value is not None and not negated:
                    self.tests.append(("in", name, frozenset([f.value]), False))
                    continue
                yield whole

    def partitions(self):
        """Whole files, gathered up to ``partitionBytes``; a larger file is a partition of its own."""
        out, now, held = [], [], 0
        for path, size in _listed(self.path):
            if now and held + size > self.target:
                out.append(Files(tuple(now)))
                now, held = [], 0
            now.append((path, size))
            held += size
        if now:
            out.append(Files(tuple(now)))
        return out or [Files(())]

    def read(self, partition: Files):
        schema = _arrow_schema()
        for path, _ in partition.files:
            store, at = filesystem(path)
            raw = store.open_input_file(at)
            buffered = io.BufferedReader(raw, 1 << 20)
            if buffered.peek(2)[:2] == b"\x1f\x8b":
                buffered = io.BufferedReader(_Seekable(gzip.GzipFile(fileobj=buffered)), 1 << 20)
            rows, held = [], 0
            for row in records(buffered, self.tests, self.payload):
                rows.append(row)
                held += len(row[10] or b"") + 500
                if held > 8 << 20:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, schema)
            raw.close()


class _Seekable(io.RawIOBase):
    """A decompressed stream: forward seeks read and drop."""

    def __init__(self, inner):
        self.inner = inner

    def readable(self):
        return True

    def seekable(self):
        return True

    def readinto(self, b):
        data = self.inner.read(len(b))
        b[: len(data)] = data
        return len(data)

    def seek(self, offset, whence=io.SEEK_SET):
        return self.inner.seek(offset, whence)

    def tell(self):
        return self.inner.tell()


def _arrow_schema() -> pa.Schema:
    s, n = pa.string(), pa.int64()
    return pa.schema([("record_id", s), ("record_type", s), ("target_uri", s), ("date", s), ("payload_digest", s), ("refers_to", s), ("content_type", s), ("headers", pa.map_(s, s)), ("http_length", n), ("block_length", n), ("payload", pa.binary()), ("payload_sha1", s)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payload", "keep|digest|skip").load(path)``"""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)


def read_warc(spark: SparkSession, path: str, payload: str = "keep") -> DataFrame:
    """The records below ``path`` (uncompressed or gzip), one row each, columns as SCHEMA.

    ``payload`` and ``payload_sha1`` are of the stored payload (null for a
    revisit, or where ``payload`` is ``skip``); ``http_length`` is the length
    that the HTTP header states, which a revisit states too. A header that is
    absent is null. A truncated record raises an error.
    """
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", payload).load(path)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """What the archives say of each page: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest and length are of the bytes read back; a revisit has
    those of the response that it names, as its own header states them.
    """
    r = read_warc(spark, path, "digest").where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) as bigint)")
    stated = F.regexp_replace("payload_digest", "^sha1:", "")
    return r.select(
        page("record_id").alias("page_id"),
        F.col("target_uri").alias("url"),
        F.when(F.col("record_type") == "revisit", F.col("http_length")).otherwise(F.col("block_length")).alias("payload_bytes"),
        F.coalesce("payload_sha1", stated).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
