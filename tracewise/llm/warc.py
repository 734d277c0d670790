"""WARC archives as a Spark data source.

Reading plans whole files into partitions, takes filters on record types and
headers down to the parser, parses the headers of a record first and passes over
the payloads that nothing asks for: by a seek where the length is known, without
keeping bytes otherwise. Writing makes one gzip member for each record, with its
length in the member's header, so that readers can seek; files get their final
names when the job commits, so the remains of lost tasks are never read.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull,
    StringStartsWith, WriterCommitMessage,
)

from tracewise.llm.common import join_keyed, new_folder, staged

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, "
    "refers_to string, payload_sha1 string, payload_length bigint, headers map<string,string>, payload binary"
)

#: Header fields of the columns; fixed names of the format but for the last.
_FIELDS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI",
    "date": "WARC-Date", "content_type": "Content-Type", "refers_to": "WARC-Refers-To",
    "payload_sha1": "WARC-Payload-Digest", "payload_length": "X-Payload-Length",
}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def _open_fs(path: str):
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _clean(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _unbracket(value: str | None) -> str | None:
    return value[1:-1] if value and value.startswith("<") and value.endswith(">") else value


def _hex_digest(value: str | None) -> str | None:
    """A SHA-1 in hex from a digest header, which has it in base 32 or hex."""
    if not value or not value.lower().startswith("sha1:"):
        return None
    digest = value[5:]
    return base64.b32decode(digest).hex() if len(digest) == 32 else digest.lower()


def record_bytes(row: dict) -> bytes:
    """A record of the archive, from the columns of ``SCHEMA``; a revisit has no payload."""
    revisit = row.get("record_type") == "revisit"
    payload = b"" if revisit else row.get("payload") or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (
        row.get("payload_length") or len(payload)
    )
    is_http = row.get("record_type") in ("response", "revisit")
    block = http + payload if is_http else payload
    digest = row.get("payload_sha1")
    fields = {
        "WARC-Type": row.get("record_type") or "resource",
        "WARC-Record-ID": f"<{row.get('record_id') or 'urn:uuid:' + str(uuid.uuid4())}>",
        "WARC-Date": row.get("date") or _DATE,
        "WARC-Target-URI": row.get("target_uri"),
        "WARC-Refers-To": f"<{row['refers_to']}>" if row.get("refers_to") else None,
        "WARC-Profile": _REVISIT if revisit else None,
        "WARC-Payload-Digest": digest and "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "X-Payload-Length": row.get("payload_length"),
        "Content-Type": "application/http; msgtype=response" if is_http else row.get("content_type"),
        "Content-Length": len(block),
    }
    head = "".join(f"{k}: {_clean(str(v))}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """One gzip member whose header has an ``sl`` field: its own length and that of the data."""
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = body.compress(data) + body.flush()
    size = len(body) + 10 + 2 + 12 + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class CutOff(ValueError):
    """A file ends inside a record."""


class _Stream:
    """Bytes of a file from a place on, plain or out of one gzip member."""

    CHUNK = 1 << 16

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.buffer, self.pool = file, start, size, b"", None
        file.seek(start)
        first = file.read(4096)
        self.gzipped = first[:2] == b"\x1f\x8b"
        self.length = None
        if self.gzipped:
            self.pool = zlib.decompressobj(31)
            if len(first) > 24 and first[3] & 4 and first[12:14] == b"sl":
                self.length = struct.unpack("<I", first[16:20])[0]
            self.buffer = self.pool.decompress(first)
        else:
            self.buffer = first
        self.empty = not first

    def more(self) -> bool:
        if self.gzipped and self.pool.eof:
            return False
        data = self.file.read(self.CHUNK)
        if not data:
            return False
        self.buffer += self.pool.decompress(data) if self.gzipped else data
        return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to a mark, which are taken away with it."""
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark))
            if not self.more():
                return None
        out, self.buffer = self.buffer[:found], self.buffer[found + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        self.buffer = b""
        while have < n and self.more():
            parts.append(self.buffer)
            have += len(self.buffer)
            self.buffer = b""
        data = b"".join(parts)
        self.buffer = data[n:]
        return data[:n]

    def skip(self, n: int) -> bool:
        """Passes over data, if there is so much; plain files are not read for it."""
        if not self.gzipped and n > len(self.buffer):
            self.file.seek(self.file.tell() + n - len(self.buffer))
            self.buffer = b""
            return self.file.tell() <= self.size
        while n > 0:
            n -= len(self.buffer)
            self.buffer = b"" if n >= 0 else self.buffer[n:]
            if n > 0 and not self.more():
                return False
        return True

    def is_cut(self) -> bool:
        """Whether something is left that is no whole record, or the member has no end."""
        return bool(self.buffer.strip()) or (self.gzipped and not self.pool.eof)

    def end(self) -> int:
        """Where the next record or member starts."""
        if not self.gzipped:
            return self.file.tell() - len(self.buffer)
        if self.length:
            return self.start + self.length
        while not self.pool.eof:
            self.buffer = b""
            if not self.more():
                break
        return self.file.tell() - len(self.pool.unused_data)


def records(file, size: int, wanted, payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Headers (names in lower case) and payloads of the records whose headers are wanted.

    The payload is None if it is not asked for. Raises ``CutOff`` at a record that
    the file does not have whole, after those before it.
    """
    at = 0
    while at < size:
        stream = _Stream(file, at, size)
        while True:
            head = stream.until(b"\r\n\r\n")
            if head is None:
                if stream.is_cut():
                    raise CutOff(f"the file ends inside the headers of a record, after byte {at}")
                break
            lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record at byte {at}")
            headers: dict[str, str] = {}
            for line in lines[1:]:
                if line[:1] in " \t" and headers:  # a folded line
                    last = next(reversed(headers))
                    headers[last] += " " + line.strip()
                else:
                    name, _, value = line.partition(":")
                    headers[name.strip().lower()] = value.strip()
            length = int(headers.get("content-length", 0))
            body = None
            take = wanted(headers)
            if take and payload:
                body = stream.take(length)
                whole = len(body) == length
                if headers.get("content-type", "").startswith("application/http"):
                    body = body.partition(b"\r\n\r\n")[2]
            elif stream.length:
                whole = at + stream.length <= size
            else:
                whole = stream.skip(length)
            if not whole:
                raise CutOff(f"the file ends inside a record of {length} bytes, after byte {at}")
            if take:
                yield headers, body
            if stream.length:  # the member has this record only, and says where it ends
                break
            stream.skip(4)
            if not stream.gzipped and stream.end() >= size:
                break
        after = stream.end()
        if after <= at:
            return
        at = after


@dataclass
class _Files(InputPartition):
    files: tuple


@dataclass
class _Written(WriterCommitMessage):
    files: tuple


def _value(column: str, headers: dict[str, str]):
    value = headers.get(_FIELDS[column].lower())
    if column in ("record_id", "refers_to", "target_uri"):
        return _unbracket(value)
    if column == "payload_sha1":
        return _hex_digest(value)
    if column == "payload_length":
        return int(value) if value is not None else None
    return value


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.arrow = pa.schema(
            [
                (n, {"payload": pa.binary(), "payload_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string())}.get(n, pa.string()))
                for n in self.names
            ]
        )
        self.path = options["path"]
        self.partition_bytes = int(options.get("partitionBytes", 64 << 20))
        self.on_cut = options.get("cutOff", "fail")
        if self.on_cut not in ("fail", "skip"):
            raise ValueError("cutOff must be fail or skip")
        self.tests: list[tuple[str, str, tuple]] = []
        if types := options.get("recordTypes"):
            self.tests.append(("record_type", "in", tuple(types.split(","))))

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in _FIELDS and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in _FIELDS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in _FIELDS and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", (f.value,)))
            elif column in _FIELDS and isinstance(f, IsNotNull):
                self.tests.append((column, "some", ()))
            else:
                yield f

    def partitions(self):
        fs, root = _open_fs(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "_.")
        groups, size = [[]], 0
        for path, n in files:
            if size and size + n > self.partition_bytes:
                groups.append([])
                size = 0
            groups[-1].append((path, n))
            size += n
        return [_Files(tuple(g)) for g in groups]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for column, test, values in self.tests:
            value = _value(column, headers)
            if value is None or (test == "in" and value not in values) or (test == "starts" and not value.startswith(values[0])):
                return False
        return True

    def _records(self, file, size: int, path: str):
        try:
            yield from records(file, size, self._wanted, "payload" in self.names)
        except CutOff as e:
            if self.on_cut == "fail":
                raise CutOff(f"{path}: {e}") from None

    def read(self, partition):
        fs, _ = _open_fs(self.path)
        rows, held = [], 0
        for path, size in partition.files:
            with fs.open_input_file(path) as file:
                for headers, body in self._records(file, size, path):
                    rows.append(
                        tuple(
                            body if n == "payload" else list(headers.items()) if n == "headers" else _value(n, headers)
                            for n in self.names
                        )
                    )
                    held += len(body or b"") + 1000
                    if held > 8 << 20:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), self.arrow.types)]
        return pa.RecordBatch.from_arrays(columns, schema=self.arrow)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.file_bytes = options["path"], int(options.get("fileBytes", 256 << 20))

    def write(self, iterator):
        fs, root = _open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files, out = [], None
        for batch in iterator:
            # a few rows at a time: Python values take several times the room
            for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
                for row in part.to_pylist():
                    if out is None:
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out = fs.open_output_stream(f"{root}/_{files[-1]}", compression=None)
                    out.write(gzip_member(record_bytes(row)))
                    if out.tell() >= self.file_bytes:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        return _Written(tuple(files))

    def commit(self, messages):
        fs, root = _open_fs(self.path)
        for message in messages:
            for name in message.files if message else ():
                fs.move(f"{root}/_{name}", f"{root}/{name}")

    def abort(self, messages):
        fs, root = _open_fs(self.path)
        for message in messages:
            for name in message.files if message else ():
                fs.delete_file(f"{root}/_{name}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").save(path)``.

    Columns are those of ``SCHEMA`` or some of them: give ``.schema(...)`` without
    ``payload`` to read headers only. Options: ``recordTypes`` (comma-separated;
    filters do the same where the session pushes them down), ``partitionBytes``,
    ``fileBytes``, ``cutOff``: a file that ends inside a record fails the job (``fail``,
    the default) or gives the whole records before it (``skip``).
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets filters through to readers that take them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


#: Equal payloads from this size on are stored once.
REVISIT_BYTES = 1000


def page_records(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A record of ``SCHEMA`` for every page; the largest id of equal payloads keeps the payload.

    A null text is empty, a null url leaves the target out, and a null id is
    ``urn:page:null``; it never keeps a payload that a page with an id also has.
    Rows with the same id and payload all keep theirs.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id).alias("_id"), F.col(url).alias("target_uri"), payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("payload_length"), F.sha1(payload).alias("payload_sha1"),
    )
    sizes = rows.filter(F.col("payload_length") >= REVISIT_BYTES).groupBy("payload_sha1")
    sizes = staged(sizes.agg(F.max("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1"), "warc-copies")
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    rows = join_keyed(rows, sizes, "payload_sha1", "_n", total, how="left")
    copy = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return rows.select(
        name("_id").alias("record_id"),
        F.when(copy, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(copy, name("_first")).alias("refers_to"),
        "payload_sha1", "payload_length",
        F.when(~copy, F.col("payload")).alias("payload"),
    )


def page_id(record_id: str):
    """The page id out of a record id of ``page_records``."""
    return F.expr(f"try_cast(substring({record_id}, 10) AS bigint)")


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """The archives of pages, written to the shared folder and read back."""
    spark = pages.sparkSession
    register(spark)
    path = new_folder(spark, "warc")
    page_records(pages, **columns).write.format("warc").mode("append").save(path)
    return spark.read.format("warc").load(path)
