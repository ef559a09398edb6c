"""WARC archives: a writer, and a sequential reader.

The reader takes one gzip member per record: the compressed stream is fed to zlib piece by piece and never
read as a whole; a record's block is framed by its Content-Length, and its payload is checked against
WARC-Payload-Digest while it passes. Writer and reader run in tasks and stream files over
``pyarrow.fs``, so the folder can be in any store that all executors see.

A payload of ``REVISIT`` bytes or more that other records have too is stored once, as the response with the
largest id; the others are revisit records that refer to it. Which is which is decided from slim rows (SHA-256,
length, id), never from payloads: groups are written before slim rows meet them, so Spark can split a hot payload,
and the revisits found are written before pages meet them by id and digest, which no key is hot in.
A read revisit gets length and digest from the response that it names, which has to be there with that digest.

Defined results: null html is an empty payload, null urls are empty, a null id is the id ``-``, read
back as null. Rows that repeat the largest id of a payload are responses each. A record
cut short, a wrong digest, headers that are missing or aren't UTF-8, and data that isn't gzip raise an error that names file and place;
so does a revisit whose response isn't found.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import text_of, written

REVISIT, ARCHIVE_BYTES, PIECE, LEVEL = 1000, 64_000_000, 1 << 16, 4


class WarcError(ValueError):
    pass


def record(kind: str, uri: str, page_id, payload: bytes | None, digest: str, refers_to=None) -> bytes:
    """One record as a gzip member. digest is hexadecimal SHA-1; a revisit has no payload of its own."""
    block = b"" if payload is None else payload
    name = lambda x: f"<urn:page:{'-' if x is None else x}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_one_line(uri)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _one_line(uri: str | None) -> str:
    return (uri or "").replace("\r", "%0D").replace("\n", "%0A")


class Reader:
    """Records of one archive, in order: (headers, payload)."""

    def __init__(self, stream, name: str = "", piece: int = PIECE):
        self.stream, self.name, self.piece = stream, name, piece
        self.rest, self.at = b"", 0

    def _more(self) -> bytes:
        new = self.stream.read(self.piece)
        self.at += len(new)
        return new

    def _member(self) -> Iterator[bytes]:
        """The decompressed pieces of the next gzip member."""
        inflate = zlib.decompressobj(31)
        data = self.rest or self._more()
        while True:
            try:
                yield inflate.decompress(data, 1 << 20)
                while inflate.unconsumed_tail:
                    yield inflate.decompress(inflate.unconsumed_tail, 1 << 20)
            except zlib.error as error:
                raise WarcError(f"{self.name}: not gzip before byte {self.at}: {error}") from error
            if inflate.eof:
                self.rest = inflate.unused_data
                return
            data = self._more()
            if not data:
                raise WarcError(f"{self.name}: the last record is cut short at byte {self.at}")

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            self.rest = self.rest or self._more()
            if not self.rest:
                return
            pieces = self._member()
            head = b""
            while b"\r\n\r\n" not in head:
                new = next(pieces, None)
                if new is None:
                    raise WarcError(f"{self.name}: a record without headers before byte {self.at}")
                head += new
            head, _, body = head.partition(b"\r\n\r\n")
            try:
                first, *lines = head.decode().split("\r\n")
            except UnicodeDecodeError as error:
                raise WarcError(f"{self.name}: headers that aren't UTF-8 before byte {self.at}") from error
            if not first.startswith("WARC/"):
                raise WarcError(f"{self.name}: not a WARC record: {first[:40]!r}")
            headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            if missing := {"warc-type", "warc-record-id", "content-length"} - headers.keys():
                raise WarcError(f"{self.name}: a record without {', '.join(sorted(missing))} before byte {self.at}")
            if not headers["content-length"].isdecimal():
                raise WarcError(f"{self.name}: {headers['warc-record-id']} has the length {headers['content-length']!r}")
            length = int(headers["content-length"])
            block, digest, left = [], hashlib.sha1(), length
            while True:
                own = body[:left]
                digest.update(own)
                block.append(own)
                left -= len(own)
                tail = body[len(own) :]
                if not left:
                    break
                body = next(pieces, None)
                if body is None:
                    raise WarcError(f"{self.name}: {left} of {length} bytes are missing in {headers.get('warc-record-id')}")
            if (tail + b"".join(pieces)) != b"\r\n\r\n":
                raise WarcError(f"{self.name}: {headers.get('warc-record-id')} doesn't end where its length says")
            if headers.get("warc-type") != "revisit" and (wanted := headers.get("warc-payload-digest")) and wanted != "sha1:" + base64.b32encode(digest.digest()).decode():
                raise WarcError(f"{self.name}: the digest of {headers.get('warc-record-id')} is wrong")
            yield headers, b"".join(block)


def _written(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    task, made, out, size, records = TaskContext.get(), [], None, 0, 0
    name = ""
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("kind", "url", "page_id", "payload", "digest", "refers_to"))):
            kind, url, page_id, payload, digest, refers_to = (x.as_py() for x in row)
            if out is None:  # an attempt that fails leaves files that nothing names
                name = f"{folder}/part-{task.partitionId():06d}-{len(made):04d}-{task.taskAttemptId()}.warc.gz"
                out, size, records = store.open_output_stream(f"{base}/{name.rpartition('/')[2]}"), 0, 0
            data = record(kind, url, page_id, payload, digest, refers_to)
            out.write(data)
            size, records = size + len(data), records + 1
            if size >= ARCHIVE_BYTES:
                out.close()
                made, out = [*made, (name, records, size)], None
    if out is not None:
        out.close()
        made.append((name, records, size))
    columns = list(zip(*made)) if made else [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> records: kind, url, page_id, payload (null for revisits), digest, refers_to."""
    payload = F.encode(text_of("html"), "UTF-8")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    slim = own.filter(F.length("payload") >= REVISIT).select("page_id", F.unhex(F.sha2("payload", 256)).alias("sha"))
    groups = written(slim.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 AND last IS NOT NULL").select("sha", "last"), "groups")
    again = slim.join(groups, "sha").filter(~F.col("page_id").eqNullSafe(F.col("last"))).distinct()
    again = written(again.select("sha", F.coalesce("page_id", F.lit(0)).alias("number"), F.col("page_id").isNull().alias("absent"), "last"), "revisits")
    named = own.withColumn("sha", F.when(F.length("payload") >= REVISIT, F.unhex(F.sha2("payload", 256)))).withColumn("number", F.coalesce("page_id", F.lit(0))).withColumn("absent", F.col("page_id").isNull())
    joined = named.join(again, ["number", "absent", "sha"], "left")
    revisit = F.col("last").isNotNull()
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("kind"), "url", "page_id", F.when(~revisit, F.col("payload")).alias("payload"), F.sha1("payload").alias("digest"), F.col("last").alias("refers_to")
    )


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes records as archives of about ARCHIVE_BYTES each; path, records and bytes of each. Runs when it is read: write it before what follows."""
    return records.mapInArrow(lambda b: _written(b, folder), "path string, records long, bytes long")


SCHEMA = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def _id_of(name: str | None, where: str) -> int | None:
    if name is None or name == "<urn:page:->":
        return None
    if not (name.startswith("<urn:page:") and name.endswith(">") and name[10:-1].lstrip("-").isdecimal()):
        raise WarcError(f"{where}: {name!r} isn't the id of a page")
    return int(name[10:-1])


def _digest_of(headers: dict[str, str], where: str) -> str:
    found = headers.get("warc-payload-digest", "")
    try:
        if found.startswith("sha1:"):
            return base64.b32decode(found[5:]).hex()
    except ValueError:
        pass
    raise WarcError(f"{where}: {headers['warc-record-id']} has the payload digest {found!r}")


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows, size = [], 0
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_stream(name) as stream:
                for h, payload in Reader(stream, path):
                    revisit = h["warc-type"] == "revisit"
                    rows.append((_id_of(h["warc-record-id"], path), h.get("warc-target-uri"), h["warc-type"], _id_of(h.get("warc-refers-to"), path), None if revisit or not payloads else payload, None if revisit else len(payload), _digest_of(h, path)))
                    size += len(payload) * payloads + 200
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """paths (path) -> a row per record; payload and payload_bytes of revisits are null, see resolved(). Each archive is read by one task, from its start, in pieces."""
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.select("path").repartition(n, "path").mapInArrow(lambda b: _read(b, payloads), SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """records, revisits with the payload_bytes of the response that they name and whose digest is theirs. records should be a written table: responses are written apart, so Spark can split a hot one."""
    first = F.col("record_type") == "response"
    known = records.filter(first & F.col("page_id").isNotNull()).groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("its_bytes"))
    again = records.filter(~first).join(written(known, "responses"), ["refers_to", "payload_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("no response "), F.coalesce(F.col("refers_to").cast("string"), F.lit("-")), F.lit(" with the digest "), "payload_digest"))
    found = again.withColumn("payload_bytes", F.coalesce("its_bytes", lost.cast("long")))
    return records.filter(first).unionByName(found.select(*records.columns))
