"""WARC archives written and read as a table of chunks.

A payload is cut into chunks; each chunk is a row (record id, chunk number) and a WARC record: the first one of the record's own
type, the others ``continuation`` segments. A record's digest is carried from chunk to chunk, on writing and on reading, so no record
is put together as a whole. Spark's text writer and reader move the bytes (the end of a record is the line separator), so
archives can lie in any store Spark reaches. A payload seen before is a ``revisit`` record that names the one kept.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewise as bw
from .tables import work_dir

CHUNK = 256 << 10
END = b"\r\n\r\n"
#: Payloads of fewer bytes are always written whole.
LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def typed(pages: DataFrame, id_col: str, payload) -> DataFrame:
    """``pages`` with payload, digest, record type and refers_to. Of rows with equal payload those with the largest id are responses.

    The digest is of the whole payload; equal digest and length count as equal payloads. Null payload is empty.
    """
    rows = pages.withColumn("warc_payload", F.coalesce(payload, F.lit(b""))).withColumn("warc_sha1", F.sha1("warc_payload"))
    rows = rows.withColumn("warc_bytes", F.octet_length("warc_payload").cast("long"))
    kept = (
        rows.filter(F.col("warc_bytes") >= LEAST_REVISIT).groupBy("warc_sha1", "warc_bytes").agg(F.max(id_col).alias("warc_kept"), F.count("*").alias("n"))
        .filter("n > 1 and warc_kept is not null").drop("n")
    )
    rows = rows.join(kept, ["warc_sha1", "warc_bytes"], "left")
    again = F.coalesce(F.col("warc_kept") != F.col(id_col), F.col("warc_kept").isNotNull())
    return rows.withColumn("warc_refers_to", F.when(again, F.col("warc_kept")))


def _header(kind: str, record: str, length: int, **more) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:row:{record}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in more.items() if v is not None]
    return "\r\n".join([*head, f"Content-Length: {length}"]).encode()


def _segments(page_id, url, payload: pa.BinaryScalar, sha1: str, refers_to):
    """Records of one row; the digest is built up chunk by chunk and stands in the last of them."""
    name = "" if page_id is None else str(page_id)
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    view = memoryview(payload.as_buffer())
    if refers_to is not None:
        digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
        yield _header("revisit", name, 0, WARC_Target_URI=uri, WARC_Refers_To=f"<urn:row:{refers_to}>", WARC_Profile=PROFILE, WARC_Payload_Digest=digest, X_Payload_Length=len(view)) + END
        return
    state, number = hashlib.sha1(), -(-len(view) // CHUNK) or 1
    for k in range(number):
        chunk = view[k * CHUNK : (k + 1) * CHUNK]
        state.update(chunk)
        more = {"WARC_Target_URI": uri}
        if number > 1:
            more |= {"WARC_Segment_Number": k + 1}
            if k:
                more |= {"WARC_Segment_Origin_ID": f"<urn:row:{name}>"}
        if k == number - 1:
            more |= {"WARC_Segment_Total_Length": len(view) if number > 1 else None, "WARC_Payload_Digest": "sha1:" + base64.b32encode(state.digest()).decode()}
        yield _header("continuation" if k else "response", name if not k else f"{name}:{k + 1}", len(chunk), **more) + END + bytes(chunk)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One WARC record per row of ``pages`` (oversized ones in segments), as gzip files below ``path``."""

    def run(batches):
        for batch in batches:
            out, size = [], 0
            cols = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                for record in _segments(cols[0][i].as_py(), cols[1][i].as_py(), cols[2][i], cols[3][i].as_py(), cols[4][i].as_py()):
                    out.append(record)
                    size += len(record)
                    if size > 4 << 20:
                        yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])
                        out, size = [], 0
            yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])

    rows = typed(pages, id_col, F.encode(F.col(html_col), "UTF-8"))
    rows = rows.select(F.col(id_col).cast("long"), url_col, "warc_payload", "warc_sha1", "warc_refers_to")
    rows.mapInArrow(bw.released(run), "value binary").select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


class Parser:
    """Byte stream of an archive to one row per record; a segment's bytes go into the record's digest and are let go."""

    def __init__(self):
        self.buffer, self.left, self.state, self.record, self.rows = bytearray(), -1, None, None, []

    def feed(self, data: bytes) -> None:
        self.buffer += data
        while True:
            if self.left < 0:
                cut = self.buffer.find(END)
                if cut < 0:
                    return
                self._begin(self.buffer[:cut].decode())
                del self.buffer[: cut + 4]
            if self.left > 0:
                part = self.buffer[: self.left]
                self.state.update(part)
                self.bytes += len(part)
                self.left -= len(part)
                del self.buffer[: len(part)]
            if self.left > 0 or len(self.buffer) < 4:
                return
            if self.buffer[:4] != END:
                raise ValueError("a WARC record does not end where its length says")
            del self.buffer[:4]
            self.left = -1
            self._end()

    def _begin(self, text: str) -> None:
        lines = text.split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record begins here")
        self.head = dict(x.split(": ", 1) for x in lines[1:])
        self.left = int(self.head["Content-Length"])
        if self.head["WARC-Type"] != "continuation":
            self.record, self.state, self.bytes = self.head, hashlib.sha1(), 0

    def _end(self) -> None:
        digest = self.head.get("WARC-Payload-Digest")
        if digest is None:  # more segments follow
            return
        told = base64.b32decode(digest.removeprefix("sha1:")).hex()
        kind = self.record["WARC-Type"]
        if kind == "response" and told != self.state.hexdigest():
            raise ValueError("a payload differs from its digest")
        name = lambda h: (lambda x: int(x) if x else None)(self.record[h].removeprefix("<urn:row:").removesuffix(">")) if h in self.record else None
        size = self.bytes if kind == "response" else int(self.record["X-Payload-Length"])
        self.rows.append((name("WARC-Record-ID"), size, told, kind, name("WARC-Refers-To")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; each archive file is one stream."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        parser = Parser()
        for batch in batches:
            for value in batch.column(0):
                parser.feed(value.as_py())
                parser.feed(END)
            rows, parser.rows = parser.rows, []
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    lines = spark.read.option("lineSep", END.decode()).text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(bw.released(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame) -> DataFrame:
    """``pages`` written as archives to the shared folder and read back."""
    spark = pages.sparkSession
    path = work_dir(spark, "warc")
    write(pages, path)
    return read(spark, path)
