"""WARC archives: a writer and a splittable reader (operator 9).

``write_warc`` writes a gzip member per record, one file per task, into a
folder that all executors share, and returns the stored manifest (path,
length) of the files that its successful tasks wrote. ``read_warc`` deals the files
out in byte ranges. A task scans its range for the gzip magic, validates each candidate
member by decoding its first bytes (they must begin a WARC record, and where
the member states its own offset, that must be the place it was found at: bytes inside
a payload that look like a member don't pass), and owns the records whose
members start inside the range, reading past its end to finish the last.

Among records with equal payloads of at least ``min_bytes`` bytes, the one with the
largest page_id is the response, the others are revisits of it without payload.

Defined cases: a null html is an empty payload; a null url is an empty
target; a null page_id is written as such (a revisit if its payload has a
response with an id). Rows that repeat the response's page_id are responses
too. Control characters in urls are percent-encoded. Empty tables give one
empty manifest and no records. Memory per task: one record and one read window.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm.textops import map_arrow, stage_folder, stored

SPLIT_BYTES = 16 << 20
WINDOW = 1 << 20
LEVEL = 3
MAGIC = b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"
PAGE_URN = "urn:x-page:"
RECORD_SCHEMA = (
    "page_id long, record_type string, refers_to long, target_uri string, payload_bytes long, "
    "payload_digest string, payload binary, intact boolean"
)


# ---------------------------------------------------------------- writing


def assign_types(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """page_id, url, html and ``response_id``: the page whose record holds this payload (null: its own does).

    Only digest and id are grouped, with partial aggregation, so a payload that a third of the rows
    share makes one row per task; its result is stored, so that joining it back is a plain join, which Spark splits if one digest is hot.
    """
    p = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    p = p.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    largest = p.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    largest = stored(largest.where(F.col("n") > 1).select(F.col("sha").alias("r_sha"), "largest"))
    joined = p.join(largest, F.col("sha") == F.col("r_sha"), "left")
    own = F.col("largest").isNull() | F.coalesce(F.col("page_id") == F.col("largest"), F.lit(False))
    return joined.select("page_id", "url", "html", F.when(~own, F.col("largest")).alias("response_id"))


def _clean_uri(uri: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)


def record(page_id: int | None, url: str, payload: bytes, response_id: int | None) -> bytes:
    """One WARC/1.1 response or revisit record."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if response_id is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if response_id is None else 'revisit'}",
        f"WARC-Record-ID: <{PAGE_URN}{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if response_id is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <{PAGE_URN}{response_id}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, offset: int) -> bytes:
    """A gzip member that states its own offset in the file in an extra field (subfield 'WO')."""
    extra = b"WO" + struct.pack("<HQ", 8, offset)
    head = MAGIC + b"\x04" + b"\0\0\0\0" + b"\0\xff" + struct.pack("<H", len(extra)) + extra
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = press.compress(data) + press.flush()
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_warc(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0,
) -> DataFrame:
    """Write the pages as WARC files into a new folder (below spark.checkpoint.dir) or a given one; returns
    their manifest (path, length, n_records). A task's retry writes a file of another name, and
    only what the manifest names is read, so lost executors leave no half files or doubled records behind."""
    folder = folder or f"{stage_folder(pages.sparkSession)}/warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, at, n = None, "", 0, 0
        for b in batches:
            for page_id, url, html, response_id in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, inner = _open(path)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(inner, compression=None)
                data = member(record(page_id, url, html.encode(), response_id), at)
                out.write(data)
                at, n = at + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "length": [at], "n_records": [n]})

    rows = assign_types(pages, id_col, url_col, html_col, min_bytes)
    return stored(map_arrow(rows, run, "path string, length long, n_records long"))


# ---------------------------------------------------------------- reading


class _Window:
    """A file read forwards in blocks; bytes before ``keep_from`` are let go."""

    def __init__(self, file: pa.NativeFile, start: int):
        self.file, self.at, self.size, self.data = file, start, file.size(), b""

    def upto(self, end: int) -> None:
        end = min(end, self.size)
        have = self.at + len(self.data)
        if end > have:
            self.data += self.file.read_at(max(end - have, min(WINDOW, self.size - have)), have)

    def drop(self, position: int) -> None:
        self.data, self.at = self.data[position - self.at :], position


def _decode(window: _Window, position: int) -> tuple[bytes, int] | None:
    """The member at ``position`` and its end, or None if no WARC record begins there."""
    window.upto(position + 64)
    head = window.data[position - window.at :][:64]
    if len(head) < 18 or not head.startswith(MAGIC) or head[3] & 0xE0:
        return None
    if head[3] & 4 and head[12:14] == b"WO" and struct.unpack("<Q", head[16:24])[0] != position:
        return None
    unpack, out, at = zlib.decompressobj(wbits=31), [], position
    try:
        while not unpack.eof:
            window.upto(at + 65536)
            piece = window.data[at - window.at :][:65536]
            if not piece:
                return None
            out.append(unpack.decompress(piece))
            at += len(piece)
            if len(out) == 1 and not out[0].startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    return b"".join(out), at - len(unpack.unused_data)


def members(file: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """The records whose members start in [start, end)."""
    window, at = _Window(file, start), start
    while at < end:
        window.upto(min(end + 2, at + WINDOW))
        found = window.data.find(MAGIC, at - window.at)
        if found < 0:
            at = max(at, window.at + len(window.data) - 2)  # a magic may lie across the window's end
            if window.at + len(window.data) >= min(end + 2, window.size):
                return
            window.drop(at)
            continue
        position = window.at + found
        if position >= end:
            return
        window.drop(position)
        got = _decode(window, position)
        at = position + 1 if got is None else got[1]
        if got is not None:
            yield got[0]


def parse(data: bytes) -> dict[str, object]:
    """The fields of one record; ``payload`` is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]

    def page(name: str) -> int | None:
        urn = fields.get(name, "").strip("<>")
        return int(urn.removeprefix(PAGE_URN)) if urn.startswith(PAGE_URN) and not urn.endswith("null") else None

    revisit = fields["WARC-Type"] == "revisit"
    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(fields["X-Payload-Length"]) if revisit and "X-Payload-Length" in fields else len(payload or b"")
    digest = stated if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {
        "page_id": page("WARC-Record-ID"), "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"),
        "target_uri": fields.get("WARC-Target-URI", ""), "payload_bytes": size, "payload_digest": digest,
        "payload": payload, "intact": digest == stated,
    }


def read_warc(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Every record of the files in ``manifest`` (path, length): RECORD_SCHEMA, one row per record."""
    splits = manifest.where(F.col("length") > 0).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    # a numbered repartition, as many tasks as splits: the rows are tiny, and adaptive execution would join the tasks of another one
    tasks = manifest.agg(F.coalesce(F.sum(F.ceil(F.col("length") / split_bytes)), F.lit(0))).first()[0]
    splits = splits.repartition(max(1, int(tasks)), F.col("path"), F.col("start"))
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, inner = _open(path)
                rows, held = [], 0
                with fs.open_input_file(inner) as file:
                    for data in members(file, start, start + split_bytes):
                        row = parse(data)
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    return map_arrow(splits, run, RECORD_SCHEMA)
