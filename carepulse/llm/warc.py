"""WARC archives as seekable Zstandard bundles.

Every task writes its records to one bundle: records are grouped into frames that can
be read by themselves (about ``FRAME_BYTES`` each, never a part of a record), and the
file ends with the seek table of the Zstandard seekable format (a skippable frame with
every frame's compressed size, size and checksum). An index maps each record's
identifier to its bundle, its frame and its place in the unpacked frame, so one record
costs one range read and one frame.

Equal payloads are stored once: the record with the largest page id of those with equal
payloads (of at least ``min_revisit`` bytes) is a response, the others are revisits that
refer to it. Bundles are named by task attempt and the index comes out of the same task,
so a retried task's index rows always fit its own file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME_BYTES = 1 << 20
MIN_REVISIT = 1000
LEVEL = 3
#: Fixed values of the Zstandard seekable format and of WARC.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = (
    "page_id long, record_id string, record_type string, bundle string, frame_offset long, frame_bytes long, "
    "record_offset long, record_bytes long"
)
_INDEX_NAMES = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
_INDEX_TYPES = [pa.string() if c.split()[1] == "string" else pa.int64() for c in INDEX_SCHEMA.split(", ")]
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _file(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return pafs.FileSystem.from_uri(path)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(record: str) -> int | None:
    name = record[len("<urn:page:") : -1]
    return None if name == "none" else int(name)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head (with the payload's length) and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m.group()):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record's type, page id, payload length and digest, the page it refers to, and its payload (None in a revisit)."""
    stop = data.index(b"\r\n\r\n")
    lines = data[:stop].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(line.split(": ", 1) for line in lines[1:])
    block = data[stop + 4 : stop + 4 + int(head["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http).group(1))
    digest = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
    whole = head["WARC-Type"] == "response"
    if whole and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
    return {
        "record_type": head["WARC-Type"],
        "page_id": _page_id(head["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": _page_id(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None,
        "payload": payload if whole else None,
    }


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """The closing skippable frame for (compressed size, size, checksum) of every frame."""
    body = b"".join(struct.pack("<III", *f) for f in frames) + struct.pack("<IBI", len(frames), 0x80, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(path: str) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, size, checksum) of every frame, from a bundle's end."""
    fs, name = _file(path)
    with fs.open_input_file(name) as f:
        size = f.size()
        count, flags, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end")
        width = 12 if flags & 0x80 else 8
        raw = f.read_at(count * width, size - 9 - count * width)
    out, at = [], 0
    for i in range(count):
        entry = struct.unpack_from("<III" if width == 12 else "<II", raw, i * width)
        out.append((at, entry[0], entry[1], entry[2] if width == 12 else 0))
        at += entry[0]
    return out


def _writer(folder: str, frame_bytes: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.zst"
        fs, place = _file(name)
        pack = zstandard.ZstdCompressor(level=LEVEL)
        out, at, frames = None, 0, []
        waiting: list[tuple] = []
        parts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal out, at, held
            if out is None:
                fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(place, compression=None)
            raw = b"".join(parts)
            frame = pack.compress(raw)
            out.write(frame)
            frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            rows = [(p, r, k, name, at, len(frame), o, n) for p, r, k, o, n in waiting]
            at += len(frame)
            held = 0
            waiting.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INDEX_TYPES)], names=_INDEX_NAMES)

        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                page, url, payload, digest, refers = (c[i].as_py() for c in columns)
                record = make_record(page, url, payload, digest, refers)
                if held and held + len(record) > frame_bytes:
                    yield flush()
                waiting.append((page, record_id(page), "response" if refers is None else "revisit", held, len(record)))
                parts.append(record)
                held += len(record)
        if held:
            yield flush()
        if out is not None:
            out.write(seek_table(frames))
            out.close()

    return run


def write_bundles(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_revisit: int = MIN_REVISIT, frame_bytes: int = FRAME_BYTES,
) -> DataFrame:
    """Writes a record per row of ``pages`` to bundles under ``path``/bundles and the index to
    ``path``/index; returns the index as read from there.

    A null html is an empty payload, a null url leaves its header out, a null id is
    written as ``none`` and never referred to (it revisits, if the group has an id).
    Rows that repeat the group's largest id are all responses. An empty table gives an
    empty index and no bundle. Further columns are not read. Only records of groups of
    equal payloads are looked up in the table of such groups; a very large group is
    split by the adaptive skew join.
    """
    body = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.select("page", "url", "payload", F.sha1("payload").alias("digest"), F.xxhash64("payload").alias("other"), F.octet_length("payload").alias("size"))
    groups = rows.where(F.col("size") >= min_revisit).groupBy("digest", "other", "size").agg(F.max("page").alias("first"), F.count("*").alias("n"))
    groups = groups.where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("d"), F.col("other").alias("o"), F.col("size").alias("s"), "first")
    same = (F.col("digest") == F.col("d")) & (F.col("other") == F.col("o")) & (F.col("size") == F.col("s"))
    refers = F.when(F.col("page").isNull() | (F.col("page") < F.col("first")), F.col("first"))
    named = rows.join(groups, same, "left").select("page", "url", "payload", "digest", refers.alias("refers"))
    index = named.mapInArrow(_writer(f"{path}/bundles", frame_bytes), INDEX_SCHEMA)
    index.write.mode("overwrite").parquet(f"{path}/index")
    return pages.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")


def read_frame(path: str, offset: int, size: int) -> bytes:
    """One unpacked frame of a bundle, by a range read."""
    import zstandard

    fs, name = _file(path)
    with fs.open_input_file(name) as f:
        return zstandard.ZstdDecompressor().decompress(f.read_at(size, offset))


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _reader(with_payload: bool):
    def run(batches):
        last, raw = None, b""
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if (r.bundle, r.frame_offset) != last:
                    last, raw = (r.bundle, r.frame_offset), read_frame(r.bundle, r.frame_offset, r.frame_bytes)
                x = parse_record(raw[r.record_offset : r.record_offset + r.record_bytes])
                row = (x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"])
                out.append((*row, x["payload"]) if with_payload else row)
            names = [c.split()[0] for c in _RECORD.split(", ")] + ["payload"] * with_payload
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    return run


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that the rows of ``index`` (all of them or some) point to, read from the bundles.

    Rows of one frame are read by one task, the frame once. Payloads are checked
    against their digests; a revisit's length and digest come from its headers.
    """
    # A number of its own: merged by the bytes of the small index, a task would unpack
    # a hundred times as many bytes of records.
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_frame = index.repartition(tasks, "bundle", "frame_offset").sortWithinPartitions("bundle", "frame_offset", "record_offset")
    by_frame = by_frame.select("bundle", "frame_offset", "frame_bytes", "record_offset", "record_bytes")
    return by_frame.mapInPandas(_reader(with_payload), _RECORD + (", payload binary" if with_payload else ""))
