"""WARC archives: written with revisit records for repeated payloads, read back by boundary-chain verification.

Writing: of the pages with equal payloads, the one with the largest page_id becomes a response record and the others
revisit it. Each task streams its records to archives in the shared folder, which it rolls over at a size.

Reading: tasks over byte ranges look for the magic line and emit each candidate with the offset of its successor, which
follows from the record's own length. A candidate is a record only if the chain of successors from the file's start
reaches it; pointer jumping (each round doubles the length of the jumps) finds these in logarithmically many rounds,
so a magic line inside a payload is rejected. Each chain has to end at the file's end.

A null payload is empty. Rows that tie for the largest page_id are all responses, and so are rows without a page_id
where no page with an id has the payload. A payload of any length is one record. An empty table gives no archive and no rows. Of other
columns only url is read, so their names do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import attach, by_value, new_path, stage, trimmed, utf8

MAGIC = b"WARC/1.0\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = b"http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Archives are closed when they have so many bytes.
ROLL_BYTES = 16 << 20
#: Bytes of a range in which a task looks for candidates, and of a read.
RANGE_BYTES = 4 << 20
#: Bytes of archives for each reading task, about.
TASK_BYTES = 32 << 20


def record_id(page_id: int | None, copy: str = "") -> bytes:
    """The id of the response of a page, or with copy of another record of it."""
    return b"<urn:page:%s%s>" % (b"none" if page_id is None else b"%d" % page_id, f":{copy}".encode() if copy else b"")


def page_of(value: bytes) -> int | None:
    number = value[len(b"<urn:page:") : -1].partition(b":")[0]
    return None if number == b"none" else int(number)


def encode_record(page_id: int | None, url: str | None, payload: bytes, original: int | None, revisit: bool, copy: str = "") -> bytes:
    """One record, its two closing line ends included. copy tells it apart from other records of the page."""
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    target = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "").encode())
    block = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    lines = [b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + record_id(page_id, copy if revisit or page_id is None else ""), b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + target, b"WARC-Payload-Digest: sha1:" + digest, b"X-Payload-Length: %d" % len(payload)]
    if revisit:
        lines += [b"WARC-Refers-To: " + record_id(original), b"WARC-Profile: " + PROFILE]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return MAGIC + b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def header(head: bytes) -> dict[bytes, bytes] | None:
    """The named fields in lower case, or None if these are no record's. No length has over 18 digits."""
    fields, at = {}, head.find(b"\r\n")
    while at >= 0:  # line by line, as false ones end soon
        stop = head.find(b"\r\n", at + 2)
        name, colon, value = head[at + 2 : stop if stop >= 0 else len(head)].partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
        at = stop
    length = fields.get(b"content-length", b"")
    return fields if length.isdigit() and len(length.lstrip(b"0")) <= 18 and b"warc-type" in fields else None


def header_end(data: bytes, at: int, stop: int) -> int:
    """Where to stop reading a header that begins at at and should end at stop: before the next magic line, which no header has in it."""
    following = data.find(b"\r\n" + MAGIC, at + len(MAGIC) - 2, stop)
    return stop if following < 0 else following + len(MAGIC)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) as archives and gives their (file, bytes).

    Files carry the attempt's number and only those of committed attempts are listed, so a task that runs again does
    no harm.
    """
    key = F.sha2(F.coalesce("html", F.lit("")), 256)
    keyed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", key.alias("key"))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for b in batches:
            texts = utf8(b["html"])
            packed = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], b["key"], packed, pa.array(map(len, texts), pa.int64())], ["page_id", "url", "key", "packed", "bytes"])

    first = stage(keyed.groupBy("key").agg(F.max("page_id").alias("original"), F.count("*").alias("n")), "warc-first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at)
        task = TaskContext.get()
        codec = pa.Codec("zstd")
        out, file, size, done, number, count = None, "", 0, [], 0, 0
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    file = f"{task.partitionId():06d}-{number:06d}-{task.taskAttemptId()}.warc"
                    out, size, number = store.open_output_stream(f"{at}/{file}"), 0, number + 1
                revisit = r["original"] is not None and r["page_id"] != r["original"]
                payload = codec.decompress(r["packed"], r["bytes"], asbytes=True)
                data = encode_record(r["page_id"], r["url"], payload, r["original"], revisit, f"{task.partitionId()}-{count}")
                count += 1
                out.write(data)
                size += len(data)
                if size >= ROLL_BYTES:
                    out.close()
                    done.append((file, size))
                    out = None
        if out is not None:
            out.close()
            done.append((file, size))
        yield pa.RecordBatch.from_pydict({"file": pa.array([p for p, _ in done], pa.string()), "bytes": pa.array([n for _, n in done], pa.int64())})

    # what goes through the shuffle is compressed; the archives are not
    small = keyed.mapInArrow(trimmed(shrink), "page_id long, url string, key string, packed binary, bytes long")
    told = attach(small, first, "key", "n").select("page_id", "url", "packed", "bytes", "original")
    return stage(told.mapInArrow(trimmed(run), "file string, bytes long"), "warc-files")


def tasks(files: DataFrame) -> int:
    return -(-(files.agg(F.sum("bytes")).first()[0] or 1) // TASK_BYTES)


def candidates(files: DataFrame, folder: str) -> DataFrame:
    """(file, at, next) of each place that looks like a record's start, from tasks over byte ranges. One that would end beyond its file is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        for b in batches:
            for r in b.to_pylist():
                found = []
                with store.open_input_file(f"{top}/{r['file']}") as f:
                    end = min(r["start"] + RANGE_BYTES, r["bytes"])
                    data = f.read_at(min(end + len(MAGIC) - 1, r["bytes"]) - r["start"], r["start"])
                    at, stop = data.find(MAGIC), -1
                    while at >= 0:
                        if stop < at:  # an empty line serves all magic lines before it
                            stop = data.find(b"\r\n\r\n", at)
                        head = memoryview(data)[at:stop] if stop >= 0 else None
                        more = RANGE_BYTES
                        while head is None and r["start"] + len(data) < r["bytes"]:  # the header goes on beyond the range
                            data += f.read_at(min(more, r["bytes"] - r["start"] - len(data)), r["start"] + len(data))
                            stop = data.find(b"\r\n\r\n", max(at, len(data) - more - 4))
                            head = memoryview(data)[at:stop] if stop >= 0 else None
                            more *= 2
                        if r["start"] + at < end and head is not None and (fields := header(bytes(head[: header_end(data, at, stop) - at]))):
                            following = r["start"] + stop + 4 + int(fields[b"content-length"].lstrip(b"0") or 0) + 4
                            if following <= r["bytes"]:
                                found.append((r["start"] + at, following))
                        at = data.find(MAGIC, at + 1)
                        if at < 0 or r["start"] + at >= end:
                            break
                yield pa.RecordBatch.from_pydict({"file": pa.array([r["file"]] * len(found), pa.string()), "at": pa.array([a for a, _ in found], pa.int64()), "next": pa.array([n for _, n in found], pa.int64())})

    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(RANGE_BYTES).cast("long"))
    ranges = files.select("file", "bytes", F.explode(starts).alias("start"))
    return ranges.repartition(tasks(files), "file", "start").mapInArrow(trimmed(run), "file string, at long, next long")


def chained(links: DataFrame, files: DataFrame) -> DataFrame:
    """Of candidates (file, at, next), those that the chain from the file's start reaches, by pointer jumping."""
    ends = links.join(links.select("file", F.col("at").alias("next")).hint("merge"), ["file", "next"], "left_semi")
    jumps = stage(ends.select("file", "at", "next"), "warc-jumps")
    reached = links.where("at = 0").select("file", "at")
    while True:  # reached: the first 2^k records of each file; jumps: 2^k records on
        further = stage(reached.hint("merge").join(jumps, ["file", "at"]).select("file", F.col("next").alias("at")), "warc-further")
        if further.isEmpty():
            break
        reached = reached.unionByName(further)
        onward = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        jumps = stage(jumps.hint("merge").join(onward, ["file", "next"]).select("file", "at", F.col("far").alias("next")), "warc-jumps")
    records = stage(links.join(reached.hint("merge"), ["file", "at"]), "warc-records")
    broken = files.join(records.groupBy("file").agg(F.max("next").alias("end")).hint("merge"), "file", "left").where("end is null or end <> bytes")
    if bad := broken.select("file").first():
        raise ValueError(f"the records of {bad['file']} do not end at its end")
    return records


def read_records(records: DataFrame, files: DataFrame, folder: str, html: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and html (null in a revisit, and in all where it is not wanted) of each record."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        f, file, base, data, held = None, None, 0, b"", 0
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["file"] != file:
                    file, base, data = r["file"], 0, b""
                    f = store.open_input_file(f"{top}/{file}")
                if not base <= r["at"] or r["next"] > base + len(data):
                    base = r["at"]
                    data = f.read_at(max(RANGE_BYTES, r["next"] - r["at"]), base)
                record = data[r["at"] - base : r["next"] - base]
                head, _, block = record.partition(b"\r\n\r\n")
                fields = header(head)
                payload = block[:-4].partition(b"\r\n\r\n")[2]
                kind, digest = fields[b"warc-type"].decode(), fields[b"warc-payload-digest"].removeprefix(b"sha1:")
                size = int(fields[b"x-payload-length"])
                if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()) != digest or len(payload) != size):
                    raise ValueError(f"the payload at {r['at']} of {file} does not have its digest")
                text = payload.decode() if html and kind == "response" else None
                refers = page_of(fields[b"warc-refers-to"]) if kind == "revisit" else None
                rows.append({"page_id": page_of(fields[b"warc-record-id"]), "url": fields[b"warc-target-uri"].decode(), "payload_bytes": size, "payload_digest": digest.decode(), "record_type": kind, "refers_to": refers, "html": text})
                held += len(record) if html else 0
                if held >= RANGE_BYTES:  # what waits in a task has a bound in bytes, not in records
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    near = records.withColumn("range", F.floor(F.col("at") / RANGE_BYTES)).repartition(tasks(files), "file", "range").sortWithinPartitions("file", "at")
    return near.select("file", "at", "next").mapInArrow(trimmed(run), schema)


def round_trip(pages: DataFrame, html: bool = True) -> DataFrame:
    """Writes archives of pages (page_id, url, html) to the shared folder and reads every record back."""
    folder = new_path(pages.sparkSession, "warc")
    files = write_archives(pages, folder)
    links = stage(candidates(files, folder), "warc-candidates")
    return read_records(chained(links, files), files, folder, html)


by_value(__name__)
