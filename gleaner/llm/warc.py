"""WARC archives with a two-level capture index.

Pages are written as WARC/1.1 records, one gzip member each, in the order of their reversed-host
URL keys. The index has a line per record, sorted by key and packed into compressed blocks of index files;
a sparse directory at the end of each file holds the first and last key and the place of each block. A lookup
searches the list of files and then a file's directory by bisection, reads the blocks that can hold its keys
by range, bisects their lines and reads the byte ranges they name. It is a job over a table of URLs: block places
are dealt to tasks anew, so one URL with many captures is read by many tasks.

Tasks write archives under names of their own; only files named by the committed index belong
to the collection, so a repeated or lost task leaves nothing that a reader sees.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleaner.llm.sides import checked_broadcast
from gleaner.plans.workspace import fresh_dir, stored
from gleaner.sources.files import resolve

ARCHIVE_BYTES = 1 << 30
BLOCK_LINES = 1000
TASK_BYTES = 64 << 20  # of records that a task reads back
DATE = "1970-01-01T00:00:00Z"  # pages carry no capture time
ENTRY = "key string, page_id long, file string, offset long, length long"
INDEX = "file string, first string, last string, blocks long, lines long, bytes long, directory long, length long"
PLACE = "file string, offset long, length long, key string"  # of a block that can hold the key; all keys for null
RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def surt(url: str) -> Column:
    """Key of a URL: host labels in reverse order, then path and query, all lower-case; empty for null."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"#.*$", "")
    host = F.regexp_extract(rest, r"^[^/?]*", 0)
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.concat(labels, F.lit(")"), F.regexp_replace(rest, r"^[^/?]*", ""))


def _clean(value: str | None) -> str:
    """Header values stay on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def _record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of one decompressed record; its length must be what it says."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record has not the length it says")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    headers["http-length"] = re.search(rb"(?i)content-length: (\d+)", http)[1].decode()
    return headers | {"payload": payload}


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0
) -> DataFrame:
    """Write all pages to WARC files in ``folder``; the written list of index files.

    Of records with equal payloads of at least ``least_bytes`` the one with the smallest id is a response, the others revisit
    it; null html is an empty payload. A page without an id is a revisit if an equal payload has one, else a response. Rows
    that repeat the smallest id are responses alike. Null URLs get an empty target.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html")
    ).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    sized = rows.where(F.octet_length("html") >= least_bytes)
    firsts = sized.groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = checked_broadcast(stored(firsts.select("sha1", "first"), "warc-firsts"))
    rows = rows.join(firsts, "sha1", "left")
    refers = F.when((F.octet_length("html") >= least_bytes) & ~F.col("first").eqNullSafe(F.col("id")), F.col("first"))
    rows = rows.select(surt("url").alias("key"), "id", "url", "html", refers.alias("refers"))
    rows = rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, target = resolve(folder)
        out, name, at = None, "", 0
        for batch in batches:
            lines = []
            for row in zip(*(batch.column(c) for c in ("key", "id", "url", "html", "refers"))):
                key, page, url, html, refers_to = (c.as_py() for c in row)
                payload = html.encode()
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    else:
                        filesystem.create_dir(target, recursive=True)
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = filesystem.open_output_stream(posixpath.join(target, name), compression=None)
                kept = payload if refers_to is None else b""
                member = gzip.compress(_record(page, url, kept, sha1_base32(payload), len(payload), refers_to), 6, mtime=0)
                out.write(member)
                lines.append((key, page, name, at, len(member)))
                at += len(member)
            yield _batch(lines, ENTRY)
        if out is not None:
            out.close()

    lines = stored(rows.mapInArrow(write, ENTRY), "warc-lines")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, target = resolve(folder)
        name, out, held, directory, at, size = f"index-{uuid.uuid4().hex}.blocks", None, [], [], 0, 0

        def close_block(lines: list[list]) -> int:
            data = zlib.compress("\n".join(json.dumps(line) for line in lines).encode())
            out.write(data)
            directory.append([lines[0][0], lines[-1][0], at, len(data), len(lines)])
            return at + len(data)

        for batch in batches:
            rows = [list(row.values()) for row in batch.to_pylist()]
            if rows and out is None:
                out = filesystem.open_output_stream(posixpath.join(target, name), compression=None)
            held += rows
            size += sum(row[4] for row in rows)
            while len(held) >= BLOCK_LINES:
                at = close_block(held[:BLOCK_LINES])
                held = held[BLOCK_LINES:]
        if out is None:
            return
        if held:
            at = close_block(held)
        data = zlib.compress(json.dumps(directory).encode())
        out.write(data)
        out.close()
        row = (name, directory[0][0], directory[-1][1], len(directory), sum(d[4] for d in directory), size, at, len(data))
        yield _batch([row], INDEX)

    ordered = lines.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return stored(ordered.mapInArrow(pack, INDEX), "warc-index")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _read(filesystem, target: str, lines: list[list]) -> Iterator[dict]:
    """Records of index lines, each by one range read; files are opened once."""
    handle, opened = None, None
    for _, _, name, offset, length in sorted(lines, key=lambda line: (line[2], line[3])):
        if name != opened:
            handle, opened = filesystem.open_input_file(posixpath.join(target, name)), name
        yield parse_record(gzip.decompress(handle.read_at(length, offset)))


def _rows(records: Iterator[dict]) -> pa.RecordBatch:
    out = []
    for r in records:
        revisit = r["warc-type"] == "revisit"
        digest, size = r["warc-payload-digest"].removeprefix("sha1:"), int(r["http-length"])
        if not revisit and (sha1_base32(r["payload"]) != digest or len(r["payload"]) != size):
            raise ValueError("a payload has not the digest or length its record says")
        page, refers = r["x-page-id"], r.get("x-refers-to-page-id")
        out.append((int(page) if page else None, r["warc-target-uri"], r["warc-type"], int(refers) if revisit else None, None if revisit else r["payload"], size, digest))
    return _batch(out, RECORD)


def _range(filesystem, target: str, name: str, offset: int, length: int) -> bytes:
    with filesystem.open_input_file(posixpath.join(target, name)) as handle:
        return handle.read_at(length, offset)


def _directory(filesystem, target: str, name: str, offset: int, length: int) -> list[list]:
    """Entries ``[first, last, offset, length, lines]`` of an index file."""
    return json.loads(zlib.decompress(_range(filesystem, target, name, offset, length)))


def _records(places: DataFrame, folder: str, tasks: int) -> DataFrame:
    """Records of the given block places; of a place with a key, those of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, target = resolve(folder)
        opened, lines, have = None, [], []
        for batch in batches:
            found = []
            for name, offset, length, key in zip(*(c.to_pylist() for c in batch.columns)):
                if (name, offset) != opened:
                    raw = zlib.decompress(_range(filesystem, target, name, offset, length)).decode()
                    opened, lines = (name, offset), [json.loads(x) for x in raw.split("\n")]
                    have = [line[0] for line in lines]
                low, high = (0, len(lines)) if key is None else (bisect.bisect_left(have, key), bisect.bisect_right(have, key))
                found += lines[low:high]
                while len(found) >= 100:
                    yield _rows(_read(filesystem, target, found[:100]))
                    found = found[100:]
            yield _rows(_read(filesystem, target, found))

    # The number is fixed: places are small, but each stands for up to a block of records.
    dealt = places.repartitionByRange(tasks, "file", "offset", "key").sortWithinPartitions("file", "offset", "key")
    return dealt.mapInArrow(run, RECORD)


def _tasks(index: DataFrame) -> int:
    size = index.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return max(2 * index.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """All records the index names, one row each; payloads are checked against their digests.

    An empty index gives no rows. Revisits have a null payload; records that repeat id and payload are rows of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, target = resolve(folder)
        for batch in batches:
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                yield _batch([(name, at, n, None) for _, _, at, n, _ in _directory(filesystem, target, name, offset, length)], PLACE)

    places = stored(index.select("file", "directory", "length").mapInArrow(run, PLACE), "warc-places")
    return _records(places, folder, _tasks(index))


def lookup(index: DataFrame, folder: str, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The records whose key is that of one of ``urls``, through the directories: only blocks that can hold a key are opened.

    A URL asked for twice, or two of one key, give each record once; a null URL asks for pages without one.
    URLs that no page has, an empty table or an empty index give no rows. Other columns of ``urls`` are not read.
    """
    # A row per index file, of which a shuffle partition wrote one; their number doesn't grow with the pages.
    files = sorted(tuple(r) for r in index.select("first", "last", "file", "directory", "length").collect())
    keys = urls.select(surt(f"`{url_col}`").alias("key")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, target = resolve(folder)
        firsts, lasts = [f[0] for f in files], [f[1] for f in files]
        opened, entries, starts, ends = None, [], [], []
        for batch in batches:
            out = []
            for key in sorted(batch.column(0).to_pylist()):
                for _, _, name, offset, length in files[bisect.bisect_left(lasts, key) : bisect.bisect_right(firsts, key)]:
                    if name != opened:
                        opened, entries = name, _directory(filesystem, target, name, offset, length)
                        starts, ends = [e[0] for e in entries], [e[1] for e in entries]
                    hits = entries[bisect.bisect_left(ends, key) : bisect.bisect_right(starts, key)]
                    out += [(name, at, n, key) for _, _, at, n, _ in hits]
            yield _batch(out, PLACE)

    places = stored(keys.mapInArrow(run, PLACE), "warc-places")
    return _records(places, folder, _tasks(index))


def archive_folder(pages: DataFrame) -> str:
    """A new folder for archives below the shared one."""
    return fresh_dir(pages.sparkSession, "warc")
