"""WARC archives with a two-level capture index.

Pages are written as gzip members, one a record. Captures are sorted by reversed-host URL key and
written as compressed blocks; each index file ends with its sparse block directory (first key, offset,
length), and one row per index file (its first and last key) is the upper level. A lookup
searches the upper level, then the directory, then one block, and reads only that block and its records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, only, store
from .files import Reader, Writer

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "surt string, page_id long, record_type string, digest string, payload_bytes long, refers_to long, archive string, at long, size long"
INDEX_FILES = "first_surt string, last_surt string, file string, directory_at long, directory_size long, captures long"
BLOCKS = "file string, at long, size long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def surt(url: str | None) -> str:
    """Reversed-host key: host labels reversed and joined by commas, then port, ')' and path with query.
    Scheme, user, a leading www. and the fragment are dropped; what has no host keeps its lower-cased text.
    Control characters and blanks are percent-encoded, so that a key fits on a line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", _surt((url or "").strip()))


def _surt(url: str) -> str:
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    port = "" if port is None or (parts.scheme, port) in (("http", 80), ("https", 443)) else f":{port}"
    return f"{','.join(reversed(host.split('.')))}{port}){(parts.path or '/').lower()}{'?' + parts.query if parts.query else ''}"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers, size: int) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-X-Payload-Length: {size}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
        payload = b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def _id(text: str) -> int | None:
    n = text.removeprefix("<urn:page:").removesuffix(">")
    return None if n == "None" else int(n)


def read_record(member: bytes) -> dict:
    """One record from its gzip member; a response whose payload doesn't match its digest is an error."""
    data = zlib.decompress(member, 31)
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return {
        "page_id": _id(fields["WARC-Record-ID"]), "payload_bytes": len(payload) if kind == "response" else int(fields["WARC-X-Payload-Length"]), "payload_digest": digest, "record_type": kind,
        "refers_to": _id(fields["WARC-Refers-To"]) if kind == "revisit" else None, "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None,
    }


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html); returns its captures, a stored table.

    Of rows with equal payloads of at least `least` bytes, those with the largest page_id are responses
    and the others revisit them; smaller payloads are all responses. Only (digest, page_id) is grouped, with
    partial maxima; the payloads meet the table of maxima in one join whose skewed partitions can be split.

    Defined cases: a null html is an empty payload, a null page_id is least of all, a null url is empty; rows that
    are equal in everything give a record each, all of the kind that their page_id has; a payload of any length
    that a string holds is one record; an empty table gives no captures; other columns are ignored.
    """
    rows = only(pages, {"page_id": "long", "url": "string", "html": "string"})
    rows = rows.withColumn("payload", F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))).drop("html").withColumn("sha", F.sha1("payload"))
    last = rows.filter(F.octet_length("payload") >= least).groupBy(F.col("sha").alias("sha_")).agg(F.max("page_id").alias("last"))
    rows = rows.join(last, F.col("sha") == F.col("sha_"), "left").select("page_id", "url", "payload", "sha", "last")

    def write(batches):
        out = None
        for b in batches:
            got = []
            for page, url, payload, sha, last in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                kind = "response" if last is None or page == last else "revisit"
                refers = last if kind == "revisit" else None
                gz = zlib.compressobj(3, zlib.DEFLATED, 31)
                out = out or Writer(folder, "pages.warc.gz")
                at, size = out.write(gz.compress(_record(page, url, payload, digest, kind, refers, len(payload))) + gz.flush())
                got.append({"surt": surt(url), "page_id": page, "record_type": kind, "digest": digest, "payload_bytes": len(payload), "refers_to": refers, "archive": out.uri, "at": at, "size": size})
            yield pa.RecordBatch.from_pylist(got, CAPTURE_SCHEMA)
        if out:
            out.close()

    return store(rows.mapInArrow(write, CAPTURES), "captures")


CAPTURE_SCHEMA = pa.schema([("surt", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("archive", pa.string()), ("at", pa.int64()), ("size", pa.int64())])


def write_index(captures: DataFrame, folder: str, lines: int = 1000) -> DataFrame:
    """Sort captures by (surt, page_id) and write blocks of `lines` lines; returns the index files.

    A line is the key and a JSON object. Ties are ordered by page_id, then by place in the archive.
    """
    order = ["surt", "page_id", "archive", "at"]

    def write(batches):
        out, held, directory, first, last, n = None, [], [], None, None, 0

        def flush():
            nonlocal held
            at, size = out.write(zlib.compress("".join(x for _, x in held).encode(), 6))
            directory.append([held[0][0], at, size])
            held = []

        for b in batches:
            out = out or Writer(folder, "captures.cdx.z")
            for row in b.to_pylist():
                key = row.pop("surt")
                first, last, n = key if first is None else first, key, n + 1
                held.append((key, f"{key}\t{json.dumps(row, separators=(',', ':'))}\n"))
                if len(held) == lines:
                    flush()
        if out:
            if held:
                flush()
            at, size = out.write(zlib.compress(json.dumps(directory).encode(), 6))
            out.close()
            yield pa.RecordBatch.from_pydict({"first_surt": [first], "last_surt": [last], "file": [out.uri], "directory_at": [at], "directory_size": [size], "captures": [n]}, pa.schema([("first_surt", pa.string()), ("last_surt", pa.string()), ("file", pa.string()), ("directory_at", pa.int64()), ("directory_size", pa.int64()), ("captures", pa.int64())]))

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return store(captures.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(write, INDEX_FILES), "index-files")


def _directory(reader: Reader, file: str, at: int, size: int) -> list[list]:
    return json.loads(zlib.decompress(reader.read(file, at, size)))


def _lines(reader: Reader, file: str, at: int, size: int) -> list[str]:
    return zlib.decompress(reader.read(file, at, size)).decode().split("\n")[:-1]


def scan_index(files: DataFrame) -> DataFrame:
    """All captures, block by block, from the index files; blocks are dealt over the cluster."""

    def blocks(batches):
        reader = Reader()
        for b in batches:
            for row in b.to_pylist():
                got = _directory(reader, row["file"], row["directory_at"], row["directory_size"])
                yield pa.RecordBatch.from_pydict({"file": [row["file"]] * len(got), "at": [x[1] for x in got], "size": [x[2] for x in got]}, pa.schema([("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())]))
        reader.close()

    def captures(batches):
        reader = Reader()
        for b in batches:
            for row in b.to_pylist():
                lines = [x.split("\t", 1) for x in _lines(reader, row["file"], row["at"], row["size"])]
                yield pa.RecordBatch.from_pylist([{"surt": k} | json.loads(x) for k, x in lines], CAPTURE_SCHEMA)
        reader.close()

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.mapInArrow(blocks, BLOCKS).repartition(parts).mapInArrow(captures, CAPTURES)


LOCATED = "surt string, file string, at long, size long"


def search_index(pages: DataFrame, files: DataFrame) -> DataFrame:
    """All captures of the URLs of `pages`, each URL's key once.

    A key's index files are found in the sorted list of their first and last keys (one entry a file, as many as
    there were partitions), its blocks in a file's directory, its lines in a block, each time by binary search
    and a range read. Blocks are dealt over the cluster, so that a URL of many captures is read by many tasks.
    A null url is the empty one; keys without captures give no rows.
    """
    uppers = sorted((r["first_surt"], r["last_surt"], r["file"], r["directory_at"], r["directory_size"]) for r in files.collect())
    shared = files.sparkSession.sparkContext.broadcast(uppers)
    captures_of = CAPTURE_SCHEMA

    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in b.column(0).to_pylist()], pa.string())], names=["surt"])

    def locate(batches):
        reader, uppers, held = Reader(), shared.value, (None, None)
        lasts = [u[1] for u in uppers]
        for b in batches:
            out = []
            for key in b.column(0).to_pylist():
                k = bisect_left(lasts, key)
                while k < len(uppers) and uppers[k][0] <= key:
                    _, _, file, at, size = uppers[k]
                    if held[0] != file:
                        held = (file, _directory(reader, file, at, size))
                    firsts = [x[0] for x in held[1]]
                    out += [{"surt": key, "file": file, "at": x[1], "size": x[2]} for x in held[1][max(0, bisect_left(firsts, key) - 1) : bisect_right(firsts, key)]]
                    k += 1
            yield pa.RecordBatch.from_pylist(out, pa.schema([("surt", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())]))
        reader.close()

    def search(batches):
        reader, block, lines, firsts = Reader(), None, [], []
        for b in batches:
            out = []
            for row in b.to_pylist():
                if block != (row["file"], row["at"]):
                    block = (row["file"], row["at"])
                    lines = [x.split("\t", 1) for x in _lines(reader, row["file"], row["at"], row["size"])]
                    firsts = [x[0] for x in lines]
                out += [{"surt": k} | json.loads(x) for k, x in lines[bisect_left(firsts, row["surt"]) : bisect_right(firsts, row["surt"])]]
            yield pa.RecordBatch.from_pylist(out, captures_of)
        reader.close()

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = only(pages, {"url": "string"}).mapInArrow(keys, "surt string").distinct()
    places = wanted.repartitionByRange(parts, "surt").sortWithinPartitions("surt").mapInArrow(locate, LOCATED)
    return places.repartition(parts, "file", "at").sortWithinPartitions("file", "at", "surt").mapInArrow(search, CAPTURES)


def read_archives(captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the captures name, read by ranges; each archive is read in order of place."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def read(batches):
        reader = Reader()
        for b in batches:
            where, at, size = (b.column(n).to_pylist() for n in ("archive", "at", "size"))
            k = 0
            while k < len(where):
                j = k
                while j < len(where) and where[j] == where[k] and j - k < 512:
                    j += 1
                got = [read_record(x) for x in reader.ranges(where[k], list(zip(at[k:j], size[k:j], strict=True)))]
                if not payloads:
                    got = [x | {"payload": None} for x in got]
                yield pa.RecordBatch.from_pylist(got, schema)
                k = j
        reader.close()

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return captures.select("archive", "at", "size").repartition(parts, "archive").sortWithinPartitions("archive", "at").mapInArrow(read, RECORDS)


def lookup(spark: SparkSession, files: DataFrame, url: str) -> list[dict]:
    """The captures of one URL: binary search of the index files' keys, of one directory and of one
    block (more only while the key runs on), each fetched by a range read."""
    key, reader, found = surt(url), Reader(), []
    near = files.filter((F.col("first_surt") <= key) & (F.col("last_surt") >= key)).orderBy("first_surt").collect()  # files that hold this key
    for row in near:
        directory = _directory(reader, row["file"], row["directory_at"], row["directory_size"])
        firsts = [x[0] for x in directory]
        for _, at, size in directory[max(0, bisect_left(firsts, key) - 1) : bisect_right(firsts, key)]:
            lines = _lines(reader, row["file"], at, size)
            keys = [x.split("\t", 1)[0] for x in lines]
            found += [{"surt": key} | json.loads(x.split("\t", 1)[1]) for x in lines[bisect_left(keys, key) : bisect_right(keys, key)]]
    reader.close()
    return found


def archive(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write archives and index below `folder` (default: a new one in the shared folder); returns the index files."""
    folder = folder or new_path(pages.sparkSession, "warc")
    return write_index(write_archives(pages, folder, least), folder)
