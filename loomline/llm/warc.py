"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

write_archives() turns rows into records and stores archives in a folder that driver and executors share (any file
system that pyarrow opens); read_archives() loads each archive's dictionary, decodes one frame per record and validates
versions, required headers, lengths and digests. An archive holds records of one task and at most about `archive_bytes`
of content, so memory is bounded and a lost executor costs one task; names carry the attempt, and only the archives that
a finished task reports are read back.

Null payloads count as empty. Equal payloads of at least `least_revisit` bytes: the row with the smallest id is the
response (rows that share that id are all responses; null ids come last), others are revisits of it. Rows are never
merged: repeated rows give repeated records. An empty table gives no archives and an empty result. Damaged archives
raise ValueError. Columns other than those named are dropped.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_folder

#: Fixed values of the formats.
SKIPPABLE_DICTIONARY = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
CRLF = b"\r\n"
#: Payload bytes a dictionary is trained on at most, of the first records of an archive, and its size.
TRAIN_BYTES, DICTIONARY_BYTES = 2_000_000, 16_384


def record_name(page_id, digest: str) -> str:
    """The record id of a page's payload; what a revisit of it refers to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}')}>"


def record(page_id, url, payload: bytes, n_bytes: int, digest: str, refers_to) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    block = http + (payload if refers_to is None else b"")
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_name(page_id, digest)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")),
        ("WARC-Payload-Digest", f"sha-256:{digest}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_name(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    headers.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + CRLF + CRLF


def archive(records: list[bytes], level: int = 3) -> bytes:
    """A whole archive: skippable frame with the dictionary, then one frame for each record."""
    import zstandard

    sample, taken = [], 0
    for r in records:
        if taken >= TRAIN_BYTES:
            break
        sample.append(r[: TRAIN_BYTES - taken])
        taken += len(sample[-1])
    try:
        words = zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:  # too little to train on: raw content serves as dictionary
        words = b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1"
    kind = zstandard.DICT_TYPE_FULLDICT if words[:4] == struct.pack("<I", DICTIONARY_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT
    data = zstandard.ZstdCompressionDict(words, dict_type=kind)
    writer = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE_DICTIONARY, len(words)), words, *map(writer.compress, records)])


def frame_end(data, at: int) -> int:
    """Where the frame that starts at `at` ends, by its block headers."""
    if at + 6 > len(data) or struct.unpack_from("<I", data, at)[0] != ZSTD_MAGIC:
        raise ValueError(f"no Zstandard frame at byte {at}")
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    pos = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if pos + 3 > len(data):
            raise ValueError(f"the frame at byte {at} is cut off")
        block = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    pos += 4 * checksum
    if pos > len(data):
        raise ValueError(f"the frame at byte {at} is cut off")
    return pos


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, validated."""
    head, found, rest = raw.partition(CRLF + CRLF)
    lines = head.decode("utf-8").split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("not a WARC record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"bad header line: {line[:80]!r}")
        headers[name] = value.strip()
    for name in REQUIRED:
        if name not in headers:
            raise ValueError(f"{name} is missing")
    n = headers["Content-Length"]
    if not n.isdigit() or len(rest) != int(n) + 4 or rest[-4:] != CRLF + CRLF:
        raise ValueError(f"Content-Length is {n}, the block has {len(rest) - 4} bytes")
    return headers, rest[:-4]


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive."""
    import zstandard

    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE_DICTIONARY:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    size = struct.unpack_from("<I", data, 4)[0]
    words = data[8 : 8 + size]
    if len(words) != size:
        raise ValueError("the dictionary frame is cut off")
    try:
        if words[:4] == struct.pack("<I", ZSTD_MAGIC):
            words = zstandard.ZstdDecompressor().decompress(words)
        kind = zstandard.DICT_TYPE_FULLDICT if words[:4] == struct.pack("<I", DICTIONARY_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words, dict_type=kind))
    except zstandard.ZstdError as e:
        raise ValueError(f"the dictionary can't be read: {e}") from e
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        end = frame_end(data, at)
        try:
            raw = reader.decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise ValueError(f"the frame at byte {at} can't be decoded: {e}") from e
        yield parse_record(raw)
        at = end


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, bytes]:
    """Bytes of the full payload as the HTTP headers state them, and the payload that the record holds, validated."""
    head, found, payload = block.partition(CRLF + CRLF)
    m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
    if not found or not head.startswith(b"HTTP/") or not m:
        raise ValueError("the block isn't an HTTP response")
    n = int(m[1])
    algorithm, _, digest = headers.get("WARC-Payload-Digest", "").partition(":")
    if headers["WARC-Type"] == "response":
        if len(payload) != n:
            raise ValueError(f"the payload has {len(payload)} bytes instead of {n}")
        if algorithm == "sha-256" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("the payload doesn't match its digest")
    elif headers["WARC-Type"] == "revisit":
        if payload:
            raise ValueError("a revisit holds a payload")
        if "WARC-Refers-To" not in headers:
            raise ValueError("a revisit refers to nothing")
        page = headers.get("X-Refers-To-Page-Id")
        if page is not None and record_name(page, digest) != headers["WARC-Refers-To"]:
            raise ValueError("a revisit refers to a record of another payload")
    return n, payload


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_revisit: int) -> DataFrame:
    """(page_id, url, payload, n_bytes, digest, refers_to) of every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(64)).cast("int")})
    # ids and digests alone find the copies; only then the payloads move, to their group's share
    thin = materialise(rows.where(F.col("n_bytes") >= least_revisit).select("page_id", "digest", "salt"), "digests")
    many = thin.groupBy("digest", "salt").agg(F.min("page_id").alias("a"), F.max("page_id").alias("b"), F.bool_or(F.col("page_id").isNull()).alias("nulls"))
    groups = many.groupBy("digest").agg(F.min("a").alias("first_id"), F.max("b").alias("last_id"), F.collect_set("salt").alias("s"), F.bool_or("nulls").alias("nulls"))
    groups = groups.where("first_id < last_id OR first_id IS NOT NULL AND nulls").select(F.col("digest").alias("g_digest"), F.explode("s").alias("g_salt"), "first_id")
    joined = rows.join(groups, (F.col("digest") == F.col("g_digest")) & (F.col("salt") == F.col("g_salt")), "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")), F.col("first_id"))
    return joined.select("page_id", "url", "payload", "n_bytes", "digest", refers.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = 16_000_000) -> DataFrame:
    """Stores the rows of with_revisits() as archives in the folder; (path, records) of each archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        held, size, count = [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, count
            name = f"part-{task.partitionId():06d}-{count:04d}-{task.taskAttemptId()}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(archive(held))
            out = pa.RecordBatch.from_pydict({"name": [name], "records": [len(held)]}, pa.schema([("name", pa.string()), ("records", pa.int64())]))
            held, size, count = [], 0, count + 1
            return out

        for b in batches:
            for row in b.to_pylist():
                held.append(record(**row))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return materialise(rows.mapInArrow(write, "name string, records long"), "archives")


def read_archives(spark, folder: str, names: DataFrame | None = None) -> DataFrame:
    """(archive, record_type, page_id, url, n_bytes, digest, refers_to, payload) of every record of the folder's archives, or of those named."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    if names is not None:
        files = files.join(names.select("name"), "name", "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[dict] = []
                for headers, block in read_archive(data):
                    n, payload = payload_of(headers, block)
                    page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                    kind = headers["WARC-Type"]
                    rows.append(
                        {
                            "archive": name,
                            "record_type": kind,
                            "page_id": int(page) if page else None,
                            "url": headers.get("WARC-Target-URI"),
                            "n_bytes": n,
                            "digest": headers.get("WARC-Payload-Digest", "").partition(":")[2],
                            "refers_to": int(refers) if refers else None,
                            "payload": payload if kind == "response" else None,
                        }
                    )
                    if len(rows) >= 512:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)

    return files.select("name", "content").mapInArrow(read, SCHEMA)


SCHEMA = "archive string, record_type string, page_id long, url string, n_bytes long, digest string, refers_to long, payload binary"
ARROW = pa.schema(
    [("archive", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = 100) -> DataFrame:
    """Writes a record for every row and reads the archives again."""
    folder = new_folder(pages.sparkSession, "warc")
    names = write_archives(with_revisits(pages, id_col, url_col, payload_col, least_revisit), folder)
    if names.isEmpty():
        return pages.sparkSession.createDataFrame([], SCHEMA)
    return read_archives(pages.sparkSession, folder, names)


def op2_warc_zstd(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return round_trip(pages).select(
        "page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


QUERIES = {"op2_warc_zstd": op2_warc_zstd}
SQL = {
    "op2_warc_zstd": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM g
"""
}
