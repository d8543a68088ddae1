"""WARC archives compressed record by record with a Zstandard dictionary.

A dictionary is built from a bounded sample of the records. Every archive starts with a
skippable frame that holds it, and each record after it is one frame, so a record can be read
alone and an archive needs nothing beside it. Of equal payloads one record keeps the payload
and the others are revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingmill.llm.common import BROADCAST_ROWS, checked_broadcast, join_groups, materialize, new_path

#: Number of the skippable frame that holds the dictionary, as the public WARC-Zstandard draft has it.
DICTIONARY_FRAME = 0x184D2A5D
#: Bounds: rows and bytes of the dictionary's sample, bytes of a dictionary, bytes of an archive before the next begins.
SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES, ARCHIVE_BYTES = 1000, 8 << 20, 65_536, 64 << 20
#: Payloads shorter than this are always stored whole.
REVISIT_FROM = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("5f0c2d3e-6d0b-5a5e-9a55-1f5f4d3c2b1a")


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def record(page_id, url: str, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record: a response with its payload, or a revisit of ``refers_to`` without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%" + "%".join(f"{b:02X}" for b in c.encode("utf-8", "replace")) for c in url))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha1:{sha}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _sample_piece(text: Column) -> Column:
    """A text whole if it is short, else its beginning, middle and end: at most a row's share of the sample's bytes."""
    most = SAMPLE_BYTES // SAMPLE_ROWS
    third = most // 4 // 3  # a character has four bytes at most
    long = F.concat(F.substring(text, 1, third), F.substring(text, F.floor(F.length(text) / 2).cast("int"), F.lit(third)), F.substring(text, F.length(text) - (third - 1), F.lit(third)))
    return F.when(F.octet_length(text) <= most, text).otherwise(long)


def dictionary(pages: DataFrame, html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A dictionary from the records of a bounded sample of pages; raw text where there is too little to train on.

    The pages with the smallest hashes are the sample, whatever their length; of a long one the
    first bytes, its middle and its end take part.
    """
    import zstandard as z

    text = F.coalesce(pages[html_col], F.lit("")).alias("html")
    hashed = pages.select(text).select(_sample_piece(F.col("html")).alias("html"), F.xxhash64("html").alias("h"))
    # the sample is chosen by hashes, so tasks send numbers to the driver and not pages
    last = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    rows = hashed.where(F.col("h") <= last).dropDuplicates(["h"]).orderBy("h").collect() if last is not None else []
    parts = [record(i, "http://example.org/", p, hashlib.sha1(p).hexdigest(), None, date) for i, p in enumerate(r["html"].encode() for r in rows)]
    try:
        return z.train_dictionary(DICT_BYTES, parts).as_bytes()
    except z.ZstdError:
        return b"".join(parts)[-DICT_BYTES:]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(folder: str, dict_bytes: bytes, archive_bytes: int, date: str, level: int):
    def run(batches):
        import zstandard as z

        files, base = _open(folder)
        pack = z.ZstdCompressor(level=level, dict_data=z.ZstdCompressionDict(dict_bytes) if dict_bytes else None, write_content_size=True).compress
        head = struct.pack("<II", DICTIONARY_FRAME, len(dict_bytes)) + dict_bytes
        out, name, size, n = None, "", 0, 0
        done = []
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    # a name of its own for each attempt: a task that is run again never writes where another did
                    name, size, n = f"{uuid.uuid4().hex}.warc.zst", len(head), 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None)  # the name alone would compress it once more
                    out.write(head)
                data = pack(record(page_id, url or "", html.encode(), digest, refers_to, date))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n, size))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z", level: int = 3, revisit_from: int = REVISIT_FROM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write a record per row into archives in the shared folder; returns their list (path, records, bytes).

    Of records with equal payloads of at least ``revisit_from`` bytes, those with the largest id
    are responses and the others revisit it. Only archives of tasks that succeeded are listed.

    Defined cases: a null payload is empty; a null id is smaller than any id; rows that share
    the largest id and the payload are all responses; other columns, of any name, are not read;
    an empty table makes no archive.
    """
    spark = pages.sparkSession
    own = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    # narrow rows decide: one scan writes id, digest and size of each page that may be a revisit
    digests = materialize(own.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= revisit_from).select("page_id", "digest"), "digests")
    groups = materialize(digests.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1 AND keep IS NOT NULL"), "payloads")
    met = join_groups(digests, groups, ["digest"], "n", "left").where(F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")))
    revisits = materialize(met.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "keep").distinct(), "revisits")
    # pages meet the revisits by broadcast of a counted short list, else in one shuffle on a key that equal rows alone share
    keyed = own.withColumn("digest", F.sha1("html"))
    rows = keyed.join(checked_broadcast(revisits, broadcast_rows), keyed["page_id"].eqNullSafe(F.col("_id")) & (keyed["digest"] == F.col("_digest")), "left").select("page_id", "url", "html", "digest", F.col("keep").alias("refers_to"))
    folder = new_path(spark, "warc")
    files, base = _open(folder)
    files.create_dir(base, recursive=True)
    return materialize(rows.mapInArrow(_write(folder, dictionary(pages, html_col, date), archive_bytes, date, level), "path string, records long, bytes long"), "archives")


def _records(stream):
    """Headers and block of each record of a decompressed archive."""
    hold = bytearray()

    def more() -> bool:
        data = stream.read(1 << 20)
        hold.extend(data)
        return bool(data)

    while True:
        while (end := hold.find(b"\r\n\r\n")) < 0:
            if not more():
                if hold.strip():
                    raise ValueError("an archive ends inside a record")
                return
        lines = bytes(hold[:end]).decode("utf-8", "replace").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        start, stop = end + 4, end + 4 + int(headers["content-length"])
        while len(hold) < stop + 4:
            if not more():
                raise ValueError("an archive ends inside a record")
        yield headers, bytes(hold[start:stop])
        del hold[: stop + 4]


def read_archive(uri: str):
    """(headers, block) of each record of one archive, read as a stream with the dictionary it starts with."""
    import zstandard as z

    files, path = _open(uri)
    with files.open_input_stream(path, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError("no dictionary in front")
        data = f.read(size)
        reader = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(data) if data else None).stream_reader(f, read_across_frames=True)
        yield from _records(reader)


_READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of listed archives: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Bytes and digest are of the full payload: of a response they are computed from what was
    read, and the digest must be the one in its header; a revisit carries those of the payload
    that it refers to. The payload of a revisit is null, as all are unless ``with_payload``.
    """

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                for h, block in read_archive(uri):
                    http, payload = block.split(b"\r\n\r\n", 1)
                    told = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                    whole = h["warc-type"] == "response"
                    size = len(payload) if whole else int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
                    if whole and hashlib.sha1(payload).hexdigest() != told:
                        raise ValueError(f"a payload in {uri} does not have its digest")
                    ints = [int(h[k]) if k in h else None for k in ("x-page-id", "x-refers-to-page-id")]
                    rows.append((ints[0], h.get("warc-target-uri"), h["warc-type"], size, told, ints[1], payload if whole and with_payload else None))
                    held += len(block) if with_payload else 256
                    if held > 4 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    # an archive is a task's work: as many partitions as archives, up to what the session deals out
    n = max(1, min(archives.count(), 4 * int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return archives.select("path").repartition(n).mapInArrow(run, _READ)


def _rows(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` and read them back, without payloads."""
    return read_archives(write_archives(pages), with_payload=False).drop("payload", "url")
