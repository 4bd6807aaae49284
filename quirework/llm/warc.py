"""WARC archives under Zstandard: a writer, and a reader that validates what it reads.

An archive is one ``.warc.zst`` file: a skippable frame that holds a dictionary,
then one frame for each record, compressed with it. The reader takes the
dictionary from the leading frame (raw, or itself compressed), walks the frames
by their block headers, decodes one at a time and checks its version line,
mandatory fields, lengths, the two line breaks that end it, and its digests. What
fails is a row with the reason in ``error``, and the records after it are still
read, as long as the frame's end can be told.

Writing: payloads of at least ``least_bytes`` that occur more than once are
stored once, under the smallest page id; the others become revisit records that
refer to it. What is shuffled for that are digests and ids; payloads are shuffled
only where Spark can't broadcast the digests that occur several times. Each task
writes one archive: it trains the dictionary on its first records (SAMPLE_BYTES
of them at most; too few to train on serve as a dictionary of raw content) and
compresses record by record. Files are written by Spark's text source, so any
file system that Spark knows will do and a lost task leaves nothing behind; the
separator that this source puts after each row is an empty skippable frame.

Reading: an archive is read whole by one task, as a binary file (so of at most
2 GB), and its records are decoded one at a time. Refers-to is resolved by a join
of record ids.

Defined results: a null html is the empty payload. A null page id sorts after
all others. Rows that share id and payload are records of their own; one of
them, of the smallest url (null last), is the response. A url that is null, empty
or has line breaks is written as an empty target without them. An empty table
gives an archive without records, and no rows. Columns other than the named ones
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, shuffle_files_dropped

# Fixed values of the formats: magic numbers of frames, version line, and the mandatory fields of a record.
ZSTD, SKIPPABLE, DICTIONARY_FRAME, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D, 0xEC30A437
VERSION, MANDATORY = b"WARC/1.1", ("warc-record-id", "content-length", "warc-date", "warc-type")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What the text source writes after each row: a skippable frame without content, which is ASCII.
GAP = struct.pack("<II", SKIPPABLE, 0)
#: Bytes that a dictionary is trained on and bytes that it has, at most; date of records, so that the same pages give the same archive.
SAMPLE_BYTES, DICTIONARY_BYTES, DATE = 2 << 20, 64 << 10, "1970-01-01T00:00:00Z"
#: Bytes of records that the reader returns at once, about.
BATCH = 4 << 20
RECORD = "archive string, at long, record_id string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to_record string, payload binary, error string"
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in RECORD.split(", "))])


def _id(name: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16], version=5)}>"


def record(kind: str, record_id: str, url: str, payload: bytes | None, digest: str, size: int, page_id: int | None, refers_to: str | None = None) -> bytes:
    """A response with its payload, or a revisit with the head alone; both tell the payload's digest and length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "WARC-Refers-To": refers_to, "WARC-Profile": PROFILE if refers_to else None,
        "Page-ID": page_id, "Content-Type": "application/http;msgtype=response", "Content-Length": len(block),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary_of(samples: list[bytes]) -> bytes:
    """Trained where there is enough to train on, else the samples themselves."""
    size = sum(map(len, samples))
    if len(samples) >= 16 and size >= 1 << 16:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 8), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:DICTIONARY_BYTES]


def _named(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    if not dictionary:
        return None
    trained = dictionary[:4] == struct.pack("<I", DICTIONARY)
    return zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def _frames(level: int, run: str):
    """Rows of a task to the frames of its archive, dictionary first. run tells records of different runs apart."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, waiting, bytes_waiting, compressor = TaskContext.get().partitionId(), 0, [], 0, None
        frames: list[bytes] = []

        def begin() -> zstandard.ZstdCompressor:
            dictionary = dictionary_of(waiting)
            stored = zstandard.ZstdCompressor(level=level).compress(dictionary)
            frames.append(struct.pack("<II", DICTIONARY_FRAME, len(stored)) + stored)
            out = zstandard.ZstdCompressor(level=level, dict_data=_named(dictionary), write_checksum=True)
            frames.extend(map(out.compress, waiting))
            waiting.clear()
            return out

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])
            frames.clear()
            return out

        for batch in batches:
            held = 0
            for r in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "bytes", "record_type", "of_group")), strict=True):
                page_id, url, html, digest, size, kind, of_group = (x.as_py() for x in r)
                first = _id(f"payload {digest}")
                own = first if of_group and kind == "response" else _id(f"{run} task {task} record {n}")
                n += 1
                data = record(kind, own, url, html.encode() if kind == "response" else None, digest, size, page_id, None if kind == "response" else first)
                if compressor:
                    frames.append(compressor.compress(data))
                    held += len(frames[-1])
                    if held > BATCH:
                        yield flushed()
                        held = 0
                else:
                    waiting.append(data)
                    bytes_waiting += len(data)
                    if bytes_waiting >= SAMPLE_BYTES:
                        compressor = begin()
            if frames:
                yield flushed()
        if not compressor:
            begin()
            yield flushed()

    return write


def planned(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """The records to write: page_id, url, html, digest, bytes, record_type (response or revisit) and of_group, whether several have the payload."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", "")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), html.alias("html"))
    keyed = rows.select("*", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").cast("long").alias("bytes"))
    first = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url") == "", "url")
    groups = keyed.filter(F.col("bytes") >= least_bytes).groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"), F.min(first).alias("first"))
    groups = groups.groupBy("digest").agg(F.sum("n").alias("n"), F.min_by(F.struct("first", "n"), "first").alias("least")).filter("n > 1")
    groups = scratch.write(groups.select(F.col("digest").alias("of"), F.col("least.first.page_id").alias("first_id"), F.col("least.first.url").alias("first_url"), F.col("least.n").alias("ties")), "groups")
    met = keyed.join(groups, F.col("digest") == F.col("of"), "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("url") == F.col("first_url"))
    kind = F.when(F.col("of").isNull() | is_first, "response").otherwise("revisit")
    columns = ["page_id", "url", "html", "digest", "bytes", kind.alias("record_type"), F.col("of").isNotNull().alias("of_group")]
    if groups.filter("ties > 1").isEmpty():
        return met.select(*columns)
    # Rows equal in id, url and payload: one of them is the response, and the others differ in nothing, so they are counted.
    alone = met.filter(F.col("of").isNull() | ~is_first | (F.col("ties") == 1)).select(*columns)
    tied = met.filter(F.col("of").isNotNull() & is_first & (F.col("ties") > 1)).groupBy("page_id", "url", "digest", "bytes").agg(F.first("html").alias("html"), F.count("*").alias("n"))
    step = 1 << 20
    again = tied.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("run"))
    again = again.select("*", F.explode(F.sequence("run", F.least(F.col("run") + step, "n") - 1)))
    named = lambda df, kind, html: df.select("page_id", "url", html.alias("html"), "digest", "bytes", F.lit(kind).alias("record_type"), F.lit(True).alias("of_group"))
    return alone.union(named(tied, "response", F.col("html"))).union(named(again, "revisit", F.lit("")))


def write(pages: DataFrame, path: str, level: int = 3, **columns) -> None:
    """Writes pages as archives into a folder, one for each task that has rows; columns: as for planned()."""
    spark = pages.sparkSession
    frames = planned(pages, Scratch(spark, "warc-plan"), **columns).mapInArrow(_frames(level, path), "frame binary")
    with shuffle_files_dropped(spark):
        frames.select(F.col("frame").cast("string").alias("value")).write.mode("overwrite").option("lineSep", GAP.decode()).text(path)


def frames_of(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(start, end, error) of each Zstandard frame, found by its header and those of its blocks; a frame cut short or unknown ends the archive."""
    at, n = 0, len(data)
    while at < n:
        if n - at < 8:
            yield at, n, "cut short"
            return
        magic, size = struct.unpack_from("<II", data, at)
        if SKIPPABLE <= magic <= SKIPPABLE + 15:
            if at + 8 + size > n:
                yield at, n, "cut short"
                return
            at += 8 + size
            continue
        if magic != ZSTD:
            yield at, n, "not a frame"
            return
        try:
            head = bytes(data[at : at + 18])
            end, checked, last = at + zstandard.frame_header_size(head), zstandard.get_frame_parameters(head).has_checksum, False
        except zstandard.ZstdError:
            yield at, n, "cut short"
            return
        while not last and end + 3 <= n:
            block = int.from_bytes(data[end : end + 3], "little")
            last = block & 1
            end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        end += 4 * checked
        if not last or end > n:
            yield at, n, "cut short"
            return
        yield at, end, ""
        at = end


def leading_dictionary(data: bytes) -> bytes:
    """The dictionary in the leading skippable frame, raw or compressed; none if the archive doesn't begin with such a frame."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_FRAME:
        return b""
    stored = bytes(data[8 : 8 + struct.unpack_from("<I", data, 4)[0]])
    if stored[:4] != struct.pack("<I", ZSTD):
        return stored
    return zstandard.ZstdDecompressor().decompressobj().decompress(stored)


def parse(data: bytes) -> dict:
    """A record's fields as of RECORD, or what is wrong with it."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    out: dict = dict.fromkeys(_ARROW.names)
    if not found or lines[0] not in (VERSION, b"WARC/1.0"):
        return out | {"error": "no WARC version line"}
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return out | {"error": "a header without a name"}
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    page_id = fields.get("page-id", "")
    out |= {
        "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "refers_to_record": fields.get("warc-refers-to"),
        "page_id": int(page_id) if page_id.lstrip("-").isdecimal() else None, "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None,
    }
    if missing := [m for m in MANDATORY if not fields.get(m)]:
        return out | {"error": f"no {missing[0]}"}
    if not fields["content-length"].isdecimal():
        return out | {"error": "a length that is no number"}
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        return out | {"error": "a length other than told"}
    block = rest[:size]
    told = fields.get("warc-block-digest", "")
    if told.startswith("sha256:") and hashlib.sha256(block).hexdigest() != told[7:]:
        return out | {"error": "a block of another digest"}
    if not fields.get("content-type", "").startswith("application/http"):
        return out | {"payload": block, "payload_bytes": size}
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        return out | {"error": "no end of the HTTP head"}
    lengths = [v.strip() for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"]
    length = int(lengths[0]) if lengths and lengths[0].isdigit() else None
    if out["record_type"] == "revisit":
        if not out["refers_to_record"]:
            return out | {"error": "a revisit of nothing"}
        return out | {"payload_bytes": length}
    if length is not None and length != len(payload):
        return out | {"error": "a payload of another length"}
    if (digest := hashlib.sha256(payload).hexdigest()) != (out["payload_digest"] or digest):
        return out | {"error": "a payload of another digest"}
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}


def records(data: bytes) -> Iterator[dict]:
    """The records of an archive, decoded one by one."""
    if not data:
        return
    view = memoryview(data)
    try:
        reader = zstandard.ZstdDecompressor(dict_data=_named(leading_dictionary(view)))
    except zstandard.ZstdError:
        yield dict.fromkeys(_ARROW.names) | {"at": 0, "error": "a dictionary that can't be read"}
        return
    for low, high, wrong in frames_of(view):
        if not wrong:
            try:
                out = parse(reader.decompressobj().decompress(view[low:high]))
            except zstandard.ZstdError:
                out, wrong = {}, "a frame that can't be decoded"
        yield (dict.fromkeys(_ARROW.names) | {"error": wrong} if wrong else out) | {"at": low}


def _rows(payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, held = [], 0
                for r in records(content.as_buffer()):
                    rows.append(r | {"archive": name.as_py()} | ({} if payloads else {"payload": None}))
                    held += 500 + len(rows[-1]["payload"] or b"")
                    if held > BATCH:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return read


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a record of all archives in a folder, in RECORD's columns; error is null for a valid one."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_rows(payloads), RECORD)


def resolved(found: DataFrame) -> DataFrame:
    """Adds refers_to, the page id of the response that a revisit refers to. A revisit whose response is missing or tells another payload has an error."""
    responses = found.filter("record_type = 'response' AND error IS NULL").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("told_bytes"), F.col("payload_digest").alias("told_digest"), F.lit(True).alias("met")
    )
    out = found.join(responses, "refers_to_record", "left")
    same = F.col("payload_bytes").eqNullSafe(F.col("told_bytes")) & F.col("payload_digest").eqNullSafe(F.col("told_digest"))
    wrong = F.when((F.col("record_type") == "revisit") & F.col("met").isNull(), "a revisit of no response").when((F.col("record_type") == "revisit") & ~same, "a revisit of another payload")
    return out.withColumn("error", F.coalesce("error", wrong)).drop("told_bytes", "told_digest", "met")


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Writes pages as archives in a scratch folder and reads them back, without payloads. Raises if a record is not as it should be."""
    scratch = Scratch(pages.sparkSession, "warc")
    write(pages, scratch.path("archives"), **columns)
    found = scratch.write(read(pages.sparkSession, scratch.path("archives"), payloads=False), "records")
    scratch.drop("archives")
    out = resolved(found)
    return out.select("*", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("WARC record "), F.col("at").cast("string"), F.lit(" of "), F.col("archive"), F.lit(": "), F.col("error")))).cast("string").alias("checked")).filter("checked IS NULL").drop("checked")
