"""WARC archives in Zstandard frames, written and read by Spark.

An archive is a skippable frame that holds the dictionary, then one frame for each record.  Spark's text writer puts the frames
into files on any file system, with its commit protocol; between two of them it writes a separator, which is an empty
skippable frame, so every Zstandard reader passes over it.  The reader gets whole files from Spark's binary source (archives
hold about ``ARCHIVE_BYTES`` of payload, whatever the number of shuffle partitions), loads the dictionary from the leading frame, cuts the file into frames by their block
headers, decodes one frame for each record and validates versions, mandatory headers, lengths and digests.

Of equal payloads of at least ``MIN_REVISIT`` bytes, the record with the largest identifier is a response and the others revisit
it: they carry headers without a payload.  Equal payloads have equal SHA-256 and length.  Only identifiers and digests take
part in finding them; payloads with more than ``HOT`` copies are joined by a broadcast (there is at most one for each ``HOT`` pages),
and frames are dealt by identifier and digest, so a page with millions of copies stays spread out.

Defined results: a null html is an empty payload; a null identifier is written as ``null`` and never is a revisit's target unless
the group has no other (then all are responses); rows repeated with one identifier are records of their own and of the same type;
a null url is written as ``urn:none``; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_REVISIT = 1000
#: Bytes of payload in an archive, about.
ARCHIVE_BYTES = 128 << 20
#: Copies of one payload up to which its records meet in one task.
HOT = 1 << 18
#: Pages the dictionary is trained on (those with the smallest hash of their identifier), bytes of each, bytes of the dictionary.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 65_536

DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
#: A skippable frame without content; ASCII, so that the text writer takes it as its separator.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
MAGIC = b"\x28\xb5\x2f\xfd"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "<urn:gridloom:page:%s>"


class BadArchive(ValueError):
    """What was read is not a valid archive."""


def record(page_id: int | None, url: str | None, size: int, digest: str, payload: bytes | None, refers_to: int | None = None) -> bytes:
    """One record; a revisit where there is no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload or b"")
    target = "".join(c if c > " " else "%%%02X" % ord(c) for c in url) if url else "urn:none"
    name = lambda x: _ID % ("null" if x is None else x)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def frame_end(data, at: int) -> int:
    """Where the Zstandard frame (or skippable frame) at ``at`` ends."""
    if at + 8 > len(data):
        raise BadArchive(f"a frame at {at} is cut off")
    if data[at + 1 : at + 4] == b"\x2a\x4d\x18" and data[at] & 0xF0 == 0x50:
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    elif data[at : at + 4] == MAGIC:
        flags = data[at + 4]
        single = flags >> 5 & 1
        end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
        while True:
            if end + 3 > len(data):
                raise BadArchive(f"the frame at {at} is cut off")
            head = int.from_bytes(data[end : end + 3], "little")
            end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            if head & 1:
                break
        end += 4 * (flags >> 2 & 1)
    else:
        raise BadArchive(f"no frame at {at}")
    if end > len(data):
        raise BadArchive(f"the frame at {at} is cut off")
    return end


def dictionary_of(data) -> tuple[zstandard.ZstdCompressionDict, int]:
    """The dictionary in the leading skippable frame, and where that ends."""
    if data[:4] != DICTIONARY_MAGIC:
        raise BadArchive("the archive doesn't begin with a dictionary")
    end = frame_end(data, 0)
    raw = bytes(data[8:end])
    if raw[:4] == MAGIC:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    return zstandard.ZstdCompressionDict(raw), end


def frames(data):
    """Each record's bytes, one frame at a time."""
    dictionary, at = dictionary_of(data)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        end = frame_end(data, at)
        if data[at : at + 4] == MAGIC:
            yield decoder.decompress(data[at:end])
        at = end


def parse(raw: bytes) -> dict:
    """A record's fields, validated."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive(f"not a record: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise BadArchive(f"not a header: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BadArchive(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise BadArchive(f"{fields['warc-record-id']}: the block isn't as long as its header says")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not http.startswith(b"HTTP/") or len(sizes) != 1 or not sizes[0].isdigit():
        raise BadArchive(f"{fields['warc-record-id']}: no valid HTTP header")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if len(payload) != int(sizes[0]) or hashlib.sha1(payload).hexdigest() != digest:
            raise BadArchive(f"{fields['warc-record-id']}: the payload doesn't match its length or digest")
    elif fields["warc-type"] != "revisit" or payload or "warc-refers-to" not in fields:
        raise BadArchive(f"{fields['warc-record-id']}: not a response or a valid revisit")
    number = lambda x: None if x is None or x.endswith(":null>") else int(x[1:-1].rpartition(":")[2])
    return {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": int(sizes[0]), "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to")), "payload": payload if fields["warc-type"] == "response" else None}


def train_dictionary(pages: DataFrame, id_col: str, html_col: str) -> bytes:
    """A dictionary from a bounded sample; a plain one where the sample is too small to train on."""
    ids = pages.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PAGES)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.substring(F.col(html_col), 1, SAMPLE_BYTES).alias("html"))
    # repeated identifiers may bring more rows than SAMPLE_PAGES; a second limit holds the bound
    sample = rows.join(F.broadcast(ids.distinct()), "id").orderBy(F.xxhash64("id"), "id", "html").limit(SAMPLE_PAGES).collect()
    texts = [record(r.id, None, len(raw), hashlib.sha1(raw).hexdigest(), raw) for r in sample for raw in [(r.html or "").encode()]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return record(0, "http://www.", 0, "0" * 40, b"") + record(0, "https://www.", 0, "0" * 40, None, 0)


def _respond(dictionary):
    """The task: id, url, html to each page's response frame."""

    def task(batches):
        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary.value), write_checksum=True)
        for batch in batches:
            made = []
            for i, url, html in zip(*(batch.column(x).to_pylist() for x in ("id", "url", "html")), strict=True):
                raw = (html or "").encode()
                digest = hashlib.sha1(raw).hexdigest()
                made.append((i, url, hashlib.sha256(raw).hexdigest(), digest, len(raw), coder.compress(record(i, url, len(raw), digest, raw))))
            ids, urls, shas, digests, sizes, out = zip(*made, strict=True) if made else ([],) * 6
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(shas, pa.string()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["id", "url", "sha", "digest", "size", "frame"])

    return task


def _archive(dictionary):
    """The task: one archive's frames, the dictionary first.

    Rows come ordered by key.  One without a frame says that the pages of its key, which follow, revisit ``refers_to``.
    """

    def task(batches):
        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary.value), write_checksum=True)
        packed = zstandard.ZstdCompressor(level=9).compress(dictionary.value)
        lead = [DICTIONARY_MAGIC + len(packed).to_bytes(4, "little") + packed]
        key = target = None
        for batch in batches:
            out = lead
            lead = []
            for row in batch.to_pylist():
                if row["frame"] is None:
                    key, target = row["key"], row["refers_to"]
                elif row["key"] == key:
                    out.append(coder.compress(record(row["id"], row["url"], row["size"], row["digest"], None, target)))
                else:
                    out.append(row["frame"])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    return task


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per page to archives ``*.warc.zst`` under ``path``."""
    spark = pages.sparkSession
    common.bounded_batches(spark)
    dictionary = spark.sparkContext.broadcast(train_dictionary(pages, id_col, html_col))  # DICTIONARY_BYTES at most
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    named = common.materialise(rows.where(F.octet_length("html") >= MIN_REVISIT).select("id", F.sha2("html", 256).alias("sha"), F.octet_length("html").alias("size")), "named")
    leaders = common.materialise(named.groupBy("sha", "size").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "leaders")
    same = ["sha", "size"]
    hot, rest = F.broadcast(leaders.where(F.col("n") > HOT)), leaders.where(F.col("n") <= HOT)
    copies = named.join(hot, same).union(named.join(hot.select(*same), same, "left_anti").join(rest, same)).where("NOT id <=> refers_to")
    revisits = copies.groupBy(F.col("id").alias("of"), F.col("sha").alias("of_sha")).agg(F.max("refers_to").alias("refers_to"))
    responses = rows.mapInArrow(_respond(dictionary), "id long, url string, sha string, digest string, size long, frame binary")
    size = rows.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0
    archives = max(2 * spark.sparkContext.defaultParallelism, -(-size // ARCHIVE_BYTES))  # few pages still keep all cores busy
    # one exchange: pages and marks of revisits are dealt by the same key, and each partition becomes an archive; pages that no mark
    # can be about are dealt by where they come from too, so rows that are all alike spread as well
    key = lambda i, sha, *more: F.concat_ws(":", sha, F.coalesce(F.col(i).cast("string"), F.lit("null")), *more).alias("key")
    place = F.when(F.col("size") < MIN_REVISIT, F.spark_partition_id().cast("string"))
    pages_of = responses.select(key("id", "sha", place), "id", "url", "digest", "size", F.lit(None).cast("long").alias("refers_to"), "frame")
    none = [F.lit(None).cast(kind).alias(n) for n, kind in (("id", "long"), ("url", "string"), ("digest", "string"), ("size", "long"))]
    marks = revisits.select(key("of", "of_sha"), *none, "refers_to", F.lit(None).cast("binary").alias("frame"))
    records = pages_of.union(marks).repartition(archives, "key").sortWithinPartitions("key", F.col("frame").isNotNull())
    records.mapInArrow(_archive(dictionary), "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).text(path)
    _rename(spark, path)


def _rename(spark: SparkSession, path: str) -> None:
    """Give the text writer's files their proper ending."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = where(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(where(path)):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(status.getPath(), where(f"{path}/{name.removesuffix('.txt')}.warc.zst"))


_FIELDS = {"page_id": ("long", pa.int64()), "url": ("string", pa.string()), "payload_bytes": ("long", pa.int64()), "payload_digest": ("string", pa.string()), "record_type": ("string", pa.string()), "refers_to": ("long", pa.int64()), "payload": ("binary", pa.binary())}


def _reader(names):
    """The task: whole archives to the named fields of their records."""

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _FIELDS[n][1]) for n in names], names=names)

    def task(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for raw in frames(memoryview(content.as_buffer()).cast("B")):
                    fields = parse(raw)
                    rows.append({n: fields[n] for n in names})
                    size += len(raw) if "payload" in names else 200
                    if size > 8 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return task


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    common.bounded_batches(spark)
    names = [n for n in _FIELDS if payloads or n != "payload"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    return files.mapInArrow(_reader(names), ", ".join(f"{n} {_FIELDS[n][0]}" for n in names))
