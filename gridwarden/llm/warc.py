"""WARC archives: writing with revisit records, and reading by verified boundary chains."""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.llm.shared import broadcast_if_short, cut, whole

#: Most bytes of an archive with more than one record; a reading task holds one archive at a time.
ARCHIVE_BYTES = 8 << 20
#: Shorter payloads are always stored.
REVISIT_BYTES = 100

_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CANDIDATE = "file string, at bigint, next bigint, head string, payload binary"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r$")


def records(pages: DataFrame, least=REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (string), digest and refers_to (null for a response).

    Of pages with equal payloads of at least ``least`` bytes the one with the smallest page_id
    is a response and the others revisit it; of equal rows, or where no page has an id, none
    can be told from the first and all are responses. A null html is an empty payload.
    """
    payload = whole(F.col("html"))
    rows = pages.select("page_id", whole(F.col("url")).alias("url"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("digest"))
    long = F.octet_length("payload") >= least
    first = rows.where(long).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return rows.join(broadcast_if_short(first), "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(long & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
        .alias("refers_to"))


def archive_numbers(archive_bytes):
    """Numbers of a task's archives from its records' sizes, by the bytes so far.

    Records that follow each other share an archive until the next one would not fit.
    """
    @F.pandas_udf("int")
    def number(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        archive, used = 0, 0
        for sizes in batches:
            numbers = []
            for size in sizes:
                if used and used + size > archive_bytes:
                    archive, used = archive + 1, 0
                used += size
                numbers.append(archive)
            yield pd.Series(numbers, dtype="int32")

    return number.asNondeterministic()


def write_archives(pages: DataFrame, path, archive_bytes=ARCHIVE_BYTES) -> None:
    """Uncompressed WARC 1.1 files under ``path``, a record per page.

    A record is a row of text and its two closing line ends are the row separator, so Spark's
    own writer makes the files, on any store that it can reach. A file has ``archive_bytes`` at
    most, or a single record.
    """
    rows = records(pages)
    stored = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    lines = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(">\r\nWARC-Target-URI: "),
        F.regexp_replace("url", r"[\r\n]+", " "),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.octet_length("payload").cast("string"),
        F.when(revisit, F.concat(
            F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <urn:page:"),
            F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Length: "), F.octet_length(stored).cast("string"),
        F.lit(_END), stored)
    written = rows.select(lines.alias("value"))
    size = F.octet_length("value") + len(_END)
    written.withColumn("archive", archive_numbers(archive_bytes)(size)) \
        .write.partitionBy("archive").option("lineSep", _END).text(path)


def candidates(spark: SparkSession, path) -> DataFrame:
    """Every place that looks like the start of a record, and where its successor would start.

    file, at, next, head (the header lines) and payload; next is null where the header or the
    payload is cut short or no record end follows it.
    """
    def scan(batches):
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"]):
                rows = []
                for found in _MAGIC.finditer(data):
                    at, body = found.start(), data.find(b"\r\n\r\n", found.start())
                    length = _LENGTH.search(data, at, body + 2) if body > 0 else None
                    if length is None:
                        continue
                    end = body + 4 + int(length[1])
                    closed = data[end:end + 4] == b"\r\n\r\n"
                    rows.append((file, at, end + 4 if closed else None,
                                 data[at:body].decode("utf-8", "replace"), data[body + 4:end]))
                frame = pd.DataFrame(rows, columns=["file", "at", "next", "head", "payload"])
                frame["next"] = frame["next"].astype("Int64")
                yield frame

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInPandas(scan, _CANDIDATE)


def reachable(links: DataFrame) -> DataFrame:
    """file, at of the candidates that the chain from the start of the file reaches.

    Pointer jumping: each round adds the successors of all reached and then doubles every
    pointer, so a chain of n records takes log2(n) rounds. A file's candidates, at most one per
    few dozen bytes of an archive, are one group.
    """
    def jump(group):
        at = np.sort(group["at"].unique())
        order = group.drop_duplicates("at").set_index("at").loc[at, "next"]
        goal = order.fillna(-1).to_numpy(np.int64)
        place = np.searchsorted(at, goal)
        known = (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == goal)
        pointer = np.append(np.where(known, place, len(at)), len(at))
        reached = np.zeros(len(at) + 1, dtype=bool)
        reached[0] = at[0] == 0
        while True:
            before = reached.sum()
            reached[pointer[reached]] = True
            if reached.sum() == before:
                break
            pointer = pointer[pointer]
        return pd.DataFrame({"file": group["file"].iloc[0], "at": at[reached[:-1]]})

    return links.select("file", "at", "next").groupBy("file").applyInPandas(
        jump, "file string, at bigint")


def read_archives(spark: SparkSession, path) -> DataFrame:
    """The records of all archives under ``path``, in no order.

    Returns file, at, record_type, record_id, target_uri, digest, payload_length, refers_to and
    payload. Only records that the chain from the start of their file reaches are records:
    what looks like one inside a payload is not. An empty file has no records.
    """
    found = candidates(spark, path).where("next is not null")
    links = cut(found.select("file", "at", "next"))
    false = links.join(reachable(links), ["file", "at"], "left_anti").select("file", "at")
    header = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID",
              "target_uri": "WARC-Target-URI", "digest": "WARC-Payload-Digest",
              "payload_length": "X-Payload-Length", "refers_to": "WARC-Refers-To"}
    fields = [F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
              .alias(column) for column, name in header.items()]
    return found.join(broadcast_if_short(false), ["file", "at"], "left_anti").select("file", "at", *fields, "payload")


def archived_pages(spark, path) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record read.

    A response's figures are those of the payload as read; a revisit's are those of the
    payload it stands for, from its header.
    """
    def number(column):
        return F.regexp_extract(column, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")

    stored = F.col("record_type") == "response"
    return read_archives(spark, path).select(
        number(F.col("record_id")).alias("page_id"),
        F.when(stored, F.octet_length("payload")).otherwise(F.col("payload_length"))
        .cast("bigint").alias("payload_bytes"),
        F.when(stored, F.sha2("payload", 256)).otherwise(
            F.regexp_replace("digest", "^sha256:", "")).alias("payload_digest"),
        "record_type", number(F.col("refers_to")).alias("refers_to"))
