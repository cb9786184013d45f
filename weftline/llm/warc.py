"""WARC archives whose repeated payloads are revisit records.

``write_archives`` resolves revisits and writes the archives; ``read_archives``
parses archives as a stream, by their content lengths, and ``join_revisits`` joins
each revisit record to the response that it refers to.

Headers, not payloads, are grouped by payload digest; digests that many captures share
are joined by broadcast of those few digests. A payload of at least
``least_bytes`` that several captures share is stored once, in the record with the
largest page id; the others become revisit records with fresh headers.

Defined cases: a null payload is the empty one; a null url is an empty target;
line ends inside a url become a space; a null id is smaller than any other; rows
that repeat the kept capture's id and payload are all response records, as neither
can be told from the other; an empty table gives an empty archive; other columns
are dropped.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import left_join_hot, written

END = "\r\n"
#: Bytes of blocks after which a batch of read records is passed on.
BATCH_BYTES = 32 << 20
# The digits of base 32, those that conv() gives and those of the format; the revisit profile.
DIGITS = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1: five hexadecimal digits are four of base 32."""
    digest = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*quads)), *DIGITS)


def _urn(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", page.cast("string"), digest))
    cut = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.concat(F.lit("<urn:uuid:"), cut, F.lit(">"))


def resolve(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Captures with payload_digest, payload_bytes, record_type, and the id and url of the response that a revisit refers to."""
    page = F.col(id_col)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(page, F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]+", " ").alias(url_col), payload.alias(payload_col))
    rows = rows.withColumns({"payload_digest": base32_sha1(payload), "payload_bytes": F.octet_length(payload).cast("long")})
    shared = (
        rows.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.count(F.lit(1)).alias("captures"), F.max(page).alias("kept"), F.max_by(url_col, page).alias("kept_url"))
        .where("captures > 1")
    )
    shared = written(shared.withColumn("shared", F.lit(True)), "digests")
    joined = left_join_hot(rows, shared, "payload_digest", "captures", id_col)
    revisit = F.coalesce("shared", F.lit(False)) & ~page.eqNullSafe(F.col("kept"))
    return joined.select(
        page, url_col, payload_col, "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("kept")).alias("kept"),
        F.when(revisit, F.col("kept_url")).alias("kept_url"),
    )


def _record(id_col: str, url_col: str, payload_col: str, date: str) -> Column:
    page, digest = F.col(id_col), F.col("payload_digest")
    revisit = F.col("record_type") == "revisit"
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col(payload_col)))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    refers = F.concat(
        line("WARC-Profile", F.lit(PROFILE)),
        line("WARC-Refers-To", _urn(F.col("kept"), digest)),
        line("WARC-Refers-To-Target-URI", F.coalesce("kept_url", F.lit(""))),
    )
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _urn(page, digest)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col(url_col)),
        line("WARC-Page-ID", F.coalesce(page.cast("string"), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, refers).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
        block,
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str | None = None, records_per_file: int = 20_000) -> None:
    """Write gzipped archives, one or more a task, by Spark's own text writer, in which ``END END`` closes a record.

    Records are dated ``date``, or with the time of the call.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    records = resolve(pages, least_bytes, id_col, url_col, payload_col).select(_record(id_col, url_col, payload_col, date).alias("value"))
    records.write.options(**{"lineSep": END + END, "compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": records_per_file}).text(path)


def parse(lines: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream of lines, whose line feeds are cut off; one record at a time is held."""
    lines = iter(lines)
    for line in lines:
        if not line.startswith(b"WARC/1."):
            continue
        headers = {}
        for line in lines:
            if line in (b"\r", b""):
                break
            name, _, value = line.rstrip(b"\r").decode().partition(":")
            headers[name] = value.removeprefix(" ")
        n, parts, size = int(headers["Content-Length"]), [], 0
        while size < n + 2 * len(END):
            line = next(lines, None)
            if line is None:
                raise ValueError("an archive ends inside a record")
            parts.append(line)
            size += len(line) + 1
        yield headers, b"\n".join(parts)[:n]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null in revisits), digest_holds.

    Archives are read as lines, a compressed one by one task from start to end, so no
    task holds more than some lines and one record.
    """
    names = ["page_id", "url", "record_type", "record_id", "to_id", "payload_bytes", "payload_digest", "payload", "digest_holds"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

        rows, held = [], 0
        for headers, block in parse(line for batch in batches for line in batch.column(0).to_pylist()):
            head, _, payload = block.partition(b"\r\n\r\n")
            said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
            revisit = headers["WARC-Type"] == "revisit"
            own = said if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
            size = int(head.rsplit(b"Content-Length: ", 1)[1]) if revisit else len(payload)
            page = headers["WARC-Page-ID"]
            rows.append((int(page) if page else None, headers["WARC-Target-URI"], headers["WARC-Type"], headers["WARC-Record-ID"], headers.get("WARC-Refers-To"), size, own, None if revisit else payload, own == said))
            held += len(block)
            if len(rows) == 1000 or held > BATCH_BYTES:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)

    schema = "page_id long, url string, record_type string, record_id string, to_id string, payload_bytes long, payload_digest string, payload binary, digest_holds boolean"
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.txt*").text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(records, schema)


def join_revisits(records: DataFrame) -> DataFrame:
    """Records without payload, with refers_to, and in revisits the size and digest of the response's payload."""
    records = written(records.drop("payload"), "records")
    kept = records.where("record_type = 'response'").select(F.col("record_id").alias("to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("kept_bytes"), F.col("payload_digest").alias("kept_digest"))
    kept = kept.groupBy("to_id").agg(F.max("refers_to").alias("refers_to"), F.max("kept_bytes").alias("kept_bytes"), F.max("kept_digest").alias("kept_digest"))
    asked = records.groupBy("to_id").agg(F.count(F.lit(1)).alias("revisits"))
    return left_join_hot(records, kept.join(asked, "to_id"), "to_id", "revisits", "page_id").withColumns({"payload_bytes": F.coalesce("kept_bytes", "payload_bytes"), "payload_digest": F.coalesce("kept_digest", "payload_digest")})
