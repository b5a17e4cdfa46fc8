"""WARC archives: writing pages as records, and reading archives by boundary-chain verification.

Writing: one record per page. Of pages with equal payloads of at least 100 bytes, the one with the smallest
page_id is a response, the others revisit it (HTTP head only). Spark's text writer makes the files; the blank
line that ends a record is its line separator, so nothing is shuffled but digests.

Reading: the text reader cuts the files at every record magic, wherever splits fall. Each piece is a candidate
record; its header gives the offset of its successor. Offsets are running sums of lengths. Candidates whose
successor is the very next one form a segment; pointer jumping over the segments, from offset 0 of each file,
keeps what the chain reaches. A magic inside a payload isn't reached; the record around it is put together
from its pieces.

Defined results: null html is an empty payload; a null url leaves the target out; a null page_id is written as
such, is never a group's response unless no page of the group has an id (then all are responses); repeated rows
with one page_id are all responses if it is the smallest of its group; an empty table gives no records. A file
that doesn't begin with a record gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import delete, hinted, new_path, written

MAGIC = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
MIN_PAYLOAD = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(value): the text of each page's record, without the blank line that ends it."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    shared = rows.where(F.col("size") >= MIN_PAYLOAD).groupBy("digest").agg(
        F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null").select("digest", "least")
    rows = rows.join(hinted(shared, 100_000), "digest", "left")
    again = F.col("least").isNotNull() & ~F.col("id").eqNullSafe(F.col("least"))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(">"))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit(BLANK))
    block = F.when(again, head).otherwise(F.concat(head, "payload"))
    fields = [
        F.concat(F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), name), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("least").cast("string"), F.lit(">"))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string"))]
    return rows.withColumn("block", block).select(
        F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *fields), F.lit(BLANK), F.col("block")).alias("value"))


def write(pages: DataFrame, path: str, **columns: str) -> None:
    records(pages, **columns).write.option("lineSep", BLANK).text(path)


def candidates(spark: SparkSession, path: str | list[str], raw: bool = False) -> DataFrame:
    """Every piece that follows a magic: (file, block, place), its length and what its header says."""
    read = spark.read.option("lineSep", MAGIC).text(path)
    head = F.substring_index("value", BLANK, 1)
    rows = read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value", F.octet_length("value").cast("bigint").alias("length"))
    rows = rows.withColumn("head", head).withColumn("head_length", F.octet_length("head").cast("bigint"))
    size = F.regexp_extract("head", r"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t]*$", 1)
    rows = rows.withColumn("size", F.when(F.col("head_length") < F.col("length"), size.try_cast("bigint")))
    tight = F.coalesce(F.col("head_length") + F.col("size") + 8 == F.col("length"), F.lit(False))
    rows = rows.withColumn("tight", tight)
    keep = [F.col("value")] if raw else []
    return rows.select("file", "block", "place", "length", "head_length", "size", "tight", *keep,
                       *(F.when(F.col("tight"), c).alias(n) for n, c in contents("value", "head").items()))


def contents(value: str, head: str) -> dict[str, F.Column]:
    """Columns of a whole record from its text and its header."""
    def field(name: str) -> F.Column:
        found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*$", 1)
        return F.when(found != "", found)

    body = F.substring(F.col(value).cast("binary"), F.octet_length(head) + 5, F.octet_length(value) - F.octet_length(head) - 8)
    http = F.substring_index(body.cast("string"), BLANK, 1)
    payload = F.substring(body, F.octet_length(http) + 5, F.octet_length(body))
    sent = F.regexp_extract(http, r"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t]*$", 1).try_cast("bigint")
    again = field("WARC-Type") == "revisit"
    return {
        "record_type": field("WARC-Type"), "record_id": field("WARC-Record-ID"), "target": field("WARC-Target-URI"),
        "refers_to": field("WARC-Refers-To"),
        "payload_bytes": F.when(again, sent).otherwise(F.octet_length(payload).cast("bigint")),
        "payload_digest": F.when(again, F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", ""))
        .otherwise(F.sha2(payload, 256))}


def chained(pieces: DataFrame) -> DataFrame:
    """Candidates with their offset, their successor's offset and their segment, by running sums in file order."""
    before = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, -1)
    # A piece stands after the magic that starts at the end of all text before it; the first piece follows none.
    rows = pieces.withColumn("end", F.coalesce(F.sum(F.col("length") + len(MAGIC)).over(before), F.lit(0))) \
        .withColumn("start", F.col("end") - len(MAGIC))
    rows = rows.withColumn("next", F.col("start") + len(MAGIC) + F.col("head_length") + F.col("size") + 8)
    return rows.withColumn("segment", F.coalesce(F.sum((~F.col("tight")).cast("int")).over(before), F.lit(0)))


def reached(rows: DataFrame) -> DataFrame:
    """(file, segment, entry): segments on the chain from offset 0, and where the chain enters them."""
    nodes = rows.where("start >= 0")
    ends = nodes.where("not tight and next is not null").select("file", "segment", F.col("next").alias("entry"))
    jump = ends.join(nodes.select("file", F.col("start").alias("entry"), F.col("segment").alias("to")),
                     ["file", "entry"])
    jump = written(jump.select("file", "segment", "to", "entry"), "warc-jump")
    found = written(nodes.where("start = 0").select("file", "segment", F.col("start").alias("entry")), "warc-reached")
    n = found.count()
    while not jump.isEmpty():
        more = found.select("file", "segment").join(jump, ["file", "segment"]) \
            .select("file", F.col("to").alias("segment"), "entry")
        wider = written(found.unionByName(more).distinct(), "warc-reached")
        second = jump.select("file", F.col("segment").alias("to"), F.col("to").alias("to2"), F.col("entry").alias("entry2"))
        longer = written(jump.join(second, ["file", "to"]).select(
            "file", "segment", F.col("to2").alias("to"), F.col("entry2").alias("entry")), "warc-jump")
        delete(found)
        delete(jump)
        found, jump = wider, longer
        m = found.count()
        if m == n:
            break
        n = m
    return found


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``, with its file and offset."""
    rows = written(chained(candidates(spark, path)), "warc-candidates")
    true = rows.join(hinted(reached(rows), 100_000), ["file", "segment"]) \
        .where("start >= entry")
    columns = ["record_type", "record_id", "target", "refers_to", "payload_bytes", "payload_digest"]
    whole = true.where("tight").select("file", F.col("start").alias("offset"), *columns)
    broken = written(true.where("not tight and next is not null").select("file", F.col("start").alias("offset"), "next"),
                     "warc-broken")
    if broken.isEmpty():
        return whole
    # Records with a magic inside: put together from the pieces of their files, read once more.
    files = broken.select("file").distinct()
    parts = candidates(spark, path, raw=True).join(hinted(files, 100_000), "file", "left_semi") \
        .select("file", "block", "place", "length", "head_length", "size", "tight", "value")
    parts = chained(parts).select("file", "start", "value")
    inside = parts.join(broken, "file").where("start >= offset and start < next")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda p: p["value"]), MAGIC)
    joined = inside.groupBy("file", "offset", "next").agg(text.alias("value")) \
        .where(F.octet_length("value") + len(MAGIC) == F.col("next") - F.col("offset"))
    joined = joined.withColumn("head", F.substring_index("value", BLANK, 1))
    return whole.unionByName(joined.select("file", "offset", *(c.alias(n) for n, c in contents("value", "head").items())))


def page_number(name: str) -> F.Column:
    return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives below the shared folder and read them back, one row per page."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path).select(
        page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_number("refers_to").alias("refers_to"))
