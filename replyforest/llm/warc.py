"""Web archives: records are written as WARC files and read back by verified chains.

The files are read in pieces between one record magic and the next, wherever it stands.  Every piece is a candidate
that says where its successor must begin.  Candidates whose successor is the next candidate form runs; from the start
of each file pointers jump from run to run, twice as far every round.  Only what they reach is a record, so a magic
inside a payload is none.  Payloads are not moved, but for the few records whose payload holds a magic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from replyforest.llm.common import text_of
from replyforest.session import passing_folder, stage

MAGIC = "WARC/1.0\r\n"
BREAK = "\r\n\r\n"
RECORDS_PER_FILE = 1000
DATE = "1970-01-01T00:00:00Z"  # pages carry none
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of bytes in upper-case base 32: every five hexadecimal digits are four of base 32."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _payload(pages: DataFrame, html: str) -> DataFrame:
    whole = pages.withColumn("_text", text_of(F.col(f"`{html}`")))
    return whole.withColumn("_bytes", F.octet_length("_text")).withColumn("_digest", base32_sha1(F.col("_text").cast("binary")))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _identity(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """One record per row of ``pages``, in gzipped WARC files of at most ``RECORDS_PER_FILE`` records.

    Of pages with equal payloads of ``least`` bytes or more, the one with the largest id is a response and the others
    revisit it; rows that repeat this id are responses as well.  A null payload is empty, a null id is the smallest.
    Other columns are not read.  An empty table gives no records.
    """
    plain = pages.select(F.col(f"`{page_id}`").alias("page"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    hashed = _payload(plain, "html")
    with passing_folder(pages.sparkSession, "warc") as steps:
        equal = hashed.where(F.col("_bytes") >= least).groupBy("_digest", "_bytes")
        equal = equal.agg(F.max("page").alias("_first"), F.count("*").alias("_times")).where("_times > 1").drop("_times")
        # Written first, so that few groups of equal payloads are known to be few, and then no payload is shuffled.
        equal = stage(equal.withColumn("_known", F.lit(True)), "equal", folder=steps)
        joined = hashed.join(equal, ["_digest", "_bytes"], "left")
        again = F.coalesce(F.col("_known") & ~F.col("page").eqNullSafe(F.col("_first")), F.lit(False))
        http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit(BREAK))
        block = F.when(again, http).otherwise(F.concat(http, F.col("_text")))
        target = F.regexp_replace(F.regexp_replace(text_of("url"), "\r", "%0D"), "\n", "%0A")
        record = F.concat(
            F.lit(MAGIC),
            _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
            _line("WARC-Record-ID", _identity(F.col("page"))),
            F.when(again, _line("WARC-Refers-To", _identity(F.col("_first")))).otherwise(""),
            F.when(again, _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(""),
            _line("WARC-Target-URI", target),
            _line("WARC-Date", F.lit(DATE)),
            _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
            _line("Content-Type", F.lit("application/http; msgtype=response")),
            F.lit("Content-Length: "),
            F.octet_length(block).cast("string"),
            F.lit(BREAK),
            block,
        )
        # What stands between two lines of the text sink ends a WARC record.
        lines = joined.select(record.alias("value")).write.option("lineSep", BREAK).option("compression", "gzip")
        lines.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between one magic and the next, with its place in the order of the file."""
    read = spark.read.option("lineSep", MAGIC).text(path)
    return read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )


def _described(pieces: DataFrame) -> DataFrame:
    """The fields of the record that a piece is, if it is a whole one."""
    value = F.col("value")
    head = F.substring_index(value, BREAK, 1)
    found = pieces.withColumn("head", head)
    for name, field in {
        "kind": "WARC-Type",
        "identity": "WARC-Record-ID",
        "refers": "WARC-Refers-To",
        "digest": "WARC-Payload-Digest",
    }.items():
        found = found.withColumn(name, _field(F.col("head"), field))
    size = _field(F.col("head"), "Content-Length").try_cast("bigint")
    found = found.withColumn("size", size).withColumn("begin", F.octet_length("head") + len(BREAK))
    # The HTTP header ends at the second break.
    found = found.withColumn("both", F.substring_index(value, BREAK, 2)).withColumn("body", F.octet_length("both") + len(BREAK))
    own = F.substring(value.cast("binary"), F.col("body") + 1, (F.col("begin") + F.col("size") - F.col("body")).cast("int"))
    whole = F.octet_length(value) == F.col("begin") + F.col("size") + len(BREAK)
    response = whole & (F.col("kind") == "response")
    return found.select(
        *pieces.columns,
        F.octet_length(value).cast("bigint").alias("length"),
        "kind",
        "identity",
        "refers",
        F.coalesce(whole, F.lit(False)).alias("whole"),
        (F.col("begin") + F.col("size") + len(BREAK)).alias("reach"),
        F.when(response, base32_sha1(own)).otherwise(F.regexp_replace(F.coalesce("digest", F.lit("")), "^sha1:", "")).alias("digest"),
        F.when(response, F.octet_length(own)).otherwise(_field(F.substring(F.col("both"), F.length("head") + 1, 1 << 20), "Content-Length")).cast("bigint").alias("bytes"),
    )


def _reached(candidates: DataFrame, steps: str) -> DataFrame:
    """The entries ``(file, entry)`` of runs that a chain of jumps from the start of the file meets."""
    jumps = stage(candidates.select("file", F.col("offset").alias("at"), "to"), "jumps", folder=steps)
    reached = stage(candidates.where(F.col("offset") == 0).select("file", F.col("offset").alias("entry")), "reached", folder=steps)
    count = reached.count()
    while count:
        landed = reached.join(jumps, [reached["file"] == jumps["file"], reached["entry"] == jumps["at"]]).select(jumps["file"], F.col("to").alias("entry"))
        # Only places where a candidate stands are entries.
        landed = landed.join(jumps.select("file", F.col("at").alias("entry")), ["file", "entry"], "left_semi")
        reached = stage(reached.unionByName(landed).distinct(), "reached", folder=steps)
        following = reached.count()
        if following == count:
            break
        count = following
        further = jumps.select(F.col("file"), F.col("at").alias("to"), F.col("to").alias("_then"))
        jumps = stage(jumps.join(further, ["file", "to"], "left").select("file", "at", F.coalesce("_then", "to").alias("to")), "jumps", folder=steps)
    return reached


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record of the archives.

    Lengths and digests of responses are those of the payloads as read; a revisit has them in its headers.
    """
    with passing_folder(spark, "unwarc") as steps:
        found = stage(_described(_pieces(spark, path)).drop("value"), "pieces", folder=steps)
        # A file holds a bounded number of records, so its pieces can be put in order together; payloads stay away.
        order = Window.partitionBy("file").orderBy("block", "place")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        placed = found.withColumn("number", F.row_number().over(order) - 1)
        placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)) + (F.col("number") - 1) * len(MAGIC))
        placed = placed.where("number > 0").withColumn("successor", F.col("offset") + len(MAGIC) + F.col("reach"))
        placed = placed.withColumn("next", F.lead("offset").over(order))
        # A run ends where the successor is not the next candidate; all of a run jump to what its end points at.
        ends = F.when(F.col("successor").isNull() | F.col("next").isNull() | (F.col("successor") != F.col("next")), F.col("number"))
        following = order.rowsBetween(0, Window.unboundedFollowing)
        placed = placed.withColumn("run", F.first(ends, ignorenulls=True).over(following))
        last = F.when(ends.isNotNull(), F.struct(F.col("successor").alias("to")))
        placed = stage(placed.withColumn("to", F.first(last, ignorenulls=True).over(following)["to"]), "placed", folder=steps)
        reached = _reached(placed.select("file", "offset", "to"), steps).withColumn("entered", F.lit(True))
        marked = placed.join(reached, (placed["file"] == reached["file"]) & (placed["offset"] == reached["entry"]), "left").drop(reached["file"])
        # Within a run all from the first entry on are records; what follows a record up to the next belongs to it.
        in_run = Window.partitionBy("file", "run").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
        marked = marked.withColumn("record", F.when(F.max("entered").over(in_run), F.col("number")))
        upto = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
        owned = stage(marked.withColumn("owner", F.last("record", ignorenulls=True).over(upto)), "owned", folder=steps)
        records = owned.where("record is not null")
        single = records.where("whole")
        broken = records.where("not whole").select("file", F.col("number").alias("owner"))
        columns = ["kind", "identity", "refers", "digest", "bytes"]
        result = single.select(*columns)
        if not broken.isEmpty():
            result = result.unionByName(_put_together(spark, path, owned, broken).select(*columns))
        page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")
        result = result.select(
            page(F.col("identity")).alias("page_id"),
            F.col("bytes").alias("payload_bytes"),
            F.col("digest").alias("payload_digest"),
            F.col("kind").alias("record_type"),
            page(F.col("refers")).alias("refers_to"),
        )
        return stage(result, "records")


def _put_together(spark: SparkSession, path: str, owned: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose payload holds the magic, from their pieces; only these pieces are read again."""
    parts = owned.join(broken, ["file", "owner"]).select("file", "owner", "number")
    # Places differ from one reading to another, but the order in a file does not.
    pieces = _pieces(spark, path).withColumn("size", F.octet_length("value"))
    wanted = pieces.join(parts.select("file").distinct(), "file", "left_semi")
    numbers = wanted.withColumn("number", F.row_number().over(Window.partitionBy("file").orderBy("block", "place")) - 1)
    joined = numbers.join(parts, ["file", "number"]).groupBy("file", "owner")
    texts = joined.agg(F.array_sort(F.collect_list(F.struct("number", "value"))).alias("all"))
    return _described(texts.select("file", F.array_join(F.transform("all", lambda x: x["value"]), MAGIC).alias("value")))


def archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages to ``path`` and returns what the archives hold."""
    write_archives(pages, path, page_id, url, html)
    return read_archives(pages.sparkSession, path)
