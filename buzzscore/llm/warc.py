"""WARC archives: writing, and reading with verified record boundaries.

Writing is Spark's text writer with a record per row and the record terminator
as line separator: any file system, with the usual commit of tasks.

Reading splits files anywhere.  Spark's text reader, with the magic of a record
as line separator, gives the segments between magics; sums of their lengths
give their offsets.  A segment that starts with a WARC header proposes a link
from its own offset to the offset where its record ends.  Pointer jumping from
the start of each file keeps the records on the chain: magic inside a payload
starts a segment, but nothing on the chain leads to it.  A record whose payload
holds magic is put together from its segments.

Only offsets and header fields are shuffled.  Payloads are hashed where they
are read, except those of the records that consist of several segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buzzscore.llm.common import with_place, written

# --- fixed values of the format ------------------------------------------------
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# ------------------------------------------------------------------------------
#: Payloads of so many bytes are stored once; shorter ones with each record.
MIN_REVISIT = 100


def _record_id(id_: Column, rk: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), rk["file"], rk["row"].cast("string")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(
        F.lit("<urn:uuid:"),
        F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)),
        F.lit(">"),
    )


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    min_revisit: int = MIN_REVISIT,
) -> None:
    """Write a record per row below ``path``; ``path`` must not exist.

    Of the rows with equal payloads of at least ``min_revisit`` bytes the one
    with the smallest id (null last, then by file and place in it) is a ``response``;
    the others are ``revisit`` records that refer to it.

    * A null html is an empty payload; a null id or url leaves its header out.
    * Line breaks in an url are percent-encoded.
    * Rows with equal ids are records of their own.
    * A payload of any length is one record, whole in the row's task.
    """
    rows = with_place(
        pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    )
    digest = F.sha2(F.col("html").cast("binary"), 256)
    long_ = rows.where(F.octet_length("html") >= min_revisit).select("rk", "id", digest.alias("digest"))
    first = (
        long_.groupBy("digest")
        .agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "rk")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    # written, so that the join has a shuffle of its own: Spark can split a hot payload there
    first = written(first, "first")
    revisits = (
        long_.join(first, "digest")
        .where("rk <> first.rk")
        .select("rk", F.col("first.id").alias("to_id"), F.col("first.rk").alias("to_rk"))
    )
    # A file of known size: Spark broadcasts it where that is small, else both sides are shuffled.
    rows = rows.join(written(revisits, "revisits"), "rk", "left")
    again = F.col("to_rk").isNotNull()
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    line = lambda name, value: F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n"))
    headers = [
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("id"), F.col("rk"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(again, line("WARC-Refers-To", _record_id(F.col("to_id"), F.col("to_rk")))),
        F.when(again, line("WARC-Profile", F.lit(PROFILE))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("X-Page-Id", F.col("id")),
        line("Content-Length", F.octet_length(block)),
    ]
    headers = [F.coalesce(h, F.lit("")) for h in headers]
    record = F.concat(F.lit(MAGIC), *headers, F.lit("\r\n"), block)
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, place, value)``: what stands after each magic, in the order of the file.

    ``block`` and ``place`` depend on the splits: they order the rows of one
    job.  A later job finds a segment by its offset or its digest.
    """
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )


def _digest(value: Column) -> Column:
    return F.unhex(F.sha2(value.cast("binary"), 256))


def _values(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``(digest, value)`` of the segments whose digests are in ``wanted``, each digest once."""
    found = _segments(spark, path).select(_digest(F.col("value")).alias("digest"), "value")
    found = found.join(wanted.select("digest"), "digest", "left_semi")
    # written, so that a join with it can split a digest that many records share
    return written(found.groupBy("digest").agg(F.first("value").alias("value")), "values")


def _header(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)(?:\A|\r\n){name}:[ \t]*([^\r\n]*?)[ \t]*(?:\r\n|\z)", 1)
    return F.when(found != "", found)


_FIELDS = {
    "type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "url": "WARC-Target-URI",
    "declared": "WARC-Payload-Digest",
    "refers": "WARC-Refers-To",
    "page": "X-Page-Id",
    "length": "Content-Length",
}


def _parse(value: Column) -> Column:
    """Header fields of a segment, and its payload if the segment is a whole record."""
    head = F.substring_index(value, END, 1)
    return F.struct(
        *[_header(head, v).alias(k) for k, v in _FIELDS.items()],
        (F.octet_length(head) + len(END)).cast("long").alias("head"),
        F.octet_length(value).cast("long").alias("size"),
    )


def _payload(value: Column, head: Column, length: Column) -> Column:
    """The payload of a whole record ``value`` (without magic): its block after the HTTP header."""
    block = F.substr(value.cast("binary"), (head + 1).cast("int"), length.cast("int"))
    http = F.octet_length(F.substring_index(block.cast("string"), END, 1)) + len(END)
    is_http = F.instr(block.cast("string"), END) > 0
    return F.when(is_http, F.substr(block, (http + 1).cast("int"), length.cast("int"))).otherwise(block)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per segment: ``file, offset, size``, its header fields, the offset ``next`` of the
    record's successor if it starts with a header, its digest, and bytes and digest of a whole payload."""
    parsed = _segments(spark, path).withColumn("h", _parse(F.col("value")))
    length = F.expr("try_cast(h.length AS bigint)")
    sound = F.col("h.type").isNotNull() & length.isNotNull() & (F.col("h.size") >= F.col("h.head"))
    whole = sound & (F.col("h.size") == F.col("h.head") + length + len(END))
    payload = F.when(whole & (F.col("h.type") != "revisit"), _payload(F.col("value"), F.col("h.head"), length))
    narrow = written(
        parsed.select(
            "file",
            "block",
            "place",
            *[F.col(f"h.{k}").alias(k) for k in _FIELDS if k != "length"],
            F.when(sound, F.col("h.head") + length + len(END) + len(MAGIC)).alias("extent"),
            F.col("h.size").alias("size"),
            whole.alias("whole"),
            _digest(F.col("value")).alias("digest"),
            F.octet_length(payload).cast("long").alias("payload_bytes"),
            F.sha2(payload, 256).alias("payload_digest"),
        ),
        "segments",
    )
    # offsets: what stands before in the split, and in the splits before
    blocks = narrow.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("sum"))
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("start"))
    inside = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(inside), F.lit(0))
    placed = narrow.withColumn("before", before).join(starts, ["file", "block"])
    # the text before the first magic of a file is a segment too; its offset is below 0
    offset = F.col("start") + F.col("before") - len(MAGIC)
    return (
        placed.withColumn("offset", offset)
        .withColumn("next", F.col("offset") + F.col("extent"))
        .where("offset >= 0")
        .drop("block", "place", "before", "start", "extent")
    )


def reachable(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(file, offset)`` of the records on the chain from each file's start.

    ``links (file, offset, next)``.  A round doubles every link and marks what
    the marked records reach, so ``n`` records of a file take log2(n) rounds.
    """
    table = written(links.select("file", "offset", "next", (F.col("offset") == 0).alias("seen")), "links")
    marked = table.where("seen").count()
    for _ in range(rounds):
        to = table.select("file", F.col("offset").alias("next"), F.col("next").alias("far"))
        both = table.join(to, ["file", "next"], "left")
        doubled = both.select("file", "offset", F.col("far").alias("next"), "seen")
        # only links to candidates mark: an inner join's rows
        hits = table.where("seen").join(to, ["file", "next"]).select(
            "file", F.col("next").alias("offset"), F.lit(None).cast("long").alias("next"), F.lit(True).alias("seen")
        )
        table = written(
            doubled.union(hits).groupBy("file", "offset").agg(F.max("next").alias("next"), F.max("seen").alias("seen")),
            "links",
        )
        now = table.where("seen").count()
        if now == marked:
            return table.where("seen").select("file", "offset")
        marked = now
    raise RuntimeError(f"the chains did not end in {rounds} rounds")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: ``file, offset, type, record_id, url, page, refers, declared``, and
    ``payload_bytes`` and ``payload_digest`` of the full payload.

    A revisit's payload is that of the record it refers to; the digest is
    computed from that record's bytes, or as declared if it is not there.
    Records beyond a break in a file's chain are not reachable and not returned.
    """
    segments = written(candidates(spark, path), "candidates")
    chain = written(reachable(segments.where(F.col("next").isNotNull()).select("file", "offset", "next")), "chain")
    records = segments.join(chain, ["file", "offset"])
    stored = records.where("whole OR type = 'revisit'").drop("whole", "size", "digest")
    # records of several segments: the payload holds magic
    split = records.where("NOT whole AND type <> 'revisit'")
    split = split.drop("payload_bytes", "payload_digest", "whole", "size", "digest")
    joined = assemble(spark, path, segments, split)
    measured = joined.withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)}
    )
    out = written(stored.unionByName(measured.drop("payload")), "records").drop("next")
    first = out.where("type <> 'revisit'").select(
        F.col("record_id").alias("refers"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"),
        F.col("page").alias("refers_page"),
    )
    return out.join(first, "refers", "left").select(
        *[c for c in out.columns if c not in ("payload_bytes", "payload_digest")],
        F.coalesce("payload_bytes", "b").alias("payload_bytes"),
        F.coalesce("payload_digest", "d", F.regexp_extract("declared", "^sha256:(.*)$", 1)).alias("payload_digest"),
        "refers_page",
    )


def assemble(spark: SparkSession, path: str, segments: DataFrame, records: DataFrame) -> DataFrame:
    """``records (file, offset, next, ...)`` with their ``payload`` (binary), from all their segments.

    A segment belongs to the last record that starts at or before it, found by
    a running maximum over the (narrow) segments of the files concerned.  The
    segments of a record meet in one row, which is as large as the record.
    """
    spans = records.select("file", F.col("offset").alias("record"), "next")
    of_file = segments.select("file", "offset", "digest").join(spans.select("file").distinct(), "file", "left_semi")
    marked = of_file.unionByName(
        spans.select("file", F.col("record").alias("offset"), "record", "next"), allowMissingColumns=True
    )
    upto = Window.partitionBy("file").orderBy("offset").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.max(F.when(F.col("record").isNotNull(), F.struct("record", "next"))).over(upto)
    parts = marked.withColumn("owner", owner).where("digest IS NOT NULL AND offset < owner.next")
    parts = parts.withColumn("record", F.col("owner.record"))
    wanted = written(parts.select("file", "record", "offset", "digest"), "parts")
    values = wanted.join(_values(spark, path, wanted), "digest")
    whole = values.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: x["value"]), MAGIC)
    whole = whole.select("file", F.col("record").alias("offset"), text.alias("text"))
    whole = whole.withColumn("h", _parse(F.col("text")))
    payload = _payload(F.col("text"), F.col("h.head"), F.expr("try_cast(h.length AS bigint)"))
    return records.join(whole.select("file", "offset", payload.alias("payload")), ["file", "offset"])


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``(file, offset, payload)``, payload as binary, of every stored record."""
    segments = written(candidates(spark, path), "candidates")
    chain = reachable(segments.where(F.col("next").isNotNull()).select("file", "offset", "next"))
    records = written(segments.join(chain, ["file", "offset"]).where("type <> 'revisit'"), "records")
    whole = records.where("whole").select("file", "offset", "digest")
    values = whole.join(_values(spark, path, whole), "digest").withColumn("h", _parse(F.col("value")))
    payload = _payload(F.col("value"), F.col("h.head"), F.expr("try_cast(h.length AS bigint)"))
    split = assemble(spark, path, segments, records.where("NOT whole").select("file", "offset", "next"))
    return values.select("file", "offset", payload.alias("payload")).union(split.select("file", "offset", "payload"))
