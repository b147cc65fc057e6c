"""WARC archives: distributed writing, and reading by boundary chains.

Writing. A record is one string; Spark's text sink ends it with CR LF CR LF,
which is the WARC record terminator, so every task writes a well-formed archive
through the output committer of any store. A payload of at least
``REVISIT_BYTES`` that several pages share is written once, by the page of the
largest page_id; the others are revisit records with its digest and length.

Reading. Archives are split at the magic line wherever it stands, in splits of
any size. Each piece is a candidate record: tasks emit its offset and, from its
Content-Length, its successor's. Pointer jumping from offset 0 keeps the
candidates that a chain from the start of the file reaches, so magic inside a
payload is rejected. Only offsets, header fields and digests move; the bytes of
a record whose payload holds magic are cut from its archive afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, read_table, stage

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
REVISIT_BYTES = 1000
#: Records in one archive file, and bytes, so that a reader can hold one that needs it whole.
FILE_RECORDS = 20_000
FILE_BYTES = 1 << 30
#: What a record's headers take at most, besides its address.
HEADER_BYTES = 1 << 10
_ZERO_TIME = "1970-01-01T00:00:00Z"


def _header(*fields: tuple[str, object]):
    return F.concat(F.lit("WARC/1.0"), *[F.concat(F.lit(f"\r\n{name}: "), value.cast("string") if hasattr(value, "cast") else F.lit(value)) for name, value in fields], F.lit(END))


def records(pages: DataFrame) -> DataFrame:
    """(page_id, record): each page's WARC record without its terminator."""
    full = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20]", "%20").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).select("*", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("bigint").alias("size"))
    shared = full.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    revisits = (
        full.select("page_id", "digest").join(shared.select(F.col("digest").alias("d"), "owner"), F.col("digest") == F.col("d")).where("page_id < owner").select("page_id", "digest", "owner").distinct()
    )
    # staged, so that its size is known: a small table goes to the pages, a large one is joined by page
    revisits = stage(revisits, "revisits")
    owned = full.join(revisits.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "owner"), (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left")
    common = [
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))), ("WARC-Date", _ZERO_TIME), ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
    ]
    response = F.concat(_header(("WARC-Type", "response"), *common, ("Content-Type", "text/html"), ("Content-Length", F.col("size"))), F.col("html"))
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    revisit = _header(
        ("WARC-Type", "revisit"), *common, ("WARC-Profile", profile), ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("owner").cast("string"), F.lit(">"))), ("WARC-Full-Length", F.col("size")), ("Content-Length", 0)
    )
    return owned.select("page_id", F.when(F.col("owner").isNull(), response).otherwise(revisit).alias("record"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Archives of all pages below ``path``, a record a row.

    Null html is an empty payload and a null url an empty one. Repeated rows
    of the largest page_id of a payload are all responses, and a row without a
    page_id is a response. Extra columns are not written.
    """
    longest = pages.agg(F.max(F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)) + 3 * F.coalesce(F.octet_length(F.col("url").cast("string")), F.lit(0)))).first()[0] or 0
    fit = max(1, min(FILE_RECORDS, FILE_BYTES // (longest + HEADER_BYTES)))
    records(pages).select(F.col("record").alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", fit).text(path)


def _field(name: str):
    return F.nullif(F.regexp_extract("header", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row for each piece that follows the magic line, with its place and header.

    ``size`` is the piece's bytes and ``own_digest`` the digest of its body if
    the body is as long as the header says, terminator included.
    """
    pieces = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value"
    )
    head = pieces.select("file", "block", "seq", "value", F.octet_length("value").cast("bigint").alias("size"), F.substring_index("value", END, 1).alias("header"))
    ahead = F.octet_length("header").cast("bigint") + len(END)
    known = head.select(
        "file", "block", "seq", "size", ahead.alias("ahead"), F.try_to_number(F.nullif(_field("Content-Length"), F.lit("")), F.lit("999999999999999")).cast("bigint").alias("length"), "header", "value"
    )
    whole = F.col("length") + F.col("ahead") + len(END) == F.col("size")
    body = F.substring(F.col("value").cast("binary"), F.col("ahead").cast("int") + 1, F.col("length").cast("int"))
    return known.select(
        "file", "block", "seq", "size", "ahead", "length", F.when(whole, F.sha1(body)).alias("own_digest"), _field("WARC-Type").alias("kind"), _field("WARC-Record-ID").alias("record_id"), _field("WARC-Target-URI").alias("url"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"), _field("WARC-Refers-To").alias("refers"), _field("WARC-Full-Length").cast("bigint").alias("full_length"),
    )


def _offsets(found: DataFrame) -> DataFrame:
    """Adds each piece's offset in its file, the place of its magic line.

    Sums run over a block's pieces and then over a file's blocks, so a file of
    any size is added up in parallel.
    """
    blocks = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("sum"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("file", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    run = found.withColumn("inside", F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(inside), F.lit(0)))
    # the piece before the first magic line of a file is the empty one at its start
    return run.join(bases, ["file", "block"]).withColumn("offset", F.col("base") + F.col("inside") - len(MAGIC)).drop("base", "inside")


def reachable(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which candidates a chain of successors from offset 0 reaches, by pointer jumping."""
    n = len(offset)
    order = np.argsort(offset, kind="stable")
    at = np.searchsorted(offset[order], successor)
    hit = (at < n) & (offset[order][np.minimum(at, n - 1)] == successor) if n else at.astype(bool)
    jump = np.append(np.where(hit, order[np.minimum(at, n - 1)], n), n)
    reached = np.append(offset == 0, False)
    while True:
        more = reached.copy()
        more[jump[reached]] = True
        more[n] = False
        if (more == reached).all():
            return reached[:n]
        reached, jump = more, jump[jump]


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    successor = (pdf["offset"] + len(MAGIC) + pdf["ahead"] + pdf["length"].fillna(-(1 << 60)) + len(END)).to_numpy(dtype=np.int64)
    return pdf.loc[reachable(pdf["offset"].to_numpy(dtype=np.int64), successor), ["file", "offset"]]


def chained(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives: candidates that a chain from the file's start reaches."""
    found = stage(_offsets(candidates(spark, path)), "candidates")
    chain = found.where("offset >= 0").select("file", "offset", "ahead", "length").groupBy("file").applyInPandas(_chain, "file string, offset bigint")
    return stage(found.join(chain, ["file", "offset"]), "records")


def _split_bodies(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Digests of the records whose payload holds magic, from their archives' bytes."""
    broken = found.where("own_digest is null").select("file", "offset", "ahead", "length")
    files = [r.file for r in broken.select("file").distinct().collect()]  # at most one a file of the archive
    if not files:
        return spark.createDataFrame([], "file string, offset bigint, body_digest string")
    spans = broken.groupBy("file").agg(F.collect_list(F.struct("offset", (F.col("offset") + len(MAGIC) + F.col("ahead")).alias("start"), "length")).alias("spans"))
    bytes_ = spark.read.format("binaryFile").load(files).select(F.col("path").alias("file"), "content")
    cut = F.transform("spans", lambda s: F.struct(s["offset"].alias("offset"), F.sha1(F.substring(F.col("content"), s["start"].cast("int") + 1, s["length"].cast("int"))).alias("body_digest")))
    return bytes_.join(spans, "file").select("file", F.explode(cut).alias("cut")).select("file", "cut.offset", "cut.body_digest")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per record: record_id, url, record_type, payload_bytes, payload_digest and refers_to_id.

    The length and digest are of the full payload: counted from the bytes of a
    response, taken from the headers of a revisit. Magic inside a payload makes
    no record; a file whose chain breaks gives the records before the break.
    """
    found = chained(spark, path)
    split = _split_bodies(spark, found)
    both = found.join(split, ["file", "offset"], "left")
    revisit = F.col("kind") == "revisit"
    return both.select(
        "record_id", "url", F.col("kind").alias("record_type"), F.when(revisit, F.col("full_length")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.coalesce("own_digest", "body_digest")).alias("payload_digest"), F.when(revisit, F.col("refers")).alias("refers_to_id"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), path)
    number = lambda c: F.nullif(F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1), F.lit("")).cast("bigint")
    return read_warc(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to"))


OP7_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, html, strlen(html) as size, max(page_id) over (partition by html) as owner from p)
select page_id, cast(size as bigint) as payload_bytes, sha1(html) as payload_digest,
  case when size >= 1000 and page_id < owner then 'revisit' else 'response' end as record_type,
  case when size >= 1000 and page_id < owner then owner end as refers_to
from q
"""
