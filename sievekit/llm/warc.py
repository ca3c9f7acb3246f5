"""WARC archives: writing with payload deduplication, reading by boundary chains.

Writing. Each page becomes a record; records are text lines whose separator is the empty
line that ends a WARC record, so Spark's own writer makes the files. Of pages with equal
payloads the one with the largest id is a response, the others revisit it.

Reading. A file is split anywhere, and each task finds the record magic in its split.
Each find is a candidate: its header gives the offset of its successor. A task follows
its candidates' successors to where they leave the split. From the start of each file,
pointer jumping over these exits (each round doubles how far they reach) finds where the
true chain enters each split; magic inside a payload is never on that chain. A second
pass walks the chain from the entries and gives the records, put together where a
payload holds the magic.

A split's size grows with the archive, so that there are MAX_SPLITS splits at most and the
entries, one number a split, have a bounded size where they are broadcast.

Archives are uncompressed and their payloads UTF-8. A broken header ends its file's chain.

Defined results: null html is an empty payload; repeated ids with equal payloads are all
responses if theirs is the largest id; null ids are smaller than all others, and their
records have an id without a number; a null url is left out of the record; an empty table makes an empty result; further columns are
ignored. Payloads of any length are kept whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm.common import looked_up, materialize, new_path

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Payloads of fewer bytes are never made revisits.
LEAST_BYTES = 0
#: Least bytes of a split, and most splits of an archive.
SPLIT_BYTES, MAX_SPLITS = 16 << 20, 1 << 18
#: Most groups of equal payloads that are broadcast; beyond, they are joined in salted shares.
MAX_BROADCAST = 200_000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 form of a binary column's SHA-1."""
    digest = F.sha1(payload)
    out = []
    for group in range(8):
        bits = F.conv(F.substring(digest, group * 5 + 1, 5), 16, 10).cast("int")
        out += [_letter(bits, shift) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def _letter(bits: Column, shift: int) -> Column:
    return F.lit(_B32).substr(F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1))


def with_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, digest, size, refers_to (null for responses)."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id", "url", payload.alias("html"), base32_sha1(payload.cast("binary")).alias("digest"),
        F.octet_length(payload).cast("bigint").alias("size"),
    )
    groups = (
        rows.where(F.col("size") >= least_bytes).groupBy("digest")
        .agg(F.max("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1").select("digest", "leader")
    )
    groups = materialize(groups, "payloads")
    own = F.when((F.col("size") >= least_bytes) & ~F.col("leader").eqNullSafe(F.col("page_id")), F.col("leader"))
    return looked_up(rows, groups, "digest", MAX_BROADCAST, ["page_id", "url"]).withColumn("refers_to", own).drop("leader")


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _record_id(number: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(number.cast("string"), F.lit("null")), F.lit(">"))


def records(typed: DataFrame, date: Column | None = None) -> DataFrame:
    """One column, the record without the empty line that ends it; date: a timestamp, else that of the writing."""
    moment = F.current_timestamp() if date is None else date
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"), F.lit("\r\n\r\n"),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    return typed.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write pages (page_id, url, html) as WARC files under path."""
    records(with_types(pages, least_bytes)).write.option("lineSep", END).text(path)


def header(text: str) -> tuple[dict[str, str], int, int] | None:
    """Fields of a record (after its magic), its header's length and its content's length in bytes; None if broken."""
    end = text.find(END)
    if end < 0:
        return None
    fields = {}
    for line in text[:end].split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    return fields, len(text[:end].encode()) + len(END), int(length)


def split_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a split, so that the files under path make MAX_SPLITS splits at most (and one a file)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return max(SPLIT_BYTES, -(-held // MAX_SPLITS))


def _chunks(spark: SparkSession, path: str):
    """RDD of (offset after a magic or 0, text up to the next magic)."""
    return spark.sparkContext.newAPIHadoopFile(
        path,
        "org.apache.hadoop.mapreduce.lib.input.TextInputFormat",
        "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.Text",
        conf={
            "textinputformat.record.delimiter": MAGIC,
            "mapreduce.input.fileinputformat.split.maxsize": str(split_bytes(spark, path)),
        },
    )


def _successor(at: int, text: str) -> int | None:
    """The offset after the record whose magic ends at offset at."""
    found = header(text)
    return None if found is None else at + found[1] + found[2] + len(END)


def _candidates(part: int, chunks: Iterator[tuple[int, str]]) -> Iterator[tuple]:
    """part, offset, successor, exit of each candidate of a split."""
    found = []
    for at, text in chunks:
        if at > 0:
            found.append((at - len(MAGIC), _successor(at, text)))
    exits: dict[int, int | None] = {}
    for offset, after in sorted(found, reverse=True):
        exits[offset] = exits.get(after, after) if after is not None else None
    for offset, after in found:
        yield part, offset, after, exits[offset]


def entries(candidates: DataFrame) -> np.ndarray:
    """For each part the offset where its file's chain enters it, by pointer jumping; -1 where it doesn't.

    candidates: part, file, offset, exit. A number a split comes to the driver: see MAX_SPLITS.
    """
    targets = candidates.select("file", F.col("exit").alias("offset")).distinct()
    first = candidates.select("file").distinct().select("file", F.lit(0).cast("bigint").alias("offset"))
    jump = candidates.where("exit IS NOT NULL").join(targets.union(first).distinct(), ["file", "offset"], "left_semi")
    jump = materialize(jump.select("file", "offset", "exit"), "jump")
    reached = materialize(first, "reached")
    while not jump.isEmpty():
        step = reached.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        reached = materialize(reached.union(step).distinct(), "reached")
        later = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("then"))
        jump = materialize(jump.join(later, ["file", "exit"]).select("file", "offset", F.col("then").alias("exit")), "jump")
    own = candidates.join(reached, ["file", "offset"], "left_semi").groupBy("part").agg(F.min("offset").alias("offset"))
    found = own.toArrow()
    part = found.column("part").to_numpy()
    out = np.full(int(part.max(initial=-1)) + 1, -1, dtype=np.int64)
    out[part] = found.column("offset").to_numpy()
    return out


_RECORD = "offset bigint, after bigint, owner bigint, text string"


def _walk(part: int, chunks: Iterator[tuple[int, str]], entry: np.ndarray) -> Iterator[tuple]:
    """offset, after, owner, text: whole records (owner null) and pieces of those that hold the magic.

    A piece's owner is the offset of its record, or -1 if that began in a split before.
    """
    expected = int(entry[part]) if part < len(entry) else -1
    current = -1
    for at, text in chunks:
        if at == 0:
            continue
        offset = at - len(MAGIC)
        if offset == expected:
            expected = _successor(at, text)
            if expected is None:
                return
            if at + len(text.encode()) >= expected:
                yield offset, expected, None, text
                current = None
            else:
                yield offset, expected, offset, text
                current = offset
        elif current is not None:
            yield offset, None, current, MAGIC + text


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records under path: file, offset, text (without the magic, with the empty line at its end)."""
    chunks = _chunks(spark, path)
    found = spark.createDataFrame(
        chunks.mapPartitionsWithIndex(_candidates), "part int, offset bigint, after bigint, exit bigint", verifySchema=False
    )
    candidates = materialize(found.withColumn("file", F.input_file_name()), "candidates")
    entry = spark.sparkContext.broadcast(entries(candidates))
    walked = spark.createDataFrame(
        chunks.mapPartitionsWithIndex(lambda part, it: _walk(part, it, entry.value)), _RECORD, verifySchema=False
    ).withColumn("file", F.input_file_name())
    whole = walked.where(F.col("owner").isNull()).select("file", "offset", "text")
    pieces = materialize(walked.where(F.col("owner").isNotNull()), "pieces")
    begun = pieces.where(F.col("owner") == F.col("offset")).select(
        "file", F.col("offset").alias("begin"), F.col("after").alias("upto")
    )
    known = pieces.where(F.col("owner") >= 0).select("file", "owner", "offset", "text")
    strays = (
        pieces.where(F.col("owner") < 0).join(begun, "file").where("offset > begin AND offset < upto")
        .select("file", F.col("begin").alias("owner"), "offset", "text")
    )
    joined = (
        known.union(strays).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("offset", "text"))).alias("parts"))
        .select("file", F.col("owner").alias("offset"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    )
    return whole.union(joined)


def parse(read_records: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload (of responses), payload_digest (as declared)."""
    head = F.substring_index("text", END, 1)
    rest = F.expr(f"substring(text, instr(text, '{END}') + 4)".replace("\r", "\\r").replace("\n", "\\n"))

    def field(name: str, pattern: str) -> Column:
        got = F.regexp_extract(head, rf"(?im)^{name}:\s*{pattern}\s*$", 1)
        return F.when(got != "", got)

    block = F.expr("substring(rest, instr(rest, '\\r\\n\\r\\n') + 4)")
    kind = field("WARC-Type", r"(\S+)")
    return (
        read_records.withColumn("rest", rest)
        .select(
            field("WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("bigint").alias("page_id"),
            field("WARC-Target-URI", r"(.*?)").alias("url"),
            kind.alias("record_type"),
            field("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("bigint").alias("refers_to"),
            F.when(kind == "response", F.expr("left(rest, length(rest) - 4)")).alias("rest"),
            field("WARC-Payload-Digest", r"sha1:(\w+)").alias("payload_digest"),
        )
        .withColumn("payload", block)
        .drop("rest")
    )


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write pages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest are those of the payload that was read; a revisit has its response's.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, least_bytes)
    payload = F.col("payload").cast("binary")
    found = materialize(
        parse(read(spark, path)).select(
            "page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
            F.when(payload.isNotNull(), base32_sha1(payload)).alias("digest"), "record_type", "refers_to",
            F.concat_ws(":", "refers_to", "payload_digest").alias("to"),
        ), "records",
    )
    # A response is found by its id and the digest that the revisit declares: ids may repeat.
    wanted = found.where("refers_to IS NOT NULL").select("to").distinct()
    responses = (
        found.where("record_type = 'response'").withColumn("to", F.concat_ws(":", "page_id", "digest")).join(wanted, "to", "left_semi")
        .groupBy("to").agg(F.min("payload_bytes").alias("b"), F.min("digest").alias("d"))
    )
    return looked_up(found, responses, "to", MAX_BROADCAST, ["page_id"]).select(
        "page_id", F.coalesce("payload_bytes", "b").alias("payload_bytes"),
        F.coalesce("digest", "d").alias("payload_digest"), "record_type", "refers_to",
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to WARC files and read back."""
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


QUERIES = {"op8_warc": op8_warc}
ORACLE: dict[str, str] = {}
