"""Operator 7: WARC archives, written and read back with boundary-chain verification.

Writing goes through Spark's text writer with CR LF as the separator, so that any store and the writer's commit
protocol serve; one record is one row. Reading splits the archives at the record magic, in parallel within a file.
A payload may hold that magic too, so each piece is only a candidate: tasks emit its offset and that of the successor
its length names. Within a block chains are followed locally; across blocks pointer jumping from each file's start
doubles the distance in every round. Only reachable candidates are records; a payload that holds the magic is put
together again from the pieces that its record spans.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ready, shared_dir

MAGIC = "WARC/1.0\r\n"
END = b"\r\n\r\n"
BASE32_16, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
URN = "urn:page:"
#: At most so many repeated payloads' digests (some 100 bytes each) are broadcast.
BROADCAST_ROWS = 200_000


def base32_sha1(payload: F.Column) -> F.Column:
    """Upper-case base32 SHA-1 of a string's bytes: each 5 hex digits are 4 digits of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), BASE32_16, BASE32)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record for every row under a folder of archives.

    Of rows with equal payloads of at least `least` bytes that with the smallest id is the response, the others
    revisit it; shorter payloads are all responses. Null html is the empty payload; a null id comes before all others;
    of equal ids with equal payloads each is a response. Control characters of addresses are dropped.
    """
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("key"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("body"))
    rows = rows.withColumn("digest", base32_sha1(F.col("body"))).withColumn("size", F.octet_length("body"))
    # Only digests met more than once travel to the rows; the counting combines before its shuffle.
    shared = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min(F.struct(F.col("key"), F.col("id"))).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    shared = cut(shared)
    few = shared.count() <= BROADCAST_ROWS  # beyond, the join shuffles, and Spark splits a payload that very many rows share
    rows = rows.join(F.broadcast(shared) if few else shared, (F.col("digest") == F.col("d")) & (F.col("size") >= least), "left")
    first = F.col("first.id")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(first)
    name = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c, F.lit("null")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), line("WARC-Refers-To", name(first)))).otherwise(""),
        F.lit("Content-Type: text/html\r\n"),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head, F.when(revisit, "").otherwise(F.col("body")), F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").text(path)


def parsed(piece: bytes) -> tuple[dict[str, str], int, int] | None:
    """(header fields, where the payload starts, its length) of what follows a magic; None where it can't be a record."""
    end = piece.find(END)
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    return fields, end + len(END), int(length)


PIECE = (
    "file string, block long, idx long, pos long, used long, next long, exit long, whole boolean, kind string, record_id string, target string, "
    "refers_to string, payload_digest string, computed string, payload_bytes long"
)


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary"))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, number within the block, bytes) of each piece; Spark reads a block's pieces in their order."""
    at, n = None, 0
    for b in batches:
        for i in range(b.num_rows):
            here = (b.column(0)[i].as_py(), b.column(1)[i].as_py())
            n = n + 1 if here == at else 0
            at = here
            yield *here, n, b.column(2)[i].as_py()


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece, with positions relative to its block's first piece: of what follows its magic, of its successor, and of where its chain leaves the block."""
    rows: list[list] = []

    def out() -> pa.RecordBatch:
        where = {r[3]: r for r in rows}
        for r in reversed(rows):
            if r[5] is not None:
                met = where.get(r[5])
                r[6] = met[6] if met else r[5]
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in PIECE.split(", ")])

    pos = 0
    for file, block, idx, piece in blocks(batches):
        if idx == 0:
            if rows:
                yield out()
            pos = 0
        used, found = len(piece) + len(MAGIC), parsed(piece)
        row = [file, block, idx, pos, used, None, None, False, None, None, None, None, None, None, None]
        if found:
            fields, start, length = found
            row[5] = pos + start + length + len(END) + len(MAGIC)
            row[7] = start + length + len(END) == len(piece)
            row[8:13] = [fields.get(k) for k in ("warc-type", "warc-record-id", "warc-target-uri", "warc-refers-to", "warc-payload-digest")]
            if row[7]:
                row[13] = digest_of(piece[start : start + length])
            row[14] = length
        rows.append(row)
        pos += used
    if rows:
        yield out()


ARROW = [pa.string(), *[pa.int64()] * 6, pa.bool_(), *[pa.string()] * 6, pa.int64()]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, kind, record_id, target, refers_to, payload_digest (of the header), computed (of the payload), payload_bytes of each record.

    Empty archives give no rows. A file whose first record can't be parsed gives no rows of its own; a chain ends at
    the first record that is cut short.
    """
    pieces = cut(ready(spark) and pieces_of(spark, path).mapInArrow(candidates, PIECE))
    size = block_bases(pieces)
    located = pieces.join(size, ["file", "block"]).select(
        "file", "block", "idx", (F.col("pos") + F.col("base")).alias("pos"), (F.col("next") + F.col("base")).alias("next"), (F.col("exit") + F.col("base")).alias("exit"),
        "base", "total", "whole", "kind", "record_id", "target", "refers_to", "payload_digest", "computed", "payload_bytes",
    )
    located = cut(located)
    # Pointer jumping over blocks: each round doubles how many blocks the known part of a chain covers.
    most = located.groupBy("file").agg(F.countDistinct("block").alias("n")).agg(F.max("n")).first()[0] or 0
    entries = located.where(F.col("pos") == len(MAGIC)).select("file", "pos")
    if most > 1:
        jump = located.where("exit is not null").select("file", F.col("pos").alias("from"), F.col("exit").alias("to"))
        covered = 1
        while covered < most:
            further = entries.join(jump, (entries["file"] == jump["file"]) & (entries["pos"] == jump["from"])).select(entries["file"], F.col("to").alias("pos"))
            entries = cut(entries.unionByName(further).distinct())
            covered *= 2
            if covered < most:
                second = jump.select(F.col("file").alias("f"), F.col("from").alias("mid"), F.col("to").alias("end"))
                jump = cut(jump.join(second, (F.col("file") == F.col("f")) & (F.col("to") == F.col("mid"))).select("file", "from", F.col("end").alias("to")))
    starts = entries.select(F.col("file").alias("f"), F.col("pos").alias("p"), F.lit(True).alias("entry"))
    marked = located.join(starts, (F.col("file") == F.col("f")) & (F.col("pos") == F.col("p")), "left").drop("f", "p")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        """The candidates on the chain from the block's entry."""
        pdf = pdf.sort_values("pos")
        where, kept = dict(zip(pdf["pos"], range(len(pdf)), strict=True)), []
        for at in pdf.loc[pdf["entry"].notna(), "pos"]:
            while at in where:
                i = where.pop(at)
                kept.append(i)
                if pd.isna(pdf["next"].iat[i]):
                    break
                at = int(pdf["next"].iat[i])
        return pdf.iloc[sorted(kept)]

    chain = cut(marked.groupBy("file", "block").applyInPandas(walk, marked.schema).where("next is not null"))
    names = ["file", (F.col("pos") - len(MAGIC)).alias("offset"), "kind", "record_id", "target", "refers_to", "payload_digest", "computed", "payload_bytes"]
    whole = chain.where("whole").select(*names)
    return whole.unionByName(spanning(spark, path, located, chain.where("not whole")).select(*names))


def block_bases(pieces: DataFrame) -> DataFrame:
    """Bytes of each block, and of the blocks before it in its file."""
    totals = pieces.groupBy("file", "block").agg(F.sum("used").alias("total"))
    before = "sum(total) over (partition by file order by block rows between unbounded preceding and 1 preceding)"
    return totals.select("file", "block", "total", F.expr(f"coalesce({before}, 0L)").alias("base"))


def spanning(spark: SparkSession, path: str, located: DataFrame, records: DataFrame) -> DataFrame:
    """Records whose payload holds the magic: their pieces are read again and put together."""
    own = records.select(F.col("file").alias("of_file"), F.col("pos").alias("of_pos"), F.col("next").alias("of_next"))
    needed = located.join(own, (F.col("file") == F.col("of_file")) & (F.col("pos") >= F.col("of_pos")) & (F.col("pos") < F.col("of_next"))).select("file", "block", "idx", "of_pos", "pos")
    needed = cut(needed)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, idx, piece in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((file, block, idx, piece), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["file", "block", "idx", "piece"])

    if not needed.head(1):  # no payload of these archives holds the magic
        return records
    found = pieces_of(spark, path).mapInArrow(raw, "file string, block long, idx long, piece binary").join(F.broadcast(needed) if needed.count() < 10_000 else needed, ["file", "block", "idx"])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        piece = MAGIC.encode().join(pdf["piece"])
        _, start, length = parsed(piece)
        held = digest_of(piece[start : start + length]) if len(piece) >= start + length else None
        return pd.DataFrame({"f": [pdf["file"].iat[0]], "p": [pdf["of_pos"].iat[0]], "again": [held]})

    held = found.groupBy("file", "of_pos").applyInPandas(joined, "f string, p long, again string")
    return records.drop("computed").join(held, (F.col("file") == F.col("f")) & (F.col("pos") == F.col("p"))).where("again is not null").withColumnRenamed("again", "computed")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Writes the archives into the shared folder, reads them back, and gives id, payload_bytes, payload_digest, record_type, refers_to of each record."""
    spark, kind = pages.sparkSession, dict(pages.dtypes)[id_col]
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, id_col, url_col, html_col, least)
    records = read_archive(spark, path)
    key = lambda c: F.expr(f"cast(nullif(substring({c}, {len(URN) + 2}, length({c}) - {len(URN) + 2}), 'null') as {kind})")
    rows = records.select(key("record_id").alias(id_col), F.col("payload_bytes").alias("own_bytes"), F.coalesce(F.when(F.col("kind") == "response", F.col("computed")), F.substring("payload_digest", 6, 32)).alias("payload_digest"), F.col("kind").alias("record_type"), key("refers_to").alias("refers_to"), F.col("refers_to").isNotNull().alias("refers"))
    rows = cut(rows)
    # A revisit's length is that of the response which it names.
    met = rows.where("refers").select(F.col("refers_to").alias("target")).distinct()
    sizes = rows.where("record_type = 'response'").join(met, F.col(id_col).eqNullSafe(F.col("target")), "left_semi").groupBy(F.col(id_col).alias("target"), F.col("payload_digest").alias("target_digest")).agg(F.max("own_bytes").alias("target_bytes"))
    joined = rows.join(sizes, F.col("refers") & F.col("refers_to").eqNullSafe(F.col("target")) & (F.col("payload_digest") == F.col("target_digest")), "left")
    return joined.select(id_col, F.when(F.col("refers"), F.col("target_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
