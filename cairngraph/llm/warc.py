"""Writing pages as WARC archives and reading archives back.

Archives are written by the text sink, a row a record, the blank lines that end
a record being its line separator; so writes are committed, retried and placed
as any other table's.

They are read in splits, cut at every ``WARC/1.`` that starts a line, which may
also stand inside a payload, but not inside a header. Each piece that starts a
header is a candidate record, for which its task emits the offset of the record
that would follow. Candidates are then
proved by pointer jumping from the start of their file, in two levels: within a
block of the file over arrays, and from block to block by joins, where jumps
double each round. What is not reached from the start of its file is no record.

A file that does not start with a record yields none; where a chain meets
something that is no record, it ends. Files may be compressed as Hadoop knows
by their names; they are then one block each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from ..lineage import scratch, stored

MAGIC = b"WARC/1."
CUT = b"\n" + MAGIC
END = "\r\n\r\n"
SMALL = 100
_VERSION = re.compile(rb"\d\r\n")


def _bytes(c: str) -> Column:
    return F.coalesce(c, F.lit("")).cast("binary")


def _line(name: str, value: Column | str) -> Column:
    """A header line, nothing without a value."""
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _in_a_line(value: Column) -> Column:
    """value with control characters, which end or break a header line, percent-encoded."""
    coded = reduce(lambda v, code: F.replace(v, F.lit(chr(code)), F.lit(f"%{code:02X}")), (*range(32), 127), value)
    return F.when(value.rlike(r"[\x00-\x1F\x7F]"), coded).otherwise(value)


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", small: int = SMALL) -> None:
    """Write pages(page_id, url, html) as WARC records of captures, payload the html in UTF-8.

    Of records with equal payloads of at least ``small`` bytes those with the
    smallest page_id are responses, all others revisits of it that hold the
    HTTP header alone; without any page_id in such a group all are responses.
    A null html is an empty payload, a null url or page_id leaves its header
    lines out. The date is the same in all records. Other columns are not read.
    """
    body = _bytes("html")
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n"))
    copies = rows.where(F.col("n") >= small).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    repeated = stored(copies.where("copies > 1 and first is not null").select("digest", "first"))
    rows = rows.join(repeated, "digest", "left")
    again = F.coalesce(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.lit(False))
    kind = F.when(again, "revisit").otherwise("response")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.concat(http, F.when(again, "").otherwise(F.coalesce("html", F.lit(""))))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = F.when(again, F.concat(_line("WARC-Refers-To", urn(F.col("first"))), _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise("")
    head = [_line("WARC-Type", kind), _line("WARC-Record-ID", urn(F.col("page_id"))), _line("WARC-Date", date), _line("WARC-Target-URI", _in_a_line(F.col("url")))]
    head += [_line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), revisit, _line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", F.octet_length(block))]
    rows.select(F.concat(F.lit("WARC/1.1\r\n"), *head, F.lit("\r\n"), block).alias("value")).write.option("lineSep", END).text(path)


def _header(text: bytes) -> tuple[int, dict[str, str]] | None:
    """(bytes, fields by lower-case name) of the record header of which text is what follows MAGIC; None if it is none.

    Where a payload starts with MAGIC, the cut before it has taken the last
    character of the header.
    """
    if not _VERSION.match(text):
        return None
    end = text.find(b"\r\n\r\n")
    if end < 0:
        if not text.endswith(b"\r\n\r"):
            return None
        end = len(text) - 3
    fields: dict[str, str] = {}
    for line in text[3:end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields.setdefault(name.strip().lower(), value.strip())
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
        return None
    return len(MAGIC) + end + 4, fields


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value) of the files at path, cut at CUT, in the order of each block."""
    meta = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    return spark.read.option("lineSep", CUT.decode()).text(path).select(*meta, F.col("value").cast("binary").alias("value"))


class _Place:
    """Counts the bytes of the pieces of a task."""

    def __init__(self):
        self.here, self.at = None, 0

    def __call__(self, file: str, block: int, value: bytes) -> tuple[int, bytes]:
        """Place of the piece in its block, counted from the block's first piece, and the piece with the cut before it."""
        if (file, block) != self.here:
            self.here, self.at = (file, block), 0
            value = value if block == 0 else CUT + value
        else:
            value = CUT + value
        at = self.at
        self.at += len(value)
        return at, value


_CANDIDATE = "file string, block long, at long, start long, size long, head long, length long, http_bytes long, told_bytes long, fields map<string,string>, digest string"
_SHAPE = pa.schema([("file", pa.string()), *[(n, pa.int64()) for n in ("block", "at", "start", "size", "head", "length", "http_bytes", "told_bytes")], ("fields", pa.map_(pa.string(), pa.string())), ("digest", pa.string())])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece, with the place ``start`` of MAGIC.

    head and length are null if no header starts there, digest unless the
    record's block is whole in the piece.
    """
    place = _Place()
    for batch in batches:
        rows = []
        for file, block, value in zip(*(c.to_pylist() for c in batch.columns)):
            at, piece = place(file, block, value)
            skip = int(piece.startswith(CUT))
            row = {"file": file, "block": block, "at": at, "start": at + skip, "size": len(piece)}
            found = _header(piece[skip + len(MAGIC) :]) if piece.startswith(MAGIC, skip) else None
            if found:
                head, fields = found
                row |= {"head": head, "length": int(fields["content-length"]), "fields": list(fields.items())}
                body = piece[skip + head : skip + head + row["length"]]
                if len(body) == row["length"]:
                    row |= _payload(body, fields.get("content-type", ""))
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=_SHAPE)


def _payload(body: bytes, kind: str) -> dict:
    """Bytes of the HTTP header of a body of HTTP, the length that it tells, and the SHA-256 of what follows it."""
    end = body.find(b"\r\n\r\n") if kind.startswith("application/http") else -1
    http = end + 4 if end >= 0 else 0
    told = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,18})", body[:http])
    return {"http_bytes": http, "told_bytes": int(told[1]) if told else None, "digest": hashlib.sha256(body[http:]).hexdigest()}


def _leaps(at: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted offsets with successors, index of the successor or of itself, and whether it is one of them."""
    to = np.minimum(np.searchsorted(at, after), len(at) - 1)
    inside = at[to] == after
    return np.where(inside, to, np.arange(len(at))), inside


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the chain of each candidate of a block leaves it, by pointer jumping."""
    pdf = pdf.sort_values("offset")
    to, _ = _leaps(pdf["offset"].to_numpy(), pdf["after"].to_numpy())
    for _ in range(len(to).bit_length()):
        to = to[to]
    return pdf.assign(exit=pdf["after"].to_numpy()[to])[["file", "offset", "exit"]]


def _reached(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidates of a block that the one reached from outside leads to, by pointer jumping."""
    pdf = pdf.sort_values("offset")
    at = pdf["offset"].to_numpy()
    to, _ = _leaps(at, pdf["after"].to_numpy())
    met = at == pdf["entry"].to_numpy()
    for _ in range(len(to).bit_length()):
        met[to[met]] = True
        to = to[to]
    return pdf[met][["file", "block", "offset"]]


def _proved(candidates: DataFrame) -> DataFrame:
    """(file, block, offset) of candidates(file, block, offset, after) that the chain from offset 0 of their file reaches."""
    exits = stored(candidates.select("file", "block", "offset", "after").groupBy("file", "block").applyInPandas(_exits, "file string, offset long, exit long"))
    starts = exits.where("offset = 0").select("file", F.lit(0).cast("long").alias("offset"))
    met_by = exits.select("file", F.col("exit").alias("offset")).union(starts).distinct()
    jumps = stored(exits.join(met_by, ["file", "offset"], "left_semi"))
    reached, before = starts, -1
    n = jumps.count()
    for _ in range(n.bit_length()):  # n blocks' chains are passed in as many doublings
        onward = reached.join(jumps, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        reached = stored(reached.union(onward.join(jumps, ["file", "offset"], "left_semi")).distinct())
        now = reached.count()
        if now == before:
            break
        before = now
        far = jumps.select("file", F.col("offset").alias("exit"), F.col("exit").alias("farther"))
        jumps = stored(jumps.join(far, ["file", "exit"], "left").select("file", "offset", F.coalesce("farther", "exit").alias("exit")))
    entries = candidates.join(reached, ["file", "offset"], "left_semi").groupBy("file", "block").agg(F.min("offset").alias("entry"))
    inside = candidates.select("file", "block", "offset", "after").join(entries, ["file", "block"])
    return inside.groupBy("file", "block").applyInPandas(_reached, "file string, block long, offset long")


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """One record's payload, from its pieces."""
    pdf = pdf.sort_values("at")
    first = pdf.iloc[0]
    whole = b"".join(pdf["piece"])
    skip = int(whole.startswith(CUT)) + int(first["head"])
    return pd.DataFrame([{"file": first["file"], "offset": first["offset"], **_payload(whole[skip : skip + int(first["length"])], first["kind"] or "")}])[["file", "offset", "http_bytes", "told_bytes", "digest"]]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, fields, http_bytes, told_bytes, payload_bytes, digest): the records of the archives at path.

    fields has the header by lower-case names, told_bytes the length that the
    HTTP header tells, payload_bytes and digest are of the payload that the
    record itself holds. A record cut off by the end of its file is left out.
    """
    candidates = stored(_pieces(spark, path).mapInArrow(_candidates, _CANDIDATE))
    blocks = candidates.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = stored(blocks.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"), F.sum("bytes").over(W.partitionBy("file")).alias("total")))
    placed = candidates.join(blocks, ["file", "block"]).withColumn("offset", F.col("base") + F.col("start"))
    ends = F.col("offset") + F.col("head") + F.col("length")
    proved = stored(_proved(placed.where(ends <= F.col("total")).select("file", "block", "offset", (ends + len(END)).alias("after"))))
    records = placed.join(proved, ["file", "block", "offset"], "left_semi")
    out = ["file", "offset", "length", "fields", "http_bytes", "told_bytes", "digest"]
    found = records.where("digest is not null").select(*out)

    torn = stored(records.where("digest is null").select("file", "offset", "head", "length", "fields"))
    if not torn.isEmpty():  # payloads that hold the magic lie in several pieces, which are read again
        wanted = stored(_pieces_of(placed, proved, torn, before))
        pieces = _pieces(spark, path).mapInArrow(_placed, "file string, block long, at long, piece binary")
        parts = pieces.join(wanted, ["file", "block", "at"]).select("file", "offset", F.col("place").alias("at"), "head", "length", "kind", "piece")
        joined = parts.groupBy("file", "offset").applyInPandas(_joined, "file string, offset long, http_bytes long, told_bytes long, digest string")
        found = found.unionByName(torn.drop("head").join(joined, ["file", "offset"]).select(*out))
    return found.withColumn("payload_bytes", F.col("length") - F.col("http_bytes"))


def _pieces_of(placed: DataFrame, proved: DataFrame, torn: DataFrame, before: WindowSpec) -> DataFrame:
    """(file, block, at, place, offset, head, length, kind): the pieces that records torn(file, offset, ...) lie in.

    Every piece belongs to the last proved record at or before it; it is looked
    for in the piece's block first, then among the last ones of earlier blocks.
    """
    marks = proved.select("file", "block", "offset", F.col("offset").alias("proved"))
    pieces = placed.select("file", "block", "at", "offset").join(marks, ["file", "block", "offset"], "left")
    last = pieces.groupBy("file", "block").agg(F.max("proved").alias("last"))
    carried = last.select("file", "block", F.max("last").over(before).alias("carried"))
    within = W.partitionBy("file", "block").orderBy("at")
    owned = pieces.withColumn("of", F.max("proved").over(within)).join(carried, ["file", "block"])
    owned = owned.select("file", "block", "at", F.col("offset").alias("place"), F.coalesce("of", "carried").alias("offset"))
    records = torn.select("file", "offset", "head", "length", F.col("fields")["content-type"].alias("kind"))
    return owned.join(records, ["file", "offset"]).where(F.col("place") < F.col("offset") + F.col("head") + F.col("length"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, at, piece)."""
    place = _Place()
    for batch in batches:
        placed = [place(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([at for at, _ in placed], pa.int64()), pa.array([piece for _, piece in placed], pa.binary())], names=["file", "block", "at", "piece"])


def captures(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records as read_archives gives them.

    A revisit's bytes and digest are those its headers tell of the payload it leaves out.
    """
    page = lambda name: F.regexp_extract(F.col("fields")[name], r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    kind = F.col("fields")["warc-type"]
    again = kind == "revisit"
    told = F.regexp_replace(F.col("fields")["warc-payload-digest"], "^sha256:", "")
    return records.where(kind.isin("response", "revisit")).select(
        page("warc-record-id").alias("page_id"),
        F.when(again, F.col("told_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, told).otherwise(F.col("digest")).alias("payload_digest"),
        kind.alias("record_type"),
        page("warc-refers-to").alias("refers_to"),
    )


def archived(pages: DataFrame) -> DataFrame:
    """captures of pages(page_id, url, html), written as archives beside the checkpoints and read back, a row each."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    return captures(read_archives(pages.sparkSession, path))
