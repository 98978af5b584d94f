"""WARC archives: written by Spark's text sink, read back in splits, with only records that the file's own chain reaches.

Reading cuts files at every `WARC/1.`, so tasks read parts of a file of any size. What follows a cut and
parses as a record's head is a candidate with a successor: its place plus head, Content-Length and the
blank line. A page may hold such text as well; only candidates that the chain of successors reaches from
the file's start are records. A split first follows chains within itself; between splits, pointer
jumping doubles the known part of all files' chains at once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, shared_dir, written

# Fixed values of the format: what begins a record, what ends it, what follows its version; the profile of a revisit.
MAGIC, END, EOL = "WARC/1.", "\r\n\r\n", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 digest of bytes in upper-case base32."""
    five = [F.conv(F.substring(F.sha1(data), 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for n in five for s in (15, 10, 5, 0)])


def _lines(**fields: Column) -> Column:
    """Head lines of the fields that are not null."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{EOL}{k.replace('_', '-')}: "), v), F.lit("")) for k, v in fields.items()])


def _record(kind: str, url: Column, digest: Column, page: Column, record_id: Column, refers: Column, html: Column | None) -> Column:
    """One record without the blank lines that end it."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8"), F.lit(END), html if html is not None else F.lit(""))
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20"), r"WARC/1\.", "WARC/1%2E")
    head = _lines(
        WARC_Type=F.lit(kind), WARC_Record_ID=record_id, WARC_Date=F.lit("1970-01-01T00:00:00Z"), WARC_Target_URI=safe, WARC_Payload_Digest=F.concat(F.lit("sha1:"), digest), WARC_Profile=F.lit(PROFILE if kind == "revisit" else None).cast("string"),
        WARC_Refers_To=refers, Page_Id=page.cast("string"), Content_Type=F.lit("application/http;msgtype=response"), Content_Length=F.octet_length(http).cast("string"),
    )
    return F.concat(F.lit(f"{MAGIC}1"), head, F.lit(END), http)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> None:
    """Writes a record for each row of pages to *.txt files under path, one or more for each task.

    Of the rows whose payload (the text's bytes, null as none) is equal and has `least_bytes` or more, one
    with the greatest id is a response; the others are revisits that refer to it. A null id is smaller than
    all others; of repeated rows one may be the response. Texts of such rows are the only ones
    that are shuffled, one for each payload, and once revisits are too many to broadcast. A missing or null
    URL is empty; blanks and control characters in it are written as %20, a magic with %2E. Other columns are not read. An
    empty table gives files without records.
    """
    text = F.coalesce(column(text_col), F.lit(""))
    url = column(url_col) if url_col in pages.columns else F.lit(None).cast("string")
    d = pages.select(column(id_col).cast("long").alias("page"), url.alias("url"), text.alias("html"), base32_sha1(text.cast("binary")).alias("digest"))
    long_enough = F.octet_length("html") >= least_bytes
    narrow = d.where(long_enough).groupBy("digest", "page", "url").agg(F.count(F.lit(1)).alias("n"))
    twins = narrow.groupBy("digest").agg(F.max(F.struct("page", "url")).alias("first"), F.sum("n").alias("all")).where("all > 1")
    twins = written(twins.select("digest", F.col("first.page").alias("first_page"), F.col("first.url").alias("first_url")))
    own = F.concat(F.lit("<urn:page:"), F.col("digest"), F.lit(">"))
    singles = d.join(twins.select("digest"), "digest", "left_anti").select(_record("response", F.col("url"), F.col("digest"), F.col("page"), F.when(long_enough, own).otherwise(F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))), F.lit(None).cast("string"), F.col("html")))
    is_first = F.col("page").eqNullSafe(F.col("first_page")) & F.col("url").eqNullSafe(F.col("first_url"))
    firsts = d.join(twins, "digest").where(is_first).groupBy("digest", "page", "url").agg(F.first("html").alias("html"))
    firsts = firsts.select(_record("response", F.col("url"), F.col("digest"), F.col("page"), own, F.lit(None).cast("string"), F.col("html")))
    again = narrow.join(twins, "digest").withColumn("n", F.col("n") - F.when(is_first, 1).otherwise(0)).where("n > 0").withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    again = again.select(_record("revisit", F.col("url"), F.col("digest"), F.col("page"), F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")), own, None))
    singles.union(firsts).union(again).toDF("value").write.option("lineSep", END).option("compression", "none").text(path)


PIECE = "file string, block bigint, at bigint, size bigint, step bigint, exit bigint, head string, begin bigint, payload_bytes bigint, digest string, payload binary, body binary"
_HEAD = re.compile(rb"[01]\r\n(?:[!-9;-~]+:[^\r\n]*\r\n)+\r\n")
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$")
_HTTP = re.compile(rb"(?im)^content-type:[ \t]*application/http")


def _pieces(keep: bool, with_payload: bool):
    """Pieces between two magics, in a split's order, and then the split's candidates; places count from its first piece.

    A candidate has step, the bytes to its successor, and exit, where its chain leaves the split. A piece's
    bytes are its body where they may belong to a record of several pieces, or all with keep.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.split(" ")[0] for c in PIECE.split(", ")]
        types = [pa.string(), *[pa.int64()] * 5, pa.string(), *[pa.int64()] * 2, pa.string(), pa.binary(), pa.binary()]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)

        def left(split, steps):
            """A split's candidates, from the last to the first."""
            to, rows = {}, []
            for at in sorted(steps, reverse=True):
                to[at] = to.get(at + steps[at], at + steps[at])
                rows.append({"file": split[0], "block": split[1], "at": at, "step": steps[at], "exit": to[at]})
            for i in range(0, len(rows), 10_000):
                yield table(rows[i : i + 10_000])

        split, at, open_to, steps = None, 0, -1, {}
        for b in batches:
            rows, held = [], 0
            for file, block, value in zip(b.column("file"), b.column("block"), b.column("value"), strict=True):
                now, v = (file.as_py(), block.as_py()), value.as_py()
                if now != split:
                    yield from left(split, steps)
                    split, at, open_to, steps = now, 0, -1, {}
                row = {"file": now[0], "block": now[1], "at": at, "size": len(v)}
                head = _HEAD.match(v)
                length = head and _LENGTH.search(head[0])
                whole = False
                if length:
                    row["head"], row["begin"] = head[0].decode("utf-8", "replace"), head.end()
                    end = head.end() + int(length[1])
                    steps[at] = len(MAGIC) + end + len(END)
                    whole = end + len(END) == len(v)
                if whole:
                    payload = _payload(v[head.end() : end], head[0])
                    row["payload_bytes"], row["digest"] = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    row["payload"] = payload if with_payload else None
                elif length:
                    open_to = max(open_to, at + steps[at])
                if keep or not whole or at < open_to:
                    row["body"] = v
                rows.append(row)
                held += len(row.get("body") or b"") + len(row.get("payload") or b"")
                if held > 4 << 20:
                    yield table(rows)
                    rows, held = [], 0
                at += len(v) + len(MAGIC)
            if rows:
                yield table(rows)
        yield from left(split, steps)

    return run


def _payload(block: bytes, head: bytes) -> bytes:
    """What follows the head of an HTTP message, or the whole block."""
    return block.partition(END.encode())[2] if _HTTP.search(head) else block


def _joined(parts: DataFrame, several: DataFrame) -> DataFrame:
    """Records of several pieces, put together. parts(file, owner, off, body)"""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            out = []
            for r in b.itertuples():
                v = MAGIC.encode().join(p["body"] for p in r.parts)
                whole = r.next - r.off == len(MAGIC) + len(v[: r.next - r.off - len(MAGIC)])
                payload = _payload(v[int(r.begin) : r.next - r.off - len(MAGIC) - len(END)], r.head.encode())
                out.append((r.file, r.off, r.head, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), payload, whole))
            yield pd.DataFrame(out, columns=["file", "off", "head", "payload_bytes", "digest", "payload", "whole"])

    lists = parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("off", "body"))).alias("parts"))
    d = several.join(lists.withColumnRenamed("owner", "off"), ["file", "off"])
    return d.mapInPandas(run, "file string, off bigint, head string, payload_bytes bigint, digest string, payload binary, whole boolean")


def _parts(pieces: DataFrame, chain: DataFrame, several: DataFrame) -> DataFrame:
    """(file, owner, off, body): the pieces of the records in several; a piece belongs to the last record of the chain at or before it.

    Carried forward within a split, and from split to split by the last record of each.
    """
    d = pieces.select("file", "block", "off").join(chain.select("file", "off", F.col("off").alias("own")), ["file", "off"], "left")
    last = d.groupBy("file", "block").agg(F.max("own").alias("own"))
    before = F.max("own").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    last = last.select("file", "block", before.alias("_before"))
    within = F.last("own", ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("off"))
    d = d.withColumn("own", within).join(last, ["file", "block"]).select("file", "off", F.coalesce("own", "_before").alias("owner"))
    d = d.join(several.select("file", F.col("off").alias("owner"), "next"), ["file", "owner"]).where("off < next").drop("next")
    return pieces.select("file", "off", "body").join(d, ["file", "off"])


def _walk(rows):
    """A split's candidates on the chain that goes through an entry."""
    import pandas as pd

    rows = rows.sort_values("off")
    due, keep = None, []
    for off, to, entry in zip(rows["off"], rows["next"], rows["entry"], strict=True):
        take = entry or off == due
        keep.append(take)
        due = to if take else due
    return pd.DataFrame(rows[keep], columns=["file", "off", "next"])


def chained(candidates: DataFrame) -> DataFrame:
    """(file, off, next): the candidates that a file's chain reaches from its start. candidates(file, block, off, next, exit)

    Only places where a chain enters a split take part in the jumps; each round joins what is reached with
    jumps of twice the length, so rounds grow with the logarithm of a file's splits.
    """
    goals = candidates.select("file", F.col("exit").alias("off")).distinct()
    starts = candidates.where("off = 0").select("file", "off")
    nodes = candidates.select("file", "off", "exit").join(goals.union(starts).distinct(), ["file", "off"], "left_semi")
    jumps, reached = written(nodes.select("file", "off", F.col("exit").alias("to"))), written(starts)
    n, before = reached.count(), -1
    while n != before:
        before = n
        further = reached.join(jumps, ["file", "off"]).select("file", F.col("to").alias("off")).join(jumps.select("file", "off"), ["file", "off"], "left_semi")
        reached = written(reached.union(further).distinct())
        n = reached.count()
        jumps = written(jumps.join(jumps.select("file", F.col("off").alias("to"), F.col("to").alias("beyond")), ["file", "to"], "left").select("file", "off", F.coalesce("beyond", "to").alias("to")))
    marked = candidates.join(reached.withColumn("entry", F.lit(True)), ["file", "off"], "left").select("file", "block", "off", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
    return marked.groupBy("file", "block").applyInPandas(_walk, "file string, off bigint, next bigint")


def _field(name: str, of: Column) -> Column:
    return F.nullif(F.regexp_extract(of, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1), F.lit(""))


def read_warc(spark: SparkSession, path: str, with_payload: bool = True, keep: bool = False) -> DataFrame:
    """(file, off, record_id, record_type, refers, page, url, claimed, payload_bytes, digest, payload, whole): the records of
    the archives under path, uncompressed, WARC 1.0 or 1.1, as far as each file's chain goes.

    payload is null without with_payload; payload_bytes and digest (base32 SHA-1) are of the bytes that were read, claimed is
    the digest in the head. A file whose chain breaks (cut off, or a wrong length) gives the records before the
    break; `whole` is false for a last one that is cut off. Payloads that hold what looks like
    records are put together again. Folders without records give no rows.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    found = written(raw.mapInArrow(_pieces(keep, with_payload), PIECE))
    pieces, steps = found.where("size is not null"), found.where("size is null")
    per = pieces.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("n"))
    # a row for each split of a file
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    base = written(per.select("file", "block", (F.coalesce(before, F.lit(0)) - len(MAGIC)).alias("base")))
    place = lambda c: F.col("base") + F.col(c)
    steps = steps.join(base, ["file", "block"]).select("file", "block", place("at").alias("off"), (place("at") + F.col("step")).alias("next"), place("exit").alias("exit"))
    chain = written(chained(steps.where("off >= 0")))
    pieces = pieces.join(base, ["file", "block"]).withColumn("off", place("at")).drop("base", "at", "step", "exit")
    records = pieces.join(chain, ["file", "off"])
    found = records.where("payload_bytes is not null").select("file", "off", "head", "payload_bytes", "digest", "payload", F.lit(True).alias("whole"))
    several = written(records.where("payload_bytes is null").select("file", "off", "next", "head", "begin"))
    if not several.isEmpty():
        parts = _parts(pieces, chain, several)
        if not parts.where("body is null").isEmpty():  # begun in another split, which could not tell
            return read_warc(spark, path, with_payload, keep=True)
        found = found.unionByName(_joined(parts, several).withColumn("payload", F.col("payload") if with_payload else F.lit(None).cast("binary")))
    h = F.col("head")
    claimed = F.regexp_replace(_field("WARC-Payload-Digest", h), "^sha1:", "")
    return found.select("file", "off", _field("WARC-Record-ID", h).alias("record_id"), _field("WARC-Type", h).alias("record_type"), _field("WARC-Refers-To", h).alias("refers"), _field("Page-Id", h).try_cast("long").alias("page"), _field("WARC-Target-URI", h).alias("url"), claimed.alias("claimed"), "payload_bytes", "digest", "payload", "whole")


def warc_round_trip(pages: DataFrame, least_bytes: int = 0, path: str | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all pages, as read back from the archives that are written for them.

    A revisit's bytes and digest are those of the response that it refers to. See write_warc and read_warc.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, least_bytes, id_col, url_col, text_col)
    d = written(read_warc(spark, path, with_payload=False))
    full = d.where("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("digest").alias("full_digest"))
    d = d.join(full, "refers", "left")
    revisit = F.col("record_type") == "revisit"
    return d.select(F.col("page").alias("page_id"), F.when(revisit, F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(revisit, F.col("full_digest")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to")

