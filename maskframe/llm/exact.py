"""Exact dedup by an exchange of Golomb-coded fingerprints.

Sender: each task reads its documents in chunks of bounded size, deletes blanks from the texts, and puts equal texts of the
chunk together, byte by byte. The distinct texts are sorted by a 48-bit fingerprint; a fingerprint's leading bits name its
owner, so each owner's part is one run of the list. The run's gaps are Golomb-coded (quotients in unary, then remainders)
and sent. Owner: it decodes the runs of all senders, marks the fingerprints that occur more than once, and returns to each
sender that has any a bitmap in the order of its run. Suspects: only texts whose bit is set are shuffled, and they are
grouped by their bytes, so texts that merely share a fingerprint stay apart. All other texts are done at their sender.

What a task writes (texts, members, messages) is stored before it is used, so a lost executor cannot change who has which
place in a list.

Scale: messages take about half of the raw fingerprints; a text that a third of all rows hold is one row for each chunk of
up to CHUNK_ROWS documents before it is shuffled; owners grow with the number of rows, so that none holds more than about
OWNED fingerprints. Bitmaps are broadcast while they are small and meet the texts by a shuffle beyond that.

Edge cases: a null text counts as empty, and empty and blank texts are one group; of texts with equal length the smallest id
stays, a null id comes last (keep_id is null only if no row of the group has an id); of rows that are equal in length and id,
exactly one stays; very long texts are rows like others (a chunk holds at least one text); an empty table gives an empty
result; further columns are not read, and clashing names do not matter, as only id and text are.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, table, text_of
from .substrings import light

BLANKS = bytes([9, 10, 11, 12, 13, 32])
#: Bits of a fingerprint. Different texts share one with probability 2**-48, which only makes them suspects.
BITS = 48
#: A sender's list covers at most so many documents and, but for one text, so many bytes of text.
CHUNK_ROWS, CHUNK_BYTES = 65_536, 32 << 20
#: An owner gets about so many fingerprints at most; there are LEAST_OWNERS of them at least.
OWNED, LEAST_OWNERS = 1 << 20, 64


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, BLANKS)


def golomb_shift(n: int, span: int) -> int:
    """Binary logarithm of the divisor for n sorted values below span: the power of two below 0.69 x the mean gap."""
    return max(0, int(0.69 * span / n).bit_length() - 1)


def golomb(values: np.ndarray, span: int) -> bytes:
    """Sorted values below span by their gaps: quotients in unary, then remainders of fixed width."""
    k = golomb_shift(len(values), span)
    gaps = np.diff(values, prepend=np.uint64(0))
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.ones(ends[-1], dtype=np.uint8)
    unary[ends - 1] = 0
    low = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(np.concatenate([unary, low.astype(np.uint8).ravel()])).tobytes()


def from_golomb(code: bytes, n: int, span: int) -> np.ndarray:
    k = golomb_shift(n, span)
    bits = np.unpackbits(np.frombuffer(code, dtype=np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    quotients = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    low = bits[ends[-1] + 1 : ends[-1] + 1 + n * k].reshape(n, k).astype(np.uint64)
    return np.cumsum((quotients << np.uint64(k)) + (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64), dtype=np.uint64)


class Chunk:
    """Documents of one sender."""

    def __init__(self) -> None:
        self.members: dict[bytes, list[tuple]] = {}
        self.rows = self.bytes = 0

    def add(self, ident, text: str | None) -> None:
        self.members.setdefault(normalised(text), []).append((ident, len(text or "")))
        self.rows += 1
        self.bytes += len(text or "")

    def full(self, most: int) -> bool:
        return self.rows >= most or self.bytes >= CHUNK_BYTES

    def table(self, sender: int, owner_bits: int, bits: int) -> Iterator[list[dict]]:
        """Rows of kind text and of kind message."""
        if not self.members:
            return
        digests = {t: hashlib.sha256(t).digest() for t in self.members}
        texts = sorted(digests, key=lambda t: (digests[t], t))
        prints = np.array([int.from_bytes(digests[t][: bits // 8]) for t in texts], dtype=np.uint64)
        owners = (prints >> np.uint64(bits - owner_bits)).astype(np.int64)
        for slot, t in enumerate(texts):
            own = sorted(self.members[t], key=lambda m: (-m[1], m[0] is None, m[0] if m[0] is not None else 0))
            yield {"kind": "text", "sender": sender, "owner": int(owners[slot]), "slot": slot, "sha": digests[t].hex(), "norm": t, "members": [{"id": i, "chars": c} for i, c in own]}
        span = 1 << (bits - owner_bits)
        starts = np.flatnonzero(np.diff(owners, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(owners)], strict=True):
            code = golomb(prints[a:b] & np.uint64(span - 1), span)
            yield {"kind": "message", "sender": sender, "owner": int(owners[a]), "slot": int(a), "n": int(b - a), "code": code}


def sent(df: DataFrame, id_col: str, text_col: str, owner_bits: int, bits: int = BITS, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The senders' texts and messages, both stored."""
    id_type = df.schema[id_col].dataType.simpleString()
    fields = f"kind string, sender long, owner int, slot int, sha string, norm binary, members array<struct<id: {id_type}, chars: bigint>>, n int, code binary"
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = rows.sparkSession.createDataFrame([], fields).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        task, chunk, number = TaskContext.get().partitionId(), Chunk(), 0

        def out(done: Chunk) -> Iterator[pa.RecordBatch]:
            part: list[dict] = []
            size = 0
            for row in done.table((task << 32) + number, owner_bits, bits):
                part.append(row)
                size += len(row.get("norm") or b"") + 200
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(part, arrow)
                    part, size = [], 0
            if part:
                yield pa.RecordBatch.from_pylist(part, arrow)

        for b in batches:
            for ident, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                chunk.add(ident, text.as_py())
                if chunk.full(chunk_rows):
                    yield from out(chunk)
                    chunk, number = Chunk(), number + 1
        yield from out(chunk)

    path = f"{shared_dir(df.sparkSession)}/exchange-{uuid.uuid4().hex}"
    rows.mapInArrow(run, schema).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    back = df.sparkSession.read.schema(schema).parquet(path)
    texts = back.filter("kind = 'text'").select("sender", "owner", "slot", "sha", "norm", "members")
    return texts, back.filter("kind = 'message'").select("sender", "owner", F.col("slot").alias("first"), "n", "code")


def bitmaps(messages: DataFrame, owner_bits: int, bits: int = BITS) -> DataFrame:
    """(sender, owner, first, bitmap): for each message with a repeated fingerprint, which of its places have one."""

    def owned(m: pd.DataFrame) -> pd.DataFrame:
        span = 1 << (bits - owner_bits)
        found = [from_golomb(c, n, span) for c, n in zip(m["code"], m["n"], strict=True)]
        _, back, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        marks = np.split(counts[back] > 1, np.cumsum(m["n"].to_numpy())[:-1])
        some = [x.any() for x in marks]
        kept = m.loc[some, ["sender", "owner", "first"]]
        return kept.assign(bitmap=[np.packbits(x).tobytes() for x, s in zip(marks, some, strict=True) if s])

    return messages.groupBy("owner").applyInPandas(owned, "sender long, owner int, first int, bitmap binary")


def marked(texts: DataFrame, maps: DataFrame) -> DataFrame:
    """Adds suspect."""
    at = F.col("slot") - F.col("first")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, (7 - at % 8).cast("int")) == 1
    return texts.join(light(maps, F.octet_length("bitmap") + 24), ["sender", "owner"], "left").withColumn("suspect", F.coalesce(bit, F.lit(False))).drop("first", "bitmap")


def verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row of df. bits: of a fingerprint, whole bytes."""
    owner_bits = min(bits, (max(LEAST_OWNERS, df.count() // OWNED) - 1).bit_length())
    texts, messages = sent(df, id_col, text_col, owner_bits, bits, chunk_rows)
    texts = marked(texts, stored(bitmaps(messages, owner_bits, bits), "bitmaps"))
    best = F.col("members")[0]
    order = F.struct((-best["chars"]).alias("c"), best["id"].isNull().alias("none"), best["id"].alias("id"), "sender", "slot")
    groups = texts.filter("suspect").groupBy("sha", "norm").agg(F.min(order).alias("w"), F.sum(F.size("members")).alias("total"))
    groups = stored(groups.select("sha", "w", "total"), "groups")

    def expanded(rows: DataFrame, keep_id: Column, size: Column, first: Column) -> DataFrame:
        each = rows.select(keep_id.alias("keep_id"), size.cast("long").alias("group_size"), first.alias("wins"), "sha", F.posexplode("members").alias("pos", "m"))
        return each.select(F.col("m.id").alias(id_col), "keep_id", "group_size", (F.col("wins") & (F.col("pos") == 0)).alias("kept"), F.col("sha").alias("text_sha256"))

    alone = expanded(texts.filter("not suspect").select("sha", "members"), best["id"], F.size("members"), F.lit(True))
    shared = texts.filter("suspect").select("sender", "slot", "sha", "members").join(groups, "sha")
    return alone.unionByName(expanded(shared, F.col("w.id"), F.col("total"), (F.col("w.sender") == F.col("sender")) & (F.col("w.slot") == F.col("slot"))))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, in its columns. Rows are found by id, length and text; of rows equal in these one stays."""
    kept = verdicts(df, id_col, text_col).filter("kept").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    text = text_of(text_col)
    own = df.withColumn("__sha", F.sha2(F.translate(text, BLANKS.decode(), "").cast("binary"), 256)).withColumn("__chars", F.length(text))
    best = own.join(kept, own[id_col].eqNullSafe(kept["__id"]) & (own["__sha"] == kept["__sha"]), "left_semi")
    longest = best.groupBy("__sha").agg(F.max("__chars").alias("__chars"))
    return best.join(longest, ["__sha", "__chars"], "left_semi").dropDuplicates(["__sha"]).drop("__sha", "__chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
