"""Packing by concatenate and cut.

Pass 1 tokenizes every document once and writes its ids to the shared folder with the task's number and the tokens
before it in that task. The tasks' totals, one row for each task, are summed up to offsets. Pass 2 rereads the ids,
adds the offset of their task and cuts the endless stream every `length` tokens: a document that crosses a cut leaves
several boundary records. Only the last sequence has padding. No text or id is shuffled.

White space is always a boundary for the tokenizer, and so are the bounds between letters, digits and marks; pieces.py
cuts texts there in numpy and keeps ids of pieces in a table of fixed size (about 22 MB a worker).

Edge cases: a null or empty text is the end-of-document id alone; a text longer than a sequence spans several; equal
rows are packed each on their own; an empty table gives no pieces; further columns are ignored,
whatever their names; very long texts are taken in stretches that end at a blank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .pieces import PAD, IdTable, Pieces

LENGTH, END_ID = 2048, 1
#: Bytes of text that are cut and looked up together.
STRETCH = 1 << 20
#: A table of task totals of at most so many rows (16 bytes each) is broadcast.
BROADCAST_TASKS = 2_000_000

_CODERS: dict[tuple[str, str], "Coder"] = {}


class Coder:
    """Texts to ids. One for each Python worker; its memory is that of the tokenizer and of one table of fixed size."""

    def __init__(self, path: str, dtype: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        self.final = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.final[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.table = IdTable(self.encode, dtype)

    def encode(self, simple: list[str], whole: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """simple pieces are encoded in a row: each is one piece for the tokenizer, too, whose last id ends a word."""
        out: list[list[int]] = []
        for lo in range(0, len(simple), 1000):
            group = simple[lo : lo + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self.final[ids]) + 1 if len(ids) else np.empty(0, dtype=int)
            if len(ends) == len(group) and (not len(ends) or ends[-1] == len(ids)):
                flat, at = ids.tolist(), [0, *ends.tolist()]
                out += [flat[i:j] for i, j in zip(at, at[1:], strict=False)]
            else:
                out += self.each(group)
        return out, self.each(whole)

    def each(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)] if words else []

    def stretch(self, data: memoryview, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a stretch of bytes, and how many there are before each bound."""
        padded = np.zeros(len(data) + PAD, dtype=np.uint8)
        padded[: len(data)] = np.frombuffer(data, dtype=np.uint8)
        p = Pieces(padded, bounds)
        ids, count = self.table.flat(p)
        total = np.append(0, np.cumsum(count))
        return ids, total[np.searchsorted(p.starts, bounds)]

    def column(self, texts: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
        """(first row, end, ids of each row as bytes), some rows at a time."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = memoryview(data) if data is not None else memoryview(b"")
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + STRETCH, side="right")) - 1)
            if at[hi] - at[lo] <= STRETCH:
                ids, cuts = self.stretch(raw[at[lo] : at[hi]], at[lo:hi] - at[lo])
                cuts = np.append(cuts, len(ids)).tolist()
                yield lo, hi, [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            else:
                yield lo, hi, [b"".join(self.stretch(part, np.zeros(1, dtype=np.int64))[0].tobytes() for part in parts(raw[at[lo] : at[hi]]))]
            lo = hi

    def texts(self, texts: list[str | None]) -> list[bytes]:
        return [x for _, _, ids in self.column(pa.array(texts, type=pa.large_string())) for x in ids]


def parts(text: memoryview) -> Iterator[memoryview]:
    """A long text in stretches of about STRETCH bytes that end at a blank."""
    blank, at = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint8), 0
    while at < len(text):
        end = at + STRETCH
        while end < len(text):
            found = np.flatnonzero(np.isin(np.frombuffer(text[end : end + STRETCH], dtype=np.uint8), blank))
            if len(found):
                end += int(found[0])
                break
            end += STRETCH
        yield text[at:end]
        at = end


def coder(path: str, dtype: str) -> Coder:
    return _CODERS.get((path, dtype)) or _CODERS.setdefault((path, dtype), Coder(path, dtype))


def tokenized(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """(part, before, doc_id, n, ids): ids as little-endian integers of dtype with end_id behind them."""
    kind = df.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, before = coder(tokenizer_path, dtype), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], dtype=dtype).tobytes(), np.dtype(dtype).itemsize
        for b in batches:
            for lo, hi, ids in code.column(b.column("text")):
                n = np.array([len(x) // width + 1 for x in ids], dtype=np.int64)
                rows = {"part": pa.array(np.full(len(n), part, dtype=np.int32)), "before": pa.array(before + np.cumsum(n) - n), "doc_id": b.column("doc_id").slice(lo, hi - lo), "n": pa.array(n), "ids": pa.array([x + end for x in ids], type=pa.binary())}
                before += int(n.sum())
                yield pa.RecordBatch.from_pydict(rows)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, f"part int, before long, doc_id {kind}, n long, ids binary")


def cut(table_: DataFrame, length: int = LENGTH, dtype: str = "<u2", digest: bool = False) -> DataFrame:
    """Pieces of a stored tokenized() table: (doc_id, start, length, ids, doc_tokens, sequence_id, offset). digest gives
    ids_crc32, over the ids as little-endian 32-bit integers, instead of ids."""
    totals = table_.groupBy("part").agg(F.sum("n").alias("total"))
    starts = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("origin"))
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_TASKS else starts
    kind = table_.schema["doc_id"].dataType.simpleString()
    width = np.dtype(dtype).itemsize
    names = ["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"]

    def kept(ids: bytes) -> bytes | int:
        return zlib.crc32(np.frombuffer(ids, dtype=dtype).astype("<u4").tobytes()) if digest else ids

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for doc, n, at, ids in zip(b["doc_id"].array, b["n"], b["at"], b["ids"], strict=True):
                start = 0
                while start < n:
                    seq, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    out.append((doc, start, size, kept(ids[start * width : (start + size) * width]), n, seq, offset))
                    start += size
                    if len(out) >= 5000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            yield pd.DataFrame(out, columns=names)

    placed = table_.join(starts, "part").select("doc_id", "n", (F.col("origin") + F.col("before")).alias("at"), "ids")
    return placed.mapInPandas(pieces, f"doc_id {kind}, start long, length long, {'ids_crc32 long' if digest else 'ids binary'}, doc_tokens long, sequence_id long, offset long")


def pack(df: DataFrame, tokenizer_path: str, length: int = LENGTH, digest: bool = False, **options) -> DataFrame:
    """Pieces of all rows of df with their ids, or the ids' digest."""
    return cut(stored(tokenized(df, tokenizer_path, **options), "ids"), length, options.get("dtype", "<u2"), digest)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids array): pieces put together, the last sequence padded unless its end is a power of two."""
    joined = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))

    @F.pandas_udf("array<int>")
    def whole(p: pd.Series) -> pd.Series:
        out = []
        for parts in p:
            ids = np.frombuffer(b"".join(x["ids"] for x in parts), dtype="<u2").astype("int32")
            exact = len(ids) & (len(ids) - 1) == 0
            out.append(ids if exact else np.pad(ids, (0, length - len(ids)), constant_values=pad_id))
        return pd.Series(out)

    return joined.select("sequence_id", whole("p").alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, str(default_tokenizer()), digest=True)
