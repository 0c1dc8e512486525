"""Substring dedup by compaction of a de Bruijn graph over words.

Nodes are runs of 49 words, and each window of 50 words is an edge from its first 49 words to its last 49. An edge that
documents share is repeated; its source is the first place (document, position) that has it. A node at which repeated edges
branch (more than one in or out) ends a path; nonbranching runs of edges that follow each other at their source compact to
one path, named by its source document and first position. Degrees meet the edges by a join, and positions meet the paths by
another one; a document's edges that run along one path become one span with source coordinates. Words at those coordinates
are compared with the span's own words by a digest of 128 bits, and only spans that agree are removed. A document loses the
words of its edges that a smaller document has.

Only edges that can be repeated are ever shuffled. Each window of 50 words has an anchor, the smallest hash of its 12-word
k-mers; equal windows have equal anchors, so an anchor (one for about 20 words) that occurs in one text only rules out all
its windows. That filter is exact. Equal texts are collapsed before: a later copy of a text has all its windows in the
first one. Edges are compared by their two nodes and 31 bits of another hash.

Edge cases: null and empty texts have no words; texts of fewer than 50 words lose nothing; a window that repeats only
inside its own document stays; rows with equal id and text are one document and get equal results; of different texts with
one id none is smaller; a null id counts as larger than all others; very long texts are ordinary, as positions are rows;
further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, stored, table, text_of
from .hashing import RUN2, sliding_min, windows, word_hashes

WINDOW, ANCHOR = 50, 12
#: A table of at most so many anchors (8 bytes each) is broadcast; a larger one meets the texts by a shuffle.
BROADCAST_ANCHORS, SALTS = 2_000_000, 16
#: Ranges of one text that are digested together; tables of spans of at most so many bytes are broadcast to the texts.
RANGES, BROADCAST_BYTES = 1000, 32 << 20
EDGE = ["left", "right", "h2"]
LAST = 2**63 - 1


def anchors_of(words: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window."""
    k = min(ANCHOR, window)
    return sliding_min(windows(words, k), window - k + 1) if len(words) >= window else np.empty(0, dtype=np.uint64)


def with_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text_of(text_col)).alias("cls"), F.col(text_col).alias("text"))


def repeated_anchors(keyed: DataFrame, window: int) -> DataFrame:
    """(doc, cls, anchors): for each document those of its anchors that another text has, too."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            doc, cls, out = b["doc"].to_numpy(), b["cls"].to_numpy(), []
            for i, words in enumerate(word_hashes(b["text"].tolist())):
                a = np.unique(anchors_of(words, window))
                if len(a):
                    out.append((i, a))
            at = np.repeat([i for i, _ in out], [len(a) for _, a in out]).astype(int)
            yield pd.DataFrame({"doc": doc[at], "cls": cls[at], "anchor": np.concatenate([a for _, a in out] or [np.empty(0, dtype=np.uint64)]).view(np.int64)})

    found = stored(keyed.mapInPandas(emit, "doc long, cls long, anchor long"), "anchors")
    shared = found.groupBy("anchor").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a <> b").select("anchor")
    return found.join(shared, "anchor").groupBy("doc", "cls").agg(F.collect_set("anchor").alias("anchors"))


def later_copies(keyed: DataFrame) -> DataFrame:
    """(doc, cls) of documents whose text a smaller document has. Groups are met in SALTS parts."""
    ids = keyed.select("doc", "cls", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).alias("salt")).distinct()
    first = ids.groupBy("cls").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("cls", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return ids.join(first, ["cls", "salt"]).filter("doc > first").select("doc", "cls", F.lit(True).alias("copy"))


def edges_of(keyed: DataFrame, window: int) -> DataFrame:
    """One row for each document: finished ones have kept_sha256, the others their text and possibly repeated edges."""
    flagged = stored(repeated_anchors(keyed, window).join(later_copies(keyed), ["doc", "cls"], "full"), "flagged")
    n = flagged.agg(F.coalesce(F.sum(F.greatest(F.size("anchors"), F.lit(0)) + 2), F.lit(0)).alias("n")).first()["n"]
    flagged = F.broadcast(flagged) if n <= BROADCAST_ANCHORS else flagged

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 1000):
                yield part(b.iloc[lo : lo + 1000])

    def part(b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        due = [i for i, (a, c) in enumerate(zip(b["anchors"], b["copy"], strict=True)) if a is not None and not (c is True or c == 1)]
        texts = b["text"].tolist()
        hashed = dict(zip(due, word_hashes([texts[i] for i in due]), strict=True))
        for i, (doc, cls, text, anchors, copy) in enumerate(b[["doc", "cls", "text", "anchors", "copy"]].itertuples(index=False)):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            n = len(words)
            pos = np.empty(0, dtype=np.int64)
            if i in hashed:
                pos = np.flatnonzero(np.isin(anchors_of(hashed[i], window), np.asarray(anchors, dtype=np.int64).view(np.uint64)))
            if len(pos):
                node, h2 = windows(hashed[i], window - 1).view(np.int64), windows(hashed[i], window, RUN2)
                rows.append((doc, cls, n, None, None, text, pos.astype(np.int32), node[pos], node[pos + 1], (h2[pos] >> np.uint64(33)).astype(np.int32)))
            else:
                gone = n if n >= window and (copy is True or copy == 1) else 0
                rows.append((doc, cls, n, gone, hashlib.sha256(b"" if gone else b" ".join(words)).hexdigest(), None, None, None, None, None))
        return pd.DataFrame(rows, columns=["doc", "cls", "n_words", "n_removed", "kept_sha256", "text", "pos", "left", "right", "h2"]).astype({"n_removed": "Int64"})

    schema = "doc long, cls long, n_words long, n_removed long, kept_sha256 string, text string, pos array<int>, left array<long>, right array<long>, h2 array<int>"
    return stored(keyed.join(flagged, ["doc", "cls"], "left").mapInPandas(run, schema), "edges")


def paths(rows: DataFrame) -> DataFrame:
    """(left, right, h2, s_doc, s_cls, s_pos, path): repeated edges at their sources, and where their compacted path starts."""
    first = F.min(F.struct("doc", "cls", "pos")).alias("s")
    found = rows.groupBy(*EDGE).agg(first, F.max("doc").alias("last")).filter("s.doc < last")
    graph = stored(found.select(*EDGE, F.col("s.doc").alias("s_doc"), F.col("s.cls").alias("s_cls"), F.col("s.pos").alias("s_pos")), "graph")
    ends = graph.select(F.inline(F.array(F.struct(F.col("left").alias("node"), F.lit(1).alias("out")), F.struct(F.col("right").alias("node"), F.lit(0).alias("out")))))
    degrees = ends.groupBy("node").agg(F.sum("out").alias("outgoing"), F.sum(1 - F.col("out")).alias("incoming"))
    branching = stored(degrees.filter("outgoing > 1 or incoming > 1").select(F.col("node").alias("left"), F.lit(True).alias("branch")), "branching")
    along = Window.partitionBy("s_doc", "s_cls").orderBy("s_pos")
    follows = F.col("branch").isNull() & (F.lag("s_pos").over(along) == F.col("s_pos") - 1)
    headed = graph.join(small(branching), "left", "left").withColumn("head", F.when(F.coalesce(follows, F.lit(False)), None).otherwise(F.col("s_pos")))
    return headed.withColumn("path", F.last("head", ignorenulls=True).over(along)).select(*EDGE, "s_doc", "s_cls", "s_pos", "path")


def spans_of(edges: DataFrame) -> DataFrame:
    """(doc, cls, start, n, s_doc, s_cls, s_start): where documents run along paths of smaller ones, n edges long."""
    rows = edges.filter("pos is not null").select("doc", "cls", F.inline(F.arrays_zip("pos", *EDGE)))
    own = rows.join(stored(paths(rows), "paths"), EDGE).filter("s_doc < doc")
    along = Window.partitionBy("doc", "cls").orderBy("pos")
    place = F.struct("s_doc", "s_cls", "path", F.col("s_pos") - F.col("pos"))
    follows = (F.lag("pos").over(along) == F.col("pos") - 1) & (F.lag(place).over(along) == place)
    own = own.repartition("doc", "cls").dropDuplicates(["doc", "cls", "pos"])
    runs = own.withColumn("run", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(along))
    first = F.min(F.struct("pos", "s_doc", "s_cls", "s_pos")).alias("f")
    ranged = runs.groupBy("doc", "cls", "run").agg(first, F.count(F.lit(1)).cast("int").alias("n"))
    return ranged.select("doc", "cls", F.col("f.pos").alias("start"), "n", F.col("f.s_doc").alias("s_doc"), F.col("f.s_cls").alias("s_cls"), F.col("f.s_pos").alias("s_start"))


def words_in(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def digest(words: list[bytes], start: int, n: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start : start + n]), digest_size=16).digest()


def light(df: DataFrame, size: Column) -> DataFrame:
    """df with a broadcast hint if its rows, each of so many bytes, are few."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def with_spans(edges: DataFrame, window: int) -> DataFrame:
    """(doc, cls, text, spans) of the unfinished documents. Each span has start, end, source, source_start and the digest of
    the source's words there."""
    texts = edges.filter("pos is not null").select("doc", "cls", "text")
    spans = stored(spans_of(edges), "spans")
    keys = ["s_doc", "s_cls", "s_start", "n"]
    asked = stored(spans.select(*keys).distinct(), "asked")
    parts = asked.groupBy("s_doc", "s_cls").agg(F.ceil(F.count(F.lit(1)) / RANGES).alias("parts"))
    part = F.pmod(F.xxhash64("s_start", "n"), F.col("parts"))
    lists = stored(asked.join(parts, ["s_doc", "s_cls"]).groupBy("s_doc", "s_cls", part.alias("part")).agg(F.collect_list(F.struct("s_start", "n")).alias("at")), "lists")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, cls, text, at in zip(b["doc"], b["cls"], b["text"], b["at"], strict=True):
                words = words_in(text)
                found = [(doc, cls, r["s_start"], r["n"], digest(words, r["s_start"], r["n"] + window - 1)) for r in at]
                yield pd.DataFrame(found, columns=[*keys, "digest"])

    named = lists.select(F.col("s_doc").alias("doc"), F.col("s_cls").alias("cls"), "at")
    read_at = texts.join(light(named, F.size("at") * 8 + 24), ["doc", "cls"]).mapInPandas(read, "s_doc long, s_cls long, s_start int, n int, digest binary")
    span = F.struct("start", (F.col("start") + F.col("n") + (window - 1)).alias("end"), F.col("s_doc").alias("source"), F.col("s_start").alias("source_start"), "digest")
    marks = spans.join(stored(read_at, "digests"), keys).groupBy("doc", "cls").agg(F.collect_set(span).alias("spans"))
    return texts.join(light(stored(marks, "marks"), F.size("spans") * 48 + 24), ["doc", "cls"], "left")


def agreeing(words: list[bytes], spans: list | None) -> list:
    """The spans whose words are those at the source, in order."""
    return sorted((x for x in (spans if spans is not None else []) if digest(words, x["start"], x["end"] - x["start"]) == x["digest"]), key=lambda x: x["start"])


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, source, start, end, source_start): spans along compacted paths in words, end exclusive, with equal words at the
    source; exact later copies are not listed."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(doc, x["source"], x["start"], x["end"], x["source_start"]) for doc, text, spans in zip(b["doc"], b["text"], b["spans"], strict=True) for x in agreeing(words_in(text), spans)]
            yield pd.DataFrame(out, columns=["doc", "source", "start", "end", "source_start"])

    return with_spans(edges_of(with_keys(df, id_col, text_col), window), window).mapInPandas(listed, "doc long, source long, start long, end long, source_start long").distinct()


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for each row of df; keep_text adds kept_text (words joined by blanks) of
    documents that lost a part but not all (others: null)."""
    edges = edges_of(with_keys(df, id_col, text_col), window)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, spans in zip(b["doc"], b["text"], b["spans"], strict=True):
                words = words_in(text)
                keep = np.ones(len(words), dtype=bool)
                for x in agreeing(words, spans):
                    keep[x["start"] : x["end"]] = False
                kept = b" ".join([words[i] for i in np.flatnonzero(keep)])
                rows.append((doc, len(words), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if keep_text else None))
            yield pd.DataFrame(rows, columns=["doc", "n_words", "n_removed", "kept_sha256", "kept_text"])

    done = edges.filter("pos is null").select("doc", "n_words", "n_removed", "kept_sha256", F.lit(None).cast("string").alias("kept_text"))
    both = done.unionByName(with_spans(edges, window).mapInPandas(cut, "doc long, n_words long, n_removed long, kept_sha256 string, kept_text string"))
    named = both.withColumn("doc", F.when(F.col("doc") != LAST, F.col("doc")).cast(df.schema[id_col].dataType)).withColumnRenamed("doc", id_col)
    return named if keep_text else named.drop("kept_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, p, md5(array_to_string(w[p:p+49], ' ')) AS h FROM s),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS first FROM k) WHERE first < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM f),
gone AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
"""
