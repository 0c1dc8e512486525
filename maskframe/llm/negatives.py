"""Hard negatives by rotated one-bit codes with interval bounds on the inner product.

Coding: a vector is scaled to integers and rotated at random. The signs of its components are a one-bit code, and the mean
absolute component is the code's alignment with the vector: vector = alignment x signs + residual, the residual orthogonal to
the signs. The residual is coded again, LEVELS times; codes, alignments and residual norms are stored beside the integers.

Search: an anchor's rotated components are rounded to PLANES bits. Popcounts of (code and bit plane) give its inner product
with a code, hence an estimate; what is left is bounded by Cauchy-Schwarz: |residual| x the part of the anchor orthogonal to
the signs, plus |vector| x the anchor's rounding error. Only pairs whose interval reaches what still counts are scored, with
integers. Positives count down to the anchor's fifth best so far; negatives count if their interval meets the window below a
positive and reaches its third best so far. The bounds always hold, so results are exact; a fixed seed only decides how many
pairs are scored.

Scale: anchors are a query set that meets all rows in blocks. A task takes one part of at most about PART anchors and one
stripe of the rows, streams the rows, and keeps the best few of each anchor, so it returns a number of rows that does not
depend on its stripe's. Stripes grow with the table and are dealt evenly whatever the ids and labels are. Nothing is
broadcast, and nothing but counts meets the driver.

Edge cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors of different
lengths count as padded with zeros; rows with an anchor's own id are neither its positives nor its negatives, and rows with
one id and one score against an anchor count once; anchors equal in id, label and vector are one; ties go to the smaller id;
a positive with a negative score has no negatives; no anchor or an empty table gives an empty result; further columns are
not read. Integers whose scores might leave 63 bits raise an error before any work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

LEVELS, PLANES, SEED = 4, 6, 12
#: Anchors of a part, anchors and rows that are compared at once, rows of a stripe.
PART, ANCHORS, BLOCK, STRIPE, LEAST_STRIPES = 32_768, 256, 512, 1 << 20, 12
#: Intervals are tested from this level on, as those of one code alone rule out hardly any pair.
FIRST = 2
#: Pairs are scored once so small a share of them is left, or after the last level.
FEW = 0.02
NONE = np.iinfo(np.int64).min
CODED = "id long, label long, stripe int, q binary, codes binary, scales binary"


def rotation(dim: int) -> np.ndarray:
    """A random rotation of dim components into a multiple of 64."""
    wide = -(-max(dim, 1) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:dim]


def coded(q: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, levels, words of 64 bits) and scales (rows, 1 + 2 x levels): norm, alignments, residual norms."""
    rest = q @ turn
    codes, alignments, norms = [], [], [np.linalg.norm(rest, axis=1)]
    for _ in range(LEVELS):
        sign = rest >= 0
        along = np.abs(rest).mean(axis=1)
        rest = rest - np.where(sign, along[:, None], -along[:, None])
        codes.append(np.packbits(sign, axis=1).view(np.uint64))
        alignments.append(along)
        norms.append(np.linalg.norm(rest, axis=1))
    return np.stack(codes, axis=1), np.stack([norms[0], *alignments, *norms[1:]], axis=1)


def integers(vectors: pd.Series, dim: int, scale: float) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out * scale)


@dataclass
class Rows:
    """Unpacked rows."""

    id: np.ndarray
    label: np.ndarray
    q: np.ndarray
    codes: np.ndarray
    scales: np.ndarray

    @staticmethod
    def of(b: pd.DataFrame, dim: int) -> Rows:
        wide = -(-max(dim, 1) // 64)
        read = lambda c, kind: np.frombuffer(b"".join(b[c]), dtype=kind)
        return Rows(b["id"].to_numpy(np.int64), b["label"].to_numpy(np.int64), read("q", "<i8").reshape(len(b), dim), read("codes", "<u8").reshape(len(b), LEVELS, wide), read("scales", "<f8").reshape(len(b), 1 + 2 * LEVELS))

    def at(self, i: np.ndarray) -> Rows:
        return Rows(self.id[i], self.label[i], self.q[i], self.codes[i], self.scales[i])


class Queries:
    """Anchors as bit planes: component = low + step x number, up to an error of known norm."""

    def __init__(self, q: np.ndarray, turn: np.ndarray) -> None:
        self.q, self.peak = q, max(int(np.abs(q).max(initial=0)), 1)
        y = q @ turn
        self.low = y.min(axis=1)
        self.step = np.maximum((y.max(axis=1) - self.low) / (2**PLANES - 1), 1e-9)
        number = np.clip(np.rint((y - self.low[:, None]) / self.step[:, None]), 0, 2**PLANES - 1)
        near = self.low[:, None] + self.step[:, None] * number
        self.error, self.square, self.total = np.linalg.norm(y - near, axis=1), (near**2).sum(axis=1), number.sum(axis=1)
        bits = number.astype(np.uint8)
        self.planes = [np.packbits((bits >> p) & 1, axis=1).view(np.uint64) for p in range(PLANES)]
        self.wide = turn.shape[1]

    def along(self, code: np.ndarray) -> np.ndarray:
        """Inner products of the rounded anchors with signs, by popcounts: (anchors, rows)."""
        shape = (len(self.low), len(code))
        both, count, plane_sum = np.empty(shape, dtype=np.uint64), np.empty(shape, dtype=np.uint8), np.zeros(shape, dtype=np.uint16 if self.wide <= 1024 else np.int32)
        for plane in reversed(self.planes):
            plane_sum <<= 1
            for w in range(code.shape[1]):
                np.bitwise_and(plane[:, None, w], code[None, :, w], out=both)
                plane_sum += np.bitwise_count(both, out=count)
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        found = np.multiply(plane_sum, (2 * self.step)[:, None], dtype=np.float32, casting="same_kind")
        found += self.low[:, None].astype(np.float32) * (2 * ones - self.wide).astype(np.float32)[None, :]
        found -= (self.step * self.total)[:, None].astype(np.float32)
        return found

    def pairs(self, rows: Rows, least: np.ndarray, most: np.ndarray, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of the pairs, among those asked for, whose interval meets least to most of the anchor at every level."""
        scales = rows.scales.astype(np.float32)
        norm = scales[:, 0]
        slack = ((self.error + 1e-5 * np.sqrt(self.square))[:, None].astype(np.float32) * norm[None, :]) + np.float32(1)
        square, least, most = self.square[:, None].astype(np.float32), least[:, None].astype(np.float32), most[:, None].astype(np.float32)
        estimate, left = np.zeros(slack.shape, dtype=np.float32), None
        for level in range(LEVELS):
            t = self.along(rows.codes[:, level])
            estimate += scales[None, :, 1 + level] * t
            if level + 1 < FIRST:
                continue
            t *= t
            t *= np.float32(-1 / self.wide)
            t += square
            np.maximum(t, 0, out=t)
            np.sqrt(t, out=t)
            t *= scales[None, :, 1 + LEVELS + level]
            t += slack
            left = (estimate + t >= least) & (estimate - t <= most)
            if asked is not None:
                left &= asked
            if np.count_nonzero(left) <= FEW * left.size:
                break
        a, r = np.divmod(np.flatnonzero(left), left.shape[1])
        # whole numbers below 2 ** 24 are exact in 32 bits of floating point, too, which are half as much to gather
        exact = np.float32 if self.q.shape[1] * self.peak * max(np.abs(rows.q).max(initial=0), 1) < 1 << 24 else np.int64
        score = np.einsum("ij,ij->i", self.q.astype(exact, copy=False)[a], rows.q.astype(exact, copy=False)[r])
        return a, r, score.astype(np.int64)


class Best:
    """The k best (score, id) of each slot; an equal pair counts once."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.slot, self.score, self.id = (np.empty(0, dtype=np.int64) for _ in range(3))
        self.worst = np.full(slots, NONE)

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        keep = score >= self.worst[slot]
        if not keep.any():
            return
        slot, score, ident = (np.concatenate(x) for x in ((self.slot, slot[keep]), (self.score, score[keep]), (self.id, ident[keep])))
        order = np.lexsort((ident, -score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        new = np.ones(len(slot), dtype=bool)
        new[1:] = (np.diff(slot) != 0) | (np.diff(score) != 0) | (np.diff(ident) != 0)
        slot, score, ident = slot[new], score[new], ident[new]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff([*first, len(slot)]))
        last = rank == self.k - 1
        self.worst[slot[last]] = score[last]
        self.slot, self.score, self.id = (x[rank < self.k] for x in (slot, score, ident))


class Positives:
    """Of each anchor the best rows of its label."""

    schema = "anchor long, key long, id long, score long"

    def __init__(self, anchors: pd.DataFrame, dim: int, turn: np.ndarray, k: int) -> None:
        anchors = anchors.sort_values("label", kind="stable")
        self.key, self.rows = anchors["key"].to_numpy(np.int64), Rows.of(anchors, dim)
        starts = [*np.flatnonzero(np.diff(self.rows.label, prepend=self.rows.label[0] - 1)), len(anchors)]
        tiles = [(lo, min(lo + ANCHORS, b)) for a, b in zip(starts, starts[1:]) for lo in range(a, b, ANCHORS)]
        self.tiles: dict[int, list] = {}
        for lo, hi in tiles:
            self.tiles.setdefault(int(self.rows.label[lo]), []).append((lo, Queries(self.rows.q[lo:hi], turn), Best(hi - lo, k)))

    def add(self, block: Rows) -> None:
        for label in np.unique(block.label):
            tiles = self.tiles.get(int(label), [])
            own = block.at(np.flatnonzero(block.label == label)) if tiles else None
            for lo, queries, best in tiles:
                a, r, score = queries.pairs(own, best.worst, np.full(len(best.worst), np.inf))
                other = own.id[r] != self.rows.id[a + lo]
                best.add(a[other], score[other], own.id[r[other]])

    def found(self) -> pd.DataFrame:
        parts = [(lo + best.slot, best) for tiles in self.tiles.values() for lo, _, best in tiles]
        at = np.concatenate([x for x, _ in parts])
        return pd.DataFrame({"anchor": self.rows.id[at], "key": self.key[at], "id": np.concatenate([b.id for _, b in parts]), "score": np.concatenate([b.score for _, b in parts])})


class Negatives:
    """Of each anchor and positive score the best rows of other labels inside the window below that score."""

    schema = "key long, positive_score long, id long, score long"

    def __init__(self, anchors: pd.DataFrame, dim: int, turn: np.ndarray, k: int, low: int, high: int) -> None:
        self.key, self.rows = anchors["key"].to_numpy(np.int64), Rows.of(anchors, dim)
        positives = [np.sort(np.asarray(p, dtype=np.int64)) for p in anchors["positives"]]
        self.width = max(len(p) for p in positives)
        self.positive = np.full((len(anchors), self.width), -1)  # a negative score has no window
        for i, p in enumerate(positives):
            self.positive[i, : len(p)] = p
        none = self.positive < 0
        self.floor = np.where(none, np.iinfo(np.int64).max, -(-low * self.positive // 100))
        self.ceiling = np.where(none, NONE, high * self.positive // 100)
        self.tiles = []
        for lo in range(0, len(anchors), ANCHORS):
            q = self.rows.q[lo : lo + ANCHORS]
            self.tiles.append((lo, Queries(q, turn), Best(len(q) * self.width, k)))

    def add(self, block: Rows) -> None:
        for lo, queries, best in self.tiles:
            part = slice(lo, lo + len(queries.q))
            most, least = self.ceiling[part], np.maximum(self.floor[part], best.worst.reshape(-1, self.width))
            other = (self.rows.label[part, None] != block.label[None, :]) & (self.rows.id[part, None] != block.id[None, :])
            a, r, score = queries.pairs(block, least.min(axis=1), most.max(axis=1), other)
            at, j = np.nonzero((score[:, None] >= least[a]) & (score[:, None] <= most[a]))
            best.add(a[at] * self.width + j, score[at], block.id[r[at]])

    def found(self) -> pd.DataFrame:
        parts = [(lo * self.width + best.slot, best) for lo, _, best in self.tiles]
        at = np.concatenate([x for x, _ in parts])
        return pd.DataFrame({"key": self.key[at // self.width], "positive_score": self.positive.ravel()[at], "id": np.concatenate([b.id for _, b in parts]), "score": np.concatenate([b.score for _, b in parts])})


def swept(anchors: DataFrame, rows: DataFrame, stripes: int, dim: int, kind: type, **options) -> DataFrame:
    """What kind finds for each part of the anchors in each stripe of the rows."""
    parts = max(1, -(-anchors.count() // PART))
    fields = [f for f in anchors.columns if f not in rows.columns]
    asked = anchors.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    read = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # a key on every row: pandas turns whole numbers beside nulls into floating ones
    both = asked.withColumn("row", F.lit(0)).unionByName(read.withColumns({"row": F.lit(1), "key": F.lit(0).cast("long")}), allowMissingColumns=True)
    both = both.select("part", "stripe", "row", "id", "label", "q", "codes", "scales", *fields)
    dealt = both.repartitionById(parts * stripes, (F.col("part") * stripes + F.col("stripe")).cast("int")).sortWithinPartitions("part", "stripe", "row")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = rotation(dim)
        group, state, waiting, held, size = None, None, [], [], 64

        def flush() -> None:
            nonlocal held, size, state, waiting
            if waiting:
                state = kind(pd.concat(waiting, ignore_index=True), dim, turn, **options)
                waiting = []
            if held and state:
                block = Rows.of(pd.concat(held, ignore_index=True), dim)
                for lo in range(0, len(block.id), size):
                    state.add(block.at(np.arange(lo, min(lo + size, len(block.id)))))
                    size = min(2 * size, BLOCK)
            held = []

        for b in batches:
            place = b["part"].to_numpy(np.int64) * stripes + b["stripe"].to_numpy(np.int64)
            for own in np.split(np.arange(len(b)), np.flatnonzero(np.diff(place)) + 1) if len(b) else []:
                if place[own[0]] != group:
                    flush()
                    if state:
                        yield state.found()
                    group, state, size = place[own[0]], None, 64
                piece = b.iloc[own]
                ahead = piece["row"] == 0
                if ahead.any():
                    waiting.append(piece[ahead])
                if not ahead.all():
                    held.append(piece[~ahead])
                    if sum(map(len, held)) >= BLOCK:
                        flush()
        flush()
        if state:
            yield state.found()

    return dealt.mapInPandas(run, kind.schema)


def encoded(df: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> tuple[DataFrame, int, int]:
    """The rows that take part with their codes, stored; the number of components and of stripes."""
    own = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias("v")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    own = own.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    peak = F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    seen = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim"), F.coalesce(F.max(peak), F.lit(0.0)).alias("peak")).first()
    dim, most = max(1, seen["dim"]), seen["peak"] * scale + 1
    if most * most * dim >= 2.0**62:
        raise ValueError("components are too large for scores of 63 bits")
    stripes = max(LEAST_STRIPES, -(-seen["n"] // STRIPE))
    dealt = own.withColumn("stripe", F.pmod(F.monotonically_increasing_id(), F.lit(stripes)).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = rotation(dim)
        for b in batches:
            for lo in range(0, len(b), 4096):
                part = b.iloc[lo : lo + 4096]
                q = integers(part["v"], dim, scale)
                codes, scales = coded(q, turn)
                packed = lambda x: [r.tobytes() for r in x]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "label": part["label"].to_numpy(), "stripe": part["stripe"].to_numpy(), "q": packed(q.astype("<i8")), "codes": packed(codes), "scales": packed(scales.astype("<f8"))})

    return stored(dealt.mapInPandas(run, CODED), "codes"), dim, stripes


def mine(df: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). anchor: a condition on the column id.
    Negatives have low to high hundredths of the positive's score; components count as floor(scale x component)."""
    rows, dim, stripes = encoded(df, id_col, vec_col, F.col("label") if label is None else label, scale)
    key = F.xxhash64("id", "label", "q").alias("key")
    anchors = stored(rows.filter(anchor).select("id", "label", "q", "codes", "scales", key).dropDuplicates(["id", "key"]), "anchors")
    found = swept(anchors, rows, stripes, dim, Positives, k=positives)
    best = Window.partitionBy("key", "anchor").orderBy(F.col("score").desc(), "id")
    pairs = found.dropDuplicates(["key", "anchor", "id", "score"]).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= positives).drop("r")
    pairs = stored(pairs.select(F.col("anchor").alias("anchor_id"), "key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = pairs.groupBy("key").agg(F.collect_set("positive_score").alias("positives"))
    below = swept(stored(anchors.join(scores, "key"), "windows"), rows, stripes, dim, Negatives, k=negatives, low=low, high=high)
    best = Window.partitionBy("key", "positive_score").orderBy(F.col("score").desc(), "id")
    ranked = below.dropDuplicates(["key", "positive_score", "id", "score"]).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return pairs.join(ranked, ["key", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), F.col("id") % 50 == 0, label=noisy)


ORACLE = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS other, a.label = o.label AS same, CAST(list_dot_product(a.q, o.q) AS BIGINT) AS score
  FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 3
"""
