"""N-gram Jaccard join with PartEnum signatures.

A document's set holds the hashes of its distinct 5-word shingles. Two sets link when their Jaccard similarity is at
least `percent` / 100, which bounds their Hamming distance by k for sets of one size band.

Signatures: the shingle domain (hash values) is cut into n1 = k // 2 + 1 + k // 12 first-level parts of three second-level
parts each. Of the three, each subset of two makes a signature, the digest of the shingles in them. Sets that differ in
at most k shingles differ in two or more second-level parts of at most k // 2 first-level parts; in any other
first-level part they agree on a subset. A set makes signatures for its own size band and for those of smaller partners.
A first-level part counts for a set if two of its three parts have shingles, as then no subset is empty; a set with at
most k // 2 such parts ("sparse") also makes a signature of every shingle, and two sparse partners meet there.

Equal sets are one class, named by a 128-bit digest, and only classes are joined. Groups of up to GROUP classes with one
signature give all their pairs. A set all of whose parts count, none of them in a large group, shares 1 + k // 12 parts with
each partner, so pairs seen in fewer parts go. Of a larger group only its members are noted. A class is settled if so few of its parts
are in large groups that each of its partners must share a small one; pairs that can be missing have both sides open.
Open classes are those made up of shingles that many classes share: families of near copies, long common passages.

Families: the open classes of large groups with the same first member form a family (later: of groups with the same first
members). Each set S is seen by its difference D from the family's pivot, the set of shingles that most of a bounded
sample of members have. Any pivot keeps all distances, so this one loses no link, but common shingles cancel out. With
excess(A) = |D(A)| - |A| (100 - percent) / (100 + percent), two members with excess(A) + excess(B) <= 0 are similar for
certain, and if any such pair exists, both are similar to the member of least excess: a star links them all without a
comparison. Every other similar pair shares an element of D. Families of up to FAMILY members are compared at once on their
small sets D. In larger ones members outside the star meet the rest by the elements of D, in groups like those above; what
is open then forms smaller families, until nothing is left. A pair still missing shares only elements of large groups, and no fewer
than either side needs. So a member with h of them that needs m goes by its first h - m + 1, those of the smallest groups (the order is
the same for all): the first that the pair shares is among these on both sides. With fewer than m it is settled. A group of the
next round shares an element that its family's pivot lacks, so families shrink from round to round. Shingles that only one
open class has are counted, but neither kept nor shuffled, as no two sets D share them.

Every candidate is checked exactly on the sets, and links become components by star contraction.

Edge cases: null texts and texts without words have empty sets and link with nothing; fewer than 5 words are one shingle;
rows with equal ids are one node; rows without id take the component of their equal texts, null if these have no id
either; very long texts are ordinary sets; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, stored, table
from .components import components
from .hashing import RUN, mix, ranges, windows, word_chunks

SHINGLE, PERCENT = 5, 80
#: Groups of more classes are large.
GROUP = 8
#: Members of a family that make its pivot; a family of at most so many members is compared in full in one place.
SAMPLE, FAMILY = 32, 1024
#: Classes that a task remembers to make their signatures once.
SEEN = 200_000
#: Shingles of sets whose signatures are made at once.
BLOCK = 1 << 18
#: Cells of a sketch; at most so many sketches are broadcast; pivots of a family are broadcast up to so many bytes.
SKETCH, BROADCAST_SKETCHES, BROADCAST_PIVOTS = 128, 100_000, 32 << 20
#: A signature: 37 bits of a digest, 7 of the band, 20 of the first-level part (or ELEMENT for a single shingle). A row with
#: NEED tells what leaves its class open in that band, in 16 bits.
BAND_AT, BAND_BITS, ELEMENT, NEED = 20, 7, (1 << 20) - 1, (1 << 20) - 2
MOST_ROUNDS = 60

U64 = np.uint64
LEFT, RIGHT, PLACE = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


def shingle_set(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    if len(words) < n:
        return ranges(words, np.array([0]), np.array([len(words)]), RUN)
    return distinct(windows(words, n))


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The values in order, each once."""
    s = np.sort(hashes)
    first = np.ones(len(s), dtype=bool)
    np.not_equal(s[1:], s[:-1], out=first[1:])
    return s[first]


def digest(s: np.ndarray) -> tuple[int, int]:
    """127 bits that name a set; the lowest of the first 64 is 0."""
    return digests([s])[0] if len(s) else (0, 0)


def digests(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """The digest of each of several sets, none of them empty."""
    if not sets:
        return []
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    a = np.add.reduceat(mix(flat + U64(1)), starts)
    b = np.add.reduceat(mix(flat ^ U64(0x5851F42D4C957F2D)), starts) ^ sizes.astype(np.uint64)
    return list(zip((a.view(np.int64) & ~1).tolist(), b.view(np.int64).tolist(), strict=True))


def most_distance(size: int, percent: int = PERCENT) -> int:
    """The largest distance of a set of this size from a partner that is no smaller."""
    return (size + size * 100 // percent) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=None)
def bands(upto: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Smallest size of each band, and k of each band: the largest distance of a pair whose smaller set is in it."""
    low, k, at = [], [], 1
    while at <= upto:
        top = at * 100 // percent
        low.append(at)
        k.append(most_distance(top, percent))
        at = top + 1
    return np.array(low), np.array(k)


def signatures(s: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int, list[int]]:
    """Signatures of a sorted set; its first band; and for each band how many of its parts must be in large groups to leave
    it open."""
    found = list(by_band([s], percent))
    return np.concatenate([f[4] for f in found]), int(found[0][1][0]), np.concatenate([f[2] for f in found]).tolist()


Bands = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def by_band(sets: list[np.ndarray], percent: int = PERCENT) -> Iterator[Bands]:
    """For sorted sets, none of them empty, and each of their bands: the set's place, the band, how many parts leave the set
    open, and if a part does not count; then signatures, and the place of the band that each is of. Bands come in blocks of
    about BLOCK shingles, a set's one after another."""
    sizes = np.array([len(s) for s in sets])
    low, ks = bands(1 << max(1, int(sizes.max()).bit_length()), percent)
    first = np.searchsorted(low, -(-sizes * percent // 100), side="right") - 1
    many = np.searchsorted(low, sizes, side="right") - first
    doc = np.repeat(np.arange(len(sets)), many)
    band = first[doc] + places(many)
    block = np.cumsum(sizes[doc]) // BLOCK
    cuts = np.flatnonzero(np.diff(block)) + 1
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    for d, b in zip(np.split(doc, cuts), np.split(band, cuts), strict=True):
        yield d, b, *parts_of(flat, starts[d], sizes[d], b, ks[b])


def places(counts: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n of counts, in a row."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def parts_of(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, band: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The last four of by_band, for bands of the sets flat[start:start + size]."""
    n1 = np.where(k > 0, k // 2 + least_parts(k), 0)  # with k = 0 only equal sets are so close, and they are one class
    sizes = np.where(k > 0, sizes, 0)
    of, high_band = np.repeat(np.arange(len(band)), sizes), band.astype(np.uint64)
    s = flat[starts[of] + places(sizes)]
    mixed = mix(s ^ LEFT)
    cell = 3 * (np.cumsum(n1) - n1)[of] + ((s >> U64(32)) * (3 * n1).astype(np.uint64)[of] >> U64(32)).astype(np.int64)
    new = np.flatnonzero(np.diff(cell, prepend=-1))  # cells ascend, as sets are sorted
    sums = np.zeros(3 * n1.sum(), dtype=np.uint64)
    if len(new):
        sums[cell[new]] = mix(np.add.reduceat(mixed, new) + high_band[of[new]]) | U64(1)
    three = sums.reshape(-1, 3)
    live, row, part = three != 0, np.repeat(np.arange(len(band)), n1), places(n1).astype(np.uint64)
    counted = np.bincount(row[np.count_nonzero(live, axis=1) >= 2], minlength=len(band))
    sparse, whole = (counted <= k // 2) & (k > 0), (k > 0) & (n1 < NEED)
    place = (part[:, None] * U64(3) + np.arange(3, dtype=np.uint64)) * PLACE
    tail = high_band[row] << U64(BAND_AT) | np.minimum(part, U64(NEED - 1))
    made = sealed(mix((three * LEFT)[:, SUBSETS[0]] + (three * RIGHT)[:, SUBSETS[1]] + place), tail[:, None])
    some = live[:, SUBSETS[0]] | live[:, SUBSETS[1]]
    one = sparse[of]
    single = sealed(mix(mixed[one] + high_band[of[one]]), high_band[of[one]] << U64(BAND_AT) | U64(ELEMENT))
    owner = np.concatenate([np.broadcast_to(row[:, None], some.shape)[some], of[one]])
    return np.where(whole & ~sparse, counted - k // 2, 1), (counted < n1) | ~whole, np.concatenate([made[some], single]), owner


#: The subsets of two of three parts: their first and their second parts.
SUBSETS = np.array([1, 0, 0]), np.array([2, 2, 1])


def least_parts(k: int | np.ndarray) -> int | np.ndarray:
    """Of n1 parts that all count, so many are shared with each partner."""
    return 1 + k // 12


def sealed(h: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """A digest with band and part in its lowest bits."""
    return (h & ~U64((1 << BAND_AT + BAND_BITS) - 1)) | tail


def need_rows(cls: np.ndarray, band: np.ndarray, need: np.ndarray) -> np.ndarray:
    """One row for each band, in the form of a signature that no other class has."""
    return ((cls & 0x1FFFFF) << 43 | np.minimum(need, 0xFFFF) << BAND_AT + BAND_BITS | band << BAND_AT | NEED).astype(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sets_of(batch: pd.Series, n: int = SHINGLE) -> Iterator[np.ndarray]:
    for words, ends in word_chunks(batch.tolist(), lower=True):
        runs, lo = windows(words, n), 0  # a run's hash does not depend on what stands before it
        for hi in ends.tolist():
            yield distinct(runs[lo : hi - n + 1]) if hi - lo >= n else shingle_set(words[lo:hi], n)
            lo = hi


def membership(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, c1, c2, n, sketch): each document's class, set size and sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sets in gathered(sets_of(b["text"])):
                names = iter(digests([s for s in sets if len(s)]))
                rows += [(*next(names), len(s), sketch(s).tobytes()) if len(s) else (0, 0, 0, b"") for s in sets]
            out = pd.DataFrame(rows, columns=["c1", "c2", "n", "sketch"])
            out.insert(0, "doc", b["doc"].array)
            yield out

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInPandas(run, f"doc {kind}, c1 long, c2 long, n long, sketch binary")


def signature_rows(df: DataFrame, text_col: str, percent: int) -> DataFrame:
    """(sig, cls) of every text, each class once in a task, with the rows of need_rows. cls is odd where not all parts count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            for sets in gathered(s for s in sets_of(b["text"]) if len(s)):
                new = {c: s for (c, _), s in zip(digests(sets), sets, strict=True) if c not in seen}
                if len(seen) >= SEEN:
                    seen.clear()
                seen.update(new)
                names = np.array(list(new), dtype=np.int64)
                for doc, band, need, weak, sig, of in by_band(list(new.values()), percent) if new else ():
                    cls = names[doc]
                    sigs = [sig.view(np.int64), need_rows(cls, band, need)]
                    yield pd.DataFrame({"sig": np.concatenate(sigs), "cls": np.concatenate([(cls | weak)[of], cls])})

    return df.select(F.col(text_col).alias("text")).mapInPandas(run, "sig long, cls long")


def gathered(sets: Iterable[np.ndarray], size: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """The sets in lists of about so many shingles."""
    held, total = [], 0
    for s in sets:
        held.append(s)
        total += len(s)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


KINDS = PAIR, LARGE, NEEDS = 0, 1, 2


def grouped(rows: DataFrame) -> DataFrame:
    """From rows (sig, cls) or (sig, cls, fam, outer): (a, b, fam, sig, kind). PAIR: a and b are a pair of a small group. LARGE: a is
    in a large group. NEEDS: a row of need_rows. With outer, only pairs and groups with an outer member count, and b is a hash
    of a large group's first members, so that only alike groups have one name.

    A group's rows arrive next to each other, outer ones first, and are held up to GROUP classes; then the group is large, and later
    members pass by one at a time.
    """
    marked = "outer" in rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sig, held, large, name, out = None, {}, False, 0, []

        def pairs() -> list[tuple]:
            members = list(held.items())
            return [] if large else [(x, y, 0, sig, PAIR) for i, (x, (_, o)) in enumerate(members) for y, (_, p) in members[:i] if o or p]

        def frame(found: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(found, columns=["a", "b", "fam", "sig", "kind"])

        for b in batches:
            s, c = b["sig"].to_numpy(), b["cls"].to_numpy()
            if not marked:
                told = (s & ELEMENT) == NEED
                if told.any():
                    yield pd.DataFrame({"a": c[told], "b": 0, "fam": 0, "sig": s[told], "kind": NEEDS})
                    s, c = s[~told], c[~told]
            if not len(s):
                continue
            f = b["fam"].to_numpy() if marked else np.zeros(len(s), dtype=np.int64)
            o = b["outer"].to_numpy() if marked else np.ones(len(s), dtype=bool)
            starts = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
            ends = np.append(starts[1:], len(s))
            live = (ends - starts > 1) | (starts == 0) | (ends == len(s))
            for lo, hi in zip(starts[live].tolist(), ends[live].tolist(), strict=True):
                if sig is None or s[lo] != sig:
                    out += pairs()
                    sig, held, large, idle = int(s[lo]), {}, False, not o[lo]
                if idle:
                    continue  # no outer member
                for x, fam, outer in zip(c[lo:hi].tolist(), f[lo:hi].tolist(), o[lo:hi].tolist(), strict=True):
                    if large:
                        out.append((x, name, fam, sig, LARGE))
                    else:
                        held[x] = (fam, outer)
                        if len(held) > GROUP:
                            large, name = True, hash(tuple(held)) if marked else 0
                            out += [(y, name, k, sig, LARGE) for y, (k, _) in held.items()]
                if len(out) >= 20_000:
                    yield frame(out)
                    out = []
        yield frame(out + pairs())

    order = ["sig", F.desc("outer"), "cls"] if marked else ["sig"]
    return stored(rows.repartition("sig").sortWithinPartitions(*order).mapInPandas(run, "a long, b long, fam long, sig long, kind int"), "groups")


def band_of(sig: str = "sig") -> Column:
    return F.shiftright(sig, BAND_AT).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int")


def part_of(sig: str = "sig") -> Column:
    return F.col(sig).bitwiseAND(F.lit(ELEMENT)).cast("int")


def class_of(name: str) -> Column:
    return F.col(name).bitwiseAND(F.lit(-2))


def open_classes(found: DataFrame) -> DataFrame:
    """(fam, cls): the open classes and the families that they go to. A large group's first member names it, or the smallest
    first member of the large groups that this one is in: groups that overlap share names, and a class is in few families."""
    group, own = Window.partitionBy("sig"), Window.partitionBy("cls")
    large = found.filter(F.col("kind") == LARGE).select("sig", class_of("a").alias("cls"), band_of().alias("band"), part_of().alias("part"))
    large = large.withColumn("first", F.min("cls").over(group)).withColumn("least", F.min("first").over(own))
    large = large.withColumn("first", F.max(F.when(F.col("cls") == F.col("first"), F.col("least"))).over(group))
    hot = large.groupBy("cls", "band").agg(F.size(F.collect_set("part")).alias("hot"), F.collect_set("first").alias("firsts"))
    need = F.shiftright("sig", BAND_AT + BAND_BITS).bitwiseAND(F.lit(0xFFFF))
    needs = found.filter(F.col("kind") == NEEDS).select(F.col("a").alias("cls"), band_of().alias("band"), need.alias("need")).distinct()
    left = hot.join(needs, ["cls", "band"]).filter(F.col("hot") >= F.col("need"))
    return left.select(F.explode("firsts").alias("fam"), "cls").distinct()


def likely_pairs(found: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of small groups but those that would share more parts if they were similar."""
    least = F.array(*(F.lit(least_parts(int(k))) for k in bands(1 << 40, percent)[1]))
    p = found.filter(F.col("kind") == PAIR).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), band_of().alias("band"), part_of().alias("part"))
    g = p.groupBy("a", "b", "band").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    least = F.element_at(least, F.col("band") + 1)
    enough = (F.col("n") >= least) & ((least == 1) | (F.col("lo") < F.col("hi")))
    g = stored(g.select("a", "b", "band", enough.alias("enough")), "seen")
    hot = small(stored(found.filter(F.col("kind") == LARGE).select(class_of("a").alias("hot"), band_of().alias("band")).distinct(), "hot"))
    rest = g.filter("not enough")
    for x in "ab":
        sure = F.col(x).bitwiseAND(F.lit(1)) == 0
        held = rest.filter(sure).withColumn("hot", class_of(x)).join(hot, ["hot", "band"], "left_semi").select("a", "b", "band", "enough")
        rest = rest.filter(~sure).unionByName(held)
    return g.filter("enough").unionByName(rest).select(class_of("a").alias("a"), class_of("b").alias("b"))


def in_order(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key)


def shared_parts(sets: DataFrame) -> DataFrame:
    """(cls, n, common) from (c1, n, shingles): each set's shingles that another one has, too, sorted."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):
                some = b.iloc[lo : lo + 500]
                s = [np.frombuffer(x, dtype="<i8") for x in some["shingles"]]
                yield pd.DataFrame({"x": np.concatenate(s), "cls": np.repeat(some["c1"].to_numpy(), [len(v) for v in s])})

    @F.pandas_udf("binary")
    def packed(x: pd.Series) -> pd.Series:
        return pd.Series([np.sort(np.asarray(v if v is not None else [], dtype="<i8").view("<u8")).tobytes() for v in x], dtype=object)

    rows = sets.mapInPandas(each, "x long, cls long")
    shared = rows.groupBy("x").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("x")
    held = rows.join(shared, "x").groupBy("cls").agg(F.collect_list("x").alias("x"))
    return stored(sets.select(F.col("c1").alias("cls"), "n").join(held, "cls", "left").select("cls", "n", packed("x").alias("common")), "common")


def pivots_of(to: DataFrame, sets: DataFrame) -> DataFrame:
    """(fam, pivot) of the families of to (fam, cls): what most of a sample of up to SAMPLE members have."""

    def majority(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def pivot() -> pd.DataFrame:
            x, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"fam": [key], "pivot": [x[2 * n > len(held)].tobytes()]})

        for b in batches:
            for k, s in zip(b["fam"].tolist(), b["common"], strict=True):
                if k != key and held:
                    yield pivot()
                    held = []
                key = k
                held.append(np.frombuffer(s, dtype="<u8"))
        if held:
            yield pivot()

    chosen = to.groupBy("fam", F.pmod(F.xxhash64("cls", "fam"), F.lit(SAMPLE)).alias("slot")).agg(F.min("cls").alias("cls"))
    found = stored(in_order(chosen.join(sets, "cls").select("fam", "common"), "fam").mapInPandas(majority, "fam long, pivot binary"), "pivots")
    light = (found.agg(F.sum(F.length("pivot") + 16)).first()[0] or 0) <= BROADCAST_PIVOTS
    return F.broadcast(found) if light else found


def difference(common: bytes, pivot: bytes) -> np.ndarray:
    return np.setxor1d(np.frombuffer(common, dtype="<u8"), np.frombuffer(pivot, dtype="<u8"), assume_unique=True)


def within_families(to: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the families of to (fam, cls): certain links (a, b), candidate pairs (a, b), and what is open as (fam, cls)."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = np.array([len(difference(s, p)) - len(s) // 8 for s, p in zip(b["common"], b["pivot"], strict=True)], dtype=np.int64)
            d = b["n"].to_numpy() + own
            yield pd.DataFrame({"fam": b["fam"], "cls": b["cls"], "n": b["n"], "d": d, "excess": d * (100 + percent) - b["n"] * (100 - percent)})

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):
                some = b.iloc[lo : lo + 500]
                made = [mix(difference(s, p) ^ mix(np.array([f], dtype=np.int64).view(np.uint64))) for s, p, f in zip(some["common"], some["pivot"], some["fam"].tolist(), strict=True)]
                size = [len(x) for x in made]
                yield pd.DataFrame({"sig": np.concatenate(made).view(np.int64), **{c: np.repeat(some[c].to_numpy(), size) for c in ("cls", "fam", "outer")}})

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def links() -> pd.DataFrame:
            cls, n, d, outer, made = (list(x) for x in zip(*held, strict=True))
            flat, at = np.unique(np.concatenate(made), return_inverse=True)
            who, both = np.repeat(np.arange(len(made)), [len(x) for x in made]), np.zeros((len(made), len(made)), dtype=np.float32)
            for lo in range(0, len(flat), 4096):
                some, has = (at >= lo) & (at < lo + 4096), np.zeros((len(made), 4096), dtype=np.float32)
                has[who[some], at[some] - lo] = 1
                both += has @ has.T
            d, n, outer, cls = np.array(d), np.array(n), np.array(outer), np.array(cls)
            apart = d[:, None] + d - 2 * np.rint(both).astype(np.int64)
            near = (apart * (100 + percent) <= (n[:, None] + n) * (100 - percent)) & (outer[:, None] | outer)
            i, j = np.nonzero(np.tril(near, -1))
            return pd.DataFrame({"a": cls[i], "b": cls[j]})

        for b in batches:
            for k, c, n, d, o, s, p in zip(*(b[x].tolist() for x in ("fam", "cls", "n", "d", "outer", "common", "pivot")), strict=True):
                if k != key and held:
                    yield links()
                    held = []
                key = k
                held.append((c, n, d, o, difference(s, p)))
        if held:
            yield links()

    pivots = pivots_of(to, sets)
    items = stored(to.join(sets, "cls").join(pivots, "fam").mapInPandas(measured, "fam long, cls long, n long, d long, excess long"), "items")
    ends = items.groupBy("fam").agg(F.min(F.struct("excess", "cls")).alias("least"), F.max("excess").alias("most"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    star = stored(items.join(small(stored(ends, "ends")), "fam").withColumn("outer", F.col("excess") + F.col("least.excess") > 0), "star")
    sure = star.filter("not outer").filter(F.col("cls") != F.col("least.cls")).select(F.col("cls").alias("a"), F.col("least.cls").alias("b"))
    # A pair shares (its excesses together) / 2 (100 + percent) elements at least, and one of it is outer.
    partner = F.when(F.col("outer"), F.col("least.excess")).otherwise(1 - F.col("least.excess"))
    far = F.col("n") + F.floor(F.col("n") * 100 / percent)
    need = F.greatest(F.lit(1), F.col("d") - F.floor(far * (100 - percent) / (100 + percent)), F.ceil((F.col("excess") + partner) / (2 * (100 + percent))))
    live = star.filter(F.col("most") + F.col("least.excess") > 0).withColumn("need", need).drop("least", "most", "excess")
    few = live.filter(F.col("members") <= FAMILY).join(sets.drop("n"), "cls")
    near = in_order(few.join(pivots, "fam").select("fam", "cls", "n", "d", "outer", "common", "pivot"), "fam")
    sure = sure.unionByName(stored(near.mapInPandas(compared, "a long, b long"), "near"))
    live = live.filter(F.col("members") > FAMILY)
    found = grouped(live.join(sets.drop("n"), "cls").join(pivots, "fam").select("common", "pivot", "cls", "fam", "outer").mapInPandas(elements, "sig long, cls long, fam long, outer boolean"))
    large = found.filter(F.col("kind") == LARGE).select("fam", F.col("a").alias("cls"), "sig", F.col("b").alias("name"))
    sizes = small(stored(large.groupBy("sig").agg(F.count(F.lit(1)).alias("size")), "sizes"))
    hot = large.join(sizes, "sig").groupBy("fam", "cls").agg(F.sort_array(F.collect_list(F.struct("size", "name", "sig"))).alias("hot"))
    hot = hot.join(live.select("fam", "cls", "outer", "need"), ["fam", "cls"]).filter(F.size("hot") >= F.col("need"))
    first = F.slice("hot", F.lit(1), (F.size("hot") - F.col("need") + 1).cast("int"))
    hot = stored(hot.select("fam", "cls", "outer", F.explode(F.array_distinct(first["name"])).alias("name")), "hot")
    left = hot.join(hot.filter("outer").select("fam", "name").distinct(), ["fam", "name"], "left_semi")
    return sure, found.filter(F.col("kind") == PAIR).select("a", "b"), left.select(F.xxhash64("fam", "name").alias("fam"), "cls").distinct()


def sketch(s: np.ndarray) -> np.ndarray:
    """Shingles counted in SKETCH cells, up to 255. The cells' differences add up to no more than the sets' distance."""
    return np.minimum(np.bincount((s >> U64(20) & U64(SKETCH - 1)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8)


def sets_for(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(node, c1, n, shingles) of the classes in need (node, c1, c2), from docs (node, text)."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for node, c1, c2, s in zip(b["node"], b["c1"], b["c2"], sets_of(b["text"]), strict=True):
                if digest(s) == (c1, c2):  # rows of one id may have several texts
                    rows.append((node, c1, len(s), s.astype("<u8").tobytes()))
            yield pd.DataFrame(rows, columns=["node", "c1", "n", "shingles"])

    kind = docs.schema["node"].dataType.simpleString()
    return docs.join(small(need), "node").mapInPandas(load, f"node {kind}, c1 long, n long, shingles binary")


def chosen_classes(member: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, c1, c2, n, sketch) of the classes in wanted (c1)."""
    chosen = small(stored(nodes.join(wanted.distinct(), "c1"), "chosen"))
    return stored(member.withColumnRenamed("doc", "node").join(chosen, ["node", "c1", "c2"]).select("node", "c1", "c2", "n", "sketch").dropDuplicates(["node", "c1", "c2"]), "classes")


def checked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) of classes whose sets are similar, as (a, b) of nodes. Sizes and sketches, which are small, rule
    out most pairs; only sets of classes in a pair that is left are made again from their texts and shuffled."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        a, b = (np.frombuffer(b"".join(v), dtype=np.uint8).reshape(-1, SKETCH).astype(np.int16) for v in (x, y))
        apart = np.abs(a - b).sum(axis=1, dtype=np.int64)
        return pd.Series(apart * (100 + percent) <= (n + m).to_numpy() * (100 - percent))

    @F.pandas_udf("boolean")
    def same(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(p, dtype="<u8"), np.frombuffer(q, dtype="<u8"), percent) for p, q in zip(x, y, strict=True)], dtype=bool)

    slim = small(classes, BROADCAST_SKETCHES)

    def side(name: str) -> DataFrame:
        return slim.select(F.col("c1").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("node", "c2", "n", "sketch")))

    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("node_a <> node_b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    close = stored(both.filter(near("sketch_a", "sketch_b", "n_a", "n_b")).select("a", "b", "node_a", "node_b", "c2_a", "c2_b"), "close")
    ends = [close.select(F.col(f"node_{x}").alias("node"), F.col(x).alias("c1"), F.col(f"c2_{x}").alias("c2")) for x in "ab"]
    sets = sets_for(docs, stored(ends[0].union(ends[1]).distinct(), "need"))
    left, right = (sets.select(F.col("c1").alias(x), F.col("node").alias(f"node_{x}"), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    whole = close.select("a", "b", "node_a", "node_b").join(left, ["a", "node_a"]).join(right, ["b", "node_b"])
    return stored(whole.filter(same("set_a", "set_b")).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "links")


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    low: Column = F.least("a", "b")
    return pairs.select(F.greatest("a", "b").alias("a"), low.alias("b")).distinct()


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for each row of df."""
    member = stored(membership(df, id_col, text_col), "member")
    nodes = member.filter("n > 0 and doc is not null").groupBy("c1", "c2").agg(F.min("doc").alias("node"))
    docs = df.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))  # equal rows only repeat links
    found = grouped(signature_rows(df, text_col, percent))
    pairs, sure, sets = likely_pairs(found, percent), None, None
    to = stored(open_classes(found), "open")
    for _ in range(MOST_ROUNDS):
        if to.isEmpty():
            break
        if sets is None:
            classes = chosen_classes(member, nodes, to.select(F.col("cls").alias("c1")))
            sets = shared_parts(stored(sets_for(docs, classes.select("node", "c1", "c2")).dropDuplicates(["c1"]), "sets"))
        certain, more, left = within_families(to, sets, percent)
        sure = certain if sure is None else sure.unionByName(certain)
        pairs, to = pairs.unionByName(more), stored(left, "open")
    else:
        raise RuntimeError("families did not settle")
    pairs = stored(ordered_pairs(pairs), "pairs")
    known = pairs.select(F.explode(F.array("a", "b")).alias("c1"))
    links = checked(pairs, chosen_classes(member, nodes, known), docs, percent)
    if sure is not None:
        named = nodes.select("c1", "node")
        sure = stored(ordered_pairs(sure), "sure")
        links = links.unionByName(sure.join(named.withColumnsRenamed({"c1": "a", "node": "node_a"}), "a").join(named.withColumnsRenamed({"c1": "b", "node": "node_b"}), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    named = components(links).withColumnRenamed("component", "label")
    labels = nodes.join(named, "node", "left").select("c1", "c2", F.coalesce("label", "node").alias("component_id"))
    out = member.join(labels, ["c1", "c2"], "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """df with one row, that of the smallest id, of each component; columns unchanged (names that begin with two underscores
    are the operator's own).

    Where ids are null or repeat, rows are the nodes instead of ids, each with a number of its own: different texts of one
    id stay unless they are similar, and a row without id stays only if no row with an id is in its component (so none has
    its set), one of each component. Rows with empty sets link with nothing: of those one of each id stays, and all without id."""
    ids = df.groupBy(id_col).count()
    if ids.filter(F.col(id_col).isNull() | (F.col("count") > 1)).isEmpty():
        found = stored(jaccard_components(df, id_col, text_col, percent), "components")
        gone = stored(found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "gone")
        return df.join(small(gone), id_col, "left_anti").select(df.columns)
    numbered = stored(df.withColumn("__row_number", F.monotonically_increasing_id()), "numbered")
    found = jaccard_components(numbered, "__row_number", text_col, percent)
    named = numbered.select("__row_number", F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).join(found, "__row_number")
    empty = F.when(F.col("n_shingles") == 0, F.struct(F.col("id").isNull(), F.coalesce(F.col("id").cast("string"), F.col("__row_number").cast("string"))))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h", "__row_number")).alias("first")
    kept = stored(named.groupBy(empty.alias("empty"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component")).agg(first).select("first.__row_number"), "kept")
    return numbered.join(small(kept), "__row_number", "left_semi").select(df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS at FROM d UNION SELECT r.node, l.b FROM r JOIN l ON r.at = l.a)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.at) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
"""
