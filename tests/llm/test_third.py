"""Exact dedup, hard negatives and the fill-in-middle transformation against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from maskframe.llm import exact, infill, negatives
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, keep_id string, sha string, members string, fim string, n long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, one text in a third of all rows, a very long text, clashing columns."""
    hot = [(100 + i, "hot text" + " " * (i % 3)) for i in range(60)]
    long = " ".join(f"w{i}é" for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \n\t\x0b\x0c\r"), (4, "one two"), (4, "one two"), (5, "onetwo"), (None, "on e two "), (None, "only null"), (6, long), (7, long + " "), (8, "<P> mark"), (9, "é😀 ü\x1cß 中文abc"), (10, " a"), (11, "a"), *hot, *((1000 + i, f"text {i} " * (i % 7)) for i in range(100))]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame([(*r, "x", "y", "z", "f", 1) for r in rows], SCHEMA).repartition(7)


def groups_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(g)[3], len(g)) for k, g in groups.items()}


@pytest.mark.parametrize("bits, chunk", [(48, 65536), (8, 65536), (48, 5)])
def test_exact_groups(spark, odd, bits, chunk):
    """Also with fingerprints of 8 bits, which different texts share, and with senders of five documents."""
    source = [(r.doc_id, r.text) for r in odd.collect()]
    want = groups_by_hand(source)
    sha = {hashlib.sha256(k.encode()).hexdigest(): k for k in want}
    got = exact.verdicts(odd, bits=bits, chunk_rows=chunk).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in got)) == sorted((i is None, i or 0) for i, _ in source)
    assert all((r.keep_id, r.group_size) == want[sha[r.text_sha256]] for r in got)
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted(sha) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_rows_that_stay(spark, odd):
    stay = exact.keep_one(odd)
    assert stay.columns == odd.columns
    want = groups_by_hand([(r.doc_id, r.text) for r in odd.collect()])
    got = stay.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in want.values())


def test_senders_tell_only_repeats(spark, odd):
    texts, messages = exact.sent(odd, "doc_id", "text", 7)
    told = {(r.sender, r.slot + 0): r for r in exact.marked(texts, exact.bitmaps(messages, 7)).collect()}
    count = {}
    for r in told.values():
        count[r.sha] = count.get(r.sha, 0) + 1
    assert any(n > 1 for n in count.values()) and all(r.suspect == (count[r.sha] > 1) for r in told.values())


@pytest.mark.parametrize("seed", range(40))
def test_golomb_round_trip(seed):
    rng = np.random.default_rng(seed)
    span = 1 << int(rng.integers(1, 48))
    values = np.sort(rng.integers(0, span, int(rng.integers(1, 3000)), dtype=np.uint64))
    code = exact.golomb(values, span)
    assert (exact.from_golomb(code, len(values), span) == values).all()
    if len(values) > 500 and span > 1 << 20:  # entropy of the set is about log2(e x span / n) bits a value
        assert len(code) * 8 / len(values) < math.log2(math.e * span / len(values)) + 0.5


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact.verdicts(none).count() == exact.keep_one(none).count() == infill.with_infill(none).count() == 0
    assert negatives.mine(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), F.col("id") % 50 == 0).count() == 0


# fill in middle


def infill_by_hand(ident, text):
    words = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
    h = hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(words), "plain", None, None, text or ""
    a, b = sorted((h1 % (len(words) + 1), h2 % (len(words) + 1)))
    p, m, s = "".join(words[:a]), "".join(words[a:b]), "".join(words[b:])
    return (len(words), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(words), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill_and_back(spark, odd):
    got = infill.with_infill(odd).withColumn("back", infill.restored()).collect()
    assert infill.with_infill(odd).columns == odd.columns and len(got) == odd.count()
    for r in got:
        assert (r.fim.n, r.fim.form, r.fim.prefix_chars, r.fim.middle_chars, r.fim.output) == infill_by_hand(r.doc_id, r.text)
        assert r.back == (r.text or "")


@pytest.mark.parametrize("most, stretch, cache", [(1 << 16, 1 << 18, 32 << 20), (100, 1 << 18, 2000), (1 << 16, 40, 0)])
def test_chunk_counts_of_random_texts(monkeypatch, most, stretch, cache):
    for name, value in (("MOST", most), ("STRETCH", stretch), ("CACHE", cache)):
        monkeypatch.setattr(infill, name, value)
    rng, counter = random.Random(most + stretch), infill.Counter()
    pool = list("abcXYZ") * 6 + list(" \n\x00.<>é中😀") + ["word" * 9, "İ", "<P", "x" * 300, "é" * 200]
    passages = ["".join(rng.choice(pool) for _ in range(400)) for _ in range(5)]
    for i in range(300):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(200))) + rng.choice([*passages, ""]) + "".join(rng.choice(pool) for _ in range(rng.randrange(50)))
        assert infill.transformed(counter, str(i), text)[:4] + infill.transformed(counter, str(i), text)[5:] == infill_by_hand(i, text)
        c = counter.read(text)
        ends = list(np.cumsum([len(w) for w in re.findall(r"[A-Za-z]+|[^A-Za-z]", text)]))
        assert [c.place(k) for k in range(c.tokens + 1)] == [0, *ends]


def test_shared_passages_share_chunks():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(2000))
    chunks = [{d[a:b] for a, b in zip([0, *infill.cuts(d)], infill.cuts(d), strict=False)} for d in (f"{' '.join(word() for _ in range(n))} {passage}".encode() for n in (3, 500))]
    assert len(chunks[0] & chunks[1]) > 0.8 * len(chunks[0])


# hard negatives


def mined_by_hand(rows, anchors, k=5, m=3, low=50, high=95):
    ok = {(i, y, tuple(math.floor(256 * x) for x in v)) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for a, y, q in ok:
        if not anchors(a):
            continue
        score = {(o, z, sum(s * t for s, t in zip(q, p, strict=False))) for o, z, p in ok if o != a}
        for p, _, s in sorted((x for x in score if x[1] == y), key=lambda x: (-x[2], x[0]))[:k]:
            below = sorted({(o, t) for o, z, t in score if z != y and low * s <= 100 * t <= high * s}, key=lambda x: (-x[1], x[0]))[:m]
            out |= {(a, p, r, o, s, t) for r, (o, t) in enumerate(below, 1)}
    return out


@pytest.mark.parametrize("dim, part", [(3, 32768), (70, 16)])
def test_hard_negatives(spark, monkeypatch, dim, part):
    """Ties, repeated vectors, one label in half of the rows, null parts, vectors of other lengths, a clashing column."""
    monkeypatch.setattr(negatives, "PART", part)
    monkeypatch.setattr(negatives, "LEAST_STRIPES", 2)
    rng = np.random.default_rng(dim)
    # float32 values that floor alike in both ways of computing
    vec = lambda n=dim: [float(x) for x in np.round(rng.normal(size=n) * 64) / 256]
    common = vec()
    rows = [(i, common if i % 5 == 0 else vec(), 0 if i % 2 else int(rng.integers(0, 4))) for i in range(240)]
    rows += [(7, rows[7][1], rows[7][2]), (50, vec(), 1), (None, vec(), 1), (301, None, 1), (302, vec(), None), (303, [*vec(dim - 1), math.nan], 1), (304, [*vec(dim - 1), math.inf], 1), (305, [*vec(dim - 1), None], 1), (350, vec(dim - 1), 1), (400, [0.0] * dim, 2), (450, [], 3)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, key int").repartition(3)
    got = [tuple(r) for r in negatives.mine(df, F.col("id") % 10 == 0).collect()]
    want = mined_by_hand(rows, lambda i: i % 10 == 0)
    assert set(got) == want and len(want) > 50


def test_intervals_hold_and_filter():
    rng = np.random.default_rng(5)
    q = np.floor(256 * rng.normal(size=(3000, 64)) / 8)
    turn = negatives.rotation(64)
    codes, scales = negatives.coded(q, turn)
    assert np.allclose(turn @ turn.T, np.eye(64))
    rows = negatives.Rows(np.arange(3000), np.zeros(3000, dtype=np.int64), q.astype(np.int64), codes, scales)
    queries, exact_scores, every = negatives.Queries(q[:40].astype(np.int64), turn), q[:40] @ q.T, np.full(40, -np.inf)
    assert queries.pairs(rows, every, -every)[2].tolist() == exact_scores.ravel().astype(int).tolist()
    for rank in (1, 6, 100):  # no pair that reaches a limit is lost, and few others are scored
        limit = np.sort(exact_scores, axis=1)[:, -rank]
        a, _, score = queries.pairs(rows, limit, -every)
        assert (np.bincount(a, score >= limit[a]) == rank).all() and len(score) < (0.1 if rank < 100 else 0.4) * exact_scores.size
        a, _, score = queries.pairs(rows, every, -limit)
        assert (np.bincount(a, score <= -limit[a], minlength=40) == (exact_scores <= -limit[:, None]).sum(axis=1)).all()


def test_scores_beyond_63_bits_are_an_error(spark):
    with pytest.raises(ValueError):
        negatives.mine(spark.createDataFrame([(50, [1e30], 1)], "vec_id long, embedding array<float>, label int"), F.col("id") % 50 == 0)
