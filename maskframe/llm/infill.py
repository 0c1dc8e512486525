"""Fill-in-middle transformation by content-defined chunks whose token counts are remembered.

A text's UTF-8 bytes are cut where a rolling hash of the last SIGHT bytes has MASK zero bits, never inside a code point, with
LEAST to MOST bytes between cuts. So texts that share passages share chunks. A chunk's boundary summary is (tokens, code
points, whether its first and last characters are letters); summaries are kept by the chunk's bytes, so a chunk that was seen
before is found only if its content is the same. Counts combine: two chunks that meet inside a run of letters share one
token. Prefix sums of the counts name the chunk that holds a cut, and only that chunk is read again to find the place.

A text is cut at two token borders that hashes of its id choose, and written as prefix, suffix, middle (psm) or suffix,
prefix, middle (spm), each behind its mark; some texts, empty ones and those that contain a mark stay plain.

Scale: no shuffle; a task's memory is bounded by STRETCH bytes of hashes and CACHE bytes of chunks.

Edge cases: a null text is empty and plain; a null id counts as the empty string; equal rows get equal results; very long
texts are hashed stretch by stretch; an empty table gives an empty result; further columns are carried along, and the added
column replaces one of its name.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of
from .hashing import windows

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")
SIGHT, MASK, LEAST, MOST = 16, np.uint64(511), 64, 1 << 16
STRETCH, CACHE = 1 << 18, 32 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many stay plain, and of 100 others so many are spm.
PLAIN_SHARE, SPM_SHARE = 10, 20
#: Bytes by class: a letter, a first byte of another character; continuation bytes are deleted.
CLASSES = bytes(97 if chr(b).isalpha() and b < 128 else 46 for b in range(256))
FOLLOWING = bytes(range(0x80, 0xC0))

Summary = tuple[int, int, bool, bool]


def candidates(data: bytes) -> list[int]:
    """Places (bytes before them) at which the rolling hash asks for a cut."""
    raw = np.frombuffer(data, dtype=np.uint8)
    out = []
    for lo in range(0, max(1, len(raw) - SIGHT), STRETCH):
        part = raw[lo : lo + STRETCH + SIGHT]
        at = np.flatnonzero((windows(part[:-1].astype(np.uint64) + np.uint64(1), SIGHT) & MASK) == 0) + SIGHT if len(part) > SIGHT else np.empty(0, dtype=np.int64)
        out.append(lo + at[(part[at] & 0xC0) != 0x80])
    return np.concatenate(out).tolist()


def cuts(data: bytes) -> list[int]:
    """Where the chunks end."""
    asked, ends, last = candidates(data), [], 0
    i = 0
    while len(data) - last > LEAST:
        i = bisect_left(asked, last + LEAST, i)
        here = asked[i] if i < len(asked) else len(data)
        if here - last > MOST:
            here = last + MOST
            while here < len(data) and data[here] & 0xC0 == 0x80:
                here += 1
        ends.append(here)
        last = here
    if last < len(data):
        ends.append(len(data))
    return ends


def summary(chunk: bytes) -> Summary:
    s = chunk.translate(CLASSES, FOLLOWING)
    return s.count(b".") + s.count(b".a") + (s[:1] == b"a"), len(s), s[:1] == b"a", s[-1:] == b"a"


class Counter:
    """Token counts of texts from the summaries of their chunks."""

    def __init__(self) -> None:
        self.seen: dict[bytes, Summary] = {}
        self.size = 0

    def of(self, chunk: bytes) -> Summary:
        found = self.seen.get(chunk)
        if found is None:
            if self.size + len(chunk) > CACHE:
                self.seen, self.size = {}, 0
            found = self.seen[chunk] = summary(chunk)
            self.size += len(chunk) + 150
        return found

    def read(self, text: str) -> Chunked:
        return Chunked(text, self)


class Chunked:
    """One text's chunks and the prefix sums of their counts."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.data = text.encode("utf-8", "surrogatepass")
        self.ends = cuts(self.data)
        found = [counter.of(self.data[a:b]) for a, b in zip([0, *self.ends], self.ends)]
        #: Does the chunk go on with the letters of the one before it?
        self.joined = [i > 0 and s[2] and found[i - 1][3] for i, s in enumerate(found)]
        self.begun = list(accumulate(s[0] - j for s, j in zip(found, self.joined, strict=True)))
        self.points = list(accumulate((s[1] for s in found), initial=0))
        self.tokens = self.begun[-1] if found else 0

    def place(self, tokens: int) -> int:
        """Code points before the end of the first so many tokens."""
        if tokens == 0 or tokens == self.tokens:
            return self.points[-1] if tokens else 0
        i = bisect_right(self.begun, tokens)
        ahead = tokens - (self.begun[i - 1] if i else 0) + self.joined[i]
        chunk = self.data[self.ends[i - 1] if i else 0 : self.ends[i]].decode("utf-8", "surrogatepass")
        return self.points[i] + next(islice(TOKEN.finditer(chunk), ahead, None)).start()


def transformed(counter: Counter, ident: str, text: str, seed: str = "1") -> tuple:
    h = hashlib.sha256(f"{seed}:{ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    c = counter.read(text)
    if not text or h3 % 100 >= 100 - PLAIN_SHARE or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return c.tokens, "plain", None, None, len(c.ends), text
    a, b = sorted((c.place(h1 % (c.tokens + 1)), c.place(h2 % (c.tokens + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_SHARE:
        return c.tokens, "spm", a, b - a, len(c.ends), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return c.tokens, "psm", a, b - a, len(c.ends), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


FIM = "n long, form string, prefix_chars long, middle_chars long, n_chunks long, output string"
_COUNTER: list[Counter] = []


def rows_of(ident: pd.Series, text: pd.Series) -> pd.DataFrame:
    counter = _COUNTER[0] if _COUNTER else _COUNTER.append(Counter()) or _COUNTER[0]
    found = [transformed(counter, i, t) for i, t in zip(ident, text, strict=True)]
    return pd.DataFrame(found, columns=["n", "form", "prefix_chars", "middle_chars", "n_chunks", "output"]).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})


def with_infill(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "fim") -> DataFrame:
    """Adds a struct of n (tokens), form, prefix_chars, middle_chars, n_chunks and output."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return df.withColumn(out, F.pandas_udf(rows_of, FIM)(ident, text_of(text_col)))


def restored(fim: str = "fim") -> Column:
    """The text, rebuilt from output and form."""
    part = F.split(F.col(fim)["output"], "<[PSM]>", -1)
    form = F.col(fim)["form"]
    whole = F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1]))
    return F.coalesce(whole, F.col(fim)["output"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_infill(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return docs.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", sha(F.col("fim.output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, CAST(len(w) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
p AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
c AS (SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS prefix, coalesce(array_to_string(w[a+1:b], ''), '') AS middle, coalesce(array_to_string(w[b+1:n], ''), '') AS suffix FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
