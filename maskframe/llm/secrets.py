"""Secret scans: fixed patterns, and guess costs of values in credential contexts.

The patterns give the base spans. Beyond them, a value of at least 8 characters behind a credential word (also "pwd",
"passphrase", "credential", "auth", "bearer" and the words for passwords in German, French and Spanish, with "is", "->" or a
blank as separators, and as the end of a longer name such as DB_PASSWORD), or a password in an address (scheme://user:value@),
is judged by the cost of guessing it: dynamic programming finds the cheapest segmentation into words, dates,
repeats, keyboard walks, sequences and brute-force spans, costs in log10 of guesses. Words are those that guessers try
first, the words of the corpus by their counts over all documents, and the pieces of the tokenizer's vocabulary by rank, so that
words of the corpus' own languages are cheap. A value of at least `least_cost` is a secret, whatever its letters, and adds an
"assign" span; behind a mere blank it must hold something other than letters, hyphens and apostrophes, as any word of a sentence can stand there.

Words are counted natively and merged before the shuffle. The table of counts by size class (a few hundred rows) tells how far
down `most` words reach; only those reach the driver and the tasks. Words that touch digits, quotes or signs of an
assignment are not counted, so that values of credentials do not become words.

Edge cases: null texts are empty; very long values cost linear time: words are no longer than the longest of the
lexicon (corpus words have at most 40 letters), and of a run's starts only those are tried that no other one beats wherever the run
ends; long words that the corpus holds less than twice can cost as much as a secret behind "=", ":" or "is"; ties between segmentations have equal cost; equal rows get equal results; further columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .packing import default_tokenizer
from .spans import Span, as_text, free_of, ordered

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
#: Each match of ASSIGN or CONTEXT holds one of these in lower case.
HINTS = ("passw", "secret", "token", "api", "pwd", "passphrase", "credential", "auth", "kennwort", "contrase", "mot de passe", "bearer", "://")
NAMES = r"password|passwd|pwd|passphrase|secret|token|api[_\x20-]?key|credentials?|auth(?:orization)?|bearer|passwort|kennwort|mot\x20de\x20passe|contrase[n\u00f1\u00d1]a"
#: Values are visible ASCII and Latin letters; group 1 is the separator, 2 the value.
CONTEXT = re.compile(rf"""(?:{NAMES})["']?\x20*(:|=|->|\x20(?:is|ist|est|es)\x20|\x20)\x20*(?=["'`]?([!-~\u00c0-\u024f]{{8,}}))""", re.I | re.A)
LOGIN = re.compile(r"://[^\s/:@]*:([^\s/:@]{8,})@")
#: Rows of a keyboard, and words that guessers try first.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
WORDS = """password passwd secret admin login welcome letmein dragon monkey master hello freedom shadow summer winter spring
autumn sunshine princess football baseball superman batman trustno love money flower ninja mustang access whatever
computer internet service system server user guest root test demo temp example sample default change public private
apple orange banana cheese coffee house school london berlin paris madrid january february march april may june july
august september october november december monday tuesday wednesday thursday friday saturday sunday the and for with
this that from have""".split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
WALK = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in ROWS for a, b in zip(row, row[1:], strict=False)}
DATES = tuple(re.compile(x) for x in (r"(?:19|20)\d\d[-/._]?[01]\d[-/._]?[0-3]\d", r"[0-3]?\d[-/._][01]?\d[-/._](?:19|20)\d\d", r"(?:19|20)\d\d"))
LEAST_COST, LEAST_LENGTH = 12.0, 12


#: A word of the corpus, on its own.
CORPUS_WORD = r"(?<![\p{L}\p{N}_=:/+.@\"'`-])[A-Za-z\u00C0-\u024F]{3,40}(?![\p{L}\p{N}_=:/+@\"'`-])"


def learned_words(df: DataFrame, text_col: str = "text", most: int = 20_000, least: int = 2) -> tuple[str, ...]:
    """The frequent words of all texts, by falling count: whole classes of like counts (eighths of a doubling) as long as they
    hold at most `most` words together, none seen less than `least` times."""
    words = df.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(CORPUS_WORD), F.lit(0))).alias("w"))
    counts = words.groupBy(F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    counts = stored(counts.withColumn("size_class", F.floor(F.log2("n") * 8).cast("int")), "words")
    left, lowest = most, None
    for r in sorted(counts.groupBy("size_class").count().collect(), key=lambda r: -r["size_class"]):
        left -= r["count"]
        if left < 0:
            break
        lowest = r["size_class"]
    rows = counts.filter(F.col("size_class") >= lowest).select("w", "n").collect() if lowest is not None else []
    return tuple(r["w"] for r in sorted(rows, key=lambda r: (-r["n"], r["w"])))


@dataclass(frozen=True)
class Known:
    """Words by rank, and the length of the longest."""

    rank: dict[str, int]
    longest: int


@lru_cache(maxsize=2)
def lexicon(words: tuple[str, ...] = ()) -> Known:
    """WORDS, the corpus' words, then the pieces of the tokenizer's vocabulary (at least 3 letters), which keep their own rank."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(str(default_tokenizer())).get_vocab()
    rank = dict(RANK)
    for piece in sorted(vocab, key=vocab.get):
        word = piece.removesuffix("</w>")
        if len(word) >= 3 and word.isascii() and word.isalpha():
            rank.setdefault(word.lower(), len(rank) + 1)
    for k, word in enumerate(words, len(RANK) + 1):
        rank[word] = min(k, rank.get(word, k))
    return Known(rank, max(map(len, rank)))


class Starts:
    """Where segments along one kind of run may start, so that the cheapest end is found without trying all starts.

    A segment of k characters costs base + log10(k) + more. Of two starts the later one is better wherever the run ends if its cost is not
    higher. A place that a segment of the run itself reached is never better than that segment's start. So few starts stay.
    """

    def __init__(self, base: float, more: float) -> None:
        self.price, self.places = base + more, [(0, 0.0)]

    def broken(self, at: int, cost: float) -> None:
        self.places = [(at, cost)]

    def end(self, at: int) -> float:
        return min((cost + self.price + math.log10(at - a) for a, cost in self.places if at - a >= 3), default=math.inf)

    def add(self, at: int, cost: float, reached: float) -> None:
        if cost < reached:
            while self.places and self.places[-1][1] >= cost:
                self.places.pop()
            self.places.append((at, cost))


def guess_cost(value: str, lexicon: dict[str, int] | None = None, longest: int | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation needs; each further segment doubles the guesses."""
    rank, n = RANK if lexicon is None else lexicon, len(value)
    low = "".join(c if len(c.lower()) > 1 else c.lower() for c in value)
    longest = longest or max(map(len, rank), default=0)
    size = sum(k for k, used in ((10, re.search(r"\d", value)), (26, re.search(r"[a-z]", value)), (26, re.search(r"[A-Z]", value)), (33, re.search(r"[^A-Za-z0-9]", value))) if used)
    one = math.log10(max(size, 2))
    more, best = math.log10(2), [0.0] + [math.inf] * n
    runs = (Starts(one, more), Starts(1.7, more), Starts(1.2, more))  # repeats, walks, sequences
    dates: dict[int, list[int]] = {}
    for a in range(n):
        if value[a].isdigit():
            for m in (d.match(value, a) for d in DATES):
                if m:
                    dates.setdefault(m.end(), []).append(a)
    for e in range(1, n + 1):
        c = low[e - 1]
        if e > 1:
            p = low[e - 2]
            for run, on in zip(runs, (c == p, (p, c) in WALK, abs(ord(c) - ord(p)) == 1), strict=True):
                if not on:
                    run.broken(e - 1, best[e - 1])
        reached = [run.end(e) for run in runs]
        best[e] = min(best[e - 1] + one, *reached)
        for a in dates.get(e, ()):
            best[e] = min(best[e], best[a] + 4.6 + more)
        for k in range(3, min(e, longest) + 1):
            r = rank.get(low[e - k : e])
            if r:
                cased = 0.3 if value[e - k : e] != low[e - k : e] else 0.0
                best[e] = min(best[e], best[e - k] + math.log10(r + 1) + cased + more)
        for run, cost in zip(runs, reached, strict=True):
            run.add(e, best[e], cost)
    return best[n]


def base_spans(text: str, hinted: bool) -> list[Span]:
    found = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    if hinted:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_LENGTH]
    return ordered(found, KINDS)


def judged(text: str, known: Known | None = None) -> list[tuple[int, int, int, float]]:
    """(start of the context, start and end of the value, guess cost) of every value in a credential context."""
    if not hinted(text):
        return []
    known, out = known or lexicon(), []
    for m in CONTEXT.finditer(text):
        value = m[2].rstrip("\"'`.,;)")
        if m[1] != " " or not re.sub("[-']", "", value).isalpha():
            out.append((m.start(), m.start(2), m.start(2) + len(value), guess_cost(value, known.rank, known.longest)))
    out += [(m.start(1), m.start(1), m.end(1), guess_cost(m[1], known.rank, known.longest)) for m in LOGIN.finditer(text)]
    return sorted(out)


def hinted(text: str) -> bool:
    low = text.lower()
    return any(h in low for h in HINTS)


def all_spans(text: str, least_cost: float = LEAST_COST, known: Known | None = None) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with those that the guess costs add."""
    return with_added(text, judged(text, known), least_cost)


def with_added(text: str, values: list[tuple[int, int, int, float]], least_cost: float) -> tuple[list[Span], list[Span]]:
    base = base_spans(text, hinted(text))
    new = [("assign", start, end) for start, _, end, cost in values if cost >= least_cost]
    return base, ordered(base + free_of(new, base), KINDS) if new else base


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_cost: float = LEAST_COST, redact: bool = False, words: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each row of df: id, counts of base spans by kind, base_sha256, spans, costs (start:end:cost of every value in a credential
    context, in log10 of guesses), and the redacted text if asked. words: those of the corpus by rank; learned from df if not given."""
    words = learned_words(df, text_col) if words is None else words
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lexicon(words)
        for b in batches:
            rows = []
            for t in b["text"]:
                values = judged(t or "", known)
                base, spans = with_added(t or "", values, least_cost)
                count = [sum(s[0] == k for s in base) for k in KINDS]
                clean = [redacted(t, spans)] if redact else []
                rows.append((*count, hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(spans), ",".join(f"{a}:{b}:{cost:.2f}" for _, a, b, cost in values), *clean))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "costs", *["redacted"] * redact])
            out.insert(0, "id", b["id"].array)
            yield out

    schema = f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, costs string" + ", redacted string" * redact
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema).withColumnRenamed("id", id_col)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each stretch that spans cover replaced by one mark."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", least_cost: float = LEAST_COST, words: tuple[str, ...] | None = None) -> DataFrame:
    """df with secrets in its texts replaced; length_col, if there, follows the new text. Same columns, same rows."""
    words = learned_words(df, text_col) if words is None else words

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        known = lexicon(words)
        return pd.Series([redacted(t, all_spans(t or "", least_cost, known)[1]) for t in text], dtype=object)

    out = df.withColumn(text_col, clean(F.col(text_col)))
    return out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(df.schema[length_col].dataType)) if length_col in df.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
