"""Language ID with a linear-chain conditional random field.

Each word has features: itself if in the lexicon, affixes of 1 to 3 letters and letter 3-grams, hashed to a fixed number
of columns. Weights and language-to-language transitions are learned together by gradient steps on the exact likelihood
(forward-backward). Training sequences join stretches of documents of different languages, so switches are learned too.
Prediction runs forward-backward over the words of the whole text, cut into chains of CHAIN words, and averages the
words' marginals weighted by their letters: the best language is the prediction, its average the score.

A run of more than PIECE letters (a script without blanks, a long compound) counts as several words of up to PIECE letters, so
that all its 3-grams are seen and a switch inside it can be: neighbours overlap by two letters, which count once, and
only the first and last have the affixes of the run.

The fit uses at most `per_language` documents of each language (those with the smallest hashes in as many hash
buckets) and at most `words` words of each, in short stretches from all over the text (of a run of more than RUN letters its
first RUN); everything else covers all rows and whole texts. Only these words reach the driver.

A task's memory does not follow its rows: texts are taken in blocks of about BLOCK characters, longer ones in parts that end
between words, and at most CACHE words (of up to PIECE letters) keep their scores.

Edge cases: null texts and texts without a letter are "und" with score 0; without any labelled row all texts are "und";
null languages are never learned; equal texts get equal results; very long texts only have more chains; an empty table gives
an empty result; further columns are neither read nor, in keep_known, changed.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LETTERS, BREAK = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")
COLUMNS, CHAIN, LEXICON = 1 << 15, 64, 200
CACHE, BLOCK, RUN = 120_000, 200_000, 200
#: Up to so many ids are listed in a filter; more are joined.
LISTED = 20_000
#: Letters of a piece of a longer run, and the mark at a piece's end where the run goes on.
PIECE, MORE = 24, "-"


def words_in(text: str) -> list[str]:
    """The runs of letters in lower case, long ones in pieces."""
    out = []
    for run in LETTERS.findall(text.lower()):
        if len(run) <= PIECE:
            out.append(run)
        else:
            out += [MORE * (at > 0) + run[at : at + PIECE] + MORE * (at + PIECE < len(run)) for at in range(0, len(run) - 2, PIECE - 2)]
    return out


def own_letters(word: str) -> int:
    """Letters of a word; those that a piece shares with the next one count there."""
    return len(word) - (word[0] == MORE) - 3 * (word[-1] == MORE)


def word_features(word: str, lexicon: frozenset[str]) -> list[int]:
    w = word.strip(MORE)
    named = [f"<{w[:k]}" for k in (1, 2, 3) if word[0] != MORE] + [f"{w[-k:]}>" for k in (1, 2, 3) if word[-1] != MORE] + [w[i : i + 3] for i in range(len(w) - 2)]
    if word in lexicon:
        named.append(f"={word}")
    return [zlib.crc32(x.encode()) % COLUMNS for x in dict.fromkeys(named)]


def forward_backward(emissions: np.ndarray, mask: np.ndarray, trans: np.ndarray, learn: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (chains, words, languages) and the scaled messages' pairwise sums if they are to learn from.

    emissions are scores; mask is 1 where a word stands, words first."""
    s, t, k = emissions.shape
    e = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    m = np.exp(trans)
    alpha = np.empty_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        a = (alpha[:, i - 1] @ m) * e[:, i]
        alpha[:, i] = np.where(mask[:, i, None], a / a.sum(axis=1, keepdims=True), alpha[:, i - 1])
    beta = np.ones_like(e)
    pairs = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        right = e[:, i + 1] * beta[:, i + 1]
        b = right @ m.T
        live = mask[:, i + 1, None]
        beta[:, i] = np.where(live, b / b.sum(axis=1, keepdims=True), beta[:, i])
        if learn:
            joint = alpha[:, i, :, None] * m * right[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True) * live[..., None]).sum(axis=0)
    g = alpha * beta
    return g / g.sum(axis=2, keepdims=True), pairs


@dataclass
class Tagger:
    languages: list[str]
    weights: np.ndarray
    trans: np.ndarray
    lexicon: frozenset[str]

    @staticmethod
    def fit(rows: list[tuple[str, str]], words: int = 200, epochs: int = 8, rate: float = 0.15, seed: int = 7) -> "Tagger":
        """rows: (text, language)."""
        rng, languages = np.random.default_rng(seed), sorted({lang for _, lang in rows})
        k, streams = len(languages), []
        counts: dict[str, Counter] = {lang: Counter() for lang in languages}
        for text, lang in rows:
            found = words_in(text)[:words]
            counts[lang].update(found)
            for lo in range(0, len(found), 16):
                streams.append([(w, languages.index(lang)) for w in found[lo : lo + 16]])
        lexicon = frozenset(w for c in counts.values() for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])
        weights, trans = np.zeros((COLUMNS, k)), np.zeros((k, k))
        if not streams:
            return Tagger(languages, weights, trans, lexicon)
        rng.shuffle(streams)  # neighbours of other languages: code-switched text
        flat = [x for s in streams for x in s]
        chains = [flat[lo : lo + CHAIN] for lo in range(0, len(flat), CHAIN)]
        memo: dict[str, np.ndarray] = {}
        g2w, g2t = np.full((COLUMNS, k), 1e-6), np.full((k, k), 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(chains))
            for lo in range(0, len(order), 16):
                batch = [chains[i] for i in order[lo : lo + 16]]
                n = len(batch)
                mask, truth = np.zeros((n, CHAIN), dtype=bool), np.zeros((n, CHAIN), dtype=int)
                emit, cols, where = np.zeros((n, CHAIN, k)), [], []
                for i, c in enumerate(batch):
                    mask[i, : len(c)] = True
                    for j, (w, y) in enumerate(c):
                        f = memo.get(w)
                        if f is None:
                            f = memo[w] = np.array(word_features(w, lexicon))
                        emit[i, j], truth[i, j] = weights[f].sum(axis=0), y
                        cols.append(f)
                        where.append(np.full(len(f), i * CHAIN + j))
                marginal, pairs = forward_backward(emit, mask, trans, learn=True)
                diff = marginal.copy()
                diff[np.arange(n)[:, None], np.arange(CHAIN), truth] -= 1
                diff[~mask] = 0
                both = mask[:, 1:] & mask[:, :-1]
                seen = np.zeros((k, k))
                np.add.at(seen, (truth[:, :-1][both], truth[:, 1:][both]), 1)
                flat_cols, grad = np.concatenate(cols), diff.reshape(-1, k)[np.concatenate(where)]
                total = np.zeros_like(weights)
                for lang in range(k):
                    total[:, lang] = np.bincount(flat_cols, weights=grad[:, lang], minlength=COLUMNS)
                total += 1e-3 * weights
                g2w += total**2
                weights -= rate * total / np.sqrt(g2w)
                gt = pairs - seen + 1e-3 * trans
                g2t += gt**2
                trans -= rate * gt / np.sqrt(g2t)
        return Tagger(languages, weights, trans, lexicon)

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Posterior rows for the words of many texts in a row; each text is cut into chains of CHAIN words."""
        k = len(self.languages)
        chains = -(-lengths // CHAIN)
        text = np.repeat(np.arange(len(lengths)), chains)
        rank = np.arange(len(text)) - np.repeat(np.cumsum(chains) - chains, chains)
        start = np.repeat(np.cumsum(lengths) - lengths, chains) + rank * CHAIN
        size = np.minimum(lengths[text] - rank * CHAIN, CHAIN)
        out = np.empty_like(emissions)
        order = np.argsort(-size, kind="stable")
        for lo in range(0, len(order), 2048):
            some = order[lo : lo + 2048]
            t = int(size[some].max())
            at = start[some][:, None] + np.arange(t)
            mask = np.arange(t) < size[some][:, None]
            padded = emissions[np.minimum(at, len(emissions) - 1)]
            marginal, _ = forward_backward(padded, mask, self.trans)
            out[at[mask]] = marginal[mask]
        return out.reshape(-1, k)


class Predictor:
    """Keeps each word's scores from text to text."""

    def __init__(self, tagger: Tagger) -> None:
        self.tagger, self.index = tagger, {}
        self.scores = np.empty((0, len(tagger.languages)), dtype=np.float32)

    def ids(self, words: list[list[str]]) -> np.ndarray:
        if len(self.index) > CACHE:
            self.index, self.scores = {}, self.scores[:0]
        new = set().union(*words) - self.index.keys()
        if new:
            w, lex = self.tagger.weights, self.tagger.lexicon
            add = np.array([w[word_features(x, lex)].sum(axis=0) for x in new], dtype=np.float32)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, add])
        n = sum(map(len, words))
        return np.fromiter((self.index[x] for t in words for x in t), dtype=np.int64, count=n)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Languages, scores, and how sure the words are: the average of each word's best marginal, weighted by letters."""
        langs, n = self.tagger.languages, len(texts)
        label, score, sure = ["und"] * n, [0.0] * n, [0.0] * n
        if not langs:
            return label, score, sure
        total, mean, best = np.zeros(n), np.zeros((n, len(langs))), np.zeros(n)
        which: list[int] = []
        block: list[str] = []
        size = 0
        for i, text in enumerate(texts):
            for part in parts(text or ""):
                if size + len(part) > BLOCK and block:
                    self.add(which, block, total, mean, best)
                    which, block, size = [], [], 0
                which.append(i)
                block.append(part)
                size += len(part)
        self.add(which, block, total, mean, best)
        for i in np.flatnonzero(total).tolist():
            row = mean[i] / total[i]
            label[i], score[i], sure[i] = langs[int(row.argmax())], float(min(1.0, row.max())), float(min(1.0, best[i] / total[i]))
        return label, score, sure

    def add(self, which: list[int], block: list[str], total: np.ndarray, mean: np.ndarray, best: np.ndarray) -> None:
        """Adds the letters, marginals and best marginals of a block's words to those of their texts."""
        words = [words_in(t) for t in block]
        words = [w if any(c.isalpha() for x in w for c in x) else [] for w in words]  # ½ and ² are no letters
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        if not lengths.sum():
            return
        ids = self.ids(words)  # may replace scores
        post = self.tagger.marginals(self.scores[ids], lengths)
        letters = np.fromiter((own_letters(x) for t in words for x in t), dtype=np.float32, count=len(post))
        live = np.flatnonzero(lengths)
        starts, text = (np.cumsum(lengths) - lengths)[live], np.array(which)[live]
        np.add.at(total, text, np.add.reduceat(letters, starts))
        np.add.at(mean, text, np.add.reduceat(post * letters[:, None], starts, axis=0))
        np.add.at(best, text, np.add.reduceat(post.max(axis=1) * letters, starts))


def parts(text: str) -> Iterator[str]:
    """A text, a long one in parts of about BLOCK characters that end where no letter follows."""
    at = 0
    while len(text) - at > BLOCK:
        m = BREAK.search(text, at + BLOCK)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; null ids count as empty."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def training_rows(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, words: int = 200) -> list[tuple[str, str]]:
    """At most `words` words of at most per_language texts of each language, from rows that are not held out. The first pass reads ids and
    languages only and keeps the smallest hash of each bucket; the second reads the texts of those."""
    able = df.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    h = F.xxhash64(id_col)
    chosen = able.groupBy(lang_col, F.pmod(h, F.lit(per_language)).alias("bucket")).agg(F.min(F.struct(h.alias("h"), F.col(id_col).alias("id"))).alias("x")).select("x.id")
    ids = [r["id"] for r in chosen.distinct().collect()]  # per_language x languages
    few = len(ids) <= LISTED
    texts = able.filter(F.col(id_col).isin(ids)) if few else able.join(chosen.distinct().withColumnRenamed("id", id_col), id_col, "left_semi")

    @F.pandas_udf("string")
    def some(texts: pd.Series) -> pd.Series:
        return pd.Series([" ".join(spread(LETTERS.findall((t or "").lower()), words)) for t in texts], dtype=object)

    found = texts.select(id_col, lang_col, some(text_col).alias("t")).orderBy(id_col, lang_col, "t").collect()
    return [(r["t"], r[lang_col]) for r in found]


def spread(runs: list[str], words: int, stretch: int = 16) -> list[str]:
    """At most `words` runs, in stretches at equal distances."""
    if len(runs) > words:
        n = -(-words // stretch)
        runs = [x for k in range(n) for x in runs[k * (len(runs) - stretch) // max(1, n - 1) :][:stretch]][:words]
    return [x[:RUN] for x in runs]


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 64, words: int = 200) -> DataFrame:
    """(id, lang_pred, score) for each row of df. The model is fitted at the call, the prediction is lazy."""
    return predict(df, fit(df, id_col, text_col, lang_col, per_language, words), id_col, text_col)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 64, words: int = 200) -> Tagger:
    return Tagger.fit(training_rows(df, id_col, text_col, lang_col, per_language, words), words)


def predictions(tagger: Tagger):
    """A pandas UDF from texts to struct<lang_pred, score, sure>."""

    @F.pandas_udf("lang_pred string, score double, sure double")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = Predictor(tagger)
        for texts in batches:
            label, score, sure = p.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": label, "score": score, "sure": sure})

    return tag


def predict(df: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col), predictions(tagger)(F.col(text_col)).alias("p")).select(id_col, "p.lang_pred", "p.score")


def keep_known(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.5) -> DataFrame:
    """The rows of df whose text has a language and whose words are sure of theirs with least_score on average, all columns
    unchanged. Texts that switch between languages stay, whatever the share of the leading one. Names that begin with
    two underscores are the operator's own."""
    tag = predictions(fit(df, id_col, text_col, lang_col))
    judged = df.withColumn("__p", tag(F.col(text_col)))
    return judged.filter((F.col("__p.lang_pred") != "und") & (F.col("__p.sure") >= least_score)).drop("__p")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return detect(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
