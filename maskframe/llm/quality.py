"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

Base rules are fixed. On top, five measures (share of symbols, upper-case letters, bangs, repeated lines, repeated
words) each get a cutoff for each stratum (language). Documents labelled good are the holdout: a cutoff is certified
if the exact binomial tail P(Bin(n, risk) <= k) for its k false rejections among n good documents is at most
delta / (rules x (strata + 1)) (Bonferroni), and if all laxer cutoffs of the grid are certified too (fixed-sequence test, which
needs no further correction). So with probability 1 - delta every stratum loses at most rules x risk of its good
documents. Strata with too few good holdouts to certify anything are pooled and tested as one more stratum, whose bound
then holds for them together. Of the certified cutoffs, that with most bad documents rejected is used, the laxest on ties; without a
certified cutoff a rule stays silent in that stratum. At every size the tail is summed downwards from its largest term, and
a geometric series bounds what is left after EXACT_TERMS terms (nothing, with fewer false rejections).

Edge cases: null texts are empty and fail the base rules; null strata form one stratum; several labels of one
document count once, as good if one of them is good; without labels only base rules act, also in a stratum that has none; equal rows get equal results; very long texts cost n log n
steps; an empty table gives an empty result; further columns are carried along, also those named words, lines or stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, text_of, words_of

SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "upper", "bangs", "dup_lines", "repeats")
#: From lax to strict.
CUTOFFS = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)
EXACT_TERMS = 100_000
#: A thresholds table of at most so many strata is broadcast.
BROADCAST_STRATA = 10_000


def repeat_features(df: DataFrame, words: str = "words") -> DataFrame:
    """Adds n_repeat_words: words covered by 3-word windows that occur at least twice in the row's own array of words.

    Each window becomes a struct of its 64-bit hash and its position, so one sort brings equal windows together; neighbours
    with equal hashes are compared word by word. n log n steps for a text of n words.
    """
    n = F.size(words)
    key = lambda x, i: F.struct(F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p"))
    w = df.withColumn("__keys", F.when(n >= 3, F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(1))), key)).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")))
    w = w.withColumn("__sorted", F.sort_array("__keys"))

    def same(x: Column, y: Column) -> Column:
        p, q = x["p"], y["p"]
        return (x["h"] == y["h"]) & (F.get(words, p) == F.get(words, q)) & (F.get(words, p + 1) == F.get(words, q + 1)) & (F.get(words, p + 2) == F.get(words, q + 2))

    found = F.transform("__sorted", lambda x, i: F.when(F.coalesce(same(x, F.get("__sorted", i + 1)), F.lit(False)) | ((i > 0) & F.coalesce(same(x, F.get("__sorted", i - 1)), F.lit(False))), x["p"].cast("bigint")))
    w = w.withColumn("__at", F.sort_array(F.filter(found, lambda x: x.isNotNull())))
    covered = F.aggregate("__at", F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n")), lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])
    return w.withColumn("n_repeat_words", covered).drop("__keys", "__sorted", "__at")


def features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base counts and the five measures, which replace columns of their names; all others stay."""
    t = text_of(text_col)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = df.withColumn("__words", words_of(text_col)).withColumn("__lines", lines)
    d = repeat_features(d, "__words")
    d = d.withColumn("n_words", F.size("__words").cast("long")).withColumn("word_chars", F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    d = d.withColumn("symbols", F.col("n_symbols") / chars).withColumn("upper", F.length(F.regexp_replace(t, r"\P{Lu}+", "")) / chars)
    d = d.withColumn("bangs", (F.length(t) - F.length(F.translate(t, "!", ""))) / chars)
    d = d.withColumn("dup_lines", F.col("n_dup_lines") / F.greatest(F.size("__lines"), F.lit(1))).withColumn("repeats", F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)))
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("__words", "__lines")


def log_factorial(n: Column) -> Column:
    """log(n!) by Stirling's series at n + 8, less the factors between; right to 12 digits from n = 0 on."""
    x = n.cast("double") + 8
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    for i in range(1, 9):
        series = series - F.log(n + F.lit(i))
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed downwards from its largest term; 1 where k is not below its mean."""
    largest = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    ratio = lambda j: j * (1 - p) / ((n - j + 1) * p)  # noqa: E731  of the term of j - 1 to that of j
    down = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), F.least(k, F.lit(EXACT_TERMS)).cast("bigint")),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * ratio(k - i)).alias("term"), (a["sum"] + a["term"]).alias("sum")),
        # the rest falls faster than this geometric series; its first term is 0 where all terms were summed
        lambda a: a["sum"] + a["term"] / (1 - ratio(F.greatest(k - EXACT_TERMS, F.lit(0)))),
    )
    return F.when((n <= 0) | (k >= n * p), F.lit(1.0)).otherwise(F.least(largest * down, F.lit(1.0)))


def thresholds(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, symbols, upper, ...): the cutoff of each rule, null where the rule is silent.

    measured: features(); labels: (id_col, good boolean). risk bounds one rule's false rejections.
    """
    once = labels.filter(F.col("good").isNotNull()).groupBy(id_col).agg(F.max("good").alias("good"))
    held = measured.filter(~F.col("base_failed")).select(id_col, F.col(stratum).alias("stratum"), *RULES).join(once, id_col)
    counts = held.groupBy("stratum").agg(
        F.count_if("good").alias("n"),
        *(F.count_if(F.col("good") & (F.col(r) > c)).alias(f"k_{r}_{i}") for r in RULES for i, c in enumerate(CUTOFFS)),
        *(F.count_if(~F.col("good") & (F.col(r) > c)).alias(f"b_{r}_{i}") for r in RULES for i, c in enumerate(CUTOFFS)),
    )
    counts = counts.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy()) + 1)
    enough = F.ceil(F.log(F.lit(delta / len(RULES)) / F.col("strata")) / math.log1p(-risk))
    counts = counts.withColumn("pooled", F.col("n") < enough)
    named = counts.select("stratum", "pooled", F.when(~F.col("pooled"), F.col("stratum")).alias("own"))
    sums = [x for x in counts.columns if x == "n" or x[:2] in ("k_", "b_")]
    counts = counts.groupBy("pooled", F.when(~F.col("pooled"), F.col("stratum")).alias("own")).agg(F.max("strata").alias("strata"), *(F.sum(x).alias(x) for x in sums))
    cells = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"k_{r}_{i}").alias("k"), F.col(f"b_{r}_{i}").alias("bad")) for r in RULES for i, c in enumerate(CUTOFFS))))
    tests = counts.select("pooled", "own", "n", "strata", cells.alias("c")).select("pooled", "own", "n", "strata", "c.*")
    tests = tests.withColumn("p", binomial_tail(F.col("k"), F.col("n"), risk))
    down = Window.partitionBy("pooled", "own", "rule").orderBy(F.desc("cutoff"))
    passed = tests.withColumn("worst", F.max("p").over(down)).filter(F.col("worst") <= F.lit(delta / len(RULES)) / F.col("strata"))
    best = passed.groupBy("pooled", "own", "rule").agg(F.max_by("cutoff", F.struct("bad", "cutoff")).alias("cutoff"))
    wide = best.groupBy(F.col("pooled").alias("__pooled"), F.col("own").alias("__own")).agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RULES))
    return named.join(wide, (F.col("pooled") == F.col("__pooled")) & F.col("own").eqNullSafe(F.col("__own"))).select("stratum", *(f"max_{r}" for r in RULES))


def judge(measured: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds kept: false if base_failed or if a measure is above its stratum's cutoff."""
    cuts = stored(cuts.withColumnRenamed("stratum", "__stratum"), "cutoffs")
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_STRATA else cuts
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False))
    return measured.join(cuts, measured[stratum].eqNullSafe(cuts["__stratum"]), "left").withColumn("kept", ~F.col("base_failed") & ~over).drop("__stratum", *(f"max_{r}" for r in RULES))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", **options) -> DataFrame:
    """Counts, measures, base_failed and kept for every row of docs. The measures, a few numbers for each document, are
    stored once, as both the calibration and the verdict read them."""
    slim = features(docs.select(F.col(id_col), F.col(text_col), F.col(stratum)), text_col).drop(text_col)
    measured = stored(slim, "quality")
    return judge(measured, thresholds(measured, labels, id_col, stratum, **options), stratum)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    return quality_rules(table(spark, sf_dir, "documents"), labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
