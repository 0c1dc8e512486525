"""Random forest on lesion features, with group folds, importances, and a fallback rule."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled
from . import metrics
from .selection import seeded


def weighted(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight = rows / (labels x rows of the label)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = n.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    w = n.join(total, F.lit(True)).select(label, (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("weight"))
    w = w.withColumnRenamed(label, "__label")
    return df.join(F.broadcast(w) if w.count() <= 1000 else w, df[label].eqNullSafe(w["__label"])).drop("__label")


def train_forest(df: DataFrame, features: list[str], label: str = "label", trees: int = 200, depth: int = 5, seed: int = 42) -> PipelineModel:
    """A forest on balanced weights. The model is a pipeline: features to a vector, label to an index, and back."""
    d = settled(weighted(settled(df.select(*features, label)), label))  # df is made once; d is read once for each level of the trees
    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(d)
    assemble = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="__x", labelCol="__y", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__c")
    model = forest.fit(assemble.transform(index.transform(d)))
    return PipelineModel([assemble, model, IndexToString(inputCol="__c", outputCol="y_pred", labels=index.labels)])


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with y_pred and proba, the probabilities in the alphabetical order of labels."""
    out = model.transform(df).withColumn("proba", F.slice(vector_to_array("__p"), 1, len(model.stages[-1].getLabels())))
    return out.drop("__x", "__p", "__r", "__c")


def predict_with_fallback(model: PipelineModel | None, df: DataFrame, fallback: str, features: list[str]) -> DataFrame:
    """df with predicted: the forest's label, or the column `fallback` where there is no model or a feature is null."""
    if model is None:
        return df.withColumn("predicted", F.col(fallback)).withColumn("by_model", F.lit(False))
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull()
    d = df.withColumn("__known", known)
    s = scored(model, d.fillna(0.0, features) if features else d)
    return s.withColumn("predicted", F.when(F.col("__known"), F.col("y_pred")).otherwise(F.col(fallback))).withColumn("by_model", F.col("__known")).drop("__known", "proba", "y_pred")


def surface_scores(model: PipelineModel, df: DataFrame, surfaces: tuple[str, ...]) -> DataFrame:
    """df with scores, the forest's probabilities of the given labels, in their order and with sum 1 (null if it knows none of
    them or they are all 0), and best, the first of the likeliest."""
    known = model.stages[-1].getLabels()
    asked = [(x, known.index(x)) for x in surfaces if x in known]
    d = scored(model, df)
    if not asked:
        return d.withColumn("scores", F.lit(None).cast("array<double>")).withColumn("best", F.lit(None).cast("string")).drop("proba", "y_pred")
    p = F.array(*(F.col("proba")[i] if (i := dict(asked).get(x)) is not None else F.lit(0.0) for x in surfaces))
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    d = d.withColumn("scores", p).withColumn("scores", F.when(total > 0, F.transform("scores", lambda x: x / total)))
    best = F.array(*map(F.lit, surfaces))[F.array_position("scores", F.array_max("scores")).cast("int") - 1]
    return d.withColumn("best", F.when(F.col("scores").isNotNull(), best)).drop("proba", "y_pred")


def importances(model: PipelineModel, df_features: list[str]) -> list[tuple[str, float]]:
    """Impurity importance of each feature, largest first."""
    values = model.stages[1].featureImportances.toArray()
    return sorted(zip(df_features, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))


#: Ranges of hashes that ranks are counted in: so many leading hexadecimal digits.
DIGITS = 3


def _ranked(df: DataFrame, order: Column, by: list[str], name: str) -> DataFrame:
    """Adds the row's rank in the order, from 1, within by. Ranks come from counts of hash ranges, so no task sorts all rows."""
    d = df.withColumn("__h", order).withColumn("__range", F.substring("__h", 1, DIGITS))
    counts = d.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # 16 ** DIGITS rows
    start = counts.select(*by, "__range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*by, "__range").orderBy("__h", "__row"))
    return d.withColumn("__own", own).join(start, [*by, "__range"]).withColumn(name, F.col("__before") + F.col("__own")).drop("__h", "__range", "__before", "__own")


def _rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(__row, columns): rows named by their key and, where a key repeats or is null, their place among its rows."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*columns))
    return df.select(F.struct(F.col(key).cast("string").alias("key"), place.alias("n")).alias("__row"), *columns)


def dealt(df: DataFrame, columns: list[str], key: str, seeds: list[int]) -> DataFrame:
    """(seed, __row, columns, given): for each seed every row once, with the columns of the row whose values it is dealt.

    Ranks in two hash orders are joined once for all seeds.
    """
    rows = _rows(df, key, columns)
    name = F.concat(F.coalesce("__row.key", F.lit("")), F.when(F.col("__row.n") > 1, F.concat(F.lit("#"), "__row.n")).otherwise(""))
    each = rows.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    hashed = lambda side: F.md5(F.concat(F.col("seed").cast("string"), F.lit(f":{side}:"), name))
    to = _ranked(each, hashed("to"), ["seed"], "__rank")
    giving = _ranked(each, hashed("from"), ["seed"], "__rank").select("seed", "__rank", F.struct(*columns).alias("given"))
    return to.join(giving, ["seed", "__rank"]).drop("__rank")


def permuted(df: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """df with the column's values dealt anew, all other columns as they are. Repeated and null keys keep their rows."""
    others = [c for c in df.columns if c != column]
    d = dealt(df.withColumn("__key", F.col(key)), [column, *others], "__key", [seed])
    return d.select(*others, F.col("given")[column].alias(column)).select(*df.columns)


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], key: str, label: str = "label", repeats: int = 30) -> DataFrame:
    """(feature, mean, std): the loss of accuracy when a feature is permuted.

    All repeats of all features are one table: each row meets the row whose values it is dealt once for a repeat, and is then
    stacked, once for each feature with that feature's value replaced, and once as it is. The forest scores the stack in one job.
    """
    d = dealt(df, [*features, label], key, list(range(repeats)))
    one = lambda f: F.struct(F.lit(f).alias("feature"), *((F.col("given")[x] if x == f else F.col(x)).alias(x) for x in features))
    stack = d.select("seed", label, F.inline(F.array(*map(one, features))))
    hit = F.avg((F.col(label) == F.col("y_pred")).cast("int"))
    base = scored(model, df.select(*features, label)).agg(hit.alias("base"))
    runs = scored(model, stack).groupBy("feature", "seed").agg(hit.alias("accuracy"))
    drop = (F.col("base") - F.col("accuracy")).alias("drop")
    return runs.join(base, F.lit(True)).select("feature", drop).groupBy("feature").agg(F.avg("drop").alias("mean"), F.stddev_pop("drop").alias("std"))  # base is one row


#: Different group sizes that with_folds() takes; n rows have at most the root of 2 n of them.
MOST_SIZES = 2_000_000


def quotas(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, int, int, int]]:
    """(size, fold, first, last): which ranks among the groups of a size go to a fold. sizes: (size, groups).

    Larger groups are dealt first, each to the fold with fewest rows: folds that lag behind the fullest one catch up, and what
    remains is dealt in turn, the emptiest first. So two folds never differ by more than the largest group.
    """
    load, out = [0] * folds, []
    for size, left in sorted(sizes, reverse=True):
        given, most = [0] * folds, max(load)
        order = sorted(range(folds), key=lambda k: (load[k], k))
        for k in order:
            given[k] = min(left, (most - load[k]) // size)
            left -= given[k]
        order = sorted(range(folds), key=lambda k: (load[k] + given[k] * size, k))
        for i, k in enumerate(order):
            given[k] += left // folds + (i < left % folds)
        first = 1
        for k in range(folds):
            if given[k]:
                out.append((size, k, first, first + given[k] - 1))
                first += given[k]
            load[k] += given[k] * size
    return out


def with_folds(df: DataFrame, group: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold: whole groups (a null group, too), so that folds have nearly equal numbers of rows.

    Only the table of sizes passes the driver (see MOST_SIZES); among groups of one size the hash order decides.
    """
    g = df.groupBy(F.col(group).alias("__row")).agg(F.count(F.lit(1)).alias("__size"))
    counts = g.groupBy("__size").agg(F.count(F.lit(1)).alias("n")).limit(MOST_SIZES + 1).collect()
    if len(counts) > MOST_SIZES:
        raise ValueError(f"with_folds: more than {MOST_SIZES} different sizes of groups")
    plan = df.sparkSession.createDataFrame(quotas([(r["__size"], r["n"]) for r in counts], folds), "__size long, fold int, __first long, __last long")
    order = F.coalesce(seeded(F.col("__row"), seed), F.lit("000"))
    ranked = _ranked(g, order, ["__size"], "__rank").join(F.broadcast(plan) if len(counts) * folds <= 100_000 else plan, "__size")
    named = ranked.filter(F.col("__rank").between(F.col("__first"), F.col("__last"))).select(F.col("__row").alias("__group"), "fold")
    return df.join(named, df[group].eqNullSafe(named["__group"])).drop("__group")


def cross_predictions(df: DataFrame, features: list[str], group: str, folds: int = 5, label: str = "label", **options) -> DataFrame:
    """(fold, label, y_pred): each fold as a forest of the others sees it."""
    d, out = settled(with_folds(df, group, folds)), None
    for k in range(folds):
        model = train_forest(d.filter(F.col("fold") != k), features, label, **options)
        one = scored(model, d.filter(F.col("fold") == k)).select("fold", label, "y_pred")
        out = one if out is None else out.unionByName(one)
    return out


def cross_validated(df: DataFrame, features: list[str], group: str, folds: int = 5, label: str = "label", **options) -> DataFrame:
    """(fold, accuracy, macro_precision, macro_recall, macro_f1)."""
    return metrics.macro(cross_predictions(df, features, group, folds, label, **options), by=["fold"], true=label, pred="y_pred")


def cross_validation(df: DataFrame, features: list[str], group: str, folds: int = 5, label: str = "label", **options) -> tuple[DataFrame, DataFrame]:
    """Figures of each fold, with its number of rows, and of each fold and class: (fold, label, precision, recall, f1, support)."""
    seen = settled(cross_predictions(df, features, group, folds, label, **options))
    sizes = seen.groupBy("fold").agg(F.count(F.lit(1)).alias("test_size"))
    by_fold = metrics.macro(seen, by=["fold"], true=label, pred="y_pred").join(sizes, "fold")
    by_class = metrics.per_label(seen, true=label, pred="y_pred", by=["fold"])
    return by_fold, by_class.select("fold", "label", "precision", "recall", "f1", "support")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
