"""Splits without leakage, preparation, and models of events, on pyspark.ml."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators import dataset
from emberline.operators.medians import medians
from emberline.operators.numbering import numbered
from emberline.session import stored

SEED = 42
#: Numeric and boolean columns that a model may see: no ids, times, coordinates or outputs of rules.
FEATURES = [c for c in dataset.COLUMNS if dataset.kind(c) in ("double", "bigint", "boolean") and c not in ("centroid_latitude", "centroid_longitude", "persistence_score")]


def group_split(events: DataFrame, groups: DataFrame, shares: tuple[float, float] = (0.6, 0.2), seed: int = SEED, facility: str | None = None) -> DataFrame:
    """``events`` (component, ...) with split: a group goes to train, validation or test as a whole, in the order of a seeded hash of its name, so that
    each split has its share of the groups, and at least one. At least three groups are needed.

    ``facility``: a column that names each event's facility, and must do so for every event.
    """
    if facility is not None and not events.filter(F.trim(F.coalesce(F.col(facility).cast("string"), F.lit(""))) == "").isEmpty():
        raise ValueError("a split by facilities needs the facility of every event")
    names = events.join(groups, "component").select("group").distinct()
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col("group").cast("string")))
    ranked = stored(numbered(names.withColumn("_h", order), [F.col("_h"), F.col("group")], "_rank"), "groups")
    n = ranked.count()
    if n < 3:
        raise ValueError(f"{n} independent groups; three are needed")
    first = min(n - 2, max(1, int(n * shares[0])))
    second = min(n - 1, max(first + 1, int(n * sum(shares))))
    split = F.when(F.col("_rank") <= first, "train").when(F.col("_rank") <= second, "validation").otherwise("test")
    return events.join(groups, "component").join(ranked.select("group", split.alias("split")), "group").drop("group")


def temporal_split(events: DataFrame, groups: DataFrame, first: int, second: int, purge: int) -> DataFrame:
    """``events`` (component, start_us, end_us, ...) with split: before ``first``, between and after ``second``, without what starts within
    ``purge`` of a cut; groups that touch several of these, the part left out included, are left out."""
    if first >= second:
        raise ValueError("the cuts must be in order")
    side = (
        F.when(F.col("end_us") < first, "train")
        .when((F.col("start_us") >= first + purge) & (F.col("end_us") < second), "validation")
        .when(F.col("start_us") >= second + purge, "test")
        .otherwise("excluded")
    )
    rows = events.join(groups, "component").withColumn("side", side)
    mixed = rows.groupBy("group").agg((F.count_distinct("side") > 1).alias("mixed"))
    return rows.join(mixed, "group").withColumn("split", F.when(F.col("mixed"), "excluded").otherwise(F.col("side"))).drop("group", "side", "mixed")


def usable_features(rows: DataFrame) -> DataFrame:
    """(feature, n): the features that are known at least once in the training split, and how often."""
    counts = rows.filter("split = 'train'").agg(*[F.count(c).alias(c) for c in FEATURES])
    each = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in FEATURES])).alias("x")).select("x.*")
    return each.filter("n > 0")


def prepared(rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with each feature filled by its median and scaled to mean 0 and deviation 1, both of the training split, and with
    ``<feature>_missing`` beside it."""
    train = rows.filter("split = 'train'").select(*[F.col(c).cast("double").alias(c) for c in features])
    median = medians(train, features)
    filled = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(median[c]))
    moments = train.agg(*[F.avg(filled(c)).alias(f"m_{c}") for c in features], *[F.stddev_pop(filled(c)).alias(f"s_{c}") for c in features]).first()
    columns = {}
    for c in features:
        columns[f"{c}_missing"] = F.col(c).isNull().cast("double")
        columns[c] = (filled(c) - F.lit(moments[f"m_{c}"])) / F.lit(moments[f"s_{c}"] or 1.0)
    return rows.withColumns(columns)


def readiness(rows: DataFrame, least: int) -> DataFrame:
    """(split, label, n, enough)."""
    return rows.groupBy("split", "label").agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= least)


@dataclass
class Parts:
    """The splits as (event_id, label, y, weight, inputs): labels of the training split in order, each row's number among them (rows of other labels have
    -1: no model can name them), weights that give every label the same sum, and two inputs a feature, its value and whether it was missing."""

    labels: list[str]
    features: list[str]
    train: DataFrame
    validation: DataFrame
    test: DataFrame


def parts(rows: DataFrame, features: list[str]) -> Parts:
    ready = prepared(rows, features)
    inputs = F.array(*[F.col(x) for c in features for x in (c, f"{c}_missing")])
    counts = {r.label: r.n for r in rows.filter("split = 'train' and label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}  # a handful of classes
    labels = sorted(counts)
    if len(labels) < 2:
        raise ValueError("two labels at least must occur in the training split")
    total = sum(counts.values())
    y = F.coalesce(F.create_map(*[F.lit(x) for k, c in enumerate(labels) for x in (c, float(k))])[F.col("label")], F.lit(-1.0))
    weight = F.create_map(*[F.lit(x) for c in labels for x in (c, total / (len(labels) * counts[c]))])[F.col("label")]
    ready = stored(ready.filter("label is not null").select("event_id", "label", "split", y.alias("y"), F.coalesce(weight, F.lit(1.0)).alias("weight"), inputs.alias("inputs")), "prepared")
    return Parts(labels, features, *[ready.filter(F.col("split") == s).drop("split") for s in ("train", "validation", "test")])


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("x", array_to_vector("inputs"))


@dataclass
class Model:
    """A fitted model of K labels; ``predicted`` adds the array ``probabilities`` and ``prediction``, the number of the likeliest label (ties: the first)."""

    fitted: list

    def predicted(self, rows: DataFrame) -> DataFrame:
        keep = rows.columns
        rows = _vectors(rows)
        if len(self.fitted) == 1:
            given = vector_to_array("probability")
            rows = self.fitted[0].transform(rows).select(*keep, given.alias("probabilities"))
        else:
            for k, one in enumerate(self.fitted):
                rows = one.transform(rows).withColumn(f"_p{k}", vector_to_array("probability")[1]).select(*keep, "x", *[f"_p{j}" for j in range(k + 1)])
            scores = F.array(*[f"_p{k}" for k in range(len(self.fitted))])
            whole = F.aggregate(scores, F.lit(0.0), lambda a, b: a + b)
            even = F.array_repeat(F.lit(1.0 / len(self.fitted)), len(self.fitted))
            rows = rows.select(*keep, F.when(whole > 0, F.transform(scores, lambda p: p / whole)).otherwise(even).alias("probabilities"))
        return rows.withColumn("prediction", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("double"))


_COLUMNS = {"featuresCol": "x", "labelCol": "y", "weightCol": "weight"}


def logistic(train: DataFrame) -> Model:
    return Model([LogisticRegression(maxIter=60, regParam=0.01, family="multinomial", **_COLUMNS).fit(_vectors(train))])


def forest(train: DataFrame) -> Model:
    return Model([RandomForestClassifier(numTrees=30, maxDepth=5, seed=SEED, **_COLUMNS).fit(_vectors(train))])


def boosted(train: DataFrame, rounds: int = 20, depth: int = 4) -> Model:
    """A boosted ensemble of trees for each label against the rest, on rows weighted alike; their probabilities are scaled to a sum of 1."""
    one = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=SEED, **_COLUMNS)
    fitted = OneVsRest(classifier=one, parallelism=4, **_COLUMNS).fit(_vectors(train))
    return Model(list(fitted.models))


MODELS = {"gradient_boosting": boosted, "logistic_regression": logistic, "random_forest": forest}


def label_scores(rows: DataFrame, n_labels: int) -> DataFrame:
    """(y, precision, recall, f1, support) of each label number from 0 on, from (y, prediction): 0 where there is nothing to divide by. A label that is
    never true, or never predicted, still counts."""
    counts = rows.groupBy("y", "prediction").agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.col("y").alias("of"), F.lit(1).alias("true")), F.struct(F.col("prediction").alias("of"), F.lit(0).alias("true")))).alias("s")
    each = counts.select("y", "prediction", "n", sides).groupBy(F.col("s.of").alias("y")).agg(
        F.sum(F.when(F.col("s.true") == 1, F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("s.true") == 0, F.col("n")).otherwise(0)).alias("p"),
        F.sum(F.when((F.col("s.true") == 1) & (F.col("y") == F.col("prediction")), F.col("n")).otherwise(0)).alias("hit"),
    )
    all_ = rows.sparkSession.range(n_labels).select(F.col("id").cast("double").alias("y"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    ratio = lambda a, b: F.when(zero(b) == 0, 0.0).otherwise(zero(a) / b)
    return all_.join(each, "y", "left").select("y", ratio(F.col("hit"), F.col("p")).alias("precision"), ratio(F.col("hit"), F.col("t")).alias("recall"), ratio(2 * F.col("hit"), F.col("p") + F.col("t")).alias("f1"), zero(F.col("t")).alias("support"))


def macro_f1(rows: DataFrame, n_labels: int) -> float:
    """The mean of all labels' F1."""
    return label_scores(rows, n_labels).agg(F.avg("f1")).first()[0] or 0.0


def select_model(rows: DataFrame, features: list[str], models: dict = MODELS) -> tuple[DataFrame, Model, Parts]:
    """((model, validation_macro_f1, selected, test_accuracy, test_macro_f1), the model selected, the splits). The best macro F1 on the validation split
    is selected (ties: the first name); the test split is looked at once, with it."""
    split = parts(rows, features)
    fitted = {name: fit(split.train) for name, fit in sorted(models.items())}
    scores = {name: macro_f1(model.predicted(split.validation), len(split.labels)) for name, model in fitted.items()}
    best = max(scores, key=lambda name: scores[name])
    test = stored(fitted[best].predicted(split.test).select("y", "prediction"), "tested")
    accuracy = test.agg(F.avg((F.col("y") == F.col("prediction")).cast("double"))).first()[0]
    result = accuracy, macro_f1(test, len(split.labels))
    lines = [(name, float(score), name == best, *(result if name == best else (None, None))) for name, score in scores.items()]
    schema = "model string, validation_macro_f1 double, selected boolean, test_accuracy double, test_macro_f1 double"
    return rows.sparkSession.createDataFrame(lines, schema), fitted[best], split


def _dealt(rows: DataFrame, repeats: int, slot_rows: int) -> DataFrame:
    """Rows with ``repeat`` and ``other``, the inputs of another row: for each repeat a permutation of the rows, made by ranking them by two hashes within
    slots of about ``slot_rows``, so that no task ranks all."""
    slots = max(1, rows.count() // slot_rows)
    each = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    each = each.withColumn("slot", F.pmod(F.xxhash64(F.lit("slot"), "repeat", "event_id"), F.lit(slots)))
    ranked = lambda seed: F.row_number().over(Window.partitionBy("repeat", "slot").orderBy(F.xxhash64(F.lit(seed), "repeat", "event_id"), "event_id"))
    givers = each.select("repeat", "slot", ranked("giver").alias("place"), F.col("inputs").alias("other"))
    return each.withColumn("place", ranked("taker")).join(givers, ["repeat", "slot", "place"]).drop("slot", "place")


def permutation_importance(split: Parts, model: Model, repeats: int = 5, slot_rows: int = 50_000) -> DataFrame:
    """(feature, mean, std) of the loss of macro F1 on the validation split when a feature's values (and whether they are missing) are dealt anew among its
    rows. All features and repeats are one job over the rows' copies."""
    n_labels = len(split.labels)
    whole = macro_f1(model.predicted(split.validation), n_labels)
    dealt = _dealt(split.validation, repeats, slot_rows).withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(len(split.features) - 1))))
    swapped: Column = F.zip_with(F.arrays_zip("inputs", F.sequence(F.lit(0), F.lit(2 * len(split.features) - 1)).alias("k")), "other", lambda a, b: F.when(F.floor(a["k"] / 2) == F.col("feature"), b).otherwise(a["inputs"]))
    said = model.predicted(dealt.withColumn("inputs", swapped).select("event_id", "y", "repeat", "feature", "inputs"))
    counts = said.groupBy("feature", "repeat", "y", "prediction").agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.col("y").alias("of"), F.col("n").alias("t")), F.struct(F.col("prediction").alias("of"), F.lit(0).cast("long").alias("t")))).alias("s")
    hit = F.when((F.col("y") == F.col("prediction")) & (F.col("s.t") > 0), F.col("n")).otherwise(0)
    seen = F.when(F.col("s.t") > 0, F.col("s.t")).otherwise(F.col("n"))  # as true, and once more as predicted
    f1 = counts.select("feature", "repeat", "y", "prediction", "n", sides).filter(F.col("s.of") >= 0).groupBy("feature", "repeat", "s.of").agg((2.0 * F.sum(hit) / F.sum(seen)).alias("f1"))
    loss = f1.groupBy("feature", "repeat").agg((F.lit(whole) - F.sum("f1") / n_labels).alias("loss"))
    named = F.element_at(F.array(*map(F.lit, split.features)), F.col("feature") + 1)
    return loss.groupBy("feature").agg(F.avg("loss").alias("mean"), F.stddev_pop("loss").alias("std")).select(named.alias("feature"), "mean", "std")
