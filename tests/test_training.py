"""Splits, preparation, models, explanations of models and anomaly scores against plain Python; checks of the typed table on broken ones."""

import math
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from emberline.operators import anomaly, dataset, training
from emberline.operators.medians import medians
from emberline.operators.metrics import average_precision, class_summary, each_class, precision_recall, roc
from emberline.operators.numbering import numbered, running
from pyspark.sql import functions as F


def test_medians(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, rng.gauss(0, 1)]), rng.choice([0, 1, 1, 7, None]), rng.random() < 0.3, None, float(k)) for k in range(4001)]
    df = spark.createDataFrame(rows, "a double, b long, c boolean, d double, e double").repartition(5)
    want = {c: (float(np.median([r[k] for r in rows if r[k] is not None])) if any(r[k] is not None for r in rows) else None) for k, c in enumerate("abcde")}
    assert medians(df, list("abcde")) == pytest.approx({c: v for c, v in want.items() if v is not None} | {"d": None}) and medians(df.limit(0), ["a"]) == {"a": None} and medians(df, []) == {}


def test_numbers_and_running_sums(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice("xyz"), rng.randrange(50), rng.randrange(9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, v long, w long").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.number for r in numbered(df, [F.desc("v"), F.col("id")]).collect()}
        assert got == {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
        sums = {r.id: r.s for r in running(df, [F.col("v"), F.col("id")], {"s": F.col("w")}, ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    total, want = Counter(), {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        total[r[1]] += r[3]
        want[r[0]] = total[r[1]]
    assert sums == want and numbered(df.limit(0), [F.col("id")]).count() == 0


def test_group_split(spark):
    events = spark.createDataFrame([(k, f"f{k % 9}") for k in range(200)], "component long, facility string")
    groups = events.select("component", F.pmod("component", F.lit(20)).alias("group"))
    rows = training.group_split(events, groups).join(groups, "component").collect()
    sides = {r.group: r.split for r in rows}
    assert len(rows) == 200 and all(sides[r.group] == r.split for r in rows) and Counter(sides.values()) == {"train": 12, "validation": 4, "test": 4}
    three = training.group_split(events, events.select("component", F.pmod("component", F.lit(3)).alias("group")))
    assert {r.split for r in three.select("split").distinct().collect()} == {"train", "validation", "test"}
    with pytest.raises(ValueError, match="three"):
        training.group_split(events, events.select("component", F.pmod("component", F.lit(2)).alias("group")))
    assert training.group_split(events, groups, facility="facility").count() == 200
    with pytest.raises(ValueError, match="facility"):
        training.group_split(events.withColumn("facility", F.when(F.col("component") != 7, F.col("facility"))), groups, facility="facility")


def test_temporal_split(spark):
    rows = [(1, 0, 5), (2, 8, 12), (3, 13, 18), (4, 11, 15), (5, 25, 30), (6, 1, 2), (7, 26, 27)]
    events = spark.createDataFrame(rows, "component long, start_us long, end_us long")
    groups = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 6)], "component long, group long")
    got = {r.component: r.split for r in training.temporal_split(events, groups, 10, 20, 2).collect()}
    assert got == {1: "train", 2: "excluded", 3: "validation", 4: "excluded", 5: "test", 6: "excluded", 7: "excluded"}
    with pytest.raises(ValueError):
        training.temporal_split(events, groups, 20, 20, 2)


def events_of(spark, n=600, seed=1):
    """Three labels, the rare one decided by the product of two features; a third feature is noise, and values are missing."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x, y, z = rng.uniform(-1, 1), rng.uniform(-1, 1), rng.gauss(0, 1)
        label = "rare" if x > 0.7 and y > 0.3 else "a" if x * y > 0 else "b"
        rows.append((f"e{k}", ("train", "train", "train", "validation", "test")[k % 5], label, x, y if rng.random() > 0.03 else None, z))
    return spark.createDataFrame(rows, "event_id string, split string, label string, x double, y double, z double"), rows


def test_prepared(spark):
    df, rows = events_of(spark, 300)
    got = {r.event_id: r for r in training.prepared(df, ["x", "y"]).collect()}
    train = [r for r in rows if r[1] == "train"]
    for k, c in ((3, "x"), (4, "y")):
        median = float(np.median([r[k] for r in train if r[k] is not None]))
        full = np.array([median if r[k] is None else r[k] for r in train])
        for r in rows:
            value = ((median if r[k] is None else r[k]) - full.mean()) / full.std()
            assert got[r[0]][c] == pytest.approx(value) and got[r[0]][f"{c}_missing"] == (r[k] is None)


def plain_f1(pairs, n):
    out = []
    for k in range(n):
        hit, said, true = sum(a == b == k for a, b in pairs), sum(b == k for _, b in pairs), sum(a == k for a, _ in pairs)
        out.append(2 * hit / (said + true) if said + true else 0.0)
    return out


def test_label_scores(spark):
    pairs = [(0, 0), (0, 2), (1, 1), (1, 0), (0, 0), (-1, 1)]  # 2 is only predicted, 3 neither; -1 is a label that no model knows
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "y double, prediction double")
    got = {int(r.y): (r.precision, r.recall, r.f1, r.support) for r in training.label_scores(df, 4).collect()}
    assert [got[k][2] for k in range(4)] == pytest.approx(plain_f1(pairs, 4)) and got[2] == (0.0, 0.0, 0.0, 0) and got[0][:2] == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert training.macro_f1(df, 4) == pytest.approx(sum(plain_f1(pairs, 4)) / 4)


@pytest.fixture(scope="module")
def fitted(spark):
    df, _ = events_of(spark, 900)
    split = training.parts(df, ["x", "y", "z"])
    return df, split, training.boosted(split.train)


def test_weights_and_boosted_model(fitted):
    _, split, model = fitted
    sums = {r.label: r.w for r in split.train.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert split.labels == ["a", "b", "rare"] and len({round(w, 6) for w in sums.values()}) == 1
    rows = model.predicted(split.test).collect()
    assert all(len(r.probabilities) == 3 and abs(sum(r.probabilities) - 1) < 1e-9 and r.prediction == int(np.argmax(r.probabilities)) for r in rows)
    assert sum(r.y == r.prediction for r in rows) / len(rows) > 0.9
    rare = [r for r in rows if r.label == "rare"]
    assert sum(r.prediction == 2 for r in rare) / len(rare) > 0.6


def test_selection(spark, fitted):
    df, split, _ = fitted
    table, model, _ = training.select_model(df, ["x", "y", "z"])
    rows = {r.model: r for r in table.collect()}
    assert set(rows) == {"gradient_boosting", "logistic_regression", "random_forest"}
    chosen = [r for r in rows.values() if r.selected]
    assert len(chosen) == 1 and chosen[0].validation_macro_f1 == max(r.validation_macro_f1 for r in rows.values()) and chosen[0].model != "logistic_regression"
    assert all(r.test_accuracy is None for r in rows.values() if not r.selected)
    said = [(r.y, r.prediction) for r in model.predicted(split.test).collect()]
    assert chosen[0].test_accuracy == pytest.approx(sum(a == b for a, b in said) / len(said)) and chosen[0].test_macro_f1 == pytest.approx(sum(plain_f1(said, 3)) / 3)
    assert chosen[0].test_macro_f1 > 0.75
    with pytest.raises(ValueError, match="two labels"):
        training.parts(df.filter("label = 'a'"), ["x"])


class Told:
    """A model that reads the label off its first two inputs."""

    def predicted(self, rows):
        x, y = F.col("inputs")[0], F.col("inputs")[2]
        return rows.withColumn("prediction", F.when(x * y > 0, 0.0).otherwise(1.0))


def test_permutation_importance(fitted):
    _, split, model = fitted
    dealt = training._dealt(split.validation, 3, 40).collect()
    for k in range(3):
        mine = [r for r in dealt if r.repeat == k]
        assert sorted(map(tuple, (r.inputs for r in mine))) == sorted(map(tuple, (r.other for r in mine))) and any(r.inputs != r.other for r in mine)
    got = {r.feature: (r.mean, r.std) for r in training.permutation_importance(split, Told(), 3, 40).collect()}
    value = lambda i: 0.0 if i[0] * i[2] > 0 else 1.0
    whole = sum(plain_f1([(r.y, value(r.inputs)) for r in dealt if r.repeat == 0], 3)) / 3
    for k, feature in enumerate(("x", "y", "z")):
        losses = []
        for repeat in range(3):
            swapped = [(r.y, value([*r.inputs[: 2 * k], *r.other[2 * k : 2 * k + 2], *r.inputs[2 * k + 2 :]])) for r in dealt if r.repeat == repeat]
            losses.append(whole - sum(plain_f1(swapped, 3)) / 3)
        assert got[feature] == (pytest.approx(np.mean(losses)), pytest.approx(np.std(losses), abs=1e-9))
    real = {r.feature: r.mean for r in training.permutation_importance(split, model, 2).collect()}
    assert min(real["x"], real["y"]) > 0.1 > abs(real["z"])


def normal_rows(n=200, seed=3):
    rng = random.Random(seed)
    return [(f"n{k}", rng.gauss(0, 1), rng.gauss(5, 2) if rng.random() > 0.05 else None, 1.0, float(rng.randrange(3))) for k in range(n)]


NORMAL = "event_id string, x double, y double, constant double, z double"


def plain_depth(tree, x):
    at = 0
    while tree[at][0] >= 0:
        f, cut, low, high, _ = tree[at]
        at = low if x[f] <= cut else high
    return tree[at][4]


def test_isolation_forest(spark):
    rows = normal_rows()
    normal = spark.createDataFrame([*rows, rows[0]], NORMAL)
    features = ["x", "y", "constant", "z"]
    model = anomaly.isolation_forest(normal, features, trees=40, sample=64)
    assert len(model.trees) == 40 and model.sample == 64 and max(len(t) for t in model.trees) < 128
    asked = [*rows[:50], ("far", 9.0, -30.0, 4.0, 0.0), ("near", 0.0, 5.0, 1.0, 1.0), ("empty", None, None, None, None)]
    got = {r.event_id: r.score for r in spark.createDataFrame(asked, NORMAL).select("event_id", model.score().alias("score")).collect()}
    for r in asked:
        x = [model.known[c] if v is None else v for c, v in zip(features, r[1:], strict=True)]
        mean = np.mean([plain_depth(t, x) for t in model.trees])
        assert got[r[0]] == pytest.approx(2 ** (-mean / anomaly.average_path(64)) - 0.5)
    assert got["far"] > 0.1 > got["near"] and got["far"] == max(got.values())
    again = anomaly.isolation_forest(normal.repartition(7), features, trees=40, sample=64)
    assert again.trees == model.trees


def test_a_tree_isolates():
    x = np.random.default_rng(0).normal(size=(50, 3))
    tree = anomaly.grow(x, 5)
    leaves = Counter()
    for row in x:
        leaves[plain_depth(tree, row)] += 1
    assert sum(leaves.values()) == 50 and sum(n[0] < 0 for n in tree) == sum(n[0] >= 0 for n in tree) + 1
    assert anomaly.grow(np.ones((9, 2)), 1) == [(-1, 0.0, 0, 0, anomaly.average_path(9))]
    assert anomaly.average_path(1) == 0 and anomaly.average_path(2) == 1 and anomaly.average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_anomaly_needs_reviews(spark):
    few = spark.createDataFrame(normal_rows(29) + normal_rows(29), NORMAL)
    for fit in (anomaly.isolation_forest, anomaly.ellipsoid):
        with pytest.raises(ValueError, match="29 reviewed"):
            fit(few, ["x"])
        with pytest.raises(ValueError, match="features"):
            fit(spark.createDataFrame(normal_rows(), NORMAL), [])


def test_ellipsoid(spark):
    rows = normal_rows()
    normal = spark.createDataFrame(rows, NORMAL).withColumn("twice", 2 * F.col("x"))
    model = anomaly.ellipsoid(normal, ["x", "y", "constant", "twice"])
    m = np.array([[r[1], model.known["y"] if r[2] is None else r[2]] for r in rows])
    inverse, mean = np.linalg.inv(np.cov(m.T)), m.mean(axis=0)
    got = {r.event_id: (r.d, r.s) for r in normal.select("event_id", model.distance().alias("d"), model.score().alias("s")).collect()}
    want = {r[0]: math.sqrt((v - mean) @ inverse @ (v - mean)) for r, v in zip(rows, m, strict=True)}
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want, abs=1e-8)
    assert 2 <= sum(s > 0 for _, s in got.values()) <= 12


def test_curves(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice([0.1, 0.2, 0.2, 0.7, 0.9, rng.random()]), rng.random() < 0.4) for _ in range(400)] + [("c", 0.3, True)]
    df = spark.createDataFrame(rows, "class string, probability double, positive boolean")
    pr = {(r["class"], r.threshold): (r.precision, r.recall) for r in precision_recall(df, ["class"]).collect()}
    rocs = {(r["class"], r.threshold): (r.tpr, r.fpr) for r in roc(df.filter("class <> 'c'"), ["class"]).collect()}
    for c in "ab":
        mine = [(p, t) for k, p, t in rows if k == c]
        pos = sum(t for _, t in mine)
        for cut in {p for p, _ in mine}:
            said = [t for p, t in mine if p >= cut]
            assert pr[c, round(cut, 6)] == (pytest.approx(sum(said) / len(said), abs=1e-6), pytest.approx(sum(said) / pos, abs=1e-6))
            assert rocs[c, round(cut, 6)] == (pytest.approx(sum(said) / pos, abs=1e-6), pytest.approx((len(said) - sum(said)) / (len(mine) - pos), abs=1e-6))
        pairs = [(a > b) + 0.5 * (a == b) for a, x in mine if x for b, y in mine if not y]
        auc = {r["class"]: r.roc_auc for r in average_precision(df, ["class"]).collect()}
        assert auc[c] == pytest.approx(sum(pairs) / len(pairs), abs=1e-6)
    summary = {r["class"]: r for r in class_summary(df).collect()}
    assert not summary["c"].available and summary["c"].roc_auc is None and summary["a"].available
    each = each_class(spark.createDataFrame([("x", "y", 0.6)], "label string, predicted string, probability double"), ("x", "y", "z")).collect()
    assert [(r["class"], round(r.probability, 6), r.positive) for r in each] == [("x", 0.2, True), ("y", 0.6, False), ("z", 0.2, False)]


def typed_rows(spark, changes):
    base = {"event_id": "EV-1", "start_time": datetime(2024, 1, 1), "end_time": datetime(2024, 1, 2), "centroid_latitude": 10.0, "centroid_longitude": 20.0, "detection_count": 3, "day_ratio": 0.5}
    rows = [base | {"event_id": f"EV-{k}"} | change for k, change in enumerate(changes)]
    names = "event_id string, start_time timestamp, end_time timestamp, centroid_latitude double, centroid_longitude double, detection_count long, day_ratio double, mean_frp double"
    return dataset.typed(spark.createDataFrame([tuple(r.get(c.split()[0]) for c in names.split(", ")) for r in rows], names))


def test_checks_of_broken_tables(spark):
    broken = [
        {}, {"event_id": None}, {"event_id": "EV-0"}, {"end_time": datetime(2023, 1, 1)}, {"start_time": None}, {"centroid_latitude": 91.0}, {"centroid_longitude": None},
        {"detection_count": 0}, {"detection_count": None}, {"mean_frp": float("nan")}, {"mean_frp": float("inf")}, {"day_ratio": 1.5}, {"day_ratio": -0.1},
    ]
    got = {r.check: r.n for r in dataset.problems(typed_rows(spark, broken)).collect()}
    assert got == {"id_missing": 1, "id_repeated": 1, "time_range": 2, "coordinates": 2, "no_detection": 2, "not_finite": 2, "not_a_share": 2}
    assert not any(r.n for r in dataset.problems(typed_rows(spark, [{}, {}])).collect()) and not any(r.n for r in dataset.problems(typed_rows(spark, [{}]).limit(0)).collect())


def test_typed_table_and_its_hash(spark, tmp_path):
    rows = typed_rows(spark, [{}, {"day_ratio": None}, {"mean_frp": 2.5}])
    assert rows.columns == dataset.COLUMNS and len(dataset.COLUMNS) == 69
    schema = {r.name: (r.dtype, r.nullable) for r in dataset.schema_rows(spark).collect()}
    assert {f.name: f.dataType.simpleString() for f in rows.schema} == {c: t for c, (t, _) in schema.items()} and not schema["event_id"][1] and schema["mean_frp"] == ("double", True)
    first = dataset.write(rows, str(tmp_path / "t")).first()
    assert first == dataset.content_hash(rows.repartition(3)).first() and first.rows == 3
    for change in ({"mean_frp": 2.6}, {"mean_frp": None}):
        assert dataset.content_hash(typed_rows(spark, [{}, {"day_ratio": None}, change])).first().digest != first.digest
    assert dataset.content_hash(rows.unionByName(rows)).first().digest != first.digest


class Formula:
    """Two labels; the first one's probability has effects of single features and of pairs of them."""

    def predicted(self, rows):
        v = [F.col("inputs")[2 * k] + F.col("inputs")[2 * k + 1] for k in range(4)]
        p = F.lit(0.3) + 0.1 * v[0] - 0.05 * v[1] + 0.2 * v[0] * v[1] + 0.07 * v[2] * v[3] - 0.03 * v[1] * v[3]
        return rows.withColumn("probabilities", F.array(p, 1 - p))


def test_contributions_are_exact_for_pairs(spark):
    from itertools import permutations

    from emberline.operators import attribution

    rng = random.Random(3)
    f = lambda v: 0.3 + 0.1 * v[0] - 0.05 * v[1] + 0.2 * v[0] * v[1] + 0.07 * v[2] * v[3] - 0.03 * v[1] * v[3]
    asked = [(f"e{k}", [x for _ in range(4) for x in (rng.random(), float(rng.random() < 0.3))]) for k in range(12)]
    held = [(f"b{k}", [x for _ in range(4) for x in (rng.random(), 0.0)]) for k in range(5)]
    schema = "event_id string, inputs array<double>"
    against = attribution.background(spark.createDataFrame(held, schema), 5)
    got = attribution.contributions(spark.createDataFrame(asked, schema), Formula(), against, list("wxyz"), ["yes", "no"]).collect()
    value = {(r.event_id, r.label, r.feature): r for r in got}
    assert len(value) == 12 * 4 * 2
    fold = lambda i: [i[2 * k] + i[2 * k + 1] for k in range(4)]
    for name, inputs in asked:
        x, bs = fold(inputs), [fold(i) for _, i in held]
        mean = lambda s, x=x, bs=bs: np.mean([f([x[k] if k in s else b[k] for k in range(4)]) for b in bs])
        for k, feature in enumerate("wxyz"):
            exact = np.mean([mean(set(order[: order.index(k) + 1])) - mean(set(order[: order.index(k)])) for order in permutations(range(4))])
            r = value[name, "yes", feature]
            assert r.contribution == pytest.approx(exact) and value[name, "no", feature].contribution == pytest.approx(-exact)
            assert r.base == pytest.approx(mean(set())) and r.probability == pytest.approx(f(x))
        assert sum(value[name, "yes", c].contribution for c in "wxyz") == pytest.approx(f(x) - mean(set()))
    with pytest.raises(ValueError):
        attribution.background(spark.createDataFrame(held, schema), 1000)


def test_contributions_of_a_model(fitted):
    from emberline.operators import attribution

    _, split, model = fitted
    rows = split.test.limit(15)
    got = attribution.contributions(rows, model, attribution.background(split.train), split.features, split.labels).collect()
    said = {r.event_id: r.probabilities for r in model.predicted(rows).collect()}
    sums = {}
    for r in got:
        assert r.probability == pytest.approx(said[r.event_id][split.labels.index(r.label)])
        sums[r.event_id, r.label] = sums.get((r.event_id, r.label), r.base) + r.contribution
    assert all(s == pytest.approx(said[e][split.labels.index(c)]) for (e, c), s in sums.items()) and len(sums) == 45
