"""Why a hotspot is classified as it is: factor labels, context and reasoning, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.geo import col
from emberline.functions.scoring import CLASSES, SATELLITE_SCORES, one_of

# Thresholds (a value up to the number has the label), labels and texts that results depend on.
THERMAL = ((310.0, "LOW"), (335.0, "MODERATE"), (360.0, "HIGH")), "VERY HIGH"
POWER = ((15.0, "LOW"), (45.0, "MODERATE"), (90.0, "HIGH")), "VERY HIGH"
INDUSTRY = ((1.0, "VERY HIGH"), (3.0, "HIGH"), (8.0, "MODERATE")), "LOW"
SURROUNDINGS = ((2.0, "VERY HIGH"), (6.0, "HIGH"), (15.0, "MODERATE")), "LOW"
PERSISTENCE = ((55.0, "HIGH"), (25.0, "MODERATE")), "LOW"
RECURRENCE = (("recurring", "HIGH"), ("persistent", "MODERATE"))
REASONING = (
    (
        "Industrial Fire",
        "Hotspot is located close to industrial infrastructure and shows a sudden increase in thermal intensity. Repeated detections were not "
        "observed at this location before the current event. These factors increase the probability of an abnormal industrial fire.",
    ),
    (
        "Persistent Industrial Heat Source",
        "Thermal detections repeatedly occur at nearly the same coordinates over multiple observation periods, with low temporal variability. The "
        "source is located inside or very near an industrial zone, consistent with operational heat rather than an uncontrolled fire.",
    ),
    (
        "Gas Flare",
        "A very hot, high-FRP thermal source persists at a fixed location within an industrial facility. Continuous bright signatures of this kind "
        "are consistent with a gas flare or high-temperature industrial vent.",
    ),
    (
        "Wildfire",
        "Hotspot overlaps or is near forest/vegetated land, has limited industrial infrastructure nearby, and exhibits spatial spread consistent "
        "with a natural vegetation fire.",
    ),
    ("Agricultural Burning", "Hotspot occurs within agricultural land and shows a seasonal/spatial pattern consistent with crop-residue burning."),
    (
        "Other Thermal Anomaly",
        "The detection does not clearly match an industrial, vegetated or agricultural signature. It may be a small transient heat source and is "
        "kept under observation.",
    ),
)
# The texts and thresholds below.
#: Class, condition over the scored columns (None: always), text; those of a class in the order in which they are listed.
FACTORS = (
    ("Industrial Fire", "d_industrial BETWEEN 0 AND 0.5", "Industrial facility within 500 m"),
    ("Industrial Fire", "d_industrial > 0.5 AND d_industrial <= 3", "Industrial facility within 3 km"),
    ("Industrial Fire", "n_detections <= 2", "Sudden thermal intensity increase"),
    ("Industrial Fire", "land_cover = 'Industrial'", "Developed land cover"),
    ("Industrial Fire", "persistence_score < 30", "Low persistence at this location"),
    ("Industrial Fire", "d_forest >= 8", "Low vegetation probability"),
    ("Industrial Fire", "validation IN ('LIKELY', 'CONFIRMED')", "Satellite validation indicates possible smoke"),
    ("Persistent Industrial Heat Source", None, "{n} detections over the observation window"),
    ("Persistent Industrial Heat Source", None, "Low temporal variability"),
    ("Persistent Industrial Heat Source", "d_industrial BETWEEN 0 AND 3", "Source inside industrial zone"),
    ("Gas Flare", None, "Very high brightness temperature"),
    ("Gas Flare", None, "High FRP sustained over time"),
    ("Gas Flare", "d_industrial >= 0", "Fixed location inside industrial facility"),
    ("Wildfire", None, "Forest/vegetated land cover"),
    ("Wildfire", "d_industrial < 0 OR d_industrial >= 8", "No significant industrial infrastructure nearby"),
    ("Wildfire", "n_detections >= 3", "Multiple detections consistent with spread"),
    ("Wildfire", "d_settlement BETWEEN 0 AND 5", "Settlement exposure within 5 km"),
    ("Agricultural Burning", None, "Detection within agricultural land"),
    ("Agricultural Burning", "tod >= 0.5", "Daytime detection typical of residue burning"),
    ("Agricultural Burning", "n_detections <= 3", "Short-lived, low-intensity signature"),
    ("Other Thermal Anomaly", None, "Signature does not match known categories"),
)


def label(value, steps, default: str) -> Column:
    """The label of the first threshold that the value doesn't exceed."""
    out = F.lit(default)
    for most, name in reversed(steps):
        out = F.when(col(value) <= most, name).otherwise(out)
    return out


def proximity(distance, steps, default: str) -> Column:
    return F.when(col(distance) >= 0, label(distance, steps, default)).otherwise("N/A")


def factor_labels() -> dict[str, Column]:
    """A label for each factor of a scored hotspot."""
    held = F.lit(PERSISTENCE[1])
    for least, name in reversed(PERSISTENCE[0]):
        held = F.when(F.col("persistence_score") >= least, name).otherwise(held)
    return {
        "thermal_intensity": label("brightness", *THERMAL),
        "frp": label("frp", *POWER),
        "industrial_proximity": proximity("d_industrial", *INDUSTRY),
        "forest_proximity": proximity("d_forest", *SURROUNDINGS),
        "agricultural_proximity": proximity("d_agriculture", *SURROUNDINGS),
        "settlement_proximity": proximity("d_settlement", *SURROUNDINGS),
        "persistence": held,
        "land_cover": F.col("land_cover"),
        "historical_recurrence": one_of("pattern", RECURRENCE, "LOW"),
        "satellite_validation": F.when(F.col("validation").isin(*[name for name, _ in SATELLITE_SCORES]), F.col("validation")).otherwise("NOT VALIDATED"),
    }


def contextual_factors() -> Column:
    """The texts that hold for a hotspot's class, in order. A count is written as the feature vector has it, as a double."""
    text = lambda t: F.concat(F.col("n_detections").cast("double").cast("string"), F.lit(t.removeprefix("{n}"))) if t.startswith("{n}") else F.lit(t)
    holds = lambda c: F.expr(c) if c else F.lit(True)
    return F.array_compact(F.array(*[F.when((F.col("classification") == kind) & holds(c), text(t)) for kind, c, t in FACTORS]))


def reasoning() -> Column:
    return one_of("classification", REASONING, "")


def ranked_classes() -> Column:
    """(p, class) from the likeliest down; ties in the order of the classes."""
    pairs = F.array(*[F.struct((-F.col(f"p{k}")).alias("m"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, name in enumerate(CLASSES)])
    return F.transform(F.array_sort(pairs), lambda x: F.struct((-x["m"]).alias("p"), x["name"].alias("name")))


def hybrid_decision(probabilities, approved, anomaly, persistence, context) -> Column:
    """What may be said of an event: its likeliest class if an approved model gave sound probabilities (a map), else Unknown.

    An unsound map of an approved model raises. ``context``: array of observed context, empty if there is none.
    """
    p = col(probabilities)
    values = F.map_values(p)
    given = col(approved) & p.isNotNull() & (F.size(p) > 0)
    sound = ~F.exists(values, lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v > 1)) & (F.abs(F.aggregate(values, F.lit(0.0), lambda a, v: a + v) - 1) <= 1e-5)
    best = F.element_at(F.array_sort(F.transform(F.map_entries(p), lambda e: F.struct((-e["value"]).alias("m"), e["key"].alias("key")))), 1)
    trained = given & F.when(given & ~sound, F.raise_error(F.lit("unsound classifier probabilities")).cast("boolean")).otherwise(True)
    reasons = F.array_compact(
        F.array(
            F.when(trained, "Decision from reviewed event model; confidence is an uncalibrated model probability").otherwise(
                "No approved event classifier; source class cannot be established from thermal/context evidence alone"
            ),
            F.when(col(persistence) == "persistent_candidate", "Stable repeated heat supports a persistent-source candidate"),
            F.when(col(anomaly) == "elevated", "Elevated FRP warrants analyst review; does not establish an industrial fire"),
            F.when(F.size(col(context)) > 0, F.concat(F.lit("Observed context: "), F.array_join(col(context), ", "))),
        )
    )
    return F.struct(
        F.when(trained, best["key"]).otherwise("Unknown").alias("decision"),
        F.when(trained, -best["m"]).alias("confidence"),
        F.when(trained, "trained_with_context").otherwise("evidence_rules").alias("mode"),
        F.when(col(anomaly) == "elevated", "review").otherwise("unassessed").alias("priority"),
        reasons.alias("reasons"),
    )
