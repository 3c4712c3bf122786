"""Features, rule classification and risk of a hotspot, as column expressions.

Distances are kilometres, -1 where a layer has nothing; brightness is kelvin and FRP megawatts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.geo import col

# The classes in order, levels, codes, weights and texts that results depend on.
CLASSES = ("Industrial Fire", "Persistent Industrial Heat Source", "Gas Flare", "Wildfire", "Agricultural Burning", "Other Thermal Anomaly")
LEVELS = (("LOW", 0, 20), ("MODERATE", 21, 40), ("ELEVATED", 41, 60), ("HIGH", 61, 80), ("CRITICAL", 81, 100))
LAND_COVERS = ("Industrial", "Forest", "Agriculture", "Urban", "Barren", "Other")
SATELLITE_SCORES = (("NOT VALIDATED", 0.0), ("UNCERTAIN", 1.0), ("LIKELY", 2.0), ("CONFIRMED", 3.0))
SATELLITE_RISK = (("CONFIRMED", 90.0), ("LIKELY", 70.0), ("UNCERTAIN", 40.0))
RECURRENCE_RISK = (("persistent", 45.0), ("recurring", 60.0), ("sudden", 25.0), ("intermittent", 35.0))
TREND_SHAPES = (("persistent", (0.55, 0.7, 0.88, 1.0)), ("recurring", (0.5, 0.85, 0.6, 1.0)), ("sudden", (0.25, 0.5, 0.78, 1.0)))
OTHER_TREND = (0.4, 0.6, 0.8, 1.0)
RECOMMENDATIONS = (
    ("CRITICAL", "Immediate field verification recommended."),
    ("HIGH", "Priority inspection recommended."),
    ("ELEVATED", "Enhanced monitoring recommended."),
    ("MODERATE", "Continue monitoring."),
    ("LOW", "No immediate action required."),
)
TEMPERATURE = 1.2
RISK_WEIGHTS = {"thermal": 0.20, "frp": 0.15, "industrial": 0.15, "settlement": 0.15, "forest": 0.08, "agriculture": 0.05, "persistence": 0.10, "satellite": 0.07, "recurrence": 0.05}


def one_of(value, pairs, default) -> Column:
    """The partner of ``value`` in ``pairs``."""
    out = F.lit(default)
    for key, result in reversed(list(pairs)):
        out = F.when(col(value) == key, F.lit(result)).otherwise(out)
    return out


def clamp(value: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def linear(value: Column, low: float, high: float) -> Column:
    """0 to 100 between two values, 0 below and 100 above."""
    return clamp((value - low) / (high - low) * 100.0, 0, 100)


def land_cover_code(value) -> Column:
    return one_of(value, [(name, float(k)) for k, name in enumerate(LAND_COVERS)], 5.0)


def satellite_score(status) -> Column:
    return one_of(status, SATELLITE_SCORES, 0.0)


def time_of_day(ts) -> Column:
    """0 at midnight, 1 at noon, 0.5 if unknown."""
    hour = F.hour(col(ts)) + F.minute(col(ts)) / 60.0
    return F.coalesce(clamp(1.0 - F.abs(hour - 12.0) / 12.0, 0, 1), F.lit(0.5))


def nearest_industrial(*distances) -> Column:
    """The least distance that isn't negative, else -1."""
    known = F.filter(F.array(*[col(d) for d in distances]), lambda d: d >= 0)
    return F.coalesce(F.array_min(known), F.lit(-1.0))


# The thresholds, weights and names of the next function.
def land_cover(industrial_km, in_forest, in_agriculture, settlement_km) -> Column:
    near = lambda d, km: (col(d) >= 0) & (col(d) <= km)
    return (
        F.when(near(industrial_km, 3.0), "Industrial")
        .when(col(in_forest), "Forest")
        .when(col(in_agriculture), "Agriculture")
        .when(near(settlement_km, 5.0), "Urban")
        .otherwise("Other")
    )


FEATURES = (
    "brightness frp n_detections persistence_score dist_industrial_km dist_forest_km dist_agriculture_km dist_settlement_km "
    "land_cover_code time_of_day historical_frequency satellite_score frp_normalized brightness_normalized"
).split()


def feature_vector() -> list[Column]:
    """FEATURES, from brightness, frp, n_detections, persistence_score, the four d_* distances, land_cover, acq_ts, validation."""
    b, f = F.greatest(F.lit(0.0), F.col("brightness")), F.greatest(F.lit(0.0), F.col("frp"))
    floor = lambda c: F.greatest(F.lit(-1.0), F.col(c))
    values = [
        b, f, F.col("n_detections").cast("double"), F.col("persistence_score"), floor("d_industrial"), floor("d_forest"), floor("d_agriculture"),
        floor("d_settlement"), land_cover_code("land_cover"), time_of_day("acq_ts"), F.col("historical_frequency"), satellite_score("validation"),
        f / 160.0, (b - 300.0) / 120.0,
    ]
    return [v.alias(name) for v, name in zip(values, FEATURES, strict=True)]


def _points(*terms: tuple[Column, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, F.lit(v)).otherwise(F.lit(0.0)) for c, v in terms])


# The thresholds, weights and names of the next function.
def rule_scores() -> list[Column]:
    """A score for each class in order, from brightness, frp, n_detections, persistence_score, d_*, land_cover, tod."""
    b, f, n, p = (F.col(c) for c in ("brightness", "frp", "n_detections", "persistence_score"))
    d, cover = F.col("d_industrial"), F.col("land_cover")
    close, very_close = (d >= 0) & (d < 8), (d >= 0) & (d < 3)
    forest_close = (F.col("d_forest") >= 0) & (F.col("d_forest") < 6)
    farm_close = (F.col("d_agriculture") >= 0) & (F.col("d_agriculture") < 4)
    in_industry, in_forest, in_farm = (cover == x for x in ("Industrial", "Forest", "Agriculture"))
    persistent = (p >= 50) & (n >= 4)
    sudden = ~persistent & (n <= 2) & ((b > 345) | (f > 40))
    very_hot, high_frp = b >= 360, f >= 60
    base = F.lit(0.05)
    flare = persistent & very_hot & high_frp & (very_close | in_industry)
    heat = persistent & (close | in_industry)
    fire = sudden & (close | in_industry) & (very_hot | high_frp)
    wild = (forest_close | in_forest) & ~close & ~in_farm
    farm = (farm_close | in_farm) & ~in_forest
    scores = [
        _points((fire, 3.5), (fire & very_hot, 0.75), (fire & high_frp, 0.75), (fire & (d < 0.5), 0.5)),
        _points((heat, 3.5), (heat & very_close, 1.0), (heat & ~very_hot, 0.5), (heat & (n >= 8), 0.5)),
        _points((flare, 4.0), (flare & (d < 1), 1.0), (flare & (f >= 90), 1.0)),
        _points((wild, 3.0), (wild & in_forest, 1.0), (wild & ~sudden & (n >= 3), 0.5), (wild & ((d < 0) | (d >= 8)), 0.5)),
        _points((farm, 3.0), (farm & in_farm, 1.5), (farm & ~very_hot & ~high_frp, 0.5), (farm & (F.col("tod") >= 0.5), 0.5), (farm & (n <= 3), 0.25)),
        F.lit(0.0),
    ]
    return [base + s for s in scores]


def probabilities(scores: list[Column]) -> list[Column]:
    """Softmax of the scores; where no rule spoke, the last class gets 0.75 and the others 0.05."""
    top = F.greatest(*scores)
    weights = [F.exp((s - top) / TEMPERATURE) for s in scores]
    total = reduce(lambda a, b: a + b, weights)
    silent = top <= 0.1
    return [F.when(silent, F.lit(0.75 if k == len(scores) - 1 else 0.05)).otherwise(w / total) for k, w in enumerate(weights)]


def top_class(probs: list[Column]) -> Column:
    """The likeliest class, ties to the first in order."""
    best = F.greatest(*probs)
    return F.coalesce(*[F.when(p == best, F.lit(name)) for p, name in zip(probs, CLASSES, strict=True)])


# The thresholds, weights and names of the next function.
def risk_score() -> Column:
    """0 to 100, unrounded, from brightness, frp, persistence_score, pattern, classification, d_* and validation."""
    b, f, kind = F.col("brightness"), F.col("frp"), F.col("classification")
    home, wood, farm, plant = (F.col(c) for c in ("d_settlement", "d_forest", "d_agriculture", "d_industrial"))
    hundred = lambda d, k: clamp(100.0 - k * d, 0, 100)
    parts = {
        "thermal": linear(b, 300, 410),
        "frp": F.least(F.lit(100.0), f * 1.1),
        # 0 km gives 0 and 8 km gives 100; farther gives 0
        "industrial": F.when(plant < 0, 10.0).when(plant > 8, 0.0).otherwise(linear(plant, 0, 8)),
        "settlement": F.when(home < 0, 5.0).otherwise(hundred(home, 6.0)),
        "forest": F.when(wood < 0, 10.0).otherwise(hundred(wood, 14.0)) * F.when(kind.isin("Wildfire", "Industrial Fire"), 1.0).otherwise(0.6),
        "agriculture": F.when(farm < 0, 5.0).otherwise(hundred(farm, 20.0)),
        "persistence": clamp(F.col("persistence_score"), 0, 100),
        "satellite": one_of("validation", SATELLITE_RISK, 25.0),
        "recurrence": one_of("pattern", RECURRENCE_RISK, 15.0),
    }
    total = reduce(lambda x, y: x + y, [parts[k] * w for k, w in RISK_WEIGHTS.items()])
    near_home = (home >= 0) & (home <= 5)
    adjust = (
        F.when(kind == "Industrial Fire", F.when(near_home, 28.0).otherwise(18.0))
        .when(kind == "Gas Flare", 7.0)
        .when((kind == "Wildfire") & near_home, 10.0)
        .when(kind == "Agricultural Burning", -6.0)
        .otherwise(0.0)
    )
    return clamp(total + adjust, 0, 100)


def risk_level(score) -> Column:
    """Closed bands of whole numbers; a score between two of them is LOW."""
    out = F.lit("LOW")
    for name, low, high in reversed(LEVELS):
        out = F.when(col(score).between(low, high), name).otherwise(out)
    return out


def trend(score, n, pattern) -> Column:
    """Four points that lead to the score, shaped by the pattern; one point without history."""
    shape = lambda factors: F.array(*[F.round(clamp(col(score) * k, 0, 100), 1) for k in factors])
    out = shape(OTHER_TREND)
    for name, factors in TREND_SHAPES:
        out = F.when(col(pattern) == name, shape(factors)).otherwise(out)
    return F.when(col(n) <= 1, F.array(F.round(col(score), 1))).otherwise(out)


def alert_due(risk, kind, confidence) -> Column:
    return (col(risk) >= 80) | (col(kind).isin("Industrial Fire", "Gas Flare") & (col(confidence) >= 0.8))


# Evidence about events ------------------------------------------------------------------------------------


def anomaly_score(current, mean, std, n) -> Column:
    """Signed deviation in standard deviations; null under five observations or without variance."""
    enough = (col(n) >= 5) & (col(std) > 0) & col(current).isNotNull() & col(mean).isNotNull()
    return F.when(enough, (col(current) - col(mean)) / col(std))


def anomaly_status(score) -> Column:
    return F.when(col(score).isNull(), "unavailable").when(col(score) >= 3, "elevated").otherwise("within_baseline")


# The thresholds, weights and names of the next function.
def persistence_status(days, mean, std) -> Column:
    cv = F.when(col(mean) > 0, col(std) / col(mean))
    return (
        F.when(col(days).isNull() | (col(days) < 5), "insufficient_history")
        .when((col(days) >= 30) & (cv <= 0.5), "persistent_candidate")
        .otherwise("recurrent_activity")
    )


# The thresholds, weights and names of the next function.
def history_reason(prior, in_window, in_radius, with_frp, times, std, current) -> Column:
    """Why an event has no anomaly score; the first reason that holds."""
    return (
        F.when(col(prior) == 0, "NO_PRIOR_OBSERVATIONS")
        .when(col(in_window) == 0, "NO_PRIOR_IN_HISTORY_WINDOW")
        .when(col(in_radius) == 0, "NO_MATCH_WITHIN_HISTORY_RADIUS")
        .when(col(with_frp) == 0, "MISSING_HISTORICAL_FRP")
        .when((col(with_frp) < 2) | (col(times) < 2), "INSUFFICIENT_HISTORY")
        .when(col(std) == 0, "ZERO_HISTORICAL_VARIANCE")
        .when(col(current).isNull(), "CURRENT_FRP_MISSING")
        .otherwise("AVAILABLE")
    )


def training_eligible(review_status, label, quality, confidence) -> Column:
    good = (col(review_status) == "approved") & (col(label) != "Unknown") & col(quality).isin("A", "B") & (col(confidence) >= 0.8)
    return F.coalesce(good, F.lit(False))
