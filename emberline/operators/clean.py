"""Cleaning of raw observations: all columns arrive as text, each row is accepted or rejected with its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ("latitude", "longitude")
IDENTITY = ("latitude", "longitude", "acquisition_us", "satellite", "instrument")
#: (column, lowest, highest, lowest is excluded, needed)
NUMBERS = (("latitude", -90.0, 90.0, False, True), ("longitude", -180.0, 180.0, False, True), ("frp", 0.0, None, False, False), ("brightness", 0.0, None, True, False))


def normalized_names(raw: DataFrame) -> DataFrame:
    """Column names stripped and in lower case; two that become equal are an error."""
    names = [c.strip().lower() for c in raw.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names collide: {sorted({n for n in names if names.count(n) > 1})}")
    return raw.toDF(*names)


def _text(raw: DataFrame, name: str) -> Column:
    """The column without blanks around it; null where it's missing or empty."""
    return F.nullif(F.trim(F.col(name).cast("string")), F.lit("")) if name in raw.columns else F.lit(None).cast("string")


def acquisition_us(raw: DataFrame) -> Column:
    """From acquisition_time, else from date and HHMM (with a .0 and leading zeros lost); null if it can't be read."""
    whole = F.try_to_timestamp(_text(raw, "acquisition_time"))
    hhmm = F.regexp_replace(_text(raw, "acq_time"), r"^(\d+)\.0$", "$1")
    hhmm = F.when(hhmm.rlike(r"^\d{1,4}$"), F.lpad(hhmm, 4, "0")).otherwise(F.replace(hhmm, F.lit(":"), F.lit("")))
    parted = F.concat(_text(raw, "acq_date"), F.lit(" "), F.substring(hhmm, 1, 2), F.lit(":"), F.substring(hhmm, 3, 2))
    parts = F.try_to_timestamp(F.when(hhmm.rlike(r"^\d{4}$"), parted), F.lit("yyyy-MM-dd HH:mm"))
    return F.unix_micros(F.coalesce(whole, parts))


def tagged(raw: DataFrame) -> DataFrame:
    """``raw`` (with source_row) normalized, with errors (array), duplicate and detection_id.

    Of rows without errors that share their identity the first by source_row is kept and the others are duplicates.
    """
    raw = normalized_names(raw)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing or not ("acquisition_time" in raw.columns or {"acq_date", "acq_time"} <= set(raw.columns)):
        raise ValueError(f"missing columns: {missing or ['acquisition_time']}")
    value = {c: _text(raw, c) for c in ("latitude", "longitude", "frp")}
    value["brightness"] = F.coalesce(*[_text(raw, c) for c in ("brightness", "bright_ti4", "brightness_ti")])
    checks = []
    for name, low, high, above, needed in NUMBERS:
        number = value[name].try_cast("double")
        good = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")) & ((number > low) if above else (number >= low))
        good = good & (number <= high) if high is not None else good
        bad = ~good & (value[name].isNotNull() | F.lit(needed))
        checks.append(F.when(bad, f"invalid:{name}"))
        value[name] = F.when(good, number)
    us = acquisition_us(raw)
    day = F.upper(_text(raw, "daynight"))
    rows = raw.select(
        "source_row",
        *[v.alias(k) for k, v in value.items()],
        us.alias("acquisition_us"),
        F.when(day.isin("D", "DAY"), "D").when(day.isin("N", "NIGHT"), "N").alias("daynight"),
        *[_text(raw, c).alias(c) for c in ("satellite", "instrument", "confidence")],
        F.array_compact(F.array(*checks, F.when(us.isNull(), "invalid:acquisition_time"))).alias("errors"),
    )
    rows = rows.withColumn("good", F.size("errors") == 0)
    # rejected rows are never compared: each gets a key of its own
    rows = rows.withColumn("_own", F.when(~F.col("good"), F.col("source_row")))
    first = F.row_number().over(Window.partitionBy("good", "_own", *IDENTITY).orderBy("source_row"))
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in IDENTITY]
    return rows.withColumn("duplicate", F.col("good") & (first > 1)).withColumn("detection_id", F.substring(F.sha2(F.concat_ws("|", *text), 256), 1, 24)).drop("_own", "good")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter((F.size("errors") == 0) & ~F.col("duplicate")).drop("errors", "duplicate")


def rejected(rows: DataFrame) -> DataFrame:
    """(source_row, validation_errors): reasons joined by semicolons."""
    reasons = F.array_join(F.when(F.col("duplicate"), F.array(F.lit("duplicate"))).otherwise(F.col("errors")), ";")
    return rows.filter((F.size("errors") > 0) | F.col("duplicate")).select("source_row", reasons.alias("validation_errors"))


def report(rows: DataFrame) -> DataFrame:
    """One row of counts and bounds over tagged rows, in one pass."""
    ok = (F.size("errors") == 0) & ~F.col("duplicate")
    return rows.agg(
        F.count("*").alias("input_rows"),
        F.count_if(ok).alias("accepted"),
        F.count_if(~ok).alias("rejected"),
        F.count_if(F.col("duplicate")).alias("duplicates"),
        F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()).alias("missing_coordinates"),
        F.count_distinct(F.when(ok, F.col("satellite"))).alias("satellites"),
        F.min(F.when(ok, F.col("acquisition_us"))).alias("first_us"),
        F.max(F.when(ok, F.col("acquisition_us"))).alias("last_us"),
    )


def live_confidence(confidence) -> Column:
    """Native confidence in percent as a share; anything else is 0."""
    share = F.col(confidence).try_cast("double") / 100.0
    return F.when(share.between(0, 1), share).otherwise(0.0)
