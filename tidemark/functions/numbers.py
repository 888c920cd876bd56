"""Decimal, unit and sentinel columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DECIMAL = "decimal(38,18)"
#: Texts that mean a missing value, by region.
MISSING = {"CN": ["", "--", "N/A", "n/a", "NA", "na"], "HK": ["", "--", "N/A", "n/a", "NA", "na"], "US": ["", "--", "N/A", "NA", "NULL"]}
#: Unit aliases: region ('' for both), alias, unit, currency, scale.
UNITS = [
    *[("", a, "percent", None, "1") for a in ("%", "percent", "pct", "percentage", "百分比", "百分点")],
    *[("", a, "percent", None, "0.01") for a in ("bp", "bps", "basis point", "basis points", "基点")],
    *[("CN", a, "CNY", "CNY", s) for a, s in (("cny", "1"), ("rmb", "1"), ("人民币", "1"), ("元", "1"), ("万元", "10000"), ("亿元", "100000000"))],
    *[("HK", a, "HKD", "HKD", s) for a, s in (("hkd", "1"), ("hk$", "1"), ("港元", "1"), ("hkd mn", "1000000"), ("hk$ mn", "1000000"), ("hkd million", "1000000"), ("million hkd", "1000000"), ("百万港元", "1000000"))],
]


def to_decimal(text: Column) -> Column:
    """Decimal of a text, or null; thousands separators are dropped and blanks are null."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast(DECIMAL)


def plain_text(value: Column) -> Column:
    """A decimal as text without trailing zeros or a bare point; integers such as 100 stay."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def same_value(left: Column, right: Column) -> Column:
    """Equal as decimals where the left is one, else equal as texts."""
    return F.coalesce(left.try_cast(DECIMAL) == right.try_cast(DECIMAL), left == right)


def missing(text: Column, region: str = "CN") -> Column:
    """True for null and for the region's sentinels; the US ones count in any case."""
    said = F.trim(text)
    return text.isNull() | (F.upper(said) if region == "US" else said).isin(MISSING[region])


def unit_key(unit: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(unit), r"\s+", " "))


def unit_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNITS, "u_region string, u_alias string, u_unit string, u_currency string, u_scale string").withColumn("u_scale", F.col("u_scale").cast("decimal(18,4)"))


def normalise_units(df: DataFrame, region: str = "region", value: str = "value", unit: str = "source_unit") -> DataFrame:
    """df with n_value, n_unit, n_currency, n_scale and n_issue, by a join with the small table of aliases.

    The scaled value is cast back to the declared decimal; an overflow gives null and an issue.
    """
    table = F.broadcast(unit_table(df.sparkSession))
    key = unit_key(F.col(unit))
    met = df.join(table, (key == F.col("u_alias")) & ((F.col("u_region") == "") | (F.col("u_region") == F.col(region))), "left")
    number, gone = to_decimal(F.col(value)), missing(F.col(value))
    scaled = (number.cast("decimal(38,9)") * F.col("u_scale")).try_cast("decimal(38,9)")
    issue = (
        F.when(key == "", "unit_required").when(F.col("u_unit").isNull(), "unsupported_unit").when(gone, "vendor_missing")
        .when(number.isNull(), "not_a_number").when(scaled.isNull(), "overflow")
    )
    found = met.withColumns({"n_value": F.when(issue.isNull(), scaled), "n_unit": F.col("u_unit"), "n_currency": F.col("u_currency"), "n_scale": F.col("u_scale"), "n_issue": issue})
    return found.drop("u_region", "u_alias", "u_unit", "u_currency", "u_scale")


def normalise_us_value(raw: Column, hint: Column | None = None, scale: Column | None = None) -> Column:
    """Struct of value, unit, currency, rule and issue: suffixes % and bp/bps, then the unit hint."""
    said = F.trim(raw)
    hint = F.lit(None).cast("string") if hint is None else F.trim(hint)
    gone = F.upper(said).isin(MISSING["US"])
    percent, points = said.endswith("%"), said.rlike("(?i)bps?$")
    digits = F.when(percent, F.rtrim(F.regexp_replace(said, "%$", ""))).when(points, F.rtrim(F.regexp_replace(said, "(?i)bps?$", ""))).otherwise(said)
    number = digits.try_cast(DECIMAL)
    suffixed = ~gone & (percent | points)
    value = F.when(points & ~percent, (number / 100).cast(DECIMAL)).otherwise(number)
    if scale is not None:
        value = (value.cast("decimal(28,9)") * scale.cast("decimal(10,0)")).cast(DECIMAL)
    unit = F.when(suffixed, "percent").when(F.upper(hint) == "USD", "currency").when(hint.isin("percent", "index_point", "rate"), hint)
    issue = F.when(~suffixed & hint.isNull(), "UNIT_REQUIRED").when(unit.isNull(), "UNKNOWN_UNIT").when(gone, "not_reported").when(number.isNull(), "NOT_A_DECIMAL")
    rule = F.when(gone, "missing_sentinel_to_null").when(percent, "percent_suffix").when(points, "basis_points_to_percent").otherwise("decimal_from_text")
    return F.struct(
        F.when(~gone, value).alias("value"), unit.alias("unit"),
        F.when(~suffixed & (F.upper(hint) == "USD"), "USD").alias("currency"), rule.alias("rule"), issue.alias("issue"),
    )
