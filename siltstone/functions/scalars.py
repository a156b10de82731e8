"""Scalar functions as column expressions, and their registration for SQL."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def format_bytes(n: Column, digits: int = 1) -> Column:
    part = lambda unit, name: F.concat(F.format_string(f"%.{digits}f", n / unit), F.lit(f" {name}"))
    return F.when(n >= 1_000_000_000, part(1e9, "GB")).when(n >= 1_000_000, part(1e6, "MB")).when(n >= 1000, part(1e3, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def format_ms(ms: Column) -> Column:
    return F.when(ms >= 1000, F.concat(F.format_string("%.2f", ms / 1000), F.lit("s"))).otherwise(F.concat(F.floor(ms + 0.5).cast("string"), F.lit("ms")))


def parse_bandwidth(s: Column) -> Column:
    """Bytes a second of strings such as 64kb, 5MB/s, 10m: units by 1024; 0 where it isn't one."""
    s = F.regexp_replace(F.lower(F.trim(s)), "/s$", "")
    form = r"^([\d.]+)\s*(kb|mb|gb|k|m|g|b)?$"  # a fixed value: the units that settings may have
    unit = F.substring(F.regexp_extract(s, form, 2), 1, 1)
    number = F.regexp_extract(s, form, 1).try_cast("double")
    factor = F.when(unit == "k", 1024).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)
    return F.coalesce(F.floor(number * factor + 0.5), F.lit(0)).cast("long")


def path_is_valid(p: Column) -> Column:
    n = F.length(p)
    return F.coalesce((n >= 1) & (n <= 1024) & ~p.startswith("/") & ~p.contains("../") & ~p.contains("./"), F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    """To one digit, as text; of nothing 0.0%."""
    return F.when(whole == 0, "0.0%").otherwise(F.concat(F.format_string("%.1f", part / whole * 100), F.lit("%")))


def trace_parent(h: Column) -> Column:
    """Struct of trace_id, span_id and flags of ``00-<32>-<16>-<2>``, white space around it aside; null where it isn't one."""
    p = F.split(F.regexp_replace(h, r"^\s+|\s+$", ""), "-")
    fine = (F.size(p) == 4) & (F.get(p, 0) == "00") & (F.length(F.get(p, 1)) == 32) & (F.length(F.get(p, 2)) == 16) & (F.length(F.get(p, 3)) == 2)
    return F.when(fine, F.struct(F.get(p, 1).alias("trace_id"), F.get(p, 2).alias("span_id"), F.get(p, 3).alias("flags")))


def format_trace(context: Column) -> Column:
    return F.concat(F.lit("00-"), context["trace_id"], F.lit("-"), context["span_id"], F.lit("-"), context["flags"])


def trace_context(h: Column, fresh: Column) -> Column:
    """The header's context, or else one made of ``fresh``, a string: ids are digits of its SHA-256, flags 01.

    Nothing random: a task that runs again gives the same context. Callers choose what makes it unique.
    """
    digits = F.sha2(fresh, 256)
    new = F.struct(F.substring(digits, 1, 32).alias("trace_id"), F.substring(digits, 33, 16).alias("span_id"), F.lit("01").alias("flags"))
    return F.coalesce(trace_parent(h), new)


def sanitise_key(k: Column) -> Column:
    return F.regexp_replace(k, r"[^a-zA-Z0-9_\-/]", "_")


def api_key_is_valid(k: Column) -> Column:  # the form is a fixed value: keys that exist have it
    return F.coalesce(k.rlike(r"^dks_[A-Za-z0-9_-]{43}$"), F.lit(False))


def api_key_prefix(k: Column) -> Column:
    """The first twelve characters that an index may show, of a key in the right form; null otherwise."""
    return F.when(api_key_is_valid(k), F.substring(k, 1, 12))


def api_key_hash(k: Column) -> Column:
    return F.sha2(k, 256)


def payload(json: Column, schema: str) -> Column:
    """A parsed payload; null where it isn't JSON of that form."""
    return F.from_json(json, schema)


def backoff_bound(attempt: Column, base_ms: int, most_ms: int) -> Column:
    return F.least(F.lit(most_ms).cast("double"), base_ms * F.pow(F.lit(2.0), attempt)).cast("long")


def error_class(status: Column, matches: Column) -> Column:
    """Why a stored object can't be used; null where it can."""
    return F.when(status == 404, "NOT_FOUND").when(status.isin(401, 403), "PERMISSION_DENIED").when(status >= 400, "SERVER_ERROR").when(~matches, "CORRUPT_BLOCK")


def register(spark: SparkSession) -> None:
    """SQL names for the byte kernels."""
    from siltstone.operators import chunking, codecs

    spark.udf.register("adler32", chunking.adler32)
    spark.udf.register("manifest_decode", codecs.decode_manifest)
    spark.udf.register("ops_decode", codecs.decode_ops)
