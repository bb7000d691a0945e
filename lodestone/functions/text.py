"""Scalar functions on names, paths, hashes and rates; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.dialect import BadPattern, to_java


def hex_lower(c: Column) -> Column:
    return F.lower(F.hex(c))


def utf8_replace(c: Column) -> Column:
    """Bytes as text, what is not UTF-8 as U+FFFD."""
    return F.make_valid_utf8(c.cast("string"))


def path_join(prefix: Column, name: Column) -> Column:
    """prefix/name; just name after an empty prefix. Below the root a null name reads "None"."""
    return F.when(prefix == "", name).otherwise(F.concat(prefix, F.lit("/"), F.coalesce(name, F.lit("None"))))


def url_digest(url: Column) -> Column:
    """The first 8 hex digits of the URL's sha256; a null URL counts as "unknown"."""
    return F.substring(F.sha2(F.coalesce(url, F.lit("unknown")).cast("binary"), 256), 1, 8)


def output_path(base: str, url: Column, path: Column) -> Column:
    """base/digest/path; null for a null path."""
    return F.concat(F.lit(base.rstrip("/") + "/"), url_digest(url), F.lit("/"), path)


def content_url(base_url: str, sha1_git: Column) -> Column:
    return F.concat(F.lit(f"{base_url}/content/sha1_git:"), sha1_git, F.lit("/raw/"))


def rate_class(remaining: Column, limit: Column) -> Column:
    """critical below a tenth of the limit, warning below three tenths, else null; null without both numbers."""
    ratio = F.try_divide(remaining.cast("double"), limit.cast("double"))
    return F.when(ratio < 0.1, F.lit("critical")).when(ratio < 0.3, F.lit("warning"))


def backoff(kind: Column, attempt: Column, retry_after: Column) -> Column:
    """Seconds before the next attempt (attempts count from 0): after 429 what the server says, or 2^(attempt+1); after timeouts and network errors 2^attempt."""
    return F.when(kind == "429", F.coalesce(retry_after.cast("double"), F.pow(F.lit(2.0), attempt + 1))).when(kind.isin("timeout", "network"), F.pow(F.lit(2.0), attempt))


def limiter_wait(per_hour: Column) -> Column:
    return F.greatest(F.lit(3600.0) / per_hour, F.lit(0.01))


def java_regex(pattern: str, spark: SparkSession | None = None) -> str:
    """A finite-automaton pattern as Java reads it (see dialect). With a session it is compiled at once, so that a bad one fails on the driver."""
    done = to_java(pattern)
    if spark is not None:
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(done)
        except Exception as e:
            raise BadPattern(str(e).splitlines()[0]) from e
    return done
