"""Number formats and small string functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fixed(x: Column, digits: int) -> Column:
    """A fixed number of decimals, rounded by the exact value of the double (halves to even), as C's printf does; the
    JVM's formatter rounds the shortest decimal that stands for the double instead."""
    scale = 10**digits
    a = F.abs(x)

    def out(y):
        # the error of the product, by splitting the factor into two halves of 26 bits
        high = y["c"] - (y["c"] - y["a"])
        error = (high * scale - y["p"]) + (y["a"] - high) * scale
        whole = F.floor(y["p"])
        rest = y["p"] - whole
        up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
        n = (whole + up.cast("int")).cast("bigint")
        return F.concat(F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))

    body = let(F.struct(a.alias("a"), (a * float(scale)).alias("p"), (a * 134217729.0).alias("c")), out)
    return F.when(x.isNotNull(), F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), body))


def score4(x: Column) -> Column:
    return fixed(x.cast("float").cast("double"), 4)


def score3(x: Column) -> Column:
    return fixed(x.cast("double"), 3)


def significant(x: Column) -> Column:
    """Six significant digits without trailing zeros; powers of ten below 1e-4 and from 1e6 on as 1e-05, 1e+06."""
    mag = F.floor(F.log10(F.abs(x))).cast("int")
    sci = F.regexp_replace(F.format_string("%.5e", x), r"\.?0+e", "e")
    # decimals so that six digits are significant
    plain = F.format_number(F.round(x, 10), 10)
    digits = F.greatest(F.lit(0), 5 - mag)
    fixed = F.coalesce(*[F.when(digits == d, F.format_string(f"%.{d}f", x)) for d in range(11)], plain)
    fixed = F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
    return F.when(x == 0, F.lit("0")).when((mag < -4) | (mag >= 6), sci).otherwise(fixed)


def q_value(x: Column) -> Column:
    shortest = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", x), "0+$", ""), r"\.$", "")
    return F.when(x == 0, F.lit("0")).when(x < 0.001, F.format_string("%.3e", x)).otherwise(shortest)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def unversioned(id: Column) -> Column:
    return F.regexp_replace(id, r"\..*$", "")


def info_value(info: Column, key: str) -> Column:
    """The value of an INFO key, '' if it has none; keys are anchored."""
    return F.regexp_extract(info, rf"(?:^|;){key}=([^;]*)", 1)


def info_map(info: Column) -> Column:
    """INFO as a map; a flag has the value `true`. The last of equal keys counts."""
    pairs = F.filter(F.split(info, ";"), lambda x: (x != "") & (x != "."))
    entry = lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(x.contains("="), F.regexp_extract(x, r"(?s)^[^=]*=(.*)\z", 1)).otherwise(F.lit("true")).alias("value"))
    named = F.transform(pairs, entry)
    last = F.filter(named, lambda x, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def info_field(info: Column, key: str) -> Column:
    """What info_map has under a key, null if it has none: one search from the end, without an array."""
    p = rf"(?s)\A(?:.*;)?{re.escape(key)}(=[^;]*)?(?:;.*)?\z"
    value = F.regexp_extract(info, p, 1)
    return F.when(value != "", F.substring(value, 2, 1 << 30)).when(info.rlike(p), F.lit("true"))


def without_key(info: Column, key: str) -> Column:
    """INFO without one key; '.' if nothing is left."""
    rest = F.regexp_replace(info, rf"(?:\A|;){re.escape(key)}(?:=[^;]*)?(?=;|\z)", "")
    left = F.regexp_replace(rest, r"\A;+|;+\z|;+(?=;)", "")
    return F.when(left == "", F.lit(".")).otherwise(left)
