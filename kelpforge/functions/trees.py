"""JSON of any depth as rows: every leaf with its path, or all leaves as one text.

The walk unfolds one level after the other in the same projection chain: objects and arrays become their parts, leaves stay
what they are. How many levels there are is counted in the data first, so that no depth is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import dealt

# The keys that come first in a canonical text, in this order.
PREFERRED = [
    "canonical", "service_name", "service", "name", "amount", "price", "currency", "value", "method", "channel", "weekday", "day", "open_time", "close_time", "condition", "action", "discount", "text",
]


def depth(text: Column) -> Column:
    """How many objects and arrays of a JSON text lie in one another at most; strings do not count."""
    marks = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    step = lambda acc, x: F.struct((acc.now + F.when(x.isin("{", "["), 1).otherwise(-1)).alias("now"), F.greatest(acc.most, acc.now + F.when(x.isin("{", "["), 1).otherwise(-1)).alias("most"))
    return F.aggregate(F.filter(F.split(marks, ""), lambda x: x != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda acc: acc.most)


def leaves(rows: DataFrame, text: str, *, arrays: bool = True) -> DataFrame:
    """``rows`` without the column ``text``, once for each leaf of that JSON, with ``path, place, value``.

    Paths are like ``a.b[0].c``. ``place`` orders the leaves: preferred keys first, then the others by name, items by number.
    ``value`` is a variant. Without ``arrays`` these are leaves, too. Empty objects and arrays have no leaves; null text and what is no
    JSON give no rows.
    """
    rest, rows = [c for c in rows.columns if c != text], dealt(rows)
    levels = rows.agg(F.max(depth(F.col(text))).alias("n")).first()["n"] or 0
    none = F.array().cast("array<string>")
    out = rows.select(*rest, F.lit("").alias("path"), none.alias("place"), F.try_parse_json(text).alias("value")).where("value IS NOT NULL")
    for _ in range(levels):
        kind = F.schema_of_variant("value")
        keyed = F.transform(
            F.map_entries(F.try_variant_get("value", "$", "map<string,variant>")),
            lambda e: F.struct(F.concat("path", F.when(F.col("path") == "", "").otherwise("."), e["key"]).alias("path"), F.concat("place", F.array(_rank(e["key"]))).alias("place"), e["value"].alias("value")),
        )
        itemed = F.transform(
            F.try_variant_get("value", "$", "array<variant>"),
            lambda v, k: F.struct(F.concat("path", F.lit("["), k.cast("string"), F.lit("]")).alias("path"), F.concat("place", F.array(F.lpad(k.cast("string"), 10, "0"))).alias("place"), v.alias("value")),
        )
        parts = F.when(kind.startswith("OBJECT"), keyed)
        if arrays:
            parts = parts.when(kind.startswith("ARRAY"), itemed)
        out = out.select(*rest, F.inline(parts.otherwise(F.array(F.struct("path", "place", "value")))))
    return out


def _rank(key: Column) -> Column:
    """A text by which preferred keys sort before all others."""
    place = F.array_position(F.array(*[F.lit(x) for x in PREFERRED]), key)
    return F.when(place > 0, F.concat(F.lit("0"), F.lpad(place.cast("string"), 4, "0"))).otherwise(F.concat(F.lit("1"), key))


def leaf_text(value: Column) -> Column:
    """A leaf as text: nothing for null, True or False for a flag, else what it says."""
    flag = F.try_variant_get(value, "$", "boolean")
    kind = F.schema_of_variant(value)
    return F.when(kind == "VOID", "").when(kind == "BOOLEAN", F.when(flag, "True").otherwise("False")).otherwise(F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("")))


def canonical_text(rows: DataFrame, text: str, key: str) -> DataFrame:
    """``key, canonical``: all leaves of each row's JSON in their order, joined by blanks; empty ones are left out.

    Rows of one ``key`` are taken together; a row without leaves has an empty text.
    """
    each = leaves(rows.select(key, text), text).select(key, "place", leaf_text(F.col("value")).alias("leaf")).where("leaf <> ''")
    joined = each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "leaf"))), lambda x: x["leaf"]), " ").alias("canonical"))
    return rows.select(key).distinct().join(joined, key, "left").select(key, F.coalesce("canonical", F.lit("")).alias("canonical"))
