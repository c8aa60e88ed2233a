"""Text, key and default helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that count as white space when trimming.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not blanks only."""
    return F.btrim(text, F.lit(WHITESPACE))


def squash(text: Column) -> Column:
    """Lower case without any white space; the form in which titles are compared."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_non_empty(*texts: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[non_empty(t) for t in texts])


def default_if_empty(text: Column, default: str) -> Column:
    return F.coalesce(non_empty(text), F.lit(default))


def normal_date(text: Column) -> Column:
    """Raw date text: null and empty become ``''``; everything else is kept."""
    return F.coalesce(text, F.lit(""))


def date_value(text: Column) -> Column:
    """The date behind an eight-digit text, null for any other form."""
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def camel_key(name: str) -> str:
    """``user_name`` -> ``userName``; only a lower-case letter after ``_`` changes."""
    return re.sub(r"_([a-z])", lambda m: m.group(1).upper(), name)


def _renamed(data_type: T.DataType) -> T.DataType:
    if isinstance(data_type, T.StructType):
        names = [camel_key(f.name) for f in data_type.fields]
        if len(set(names)) != len(names):
            raise ValueError(f"keys collide after renaming: {sorted(names)}")
        return T.StructType(
            [T.StructField(n, _renamed(f.dataType), f.nullable)
             for n, f in zip(names, data_type.fields)])
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(_renamed(data_type.elementType), data_type.containsNull)
    return data_type


def camel_columns(df: DataFrame) -> DataFrame:
    """Rename columns and nested struct keys at every depth; values are untouched."""
    target = _renamed(df.schema)
    return df.select([
        F.col(f"`{old.name}`").cast(new.dataType).alias(new.name)
        for old, new in zip(df.schema.fields, target.fields)])


def attribute_map(attributes: Column, prefix: str = "sessionAttr:") -> Column:
    """Map of the prefixed entries, prefix removed; JSON values decoded, other text as it is."""
    chosen = F.map_filter(attributes, lambda k, _: k.startswith(prefix))
    bare = F.transform_keys(chosen, lambda k, _: F.substr(k, F.lit(len(prefix) + 1)))
    parsed = F.try_parse_json
    return F.transform_values(
        bare, lambda _, v: F.when(parsed(v).isNotNull(), parsed(v).cast("string")).otherwise(v))
