"""Text columns: ids, names, prompts, tables of tab-separated values, token counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a token, and what stands between items of a list.
TOKEN = r"(?U)\w+|[^\w\s]"
ITEM_END = "\n=====\n\n"
UNKNOWN = "UNKNOWN"


@F.pandas_udf(T.LongType())
def content_id(texts: pd.Series) -> pd.Series:
    """Half of the text's unsigned XXH3 64-bit digest, so that it fits a signed number; null for null."""
    import xxhash

    return texts.map(lambda t: None if t is None else xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) // 2).astype("Int64")


def entity_type(kind: Column, allowed: list[str]) -> Column:
    """Upper case without blanks and underscores if that is an allowed type (written likewise), else UNKNOWN."""
    plain = F.upper(F.regexp_replace(kind, "[ _]", ""))
    known = [a.replace(" ", "").replace("_", "").upper() for a in allowed]
    return F.when(plain.isin(known), plain).otherwise(UNKNOWN)


def entity_text(kind: Column, name: Column, description: Column) -> Column:
    """What is embedded for an entity."""
    return F.concat(F.lit("["), kind, F.lit("] "), name, F.when(F.length(description) > 0, F.concat(F.lit("\n[DESCRIPTION] "), description)).otherwise(""))


def generic_text(name: Column) -> Column:
    return F.concat(F.lit("[NONE] "), name)


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("bigint")


def within_limit(text: Column, limit: int) -> Column:
    """The token count if it is within the limit, else null."""
    return F.when(token_count(text) <= limit, token_count(text))


def tsv_row(*columns: Column) -> Column:
    """A row of tab-separated values; a line feed becomes two blanks, a tab one."""
    clean = [F.regexp_replace(F.regexp_replace(c.cast("string"), "\n", "  "), "\t", " ") for c in columns]
    return F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in clean])


def reference_item(position: Column, text: Column, separator: str = ITEM_END) -> Column:
    return F.concat(F.lit("["), position.cast("string"), F.lit("]  "), text, F.lit(separator))


def prompt(template: str, **values: Column) -> Column:
    """The template with {name} replaced by columns; doubled braces stand for themselves."""
    import string

    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        parts += [F.lit(literal)] * bool(literal) + ([F.coalesce(values[name].cast("string"), F.lit(""))] if name else [])
    return F.concat(*parts) if parts else F.lit("")
