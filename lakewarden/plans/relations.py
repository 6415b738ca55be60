"""Row and line relations made from wide tables: the same operators then serve files and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aliases
from ..functions.text import json_string, stripped

JSON_TYPES = {"string": "string", "boolean": "boolean", "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "number", "double": "number"}


def table_rows(df: DataFrame, path: Column, row_num: Column, roles: Column, fields: dict[str, Column], hash_of: Column | None = None) -> DataFrame:
    """A row relation over scalar columns; fields names them as records would.

    row_hash is the hash of hash_of (the canonical JSON of all fields where it is not given).
    A null field is present, as in a record with an explicit null.
    """
    chosen = df.select(path.alias("path"), row_num.cast("long").alias("row_num"), roles.alias("roles"), *[c.alias(f"f_{n}") for n, c in fields.items()], (hash_of if hash_of is not None else F.lit(None).cast("string")).alias("hashed"))
    types, texts, top, context, canon = [], [], [], [], []
    for f in chosen.schema[3:-1]:
        name, value = f.name[2:], F.col(f.name)
        kind = JSON_TYPES[f.dataType.simpleString()]
        quoted = kind == "string"
        shown = lambda v, quoted=quoted: F.coalesce(json_string(v) if quoted else v.cast("string"), F.lit("null"))
        types += [F.lit(name), F.when(value.isNull(), F.lit("null")).otherwise(F.lit(kind))]
        texts += [F.lit(name), value.cast("string")]
        top += [F.lit(name), shown(value)]
        canon.append((name, F.concat(F.lit(f'"{name}":'), shown(stripped(value) if quoted else value))))
    context = [c for n, c in sorted(canon, key=lambda x: x[0]) if n in aliases.CONTEXT]
    whole = lambda members: F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    texts_map = F.create_map(*texts)  # with nulls, so that the planner reads a field's column instead of a map
    text = whole([c for _, c in sorted(canon, key=lambda x: x[0])])
    return chosen.select(
        "path", "row_num", "roles", F.lit("object").alias("kind"), text.alias("canon"), F.concat(F.lit("sha256:"), F.sha2(F.coalesce("hashed", text), 256)).alias("row_hash"),
        F.create_map(*top).alias("top"), F.create_map(*types).alias("types"), texts_map.alias("texts"), F.create_map().cast("map<string,array<string>>").alias("lists"),
        (whole(context) if context else F.lit("{}")).alias("context"), F.lit(None).cast("string").alias("discriminator"),
    )


def text_lines(df: DataFrame, path: Column, roles: Column, text: Column) -> DataFrame:
    """A line relation: physical lines, numbered from 1."""
    lines = df.select(path.alias("path"), roles.alias("roles"), F.posexplode(F.split(text, "\r\n|\r|\n")).alias("pos", "line"))
    return lines.select("path", (F.col("pos") + 1).cast("long").alias("line_num"), "roles", "line")
