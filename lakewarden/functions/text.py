"""Column functions over text, record fields and placeholders; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import aliases

# fixed values: patterns of sensitive values and of template placeholders
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
PHONE = r"\b(?:\+\d{1,3}[-.\s])?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b"
API_KEY = r"(?i)\b(?:api_key|apikey|secret|token|password)\s*[:=]\s*([^\s]{12,})"
PRIVATE_KEY = "BEGIN PRIVATE KEY"
PLACEHOLDER = r"\{\{\s*[A-Za-z_][A-Za-z0-9_]*\s*\}\}|\$\{\s*[A-Za-z_][A-Za-z0-9_]*\s*\}|(?<!\{)\{[A-Za-z_][A-Za-z0-9_]*\}(?!\})"
INTERPOLATION = r"\{\{\s*[A-Za-z_][A-Za-z0-9_]*\s*\}\}|\$\{\s*[A-Za-z_][A-Za-z0-9_]*\s*\}|\{[A-Za-z_][A-Za-z0-9_]*\}|<[A-Za-z_][A-Za-z0-9_]*>"
# fixed values: the code points of white space
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without surrounding Unicode white space."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def plain_text(text: Column) -> Column:
    """One kind of line end, no surrounding white space, runs of space, tab and line feed as one space."""
    return F.regexp_replace(stripped(F.regexp_replace(text, r"\r\n?", "\n")), r"[ \t\n]+", " ")


def prefixed_sha(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def bare_fingerprint(value: Column) -> Column:
    return F.regexp_replace(F.lower(stripped(value)), "^sha256:", "")


def is_fingerprint(value: Column) -> Column:
    return bare_fingerprint(value).rlike("^[0-9a-f]{64}$")


def is_trivial(answer: Column) -> Column:
    low = F.lower(stripped(answer))
    return low.isin(*aliases.TRIVIAL_ANSWERS) | low.rlike(r"^(?U)[\p{L}\p{N}]$")


def redacted(kind: Column | str, value: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit("<"), kind, F.lit(">:sha256:"), F.sha2(value, 256))


def has_role(roles: Column, *wanted: str) -> Column:
    return F.arrays_overlap(roles, F.array(*[F.lit(w) for w in wanted]))


def is_scalar(name: str) -> Column:
    return F.col("types")[name].isin("string", "integer", "number", "non_finite_number")


def first_scalar(names: tuple[str, ...]) -> Column:
    """(field, value) of the first alias with a filled scalar, trimmed; null if there is none."""
    options = []
    for name in names:
        value = stripped(F.col("texts")[name])
        options.append(F.when(is_scalar(name) & (value != ""), F.struct(F.lit(name).alias("field"), value.alias("value"))))
    return F.coalesce(*options)


def first_filled_string(names: tuple[str, ...]) -> Column:
    """(field, value) of the first alias with a string that is not blank, as it is."""
    return F.coalesce(*[F.when((F.col("types")[n] == "string") & (stripped(F.col("texts")[n]) != ""), F.struct(F.lit(n).alias("field"), F.col("texts")[n].alias("value"))) for n in names])


def identifier(name: str) -> Column:
    value = stripped(F.col("texts")[name])
    return F.when(F.col("types")[name].isin("string", "integer", "number") & (value != ""), value)


def context_references(scalars: tuple[str, ...], lists: tuple[str, ...] = aliases.CONTEXT_ID_LIST) -> Column:
    """All references of a record as (field, value), scalars before lists."""
    single = F.array_compact(F.array(*[F.when(identifier(n).isNotNull(), F.struct(F.lit(n).alias("field"), identifier(n).alias("value"))) for n in scalars]))
    many = [F.transform(F.coalesce(F.col("lists")[n], F.array().cast("array<string>")), _named(n)) for n in lists]
    return F.concat(single, *many)


def _named(name: str):
    return lambda v: F.struct(F.lit(name).alias("field"), v.alias("value"))


def content_state() -> Column:
    """filled, empty or null (cannot tell) for a retrieval record's content fields."""
    present = [F.col("types")[n].isNotNull() for n in aliases.RAG_CONTENT]
    filled = [F.coalesce((F.col("types")[n] == "string") & (stripped(F.col("texts")[n]) != ""), F.lit(False)) for n in aliases.RAG_CONTENT]
    blank = [F.col("types")[n].isNull() | (F.col("types")[n] == "null") | ((F.col("types")[n] == "string") & (stripped(F.col("texts")[n]) == "")) for n in aliases.RAG_CONTENT]
    some, any_filled, all_blank = present[0], filled[0], blank[0]
    for p, f, b in zip(present[1:], filled[1:], blank[1:], strict=True):
        some, any_filled, all_blank = some | p, any_filled | f, all_blank & b
    return F.when(any_filled, F.lit("nonempty")).when(some & all_blank, F.lit("empty"))


def content_fields() -> Column:
    return F.array_compact(F.array(*[F.when(F.col("types")[n].isNotNull(), F.lit(n)) for n in aliases.RAG_CONTENT]))


def first_rows(rows: DataFrame, keys: list[str], order: list[Column | str], items: dict[str, Column | str], limit: int = aliases.EVIDENCE_LIMIT) -> DataFrame:
    """Per key the first rows by an order, as arrays of the given columns in that order.

    Ranked before they are gathered: the planner keeps `limit` rows of a key in each
    task before the shuffle, so no group is held whole however large it is.
    """
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    first = rows.select(*keys, place.alias("_place"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in items.items()]).where(F.col("_place") <= limit)
    gathered = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_place", *items))).alias("_all"))
    return gathered.select(*keys, *[F.col(f"_all.{n}").alias(n) for n in items])


# fixed values: how JSON writes the characters that it escapes
SHORT_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
RARE_ESCAPES = {"\b": "\\b", "\f": "\\f"}


def json_string(text: Column) -> Column:
    """Text as a JSON string, in the canonical form: other control characters as \\u and four lower-case digits."""
    out = text
    for char, written in SHORT_ESCAPES.items():
        out = F.replace(out, F.lit(char), F.lit(written))
    rest = {chr(c): RARE_ESCAPES.get(chr(c), f"\\u{c:04x}") for c in range(32) if chr(c) not in SHORT_ESCAPES}
    table = F.create_map(*[F.lit(x) for pair in rest.items() for x in pair])
    rare = F.array_join(F.transform(F.split(out, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), rare).otherwise(out), F.lit('"'))
