"""Identifier builders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(name: Column | str) -> Column:
    """Lower case; every space and hyphen becomes an underscore.  NULL stays NULL."""
    c = F.col(name) if isinstance(name, str) else name
    return F.replace(F.replace(F.lower(c.cast("string")), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))


def dotted(*names: Column | str) -> Column:
    """Normalised names joined by dots; NULL if any name is NULL."""
    parts = [normalize(n) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit("."), p)
    return out


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def value_hash(value: Column | str) -> Column:
    """MD5 hex digest of the value's text; NULL counts as the empty text."""
    return F.md5(F.coalesce(_s(value), F.lit("")))


database_id = normalize


def schema_id(database: Column | str, schema: Column | str) -> Column:
    return dotted(database, schema)


def table_id(database: Column | str, schema: Column | str, table: Column | str) -> Column:
    return dotted(database, schema, table)


def column_id(database: Column | str, schema: Column | str, table: Column | str, column: Column | str) -> Column:
    return dotted(database, schema, table, column)


def value_id(database, schema, table, column, value) -> Column:
    """The column's id, a dot and the digest of the value."""
    return F.concat(column_id(database, schema, table, column), F.lit("."), value_hash(value))


def glossary_id(glossary) -> Column:
    return normalize(glossary)


def category_id(glossary, category) -> Column:
    return dotted(glossary, category)


def term_id(glossary, category, term) -> Column:
    return dotted(glossary, category, term)


def tag_key_id(source, key) -> Column:
    return dotted(source, key)


def tag_value_id(source, key, value) -> Column:
    return F.concat(dotted(source, key), F.lit("."), value_hash(value))


def tag_assignment_id(object_id, key, value) -> Column:
    """An object's tag: its id as it stands, the normalised key, the digest of the value."""
    return F.concat(_s(object_id), F.lit("."), normalize(key), F.lit("."), value_hash(value))


def query_id(text) -> Column:
    return F.sha2(_s(text), 256)


def cte_id(query, name) -> Column:
    return F.concat(_s(query), F.lit("."), normalize(name))


def model_id(name) -> Column:
    return normalize(name)


def metric_id(model, name) -> Column:
    return dotted(model, name)


def join_id(model, name) -> Column:
    return dotted(model, name)


def expression_id(owner, dialect, expression) -> Column:
    return F.concat(_s(owner), F.lit("."), F.md5(F.concat(_s(dialect), F.lit("::"), _s(expression))))


def ai_context_id(owner, data) -> Column:
    return F.concat(_s(owner), F.lit("."), F.md5(_s(data)))


def custom_extension_id(owner, vendor, data) -> Column:
    return F.concat(_s(owner), F.lit("."), F.md5(F.concat(_s(vendor), F.lit("::"), _s(data))))


def question_id(question, sql) -> Column:
    """A question with its gold query; outer white space of either does not count."""
    plain = lambda c: F.regexp_replace(_s(c), r"^\s+|\s+$", "")
    return F.sha2(F.concat(plain(question), F.lit("\n"), plain(sql)), 256)


def query_column_id(query, column) -> Column:
    """A column owned by a query rather than by a table."""
    return F.concat(_s(query), F.lit("."), normalize(column))
