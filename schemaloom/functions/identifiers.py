"""Identifiers and literals of SQL dialects.

Queries here are DataFrame plans, so names and values seldom become SQL text; these
functions serve callers that write SQL for a warehouse, and names that callers pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemaloom.errors import ConfigError

# Fixed value: what an unquoted name may be.
_UNQUOTED = r"^[A-Za-z_][A-Za-z0-9_$]*$"
_QUOTED = r'^"((?s:[^"]|"")+)"$'


def folded(name: Column | str) -> Column:
    """A name as the warehouse stores it: unquoted in upper case, quoted as it stands with doubled quotes undone.

    NULL for anything else, an empty name included.
    """
    c = F.col(name) if isinstance(name, str) else name
    inner = F.replace(F.regexp_extract(c, _QUOTED, 1), F.lit('""'), F.lit('"'))
    return F.when(c.rlike(_UNQUOTED) & ~F.contains(c, F.lit("\n")), F.upper(c)).when(c.rlike(_QUOTED), inner)


def fold_name(name: str) -> str:
    """The same for a name that a caller passes; an error if it is no name."""
    if len(name) > 2 and name[0] == name[-1] == '"':
        parts = name[1:-1].split('""')
        if not any('"' in p for p in parts):
            return '"'.join(parts)
    elif name.isascii() and name.replace("$", "_").isidentifier() and name[0] != "$":
        return name.upper()
    raise ConfigError(f"{name!r} is neither a plain name nor a quoted one")


def quoted(name: str) -> str:
    """A name in double quotes."""
    return '"{}"'.format(name.replace('"', '""'))


def back_quoted(name: str) -> str:
    """A name in back quotes; an error if it has one itself."""
    if "`" in name:
        raise ConfigError(f"{name!r} has a back quote")
    return f"`{name}`"


def literal(value: Column | str) -> Column | str:
    """A text as an SQL literal; backslashes and apostrophes are doubled."""
    if isinstance(value, str):
        return "'{}'".format(value.replace("\\", "\\\\").replace("'", "''"))
    return F.concat(F.lit("'"), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
