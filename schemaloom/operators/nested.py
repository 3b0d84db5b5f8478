"""Deeply nested semi-structured records to related flat tables.

A record is a JSON text.  :func:`flatten` parses it into a VARIANT, infers one
merged schema over all records, and explodes every level of arrays into a child
table.  A child row carries its record's key and surrogate key and its place at
each level (``pos_0``, ``pos_1`` ..., counted from 0 and including entries that are
null), so the link to the parent row is an equi-join on key and leading positions.

Records are parsed once and written as VARIANT; one aggregate infers the schema of
all levels.  Exporters disagree on layout.  A list may come as a list, as one bare
object (a list of one) or as a text that encodes either; a whole record may be a
text that encodes the record, any number of times.  Paths whose kinds conflict come
out of the inference as VARIANT and are treated as possible lists, so none of these
spellings loses rows; what lies below such a path is inferred from its own entries.

Levels are named by their path: ``""`` is the record, ``tables.columns`` a list in the
entries of a list, and ``[]`` stands for a list that is itself an entry, or the record.
Entries that are no objects give their text as ``value``.

Defined results: a NULL, empty, cut-off or otherwise invalid text gives a record
without children; text after the JSON value makes it invalid; an object that
repeats a member is invalid unless ``spark.sql.variant.allowDuplicateKeys`` is
set; entries of a list that are null keep their place and give a child row with
NULL members.  Equal records each give their own rows, told apart by the surrogate
key.  Members whose names differ only by case, or dotted names that clash, give
columns with ``_value`` added.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.type_text import member_paths_udf, parse_type
from schemaloom.materialize import materialize

_END = '"\\u0001end"'
_BLANKS = " \t\r\n"
#: The step of a path that stands for a list within a list.
ENTRY = "[]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_strict(text: Column) -> Column:
    """VARIANT of a JSON text, NULL unless the whole text is one JSON value.

    ``try_parse_json`` stops after the first value, so the text is parsed as the
    head of a two-element list whose tail is a known mark.
    """
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f",{_END}]")))
    whole = lambda p: (F.try_variant_get(p, "$[1]", "string") == F.lit("\u0001end")) & F.try_variant_get(p, "$[2]", "variant").isNull()
    return _let(pair, lambda p: F.when(whole(p), F.try_variant_get(p, "$[0]", "variant")))


def _open_text(text: Column) -> Column:
    """A text that is a JSON string stands for the string's content, and so on until none is left.

    Encoding a text once more adds at least five characters for each backslash and quote
    it has, and each time there are more of these: n characters hold less than sqrt(n) + 1 levels.
    """
    is_text = lambda t: F.ltrim(t, F.lit(_BLANKS)).startswith('"')
    once = lambda t, _: F.when(is_text(t), F.try_variant_get(parse_strict(t), "$", "string")).otherwise(t)
    levels = F.when(is_text(text), F.floor(F.sqrt(F.length(text))).cast("int") + 1).otherwise(0)
    return F.aggregate(F.array_repeat(F.lit(1), levels), text, once)


def decode(text: Column) -> Column:
    """VARIANT of what a JSON text, or a text that encodes such a text, stands for."""
    return parse_strict(_open_text(text))


def _entries(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def as_list(v: Column) -> Column:
    """array<variant> of a list, of one object, or of a text of either; NULL for anything else."""
    plain = lambda x: F.coalesce(_entries(x), F.when(_is_object(x), F.array(x)))
    text = F.try_variant_get(v, "$", "string")
    return F.coalesce(plain(v), _let(decode(text), plain))


def member(v: Column, steps: tuple[str, ...]) -> Column:
    """VARIANT of a member of a member ...; any name is allowed."""
    path = "$"
    for name in steps:
        quote = next((q for q in "'\"" if name and q not in name), None)
        if quote:
            path += f"[{quote}{name}{quote}]"
            continue
        # a name that no path can spell
        v = v if path == "$" else F.try_variant_get(v, path, "variant")
        v, path = F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(name)), "$"
    return F.try_variant_get(v, path, "variant")


@dataclass(frozen=True)
class Kinds:
    """What the values of a level are: the merged schema of the objects, and whether there are lists and scalars."""

    schema: Any
    lists: bool = False
    scalars: bool = False

    @classmethod
    def of(cls, kind: Any) -> Kinds | None:
        """Of the entries of a list with the inferred element type; None if that leaves it open."""
        if isinstance(kind, tuple):
            return cls(kind) if kind[0] == "struct" else cls("VOID", lists=True)
        if kind.upper() == "VARIANT":
            return None
        return cls("VOID", scalars=kind.upper() != "VOID")


def merged_schema(values: DataFrame, column: str = "value") -> Kinds:
    """The kinds of all values: one distributed aggregate, a single row to the driver.

    Only objects have members; with others among them the merge would be VARIANT.
    """
    v = F.col(column)
    is_object, is_list = _is_object(v), _entries(v).isNotNull()
    scalar = v.isNotNull() & ~F.is_variant_null(v) & ~is_object & ~is_list
    text, lists, scalars = values.agg(F.schema_of_variant_agg(F.when(is_object, v)), F.count_if(is_list), F.count_if(scalar)).first()
    return Kinds(parse_type(text, exact=True), lists > 0, scalars > 0)


@dataclass
class Level:
    """One table of the result: its path, the rows and what their values are."""

    path: str
    rows: DataFrame
    keys: list[str]
    known: Kinds | None = None
    children: dict[str, Level] = field(default_factory=dict)

    @property
    def kinds(self) -> Kinds:
        """Known from the level above, or else inferred from the rows."""
        if self.known is None:
            self.known = merged_schema(self.rows)
        return self.known

    def table(self, *, members: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
        """Keys, positions and the scalar members as text columns.

        ``members`` maps output columns to the names on the way to them; by default every
        scalar of the merged schema is taken, nested objects dotted, and ``value`` holds
        the entries that are no objects.
        """
        v = F.col("value")
        wanted = [(".".join(p), member(v, p)) for p, t in _leaves(self.kinds.schema) if not isinstance(t, tuple)] if members is None else [(n, member(v, p)) for n, p in members.items()]
        columns = [(n, F.try_variant_get(m, "$", "string")) for n, m in wanted]
        if members is None and self.kinds.scalars:
            columns.append(("value", F.when(~_is_object(v) & _entries(v).isNull(), F.try_variant_get(v, "$", "string"))))
        taken, out = {k.lower() for k in self.keys}, []
        for name, column in columns:
            while name.lower() in taken:
                name += "_value"
            taken.add(name.lower())
            out.append(column.alias(name))
        return self.rows.select(*self.keys, *out)


def _leaves(schema: Any) -> list[tuple[tuple[str, ...], Any]]:
    """(path, type) of every member below one row that is no object, in order."""
    out, todo = [], [((), schema)]
    while todo:
        steps, kind = todo.pop()
        if isinstance(kind, tuple) and kind[0] == "struct":
            todo += [((*steps, n), t) for n, t in reversed(kind[1])]
        elif steps:
            out.append((steps, kind))
    return out


def _lists(schema: Any) -> list[tuple[tuple[str, ...], Any]]:
    """Paths below one row that are lists or, the kinds conflicting, may be; with the element type, VARIANT if open."""
    found = [(p, t[1][0] if t[1] else "VOID") for p, t in _leaves(schema) if isinstance(t, tuple)]
    return found + [(p, t) for p, t in _leaves(schema) if isinstance(t, str) and t.upper() == "VARIANT"]


def _wanted_lists(level: Level, wanted: set[tuple[str, ...]], at: tuple[str, ...]) -> list[tuple[tuple[str, ...], Any]]:
    """The next steps of the wanted paths that pass through ``at``; those that no record is known to have are left out."""
    nexts = sorted({w[len(at)] for w in wanted if len(w) > len(at) and w[: len(at)] == at})
    if level.known is None:
        return [((n,), "VARIANT") for n in nexts]
    schema = level.known.schema
    there = dict(schema[1]) if isinstance(schema, tuple) and schema[0] == "struct" else {}
    element = lambda t: t[1][0] if isinstance(t, tuple) and t[0] != "struct" and t[1] else "VARIANT"
    return [((n,), element(there[n])) for n in nexts if n in there]


def open_records(df: DataFrame, key: str, text: str, surrogate: str = "row_key") -> DataFrame:
    """(surrogate, key, value): each text decoded once and written, under a key of its own; keys are never null-filtered."""
    return materialize(df.select(F.monotonically_increasing_id().alias(surrogate), F.col(key), decode(F.col(text)).alias("value")), "records")


def explode_level(rows: DataFrame, keys: list[str], entries: Column, ordinal: str) -> DataFrame:
    """The entries of a list below ``value``, with their places."""
    return rows.select(*keys, F.posexplode(entries).alias(ordinal, "value"))


def flatten(df: DataFrame, key: str, text: str, *, surrogate: str = "row_key", wanted: set[str] | None = None) -> dict[str, Level]:
    """All levels by path; the root is ``""``, a child e.g. ``tables.columns``.

    ``wanted`` keeps only the named list paths and those above them; every step of such a
    path is taken for a list, even where all records have a bare object or a text there.
    """
    levels: dict[str, Level] = {}
    keys = [surrogate, key]
    chosen = None if wanted is None else {tuple(w.split(".")) for w in wanted}
    todo = [((), Level("", open_records(df, key, text, surrogate), keys))]
    todo[0][1].kinds  # noqa: B018  the one aggregate that infers the levels
    while todo:
        at, level = todo.pop()
        levels[level.path] = level
        if chosen is None:
            below = _lists(level.kinds.schema)
            if level.kinds.lists:
                below = [*below, ((ENTRY,), "VARIANT")]
        else:
            below = _wanted_lists(level, chosen, at)
        for steps, kind in below:
            name = ".".join((*at, *steps))
            ordinal = f"pos_{len(level.keys) - 2}"
            value = F.col("value")
            entries = _entries(value) if steps == (ENTRY,) else as_list(member(value, steps))
            child = level.children[name] = Level(name, explode_level(level.rows, level.keys, entries, ordinal), [*level.keys, ordinal], Kinds.of(kind))
            todo.append(((*at, *steps), child))
    return levels


def nested_rows(audit: DataFrame, pages: DataFrame) -> DataFrame:
    """Permission, column and field rows of audit payloads and catalog pages, in one table."""
    parts = []
    grants = flatten(audit, "delivery_id", "proto_payload", wanted={"authorizationInfo"})
    if "authorizationInfo" in grants:
        t = grants["authorizationInfo"].table(members={"permission": ("permission",)})
        parts.append(t.filter(F.col("permission") != "").select(F.lit("permission").alias("record_kind"), F.col("delivery_id").alias("record_id"), F.lit(-1).alias("parent_pos"), F.col("pos_0").alias("child_pos"), F.col("permission").alias("child_path")))
    tables = flatten(pages, "page_id", "payload", wanted={"tables.columns"})
    if "tables.columns" in tables:
        t = tables["tables.columns"].table(members={"name": ("name",), "type_text": ("type_text",)}).filter(F.col("name") != "")
        kinds = F.array(F.struct(F.lit("column").alias("record_kind"), F.col("name").alias("child_path")))
        fields = F.transform(F.coalesce(F.col("members"), F.array()), lambda p: F.struct(F.lit("field").alias("record_kind"), F.concat("name", F.lit("."), p).alias("child_path")))
        rows = t.withColumn("members", member_paths_udf("type_text")).select("page_id", "pos_0", "pos_1", F.explode(F.concat(kinds, fields)).alias("r"))
        parts.append(rows.select("r.record_kind", F.col("page_id").alias("record_id"), F.col("pos_0").alias("parent_pos"), F.col("pos_1").alias("child_pos"), "r.child_path"))
    empty = "record_kind string, record_id bigint, parent_pos int, child_pos int, child_path string"
    out = audit.sparkSession.createDataFrame([], empty)
    for p in parts:
        out = out.unionByName(p)
    return out
