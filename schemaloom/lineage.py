"""SQL lineage from Spark's own parser.

The only module that reaches into the session's JVM objects.  A query text is
parsed to an unresolved plan (no catalogue is needed) and walked once, by
``PlanReader.java``, which Spark's own Janino compiles: frames of texts are cut, parsed
and named in the executors' JVMs, single texts are parsed in the driver's.  A text may
hold several statements; each counts by itself, and equal ones of a text, like equal
texts, are parsed once.  In tasks, statements that differ only in names and literals are
parsed once too, if nothing in them makes the parser look at those, and those that begin
as no statement can are not parsed (see ``PlanReader.java``).  What Java might take
otherwise than Python is left to Python.  What the parser cannot read is skipped with a
warning that names the error's type and nothing of the text.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import warnings
import zipfile
from collections import Counter
from collections.abc import Collection
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom import ids
from schemaloom.errors import ConfigError, SchemaloomWarning
from schemaloom.materialize import materialize
from schemaloom.sources.rows import edges_of, nodes_of
from schemaloom.store import GraphBatch

# Platform and service by dialect.
DIALECTS = {"bigquery": ("GCP", "BIGQUERY"), "snowflake": ("SNOWFLAKE", "SNOWFLAKE")}
_REWRITES = [(r"\bSAFE_CAST\s*\(", "TRY_CAST("), (r"\bINT64\b", "BIGINT"), (r"\bFLOAT64\b", "DOUBLE"), (r"\bBYTES\b", "BINARY"), (r"\bNUMBER\b(?=\s*[),])", "DECIMAL"), (r"::\s*NUMBER\b", "::DECIMAL")]
_REWRITTEN = ("SAFE_CAST", "INT64", "FLOAT64", "BYTES", "NUMBER")

#: Statements in one batch of a task.
BATCH_ROWS = 20_000
_PIECES = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;", re.DOTALL)
_LEADING = re.compile(r"(?:\s+|--[^\n]*(?:\n|$)|/\*.*?\*/)*", re.DOTALL)


def statements(text: str) -> list[str]:
    """The statements of a text, without the comments before them; quotes and comments hide semicolons."""
    ends = [m.start() for m in _PIECES.finditer(text) if m.group() == ";"]
    cut = [text[a:b] for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(text)])]
    return [x for c in cut if (x := c[_LEADING.match(c).end() :].rstrip())]


@dataclass
class Parsed:
    """What a query text names; tables are (parts, alias)."""

    tables: list[tuple[list[str], str | None]] = field(default_factory=list)
    columns: list[tuple[str | None, str]] = field(default_factory=list)
    equalities: list[tuple[tuple[str | None, str], tuple[str | None, str], str, bool]] = field(default_factory=list)
    joins: list[tuple[str, str]] = field(default_factory=list)
    ctes: list[tuple[str, str]] = field(default_factory=list)


def _norm(name: str) -> str:
    return name.lower().replace(" ", "_").replace("-", "_")


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _rewritten(text: str) -> bool:
    """Whether a text may differ from its plain form."""
    upper = text.upper()
    return not text.isascii() or any(word in upper for word in _REWRITTEN)


class _Text:
    """A text, the form of it that the parser reads, and the way back from places in that form."""

    def __init__(self, text: str, *, same: bool = False):
        """``same``: the text is known to be its plain form."""
        self.text = self.plain = text
        # by character of the plain form, the characters of the text it stands for; None while they are the same
        first: list[int] | None = None
        last: list[int] | None = None
        for pattern, put in _REWRITES if not same and _rewritten(text) else ():
            if not (found := list(re.finditer(pattern, self.plain, flags=re.IGNORECASE))):
                continue
            if first is None:
                first, last = list(range(len(text))), list(range(len(text)))
            out, f, e, at = [], [], [], 0
            for m in found:
                a, b = m.span()
                out += [self.plain[at:a], put]
                f += first[at:a] + [first[a]] * len(put)
                e += last[at:a] + [last[b - 1]] * len(put)
                at = b
            self.plain, first, last = "".join([*out, self.plain[at:]]), f + first[at:], e + last[at:]
        self._first, self._last = first, last

    def source(self, start: int, stop: int) -> str:
        """The text behind the characters ``start`` to ``stop`` (inclusive) of the plain form; the parser counts code points."""
        return self.text[start : stop + 1] if self._first is None else self.text[self._first[start] : self._last[stop] + 1]


class _Walker:
    def __init__(self, text: _Text, parsed: Parsed):
        self.text, self.out = text, parsed

    def source(self, node) -> str:
        o = node.origin()
        if o.startIndex().isDefined() and o.stopIndex().isDefined():
            return self.text.source(o.startIndex().get(), o.stopIndex().get())
        return ""

    def expression(self, e) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedAttribute":
            parts = list(_seq(e.nameParts()))
            self.out.columns.append((parts[-2] if len(parts) > 1 else None, parts[-1]))
        elif hasattr(e, "plan") and "Subquery" in kind or kind in ("Exists", "ListQuery", "InSubquery"):
            plans = [e.plan()] if kind not in ("InSubquery",) else [e.query().plan()]
            for p in plans:
                self.plan(p)
            if kind == "InSubquery":
                for v in _seq(e.values()):
                    self.expression(v)
            return
        for child in _seq(e.children()):
            self.expression(child)

    def operand(self, e) -> tuple[str | None, str] | None:
        if e.getClass().getSimpleName() != "UnresolvedAttribute":
            return None
        parts = list(_seq(e.nameParts()))
        return (parts[-2] if len(parts) > 1 else None, parts[-1])

    def conjuncts(self, e, whole: str, single: bool) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "And":
            for child in _seq(e.children()):
                self.conjuncts(child, whole, False)
        elif kind == "EqualTo":
            a, b = self.operand(e.left()), self.operand(e.right())
            if a and b:
                self.out.equalities.append((a, b, self.source(e) or whole, single))

    def plan(self, p, alias: str | None = None) -> None:
        kind = p.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            for cte in _seq(p.innerChildren()):
                self.out.ctes.append((cte.alias(), self.source(cte.child())))
                self.plan(cte.child())
        elif kind == "UnresolvedRelation":
            parts = [x for part in _seq(p.multipartIdentifier()) for x in part.split(".")]
            self.out.tables.append((parts, alias))
        elif kind == "Join" and p.condition().isDefined():
            c = p.condition().get()
            right = self.leaf(p.right())
            self.out.joins.append((right, self.source(c) or c.sql()))
            self.conjuncts(c, self.source(c), True)
        for e in _seq(p.expressions()):
            self.expression(e)
        for child in _seq(p.children()):
            self.plan(child, p.alias() if kind == "SubqueryAlias" else None)

    def leaf(self, p) -> str:
        while p.getClass().getSimpleName() == "SubqueryAlias":
            p = p.child()
        if p.getClass().getSimpleName() != "UnresolvedRelation":
            return ""
        parts = [x for part in _seq(p.multipartIdentifier()) for x in part.split(".")]
        return ".".join(parts[-2:])


_READERS: dict[str, object] = {}


def _reader(spark: SparkSession):
    """The session's plan reader, compiled once for an application and known to its executors."""
    context = spark.sparkContext
    if context.applicationId not in _READERS:
        jvm, new = context._jvm, context._gateway.new_array
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        with open(os.path.join(os.path.dirname(__file__), "PlanReader.java")) as source:
            compiler.cook(source.read())
        jar = os.path.join(tempfile.mkdtemp(dir=context._temp_dir), "schemaloom-plan-reader.jar")
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in compiler.getBytecodes().items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        context._jsc.addJar(jar)
        made = compiler.getClassLoader().loadClass("schemaloom.PlanReader").getDeclaredConstructor(new(jvm.java.lang.Class, 0))
        _READERS[context.applicationId] = made.newInstance(new(jvm.java.lang.Object, 0))
    return _READERS[context.applicationId]


def _plan_json(spark: SparkSession, statement: Column, kinds: Collection[str]) -> Column:
    """What the plan of each statement names, as far as the kinds of rows need it, or the error's type."""
    kind = spark.sparkContext._jvm.org.apache.spark.sql.types.DataType.fromDDL("string")
    spark._jsparkSession.udf().register("schemaloom_plan_json", _reader(spark).of("column_info" in kinds, "references_info" in kinds), kind)
    return F.call_udf("schemaloom_plan_json", statement)


def _rows_of(spark: SparkSession, kinds: Collection[str], shape: str, default_database: str | None, default_schema: str | None, mode: str) -> Column:
    """The rows of all statements of a text, by kind, the errors' types, and the statements left to Python."""
    reader = _reader(spark).rows(",".join(kinds), default_database, default_schema, mode == "compat")
    kind = spark.sparkContext._jvm.org.apache.spark.sql.types.DataType.fromDDL(shape)
    spark._jsparkSession.udf().register("schemaloom_lineage", reader, kind)
    return F.call_udf("schemaloom_lineage", F.col("query_id"), F.col("text"))


def may_select(spark: SparkSession, text: Column) -> Column:
    """Whether a text may hold the word SELECT in any case, by its bytes; true for all that do."""
    kind = spark.sparkContext._jvm.org.apache.spark.sql.types.DataType.fromDDL("boolean")
    spark._jsparkSession.udf().register("schemaloom_may_select", _reader(spark).maySelect(), kind)
    return F.call_udf("schemaloom_may_select", text.cast("binary"))


def _parsed(known: _Text, found: dict) -> Parsed:
    source = lambda at: known.source(*at) if at else ""
    return Parsed(
        tables=[(parts, alias) for parts, alias in found["tables"]],
        columns=[(q, c) for q, c in found.get("columns", ())],
        equalities=[((*a,), (*b,), source(at), single) for a, b, at, single in found.get("equalities", ())],
        joins=[(right, source(at) or sql) for right, at, sql in found.get("joins", ())],
        ctes=[(name, source(at)) for name, at in found["ctes"]],
    )


def parse(spark: SparkSession, text: str, *, walk: bool = False) -> Parsed:
    """Raises what the parser raises.  ``walk`` reads the plan node by node from Python, which is slower and gives the same."""
    known = _Text(text)
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(known.plain)
    if not walk:
        return _parsed(known, json.loads(_reader(spark).read(plan)))
    parsed = Parsed()
    _Walker(known, parsed).plan(plan)
    return parsed


def can_be_analysed(spark: SparkSession, text: str) -> bool:
    """Whether a statement parses and resolves; commands are not run."""
    state = spark._jsparkSession.sessionState()
    skip = spark.sparkContext._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()
    try:
        state.executePlan(state.sqlParser().parsePlan(text), skip).assertAnalyzed()
    except Exception:
        return False
    return True


def lineage(spark: SparkSession, text: str, query_id: str, *, dialect: str = "bigquery", default_database: str | None = None, default_schema: str | None = None, mode: str = "resolved") -> dict[str, list[dict]] | None:
    """Tables, columns, references and CTEs of one query; None if it cannot be read.

    ``resolved`` gives every equality of a join condition as a reference, each side by its
    own qualifier.  ``compat`` takes only conditions of a single predicate and gives both
    sides the way older graphs have them: the joined table with the predicate's right side.
    """
    _check(dialect, mode)
    try:
        return _named(parse(spark, text), query_id, dialect, default_database, default_schema, mode)
    except Exception as e:
        warnings.warn(f"a query text could not be read ({type(e).__name__}); it is skipped", SchemaloomWarning, stacklevel=2)
        return None


def _check(dialect: str, mode: str) -> None:
    if dialect not in DIALECTS:
        raise ConfigError(f"unsupported dialect {dialect!r}")
    if mode not in ("resolved", "compat"):
        raise ConfigError(f"unknown mode {mode!r}")


def _named(p: Parsed, query_id: str, dialect: str, default_database: str | None, default_schema: str | None, mode: str) -> dict[str, list[dict]]:
    platform, service = DIALECTS[dialect]
    ctes = {name for name, _ in p.ctes}
    by_name: dict[str, str] = {}
    tables, names = [], {}
    for parts, alias in p.tables:
        name = parts[-1]
        if (len(parts) == 1 and name in ctes) or (name.startswith("__") and name.endswith("__")):
            continue
        database = parts[-3] if len(parts) > 2 else default_database
        schema = parts[-2] if len(parts) > 1 else default_schema
        if not database or not schema:
            raise ConfigError("a table has neither its own nor a default database and schema")
        table_id = ".".join(map(_norm, (database, schema, name)))
        by_name[name] = table_id
        names[table_id] = name
        if alias:
            by_name[alias] = table_id
        tables.append({"platform": platform, "service": service, "table_id": table_id, "table_name": name, "schema_id": ".".join(map(_norm, (database, schema))), "schema_name": schema, "database_name": database, "table_alias": alias or "", "query_id": query_id})
    column = lambda t, c: f"{t}.{_norm(c)}"
    columns = [{"table_id": by_name[q], "table_alias": q, "column_name": c, "column_id": column(by_name[q], c), "query_id": query_id} for q, c in p.columns if q in by_name and c != "*"]
    refs = []
    aliased = {a for _, a in p.tables if a}
    for (qa, ca), (qb, cb), text_, single in p.equalities:
        if mode == "compat":
            joined = [t for t in p.joins if t[1] == text_ and single]
            right = by_name.get(joined[0][0].split(".")[-1]) if joined else None
            if not right or qa not in by_name or not aliased:
                continue
            left_id, right_id = column(right, cb), column(by_name[qa], ca)
        elif qa in by_name and qb in by_name:
            left_id, right_id = column(by_name[qb], cb), column(by_name[qa], ca)
        else:
            continue
        if left_id != right_id:
            refs.append({"left_column_id": left_id, "right_column_id": right_id, "criteria": text_, "query_id": query_id})
    made = [{"cte_id": f"{query_id}.{_norm(n)}", "cte_name": n, "definition": d, "query_id": query_id} for n, d in p.ctes]
    return {"table_info": tables, "column_info": columns, "references_info": refs, "cte_info": made}


_SHAPES = {
    "table_info": "platform string, service string, table_id string, table_name string, schema_id string, schema_name string, database_name string, table_alias string, query_id string",
    "column_info": "table_id string, table_alias string, column_name string, column_id string, query_id string",
    "references_info": "left_column_id string, right_column_id string, criteria string, query_id string",
    "cte_info": "cte_id string, cte_name string, definition string, query_id string",
}


def _columns(kind: str) -> list[str]:
    return [c.split()[0] for c in _SHAPES[kind].split(", ")]


@dataclass
class _Read:
    """What has been read: the distinct texts, the rows of each text, and those of the statements that Python had to read."""

    distinct: DataFrame
    texts: DataFrame
    rest: DataFrame | None

    def rows(self, kind: str) -> DataFrame:
        """Rows of a kind, without what all rows have."""
        columns = ["query_id", *_own(kind)]
        rows = self.texts.select("query_id", F.inline(f"found.{kind}")).select(columns)
        return rows if self.rest is None else rows.unionAll(self.rest.select("query_id", F.inline(kind)).select(columns))


def _own(kind: str) -> list[str]:
    return [c for c in _columns(kind) if c not in ("platform", "service", "query_id")]


def _read(queries: DataFrame, kinds: Collection[str], text: str, dialect: str, default_database: str | None, default_schema: str | None, mode: str) -> _Read:
    """Reads all statements of all distinct texts in tasks, the texts' rows together."""
    _check(dialect, mode)
    if unknown := set(kinds) - set(_SHAPES):
        raise ConfigError(f"unknown kinds {sorted(unknown)}")
    spark, most = queries.sparkSession, BATCH_ROWS
    # what every row has, or the statement has, is no part of the lists
    fields = {k: _own(k) for k in _SHAPES if k in kinds}

    def cut(batches):
        for b in batches:
            known = []
            for q, t in zip(*(c.to_pylist() for c in b.columns)):
                other = _rewritten(t)
                known += [(q, x, plain if other and (plain := _Text(x).plain) != x else None) for x in dict.fromkeys(statements(t))]
            for k in range(0, len(known), most):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*known[k : k + most])], ["query_id", "text", "plain"])

    def named(batches):
        for b in batches:
            errors: list[str | None] = []
            rows: dict[str, list[dict]] = {k: [] for k in fields}
            ends = {k: [0] for k in fields}
            for q, x, other, found in zip(*(c.to_pylist() for c in b.columns)):
                got, error = {}, None
                try:
                    found = json.loads(found)
                    error = found.get("error")
                    if not error:
                        got = _named(_parsed(_Text(x, same=not other), found), q, dialect, default_database, default_schema, mode)
                except Exception as e:
                    error = type(e).__name__
                errors.append(error)
                for k in fields:
                    rows[k] += got.get(k, ())
                    ends[k].append(len(rows[k]))
            lists = [pa.ListArray.from_arrays(pa.array(ends[k], pa.int32()), pa.StructArray.from_arrays([pa.array([r[c] for r in rows[k]], pa.string()) for c in cs], cs)) for k, cs in fields.items()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(errors, pa.string()), *lists], ["query_id", "error", *fields])

    # grouped by both: without the text as an aggregate the rows are hashed, not sorted
    distinct = queries.filter(F.col(text).isNotNull()).select(ids.query_id(F.col(text)).alias("query_id"), F.col(text).alias("text")).distinct()
    lists = {k: ", ".join(f"{c}: string" for c in cs) for k, cs in fields.items()}
    of_text = _rows_of(spark, fields, f"struct<errors: array<string>, left: array<string>, {', '.join(f'{k}: array<struct<{x}, first: boolean>>' for k, x in lists.items())}>", default_database, default_schema, mode)
    texts, rest = materialize(distinct.select("query_id", of_text.alias("found")), "lineage"), None
    # null stands for a text with statements that are left
    errors = texts.select(F.explode(F.expr("if(size(found.left) > 0, array_append(found.errors, null), found.errors)")).alias("error"))
    counts = Counter(dict(map(tuple, errors.groupBy("error").count().collect())))
    if counts.pop(None, 0):
        plans = texts.select("query_id", F.explode("found.left").alias("text")).mapInArrow(cut, "query_id string, text string, plain string")
        plans = plans.select("query_id", "text", F.col("plain").isNotNull().alias("other"), _plan_json(spark, F.coalesce("plain", "text"), kinds).alias("found"))
        rest = materialize(plans.mapInArrow(named, f"query_id string, error string, {', '.join(f'{k} array<struct<{x}>>' for k, x in lists.items())}"), "lineage")
        counts.update(dict(map(tuple, rest.filter(F.col("error").isNotNull()).groupBy("error").count().collect())))
    for error, n in counts.items():
        warnings.warn(f"{n} statements could not be read ({error}); they are skipped", SchemaloomWarning, stacklevel=3)
    return _Read(distinct, texts, rest)


def lineage_frames(queries: DataFrame, *, text: str = "query", dialect: str = "bigquery", default_database: str | None = None, default_schema: str | None = None, mode: str = "resolved", kinds: Collection[str] = tuple(_SHAPES)) -> dict[str, DataFrame]:
    """Frames of all statements of all distinct texts; tasks cut, parse and read them.

    ``kinds``: the frames to make, all by default; every statement is read for any of them.
    """
    read = _read(queries, kinds, text, dialect, default_database, default_schema, mode)
    same = dict(zip(("platform", "service"), map(F.lit, DIALECTS[dialect])))
    frames = {k: read.rows(k).select(*[same[c].alias(c) if c in same else c for c in _columns(k)]) for k in _SHAPES if k in kinds}
    return frames | {"query_info": read.distinct.withColumnRenamed("text", "content")}


_IDS = {"table_info": ["table_id"], "references_info": ["left_column_id", "right_column_id"]}


def query_counts(queries: DataFrame, kind: str, *, least: Collection[str] = (), text: str = "query", dialect: str = "bigquery", default_database: str | None = None, default_schema: str | None = None, mode: str = "resolved") -> DataFrame:
    """In how many distinct texts each table or reference is, by its ids; with the least value of the columns ``least``."""
    if kind not in _IDS:
        raise ConfigError(f"no counts of kind {kind!r}")
    read, keys = _read(queries, [kind], text, dialect, default_database, default_schema, mode), _IDS[kind]
    if read.rest is not None:
        return read.rows(kind).groupBy(keys).agg(*[F.min(c).alias(c) for c in least], F.count_distinct("query_id").alias("n_queries"))
    # a text's rows are together and its first of each is marked, so no pair of a text and an id is moved; texts as keys are hashed, a least text is not
    counts = read.texts.select(F.inline(f"found.{kind}")).groupBy(*keys, *least).agg(F.count_if("first").alias("n_queries"))
    if not least:
        return counts
    return counts.groupBy(keys).agg(*[F.min(c).alias(c) for c in least], F.coalesce(F.sum("n_queries"), F.lit(0)).alias("n_queries"))


def lineage_batch(frames: dict[str, DataFrame]) -> GraphBatch:
    """Query, table, column and CTE nodes with their edges."""
    t, c, r, e = (frames[k] for k in ("table_info", "column_info", "references_info", "cte_info"))
    db, known = ids.database_id("database_name"), t.select("query_id").distinct()
    return GraphBatch(
        {
            "Database": nodes_of(t, "Database", db, name="database_name", platform="platform", service="service"),
            "Schema": nodes_of(t, "Schema", F.col("schema_id"), name="schema_name"),
            "Table": nodes_of(t, "Table", F.col("table_id"), name="table_name"),
            "Column": nodes_of(c, "Column", F.col("column_id"), name="column_name"),
            "Query": nodes_of(frames["query_info"].join(known, "query_id", "left_semi"), "Query", F.col("query_id"), content="content"),
            "CTE": nodes_of(e, "CTE", F.col("cte_id"), name="cte_name", definition="definition", query_id="query_id"),
        },
        {
            "Database-HAS_SCHEMA-Schema": edges_of(t, db, F.col("schema_id")),
            "Schema-HAS_TABLE-Table": edges_of(t, F.col("schema_id"), F.col("table_id")),
            "Table-HAS_COLUMN-Column": edges_of(c, F.col("table_id"), F.col("column_id")),
            "Column-REFERENCES-Column": edges_of(r, F.col("left_column_id"), F.col("right_column_id"), criteria="criteria"),
            "Query-USES_TABLE-Table": edges_of(t, F.col("query_id"), F.col("table_id")),
            "Query-USES_COLUMN-Column": edges_of(c, F.col("query_id"), F.col("column_id")),
            "Query-DEFINES-CTE": edges_of(e, F.col("query_id"), F.col("cte_id")),
        },
    )
