"""Semantic-model documents (YAML): into the graph and out of it.

A document is small and read on the driver; its rows become frames with fixed
schemas, so deduplication, upserts and the export's nesting are Spark's.
"""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
import warnings
from collections import defaultdict
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom import ids
from schemaloom.errors import ConfigError, ExtractionError, SchemaloomWarning
from schemaloom.materialize import discard, materialize
from schemaloom.operators.upsert import first_per_key
from schemaloom.plans.context import aspect_type
from schemaloom.schemas import EDGES, NODES
from schemaloom.store import GraphBatch, GraphStore

# Glossary and category of synonyms, labels that synonyms may tag, versions known, what a name in a source may be.
SYNONYMS = ("osi", "synonyms")
TAGGED = ("Schema", "Table", "Column", "Metric")
VERSIONS = ("0.1.1", "0.2.0", "0.2.0.dev0")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _n(name: str) -> str:
    return name.lower().replace(" ", "_").replace("-", "_")


def _md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def load(source: str, *, timeout: int = 30) -> dict[str, Any]:
    """The document of a path or URL; it must be a mapping."""
    import yaml

    if re.match(r"^https?://", source):
        with urllib.request.urlopen(source, timeout=timeout) as r:  # noqa: S310
            text = r.read().decode()
    else:
        with open(source, encoding="utf-8") as f:
            text = f.read()
    doc = yaml.safe_load(text)
    if not isinstance(doc, dict):
        raise ExtractionError("the document is no mapping")
    return doc


def check_version(doc: dict[str, Any], wanted: str | None = None) -> None:
    """A version that is unknown or another than wanted only warns."""
    version = str(doc.get("version", ""))
    if version not in VERSIONS or (wanted and version != wanted):
        warnings.warn(f"the document has version {version!r}", SchemaloomWarning, stacklevel=2)


def classify(source: str) -> tuple[str, str, str] | None:
    """(database, schema, table) of a table source, None for a query; names of one or two parts are an error."""
    if not source:
        raise ConfigError("a dataset has no source")
    parts = source.split(".")
    if all(_NAME.fullmatch(p) for p in parts):
        if len(parts) == 3:
            return parts[0], parts[1], parts[2]
        if len(parts) < 3:
            raise ConfigError(f"{source!r} is neither database.schema.table nor a query")
    return None


def source_kind(source: Column | str) -> Column:
    """``table``, ``query`` or ``error`` as :func:`classify` decides, for many sources at once."""
    c = F.col(source) if isinstance(source, str) else source
    names = c.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$") & ~F.contains(c, F.lit("\n"))
    parts = F.size(F.split(c, r"\."))
    return F.when(c.isNull() | (c == "") | (names & (parts < 3)), "error").when(names & (parts == 3), "table").otherwise("query")


class _Rows:
    """Collects the rows of a document by label and edge kind."""

    def __init__(self):
        self.nodes: dict[str, list[dict]] = defaultdict(list)
        self.edges: dict[str, list[dict]] = defaultdict(list)

    def node(self, kind: str, node_id: str, labels: tuple[str, ...] = (), /, **properties) -> str:
        self.nodes[kind].append({"id": node_id, "labels": list(labels), **properties})
        return node_id

    def edge(self, source: str, kind: str, target: str, src: str, dst: str) -> None:
        self.edges[f"{source}-{kind}-{target}"].append({"src_id": src, "dst_id": dst})

    def extras(self, model: str, label: str, owner: str, entry: dict[str, Any]) -> None:
        """Context and extensions of an entry, shared by content within a model; synonyms become terms."""
        value = entry.get("ai_context")
        if value not in (None, ""):
            text = value if isinstance(value, str) else json.dumps(value, sort_keys=True)
            self.edge(label, "HAS_ASPECT", "Aspect", owner, self.node("Aspect", f"{model}.{_md5(text)}", ("Aspect", "AiContext"), data=text))
            try:
                said = json.loads(value) if isinstance(value, str) else value
            except ValueError:
                said = None
            synonyms = said.get("synonyms") if isinstance(said, dict) else None
            for s in synonyms if isinstance(synonyms, list) and label in TAGGED else []:
                if isinstance(s, str) and s.strip():
                    self.edge(label, "TAGGED_WITH", "BusinessTerm", owner, self.node("BusinessTerm", ".".join(map(_n, (*SYNONYMS, s))), name=s))
        for e in entry.get("custom_extensions") or []:
            if isinstance(e, dict) and e.get("data") is not None:
                text = e["data"] if isinstance(e["data"], str) else json.dumps(e["data"], sort_keys=True)
                vendor = e.get("vendor_name") or ""
                self.edge(label, "HAS_ASPECT", "Aspect", owner, self.node("Aspect", f"{model}.{_md5(vendor + '::' + text)}", ("Aspect", "CustomExtensions"), data=text, vendor_name=vendor))

    def dialects(self, label: str, owner: str, entry: dict[str, Any]) -> None:
        for d in (entry.get("expression") or {}).get("dialects") or []:
            dialect, text = d.get("dialect"), d.get("expression")
            if dialect is not None and text is not None:
                self.edge(label, "HAS_EXPRESSION", "Expression", owner, self.node("Expression", f"{owner}.{_md5(f'{dialect}::{text}')}", dialect=dialect, expression=text))


def _dataset_owner(source: str) -> tuple[str, str]:
    table = classify(source)
    return ("Table", ".".join(map(_n, table))) if table else ("Query", hashlib.sha256(source.encode()).hexdigest())


def _model_rows(rows: _Rows, model: dict[str, Any], version: str) -> None:
    name = model["name"]
    me = rows.node("Domain", _n(name), ("Domain", "SemanticModel"), name=name, description=model.get("description"), osi_version=version)
    datasets = model.get("datasets") or []
    owners = {d["name"]: _dataset_owner(d.get("source")) for d in datasets}
    column = lambda owner, c: f"{owner}.{_n(c)}"
    relationships = model.get("relationships") or []
    foreign = {column(owners[r["from"]][1], c) for r in relationships if r.get("from") in owners for c in r.get("from_columns") or []}
    for d in datasets:
        label, owner = owners[d["name"]]
        table = classify(d["source"])
        if table:
            db, schema = _n(table[0]), ".".join(map(_n, table[:2]))
            rows.node("Database", db, name=table[0])
            rows.node("Schema", schema, name=table[1])
            rows.edge("Database", "HAS_SCHEMA", "Schema", db, schema)
            rows.edge("Schema", "HAS_TABLE", "Table", schema, owner)
            keys = [u for u in d.get("unique_keys") or [] if u] or None
            rows.node("Table", owner, ("Table", "SemanticTable"), name=d["name"], description=d.get("description"), source=d["source"], primary_key=d.get("primary_key") or None, unique_keys=keys)
            rows.edge("Domain", "HAS_TABLE", "Table", me, owner)
        else:
            rows.node("Query", owner, name=d["name"], content=d["source"], description=d.get("description"))
            rows.edge("Domain", "HAS_QUERY", "Query", me, owner)
        rows.extras(me, label, owner, d)
        primary = set(d.get("primary_key") or [])
        for f in d.get("fields") or []:
            c = column(owner, f["name"])
            is_time = f["dimension"].get("is_time") if isinstance(f.get("dimension"), dict) else None
            rows.node("Column", c, ("Column", "SemanticColumn"), name=f["name"], description=f.get("description"), label=f.get("label"), is_primary_key=f["name"] in primary, is_foreign_key=c in foreign, is_time_dimension=is_time if isinstance(is_time, bool) else None)
            rows.edge(label, "HAS_COLUMN" if label == "Table" else "USES_COLUMN", "Column", owner, c)
            rows.dialects("Column", c, f)
            rows.extras(me, "Column", c, f)
    for r in relationships:
        _relationship_rows(rows, me, r, owners, column)
    for m in model.get("metrics") or []:
        mid = rows.node("Metric", f"{me}.{_n(m['name'])}", name=m["name"], description=m.get("description"))
        rows.edge("Domain", "HAS_METRIC", "Metric", me, mid)
        rows.dialects("Metric", mid, m)
        rows.extras(me, "Metric", mid, m)
    rows.extras(me, "Domain", me, model)


def _relationship_rows(rows: _Rows, me: str, r: dict[str, Any], owners: dict[str, tuple[str, str]], column) -> None:
    here, there = list(r.get("from_columns") or []), list(r.get("to_columns") or [])
    join = rows.node("Join", f"{me}.{_n(r['name'])}", name=r["name"], from_columns=here or None, to_columns=there or None)
    source, target = owners.get(r.get("from")), owners.get(r.get("to"))
    for end, kind, cols in ((source, "HAS_SOURCE_TABLE", here), (target, "HAS_TARGET_TABLE", there)):
        if end:
            rows.edge("Join", kind, end[0], join, end[1])
            for c in cols:
                rows.edge("Column", "USED_IN_JOIN", "Join", column(end[1], c), join)
    if source and target:
        if len(here) != len(there):
            raise ConfigError(f"relationship {r['name']!r} pairs {len(here)} columns with {len(there)}")
        for a, b in zip(here, there, strict=True):
            rows.edge("Column", "REFERENCES", "Column", column(source[1], a), column(target[1], b))
    rows.extras(me, "Join", join, r)


def model_batch(spark: SparkSession, doc: dict[str, Any]) -> GraphBatch:
    """All models of a document; the first of equal ids holds."""
    rows = _Rows()
    for model in doc.get("semantic_model") or []:
        _model_rows(rows, model, str(doc.get("version", "")))
    batch = GraphBatch(keys={"BusinessTerm": "name"})
    for label, found in rows.nodes.items():
        schema = NODES[label].schema
        df = spark.createDataFrame([tuple(f.get(c) for c in schema.names) for f in found], schema).withColumn("seq_", F.monotonically_increasing_id())
        batch.nodes[label] = first_per_key(df, ["id"], ["seq_"]).drop("seq_")
    for kind, found in rows.edges.items():
        schema = EDGES[kind].schema
        batch.edges[kind] = spark.createDataFrame([tuple(f.get(c) for c in schema.names) for f in found], schema).dropDuplicates(["src_id", "dst_id"])
    return batch


def _members(store: GraphStore, model_id: str) -> DataFrame:
    """(id) of everything that belongs to a model: itself, its datasets, their columns, its metrics and joins."""
    of = lambda kind, src, as_: store.edges(kind).join(src.select(F.col("id").alias("src_id")), "src_id", "left_semi").select(F.col("dst_id").alias(as_))
    me = store.nodes("Domain").filter(F.col("id") == model_id).select("id")
    sets = of("Domain-HAS_TABLE-Table", me, "id").unionByName(of("Domain-HAS_QUERY-Query", me, "id"))
    columns = of("Table-HAS_COLUMN-Column", sets, "id").unionByName(of("Query-USES_COLUMN-Column", sets, "id"))
    ends = store.edges("Join-HAS_SOURCE_TABLE-Table").unionByName(store.edges("Join-HAS_SOURCE_TABLE-Query"))
    joins = ends.join(sets.select(F.col("id").alias("dst_id")), "dst_id", "left_semi").select(F.col("src_id").alias("id"))
    whole = reduce(lambda a, b: a.unionByName(b), [me, sets, columns, of("Domain-HAS_METRIC-Metric", me, "id"), joins]).distinct()
    return materialize(whole, "members")


def _by_source(store: GraphStore, members: DataFrame, kinds: list[str], label: str, record) -> dict[str, list]:
    """Children of a model's nodes on the driver; a model is a document's size."""
    out: dict[str, list] = defaultdict(list)
    edges = reduce(lambda a, b: a.unionByName(b), [store.edges(k).select("src_id", "dst_id") for k in kinds])
    edges = edges.join(members.select(F.col("id").alias("src_id")), "src_id", "left_semi")
    for r in edges.join(store.nodes(label), F.col("dst_id") == F.col("id")).select("src_id", "id", *record).collect():
        out[r.src_id].append(r)
    return {k: sorted(v, key=lambda r: r.id) for k, v in out.items()}


def export(store: GraphStore, model: str) -> dict[str, Any]:
    """The document of a model in the graph; empty members are left out."""
    d = store.nodes("Domain").filter(F.col("id") == ids.model_id(F.lit(model))).first()
    if d is None:
        raise ConfigError(f"no model {model!r}")
    members = _members(store, d.id)
    aspect = _by_source(store, members, [k for k in EDGES if k.endswith("HAS_ASPECT-Aspect")], "Aspect", [aspect_type("labels").alias("kind"), "data", "vendor_name"])
    spoken = _by_source(store, members, ["Column-HAS_EXPRESSION-Expression", "Metric-HAS_EXPRESSION-Expression"], "Expression", ["dialect", "expression"])
    fields = _by_source(store, members, ["Table-HAS_COLUMN-Column", "Query-USES_COLUMN-Column"], "Column", ["name", "description", "label", "is_time_dimension"])

    def put(out: dict[str, Any], key: str, value: Any) -> None:
        if value not in (None, "", [], {}):
            out[key] = value

    def context_of(out: dict[str, Any], owner: str) -> None:
        for a in aspect.get(owner, []):
            if a.kind == "ai_context":
                try:
                    put(out, "ai_context", json.loads(a.data))
                except ValueError:
                    put(out, "ai_context", a.data)

    def extensions_of(out: dict[str, Any], owner: str) -> None:
        put(out, "custom_extensions", [{"vendor_name": a.vendor_name or "", "data": _pretty(a.data)} for a in aspect.get(owner, []) if a.kind == "custom_extensions"])

    def said(out: dict[str, Any], owner: str) -> None:
        if spoken.get(owner):
            out["expression"] = {"dialects": [{"dialect": e.dialect, "expression": e.expression} for e in spoken[owner]]}

    m: dict[str, Any] = {"name": d.name}
    put(m, "description", d.description)
    context_of(m, d.id)
    t = _by_source(store, members, ["Domain-HAS_TABLE-Table"], "Table", ["name", "description", "source", "primary_key", "unique_keys"]).get(d.id, [])
    q = _by_source(store, members, ["Domain-HAS_QUERY-Query"], "Query", ["name", "description", F.col("content").alias("source"), F.lit(None).alias("primary_key"), F.lit(None).alias("unique_keys")]).get(d.id, [])
    m["datasets"] = []
    names = {}
    for s in sorted([*t, *q], key=lambda r: r.name):
        names[s.id] = s.name
        out: dict[str, Any] = {"name": s.name}
        put(out, "source", s.source)
        put(out, "primary_key", s.primary_key)
        put(out, "unique_keys", s.unique_keys)
        put(out, "description", s.description)
        context_of(out, s.id)
        own = []
        for f in fields.get(s.id, []):
            o: dict[str, Any] = {"name": f.name}
            said(o, f.id)
            if f.is_time_dimension is not None:
                o["dimension"] = {"is_time": f.is_time_dimension}
            put(o, "label", f.label)
            put(o, "description", f.description)
            context_of(o, f.id)
            extensions_of(o, f.id)
            own.append(o)
        put(out, "fields", own)
        extensions_of(out, s.id)
        m["datasets"].append(out)
    both = reduce(lambda a, b: a.unionByName(b), [store.edges(f"Join-{k}-{t}").withColumn("kind", F.lit(k)) for k in ("HAS_SOURCE_TABLE", "HAS_TARGET_TABLE") for t in ("Table", "Query")])
    ends: dict[str, dict[str, str]] = {"HAS_SOURCE_TABLE": {}, "HAS_TARGET_TABLE": {}}
    for r in both.join(members.select(F.col("id").alias("src_id")), "src_id", "left_semi").collect():
        ends[r.kind][r.src_id] = r.dst_id
    rels = []
    for j in store.nodes("Join").join(members, "id", "left_semi").orderBy("id").collect():
        if ends["HAS_SOURCE_TABLE"].get(j.id) in names:
            o = {"name": j.name, "from": names[ends["HAS_SOURCE_TABLE"][j.id]], "to": names.get(ends["HAS_TARGET_TABLE"].get(j.id)), "from_columns": j.from_columns or [], "to_columns": j.to_columns or []}
            context_of(o, j.id)
            extensions_of(o, j.id)
            rels.append(o)
    put(m, "relationships", rels)
    metrics = []
    for x in _by_source(store, members, ["Domain-HAS_METRIC-Metric"], "Metric", ["name", "description"]).get(d.id, []):
        o = {"name": x.name}
        said(o, x.id)
        put(o, "description", x.description)
        context_of(o, x.id)
        extensions_of(o, x.id)
        metrics.append(o)
    put(m, "metrics", metrics)
    extensions_of(m, d.id)
    discard(members)
    return {"version": d.osi_version, "semantic_model": [m]} if d.osi_version else {"semantic_model": [m]}


def _pretty(data: str) -> str:
    try:
        return json.dumps(json.loads(data), indent=2) + "\n"
    except (TypeError, ValueError):
        return data


def dump(doc: dict[str, Any]) -> str:
    """YAML in the given order: key lists inline, texts of several lines as blocks."""
    import yaml

    class Dumper(yaml.SafeDumper):
        def ignore_aliases(self, data):
            return True

    def text(dumper, value):
        return dumper.represent_scalar("tag:yaml.org,2002:str", value, style="|" if "\n" in value else None)

    def sequence(dumper, value):
        flat = value and all(isinstance(v, str) for v in value)
        return dumper.represent_sequence("tag:yaml.org,2002:seq", value, flow_style=bool(flat))

    Dumper.add_representer(str, text)
    Dumper.add_representer(list, sequence)
    return yaml.dump(doc, Dumper=Dumper, sort_keys=False, allow_unicode=True)
