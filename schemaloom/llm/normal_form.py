"""Duplicates hidden by formatting: Merkle-style hashing of nested records.

Every record is a tree.  A leaf's digest is that of its normalised text; the
digest of an unordered node (a multiset, or the entries of an array of records) is
that of its children's sorted digests; a record node digests its sorted (field name,
child digest) pairs, so the order of fields does not matter.  A map is an unordered
node of its key and value records.

Rows are normalised once, to (id, root digest, whole normalised tree) in files, and
grouped by root digest.  The group also keeps its least and greatest tree: if these are
equal as text, all its records are; the digests for which they are not are told apart
by the trees.  So the comparison moves one tree per digest and map task, however many
copies there are, and a third of all rows being copies of one record is no problem.
The groups lie in a file when the copies are joined back to them by digest, so adaptive
execution can split a hot digest.

Defined results: a NULL anywhere in the compared fields, nested ones included, makes a
record equal to none; empty texts and texts without a single word are equal to each other; ids
tie-break by size, the smallest is the first; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.materialize import materialize


@dataclass(frozen=True)
class Leaf:
    """A scalar; ``text`` is its normalised text."""

    text: Column


@dataclass(frozen=True)
class Multiset:
    """An unordered node whose children are the texts of an array<string>."""

    texts: Column


@dataclass(frozen=True)
class Record:
    """A node with named children; their order does not matter."""

    fields: tuple[tuple[str, Leaf | Multiset | Record | Each], ...]


@dataclass(frozen=True)
class Each:
    """A node whose children are the entries of an array, each a node made by ``child``; unordered unless said otherwise."""

    entries: Column
    child: Callable[[Column], Leaf | Multiset | Record | Each]
    ordered: bool = False


Node = Leaf | Multiset | Record | Each


def map_entries(column: Column, value: Callable[[Column], Node]) -> Each:
    """A map whose keys and values are compared and whose order is not."""
    return Each(F.map_entries(column), lambda e: Record((("key", Leaf(e["key"])), ("value", value(e["value"])))))


def word_multiset(name: str) -> Multiset:
    """Words are maximal runs of letters and digits; letter case, other characters and order do not count."""
    return Multiset(F.regexp_extract_all(F.lower(F.col(name)), F.lit(r"([\p{L}\p{N}]+)"), 1))


def folded(name: str | Column) -> Leaf:
    """Lower case, punctuation dropped, runs of white space one blank, outer blanks dropped."""
    text = F.col(name) if isinstance(name, str) else name
    return Leaf(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""), r"\s+", " ")))


def digest(node: Node) -> Column:
    """The node's digest, bottom-up; NULL if a leaf is NULL."""
    if isinstance(node, Leaf):
        return F.md5(node.text)
    if isinstance(node, Multiset):
        return F.md5(F.concat(F.lit("{"), F.array_join(F.array_sort(F.transform(node.texts, F.md5)), ",")))
    if isinstance(node, Each):
        below = F.transform(node.entries, lambda x: digest(node.child(x)))
        return F.md5(F.concat(F.lit("["), F.array_join(below if node.ordered else F.array_sort(below), ",")))
    parts = [F.concat(F.lit(name + "="), digest(child)) for name, child in sorted(node.fields, key=lambda f: f[0])]
    return F.md5(F.concat(F.lit("<"), *[p for part in parts for p in (part, F.lit(";"))]))


def structure(node: Node) -> Column:
    """The whole normalised tree as one text, injective; NULL if a leaf is NULL."""
    if isinstance(node, Leaf):
        return F.to_json(F.array(node.text))
    if isinstance(node, Multiset):
        return F.to_json(F.array_sort(node.texts))
    if isinstance(node, Each):
        below = F.transform(node.entries, lambda x: structure(node.child(x)))
        return F.to_json(below if node.ordered else F.array_sort(below))
    parts = [F.concat(F.lit(name + "="), structure(child)) for name, child in sorted(node.fields, key=lambda f: f[0])]
    return F.concat(F.lit("<"), *[p for part in parts for p in (part, F.lit(";"))])


def _complete(node: Node) -> Column:
    if isinstance(node, Record):
        out = F.lit(True)
        for _, child in node.fields:
            out = out & _complete(child)
        return out
    if isinstance(node, Each):
        return node.entries.isNotNull() & F.forall(node.entries, lambda x: _complete(node.child(x)))
    if isinstance(node, Multiset):
        return node.texts.isNotNull() & F.forall(node.texts, lambda x: x.isNotNull())
    return node.text.isNotNull()


def _confirmed(df: DataFrame, row_id: str, node: Node) -> tuple[DataFrame, DataFrame, Column]:
    """(rows ``r``, groups ``g`` of equal rows with more than one copy, the condition that joins them)."""
    rows = materialize(df.filter(F.coalesce(_complete(node), F.lit(False))).select(F.col(row_id).alias("id"), digest(node).alias("digest"), structure(node).alias("tree")), "trees")
    count = [F.min("id").alias("first_id"), F.count("*").alias("copies")]
    groups = rows.groupBy("digest").agg(*count, F.min("tree").alias("least"), F.max("tree").alias("greatest")).filter("copies > 1")
    groups = materialize(groups.select("digest", "first_id", "copies", (F.col("least") != F.col("greatest")).alias("differ")), "groups")
    same = F.col("r.digest") == F.col("g.digest")
    clash = groups.filter("differ")
    if clash.isEmpty():
        return rows.select("id", "digest").alias("r"), groups.alias("g"), same
    unlike = clash.select("digest", "differ")
    own = rows.join(unlike, "digest").groupBy("digest", "tree").agg(*count).filter("copies > 1")
    alike = groups.filter("not differ").select("digest", F.lit(None).cast("string").alias("tree"), "first_id", "copies")
    marked = rows.join(unlike, "digest", "left").select("id", "digest", F.when(F.col("differ"), F.col("tree")).alias("tree"))
    return marked.alias("r"), alike.unionByName(own).alias("g"), same & F.col("r.tree").eqNullSafe(F.col("g.tree"))


def hidden_copies(df: DataFrame, row_id: str, node: Node) -> DataFrame:
    """(first_id, copy_id) of every row that equals an earlier one."""
    rows, groups, same = _confirmed(df, row_id, node)
    return rows.join(groups, same).filter("id > first_id").select("first_id", F.col("id").alias("copy_id"))


def collapse(df: DataFrame, row_id: str, node: Node) -> DataFrame:
    """One row per record (first_id, copies); records that equal none have one copy."""
    rows, groups, same = _confirmed(df, row_id, node)
    copied = rows.join(groups, same, "left_semi").select(F.col("id").alias("i"))
    single = df.select(F.col(row_id).alias("first_id")).join(copied, F.col("first_id") == F.col("i"), "left_anti")
    return groups.select("first_id", "copies").unionByName(single.select("first_id", F.lit(1).cast("bigint").alias("copies")))
