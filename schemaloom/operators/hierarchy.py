"""Parent-child links to full hierarchies.

Leaves are peeled bottom-up: in each round every node without remaining children
sends its subtree size, or in ``descendants`` its list, to its parent and leaves the
graph.  In reverse order of peeling the nodes then receive root, depth and path from
their parents.

Rounds go on while they take at least ``least_share`` of the nodes that are left, so
the rounds are few and the graph shrinks geometrically.  What remains are deep chains
and circles.  There each node looks 1, 2, 4 ... levels up and adds what it holds to the
ancestor it sees, so a chain of any length is done in a logarithmic number of rounds;
nodes that never see an end lead into circles, and the ends of their long looks are the
circles' members.  The results do not depend on ``least_share``.

Rounds are joins and pre-aggregated sums over files, whose sides adaptive execution can
split, so a parent with a third of all nodes below it is no problem; no step gathers
nodes in one task.

Defined results: NULL or blank ids name no node; ids compare without case and
outer blanks; of several rows of one node the latest holds, NULL times first,
ties to the greatest parent id; a NULL, blank or unknown parent makes a root of
depth 0; a node whose climb ends in a circle has depth -1, an empty path and the
smallest id of the circle as root; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.materialize import counted, discard, materialize

#: A round of peeling that takes less than this share of the nodes left is the last.
LEAST_SHARE = 0.4
_PLACED = "id string, parent string, root string, depth int, path string, size bigint"
_PAIRS = "ancestor string, descendant string, distance int"


def latest_links(df: DataFrame, node: str, parent: str, time: str) -> DataFrame:
    """(id, parent) of each node's latest row; parents that are no node are NULL."""
    clean = lambda c: F.nullif(F.upper(F.trim(F.col(c))), F.lit(""))
    rows = df.select(clean(node).alias("id"), clean(parent).alias("p"), F.col(time).alias("t")).filter(F.col("id").isNotNull())
    best = rows.groupBy("id").agg(F.max(F.struct("t", "p")).alias("b")).select("id", F.col("b.p").alias("p"))
    known = best.select(F.col("id").alias("k"))
    return best.join(known, F.col("p") == F.col("k"), "left").select("id", F.col("k").alias("parent"))


def _leaves(rest: DataFrame, left: int, least_share: float) -> tuple[DataFrame | None, int]:
    """The nodes without remaining children and how many are left then; None if they are too few for another round."""
    parents = rest.select(F.col("parent").alias("id")).filter("id is not null").distinct()
    leaves, n = counted(rest.join(parents, "id", "left_anti"), "leaves")
    if n and n >= least_share * left:
        return leaves, left - n
    discard(leaves)
    return None, left


def _doubled_climb(step: DataFrame) -> DataFrame:
    """Twice as far a look of every node of ``step`` (id, far, low); those whose climb ends on the way fall out."""
    other = step.select(F.col("id").alias("k"), F.col("far").alias("far2"), F.col("low").alias("low2"))
    return step.join(other, F.col("far") == F.col("k")).select("id", F.col("far2").alias("far"), F.least("low", "low2").alias("low"))


def _doubled_forest(node: DataFrame) -> DataFrame:
    """Twice as far a look of every node that has not seen its root; each adds what it holds to the node it saw."""
    sums = node.filter("far is not null").groupBy(F.col("far").alias("s")).agg(F.sum("size").alias("more"))
    other = node.select(F.col("id").alias("k"), F.col("far").alias("far2"), F.col("top").alias("top2"), F.col("depth").alias("depth2"), F.col("path").alias("path2"))
    seen = node.join(other, F.col("far") == F.col("k"), "left").join(sums, F.col("id") == F.col("s"), "left")
    return seen.select(
        "id", "parent", F.col("far2").alias("far"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.concat_ws("/", "path2", "path").alias("path"), F.coalesce("top", "top2").alias("top"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth")
    )


def _circles(rest: DataFrame) -> DataFrame | None:
    """(id, low) of the members of circles, ``low`` being their circle's smallest id; None if there are none.

    While any climb that ends has not ended, a round loses rows; afterwards the nodes seen
    are a shrinking set, which stays the same once only members are left in it.
    """
    step, left = counted(_doubled_climb(rest.filter("parent is not null").select("id", F.col("parent").alias("far"), F.least("id", "parent").alias("low"))), "climb")
    count, before = None, None
    while left:
        if left == count:
            now = tuple(step.agg(F.count_distinct("far"), F.sum(F.xxhash64("id", "low").cast("decimal(38,0)"))).first())
            if now == before:
                break
            before = now
        old, count = step, left
        step, left = counted(_doubled_climb(_doubled_climb(step)), "climb")
        discard(old)
    if not left:
        return None
    members = step.select(F.col("far").alias("id")).distinct()
    return materialize(step.select("id", "low").join(members, "id", "left_semi"), "circles")


def _place_rest(rest: DataFrame) -> DataFrame:
    """Root, depth, path and size of all nodes of ``rest`` (id, parent, size); size holds what was peeled below, the node included."""
    circles = _circles(rest)
    far = F.col("parent")
    if circles is not None:
        rest = rest.join(circles.select("id", "low"), "id", "left")
        far = F.when(F.col("low").isNull(), F.col("parent"))
    node = rest.select("id", "parent", far.alias("far"), "size", F.col("id").alias("path")).withColumns({"top": F.when(F.col("far").isNull(), F.col("id")), "depth": F.col("far").isNotNull().cast("int")})
    node = materialize(node, "forest")
    while not node.filter("far is not null").isEmpty():
        old, node = node, materialize(_doubled_forest(node), "forest")
        discard(old)
    if circles is None:
        return node.select("id", "parent", F.col("top").alias("root"), "depth", "path", "size")
    whole = circles.join(node.select("id", "size"), "id").groupBy("low").agg(F.sum("size").alias("all"))
    ends = circles.join(whole, "low").select(F.col("id").alias("end"), "low", "all")
    endless = F.col("end").isNotNull()
    return node.join(ends, F.col("top") == F.col("end"), "left").select(
        "id",
        "parent",
        F.coalesce("low", "top").alias("root"),
        F.when(endless, -1).otherwise(F.col("depth")).alias("depth"),
        F.when(endless, "").otherwise(F.col("path")).alias("path"),
        F.when(endless & (F.col("id") == F.col("end")), F.col("all")).otherwise(F.col("size")).alias("size"),
    )


def hierarchy(links: DataFrame, *, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per node of ``links`` (id, parent): id, parent, root, depth, path, size (itself included)."""
    rest, left = counted(links.select("id", "parent", F.lit(1).cast("bigint").alias("size")), "links")
    peeled: list[DataFrame] = []
    while left:
        leaves, left = _leaves(rest, left, least_share)
        if leaves is None:
            break
        sums = leaves.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("more"))
        smaller = rest.join(leaves.select("id"), "id", "left_anti").join(sums, "id", "left").select("id", "parent", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        old, rest = rest, materialize(smaller, "rest")
        discard(old)
        peeled.append(leaves)
    placed = materialize(_place_rest(rest), "placed") if left else links.sparkSession.createDataFrame([], _PLACED)
    for leaves in reversed(peeled):
        above = placed.select(F.col("id").alias("k"), "root", "depth", "path")
        down = leaves.join(above, F.col("parent") == F.col("k"), "left")
        inside = F.col("depth") >= 0
        placed_now = down.select(
            "id",
            "parent",
            F.coalesce("root", "id").alias("root"),
            F.when(F.col("k").isNull(), 0).when(inside, F.col("depth") + 1).otherwise(-1).alias("depth"),
            F.when(F.col("k").isNull(), F.col("id")).when(inside, F.concat("path", F.lit("/"), "id")).otherwise("").alias("path"),
            "size",
        )
        placed = placed.unionByName(materialize(placed_now, "placed"))
    return placed


def _pairs_of_rest(rest: DataFrame) -> DataFrame:
    """The pairs among all nodes of ``rest`` (id, parent), circles included, by doubling how far each looks."""
    step = materialize(rest.filter("parent is not null").select("id", F.col("parent").alias("far")), "climb")
    met, count = counted(rest.select("id", F.col("id").alias("other"), F.lit(0).alias("distance")), "met")
    length, before = 1, None
    while count != before:
        further = step.join(met.withColumnRenamed("id", "far"), "far").select("id", "other", (F.col("distance") + length).alias("distance"))
        # a climb through a circle meets a node again, the shortest way counts
        old, before = met, count
        met, count = counted(met.unionByName(further).groupBy("id", "other").agg(F.min("distance").alias("distance")), "met")
        discard(old)
        old, step = step, materialize(step.join(step.select(F.col("id").alias("far"), F.col("far").alias("far2")), "far").select("id", F.col("far2").alias("far")), "climb")
        discard(old)
        length *= 2
    return met.filter("id <> other").select(F.col("other").alias("ancestor"), F.col("id").alias("descendant"), F.col("distance").cast("int").alias("distance"))


def descendants(links: DataFrame, *, least_share: float = LEAST_SHARE) -> DataFrame:
    """(ancestor, descendant, distance) of all nodes of ``links`` (id, parent); a row per pair, never a list per node.

    A node's descendants are the other nodes whose climb meets it, so members of a circle
    are each other's, and what hangs below a circle is below each of its members.  Each
    round the leaves, whose pairs are then complete, send them to their parents.
    """
    rest, left = counted(links.select("id", "parent"), "links")
    known = materialize(links.sparkSession.createDataFrame([], _PAIRS), "pairs")
    whole: list[DataFrame] = []
    while left:
        leaves, left = _leaves(rest, left, least_share)
        if leaves is None:
            break
        done = materialize(known.join(leaves.select(F.col("id").alias("ancestor"), "parent"), "ancestor"), "pairs")
        whole.append(done.drop("parent"))
        sent = done.select(F.col("parent").alias("ancestor"), "descendant", (F.col("distance") + 1).alias("distance"))
        sent = sent.unionByName(leaves.select(F.col("parent").alias("ancestor"), F.col("id").alias("descendant"), F.lit(1).alias("distance")))
        open_ = known.join(leaves.select(F.col("id").alias("ancestor")), "ancestor", "left_anti")
        old, known = known, materialize(open_.unionByName(sent.filter("ancestor is not null")), "pairs")
        discard(old)
        old, rest = rest, materialize(rest.join(leaves.select("id"), "id", "left_anti"), "rest")
        discard(old)
    inner = materialize(_pairs_of_rest(rest), "pairs")
    via = known.select(F.col("ancestor").alias("via"), F.col("descendant").alias("below"), F.col("distance").alias("first"))
    further = inner.join(via, F.col("descendant") == F.col("via")).select("ancestor", F.col("below").alias("descendant"), (F.col("distance") + F.col("first")).alias("distance"))
    found = inner.unionByName(known).unionByName(further)
    for part in whole:
        found = found.unionByName(part.select("ancestor", "descendant", "distance"))
    return found


def department_tree(departments: DataFrame, *, least_share: float = LEAST_SHARE) -> DataFrame:
    """The tree of departments with the number of descendants of each."""
    links = latest_links(departments, "department_id", "parent_department_id", "created_at")
    return hierarchy(links, least_share=least_share).select(
        F.col("id").alias("department_id"),
        F.col("root").alias("root_department_id"),
        F.col("depth").cast("int").alias("node_depth"),
        F.col("path").alias("full_path"),
        (F.col("size") - 1).cast("bigint").alias("n_descendants"),
    )


def department_descendants(departments: DataFrame, *, least_share: float = LEAST_SHARE) -> DataFrame:
    """A row for each department and each of its descendants."""
    links = latest_links(departments, "department_id", "parent_department_id", "created_at")
    return descendants(links, least_share=least_share).select(F.col("ancestor").alias("department_id"), F.col("descendant").alias("descendant_id"), "distance")
