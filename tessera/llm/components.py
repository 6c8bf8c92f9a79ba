"""Connected components of a graph that lives in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_lookup, materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for each vertex of the edges (a, b): c is the smallest vertex it reaches.

    Each round takes the smallest label among neighbours and then the label of
    one's label, so distances shrink geometrically. Rounds are written tables;
    the driver sees one sum of labels a round, which stops falling at the end.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("c")), "labels")
    before = None
    while True:
        total = labels.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels
        before = total
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        lower = materialize(labels.join(near, "v", "left").select("v", F.least("c", F.coalesce("m", "c")).alias("c")), "labels")
        roots = lower.select(F.col("v").alias("c"), F.col("c").alias("root"))
        labels = materialize(join_lookup(lower, roots, "c").select("v", F.coalesce("root", "c").alias("c")), "labels")


def extend(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (v, c) after further links (a, b): rounds run over the components that links join, not over all vertices again."""
    fresh = links.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(labels, "v", "left_anti")
    labels = materialize(labels.select("v", "c").unionByName(fresh.select("v", F.col("v").alias("c"))), "labels")
    ends = {side: labels.select(F.col("v").alias(side), F.col("c").alias(f"c{side}")) for side in "ab"}
    joined = links.select("a", "b").join(ends["a"], "a").join(ends["b"], "b").where("ca <> cb")
    joined = materialize(joined.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "joined")
    if joined.isEmpty():
        return labels
    roots = components(joined).select(F.col("v").alias("c"), F.col("c").alias("root"))
    return materialize(join_lookup(labels, roots, "c").select("v", F.coalesce("root", "c").alias("c")), "labels")


def vertices(used: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (id, set_id, ...) with the vertex v each belongs to; the vertices (id, set_id, v, first) that differ from the id.

    set_id names what a row holds. A vertex is an id; only where rows of one id
    hold different things does each but the first get a vertex beyond all ids.
    """
    differ = used.groupBy("id").agg(F.min("set_id").alias("first"), F.max("set_id").alias("last")).where("first <> last").select("id", "first")
    differ = materialize(differ, "differ")
    if differ.isEmpty():
        return used.withColumn("v", F.col("id")), None
    top = used.agg(F.max("id")).first()[0]
    more = used.select("id", "set_id").join(differ, "id").where("set_id <> first").distinct()
    more = materialize(more.withColumn("v", F.lit(top) + 1 + F.monotonically_increasing_id()), "more")
    return used.join(more.drop("first"), ["id", "set_id"], "left").withColumn("v", F.coalesce("v", "id")), more


def same_id_links(more: DataFrame, firsts: DataFrame) -> DataFrame:
    """Materialized: links (a, b) of the classes that one id holds, from ``vertices`` and (set_id, class)."""
    one, two = (firsts.select(F.col("set_id").alias(s), F.col("class").alias(c)) for s, c in (("first", "a"), ("set_id", "b")))
    return materialize(more.join(one, "first").join(two, "set_id").select("a", "b").distinct(), "same-id")


def vertices_of_bare(rows: DataFrame, used: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows (id, set_id, class) with their vertex v: the class; where a row holds nothing, that of its id's other rows, or the id."""
    bare = rows.where("id IS NOT NULL AND set_id IS NULL").select("id").distinct()
    named = used.join(bare, "id", "left_semi").join(firsts.select("set_id", "class"), "set_id").groupBy("id").agg(F.min("class").alias("of_id"))
    return join_lookup(rows, materialize(named, "named"), "id").withColumn("v", F.coalesce("class", "of_id", "id")).drop("set_id", "class", "of_id")
