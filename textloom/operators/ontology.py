"""Ontology tables: hierarchy edges, category filter, term index, relations, annotations, and their integration.

nodes(node_id, terms, define_tokens, define_ners, tree_numbers); edges(parent_id, child_id);
relations(src, dst, kind); annotations(node_id, name). Pointers of an object graph are rows of edge tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Ontology:
    nodes: DataFrame
    edges: DataFrame
    relations: DataFrame | None = None
    genes: DataFrame | None = None
    symptoms: DataFrame | None = None


def tree_edges(tree: DataFrame) -> DataFrame:
    """(parent_id, child_id) of tree(node_id, tree_number): a parent has the number without its last part."""
    child = tree.select(F.col("node_id").alias("child_id"), F.regexp_replace("tree_number", r"\.[^.]*$", "").alias("up"), "tree_number").where("up <> tree_number")
    return child.join(tree.select(F.col("node_id").alias("parent_id"), F.col("tree_number").alias("up")), "up").select("parent_id", "child_id").distinct()


def parent_edges(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(parent_id, child_id) of rows(node_id, parents array); ids that known(node_id) lacks are passed over."""
    pairs = rows.select(F.explode("parents").alias("parent_id"), F.col("node_id").alias("child_id")).distinct()
    ids = lambda c: known.select(F.col("node_id").alias(c))
    return pairs.join(ids("parent_id"), "parent_id", "left_semi").join(ids("child_id"), "child_id", "left_semi").select("parent_id", "child_id")


def in_categories(nodes: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """Nodes with any wanted category; the category is always derived from the tree numbers."""
    return nodes.withColumn("category", T.tree_category(F.col("tree_numbers"))).where(F.arrays_overlap("category", F.array(*map(F.lit, wanted))))


def normalize_nodes(nodes: DataFrame, entities: Callable[[Column], Column] = T.adjacent_pairs) -> DataFrame:
    """Terms de-duplicated first and normalised then, so that equal ones may reappear; the definition's tokens, digits kept, and entities."""
    terms = F.transform(F.array_distinct("terms"), T.normalize)
    tokens = T.drop_stopwords(F.filter(F.split(T.normalize(F.col("define")), " "), lambda t: t != ""))
    rows = nodes.withColumn("terms", terms).withColumn("define_tokens", F.coalesce(tokens, F.array().cast("array<string>")))
    return rows.withColumn("define_ners", entities(F.col("define_tokens")))


def term_index(nodes: DataFrame, category: str | None = None) -> DataFrame:
    """(term, node_ids), of the nodes of one category if given."""
    rows = nodes if category is None else nodes.where(F.array_contains(T.tree_category(F.col("tree_numbers")), category))
    return rows.select(F.explode(F.array_distinct("terms")).alias("term"), "node_id").groupBy("term").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))


def xref_links(base: DataFrame, xrefs: DataFrame, strict: bool = False) -> DataFrame:
    """(node_id, base_id) of the references xrefs(node_id, xref) that name a base node; see xref_merge."""
    part = F.split("xref", ":")
    links = xrefs.where(F.size(part) > 1).select("node_id", part[0 if strict else 1].alias("base_id"))
    return links.join(base.select(F.col("node_id").alias("base_id")), "base_id", "left_semi").distinct().select("node_id", "base_id")


def merged_edges(base_edges: DataFrame, other_edges: DataFrame, links: DataFrame) -> DataFrame:
    """(parent_id, child_id): the base's edges, those of merged nodes as their base nodes' own, and those between nodes that stay.

    links(node_id, base_id) are those of xref_merge. A neighbour that was merged itself keeps its own id no longer, so an
    edge to it counts for the base node it went to.
    """
    moved = lambda c: links.select(F.col("node_id").alias(c), F.col("base_id").alias(f"{c}_base"))
    both = other_edges.join(moved("parent_id"), "parent_id", "left").join(moved("child_id"), "child_id", "left")
    kept = both.select(F.coalesce("parent_id_base", "parent_id").alias("parent_id"), F.coalesce("child_id_base", "child_id").alias("child_id"))
    return base_edges.select("parent_id", "child_id").unionByName(kept).where("parent_id <> child_id").distinct()


def xref_merge(base: DataFrame, other: DataFrame, xrefs: DataFrame, strict: bool = False) -> DataFrame:
    """base nodes with the terms and definition tokens of the other nodes that xrefs(node_id, xref) lead to, then the rest of other.

    A reference PREFIX:ID names a base node by its ID; `strict` reads the two parts in the other order. Merged other nodes
    go; of the rest, ids that base has already lose.
    """
    links = xref_links(base, xrefs, strict)
    extra = links.join(other.select("node_id", "terms", "define_tokens"), "node_id").groupBy("base_id").agg(F.flatten(F.array_sort(F.collect_list("terms"))).alias("more_terms"), F.flatten(F.array_sort(F.collect_list("define_tokens"))).alias("more_tokens"), F.array_sort(F.collect_set("node_id")).alias("stem_from"))
    none = F.array().cast("array<string>")
    merged = base.join(extra, base.node_id == extra.base_id, "left").select(
        "node_id", F.array_distinct(F.concat("terms", F.coalesce("more_terms", none))).alias("terms"), F.array_distinct(F.concat("define_tokens", F.coalesce("more_tokens", none))).alias("define_tokens"),
        "tree_numbers", F.coalesce("stem_from", none).alias("stem_from"),
    )
    rest = other.join(links.select("node_id").distinct(), "node_id", "left_anti").join(base.select("node_id"), "node_id", "left_anti")
    return merged.unionByName(rest.select("node_id", "terms", "define_tokens", "tree_numbers", none.alias("stem_from")))


def symmetric_relations(rows: DataFrame, xrefs: DataFrame | None = None, kind: str = "chemical", base: str = "MESH") -> DataFrame:
    """(src, dst, kind) both ways, of rows(chemical_id, disease_ref 'PREFIX:ID'); other prefixes go through xrefs(xref, node_id)."""
    part = F.split("disease_ref", ":")
    direct = rows.where((part[0] == base) & (F.size(part) > 1)).select(F.col("chemical_id").alias("src"), part[1].alias("dst"))
    if xrefs is not None:
        far = rows.where(part[0] != base).join(xrefs.withColumnRenamed("xref", "disease_ref"), "disease_ref").select(F.col("chemical_id").alias("src"), F.col("node_id").alias("dst"))
        direct = direct.unionByName(far)
    both = direct.unionByName(direct.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src IS NOT NULL AND dst IS NOT NULL").distinct().withColumn("kind", F.lit(kind))


def union_annotations(rows: DataFrame) -> DataFrame:
    """(node_id, names) of rows(node_id, name): distinct names in order."""
    return rows.groupBy("node_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: numbers of nodes, relations and terms."""
    a = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n_terms"))
    return a.crossJoin(edges.agg(F.count(F.lit(1)).alias("n_relations")))  # one row each


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_rows, n_distinct, n_null) of each column."""
    names = columns or df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *(F.countDistinct(c).alias(f"d_{c}") for c in names), *(F.count(c).alias(f"c_{c}") for c in names))
    return wide.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d_{c}").alias("n_distinct"), (F.col("_n") - F.col(f"c_{c}")).alias("n_null")) for c in names])).alias("x")).select("x.column", F.col("_n").alias("n_rows"), "x.n_distinct", "x.n_null")


def fill_and_dedupe(rows: DataFrame, number: str) -> DataFrame:
    """Null numbers become the column's mean; full-row repeats go."""
    mean = rows.agg(F.avg(number).alias("_mean"))
    return rows.crossJoin(F.broadcast(mean)).withColumn(number, F.coalesce(number, "_mean")).drop("_mean").distinct()  # one row


def gene_lists(rows: DataFrame) -> DataFrame:
    """(disease, genes) of rows(disease, gene)."""
    return rows.groupBy("disease").agg(F.array_sort(F.collect_set("gene")).alias("genes"))


def describe(nodes: DataFrame, node_id: str) -> DataFrame:
    """One descriptor: its joined notes, terms and tree numbers."""
    return nodes.where(F.col("node_id") == node_id).select("node_id", F.array_join("notes", " ").alias("define"), "terms", "tree_numbers")
