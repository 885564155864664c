"""Retrieval over texts and vectors, and graph queries (JOIN-03/04/05/12/14, PIPE-10, TOP-02/07, VEC, GRF)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.lineage import checkpointed
from ..functions.skew import join_dealt
from .texts import keywords, length_of, term_counts, term_vectors


def candidates(docs: DataFrame, query: str) -> DataFrame:
    """JOIN-03, SET-03: texts that share a keyword with the query; all, if none does."""
    terms = keywords(F.lit(query))
    hit = docs.withColumn("_hit", F.arrays_overlap(keywords(F.coalesce(F.col("text"), F.lit(""))), terms))
    some = hit.agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("_some"))
    return hit.join(F.broadcast(some)).filter(F.col("_hit") | ~F.col("_some")).drop("_hit", "_some")  # one row on that side


def retrieve(docs: DataFrame, query: str, k: int = 5, least: float = 0.0) -> DataFrame:
    """PIPE-10: sparse dot product of unit term vectors (Q10), top k; ties by id. Terms are counted in the row, so that
    only the k best rows of each task travel; the query's terms are one row, worked out first."""
    asked = term_counts(docs.sparkSession.range(1), keywords(F.lit(query))).first().terms
    ks = docs.select("doc_id", keywords(F.coalesce("text", F.lit(""))).alias("_w"))
    ks = ks.filter(F.arrays_overlap("_w", F.lit([x.term for x in asked]))) if asked else ks.limit(0)
    d = term_counts(ks, F.col("_w"), "_t")
    has = lambda term: F.coalesce(F.get(F.filter("_t", lambda x: x.term == term), F.lit(0)).tf, F.lit(0))
    d = d.select("doc_id", length_of("_t").alias("_n"), *[has(x.term).alias(f"_q{i}") for i, x in enumerate(asked)])
    if not asked:
        return d.select("doc_id", F.lit(0.0).alias("score"))
    # terms that no text has are dropped before the query is scaled
    known = d.agg(*[F.coalesce(F.max(f"_q{i}"), F.lit(0)) for i in range(len(asked))]).first()
    scale = sum(x.tf**2 for x, n in zip(asked, known, strict=True) if n) ** 0.5 or 1.0
    score = sum((F.col(f"_q{i}") / F.col("_n") * (x.tf / scale) for i, x in enumerate(asked)), F.lit(0.0))
    return d.select("doc_id", F.round(score, 6).alias("score")).filter(F.col("score") >= least).orderBy(F.desc("score"), "doc_id").limit(k)


#: Terms of the queries up to which they are broadcast to the texts.
ASKED_TERMS = 1 << 20
#: What rounding to six places, and the order of a sum, may move a score by.
_SLACK = 2e-6


def _scored(pairs: DataFrame, index: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, row, doc_id, score) of pairs (key, row): exact, from the text's own row and the query's weights."""
    dot = F.aggregate("terms", F.lit(0.0), lambda s, x: s + x.v * F.coalesce(F.try_element_at("_w", x.term), F.lit(0.0)))
    return pairs.join(index, "row").join(weights, key).select(key, "row", "doc_id", F.round(dot, 6).alias("score"))


def asked_terms(queries: DataFrame, docs: DataFrame, key: str, k: int, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What retrieve_many() works with. index, written: (row, doc_id, terms), an array of (term, v) of the terms that any query has;
    counts, written: (term, n, most), of the texts that have a term their number and the largest weight; weights: (key, a map of the
    query's terms); terms, written: (key, term, w, rest, floor, essential). floor is the k-th best score among the texts in which a term of the query weighs
    most, so k texts reach it. Terms that together cannot reach it are not essential: they add up to at most rest, the sum of their
    largest contributions or, as texts have length one, the length of their weights."""
    q = term_vectors(queries, key, text).groupBy(key, "term").agg(F.sum("weight").alias("w"))
    q = checkpointed(q)
    asked = q.select("term").distinct()
    few = asked.limit(ASKED_TERMS + 1).count() <= ASKED_TERMS
    d = term_vectors(docs.withColumn("_row", F.struct(F.monotonically_increasing_id().alias("row"), "doc_id")), "_row", "text")
    d = d.join(F.broadcast(asked) if few else asked, "term", "left_semi")
    d = d.groupBy("_row").agg(F.collect_list(F.struct("term", F.col("weight").alias("v"))).alias("terms"))  # a text each
    index = checkpointed(d.select("_row.row", "_row.doc_id", "terms"))
    posting = index.select("row", F.explode("terms").alias("x")).select("row", "x.term", "x.v")
    counts = checkpointed(posting.groupBy("term").agg(F.count("*").alias("n"), F.max("v").alias("most")))
    weights = q.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("_w"))  # the terms of one query
    best = posting.withColumn("_r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("v"), "row"))).filter(F.col("_r") <= k)
    seeds = _scored(best.join(q, "term").select(key, "row").distinct(), index, weights, key)
    seeds = seeds.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "row"))).filter(F.col("_r") == k)
    t = q.join(counts, "term").withColumn("_u", F.col("w") * F.col("most")).join(seeds.select(key, F.col("score").alias("floor")), key, "left").fillna(0.0, ["floor"])
    by = Window.partitionBy(key)  # the terms of one query
    upto = by.orderBy("_u", "term").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_reach", F.least(F.sum("_u").over(upto), F.sqrt(F.sum(F.col("w") * F.col("w")).over(upto))))
    t = t.withColumn("essential", F.col("_reach") >= F.col("floor") - _SLACK)
    t = t.withColumn("rest", F.coalesce(F.max(F.when(~F.col("essential"), F.col("_reach"))).over(by), F.lit(0.0)))
    return index, counts, weights, checkpointed(t.select(key, "term", "w", "rest", "floor", "essential"))


def retrieve_many(queries: DataFrame, docs: DataFrame, key: str, k: int = 3, text: str = "text") -> DataFrame:
    """PIPE-10 for a table of queries: (key, doc_id, score), the k best texts of each, ties by doc_id. An inverted index with the largest
    weight of each term tells which terms of a query are essential: only texts that have one of them are met, by term, the frequent terms dealt to many
    tasks; those whose essential terms and the most of all others stay below the k-th score known are dropped; the rest get their exact
    score from their own row. Rows that share a doc_id are texts of their own. Null keys and texts without a keyword find nothing."""
    index, counts, weights, terms = asked_terms(queries, docs, key, k, text)
    posting = index.select("row", F.explode("terms").alias("x")).select("row", "x.term", "x.v")
    essential = terms.filter("essential").drop("essential")
    used = checkpointed(counts.join(essential.select("term").distinct(), "term", "left_semi").select("term", "n"))
    met = join_dealt(posting, essential, used, "term", "row")
    met = met.groupBy(key, "row").agg(F.sum(F.col("w") * F.col("v")).alias("_part"), F.first("rest").alias("rest"), F.first("floor").alias("floor"))
    met = met.filter(F.col("_part") + F.col("rest") >= F.col("floor") - _SLACK).select(key, "row")
    found = _scored(met, index, weights, key).drop("row")
    return found.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "doc_id"))).filter(F.col("_r") <= k).drop("_r")


def budget_context(found: DataFrame, docs: DataFrame, budget: int) -> DataFrame:
    """TOP-07: texts in order of score while they fit; those that do not fit are skipped. The input is a top-k list."""
    d = found.join(docs.select("doc_id", "text"), "doc_id")
    rows = d.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", F.length("text").alias("n")))).alias("x"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<bigint>").alias("ids"))
    step = lambda a, x: F.when(a.used + x.n <= budget, F.struct((a.used + x.n).alias("used"), F.array_append(a.ids, x.doc_id).alias("ids"))).otherwise(F.struct(a.used.alias("used"), a.ids.alias("ids")))
    return rows.select(F.explode(F.aggregate("x", start, step, lambda a: a.ids)).alias("doc_id"))


def vector_topk(vectors: DataFrame, query: Column, k: int, least: float = -1.0, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """JOIN-04, TOP-02, VEC-01 for one query vector: a scan with a top-k, no join."""
    return vectors.select(key, F.round(S.cosine(F.col(column), query), 6).alias("score")).filter(F.col("score") >= least).orderBy(F.desc("score"), key).limit(k)


def weighted_mean_vector(vectors: DataFrame, weight: Column, column: str = "embedding") -> DataFrame:
    """AGG-21: the weighted mean per place; equal weights, if they sum to 0."""
    d = vectors.select(F.posexplode(column).alias("place", "v"), weight.alias("w"))
    return d.groupBy("place").agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("v").cast("double") * F.col("w")), F.sum("w")), F.avg(F.col("v").cast("double"))), 6).alias("mean"))


def neighbours(edges: DataFrame, node) -> DataFrame:
    """GRF-02, JOIN-14."""
    return edges.filter((F.col("src") == node) | (F.col("dst") == node))


def similar_nodes(edges: DataFrame, node, k: int = 5) -> DataFrame:
    """GRF-03, JOIN-05: Jaccard of out-neighbours (distinct edges, Q9); only nodes that share one are met."""
    e = edges.select("src", "dst").distinct()
    mine = e.filter(F.col("src") == node).select("dst")
    common = e.join(mine, "dst").filter(F.col("src") != node).groupBy("src").agg(F.count("*").alias("common"))
    sizes = e.groupBy("src").agg(F.count("*").alias("size"))
    own = mine.agg(F.count("*").alias("own"))
    d = common.join(sizes, "src").join(F.broadcast(own))  # one row on that side
    return d.select(F.col("src").alias("node"), F.round(F.col("common") / (F.col("size") + F.col("own") - F.col("common")), 6).alias("jaccard")).orderBy(F.desc("jaccard"), "node").limit(k)


def subgraph(edges: DataFrame, seed, depth: int) -> DataFrame:
    """GRF-04: edges among the nodes within `depth` steps along the edges. Each step follows the edges of the nodes that the step before
    found first, those of hubs dealt to many tasks, and is written, so that neither plan nor work grows with what was seen."""
    e = checkpointed(edges.select("src", "dst").distinct())
    degree = checkpointed(e.groupBy("src").agg(F.count("*").alias("n")))
    seen = front = e.sparkSession.createDataFrame([(seed,)], e.select(F.col("src").alias("node")).schema)
    for _ in range(depth):
        found = join_dealt(e, front.select(F.col("node").alias("src")), degree, "src", "dst").select(F.col("dst").alias("node")).filter("node is not null").distinct()
        front = checkpointed(found.join(seen, "node", "left_anti"))
        if front.isEmpty():
            break
        seen = checkpointed(seen.union(front))
    return e.join(seen.select(F.col("node").alias("src")), "src", "left_semi").join(seen.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (src, dst), root being the smallest node that is connected: each round takes the smallest root among
    the neighbours and then that root's own, and is checkpointed, so rounds grow with the logarithm of a component's size."""
    e = edges.select("src", "dst").filter("src is not null and dst is not null")
    both = checkpointed(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    degree = checkpointed(both.groupBy("dst").agg(F.count("*").alias("n")))
    label = checkpointed(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("root")))
    while True:
        near = join_dealt(both, label.select(F.col("node").alias("dst"), "root"), degree, "dst", "src").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        new = checkpointed(label.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old")))
        tops = new.select(F.col("node").alias("root"), F.col("root").alias("top"))
        counts = checkpointed(new.groupBy("root").agg(F.count("*").alias("n")))
        label = checkpointed(join_dealt(new, tops, counts, "root", "node").select("node", F.least("root", "top").alias("root"), "old"))
        if label.filter("root <> old").isEmpty():
            return label.select("node", "root")


def graph_stats(edges: DataFrame) -> DataFrame:
    """GRF-05, AGG-18."""
    nodes = edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct()
    return edges.agg(F.count("*").alias("n_edges"), F.countDistinct("type").alias("edge_types")).join(F.broadcast(nodes.agg(F.count("*").alias("n_nodes"))))


def with_missing_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-01: ends of edges that have no node become nodes of type unknown."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return nodes.select("id", "type").unionByName(ends.join(nodes, "id", "left_anti").withColumn("type", F.lit("unknown")))


def with_properties(df: DataFrame, props: str, wanted: dict[str, str]) -> DataFrame:
    """FLT-06, GRF-06: rows whose map has all the given values."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(props)[k].eqNullSafe(F.lit(v)) for k, v in wanted.items()], F.lit(True)))
