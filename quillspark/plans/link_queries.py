"""Linking and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import articles as A
from quillspark.operators import graph as G
from quillspark.operators import linking as L
from quillspark.plans import sql
from quillspark.plans.article_queries import view
from quillspark.plans.registry import register
from quillspark.session import saved, table, texts


def tiered(spark, sf_dir):
    docs = texts(spark, sf_dir)
    kw = A.keywords(docs)
    return L.tiers(kw, L.frequencies(kw, docs))


def kept(spark, sf_dir):
    """The same, written once: ten short rows a document, which joins with itself read several times."""
    return saved(tiered(spark, sf_dir))


def six_places(name: str):
    """Rounded as the SQL does it: the binary value counts, not its shortest decimal form."""
    return (F.floor(F.col(name) * 1e6 + 0.5) / 1e6).alias(name)


def mutual_edges(spark, sf_dir, tier=None):
    budget = saved(L.budgets(view(spark, sf_dir, confidence=True)))
    rank = saved(L.best(tier or kept(spark, sf_dir), budget))
    return L.mutual(rank, budget), rank, budget


@register("link_tiers", f"WITH {sql.TIERS} SELECT doc_id, kw, tier FROM tier")
def link_tiers(spark, sf_dir):
    return tiered(spark, sf_dir).select("doc_id", "kw", "tier")


@register("link_candidates", f"WITH {sql.CANDIDATES} SELECT a, b, round(score, 6) AS score FROM cnd")
def link_candidates(spark, sf_dir):
    return L.candidates(kept(spark, sf_dir)).select("a", "b", six_places("score"))


@register("link_budget", f"WITH {sql.ARTICLES}, {sql.BUDGETS} SELECT doc_id, budget FROM bud")
def link_budget(spark, sf_dir):
    return L.budgets(view(spark, sf_dir, confidence=True))


@register("link_mutual_topk", f"{sql.MUTUAL} SELECT a, b FROM mut")
def link_mutual_topk(spark, sf_dir):
    return mutual_edges(spark, sf_dir)[0]


@register("link_rescue")
def link_rescue(spark, sf_dir):
    edges, rank, budget = mutual_edges(spark, sf_dir)
    return L.rescued(edges, rank, budget)


_freq = "fr AS (SELECT kw, count(*) AS df, any_value(n) AS n, ln(CAST(any_value(n) + 1 AS DOUBLE) / (count(*) + 1)) + 1 AS idf FROM kw, tot GROUP BY kw)"
_plain = f"WITH {sql.KEYWORDS}, {_freq}, br AS (SELECT doc_id, kw, idf FROM kw JOIN fr USING (kw) WHERE n < 10 OR df <= CAST(0.2 AS DOUBLE) * n)"


@register("link_legacy_idf", f"{_plain} SELECT a, b, round(score, 6) AS score FROM (SELECT x.doc_id AS a, y.doc_id AS b, round(sum(x.idf), 9) AS score FROM br x JOIN br y ON x.kw = y.kw AND x.doc_id < y.doc_id GROUP BY 1, 2) WHERE score >= 5.5")
def link_legacy_idf(spark, sf_dir):
    docs = texts(spark, sf_dir)
    kw = saved(A.keywords(docs))
    return L.legacy_idf(kw, L.frequencies(kw, docs)).select("a", "b", six_places("score"))


@register("link_legacy_count", f"{_plain} SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM br x JOIN br y ON x.kw = y.kw AND x.doc_id < y.doc_id GROUP BY 1, 2 HAVING count(*) >= 2")
def link_legacy_count(spark, sf_dir):
    docs = texts(spark, sf_dir)
    kw = saved(A.keywords(docs))
    return L.legacy_count(kw, L.frequencies(kw, docs))


@register("merge_candidates", f"WITH {sql.TIERS}, {sql.MERGES} SELECT a, b, ratio FROM mrg")
def merge_candidates(spark, sf_dir):
    return L.merge_candidates(kept(spark, sf_dir))


@register("supersede_losers", f"WITH {sql.TIERS}, {sql.MERGES}, p AS (SELECT a, b, 'doc-' || a AS x, 'doc-' || b AS y FROM mrg), l AS (SELECT CASE WHEN len(x) > len(y) THEN x ELSE y END AS loser, CASE WHEN len(x) > len(y) THEN y ELSE x END AS winner, a, b FROM p) SELECT loser, winner FROM (SELECT *, row_number() OVER (PARTITION BY loser ORDER BY a DESC, b DESC) AS r FROM l) WHERE r = 1")
def supersede_losers(spark, sf_dir):
    return L.superseded(L.merge_candidates(kept(spark, sf_dir)))


_report = """dg AS (SELECT d, count(*) AS c FROM (SELECT a AS d FROM mut UNION ALL SELECT b FROM mut) GROUP BY d), z AS (SELECT budget, coalesce(c, 0) AS c FROM bud LEFT JOIN dg ON doc_id = d)
SELECT count(*) AS articles, CAST(sum(c) AS BIGINT) AS directed_links, CAST(sum(c) / 2 AS BIGINT) AS undirected_links, CAST(sum(CAST(c = 0 AS INT)) AS BIGINT) AS orphans, round(avg(c), 2) AS mean_degree, max(c) AS max_degree,
  min(budget) AS min_budget, CAST(median(budget) AS DOUBLE) AS median_budget, max(budget) AS max_budget FROM z"""


@register("link_report", f"{sql.MUTUAL}, {_report}")
def link_report(spark, sf_dir):
    edges, _, budget = mutual_edges(spark, sf_dir)
    return L.report(view(spark, sf_dir), edges, budget)


@register("related_lists", f"{sql.MUTUAL}, u AS (SELECT a AS s, b AS t FROM mut UNION ALL SELECT b, a FROM mut) SELECT doc_id, coalesce(string_agg('doc-' || t, ',' ORDER BY 'doc-' || t), '') AS related FROM documents LEFT JOIN u ON s = doc_id GROUP BY doc_id")
def related_lists(spark, sf_dir):
    edges = mutual_edges(spark, sf_dir)[0]
    out = L.materialised(view(spark, sf_dir).select("doc_id", "slug"), edges)
    return out.select("doc_id", F.array_join(F.transform("related", lambda r: r["slug"]), ",").alias("related"))


@register("kg_export", f"{sql.MUTUAL}, sh AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM kw x JOIN kw y ON x.kw = y.kw AND x.doc_id < y.doc_id GROUP BY 1, 2) SELECT 'doc-' || a AS source, 'doc-' || b AS target, greatest(coalesce(c, 0), 1) AS weight FROM mut LEFT JOIN sh USING (a, b)")
def kg_export(spark, sf_dir):
    kw = kept(spark, sf_dir)
    edges = mutual_edges(spark, sf_dir, kw)[0]
    kw = kw.select("doc_id", "kw")
    rows = edges.join(kw.withColumnRenamed("doc_id", "a"), "a").join(kw.select(F.col("doc_id").alias("b"), F.col("kw").alias("_k")), "b")
    shared = rows.groupBy("a", "b").agg(F.sum((F.col("kw") == F.col("_k")).cast("long")).alias("weight"))
    name = lambda c: F.concat(F.lit("doc-"), F.col(c))
    return shared.select(name("a").alias("source"), name("b").alias("target"), F.greatest("weight", F.lit(1)).alias("weight"))


@register("kg_by_type", f"WITH {sql.ARTICLES} SELECT t.type, count(slug) AS n FROM (VALUES ('base'), ('process'), ('plan'), ('help'), ('research-note'), ('note'), ('mission')) t(type) LEFT JOIN art ON art.type = t.type GROUP BY t.type")
def kg_by_type(spark, sf_dir):
    kinds = spark.createDataFrame([(t,) for t in ("base", "process", "plan", "help", "research-note", "note", "mission")], "type string")
    return kinds.join(view(spark, sf_dir).groupBy("type").count(), "type", "left").select("type", F.coalesce("count", F.lit(0)).alias("n"))


@register("merge_with", f"WITH {sql.KEYWORDS}, o AS (SELECT kw FROM kw WHERE doc_id = 5), s AS (SELECT doc_id, count(*) AS shared FROM kw JOIN o USING (kw) WHERE doc_id <> 5 GROUP BY doc_id), z AS (SELECT doc_id, count(*) AS n FROM kw GROUP BY doc_id) SELECT doc_id, shared, round(CAST(shared AS DOUBLE) / least(n, (SELECT count(*) FROM o)), 4) AS ratio FROM s JOIN z USING (doc_id) WHERE CAST(shared AS DOUBLE) / least(n, (SELECT count(*) FROM o)) > 0.5")
def merge_with(spark, sf_dir):
    kw = A.keywords(texts(spark, sf_dir))
    own = kw.where("doc_id = 5").agg(F.collect_list("kw").alias("_own"))  # keywords of one article
    rows = kw.where("doc_id <> 5").groupBy("doc_id").agg(F.collect_list("kw").alias("_kw")).crossJoin(F.broadcast(own))
    shared = F.size(F.array_intersect("_kw", "_own"))
    ratio = shared / F.least(F.size("_kw"), F.size("_own"))
    return rows.where(ratio > 0.5).select("doc_id", shared.cast("long").alias("shared"), F.round(ratio, 4).alias("ratio"))


# a graph of the order tables: region > nation > customer and supplier
_edges_sql = """SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier"""
_nodes_sql = """SELECT 'r' || r_regionkey AS node_id, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, c_name FROM customer UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier"""


def graph(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    e = lambda d, a, x, b, y: d.select(F.concat(F.lit(a), F.col(x)).alias("source"), F.concat(F.lit(b), F.col(y)).alias("target"))
    n = lambda d, a, x, y: d.select(F.concat(F.lit(a), F.col(x)).alias("node_id"), F.col(y).alias("name"))
    edges = e(t("nation"), "r", "n_regionkey", "n", "n_nationkey").union(e(t("customer"), "n", "c_nationkey", "c", "c_custkey")).union(e(t("supplier"), "n", "s_nationkey", "s", "s_suppkey"))
    nodes = n(t("region"), "r", "r_regionkey", "r_name").union(n(t("nation"), "n", "n_nationkey", "n_name")).union(n(t("customer"), "c", "c_custkey", "c_name")).union(n(t("supplier"), "s", "s_suppkey", "s_name"))
    return nodes, edges


@register("graph_neighbors", f"SELECT target AS node_id, name FROM ({_edges_sql}) LEFT JOIN ({_nodes_sql}) ON node_id = target WHERE source = 'n3'")
def graph_neighbors(spark, sf_dir):
    return G.command("NEIGHBORS g n3", *graph(spark, sf_dir))


@register("graph_both", f"WITH e AS ({_edges_sql}) SELECT DISTINCT x AS node_id, name FROM (SELECT target AS x FROM e WHERE source = 'n3' UNION ALL SELECT source FROM e WHERE target = 'n3') LEFT JOIN ({_nodes_sql}) ON node_id = x")
def graph_both(spark, sf_dir):
    return G.neighbors(*graph(spark, sf_dir), "n3", "both")


@register("graph_shortest_path", f"WITH RECURSIVE e AS ({_edges_sql} UNION ALL SELECT 'r' || r_regionkey, 'r' || (r_regionkey + 1) % 5 FROM region), u AS (SELECT source, target FROM e UNION ALL SELECT target, source FROM e), w(node, path, d) AS (SELECT 'c1', ['c1'], 0 UNION ALL SELECT u.target, list_append(path, u.target), d + 1 FROM w JOIN u ON u.source = node WHERE d < 6 AND NOT list_contains(path, u.target) AND (u.target = 's1' OR u.target[1:1] IN ('n', 'r'))) SELECT array_to_string(path, ' -> ') AS path, d AS length FROM w WHERE node = 's1' ORDER BY d, path LIMIT 1")
def graph_shortest_path(spark, sf_dir):
    ring = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("source"), F.concat(F.lit("r"), (F.col("r_regionkey") + 1) % 5).alias("target"))
    edges = graph(spark, sf_dir)[1].union(ring)
    both = G.undirected(edges).select(F.col("src").alias("source"), F.col("dst").alias("target"))
    return G.shortest_path(both, "c1", "s1")


@register("graph_stats", f"SELECT (SELECT count(*) FROM ({_nodes_sql})) AS node_count, (SELECT count(*) FROM ({_edges_sql})) AS edge_count, 'node_id,name' AS node_columns")
def graph_stats(spark, sf_dir):
    return G.graph_stats(*graph(spark, sf_dir))


@register("graph_degree", f"WITH e AS ({_edges_sql}) SELECT x AS node_id, count(*) AS degree FROM (SELECT source AS x FROM e UNION ALL SELECT target FROM e) GROUP BY x")
def graph_degree(spark, sf_dir):
    return G.degrees(graph(spark, sf_dir)[1])


_shown = "regexp_replace({0}, '^c', 'z')"


@register("graph_vis_export", f"WITH n AS (SELECT {_shown.format('node_id')} AS node_id FROM ({_nodes_sql})), f AS (SELECT node_id FROM n ORDER BY node_id LIMIT 500), e AS (SELECT {_shown.format('source')} AS source, {_shown.format('target')} AS target FROM ({_edges_sql})) SELECT source, target FROM e WHERE source IN (SELECT node_id FROM f) AND target IN (SELECT node_id FROM f) ORDER BY source, target LIMIT 5000")
def graph_vis_export(spark, sf_dir):
    """The whole graph, customers named so that they come after regions, nations and suppliers."""
    nodes, edges = graph(spark, sf_dir)
    named = lambda c: F.regexp_replace(c, "^c", "z").alias(c)
    return G.exported(nodes.select(named("node_id"), "name"), edges.select(named("source"), named("target")))[1]


@register("graph_unique_edges", f"WITH e AS ({_edges_sql}), b AS (SELECT * FROM e UNION ALL SELECT target, source FROM e) SELECT least(source, target) AS source, greatest(source, target) AS target FROM b GROUP BY 1, 2")
def graph_unique_edges(spark, sf_dir):
    edges = graph(spark, sf_dir)[1]
    twice = edges.union(edges.select(F.col("target"), F.col("source")))
    return G.unique_undirected(twice)


@register("graph_ego", f"WITH e AS ({_edges_sql}), u AS (SELECT 'n3' AS x UNION SELECT target FROM e WHERE source = 'n3' UNION SELECT source FROM e WHERE target = 'n3') SELECT source, target FROM e WHERE source IN (SELECT x FROM u) AND target IN (SELECT x FROM u)")
def graph_ego(spark, sf_dir):
    return G.ego(graph(spark, sf_dir)[1], "n3")
