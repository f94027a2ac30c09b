"""All core queries by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.functions.runtime import partitions, table
from spindrel.operators import components, graph, intervals, similarity, temporal, texts, traversal, vectors
from spindrel.plans.registry import QUERIES, SQL, Query, query
from spindrel.plans.registry import rounded as _r
from spindrel.sources import graphs
from spindrel.streaming import events as streams

# -- intervals ------------------------------------------------------------------------------------

_ISLANDS = """
with e as (select source, target, epoch_us(valid_from) s,
    case when valid_until is null or year(valid_until) >= 9999 then 9223372036854775807 else epoch_us(valid_until) end t
  from temporal_edges where source is not null and target is not null and valid_from is not null and (valid_until is null or valid_until > valid_from)),
m as (select *, max(t) over (partition by source, target order by s, t rows between unbounded preceding and 1 preceding) prev from e)
"""


@query(_ISLANDS + "select source, target, prev // 1000 as gap_from_ms, s // 1000 as gap_until_ms from m where s > prev and s // 1000 - prev // 1000 >= 1000")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = intervals.gaps(table(spark, d, "temporal_edges"), ["source", "target"], "valid_from", "valid_until")
    ms = lambda c: F.floor(F.col(c) / 1000).cast("long")
    found = found.select("source", "target", ms("gap_from").alias("gap_from_ms"), ms("gap_until").alias("gap_until_ms"))
    return found.where("gap_until_ms - gap_from_ms >= 1000")


@query(_ISLANDS + """, g as (select *, sum(case when prev is null or s > prev then 1 else 0 end) over (partition by source, target order by s, t rows unbounded preceding) i from m)
select source, target, min(s) as period_from, nullif(max(t), 9223372036854775807) as period_until from g group by source, target, i""")
def p3_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods(table(spark, d, "temporal_edges"), ["source", "target"], "valid_from", "valid_until")


# -- views of the relational tables as a graph ----------------------------------------------------

_NODES = """nodes as (
  select 'region:' || r_regionkey as id, 'region' as type, r_name as name, null::double as amount from region
  union all select 'nation:' || n_nationkey, 'nation', n_name, null from nation
  union all select 'customer:' || c_custkey, 'customer', c_name, c_acctbal from customer
  union all select 'supplier:' || s_suppkey, 'supplier', s_name, s_acctbal from supplier
  union all select 'part:' || p_partkey, 'part', p_name, p_retailprice from part
  union all select 'orders:' || o_orderkey, 'orders', 'orders:' || o_orderkey, o_totalprice from orders)"""
_EDGES = """edges as (
  select 'nation:' || n_nationkey as source, 'region:' || n_regionkey as target, 'part_of' as type, 1.0::double as weight from nation
  union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in', 1.0 from customer
  union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 1.0 from supplier
  union all select 'customer:' || o_custkey, 'orders:' || o_orderkey, 'placed', 1.0 from orders
  union all select 'orders:' || l_orderkey, 'part:' || l_partkey, 'contains', l_quantity from lineitem
  union all select distinct 'supplier:' || l_suppkey, 'part:' || l_partkey, 'supplies', 1.0 from lineitem)"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    nodes = graphs.star_nodes(spark, d)
    edges = graphs.star_edges(spark, d, ("part_of", "located_in"))
    start = [r["id"] for r in nodes.where("type = 'region' and name = 'AFRICA'").select("id").limit(1).collect()]
    reach = traversal.bfs(nodes, edges, start, 2, "in", ["part_of", "located_in"])
    rows = reach.join(nodes, "id").where(F.col("type").isin("customer", "supplier"))
    return rows.select("id", "type", "name", _r("amount"), "depth", "path").orderBy(F.desc("amount"), "id").limit(50)


@query(f"""with {_NODES} select c.id, c.type, c.name, round(c.amount, 6) as amount, 2::int as depth, r.id || '>' || n.id || '>' || c.id as path
from nodes r join (select 'region:' || n_regionkey r, 'nation:' || n_nationkey id from nation) n on r.id = n.r
join (select 'nation:' || c_nationkey n, 'customer:' || c_custkey id from customer union all select 'nation:' || s_nationkey, 'supplier:' || s_suppkey from supplier) l on l.n = n.id
join nodes c on c.id = l.id where r.name = 'AFRICA' and r.type = 'region' order by c.amount desc, c.id limit 50""")
def region_customers(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d)


@query(f"with {_NODES} select id, name from nodes where type = 'nation'")
def label_filter(spark: SparkSession, d: str) -> DataFrame:
    return graph.with_label(graphs.star_nodes(spark, d), "nation").select("id", "name")


@query("select type, count(*) as n from graph_nodes group by type")
def label_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.label_counts(table(spark, d, "graph_nodes"))


for _op, _col, _val, _cond in (
    ("eq", "c_mktsegment", "BUILDING", "c_mktsegment = 'BUILDING'"),
    ("ne", "c_mktsegment", "BUILDING", "c_mktsegment <> 'BUILDING'"),
    ("lt", "c_acctbal", 0.0, "c_acctbal < 0"),
    ("gt", "c_acctbal", 9000.0, "c_acctbal > 9000"),
    ("lte", "c_nationkey", 3, "c_nationkey <= 3"),
    ("gte", "c_nationkey", 20, "c_nationkey >= 20"),
    ("contains", "c_name", "customer#00000001", "contains(lower(c_name), 'customer#00000001')"),
    ("matches", "c_mktsegment", "^(auto|mach)", "regexp_matches(c_mktsegment, '^(auto|mach)', 'i')"),
):

    def _one(spark: SparkSession, d: str, op: str = _op, col: str = _col, val: object = _val) -> DataFrame:
        return table(spark, d, "customer").where(graph.property_condition(F.col(col), op, val)).select("c_custkey", "c_name")

    _one.__name__ = f"property_{_op}"
    query(f"select c_custkey, c_name from customer where {_cond}")(_one)


@query("select id from graph_nodes where map_contains(properties, 'status')")
def property_exists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_nodes").where(F.map_contains_key("properties", F.lit("status"))).select("id")


@query("select p_brand as value, count(distinct p_partkey) as n from part where p_brand is not null group by 1")
def property_distribution(spark: SparkSession, d: str) -> DataFrame:
    return graph.property_distribution(table(spark, d, "part").withColumnRenamed("p_partkey", "id"), "p_brand")


@query(f"with {_EDGES} select source, target, type from edges where source in ('orders:1', 'customer:7')")
def out_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.out_edges(graphs.star_edges(spark, d), ["orders:1", "customer:7"]).select("source", "target", "type")


@query(f"with {_EDGES} select source, target, type from edges where target = 'nation:3' and type = 'located_in'")
def in_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_edges(graphs.star_edges(spark, d), ["nation:3"], ["located_in"]).select("source", "target", "type")


@query("""select source as id, target as neighbour, type, 'out' as direction from temporal_edges where source = 'node_system'
union all select target, source, type, 'in' from temporal_edges where target = 'node_system'""")
def neighbours_both(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(table(spark, d, "temporal_edges"), ["node_system"])


@query("""select n as nodes, m as edges, round(m / (n::double * (n - 1)), 9) as density, 600 * n + 200 * m as memory_bytes
from (select count(*) n from graph_nodes), (select count(*) m from temporal_edges)""")
def graph_metrics(spark: SparkSession, d: str) -> DataFrame:
    return graph.metrics(table(spark, d, "graph_nodes"), table(spark, d, "temporal_edges")).withColumn("density", F.round("density", 9))


@query("""select id, 'source' as missing from temporal_edges where source not in (select id from graph_nodes)
union all select id, 'target' from temporal_edges where target not in (select id from graph_nodes)""")
def graph_consistency(spark: SparkSession, d: str) -> DataFrame:
    return graph.dangling(table(spark, d, "graph_nodes"), table(spark, d, "temporal_edges")).select("id", "missing")


@query("select type, count(*) as n from temporal_edges where source <> 'node_system' and target <> 'node_system' group by type")
def remove_node_cascade(spark: SparkSession, d: str) -> DataFrame:
    gone = spark.createDataFrame([("node_system",)], "id string")
    return graph.label_counts(graph.remove_nodes(table(spark, d, "graph_nodes"), table(spark, d, "temporal_edges"), gone)[1])


def _reach(start: str, hops: int, step: str) -> str:
    return f"""with recursive {_EDGES}, steps as ({step}), r(id, depth) as (select '{start}', 0 union select v, depth + 1 from r join steps on id = u where depth < {hops})
select id, min(depth)::int as depth from r group by id"""


@query(_reach("customer:7", 3, "select source u, target v from edges"))
def bfs_out(spark: SparkSession, d: str) -> DataFrame:
    return traversal.bfs(graphs.star_nodes(spark, d), graphs.star_edges(spark, d, once=False), ["customer:7"], 3).select("id", "depth")


@query(_reach("region:1", 2, "select target u, source v from edges where type in ('part_of', 'located_in')"))
def bfs_in(spark: SparkSession, d: str) -> DataFrame:
    return traversal.bfs(graphs.star_nodes(spark, d), graphs.star_edges(spark, d, ("part_of", "located_in")), ["region:1"], 2, "in").select("id", "depth")


@query(_reach("nation:5", 3, "select source u, target v from edges where type in ('part_of', 'located_in') union all select target, source from edges where type in ('part_of', 'located_in')"))
def bfs_both_typed(spark: SparkSession, d: str) -> DataFrame:
    return traversal.bfs(graphs.star_nodes(spark, d), graphs.star_edges(spark, d, ("part_of", "located_in")), ["nation:5"], 3, "both").select("id", "depth")


_PLACES = f"""with recursive {_EDGES}, steps as (select source u, target v from edges where type in ('part_of', 'located_in') union select target, source from edges where type in ('part_of', 'located_in')),"""


@query(_PLACES + """ pairs(a, b) as (values ('nation:0', 'nation:5'), ('nation:0', 'nation:1'), ('region:0', 'region:0')),
r(a, id, p) as (select a, a, [a] from pairs union select r.a, v, list_append(p, v) from r join steps on id = u where len(p) < 5 and not list_contains(p, v))
select pairs.a, pairs.b, (len(p) - 1)::int as distance, array_to_string(p, '>') as path from pairs join r on r.a = pairs.a and r.id = pairs.b qualify row_number() over (partition by pairs.a, pairs.b order by len(p), array_to_string(p, '>')) = 1""")
def shortest_path_bidir(spark: SparkSession, d: str) -> DataFrame:
    edges = graphs.star_edges(spark, d, ("part_of", "located_in"))
    out = None
    for a, b in (("nation:0", "nation:5"), ("nation:0", "nation:1"), ("region:0", "region:0")):
        one = traversal.shortest_path(edges, a, b, 4).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "distance", "path")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with recursive {_EDGES}, steps as (select source u, target v from edges where type in ('part_of', 'located_in') union select target, source from edges where type in ('part_of', 'located_in')),
r(id, p) as (select 'nation:0', ['nation:0'] union all select v, list_append(p, v) from r join steps on id = u where len(p) < 5 and not list_contains(p, v) and id <> 'nation:5')
select array_to_string(p, '>') as path, (len(p) - 1)::int as hops from r where id = 'nation:5'""")
def all_simple_paths(spark: SparkSession, d: str) -> DataFrame:
    return traversal.simple_paths(graphs.star_edges(spark, d, ("part_of", "located_in")), "nation:0", "nation:5", 4)


@query(f"""with {_EDGES} select s.source as supplier, c.source as customer, s.target as nation from edges s join edges c on s.target = c.target
where s.type = 'located_in' and c.type = 'located_in' and s.source like 'supplier:%' and c.source like 'customer:%'""")
def motif_same_nation(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graphs.star_nodes(spark, d), graphs.star_edges(spark, d, ("located_in",))
    kinds = {v: F.col("type") == v for v in ("supplier", "nation", "customer")}
    return graph.match_motif(nodes, edges, kinds, [("supplier", "nation", "located_in", "out"), ("nation", "customer", "located_in", "in")])


@query("select 'customer:' || o_custkey as a, 'orders:' || o_orderkey as b, 'part:' || l_partkey as c from orders join lineitem on o_orderkey = l_orderkey")
def motif_two_hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.two_hop(graphs.star_edges(spark, d, ("placed", "contains")), "placed", "contains")


@query("""with e as (select distinct source, target from temporal_edges where lower(type) = 'part_of' and source <> 'node_system')
select a.source as parent, a.target as a, b.target as b from e a join e b on a.source = b.source and a.target < b.target""")
def siblings(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "temporal_edges").where("source <> 'node_system'").withColumn("type", F.lower("type"))
    return graph.siblings(edges, ["part_of"])


@query("select floor(confidence * 10)::int as bucket, count(*) as n from text_chunks where confidence is not null group by 1")
def confidence_buckets(spark: SparkSession, d: str) -> DataFrame:
    return graph.confidence_buckets(table(spark, d, "text_chunks"), "confidence")


@query("""with n as (select target id, count(*) n from temporal_edges group by 1), m as (select distinct lower(type) g, id from graph_nodes where type is not null),
r as (select g, m.id, coalesce(n, 0) n, row_number() over (partition by g order by coalesce(n, 0) desc, m.id) k from m left join n using (id)) select g as "group", id as root, n as incoming from r where k = 1""")
def hierarchy_roots(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "graph_nodes").where("type is not null").select(F.lower("type").alias("group"), "id").distinct()
    return graph.roots(members, table(spark, d, "temporal_edges"))


@query(f"""with recursive {_EDGES}, steps as (select source u, target v from edges where type in ('part_of', 'located_in') union select target, source from edges where type in ('part_of', 'located_in')),
r(id, root) as (select u, u from steps where u like 'region:%' union select v, root from r join steps on id = u), k as (select id, min(root) root from r group by 1)
select k.id as node, g.component from k join (select root, min(id) component from k group by 1) g using (root)""")
def connected_groups(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_components(graphs.star_edges(spark, d, ("part_of", "located_in")), "source", "target")


# -- texts ----------------------------------------------------------------------------------------

_TOK = """t as (select doc_id as id, unnest(list_distinct(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '[^a-zA-Z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: length(x) between 2 and 50))) as token from documents)"""


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return texts.postings(table(spark, d, "documents"), "doc_id", "text")


@query(f"with {_TOK} select distinct id from t where token in ('checklist', 'roadmap')")
def text_any(spark: SparkSession, d: str) -> DataFrame:
    return texts.any_term(_posts(spark, d), ["checklist", "roadmap"])


@query(f"with {_TOK} select id from t where token in ('work', 'stopped', 'checklist') group by id having count(distinct case when token = 'checklist' then 1 else 2 end) = 2")
def text_all(spark: SparkSession, d: str) -> DataFrame:
    return texts.all_terms(_posts(spark, d), ["checklist", "work stopped"])


@query("select doc_id as id from documents where contains(' ' || trim(regexp_replace(lower(text), '[^a-zA-Z0-9_]+', ' ', 'g')) || ' ', ' several volunteers ')")
def text_phrase(spark: SparkSession, d: str) -> DataFrame:
    return texts.phrase(table(spark, d, "documents"), "doc_id", "text", "several volunteers")


@query(f"with {_TOK} select token, count(*) as n from t group by token order by n desc, token limit 20")
def token_topk(spark: SparkSession, d: str) -> DataFrame:
    return texts.token_frequency(_posts(spark, d), 20)


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in texts.STOP) + "]"


@query(f"""with w as (select memory_id, word, min(i) i from (select memory_id, unnest(string_split_regex(lower(content), '\\s+')) word, generate_subscripts(string_split_regex(lower(content), '\\s+'), 1) i from (select distinct memory_id, content from memories where content is not null))
where length(word) > 2 and not list_contains({_STOP_SQL}, word) group by 1, 2), k as (select *, row_number() over (partition by memory_id order by i) r from w)
select m.memory_id, coalesce(string_agg(word, ' ' order by i), '') as words from (select distinct memory_id from memories where content is not null) m left join k on k.memory_id = m.memory_id and r <= 10 group by 1""")
def keyword_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").where("content is not null").select("memory_id", F.array_join(texts.keywords(F.col("content")), " ").alias("words")).distinct()


@query("select distinct id from graph_nodes where len(list_filter(map_values(properties), lambda v: contains(lower(v), 'protocol'))) > 0")
def legacy_text_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_nodes").where(F.exists(F.map_values("properties"), lambda v: F.contains(F.lower(v), F.lit("protocol")))).select("id").distinct()


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return texts.chunks(table(spark, d, "documents"), "doc_id", "text")


def _conf(t: str) -> str:
    c = f"(case when length({t}) < 50 then 0.5 else 1.0 end * case when length({t}) > 1000 then 0.7 else 1.0 end * case when regexp_matches({t}, '[.!?]$') then 1.1 else 1.0 end * case when length({t}) - length(regexp_replace({t}, '\\s', '', 'g')) > 0.3 * length({t}) then 0.8 else 1.0 end)::double"
    return f"greatest(0.0, least(1.0, {c}))"


def _tier(split: str, kind: str) -> str:
    return f"""select doc, '{kind}' kind, i, t, {_conf('t')} c from (select doc_id doc, unnest(range(1, len(a) + 1)) i, trim(regexp_replace(unnest(a), '\\s+', ' ', 'g')) t from (select doc_id, string_split_regex(text, '{split}') a from d))
  where length(t) between 50 and 1000 and {_conf('t')} >= 0.7"""


_CHUNKS_SQL = f"""d as (select doc_id, text from documents where length(trim(text)) > 0), one as ({_tier('[.!?]+', 'sentence')}), two as (select * from ({_tier('[\\n]\\s*[\\n]', 'paragraph')}) where doc not in (select doc from one)),
three as (select doc_id doc, 'document' kind, 1 i, text t, 1.0::double c from d where doc_id not in (select doc from one) and doc_id not in (select doc from two)),
chunk as (select doc, (row_number() over (partition by doc order by i) - 1)::int pos, kind, t as text, c as confidence from (from one union all from two union all from three))"""


@query(f"with {_CHUNKS_SQL} select doc, pos, kind, text, round(confidence, 6) as confidence from chunk")
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).withColumn("confidence", F.round("confidence", 6))


@query(f"with {_CHUNKS_SQL} select a.doc, a.pos as a, b.pos as b from chunk a join chunk b on a.doc = b.doc and b.pos = a.pos + 1")
def sequential_relations(spark: SparkSession, d: str) -> DataFrame:
    return texts.sequential(_chunks(spark, d))


@query(f"with {_CHUNKS_SQL} select a.doc, a.pos as a, b.pos as b, round(greatest(0.1::double, 1 - abs(a.pos - b.pos) / 5.0::double), 6) as weight from chunk a join chunk b on a.doc = b.doc and abs(a.pos - b.pos) between 1 and 5")
def cooccurrence_relations(spark: SparkSession, d: str) -> DataFrame:
    return texts.cooccurrence(_chunks(spark, d)).withColumn("weight", F.round("weight", 6))


# -- vectors --------------------------------------------------------------------------------------

_WANTED = [((i * 37) % 11 - 5) / 10 for i in range(64)]
_Q = "[" + ", ".join(map(str, _WANTED)) + "]::double[]"


def _top(metric: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return vectors.top_k(table(spark, d, "embeddings"), "vec_id", "embedding", _WANTED, 10, metric).select("id", _r("score"))

    run.__name__ = f"vector_{metric}_topk"
    return run


for _m, _s in (("cosine", f"list_cosine_similarity(embedding::double[], {_Q})"), ("euclidean", f"1 / (1 + list_distance(embedding::double[], {_Q}))"), ("dot", f"greatest(0, least(1, (list_dot_product(embedding::double[], {_Q}) + 1) / 2))")):
    query(f"select vec_id as id, round({_s}, 6) as score from embeddings order by {_s} desc, vec_id limit 10")(_top(_m))


@query("select label as \"group\", (p - 1)::int as pos, round(avg(embedding[p]::double), 6) as value from embeddings, range(1, 65) t(p) group by 1, 2")
def centroid_by_label(spark: SparkSession, d: str) -> DataFrame:
    return vectors.centroids(table(spark, d, "embeddings"), "label", "embedding").select("group", "pos", _r("value"))


@query("select round(avg(x::double), 6) as mean, round(stddev_pop(x::double), 6) as std, round(min(x::double), 6) as low, round(max(x::double), 6) as high from (select unnest(embedding) x from embeddings)")
def embedding_stats(spark: SparkSession, d: str) -> DataFrame:
    return vectors.embedding_stats(table(spark, d, "embeddings"), "embedding").select(_r("mean"), _r("std"), _r("low"), _r("high"))


@query("select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def neighbour_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    both = e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    return both.select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), F.round(vectors.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine"))


# -- names ----------------------------------------------------------------------------------------


#: Null and blank names are none.
_NAMES_SQL = "n as (select distinct regexp_replace(lower(name), '[^ -~]', '?', 'g') nm from entity_records where length(trim(name)) > 0)"


def _names(spark: SparkSession, d: str) -> DataFrame:
    plain = F.regexp_replace(F.lower("name"), "[^ -~]", "?")  # DuckDB counts edits in bytes
    return table(spark, d, "entity_records").where("length(trim(name)) > 0").select(plain.alias("n")).distinct()


@query(f"""with {_NAMES_SQL}
select x.nm as a, y.nm as b, round(1 - levenshtein(x.nm, y.nm)::double / greatest(length(x.nm), length(y.nm)), 6) as score from n x join n y on x.nm < y.nm
where 1 - levenshtein(x.nm, y.nm)::double / greatest(length(x.nm), length(y.nm)) >= 0.8""")
def levenshtein_sim(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of close names."""
    return similarity.close_by_edits(_names(spark, d), 0.8).select("a", "b", F.round("score", 6).alias("score"))


def _name_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = similarity.with_bits(_names(spark, d).where("length(trim(n)) >= 4"))
    k = lambda c: n.select(F.col("n").alias(c), F.col("one").alias(c + "1"), F.col("two").alias(c + "2"), F.substring("n", 1, 4).alias("key"))
    a, b = similarity.in_blocks(k("a"), k("b"), "key", "a", "b")
    return a.join(b, ["key", "i", "j"]).where("a < b and abs(length(a) - length(b)) <= 3")


def _tokens_sql(c: str) -> str:
    return f"list_distinct(list_filter(string_split_regex({c}, '\\s+'), lambda t: t <> ''))"


@query(f"with {_NAMES_SQL}, p as (select x.nm as a, y.nm as b from n x join n y on x.nm < y.nm), j as (select a, b, len(list_intersect({_tokens_sql('a')}, {_tokens_sql('b')}))::double / len(list_distinct(list_concat({_tokens_sql('a')}, {_tokens_sql('b')}))) s from p) select a, b, round(s, 6) as score from j where s > 0.3")
def jaccard_sim(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of names that share enough words."""
    return similarity.close_by_words(_names(spark, d), 0.3).select("a", "b", F.round("score", 6).alias("score"))


@query()
def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Jaro-Winkler, token overlap and sound of names that begin alike; only distinct pairs of like length are compared."""
    a, b = F.col("a"), F.col("b")
    common = (F.length("a") + F.length("b") - similarity.bits_apart("a", "b")) / 2  # letters that can match at most; four are first letters
    near = _name_pairs(spark, d).where(common / F.length("a") + common / F.length("b") >= 1.5 - 1e-9)
    rows = near.select("a", "b").repartition(partitions(spark)).withColumn("jw", similarity.jaro_winkler(a, b)).where("jw >= 0.9")
    fuzzy = (similarity.levenshtein_similarity(a, b) + F.col("jw")) / 2
    sound = (similarity.sound_code(a) == similarity.sound_code(b)).cast("double")
    return rows.select(a, b, F.round("jw", 6).alias("jw"), F.round(similarity.composite(fuzzy, similarity.jaccard(a, b), sound, F.lit(0.0)), 6).alias("score"))


# -- time -----------------------------------------------------------------------------------------

_AT = "2025-06-01 00:00:00"


@query(f"select id from temporal_edges where valid_from <= timestamptz '{_AT}+00' and (valid_until is null or valid_until > timestamptz '{_AT}+00')")
def valid_at(spark: SparkSession, d: str) -> DataFrame:
    return temporal.valid_at(table(spark, d, "temporal_edges"), F.to_timestamp(F.lit(_AT))).select("id")


@query("select id from temporal_edges where valid_from <= timestamptz '2025-06-30 00:00:00+00' and coalesce(valid_until, timestamptz '2026-06-01 00:00:00+00') >= timestamptz '2025-06-01 00:00:00+00'")
def range_overlap(spark: SparkSession, d: str) -> DataFrame:
    ts = lambda s: F.to_timestamp(F.lit(s))
    return temporal.overlapping(table(spark, d, "temporal_edges"), ts(_AT), ts("2025-06-30 00:00:00"), ts("2026-06-01 00:00:00")).select("id")


@query(f"""select count(*) as total, count(*) filter (v) as valid, count(*) filter (not v) as invalid, epoch_ms(min(valid_from) filter (v)) as oldest, epoch_ms(max(valid_from) filter (v)) as newest
from (select *, coalesce(valid_from <= timestamptz '{_AT}+00' and (valid_until is null or valid_until > timestamptz '{_AT}+00'), false) v from temporal_edges)""")
def temporal_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = temporal.metrics(table(spark, d, "temporal_edges"), F.to_timestamp(F.lit(_AT)))
    return m.select("total", "valid", "invalid", F.unix_millis("oldest").alias("oldest"), F.unix_millis("newest").alias("newest"))


@query("""select distinct id, epoch_ms(least(valid_until, lead(valid_from) over (partition by source, target, type order by valid_from, id))) as until from (select distinct id, source, target, type, valid_from, valid_until from temporal_edges where valid_from is not null)""")
def supersede(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "temporal_edges").where("valid_from is not null").select("id", "source", "target", "type", "valid_from", "valid_until").distinct()
    return temporal.superseded(e, F.col("type"), [F.col("valid_from"), F.col("id")]).select("id", F.unix_millis("valid_until").alias("until"))


@query("""with s as (select user_id, event_id, ts, case when ts > lag(ts) over w + interval 30 minute or lag(ts) over w is null then 1 else 0 end f from events window w as (partition by user_id order by ts, event_id)),
g as (select *, sum(f) over (partition by user_id order by ts, event_id rows unbounded preceding) k from s) select user_id, k::bigint as session, min(ts) as begin, max(ts) as until, count(*) as n from g group by 1, 2""")
def session_sequences(spark: SparkSession, d: str) -> DataFrame:
    return temporal.sessions(table(spark, d, "events"), "user_id", "ts", "30 minutes")


@query("""with f as (select user_id, min(ts) t0 from events where event_type = 'click' group by 1),
g as (select f.user_id, t0, min(ts) t1 from f join events e on e.user_id = f.user_id and e.event_type = 'purchase' and e.ts > t0 group by 1, 2)
select user_id from g where epoch_ms(t1) - epoch_ms(t0) <= 86400000""")
def sequence_match(spark: SparkSession, d: str) -> DataFrame:
    return temporal.has_sequence(table(spark, d, "events"), "user_id", "ts", "event_type", ["click", "purchase"], 86_400_000)


@query("select time_bucket(interval 1 hour, ts) as begin, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    return streams.windowed_counts(table(spark, d, "events"), "ts", "1 hour").withColumn("total", F.round("total", 6))


# -- stored clusters ------------------------------------------------------------------------------


@query("""with m as (select c.id, unnest(members) node from memory_clusters c), n as (select distinct id node, lower(type) t from graph_nodes where type is not null),
k as (select m.id, t, count(*) n from m join n using (node) group by 1, 2) select id, t as theme, n from (select *, row_number() over (partition by id order by n desc, t) r from k) where r = 1""")
def cluster_theme(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memory_clusters").select("id", F.explode("members").alias("node"))
    n = table(spark, d, "graph_nodes").where("type is not null").select(F.col("id").alias("node"), F.lower("type").alias("theme")).distinct()
    k = m.join(n, "node").groupBy("id", "theme").agg(F.count("*").alias("n"))
    best = k.groupBy("id").agg(F.min_by(F.struct("theme", "n"), F.struct(-F.col("n"), F.col("theme"))).alias("b"))
    return best.select("id", "b.theme", "b.n")


@query("select case when n <= 1 then '1' when n <= 3 then '2-3' when n <= 7 then '4-7' else '8+' end as size, count(*) as clusters from (select len(list_distinct(members)) n from memory_clusters) group by 1")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.array_distinct("members"))
    bucket = F.when(n <= 1, "1").when(n <= 3, "2-3").when(n <= 7, "4-7").otherwise("8+")
    return table(spark, d, "memory_clusters").groupBy(bucket.alias("size")).agg(F.count("*").alias("clusters"))


def queries() -> dict[str, Query]:
    from spindrel.plans import knowledge  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
