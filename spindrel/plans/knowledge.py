"""Queries over the knowledge graph: linking, resolution, ranking, time, sequences, vectors, traversal, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.functions import providers
from spindrel.functions.runtime import cut, table
from spindrel.operators import extraction, fusion, graph, groups, hierarchy, linking, patterns, ranking, resolution, retention, sequences, similarity, temporal, texts, traversal, vectors
from spindrel.plans.catalog import _EDGES, _WANTED
from spindrel.plans.memory import answer
from spindrel.plans.registry import query
from spindrel.plans.registry import rounded as _r
from spindrel.sources import graphs
from spindrel.streaming import events as streams

_AT = "2025-06-01 00:00:00"
_T = f"timestamptz '{_AT}+00'"
_Q = "[" + ", ".join(map(str, _WANTED)) + "]::double[]"
_VALID = "(embeddings is not null and len(embeddings) = 64 and len(list_filter(embeddings, lambda x: x is null or isnan(x) or isinf(x))) = 0)"


def _at(s: str = _AT):
    return F.to_timestamp(F.lit(s))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "graph_nodes").select("id", F.lower("type").alias("type"), F.try_element_at("properties", F.lit("name")).alias("name"), "properties", F.col("embeddings").alias("embedding"))
    return n.dropDuplicates(["id"])


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "text_chunks").select("id", F.col("content").alias("text"), F.lower("chunk_type").alias("kind"), "source", "ts", "confidence", F.col("embeddings").alias("embedding"))
    return c.dropDuplicates(["id"])


def _relations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "temporal_edges").select("id", "source", "target", F.lower("type").alias("type"), "weight").dropDuplicates(["id"])


_E = "e as (select distinct on (id) id, lower(type) as type, properties['name'] as name, properties, embeddings from graph_nodes)"
_C = "c as (select distinct on (id) id, content as text, lower(chunk_type) as kind, source, ts, confidence, embeddings from text_chunks)"
_R = "rel as (select distinct on (id) id, source, target, lower(type) as type, weight from temporal_edges)"


# -- links between entities and chunks ------------------------------------------------------------


def _words_sql(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def _near_sql(w: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({w}), 1)), lambda i: {w}[i] || ' ' || {w}[i + 1]))"


_CAND = f"""{_E}, {_C}, en as (select *, {_words_sql('name')} w from e where length(trim(name)) > 0), cn as (select *, {_words_sql('text')} w from c where length(trim(text)) > 0),
ew as (select id, unnest(case when len(w) = 1 then w else {_near_sql('w')} end) word from en), cw as (select * from (select id, unnest(list_concat(list_distinct(w), {_near_sql('w')})) word from cn) where word in (select word from ew)),
df as (select word, count(*) df from cw group by 1), rare as (select id, arg_min(word, (coalesce(df, 0), word)) word from ew left join df using (word) group by 1),
cand as (select en.id eid, en.type etype, en.name, en.properties, cn.id cid, cn.text, cn.kind from rare join cw using (word) join en on en.id = rare.id join cn on cn.id = cw.id)"""


#: All pairs of a named entity and a text.
_ALL = f"{_E}, {_C}, cand as (select e.id eid, e.type etype, e.name, e.properties, c.id cid, c.text, c.kind from e, c where length(trim(name)) > 0 and length(trim(text)) > 0)"


def _holds_sql(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


def _types_sql(t: dict[str, list[str]]) -> str:
    return "coalesce(" + " or ".join(f"(etype = '{k}' and {_holds_sql(v)})" for k, v in t.items()) + ", false)"


_SPLIT = "list_filter(string_split_regex(lower({}), '\\s+'), lambda w: w <> '')"
_OVER = f"""(len(list_filter({_SPLIT.format('name')}, lambda p: len(list_filter({_SPLIT.format('text')}, lambda q: contains(p, q) or contains(q, p))) > 0))::double / greatest(len({_SPLIT.format('name')}), len({_SPLIT.format('text')})))"""


@query(f"""with {_ALL}, s as (select eid, cid, name, text, instr(lower(text), lower(name)) pl, {_OVER} o, {_types_sql(linking.TYPE_CONTEXT)} k from cand),
m as (select eid as entity, cid as chunk, case when contains(lower(text), 'the ' || lower(name)) or contains(lower(text), 'a ' || lower(name)) then 'definite_mention' when contains(lower(text), lower(name) || ' is') or contains(lower(text), lower(name) || ' was') then 'subject_mention'
  when contains(lower(text), 'of ' || lower(name)) or contains(lower(text), 'by ' || lower(name)) then 'object_mention' else 'general_mention' end as mention,
  least(1.0, case when pl > 0 then 0.8 else 0 end + case when o > 0.8 then o * 0.6 else 0 end + case when k then 0.2 else 0 end + case when pl > 0 then (1 - (pl - 1)::double / length(text)) * 0.1 else 0 end) c from s)
select entity, chunk, mention, round(c, 6) as confidence from m where c >= 0.6 qualify row_number() over (partition by entity order by round(c, 9) desc, chunk) <= 10""")
def entity_mentions_top10(spark: SparkSession, d: str) -> DataFrame:
    return linking.mentions(_entities(spark, d), _chunks(spark, d)).select("entity", "chunk", "mention", _r("confidence"))


_TERM = " or ".join(f"(type = '{t}' and {_holds_sql(w)})" for t, w in linking.RELATION_TERMS.items()) + " or (type not in (" + ", ".join(f"'{t}'" for t in linking.RELATION_TERMS) + ") and contains(lower(text), type))"


@query(f"""with {_CAND}, rel as (select 'co_' || cid as id, min(eid) as source, max(eid) as target, case when right(cid, 1) < '8' then 'works_at' else 'assigned' end as type from cand where contains(lower(text), lower(name)) group by cid having min(eid) <> max(eid)), near as (select * from cand where contains(lower(text), lower(name))),
s as (select distinct rel.id as relationship, a.cid as chunk, a.text, a.kind, rel.type from rel join near a on a.eid = rel.source join near b on b.eid = rel.target and b.cid = a.cid where rel.source <> rel.target)
select relationship, chunk, round(least(1.0, 0.5 + case when {_TERM} then 0.3 else 0 end + case when length(text) > 200 then 0.1 else 0 end + case when kind = 'sentence' then 0.1 else 0 end), 6) as confidence from s""")
def evidence_support(spark: SparkSession, d: str) -> DataFrame:
    """Relations between the first and the last entity that a chunk names, and the chunks that support them."""
    e, c = _entities(spark, d), _chunks(spark, d)
    near = linking.candidates(e, c).where(F.contains(F.lower("c.text"), F.lower("e.name"))).select(F.col("e.id").alias("entity"), F.col("c.id").alias("chunk"))
    near = cut(near, "named")
    named = near.groupBy("chunk").agg(F.min("entity").alias("source"), F.max("entity").alias("target"))
    kind = F.when(F.right("chunk", F.lit(1)) < "8", "works_at").otherwise("assigned")
    rel = named.where("source <> target").select(F.concat(F.lit("co_"), "chunk").alias("id"), "source", "target", kind.alias("type"))
    return linking.evidence(rel, e, c, near).select("relationship", "chunk", _r("confidence"))


_SPLIT0 = "list_distinct(string_split_regex(lower({}), '\\s+'))"


@query(f"""with {_ALL}, s as (select eid as entity, cid as chunk, len(list_intersect({_SPLIT0.format('name')}, {_SPLIT0.format('text')}))::double / len(list_distinct(list_concat({_SPLIT0.format('name')}, {_SPLIT0.format('text')}))) * 0.4
  + case when {_types_sql(linking.TYPE_RELEVANCE)} then 0.3 else 0 end + case when len(list_filter(map_values(properties), lambda v: contains(lower(text), lower(v)))) > 0 then 0.2 else 0 end as s from cand)
select entity, chunk, round(s, 6) as score from s where round(s, 9) >= 0.5""")
def grounding(spark: SparkSession, d: str) -> DataFrame:
    return linking.grounding(_entities(spark, d), _chunks(spark, d), 0.5).select("entity", "chunk", _r("score"))


@query(f"""with {_C}, {_E}, k as (select distinct coalesce(type, '') = 'event' as event from e where type = 'event' or map_contains(properties, 'date') or map_contains(properties, 'time')),
s as (select id as chunk, event, case when {_holds_sql(linking.TIME_TERMS)} then 0.3 else 0 end + case when regexp_matches(text, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}|\\d{{4}}-\\d{{2}}-\\d{{2}}') then 0.4 else 0 end + case when {_holds_sql(linking.EVENT_TERMS)} and event then 0.3 else 0 end as s from c, k where text is not null)
select chunk, event, round(s, 6)::double as score from s where s >= 0.3""")
def temporal_alignment(spark: SparkSession, d: str) -> DataFrame:
    return linking.alignments(_entities(spark, d), _chunks(spark, d), 0.3).select("chunk", "event", _r("score"))


@query()
def cross_links(spark: SparkSession, d: str) -> DataFrame:
    return linking.links(_entities(spark, d), _chunks(spark, d), _relations(spark, d)).select("id", "type", "source", "target", _r("confidence"))


# -- resolution -----------------------------------------------------------------------------------

_KEYS = """k as (select distinct id, lower(type) as type, 0 as r, 'name=' || nullif(trim(regexp_replace(regexp_replace(lower(name), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')), '') as key from entity_records
union select id, lower(type), 1, 'id=' || nullif(trim(regexp_replace(lower(id), '[^\\p{L}\\p{N}\\s]', '', 'g')), '') from entity_records)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_records").select("id", "type", "name", "properties", "created_at", F.lit(None).cast("array<double>").alias("embedding"))


@query(f"with {_KEYS}, p as (select a.id, b.id as other, a.r from k a join k b on a.key = b.key and a.r = b.r and a.type = b.type and a.id <> b.id) select id, arg_min(other, (r, other)) as match from p group by id")
def exact_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Entities of one type with the same normal name."""
    e = _records(spark, d)
    return resolution.exact(e, e)


@query()
def composite_resolve(spark: SparkSession, d: str) -> DataFrame:
    """The best other record of each; equal names first."""
    e = _records(spark, d).where("length(trim(name)) > 0").dropDuplicates(["id"])
    return resolution.resolve(e, e).select("id", "match", _r("score"), "how")


@query("""select lower(type) as type, lower(trim(name)) as name, arg_max(id, (created_at, id)) as id from entity_records where type is not null and length(trim(name)) > 0 group by 1, 2""")
def name_index(spark: SparkSession, d: str) -> DataFrame:
    return resolution.name_index(_records(spark, d).where("type is not null"), "created_at")


@query("""with i as (select lower(type) as type, lower(trim(name)) as name, arg_max(id, (created_at, id)) as m from entity_records where type is not null and length(trim(name)) > 0 group by 1, 2),
x as (select distinct source, target, id from temporal_edges where source is not null and target is not null), s as (select id, min(mod(ascii(right(id, 1)), 2)) as odd from graph_nodes group by 1)
select x.id, x.source || case when s.odd = 1 then '#' else '' end as source, x.target as target from x left join s on s.id = x.source where x.source || case when s.odd = 1 then '#' else '' end <> x.target""")
def rewritten_ends(spark: SparkSession, d: str) -> DataFrame:
    """Relationships after every node whose id ends in an odd character was resolved to another id, as sources."""
    odd = table(spark, d, "graph_nodes").where(F.ascii(F.right("id", F.lit(1))) % 2 == 1).select("id", F.concat("id", F.lit("#")).alias("match")).distinct()
    edges = table(spark, d, "temporal_edges").select("id", "source", F.col("target").alias("t"), F.concat(F.lit("~"), "target").alias("target")).where("source is not null and t is not null").distinct()
    return resolution.rewrite(edges, odd).select("id", "source", F.col("t").alias("target")).where("source <> target")


@query("select * from (select lower(type) as type, lower(name) as name, id, (row_number() over (partition by lower(type), lower(name) order by coalesce(try_cast(properties['mentions'] as double), 0) desc, id)) as r from (select distinct id, type, name, properties from entity_records) where name is not null) where r = 1".replace("select *", "select type, name, id"))
def distinct_entities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entity_records").select("id", "type", "name", F.coalesce(F.try_element_at("properties", F.lit("mentions")).try_cast("double"), F.lit(0.0)).alias("confidence")).distinct()
    return resolution.distinct_entities(e, "id").select(F.lower("type").alias("type"), F.lower("name").alias("name"), "id")


# -- relevance and ranking ------------------------------------------------------------------------

_REL = """least(1.0, case when lower(name) = 'protocol' then 1.0 when length(name) > 0 and (contains(lower(name), 'protocol') or contains('protocol', lower(name))) then 0.7 else 0 end + 0.2 * coalesce(len(list_filter(map_values(properties), lambda v: contains(lower(v), 'protocol'))), 0))"""


@query(f"with {_E}, s as (select id, {_REL}::double as s from e) select id, round(s, 6) as score from s where s > 0.05")
def relevance_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranking.relevant_nodes(_entities(spark, d), "protocol").select("id", _r("score"))


_COS = f"list_cosine_similarity(embeddings::double[], {_Q})"


@query(f"with {_E}, s as (select id, {_COS} as s from e where {_VALID} and list_sum(list_transform(embeddings, lambda x: x::double * x::double)) > 0) select id, round(s, 6) as score from s where s > 0.1 order by s desc, id limit 15")
def similar_nodes(spark: SparkSession, d: str) -> DataFrame:
    return ranking.similar_nodes(_entities(spark, d), "embedding", _WANTED, 15).select("id", _r("score"))


@query(f"with {_E} select id from e where type = 'concept' and contains(lower(name), 'protocol')")
def multi_index_and(spark: SparkSession, d: str) -> DataFrame:
    return ranking.multi_index(_entities(spark, d), [F.col("type") == "concept", F.contains(F.lower("name"), F.lit("protocol"))]).select("id")


@query(f"with {_E} select id from e where type = 'skill' or contains(lower(name), 'protocol') or map_contains(properties, 'status')")
def multi_index_or(spark: SparkSession, d: str) -> DataFrame:
    return ranking.multi_index(_entities(spark, d), [F.col("type") == "skill", F.contains(F.lower("name"), F.lit("protocol")), F.map_contains_key("properties", F.lit("status"))], "any").select("id")


@query(f"with {_C} select id from c where (contains(lower(text), 'roadmap') or contains(lower(text), 'checklist')) and kind = 'sentence' and source is not null")
def lexical_filter(spark: SparkSession, d: str) -> DataFrame:
    return ranking.filter_chunks(_chunks(spark, d), query="Roadmap checklist", kind="sentence").where("source is not null").select("id")


@query(f"with {_E}, {_R} select 'entity' as kind, id from e where type in ('person', 'skill') and length(name) > 0 and contains(lower(name), 'an') union all select 'relationship', id from rel where type in ('knows') and coalesce(weight, 1) >= 0.5")
def domain_filter(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d).withColumn("confidence", F.lit(1.0))
    r = _relations(spark, d).withColumn("confidence", F.col("weight"))
    a, b = ranking.filter_domain(e, r, types=["person", "skill"], relations=["knows"], name="an", least=0.5)
    return a.select(F.lit("entity").alias("kind"), "id").unionByName(b.select(F.lit("relationship").alias("kind"), "id"))


@query(f"with {_R} select id, round(weight, 6) as score from rel where type in ('knows', 'leads')")
def link_filter(spark: SparkSession, d: str) -> DataFrame:
    links = _relations(spark, d).withColumn("confidence", F.col("weight")).withColumn("source_graph", F.lit("domain")).withColumn("target_graph", F.lit("domain"))
    return ranking.filter_links(links, types=["knows", "leads"], source_graph="domain", target_graph="domain").select("id", _r("score"))


_TOPC = f"(select id, {_COS} as s from {{}} where {_VALID} order by case when list_sum(list_transform(embeddings, lambda x: x::double * x::double)) = 0 then 0 else {_COS} end desc, id limit 20)"
_UNIFIED = f"""{_E}, {_C}, {_R},
lb as (select id, 0.8::double as s, 0 b from c where contains(lower(text), 'roadmap') union all select id, s, 1 from {_TOPC.format('c')} union all select id, 0.9, 2 from c where kind = 'section'),
lex as (select id, arg_min(s, b) as s from lb group by 1),
db as (select id, 0.9::double as s, 0 b from e where type in ('location') union all select id, 0.8, 1 from e where length(name) > 0 and (contains(lower(name), 'roadmap') or contains('roadmap', lower(name))) union all select id, s, 2 from {_TOPC.format('e')}),
dom as (select id, arg_min(s, b) as s from db group by 1),
u as (select 'chunk' as kind, id, coalesce(nullif(s, 0), 0.5) as s from lex union all select 'entity', id, coalesce(nullif(s, 0), 0.6) from dom union all select 'relationship', id, 0.7 from rel where type in ('leads'))"""


@query(f"with {_UNIFIED} select kind, id, round(s, 6) as score from u order by s desc, kind, id limit 200")
def unified_query(spark: SparkSession, d: str) -> DataFrame:
    q = ranking.Query(text="roadmap", vector=_WANTED, chunk_kind="section", entity_types=["location"], relation_types=["leads"], limit=200)
    links = _relations(spark, d).withColumn("confidence", F.col("weight"))
    return answer(_chunks(spark, d), _entities(spark, d), _relations(spark, d), links, q).select("kind", "id", _r("score"))


@query("""with acc as (select session_id as id, ts as tm from memories where session_id is not null and ts is not null), uses as (select id, count(*) uses, max(tm) last from acc group by 1),
recent as (select id from uses order by last desc, id limit 10), res as (select distinct session_id as id, 0.5::double as s from memories where session_id is not null),
k as (select res.id, s, coalesce(uses, 0) u, case when res.id in (select id from recent) then 1 else 0 end r from res left join uses using (id)),
top as (select id, row_number() over (order by 0.6 * r + 0.4 * u desc, id) p from k)
select k.id, round(least(1.0, case when p <= 10 then s * (1 + 0.3 * r + case when u > 3 then least(0.25, u / 40) else 0 end) else s end), 6) as score, case when p <= 10 then p::int end as place from k join top using (id)""")
def recency_boost(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories").where("session_id is not null")
    acc = m.where("ts is not null").select(F.col("session_id").alias("id"), F.col("ts").alias("at"))
    res = m.select(F.col("session_id").alias("id"), F.lit(0.5).alias("score")).distinct()
    return ranking.recent_first(res, acc, kind="entity").select("id", _r("score"), "place")


_MEM = "m as (select distinct c.id as cluster, unnest(members) as id from memory_clusters c)"


@query(f"""with {_MEM}, sz as (select cluster, count(*)::int n from m where id is not null group by 1), {_E}, j as (select m.id, m.cluster, c.theme, n, c.confidence cc, c.last_updated lu from m join memory_clusters c on c.id = m.cluster join sz using (cluster)),
b as (select * from j qualify row_number() over (partition by id order by coalesce(cc, 0) desc, cluster) = 1),
x as (select e.id, coalesce(cluster, 'isolated') as cluster, coalesce(n, 1) as size, case when n is null or n <= 1 then 1.0 else least(1.0, 2.0 / n) end as centrality,
  least(1.0, 0.5 * case when n is null then 1 else 1 + case when cc > 0.8 then 0.2 when cc > 0.6 then 0.1 else 0 end + case when n between 3 and 10 then 0.1 else 0 end + case when lu > {_T} - interval 24 hours then 0.05 else 0 end end) as s, coalesce(cc, 0) cc, coalesce(theme = e.type, false) t from e left join b on b.id = e.id)
select id, cluster, size, round(centrality, 6)::double as centrality, t or centrality > 0.7 as representative, round(s, 6)::double as score, round(s + 0.1 * cc, 6)::double as order_key from x""")
def cluster_enrichment(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "memory_clusters")
    members = c.select(F.col("id").alias("cluster"), F.explode("members").alias("id"))
    res = _entities(spark, d).select("id", "type", F.lit(0.5).alias("score"))
    out = ranking.with_clusters(res, members, c, _at())
    return out.select("id", "cluster", "size", _r("centrality"), "representative", _r("score"), _r("order_key"))


@query(f"""with msg as (select session_id as conv, content as text, row_number() over (partition by session_id order by ts desc nulls last, memory_id) r from (select distinct session_id, content, ts, memory_id from memories) where session_id is not null and content is not null),
w as (select distinct conv, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: length(w) > 6)) as word from msg where r <= 3),
p as (select distinct id, unnest(string_split_regex(lower(properties['name']), '\\s+')) as word from graph_nodes where properties['name'] is not null),
h as (select distinct conv, id from w join p using (word)) select conv, id from h qualify row_number() over (partition by conv order by id) <= 5""")
def contextual_memories(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories").where("session_id is not null and content is not null").select("session_id", "content", "ts", "memory_id").distinct()
    from pyspark.sql import Window

    rank = -F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc_nulls_last("ts"), "memory_id"))
    msg = m.select(F.col("session_id").alias("conv"), rank.alias("turn"), F.col("content").alias("text"))
    nodes = table(spark, d, "graph_nodes").select("id", F.try_element_at("properties", F.lit("name")).alias("text")).distinct()
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 6)
    return ranking.contextual(msg, nodes, words, 5)


# -- time -----------------------------------------------------------------------------------------

_EDGE = "t as (select distinct on (id) id, source, target, type, valid_from, valid_until, temporal_type from temporal_edges)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "temporal_edges").select("id", "source", "target", "type", "valid_from", "valid_until", "temporal_type").dropDuplicates(["id"])


@query(f"""with {_EDGE}, v as (select * from t where valid_from <= {_T} and (valid_until is null or valid_until > {_T})), n as (select distinct id from graph_nodes where id in (select source from v union select target from v))
select 'edge' as kind, id from v union all select 'node', id from n""")
def graph_state_at(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = temporal.graph_state(_edges(spark, d), table(spark, d, "graph_nodes").select("id").distinct(), _at())
    return edges.select(F.lit("edge").alias("kind"), "id").unionByName(nodes.select(F.lit("node").alias("kind"), "id"))


@query(f"with {_EDGE} select id from t where (source = 'node_system' or target = 'node_system') and valid_until <= {_T}")
def node_invalidated_at(spark: SparkSession, d: str) -> DataFrame:
    return temporal.at_node(_edges(spark, d), "node_system", _at(), "invalidated").select("id")


_KIND = f"case when regexp_matches(replace(lower(type), '_', ' '), '\\b({temporal.EVENT_WORDS})\\b') then 'event' when regexp_matches(replace(lower(type), '_', ' '), '\\b({temporal.STATE_WORDS})\\b') then 'state' else 'fact' end"


@query(f"with {_EDGE} select id, {_KIND} as kind, epoch_ms(coalesce(valid_until, valid_from + case {_KIND} when 'event' then interval 30 day when 'state' then interval 90 day else interval 365 day end)) as until from t")
def infer_temporal_type(spark: SparkSession, d: str) -> DataFrame:
    rows = temporal.track(_edges(spark, d).drop("temporal_type"), "domain")
    return rows.select("id", F.col("temporal_type").alias("kind"), F.unix_millis("valid_until").alias("until"))


@query(f"with {_EDGE} select id, epoch_ms(case when lower(type) = 'knows' and (valid_until is null or {_T} < valid_until) then {_T} else valid_until end) as until, case when lower(type) = 'knows' and (valid_until is null or {_T} < valid_until) then 'closed' end as reason from t")
def invalidate_edges(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    changes = e.where("lower(type) = 'knows'").select("id", _at().alias("at"), F.lit("closed").alias("reason"))
    return temporal.invalidate(e, changes).select("id", F.unix_millis("valid_until").alias("until"), "reason")


@query(f"with {_EDGE} select id, epoch_ms(valid_from) as since, epoch_ms(case when lower(type) = 'leads' then {_T} else valid_until end) as until from t")
def update_period(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    changes = e.where("lower(type) = 'leads'").select("id", F.lit(None).cast("timestamp").alias("valid_from"), _at().alias("valid_until"), F.lit("known end").alias("reason"))
    return temporal.update_period(e, changes).select("id", F.unix_millis("valid_from").alias("since"), F.unix_millis("valid_until").alias("until"))


@query(f"with {_EDGE} select id from t where not coalesce(valid_until < {_T} - interval 30 day, false)")
def cleanup_edges(spark: SparkSession, d: str) -> DataFrame:
    return temporal.cleanup(_edges(spark, d), _at() - F.expr("interval 30 days")).select("id")


@query(f"with {_EDGE} select id from t where temporal_type in ('event', 'state') and valid_from < timestamptz '2025-07-01 00:00:00+00' and coalesce(valid_until, timestamptz '2025-08-01 00:00:00+00') > {_T}")
def tracked_relationships(spark: SparkSession, d: str) -> DataFrame:
    rows = _edges(spark, d).withColumn("graph", F.lit("domain"))
    return temporal.tracked(rows, kinds=["event", "state"], graphs=["domain"], between=(_at(), _at("2025-07-01 00:00:00")), now=_at("2025-08-01 00:00:00")).select("id")


@query(f"""with {_EDGE} select temporal_type as kind, count(*) filter (not coalesce(valid_until <= {_T}, false)) as active, count(*) filter (coalesce(valid_until <= {_T}, false)) as invalidated,
round(avg(epoch_ms({_T}) / 1000.0 - epoch_us(valid_from) / 1e6), 3) as mean_age_s, count(*) filter (coalesce(valid_until <= {_T}, false) and valid_until > {_T} - interval 24 hour) as ended_last_day from t group by 1""")
def temporal_stats(spark: SparkSession, d: str) -> DataFrame:
    return temporal.stats(_edges(spark, d), _at(), F.col("temporal_type")).withColumn("mean_age_s", F.round("mean_age_s", 3))


@query(f"with {_EDGE} select strftime(valid_from, '%Y-%m-%d') as day, type, count(*) as n from t where valid_from is not null group by 1, 2")
def edges_by_day(spark: SparkSession, d: str) -> DataFrame:
    return temporal.by_day(_edges(spark, d))


@query(f"""with {_EDGE}, k as (select *, case lower(type) when 'divorced_from' then 'married_to' when 'unemployed' then 'works_at' when 'moved_from' then 'lives_at' when 'sold' then 'owns' when 'left_position' then 'leads' else lower(type) end g from t where valid_from is not null)
select id, epoch_ms(least(valid_until, lead(valid_from) over (partition by source, target, g order by valid_from, id))) as until from k""")
def supersede_exclusive(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).where("valid_from is not null")
    return temporal.superseded(e, temporal.conflict_class(F.col("type")), [F.col("valid_from"), F.col("id")]).select("id", F.unix_millis("valid_until").alias("until"))


@query(f"""with {_EDGE}, a as (select *, case when type is not distinct from lag(type) over w and row_number() over w > 1 then 0 else 1 end f from t where valid_from is not null window w as (partition by source, target order by valid_from, id)),
b as (select *, sum(f) over (partition by source, target order by valid_from, id rows unbounded preceding) g from a), s as (select source, target, g, min(valid_from) m from b group by 1, 2, 3), n as (select source, target, g, lead(m) over (partition by source, target order by g) nx from s)
select b.id, epoch_ms(least(b.valid_until, nx)) as until from b join n on n.source = b.source and n.target = b.target and n.g = b.g""")
def supersede_by_change(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).where("valid_from is not null")
    return temporal.superseded_by_change(e, [F.col("valid_from"), F.col("id")]).select("id", F.unix_millis("valid_until").alias("until"))


@query(f"with {_EDGE} select id, concat_ws('_', 'temp', source, type, target, strftime(valid_from, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_ms(valid_from) % 1000)::varchar, 3, '0') || 'Z') as key from t")
def edge_keys(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("id", temporal.edge_key(F.col("source"), F.col("type"), F.col("target"), F.col("valid_from")).alias("key"))


# -- sequences and windows ------------------------------------------------------------------------

_LOG = "log as (select user_id as seq, ts as tm, case event_type when 'signup' then 'start' when 'purchase' then 'complete' else 'add' end as what, event_type as type from events)"
_SEQ = f"""{_LOG}, s as (select seq, min(tm) b, arg_min(type, tm) as name from log where what = 'start' group by 1), f as (select log.seq, min(tm) u from log join s using (seq) where what = 'complete' and tm >= b group by 1),
g as (select log.seq, count(*) n from log join s using (seq) left join f using (seq) where what = 'add' and tm >= b and (u is null or tm <= u) group by 1),
q as (select s.seq, name, case when u is null then 'active' else 'completed' end as status, coalesce(n, 0) as events, b, u from s left join f using (seq) left join g using (seq))"""


def _seqs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    what = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "complete").otherwise("add")
    return sequences.replay(table(spark, d, "events").select(F.col("user_id").alias("seq"), F.col("ts").alias("at"), what.alias("what"), F.col("event_type").alias("type")))


@query(f"with {_SEQ} select seq, status, events from q")
def sequence_states(spark: SparkSession, d: str) -> DataFrame:
    return _seqs(spark, d)[0].select("seq", "status", "events")


@query(f"with {_SEQ} select log.seq, what, count(*) as n from log left join s using (seq) left join f using (seq) where what <> 'start' and (b is null or tm < b or coalesce(tm > u, false)) group by 1, 2")
def sequence_refused(spark: SparkSession, d: str) -> DataFrame:
    return _seqs(spark, d)[1].groupBy("seq", "what").agg(F.count("*").alias("n"))


@query(f"with {_SEQ} select status, count(*) as sequences, sum(events)::bigint as events, round(avg(events), 2) as mean_length, round(avg(epoch_us(u) - epoch_us(b)) / 1000) as mean_ms from q group by 1")
def sequence_stats(spark: SparkSession, d: str) -> DataFrame:
    return sequences.statistics(_seqs(spark, d)[0])


@query(f"with {_SEQ} select name, events, count(*) as n, round(avg(epoch_us(u) - epoch_us(b)) / 1000, 3) as mean_ms from q where status = 'completed' group by 1, 2")
def sequence_durations(spark: SparkSession, d: str) -> DataFrame:
    return sequences.durations(_seqs(spark, d)[0]).withColumn("mean_ms", F.round("mean_ms", 3))


@query("select event_type as type, count(*) as n from events group by 1 order by n desc, type limit 10")
def top_event_types(spark: SparkSession, d: str) -> DataFrame:
    return sequences.top_types(table(spark, d, "events"), "event_type")


@query("with e as (select event_id, lag(event_id) over (partition by user_id order by ts, event_id) p from events) select p as cause, event_id as effect from e where p is not null")
def event_causes(spark: SparkSession, d: str) -> DataFrame:
    """Each event names the user's event before it, and one that doesn't exist."""
    from pyspark.sql import Window

    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return sequences.causes(table(spark, d, "events").select(F.col("event_id").alias("id"), F.array_compact(F.array(before, F.lit(-1).cast("long"))).alias("caused_by")))


@query("""with w as (select time_bucket(interval 15 minute, ts) - to_minutes(15 * k) as begin, event_type, value from events, range(0, 4) t(k))
select begin, event_type, count(*) as n, round(sum(value), 6) as total from w group by 1, 2""")
def sliding_window(spark: SparkSession, d: str) -> DataFrame:
    return streams.windowed_counts(table(spark, d, "events"), "ts", "1 hour", "15 minutes").withColumn("total", F.round("total", 6))


@query("""with s as (select user_id, ts, case when ts >= lag(ts) over w + interval 30 minute or lag(ts) over w is null then 1 else 0 end f from events window w as (partition by user_id order by ts)),
g as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) k from s) select user_id, min(ts) as begin, count(*) as n from g group by user_id, k""")
def session_window(spark: SparkSession, d: str) -> DataFrame:
    return streams.session_counts(table(spark, d, "events"), "ts", "30 minutes", "user_id")


# -- vectors and groups ---------------------------------------------------------------------------


@query("select count(*) as n, max(len(embedding))::int as dimension, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))), 6) as mean_norm from embeddings where len(embedding) > 0")
def vector_stats(spark: SparkSession, d: str) -> DataFrame:
    return vectors.vector_stats(table(spark, d, "embeddings"), "embedding").withColumn("mean_norm", F.round("mean_norm", 6))


@query("""select case when embeddings is null then 'missing' when len(embeddings) = 0 then 'empty' when len(list_filter(embeddings, lambda x: x is null or isnan(x) or isinf(x))) > 0 then 'not finite' when len(embeddings) <> 64 then 'other length'
when list_sum(list_transform(embeddings, lambda x: x::double * x::double)) = 0 then 'zero' else 'good' end as issue, count(*) as n from graph_nodes group by 1""")
def embedding_quality(spark: SparkSession, d: str) -> DataFrame:
    return vectors.quality(table(spark, d, "graph_nodes"), "embeddings")


@query(f"select vec_id as id, round(list_sum(list_transform(list_zip(embedding::double[], {_Q}), lambda p: abs(p[1] - p[2]))), 6) as distance from embeddings order by list_sum(list_transform(list_zip(embedding::double[], {_Q}), lambda p: abs(p[1] - p[2]))), vec_id limit 10")
def manhattan_nearest(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(x) for x in _WANTED])
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vectors.manhattan(F.col("embedding"), q).alias("d")).orderBy("d", "id").limit(10).select("id", _r("d", "distance"))


@query("""select a.vec_id as a, b.vec_id as b, round(case when a.vec_id = b.vec_id then 1 else list_cosine_similarity(a.embedding::double[], b.embedding::double[]) end, 6)::double as cosine from embeddings a, embeddings b where a.vec_id in (0, 7, 100)""")
def pairwise_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Some vectors against all."""
    e = table(spark, d, "embeddings")
    return vectors.pairwise(e.where(F.col("vec_id").isin(0, 7, 100)), e, "vec_id", "embedding").select("a", "b", _r("cosine"))


@query("""with m as (select list(x order by p) as mean from (select p, avg(embedding[p]::double) x from embeddings, range(1, 65) t(p) group by p)) select vec_id as id, (p - 1)::int as pos, round(embedding[p]::double - mean[p], 6) as value from embeddings, m, range(1, 5) t(p)""")
def leading_dimensions(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors.leading(table(spark, d, "embeddings"), "vec_id", "embedding", 4)
    return rows.select("id", F.posexplode("vector").alias("pos", "value")).select("id", "pos", _r("value"))


@query("""with s as (select label as g, p, sum(embedding[p]::double * (vec_id + 1)) / sum(vec_id + 1) as x from embeddings, range(1, 65) t(p) group by 1, 2), n as (select g, sqrt(sum(x * x)) l from s group by 1)
select s.g as "group", (p - 1)::int as pos, round(x / l, 6) as value from s join n using (g)""")
def weighted_centroids(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors.weighted_centroids(table(spark, d, "embeddings").withColumn("w", F.col("vec_id") + 1), "label", "embedding", "w")
    return rows.select("group", F.posexplode("vector").alias("pos", "value")).select("group", "pos", _r("value"))


_ECOS = f"list_cosine_similarity(embedding::double[], {_Q})"


@query(f"select row_number() over (order by {_ECOS} desc, vec_id)::int as rank, vec_id as id, round({_ECOS}, 6) as score from embeddings where label = 3 and {_ECOS} >= 0.02 order by {_ECOS} desc, vec_id limit 10")
def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    return vectors.search(table(spark, d, "embeddings"), "vec_id", "embedding", _WANTED, where=F.col("label") == 3, threshold=0.02).select("rank", "id", _r("score"))


_TWO = [[((i * 37) % 11 - 5) / 10 for i in range(64)], [((i * 29) % 13 - 6) / 10 for i in range(64)]]
_MAXQ = "[" + ", ".join(str(x) for x in vectors.combine(_TWO, "max")) + "]::double[]"


@query(f"select vec_id as id, round(list_cosine_similarity(embedding::double[], {_MAXQ}), 6) as score from embeddings where list_cosine_similarity(embedding::double[], {_MAXQ}) >= 0 order by list_cosine_similarity(embedding::double[], {_MAXQ}) desc, vec_id limit 10")
def multi_query_search(spark: SparkSession, d: str) -> DataFrame:
    return vectors.search(table(spark, d, "embeddings"), "vec_id", "embedding", vectors.combine(_TWO, "max"), threshold=0.0).select("id", _r("score"))


@query("select vec_id as id, round(list_cosine_similarity(embedding[1:32]::double[], [1.0 for x in range(32)]), 6) as score from embeddings")
def prefix_cosine(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), _r(vectors.cosine_prefix(F.col("embedding"), F.array_repeat(F.lit(1.0), F.lit(32))), "score"))


@query()
def ann_lsh_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.approximate(table(spark, d, "embeddings"), "vec_id", "embedding", _WANTED, 10).select("id", _r("score"))


@query()
def principal_components(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors.principal(table(spark, d, "embeddings"), "vec_id", "embedding", 3)
    return rows.select("id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query()
def kmeans_cosine(spark: SparkSession, d: str) -> DataFrame:
    return groups.kmeans(table(spark, d, "embeddings").withColumnRenamed("vec_id", "id"), 10, threshold=0.3).select("cluster", "id", _r("similarity"))


@query()
def agglomerative(spark: SparkSession, d: str) -> DataFrame:
    return groups.agglomerate(table(spark, d, "embeddings").withColumnRenamed("vec_id", "id"), 10)


@query("""with s as (select label, p, avg(embedding[p]::double) x from embeddings, range(1, 65) t(p) group by 1, 2), c as (select label, list(x order by p) v from s group by 1) select e.label as cluster, round(avg(list_cosine_similarity(e.embedding::double[], c.v)), 6) as confidence from embeddings e join c on c.label = e.label group by 1""")
def cluster_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    c = vectors.centroids(e, "label", "embedding").groupBy(F.col("group").alias("cluster")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("c"))  # 64 places
    return groups.confidence(e.select(F.col("label").alias("cluster"), F.col("embedding").alias("v")), c).select("cluster", _r("confidence"))


@query("with m as (select distinct id, unnest(members) m from memory_clusters), k as (select id, count(*) n from m where m is not null group by 1) select count(*) as clusters, round(avg(n), 6) as mean_size, max(n) as max_size from k")
def clustering_summary(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memory_clusters").select(F.col("id").alias("cluster"), F.explode("members").alias("id")).where("id is not null")
    return groups.summary(m).withColumn("mean_size", F.round("mean_size", 6))


@query(f"with s as (select id, case when list_sum(list_transform(centroid, lambda x: x::double * x::double)) = 0 then 0 else list_cosine_similarity(centroid::double[], {_Q}) end as s from memory_clusters where len(centroid) = 64) select id, round(s, 6) as score from s where s > 0.05 order by s desc, id limit 5")
def related_clusters(spark: SparkSession, d: str) -> DataFrame:
    return groups.related(table(spark, d, "memory_clusters"), _WANTED, threshold=0.05).select("id", _r("score"))


@query(f"""with {_MEM}, {_E}, x as (select m.cluster, e.type, e.name from m join e on e.id = m.id), k as (select cluster, type, count(*) n from x where type is not null group by 1, 2), b as (select cluster, arg_min(type, (-n, type)) as type from k group by 1),
nm as (select cluster, name, row_number() over (partition by cluster order by name) r from (select distinct cluster, name from x where name is not null)), j as (select cluster, string_agg(name, ', ' order by r) s from nm where r <= 2 group by 1)
select b.cluster, concat_ws(': ', b.type, j.s) as theme from b left join j on j.cluster = b.cluster""")
def cluster_themes(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memory_clusters").select(F.col("id").alias("cluster"), F.explode(F.array_distinct("members")).alias("id"))
    return groups.themes(m.join(_entities(spark, d), "id").select("cluster", "type", "name"))


@query("""with x as (select vec_id, embedding::double[] a, list_concat(embedding[33:64]::double[], embedding[1:32]::double[]) b from embeddings),
s as (select *, list_dot_product(a, a) / 8 aa, list_dot_product(a, b) / 8 ab, list_dot_product(b, b) / 8 bb from x), w as (select *, exp(aa - greatest(aa, ab)) p, exp(ab - greatest(aa, ab)) q, exp(ab - greatest(ab, bb)) r, exp(bb - greatest(ab, bb)) t from s),
f as (select vec_id, list_transform(list_zip(a, b), lambda z: ((p * z[1] + q * z[2]) / (p + q) + (r * z[1] + t * z[2]) / (r + t)) / 2) v from w)
select vec_id as id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as norm, round(v[1], 6) as first from f""")
def fused_attention(spark: SparkSession, d: str) -> DataFrame:
    """Attention over each vector and its halves swapped."""
    v = F.col("embedding").cast("array<double>")
    swapped = F.concat(F.slice(v, 33, 32), F.slice(v, 1, 32))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), fusion.attention(F.array(v, swapped), 64).alias("f"))
    return rows.select("id", F.round(vectors.norm(F.col("f")), 6).alias("norm"), F.round(F.get("f", F.lit(0)), 6).alias("first"))


@query("""with x as (select vec_id, embedding::double[] a, list_concat(embedding[33:64]::double[], embedding[1:32]::double[]) b from embeddings), f as (select vec_id, list_transform(list_zip(a, b), lambda p: p[1] * 0.7 + p[2] * 0.3) v from x)
select vec_id as id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as first from f""")
def fused_weighted(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    swapped = F.concat(F.slice(v, 33, 32), F.slice(v, 1, 32))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(F.get(fusion.weighted(v, swapped), F.lit(0)), 6).alias("first"))


# -- traversal and patterns -----------------------------------------------------------------------


@query(f"""with recursive {_EDGES}, steps as (select source u, target v from edges where type in ('part_of', 'located_in') union select target, source from edges where type in ('part_of', 'located_in')),
r(id, depth) as (select 'nation:3', 0 union select v, depth + 1 from r join steps on id = u where depth < 3), k as (select id, min(depth)::int as depth from r group by 1) select id, depth from k order by depth, id limit 100""")
def ego_traverse(spark: SparkSession, d: str) -> DataFrame:
    return traversal.ego(graphs.star_nodes(spark, d), graphs.star_edges(spark, d, ("part_of", "located_in")), "nation:3", 3, 100).select("id", "depth")


_PLACES_IN = f"""{_EDGES}, ed as (select source, target, lpad(length(source)::varchar, 4, '0') || source as o from edges where type in ('part_of', 'located_in')),
n as (select source as id, row_number() over (order by o) p from ed where target = 'region:1'), l as (select ed.source as id, n.id as parent, p, o from ed join n on ed.target = n.id),
k as (select (select count(*) from n) c, (select count(*) from l) m)"""


def _ordered_sql(nations: str, leaves: str) -> str:
    return f"""with {_PLACES_IN}, r as (select 0 as pos, 'region:1' as id, 'region:1' as path union all select (row_number() over (order by {nations}))::int, id, 'region:1>' || id from n
union all select ((select c from k) + row_number() over (order by {leaves}))::int, id, 'region:1>' || parent || '>' || id from l) select pos, id, path, (1 + c)::int as visited, (c + m)::int as edges, 1::int as depth from r, k"""


def _ordered(spark: SparkSession, d: str, way: str) -> DataFrame:
    edges = graphs.star_edges(spark, d, ("part_of", "located_in"))
    edges = edges.withColumn("ord", F.concat(F.lpad(F.length("source").cast("string"), 4, "0"), "source"))
    return traversal.ordered(graphs.star_nodes(spark, d), edges, "region:1", 1, 1_000_000, way=way, direction="in")


@query(_ordered_sql("p", "p, o"))
def bfs_ordered(spark: SparkSession, d: str) -> DataFrame:
    return _ordered(spark, d, "breadth")


@query(_ordered_sql("p desc", "p, o desc"))
def dfs_ordered(spark: SparkSession, d: str) -> DataFrame:
    return _ordered(spark, d, "depth")


@query("select distinct 'customer:' || o_custkey as a, 'orders:' || o_orderkey as b, 'part:' || l_partkey as c from orders join lineitem on o_orderkey = l_orderkey")
def motif_triangle_typed(spark: SparkSession, d: str) -> DataFrame:
    """a placed b, b contains c, a bought c."""
    edges = graphs.star_edges(spark, d, ("placed", "contains")).select("source", "target", "type")
    bought = graph.two_hop(edges, "placed", "contains").select(F.col("a").alias("source"), F.col("c").alias("target"), F.lit("bought").alias("type")).distinct()
    kinds = {v: F.col("type") == t for v, t in (("a", "customer"), ("b", "orders"), ("c", "part"))}
    links = [("a", "b", "placed", "out"), ("b", "c", "contains", "out"), ("a", "c", "bought", "out")]
    return graph.match_motif(graphs.star_nodes(spark, d), edges.unionByName(bought), kinds, links)


@query("select * from (values ('employment'), ('team')) t(pattern)")
def pattern_candidates(spark: SparkSession, d: str) -> DataFrame:
    known = patterns.keys(spark, [patterns.Pattern("employment", {"a": "person", "b": "organization"}, [("a", "b", "works_at", "out")]), patterns.Pattern("team", {"x": "person", "y": "organization", "z": "person"}, [("x", "y", "works_at", "out"), ("x", "z", "knows", "any")]), patterns.Pattern("place", {"p": "location"}, [])])
    return patterns.candidates(known, ["person", "location"], ["works_at"])


# -- hierarchies, indexes, totals -----------------------------------------------------------------

_GRP = "g as (select distinct lower(type) as g, id from graph_nodes where type is not null and id is not null)"


@query(f"""with {_GRP}, ch as (select distinct source p, target c from temporal_edges where (contains(lower(type), 'contains') or contains(lower(type), 'manages') or contains(lower(type), 'leads')) and source <> target),
i as (select a.g, p, count(*) k from ch join g a on a.id = p join g b on b.id = c and b.g = a.g group by 1, 2), t as (select g, sum(k) pairs, count(*) parents, sum(k * (k - 1) // 2) sib from i group by 1),
n as (select target id, count(*) n from temporal_edges where source <> target group by 1), r as (select g, count(*) members, arg_min(g.id, (-coalesce(n, 0), g.id)) as root from g left join n on n.id = g.id group by 1)
select r.g as "group", root, members, coalesce(pairs, 0)::bigint as pairs, round(greatest(0, least(1, case when members > 20 then 0.8 else 1 end * case when pairs > 0 then 1.2 else 1 end * case when sib > 0 then 1.1 else 1 end * case when parents > 0 and pairs / greatest(parents, 1) < 1.5 then 0.9 else 1 end)), 6)::double as confidence from r left join t on t.g = r.g""")
def hierarchy_confidence(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "graph_nodes").where("type is not null and id is not null").select(F.lower("type").alias("group"), "id").distinct()
    rel = table(spark, d, "temporal_edges").select("source", "target", F.when(F.contains(F.lower("type"), F.lit("leads")), F.lit("manages")).otherwise(F.col("type")).alias("type"))
    return hierarchy.hierarchies(members, rel, 0.0).select("group", "root", "members", "pairs", _r("confidence"))


@query("""with g as (select distinct coalesce(properties['organization'], 'unknown') as "group", id from graph_nodes where id is not null) select "group", id from g qualify count(*) over (partition by "group") > 1""")
def grouped_members(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.grouped(table(spark, d, "graph_nodes"), "organization")


@query("select distinct lower(chunk_type) as key, id from text_chunks where chunk_type is not null")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.inverted(table(spark, d, "text_chunks"), F.lower("chunk_type"))


@query("select distinct id, k as key, properties[k] as value from (select id, properties, unnest(map_keys(properties)) k from graph_nodes)")
def property_entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_nodes").select("id", F.explode("properties").alias("key", "value")).distinct()


@query("""select 'memories' as name, count(*) as n, count(distinct memory_id) as ids from memories union all select 'text_chunks', count(*), count(distinct id) from text_chunks union all select 'graph_nodes', count(*), count(distinct id) from graph_nodes
union all select 'temporal_edges', count(*), count(distinct id) from temporal_edges union all select 'memory_clusters', count(*), count(distinct id) from memory_clusters""")
def table_totals(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, key in (("memories", "memory_id"), ("text_chunks", "id"), ("graph_nodes", "id"), ("temporal_edges", "id"), ("memory_clusters", "id")):
        one = table(spark, d, name).agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids")).select(F.lit(name).alias("name"), "n", "ids")
        out = one if out is None else out.unionByName(one)
    return out


@query("""with t as (select doc_id as id, unnest(list_distinct(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '[^a-zA-Z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: length(x) between 2 and 50))) as token from documents)
select 'token' as index, count(distinct token) as entries, count(*) as items, round(count(*)::double / count(distinct token), 6) as mean_items, sum(length(token))::bigint as characters from t
union all select 'label', count(distinct type), count(*), round(count(*)::double / count(distinct type), 6), sum(length(type))::bigint from graph_nodes where type is not null""")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    """Entries, items, items an entry and characters of the token and the label index."""
    posts = texts.postings(table(spark, d, "documents"), "doc_id", "text").select(F.lit("token").alias("index"), F.col("token").alias("k"))
    labels = table(spark, d, "graph_nodes").where("type is not null").select(F.lit("label").alias("index"), F.col("type").alias("k"))
    out = posts.unionByName(labels).groupBy("index").agg(F.count_distinct("k").alias("entries"), F.count("*").alias("items"), F.sum(F.length("k")).alias("characters"))
    return out.select("index", "entries", "items", F.round(F.col("items") / F.col("entries"), 6).alias("mean_items"), "characters")


@query("""select distinct id, type, coalesce(properties['name'], id) as name, substr(coalesce(properties['name'], id), 1, 10) || '...' as preview from graph_nodes""")
def entity_projection(spark: SparkSession, d: str) -> DataFrame:
    e = graphs.entity_of(table(spark, d, "graph_nodes"))
    return e.select("id", "type", "name", ranking.preview(F.col("name"), 10).alias("preview")).distinct()


@query("select sha256(content) as digest, min(memory_id) as first, count(distinct memory_id) as copies from memories where content is not null group by 1")
def same_content(spark: SparkSession, d: str) -> DataFrame:
    return vectors.same_content(table(spark, d, "memories"), "memory_id", "content")


@query("""with i as (select memory_id as id, min(ts) c from memories where memory_id is not null group by 1), n as (select count(*) n from i) select id from i order by c nulls first, id limit (select case when n > 300 then least(n, n - 300 + 100) else 0 end from n)""")
def evicted_oldest(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories").where("memory_id is not null").select(F.col("memory_id").alias("id"), F.col("ts").alias("created_at"))
    return retention.evicted(m, m.select("id", F.col("created_at").alias("at")), 300, policy="temporal")


# -- extraction -----------------------------------------------------------------------------------


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").select(F.col("memory_id").alias("id"), F.col("content").alias("text")).dropDuplicates(["id"])


_CAPS = r"[A-Z][\p{L}\p{N}&]*"
_NOUN = rf"{_CAPS}(?:\s+{_CAPS}){{0,3}}"
_BETWEEN = rf"({_NOUN})\s+((?:(?:{extraction.VERBS})(?:\s+(?:{extraction.PREPOSITIONS}))?)|{extraction.PREPOSITIONS})\s+(?:the\s+|a\s+|an\s+)?({_NOUN})"
_OWNS = rf"({_NOUN})('s)\s+({_NOUN})".replace("'", "''")
_PRON = "(" + ", ".join(f"'{p}'" for p in extraction.PRONOUNS) + ")"


@query(f"""with t as (select memory_id as id, trim(regexp_replace(regexp_replace(any_value(content), '[\\s ]+', ' ', 'g'), '[‘’]', chr(39), 'g')) as text from memories where length(trim(content)) > 0 group by 1),
s0 as (select id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) > 0) a from t),
s as (select id, unnest(range(0, len(a)))::int as pos, unnest(a) as sentence from s0),
m as (select id, pos, unnest(regexp_extract_all(sentence, '{_BETWEEN}', 1)) h, unnest(regexp_extract_all(sentence, '{_BETWEEN}', 2)) v, unnest(regexp_extract_all(sentence, '{_BETWEEN}', 3)) d from s),
o as (select id, pos, unnest(regexp_extract_all(sentence, '{_OWNS}', 1)) h, unnest(regexp_extract_all(sentence, '{_OWNS}', 3)) d from s),
dep as (select id, pos, h as head, regexp_replace(lower(v), '\\s+', '_', 'g') as relation, d as dependent from m union all select id, pos, h, 'owns', d from o)
select id, pos, head, relation, dependent, count(*) as n from dep where head <> dependent and lower(head) not in {_PRON} and lower(dependent) not in {_PRON} group by all""")
def dependency_counts(spark: SparkSession, d: str) -> DataFrame:
    return extraction.dependencies(_texts(spark, d)).groupBy("id", "pos", "head", "relation", "dependent").agg(F.count("*").alias("n"))


@query()
def rule_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return extraction.dependencies(_texts(spark, d))


@query()
def rule_entities(spark: SparkSession, d: str) -> DataFrame:
    return extraction.entities(_texts(spark, d)).select("id", "entity", "name", "type", "original_type", _r("confidence"))


@query()
def rule_relationships(spark: SparkSession, d: str) -> DataFrame:
    return extraction.relationships(_texts(spark, d)).select("id", "relationship", "source", "target", "type", _r("confidence"))


@query("""with w as (select distinct lower(name) nm from entity_records where name is not null and length(trim(name)) > 0), s as (select nm, 'north ' || nm o from w)
select nm as name, round(len(list_filter(list_filter(string_split_regex(nm, '\\s+'), lambda x: x <> ''), lambda p: len(list_filter(list_filter(string_split_regex(o, '\\s+'), lambda x: x <> ''), lambda q: contains(p, q) or contains(q, p))) > 0))::double
 / greatest(len(list_filter(string_split_regex(nm, '\\s+'), lambda x: x <> '')), len(list_filter(string_split_regex(o, '\\s+'), lambda x: x <> ''))), 6) as score from s where len(list_filter(string_split_regex(nm, '\\s+'), lambda x: x <> '')) > 0""")
def word_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entity_records").where("length(trim(name)) > 0").select(F.lower("name").alias("name")).distinct()
    return rows.select("name", _r(linking.word_overlap(F.col("name"), F.concat(F.lit("north "), "name")), "score"))


@query("""select distinct name, trim(regexp_replace(regexp_replace(lower(name), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')) as normal from entity_records where name is not null""")
def normal_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_records").where("name is not null").select("name", similarity.normal_name(F.col("name")).alias("normal")).distinct()


# -- providers and logs ---------------------------------------------------------------------------


def _letters(batch):
    """Stands in for a model: length and number of e's of each text."""
    return [[float(len(t)), float(t.count("e"))] for t in batch]


@query("select memory_id as id, case when length(trim(content)) > 0 then length(content)::double end as a, case when length(trim(content)) > 0 then (length(content) - length(replace(content, 'e', '')))::double end as b from memories")
def provider_embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = providers.embed(table(spark, d, "memories").select(F.col("memory_id").alias("id"), "content"), "content", _letters, 2)
    return rows.select("id", F.get("embedding", F.lit(0)).alias("a"), F.get("embedding", F.lit(1)).alias("b"))


@query("""with m as (select distinct unnest(members) as id from memory_clusters), n as (select id, any_value(type) as t, count(*) c from graph_nodes group by 1)
select coalesce(n.id, m.id) as id, case when m.id is not null then 'clustered' else 'single' end as state from n full join m using (id) where m.id is null or right(m.id, 1) >= '8'""")
def replayed_log(spark: SparkSession, d: str) -> DataFrame:
    """Nodes after a log that puts all members of stored clusters and then deletes those whose id ends below 8."""
    nodes = table(spark, d, "graph_nodes").select("id", F.lit("single").alias("type")).distinct()
    m = table(spark, d, "memory_clusters").select(F.explode("members").alias("id")).where("id is not null").distinct()
    log = m.select(F.lit(1).alias("at"), F.lit("put").alias("op"), "id", F.lit("clustered").alias("type"))
    log = log.union(m.where(F.right("id", F.lit(1)) < "8").select(F.lit(2), F.lit("delete"), "id", F.lit(None).cast("string")))
    return graphs.replay_log(nodes, log).select("id", F.col("type").alias("state"))


@query("select id, k || '=' || properties[k] as entry from (select distinct id, properties, unnest(map_keys(properties)) k from graph_nodes)")
def property_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "graph_nodes").select("id", F.explode(F.map_entries("properties")).alias("e"))
    return e.select("id", F.concat_ws("=", "e.key", "e.value").alias("entry")).distinct()


# -- maintenance and names ------------------------------------------------------------------------

_NAMES = "nm as (select distinct name from entity_records where length(trim(name)) > 0)"


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_records").where("length(trim(name)) > 0").select("name").distinct()


@query("select distinct id, type from graph_nodes where id in (select min(id) from graph_nodes union select max(id) from graph_nodes)")
def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "graph_nodes")
    ends = nodes.agg(F.min("id"), F.max("id")).first()
    return graphs.by_id(nodes, list(ends)).select("id", "type").distinct()


@query("select distinct id from temporal_edges where id not in (select min(id) from temporal_edges)")
def remove_edge(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "temporal_edges")
    return graphs.without_edges(edges, [edges.agg(F.min("id")).first()[0]]).select("id").distinct()


@query("""with n as (select distinct id from graph_nodes), e as (select distinct on (id) id, source, target, temporal_type from temporal_edges), k as (select *, case when temporal_type = 'fact' then 0 else 1 end f from e where temporal_type = 'fact' or (source in (select id from n) and target in (select id from n)))
select id, source from k qualify row_number() over (partition by source order by f, id) <= 3""")
def capped_edges(spark: SparkSession, d: str) -> DataFrame:
    """Facts are there, other edges are added if their ends exist; three edges a source."""
    e = table(spark, d, "temporal_edges").select("id", "source", "target", "temporal_type").dropDuplicates(["id"])
    fact = F.coalesce(F.col("temporal_type") == "fact", F.lit(False))
    return graph.add_edges(e.where(fact), e.where(~fact), table(spark, d, "graph_nodes").select("id"), 3, "id").select("id", "source")


@query("""with n as (select id, any_value(type) as type from graph_nodes group by 1), m as (select distinct unnest(members) as id from memory_clusters)
select coalesce(n.id, m.id) as id, case when m.id is not null then 'member' else n.type end as type from n full join m using (id) where coalesce(n.id, m.id) is not null""")
def upserted_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "graph_nodes").groupBy("id").agg(F.first("type").alias("type"))
    m = table(spark, d, "memory_clusters").select(F.explode("members").alias("id")).where("id is not null").distinct().withColumn("type", F.lit("member"))
    return graph.upsert_nodes(n, m).select("id", "type")


@query("select epoch_us(created_at) as tick, type as op, id from (select distinct on (id) id, type, created_at from temporal_edges) order by created_at desc, id limit 100")
def operation_history(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "temporal_edges").select(F.col("created_at").alias("at"), F.col("type").alias("op"), "id").dropDuplicates(["id"])
    return graphs.history(log).select(F.unix_micros("at").alias("tick"), "op", "id")


@query("select id from (select distinct id from graph_nodes where id is not null) order by id limit 25 offset 50")
def paged_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graphs.page(table(spark, d, "graph_nodes").where("id is not null").select("id").distinct(), [F.col("id")], 50, 25)[0]


@query("select distinct id, lower(type) as label from graph_nodes where type is not null")
def node_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_nodes").where("type is not null").select("id", F.lower("type").alias("label")).distinct()


@query(f"with {_NAMES} select name, trim(regexp_replace(regexp_replace(name, '[\\s ]+', ' ', 'g'), '[‘’]', chr(39), 'g')) as plain from nm")
def normal_space(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("name", extraction.normal_space(F.col("name")).alias("plain"))


_ORG = f"""(regexp_matches(name, '(?i)\\b(?:{extraction.COMPANY}|{extraction.INSTITUTION})\\b') or (regexp_matches(name, '^[A-Z][a-z]*[A-Z][A-Za-z]*$') and length(name) > 3) or regexp_matches(name, '^[A-Z]{{3,}}$')
or (len(string_split_regex(name, '\\s+')) >= 2 and regexp_matches(name, '^[A-Z]\\S*(?:\\s+[A-Z]\\S*)+$') and not regexp_matches(name, '^[A-Z][a-z]+\\s+[A-Z][a-z]+$')))"""


@query(f"with {_NAMES} select name from nm where {_ORG}")
def organization_names(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).where(extraction.looks_like_organization(F.col("name")))


_TYPED = f"""case when regexp_matches(name, '(?i)\\b(?:{extraction.COMPANY})\\b') or regexp_matches(name, '(?i)\\b(?:{extraction.INSTITUTION})\\b') or (regexp_matches(name, '^[A-Z][a-z]*[A-Z][A-Za-z]*$') and length(name) > 3) or regexp_matches(name, '^[A-Z]{{3,}}$') or (ext and regexp_matches(name, '^[A-Z]')) then 'organization'
when regexp_matches(name, '(?i)^(?:{extraction.TITLE})\\b') or regexp_matches(name, '^[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{1,2}}$') or (not ext and regexp_matches(name, '^[A-Z][a-z]+$')) then 'person'
when regexp_matches(name, '(?i)\\b(?:{extraction.PLACE})\\b') or regexp_matches(name, '^[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*,\\s*[A-Z]{{2}}$') then 'location' else 'concept' end"""


@query(f"with {_NAMES}, x as (select name, ext from nm, (values (true), (false)) t(ext)) select name, ext as dependent, {_TYPED} as type, {_TYPED} || '_' || regexp_replace(lower(name), '\\s+', '_', 'g') as entity from x")
def typed_names(spark: SparkSession, d: str) -> DataFrame:
    """Type and id of each name as the subject of ``works`` and as what follows ``works_at``."""
    rows = _names(spark, d).select("name", F.explode(F.array(F.lit(True), F.lit(False))).alias("dependent"))
    rel = F.when(F.col("dependent"), "works_at").otherwise("works")
    rows = rows.withColumn("type", extraction.entity_type(F.col("name"), rel, ~F.col("dependent")))
    return rows.withColumn("entity", extraction.entity_id(F.col("name"), F.col("type")))


_NOT = "[" + ", ".join(f"'{w}'" for w in texts.STOP + extraction.PRONOUNS) + "]"


@query(f"with {_NAMES} select name from nm where len(string_split_regex(name, '\\s+')) <= 4 and regexp_matches(name, '[a-zA-Z]') and not regexp_matches(lower(name), '^(?:a|an|the|of|{extraction.PREPOSITIONS})\\s') and not list_contains({_NOT}, lower(name))")
def valid_names(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).where(extraction.valid_entity(F.col("name")))


_CTX = " ".join(f"when regexp_matches(c, '\\b(?:{w})\\b') then '{t}'" for t, w in extraction.CONTEXT.items())


@query(f"""with t as (select distinct on (memory_id) memory_id as id, string_split_regex(lower(content), '\\s+') as w from memories where length(trim(content)) > 0), p as (select id, w, list_position(w, 'team') as i from t where list_contains(w, 'team')),
x as (select id, array_to_string(w[greatest(1, i - 3):i + 3], ' ') as c from p) select id, c as context, case {_CTX} else 'concept' end as type from x""")
def context_types(spark: SparkSession, d: str) -> DataFrame:
    """Words around the first ``team`` of each text, and the type they tell."""
    rows = _texts(spark, d).where("length(trim(text)) > 0").select("id", extraction.context_of(F.col("text"), F.lit("team")).alias("context")).where("context <> ''")
    return rows.select("id", "context", extraction.type_by_context(F.col("context"), F.lit("concept")).alias("type"))


@query("select session_id as id, count(*) as uses, epoch_us(max(ts)) as last from memories where session_id is not null and ts is not null group by 1")
def access_usage(spark: SparkSession, d: str) -> DataFrame:
    acc = table(spark, d, "memories").where("session_id is not null and ts is not null").select(F.col("session_id").alias("id"), F.col("ts").alias("at"))
    return retention.usage(acc).select("id", "uses", F.unix_micros("last").alias("last"))


@query("select p_partkey as id, case when abs(p_size::double / (p_partkey % 50 + 1) - 1) < 0.2 then '672x672' when p_size::double / (p_partkey % 50 + 1) < 1 then '336x1344' else '1344x336' end as target from part")
def image_targets(spark: SparkSession, d: str) -> DataFrame:
    """Target sizes of images of ``p_size`` by a side from the key."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), graphs.image_target(F.col("p_size"), F.col("p_partkey") % 50 + 1).alias("target"))


@query("select token, count(*) as n, round(count(*)::double / (select count(*) from documents), 9) as share from (select doc_id, unnest(list_distinct(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '[^a-zA-Z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: length(x) between 2 and 50))) as token from documents) group by 1")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    n = docs.count()
    return texts.postings(docs, "doc_id", "text").groupBy("token").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / float(max(n, 1)), 9))
