"""Entities and relationships of texts by rules.

No tagger is at hand, so nouns are runs of capitalised words, and a sentence's
relations are read by patterns of verbs and prepositions between two of them.
Everything is column expressions: sentences are exploded, patterns captured by
regular expressions, types and confidences are ``when`` chains.

Texts are (id, text). Null and blank texts give nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.operators import texts

#: Confidences of what the patterns find, and of entities by type.
VERB_PREPOSITION, VERB, PREPOSITION, POSSESSIVE, WORK = 0.9, 0.85, 0.8, 0.9, 0.95
TYPE_CONFIDENCE = {"person": 0.9, "location": 0.85, "organization": 0.8, "concept": 0.7}
#: Suffixes and titles.
COMPANY = "Inc|Corp|Corporation|Company|Co|LLC|Ltd|Technologies|Tech|Systems|Solutions|Group|Associates|Partners"
INSTITUTION = "University|College|Institute|Foundation|Society|Association|School"
PLACE = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Plaza|Square|Circle|Court|Ct"
TITLE = "Mr|Mrs|Ms|Dr|Prof|Professor|Sir|Lady|Captain|Colonel"
PREPOSITIONS = "at|in|on|for|with|by|to|from"
# own choice: verbs that the patterns know
VERBS = "is|was|are|were|has|have|had|owns|knows|knew|manages|managed|leads|led|heads|headed|works|worked|lives|lived|employed|located|collaborates|studies|teaches|partners|joined|founded|created|develops|studied|visited|met|moved|supports|involves|researches"
#: Semantic relations of what stands between two nouns.
RELATIONS = {
    "is": "instance_of", "was": "instance_of", "are": "instance_of", "were": "instance_of", "has": "has", "have": "has", "had": "has", "owns": "owns", "knows": "knows", "knew": "knows",
    "manages": "manages", "managed": "manages", "leads": "leads", "led": "leads", "heads": "heads", "headed": "heads",
    "works_at": "works_at", "works_for": "works_for", "works_in": "works_in", "works_with": "associated_with", "lives_at": "lives_at", "lives_in": "lives_in", "employed_by": "employed_by",
    "located_at": "located_at", "located_in": "located_in", "located_on": "located_on", "collaborates_with": "collaborates_with", "studies_at": "studies_at", "teaches_at": "teaches_at", "partners_with": "partners_with",
    "at": "located_at", "in": "located_in", "on": "located_on", "near": "near", "with": "associated_with", "for": "works_for", "by": "created_by", "to": "connected_to", "from": "originated_from",
}
#: Words near an entity that tell its type, in the order in which they are tried.
CONTEXT = {
    "person": "said|says|told|believes|thinks|worked|works|founded|ceo|director|manager|engineer|developer|researcher|professor|dr|mr|ms|mrs",
    "organization": "company|corporation|inc|llc|startup|firm|business|organization|team|group|department|division|university|college|institute",
    "location": "city|town|country|state|region|area|located|based|headquarters|office|building|street|avenue|road",
    "technology": "technology|software|platform|system|tool|framework|library|api|service|application|algorithm|model|database|server",
    "event": "conference|meeting|workshop|seminar|summit|event|gathering|session|talk|presentation|hackathon|competition",
}
#: Pronouns, which are no ends of relations.
PRONOUNS = ["he", "she", "they", "it", "we", "i", "you", "him", "her", "them", "us", "me", "who", "this", "that"]

CAP = r"[A-Z][\p{L}\p{N}&]*"
NOUN = rf"{CAP}(?:\s+{CAP}){{0,3}}"


def normal_space(text: Column) -> Column:
    """White space once, typographic apostrophes as plain ones."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\s ]+", " "), "[‘’]", "'"))


def sentences(df: DataFrame) -> DataFrame:
    """(id, pos, sentence)."""
    rows = df.where("length(trim(text)) > 0").select("id", F.posexplode(texts.sentences(normal_space(F.col("text")))).alias("pos", "sentence"))
    return rows


def dependencies(df: DataFrame) -> DataFrame:
    """(id, pos, head, relation, dependent, confidence): relations between two nouns of a sentence.

    Verb with a preposition, verb alone, preposition alone, possession; verbs of work are surest.
    """

    def hits(pattern: str, relation: Callable[[Column], Column], confidence: Callable[[Column], Column]) -> Column:
        found = F.regexp_extract_all("sentence", F.lit(pattern), F.lit(0))
        part = lambda x, i: F.regexp_extract(x, pattern, i)
        return F.transform(found, lambda x: F.struct(part(x, 1).alias("head"), F.lower(relation(x)).alias("relation"), part(x, 3).alias("dependent"), confidence(x).alias("confidence")))

    between = rf"({NOUN})\s+((?:(?:{VERBS})(?:\s+(?:{PREPOSITIONS}))?)|{PREPOSITIONS})\s+(?:the\s+|a\s+|an\s+)?({NOUN})"
    word = lambda x: F.regexp_replace(F.lower(F.regexp_extract(x, between, 2)), r"\s+", "_")
    work = ["works_at", "works_for", "employed_by", "leads", "manages", "heads"]
    sure = lambda x: F.when(word(x).isin(work), WORK).when(word(x).contains("_"), VERB_PREPOSITION).when(word(x).isin(PREPOSITIONS.split("|")), PREPOSITION).otherwise(VERB)
    owns = rf"({NOUN})('s)\s+({NOUN})"
    all_ = F.concat(hits(between, word, sure), hits(owns, lambda x: F.lit("owns"), lambda x: F.lit(POSSESSIVE)))
    rows = sentences(df).select("id", "pos", F.inline(all_))
    return rows.where("head <> dependent").where(~F.lower("head").isin(PRONOUNS) & ~F.lower("dependent").isin(PRONOUNS))


def looks_like_organization(name: Column) -> Column:
    """A suffix of companies or institutions, inner capitals, an acronym, or several capitalised words that are no person's."""
    words = F.size(F.split(name, r"\s+"))
    suffix = name.rlike(rf"(?i)\b(?:{COMPANY}|{INSTITUTION})\b")
    camel = name.rlike(r"^[A-Z][a-z]*[A-Z][A-Za-z]*$") & (F.length(name) > 3)
    many = (words >= 2) & name.rlike(r"^[A-Z]\S*(?:\s+[A-Z]\S*)+$") & ~name.rlike(r"^[A-Z][a-z]+\s+[A-Z][a-z]+$")
    return suffix | camel | name.rlike(r"^[A-Z]{3,}$") | many


def entity_type(name: Column, relation: Column, at_head: Column) -> Column:
    """Organisation, person, location or concept, tried in this order."""
    org = name.rlike(rf"(?i)\b(?:{COMPANY})\b") | name.rlike(rf"(?i)\b(?:{INSTITUTION})\b") | (name.rlike(r"^[A-Z][a-z]*[A-Z][A-Za-z]*$") & (F.length(name) > 3)) | name.rlike(r"^[A-Z]{3,}$")
    org = org | (~at_head & relation.rlike(r"(?:^|_)(?:at|for|with)$") & name.rlike("^[A-Z]"))
    person = name.rlike(rf"(?i)^(?:{TITLE})\b") | name.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}$") | (at_head & name.rlike("^[A-Z][a-z]+$") & relation.rlike("^(?:works|leads|manages|knows|lives|owns)"))
    place = name.rlike(rf"(?i)\b(?:{PLACE})\b") | name.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s*[A-Z]{2}$") | (~at_head & relation.rlike(r"(?:^|_)(?:in|at|near|from)$") & name.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$"))
    return F.when(org, "organization").when(person, "person").when(place, "location").otherwise("concept")


def valid_entity(name: Column) -> Column:
    """At most four words, a letter, no article or preposition in front, no stop word or pronoun."""
    lower = F.lower(name)
    return (F.size(F.split(name, r"\s+")) <= 4) & name.rlike("[a-zA-Z]") & ~lower.rlike(rf"^(?:a|an|the|of|{PREPOSITIONS})\s") & ~lower.isin(texts.STOP + PRONOUNS)


def context_of(sentence: Column, name: Column, around: int = 3) -> Column:
    """Up to ``around`` words on each side of the first mention, with the mention."""
    ws = F.split(F.lower(sentence), r"\s+")
    first = F.element_at(F.split(F.lower(name), r"\s+"), 1)
    at = F.array_position(ws, first).cast("int")
    n = F.size(F.split(name, r"\s+"))
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.concat_ws(" ", F.slice(ws, start, at - start + n + around))).otherwise(F.lit(""))


def type_by_context(context: Column, current: Column) -> Column:
    """The first type with a whole word of its list in the context, else the current one."""
    out = None
    for t, words in CONTEXT.items():
        hit = context.rlike(rf"\b(?:{words})\b")
        out = F.when(hit, t) if out is None else out.when(hit, t)
    return out.otherwise(current)


def entity_id(name: Column, type_: Column) -> Column:
    return F.concat_ws("_", type_, F.regexp_replace(F.lower(name), r"\s+", "_"))


def relationship_id(source: Column, target: Column, type_: Column) -> Column:
    return F.concat_ws("_", source, type_, target)


def _ends(deps: DataFrame) -> DataFrame:
    """(id, pos, name, relation, at_head, confidence) of both ends of each relation."""
    ends = F.array(F.struct(F.col("head").alias("name"), F.lit(True).alias("at_head")), F.struct(F.col("dependent").alias("name"), F.lit(False).alias("at_head")))
    return deps.select("id", "pos", "relation", "confidence", F.inline(ends)).where(valid_entity(F.col("name")))


def entities(df: DataFrame, *, least: float = 0.6, most: int = 50) -> DataFrame:
    """(id, entity, name, type, original_type, confidence): at most ``most`` of a text, the surest first.

    The surest mention of a name decides its type; the words around it may
    change the type and then add 0.1 to the confidence, up to 1.
    """
    deps = dependencies(df)
    found = _ends(deps).select("id", "pos", "name", entity_type(F.col("name"), F.col("relation"), F.col("at_head")).alias("type"), "confidence", "at_head")
    first = found.groupBy("id", F.lower("name").alias("key")).agg(F.min_by(F.struct("name", "type", "confidence", "pos"), F.struct(-F.col("confidence"), "pos", ~F.col("at_head"), "name")).alias("e")).select("id", "e.*")
    told = first.join(sentences(df), ["id", "pos"]).withColumn("new", type_by_context(context_of(F.col("sentence"), F.col("name")), F.col("type")))
    changed = F.col("new") != F.col("type")
    rows = told.select("id", entity_id(F.col("name"), F.col("new")).alias("entity"), "name", F.col("new").alias("type"), F.col("type").alias("original_type"), F.least(F.lit(1.0), F.col("confidence") + F.when(changed, 0.1).otherwise(0.0)).alias("confidence"))
    r = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("confidence", 9)), "name"))
    return rows.where(F.col("confidence") >= least).withColumn("r", r).where(F.col("r") <= most).drop("r")


def relationships(df: DataFrame, *, least: float = 0.5, most: int = 100) -> DataFrame:
    """(id, relationship, source, target, type, confidence): relations whose ends are entities of the text; as sure as the least sure part."""
    deps = dependencies(df).select("id", F.lower("head").alias("h"), F.lower("dependent").alias("d"), "relation", "confidence")
    table = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])
    ents = entities(df).select("id", F.lower("name").alias("key"), "entity", F.col("confidence").alias("c"))
    rows = deps.join(ents.select("id", F.col("key").alias("h"), F.col("entity").alias("source"), F.col("c").alias("cs")), ["id", "h"])
    rows = rows.join(ents.select("id", F.col("key").alias("d"), F.col("entity").alias("target"), F.col("c").alias("ct")), ["id", "d"]).where("source <> target")
    kind = F.coalesce(F.try_element_at(table, F.col("relation")), F.lit("related_to"))
    rows = rows.select("id", "source", "target", kind.alias("type"), F.least("confidence", "cs", "ct").alias("confidence"))
    rows = rows.groupBy("id", "source", "target", "type").agg(F.max("confidence").alias("confidence")).where(F.col("confidence") >= least)
    r = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("confidence", 9)), "source", "type", "target"))
    rows = rows.withColumn("r", r).where(F.col("r") <= most).drop("r")
    return rows.select("id", relationship_id(F.col("source"), F.col("target"), F.col("type")).alias("relationship"), "source", "target", "type", "confidence")


def to_dependencies(rels: DataFrame) -> DataFrame:
    return rels.select("id", F.col("source").alias("head"), F.col("type").alias("relation"), F.col("target").alias("dependent"), "confidence")


def merge_similar(ents: DataFrame, links: DataFrame) -> DataFrame:
    """Entities (entity, confidence, ..) joined by links (a, b): of each connected group the surest stays, 0.1 surer, up to 1."""
    from spindrel.operators.components import connected_components

    comp = connected_components(links).select(F.col("node").alias("entity"), "component")
    rows = ents.join(comp, "entity", "left").withColumn("_g", F.coalesce("component", "entity"))
    w = Window.partitionBy("_g")
    best = rows.withColumn("_r", F.row_number().over(w.orderBy(F.desc("confidence"), "entity"))).withColumn("_n", F.count("*").over(w)).where("_r = 1")
    return best.withColumn("confidence", F.when(F.col("_n") > 1, F.least(F.lit(1.0), F.col("confidence") + 0.1)).otherwise(F.col("confidence"))).select(*ents.columns)


# -- answers of models ------------------------------------------------------------------------------


def parse_answer(answer: str | None) -> object | None:
    """JSON of a model's answer: as it is, within a fence, the outermost object or list, at last repaired (keys and single quotes, trailing commas)."""
    if not answer:
        return None
    fence = re.search(r"```(?:json)?\s*(.*?)```", answer, re.S)
    tries = [answer, fence[1] if fence else ""]
    for a, b in ("{}", "[]"):
        if a in answer and b in answer:
            tries.append(answer[answer.index(a) : answer.rindex(b) + 1])
    for t in [*tries, *(_repair(t) for t in tries)]:
        try:
            return json.loads(t)
        except (ValueError, TypeError):
            continue
    return None


def _repair(t: str) -> str:
    t = re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', t)
    t = re.sub(r"(?<=[\[{,:\s])'([^']*)'", r'"\1"', t)
    return re.sub(r",\s*([\]}])", r"\1", t)


def extract_with(df: DataFrame, provider: Callable[[Iterable[str]], Iterable[str]], least: float = 0.0) -> DataFrame:
    """(id, name, type, confidence): entities by a model; ``provider`` answers a batch of texts.

    A batch whose provider fails gives rows without entities, not an error;
    entities without a name or type, or with a confidence outside 0 to 1, are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            try:
                answers = list(provider(frame["text"].tolist()))
            except Exception:  # the provider is foreign code
                answers = [None] * len(frame)
            for id_, a in zip(frame["id"], answers, strict=False):
                got = parse_answer(a)
                items = got.get("entities", []) if isinstance(got, dict) else got if isinstance(got, list) else []
                for e in items:
                    if isinstance(e, dict) and str(e.get("name") or "").strip() and str(e.get("type") or "").strip():
                        c = e.get("confidence", 1.0)
                        if isinstance(c, (int, float)) and 0 <= c <= 1 and c >= least:
                            out.append((id_, str(e["name"]).strip(), str(e["type"]).strip().lower(), float(c)))
            yield pd.DataFrame(out, columns=["id", "name", "type", "confidence"])

    kind = df.schema["id"].dataType.simpleString()
    return df.where("length(trim(text)) > 0").select("id", "text").mapInPandas(run, f"id {kind}, name string, type string, confidence double")
