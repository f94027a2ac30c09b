"""Personal data in texts: bootstrapped contextual extraction.

Seeds are the values that stand alone in a user column. Values of one shape
induce a template, in which positions that never vary stay literal; names
give the given names. The templates' finds in the texts make a bipartite graph
with the words before them. Kinds spread over this graph from the sure seeds
(a leading + is a phone, letters among digits an identity number): contexts
take the weighted mean of their templates, templates that of their contexts,
a few times in Spark. Contexts that hold nearly only such finds then reveal
numbers of shapes never seen as seeds; contexts whose numbers mostly have other
shapes (part numbers, readings) veto finds. Words that stand before many
different capitalised names, and not in prose, join the given names;
what follows postcodes becomes a town. E-mail addresses and addresses begin with
fixed seed forms; words that stand where the seeds' street words do, in the same
contexts, join the street words by the same kind of graph.

What is collected to the driver are templates, contexts and words of a
vocabulary, each once, with floors of a fixed number of distinct texts.

Defined results: null and empty fields hold nothing; a value found twice in
one field is one row; null ids are left out; a whole text is searched,
whatever its length; overlapping finds go to the first of email, address,
number, name; other columns aren't read.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.functions.runtime import cut

EMAIL = re.compile(
    r"(?<![\w.+-])[A-Za-z0-9][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])"
    r"|(?<![\w.+-])[A-Za-z0-9][\w.+-]*\s*(?:\[\s*at\s*\]|\(\s*at\s*\)|\{\s*at\s*\})\s*[\w-]+(?:\.[\w-]+)+"
    r"|(?<![\w.+-])[A-Za-z0-9][\w.+-]*\s*(?:\[\s*at\s*\]|\(\s*at\s*\)|\{\s*at\s*\}|\sat\s)\s*[\w-]+(?:\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\)|\{\s*dot\s*\}|\sdot\s)\s*[\w-]+)+",
    re.I,
)
#: Street words, titles, words before names that aren't persons.
STREET = "Street|St|Lane|Road|Rd|Avenue|Ave|Drive|Dr|Court|Ct|Close|Square|Sq|Way|Terrace|Place|Pl|Boulevard|Blvd|Crescent|Row|Hill|Gardens"
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Eng|Sir|Herr|Frau|Mme"
NOT_PERSON = {"project", "stream", "proj", "the", "team", "group"}
_UNIT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Wohnung|Room)\.? ?\w+, )?"
_TAIL = r"(?:(?:,? (?:Apt|Flat|Unit|Suite|Apartment)\.? ?\w+|, \d+[ºª°](?: [A-Z]\b)?)?(?:, \d{4,5}(?: [A-Z]{2})?(?: [A-Z][\w'-]+){1,2}|, (?:[A-Z][\w'-]+)(?: [A-Z][\w'-]+)?)?)"
_N = r"\d+[A-Za-z]?(?![\w])"


def address_pattern(more: Iterable[str] = ()) -> re.Pattern:
    """The seed forms, with further street words as they were learned."""
    street = "|".join([STREET, *sorted(re.escape(w) for w in more)])
    return re.compile(
        rf"(?<![\w]){_UNIT}\d+[A-Za-z]? (?:[A-Z][\w'-]+ ){{1,2}}(?:(?:{street})\b\.?){_TAIL}"
        rf"|(?<![\w])\d+[A-Za-z]? [^\W\d_]+ (?:street|lane|road|avenue|STREET|LANE|ROAD|AVENUE)\b{_TAIL}"
        rf"|(?<![\w])[A-ZÀ-ÖØ-Þ][\w-]+(?:weg|straße|strasse|str\.|gasse|platz|allee|straat|laan|gatan|vägen) {_N}{_TAIL}"
        rf"|(?<![\w])(?:Via|Viale|Piazza|Corso|Calle|Avenida|Plaza|Paseo|Rua|Travessa|Rue|Avenue)(?: (?:de|da|do|del|della|la|los|dos))*(?: [A-ZÀ-ÖØ-Þ][\w'-]+){{1,2}},? {_N}{_TAIL}"
        rf"|(?<![\w])\d+(?: (?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|allée|quai|impasse)(?: (?:de|du|des|la|le|les|d'))*(?: [A-ZÀ-ÖØ-Þ][\w'-]+){{1,2}}{_TAIL}"
    )


ADDRESS = address_pattern()
#: A house number, one or two names and a word that may be a street word.
MAYBE_STREET = re.compile(r"(?<![\w])\d{1,4}[A-Za-z]? (?:[A-Z][\w'-]+ ){1,2}?([A-Z][a-z]+)\b\.?(?=[,.;\n]|$| \d)")
POSTCODE_TOWN = re.compile(r", \d{4,5} ([A-Z][\w'-]+(?: [A-Z][\w'-]+)?)")
NUMBER = re.compile(r"(?<![\w@#/.-])(?:[A-Z]{1,3} ?)?[+(]?\d[\d ().\-/]{4,}\d(?:-?[A-Z])?(?![\w])")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
CAP = r"[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:[-'’][A-ZÀ-ÖØ-Þ]?[^\W\d_]+)*"
MATCHES = re.compile(rf"({CAP})(?=\s+({CAP}))")
TURNED = re.compile(rf"(?<![\w@.-])(?P<last>{CAP}), (?P<first>[A-Z]\.|[^\W\d_]+)(?![\w@])(?!\s+[A-Z][a-z])")
TITLED = re.compile(rf"(?<!\w)(?:{TITLES})\.?\s+(?P<name>{CAP}(?:\s+{CAP})?)")
INITIAL = re.compile(rf"(?<![\w.@])(?P<name>[A-Z]\.\s+(?P<last>{CAP}))(?![@\w])")
HAS_DIGIT = re.compile(r"\d")
OBSCURED = re.compile(r"[\[({]\s*at\s*[\])}]|\sat\s.*\sdot\s", re.I | re.S)


def number_finder(patterns: list[str]) -> re.Pattern:
    """Finds of any template, group t0 for the first and so on; most places fail at the first character."""
    any_ = "|".join(rf"(?P<t{i}>{p})" for i, p in enumerate(patterns))
    return re.compile(rf"(?<![\w+#/.-])(?<!\d )(?=[^a-z\s])(?:{any_})(?![\w/]|[-.]\d)" if patterns else r"(?!)")


def before(text: str, at: int) -> str:
    """The last two words before a place, within the sentence."""
    left = re.split(r"[.!?\n;|]\s", text[max(0, at - 40) : at])[-1]
    return " ".join(w.lower() for w in re.findall(r"[^\W\d_]+", left)[-2:])


class Patterns:
    """What was learned."""

    def __init__(self, templates: dict[str, tuple[str, str]], contexts: dict[str, str], veto: set[str], given: set[str], common: set[str], towns: set[str], streets: Iterable[str] = ()):
        self.templates, self.contexts, self.veto = templates, contexts, veto
        self.given, self.common, self.towns = given, common, towns
        order = sorted(templates, key=lambda s: -len(s))
        self.kinds = [templates[s][1] for s in order]
        self.numbers = number_finder([templates[s][0] for s in order])
        self.user = [(re.compile(templates[s][0]), templates[s][1]) for s in order]
        self.address = address_pattern(streets)

    def surname(self, word: str) -> bool:
        return len(word) >= 3 and word.lower() not in self.common and word.lower() not in self.given

    def _address_end(self, m: re.Match) -> str:
        """The match without a tail word that is no known town."""
        value = m[0]
        town = re.search(r", ((?:[A-Z][\w'-]+)(?: [A-Z][\w'-]+)?)$", value)
        if town and not re.search(r"\d", town[1]):
            if town[1] in self.towns:
                return value
            if town[1].split()[0] in self.towns:
                return value[: town.start(1)] + town[1].split()[0]
            return value[: town.start()]
        code = re.search(r"(, \d{4,5} )([A-Z][\w'-]+) ([A-Z][\w'-]+)$", value)
        if code and f"{code[2]} {code[3]}" not in self.towns and code[2] in self.towns:
            return value[: code.end(2)]
        return value

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(begin, end, kind) of what stands in a text, without overlaps."""
        got: list[tuple[int, int, str]] = []
        taken: list[tuple[int, int]] = []

        def add(a: int, b: int, kind: str) -> None:
            while b > a and text[b - 1] in " .,;:!?":
                b -= 1
            if b > a and all(b <= x or a >= y for x, y in taken):
                got.append((a, b, kind))
                taken.append((a, b))

        digits = HAS_DIGIT.search(text) is not None
        if "@" in text or OBSCURED.search(text):
            for m in EMAIL.finditer(text):
                add(m.start(), m.end(), "email")
        if digits:
            for m in self.address.finditer(text):
                add(m.start(), m.start() + len(self._address_end(m)), "address")
            for m in self.numbers.finditer(text):
                ctx = before(text, m.start())
                if ctx not in self.veto:
                    add(m.start(), m.end(), self.kinds[int(m.lastgroup[1:])])
            if self.contexts:
                for m in NUMBER.finditer(text):
                    kind = self.contexts.get(before(text, m.start()))
                    if kind and sum(c.isdigit() for c in m[0]) >= 6:
                        add(m.start(), m.end(), kind)
        low = lambda a: before(text, a).rpartition(" ")[2]
        tokens = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text)]
        given = [i for i, t in enumerate(tokens) if t[2].lower() in self.given]
        for i in given:  # a given name, perhaps an initial, a surname
            a, b, first = tokens[i]
            if a and (text[a - 1].isalnum() or text[a - 1] in "_@.+-"):
                continue
            j = i + 1
            if j < len(tokens) and len(tokens[j][2]) == 1 and text[tokens[j][1] : tokens[j][1] + 1] == "." and text[b : tokens[j][0]].isspace():
                j, b = j + 1, tokens[j][1] + 1
            if j >= len(tokens) or not text[b : tokens[j][0]].isspace():
                continue
            _, end, last = tokens[j]
            if end < len(text) and (text[end].isalnum() or text[end] in "_@") or not self.surname(last) or low(a) in NOT_PERSON:
                continue
            if (first[0].isupper() and last[0].isupper()) or (first.islower() and last.islower() and first not in self.common and len(last) >= 5):
                add(a, end, "name")
        for m in TITLED.finditer(text):
            parts = m["name"].split()
            keep = m["name"] if len(parts) == 1 or (parts[0].lower() in self.given and self.surname(parts[1])) else parts[0]
            if self.surname(keep.split()[-1]):
                add(m.start("name"), m.start("name") + len(keep), "name")
        for m in INITIAL.finditer(text):
            if self.surname(m["last"]):
                add(m.start("name"), m.end("name"), "name")
        if "," in text:
            for m in TURNED.finditer(text):
                first = m["first"]
                if (first.endswith(".") or first.lower() in self.given) and first[0].isupper() and self.surname(m["last"]) and low(m.start()) not in NOT_PERSON:
                    end = m.end("first")
                    if all(end <= x or m.start() >= y for x, y in taken):
                        got.append((m.start(), end, "name"))
                        taken.append((m.start(), end))
        return sorted(got)

    def find_user(self, value: str) -> list[tuple[int, int, str]]:
        if EMAIL.fullmatch(value):
            return [(0, len(value), "email")]
        for pattern, kind in self.user:
            if pattern.fullmatch(value):
                return [(0, len(value), kind)]
        words = value.split()
        if 2 <= len(words) <= 4 and all(re.fullmatch(rf"{CAP}|[A-Z]\.", w) for w in words):
            return [(0, len(value), "name")]
        return []


def _templates(users: DataFrame) -> dict[str, str]:
    """Template of each shape of at least two values that stand alone in the user column."""
    alone = users.where("u rlike '[0-9].*[0-9].*[0-9].*[0-9].*[0-9]' and not u rlike '^[a-z]' and not contains(u, '@')").distinct()
    s = F.regexp_replace(F.regexp_replace("u", "[0-9]", "9"), "[A-Za-z]", "A")
    seeds = alone.select("u", s.alias("s"))
    sizes = {r["s"]: r["n"] for r in seeds.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= 2).collect()}  # one row a format of numbers
    if not sizes:
        return {}
    at = seeds.where(F.col("s").isin(list(sizes))).select("s", F.posexplode(F.split("u", "")).alias("i", "c")).where("c <> ''")
    seen: dict[str, dict[int, set[str]]] = {}
    for r in at.distinct().collect():  # at most 36 characters for each place of a shape
        seen.setdefault(r["s"], {}).setdefault(r["i"], set()).add(r["c"])
    out = {}
    for name, places in seen.items():
        parts = []
        for i in sorted(places):
            c = places[i]
            fixed = len(c) == 1 and sizes[name] >= 6
            one = next(iter(c))
            parts.append(re.escape(one) if fixed or not one.isalnum() else r"\d" if one.isdigit() else "[A-Z]")
        out[name] = "".join(parts)
    return out


def _observe(templates: dict[str, str], sure: set[str]):
    """Counts over a batch: templates and numbers by context, words, towns; pairs of capitalised words."""
    order = sorted(templates, key=lambda s: -len(s))
    finder = number_finder([templates[s] for s in order])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                if HAS_DIGIT.search(text):
                    hit = set()
                    for m in finder.finditer(text):
                        ctx = before(text, m.start())
                        n["ctx", order[int(m.lastgroup[1:])], ctx] += 1
                        hit.add(m.start())
                    for m in NUMBER.finditer(text):
                        if sum(c.isdigit() for c in m[0]) >= 6:
                            n["num", "in" if any(m.start() <= h < m.end() for h in hit) else "out", before(text, m.start())] += 1
                    for m in POSTCODE_TOWN.finditer(text):
                        n["town", m[1], ""] += 1
                    homes = [m.start() for m in ADDRESS.finditer(text)]
                    for a in homes:
                        n["street", "", before(text, a)] += 1
                    for m in MAYBE_STREET.finditer(text):
                        if m.start() not in homes:
                            n["street", m[1], before(text, m.start())] += 1
                seen = WORD.findall(text)
                for w in {w for w in seen if w.islower()}:
                    n["low", w, ""] += 1
                for w in {w.lower() for w in seen if w[0].isupper()}:
                    n["cap", w, ""] += 1
                for a, b in itertools.pairwise(seen):
                    if b.islower() and a in sure:
                        n["named", b, ""] += 1
                for a, b in MATCHES.findall(text):
                    n["pair", a, b] += 1
                for m in INITIAL.finditer(text):
                    n["named", m["last"].lower(), ""] += 1
                for m in TITLED.finditer(text):
                    n["named", m["name"].split()[-1].lower(), ""] += 1
                if "," in text:
                    for m in TURNED.finditer(text):
                        n["turn", m["first"], m["last"]] += 1
            if n:
                keys = list(zip(*n, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(k) for k in keys), pa.array(list(n.values()), pa.int64())], names=["what", "a", "b", "n"])

    return run


def learn(memories: DataFrame, aliases: DataFrame, *, text_col: str = "content", user_col: str = "user_id", rounds: int = 4) -> Patterns:
    """Patterns of a collection; counts are over distinct texts and values, and floors are the same at every size."""
    texts = memories.select(F.col(text_col).alias("text")).where("text is not null").distinct()
    users = memories.select(F.col(user_col).alias("u")).where("u is not null").distinct()
    templates = _templates(users)
    sure = _sure_names(users, aliases)
    seen = texts.mapInArrow(_observe(templates, {r["w"] for r in sure.collect()}), "what string, a string, b string, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    seen = cut(seen, "observed")

    # kinds spread over the graph of templates and contexts; +1 is a phone, -1 an identity number
    links = cut(seen.where(F.col("what") == "ctx").select(F.col("a").alias("s"), F.col("b").alias("ctx"), F.log1p("n").alias("w")), "links")
    known = F.when(F.col("s").rlike(r"^[+(]"), 1.0).when(F.col("s").contains("A"), -1.0)
    scores = links.select("s").distinct().select("s", F.coalesce(known, F.lit(0.0)).alias("score"))
    for _ in range(rounds):
        ctx = links.join(scores, "s").groupBy("ctx").agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("c"))
        back = links.join(ctx, "ctx").groupBy("s").agg((F.sum(F.col("w") * F.col("c")) / F.sum("w")).alias("b"))
        scores = cut(back.select("s", F.coalesce(known, F.col("b")).alias("score")), "scores")
    found = {r["s"]: r["score"] for r in scores.collect()}  # one row a template
    digits = lambda s: sum(c == "9" for c in s)
    guess = lambda s: "phone" if s[0] in "+(" or (digits(s) >= 10 and "A" not in s) else "id_number"
    kinds = {s: ("phone" if found[s] > 0 else "id_number") if abs(found.get(s, 0.0)) > 0.05 else guess(s) for s in templates}
    ctx = links.join(scores, "s").groupBy("ctx").agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("c"))
    nums = seen.where(F.col("what") == "num").groupBy(F.col("b").alias("ctx")).agg(F.sum(F.when(F.col("a") == "in", F.col("n")).otherwise(0)).alias("inside"), F.sum("n").alias("n"))
    clear = (F.col("inside") >= 0.85 * F.col("n")) & (F.abs("c") > 0.3) | (F.col("inside") <= 0.15 * F.col("n"))
    told = nums.where((F.col("n") >= 8) & (F.col("ctx") != "")).join(ctx, "ctx", "left").where(clear).collect()  # clear contexts of numbers, of at most two words
    contexts = {r["ctx"]: "phone" if r["c"] > 0 else "id_number" for r in told if r["c"] is not None and r["inside"] >= 0.85 * r["n"] and abs(r["c"]) > 0.3}
    veto = {r["ctx"] for r in told if r["inside"] <= 0.15 * r["n"]}

    towns = {r["a"] for r in seen.where((F.col("what") == "town") & (F.col("n") >= 2)).collect()}
    streets = _streets(seen, rounds)
    given, common = _given(seen, sure)
    return Patterns({s: (templates[s], kinds[s]) for s in templates}, contexts, veto, given, common, towns, streets)


def _streets(seen: DataFrame, rounds: int) -> set[str]:
    """Street words beyond the seeds: scored with the contexts of addresses, as a graph; seeds count 1."""
    links = seen.where((F.col("what") == "street") & (F.col("b") != "")).select(F.col("a").alias("w"), F.col("b").alias("ctx"), "n")
    seed = F.col("w") == ""
    scores = links.select("w").distinct().select("w", F.when(seed, 1.0).otherwise(0.0).alias("score"))
    for _ in range(rounds):
        ctx = links.join(scores, "w").groupBy("ctx").agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("c"))
        back = links.join(ctx, "ctx").groupBy("w").agg((F.sum(F.col("n") * F.col("c")) / F.sum("n")).alias("score"), F.sum("n").alias("finds"))
        scores = back.select("w", F.when(seed, 1.0).otherwise(F.col("score")).alias("score"), "finds")
    return {r["w"] for r in scores.where(~seed & (F.col("score") >= 0.5) & (F.col("finds") >= 4)).collect()}


def _sure_names(users: DataFrame, aliases: DataFrame) -> DataFrame:
    """(w): given names of the table, and first words of at least two names that stand alone."""
    first = users.where(F.col("u").rlike(r"^\p{Lu}\p{L}+ (\p{Lu}\. )?\p{Lu}[\p{L}'-]+$")).groupBy(F.lower(F.split("u", " ")[0]).alias("w")).agg(F.count("*").alias("n")).where("n >= 2").select("w")
    table = aliases.select(F.explode(F.array("short_name", "given_name")).alias("w")).select(F.lower(F.trim("w")).alias("w")).where("length(w) > 0")
    return cut(first.union(table).distinct(), "names")


def _given(seen: DataFrame, sure: DataFrame) -> tuple[set[str], set[str]]:
    """Given names, and words that follow them without being surnames."""
    words = seen.where(F.col("what").isin("low", "cap")).groupBy(F.col("a").alias("w")).agg(F.sum(F.when(F.col("what") == "low", F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(F.col("what") == "cap", F.col("n")).otherwise(0)).alias("cap"))
    words = cut(words, "words")
    prose = (F.col("low") >= 3) & (F.col("low") >= 0.1 * F.col("cap"))
    pairs = seen.where(F.col("what") == "pair").groupBy(F.lower("a").alias("g"), F.lower("b").alias("b")).agg(F.sum("n").alias("n"))
    follow = pairs.join(words.where(~prose).select(F.col("w").alias("b")), "b").groupBy("g").agg(F.count("*").alias("names"))
    wide = pairs.groupBy("g").agg(F.count("*").alias("d"), F.sum("n").alias("n")).where("d >= 5 and d > 0.4 * n and length(g) >= 3")
    wide = wide.join(follow, "g").join(words.select(F.col("w").alias("g"), "cap"), "g").where("names >= 0.8 * d and n >= 0.3 * cap").join(words.where(prose).select(F.col("w").alias("g")), "g", "left_anti").select(F.col("g").alias("w"))
    never = [*NOT_PERSON, *(t.lower() for t in TITLES.split("|"))]
    names = sure.union(wide).distinct().where((F.length("w") >= 2) & ~F.col("w").isin(never))
    mostly_low = words.where((F.col("low") > 10) & (F.col("low") > 10 * F.col("cap"))).select("w")
    names = cut(names.join(mostly_low, "w", "left_anti"), "given")
    turned = seen.where(F.col("what") == "turn").select(F.lower("a").alias("g"), F.lower("b").alias("b"), "n")
    after = pairs.select("g", "b", "n").union(turned).join(names.select(F.col("w").alias("g")), "g").select(F.col("b").alias("w"), "n")
    after = after.union(seen.where(F.col("what") == "named").select("a", "n")).groupBy("w").agg(F.sum("n").alias("after"))
    judged = words.join(after, "w", "left").join(names, "w", "left_anti").select("w", prose.alias("prose"), "low", "cap", F.coalesce("after", F.lit(0)).alias("after"))
    other = F.col("prose") & (F.col("after") < 0.3 * (F.col("low") + F.col("cap"))) | (F.col("cap") >= 5) & (F.col("after") < 0.3 * F.col("cap")) & (F.col("after") > 0)
    return {r["w"] for r in names.collect()}, {r["w"] for r in judged.where(other).select("w").collect()}  # words of a vocabulary, each once


def _tag(patterns: Patterns):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, text, user in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("u").to_pylist(), strict=True):
                rows = {("content", k, text[a:b]) for a, b, k in patterns.find(text)} if text else set()
                rows |= {("user_id", k, user[a:b]) for a, b, k in patterns.find_user(user)} if user else set()
                out += [(id_, *r) for r in rows]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["memory_id", "field", "kind", "found_value"])

    return run


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder in place of each span."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _redact(patterns: Patterns):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(t, patterns.find(t)) if t else t for t in batch.column("text").to_pylist()]
            users = [redact(u, patterns.find_user(u)) if u else u for u in batch.column("u").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array(users, pa.string())], names=["memory_id", "content", "user_id"])

    return run


def _rows(memories: DataFrame, id_col: str, text_col: str, user_col: str) -> DataFrame:
    return memories.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(user_col).cast("string").alias("u")).where("id is not null")


def found(memories: DataFrame, patterns: Patterns, *, id_col: str = "memory_id", text_col: str = "content", user_col: str = "user_id") -> DataFrame:
    """(memory_id, field, kind, found_value), each once."""
    return _rows(memories, id_col, text_col, user_col).mapInArrow(_tag(patterns), "memory_id string, field string, kind string, found_value string").distinct()


def redacted(memories: DataFrame, patterns: Patterns, *, id_col: str = "memory_id", text_col: str = "content", user_col: str = "user_id") -> DataFrame:
    """(memory_id, content, user_id) with placeholders; one row for each row with an id."""
    return _rows(memories, id_col, text_col, user_col).mapInArrow(_redact(patterns), "memory_id string, content string, user_id string")
