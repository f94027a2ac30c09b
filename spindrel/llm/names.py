"""Variant spellings of names: phonetic blocks, Jaro-Winkler, nicknames, connected components.

A name is read as a form: its nature (person, organisation or project), its
root (surname, first word of an organisation, project word) and its
companions (given name, branch words). Reading undoes case, accents, digits
for letters, glued words, order, titles, legal forms and remarks; given names
go through the nickname table, which quoted nicknames in the data extend, and
branch words through the words that many organisations share. Given names too
rare to be known are compared as written: by beginning, or as slips of the pen
if one of the two is seen with at most two, or a quarter of the other's surnames.

Forms with the same reading are one. Two forms are compared if they share a
block of the phonetic codes of their sorted tokens: nature, codes of the companions
(of given names the first sound) and the code of the first or the last half of
the root (one slip of the pen leaves one of the halves alone). Roots are
accepted by Jaro-Winkler similarity and few edits. Connected components of the accepted pairs are entities. A
form whose given name leaves a choice (an initial, a cut name, a short name
of two names) joins the only entity it fits, or none if it fits several; it
never connects two others.

Defined results: null, blank and placeholder names are left out; an unknown or
null type is decided by the name; a repeated id counts once; a name table that
is empty or null in places only means fewer nicknames; other columns aren't read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrel.functions.runtime import cut, partitions
from spindrel.operators.components import connected_components
from spindrel.operators.similarity import winkler

#: Spellings of types, placeholders, titles, remarks, legal forms and project words.
TYPES = {"person": "person", "people": "person", "individual": "person", "human": "person", "per": "person"}
TYPES |= {"organization": "org", "organisation": "org", "company": "org", "org": "org", "firm": "org", "corporation": "org"}
TYPES |= {"project": "project", "initiative": "project", "proj": "project", "program": "project", "programme": "project"}
PLACEHOLDERS = {"", "unknown", "unknown person", "n a", "na", "tbd", "none", "null", "test", "anonymous", "nobody", "no name", "nil", "todo", "tba", "unnamed", "xxx", "name"}
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "miss", "eng", "ing", "sir", "herr", "frau", "mme", "sr", "jr", "phd", "md", "ii", "iii", "contractor", "ext", "external", "she", "he", "they"}
LEGAL = {"llc", "ag", "ltd", "limited", "inc", "bv", "corp", "gmbh", "sa", "plc", "the", "and", "co", "kg", "nv", "ab", "oy", "srl", "spa"}
PROJECT = {"project", "proj", "prj", "initiative", "stream"}
LEET = str.maketrans("01345", "oieas")
PHONETIC = str.maketrans("bpfvwckqgszxdtyj", "ppfffkkkksssttii")
VOWELS = str.maketrans("eiouy", "aaaaa")


@lru_cache(200_000)
def letters(a: str) -> int:
    """Bits of the letters that occur; an edit changes at most two of them."""
    out = 0
    for c in a:
        out |= 1 << (ord(c) & 63)
    return out


def edits(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; ``most + 1`` if more."""
    if abs(len(a) - len(b)) > most or (letters(a) ^ letters(b)).bit_count() > 2 * most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i]
        for j, e in enumerate(b, 1):
            x = min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != e))
            if before and j > 1 and c == b[j - 2] and a[i - 2] == e:
                x = min(x, before[j - 2] + 1)
            row.append(x)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def phonetic(word: str) -> str:
    """Sound classes of the letters, one vowel class, repeated classes once, without h; ph sounds as f."""
    return re.sub(r"(.)\1+", r"\1", word.replace("ph", "f").replace("h", "").translate(PHONETIC).translate(VOWELS))


def first_sounds(given: str) -> set[str]:
    """First sound of a given name; all that it may have if only its first letter is known (``p*``, ``h*``)."""
    if given in ("p*", "h*"):
        return {"p", "f"} if given == "p*" else {"a"}
    return {phonetic(given.rstrip("*"))[:1]} if given else set()


def _plain(text: str) -> str:
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*", lambda m: m[0].translate(LEET) if re.search(r"\d", m[0]) else m[0], text)


def _split(text: str) -> list[str]:
    text = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text) if not re.search(r"[a-z][A-Z][a-z]*\b.*'", text) else text
    return [w for w in re.findall(r"[^\W_]+", text.lower())]


def _remarks(text: str) -> tuple[str, list[str]]:
    """The name without bracketed and dashed remarks, and the words of the remarks."""
    notes = re.findall(r"[(\[]([^)\]]*)[)\]]", text) + re.findall(r"\s[-–]\s+(\w+)\s*$", text)
    text = re.sub(r"[(\[][^)\]]*[)\]]", " ", text)
    text = re.sub(r"\s[-–]\s+\w+\s*$", " ", text)
    return text, [w for n in notes for w in re.findall(r"[^\W_]+", n.lower())]


def words_of(name: str) -> tuple[list[str], list[str], list[str]]:
    """Words, words of remarks, quoted words."""
    text, notes = _remarks(_plain(name))
    quoted = [w.lower() for w in re.findall(r"[\"“”„]([^\"“”„]+)[\"“”„]", text)]
    return _split(re.sub(r"[\"“”„][^\"“”„]+[\"“”„]", " ", text)), notes, quoted


def placeholder(name: str | None) -> bool:
    return name is None or " ".join(re.findall(r"[^\W_]+", name.lower())) in PLACEHOLDERS


def abbreviates(short: str, word: str) -> bool:
    """Its beginning, or some of its letters in order with the same first one."""
    if len(short) >= len(word) or not short or short[0] != word[0]:
        return False
    if word.startswith(short):
        return len(short) >= 2
    if len(short) > 5 or len(short) < 2:
        return False
    rest = iter(word)
    return all(c in rest for c in short) and len(short) <= len(word) * 0.75


def longer_of(short: str, words: list[str]) -> str | None:
    """The first word that the short one begins, else the first one that it abbreviates otherwise."""
    got = [m for m in words if abbreviates(short, m)]
    return next((m for m in got if m.startswith(short)), got[0] if got else None)


class Reader:
    """Reads names with the given names, nicknames and branch words of a collection."""

    def __init__(self, given: dict[str, int], branch: dict[str, int], nicknames: Iterable[tuple[str, str]]):
        self.nick: dict[str, set[str]] = {}
        for short, full in nicknames:
            if short and full and short != full:
                self.nick.setdefault(short, set()).add(full)
        full = {g for s in self.nick.values() for g in s}
        self.given = {g for g in given if g not in self.nick} | full
        self.known = self.given | set(self.nick)
        self.branch: dict[str, str] = {}
        main: list[str] = []
        for w in sorted(branch, key=lambda w: (-branch[w], w)):
            if len(w) < 2 or w in LEGAL:
                continue
            to = longer_of(w, main)
            if to is None and len(w) >= 5:
                to = next((m for m in main if len(m) >= 5 and edits(w, m, 2) <= (2 if len(w) >= 8 else 1)), None)
            if to is None and len(w) >= 4:
                main.append(w)
            self.branch[w] = to or w
        self.main = main
        self.seen: dict[str, frozenset[str]] = {}
        self.seen_branch: dict[str, str | None] = {}

    def given_names(self, w: str, dotted: bool) -> frozenset[str]:
        """Full given names that a written one may stand for; ``x*`` are all that begin with x, known or not."""
        key = w + "." * dotted
        if key not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[key] = self._given_names(w, dotted)
        return self.seen[key]

    def _given_names(self, w: str, dotted: bool) -> frozenset[str]:
        if len(w) == 1:
            return frozenset([w + "*"])
        if w in self.nick and not (dotted and w not in self.nick):
            return frozenset(self.nick[w])
        if w in self.given:
            return frozenset([w])
        short = self._diminutive(w)
        if short:
            return short | frozenset(g for g in self.given if g.startswith(w))
        if dotted or len(w) <= 3 and any(g.startswith(w) for g in self.given):
            return frozenset([w + "*"])
        for most in (1, 2):
            near = frozenset(g for g in self.given if len(g) > 3 and edits(w, g, most) <= most)
            if near and (most == 1 or len(w) >= 6):
                return near
        near = frozenset(x for n, full in self.nick.items() if len(n) > 3 and edits(w, n, 1) <= 1 for x in full)
        return near or frozenset([w])

    def _diminutive(self, w: str) -> frozenset[str]:
        """What a short name stands for that differs from a known one by y, ie or i at the end, the letter before perhaps doubled (Bob, Bobby)."""
        for end in ("ie", "y", "i"):
            stem = w[: -len(end)]
            if w.endswith(end) and len(stem) >= 2:
                for k in (stem, stem[:-1] if len(stem) > 2 and stem[-1] == stem[-2] else ""):
                    if k in self.nick:
                        return frozenset(self.nick[k])
            for k in (w + end, w + w[-1] + end):
                if len(w) >= 3 and k in self.nick:
                    return frozenset(self.nick[k])
        return frozenset()

    def _like_given(self, w: str) -> bool:
        return any(g in self.given or g.endswith("*") for g in self.given_names(w, False))

    def branch_word(self, w: str) -> str | None:
        if w in self.branch:
            return self.branch[w]
        if w not in self.seen_branch:
            if len(self.seen_branch) > 200_000:
                self.seen_branch.clear()
            got = longer_of(w, self.main) if len(w) <= 6 else None
            if got is None and len(w) >= 4:
                near = [(d, m) for m in self.main if abs(len(m) - len(w)) <= 2 and (d := edits(w, m, 2)) <= (2 if len(w) >= 6 else 1)]
                got = min(near)[1] if near else None
            self.seen_branch[w] = got
        return self.seen_branch[w]

    def read(self, name: str, type_: str | None) -> tuple[str, str, tuple[str, ...]] | None:
        """(nature, root, companions) or None."""
        words, notes, _ = words_of(name)
        nature = TYPES.get((type_ or "").strip().lower())
        if nature is None:
            if any(w in PROJECT for w in words + notes):
                nature = "project"
            else:
                content = [w for w in words if len(w) > 1 and w not in TITLES]
                glued = re.findall(r"[^\W_]+", _plain(name).lower())
                if any(w in LEGAL for w in words + notes) or any(w not in self.known and self.branch_word(w) for w in content if len(w) > 3 or w in self.branch) or any(self._glued(w) for w in glued):
                    nature = "org"
                elif len(content) == 1 and len(words) == 1:
                    nature = "project"
                else:
                    nature = "person"
        return getattr(self, "_" + nature)(name, words)

    def _project(self, name: str, words: list[str]) -> tuple[str, str, tuple[str, ...]] | None:
        rest = [w for w in words if w not in PROJECT and w != "the" and len(w) > 1]
        return ("project", "".join(rest), ()) if rest else None

    def _glued(self, w: str) -> list[str] | None:
        """Root and branch words of a word that holds both."""
        tail: list[str] = []
        while len(w) > 4:
            end = next((m for m in self.main if len(m) >= 4 and w.endswith(m) and len(w) - len(m) >= 4), None)
            if end is None:
                break
            tail.insert(0, end)
            w = w[: -len(end)]
        return [w, *tail] if tail else None

    def _org(self, name: str, words: list[str]) -> tuple[str, str, tuple[str, ...]] | None:
        rest = [w for w in words if w not in LEGAL and len(w) > 1]
        rest = [x for w in rest for x in ((self._glued(w) if len(w) >= 12 and w not in self.branch else None) or [w])]
        if not rest:
            return None
        marks = [self.branch_word(w) for w in rest]
        roots = [w for w, m in zip(rest, marks, strict=True) if m is None]
        if not roots:
            k = min(range(len(rest)), key=lambda i: (rest[i] in self.branch, -len(rest[i])))
            roots, marks[k] = [rest[k]], None
        return "org", "".join(roots), (" ".join(sorted({m for m in marks if m})),)

    def _person(self, name: str, words: list[str]) -> tuple[str, str, tuple[str, ...]] | None:
        text = re.sub(r"[\"“”„][^\"“”„]+[\"“”„]", " ", _remarks(_plain(name))[0]).replace("_", " ")
        if len(re.findall(r"[^\W_]+", text)) == 1:  # given name and surname glued
            text = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text)
            word = text.strip().lower()
            text = next((f"{word[:k]} {word[k:]}" for k in range(len(word) - 5, 4, -1) if word[:k] in self.given), text)
        text = text.lower()
        dotted = set(re.findall(r"([^\W_]+)\.", text))
        left, comma, right = text.partition(",")
        ws = [w for w in re.findall(r"[^\W_]+", text) if w not in TITLES]
        if comma and [w for w in re.findall(r"[^\W_]+", right) if w not in TITLES]:
            last = [w for w in re.findall(r"[^\W_]+", left) if w not in TITLES]
            first = [w for w in re.findall(r"[^\W_]+", right) if w not in TITLES]
        elif len(ws) >= 2:
            known = lambda w: len(w) == 1 or w in self.known or (w in dotted and len(w) <= 4)
            if known(ws[-1]) and not known(ws[0]):
                last, first = ws[:1], ws[1:]
            elif not known(ws[0]) and not known(ws[-1]) and self._like_given(ws[-1]) and not self._like_given(ws[0]):
                last, first = ws[:1], ws[1:]
            else:
                last, first = ws[-1:], ws[:-1]
        else:
            last, first = ws, []
        if not last:
            return None
        longer = [w for w in first if len(w) > 1] or first[:1]
        companions = tuple(sorted(self.given_names(longer[0], longer[0] in dotted))) if longer else ()
        return "person", "".join(last), companions


def _tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of persons and organisations, and quoted nicknames with the word before."""
    for batch in batches:
        out: dict[tuple[str, str, str], int] = {}
        for name, type_ in zip(batch.column("name").to_pylist(), batch.column("type").to_pylist(), strict=True):
            nature = TYPES.get((type_ or "").strip().lower())
            if nature is None or nature == "project" or placeholder(name):
                continue
            words, _, quoted = words_of(name)
            for w in {w for w in words if len(w) > 1 and w not in TITLES and w not in LEGAL}:
                out[nature, w, ""] = out.get((nature, w, ""), 0) + 1
            if nature == "person" and len(quoted) == 1 and words:
                out["nick", quoted[0], words[0]] = out.get(("nick", quoted[0], words[0]), 0) + 1
        if out:
            a, b, c = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), pa.array(list(out.values()), pa.int64())], names=["what", "word", "full", "n"])


def reader_for(records: DataFrame, aliases: DataFrame) -> Reader:
    """Common words by counts over all records; what is collected are words that at
    least 0.6 % of the names of a nature hold, so their number has a bound."""
    counts = records.mapInArrow(_tally, "what string, word string, full string, n long").groupBy("what", "word", "full").agg(F.sum("n").alias("n"))
    counts = cut(counts, "words")
    total = {r["what"]: r["n"] for r in records.groupBy(F.lower(F.trim("type")).alias("what")).agg(F.count("*").alias("n")).where(F.col("what").isin(list(TYPES))).collect()}
    size = {k: sum(n for t, n in total.items() if TYPES[t] == k) for k in ("person", "org")}
    least = {k: max(8, math.ceil(0.006 * n)) for k, n in size.items()}
    common = {k: {r["word"]: r["n"] for r in counts.where((F.col("what") == k) & (F.col("n") >= least[k])).collect()} for k in least}
    table = {(r[0].strip().lower(), r[1].strip().lower()) for r in aliases.select("short_name", "given_name").where("short_name is not null and given_name is not null").collect()}
    full = set(common["person"]) | {f for _, f in table}
    mined = counts.where((F.col("what") == "nick") & (F.col("n") >= max(1, least["person"] // 100)) & F.col("full").isin(list(full))).collect()  # a nickname of a common given name
    return Reader(common["person"], common["org"], table | {(r["word"], r["full"]) for r in mined if r["word"] not in full})


def _read(reader: Reader):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, name, type_ in zip(batch.column("id").to_pylist(), batch.column("name").to_pylist(), batch.column("type").to_pylist(), strict=True):
                form = None if placeholder(name) else reader.read(name, type_)
                if form and form[1]:
                    nature, root, companions = form
                    open_ = nature == "person" and (len(companions) > 1 or any(c.endswith("*") for c in companions))
                    rare = nature == "person" and not open_ and any(c not in reader.known for c in companions)
                    rows.append((id_, name, nature, root, "|".join(companions), open_, rare))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:5]), *(pa.array(c, pa.bool_()) for c in cols[5:])], names=["id", "spelling", "nature", "root", "companions", "open", "rare"])

    return run


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for form, nature, root, companions, open_, breadth in zip(*(batch.column(c).to_pylist() for c in ("form", "nature", "root", "companions", "open", "breadth")), strict=True):
            code = phonetic(root)
            half = 4
            heads = sorted({x for c in companions.split("|") for x in first_sounds(c)}) or [""] if nature == "person" else [" ".join(phonetic(w) for w in companions.split())]
            for part in {"<" + code[:half], ">" + code[-half:]}:
                rows += [(f"{nature}/{h}/{part}", form, root, companions, open_, breadth) for h in heads]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "form", "root", "companions", "open", "breadth"])


def same_root(a: str, b: str, least: float) -> bool:
    if a == b:
        return True
    n = min(len(a), len(b))
    most = 2 if n >= 8 else 1 if n >= 5 else 0
    return abs(len(a) - len(b)) <= most and winkler(a, b) >= least and edits(a, b, most) <= most


def fits(choice: str, given: str) -> bool:
    """Whether one of the given names that an open form leaves is that of another form."""
    return any(given.startswith(c[:-1]) if c.endswith("*") else c == given for c in choice.split("|"))


def slip(a: str, b: str, n: int, m: int) -> bool:
    """Whether one of two rare given names, seen with ``n`` and ``m`` surnames, is a slip of the pen of the other."""
    short = min(len(a), len(b))
    most = 2 if short >= 8 else 1
    return short >= 4 and abs(len(a) - len(b)) <= most and min(n, m) <= max(2, 0.25 * max(n, m)) and edits(a, b, most) <= most


def _pairs(least: float):
    """Accepted pairs of each block; the input comes block by block."""

    def across(xs: list[tuple], ys: list[tuple], open_: bool) -> Iterator[tuple]:
        for f, root, bits in xs:
            for g, other, bits2 in ys:
                if (bits ^ bits2).bit_count() <= 4 and f != g and same_root(root, other, least):
                    yield f, g, open_

    def compare(rows: list[tuple]) -> Iterator[tuple]:
        """Forms meet by their companions, so that what is compared one by one are forms with fitting ones."""
        closed: dict[str, list[tuple]] = {}
        rare: dict[str, int] = {}
        for form, root, comp, open_, n in rows:
            if not open_:
                closed.setdefault(comp, []).append((form, root, letters(root)))
                if n:
                    rare[comp] = n
        for same in closed.values():
            for i, one in enumerate(same):
                yield from across([one], same[i + 1 :], False)
        unusual = sorted(rare)
        for i, c in enumerate(unusual):
            for d in unusual[i + 1 :]:
                if slip(c, d, rare[c], rare[d]):
                    yield from across(closed[c], closed[d], False)
            if 2 <= len(c) <= 3:  # may be cut off
                for d in closed:
                    if d != c and d.startswith(c):
                        yield from across(closed[c], closed[d], True)
        for form, root, comp, open_, _ in rows:
            if open_:
                for d in closed:
                    if fits(comp, d):
                        yield from across([(form, root, letters(root))], closed[d], True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, out = None, [], []
        emit = lambda: pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.bool_())], names=["a", "b", "open"])
        for batch in batches:
            for block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != last:
                    out.extend(compare(rows))
                    last, rows = block, []
                rows.append(tuple(row))
            if len(out) > 50_000:
                yield emit()
                out = []
        out.extend(compare(rows))
        yield emit()

    return run


def entities(records: DataFrame, aliases: DataFrame, *, least: float = 0.9, hot: int = 2000) -> DataFrame:
    """(id, entity, spelling): the entity of every record with a name, the hash of its name; ``entity`` is opaque."""
    spark = records.sparkSession
    rows = records.select("id", "type", "name").where("id is not null and name is not null").distinct().repartition(partitions(spark))  # reading is Python: not in a few small partitions
    reader = reader_for(rows, aliases)
    forms = rows.mapInArrow(_read(reader), "id string, spelling string, nature string, root string, companions string, open boolean, rare boolean")
    forms = cut(forms.withColumn("form", F.xxhash64("nature", "root", "companions")).withColumn("spelling", F.xxhash64("spelling")), "forms")
    distinct = forms.select("form", "nature", "root", "companions", "open", "rare").distinct()
    breadth = distinct.where("rare").groupBy("companions").agg(F.count_distinct("root").alias("breadth")).withColumn("rare", F.lit(True))
    distinct = distinct.join(breadth, ["companions", "rare"], "left").withColumn("breadth", F.coalesce("breadth", F.lit(0)))
    blocks = cut(distinct.mapInArrow(_blocks, "block string, form long, root string, companions string, open boolean, breadth long"), "blocks")
    wide = blocks.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("block", F.ceil(F.col("n") / hot).cast("int").alias("k"))
    cells = blocks.join(F.broadcast(wide) if wide.limit(10_001).count() <= 10_000 else wide, "block", "left").withColumn("mine", F.pmod(F.xxhash64("form"), F.coalesce("k", F.lit(1))).cast("int"))
    every = F.expr("transform(sequence(0, coalesce(k, 1) - 1), x -> concat_ws('#', block, least(x, mine), greatest(x, mine)))")  # a part of a wide block meets each other part
    cells = cells.select(F.explode(every).alias("block"), "form", "root", "companions", "open", "breadth")
    parts = partitions(spark)
    near = cells.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_pairs(least), "a long, b long, open boolean").distinct()
    near = cut(near, "pairs")
    comp = connected_components(near.where("not open"))
    sure = forms.where("not open").select("form").distinct().join(comp, F.col("form") == F.col("node"), "left").select("form", F.coalesce("component", "form").alias("entity"))
    sure = cut(sure, "sure")
    choice = cut(near.where("open").select(F.col("a").alias("form"), F.col("b").alias("to")), "choices")

    def only(of: DataFrame) -> DataFrame:
        fit = of.join(sure.select(F.col("form").alias("to"), "entity"), "to").groupBy("form").agg(F.min("entity").alias("entity"), F.max("entity").alias("most"))
        return fit.where("entity = most").select("form", "entity")

    moved = only(choice.join(sure.select("form"), "form", "left_semi"))  # rare given names that may be cut off
    sure = cut(moved.union(sure.join(moved, "form", "left_anti")), "moved")
    named = sure.union(only(choice.join(sure.select("form"), "form", "left_anti")))
    return forms.join(named, "form", "left").select("id", F.coalesce("entity", "form").alias("entity"), "spelling").distinct()


def linked_pairs(found: DataFrame, expand: int = 200) -> DataFrame:
    """(id_a, id_b): all pairs of an entity; of more than ``expand`` records with an equal name
    only the first is paired with the other names, and with each of its copies."""
    copies = found.groupBy("entity", "spelling").agg(F.count_distinct("id").alias("n"), F.min("id").alias("first"))
    rows = cut(found.join(copies, ["entity", "spelling"]), "members")
    standing = rows.where((F.col("n") <= expand) | (F.col("id") == F.col("first"))).select("entity", "id").distinct()
    size = standing.groupBy("entity").agg(F.count("*").alias("size")).where("size > 1").withColumn("k", F.ceil(F.col("size") / 2000).cast("int"))
    standing = cut(standing.join(size, "entity"), "standing")
    left = standing.select("entity", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("part"), F.col("id").alias("id_a"))  # a large entity is joined in parts
    right = standing.select("entity", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), F.col("id").alias("id_b"))
    pairs = left.join(right, ["entity", "part"]).select("id_a", "id_b")
    star = rows.where(F.col("n") > expand).select(F.col("first").alias("id_a"), F.col("id").alias("id_b"))
    return pairs.union(star).where("id_a < id_b").distinct()
