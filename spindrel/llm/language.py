"""Languages of documents and of their segments: string kernels with Nyström landmarks.

Two sentences are as alike as the share of character n-grams (n = 1 to 4,
with word borders) that both hold: k(x, z) = |G(x) & G(z)| / sqrt(|G(x)| |G(z)|),
the normalised blended-spectrum presence kernel, n-grams hashed to ``dims``
slots. Kernel ridge regression, one language against the rest, is solved on
landmark sentences. As the kernel is a product of presence vectors, all
landmarks and weights fold into one matrix of slots by languages, and a batch
of sentences is scored by one product with it.

The model is fitted on a bounded sample: ``per_language`` sentences of as many
documents labelled with each language, the first by hash. Labels may be wrong and
documents mixed, so sentences that the fit itself gives to another language
are moved there, and the fit is repeated.

Code, links, markup, names (capitalised words within a sentence) and quoted
phrases of up to six words don't count. The main language has the most letters of
the document; a further one needs a whole sentence of ``also_letters`` letters,
names included (twice as many without an end mark), that it wins by ``margin``. Shorter or unclear sentences go with the ones before them.

Defined results: every row of the input gives one row; null, empty and symbol-only texts
have no language, confidence 0 and no segments; a label in any known
notation counts as its language, all others as missing; whole texts are read; other columns are not.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGS = ("de", "en", "es", "fr", "it", "nl", "pt", "ru", "sv")
#: Notations of the nine languages.
NOTATIONS = {
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand"),
    "en": ("en", "eng", "english", "englisch", "anglais"),
    "es": ("es", "spa", "esp", "spanish", "español", "espanol", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "ru": ("ru", "rus", "russian", "русский"),
    "sv": ("sv", "swe", "swedish", "svenska"),
}
OF_LABEL = {n: lang for lang, names in NOTATIONS.items() for n in names}

#: What is no prose, in the order in which it is tried, each with the characters of which it needs one (any text may hold the others).
NO_PROSE = (
    ("", r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`|<(?:script|style|code|pre)\b.*?</(?:script|style|code|pre)\s*>|<!--.*?-->|</?[A-Za-z][^<>\n]*>"),
    ("", r"(?:https?|ftp)://\S+|www\.\S+"),
    ("@", r"[\w.+-]+@[\w-]+\.\S+"),
    ("", r"&#?\w+;|\]\([^)\s]*\)"),
    ("\\/_", r"[\w./\\-]*[\\/_]\w[\w./\\-]*"),
    ("(", r"\w+\([^)\n]*\)"),
    ("", r"[\"“„«][^\"“”„«»\n]{1,60}[\"”“»]"),
    ("", r"^[ \t]*(?:def|import|from|return|class|const|let|var|SELECT|select|function|public|private|for|if|while)\b.*[({=;:].*$|^.*[;{}]\s*$"),
)
#: Without any of these nothing is masked.
MAY_MASK = re.compile(r"[`~<@&/\\_(\"“„«{};]|www\.|^[ \t]*(?:def|import|from|return|class|const|let|var|SELECT|select|function|public|private|for|if|while)\b", re.M)
BREAK = re.compile(r"(?=[.!?…])(?<!\b[A-ZА-Я])(?<!\bMr)(?<!\bMrs)(?<!\bMs)(?<!\bDr)(?<!\bProf)(?<!\bEng)[.!?…]+[\"”»)]*(?=\s|$)|\n+")
LETTER = re.compile(r"[^\W\d_]")
END = re.compile(r"[.!?…]+[\"”»)]*\s*$")
NOT_LETTER = re.compile(r"[\W\d_]+")
NAME = re.compile(r"(?<=\S)(\s+)[A-ZÀ-ÖØ-ÞА-Я][\w’'-]*")


def language_of(label: str | None) -> str | None:
    return OF_LABEL.get(re.split(r"[-_ ]", (label or "").strip().lower())[0])


def label_language(label: Column) -> Column:
    """The same as a column expression."""
    first = F.split(F.lower(F.trim(label)), "[-_ ]")[0]
    known = F.create_map(*[F.lit(x) for pair in OF_LABEL.items() for x in pair])
    return F.try_element_at(known, first)


def _mask(m: re.Match) -> str:
    found = m[0]
    if found[0] in "\"“„«" and len(found.split()) > 6:
        return found
    return re.sub(r"[^\n]", " ", found)


@cache
def _masked(needed: tuple[bool, ...]) -> re.Pattern:
    return re.compile("|".join(p for (_, p), n in zip(NO_PROSE, needed, strict=True) if n), re.S | re.M)


def _prose(text: str) -> str:
    """The text with blanks for what is no prose."""
    if not MAY_MASK.search(text):
        return text
    return _masked(tuple(not chars or any(c in text for c in chars) for chars, _ in NO_PROSE)).sub(_mask, text)


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """(begin, end, what counts of it, letters of all of it) of each sentence; without an end mark (a heading) half its letters."""
    plain = _prose(text)
    out, at = [], 0
    for m in [*BREAK.finditer(plain), None]:
        end = m.end() if m else len(plain)
        part = plain[at:end]
        if LETTER.search(part):
            kept = part.strip(" \t\r\n#*->|=•")
            shown = kept if kept.isupper() else NAME.sub(r"\1", kept)
            whole = NOT_LETTER.sub(" ", kept.lower()).strip()
            shown = whole if shown == kept else NOT_LETTER.sub(" ", shown.lower()).strip()
            letters = len(whole) - whole.count(" ")
            if len(shown) - shown.count(" ") < 0.3 * letters:
                shown = whole
            out.append((at, end, shown, letters if END.search(part) else letters // 2))
        at = end
    return out


def grams(texts: list[str], dims: int, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Rows and slots of the distinct n-grams of each text, ordered by row; fewer than 2**31 / dims texts."""
    joined = "".join(f" {t} " for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in texts])
    keys = []
    h = np.zeros(len(code), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, most + 1):
            h = h[: len(code) - n + 1] * np.uint64(1_000_003) + code[n - 1 :] + np.uint64(1)
            if not len(h):
                break
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            ok = row[: len(h)] == row[n - 1 :]
            keys.append(row[: len(h)][ok] * np.int32(dims) + ((mixed[ok] >> np.uint64(40)) % np.uint64(dims)).astype(np.int32))
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int32)
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return key // np.int32(dims), key % np.int32(dims)


class Model:
    """Folded landmark weights: slots by languages."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(LANGS)), np.float32)
        for a in range(0, len(texts), 1000):
            part = texts[a : a + 1000]
            row, slot = grams(part, len(self.weights))
            starts = np.searchsorted(row, np.arange(len(part)))
            n = np.diff(np.r_[starts, len(row)])
            ok = n > 0
            if ok.any():
                total = np.add.reduceat(self.weights[slot], starts[ok], axis=0)
                out[a : a + 1000][ok] = total / np.sqrt(n[ok, None]) + self.bias
        return out


def fit_sentences(texts: list[str], labels: np.ndarray, *, dims: int = 1 << 15, landmarks: int = 900, ridge: float = 0.3, rounds: int = 3, seed: int = 5) -> Model:
    """Nyström kernel ridge regression of labelled sentences."""
    rng = np.random.default_rng(seed)
    marks = np.sort(rng.permutation(len(texts))[:landmarks])
    row, slot = grams(texts, dims)
    n = np.bincount(row, minlength=len(texts)).astype(np.float32)
    x = np.zeros((len(texts), dims), np.uint8)
    x[row, slot] = 1
    z = x[marks].astype(np.float32) / np.sqrt(np.maximum(n[marks], 1))[:, None]
    k = np.concatenate([x[a : a + 1000].astype(np.float32) @ z.T for a in range(0, len(texts), 1000)]) / np.sqrt(np.maximum(n, 1))[:, None]
    kzz = k[marks]
    gram = k.T @ k + ridge * kzz + 1e-4 * np.eye(len(marks), dtype=np.float32)
    y = labels.copy()
    for _ in range(rounds):
        target = np.where(y[:, None] == np.arange(len(LANGS)), 1.0, -1.0).astype(np.float32)
        bias = target.mean(axis=0)
        alpha = np.linalg.solve(gram.astype(np.float64), (k.T @ (target - bias)).astype(np.float64)).astype(np.float32)
        y = (k @ alpha + bias).argmax(axis=1)
    return Model((z.T @ alpha).astype(np.float32), bias.astype(np.float32))


def _sample():
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, lang, h in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), batch.column("h").to_pylist(), strict=True):
                for i, (_, _, s, _) in enumerate(sentences(text)):
                    if 30 <= len(s) <= 400:
                        rows.append((lang, s, hash((h, i)) & 0x7FFFFFFF))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "s", "r"])

    return run


def fit(df: DataFrame, *, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", per_language: int = 700, **how) -> Model | None:
    """Model of a bounded sample of labelled sentences; None if there are none."""
    rows = df.select(F.col(text_col).alias("text"), label_language(F.col(label_col)).alias("lang"), F.xxhash64(id_col).alias("h")).where("length(text) > 0 and lang is not null")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    drawn = rows.select("lang", "h").withColumn("n", first).where(F.col("n") <= per_language).select("h").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("r", "s"))
    got = rows.join(F.broadcast(drawn), "h", "left_semi").mapInArrow(_sample(), "lang string, s string, r long")  # drawn: at most per_language documents a language
    got = got.withColumn("n", rank).where(F.col("n") <= per_language).select("lang", "s").collect()
    if not got:
        return None
    got = sorted((r["lang"], r["s"]) for r in got)
    return fit_sentences([s for _, s in got], np.array([LANGS.index(lang) for lang, _ in got]), **how)


def judge(spans: list[tuple[int, int, str, int]], scores: np.ndarray, also_letters: int, margin: float) -> tuple[str, float, list[str], list[dict]]:
    """Main language, its confidence, further languages and segments of a document."""
    order = np.argsort(-scores, axis=1)
    lead = np.take_along_axis(scores, order[:, :1], axis=1)[:, 0] - np.take_along_axis(scores, order[:, 1:2], axis=1)[:, 0]
    letters = np.array([len(s) - s.count(" ") for _, _, s, _ in spans])
    sure = (np.array([n for *_, n in spans]) >= also_letters) & (lead >= margin)
    mass = np.zeros(len(LANGS))
    np.add.at(mass, order[:, 0], letters * np.maximum(lead, 0.02))
    best = order[:, 0].copy()
    first = int(np.argmax(mass))
    for i in range(len(spans)):
        if not sure[i]:
            best[i] = best[i - 1] if i else first
    mass = np.zeros(len(LANGS))
    np.add.at(mass, best, letters)
    main = int(np.argmax(mass))
    p = np.exp(4 * scores - (4 * scores).max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    weight = letters[best == main]
    confidence = float((p[best == main, main] * weight).sum() / max(weight.sum(), 1))
    also = sorted({LANGS[b] for b, ok in zip(best, sure, strict=True) if ok and b != main})
    segments: list[dict] = []
    for (begin, end, *_), b, q in zip(spans, best, p, strict=True):
        if segments and segments[-1]["lang"] == LANGS[b]:
            segments[-1]["until"] = end
            segments[-1]["_q"].append(float(q[b]))
        else:
            segments.append({"begin": begin, "until": end, "lang": LANGS[b], "_q": [float(q[b])]})
    for s in segments:
        s["confidence"] = float(np.mean(s.pop("_q")))
    return LANGS[main], confidence, also, segments


_OUT = pa.schema(
    [
        ("id", pa.int64()), ("letters", pa.int64()), ("main", pa.string()), ("confidence", pa.float64()), ("also", pa.list_(pa.string())),
        ("segments", pa.list_(pa.struct([("begin", pa.int32()), ("until", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))),
    ]
)


def _identify(model: Model | None, also_letters: int, margin: float, id_type: pa.DataType | None = None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column("text").to_pylist()
                spans = [sentences(t) if t and model else [] for t in texts]
                scores = model.scores([s for x in spans for _, _, s, _ in x]) if model else np.zeros((0, len(LANGS)))
                out, k = [], 0
                for t, x in zip(texts, spans, strict=True):
                    n = len(NOT_LETTER.sub("", t)) if t else 0
                    out.append((n, *(judge(x, scores[k : k + len(x)], also_letters, margin) if x else (None, 0.0, [], []))))
                    k += len(x)
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, f.type) for c, f in zip(cols, list(_OUT)[1:], strict=True))], names=_OUT.names)

    return run


def identify(df: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", also_letters: int = 8, margin: float = 0.35) -> DataFrame:
    """(id, label, letters, main, confidence, also, segments): one row for each row of ``df``."""
    rows = df.select(F.struct(F.col(id_col).alias("id"), F.col(label_col).alias("label")).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, letters long, main string, confidence double, also array<string>, segments array<struct<begin: int, until: int, lang: string, confidence: double>>"
    out = rows.mapInArrow(_identify(model, also_letters, margin), schema)
    return out.select(F.col("id.id").alias(id_col), F.col("id.label").alias("label"), "letters", "main", "confidence", "also", "segments")


def wrong_or_further(found: DataFrame, id_col: str = "doc_id", least_letters: int = 40) -> DataFrame:
    """(id, role, lang): main languages that the label misses, and further languages."""
    told = label_language(F.col("label"))
    case = lambda role, lang: F.struct(F.lit(role).alias("role"), lang.alias("lang"))
    main = F.when(told.isNull() | (told != F.col("main")), F.array(case("main", F.col("main")))).otherwise(F.array().cast("array<struct<role:string,lang:string>>"))
    rows = found.where((F.col("letters") >= least_letters) & F.col("main").isNotNull())
    return rows.select(id_col, F.inline(F.concat(main, F.transform("also", lambda x: case("also", x))))).distinct()
