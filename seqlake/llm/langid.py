"""Language identification: script ranges narrow the candidates, then Viterbi over
per-word scores with a switching penalty labels spans of mixed-language text.

A word is a run of letters and the combining marks that follow them. Its score for a language is the sum of smoothed log
probabilities of its hashed letter pairs and triples, word ends included. Only
languages that use the word's script are candidates. The best path pays
SWITCH for every change of language; the text's language is that of most
letters on the path and its share is the score.

The model is fitted on a bounded sample: of every language, documents are taken
by the hash of their ids at the rate that gives SAMPLE of them, whole texts.
Everything else covers all rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship
from .common import chunks, with_columns

#: Documents of each language that the model is fitted on, on average.
SAMPLE = 1500
SWITCH, ALPHA = 12.0, 0.2
#: A language uses a script from this share of its letters on.
USES = 0.005
PAIRS, TRIPLES = 1 << 13, 1 << 15
SPACE = PAIRS + TRIPLES
UNKNOWN = "und"
#: Words in a block of the Viterbi pass; blocks run side by side.
BLOCK = 64

# Unicode script ranges.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x2FA1F),
]
_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]


@dataclass
class _Letters:
    lower: np.ndarray  # a letter's lower-case code point, a combining mark's own, 0 for anything else
    mark: np.ndarray
    script: np.ndarray


_letters: _Letters | None = None


def letters() -> _Letters:
    """Tables over all code points, made once in a process."""
    global _letters
    if _letters is None:
        lower = np.zeros(0x110000, np.uint32)
        script = np.zeros(0x110000, np.uint8)
        mark = np.zeros(0x110000, bool)
        for i in range(0x110000):
            c = chr(i)
            if unicodedata.category(c)[0] == "M":
                lower[i], mark[i] = i, True
            elif c.isalpha():
                low = c.lower()
                lower[i] = ord(low) if len(low) == 1 else i
        for name, a, b in SCRIPTS:
            script[a : b + 1] = _NAMES.index(name)
        _letters = _Letters(lower, mark, script)
    return _letters


@dataclass
class Words:
    """Words of some texts, put together: features of each position, and where words begin."""

    pairs: np.ndarray
    triples: np.ndarray
    start: np.ndarray  # of each word, in positions
    doc: np.ndarray  # of each word
    length: np.ndarray  # letters of each word
    script: np.ndarray


def words_of(texts: list[str]) -> Words | None:
    """None if there is no letter."""
    joined = " ".join(texts) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    tables = letters()
    c = tables.lower[code]
    marks = tables.mark[code]
    if marks.any():
        # A mark belongs to a word if what stands before it and other marks is a letter.
        solid = np.maximum.accumulate(np.where(marks, 0, np.arange(len(code))))
        c = np.where(marks & ((c[solid] == 0) | marks[solid]), 0, c)
    inside = c != 0
    before = np.r_[False, inside[:-1]]
    start = np.flatnonzero(inside & ~before)
    if not len(start):
        return None
    end = np.flatnonzero(~inside & before)
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    doc = np.searchsorted(np.cumsum(lens), start, "right")
    keep = inside | before
    at = np.flatnonzero(keep)
    c = c.astype(np.uint64)
    p1 = np.r_[np.uint64(0), c[:-1]]
    p2 = np.where(p1 == 0, np.uint64(0), np.r_[np.uint64(0), np.uint64(0), c[:-2]])
    c, p1, p2 = c[at], p1[at], p2[at]
    pair = p1 * np.uint64(0x9E3779B97F4A7C15) + c * np.uint64(0xC2B2AE3D27D4EB4F)
    triple = pair * np.uint64(0x165667B19E3779F9) + p2 * np.uint64(0x27D4EB2F165667C5)
    pairs = (pair >> np.uint64(64 - 13)).astype(np.int32)
    triples = (triple >> np.uint64(64 - 15)).astype(np.int32)
    return Words(pairs, triples, np.searchsorted(at, start), doc, end - start, tables.script[code[start]])


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # [language, SPACE], float32, less the mean of the languages
    candidate: np.ndarray  # [script, language], bool


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        by: dict[str, list[str]] = {}
        for lang, text in zip(langs, texts):
            by.setdefault(lang, []).append(text)
        for lang, own in by.items():
            total = seen.setdefault(lang, np.zeros(SPACE + len(_NAMES), np.int64))
            for i, j in chunks(np.fromiter(map(len, own), np.int64, len(own))):
                if w := words_of(own[i:j]):
                    total[:PAIRS] += np.bincount(w.pairs, minlength=PAIRS)
                    total[PAIRS:SPACE] += np.bincount(w.triples, minlength=TRIPLES)
                    total[SPACE:] += np.bincount(w.script, w.length, len(_NAMES)).astype(np.int64)
    for lang, total in seen.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], names=["lang", "k", "n"])


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on rows with text, lang and an id that isn't held out. Without such rows there are no languages."""
    ship(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # A row for each language.
    rate = known.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("rate"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(rate), "lang").where(place < F.col("rate"))
    counts = texts.select("lang", "text").mapInArrow(_fit_batches, "lang string, k int, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow()
    lang = np.array(counts.column("lang").to_pylist(), object)
    k, n = counts.column("k").to_numpy(), counts.column("n").to_numpy()
    langs = sorted(set(lang))
    total = np.zeros((len(langs), SPACE + len(_NAMES)))
    for i, name in enumerate(langs):
        own = lang == name
        total[i, k[own]] = n[own]
    logp = np.zeros((len(langs), SPACE))
    for a, b in ((0, PAIRS), (PAIRS, SPACE)):
        part = total[:, a:b] + ALPHA
        logp[:, a:b] = np.log(part / part.sum(axis=1, keepdims=True))
    if langs:
        logp -= logp.mean(axis=0)
    used = total[:, SPACE:] / np.maximum(total[:, SPACE:].sum(axis=1, keepdims=True), 1)
    candidate = (used >= USES).T
    candidate[~candidate.any(axis=1)] = True  # a script that no language is known to use
    return Model(langs, (logp * 0.5).astype(np.float32), candidate)


def word_scores(model: Model, w: Words) -> np.ndarray:
    """[language, word]; a language that doesn't use the word's script gets a prohibitive score."""
    out = np.empty((len(model.langs), len(w.start)), np.float32)
    for i, table in enumerate(model.logp):
        out[i] = np.add.reduceat(table[w.pairs] + table[PAIRS:][w.triples], w.start)
    out[~model.candidate[w.script].T] = -1e4
    return out


def viterbi(scores: np.ndarray, doc: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language index of each word on its text's best path; ties go to the smaller index.

    Texts are cut into blocks of BLOCK words. All blocks run at once: first the
    best score from each language at a block's begin to each at its end, then
    the blocks of a text in turn, then each block again from its known begin.
    """
    n_lang, n = scores.shape
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    count = np.diff(np.r_[first, n])
    blocks = -(-count // BLOCK)
    of = np.repeat(np.arange(len(first)), blocks)
    lead = np.cumsum(blocks) - blocks
    turn = np.arange(len(of)) - lead[of]
    begin = first[of] + turn * BLOCK
    size = np.minimum(BLOCK, first[of] + count[of] - begin)
    at = np.minimum(begin[None, :] + np.arange(BLOCK)[:, None], n - 1)
    real = np.arange(BLOCK)[:, None] < size[None, :]
    step = np.where(real[None], scores[:, at], np.float32(0))  # [language, BLOCK, block]
    nb = len(of)
    stay = np.float32(switch)
    through = np.full((n_lang, n_lang, nb), -stay, np.float32)
    for s in range(n_lang):
        through[s, s] = 0
    for t in range(BLOCK):
        if t:
            np.maximum(through, through.max(axis=1, keepdims=True) - stay, out=through)
        through += step[None, :, t]
    # A block's begin language, from the best paths into it.
    enter = np.zeros((n_lang, nb), np.float32)
    order = np.argsort(turn, kind="stable")
    edges = np.searchsorted(turn[order], np.arange(turn.max() + 2))
    carry = np.zeros((n_lang, len(first)), np.float32)
    for k in range(len(edges) - 1):
        own = order[edges[k] : edges[k + 1]]
        text = of[own]
        enter[:, own] = carry[:, text]
        best = (carry[:, None, text] + through[:, :, own]).max(axis=0)
        carry[:, text] = best - best.max(axis=0)
    # Forward inside the blocks with what entered, then back from the last block of each text.
    back = np.zeros((BLOCK, n_lang, nb), np.int32)
    now = enter
    own_lang = np.arange(n_lang, dtype=np.int32)[:, None]
    for t in range(BLOCK):
        top = now.argmax(axis=0).astype(np.int32)
        jump = now.max(axis=0) - stay
        move = (jump > now) & real[t]
        back[t] = np.where(move, top, own_lang)
        now = np.where(move, jump, now) + step[:, t]
    path = np.zeros((BLOCK, nb), np.int32)
    final = now.argmax(axis=0)
    after = np.zeros(len(first), np.int64)
    for k in range(len(edges) - 2, -1, -1):
        own = order[edges[k] : edges[k + 1]]
        text = of[own]
        last = turn[own] == blocks[text] - 1
        lang = np.where(last, final[own], after[text])
        for t in range(BLOCK - 1, -1, -1):
            path[t, own] = lang
            lang = back[t, lang, own]
        after[text] = lang
    return path.T[real.T].astype(np.int64)


def label(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[list[tuple[int, int, int]]]]:
    """For each text its language, its score, and its spans (first word, end word, language index)."""
    langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not model.langs:
        return langs, score, spans
    own = [t or "" for t in texts]
    for i, j in chunks(np.fromiter(map(len, own), np.int64, len(own))):
        if not (w := words_of(own[i:j])):
            continue
        path = viterbi(word_scores(model, w), w.doc)
        by = np.bincount(w.doc * len(model.langs) + path, w.length, (j - i) * len(model.langs)).reshape(j - i, -1)
        total = by.sum(axis=1)
        for d in np.flatnonzero(total):
            k = int(by[d].argmax())
            langs[i + d], score[i + d] = model.langs[k], by[d, k] / total[d]
        cut = np.flatnonzero(np.r_[True, (w.doc[1:] != w.doc[:-1]) | (path[1:] != path[:-1])])
        lead = np.searchsorted(w.doc, w.doc[cut])
        for a, b, d, f in zip(cut, np.r_[cut[1:], len(path)], w.doc[cut], lead):
            spans[i + d].append((int(a - f), int(b - f), int(path[a])))
    return langs, score, spans


def identify(docs: DataFrame, model: Model, keep: bool = True) -> DataFrame:
    """docs with lang_pred, lang_score and lang_spans (first word, word after the last, language) added; no shuffle. keep=False leaves the text out.

    `und` with score 0 and no spans for a null text, one without letters, or a
    model without languages.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # as large as SPACE times the languages

    def make(texts: pa.Array) -> dict[str, pa.Array]:
        m = held.value
        langs, score, spans = label(m, texts.to_pylist())
        kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))
        rows = [[{"first": a, "stop": b, "lang": m.langs[k]} for a, b, k in x] for x in spans]
        return {"lang_pred": pa.array(langs, pa.string()), "lang_score": pa.array(score), "lang_spans": pa.array(rows, kind)}

    return with_columns(docs, make, "text", "lang_pred string, lang_score double, lang_spans array<struct<first:int,stop:int,lang:string>>", keep)


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans for every row, repeated rows and null ids included."""
    model = fit(docs)
    found = identify(docs.select("doc_id", "text"), model, keep=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").alias("n_spans"))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without those of no known language, or of none for at least `least` of their letters.

    Null and empty texts, and texts without letters, go. Repeated rows stay or
    go together; ids may be null. A score equal to `least` stays. An empty table
    stays empty; without learned languages everything goes. Other columns are
    kept as they are.
    """
    names = docs.columns
    inner = docs.toDF(*[f"_{i}" if n != "text" else n for i, n in enumerate(names)])
    found = identify(inner, fit(docs)).where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least))
    return found.select(*[F.col(f"_{i}" if n != "text" else n).alias(n) for i, n in enumerate(names)])
