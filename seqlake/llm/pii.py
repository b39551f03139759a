"""Personal data: generators, boosted trees and calibrated thresholds, in DataFrame operations only.

Base spans come from four patterns and their checks and always stay. Wider
generators propose more candidates, overlapping ones included: digit groups of
any format, single runs of 14 to 19 digits (base takes a card and the number
next to it for one, which fails), whatever stands around an @, and mail
addresses written with (at) and (dot). Boosted regression trees score a
candidate from its format and context. They are fitted here, by weak labels
from evidence: a candidate is personal data if it lies on a base span (a
pattern with a check: plus sign, checksum, byte values) or if a word before it
says so and its digits fit (`phone`, `card`, `host`); all others aren't.
Addresses in words, runs right beside other digits, and groups of 10 to 15
digits with brackets or mixed marks but no plus have no label, as nothing
vouches for or against them; they are scored by the features that they share
with the others. A leading + is no feature, and the card checksum is one of single
runs only, so that the trees learn what other numbers look like and where they
stand. All features are small integers, so the corpus's candidates come to the
driver as counts of feature vectors, bounded by the features' values and not by
the corpus. Half of the documents, by a hash of id and text, fit the trees; the
other half calibrates, for each kind, the lowest score from which on PRECISION
of the candidates are personal data. A kind's precision is drawn towards that of
all kinds by PRIOR candidates, so that rare kinds need no rule of their own.

Positions are counted in code points: a text is split by the pattern, and the
lengths of the parts and matches before it are a match's place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle

KINDS = ["email", "ip", "card", "phone"]
PRECISION = 0.95
ROUNDS, DEPTH, RATE = 24, 3, 0.3
#: Documents and spans that are broadcast at most to the texts that they are of; more are shuffled.
FETCHED = 1 << 20
#: Candidates' worth of the precision of all kinds in that of one.
PRIOR = 20

# The base patterns, written so that no text makes them slow: a
# repetition never gives back, and a match begins at its run's begin or where the last one ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: The wider generators: groups of digits, single runs of them, what stands around an @, and mail addresses in words.
DIGITS = r"[0-9](?:[\x20().-]{0,2}[0-9])++"
RUN = r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])"
MAIL = r"[A-Za-z0-9._%+-]{1,64}\x20?@\x20?[A-Za-z0-9-]{1,64}(?:\.[A-Za-z0-9-]{1,64})*+"
SPELLED_AT, SPELLED_DOT = r"\x20?[\[(](?:at|AT)[\])]\x20?", r"\x20?[\[(](?:dot|DOT)[\])]\x20?"
SPELLED = rf"[A-Za-z0-9._%+-]{{1,64}}{SPELLED_AT}[A-Za-z0-9-]{{1,64}}(?:(?:\.|{SPELLED_DOT})[A-Za-z0-9-]{{1,64}})++"
#: Places of the generators among all; FORM: what the trees are told of it.
WIDE, AROUND_AT, ONE_RUN, IN_WORDS = 4, 5, 6, 7
FORM = [0, 1, 2, 1]
#: Words before a number that say what it is.
CUES = [r"(?i)(?:phone|tel|call|mobile|fax|telefon|whatsapp)\W*$", r"(?i)(?:card|visa|amex|mastercard|credit|carte|karte|tarjeta)\W*$", r"(?i)(?:\bip|addr|address|host|server)\W*$"]


def _luhn(match: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(match, "[^0-9]", "")), "")
    place = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(place, F.lit(0), lambda a, b: a + b) % 10 == 0


def _digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", ""))


def _matches(text: Column, worth: Column, pattern: str, kind: int) -> Column:
    """Array of (kind, match, gap: length of the part before, tail, head: what stands around)."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.transform(
        F.arrays_zip(parts.alias("p"), found.alias("m"), F.slice(parts, F.lit(2), F.size(parts)).alias("q")),
        lambda x: F.struct(
            F.lit(kind).alias("kind"), x["m"].alias("m"), F.length(x["p"]).alias("gap"),
            F.substring(x["p"], F.greatest(F.lit(1), F.length(x["p"]) - 23), F.lit(24)).alias("tail"), F.substring(x["q"], 1, 2).alias("head"),
        ),
    )
    return F.when(worth, F.filter(rows, lambda x: x["m"].isNotNull()))


def _signs(text: Column) -> tuple[Column, Column, Column]:
    """Digits, an @ and an (at): without any of them no generator finds anything."""
    return F.regexp_like(text, F.lit("[0-9]")), F.contains(text, F.lit("@")), F.regexp_like(text, F.lit(r"[\[(](?:at|AT)[\])]"))


def proposals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, candidates): rows (row, doc_id, hash) of docs, and every generator's matches with their places."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digit, at, spelled = _signs(text)
    generators = [(EMAIL, at), (IP, digit), (CARD, digit), (PHONE, F.contains(text, F.lit("+")) & digit), (DIGITS, digit), (MAIL, at), (RUN, digit), (SPELLED, spelled)]
    none = F.array().cast("array<struct<kind:int,m:string,gap:int,tail:string,head:string>>")
    every = F.concat(*[F.coalesce(_matches(text, worth, p, k), none) for k, (p, worth) in enumerate(generators)])
    rows = settle(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("hash"), every.alias("found")))
    fits = (F.xxhash64("doc_id", "hash", F.lit(9)) % 2 == 0).alias("fits")
    one = rows.where(F.size("found") > 0).select("row", fits, F.posexplode("found").alias("i", "x")).select("row", "fits", "i", "x.*")
    run = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("m")).over(run.rowsBetween(Window.unboundedPreceding, 0))
    one = one.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.length("m")).cast("int"))
    n, m = _digits(F.col("m")), F.col("m")
    # `when` keeps the checks from matches that are too long for them.
    good = (
        F.when(F.col("kind") == 0, True)
        .when(F.col("kind") == 1, F.regexp_like(m, F.lit(f"^{BYTE}(?:\\.{BYTE}){{3}}$")))
        .when(F.col("kind") == 2, F.when(n.between(14, 19), _luhn(m)).otherwise(False))
        .when(F.col("kind") == 3, n.between(10, 15))
        .otherwise(False)
    )
    return rows.drop("found"), settle(one.withColumn("base", good).where(F.col("base") | (F.col("kind") >= WIDE)))


#: Feature columns of a candidate; all are small non-negative integers.
FEATURES = ["f_form", "f_digits", "f_marks", "f_groups", "f_first", "f_cue", "f_before", "f_after", "f_check"]
EXTRA = ["labelled", "doubtful", "evident", "fits"]


def _side(c: Column) -> Column:
    return F.when(c.rlike(r"^[0-9]"), 3).when(c.rlike(r"^[A-Za-z\x{80}-\x{10FFFF}]"), 2).when(c.rlike(r"^\s"), 1).otherwise(F.when(c == "", 0).otherwise(4))


def features(wide: DataFrame) -> DataFrame:
    """wide with FEATURES, evident: whether a word before it says what it is, labelled: whether anything could vouch for it, and doubtful: whether nothing speaks against it either, unless base has it."""
    m = F.col("m")
    bare = F.regexp_replace(m, "[0-9]", "")
    marks = F.when(bare == "", 0).when(F.translate(bare, " ", "") == "", 1).when(F.translate(bare, "-", "") == "", 2).when(F.translate(bare, ".", "") == "", 3).otherwise(F.when(F.contains(bare, F.lit("(")) | F.contains(bare, F.lit(")")), 5).otherwise(4))
    groups = F.split(m, "[^0-9]+")
    cue = F.lit(0)
    for k, pattern in reversed(list(enumerate(CUES))):
        cue = F.when(F.regexp_like("tail", F.lit(pattern)), k + 1).otherwise(cue)
    # Of a mail address: the parts of its host and the length of the last, as if it were written with an @.
    mail = F.col("kind").isin(AROUND_AT, IN_WORDS)
    host = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, SPELLED_AT, "@"), SPELLED_DOT, "."), r"^[^@]*@\x20?", ""), r"\.")
    joined = F.regexp_like("tail", F.lit(r"(?:^|[0-9])[\x20-]?$")) | F.regexp_like("head", F.lit(r"^[\x20-]?(?:[0-9]|$)"))
    said, n = F.col("kind") == WIDE, _digits(m)
    evident = said & ((cue == 1) & n.between(7, 15) | (cue == 2) & n.between(14, 19) | (cue == 3) & (marks == 3) & (F.size(groups) == 4) & (n <= 12))
    return wide.withColumns({
        "evident": evident,
        "labelled": (F.col("kind") != IN_WORDS) & ~((F.col("kind") == ONE_RUN) & joined),
        "doubtful": said & ~evident & n.between(10, 15) & (marks >= 4) & (F.size(groups) >= 3),
        "f_form": F.element_at(F.array(*[F.lit(v) for v in FORM]), F.col("kind") - WIDE + 1),
        "f_digits": F.when(mail, 0).otherwise(F.least(_digits(m), F.lit(20))),
        "f_marks": F.when(mail, (F.col("kind") == AROUND_AT).cast("int") * F.regexp_like(m, F.lit(r"\x20@|@\x20")).cast("int")).otherwise(marks),
        "f_groups": F.least(F.when(mail, F.size(host)).otherwise(F.size(groups)), F.lit(6)),
        "f_first": F.least(F.length(F.when(mail, F.element_at(host, -1)).otherwise(F.element_at(groups, 1))), F.lit(6)), "f_cue": cue,
        "f_check": F.when(F.col("kind") == ONE_RUN, _luhn(m).cast("int")).otherwise(0),
        # A plus sign and an opening bracket belong to the base pattern's match: what stands before them counts.
        "f_before": _side(F.substring(F.regexp_replace("tail", r"[+(\x20]+$", ""), -1, 1)), "f_after": _side(F.col("head")),
    })


def _tree(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int) -> dict:
    """A regression tree on counted rows, by the largest gain; a leaf is one Newton step."""
    value = float(gradient.sum() / (weight.sum() + 1.0))
    best = None
    if depth:
        total = gradient.sum() ** 2 / (weight.sum() + 1.0)
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                gain = sum(gradient[s].sum() ** 2 / (weight[s].sum() + 1.0) for s in (left, ~left)) - total
                if gain > 1e-6 and (best is None or gain > best[0]):
                    best = (gain, f, int(cut), left)
    if best is None:
        return {"value": value}
    _, f, cut, left = best
    return {"f": f, "cut": cut, "left": _tree(x[left], gradient[left], weight[left], depth - 1), "right": _tree(x[~left], gradient[~left], weight[~left], depth - 1)}


def _apply(tree: dict, x: np.ndarray) -> np.ndarray:
    if "value" in tree:
        return np.full(len(x), tree["value"])
    left = x[:, tree["f"]] <= tree["cut"]
    out = np.empty(len(x))
    out[left], out[~left] = _apply(tree["left"], x[left]), _apply(tree["right"], x[~left])
    return out


def boost(x: np.ndarray, n: np.ndarray, positive: np.ndarray, rounds: int = ROUNDS) -> list[dict]:
    """Logistic boosting on feature vectors that occur n times, `positive` times as personal data."""
    trees, score = [], np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(_tree(x, positive - n * p, n * p * (1 - p), DEPTH))
        score += RATE * _apply(trees[-1], x)
    return trees


def score_of(trees: list[dict]) -> Column:
    """The trees as one expression."""

    def node(t: dict) -> Column:
        if "value" in t:
            return F.lit(t["value"])
        return F.when(F.col(FEATURES[t["f"]]) <= t["cut"], node(t["left"])).otherwise(node(t["right"]))

    total = F.lit(0.0)
    for t in trees:
        total = total + F.lit(RATE) * node(t)
    return total


def calibrate(score: np.ndarray, n: np.ndarray, positive: np.ndarray, own: np.ndarray, precision: float = PRECISION) -> float:
    """The lowest score from which on `precision` of the own candidates, and PRIOR ones like those of all kinds, are positive; infinite if none is."""
    order = np.argsort(-score, kind="stable")
    last = np.r_[score[order][1:] != score[order][:-1], True] if len(order) else np.zeros(0, bool)
    total, good = np.cumsum(n[order]), np.cumsum(positive[order])
    mine, mine_good = np.cumsum((n * own)[order]), np.cumsum((positive * own)[order])
    fine = last & (mine_good + PRIOR * good / np.maximum(total, 1) >= precision * (mine + PRIOR))
    return float(score[order][np.flatnonzero(fine)[-1]]) if fine.any() else float("inf")


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (row, doc_id, hash); spans (row, kind index, start, end, base), none twice.

    A span that the method adds touches no base span and no other added one
    that begins before it. A null or empty text has no spans.
    """
    rows, found = proposals(docs)
    base = found.where("base").select("row", "kind", "start", "end")
    wide = features(found.where(F.col("kind") >= WIDE)).select("row", "kind", "start", "end", *FEATURES, *EXTRA)
    # Whether a candidate lies on a base span: the farthest end of those that begin before its end.
    marks = base.select("row", F.col("start").alias("at"), F.lit(0).alias("side"), "end", *[F.lit(None).cast("int").alias(c) for c in ("kind", "start", *FEATURES)], *[F.lit(None).cast("boolean").alias(c) for c in EXTRA])
    asks = wide.select("row", F.col("end").alias("at"), F.lit(-1).alias("side"), F.lit(None).cast("int").alias("far"), "kind", "start", *FEATURES, *EXTRA, F.col("end").alias("stop"))
    both = marks.withColumnRenamed("end", "far").withColumn("stop", F.lit(None).cast("int")).unionByName(asks)
    before = Window.partitionBy("row").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("reach", F.max("far").over(before)).where("stop is not null")
    seen = settle(seen.withColumn("hit", F.coalesce(F.col("reach") > F.col("start"), F.lit(False))).drop("far", "reach", "at", "side"))
    kind = F.when(F.col("kind").isin(AROUND_AT, IN_WORDS), 0).when((F.col("f_marks") == 3) & (F.col("f_groups") == 4) & (F.col("f_digits") <= 12), 1).when(F.col("f_digits") >= 14, 2).otherwise(3)
    seen = seen.withColumn("as", kind)
    # One row a feature vector, kind and half: bounded by the features' values.
    counts = sorted(seen.where("labelled and (hit or not doubtful)").groupBy(*FEATURES, "as", "fits").agg(F.count("*").alias("n"), F.count_if(F.col("hit") | F.col("evident")).alias("hits")).collect())
    fits = np.array([r["fits"] for r in counts], bool)
    more = None
    if fits.any() and (~fits).any():
        x, n, hits = (np.array([[r[c] for c in cs] for r in counts]) for cs in (FEATURES, ["n"], ["hits"]))
        n, hits, kinds = n[:, 0].astype(float), hits[:, 0].astype(float), np.array([r["as"] for r in counts])
        trees = boost(x[fits], n[fits], hits[fits])
        score = sum(RATE * _apply(t, x) for t in trees)
        least = F.lit(float("inf"))
        for k in range(len(KINDS)):
            least = F.when(F.col("as") == k, F.lit(calibrate(score[~fits], n[~fits], hits[~fits], kinds[~fits] == k))).otherwise(least)
        fresh = seen.where(~F.col("hit")).where(score_of(trees) >= least)
        ahead = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
        fresh = fresh.withColumn("reach", F.max("stop").over(ahead)).where(F.col("reach").isNull() | (F.col("reach") <= F.col("start")))
        more = fresh.select("row", F.col("as").alias("kind"), "start", F.col("stop").alias("end"), F.lit(False).alias("base"))
    spans = base.withColumn("base", F.lit(True))
    return rows, spans if more is None else spans.unionByName(more)


def detect(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, hash (of the text), n_email, n_ip, n_card, n_phone, base_sha256, spans, found.

    found: (start, kind index, end) of all spans in order. Null and empty texts
    have counts 0 and empty spans. Repeated rows and null ids get a row each; an
    empty table gives an empty result. Only doc_id and text are read.
    """
    rows, spans = find(docs)
    name = F.array(*[F.lit(k) for k in KINDS])

    def text(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    span = F.struct("start", "kind", "end")
    by_row = settle(spans.groupBy("row").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{v}") for k, v in enumerate(KINDS)],
        F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("found"),
    ))
    out = rows.join(by_row, "row", "left")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    base, found = F.coalesce("base", empty), F.coalesce("found", empty)
    return out.select("doc_id", "hash", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(found).alias("spans"), found.alias("found"))


def op9(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return detect(docs).drop("hash", "found")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in square brackets; n_chars, where it exists, follows the text.

    Of overlapping spans each replaces what those before it have left.
    """
    hits = detect(docs).where(F.size("found") > 0).select(F.col("doc_id").alias("_llm_id"), F.col("hash").alias("_llm_hash"), F.col("found").alias("_llm_found"))
    hits = settle(hits.groupBy("_llm_id", "_llm_hash").agg(F.first("_llm_found").alias("_llm_found")))
    rows, held = hits.agg(F.count("*"), F.coalesce(F.sum(F.size("_llm_found")), F.lit(0))).first()
    if rows + held <= FETCHED:
        hits = F.broadcast(hits)
    digit, at, spelled = _signs(F.coalesce(F.col("text"), F.lit("")))
    # Only texts in which something can be found are shuffled to their spans.
    open_ = docs.where(digit | at | spelled)
    joined = open_.join(hits, open_["doc_id"].eqNullSafe(hits["_llm_id"]) & (F.xxhash64(open_["text"]) == hits["_llm_hash"]), "left")
    # (parts, place): the parts put out so far and the code points they stand for.
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(a: Column, s: Column) -> Column:
        part = F.concat(F.substring(F.col("text"), a["at"] + 1, F.greatest(F.lit(0), s["start"] - a["at"])), F.element_at(name, s["kind"] + 1))
        return F.when(s["end"] <= a["at"], a).otherwise(F.struct(F.concat(a["parts"], F.array(part)).alias("parts"), s["end"].alias("at")))

    done = F.aggregate("_llm_found", start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(F.col("text"), a["at"] + 1, F.lit(2**31 - 1))))
    text = F.when(F.col("_llm_found").isNull(), F.col("text")).otherwise(done)
    cols = [text.alias(c) if c == "text" else F.when(F.col("_llm_found").isNull(), F.col(c)).otherwise(F.length(text)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return joined.select(*cols).unionAll(docs.where(~(digit | at | spelled)))
