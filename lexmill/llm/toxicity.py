"""Operator 7: toxic passages by maximum-scoring segments, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import column_place, crc_mod, in_slices
from lexmill.session import stage

#: Labelled documents of each class that the model is fitted on.
PER_CLASS = 10_000
#: Weight of the prior, as a share of the sample's documents.
PRIOR_SHARE = 0.05
#: What a token outside the lexicon takes from a passage's score.
GAP = 0.25
#: Chance that any word at all enters the lexicon by accident.
SIGNIFICANCE = 0.05
PREDICT = 0.7
#: Sketches of a labelled text, and how many of them near copies have in common.
SKETCHES, AGREE = 4, 3

WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def segments(hits: list[tuple[int, float]], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score), in one pass over the words with a positive score.

    Words between two hits cost `gap` each. A new hit joins the segments before it as long as that raises the score: it
    looks back for the last segment whose left sum is lower; if that one's right sum is not higher, all from there on
    merge. Each segment keeps a link to the last one before it of lower left sum, so a look back passes over what lies
    between, and nothing is passed over twice: the scan is linear in the hits.
    """
    out: list[tuple[int, int, float, float]] = []  # first, last, sum left of it, sum at its end
    link: list[int] = []
    total, at = 0.0, 0
    for place, score in hits:
        total -= gap * (place - at)
        first, left = place, total
        total, at = total + score, place + 1
        j = len(out) - 1
        while j >= 0 and out[j][2] >= left:
            j = link[j]
        while j >= 0 and out[j][3] < total:
            first, _, left, _ = out[j]
            back = link[j]
            del out[j:], link[j:]
            j = back
        out.append((first, place, left, total))
        link.append(j)
    return [(a, b, r - left) for a, b, left, r in out]


@dataclass
class ToxicModel:
    """Log-odds of the lexicon's words, scale and offset of the extreme-value law, and the logistic calibration."""

    lexicon: dict[str, float]
    decay: float
    base: float
    slope: float
    bias: float

    def passages(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Passages whose score a clean text of this length would reach with a chance under 5 %: (first, last, bits)."""
        if self.lexicon.keys().isdisjoint(words):
            return []
        get = self.lexicon.get
        hits = [(i, s) for i, w in enumerate(words) if (s := get(w)) is not None]
        size = math.log(len(words))
        found = ((a, b, self.decay * s - size) for a, b, s in segments(hits, GAP))
        return [x for x in found if 1 - math.exp(-math.exp(-x[2])) < 0.05]

    def strength(self, passages: list[tuple[int, int, float]]) -> float:
        """One number for a document: the best passage's distance from chance, and a little for each further one."""
        return math.log1p(max(x[2] for x in passages)) + math.log1p(len(passages)) if passages else 0.0

    def score(self, passages: list[tuple[int, int, float]]) -> float:
        if not passages:
            return self.base
        return 1 / (1 + math.exp(-(self.bias + self.slope * self.strength(passages))))


def sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different words, a hash of all words in order, and sketches of labelled documents; near copies agree in most sketches."""
    for batch in in_slices(batches):
        words = [words_of(t) for t in batch.column(2).to_pylist()]
        marks = [xxhash.xxh64_intdigest(" ".join(w)) >> 1 for w in words]
        sketches: list[list[int]] = [[] for _ in range(SKETCHES)]
        for w in words:
            grams = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
            for k in range(SKETCHES):
                sketches[k].append(min(xxhash.xxh64_intdigest(g, seed=k) for g in grams) >> 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string())), pa.array(marks, pa.int64()), *(pa.array(s, pa.int64()) for s in sketches)],
            names=["doc_id", "toxic", "words", "mark", *(f"sketch{k}" for k in range(SKETCHES))],
        )


def count_once(sample: DataFrame) -> DataFrame:
    """(toxic, words) of the sample without near copies, whatever the order of its rows.

    A row goes where a row of its class with a lower doc_id (with the same one: a lower hash of the words) agrees with it
    in AGREE of the SKETCHES at least. So it stays if it is the lowest for each choice of AGREE sketches. The minima are
    taken before the shuffle; the rows that stay are as bounded as the sample, so they are broadcast.
    """
    names = [f"sketch{k}" for k in range(SKETCHES)]
    choices = list(combinations(names, AGREE))
    keys = F.array(*(F.struct(F.lit(n).alias("choice"), "toxic", *(F.col(c).alias(f"key{i}") for i, c in enumerate(chosen))) for n, chosen in enumerate(choices)))
    lowest = sample.select(F.explode(keys).alias("key"), "doc_id", "mark").groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("row"))
    first = lowest.groupBy("row").count().filter(F.col("count") == len(choices)).select("row.*")
    return sample.join(F.broadcast(first), ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"]).select("toxic", "words")


def surprising(share: float, vocabulary: int) -> Column:
    """Whether chance alone would put a word of (a toxic, b clean) documents into so many toxic ones less than SIGNIFICANCE
    times over all words (Chernoff's bound, Bonferroni's correction); `share` of all documents are toxic."""
    if not 0 < share < 1:
        return F.lit(False)
    n, p = F.col("a") + F.col("b"), F.col("a") / (F.col("a") + F.col("b"))
    divergence = p * F.log(p / share) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    return (p > share) & (n * divergence >= math.log((vocabulary + 1) / SIGNIFICANCE))


def log_odds(toxic: dict[str, int], clean: Counter, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log-odds of words under an informative Dirichlet prior, for those over twice the gap.

    The prior is the sample's own word distribution, PRIOR_SHARE as heavy as the sample, which draws rare words to zero.
    """
    out = {}
    for word, a in toxic.items():
        b = clean[word]
        prior = PRIOR_SHARE * (a + b)
        odds = lambda y, n: math.log((y + prior) / max(1e-9, n * (1 + PRIOR_SHARE) - y - prior))
        value = odds(a, n_toxic) - odds(b, n_clean)
        if value > 2 * GAP:
            out[word] = value
    return out


def decay_rate(lexicon: dict[str, float], clean: Counter, tokens: int) -> float:
    """The positive root of sum p(w) exp(rate * score(w)) = 1 over clean text: the extreme-value law's scale."""
    if not lexicon:
        return 1.0
    chance = {w: (clean[w] + 0.5) / (tokens + 1.0) for w in lexicon}
    rest = 1 - sum(chance.values())
    drift = lambda x: sum(p * math.exp(min(700.0, x * lexicon[w])) for w, p in chance.items()) + rest * math.exp(-GAP * x) - 1
    low, high = 1e-6, 1.0
    while drift(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if drift(mid) < 0 else (low, mid)
    return max(low, 1e-3)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicModel:
    """Fit on at most about `per_class` labelled documents of each class, drawn by the hash of the id, whole texts.

    Near copies of one class within the sample count once, lest one text's odd words look like a trend; texts that only
    share a passage, or a toxic text made from a clean one, all count. The words are counted and tested by Spark; only
    those that pass come to the driver. The scale comes from the clean sample's word chances, the calibration from a
    logistic fit of the passages' strength on the sample. A document with several labels is toxic if one says so; a null
    id or label is not learnt from; texts of one id are all read. Other columns are not read, whatever their names.
    """
    truth = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in truth.groupBy("toxic").count().collect()}
    if not {0, 1} <= sizes.keys():
        return ToxicModel({}, 1.0, float(sizes.get(1, 0) > 0) / 2, 1.0, 0.0)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) / 1_000_000
    chosen = truth.filter(draw < F.when(F.col("toxic") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0])))
    # at most about 2 x per_class ids
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    schema = "doc_id long, toxic int, words array<string>, mark long, " + ", ".join(f"sketch{k} long" for k in range(SKETCHES))
    sample = stage(texts.mapInArrow(sample_words, schema), "toxic-sample")
    single = stage(count_once(sample), "toxic-single", 8)
    by_class = {r["toxic"]: (r["n"], r["tokens"]) for r in single.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("tokens")).collect()}
    (n_toxic, _), (n_clean, tokens) = by_class.get(1, (0, 0)), by_class.get(0, (0, 0))
    counted = single.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    )
    vocabulary = counted.count()
    rows = counted.filter(surprising(n_toxic / max(1, n_toxic + n_clean), vocabulary)).collect()
    clean = Counter({r["word"]: r["b"] for r in rows})
    lexicon = log_odds({r["word"]: r["a"] for r in sorted(rows, key=lambda r: r["word"])}, clean, n_toxic, n_clean)
    model = ToxicModel(lexicon, decay_rate(lexicon, clean, int(tokens or 0)), 0.0, 1.0, 0.0)
    box = docs.sparkSession.sparkContext.broadcast(model)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [box.value.strength(box.value.passages(words_of(t))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.float64())], names=["toxic", "strength"])

    # the sample bounds the rows; sorted, so that sums don't depend on the order of tasks
    table = sorted(texts.mapInArrow(strengths, "toxic int, strength double").groupBy("toxic", "strength").count().collect())
    none = Counter()
    for r in table:
        if r["strength"] == 0:
            none[r["toxic"]] += r["count"]
    weight = {c: sizes[c] / max(1, sum(r["count"] for r in table if r["toxic"] == c)) for c in (0, 1)}
    model.base = min(0.5, (none[1] * weight[1] + 0.5) / (none[0] * weight[0] + none[1] * weight[1] + 1))
    rows = [(r["strength"], r["toxic"], r["count"] * weight[r["toxic"]]) for r in table if r["strength"] > 0]
    model.slope, model.bias = logistic(rows)
    return model


def logistic(rows: list[tuple[float, int, float]], steps: int = 100) -> tuple[float, float]:
    """Weighted logistic regression on one feature by Newton steps, with a weak pull towards slope 1."""
    slope, bias = 1.0, 0.0
    if not rows:
        return slope, bias
    x, y, w = (np.array(c, float) for c in zip(*rows, strict=True))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(bias + slope * x, -30, 30)))
        g = np.array([(w * (y - p)).sum() - bias * 0.1, (w * (y - p) * x).sum() - (slope - 1) * 1.0])
        v = w * p * (1 - p)
        h = np.array([[v.sum() + 0.1, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1.0]])
        move = np.linalg.solve(h, g)
        bias, slope = bias + float(np.clip(move[0], -2, 2)), slope + float(np.clip(move[1], -2, 2))
    return slope, bias


def toxic_passages(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, score, passages): chance that the text is toxic, and every significant passage by its word numbers.

    Null, empty and wordless texts have no passage and the score of texts without one. Whole texts are read, one pass
    each; only the lexicon goes to the workers and nothing is shuffled.
    """
    box = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("bits", pa.float64())]))
        for batch in in_slices(batches):
            found = [box.value.passages(words_of(t)) for t in batch.column(1).to_pylist()]
            spans = [[{"first": a, "last": b, "bits": s} for a, b, s in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([box.value.score(f) for f in found], pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "passages"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, passages array<struct<first:int,last:int,bits:double>>")


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learnt from: crc32(doc_id) modulo 3 is not 1."""
    return labels.select("doc_id", "toxic").filter(crc_mod(F.col("doc_id"), 3) != 1)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and verdict for each document.

    Equal texts score alike, so ties and repeated rows are judged alike; null and empty texts get the score of texts without
    a passage. Without labels of both classes all texts score the same. Empty documents table: no rows.
    """
    scored = toxic_passages(docs, fit_toxicity(docs, training_labels(labels)))
    return scored.select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= PREDICT).cast("int").alias("predicted"), F.size("passages").alias("n_passages"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under 0.7, with all their columns, whatever their names, in one pass over the texts.

    Null and empty texts have the score of texts without a passage, which is under 0.7, so they stay. Repeated rows stay or
    go together. Empty table: no rows.
    """
    box = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, training_labels(labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts = batch.column(column_place(batch.schema, "text")).to_pylist()
            keep = [box.value.score(box.value.passages(words_of(t))) < PREDICT for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
