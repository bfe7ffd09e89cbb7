"""Operator 5: language identification, known words first, then shorter and shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import crc_mod, in_slices

#: Labelled documents a language that the model is fitted on; they alone bound its words and n-grams.
PER_LANGUAGE = 500
LONGEST = 5
#: Words that a worker remembers the scores of, and words of a text that are summed at once.
CACHE = 200_000

WORD = re.compile(r"[^\W\d_]+")


@dataclass
class LanguageModel:
    """Log frequency of each word and n-gram in each language, a row of a matrix each; n-grams see a mark at both ends of a
    word."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    rows: np.ndarray

    @classmethod
    def of(cls, languages: list[str], words: dict[str, tuple[float, ...]], grams: dict[str, tuple[float, ...]]) -> LanguageModel:
        """From the log frequencies of words and n-grams."""
        rows = np.array([*words.values(), *grams.values()], np.float32).reshape(-1, len(languages))
        return cls(languages, {w: i for i, w in enumerate(words)}, {g: len(words) + i for i, g in enumerate(grams)}, rows)

    def places(self, word: str) -> list[int]:
        """Row of the word itself, else the rows of its known n-grams of the greatest length that has any, else none."""
        known = self.words.get(word)
        if known is not None:
            return [known]
        marked, get = f"<{word}>", self.grams.get
        for n in range(min(LONGEST, len(marked)), 0, -1):
            found = [g for i in range(len(marked) - n + 1) if (g := get(marked[i : i + n])) is not None]
            if found:
                return found
        return []

    def score(self, words: list[str]) -> np.ndarray:
        """The mean over each word's places; a word without any says nothing."""
        places = list(map(self.places, words))
        counts = np.fromiter(map(len, places), np.int64, len(places))
        out, some = np.zeros((len(words), len(self.languages))), counts > 0
        if some.any():
            flat = np.fromiter(chain.from_iterable(places), np.int64, int(counts.sum()))
            starts = (np.cumsum(counts) - counts)[some]
            out[some] = np.add.reduceat(self.rows[flat].astype(np.float64), starts, axis=0) / counts[some][:, None]
        return out

    def word(self, word: str) -> np.ndarray:
        return self.score([word])[0]


class WordScores(dict):
    """Row of each word in a score table, filled when words are first seen."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.rows = np.zeros((2 * CACHE, len(model.languages)))

    def total(self, words: list[str]) -> np.ndarray:
        """Sum over the words, CACHE of them at a time, so that a text of any length stays within the table."""
        out = np.zeros(len(self.model.languages))
        for at in range(0, len(words), CACHE):
            if len(self) > CACHE:
                self.clear()
            part = words[at : at + CACHE]
            fresh = [w for w in dict.fromkeys(part) if w not in self]
            if fresh:
                have = len(self)
                self.rows[have : have + len(fresh)] = self.model.score(fresh)
                self.update(zip(fresh, range(have, have + len(fresh)), strict=True))
            out += self.rows[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(axis=0)
        return out


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and n-grams of labelled documents, summed a batch at a time."""
    for batch in in_slices(batches):
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(WORD.findall((text or "").lower()))
        rows: Counter = Counter()
        for lang, words in counts.items():
            for word, n in words.items():
                rows[lang, True, word] += n
                marked = f"<{word}>"
                for size in range(1, LONGEST + 1):
                    for i in range(len(marked) - size + 1):
                        rows[lang, False, marked[i : i + size]] += n
        langs, whole, grams = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(whole, pa.bool_()), pa.array(grams, pa.string()), pa.array(list(rows.values()), pa.int64())],
            names=["lang", "whole", "gram", "n"],
        )


def fit_languages(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on at most about `per_language` documents a language, chosen by the hash of id and text, with their whole texts.

    The model holds every word and n-gram of that sample, however rare. Rows with equal ids are drawn like others; rows
    that are equal in both are drawn together, which adds to counts but to no list. A language never goes without any.
    """
    digest = F.xxhash64("doc_id", "text", F.lit("language"))
    rows = labelled.groupBy("lang").agg(F.count("*").alias("count"), F.min(digest).alias("least")).collect()
    sizes, least = {r["lang"]: r["count"] for r in rows}, {r["lang"]: r["least"] for r in rows}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], {}, {}, np.zeros((0, 0), np.float32))
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))))
    first = F.create_map(*(F.lit(x) for lang in languages for x in (lang, least[lang])))
    draw = F.pmod(digest, F.lit(1_000_000)) / 1_000_000
    sample = labelled.filter((draw < share[F.col("lang")]) | (digest == first[F.col("lang")])).select("lang", "text")
    counted = sample.mapInArrow(count_grams, "lang string, whole boolean, gram string, n long").groupBy("whole", "gram")
    each = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(languages)]
    table = pa.Table.from_batches(counted.agg(*each).toArrow().combine_chunks().to_batches())
    whole, names = table["whole"].to_numpy(zero_copy_only=False).astype(bool), table["gram"].to_pylist()
    counts = np.stack([table[f"n{i}"].to_numpy() for i in range(len(languages))], axis=1).astype(np.float64)
    rows = np.zeros(counts.shape, np.float32)
    index: dict[bool, dict[str, int]] = {}
    for kind in (True, False):
        own = np.flatnonzero(whole == kind)
        base = np.log(counts[own].sum(axis=0) + len(own) / 2 + 1)
        rows[own] = np.log(counts[own] + 0.5) - base
        index[kind] = {names[i]: i for i in own.tolist()}
    return LanguageModel(languages, index[True], index[False], rows)


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score): the language under which the text's words are likeliest, and its probability.

    Only the text is looked at. Null texts and texts without a letter are `und` with score 0; of languages that are equally
    likely the first by name is taken. Only the model, bounded by its sample, is sent to the workers; nothing is shuffled.
    """
    box = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = box.value.languages
        scores = WordScores(box.value)
        for batch in in_slices(batches):
            names, values = [], []
            for text in batch.column(1).to_pylist():
                words = WORD.findall(text.lower()) if text and languages else []
                if not any(c.isalpha() for w in words for c in w):
                    names.append("und")
                    values.append(0.0)
                    continue
                total = scores.total(words)
                best = int(np.argmax(total))
                names.append(languages[best])
                values.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(values, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Language of each document, learnt from documents with a language whose crc32(doc_id) modulo 4 is not 2.

    Repeated rows are judged alike. Without labelled rows every document is `und`. Empty table: no rows.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2)).select("doc_id", "text", "lang")
    predicted = predict_languages(docs, fit_languages(labelled))
    return predicted.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
