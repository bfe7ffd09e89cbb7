"""Script conversion: phrases of a table put in the place of others, the longest match first."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexmill.operators.matching import containing

#: Bytes of phrases and replacements up to which a table is sent to every worker; a larger one is joined to the texts.
TABLE_BYTES = 32 << 20
#: Phrases of one first character up to which all are one regular expression, which tries them one by one.
ALTERNATIVES = 64


class Phrases:
    """Replacements by phrase, and for each first character the lengths of its phrases, longest first."""

    def __init__(self, table: dict[str, str]):
        self.table, sizes = table, {}
        for phrase in table:
            sizes.setdefault(phrase[0], set()).add(len(phrase))
        self.sizes = {first: sorted(found, reverse=True) for first, found in sizes.items()}
        self.first = re.compile("[" + "".join(map(re.escape, self.sizes)) + "]") if table else None
        tails: dict[str, list[str]] = {}
        for phrase in sorted(table, key=len, reverse=True):
            tails.setdefault(phrase[0], []).append(re.escape(phrase[1:]))
        few = table and max(map(len, tails.values())) <= ALTERNATIVES
        self.whole = re.compile("|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in tails.items())) if few else None

    def put(self, text: str) -> str:
        """The text with its phrases replaced: from left to right, at each place the longest that fits."""
        if self.whole:
            return self.whole.sub(lambda m: self.table[m[0]], text)
        out, at, done = [], 0, 0
        while self.first and (found := self.first.search(text, at)):
            at = found.start()
            size = next((s for s in self.sizes[text[at]] if text[at : at + s] in self.table), 0)
            if size:
                out += (text[done:at], self.table[text[at : at + size]])
                done = at = at + size
            else:
                at += 1
        return "".join(out) + text[done:]


def cleaned(table: DataFrame) -> DataFrame:
    """(phrase, replacement), each phrase once: of several replacements the least. Rows with a null and empty phrases go."""
    given = table.select("phrase", "replacement").filter(F.length("phrase") > 0).filter("replacement is not null")
    return given.groupBy("phrase").agg(F.min("replacement").alias("replacement"))


def converter(table: DataFrame, most: int = TABLE_BYTES) -> Callable[[Column], Column] | None:
    """A function of a text column that converts it by a table of (phrase, replacement), or None where the table has more
    than `most` bytes and so isn't sent to the workers. The function fits `normalise(convert=…)`."""
    rows = cleaned(table)
    size = rows.agg(F.sum(F.octet_length("phrase") + F.octet_length("replacement"))).first()[0]
    if (size or 0) > most:
        return None
    box = table.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in rows.collect()})

    @F.pandas_udf(StringType())
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        phrases = Phrases(box.value)
        for texts in batches:
            yield texts.map(phrases.put, na_action="ignore")

    return convert


@F.pandas_udf(StringType())
def _by_own(texts: pd.Series, phrases: pd.Series, replacements: pd.Series) -> pd.Series:
    rows = zip(texts, phrases, replacements, strict=True)
    return pd.Series([t if t is None or p is None else Phrases(dict(zip(p, r, strict=True))).put(t) for t, p, r in rows], dtype=object)


def converted(docs: DataFrame, table: DataFrame, text: str, most: int = TABLE_BYTES) -> DataFrame:
    """The documents with the column `text` converted by a table of (phrase, replacement) of any size.

    Scanning from the left, the longest phrase that fits at a place is replaced and the scan goes on behind it; what is put
    in is not read again. Null texts stay null. A table of up to `most` bytes is sent to the workers. Beyond it each text is
    joined with the phrases that it holds (containing), so a row carries its own table and nothing is broadcast; equal texts
    are looked up once.
    """
    convert = converter(table, most)
    if convert is not None:
        return docs.withColumn(text, convert(F.col(text)))
    digest = lambda c: F.sha2(c, 256)
    texts = docs.select(F.col(text).alias("text")).filter("text is not null").select(digest(F.col("text")).alias("id"), "text").dropDuplicates(["id"])
    rows = cleaned(table).select("phrase", F.struct("phrase", "replacement").alias("pair"))
    held = containing(texts, rows, "id", "text", "pair", "phrase").groupBy("id").agg(F.collect_list("pair").alias("pairs"))
    own, listed = "__own_digest", "__own_pairs"
    joined = docs.withColumn(own, digest(F.col(text))).join(held.select(F.col("id").alias(own), F.col("pairs").alias(listed)), own, "left")
    return joined.withColumn(text, _by_own(F.col(text), F.col(f"{listed}.phrase"), F.col(f"{listed}.replacement"))).select(*docs.columns)
