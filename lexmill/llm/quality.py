"""Operator 3: quality rules as weak supervision, in DataFrame expressions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import free_name
from lexmill.session import stage

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
KEEP = 0.5

#: Each rule votes good inside the first pair of bounds, bad outside the second pair, and else abstains:
#: (name, quantity, good from, good to, bad below, bad above).
RULES = (
    ("length", "n_words", 50, math.inf, 20, math.inf),
    ("word_length", "word_chars / n_words", 3.5, 6.5, 2.5, 10.0),
    ("symbols", "n_symbols / n_words", 0.0, 0.05, -1.0, 0.2),
    ("symbol_share", "n_symbols / word_chars", 0.0, 0.01, -1.0, 0.05),
    ("duplicate_lines", "n_dup_lines / n_lines", 0.0, 0.1, -1.0, 0.3),
    ("repeats", "n_repeat_words / n_words", 0.0, 0.05, -1.0, 0.15),
    ("capitals", "n_capitals / word_chars", 0.001, 0.08, -1.0, 0.3),
    ("shouting", "n_shouts / n_words", 0.0, 0.05, -1.0, 0.3),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body or the optimizer repeats its name."""
    return F.element_at(F.transform(F.array(value), body), 1)


def counts(text: Column) -> Column:
    """Struct of the word, symbol, line and repetition counts of a whole text.

    Words are runs of characters outside space, tab, line feed, vertical tab, form feed and carriage return. Null and
    empty texts have no words and zero in every count. A 5-word window is compared by the 64-bit hash of its words; only
    texts with a repeated window sort them. All of it stays within the row: nothing is exploded or shuffled.
    """
    whole = F.coalesce(text, F.lit(""))
    blank = lambda x: F.translate(x, SPACES, " " * len(SPACES))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.ltrim(blank(x))) > 0)
    count_of = lambda chars: (F.length(whole) - F.length(F.translate(whole, chars, ""))).cast("long")

    def windows(words: Column) -> Column:
        last = F.size(words) - WINDOW
        one = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one)).otherwise(F.array().cast("array<bigint>"))

    def repeated(hashes: Column) -> Column:
        """Words in windows found twice: each such window covers its words up to the next such window."""
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = lambda s, i: F.get(s, i)["h"]
        twins = lambda s: F.filter(s, lambda x, i: (at(s, i + 1) == x["h"]) | ((i > 0) & (at(s, F.greatest(i - 1, F.lit(0))) == x["h"])))
        gaps = lambda p: F.transform(p, lambda q, i: F.coalesce(F.least(F.get(p, i + 1) - q, F.lit(WINDOW)), F.lit(WINDOW)))
        places = let(placed, lambda s: F.sort_array(F.transform(twins(s), lambda x: x["i"])))
        covered = let(places, lambda p: F.aggregate(gaps(p), F.lit(0), lambda a, b: a + b))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(0).cast("long")

    def of_pieces(pieces: Column) -> Column:
        return let(F.array_remove(pieces, ""), lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            (F.length(whole) - F.size(pieces) + 1).cast("long").alias("word_chars"),
            count_of(SYMBOLS).alias("n_symbols"),
            count_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
            count_of("!").alias("n_shouts"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), F.size(F.array_distinct(x)).cast("long").alias("different"))).alias("lines"),
            let(windows(words), repeated).alias("n_repeat_words"),
        ))

    return let(F.split(blank(whole), " "), of_pieces)


def quantity(c: Column, name: str) -> Column:
    if name == "n_lines":
        return c["lines"]["all"]
    return c["lines"]["all"] - c["lines"]["different"] if name == "n_dup_lines" else c[name]


def votes(c: Column) -> Column:
    """Struct of one vote a rule: 1 for good, -1 for bad, 0 to abstain; a share of nothing abstains."""
    out = []
    for name, what, good_from, good_to, bad_below, bad_above in RULES:
        parts = [quantity(c, x.strip()) for x in what.split("/")]
        x = F.try_divide(*parts) if len(parts) == 2 else parts[0]
        good, bad = (x >= good_from) & (x <= good_to), (x < bad_below) | (x > bad_above)
        out.append(F.when(bad, -1).when(good, 1).otherwise(0).alias(name))
    return F.struct(*out)


@dataclass
class VoteModel:
    """Share of good documents and, for each rule, the chance that its vote on a good document is good and that its vote on
    a bad one is bad. Abstaining says nothing."""

    prior: float
    on_good: list[float]
    on_bad: list[float]

    def weights(self) -> list[tuple[float, float]]:
        """Log odds that a rule's good and bad vote add."""
        return [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in zip(self.on_good, self.on_bad, strict=True)]

    def odds(self, vote: tuple[int, ...]) -> float:
        """Log odds that a document with these votes is good."""
        return math.log(self.prior / (1 - self.prior)) + sum(w[v < 0] for w, v in zip(self.weights(), vote, strict=True) if v)

    def posterior(self, vote: Column) -> Column:
        """Probability that a document is good, given its struct of votes."""
        add = lambda w, v: F.when(v > 0, w[0]).when(v < 0, w[1]).otherwise(0.0)
        score = reduce(lambda a, b: a + b, (add(w, vote[r[0]]) for w, r in zip(self.weights(), RULES, strict=True)), F.lit(math.log(self.prior / (1 - self.prior))))
        return 1 / (1 + F.exp(-score))


def estimate(table: list[tuple[tuple[int, ...], int]], rounds: int = 300) -> VoteModel:
    """Expectation-maximisation over counted vote patterns.

    Votes are taken to err independently given the truth. The first round weighs a bad vote like four good ones, which
    fixes which class is called good. Each count has one made-up document of either kind added, so nothing is certain. A
    rule whose good votes are no likelier on good documents gets the same chances for both classes: it has no say.
    """
    rules = len(RULES)
    good = [1 / (1 + math.exp(-sum(0.5 if v > 0 else 2 * v for v in vote))) for vote, _ in table]
    for _ in range(rounds):
        # for each class and rule: good and bad votes
        cast = [[[1.0, 1.0] for _ in range(rules)] for _ in range(2)]
        sure = 1.0
        for w, (vote, n) in zip(good, table, strict=True):
            sure += w * n
            for j, v in enumerate(vote):
                if v:
                    cast[0][j][v < 0] += n * w
                    cast[1][j][v < 0] += n * (1 - w)
        on_good = [a / (a + b) for a, b in cast[0]]
        on_bad = [b / (a + b) for a, b in cast[1]]
        for j in range(rules):
            if on_good[j] < 1 - on_bad[j]:
                on_good[j] = (cast[0][j][0] + cast[1][j][0]) / (sum(cast[0][j]) + sum(cast[1][j]))
                on_bad[j] = 1 - on_good[j]
        model = VoteModel(sure / (sum(n for _, n in table) + 2.0), on_good, on_bad)
        before, good = good, [1 / (1 + math.exp(-max(-500.0, min(500.0, model.odds(v))))) for v, _ in table]
        if all(abs(a - b) < 1e-9 for a, b in zip(before, good, strict=True)):
            break
    return model


def fit_votes(voted: DataFrame) -> VoteModel:
    """The model of a frame of vote structs.

    Spark counts how often each combination of votes occurs over all documents; there are at most 3 ** len(RULES) (6561)
    combinations, whatever the input, and the rounds run over that table, in an order of its own.
    """
    return estimate(sorted((tuple(row["votes"]), row["count"]) for row in voted.groupBy("votes").count().collect()))


def base_failed(c: Column) -> Column:
    """Under ten words, or over a fifth of the words in repeated 5-word windows."""
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def quality(docs: DataFrame) -> DataFrame:
    """Counts, posterior and verdict for each document.

    Rules vote or abstain; the model is fitted over all documents of the call. Base failures are never kept, all others
    are kept where the posterior is at least 0.5. Null and empty texts fail the base rule. Repeated rows are judged
    alike. Empty table: no rows. Other columns of the input are not read.
    """
    counted = docs.select("doc_id", counts(F.col("text")).alias("c"))
    voted = stage(counted.select("doc_id", "c", votes(F.col("c")).alias("votes")), "votes")
    good = fit_votes(voted).posterior(F.col("votes"))
    c = F.col("c")
    return voted.select(
        "doc_id", *(quantity(c, n).alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed(c).alias("base_failed"), (~base_failed(c) & (good >= KEEP)).alias("kept"), good.alias("quality"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that quality() keeps, with all their columns, whatever their names.

    Null and empty texts go, since they fail the base rule; repeated rows stay or go together; an empty table stays empty.
    Votes and base verdict are written beside the columns, so the counts are taken once and no text is shuffled.
    """
    mark = free_name(docs, "rules")
    marks = let(counts(F.col("text")), lambda c: F.struct(votes(c).alias("votes"), base_failed(c).alias("failed")))
    voted = stage(docs.withColumn(mark, marks), "votes")
    model = fit_votes(voted.select(F.col(f"{mark}.votes").alias("votes")))
    return voted.filter(~F.col(f"{mark}.failed") & (model.posterior(F.col(f"{mark}.votes")) >= KEEP)).drop(mark)
