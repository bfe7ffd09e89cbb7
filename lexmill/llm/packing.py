"""Operator 1: packing token sequences by cutting-stock column generation."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import blocks
from lexmill.session import stage

CAPACITY = 4096
#: Lengths are rounded up to whole units for the linear program: at most 15 tokens of padding a piece.
UNIT = 16
END_OF_TEXT = 2
#: Pieces of a class that are ranked in one task, about.
PER_BUCKET = 50_000
#: Words that a worker remembers: so many met lately, and as many from before.
CACHE = 100_000
#: Text bytes that are tokenised together.
BLOCK = 1 << 22

#: White space for Arrow's splitter, but not for the tokenizer.
ODD = "[\x1c-\x1f]"
#: Words of a lower-case run.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+"
#: Runs of ASCII and of Latin-1's letters, which keep their form when normalised and whose lower case is one letter.
LATIN = "^[\x00-\x7fÀ-ÖØ-öø-ÿ]*$"


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow
    from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Recent(dict):
    """A table of what was met lately; what was met before that stays in `old`, and is forgotten unless met again."""

    old: dict

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, wanted: list[str]) -> list[str]:
        """What is in neither table; what is only in the old one moves to this one."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        unknown = [x for x in wanted if x not in self]
        old = self.old
        self.update((x, old[x]) for x in unknown if x in old)
        return [x for x in unknown if x not in old]


class WordIds:
    """Token ids of whole texts as little-endian bytes, by the tokenizers library, each different word encoded once.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its runs of non-spaces.
    Arrow cuts a block of texts into runs, numbers the different ones and cuts these into lower-case words; unseen words
    go to the library's model in one call, past its normaliser and splitter, which have no more to do. Every word's last
    token, and no other, carries the end-of-word mark, by which the words' ids are told apart. Runs with letters other
    than those of Latin-1, or whatever else may change when normalised, are normalised one by one.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.library = path, None
        self.model = Tokenizer.from_file(path)
        vocab = self.model.get_vocab()
        self.final = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.final[i] = token.endswith("</w>")
        special = [x.content for x in self.model.get_added_tokens_decoder().values()]
        self.model.normalizer, self.model.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.apart = "|".join([ODD, *map(re.escape, special)])
        self.word = regex.compile(WORD)
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.words = Recent(CACHE)

    def direct(self, text: str) -> bytes:
        """Ids by the whole library; few texts need it."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def normalised(self, run: str) -> str | None:
        """Words of a run, spaces between them; None if only the library's own normaliser will do."""
        low = unicodedata.normalize("NFC", run).replace("Σ", "σ").lower()
        return " ".join(self.word.findall(low)) if low.isascii() or unicodedata.is_normalized("NFC", low) else None

    def learn(self, words: list[str]) -> None:
        """Enter unseen words."""
        written = [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words]
        ids = np.asarray(self.model.encode_batch_fast([written], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) == len(words):
            data, stops = ids.tobytes(), (4 * ends).tolist()
            self.words.update(zip(words, map(data.__getitem__, map(slice, [0, *stops], stops)), strict=True))
        else:
            self.words.update((w, self.direct(w)) for w in words)

    def store(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different runs, end to end, and where each run's ids end."""
        cut = pc.ascii_rtrim_whitespace(pc.replace_substring_regex(pc.utf8_lower(runs), WORD, "\\0 "))
        other = pc.invert(pc.match_substring_regex(runs, LATIN)).to_numpy(zero_copy_only=False)
        whole: dict[int, bytes] = {}
        if other.any():
            places = np.flatnonzero(other)
            odd = runs.take(pa.array(places)).to_numpy(zero_copy_only=False).tolist()
            words = [self.normalised(x) for x in odd]
            whole = {int(k): self.direct(x) for k, x, w in zip(places, odd, words, strict=True) if w is None}
            cut = pc.replace_with_mask(cut, pa.array(other), pa.array([w or "" for w in words], cut.type))
        lists = pc.ascii_split_whitespace(cut)
        coded = lists.flatten().dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = self.words.missing([w for w in different if w])
        if fresh:
            self.learn(fresh)
        known = self.words
        parts = [known[w] if w else b"" for w in different]
        # the words of each run, laid end to end
        ids, stop = gathered(parts, coded.indices.to_numpy(zero_copy_only=False))
        ends = np.concatenate([[0], stop])[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()]
        if whole:
            starts = np.concatenate([[0], ends[:-1]])
            ids, ends = gathered([whole.get(k, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))], np.arange(len(runs)))
        return ids, ends

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text of a block."""
        texts = (pa.array(texts, pa.string()) if isinstance(texts, list) else texts).fill_null("")
        apart = pc.match_substring_regex(texts, self.apart)
        lists = pc.utf8_split_whitespace(pc.if_else(apart, "", texts))
        coded = lists.flatten().dictionary_encode()
        ids, ends = self.store(coded.dictionary)
        data, stop = laid_out(ids, ends, coded.indices.to_numpy(zero_copy_only=False))
        data = data.tobytes()
        bounds = (4 * np.concatenate([[0], stop])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]).tolist()
        out = [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for k in np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self.direct(texts[k].as_py())
        return out


def laid_out(ids: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of `ids` that end at `ends`, in the order of `at`, and where each ends in the result."""
    starts = np.concatenate([[0], ends[:-1]])
    each = (ends - starts)[at]
    stop = np.cumsum(each)
    return ids[np.repeat(starts[at] - (stop - each), each) + np.arange(stop[-1] if len(stop) else 0)], stop


def gathered(parts: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // 4
    return laid_out(np.frombuffer(b"".join(parts), "<u4"), ends, at)


_encoders: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One encoder for each worker and file."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids, closed by END_OF_TEXT and cut after every `capacity` of them: place, length and checksum."""

    end_id = END_OF_TEXT.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for batch in blocks(batches, "text", BLOCK):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                ids += end_id
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(price: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Knapsack: the pattern of classes 1..units, with repeats, that fits in `units` and has the highest price."""
    value, taken = np.zeros(units + 1), np.zeros(units + 1, np.int64)
    for w in range(1, units + 1):
        gain = value[w - 1 :: -1][:w] + price[:w]
        k = int(np.argmax(gain))
        if gain[k] > value[w - 1] + 1e-12:
            value[w], taken[w] = gain[k], k + 1
        else:
            value[w] = value[w - 1]
    pattern, w = np.zeros(len(price), np.int64), units
    while w > 0:
        if taken[w]:
            pattern[taken[w] - 1] += 1
            w -= taken[w]
        else:
            w -= 1
    return float(value[units]), pattern


def generate_columns(demand: np.ndarray, gap: float = 1e-3, rounds: int = 3000, pull: float = 0.6) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and how often each is used in a solution of the linear program.

    The program: fewest sequences such that every class gets at least its slots. It starts from one class a pattern; the
    revised simplex method takes in the pattern that the knapsack prices best. Prices are first drawn towards those of
    the best bound so far, which keeps them from swinging; only where they give nothing are the true ones tried. The
    end is reached when the solution is within `gap` of the bound, prices over the worth of the best pattern (Farley).
    A class whose price falls under zero may be over-supplied: its surplus enters the basis.
    """
    units, used = len(demand), np.flatnonzero(demand)
    m, wanted = len(used), demand[used].astype(float)
    columns = np.zeros((m, units), np.int64)
    columns[np.arange(m), used] = units // (used + 1)
    cost = np.ones(m)
    inverse = np.diag(1.0 / columns[np.arange(m), used])
    amount = inverse @ wanted
    centre, bound = np.zeros(m), 0.0

    def priced(values: np.ndarray) -> tuple[float, np.ndarray]:
        price = np.zeros(units)
        price[used] = np.maximum(values, 0.0)
        return best_pattern(price, units)

    for _ in range(rounds):
        true = cost @ inverse
        low = int(np.argmin(true))
        if true[low] < -1e-7:
            column, price_in = np.zeros(units, np.int64), 0.0
            column[used[low]] = -1
        else:
            for mixed in (pull * centre + (1 - pull) * true, true) if bound else (true,):
                worth, column = priced(mixed)
                here = float(np.maximum(mixed, 0) @ wanted) / max(1.0, worth)
                if here > bound:
                    bound, centre = here, np.maximum(mixed, 0) / max(1.0, worth)
                if true @ column[used] > 1 + 1e-7:
                    break
            else:
                break
            price_in = 1.0
        if cost @ amount <= bound * (1 + gap):
            break
        step = inverse @ column[used].astype(float)
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = amount[up] / step[up]
        out = int(np.argmin(ratio))
        theta = ratio[out]
        amount -= theta * step
        amount[out] = theta
        np.maximum(amount, 0, out=amount)
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        columns[out], cost[out] = column, price_in
    return columns[cost > 0], amount[cost > 0]


def best_fit(demand: np.ndarray) -> list[np.ndarray]:
    """Patterns for the few pieces that rounding leaves: best fit, largest class first."""
    units, bins = len(demand), []
    free: dict[int, list[int]] = {}
    for size in range(units, 0, -1):
        for _ in range(int(demand[size - 1])):
            room = next((f for f in range(size, units + 1) if free.get(f)), None)
            if room is None:
                bins.append(np.zeros(units, np.int64))
                i, room = len(bins) - 1, units
            else:
                i = free[room].pop()
            bins[i][size - 1] += 1
            free.setdefault(room - size, []).append(i)
    return bins


@dataclass
class Plan:
    """For each class its slots in order: runs of sequences that hold the same number of that class."""

    before: list[np.ndarray]
    each: list[np.ndarray]
    first: list[np.ndarray]

    def sequence(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.empty(len(size), np.int64)
        for c in np.unique(size):
            rows = size == c
            k = rank[rows]
            run = np.searchsorted(self.before[c - 1], k, side="right") - 1
            out[rows] = self.first[c - 1][run] + (k - self.before[c - 1][run]) // self.each[c - 1][run]
        return out


def plan_sequences(demand: np.ndarray) -> Plan:
    """Whole numbers of patterns that cover the demand: the linear solution rounded down, the rest by best fit."""
    patterns, amount = generate_columns(demand) if demand.any() else (np.zeros((0, len(demand)), np.int64), np.zeros(0))
    times = np.floor(amount + 1e-9).astype(np.int64)
    left = np.maximum(demand - times @ patterns, 0)
    runs = [(p, int(t)) for p, t in zip(patterns, times, strict=True) if t] + [(p, 1) for p in best_fit(left)]
    first = np.cumsum([0] + [t for _, t in runs])
    before, each, begin = [], [], []
    for c in range(len(demand)):
        own = [(int(p[c]), t, int(f)) for (p, t), f in zip(runs, first, strict=False) if p[c]]
        before.append(np.cumsum([0] + [a * t for a, t, _ in own])[:-1] if own else np.zeros(1, np.int64))
        each.append(np.array([a for a, _, _ in own] or [1]))
        begin.append(np.array([f for _, _, f in own] or [0]))
    return Plan(before, each, begin)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens; one row a piece.

    Documents over `capacity` are cut into full pieces and a rest; all others stay whole. Lengths are counted by class
    (capacity / unit classes, so the count that reaches the driver has at most 256 rows whatever the input), the
    cutting-stock program is solved over the classes, and the k-th piece of a class takes the k-th slot of that class.
    Pieces are ranked in buckets of the hashed id, as many as a class's count asks for, with a table of starts, so no task
    holds a whole class; pieces without an id are dealt by their place in the staged table instead.

    Null or empty text: one piece of the closing id alone. Repeated rows are packed each for itself. Empty table: no
    rows. Only doc_id and text are read. The tokens are counted once and staged; nothing depends on a task's order.
    """
    size = F.ceil(F.col("length") / unit).cast("int")
    pieces = stage(token_pieces(docs, path, capacity).select("*", size.alias("size")), "pieces")
    demand = np.zeros(capacity // unit, np.int64)
    for row in pieces.groupBy("size").count().collect():
        demand[row["size"] - 1] = row["count"]
    plan = plan_sequences(demand)

    @F.pandas_udf("long")
    def sequence(sizes: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series(plan.sequence(sizes.to_numpy(), ranks.to_numpy()))

    buckets = F.element_at(F.array(*(F.lit(1 + int(d) // PER_BUCKET) for d in demand)), F.col("size"))
    dealt = F.xxhash64("doc_id", "start", F.when(F.col("doc_id").isNull(), F.struct("_metadata.file_name", "_metadata.row_index")))
    pieces = pieces.withColumn("bucket", F.pmod(dealt, buckets).cast("int"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("size", "bucket").count()
    starts = counts.select("size", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("size", "bucket").orderBy("doc_id", "start", "ids_crc32")
    placed = (
        pieces.withColumn("nth", F.row_number().over(order) - 1)
        .join(starts, ["size", "bucket"])
        .withColumn("rank", (F.col("first") + F.col("nth")).cast("long"))
        .withColumn("sequence_id", sequence("size", "rank"))
    )
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"),
    )
