"""Operator 2: byte-level BPE by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.llm.common import blocks

#: Entries that a worker keeps of each cache before it starts anew.
CACHE = 300_000
#: Places of the table of pairs that are told many at once (a power of 2); a pair overwrites what has its place.
PAIRS = 1 << 20
#: Characters from which on a run is not kept, bytes from which on a piece is taken back token by token alone.
LONG = 64
#: Pieces below which taking back many at once doesn't pay.
FEW = 48
#: Stands between pieces in the automaton's input: above every byte, so no token crosses it.
BAR = "\u0100"
NONE = -1


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others
    follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Exact BPE of one vocabulary file.

    Encoding a piece: at each place take the longest token that matches there (found by an Aho-Corasick automaton over
    all tokens). The token stands if BPE would leave it side by side with the token before it; else the next shorter
    token is tried, and if none is left the token before is taken back. Places found to be dead ends are remembered, so
    the work is linear in the piece's length. Whether two tokens can stand side by side follows from the merge table:
    undo their last merges in turn, and see that no earlier merge crosses the border.

    The different pieces of a block of texts are encoded together: one run of the automaton gives the longest matches of
    all, one look at the pair table tells which pieces are done by that, and the others are taken back in step with more
    matches from the trie of the same tokens, a token
    of each piece at a time. Long pieces are taken back alone.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.tokens[i] = raw(token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.ids = {t: i for t, i in ((raw(t), i) for t, i in vocab.items() if t not in self.special)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            pair = vocab[a], vocab[b]
            self.rank.setdefault(pair, rank)
            made = vocab[a + b]
            if made not in self.born:
                self.born[made], self.halves[made] = rank, pair
        self.shorter = self._prefixes()
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        lengths = np.fromiter(map(len, self.tokens), np.int64, size)
        self.lengths, self.offsets = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self._trie()
        self.next_shorter = np.array(self.shorter)
        self.size = size
        keys = np.fromiter((a * size + b for a, b in self.rank), np.int64, len(self.rank))
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], np.fromiter(self.rank.values(), np.int64, len(keys))[order]
        self.made, self.left, self.right = np.full(size, NONE), np.full(size, NONE), np.full(size, NONE)
        for token, rank in self.born.items():
            self.made[token], (self.left[token], self.right[token]) = rank, self.halves[token]
        self.pair_keys, self.pair_fits = np.full(PAIRS, NONE), np.zeros(PAIRS, bool)
        #: Decimal ids followed by a comma, then followed by the end of their run.
        self.names = [f"{i}," for i in range(size)] + [f"{i} " for i in range(size)]
        self.runs = Runs()
        self.run_ids: list[str | None] = []
        self._forget()

    def _forget(self) -> None:
        """Pieces met, by number; and of each number, where its ids are in one array and how many they are."""
        self.pieces: dict[str, int] = {}
        self.ids_of, self.begins, self.counts = (np.empty(0, np.int64) for _ in range(3))

    def _prefixes(self) -> list[int]:
        """For each token the longest token that is a proper prefix of it."""
        out = [NONE] * len(self.tokens)
        for token, i in self.ids.items():
            out[i] = next((self.ids[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ids), NONE)
        return out

    def _trie(self) -> None:
        """The tokens' trie as arrays: the children of a node by byte, sorted, and the token that ends at a node."""
        nodes: dict[bytes, int] = {b"": 0}
        edges: list[int] = []
        for token in self.ids:
            for n in range(1, len(token) + 1):
                if token[:n] not in nodes:
                    edges.append(nodes[token[: n - 1]] * 256 + token[n - 1])
                    nodes[token[:n]] = len(nodes)
        self.edges = np.array(edges)
        order = np.argsort(self.edges)
        self.edges, self.children = self.edges[order], order + 1
        self.token_at = np.full(len(nodes), NONE)
        for token, i in self.ids.items():
            self.token_at[nodes[token]] = i
        #: Nodes of all two bytes; NONE where no token begins so.
        self.second = np.full(1 << 16, NONE)
        roots = np.fromiter((nodes.get(bytes([b]), NONE) for b in range(256)), np.int64, 256)
        deep = np.isin(self.edges >> 8, roots)
        byte_of = np.zeros(len(nodes), np.int64)
        byte_of[roots[roots != NONE]] = np.flatnonzero(roots != NONE)
        self.second[byte_of[self.edges[deep] >> 8] * 256 + (self.edges[deep] & 255)] = self.children[deep]
        self.first = np.where(roots == NONE, NONE, self.token_at[roots])

    def longest_at(self, data: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The longest token at each place of the bytes, where `left` bytes may be used, one at least."""
        out = self.first[data]
        live = np.flatnonzero(left > 1)
        node = self.second[data[live] * 256 + data[live + 1]]
        depth, last = 2, len(self.edges) - 1
        while True:
            on = node != NONE
            live, node = live[on], node[on]
            if not len(live):
                return out
            ends = self.token_at[node]
            out[live] = np.where(ends == NONE, out[live], ends)
            on = left[live] > depth
            live, node = live[on], node[on]
            keys = node * 256 + data[live + depth]
            at = np.minimum(np.searchsorted(self.edges, keys), last)
            node = np.where(self.edges[at] == keys, self.children[at], NONE)
            depth += 1

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes gives just these two tokens (an entry of the pair table)."""
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= 4 * CACHE:
                self.compatible.clear()
            known = self.compatible[left, right] = self._fits(left, right)
        return known

    def _fits(self, a: int, b: int) -> bool:
        """Going back in time, the border has the tokens a and b beside it; a merge of them must come too late.

        Undone is always the later-made of the two, so `until` is the time at which a or b stopped being as it is. With
        equal ranks (the same merge on both sides) the left one is made first.
        """
        born, halves, rank = self.born, self.halves, self.rank
        until = (1 << 60, 0)
        while True:
            met = rank.get((a, b))
            # the merge at the border would run at its rank; it does not overtake a merge that is first or further left
            if met is not None and (met, 1) < until:
                return False
            made_a, made_b = born.get(a, NONE), born.get(b, NONE)
            if made_a == NONE and made_b == NONE:
                return True
            if made_a > made_b:
                until, a = (made_a, 0), halves[a][1]
            else:
                until, b = (made_b, 2), halves[b][0]

    def fit_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`fits` of many pairs; a table of fixed size remembers pairs."""
        keys = left * self.size + right
        places = (keys * 0x9E3779B1 >> 15) & (PAIRS - 1)
        out = self.pair_fits[places]
        new = np.flatnonzero(self.pair_keys[places] != keys)
        if len(new):
            pairs, which = np.unique(keys[new], return_inverse=True)
            told = self._fit_pairs(*np.divmod(pairs, self.size))
            out[new] = told[which]
            # of pairs with one place the last is kept, key and answer alike
            kept, first = np.unique(((pairs * 0x9E3779B1 >> 15) & (PAIRS - 1))[::-1], return_index=True)
            self.pair_keys[kept], self.pair_fits[kept] = pairs[::-1][first], told[::-1][first]
        return out

    def _fit_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`_fits` of many pairs, an undone merge of each at a time; a time and its side are one number here."""
        out = np.ones(len(a), bool)
        live, until = np.arange(len(a)), np.full(len(a), 1 << 60)
        last = len(self.merge_keys) - 1
        while len(live):
            keys = a * self.size + b
            at = np.minimum(np.searchsorted(self.merge_keys, keys), last)
            early = (self.merge_keys[at] == keys) & (3 * self.merge_ranks[at] + 1 < until)
            out[live[early]] = False
            made_a, made_b = self.made[a], self.made[b]
            on = np.flatnonzero(~early & ((made_a != NONE) | (made_b != NONE)))
            live, a, b, made_a, made_b = live[on], a[on], b[on], made_a[on], made_b[on]
            later = made_a > made_b
            until = np.where(later, 3 * made_a, 3 * made_b + 2)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece of pre-tokenised text."""
        whole = self.ids.get(piece)
        if whole is not None and len(piece) == 1:
            return (whole,)
        n = len(piece)
        tokens, shorter, fits = self.tokens, self.shorter, self.fits
        longest: list[int] = [NONE] * n
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            start = end - len(tokens[i]) + 1
            # ends come in rising order, so the last token noted for a start is its longest
            longest[start] = i
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + len(tokens[token])
            if not dead[end] and (not out or fits(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else NONE
                continue
            token = shorter[token]
            while token == NONE:
                dead[at] = 1
                token = out.pop()
                at -= len(tokens[token])
                token = shorter[token]
        return tuple(out)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces, one after another, and how many each has.

        Tokens of which each fits the one before are what BPE gives, so longest matches that fit need no other check.
        """
        raw = [piece.encode().decode("latin-1") for piece in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        found = np.fromiter(chain.from_iterable(self.automaton.iter_long(BAR.join(raw))), np.int64).reshape(-1, 2)
        stops, ids = found[:, 0] + 1, np.ascontiguousarray(found[:, 1])
        starts = stops - self.lengths[ids]
        owner = np.searchsorted(begins, starts, side="right") - 1
        good = np.bincount(owner, self.lengths[ids], len(raw)) == sizes
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        good[owner[inner[starts[inner + 1] != stops[inner]]]] = False
        good[owner[inner[~self.fit_pairs(ids[inner], ids[inner + 1])]]] = False
        again = np.flatnonzero(~good)
        if len(again):
            short = sizes[again] < LONG
            many, alone = again[short], again[~short]
            if len(many) < FEW:
                many, alone = many[:0], again
            lists = [self.encode_piece(raw[k].encode("latin-1")) for k in alone]
            more, counts = self._take_back([raw[k] for k in many], sizes[many])
            stay = good[owner]
            owner = np.concatenate([owner[stay], np.repeat(many, counts), np.repeat(alone, np.array([len(x) for x in lists], np.int64))])
            ids = np.concatenate([ids[stay], more, np.fromiter(chain.from_iterable(lists), np.int64)])
            ids = ids[np.argsort(owner, kind="stable")]
        return ids, np.bincount(owner, minlength=len(raw))

    def _take_back(self, raw: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What `encode_piece` does, for many short pieces in step; ids one after another, and how many each has."""
        n = len(raw)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        stop = np.cumsum(sizes)
        begins = stop - sizes
        data = np.frombuffer("".join(raw).encode("latin-1"), np.uint8).astype(np.int64)
        longest = np.append(self.longest_at(data, np.repeat(stop, sizes) - np.arange(len(data))), NONE)
        # a piece's end is the begin of the next, which is never a dead end
        dead = np.zeros(len(longest), bool)
        out, depth = np.full((n, int(sizes.max())), NONE), np.zeros(n, np.int64)
        live, at = np.arange(n), begins.copy()
        token = longest[at]
        while len(live):
            # token: what is tried next at a place; NONE when nothing shorter is left there
            deep, none = depth[live], token == NONE
            before = out[live, deep - 1]
            back = np.flatnonzero(none)
            dead[at[back]] = True
            depth[live[back]] -= 1
            at[back] -= self.lengths[before[back]]
            token[back] = self.next_shorter[before[back]]
            end = at + self.lengths[token]
            tried = np.flatnonzero(~none)
            tried = tried[~dead[end[tried]]]
            inner = deep[tried] > 0
            fits = np.ones(len(tried), bool)
            fits[inner] = self.fit_pairs(before[tried[inner]], token[tried[inner]])
            stands = np.zeros(len(live), bool)
            stands[tried[fits]] = True
            falls = np.flatnonzero(~stands & ~none)
            token[falls] = self.next_shorter[token[falls]]
            stood = tried[fits]
            out[live[stood], deep[stood]] = token[stood]
            depth[live[stood]] += 1
            at[stood] = end[stood]
            token[stood] = longest[at[stood]]
            on = at < stop[live]
            if not on.all():
                live, at, token = live[on], at[on], token[on]
        return out[np.arange(out.shape[1]) < depth[:, None]], depth

    def encode(self, text: str) -> list[str]:
        """Decimal ids of the text, in comma-joined runs."""
        return self.encode_texts([text])

    def encode_texts(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text, joined by commas."""
        if not self.special or not any(s in text for text in texts for s in self.special):
            return self._plain(texts)
        parts = [self.split_special.split(text) for text in texts]
        plain = iter(self._plain([part for some in parts for part in some if part not in self.special]))
        return [",".join(filter(None, [str(self.special[part]) if part in self.special else next(plain) for part in some])) for some in parts]

    def _plain(self, texts: list[str]) -> list[str]:
        """A single space between two non-spaces starts a new piece, so runs between such spaces are encoded apart.

        Runs are numbered when first met, worked out for all texts together and kept for later ones; None stands for a
        run with white space (or nothing) beside a space. Texts with such a run are cut whole.
        """
        runs, ids, findall = self.runs, self.run_ids, self.pattern.findall
        if len(ids) > CACHE:
            runs.clear()
            ids.clear()
        runs.count, runs.new = len(ids), []
        heads, numbers = [], []
        for text in texts:
            head, *rest = text.split(" ")
            heads.append(head)
            numbers.append(list(map(runs.__getitem__, rest)))
        plain = [bool(run) and not run[0].isspace() and not run[-1].isspace() for run in runs.new]
        if any(plain):
            pieces = findall(" " + " ".join(compress(runs.new, plain)))
            first = np.fromiter((piece[0] == " " for piece in pieces), bool, len(pieces))
            told = iter(self._joined(pieces, np.append(first[1:], True)))
            ids += [next(told) if x else None for x in plain]
        else:
            ids += [None] * len(plain)
        values = [list(map(ids.__getitem__, some)) for some in numbers]
        for run in runs.new:
            if len(run) >= LONG:
                ids[runs.pop(run)] = None
        pieces, ends = [], []
        for k, (text, head) in enumerate(zip(texts, heads, strict=True)):
            if values[k] and (not head or head[-1].isspace() or None in values[k]):
                values[k], head = [], text
            if head:
                pieces += findall(head)
            ends.append(len(pieces))
        last = np.zeros(len(pieces) + 1, bool)
        last[np.array(ends, np.int64) - 1] = True
        opening = iter(self._joined(pieces, last[:-1]))
        begins = [0, *ends]
        return [",".join([next(opening), *some]) if begin < end else "" for some, begin, end in zip(values, begins, ends)]

    def _joined(self, pieces: list[str], last: np.ndarray) -> list[str]:
        """Decimal ids of runs of pieces; `last` marks the last piece of each run."""
        if not pieces:
            return []
        different = set(pieces)
        new = different.difference(self.pieces)
        if len(self.counts) + len(new) > CACHE or len(self.ids_of) > 8 * CACHE:
            self._forget()
            new = different
        known = self.pieces
        if new:
            ids, counts = self.encode_pieces(list(new))
            known.update(zip(new, range(len(self.counts), len(self.counts) + len(new))))
            self.begins = np.concatenate([self.begins, len(self.ids_of) + np.cumsum(counts) - counts])
            self.ids_of, self.counts = np.concatenate([self.ids_of, ids]), np.concatenate([self.counts, counts])
        which = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        for piece in new:
            if len(piece) >= LONG:
                del known[piece]
        sizes = self.counts[which]
        stops = np.cumsum(sizes)
        flat = self.ids_of[np.repeat(self.begins[which] - (stops - sizes), sizes) + np.arange(stops[-1])]
        flat[stops[last] - 1] += self.size
        return "".join(map(self.names.__getitem__, flat.tolist())).split(" ")[:-1]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Bytes of each document's ids; ends holds where each document's ids end.

        The offset table says where each token's bytes lie in one array, so all documents are gathered at once.
        """
        sizes = self.lengths[ids]
        stop = np.cumsum(sizes)
        where = np.repeat(self.offsets[ids] - (stop - sizes), sizes) + np.arange(stop[-1] if len(stop) else 0)
        data = self.blob[where].tobytes()
        bounds = np.concatenate([[0], stop])[np.concatenate([[0], ends])]
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class Runs(dict):
    """Numbers of runs of text; a new one gets the next number."""

    def __missing__(self, run: str) -> int:
        number = self[run] = self.count
        self.count += 1
        self.new.append(run)
        return number


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


#: Text bytes that are encoded and decoded at once.
BLOCK = 1 << 20


def digests(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    engine = codec(path)
    encoded = engine.encode_texts([text or "" for text in batch.column(1).to_pylist()])
    arrays = [np.fromstring(s, np.int64, sep=",") if s else np.empty(0, np.int64) for s in encoded]
    counts = [len(a) for a in arrays]
    id_sums = [hashlib.sha256(s.encode()).hexdigest() for s in encoded]
    decoded = engine.decode(np.concatenate(arrays), np.cumsum(counts))
    text_sums = [hashlib.sha256(data.decode("utf-8", "replace").encode()).hexdigest() for data in decoded]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums), pa.array(text_sums)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text, for each document.

    Whole texts are encoded, about BLOCK bytes at once, by a codec that each worker loads once. A special token's own text in a
    document becomes that token. Null counts as empty: no tokens, and the digests of nothing. Repeated rows give
    repeated results. Empty table: no rows. Only doc_id and text are read. Nothing is shuffled; memory a worker is the
    codec, its bounded tables and one block (one text at least) beside the Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            yield digests(batch, path)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
