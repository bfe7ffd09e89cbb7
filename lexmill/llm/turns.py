"""Operator 13: repair of conversations by a dynamic program shared over a trie of their role and fault signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import in_slices, join_groups
from lexmill.session import stage

SPACES = " \t\n\x0b\x0c\r"
#: Costs of the edits and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Places in the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a row of user or assistant makes of a place; None where it can't stand.
NEXT = (USER, USER, ASSISTANT, USER)
FAR = 1 << 60
ROLES = {USER: "user", ASSISTANT: "assistant"}

# A row's symbol: x must go (blank or duplicate); else s, u, a or o by the first letter of its role, upper case if truncated.


def damage(rows: DataFrame) -> DataFrame:
    """Damage by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its . ! ? away, 3 repeats
    it, 4 makes it the user's. Nulls, in the checksum as in role and text, are read as one space.

    The frame keeps dropped rows, marked `gone`, so that a conversation without rows is still known; `copy` counts the
    repeats. Columns: conv_id, turn, role, text, gone, copy.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"),
        (kind == 0).alias("gone"), F.explode(copies).alias("copy"),
    )


def undamaged(rows: DataFrame) -> DataFrame:
    """The columns that repair works on, for conversations as they are."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"), F.lit(False).alias("gone"), F.lit(0).alias("copy"))


def ordered(rows: DataFrame) -> DataFrame:
    """With the columns that order a conversation: turn (nulls first), then role, then text by its first 32 characters
    and its digest, then copy."""
    return rows.withColumns({"head": F.substring("text", 1, 32), "digest": F.md5(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"))})


#: Ascending, so nulls come first.
ORDER = ("turn", "role", "head", "digest", "copy")


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal), one row a conversation.

    Light rows, with a digest in place of the text, are dealt out by conversation once: a window over (conversation,
    digest) tells repeats, another local sort brings them into order, and each conversation is read as a stream.
    """
    bare = F.translate("text", SPACES, "")
    flags = F.when(bare == "", "b").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise("f")
    light = ordered(rows).select("conv_id", "turn", "role", "head", "digest", "copy", "gone", F.when(F.col("gone"), "g").otherwise(flags).alias("flag"), F.substring("role", 1, 1).alias("initial"))
    seen = Window.partitionBy("conv_id", "digest", "gone").orderBy(*ORDER)
    placed = light.repartition("conv_id").withColumn("again", F.row_number().over(seen) > 1).sortWithinPartitions("conv_id", *ORDER).select("conv_id", "turn", "flag", "initial", "again")
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Conversation | None = None
        done: list[tuple] = []
        schema = None
        for batch in in_slices(batches, 4000):
            schema = schema or pa.schema([batch.schema.field("conv_id"), *_REPORT])
            for conv, turn, flag, initial, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or conv != current.conv:
                    if current is not None:
                        done.append(current.result())
                    current = _Conversation(conv)
                if flag != "g":
                    current.take(turn, flag, initial, again)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []
        if current is not None:
            done.append(current.result())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    return placed.mapInArrow(read, f"conv_id {id_type}, signature string, gaps long, blank long, duplicate long, truncated long, illegal long")


_REPORT = [pa.field("signature", pa.string()), *(pa.field(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal"))]
LEGAL = {"su", "ua", "au"}


class _Conversation:
    """Counts of one conversation while its rows pass."""

    def __init__(self, conv):
        self.conv, self.symbols = conv, bytearray()
        self.low = self.high = self.last_turn = self.last_initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def take(self, turn: int | None, flag: str, initial: str, again: bool) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        if self.last_initial is not None:
            self.illegal += self.last_initial + initial not in LEGAL
        self.last_initial = initial
        symbol = initial if initial in ("s", "u", "a") else "o"
        if flag == "b":
            self.blank += 1
            symbol = "x"
        elif again:
            self.duplicate += 1
            symbol = "x"
        elif flag == "t":
            self.truncated += 1
            symbol = symbol.upper()
        self.symbols += symbol.encode()

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, self.symbols.decode(), gaps, self.blank, self.duplicate, self.truncated, self.illegal


def opened(costs: tuple[int, ...]) -> tuple[int, ...]:
    """Least cost of each place after any inserts; two in a row are the most that can help."""
    user = min(costs[USER], INSERT + min(costs[START], costs[SYSTEM], costs[ASSISTANT]))
    assistant = min(costs[ASSISTANT], INSERT + user)
    return costs[START], costs[SYSTEM], user, assistant


def edits(symbol: str, place: int) -> list[tuple[str, int, int]]:
    """(edit, next place, cost) of a row at a place, edits in ASCII order."""
    out = [("D", place, DELETE)]
    if symbol == "x":
        return out
    more = TRUNCATED if symbol.isupper() else 0
    letter = symbol.lower()
    kept = SYSTEM if letter == "s" and place == START else NEXT[place] if letter == ("a" if place == USER else "u") else None
    if kept is not None:
        out.append(("K", kept, more))
    out.append(("R", NEXT[place], REROLE + more))
    return out


#: Edits for each symbol and place.
EDITS = {s: [edits(s, p) for p in range(4)] for s in "xsuaoSUAO"}


def layer(costs: tuple[int, ...], symbol: str) -> tuple[int, ...]:
    """Least cost of each place after one more row."""
    out = [FAR] * 4
    for place, cost in enumerate(opened(costs)):
        for _, to, more in EDITS[symbol][place]:
            out[to] = min(out[to], cost + more)
    return tuple(out)


class Trie:
    """Layers along the current path of a prefix trie; signatures that come in order share the layers of their prefix.

    In sorted order a trie is walked depth first, so of all its nodes only those on the path to the current signature
    need to be held; a node is entered, and its layer worked out, once.
    """

    def __init__(self):
        self.path = ""
        self.layers = [(0, FAR, FAR, FAR)]
        self.entered = 0

    def insert(self, signature: str) -> list[tuple[int, ...]]:
        shared = 0
        most = min(len(self.path), len(signature))
        while shared < most and self.path[shared] == signature[shared]:
            shared += 1
        del self.layers[shared + 1 :]
        for symbol in signature[shared:]:
            self.layers.append(layer(self.layers[-1], symbol))
            self.entered += 1
        self.path = signature
        return self.layers

    def answer(self, signature: str) -> tuple[int, str]:
        """(least cost, ASCII-least audit of that cost) at the terminal node of a signature.

        From the end backwards those places are marked that lie on a cheapest way; then the audit is read forwards, at
        each step the least letter that keeps to marked places.
        """
        layers = self.insert(signature)
        final = opened(layers[-1])
        cost = min(final[START], final[ASSISTANT])
        # after[i]: places after row i, inserts done, on a cheapest way; before[i]: the same with no insert done
        after = {p for p in (START, ASSISTANT) if final[p] == cost}
        marks: list[tuple[set[int], set[int]]] = []
        for i in range(len(signature), -1, -1):
            free, shut = opened(layers[i]), layers[i]
            after = after | {p for p in range(4) if NEXT[p] in after and NEXT[p] != p and free[p] + INSERT == free[NEXT[p]]}
            after = after | {p for p in range(4) if NEXT[p] in after and free[p] + INSERT == free[NEXT[p]]}
            marks.append((after, {p for p in after if shut[p] == free[p]}))
            if i:
                before = opened(layers[i - 1])
                after = {p for p in range(4) if any(to in marks[-1][1] and before[p] + more == shut[to] for _, to, more in EDITS[signature[i - 1]][p])}
        marks.reverse()
        out, place = [], START
        for i in range(len(signature) + 1):
            free = opened(layers[i])
            while True:
                steps = EDITS[signature[i]][place] if i < len(signature) else []
                ahead = [(letter, to) for letter, to, more in steps if to in marks[i + 1][1] and free[place] + more == layers[i + 1][to]]
                if NEXT[place] in marks[i][0] and free[place] + INSERT == free[NEXT[place]]:
                    ahead.append(("I", NEXT[place]))
                if not ahead:
                    break
                letter, place = min(ahead)
                out.append(letter)
                if letter != "I":
                    break
        return cost, "".join(out)


def answers(found: DataFrame) -> DataFrame:
    """(signature, count, cost, audit) for each distinct signature.

    Signatures are counted, dealt out by range and sorted, so a task walks one part of the trie; prefixes are worked out
    once in each part.
    """
    distinct = found.groupBy("signature").agg(F.count("*").alias("count"))
    schema = pa.schema([("signature", pa.string()), ("count", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in in_slices(batches, 1000):
            solved = [trie.answer(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c for c, _ in solved], pa.int64()), pa.array([a for _, a in solved], pa.string())], schema=schema)

    return distinct.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(solve, "signature string, count long, cost long, audit string")


class _Replay:
    """Applies an audit to the rows of a conversation as they pass; rows that an audit deletes give nothing."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, START

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.place = NEXT[self.place]
            yield ROLES[self.place], ""

    def take(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.place = SYSTEM if self.place == START and role.startswith("s") else NEXT[self.place]
            yield role, text
        elif edit == "R":
            self.place = NEXT[self.place]
            yield ROLES[self.place], text


def solved(rows: DataFrame) -> DataFrame:
    """(conv_id, audit, cost, gaps, blank, duplicate, truncated, illegal) for each conversation, written out.

    Few signatures may hold most conversations, so an answer goes to its conversations by join_groups: those of the
    commonest signatures stay where they are.
    """
    found = stage(signatures(rows), "signatures")
    return stage(join_groups(found, stage(answers(found), "answers"), "signature", "count", found.count()).drop("count", "signature"), "audits")


def replayed(rows: DataFrame, audits: DataFrame, digest: bool) -> DataFrame:
    """Repaired conversations: (conv_id, place, role, text), or with `digest` (conv_id, repaired_sha256).

    Rows and audits are dealt out by conversation and sorted, the audit first, so a conversation of any length passes as a
    stream and its digest grows row by row.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    marked = audits.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("head"), F.lit("").alias("digest"), F.lit(0).alias("copy"), F.col("audit").alias("text"))
    texts = ordered(rows.filter(~F.col("gone"))).select("conv_id", F.lit(1).alias("part"), "turn", "role", "head", "digest", "copy", "text")
    both = marked.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "part", *ORDER).select("conv_id", "part", "role", "text")

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Lists of (conv_id, first, role, text) in order; each conversation begins with a row whose role is None."""
        replay, conv = None, None
        for batch in in_slices(batches, 2000):
            out: list[tuple] = []
            for key, part, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == 0:
                    if replay is not None:
                        out += [(conv, r, t) for r, t in replay.inserts()]
                    replay, conv = _Replay(text), key
                    out.append((key, None, None))
                else:
                    out += [(conv, r, t) for r, t in replay.take(role, text)]
            yield out
        if replay is not None:
            yield [(conv, r, t) for r, t in replay.inserts()]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def head(batches):
            nonlocal kind
            for batch in batches:
                kind = kind or batch.schema.field("conv_id").type
                yield batch

        running, conv, any_yet = None, None, False
        for part in turns(head(batches)):
            done: list[tuple] = []
            for key, role, text in part:
                if role is None:
                    if running is not None:
                        done.append((conv, running.hexdigest()))
                    running, conv, any_yet = hashlib.sha256(), key, False
                else:
                    running.update((("\n" if any_yet else "") + role + ":" + text).encode())
                    any_yet = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([h for _, h in done])], ["conv_id", "repaired_sha256"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([running.hexdigest()])], ["conv_id", "repaired_sha256"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def head(batches):
            nonlocal kind
            for batch in batches:
                kind = kind or batch.schema.field("conv_id").type
                yield batch

        place = 0
        for part in turns(head(batches)):
            out: list[tuple] = []
            for key, role, text in part:
                if role is None:
                    place = 0
                else:
                    out.append((key, place, role, text))
                    place += 1
            if out:
                keys, places, roles, texts_ = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(places, pa.int64()), pa.array(roles), pa.array(texts_)], ["conv_id", "place", "role", "text"])

    if digest:
        return both.mapInArrow(hashed, f"conv_id {id_type}, repaired_sha256 string")
    return both.mapInArrow(listed, f"conv_id {id_type}, place long, role string, text string")


def repair(conversations: DataFrame) -> DataFrame:
    """Conversations with the cheapest edits made: (conv_id, place, role, text), places gapless from 0.

    A conversation whose rows are all deleted gives no rows.
    """
    rows = undamaged(conversations)
    return replayed(rows, solved(rows).select("conv_id", "audit"), digest=False)


def repair_report(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired text, one row for each conversation.

    `rows` come from damage() or undamaged(). A row's first fault counts: blank, duplicate (role and text seen earlier in
    the conversation), truncated. Rows go by turn, nulls first; within a turn by role, then text. Null ids are one
    conversation; repeated rows are duplicates; a conversation without rows (all dropped) has zeros, an empty audit and
    the digest of nothing. Roles other than user, assistant and system, empty ones too, can only be given a new role or
    be deleted. Empty table: no rows. Other columns of the input are not read.
    """
    found = solved(rows)
    sums = replayed(rows, found.select("conv_id", "audit"), digest=True)
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
    return found.alias("a").join(sums.alias("b"), same).select("a.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
