import hashlib
import itertools
import re
import zlib

import pytest

from lexmill.llm.turns import Trie, answers, damage, repair, repair_report, undamaged
from lexmill.llm.queries import op13_turn_repair
from tests.llm.conftest import SF

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, part string, audit string, copy int"


def least(rows):
    """(cost, audit, repaired) over every sequence of edits, by memory of (row, output so far's place): rows are (role, text, gone, truncated)."""
    best = {}

    def search(i, roles):
        """All (cost, audit, output) from row i with the initials so far, inserts bounded by two in a row."""
        ahead = []
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", roles):
                ahead.append((0, "", ()))
        else:
            role, text, gone, truncated = rows[i]
            key = (i + 1, state(roles))
            more = 3 if truncated else 0
            ahead += [(c + 4, "D" + a, o) for c, a, o in tail(i + 1, roles)]
            if not gone:
                ahead += [(c + more, "K" + a, ((role, text), *o)) for c, a, o in tail(i + 1, roles + role[:1])]
                for new in ("user", "assistant"):
                    ahead += [(c + 3 + more, "R" + a, ((new, text), *o)) for c, a, o in tail(i + 1, roles + new[0])]
        if len(inserted) < 2:
            for new in ("user", "assistant"):
                inserted.append(new)
                ahead += [(c + 3, "I" + a, ((new, ""), *o)) for c, a, o in tail(i, roles + new[0], True)]
                inserted.pop()
        return ahead

    inserted = []

    def state(roles):
        return roles if len(roles) < 2 else roles[-1]

    def tail(i, roles, keep=False):
        if not re.fullmatch("s?(ua)*u?", roles):
            return []
        held = list(inserted)
        if not keep:
            inserted.clear()
        short = ("" if not roles else "s" if roles == "s" else "u" if roles[-1] == "u" else "ua", i, len(inserted))
        if short not in best:
            best[short] = sorted(search(i, short[0]))[:1]
        inserted[:] = held
        return best[short]

    return min(tail(0, ""))


def slow(rows):
    """The report of each conversation of undamaged rows, in plain loops."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            show = lambda v: " " if v is None else v
            role, text = show(role), show(text)
            kind = zlib.crc32(f"{show(c)}:{show(turn)}".encode()) % 20
            if kind == 1:
                text = ""
            if kind == 2:
                text = re.sub("[.!?]", "", text)
            if kind == 4:
                role = "user"
            after += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in after:
            bare = text.strip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in after if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(after))
        cost, audit, output = least(marked)
        text = "\n".join(f"{r}:{t}" for r, t in output)
        out[conv] = {"conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **counts, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}
    return out


def same(report, rows):
    got = {r["conv_id"]: r.asDict() for r in report.collect()}
    want = slow(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k], k


def test_trie_against_every_sequence_of_edits():
    trie = Trie()
    signatures = sorted("".join(s) for n in range(6) for s in itertools.product("xsuaoUA", repeat=n) if n < 5 or s[0] == "s")
    for signature in signatures[::7]:
        rows = [("o" if s == "x" else s.lower(), "t", s == "x", s.isupper()) for s in signature]
        cost, audit, _ = least(rows)
        assert trie.answer(signature) == (cost, audit), signature


def test_prefixes_are_worked_out_once():
    trie = Trie()
    signatures = sorted("".join(s) for s in itertools.product("sua", repeat=7))
    for signature in signatures:
        trie.answer(signature)
    assert trie.entered == sum(3**k for k in range(1, 8))


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_query_against_plain_loops(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(op13_turn_repair(spark, folder), rows)


@pytest.fixture(scope="module")
def odd_turns():
    rows = [(1, None, None, None), (1, None, "user", "a."), (1, 3, "user", ""), (1, 9, "", "no role."), (2, 1, "system", "x."), (2, 1, "system", "x."), (2, 1, "user", "b"), (None, 1, "user", "null id."), (None, None, "assistant", "ok."), (None, 2, "tool", "t?")]
    rows += [(3, t, "user", "same.") for t in range(40)] + [(4, 0, "assistant", "long " * 60_000 + "."), (5, 0, "agent", "中文 🙂!"), (5, 1, "sys", "\x1c\x85."), (6, -5, "user", "q?"), (6, 4_000_000_000, "assistant", "r!")]
    rows += [(7, t, ("user", "assistant", "system")[t * t % 3], f"turn {t}{'.' if t % 4 else ''}") for t in range(300)] + [(100 + k, 0, "user", "hi.") for k in range(60)]
    return rows


def test_odd_rows(spark, odd_turns):
    frame = spark.createDataFrame([(*r, "p", "a", 1) for r in odd_turns], SCHEMA).repartition(7)
    same(repair_report(damage(frame)), odd_turns)


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_report(damage(empty)).count() == 0 and repair(empty).count() == 0


def test_repair_makes_legal_conversations(spark, odd_turns):
    frame = spark.createDataFrame([(*r, "p", "a", 1) for r in odd_turns], SCHEMA)
    found = {}
    for r in repair(frame).orderBy("conv_id", "place").collect():
        found.setdefault(r["conv_id"], []).append(r)
    for rows in found.values():
        assert [r["place"] for r in rows] == list(range(len(rows)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in rows))
    report = repair_report(undamaged(frame))
    digests = {r["conv_id"]: r["repaired_sha256"] for r in report.collect()}
    for conv, rows in found.items():
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in rows).encode()).hexdigest() == digests[conv]


def test_signatures_are_solved_once(spark):
    found = spark.createDataFrame([("ua",)] * 50 + [("uaS",)] * 3 + [("",)], "signature string")
    assert sorted(tuple(r) for r in answers(found).collect()) == [("", 1, 0, ""), ("ua", 50, 0, "KK"), ("uaS", 3, 4, "KKD")]
