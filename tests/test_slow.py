"""Whole documents through the cleaning chain and the chunkers, against plain loops."""

import random
import re

from pyspark.sql import functions as F

from lexmill.functions import text as t
from lexmill.operators import chunking as k
from lexmill.operators import corpus as c

SF = "/root/testdata/sf0.001"


def has(pattern, text):
    return re.search(pattern, text, re.A) is not None


def strip(text):
    return re.sub(r"\A\s+|\s+\Z", "", text, flags=re.A)


def slow_noise(lines):
    run, out = 0, []
    for line in map(strip, lines):
        noise = (has(c.ADVERT, line) and len(line) < c.ADVERT_CHARS) or has(c.DECORATION, line) or has(c.PAGE_NUMBER, line) or has(c.RUNNING_HEAD, line)
        contents = has(c.CONTENTS_DOTS, line) or has(c.CONTENTS_LEADER, line) or (run >= c.CONTENTS_START and has(c.CONTENTS_TAIL, line))
        if line == "" or not (noise or (contents and run < c.CONTENTS_RUN)):
            out.append(line)
        if line and not noise:
            run = run + 1 if contents else 0
    return out


def slow_joining(lines):
    out, held = [], ""

    def close():
        nonlocal held
        if held:
            out.append(held)
        held = ""

    for line in map(strip, lines):
        if line == "" or line.startswith("#"):
            close()
            out.extend([line, ""] if line else [""])
            continue
        joined = held != ""
        if joined:
            end = held[-1]
            if has(c.HEADING, line) or has(c.CHAPTER, line) or has(c.PAGE_NUMBER, line) or end in c.SENTENCE_ENDS or len(held) <= c.SHORT_LINE or line[0] in c.OPENERS:
                close()
                held = line
            else:
                glue = "" if has(f"[{t.HAN}]", end) and has(f"^[{t.HAN}]", line) else " "
                held = held + glue + line
        else:
            held = line
        if joined and len(held) > c.LONG_LINE:
            close()
    close()
    return out


def slow_repeats(blocks, least=c.REPEAT_CHARS):
    seen, out = set(), []
    for block in blocks:
        key = re.sub(r"\s+", "", block, flags=re.A)
        if len(key) < least or key not in seen:
            out.append(block)
        seen.add(key)
    return out


def slow_normalise(text):
    text = re.sub(r"\r\n?", "\n", text.translate({ord(z): None for z in t.ZERO_WIDTH}))
    lines = text.split("\n")
    first = next((i for i, x in enumerate(lines[: c.FRONT_LINES]) if len(strip(x)) >= c.FRONT_CHARS and has(f"[{t.HAN}]", x)), 0)
    joined = "\n".join(slow_joining(slow_noise(lines[first:])))
    out = "\n\n".join(slow_repeats(joined.split("\n\n")))
    out = re.sub(r"[ \t]{2,}", " ", out.translate(str.maketrans(t.QUOTES, t.CORNERS)))
    out = re.sub(f"([{t.BIGRAM_HAN}])\\s+([{t.CLOSING}])", r"\1\2", out, flags=re.A)
    out = re.sub(f"([{t.OPENING}])\\s+", r"\1", out, flags=re.A)
    out = re.sub(r"\n{3,}", "\n\n", out)
    out = re.sub(r"(?m)[ \t]+$", "", out)
    return strip(re.sub(r"\n{3,}", "\n\n", out))


def pack(units, size):
    out, held = [], ""
    for u in filter(None, map(strip, units)):
        if len(u) > size:
            out += [held] * bool(held) + [u[i : i + size] for i in range(0, len(u), size)]
            held = ""
        elif not held or len(held) + len(u) + 1 <= size:
            held = f"{held}\n{u}" if held else u
        else:
            out.append(held)
            held = u
    return out + [held] * bool(held)


def units_of(lines, opens, size):
    out, unit = [], ""
    for line in lines:
        if opens(unit, line) or len(unit) + len(line) > size:
            out += [unit] * bool(unit)
            unit = line
        else:
            unit = f"{unit}\n{line}" if unit else line
    return out + [unit] * bool(unit)


def lectures(lines):
    out, held = [], ""
    for para in lines:
        if len(para) > k.LECTURE:
            step = k.LECTURE - k.OVERLAP
            out += [held] * bool(held) + [para[i : i + k.LECTURE] for i in range(0, len(para), step)]
            held = ""
        elif len(held) + len(para) + 1 <= k.LECTURE:
            held = f"{held}\n{para}" if held else para
        else:
            out += [held] * bool(held)
            held = strip(f"{held[-k.OVERLAP :]}\n{para}") if len(held) > k.OVERLAP else para
    return out + [held] * bool(held)


def slow_chunks(text, role, script=t.LATIN):
    """(section, piece) of each chunk that passes the gates; texts without front matter."""
    body = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", text)
    body = re.sub(r"(?m)^[ \t]*[-=]{3,}[ \t]*$", "", re.sub("`{1,3}", "", body))
    body = re.sub(r"[ \t]{2,}", " ", body)
    out = []
    for part in re.split(r"\n(?=#{1,6}[ \t]+\S)", body):
        head = re.match(r"#{1,6}[ \t]+([^\n]+)\n?", part)
        rest = strip(part[head.end() :] if head else part)
        lines = [x for x in map(strip, rest.split("\n")) if x]
        if role == "case":
            pieces = pack(units_of(lines, lambda u, x: has(k.CASE_START, x) and len(u) >= k.CASE_LEAST, k.CASE_UNIT), k.CASE)
        elif role == "lecture":
            pieces = lectures(lines)
        else:
            pieces = pack(units_of(lines, lambda u, x: has(k.CLAUSE, x) and u != "", k.CLASSIC_UNIT), k.CLASSIC)
        for piece in map(strip, pieces):
            share = len(re.findall(f"[{script}]", piece)) / len(piece) if piece else 0
            if len(piece) >= k.LEAST_CHARS and share >= k.LEAST_RATIO:
                out.append((head[1].strip(" ") if head else "", piece))
    return out


def made_texts():
    """Chinese texts with everything that the cleaning rules look at."""
    rng = random.Random(3)
    han = "太阳病头痛发热汗出恶风者桂枝汤主之服已须臾啜热稀粥一升余以助药力"
    said = lambda a, b: "".join(rng.choice(han) for _ in range(rng.randint(a, b)))
    odd = [
        "", "", "  ", "关注公众号", "=====", "- 12 -", "第 3 章", "# 标题", "第一条 " + han, "一、" + han, "篇目……………12", "桂枝汤方  12", "“引文　” ，后", "（ 括号", "1. 条目", "男，45岁", "案一", "Page 7",
        "abc def", "https://x.yz", "​零宽", "尾\r",
    ]
    for _ in range(60):
        once = said(70, 90)
        yield "\n".join(rng.choice([said(1, 15), said(20, 60) + rng.choice(["。", "，", "", "："]), once, rng.choice(odd), rng.choice(odd)]) for _ in range(rng.randint(1, 120)))


def test_normalised_documents(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + list(made_texts())
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = dict(map(tuple, frame.select("id", c.normalise(F.col("text"))).collect()))
    for i, text in enumerate(texts):
        assert got[i] == slow_normalise(text), i


def test_chunked_documents(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + list(made_texts())
    roles = ["classic", "case", "lecture"]
    rows = [("s", str(i), "", roles[i % 3], text) for i, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "school string, source string, title string, role string, text string")
    for script in (t.LATIN, t.HAN):
        got = {}
        for r in k.document_chunks(frame, script).orderBy("source", "chunk_index").collect():
            got.setdefault(int(r["source"]), []).append((r["section"], r["content"].split("】\n", 1)[1]))
        for i, text in enumerate(texts):
            want = [(section or str(i), piece) for section, piece in slow_chunks(text, roles[i % 3], script)]
            assert got.get(i, []) == want, i
