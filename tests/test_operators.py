"""Operators on small rows worked out by hand."""

import io
import math
import random
import re
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as t
from lexmill.functions.vectors import cosine, fit_dimension
from lexmill.operators import build, chunking, corpus, evaluation, opinions, retrieval, rules, store
from lexmill.sources import binary, knowledge
from lexmill.streaming.ingest import compact, current_rows, ingest_stream, session_events, windowed_counts

HAN = "太阳病头痛发热汗出恶风者桂枝汤主之"


def one(spark, expression, **columns):
    names = list(columns) or ["x"]
    frame = spark.createDataFrame([tuple(columns.values()) or (1,)], names)
    return frame.select(expression.alias("y")).first()["y"]


def test_tokens(spark):
    assert one(spark, t.search_tokens(F.col("x")), x="桂枝汤 Abc réel 桂枝") == ["桂枝", "枝汤", "abc", "r", "el"]
    assert one(spark, t.search_tokens(F.col("x"), unique=False), x="汤 a a") == ["汤", "a", "a"]
    assert one(spark, t.feature_tokens(F.col("x")), x="桂枝 AB 汤") == ["桂", "枝", "汤", "桂枝", "ab"]


@pytest.mark.parametrize(("x", "y"), [("", 0.0), ("ab", 0.0), ("a桂", 0.5)])
def test_script_ratio(spark, x, y):
    assert one(spark, t.script_ratio(F.col("x")), x=x) == y


def test_cleaning(spark):
    assert one(spark, t.clean_markdown(F.col("x")), x="a ![i](u) `b`\n---\nc   d") == "a b\n\nc d"
    assert one(spark, t.unify_punctuation(F.col("x")), x="“桂　枝” ，a") == "「桂 枝」 ，a"
    assert one(spark, t.squeeze_blank_lines(F.col("x")), x="\n\na  \n\n\n\nb\n") == "a\n\nb"
    assert one(spark, t.unify_lines(F.col("x")), x="a\r\nb\rc​") == "a\nb\nc"


def test_replies(spark):
    assert one(spark, t.json_object(F.col("x")), x='Sure:\n```json\n{"a": {"b": 1}}\n```\nbye }') == '{"a": {"b": 1}}'
    assert one(spark, t.json_object(F.col("x")), x='x {"a": 1} y') == '{"a": 1}'
    assert [one(spark, t.clamp(F.col("x"), 0.5), x=x) for x in ("2", "-1", "no", "0.3")] == [1.0, 0.0, 0.5, 0.3]
    assert [one(spark, t.mask_secret(F.col("x")), x=x) for x in ("sk-1234567abcd", "short", "")] == ["sk-…abcd", "…", ""]


def test_vectors(spark):
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.70710678)
    assert one(spark, fit_dimension(F.col("a"), 3), a=[3.0, 4.0]) == [0.6, 0.8, 0.0]


def test_front_matter(spark):
    meta, body = chunking.front_matter(F.col("x"))
    got = one(spark, F.struct(meta.alias("m"), body.alias("b")), x="---\ntitle: A: b\nrole: case\ntitle: C\nnone\n---\n# h\nx")
    assert got["m"] == {"role": "case", "title": "C"} and got["b"] == "# h\nx"


def test_sections(spark):
    got = one(spark, t.sections(F.col("x")), x="intro\n# One\nbody\n## Two\n\n#x no\n# Three\nend")
    assert [tuple(s) for s in got] == [("", "intro"), ("One", "body"), ("Two", "#x no"), ("Three", "end")]


def slow_pack(units, size):
    out, held = [], ""
    for u in (x.strip() for x in units):
        if not u:
            continue
        joined = f"{held}\n{u}" if held else u
        if len(u) > size:
            out += [held] * bool(held) + [u[i : i + size] for i in range(0, len(u), size)]
            held = ""
        elif len(joined) <= size:
            held = joined
        else:
            out, held = [*out, held], u
    return out + [held] * bool(held)


def test_packing_of_units(spark):
    rng = random.Random(1)
    for _ in range(10):
        units = ["x" * rng.choice([0, 3, 10, 30, 70]) for _ in range(rng.randint(0, 20))]
        assert one(spark, chunking.pack_units(F.split("x", "\n"), 40), x="\n".join(units)) == slow_pack(units, 40)


def test_clauses_and_cases(spark):
    lines = [f"第{i}条 " + HAN * 9 for i in (1, 2, 3, 4, 5)]
    got = one(spark, chunking.classic_chunks(F.col("x")), x="\n".join(lines))
    assert [g.count("第") for g in got] == [3, 2] and "".join(got).replace("\n", "") == "".join(lines)
    short = one(spark, chunking.case_chunks(F.col("x")), x="案一\n男，45岁\n" + HAN)
    assert len(short) == 1
    long = "案一\n" + HAN * 6 + "\n案二\n" + HAN
    units = one(spark, chunking.group_lines(chunking.full_lines(F.col("x")), lambda u, line: line.rlike(chunking.CASE_START) & (F.length(u) >= 90), 300), x=long)
    assert [u[:2] for u in units] == ["案一", "案二"]


def test_lectures(spark):
    windows = one(spark, chunking.lecture_chunks(F.col("x")), x="a" * 1500)
    assert [len(w) for w in windows] == [680, 680, 320]
    paragraphs = [c * 300 for c in "abc"]
    assert [len(x) for x in one(spark, chunking.lecture_chunks(F.col("x")), x="\n".join(paragraphs))] == [601, 391]


def test_chunks_of_a_document(spark):
    text = f"---\ntitle: 书\nrole: classic\n---\n# 一\n{HAN * 3}\n# 二\nshort\n# 三\n{'x' * 50}\n# 四\n{HAN * 4}"
    docs = spark.createDataFrame([("shanghan", "f.md", "", "classic", text)], "school string, source string, title string, role string, text string")
    got = chunking.document_chunks(docs).orderBy("chunk_index").collect()
    assert [(r["section"], r["chunk_index"], r["title"]) for r in got] == [("一", 0, "书"), ("四", 1, "书")]
    assert got[0]["content"].startswith("【书·一】\n太阳病") and got[0]["token_key"].startswith("f.md::一::0::【书·一】")
    stats = chunking.chunk_statistics(chunking.chunk_pieces(docs)).first()
    assert (stats["total"], stats["dropped_short"], stats["dropped_low_script"], stats["sections"]) == (2, 1, 1, 4)


def test_noise_lines(spark):
    contents = [f"篇目{i}……………{i}" for i in range(3)]
    lines = ["正文一句。", "关注公众号", "更多资源" + "长" * 130, "=====", "- 12 -", "第 3 章", "", *contents, "", "桂枝汤方  12", "正文又一句。", "桂枝汤方  12"]
    got = one(spark, corpus.drop_noise(F.split("x", "\n")), x="\n".join(lines))
    assert got == ["正文一句。", "更多资源" + "长" * 130, "", "", "正文又一句。", "桂枝汤方  12"]


def test_long_contents_come_back(spark):
    lines = [f"x……………{i}" for i in range(405)]
    assert len(one(spark, corpus.drop_noise(F.split("x", "\n")), x="\n".join(lines))) == 5


def test_broken_lines(spark):
    a, b = "太阳病头痛发热汗出恶风者桂枝汤主之服已须臾", "啜热稀粥一升余以助药力。"
    got = one(spark, corpus.join_broken_lines(F.split("x", "\n")), x=f"{a}\n{b}\n短行\n另一段\n\n# 题\n完")
    assert got == [a + b, "短行", "另一段", "", "# 题", "", "完"]


def test_repeated_blocks(spark):
    long = HAN * 5
    assert one(spark, corpus.drop_repeated(F.split("x", "\n\n")), x=f"{long}\n\na\n\n{long[:9]} {long[9:]}\n\na") == [long, "a", "a"]


def test_normalise_is_idempotent(spark):
    text = f"封面\n{HAN * 3}。\n\n“引文”\n{HAN * 3}"
    once = one(spark, corpus.normalise(F.col("x")), x=text)
    assert once.startswith("太阳病") and "「引文」" in once
    assert one(spark, corpus.normalise(F.col("x")), x=once) == once


def test_compendium(spark):
    def book(title, n):
        return f"图书在版编目（CIP）数据\n\n{title}/某某著．-北京：人民卫生出版社，2017\n# 整理说明\n套话\n# 正文\n" + (HAN + "\n") * n

    head = "脾胃论\n人民卫生出版社有限公司\n标准书号：123\n# 正文\n" + (HAN + "\n") * 200
    docs = spark.createDataFrame([(1, head + book("景岳全书．上", 200) + book("脉经", 200) + book("小书", 3)), (2, book("脉经", 200))], "doc_id long, text string")
    got = corpus.split_compendium(docs).orderBy("start").collect()
    assert [(r["doc_id"], r["title"], r["volume"], r["basis"]) for r in got] == [(1, "脾胃论", "", "isbn"), (1, "景岳全书", "上", "cip"), (1, "脉经", "", "cip")]
    assert all(r["text"].startswith("# 正文") for r in got[1:])


def test_compendium_moves_its_text_once(spark):
    """Lines are looked up by their marks, so no exchange but that of the documents carries text; a book without a preface
    begins at its imprint, the last one ends with the text."""
    book = lambda title, body: f"图书在版编目（CIP）数据\n\n{title}/某．-北京：人民卫生出版社\n{body}\n"
    docs = spark.createDataFrame([(1, book("甲", "x " * 40) + book("乙（上）", "# 凡例\n套话\n## 正文\n" + "y " * 40)), (2, None), (3, "")], "doc_id long, text string")
    got = corpus.split_compendium(docs, 30)
    rows = sorted(map(tuple, got.collect()))
    assert rows == [(1, "乙", "上", 4, 12, "cip", "## 正文\n" + ("y " * 40).strip()), (1, "甲", "", 0, 4, "cip", book("甲", "x " * 40).strip())]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(start" in plan and "collect_list(struct(pos" not in plan


def test_books_of_one_title_are_not_one_task(spark):
    """A title that most books bear takes no text with it: texts are joined by source and place."""
    part = lambda k: f"图书在版编目（CIP）数据\n\n甲/某．-北京：人民卫生出版社\n{'x ' * 40}{k}\n"
    sources = spark.range(40).select(F.concat(F.lit("many"), "id").alias("source"), F.lit(".pdf").alias("suffix"), F.lit(part(1) + part(2)).alias("text"))
    books = spark.createDataFrame([("甲", "jia", "piwei", "case", "甲", 1)], "book_title string, slug string, school string, role string, title string, priority int")
    got = build.expanded(sources, [], books, ("many",), least=30)
    rows = got.select("source", "status", "work", "school", F.length("text").alias("n")).collect()
    assert len(rows) == 80 and {tuple(r)[1:] for r in rows} == {("ready", "jia", "piwei", len(part(1)) - 1)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "hashpartitioning(title" in line]
    joins = [line for line in plan.splitlines() if "Join [doc_id#" in line or "Join [title#" in line]
    assert exchanges and any("start#" in line for line in joins)


def test_titles(spark):
    registry = spark.createDataFrame([("伤寒论", "a"), ("金匮要略", "b"), ("金匮要略诠解", "c")], "book_title string, slug string")
    titles = spark.createDataFrame([("金匮要略",), ("金匮要略诠解本",), ("伤寒论集",), ("新金匮要略",)], "title string")
    got = {r["title"]: (r["slug"], r["how"]) for r in corpus.resolve_titles(titles, registry).collect()}
    assert got == {"金匮要略": ("b", "exact"), "金匮要略诠解本": (None, "ambiguous"), "伤寒论集": (None, "none"), "新金匮要略": ("b", "contained")}
    assert one(spark, corpus.volume_slug(F.lit("jing"), F.col("x")), x="下") == "jing_xia"
    assert one(spark, corpus.edition_score(F.lit(2), F.col("x"), F.lit(5_000_000)), x=".EPUB") == 2_020_999_999


def test_store(spark):
    frame = lambda rows: spark.createDataFrame(rows, "school string, source string, key string, v int")
    old = frame([("a", "s", "1", 1), ("a", "s", "2", 1), ("b", "s", "3", 1)])
    new = frame([("a", "s", "1", 2), ("a", "s", "4", 2)])
    merged = store.upsert(old, new, "key")
    assert sorted((r["key"], r["v"]) for r in merged.collect()) == [("1", 2), ("2", 1), ("3", 1), ("4", 2)]
    assert sorted(map(tuple, store.upsert(merged, new, "key").collect())) == sorted(map(tuple, merged.collect()))
    pruned = store.prune(merged, new.select("school", "source").distinct(), new, ["school", "source"], "key")
    assert sorted(r["key"] for r in pruned.collect()) == ["1", "3", "4"]
    assert store.sweep(merged, new.limit(0), ["school"]).count() == 4 and store.sweep(merged, new, ["school"]).count() == 3
    twice = frame([("a", "s", "1", 5), ("a", "s", "1", 7), ("a", "s", "1", None)])
    assert [r["v"] for r in store.upsert(old, twice, "key", F.col("v")).filter("key = '1'").collect()] == [7]
    assert store.upsert(old, twice, "key").filter("key = '1'").count() == 1


def test_incremental_state(spark):
    """A source with several stored rows is unchanged only if all agree; force leaves none unchanged."""
    current = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "source string, fingerprint string")
    state = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", "0"), ("c", None)], "source string, fingerprint string")
    status = lambda **k: {r["source"]: r["status"] for r in store.changed_sources(current, state, "source", **k).collect()}
    assert status() == {"a": "unchanged", "b": "changed", "c": "changed", "d": "new"}
    assert status(force=True) == {"a": "changed", "b": "changed", "c": "changed", "d": "new"}


CASES = [
    ({"x": "y"}, "最近有胸痛", ["胸痛"], "证据不足，待进一步问诊", 0.32), ({"age": "12"}, "", ["未成年人"], "证据不足，待进一步问诊", 0.32),
    ({"cold": "经常怕冷", "fatigue": "容易疲倦"}, "", [], "脾胃阳虚倾向", 0.72), ({"cold": "没有怕冷", "fatigue": "容易疲倦", "poor_appetite": "食欲不振"}, "", [], "脾气不足倾向", 0.66),
    ({"cold": "暂不确定", "fatigue": "暂不确定"}, "", [], "证据不足，待进一步问诊", 0.32), ({"heat": "手足心热", "thirst": "经常口渴", "age": "old"}, None, [], "胃热倾向", 0.68),
    ({"pregnant": "true", "serious_conditions": "yes"}, "", ["严重慢病", "孕产场景"], "证据不足，待进一步问诊", 0.32),
]


@pytest.mark.parametrize(("facts", "text", "flags", "name", "score"), CASES)
def test_rules(spark, facts, text, flags, name, score):
    frame = spark.createDataFrame([(facts, text)], "facts map<string,string>, text string")
    row = frame.select(rules.risk_flags(F.col("facts"), F.col("text")).alias("flags"), F.get(rules.candidates(F.col("facts")), F.lit(0)).alias("top")).first()
    assert row["flags"] == flags and (row["top"]["name"], row["top"]["score"]) == (name, score)


def test_fusion_and_seats(spark):
    ranks = lambda keys: spark.createDataFrame([(1, k, i + 1) for i, k in enumerate(keys)], "query_id long, key long, rank int")
    fused = {r["key"]: (r["score"], r["method"]) for r in retrieval.fuse(ranks([7, 8]), ranks([8, 9]), "key").collect()}
    assert fused == {7: (round(1 / 61, 9), "vector"), 8: (round(1 / 62 + 0.4 / 61, 9), "hybrid"), 9: (round(0.4 / 62, 9), "keyword")}
    pool = spark.createDataFrame([(1, k, 1.0 / k, own) for k, own in ((1, False), (2, False), (3, True), (4, True))], "query_id long, key long, score double, mine boolean")
    assert [r["key"] for r in retrieval.seat_tiers(pool, 4, 1, F.col("mine"), "key").orderBy("seat").collect()] == [3, 4, 1, 2]


def test_metrics(spark):
    results = spark.createDataFrame([("a", 1, 1, False, True), ("a", 1, 2, True, True), ("a", 2, 1, False, False)], "channel string, case_id int, rank int, hit boolean, inside boolean")
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id int")
    row = evaluation.channel_metrics(results, cases, F.col("hit"), F.col("inside")).first()
    assert (row["recall"], row["mrr"], row["isolation"], row["cases"]) == (0.333, 0.167, 0.667, 3)
    assert one(spark, evaluation.phrases_hit(F.col("x"), F.array(F.lit("a"), F.lit("z")), strict=False), x="abc")
    assert not one(spark, evaluation.phrases_hit(F.col("x"), F.array(F.lit("a"), F.lit("z")), strict=True), x="abc")
    scores = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (2, 2, 0.3), (2, 1, 0.4)], "query_id int, passage_id int, score double")
    check = evaluation.self_check(scores).first()
    assert check["top1"] == 0.5 and check["margin"] == pytest.approx(-0.1)


def slow_bm25(texts, queries, k):
    bags = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in texts}
    mean = sum(map(len, bags.values())) / max(1, len(bags)) or 1
    out = {}
    for q, words in queries.items():
        scores = []
        for i, bag in bags.items():
            score = 0.0
            for w in words:
                df = sum(w in b for b in bags.values())
                tf = bag.count(w)
                score += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(bag) / mean))
            if score > 0:
                scores.append((-math.floor(score * 1e6 + 0.5) / 1e6, i))
        out[q] = [(i, pytest.approx(-s)) for s, i in sorted(scores)[:k]]
    return out


def test_bm25_in_blocks(spark, monkeypatch):
    """Blocks of queries and slices of documents change nothing; ties go to the smaller key; nulls are never found."""
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(60, None), (61, ""), (62, "a b"), (63, "a b")]
    queries = {q: sorted({rng.choice("abcdefghz") for _ in range(3)}) for q in range(9)}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    terms = spark.createDataFrame([(q, w) for q, ws in queries.items() for w in ws], "query_id long, token string")
    want = slow_bm25(texts, queries, 5)
    for block, cells in ((retrieval.TERM_BLOCK, retrieval.CELLS), (5, 20)):
        monkeypatch.setattr(retrieval, "TERM_BLOCK", block)
        monkeypatch.setattr(retrieval, "CELLS", cells)
        got = {}
        for r in retrieval.bm25_top_k(docs, t.words(F.col("text")), terms, 5).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
        assert got == {q: rows for q, rows in want.items() if rows}
    assert retrieval.bm25_top_k(docs, t.words(F.col("text")), terms.limit(0), 5).count() == 0
    assert retrieval.bm25_top_k(docs.limit(0), t.words(F.col("text")), terms, 5).count() == 0


def test_dense_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(50)] + [(50, [0.0, 0.0, 0.0]), (51, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = frame.filter("vec_id < 7").selectExpr("vec_id as query_id", "embedding as query_vector")
    plain = sorted(map(tuple, retrieval.dense_top_k(frame, queries, 6).collect()))
    length = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    for q, v in rows[:7]:
        all_ = sorted((-math.floor(sum(a * b for a, b in zip(v, w, strict=True)) / length(v) / length(w) * 1e6 + 0.5) / 1e6, i) for i, w in rows if w)
        assert [(r[1], r[2]) for r in plain if r[0] == q and r[3]] and sorted((r[3], r[1]) for r in plain if r[0] == q) == [(n + 1, i) for n, (_, i) in enumerate(all_[:6])]
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 6)
    monkeypatch.setattr(retrieval, "CELLS", 10)
    assert sorted(map(tuple, retrieval.dense_top_k(frame, queries, 6).collect())) == plain
    spaces = frame.withColumn("embedder_id", F.when(F.col("vec_id") < 10, "a").when(F.col("vec_id") < 20, "b"))
    assert retrieval.one_space(spaces, "a").count() == 10


def palm_book(text: bytes, flags: int, trailer: bytes) -> bytes:
    """An unpacked one-record Palm book."""
    head = struct.pack(">HHIHHH", 1, 0, len(text), 1, 4096, 0) + b"\0\0" + b"MOBI" + struct.pack(">III", 0xE8, 2, 65001) + b"\0" * 0xE0
    head = head[:0x102] + struct.pack(">H", flags) + head[0x104:]
    record = text + trailer
    starts = [78 + 16, 78 + 16 + len(head)]
    return b"Book".ljust(60, b"\0") + b"BOOKMOBI" + b"\0" * 8 + struct.pack(">H", 2) + b"".join(struct.pack(">II", s, 0) for s in starts) + head + record


def test_binary_files(spark, tmp_path):
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="{i}" href="{h}" media-type="application/xhtml+xml"/>' for i, h in (("a", "1.xhtml"), ("b", "nav.xhtml"), ("c", "2.xhtml")))
        z.writestr("O/p.opf", f'<package><metadata><dc:title xmlns:dc="http://purl.org/dc/elements/1.1/"> A Title </dc:title></metadata><manifest>{items}</manifest><spine><itemref idref="c"/><itemref idref="b"/><itemref idref="a"/></spine></package>')
        for name, body in (("1", "<h1>One</h1><p>A &amp; B</p>"), ("nav", "no"), ("2", "<p>Two</p>")):
            z.writestr(f"O/{name}.xhtml", body)
    (tmp_path / "x.epub").write_bytes(book.getvalue())
    (tmp_path / "x.azw").write_bytes(palm_book(b"<p>Palm text of some length</p>", 0x1C, b"\x81"))
    (tmp_path / "g.txt").write_bytes("桂枝汤".encode("gb18030"))
    (tmp_path / "u.txt").write_text("plain text", encoding="utf-8")
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "skip.zip").write_bytes(b"PK\x03\x04")
    rows = {r["name"]: r for r in binary.extracted(binary.read_files(spark, str(tmp_path))).collect()}
    assert set(rows) == {"x.epub", "x.azw", "g.txt", "u.txt", "bad.pdf"}
    assert rows["x.epub"]["format"] == "epub" and rows["x.epub"]["text"].replace("\n\n\n", "\n\n") == "Two\n\n# One\n\nA & B"
    assert rows["x.azw"]["format"] == "mobi" and rows["x.azw"]["text"].strip() == "Palm text of some length"
    assert rows["g.txt"]["text"] == "桂枝汤" and rows["u.txt"]["text"] == "plain text"
    assert rows["bad.pdf"]["text"] is None and rows["bad.pdf"]["error"]
    assert rows["x.epub"]["title"] == "A Title" and rows["u.txt"]["title"] == ""
    report = {r["name"]: r for r in binary.extraction_report(binary.extracted(binary.read_files(spark, str(tmp_path)))).collect()}
    assert report["bad.pdf"]["note"].startswith("failed: ") and report["bad.pdf"]["chars"] == 0 and report["u.txt"]["density"] == 10.0


def test_entities(spark):
    text = "a &amp; b &#8217; &eacute; &#x4e2d; &amp;lt; &nbsp;x &bogus; &"
    assert one(spark, t.decode_entities(F.col("x")), x=text) == "a & b ’ é 中 &lt; \u00a0x &bogus; &"
    assert one(spark, t.html_to_markdown(F.col("x")), x="<p>&lt;b&gt; &Eacute;</p>").strip() == "<b> É"


def test_long_texts_cost_in_proportion(spark):
    """Folds over a document's lines in slices give the same as over all lines, and don't slow down with their number."""
    rng = random.Random(8)
    lines = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert one(spark, chunking.pack_units(F.split("x", "\n"), 620), x="\n".join(lines)) == slow_pack(lines, 620)
    keys, want = set(), []
    for line in lines:
        key = line.replace(" ", "")
        if len(key) < 20 or key not in keys:
            want.append(line)
        keys.add(key)
    assert one(spark, corpus.drop_repeated(F.split("x", "\n"), 20), x="\n".join(lines)) == want


def test_names_and_classes(spark):
    assert one(spark, build.plain_name(F.col("x")), x="ＡＢ１ ﬁ 伤寒") == "AB1 fi 伤寒"
    assert one(spark, build.is_compendium(F.col("x")), x="a 现代著名老中医名著重刊丛书 b") and not one(spark, build.is_compendium(F.col("x")), x="a")
    registry = [("伤寒论", "shanghan", "classic", "伤寒论", "shanghan_lun", 95)]
    classes = lambda x: one(spark, build.classified(F.col("x"), registry), x=x)
    assert tuple(classes("宋本伤寒论.epub")) == ("shanghan", "classic", "伤寒论", "shanghan_lun", 95, "registry")
    assert tuple(classes("名家医案 (上册).pdf"))[:4] == ("shanghan", "case", "名家医案", "名家医案_上册_pdf")
    assert classes("温病医案")["school"] == "wenbing" and classes("无关") is None


def test_expansion_and_choice(spark):
    marker = build.COMPENDIUM_MARKERS[0]
    book = lambda title: f"图书在版编目（CIP）数据\n\n{title}/某．-北京：人民卫生出版社\n" + (HAN + "\n") * 40
    rows = [(f"{marker}.epub", ".epub", book("脾胃论．上") + book("无名书")), ("脾胃论.md", ".md", "x" * 50), ("脾胃论2.pdf", ".pdf", "x" * 900), ("别的.md", ".md", "y"), (f"{marker}2.epub", ".epub", "none")]
    registry = [("脾胃论", "piwei", "classic", "脾胃论", "piwei_lun", 92)]
    books = spark.createDataFrame([("脾胃论", "piwei_lun", "piwei", "classic", "脾胃论", 80)], "book_title string, slug string, school string, role string, title string, priority int")
    found = build.expanded(spark.createDataFrame(rows, "source string, suffix string, text string"), registry, books, least=100)
    got = {(r["source"], r["unit"]): (r["status"], r["slug"], r["work"], r["cited"]) for r in found.collect()}
    assert got == {
        (rows[0][0], "脾胃论·上"): ("ready", "piwei_lun_shang", "piwei_lun", f"{build.COMPENDIUM_LABEL}·脾胃论·上"), (rows[0][0], "无名书"): ("skipped", None, None, f"{build.COMPENDIUM_LABEL}·无名书"),
        ("脾胃论.md", "脾胃论"): ("ready", "piwei_lun", "piwei_lun", "脾胃论.md"), ("脾胃论2.pdf", "脾胃论"): ("ready", "piwei_lun", "piwei_lun", "脾胃论2.pdf"),
        ("别的.md", ""): ("skipped", None, None, "别的.md"), (rows[4][0], ""): ("skipped", None, None, rows[4][0]),
    }
    assert [(r["source"], r["compendium"]) for r in build.chosen(found).collect()] == [("脾胃论.md", False)]


def test_breaker_stops_a_write(spark, tmp_path):
    rows = spark.range(3)
    breaker = lambda bad: corpus.breaker_open(spark.createDataFrame([("rejected: x",)] * bad + [("ok",)] * 4, "status string"), F.col("status"))
    assert build.stopped_by(rows, breaker(2)).count() == 3
    with pytest.raises(Exception, match="too many sources"):
        build.stopped_by(rows, breaker(3)).write.parquet(str(tmp_path / "out"))


def test_opinions(spark):
    read = lambda x: one(spark, opinions.opinion(F.col("x")), x=x)
    full = read('{"diagnosis": "d", "confidence": "0.7", "evidence": ["a", 1], "counter": "c", "formula": ""}')
    assert (full["diagnosis"], full["confidence"], full["evidence"], full["counter"], full["formula"]) == ("d", 0.7, ["a", "1"], ["c"], None)
    assert tuple(read("no json")) == (opinions.NO_DIAGNOSIS, 0.5, [], [], "", "", None, "")
    assert read('{"evidence": {"a": 1}, "counter": 5, "confidence": 7}')["evidence"] == [] and read('{"confidence": 7}')["confidence"] == 1.0
    facts = spark.createDataFrame([({"cold": "经常怕冷", "fatigue": "容易疲倦", "x": "不确定"},), ({},)], "facts map<string,string>")
    rows = facts.select(opinions.facts_text(F.col("facts")).alias("t"), opinions.fallback_opinion(F.col("facts")).alias("o")).collect()
    assert rows[0]["t"] == "- cold: 经常怕冷\n- fatigue: 容易疲倦" and rows[1]["t"] == opinions.NO_FACTS
    assert rows[0]["o"]["evidence"] == ["cold：经常怕冷", "fatigue：容易疲倦"] and rows[1]["o"]["confidence"] == 0.32


def test_palm_packing():
    assert binary.unpack_palm(b"abc" + bytes([0x80 | 3 >> 5, (3 << 3 | 1) & 0xFF]) + b"\x02\xff\xfe" + bytes([0xC0 | ord("x") & 0x3F | 0x40])) == b"abcabca\xff\xfe x"


def test_knowledge_files(spark, tmp_path):
    for folder, name, text in (("common", "a.md", "x"), ("common", "README.md", "no"), ("other", "b.md", "y"), ("piwei", "c.md", "z")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    good, unknown = knowledge.read_documents(spark, str(tmp_path))
    assert sorted(map(tuple, good.collect())) == [("common", "a.md", "x"), ("piwei", "c.md", "z")] and [tuple(r) for r in unknown.collect()] == [("other", "b.md")]
    docs = spark.createDataFrame([("piwei", "s1", "书", "classic", "a.md", "正文\n第二行", "u", "d", 6)], "school string, slug string, title string, role string, source string, text string, unit string, digest string, chars int")
    knowledge.write_documents(docs, str(tmp_path / "written"))
    knowledge.write_documents(docs.withColumn("slug", F.lit("s2")), str(tmp_path / "written"))
    written = {(r["school"], r["slug"]): r["text"] for r in knowledge.read_written(spark, str(tmp_path / "written")).collect()}
    assert set(written) == {("piwei", "s1"), ("piwei", "s2")} and written["piwei", "s1"] == "---\ntitle: 书\nschool: piwei\nrole: classic\nsource: a.md\nchars: 6\n---\n\n正文\n第二行"
    assert knowledge.read_manifest(spark, str(tmp_path / "manifest")).count() == 0
    knowledge.write_manifest(docs, str(tmp_path / "manifest"))
    assert [(r["slug"], r["version"]) for r in knowledge.read_manifest(spark, str(tmp_path / "manifest")).collect()] == [("s1", 3)]
    prints = spark.createDataFrame([("a.md", "f")], "source string, fingerprint string")
    knowledge.write_state(prints, str(tmp_path / "prints"), "v2", "hash@64", whole=False)
    assert knowledge.read_state(spark, str(tmp_path / "prints")).count() == 0
    knowledge.write_state(prints, str(tmp_path / "prints"), "v2", "hash@64")
    assert [(r["chunker"], r["source"]) for r in knowledge.read_state(spark, str(tmp_path / "prints")).collect()] == [("v2", "a.md")]
    (tmp_path / "state.json").write_text('{"source": "a", "fingerprint": "f"}\n{broken\n')
    assert [tuple(r) for r in knowledge.read_state(spark, str(tmp_path / "state.json"), "source string, fingerprint string").collect()] == [("a", "f")]


def test_streaming_ingest(spark, tmp_path):
    source, schema, path = tmp_path / "in", "key long, text string, ts timestamp", str(tmp_path / "table")
    add = lambda rows: spark.createDataFrame(rows, "key long, text string, ts string").select("key", "text", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(source))
    for rows in ([(1, "a", "2024-01-01"), (2, "b", "2024-01-01"), (1, "late", "2023-01-01"), (4, "x", None)], [(2, "c", "2024-01-02"), (3, "d", "2024-01-02")]):
        add(rows)
        ingest_stream(spark.readStream.schema(schema).parquet(str(source)), path, "key", str(tmp_path / "checkpoint"), "ts").awaitTermination()
    now = lambda *up_to: sorted((r["key"], r["text"]) for r in current_rows(spark, path, schema, "key", *up_to).collect())
    assert now() == [(1, "a"), (2, "c"), (3, "d"), (4, "x")] and now(0) == [(1, "a"), (2, "b"), (4, "x")]
    compact(spark, path, str(tmp_path / "short"), schema, "key", 1)
    assert sorted((r["key"], r["text"]) for r in current_rows(spark, str(tmp_path / "short"), schema, "key").collect()) == now()


def test_streaming_ingest_without_an_order(spark, tmp_path):
    """Rows without a time column: one of equal keys stays, the same one whatever the order; a repeated batch changes nothing."""
    kept = set()
    for n, rows in enumerate(([(1, "a"), (1, "b"), (2, None)], [(2, None), (1, "b"), (1, "a")])):
        spark.createDataFrame(rows, "key long, text string").coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        for again in range(2):
            stream = spark.readStream.schema("key long, text string").parquet(str(tmp_path / f"in{n}"))
            ingest_stream(stream, str(tmp_path / f"out{n}"), "key", str(tmp_path / f"checkpoint{n}{again}")).awaitTermination()
        kept.add(tuple(sorted((r["key"], r["text"] or "") for r in current_rows(spark, str(tmp_path / f"out{n}"), "key long, text string", "key").collect())))
    assert len(kept) == 1 and len(next(iter(kept))) == 2


def test_streamed_session_events(spark, tmp_path):
    schema = "session_id long, flags array<string>, agents int, failed boolean"
    spark.createDataFrame([(1, ["x"], 2, False), (2, [], 1, True)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    session_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("session_id", "seq").collect()
    assert [r["event"] for r in rows if r["session_id"] == 1] == ["stage_started", "risk_detected", "stage_started", "agent_result", "agent_result", "stage_started", "report", "completed"]
    assert [r["event"] for r in rows if r["session_id"] == 2] == ["stage_started", "stage_started", "agent_result", "error"]


def test_windowed_counts(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()
