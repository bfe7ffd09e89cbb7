import html
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm.common import drawn
from lexmill.llm.html_text import Direction, Labeller, blocks_of, bucket, fit_labeller, main_text, structure_labels, veil, vectors
from lexmill.llm.sharding import jump_hash, shard_documents
from lexmill.llm.url_filter import FEATURES, fit_trees, judge_urls, lexical, with_suffixes
from tests.llm.conftest import SF


def test_shards(docs):
    rows = shard_documents(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    slots = {}
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_shards(odd, nothing):
    rows = shard_documents(odd).collect()
    assert len(rows) == odd.count() and {r["size"] for r in rows if r["doc_id"] == 1} == {1}
    assert shard_documents(nothing).count() == 0


def test_jump_hash_is_even_and_stable():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 40_000).astype(np.uint64)
    for n in (1, 2, 7, 16, 100):
        a, b = jump_hash(keys, n), jump_hash(keys, n + 1)
        assert ((a == b) | (b == n)).all() and abs((b == n).mean() - 1 / (n + 1)) < 0.02
        assert np.bincount(a, minlength=n).min() > 0.7 * len(keys) / n


RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def rule_of(url):
    match = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]+", lambda m: m.group().lower(), match[1]), match[2]) if match else ("", "")
    fits = [r for r in RULES if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith("/" + r[0].partition("/")[2])]
    return host, path, max(fits, key=lambda r: len(r[0]), default=(None, None))


def test_url_rules(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    rows = judge_urls(pages).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, (rule, verdict) = rule_of(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)


def test_odd_urls(spark):
    urls = [None, "", "no scheme/com/en/", "http://COM/en/1", "http://x.example.com/en/77?q=1", "http://xcom/en/", "http://a.com", "ftp://net/de/?a#b", "http://example.net/de/8", "http://q.org/es/#x://y/z", "http://é.com/en/\n"]
    frame = spark.createDataFrame([(i, u, "h", 1.0) for i, u in enumerate(urls)], "page_id long, url string, label string, features double")
    for r in judge_urls(frame).collect():
        host, path, (rule, verdict) = rule_of(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)
    assert judge_urls(frame.limit(0)).count() == 0
    assert {r["verdict"] for r in judge_urls(frame.filter("page_id < 3")).collect()} == {"allow"}


def article(page):
    inner = re.search(r"(?s)<article>(.*?)(</article>|$)", page)[1]
    parts = (" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split(r"<br>|</?p>|</?h1>", inner))
    return "\n\n".join(x for x in parts if x)


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    wanted = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    rows = main_text(pages).collect()
    assert sum(r["text"] == wanted[r["page_id"]] for r in rows) >= 0.98 * len(rows) and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_furniture_is_left_out(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    extra = '<section class="comments"><div class="comment"><p>First comment here.</p></div></section><form class="newsletter"><p>Send me mail</p></form>'
    plain = pages.limit(1).first()["html"]
    page = plain.replace("</article>", f"</article>{extra}").replace("<article>", '<aside class="sidebar"><ul><li>Most read</li></ul></aside><article>')
    more = spark.createDataFrame([(10**6, "u", page), (10**6 + 1, "u", None), (10**6 + 2, "u", ""), (10**6 + 3, "u", "<p>&am"), (10**6 + 4, "u", "<!-- open")], pages.schema)
    rows = {r["page_id"]: r["text"] for r in main_text(pages.unionByName(more)).collect()}
    assert rows[10**6] == article(plain)
    assert rows[10**6 + 1] == rows[10**6 + 2] == rows[10**6 + 4] == ""
    assert main_text(pages.limit(0)).count() == 0


def test_blocks():
    found = blocks_of("<title>t</title><body><p>a &amp; <b>b</b>c<br>d<p>e &lt;i&gt;</p><ul><li>f<li>g</ul><script>x</script>tail")
    assert [b.text for b in found] == ["a & bc d", "e <i>", "f", "g", "tail"]


def test_gradients():
    """The backward pass agrees with differences of the forward pass."""
    rng = np.random.default_rng(1)
    layer = Direction(2)
    for name in ("wx", "wh", "b"):
        setattr(layer, name, getattr(layer, name).astype(np.float64))
    x, mask = rng.normal(size=(4, 3, layer.wx.shape[0])), np.ones((4, 3))
    mask[2:, 1] = 0
    pull = rng.normal(size=(4, 3, 16))
    layer.forward(x, mask)
    grads = dict(zip(("wx", "wh", "b"), layer.backward(x, pull), strict=True))
    for name, spot in (("wx", (5, 7)), ("wh", (3, 50)), ("b", (20,))):
        weight, values = getattr(layer, name), []
        for step in (1e-3, -2e-3):
            weight[spot] += step
            values.append((layer.forward(x, mask) * pull).sum())
        weight[spot] += 1e-3
        assert grads[name][spot] == pytest.approx((values[0] - values[1]) / 2e-3, rel=0.02, abs=2e-3)


def test_hidden_elements_end_where_they_do():
    texts = lambda page: [b.text for b in blocks_of(page)]
    assert texts("<p>one</p><svg class=i/><p>two</p>") == ["one", "two"]
    assert texts("<p>one</p><svg><path/>x</svg><p>two</p>") == ["one", "two"]
    assert texts("<!-- <select> --><article>one</article>") == ["one"]
    assert texts("<p>wo<!-- <button> -->rd</p>") == ["word"]
    assert texts("<p>one</p><!-- <script> --><p>two</p><script>a <!-- b</script><p>three</p>") == ["one", "two", "three"]
    for tag in ("button", "select", "noscript", "template", "iframe", "svg"):
        assert texts(f"<p>one</p><{tag} class=x><p>two</p>") == ["one", "two"]
        assert texts(f"<p>one</p><{tag}>x</{tag}><p>two</p>") == ["one", "two"]
    for tag in ("script", "style", "title", "textarea"):
        assert texts(f"<p>one</p><{tag}><p>two</p>") == ["one"]


def test_quotes_and_names():
    texts = lambda page: [b.text for b in blocks_of(page)]
    assert texts("<p data-x='a > b'>Text</p>") == texts('<p data-x = "a > b">Text') == ["Text"]
    assert texts("<p title=it's>one</p><p>two's</p>") == ["one", "two's"]
    assert texts('<p class="open>one</p><p>two</p>') == ["one", "two"]
    assert texts("<!-- <script> --><article><p>Main text here.</p></article>") == ["Main text here."]
    assert texts("a < b <i>c</i> 1<2") == ["a < b c 1<2"]
    assert blocks_of("<div data-class='ad' title='class=nav' CLASS='Main-Text x' id=y>z")[0].path == ("div", ".main", ".text", ".x", ".y")
    deep = "<div>" * 3000 + "x" + '<p a="' * 3000
    assert len(blocks_of(deep)) == 1


def test_other_class_names(spark):
    """Furniture is told from the article on pages that name their parts by other words."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rng = np.random.default_rng(3)
    rows = []
    for r in pages.collect():
        rows.append((r["page_id"], re.sub(r'(class|id)="[^"]*"', lambda m: f'{m[1]}="q{rng.integers(10**6)}"', r["html"]), article(r["html"])))
    frame = spark.createDataFrame([(i, "u", h) for i, h, _ in rows], pages.schema)
    got = {r["page_id"]: r["text"] for r in main_text(frame, fit_labeller(pages)).collect()}
    assert sum(got[i] == t for i, _, t in rows) >= 0.95 * len(rows)


def test_repeated_and_null_pages(spark):
    page = spark.read.parquet(f"{SF}/pages.parquet").first()
    long = "<article>" + "<p>All these words go on and on.</p>" * 3000 + "</article>"
    rows = [(None, page["url"], page["html"]), (1, None, page["html"]), (1, None, page["html"]), (2, "u", long)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 4 and len({r["text"] for r in got if r["page_id"] != 2}) == 1
    assert max(r["n_chars"] for r in got) == 3000 * len("All these words go on and on.") + 2 * 2999


def trees_of(text):
    """Nested (feature, value, left, right) or leaf numbers with their weights, from the model's own listing."""
    out, lines = [], iter(text.split("\n"))
    lines = [x for x in lines if x.strip()]

    def node(at):
        line = lines[at].strip()
        if line.startswith("Predict:"):
            return float(line.split(":")[1]), at + 1
        feature, value = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        left, at = node(at + 1)
        assert lines[at].strip().startswith("Else")
        right, at = node(at + 1)
        return (int(feature), float(value), left, right), at

    for k, line in enumerate(lines):
        if m := re.match(r"\s*Tree \d+ \(weight (\S+)\):", line):
            out.append((float(m[1]), node(k + 1)[0]))
    return out


def test_verdicts_of_the_trees(spark):
    """Where no rule fits, the verdict follows from walking every tree by hand over features worked out by hand."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = lexical(pages)
    labelled = rows.filter("ruled is not null").count()
    full = with_suffixes(rows)
    fitted = trees_of(fit_trees(full, labelled).stages[-1].toDebugString)
    assert len(fitted) == 20
    table = full.withColumn("fold", F.pmod(F.xxhash64("page_id", F.lit("fold")), F.lit(4))).collect()
    known = [(r["suffix"], r["fold"], r["ruled"]) for r in table if r["ruled"]]
    verdicts = {r["page_id"]: r["verdict"] for r in judge_urls(pages).collect()}
    for r in table:
        seen = [v for s, k, v in known if s == r["suffix"] and (r["ruled"] is None or k != r["fold"])]
        assert r["suffix_blocked"] == pytest.approx((seen.count("block") + 1) / (len(seen) + 2)) and r["suffix_weight"] == pytest.approx(np.log1p(len(seen)))
        total = 0.0
        for weight, tree in fitted:
            while isinstance(tree, tuple):
                tree = tree[2] if r[FEATURES[tree[0]]] <= tree[1] else tree[3]
            total += weight * tree
        assert verdicts[r["page_id"]] == (r["ruled"] or ("block" if total > 0 else "allow"))


def test_features_by_hand(spark):
    url = "https://a.b-c.com/x/y/1?q=1&r=#f"
    row = lexical(spark.createDataFrame([(1, url), (2, None)], "page_id long, url string")).orderBy("page_id").collect()
    shares = [url.count(c) / len(url) for c in set(url)]
    got = row[0]
    assert (got["n_url"], got["n_host"], got["n_path"], got["depth"], got["labels"], got["parameters"], got["has_fragment"], got["dashes"], got["secure"]) == (len(url), 9, 6, 3, 2, 3, 1, 1, 1)
    assert got["suffix"] == "com" and got["digits"] == pytest.approx(2 / len(url)) and got["entropy"] == pytest.approx(-sum(p * np.log2(p) for p in shares))
    assert row[1]["entropy"] == row[1]["digits"] == 0 and row[1]["suffix"] == ""


def test_repeated_and_long_urls(spark):
    rows = [(1, "http://com/en/" + "x" * 100_000), (1, "http://com/en/" + "x" * 100_000), (None, "http://net/de/1"), (2, "http://z.z/"), (2, "http://z.z/"), (3, "a" * 50_000)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows) and len({r["verdict"] for r in got if r["page_id"] == 2}) == 1
    assert {r["verdict"] for r in got if r["page_id"] == 1} == {"block"} and {r["verdict"] for r in got if r["page_id"] is None} == {"allow"}


def test_comments_that_end_early():
    texts = lambda page: [b.text for b in blocks_of(page)]
    assert texts("<p>x<!-->y<p>z") == ["xy", "z"]
    assert texts("<p>x<!--->y<p>z") == ["xy", "z"]
    assert texts("<p>q<!--a--!>b") == ["qb"]
    assert texts("<p>q<!----!>b<!-- > -->c<!-- - -- >d") == ["qbc"]


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</section>" * 40_000 + "<p>text", "".join(f"<div class='a{k}'><p>word {k}</p>" for k in range(8000)), "<p>x" + "</b></i></p>" * 40_000])
def test_deep_and_stray_markup_in_linear_time(page):
    blocks = blocks_of(page)
    began = time.process_time()
    found = blocks_of(page)
    vectors(found)
    structure_labels(found)
    assert time.process_time() - began < 1.5 and [b.text for b in found] == [b.text for b in blocks]


def test_shared_nodes_give_the_same_marks():
    """Marks gathered along shared nodes equal those of each block's whole path, veiled or not."""
    page = "<main><div class='a b'><p>one</p><aside id=q><p>two</p></aside></div><ul><li>three<li>four</ul></main><footer>five"
    found = blocks_of(page)
    for seed in range(4):
        shown = veil(random.Random(seed)) if seed else tuple
        for block, row in zip(found, vectors(found, shown), strict=True):
            assert set(np.flatnonzero(row[:64])) == {bucket(x, 64) for items in [block.path] for x in shown(items)}
    assert structure_labels(found).tolist() == [1, 0, 1, 1, 0]


def test_labeller_against_single_steps():
    """predict() over padded groups equals a walk over each page's blocks, one gate at a time."""
    rng = np.random.default_rng(4)
    model = Labeller(9)
    model.out = rng.normal(size=model.out.shape).astype(np.float32)
    pages = [rng.normal(size=(n, model.ahead.wx.shape[0])).astype(np.float32) for n in (1, 7, 3, 0, 12)]
    squash = lambda x: 1 / (1 + np.exp(-x))

    def walk(layer, rows):
        h, c, out = np.zeros(16), np.zeros(16), []
        for x in rows:
            z = x.astype(float) @ layer.wx + h @ layer.wh + layer.b
            c = squash(z[16:32]) * c + squash(z[:16]) * np.tanh(z[48:])
            h = squash(z[32:48]) * np.tanh(c)
            out.append(h)
        return out

    for page, got in zip(pages, model.predict(pages, cells=10), strict=True):
        ahead, back = walk(model.ahead, page), walk(model.back, page[::-1])[::-1]
        want = [squash(np.concatenate([a, b, [1.0]]) @ model.out) for a, b in zip(ahead, back, strict=True)]
        assert np.allclose(got, want, atol=1e-5)


@pytest.mark.parametrize("page_id", [None, 7])
def test_equal_ids_above_the_sample(spark, page_id):
    """With one id for all pages the labeller is fitted on a part of them and works as well as ever."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["html"]: article(r["html"]) for r in pages.collect()}
    same = pages.withColumn("page_id", F.lit(page_id).cast("long"))
    drew = drawn(same, ["html"], 60, "html").count()
    assert 30 < drew < 100
    got = main_text(same, fit_labeller(same, 60)).join(pages.select("url", "html"), "url").collect()
    assert sum(r["text"] == want[r["html"]] for r in got) >= 0.95 * len(got)


def test_few_different_rows_above_the_sample(spark):
    """Where the draw would leave nothing, the row of least hash is drawn."""
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("page_id"), F.lit("<article><p>Text.</p></article>").alias("html"))
    assert drawn(rows, ["html"], 1, "x").distinct().count() == 1
    urls = spark.range(300).select(F.lit(1).cast("long").alias("page_id"), F.concat(F.lit("http://"), F.when(F.col("id") % 2 == 0, "net/de/").otherwise("com/en/"), F.col("id") % 3).alias("url"))
    full = with_suffixes(lexical(urls.unionByName(spark.createDataFrame([(1, "http://x.y/")], "page_id long, url string"))))
    assert fit_trees(full, 1).transform(full).count() == 301
