"""Pages, embeddings, conversations, the pipeline and the reference SQL."""

import collections
import json
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from helpers import ODD, empty, odd, reach  # noqa: E402

import corpus_pipeline  # noqa: E402
from pitpanel.llm import common, embeddings, exactdedup, html, packing, queries, simhash, toolcalls  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def rows(df, cols):
    return collections.Counter(tuple(None if v is None or v is pd.NA or v != v else v for v in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_reference_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), con.sql(queries.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and rows(got, cols) == rows(want, cols)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="ad">Buy this wonderful thing today because it is quite cheap and good for you.</div>
<article><h1>A &amp; B</h1><p>First&nbsp;  paragraph,
 with <b>bold</b> and <a href="/x">one link</a>.<p>Short.<form><input value=x>Your mail please</form>
<aside>Related things</aside><p>Caf&eacute; &#8212; &am end<br>of it</p>
<section class="comments"><p>I like this text a lot, thank you for having written it here.</p></section></article>
<div id="cookie-notice">We use cookies</div><footer>&copy; all of us</footer>"""


def test_page():
    assert html.main_text(PAGE, html.train()) == "A & B\nFirst paragraph, with bold and one link.\nShort.\nCafé — &am end of it"


def test_page_without_an_article_element():
    page = PAGE.replace("article", "div").replace("First", "First " + "of many words in a longer paragraph " * 3).replace("Short.", "Also a paragraph " + "with enough words to be text " * 3)
    got = html.main_text(page, html.train())
    assert "longer paragraph" in got and "enough words" in got
    assert not any(x in got for x in ("Home", "Buy", "I like", "cookies", "Your mail", "Related", "all of us", "hidden"))


@pytest.mark.parametrize("wrapper", ['div class="no-sidebar"', 'div class="page with-sidebar"', 'div id="has-header"', 'div class="legal-text"', 'div class="sidebar"', "form"])
def test_a_container_does_not_override_the_article_inside(wrapper):
    page = PAGE.replace("<article>", f"<{wrapper}><article>").replace("</article>", f"</article></{wrapper.split()[0]}>")
    assert html.main_text(page, html.train()) == html.main_text(PAGE, html.train()) != ""


def test_layout_names_are_no_furniture_without_an_article():
    text = "A paragraph of the page with quite enough words in it to be taken as text by the tree that is grown here."
    for name in ("no-sidebar", "with-sidebar", "has-header", "legal-text"):
        assert html.main_text(f'<body><div class="{name}"><p>{text}</p></div></body>', html.train()) == text
    assert html.main_text(f'<body><div class="left-sidebar"><p>{text}</p></div></body>', html.train()) == ""


def test_comment_articles_are_furniture():
    page = '<article class="post has-comments"><p>The story itself.</p></article><article class="comment even" id="comment-7"><p>I like it.</p></article>'
    assert html.main_text(page, html.train()) == "The story itself."
    page = '<article><p>The story itself.</p></article><div id="comments"><article><p>I like it.</p></article></div>'
    assert html.main_text(page, html.train()) == "The story itself."


def test_deep_pages_take_no_longer_than_flat_ones():
    """Ends without a start, and deep nests, are linear: quadratic work takes minutes here."""
    import time

    start = time.perf_counter()
    for page in ("<div>" * 30000 + "</b>" * 30000 + "text", "<div><p>" * 20000 + "x" + "</p></div>" * 20000, "<ul><li>" * 20000 + "x", "<b><i>" * 30000 + "</p></u>" * 30000):
        html.blocks(page)
    assert time.perf_counter() - start < 20


def naive_drop(self, tag, until=frozenset()):
    """The rule read off the open tags one by one."""
    for k in range(len(self.open) - 1, -1, -1):
        if self.open[k][0] == tag:
            while len(self.open) > k:
                closed, furniture, self.weak = self.open.pop()
                self.count(closed, furniture, -1)
            return
        if self.open[k][0] in until:
            return


def test_closing_by_place_is_closing_by_walk(monkeypatch):
    rng = np.random.default_rng(4)
    names = ["div", "p", "li", "ul", "b", "a", "td", "tr", "table", "article", "nav", "h2", "section", "dd", "dl"]
    pages = ["".join(f"<{'/' if rng.random() < 0.45 else ''}{names[rng.integers(len(names))]}>w{i} " for i in range(60)) for _ in range(300)]
    fast = [html.blocks(p) for p in pages]
    monkeypatch.setattr(html.Blocks, "drop", naive_drop)
    assert fast == [html.blocks(p) for p in pages]


def test_tree_learns_its_table():
    table = np.array(html.LABELLED, float)
    assert (html.classify(html.train(), table[:, :-1]) == table[:, -1].astype(bool)).all()


def test_pages_odd(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (2, None, "", 1), (None, "v", "plain < text & more", 1), (4, "w", "<article><p>cut of", 1),
                                (5, "x", "<p>" * 3000 + "deep", 1), (6, "y", "</div></p><article><h1>t</h1></article>" + "<!--", 1)], "page_id long, url string, html string, text int")
    got = {(r.page_id, r.url): r for r in html.extract(df).collect()}
    assert html.extract(df).count() == 7 and got[1, "u"].text == "" and got[1, "u"].n_chars == 0
    assert got[4, "w"].text == "cut of" and got[6, "y"].text == "t"
    assert html.extract(empty(df)).count() == 0


def brute(table, least=0.93):
    def good(v, lab):
        return lab is not None and v is not None and None not in v and len(v) and np.isfinite(np.array(v, float)).all() and np.any(v)

    links = np.eye(len(table), dtype=bool)
    for i, (_, v, a) in enumerate(table):
        for j, (_, w, b) in enumerate(table[:i]):
            if good(v, a) and good(w, b) and a == b and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                links[i, j] = links[j, i] = x @ y / np.sqrt((x @ x) * (y @ y)) >= least
    return links


def check_vectors(table, got):
    links = brute(table)
    ids, low = [r[0] for r in table], reach(links)
    want = []
    for i in range(len(table)):
        c = min((ids[j] for j in range(len(table)) if low[j] == low[i] and ids[j] is not None), default=None)
        want.append((ids[i], int(links[i].sum()) - 1, c, ids[i] is not None and ids[i] == c))
    assert collections.Counter(want) == collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got)


@pytest.mark.parametrize("dim", [64, 20, 3, 1])
def test_vectors(spark, dim):
    rng = np.random.default_rng(dim)
    table = []
    for i in range(160):
        v = rng.normal(size=dim) if i % 2 or not table else np.array(table[rng.integers(len(table))][1]) + rng.normal(size=dim) * rng.choice([0, 0.02, 0.2])
        table.append((i, [float(x) for x in np.float32(v * rng.choice([1, 3]))], int(rng.integers(3))))
    df = spark.createDataFrame([(*r, 1) for r in table], "vec_id long, embedding array<float>, label int, n int")
    check_vectors(table, embeddings.near_duplicates(df).collect())


def test_large_cells_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL_ROWS", 16)
    monkeypatch.setattr(embeddings, "TILE", 8)
    rng = np.random.default_rng(0)
    centre = rng.normal(size=16)
    table = [(i, [float(x) for x in np.float32(centre + rng.normal(size=16) * 0.35)], 1) for i in range(150)]
    check_vectors(table, embeddings.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")).collect())


def test_vectors_odd(spark):
    nan, inf = float("nan"), float("inf")
    table = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1),
             (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.01], 1), (None, [0.0, 1.0], 2), (11, [-0.0, 1.0], 2), (12, [3e38, 0.0], 1), (13, [1e-38, 0.0], 1)]
    df = spark.createDataFrame([(*r, 1) for r in table], "vec_id long, embedding array<float>, label int, guest int")
    check_vectors(table, embeddings.near_duplicates(df).collect())
    assert embeddings.near_duplicates(empty(df)).count() == 0


def test_calls(spark):
    calls = spark.createDataFrame([("a", None, "add", '{"y": 2, "x": 1, "z": {"q": 1, "b": [1, 2]}}', 1), ("b", "a", "add", '{"x": "1"}', 1), ("c", "b", "add", "not json", 1), ("d", "c", "mul", "{}", 1),
                                   ("e", "f", "add", None, 1), ("f", "e", "add", '{"x": 1, "y": null}', 1), (None, None, "add", '{"x": 1, "y": 2}', 1), ("g", "gone", "add", '{"x": 1.5, "y": 2}', 1)],
                                  "call_id string, parent_id string, name string, arguments string, copies long")
    results = spark.createDataFrame([("a", "3", 1), ("a", "2", 1), ("zz", "?", 1), (None, "!", 1)], "call_id string, content string, copies long")
    schemas = {"add": {"x": ("integer", True), "y": ("integer", True), "z": ("object", False)}}
    out = toolcalls.link(calls, results, schemas).collect()
    got = {r.call_id: r for r in out if r.kind == "call"}
    assert got["a"].errors == "" and got["b"].errors == "missing:y,type:x" and got["c"].errors == "not an object" and got["d"].errors == "unknown tool"
    assert got["f"].errors == "missing:y" and got["g"].errors == "type:x" and got["e"].errors == "not an object"
    assert [got[k].level for k in "abcdefg"] == [0, 1, 2, 3, None, None, 0] and got[None].level == 0
    assert got["a"].linked and not got["b"].linked and json.loads(got["a"].json)["result"] == "2"
    assert got["a"].json == '{"arguments":{"x":1,"y":2,"z":{"b":[1,2],"q":1}},"id":"a","level":0,"name":"add","result":"2"}'
    assert sorted(str(r.call_id) for r in out if r.kind == "result") == ["None", "zz"]


def test_conversations_odd(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi", 1), (1, 0, "user", "hi", 1), (1, 1, "assistant", "yo", 1), (1, 2, "user", None, 1), (2, 1, "assistant", "lost", 1), (None, 0, "user", "x", 1),
                                (3, None, "assistant", "y", 1), (4, 0, None, "z", 1), (5, 0, "system", "s", 1)], "conv_id long, turn long, role string, text string, level int")
    got = {(r.kind, r.call_id): r for r in toolcalls.chats(df).collect()}
    assert got["call", "1-0"].copies == 2 and got["call", "1-0"].linked and got["call", "1-2"].level == 1 and got["call", "1-2"].errors == "missing:text"
    assert set(got) == {("call", "1-0"), ("call", "1-2"), ("result", "2-0"), ("call", None), ("result", None), ("message", "4-0"), ("message", "5-0")}
    assert json.loads(got["message", "4-0"].json) == {"conv_id": 4, "role": None, "text": "z", "turn": 0}
    assert got["message", "5-0"].json == '{"conv_id":5,"role":"system","text":"s","turn":0}'
    assert toolcalls.chats(empty(df)).count() == 0


def test_every_message_is_in_some_row(spark):
    """Differing texts of a turn, further results and other roles, against the reference SQL and counted by hand."""
    table = [(1, 0, "user", "hi"), (1, 0, "user", "ho"), (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", None), (1, 1, "tool", "t"), (1, 2, "user", "on"),
             (1, 3, "assistant", None), (2, 1, "assistant", "x"), (2, 1, "assistant", "y"), (2, 0, "system", "be \"kind\"\n"), (2, 0, "system", "be \"kind\"\n"), (2, 0, None, None), (3, 0, "user", "é")]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    got = toolcalls.chats(df).toPandas()
    assert got.copies.sum() == len(table) - 2                       # the results "a" and NULL stand in their calls' rows
    of = lambda kind, call: sorted((json.loads(j).get("result", json.loads(j).get("text")) for j in got[(got.kind == kind) & (got.call_id == call)].json), key=str)
    assert of("further result", "1-0") == [None, "b"] and of("result", "2-0") == ["x", "y"] and of("message", "1-1") == ["t"]
    assert sorted((json.loads(r.json)["arguments"]["text"], r.copies) for r in got[got.call_id == "1-0"].itertuples() if r.kind == "call") == [("hi", 2), ("ho", 1)]
    assert {r.level for r in got[(got.kind == "call") & (got.call_id == "1-2")].itertuples()} == {1}
    con = duckdb.connect()
    conversations = df.toPandas().astype({"conv_id": "int64", "turn": "int64"})  # noqa: F841
    con.register("conversations", conversations)
    want = con.sql(toolcalls.ORACLE).df()
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_pipeline_keeps_one_of_each_group_and_all_that_is_clean(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    read = lambda df, n: (df.write.parquet(str(tmp_path / n)), spark.read.parquet(str(tmp_path / n)))[1]
    one = read(stages["language_id"](spark, docs, SMALL), "a")
    assert one.count() >= 0.99 * docs.count() and one.columns == docs.columns
    two = read(stages["exact_dedup"](spark, one, SMALL), "b")
    groups = collections.defaultdict(list)
    for r in one.collect():
        groups[r.text.encode().lower()].append(r.doc_id)
    assert sorted(r.doc_id for r in two.collect()) == sorted(max(g) for g in groups.values()) and two.columns == docs.columns
    three = read(stages["simhash_neardup"](spark, two, SMALL), "c")
    from pitpanel.llm.simhash import near_duplicates

    assert sorted(r.doc_id for r in three.collect()) == sorted(r.component_id for r in near_duplicates(two).select("component_id").distinct().collect())
    four = read(stages["source_mixture"](spark, three, SMALL), "d")
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} <= {r.doc_id for r in three.collect()}
    five = stages["best_fit_packing"](spark, four, SMALL)
    assert five.where("piece = 0").count() == four.count()


def test_pipeline_odd(spark, tmp_path):
    df = odd(spark)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    exact = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "")
    assert exact.count() == len({(r[1] or "").encode().lower() for r in ODD}) and exact.columns == df.columns
    empty(df).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_texts_reach_workers_in_short_batches(spark, monkeypatch):
    own, seen = spark.conf.get(common.BATCH), {}
    for m in (simhash, exactdedup, packing):
        monkeypatch.setattr(m, "settle", lambda df, name, real=m.settle: (seen.setdefault(name, spark.conf.get(common.BATCH)), real(df, name))[1])
    d = odd(spark)
    simhash.near_duplicates(d)
    exactdedup.duplicates(d, exactdedup.by_age())
    packing.sequences(d, common.tokenizer_file("word_bpe_49k.json"))
    assert [int(seen[n]) for n in ("fingerprints", "digests", "classes", "pieces")] == [common.TEXT_ROWS] * 4
    assert spark.conf.get(common.BATCH) == own
    with pytest.raises(KeyError), common.short_batches(spark, 7):
        assert spark.conf.get(common.BATCH) == "7"
        with common.short_batches(spark):                     # a smaller limit stays
            assert spark.conf.get(common.BATCH) == "7"
        raise KeyError
    assert spark.conf.get(common.BATCH) == own


def test_a_worker_gives_freed_memory_back():
    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096
    blocks = [bytes(2000) for _ in range(100_000)]
    pins = blocks[::100]                                      # spread over the heap, which so keeps its size
    del blocks
    before = resident()
    assert list(common.text_batches(iter(()), "text")) == [] and before - resident() > 100e6 and len(pins) == 1000
