"""Pages, conversations, vectors."""

import hashlib

import numpy as np
import pytest
from fixtures import words
from pyspark.sql import functions as F

from tracelode.llm import chat, pages, topk


def page(i, body, site="news"):
    return (i, f"https://{site}.example.org/a/{i}", body)


def layout(i, paragraphs, title=None):
    menu = "".join(f"<li><a href='/{i}{j}'>m{j}</a></li>" for j in range(3))
    body = "".join(f"<p>{p}" for p in paragraphs)
    return (f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style></head><body><header>Site</header><nav><ul>{menu}</ul></nav>"
            f"<div class='cookie-notice'>We use cookies {i}</div><article><h1>{title or f'Title {i}'}</h1>{body}<script>var a='</p>';</script>"
            f"<form><label>Name</label></form></article><div id='comments'><p>Nice {i}!</p></div><aside>Also {i}</aside><footer>&copy; x</footer></body></html>")


def test_pages(spark):
    rows = [page(i, layout(i, [f"A &amp; b{i}\n  c", "Second<br>line <b>bold</b>ly"])) for i in range(6)]
    rows += [page(10, None), page(11, ""), page(12, "just text & more"), (13, None, layout(13, ["Lone"])), page(14, layout(14, ["Open <p>tag"])[:-60], "other")]
    rows += [page(1, layout(1, ["A &amp; b1\n  c", "Second<br>line <b>bold</b>ly"]))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash")).withColumn("main", F.lit("clash"))
    found = {r.page_id: r for r in pages.extract(df).collect()}
    for i in range(6):
        assert found[i].text == f"Title {i} A & b{i} c Second line boldly"
        assert found[i].n_chars == len(found[i].text)
    assert found[10].text == found[11].text == "" and found[12].text == "just text & more"
    assert found[13].text == "Title 13 Lone" and found[14].text == "Title 14 Open tag"
    assert pages.extract(df.limit(0)).count() == 0


def test_pages_without_an_article_element(spark):
    make = lambda i: (f"<body><div class='top'>Welcome to our site</div><div class='wrap'><h2>Head {i}</h2><p>{words(i, 30)}</p><p>{words(i + 50, 20)}</p></div>"  # noqa: E731
                      f"<div class='sidebar'>{words(i + 90, 9)}</div><div>All rights reserved</div></body>")
    df = spark.createDataFrame([page(i, make(i), "plain") for i in range(8)], "page_id bigint, url string, html string")
    found = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert found == {i: f"Head {i} {words(i, 30)} {words(i + 50, 20)}" for i in range(8)}


def test_template_classes(spark):
    df = spark.createDataFrame([page(i, layout(i, ["x y " * 20, "z " * 20])) for i in range(5)], "page_id bigint, url string, html string")
    found = pages.templates(df).collect()
    assert [r.main for r in found] == ["html/body/article"]
    assert pages.templates(df.limit(3)).count() == 0


def test_two_layouts_of_unnamed_divs(spark):
    """Half articles, half posts, and pages without html: no token is in nearly all pages."""
    article = lambda i: (f"<div>Home News Contact</div><div><h2>Head {i}</h2><p>{words(i, 30)}</p></div><div>All rights reserved</div>")
    post = lambda i: (f"<section><p>Posts of our readers</p></section><table><tr><td>{words(i, 25)}</table><section><p>Write to us</p></section>")
    rows = [page(i, f"<body>{post(i) if i % 2 else article(i)}</body>", "two") for i in range(12)] + [page(20 + i, (None, "")[i % 2], "two") for i in range(4)]
    found = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found == {i: words(i, 25) if i % 2 else f"Head {i} {words(i, 30)}" for i in range(12)} | {20 + i: "" for i in range(4)}


@pytest.mark.parametrize("length", [10, 60])
def test_long_texts_of_the_template(spark, length):
    legal = words(777, length)
    assert (len(legal) > 200) == (length == 60)
    df = spark.createDataFrame([page(i, f"<body><div><p>{words(i, 30)}</p></div><div>{legal}</div></body>", "law") for i in range(8)], "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in pages.extract(df).collect()} == {i: words(i, 30) for i in range(8)}


@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", "<|turn|>user\n<|end|>\n", "<\\|turn|> \\ <\\\\|end|>", "<<|end|>|end|>", "<", "<|", "[[INST]INST]", "a\\"])
def test_escape_is_undone(text):
    f = chat.Format(chat.CHAT)
    escaped = f.escape(text)
    assert f.unescape(escaped) == text and not any(c in escaped for c in chat.CHAT.reserved)
    for role in ("user", "a\nb", "\\n", "<|end|>", ""):
        assert f.read("".join(s for s, _ in f.segments(role, text))) == (role, text)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "a1"), (1, 0, "user", "u"), (1, 2, "user", None), (1, 3, "assistant", "é</s>"), (2, 0, "assistant", "x"),
            (3, 0, None, None), (None, 0, "user", "q"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 1, "user", "u"), (5, 0, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("state", F.lit("clash")).withColumn("segment", F.lit(0))
    found = {r.conv_id: r for r in chat.read_back(chat.chat_segments(df)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found[1].n_turns == 4 and found[1].valid and found[1].complete
    assert found[1].turns_sha256 == sha("user\nu\nassistant\na1\nuser\n\nassistant\né</s>\n")
    assert found[1].loss_sha256 == sha("a1é</s>") and found[1].loss_chars == 7
    assert not found[2].valid and not found[3].valid and not found[4].valid and found[5].valid and not found[5].complete
    assert found[None].n_turns == 1 and found[4].n_turns == 3
    assert chat.read_back(chat.chat_segments(df.limit(0))).count() == 0
    whole = {(r.conv_id, r.place): r.formatted for r in chat.formatted(df).collect()}
    assert whole[(1, 3)] == "<|turn|>assistant\né<\\/s><|end|>\n"


def test_top_k(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(0, 0.3, 6).astype("float32").tolist()) for i in range(400)]
    data += [(i, data[7][1]) for i in range(400, 420)] + [(500, None), (501, []), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (600, [float("nan")] * 6), (700, [float("inf")] * 6),
             (800, [0.0] * 6), (900, [0.5, 0.5]), (901, [0.1, 0.9]), (None, [0.5] * 6)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").withColumn("dim", F.lit("clash"))
    vectors = df.select("vec_id", topk.scaled(F.col("embedding")).alias("row"))
    queries = vectors.where("vec_id % 100 = 0")
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(vectors, queries, block=64, query_block=2).collect())
    usable = {i: np.floor(1024 * np.array(v, dtype=np.float64)).astype(int) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    expected = []
    for q, v in usable.items():
        if q % 100 == 0:
            best = sorted((-int(v @ w), i) for i, w in usable.items() if i != q and len(w) == len(v))[:10]
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert found == sorted(expected)
    assert topk.top_k(vectors.limit(0), queries).count() == topk.top_k(vectors, queries.limit(0)).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(0)
    rows = (rng.exponential(1.0, (20_000, 3)) ** 3 * 100).astype(np.int64)
    lists = topk.Lists(np.arange(20_000), rows)
    query = np.array([5, 1, 3])
    ids, scores, met = lists.best(-1, query, 10)
    exact = sorted(((-int(s), i) for i, s in enumerate(rows @ query)))[:10]
    assert [(-s, i) for s, i in exact] == list(zip(scores.tolist(), ids.tolist())) and met < 5000


@pytest.mark.parametrize("spread", ["even", "long tails", "few values"])
def test_many_queries_of_one_block(spread):
    """Against all products: together and with floors; what is scored is all rows only where values give no hold."""
    rng = np.random.default_rng(3)
    rows = {"even": rng.normal(size=(3000, 16)) * 1024, "long tails": rng.exponential(1.0, (3000, 16)) ** 4 * 100, "few values": rng.integers(-2, 3, (3000, 16))}[spread].astype(np.int64)
    queries = np.vstack([rows[:40], np.zeros((1, 16), np.int64), -rows[40:45]])
    ids, query_ids = rng.permutation(3000) * 7, np.arange(46) * 7
    lists = topk.Lists(ids, rows)
    expected = []
    for q, query in zip(query_ids, queries):
        best = sorted((-int(s), int(i)) for i, s in zip(ids, rows @ query) if i != q)[:10]
        expected.append([(i, -s) for s, i in best])
    found, scored = lists.best_of(query_ids, queries, 10)
    assert [list(zip(i.tolist(), s.tolist())) for i, s in found] == expected and scored <= 3000
    floors = np.array([e[4][1] for e in expected])
    found, _ = lists.best_of(query_ids, queries, 10, floors)
    assert all(set(e[:5]) <= set(zip(i.tolist(), s.tolist())) for e, (i, s) in zip(expected, found))


def test_floors_and_bounds_spare_rows():
    """With a hold in the values, few rows are scored, also for several queries at once."""
    rng = np.random.default_rng(0)
    rows = (rng.exponential(1.0, (20_000, 3)) ** 3 * 100).astype(np.int64)
    lists, queries = topk.Lists(np.arange(20_000), rows), np.array([[5, 1, 3], [1, 1, 9], [2, 7, 1]])
    _, scored = lists.best_of(np.full(3, -1), queries, 10)
    _, fewer = lists.best_of(np.full(3, -1), queries, 10, np.full(3, 1 << 40))
    assert scored < 8000 and fewer < scored


def test_deep_pages():
    """100,000 nested elements, and end tags of elements that are not open, in linear time; paths stay short."""
    import time
    began = time.perf_counter()
    found = pages.main_text("<div>x" * 100_000, [])
    assert found == " ".join("x" * 100_000)
    deep = pages.Page("<section class='a'><div>" * 20_000 + "<p>end</p>" + "</em>" * 20_000)
    assert max(map(len, deep.elements)) < 400 and deep.blocks[0][1] == "end" and len(deep.elements) == 40_001
    assert time.perf_counter() - began < 30


def test_paths_tell_deep_elements_apart():
    deep = pages.Page("<div><p>a</p>" * 200 + "</div>" * 100 + "<ul><li>b</ul>")
    assert len({node.path for node in deep.nodes}) == len(deep.elements) + 1 == 200 + 200 + 2 + 1


def test_a_long_conversation_and_clashing_columns(spark):
    """6,000 turns and a turn of a megabyte in one conversation, null rows, columns of the names that are used inside."""
    turns = [(1, t, ("user", "assistant")[t % 2], f"Turn {t} </s>" if t != 77 else "long [INST] " * 90_000) for t in range(6000)] + [(None, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    df = df.withColumns({c: F.lit("clash") for c in ("place", "part", "segment", "loss", "state")})
    found = {r.conv_id: r for r in chat.read_back(chat.chat_segments(df)).collect()}
    whole = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns[:6000]).encode()).hexdigest()
    loss = "".join(x for _, t, r, x in turns[:6000] if r == "assistant")
    assert (found[1].n_turns, found[1].turns_sha256, found[1].valid, found[1].complete) == (6000, whole, True, True)
    assert (found[1].loss_chars, found[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert found[None].n_turns == 1 and not found[None].valid


def test_pages_with_clashing_columns(spark):
    rows = [page(i, layout(i, [f"Text {i}"])) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("clash") for c in ("classes", "salt", "host", "key", "token", "pages")})
    assert {r.page_id: r.text for r in pages.extract(df).collect()} == {i: f"Title {i} Text {i}" for i in range(5)}
