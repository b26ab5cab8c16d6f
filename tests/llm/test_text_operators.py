"""Conversations, pages and languages."""

import random

import pytest
from pyspark.sql import functions as F

from rentloom.llm import language, pages
from rentloom.llm.chat import events_of_turns, fold_events, format_conversations, read_back, render
from rentloom.llm.language import identify, page_evidence
from rentloom.llm.pages import extract_pages, page_lines, shared_lines

TURNS = "conv_id long, turn long, role string, text string"


def test_texts_with_control_strings_come_back(spark):
    texts = ["<|im_end|>\n<|im_start|>user\nx", "<\\|im_end|>", "<\\\\|", "", None, "a<", "|b", "<<|>", "\\", "%0A%", "<|im_end|", "é😀"]
    rows = [(1, i, role, t) for i, t in enumerate(texts) for role in ("user\nassistant%0A<|", "assistant")] + [(1, 0, "assistant", texts[0])]
    back = read_back(render(fold_events(events_of_turns(spark.createDataFrame(rows, TURNS)))))
    got = back.first()
    assert [(t.role, t.text) for t in got.turns] == [(r, t or "") for _, _, r, t in sorted(rows, key=lambda r: (r[1], r[2].encode(), (r[3] or "").encode()))]
    assert "".join(p.text for p in got.pieces) == got.formatted
    assert [p.loss for p in got.pieces].count(True) == len(texts) + 1


def test_nulls_ties_and_empty_tables_of_turns(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "b"), (5, None, "user", "x"), (5, 1, "assistant", "y"), (5, 1, "assistant", "y")]
    got = {r.conv_id: r for r in format_conversations(spark.createDataFrame(rows, TURNS)).collect()}
    assert (got[None].n_turns, got[None].loss_chars, got[5].n_turns, got[5].loss_chars) == (2, 1, 3, 2)
    assert format_conversations(spark.createDataFrame([], TURNS)).collect() == []


def test_events_fold_into_final_messages(spark):
    log = [("c", 1, "message", "u1", "user", "hi"), ("c", 2, "message", "a1", "assistant", ""), ("c", 3, "delta", "a1", None, "Hel"),
           ("c", 4, "delta", "a1", None, "lo"), ("c", 5, "message", "u2", "user", "and?"), ("c", 6, "message", "a2", "assistant", "old"),
           ("c", 7, "regenerate", "a1", None, ""), ("c", 8, "delta", "a1", None, "Good day"), ("c", 9, "message", "u3", "user", "tpyo"),
           ("c", 10, "edit", "u3", None, "typo"), ("c", 11, "unknown", "u3", None, "!"), ("d", 1, "delta", "x", "assistant", "only a delta")]
    events = spark.createDataFrame(log, "conv string, seq long, kind string, message string, role string, text string")
    got = fold_events(events).orderBy("conv", "started").select("conv", "role", "text").collect()
    assert [tuple(r) for r in got] == [("c", "user", "hi"), ("c", "assistant", "Good day"), ("c", "user", "typo"), ("d", "assistant", "only a delta")]


def test_formatting_runs_no_python(spark, capsys):
    format_conversations(spark.createDataFrame([(1, 1, "user", "x")], TURNS)).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


ARTICLE = ("<html><head><title>T</title><style>p{}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li>Menu</li></ul></nav><!-- x -->"
           "<div class=\"ad\">Buy</div><header>Top</header><article><h1>A &amp; B</h1><p><b>One\n two<br>three<p>Two&nbsp;x</p><aside>Side</aside>"
           "<form>Send</form><div class='comments'><p>First!</p></div><p>End &lt;b&gt;</article><footer>&copy; me</footer></body></html>")


def test_article_without_its_surroundings():
    assert "\n".join(t for z, t in page_lines(ARTICLE) if z == 0) == "A & B\nOne two three\nTwo x\nEnd <b>"


def test_unclosed_menu_does_not_swallow_the_article():
    assert [t for z, t in page_lines("<body><nav><p>m<article><p>text</article>") if z == 0] == ["text"]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([str(x) for x in rng.sample(range(12), rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = shared_lines(a, b)
        assert len(found) == table[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in sorted(found))


def test_pages_lose_what_they_share_with_their_nearest(spark):
    def page(*lines):
        return "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"
    rows = [(1, "http://h.example/a/1", page("Head", "first text", "Foot"), 0), (2, "http://h.example/a/2", page("Head", "second text", "Foot"), 0),
            (3, "http://h.example/b/9", page("Head", "third text", "Foot"), 0), (4, "http://other.example/", page("Head", "alone"), 0),
            (5, None, page("no url"), 0), (6, "http://h.example/c", None, 0), (7, "http://z.example/x", ARTICLE, 0), (8, "http://z.example/x", ARTICLE, 0)]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, _key int")).collect()}
    article = "A & B\nOne two three\nTwo x\nEnd <b>"
    assert got == {1: "first text", 2: "second text", 3: got[3], 4: "Head\nalone", 5: "no url", 6: "", 7: article, 8: article}
    assert "third text" in got[3]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_language(spark):
    rng = random.Random(4)
    words = {"en": "the and of thing stone river water with".split(), "de": "der und die schluss haus wasser mit gross".split()}
    rows = [(i, " ".join(rng.choices(words[k], k=60)), k, f"{k}.example.org") for i, k in enumerate(["en", "de"] * 30)]
    rows += [(100, None, "en", "x"), (101, "123 --", "en", None), (102, "zqxj kwvy " * 30, None, "en.example.org"),
             (103, "der und die wasser " * 9, "en", None), (None, rows[0][1], None, None), (104, "haus " * 20_000, "de", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("best", F.lit(1))
    got = {r.doc_id: (r.language, r.accepted) for r in identify(docs).collect()}
    assert all(got[i] == (k, True) for i, _, k, _ in rows[:60])
    assert got[100] == got[101] == (None, False) and got[102][1] is False and got[103] == ("de", True) and got[None] == ("en", True)
    assert identify(docs.limit(0)).collect() == []
    assert {r.accepted for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {False}


def test_language_held_out(spark, sf):
    """Fitted on half of the documents, the letters find the language of the other half."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = identify(docs.where("doc_id % 2 = 1"), declared=F.lit(""), train=docs.where("doc_id % 2 = 0")).join(docs, "doc_id")
    right, rows = found.agg(F.count_if(F.col("language") == F.col("lang")), F.count("*")).first()
    assert right / rows > 0.97


def test_evidence_of_pages(spark):
    page = spark.createDataFrame([("https://u@blog.site.example.de:80/x", "<html dir=ltr lang='de-AT'><p>")], "url string, html string")
    assert page.select(*page_evidence().values()).first()[:] == ("blog.site.example.de", "de", "de")


def common_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [1 << 28, 8])
def test_repeated_lines_are_aligned(monkeypatch, bits):
    monkeypatch.setattr(pages, "TABLE_BITS", bits)      # 8: every table is halved
    assert len(shared_lines(["m", "a", "m"], ["a", "m"])) == 2
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        found = shared_lines(a, b)
        assert len(found) == common_length(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in sorted(found))
    assert len(shared_lines(["x"] * 3000 + ["y"], ["y"] + ["x"] * 2000)) == 2000


def test_marked_articles_keep_shared_lines_and_copies_get_one_text(spark):
    def page(*lines, marked=False):
        inner = "".join(f"<div>{x}</div>" for x in lines)
        return f"<body><article>{inner}</article><div>Out {lines[0]}</div></body>" if marked else f"<body>{inner}</body>"
    first, second = "the text of the first article " * 3, "what the second one says " * 3
    rows = [(1, "http://m.example/a/1", page("Share this", first, marked=True)), (2, "http://m.example/a/2", page("Share this", second, marked=True)),
            (3, "http://m.example/a/2?x", page("Share this", second, "one line more", marked=True)),
            *[(i, f"http://c.example/p/{i}", page("Head", first, "Head", "Foot")) for i in (11, 12, 13)],
            (14, "http://c.example/p/14", page("Head", second, "Foot")), (14, "http://c.example/p/14", page("Head", second, "Foot")),
            (20, "http://alone.example/", page("Head", "alone")), (20, "http://alone.example/", page("Head", "alone"))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in extract_pages(frame).collect())
    one, two = first.strip(), second.strip()
    assert got == [(1, f"Share this\n{one}"), (2, f"Share this\n{two}"), (3, f"Share this\n{two}\none line more"), *[(i, f"{one}\nHead") for i in (11, 12, 13)],
                   (14, two), (14, two), (20, "Head\nalone"), (20, "Head\nalone")]


@pytest.mark.parametrize("kept", [
    '<a href="/the-hidden-valley">x</a>', '<p title="hidden gems">x</p>', '<p aria-hidden="false">x</p>', "<div data-hidden>x</div>",
    '<h2 id="login">x</h2>', '<section id="related-work">x</section>', '<section id="notice">x</section>', '<p class="ad-hoc">x</p>',
    '<div class="has-sidebar">x</div>', '<div data-class="ad" data-role="menu">x</div>', '<p title="a class=ad b">x</p>'])
def test_attributes_that_hide_nothing(kept):
    assert page_lines(f"<article>{kept}</article>") == [(0, "x")]


@pytest.mark.parametrize("gone", [
    "<p hidden>x</p>", '<p class=a HIDDEN="">x</p>', "<div class='main ad'>x</div>", '<div class="cookie-notice">x</div>', "<p role=navigation>x</p>",
    "<section class=related>x</section>"])
def test_attributes_that_hide(gone):
    assert page_lines(f"<article>{gone}</article>") == [(2, "x")]
    assert page_lines('<div id="sidebar">x</div><div class="has-sidebar">y</div>') == [(2, "x"), (1, "y")]
    assert page_lines("<article><p>one <button>Press</button>two</article>") == [(0, "one two"), (2, "Press")]


def test_differences_equal_a_plain_loop_over_the_pages(spark):
    rng = random.Random(12)
    frames = [[f"menu {h}", f"menu {h}b", f"foot {h}"] for h in range(3)]
    pages_of = {}
    for i in range(120):
        host = rng.randrange(3)
        a, b, c = frames[host]
        inner = [f"line {i}.{k}" for k in range(rng.randint(1, 3))]
        url = f"http://h{host}.example/" + "/".join(rng.choices("abc", k=rng.randint(1, 4))) + f"/{i}"
        pages_of[url] = i, [*rng.choice(([a], [a, b], [])), *inner, *rng.choice(([c], []))]
    want, ordered = {}, sorted(pages_of, key=lambda u: (u.split("/")[2], u.split(".example", 1)[1]))
    for n, url in enumerate(ordered):
        near = [u for u in (ordered[n + 1] if n + 1 < len(ordered) else None, ordered[n - 1] if n else None) if u and u.split("/")[2] == url.split("/")[2]]

        def common(u):
            return next((k for k, (x, y) in enumerate(zip(u, url)) if x != y), min(len(u), len(url)))
        nearest = max(near, key=common) if near else None
        want[pages_of[url][0]] = "\n".join(x for x in pages_of[url][1] if not nearest or x not in pages_of[nearest][1])
    rows = [(i, u, "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>") for u, (i, lines) in pages_of.items()]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == 120
    assert all(r.n_rescued == r.n_cut == 0 and r.n_chars == len(r.text) for r in got)


def test_no_line_of_a_marked_article_is_lost(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in extract_pages(rows).collect()}
    for r in rows.collect():
        own = [line for zone, line in page_lines(r.html or "") if zone == 0]
        assert not own or got[r.page_id] == "\n".join(own)


@pytest.mark.parametrize("block", [128, 2])
def test_rare_languages_stay(spark, monkeypatch, block):
    """Two labels on one row in 3000 each; two to a block, the model has two blocks."""
    monkeypatch.setattr(language, "BLOCK", block)
    rng = random.Random(3)
    words = {"en": "the and of thing stone river water with".split(), "fi": "talo vesi joki kivi suuri pieni".split(),
             "cy": "dwfr llyn mynydd cwm ffordd ysgol".split()}
    rows = [(i, " ".join(rng.choices(words["en"], k=30)), "en", "h") for i in range(3000)]
    rows += [(4000 + i, " ".join(rng.choices(words[k], k=60)), k, "h") for i, k in enumerate(("fi", "cy"))]
    rows += [(5000, "zqxj kwvy " * 30, "en", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = {r.doc_id: (r.language, r.accepted) for r in identify(docs).collect()}
    assert got[4000] == ("fi", True) and got[4001] == ("cy", True) and got[5000][1] is False
    assert len(got) == len(rows) and all(got[i] == ("en", True) for i in range(3000))
