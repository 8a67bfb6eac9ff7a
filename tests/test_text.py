import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import html, text, urls, vectors
from corpusmill.functions.text import chunk_text, fold_text, spans


@given(st.text(alphabet="ab .!?\n\"", max_size=400), st.integers(1, 60), st.integers(0, 20))
def test_chunks_cover_the_text(body, target, overlap):
    cuts = list(spans(body, target))
    assert "".join(body[a:z] for a, z in cuts) == body
    assert all(0 < z - a <= target for a, z in cuts)
    chunks = chunk_text(body, target, overlap)
    assert chunks == ([] if not body.strip() else [body[max(0, a - overlap) : z] for a, z in cuts])


def test_chunk_boundaries():
    assert chunk_text(None) == [] and chunk_text("  \n") == []
    assert len(chunk_text("x" * 20000)) == 5
    paragraphs = "\n\n".join(["word " * 20] * 10)
    assert all(c.endswith("\n\n") for c in chunk_text(paragraphs, 250, 0)[:-1])
    with pytest.raises(ValueError):
        chunk_text("abc", 0)


def test_folding():
    assert fold_text("RÉFÉRENCEMENT Straße") == "referencement straße"
    assert fold_text(None) is None


def test_html():
    page = "<html><title> My\n Title</title><script>no()</script><nav>n<nav>n</nav></nav><p>Hello&nbsp;&amp;</p><p>world</p></html>"
    assert html.html_text(page) == ("My Title", "Hello & world")
    assert html.html_text(None) == (None, None) and html.html_text("<p></p>") == (None, None)


def test_url_functions(spark):
    df = spark.createDataFrame([("see https://a.b/c). and https://a.b/c, http://x.com/y",), (None,), ("none",)], "t string")
    found = [r[0] for r in df.select(urls.found_urls(F.col("t"))).collect()]
    assert found == [["https://a.b/c", "http://x.com/y"], [], []]
    assert [r[0] for r in df.select(urls.commentary(F.col("t"))).collect()] == ["see and", None, "none"]


def test_shortener_limit(spark):
    chain = [(f"https://bit.ly/{i}", f"https://bit.ly/{i + 1}") for i in range(9)]
    out = urls.resolved(spark.createDataFrame([("https://bit.ly/0",), ("https://e.org/",)], "url string"), spark.createDataFrame(chain, "url string, final_url string")).collect()
    assert {r["url"]: r["error"] for r in out} == {"https://bit.ly/0": "redirect loop: exceeded 5 shortener hops", "https://e.org/": None}


def test_keywords(spark):
    df = spark.createDataFrame([(["English keywords: a, b, c", "French keywords: d", "Keywords:", "Mots-clés :", "Washington, D.C."],)], "k array<string>")
    assert df.select(text.split_keywords(F.col("k"))).first()[0] == ["a", "b", "c", "d", "Washington, D.C."]


def test_zero_vectors_rank_last(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "id int, v array<float>")
    sim = vectors.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0)))
    assert [r["id"] for r in df.orderBy(vectors.for_ranking(sim).desc()).collect()] == [2, 3, 1]
    fast = df.select("id", vectors.cosine_to([1.0, 0.0])("v").alias("s")).collect()
    assert [r["s"] for r in fast][1:] == [1.0, -1.0] and fast[0]["s"] is None


def test_html_pages():
    messy = "<html><head><title>My\n Title</title><script>var x</script><style>p{}</style></head><body><nav>menu</nav><header>top</header><p>Hello&nbsp;<b>wor</b>ld</p><footer>end</footer></body></html>"
    cases = {
        None: (None, None),
        "": (None, None),
        messy: ("My Title", "Hello wor ld"),
        # a title inside a skipped element is skipped; pieces of a title are joined by a space
        "<header><title>no</title></header><title>a</title>x<title>b</title>": ("a b", "x"),
        "<nav><footer>a</nav>b</footer>c</aside>d": (None, "c d"),
        "5 &lt; 6 <br> un<p>closed": (None, "5 < 6 un closed"),
    }
    assert {page: html.html_text(page) for page in cases} == cases


def test_cells_of_records_and_back(spark):
    from pyspark.sql import functions as F

    from corpusmill.functions import cells

    shown = [(None, ""), (True, "Yes"), (False, "No"), ([1, [None, "a"], []], "1, , a, "), ({"b": 1.0, "a": [False, "é"]}, '{"b":1,"a":[false,"é"]}'), (5.0, "5"), (2.5, "2.5"), (-0.00002, "-0.00002"), (1e-7, "1e-7"), (1.25e22, "1.25e+22"), (1e16, "10000000000000000"), ("x", "x")]
    assert [cells.cell_text(v) for v, _ in shown] == [t for _, t in shown]
    typed = [(" 5 ", "integer", 5), ("", "number", 0), ("2.50", "number", 2.5), ("0x1F", "integer", 31), ("0xZZ", "integer", "0xZZ"), ("1e3", "integer", 1000), ("five", "number", "five"), ("1e999", "number", None), ("true", "boolean", True), ("True", "boolean", False), (" a,, b ", "array", ["a", "b"]), (" x ", "string", "x"), ("5", "object", "5")]
    assert [cells.cell_value(t, k) for t, k, _ in typed] == [v for *_, v in typed]
    rows = spark.createDataFrame([('{"b": [true], "a": {"x": 1}}',), ("[1]",), ("{broken",), (None,)], "record string").select(cells.record_cells("record").alias("c"), cells.patch_value(F.col("record"), F.lit("array")).alias("v")).collect()
    assert rows[0]["c"] == {"b": "Yes", "a": '{"x":1}'} and [r["c"] for r in rows[1:]] == [None] * 3 and rows[1]["v"] == '["[1]"]' and rows[3]["v"] is None


def plain_spans(body, target):
    """The rule by trying every end from the farthest on: paragraph breaks first, then sentence breaks."""
    found, at = [], 0
    while at < len(body):
        end = min(at + target, len(body))
        if end < len(body):
            window = body[at:end]
            paragraph = [e for e in range(len(window), 1, -1) if window[e - 1] == "\n" and "\n" in window[: e - 1][len(window[: e - 1].rstrip()) :]]
            sentence = [e for e in range(len(window), 1, -1) if window[e - 1].isspace() and (window[e - 2] in ".!?" or (e > 2 and window[e - 2] in "\"')]" and window[e - 3] in ".!?"))]
            end = at + (paragraph or sentence or [end - at])[0]
        found.append((at, end))
        at = end
    return found


@given(st.text(alphabet="ab .!?\n\t\"')  é😀", max_size=300), st.integers(1, 40))
def test_spans_equal_the_plain_rule(body, target):
    assert spans(body, target) == plain_spans(body, target)


def test_chunks_of_a_long_text_in_linear_time():
    body = "Some words here. And more\n\n" * 200_000
    cuts = spans(body, 4000)
    assert cuts[-1][1] == len(body) and all(body[z - 2 : z] == "\n\n" for _, z in cuts)
