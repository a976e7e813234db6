"""Vector join and page text against brute force."""

import numpy as np
import pytest
from pyspark.sql import types as T

from flowsieve.llm import page_text, vector_join

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType())])


def brute(table, cosine=0.98):
    vectors = []
    for r in table:
        v = r["embedding"]
        ok = v and r["label"] is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) if ok else None
        vectors.append(x / np.linalg.norm(x) if ok else None)
    n = len(table)
    links = [[j for j in range(n) if j != i and vectors[i] is not None and vectors[j] is not None and table[i]["label"] == table[j]["label"]
              and len(vectors[i]) == len(vectors[j]) and vectors[i] @ vectors[j] >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        ids = [table[j]["vec_id"] for j in seen if table[j]["vec_id"] is not None]
        component = min(ids) if ids else None
        out.append((table[i]["vec_id"], len(links[i]), component, table[i]["vec_id"] == component))
    return sorted(out, key=repr)


def test_range_join(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "VECTORS_PER_PIVOT", 30)
    monkeypatch.setattr(vector_join, "BLOCK", 40)
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1):
        for centre in rng.normal(size=(25, 8)):
            rows += [(len(rows), [float(np.float32(x)) for x in centre + rng.normal(scale=0.08, size=8)], label) for _ in range(8)]
    hot = [1.0, 0.5, 0.0, -0.0, 2.0, 0.0, 0.0, 1.0]
    rows += [(2000 + i, hot, 0) for i in range(60)] + [(2100, [-x if x == 0 else x for x in hot], 0), (2101, [x * 3 for x in hot], 0)]
    rows += [(3000, None, 0), (3001, [0.0] * 8, 0), (3002, [float("nan")] * 8, 0), (3003, [float("inf")] + [1.0] * 7, 0), (3004, hot, None),
             (3005, hot[:4], 0), (3006, hot[:4], 0), (None, hot, 1), (3007, hot, 1), (3007, hot, 1), (3008, [], 0), (3009, [None, 1.0], 0)]
    table = spark.createDataFrame(rows, VECTORS)
    got = sorted((tuple(r) for r in vector_join.near_duplicates(table).collect()), key=repr)
    assert got == brute(table.collect())
    assert vector_join.near_duplicates(table.limit(0)).collect() == []


PAGE = ("<html><body><header>Site</header><nav><ul><li><a href='/'>Home</a></li></ul></nav>{}<footer>&copy; x, y. z.</footer>"
        "<script>var a = '<p>no</p>';</script></body></html>")


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain, no tags.", "plain, no tags."), ("<p>a < b and c > d</p>", "a < b and c > d"),
    ("<script>x", ""), ("<!-- open <p>no</p>", ""),
    (PAGE.format("<article><h1>T &amp;amp; U</h1><p>b \n c<br>d<p>e</article>"), "T &amp; U\nb c\nd\ne"),
    (PAGE.format("<div class='cookie-banner'>We use cookies, yes.</div><main><p>Short.</p><div id=comments><p>Nice, thanks.</p></div></main>"), "Short."),
    (PAGE.format("<div><h2>Head</h2><p>One sentence, of some length, that goes on. Another one of the kind.</p><p>And a second paragraph, "
                 "long enough to count; it ends.</p></div><div class=sidebar><p>Side, text.</p></div><form>Name <input> go.</form>"),
     "Head\nOne sentence, of some length, that goes on. Another one of the kind.\nAnd a second paragraph, long enough to count; it ends."),
])
def test_content(html, text):
    assert page_text.content(html) == text


STORY = ["The council met on Monday, and after a long debate, it agreed to rebuild the bridge; work begins in May, if funds allow.",
         "Residents, who had waited for years, welcomed the vote. Some asked about noise, dust, and the length of the works.",
         "The mayor said: the old bridge is safe, but narrow. A new one, with room for bicycles, will stand by next autumn."]


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


@pytest.mark.parametrize("attribute", ["", " class='card'", " class='teaser more'"])
@pytest.mark.parametrize("around", ["{}", "<main>{}</main>"])
def test_story_outside_teaser_articles(attribute, around):
    cards = "".join(f"<article{attribute}><h3>Ten tips number {i}</h3><p>Read it here.</p></article>" for i in range(3))
    page = PAGE.format(around.format(f"<div>{paragraphs(STORY)}</div>{cards}"))
    assert page_text.content(page) == "\n".join(STORY)
    page = PAGE.format(around.format(f"<section>{cards}</section><article><h1>Bridge</h1>{paragraphs(STORY)}</article>"))
    assert page_text.content(page) == "\n".join(["Bridge", *STORY])


def test_article_keeps_its_short_parts():
    table = "<table><tr><td>3</td><td>x</td></tr></table><ul><li>tar</li><li>steel</li></ul>"
    want = "\n".join([*STORY, "3", "x", "tar", "steel"])
    assert page_text.content(PAGE.format(f"<article>{paragraphs(STORY)}{table}</article>")) == want
    both = "".join(f"<article>{paragraphs(STORY)}{table}</article>" for _ in range(4))
    assert page_text.content(PAGE.format(both)) == "\n".join([want] * 4)


@pytest.mark.parametrize("wrapper", ["div class='content no-sidebar'", "div class=has-sidebar", "div class='page-with-comments'",
                                     "section id='search-history'", "div class='post social'"])
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<main>{}</main>"])
def test_class_words_do_not_rule_out_the_story(wrapper, inner):
    around = "<div class=ad><p>Buy now, pay later, and save.</p></div><{}>{}<div class=comments><p>Nice, thanks.</p><p>Me too.</p></div></{}>"
    page = PAGE.format(around.format(wrapper, inner.format(paragraphs(STORY)), wrapper.split()[0]))
    assert page_text.content(page) == "\n".join(STORY)


def test_class_words_still_weigh():
    thread = "<div class=comments>" + "<div><p>Well said, I think.</p></div>" * 12 + "</div>"
    assert page_text.content(PAGE.format(f"<article>{paragraphs(STORY)}</article>{thread}")) == "\n".join(STORY)
    ad = "<div class=ad>Buy, now, or, as, said, tomorrow, at the latest. It is cheap.</div>"
    assert page_text.content(PAGE.format(f"{ad}<article><h1>A vote.</h1><p><b>A vote.<br></article>")) == "A vote.\nA vote."
    cards = "".join(f"<article><h3>Tip {i}</h3><p>Read it here.</p></article>" for i in range(3))
    page = PAGE.format(f"<div><article>{paragraphs(STORY)}</article></div><div class=related>{cards}</div>")
    assert page_text.content(page) == "\n".join(STORY)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr("*", "'x' AS text", "1 AS n_chars")
    pages = pages.unionByName(pages.limit(1).selectExpr(*[f"IF(false, {c}, NULL) AS {c}" for c in pages.columns]))
    found = page_text.extracted(pages).collect()
    assert len(found) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in found)
    for r in found:
        assert "track(" not in r["text"] and "<" not in r["text"].replace("<<", "")[:1]
