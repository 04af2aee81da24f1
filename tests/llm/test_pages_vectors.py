"""HTML extraction and embedding near-dedup."""

import html

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitrace.llm import embed_dedup, html_extract


@pytest.fixture(scope="module")
def models():
    return html_extract.train(200)


def _page(body, title="A title of words.", tail="</body></html>"):
    return f'<!DOCTYPE html><html><head><title>{title}</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>News</a></li></ul></nav><div class="ad">Buy now and save.</div><article><h1>{title}</h1>{body}</article><footer>&copy; host</footer>{tail}'


def test_main_text(models):
    said = ["First words, and more of them here.", "Second &amp; third paragraph is a longer one; it goes on."]
    body = "".join(f"<p>{s}</p>" for s in said)
    got = html_extract.main_texts([_page(body), _page(body, tail=""), _page(f"<p><b>{said[0]}<br><p>{said[1]}")], models)
    want = "A title of words. " + " ".join(html.unescape(s) for s in said)
    assert got == [want] * 3


#: (what stands in the article, what its text is): elements that must not take text with them.
ODD = [
    ("<p>before</p><button-group>x y</button-group><p>after</p>", "before x y after"),
    ("<p>before</p><object-view>held<p>inner words</p></object-view><p>after</p>", "before held inner words after"),
    ("<p>before <select-x>kept</select-x> and</p><p>after</p>", "before kept and after"),
    ("<p>before</p><noscript>without end<p>after</p>", "before without end after"),
    ("<p>before<noscript><p>gone</p></noscript></p><p>after</p>", "before after"),
    ("<p>sum <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here</p>", "sum x=2 here"),
    ("<p>an <object data=x>object text</object> and <canvas>canvas text</canvas></p>", "an object text and canvas text"),
    ("<p>Choose a colour <select><option>red<option>blue</select>first, and the page keeps it <button>OK</button>for as long as you read.</p><p>after</p>", "Choose a colour first, and the page keeps it for as long as you read. after"),
    ("<p>left <button>open</p><p>after</p>", "left open after"),
    ("<p>code</p><script>if (a<b) '</p>'</script><style>p{}</style><p>after</p>", "code after"),
    ("<p>a<textarea>typed</textarea>b</p><iframe>frame</iframe><p>after</p>", "ab after"),
    ("<p>t<template><p>hidden</p></template></p><p>after</p>", "t after"),
]


@pytest.mark.parametrize("inner,want", ODD)
def test_no_text_is_lost(models, inner, want):
    said = "Words of the article that come first, and more of them follow here."
    last = "The last paragraph of the article stands here, whole."
    page = _page(f"<p>{said}</p>{inner}<p>{last}</p>", title="A title of words.")
    assert html_extract.main_texts([page], models) == [f"A title of words. {said} {want} {last}"]


#: Pages as people write them: (html, main text).
BY_HAND = [
    (
        "<html><body><header><a href=/>Site</a><nav><a href=/a>A</a> <a href=/b>B</a></nav></header><main><h1>How to bake bread</h1><p>Mix flour, water, salt and yeast. Knead for ten minutes.</p><ul><li>500 g flour<li>10 g salt</ul><p>Bake until it is brown &mdash; about 40 minutes.</p></main><aside><h3>Related</h3><ul><li><a href=/c>Cakes</a></ul></aside><footer>&copy; 2020 Site</footer></body></html>",
        "How to bake bread Mix flour, water, salt and yeast. Knead for ten minutes. 500 g flour 10 g salt Bake until it is brown \u2014 about 40 minutes.",
    ),
    (
        "<body><div class=navbar><a href=/>Home</a> <a href=/about>About</a></div><div class='post-content'><h1>Notes on rivers</h1><p>Rivers carry water to the sea. They also carry sand.</p><div class=advert>Buy boats today, only here.</div><p>Most rivers begin in mountains, where rain and snow are common.</p></div><div id=comments><h3>2 comments</h3><div class=comment><p>Nice text!</p></div><div class=comment><p>I disagree.</p></div></div><div class=footer>Imprint &middot; Privacy</div>",
        "Notes on rivers Rivers carry water to the sea. They also carry sand. Most rivers begin in mountains, where rain and snow are common.",
    ),
    (
        "<html><body><nav><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></nav><div class='cookie-notice'><p>We use cookies.</p><button>Accept</button></div><article><h1>A short report</h1><p>The council met on Monday. It decided nothing.</p><blockquote>Nothing is decided until everything is, the mayor said.</blockquote><form class=newsletter><label>Mail</label><input name=m><button>Join</button></form><p>It will meet again next week.</p></article></body></html>",
        "A short report The council met on Monday. It decided nothing. Nothing is decided until everything is, the mayor said. It will meet again next week.",
    ),
]


@pytest.mark.parametrize("page,want", BY_HAND)
def test_pages_by_hand(models, page, want):
    assert html_extract.main_texts([page], models) == [want]


def test_composed_pages_held_out(models):
    wrong = total = 0
    for page in html_extract.training_pages(80, seed=77):
        blocks, label = html_extract._labels(page)
        x = html_extract.features(blocks)
        chosen = html_extract.decode(blocks, models[0].probability(x), models[1].probability(x))
        for b, y, c in zip(blocks, label, chosen):
            if b.parts:
                wrong, total = wrong + (c != (y == 1)), total + 1
    assert wrong / total < 0.03


def test_decode_is_hierarchical():
    """Boilerplate above, main below: the labelling stays consistent whatever the odds."""
    from habitrace.llm.html_dom import parse

    rng = np.random.default_rng(0)
    blocks = parse("<div><nav><p>a</p><div><p>b</p><p>c</p></div></nav><article><p>d</p><aside><p>e</p></aside></article></div>")
    for _ in range(50):
        m, b = rng.random(len(blocks)), rng.random(len(blocks))
        chosen = html_extract.decode(blocks, m, b)
        for i, x in enumerate(blocks):
            if chosen[i] and x.parent >= 0 and not chosen[x.parent]:
                # main text under what is not main: that is a container, which nothing main stands above
                up = x.parent
                while up >= 0:
                    assert not chosen[up]
                    up = blocks[up].parent


def test_extract_edges(spark, models):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "plain words only"), (3, "u", "plain words only"), (4, "u", "<div><p>unclosed <b>bold &nbsp; text"), (5, "u", "<" * 300), (None, "u", _page("<p>Some text that is here.</p>")), (6, "u", _page("<p>" + "long words here. " * 20000 + "</p>"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = html_extract.extract(df, models=models).collect()
    assert len(got) == len(pages)
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == "" and by[1].n_chars == 0
    assert by[6].n_chars > 300000 and "Some text that is here." in by[None].text
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(df.limit(0), models=models).count() == 0


def _brute(rows, threshold=0.9):
    ok = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, np.float64)
    links = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold:
                links[a].add(b)
    label = {k: rows[k][0] for k in range(len(rows))}
    while True:
        new = {k: min([label[k], *(label[j] for j in links[k])]) if links[k] else label[k] for k in label}
        if new == label:
            return sorted(((rows[k][0], len(links[k]), label[k]) for k in label), key=str)
        label = new


@pytest.mark.parametrize("block", [1024, 7])
def test_embedding_links(spark, block):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(8):
        mid = rng.standard_normal(16)
        for k in range(12):
            rows.append((100 * c + k, [float(np.float32(x)) for x in mid + 0.08 * rng.standard_normal(16)]))
    rows += [(900 + k, [float(x) for x in rng.standard_normal(16)]) for k in range(30)]
    rows += [(950, rows[0][1]), (951, rows[0][1]), (3, rows[3][1]), (960, None), (961, []), (962, [0.0] * 16), (963, [float("nan")] + [1.0] * 15), (964, [None] + [1.0] * 15), (965, [1.0, 2.0]), (966, [2.0, 4.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(0)).withColumn("node", F.lit("clash"))
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.embedding_links(df, block=block).collect()), key=str)
    assert got == _brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])


def test_recall_of_a_table(spark):
    """Ids divisible by 20 against all rows: the links found, of those that brute force finds at the threshold."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()
    rng = np.random.default_rng(5)
    base = np.array([r.embedding for r in rows], np.float64)
    made = [base]
    for cos in (0.9005, 0.905, 0.92, 0.95):
        unit = base[:300] / np.linalg.norm(base[:300], axis=1)[:, None]
        other = rng.standard_normal(unit.shape)
        other -= (other * unit).sum(axis=1)[:, None] * unit
        made.append(cos * unit + np.sqrt(1 - cos * cos) * other / np.linalg.norm(other, axis=1)[:, None])
    vectors = np.vstack(made).astype(np.float32)
    vectors = vectors[rng.permutation(len(vectors))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embed_dedup.embedding_links(df).collect()}
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    true = {q: int((unit @ unit[q] >= 0.9).sum()) - 1 for q in range(0, len(unit), 20)}
    assert all(got[i] <= n for i, n in true.items())
    assert sum(got[i] for i in true) >= 0.9 * sum(true.values()) > 50


def test_hot_bucket(spark):
    """A large family in one bucket, cut into blocks: no link is lost, none is counted twice."""
    rng = np.random.default_rng(9)
    mid = rng.standard_normal(8)
    rows = [(i, [float(np.float32(x)) for x in mid + 0.02 * rng.standard_normal(8)]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for block in (4096, 100):
        got = embed_dedup.embedding_links(df, block=block).collect()
        assert {(r.n_links, r.component_id) for r in got} == {(699, 0)}


def test_embedding_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_dedup.embedding_links(empty).count() == 0
    one = spark.createDataFrame([(4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert embed_dedup.embedding_links(one).first().asDict() == {"vec_id": 4, "n_links": 0, "component_id": 4, "kept": True}
