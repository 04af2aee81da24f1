"""Main-text extraction with boosted trees over DOM-node features.

Two small boosted models give each block node the odds of being main text, of
being boilerplate, or of being a container of both. A dynamic programme over
the tree picks the most probable consistent labelling: what stands under
boilerplate is boilerplate, main text may hold boilerplate (an advert inside an
article) but no new container, and only a container may hold all three.

There are no labelled pages, so the models are trained on pages that
``training_pages`` composes from random layouts, whose labels are known by
construction; the pages of the corpus are only scored.
"""

from __future__ import annotations

import functools
import html
import random
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitrace.llm.boosting import Boosted, fit_boosted
from habitrace.llm.html_dom import Block, parse

#: Composed pages for training; a documented bound.
TRAINING_PAGES = 500

TAGS = ("#text", "p", "h", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "list", "li", "table", "quote", "other")

#: Families of attribute tokens.
TOKENS = {
    "content": "article content post entry main story body text blog read prose",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topbar toolbar tabs pagination pager",
    "edge": "header footer masthead banner copyright legal bottom top logo site",
    "side": "sidebar side aside rail widget related recommended recommendations more trending popular links",
    "advert": "ad ads advert advertisement advertorial sponsor sponsored promo promotion adsense dfp",
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert newsletter subscribe paywall disclaimer warning",
    "talk": "comment comments reply replies respond discussion disqus reader review reviews feedback",
    "social": "share sharing social follow twitter facebook tags tag meta byline author",
}
#: Attribute tokens that tell nothing.
NEUTRAL = "box wrap wrapper container inner outer block item list row col left right large small js mt page area unit group".split()
_FAMILY = {w: i for i, words in enumerate(TOKENS.values()) for w in words.split()}


def _kind(tag: str) -> int:
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        tag = "h"
    elif tag in ("ul", "ol", "dl"):
        tag = "list"
    elif tag in ("dt", "dd"):
        tag = "li"
    elif tag in ("blockquote", "pre", "figure", "figcaption"):
        tag = "quote"
    elif tag in ("tbody", "thead", "tr", "td", "th"):
        tag = "table"
    return TAGS.index(tag) if tag in TAGS else len(TAGS) - 1


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block: subtree density, attribute tokens, depth, siblings, place."""
    n, families, kinds = len(blocks), len(TOKENS), [_kind(b.tag) for b in blocks]
    chars, links, words, stops, inputs, nodes, heads, paras = (np.zeros(n) for _ in range(8))
    tokens = np.zeros((n, families))
    before = np.zeros(n)
    total = 0
    for i, b in enumerate(blocks):
        before[i] = total
        nodes[i] = 1
        inputs[i] = b.inputs
        heads[i] = kinds[i] == 2
        paras[i] = kinds[i] == 1
        for w in b.attrs:
            if w in _FAMILY:
                tokens[i, _FAMILY[w]] = 1
        if b.parts:
            said = b.text()
            chars[i], links[i], words[i] = len(said), min(b.links, len(said)), said.count(" ") + bool(said)
            stops[i] = said.count(". ") + said.count("? ") + said.count("! ") + said.endswith((".", "?", "!"))
            total += len(said)
    for a in (chars, links, words, stops, inputs, nodes, heads, paras):
        for i in range(n - 1, 0, -1):
            a[blocks[i].parent] += a[i]
    above = np.zeros((n, families + 5))
    rank, count, alike = np.zeros(n), np.zeros(n), np.zeros(n)
    signs = [TAGS.index(t) for t in ("article", "main", "nav", "footer", "aside")]
    parent = np.zeros(n, int)
    for i, b in enumerate(blocks):
        same = Counter(kinds[c] for c in b.children)
        for j, c in enumerate(b.children):
            rank[c], count[c] = j, len(b.children)
            alike[c] = same[kinds[c]] / len(b.children)
        if i:
            p = parent[i] = b.parent
            above[i] = above[p]
            above[i, :families] = np.maximum(above[i, :families], tokens[p])
            for k, s in enumerate(signs):
                if kinds[p] == s:
                    above[i, families + k] = 1
    whole = max(1.0, chars[0])
    size = np.maximum(chars, 1)
    one_hot = np.zeros((n, len(TAGS)))
    one_hot[np.arange(n), kinds] = 1
    plain = np.stack(
        [np.log1p(chars), np.log1p(words), links / size, stops / np.maximum(words, 1), chars / nodes, np.log1p(nodes), inputs, heads / nodes, paras / nodes,
         [b.depth for b in blocks], rank, count, alike, before / whole, (before + chars) / whole, chars / whole, chars / np.maximum(chars[parent], 1), links[parent] / np.maximum(chars[parent], 1), np.log1p(chars[parent]), np.array(kinds)[parent]],
        axis=1,
    )
    return np.hstack([plain, one_hot, tokens, above])


def decode(blocks: list[Block], main: np.ndarray, boiler: np.ndarray) -> np.ndarray:
    """True for each block under the most probable consistent labelling that is main."""
    odds = np.stack([main * (1 - boiler), boiler * (1 - main), (1 - main) * (1 - boiler)], axis=1) + 1e-6
    logs = np.log(odds / odds.sum(axis=1, keepdims=True))
    best = [list(x) for x in logs.tolist()]
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if not b.children:
            best[i][2] = -1e18
        if i:
            up, own = best[b.parent], best[i]
            up[0] += max(own[0], own[1])
            up[1] += own[1]
            up[2] += max(own)
    label = [0] * len(blocks)
    for i, b in enumerate(blocks):
        allowed = (0, 1, 2) if not i else ((0, 1), (1,), (0, 1, 2))[label[b.parent]]
        label[i] = max(allowed, key=lambda k: (best[i][k], -k))
    return np.array([x == 0 for x in label])


def _prose(rng: random.Random, words: int, marks: bool = True) -> str:
    """Invented prose; some of it shouted, sprinkled with symbols, or strung together by a separator."""
    parts = "ta re on is el mo ver lan sti ka du pre or un ish ge al no ti ra".split()
    out, left = [], 0
    for _ in range(words):
        w = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        if left == 0:
            w, left = w.capitalize(), rng.randint(2, 16)
        left -= 1
        junk = rng.random()
        out.append(w + ("." if left == 0 and marks else "," if junk < 0.05 else ""))
    style = rng.random()
    if style < 0.07:
        out = [w.upper() + rng.choice("!?.").replace(".", "") * rng.randint(0, 2) for w in out]
    elif style < 0.16:
        often = rng.random()
        out = [w + html.escape(rng.choice(string.punctuation)) * rng.randint(1, 3) if rng.random() < often else w for w in out]
    return rng.choice([" | ", " / ", " - ", " * ", " > "] if style > 0.94 else [" "]).join(out)


def _soup(rng: random.Random, tag: str, inner: str, share: float = 0.12) -> str:
    """An element that HTML lets stay open, or one whose inner tags are crossed or forgotten, now and then."""
    if rng.random() < share:
        mark = rng.choice(["b", "i", "em", "span", "strong"])
        inner = rng.choice([f"<{mark}>{inner}", f"{inner}<br>", f"<{mark}>{inner}</{tag}></{mark}>", inner])
        return f"<{tag}>{inner}"
    return f"<{tag}>{inner}</{tag}>"


def training_pages(pages: int = TRAINING_PAGES, seed: int = 11) -> Iterator[str]:
    """Pages whose blocks carry their label as an attribute ``data-y`` (m or b)."""
    for k in range(pages):
        rng = random.Random(seed * 100_003 + k)
        pick, chance = rng.choice, rng.random
        bare = chance() < 0.25

        def tag(name: str, family: str | None, inner: str, y: str = "", bare: bool = bare, rng: random.Random = rng) -> str:
            names = TOKENS[family].split() if family else []
            if not names or bare or rng.random() >= 0.85:
                return f"<{name}{y}>{inner}</{name}>"
            said = rng.choice(names)
            if rng.random() < 0.5:
                said = rng.choice(["{}-{}", "{}_{}", "{} {}"]).format(*rng.sample([said, rng.choice(NEUTRAL)], 2))
            return f'<{name} {rng.choice(["class", "class", "class", "id"])}="{said}"{y}>{inner}</{name}>'

        def items(lo: int, hi: int, long: bool = False, rng: random.Random = rng) -> str:
            return "".join(f'<li><a href="/x">{_prose(rng, rng.randint(1, 9 if long else 2), False)}</a></li>' for _ in range(rng.randint(lo, hi)))

        y_m, y_b = " data-y=m", " data-y=b"

        def junk(rng: random.Random = rng) -> str:
            kind = rng.randrange(7)
            short = _prose(rng, rng.randint(3, 40))
            if kind == 0:
                return tag(rng.choice(["div", "aside", "section", "p"]), "advert", rng.choice([short, f"<p>{short}</p>"]), y_b, False)
            if kind == 1:
                return tag("aside", "side", f"<h3>{_prose(rng, 2, False)}</h3><ul>{items(2, 8, True)}</ul>", y_b)
            if kind == 2:
                return tag(rng.choice(["div", "section"]), "notice", f"<p>{short}</p><button>OK</button>", y_b, False)
            if kind == 3:
                return tag("form", "notice", f"<label>{_prose(rng, 2, False)}</label><input name=q><button>Go</button><p>{short}</p>", y_b)
            if kind == 4:
                return tag("div", "social", f"<a href=#>{_prose(rng, 1, False)}</a> <a href=#>{_prose(rng, 1, False)}</a>", y_b, False)
            if kind == 5:
                return tag("div", "side", f"<p>{_prose(rng, 2)}</p><ul>{items(2, 6, True)}</ul>", y_b, False)
            said = "".join(tag(rng.choice(["div", "li", "article"]), "talk", f"<p>{_prose(rng, rng.randint(3, 50))}</p>", "", False) for _ in range(rng.randint(1, 6)))
            return tag(rng.choice(["section", "div", "ol"]), "talk", f"<h3>{_prose(rng, 2, False)}</h3>" + said, y_b, False)

        def para(rng: random.Random = rng, pick=pick) -> str:
            kind, words = rng.random(), int(rng.choice([1, 3, 8, 20, 60, 150, 300]) * (0.5 + rng.random()))
            said = _prose(rng, max(1, words))
            if kind < 0.16:
                return "<ul>" + _soup(rng, "li", said) + _soup(rng, "li", _prose(rng, 9)) + "</ul>"
            if kind < 0.2:
                return f"<blockquote>{said}</blockquote>"
            if kind < 0.25:
                return f"<h2>{_prose(rng, rng.randint(1, 9), False)}</h2>"
            if kind < 0.28:
                return f"<table><tr><td>{_prose(rng, 3, False)}</td><td>{_prose(rng, 3, False)}</td></tr></table>"
            if kind < 0.34:
                return f'<p>{said} <a href="/y">{_prose(rng, 3, False)}</a> {_prose(rng, 8)}</p>'
            if kind < 0.38:
                return f"<div>{said}</div>"
            if kind < 0.41:
                return f"<p>{said} {pick(['<button>OK</button>', '<select><option>a<option>b</select>', '<input type=checkbox>'])} {_prose(rng, 8)}</p>"
            return _soup(rng, "p", said)

        body = [para() for _ in range(pick([1, 1, 2, 3, 5, 8, 14, 25, 70]))]
        title = f"<h1>{_prose(rng, rng.randint(1, 12), chance() < 0.5)}</h1>"
        main = title + "".join(body)
        inside = ""
        if chance() < 0.5:
            cut = rng.randrange(len(body) + 1)
            main = title + "".join(body[:cut]) + (inside := junk()) + "".join(body[cut:])
        host = pick(["article", "article", "article", "main", "div", "section"])
        main = tag(host, "content", main, y_m, host != "div" and bare)
        nav = tag(pick(["nav", "nav", "div", "header"]), "menu", f"<ul>{items(2, 9)}</ul>", y_b, False)
        if chance() < 0.3:
            nav = tag("header", "edge", f"<a href=/>{_prose(rng, 1, False)}</a>" + nav, y_b)
        foot = tag(pick(["footer", "footer", "div"]), "edge", f"&copy; {_prose(rng, 1)} &middot; {_prose(rng, rng.randint(2, 20))}", y_b, False)
        page = [nav] if chance() < 0.9 else []
        page += [junk() for _ in range(pick([0, 1, 1, 1, 2]))]
        page += [main]
        page += [junk() for _ in range(pick([0, 0, 0, 1, 2]))]
        middle = "".join(page[1:])
        if chance() < 0.25:
            page = [page[0], tag("div", None, middle)]
        yield "<html><body>" + "".join(page) + (foot if chance() < 0.9 else "") + pick(["</body></html>", ""])


def _labels(page: str) -> tuple[list[Block], np.ndarray]:
    """Blocks with 0 boilerplate, 1 main, 2 container, from the marks of the trainer."""
    blocks = parse(page.replace(" data-y=m", " id=zzmain").replace(" data-y=b", " id=zzboil"))
    label = np.full(len(blocks), 2)
    for i, b in enumerate(blocks):
        if i and label[b.parent] != 2:
            label[i] = label[b.parent]
        if "zzmain" in b.attrs:
            label[i] = 1
        if "zzboil" in b.attrs:
            label[i] = 0
        b.attrs = [a for a in b.attrs if not a.startswith("zz")]
    return blocks, label


@functools.lru_cache(maxsize=4)
def train(pages: int = TRAINING_PAGES) -> tuple[Boosted, Boosted]:
    """(main, boilerplate) models from composed pages; deterministic, fitted once by a driver process."""
    both = [_labels(p) for p in training_pages(pages)]
    x = np.vstack([features(b) for b, _ in both])
    y = np.concatenate([label for _, label in both])
    return fit_boosted(x, (y == 1).astype(float), 40, 4), fit_boosted(x, (y == 0).astype(float), 40, 4)


def main_texts(pages: list[str], models: tuple[Boosted, Boosted]) -> list[str]:
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    x = np.vstack([features(b) for b in parsed])
    main, boiler = (m.probability(x) for m in models)
    out, at = [], 0
    for blocks in parsed:
        chosen = decode(blocks, main[at : at + len(blocks)], boiler[at : at + len(blocks)])
        at += len(blocks)
        out.append(" ".join(t for b, c in zip(blocks, chosen) if c and b.parts and (t := b.text())))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", models: tuple[Boosted, Boosted] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    A null or empty page has an empty text, as has one without main text; very
    long pages are read whole. Repeated rows and rows without an id stay; an
    empty table gives no rows. Extra columns, whatever they are called, are
    left out.
    """
    trained = pages.sparkSession.sparkContext.broadcast(models or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 64):
                batch = whole.slice(at, 64)
                texts = main_texts([h or "" for h in batch.column(2).to_pylist()], trained.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
