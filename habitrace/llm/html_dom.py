"""A small tolerant HTML reader: block nodes with their statistics, text in page order.

Inline elements belong to the block that holds them; text that stands beside
child blocks becomes an anonymous block, so only leaves have text. Elements end
as the HTML standard has it: raw text (scripts, styles, titles) at its own end
tag by name, everything else at its own end tag or with its parent. Only
``script`` and ``style`` without an end run to the end of the page; any other
raw element without one (before the next of its name) is nothing but a stray
tag. Form controls and templates hide what they hold if they are closed; without
an end tag of their own they hide nothing.
"""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|noscript|iframe|noembed|noframes|xmp)(?=[\s/>])(?P<rawattrs>[^>]*)>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[/!?][^>]*(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")

#: Elements by how they lay out and nest.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style title textarea noscript iframe noembed noframes xmp".split()
RAW_NEXT = {name: re.compile(rf"<(/?){name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
HIDES = set("button select datalist template".split())
CONTROLS = set("button select textarea input".split())
IGNORED = set("html head body".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var svg g text tspan math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover semantics annotation object canvas picture video audio output meter progress slot".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = set("ul ol dl table tbody thead tfoot tr body html div section article form nav aside".split())


class Block:
    """One block node: where it hangs, what it is called, and its own text."""

    __slots__ = ("tag", "parent", "depth", "attrs", "children", "parts", "links", "inlines", "inputs", "end")

    def __init__(self, tag: str, parent: int, depth: int, attrs: list[str]):
        self.tag, self.parent, self.depth, self.attrs = tag, parent, depth, attrs
        self.children: list[int] = []
        self.parts: list[str] = []
        self.links = self.inlines = self.inputs = 0
        self.end = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _tokens(attrs: str) -> list[str]:
    return [w for m in _ATTR.finditer(attrs) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())]


class _Open:
    """An open element on the stack; ``mark`` tells where hidden content began."""

    __slots__ = ("name", "block", "mark")

    def __init__(self, name: str, block: int, mark: tuple[int, int, int, int] | None = None):
        self.name, self.block, self.mark = name, block, mark


class _Reader:
    """Tokens to blocks."""

    def __init__(self) -> None:
        self.blocks = [Block("html", -1, 0, [])]
        self.stack = [_Open("html", 0)]
        self.in_link = 0
        self.text_at = -1

    def leaf(self) -> Block:
        """Where text goes: an anonymous block under the current one."""
        if self.text_at < 0:
            owner = self.stack[-1].block
            self.text_at = len(self.blocks)
            self.blocks.append(Block("#text", owner, self.blocks[owner].depth + 1, []))
            self.blocks[owner].children.append(self.text_at)
        return self.blocks[self.text_at]

    def say(self, raw: str) -> None:
        if self.text_at < 0 and not raw.strip():
            return
        said = html.unescape(raw) if "&" in raw else raw
        own = self.leaf()
        own.parts.append(said)
        own.links += len(said) if self.in_link else 0

    def pop_to(self, k: int) -> None:
        for open_ in self.stack[k:]:
            self.in_link -= open_.name == "a"
            if open_.name not in INLINE and open_.mark is None:
                self.text_at = -1
        del self.stack[k:]

    def hide_from(self, mark: tuple[int, int, int, int]) -> None:
        """Takes back the text since ``mark``; what follows goes on in the block that stood open then."""
        made, text_at, parts, links = mark
        for block in self.blocks[made:]:
            block.parts, block.links = [], 0
        if text_at >= 0:
            own = self.blocks[text_at]
            del own.parts[parts:]
            own.links = links
        self.text_at = text_at

    def end(self, name: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            open_ = self.stack[k]
            if open_.name == name:
                self.pop_to(k)
                if open_.mark is not None:
                    self.hide_from(open_.mark)
                return
            if (name in INLINE and open_.name not in INLINE) or (name == "p" and open_.mark is not None):
                return

    def close(self, names: tuple[str, ...], stops: set[str]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name in names:
                return self.pop_to(k)
            if self.stack[k].name in stops or self.stack[k].mark is not None:
                return None

    def start(self, name: str, attrs: str) -> None:
        if name in IGNORED:
            self.blocks[0].attrs += _tokens(attrs)
        elif name == "br":
            if self.text_at >= 0:
                self.blocks[self.text_at].parts.append(" ")
        elif name in VOID:
            if name == "input":
                self.leaf().inputs += 1
            elif name == "hr":
                self.text_at = -1
        elif name in HIDES:
            if name in CONTROLS:
                self.leaf().inputs += 1
            at = self.text_at
            mark = (len(self.blocks), at, len(self.blocks[at].parts) if at >= 0 else 0, self.blocks[at].links if at >= 0 else 0)
            if not attrs.rstrip().endswith("/"):
                self.stack.append(_Open(name, self.stack[-1].block, mark))
        elif name in INLINE:
            if self.text_at >= 0:
                self.blocks[self.text_at].inlines += 1
            if not attrs.rstrip().endswith("/"):
                self.stack.append(_Open(name, self.stack[-1].block))
                self.in_link += name == "a"
        else:
            if name in CLOSES_P:
                self.close(("p",), HOLDS)
            if name in SAME:
                self.close(SAME[name], HOLDS - {"tr"} if name in ("td", "th") else HOLDS - set(SAME[name]))
            owner = self.stack[-1].block
            self.blocks.append(Block(name, owner, self.blocks[owner].depth + 1, _tokens(attrs) if attrs else []))
            self.blocks[owner].children.append(len(self.blocks) - 1)
            self.stack.append(_Open(name, len(self.blocks) - 1))
            self.text_at = -1


def _after_raw(page: str, raw: str, at: int, unended: set[str]) -> int:
    """Where to go on behind the start tag of a raw element; names without any more end tags are remembered."""
    if raw in unended:
        return at
    code, place = raw in ("script", "style"), at
    while (found := RAW_NEXT[raw].search(page, place)) and code and not found[1]:
        place = found.end()
    if found:
        return found.end() if found[1] else at
    if code:
        return len(page)
    unended.add(raw)
    return at


def parse(page: str) -> list[Block]:
    """Blocks in page order, parents first; block 0 is the root."""
    reader, at = _Reader(), 0
    unended: set[str] = set()
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            reader.say(page[at : m.start()])
        at = m.end()
        if m["raw"]:
            raw = m["raw"].lower()
            if raw == "textarea":
                reader.leaf().inputs += 1
            at = _after_raw(page, raw, at, unended)
            continue
        name = m["name"] or m["name2"]
        if not name:
            continue
        if m["end"] or m["end2"]:
            reader.end(name.lower())
        else:
            reader.start(name.lower(), m["attrs"] or m["attrs2"] or "")
    if at < len(page):
        reader.say(page[at:])
    return reader.blocks
