"""HTML extraction: words score by weights learned from labelled pages, tags count against, and a linear scan finds the best region."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarmac.llm.common import add_columns

# Element names of the HTML standard. The content of the first is never text; the last say nothing of a part.
_RAW = set("script style noscript template svg math iframe object canvas video audio textarea select title".split())
_SILENT = {"script", "style", "noscript", "template", "svg"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_OWN_END = set("p li option tr td th dt dd".split())
_GENERIC = _INLINE | _VOID | _OWN_END | set("html head body div section h1 h2 h3 h4 h5 h6 ul ol dl table thead tbody tfoot caption blockquote pre figure figcaption center address details summary hgroup".split())

_LOWER = {c: c + 32 for c in range(65, 91)}
_TAG = re.compile(r"/?[a-z][a-z0-9:-]*")
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style|data-main)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")

#: An element of this weight or less is no part of the text around it; one of at least the second holds content.
NOT_CONTENT, CONTENT = -1.5, 1.0


class Token(NamedTuple):
    """A tag or a piece of text: its kind, whether it begins a block, its text and words, and what its open elements say of it."""

    kind: str
    block: bool
    text: str
    words: int
    main: bool
    link: bool
    mode: str
    content: float
    part: int
    features: tuple


def _tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of tags, comments (no name) and raw elements (name and ``!``), in one pass.

    What is sought and not found once is not sought again, so unclosed tags, quotes and comments cost one look at the rest.
    """
    lower = page.lower()
    if len(lower) != len(page):  # places must stay
        lower = page.translate(_LOWER)
    missing: set[str] = set()

    def find(what: str, at: int) -> int:
        if what in missing:
            return -1
        found = lower.find(what, at)
        if found < 0:
            missing.add(what)
        return found

    n, at = len(page), 0
    while (at := find("<", at)) >= 0:
        if lower.startswith("<!--", at):
            end = find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield at, end, "", ""
            at = end
            continue
        m = _TAG.match(lower, at + 1)
        if not m:
            if at + 1 < n and lower[at + 1] in "!?/":
                end = find(">", at)
                end = n if end < 0 else end + 1
                yield at, end, "", ""
                at = end
            else:
                at += 1
            continue
        end = m.end()
        while True:  # to the first > outside of quotes; a quote that never closes is none
            stop = find(">", end)
            if stop < 0:
                yield at, n, "", ""  # a tag that the page's end cuts off
                return
            quotes = [q for q in (lower.find('"', end, stop), lower.find("'", end, stop)) if q >= 0]
            if not quotes:
                break
            quote = min(quotes)
            close = find(lower[quote], quote + 1)
            if close < 0:
                break
            end = close + 1
            if end > stop:
                continue
        name, attrs = m[0], lower[m.end() : stop]
        end = stop + 1
        if name in _RAW and not attrs.endswith("/"):
            close = find(f"</{name}", end)
            if close >= 0:
                close = find(">", close)
            end = n if close < 0 else close + 1
            name += "!"
        yield at, end, name, attrs
        at = end


def _features(name: str, attrs: str) -> list[tuple[str, float]]:
    """What an element's name and attributes say of what it holds: features and their shares. A class of several words counts with their mean."""
    out = [] if name in _GENERIC else [(f"tag:{name}", 1.0)]
    for m in _ATTR.finditer(attrs) if attrs else ():
        key, value = m[1], m[2] or m[3] or m[4] or ""
        if key == "class" or key == "id" and name not in ("h1", "h2", "h3", "h4", "h5", "h6"):
            for one in value.split():
                words = _NAME.findall(one)
                out += [(f"name:{w}", (1.0 if key == "class" else 0.6) / len(words)) for w in words]
        elif key == "role":
            out.append((f"role:{value.strip()}", 1.0))
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            out.append(("hidden", 1.0))
    return [] if name in ("html", "body") else out


def tokens(page: str, weights: dict[str, float], forms: bool = True) -> list[Token]:
    """Tags and texts of a page in order, with what their open elements say; time grows with the page, however deep it nests.

    The mode is ``plain``, ``skipped`` within a part inside content that is none itself, or ``outside`` within such a part
    elsewhere; ``part`` is the place of the innermost such part. ``forms`` says whether a form is one.
    """
    out: list[Token] = []
    # Of each open element: name, mode, greatest content weight, place of the innermost part, links open, main text, features.
    stack: list[tuple] = [("", "plain", 0.0, -1, 0, False, ())]
    opened: Counter = Counter()

    def emit(kind: str, block: bool, text: str) -> None:
        _, mode, content, part, links, main, features = stack[-1]
        out.append(Token(kind, block, text, len(text.split()), main, links > 0, mode, content, part, features))

    def close(name: str) -> None:
        if opened[name]:
            while True:
                gone = stack.pop()[0]
                opened[gone] -= 1
                if gone == name:
                    return

    at = 0
    for start, end, name, attrs in _tags(page):
        if start > at:
            emit("word", False, html.unescape(page[at:start]))
        at = end
        if not name:
            continue
        if name.endswith("!"):
            emit("tag:raw", name[:-1] not in _SILENT, "")
        elif name.startswith("/"):
            close(name[1:])
            emit(f"tag:{name[1:]}", name[1:] not in _INLINE, "")
        else:
            if name not in _VOID and not attrs.endswith("/"):
                if name in _OWN_END and stack[-1][0] == name:
                    close(name)
                _, mode, content, part, links, main, above = stack[-1]
                own = _features(name, attrs)
                weight = sum(weights.get(f, 0.0) * share for f, share in own if forms or f != "tag:form")
                if weight <= NOT_CONTENT:
                    part = len(out)
                    mode = mode if mode != "plain" else "skipped" if content >= CONTENT else "outside"
                elif mode == "plain":
                    content = max(content, min(weight, 4.0))
                known = (*above, *own) if not weights else ()
                stack.append((name, mode, content, part, links + (name == "a"), main or "data-main" in attrs, known))
                opened[name] += 1
            emit(f"tag:{name}", name not in _INLINE, "")
    if len(page) > at:
        emit("word", False, html.unescape(page[at:]))
    return out


# Usual names of containers of content, and of other parts of a page.
_CONTENT_NAMES = "article content main post entry story body text".split()
_OTHER_NAMES = (
    "ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs cookie cookies consent gdpr disclaimer footer foot form login masthead menu menubar modal "
    "nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promoted promotion recommended related rss search share sharing sidebar side signup "
    "skip social sponsor sponsored subscribe subscription tags toolbar topbar warning widget widgets comment comments commentlist reply replies respond disqus discussion feedback "
    "reviews responses"
).split()
_OTHER_TAGS = "nav footer aside form menu dialog button fieldset datalist".split()
_OTHER_ROLES = "navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split()
_SENTENCES = [
    "The river rose in the night and by morning the lower road was under water from the mill to the old bridge.",
    "Nobody was hurt.",
    "Work on a <a href='/d'>new dam</a> had been planned for years, <b>but</b> the council never found the money that it needed.",
    "It may now.",
    "A meeting is called for the first week of next month, when engineers will show three plans and what each of them would cost.",
    "<i>Three</i> of the plans were drawn before the last flood, and none of them would have held it back.",
]
_OTHERS = ["Read also what our readers say about this and send us your own", "All rights reserved", "We use small files on this site to make it better for you", "Buy boots now"]


def labelled_pages() -> list[str]:
    """Pages of usual layouts, made for this purpose: ``data-main`` marks their main text. Every name and tag of another part
    stands in some page as a part of its own, with links or sentences; headers also stand inside the main text."""
    links = "<ul>" + "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Home", "News", "Weather", "Sport", "About us")) + "</ul>"
    wraps = ["article", "main", "div role='main'", *[f"div class='{n}'" for n in _CONTENT_NAMES], *[f"div id='{n}'" for n in _CONTENT_NAMES], "td", "div"]
    others = [f"div class='{n}'" for n in _OTHER_NAMES] + _OTHER_TAGS + [f"div role='{r}'" for r in _OTHER_ROLES] + ["header", "div class='header'", "div hidden"]
    out = []
    for i in range(2 * len(others)):
        wrap = wraps[i % len(wraps)]
        one, two = others[i % len(others)], others[(i * 7 + 3) % len(others)]
        said = _OTHERS[i % len(_OTHERS)]
        body = "".join(f"<p>{s}</p>" for s in _SENTENCES[i % 3 :])
        head = ("<h1>High water</h1>", "<header><h1>High water in the valley</h1><p>From our reporter</p></header>", "<div class='header'><h1>High water in the valley</h1></div>")[i % 3]
        site = ("header", "div class='header'")[i % 2]
        inner = f"<{two}><p>{said}</p>{links if i % 2 else ''}</{two.split()[0]}>"
        before, after = (links if i % 2 else f"<p>{said}</p>{links}"), (f"<p>{said}</p>" if i % 4 else f"<p>{said} {said}</p>")
        out.append(
            f"<html><body><{site}>{said}</{site.split()[0]}><{one}>{before}</{one.split()[0]}><div>{links}</div><div><{wrap} data-main>{head}{body}</{wrap.split()[0]}></div>"
            f"{inner}<{one}>{after}</{one.split()[0]}></body></html>"
        )
    return out


def learn(pages: list[str]) -> dict[str, float]:
    """Log odds that words stand in the main text: by feature of their elements, in links, and outside of all content, on pages
    that have most words in content and on others; and of tags by name, which always count against a region, at least a little."""
    inside, outside = Counter(), Counter()
    for page in pages:
        for t in tokens(page, {}):
            count = inside if t.main else outside
            if t.kind == "word":
                count["link"] += t.words * t.link
                for f in {f for f, _ in t.features}:
                    count[f] += t.words
            else:
                count["<" + t.kind] += 1
    odds = {f: math.log((inside[f] + 0.5) / (outside[f] + 0.5)) for f in {*inside, *outside}}
    weights = {f.removeprefix("<tag:") if f[0] == "<" else f: max(-3.0, min(v / 2, -0.05)) if f[0] == "<" else max(-4.0, min(v, 4.0)) for f, v in odds.items()}
    for page in pages:
        parsed = tokens(page, weights)
        base = _base(parsed)
        for t in parsed:
            if t.kind == "word" and not t.link and t.mode == "plain" and t.content < CONTENT:
                (inside if t.main else outside)[base] += t.words
    return weights | {b: max(-4.0, min(math.log((inside[b] + 0.5) / (outside[b] + 0.5)), 4.0)) for b in ("alone", "beside")}


def _base(parsed: list[Token]) -> str:
    """What words outside of all content are: beside content that has most of the page's words, or alone."""
    words = [(t.words, t.content >= CONTENT) for t in parsed if t.kind == "word" and not t.link and t.mode == "plain"]
    return "beside" if 2 * sum(n for n, content in words if content) >= sum(n for n, _ in words) > 0 else "alone"


_weights: dict[str, float] = {}


def _region(parsed: list[Token], weights: dict[str, float]) -> tuple[int, int]:
    """First token and the one after the last of the contiguous region of the greatest sum of scores (empty if none is positive)."""
    base, link = weights[_base(parsed)], weights["link"]
    total = best = 0.0
    start, region = 0, (0, 0)
    for i, t in enumerate(parsed):
        if t.mode == "skipped":
            score = 0.0
        elif t.kind == "word":
            score = t.words * (NOT_CONTENT if t.mode == "outside" else link if t.link else t.content if t.content >= CONTENT else base)
        else:
            score = weights.get(t.kind[4:], -0.3)
            if t.content >= CONTENT:
                score = max(score, -0.3)
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, region = total, (start, i + 1)
    return region


def extract(page: str, weights: dict[str, float] | None = None) -> str:
    """The main text of a page: the blocks of its best region, without parts that begin inside it and aren't content by their names.

    A page that has no such text, but a form, is read once more as if the form were none: some pages stand in one.
    """
    if not _weights:
        _weights.update(learn(labelled_pages()))
    weights = weights or _weights
    parsed = tokens(page, weights)
    begin, end = _region(parsed, weights)
    if end == begin and "<form" in page.lower():
        parsed = tokens(page, weights, forms=False)
        begin, end = _region(parsed, weights)
    if end == begin:
        return ""
    # Whole blocks: the region grows to the block borders around it.
    while begin > 0 and not parsed[begin - 1].block and not parsed[begin].block:
        begin -= 1
    while end < len(parsed) and not parsed[end].block:
        end += 1
    blocks, current = [], []
    for t in parsed[begin:end]:
        if t.block:
            blocks.append("".join(current))
            current = []
        elif t.text and t.part < begin and t.mode != "skipped":
            current.append(t.text)
    blocks.append("".join(current))
    return " ".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per page: ``row`` (its ``keep`` columns), text and n_chars. A null or empty page, or one without words, gives the empty text."""

    def compute(column):
        texts = [extract(p) if p else "" for p in column.to_pylist()]
        return [texts, [len(t) for t in texts]]

    return add_columns(pages, [html_col], compute, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], list(keep))
