"""Main text of web pages by two passes of block rules: stop words, length and links decide, then neighbours do."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_limits, batches

# HTML element names by their part in a page.
#: Their content is never text of a page.
HIDDEN = frozenset("script style noscript template head svg annotation annotation-xml iframe object canvas audio video select textarea button".split())
#: Their content is beside the article.
BESIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
#: They begin and end blocks.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class or role of elements beside the article, or their whole id.
ASIDE_WORDS = frozenset(
    "ads advert advertisement adverts breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer masthead menu modal nav navbar navigation"
    " newsletter pager pagination popup promo promoted sidebar sponsored subscribe subscription toolbar".split()
)
#: Words that say so alone or with words for boxes, but are a text's own words in other company.
WEAK_WORDS = frozenset("ad banner header notice related reply replies respond share sharing social sponsor widget".split())
BOX_WORDS = frozenset(
    "area articles banner bar block bottom box button buttons content container form group icons inner item items left links list media module news on page"
    " panel post posts right section site slot stories text this title top unit us widget with wrap wrapper".split()
)
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his if in into is it its not of on or she that the their there they this to was we were"
    " which will with would you aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für haben hat ich ihr"
    " ihre im ist mit nach nicht noch nur oder sich sie sind so über um und uns vom von vor war was wenn wie wir wird zu zum zur au aux avec ce ces cette"
    " comme dans de du elle en est et il ils je la le les leur lui mais ne nous ont ou où par pas plus pour qu que qui sa se ses son sont sur un une vous al"
    " como con cuando del desde donde el ella ellos era es esta este esto fue ha hay la las lo los más me muy ni no nos o para pero por porque se si sin"
    " sobre su sus también te un una y ya".split()
)

#: A block of more characters in links than this share is no text; one of SHORT characters or fewer is short, one of
#: LONG or more is long.
LINKS, SHORT, LONG = 0.33, 70, 200
#: Shares of stop words that make a block text, or nearly.
HIGH, LOW = 0.30, 0.12

#: What follows "<": a comment, character data, another declaration, or a tag with its attributes. A quote opens a value
#: only behind "="; each part is taken once, so that no page takes more than linear time.
_COMMENT = re.compile(r"!--(?:.*?-->|.*\Z)", re.S)
_CDATA = re.compile(r"!\[CDATA\[(.*?)(?:\]\]>|\Z)", re.S)
_NAME = re.compile(r"(/?)([A-Za-z][^\s/>\x00]*)")
_ATTRS = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+|[\"'])*+")
_NAMES = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
_ENDS = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in HIDDEN}
_HEAD = re.compile(r"</head(?=[\s/>])[^>]*>|<body\b", re.I)
#: Marks that end sentences or part them, of any script; letters of scripts without white space between words.
_MARKS = re.compile(r"[.!?;,:\u3002\uff01\uff1f\u3001\uff0c\u0964\u061f\u060c\u06d4\u1362\u104b\u17d4]")
_DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\ua000-\ua4cf\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
_FOREIGN = re.compile(r"[^\W\d_\u0000-\u024f\u1e00-\u1eff]")


class Block:
    __slots__ = ("text", "linked", "heading", "beside", "article", "main", "around", "label")

    def __init__(self, text: str, linked: int, heading: bool, beside: bool, article: bool, main: bool, around: int):
        self.text, self.linked, self.heading, self.beside, self.article = text, linked, heading, beside, article
        self.main, self.around = main, around  # in <main>; elements around the outermost article or main that class words alone mark
        self.label = ""


def _says_beside(kind: str, value: str) -> bool:
    low = value.lower()
    if kind == "id":
        return low in ASIDE_WORDS or low in WEAK_WORDS
    for name in low.split():
        parts = _PARTS.findall(name)
        if not ASIDE_WORDS.isdisjoint(parts):
            return True
        if not WEAK_WORDS.isdisjoint(parts) and all(x in WEAK_WORDS or x in BOX_WORDS for x in parts):
            return True
    return False


def _is_beside(name: str, attrs: str) -> int:
    """2 of an element beside the article, 1 if only a word of its class, id or role says so, else 0."""
    if name in BESIDE:
        return 2
    if attrs and name not in ("html", "body", "main", "article"):
        low = attrs.lower()
        if "hidden" in low and re.search(r"\shidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true", low) or "none" in low and re.search(r"display\s*:\s*none", low):
            return 2
        if any(_says_beside(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _NAMES.finditer(attrs)):
            return 1
    return 0


class _Open:
    """The open elements, the innermost last, and where those of a name and those that are blocks stand."""

    def __init__(self) -> None:
        self.all: list[tuple[str, int]] = []  # name, and whether it is beside the article
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, aside: int) -> None:
        self.at.setdefault(name, []).append(len(self.all))
        if name in BLOCK:
            self.blocks.append(len(self.all))
        self.all.append((name, aside))

    def pop(self) -> tuple[str, int]:
        name, aside = self.all.pop()
        self.at[name].pop()
        if name in BLOCK:
            self.blocks.pop()
        return name, aside

    def ended_by(self, name: str) -> int | None:
        """The element that an end tag closes: the innermost of its name, but none outside a block for other elements."""
        own = self.at.get(name)
        if not own or name not in BLOCK and self.blocks and self.blocks[-1] > own[-1]:
            return None
        return own[-1]


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order, each between two tags that begin or end blocks. A tag that the page's end cuts off
    ends the page."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    opened = _Open()
    beside = marked = around = links = articles = mains = headings = headers = 0
    at, end = 0, len(html)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                # a heading in the article's own header is the article's
                own = beside - headers if headings and articles else beside
                out.append(Block(text, linked, headings > 0, own > 0 or marked > around, articles > 0, mains > 0, around))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(_SPACE.sub(" ", text).strip())

    def close(k: int) -> None:
        nonlocal beside, marked, around, links, articles, mains, headings, headers
        while len(opened.all) > k:
            name, aside = opened.pop()
            beside -= aside == 2
            marked -= aside == 1
            links -= name == "a"
            articles -= name in ("article", "main")
            mains -= name == "main"
            headings -= name in HEADING
            headers -= aside == 2 and name == "header" and articles > 0
        if not articles:
            around = 0

    text_from = 0
    while at < end:
        at = html.find("<", at)
        if at < 0:
            break
        m = _NAME.match(html, at + 1)
        if not m:
            other = _COMMENT.match(html, at + 1) or _CDATA.match(html, at + 1)
            if other is None and html[at + 1 : at + 2] in ("!", "?", "/"):
                z = html.find(">", at + 1)
                add(html[text_from:at])
                text_from = at = end if z < 0 else z + 1
            elif other is None:
                at += 1  # a "<" of the text
            else:
                add(html[text_from:at])
                if other.re is _CDATA:
                    parts.append(other[1])
                text_from = at = other.end()
            continue
        add(html[text_from:at])
        attrs = _ATTRS.match(html, m.end())[0]
        at = m.end() + len(attrs)
        text_from = at = at + 1
        if at > end:
            break
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                flush()
            if (k := opened.ended_by(name)) is not None:
                close(k)
            continue
        if name in HIDDEN:
            if not attrs.endswith("/") or name in ("script", "style"):
                z = _HEAD.search(html, at) if name == "head" else _ENDS[name].search(html, at)
                if name == "head":
                    at = (z.start() if z[0][1] != "/" else z.end()) if z else at
                else:
                    at = z.end() if z else end
                text_from = at
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
            if (name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name in HEADING) and opened.blocks:
                # an element that its own kind ends
                k = opened.blocks[-1]
                inner = opened.all[k][0]
                if inner == "p" or inner == name and name != "li":
                    close(k)
        if name in VOID or attrs.endswith("/"):
            continue
        aside = _is_beside(name, attrs)
        headers += aside == 2 and name == "header" and articles > 0
        opened.push(name, aside)
        beside += aside == 2
        marked += aside == 1
        if not articles and name in ("article", "main"):
            around = marked
        links += name == "a"
        articles += name in ("article", "main")
        mains += name == "main"
        headings += name in HEADING
    add(html[text_from:])
    flush()
    return out


def _density(text: str) -> tuple[float, float]:
    """The share of stop words, and the length in characters of a script with white space. Text of a script without known
    stop words counts as text by its sentences' marks."""
    found = _WORD.findall(text.lower())
    letters = sum(map(len, found))
    if letters and 2 * len(_FOREIGN.findall(text)) > letters:
        dense = len(_DENSE.findall(text))
        return HIGH if _MARKS.search(text) else LOW / 2, len(text) + 2 * dense
    share = sum(w in STOP_WORDS for w in found) / len(found) if found else 0.0
    if share < LOW and len(text) >= LONG and len(_MARKS.findall(text)) >= 2 + len(text) // 200 and len(found) >= 20:
        share = LOW  # whole sentences of a language without stop words here
    return share, len(text)


def _first(b: Block, inside: bool) -> str:
    """good, bad, near (nearly good), short, or poor (few stop words, as in code, tables and names), by the block alone."""
    n = len(b.text)
    if b.beside or inside and not b.article:
        return "bad"
    if n and b.linked / n > LINKS:
        return "bad"
    if b.text[:1] in "©\xa9" and n < LONG:
        return "bad"
    if b.heading:
        return "short"
    share, size = _density(b.text)
    if size <= SHORT:
        return "short"
    if share >= HIGH:
        return "good"
    return "near" if share >= LOW or b.article else "poor"


def _runs(found: list[Block], first: list[str]) -> None:
    """Nearly good blocks that follow each other, with only short ones between, are good if they are LONG together: lists
    and paragraphs of a few words each are text as one long paragraph is."""
    i = 0
    while i < len(found):
        if first[i] != "near":
            i += 1
            continue
        k, size = i, 0
        while k < len(found) and first[k] in ("near", "short"):
            size += len(found[k].text) if first[k] == "near" else 0
            k += 1
        if size >= LONG:
            for j in range(i, k):
                first[j] = "good" if first[j] == "near" else first[j]
        i = k


def classify(found: list[Block]) -> None:
    """Labels each block good or bad: first by itself, then short and nearly good ones by the nearest decided blocks.

    Between good neighbours all kinds are good, between bad ones none; else a nearly good block is good, a poor one isn't,
    and a short one is if the good one is no further off, or in the article. Poor ones decide nothing about others. Where
    nothing is decided, the article and nearly good blocks are good. On a page without a good block, nearly good and poor ones
    and short sentences are good.
    Blocks in menus, footers and the like decide nothing about those around.
    """
    own = [b for b in found if b.article and not b.beside]
    # without <main>, the articles in the fewest marked elements are the page's, others are comments and the like
    least = 0 if any(b.main for b in own) else min((b.around for b in own), default=0)
    for b in own:
        b.beside = not b.main and b.around > least
    inside = any(not b.beside for b in own)
    first = [_first(b, inside) for b in found]
    _runs(found, first)
    if "good" not in first:
        # code, tables or a few short sentences are then what the page is about
        sentence = lambda b: not b.heading and _MARKS.search(b.text[-2:]) and " " in b.text
        first = ["good" if x in ("near", "poor") or x == "short" and sentence(b) else x for x, b in zip(first, found, strict=True)]
    n = len(found)
    # elements say of the blocks within that they are beside the text, and nothing about those around
    decides = [first[i] in ("good", "bad") and not (first[i] == "bad" and (b.beside or inside and not b.article)) for i, b in enumerate(found)]
    before, after = [(-1, "")] * n, [(n, "")] * n
    last = (-1, "")
    for i in range(n):
        before[i] = last
        if decides[i]:
            last = (i, first[i])
    last = (n, "")
    for i in range(n - 1, -1, -1):
        after[i] = last
        if decides[i]:
            last = (i, first[i])
    for i, b in enumerate(found):
        if first[i] in ("good", "bad"):
            b.label = first[i]
            continue
        (p, left), (q, right) = before[i], after[i]
        sides = {left, right} - {""}
        if first[i] == "poor":
            b.label = "good" if sides == {"good"} else "bad"
            continue
        if sides == {"good"}:
            b.label = "good"
        elif sides == {"bad"}:
            b.label = "good" if b.article and first[i] == "near" else "bad"
        elif not sides:
            b.label = "good" if b.article or first[i] == "near" else "bad"
        elif first[i] == "near" or b.article:
            b.label = "good"
        else:
            b.label = "good" if i - p == q - i else left if i - p < q - i else right
        if b.heading and b.article:
            b.label = "good"


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    classify(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def _extract(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(frames):
        texts = [main_text(x) for x in b.column("html").to_pylist()]
        cols = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (the main text, blocks joined by a blank line) and n_chars of every page.

    A null or empty page, one of markup alone and one with nothing but menus and the like have an empty text. Unclosed
    and misnested tags are taken as they come, in time linear in the page. A null page_id or url is carried along. Rows are judged each, so repeated ones give repeated results; other
    columns are ignored. An empty table gives an empty result.
    """
    arrow_limits(pages.sparkSession, 500)
    own = pages.selectExpr("CAST(page_id AS LONG) AS page_id", "url", "html")
    return own.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
