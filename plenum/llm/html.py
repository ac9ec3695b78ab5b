"""Main text of web pages by tree scoring.

Blocks of text give points for their length and commas to the elements around them, half as many at each step outwards; an element's
points are discounted by the share of its text that is in links. The best element, or the article or the common parent of its equals
around it, is the container; siblings that score well enough stay with what stands between them. All that the container holds stays,
however short, but for menus, forms, notices, reader comments and the like. Sums over elements are single passes from the last element
to the first, so a page takes time in proportion to its length, however deep it is.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML and usual names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math title object textarea select canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th "
    "thead tr ul head".split()
)
DROPPED = RAW | frozenset("nav aside footer form menu dialog button head search fieldset".split())
#: What a start tag ends if it is open, up to these containers.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side-bar|comments?|commentlist|disqus|respond|cookies?|consent|gdpr|"
    r"notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|breadcrumbs?|"
    r"menu|nav|navbar|navigation|masthead|topbar|toolbar|footer|pagination|pager|widget|hidden|skip-link|toc)(?:$|[\s_-])",
    re.I,
)
#: Words that may stand beside one of FURNITURE in a class of that sense, and first words that turn it into a page's state.
HOLDERS = frozenset(
    "box bar button buttons list item items section area wrapper wrap container block group row inner outer link links icon icons side site page top bottom "
    "left right primary secondary main global mobile desktop header title form unit slot text post posts article articles entry thread reply user reader "
    "skip visually is media stories bottombar panel".split()
)
#: First words of a class that names readers' comments, whatever follows.
COMMENTS = frozenset("comment comments commentlist commenters disqus respond responses replies".split())
STATES = frozenset("no has with without not".split())
#: The share of its points that text counts in an element that looks like furniture and may hold the article.
DOUBTED = 0.3
#: The share of its parent's text outside links from which an element is the container by itself.
MOST = 0.75
#: Text of one block passes its points on to what holds it.
PARAGRAPH = frozenset("p pre li blockquote td h1 h2 h3 h4 h5 h6 dd dt".split())
ROLES = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|dialog|alert|alertdialog|menu|menubar|form)$", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|main|story|body|text)(?:$|[\s_-])", re.I)

# attributes are read in one way only and without a way back, so a tag of any length takes no memory
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*\Z", re.S)
_ATTR = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)")
_HIDDEN = re.compile(r"(?:^|[\s/])hidden(?=[\s=/]|$)", re.I)
#: A character's number: noughts before it, and figures beyond those of any character, which int() refuses by the thousand.
_NUMBER = re.compile(r"&#0*([0-9]{1,8})[0-9]*")
_NOT_SHOWN = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)


def _furniture(value: str) -> bool:
    """Whether one whole class of the value names furniture: all its words, not a part of it."""
    for name in value.split():
        words = [w for w in re.split(r"[_-]+", name) if w]
        if words and words[0].lower() in COMMENTS:
            return True
        if FURNITURE.search(name) and words[0].lower() not in STATES and all(w.lower() in HOLDERS or w[0].isdigit() or FURNITURE.search(w) for w in words):
            return True
    return False


def _comments(value: str) -> bool:
    return any(re.split(r"[_-]+", name.strip("_-"))[0].lower() in COMMENTS for name in value.split())


class _Page:
    """The elements of a page and its blocks of text, in page order."""

    def __init__(self, html: str):
        self.tag, self.parent, self.good, self.dead = ["#page"], [-1], [0.0], [False]
        self.doubted, self.comments = [False], [False]  # looks like furniture; is readers' comments
        self.block = [0]  # the nearest element around that is a block
        self._open: Counter[str] = Counter()
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._stack, self._parts, self._linked, self._links = [0], [], 0, 0
        self._read(html)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(unescape(_NUMBER.sub(r"&#\1", "".join(self._parts))).split())
            top = self._stack[-1]
            if text and not self.dead[top]:
                self.blocks.append((self.block[top], text, min(self._linked, len(text))))
        self._parts, self._linked = [], 0

    def _pop_to(self, k: int) -> None:
        if any(self.tag[n] in BLOCK for n in self._stack[k:]):
            self._flush()
        gone = [self.tag[n] for n in self._stack[k:]]
        self._links -= gone.count("a")
        self._open.subtract(gone)
        del self._stack[k:]

    def _close(self, names: set[str], until: set[str]) -> None:
        if not any(self._open[name] for name in names):
            return
        for k in range(len(self._stack) - 1, 0, -1):
            name = self.tag[self._stack[k]]
            if name in names:
                self._pop_to(k)
                if names != {"tr", "td", "th"}:
                    return
            elif name in until:
                return

    def _say(self, text: str) -> None:
        if text and not self.dead[self._stack[-1]]:
            self._parts.append(text)
            if self._links:
                self._linked += len(text)

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            m = _TOKEN.search(html, at)
            if m is None:
                self._say(html[at:])
                break
            self._say(html[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if self._open[name]:
                    self._pop_to(next(k for k in range(len(self._stack) - 1, 0, -1) if self.tag[self._stack[k]] == name))
                elif name in BLOCK:
                    self._flush()
                continue
            if name in RAW:  # up to its end tag, without regard to markup inside
                found = re.compile(f"</{name}", re.I).search(html, at)
                end = found.start() if found else size
                close = html.find(">", end)
                at = close + 1 if close >= 0 else size
                continue
            if name in BLOCK:
                self._flush()
                self._close({"p"}, {"table", "td", "th", "button", "caption", "#page"})
            if name in ENDS:
                self._close(*ENDS[name])
            if name in VOID:
                self._say(" ")
                continue
            attrs = m[3]
            dead = self.dead[self._stack[-1]] or name in DROPPED
            doubted = comments = False
            good = 25.0 if name in ("article", "main") else 0.0
            if attrs and not dead:
                if _HIDDEN.search(_VALUE.sub("=", attrs)):
                    dead = name not in ("html", "body")
                for key, *values in _ATTR.findall(attrs):
                    value = "".join(values)
                    if key.lower() in ("class", "id"):
                        if _comments(value) and name not in ("html", "body", "main", "h1"):
                            doubted = comments = True
                        elif _furniture(value) and name not in ("html", "body", "article", "main", "h1"):
                            doubted, dead = name in BLOCK, dead or name not in BLOCK
                        elif GOOD.search(value):
                            good += 25.0
                    elif key.lower() == "style" and _NOT_SHOWN.search(value) or key.lower() == "aria-hidden" and value.strip().lower() == "true":
                        dead = name not in ("html", "body")
                    elif key.lower() == "role":
                        dead = dead or bool(ROLES.match(value))
                        good += 25.0 * (value.lower() in ("main", "article"))
            if name == "header":  # a page's header, not an article's
                dead = dead or not any(self._open[x] for x in ("article", "main", "section"))
            self.tag.append(name)
            self.parent.append(self._stack[-1])
            self.good.append(good)
            self.dead.append(dead)
            self.doubted.append(doubted)
            self.comments.append(comments)
            self.block.append(len(self.tag) - 1 if name in BLOCK else self.block[self._stack[-1]])
            self._open[name] += 1
            self._stack.append(len(self.tag) - 1)
            self._links += name == "a"
        self._flush()

    def sums(self, own: list, keep: float = 1.0) -> list:
        """Each element's own value and keep times what its children come to. Parents stand before their children."""
        out = list(own)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += keep * out[e]
        return out

    def within(self, own: list[bool]) -> list[bool]:
        """Whether an element or one around it is so."""
        out = list(own)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out


def extract(html: str | None) -> str:
    """The main text: blocks in page order, one a line."""
    page = _Page(html or "")
    if not page.blocks:
        return ""
    n, parent, tag = len(page.tag), page.parent, page.tag
    size = [0] * n
    for node, text, _ in page.blocks:
        size[node] += len(text)
    size = page.sums(size)
    article = [tag[e] in ("article", "main") and not page.comments[e] and not page.dead[e] for e in range(n)]
    holds = page.sums([int(x) for x in article])
    # what looks like furniture goes, unless it holds an article, main, or most of the text: there the best element decides;
    # comments go, unless both are so; beside articles without any text, much text makes no article
    empty = holds[0] and not any(article[e] and size[e] for e in range(n))
    large = [2 * size[e] > size[0] and not empty for e in range(n)]
    gone = page.within([page.doubted[e] and not (holds[e] and large[e] if page.comments[e] else holds[e] or large[e]) for e in range(n)])
    blocks = [b for b in page.blocks if not gone[b[0]]]
    if not blocks:
        return ""
    doubt = page.within(page.doubted)
    score, chars, linked = [0.0] * n, [0] * n, [0] * n
    for node, text, links in blocks:
        points = 1.0 + text.count(",") + text.count("，") + min(len(text) / 100.0, 3.0)
        score[max(0, parent[node]) if tag[node] in PARAGRAPH else node] += points * (DOUBTED if doubt[node] else 1.0)
        chars[node] += len(text)
        linked[node] += links
    score, chars, linked = page.sums(score, 0.5), page.sums(chars), page.sums(linked)
    final = [(s + g) * (1 - l / c) if s and c else 0.0 for s, g, c, l in zip(score, page.good, chars, linked)]
    best = max(range(n), key=lambda e: (final[e], -e))
    plain = [c - l for c, l in zip(chars, linked)]
    around = [best]
    while parent[around[-1]] >= 0:
        around.append(parent[around[-1]])
    top = next((e for e in around if article[e]), None)
    if top is None:
        top = best
        for e in around[1:]:
            if tag[e] in ("#page", "html", "body") or page.doubted[e] or plain[top] < plain[e] and plain[top] >= MOST * plain[e]:
                break
            top = e
    above = {top, *around[around.index(top) :]}
    dense = [linked[e] / chars[e] if chars[e] else 1.0 for e in range(n)]
    beside = [e for e in range(n) if parent[e] == parent[top] and not page.dead[e] and not gone[e] and not page.doubted[e]]
    alike = lambda e: final[e] >= max(10.0, 0.2 * final[best]) and dense[e] < 0.5 or plain[e] > 80 and dense[e] < 0.25 and tag[e] in ("p", "pre", "blockquote", tag[top]) and not article[top]
    kept = {top, *(e for e in beside if alike(e))}  # top may look like furniture itself, and none of the others be alike
    # what stands between kept siblings belongs to them
    kept |= {e for e in beside if min(kept) < e < max(kept) and dense[e] < 0.5}
    inside = page.within([e in kept for e in range(n)])
    bad = page.within([page.doubted[e] and e not in above for e in range(n)])
    return "\n".join(text for node, text, _ in blocks if inside[node] and not bad[node])


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars (code points).

    A null html is empty; cut-off pages give what they have; pages of any size are read whole; bytes that are no UTF-8 become U+FFFD.
    Repeated rows each give a row, an empty table none; null ids and urls stay null; other columns are ignored.
    """

    @F.pandas_udf("string")
    def of(col: pd.Series) -> pd.Series:
        return col.map(extract)

    return pages.select("page_id", "url", of(F.make_valid_utf8(F.col("html").cast("string"))).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
