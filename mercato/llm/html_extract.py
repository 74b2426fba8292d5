"""Main text of web pages (operator 11): tree scoring.

A page is read into a tree (``html_tree``). Elements that are no part of an article by their
name, role or class (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments) are set aside. Every paragraph then passes points for its length and its commas
to its ancestors: all of them to the nearest block above it, half to the next, a sixth, an eighth
and a tenth to the ones above. A block's points are multiplied by the share of its text that is
no link, after a bonus for the names that mark content. The block with most points is the
container. Where it lies in an ``article`` (or else in ``main``) that element is taken whole. Its
siblings are kept where they look like parts of the same text: blocks of the same class, or with a
fifth of its points, paragraphs that are not mostly links, and headings above it. Inside, lists of
short links go, and nothing else.

Text of a block has its white space (Unicode's, no-break spaces too) turned into one space and is
trimmed; blocks are joined in page order by one space. A line break ends a word like a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import by_bytes, prepare
from mercato.llm.html_tree import HEADINGS, INLINE, Page, attributes

# Elements and roles that hold no article text.
ASIDE_TAGS = frozenset("head script style noscript template nav aside footer header form button "
                       "select option textarea input label fieldset iframe object embed svg canvas "
                       "menu dialog audio video map datalist".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog "
                        "dialog menu menubar form toolbar tablist status".split())
# Words of class and id names. One that opens or ends a name tells what it is.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox "
    "adunit banner sponsor sponsored sponsors promo promos promoted promotion "
    "menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager topbar toolbar "
    "header masthead footer copyright colophon sidebar sidebars aside rail widget widgets "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay paywall "
    "newsletter subscribe subscription signup login search form "
    "share sharing social related recommended recommendations trending popular teaser teasers "
    "skip hidden".split())
COMMENT_WORDS = frozenset("comment comments commentlist commentary discussion disqus replies reply "
                          "respond responses".split())
# An article's own heading may be called a header; a state like "has-sidebar" says nothing.
ARTICLE_WORDS = frozenset("article post entry story content main page body text".split())
STATE_WORDS = frozenset("has with no is without js free".split())
CONTENT_BONUS = 25.0
SHARES = (1.0, 1 / 2, 1 / 6, 1 / 8, 1 / 10)
PARAGRAPHS = HEADINGS | frozenset("p li dt dd td th pre blockquote figcaption caption summary "
                                  "address".split())
# Elements that hold parts of a text but are never its container.
PARTS = INLINE | (PARAGRAPHS - {"td", "th"}) | frozenset("table thead tbody tfoot tr ul ol dl figure "
                                                         "details".split())

_WORDS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_COMMAS = re.compile("[,\N{ARABIC COMMA}\N{IDEOGRAPHIC COMMA}\N{FULLWIDTH COMMA}]")


def _named(words: frozenset, names: list[list[str]]) -> bool:
    return any(parts and not STATE_WORDS.intersection(parts)
               and (parts[0] in words or parts[-1] in words) for parts in names)


def _judge(tag: str, raw: str) -> tuple[str | None, float, str]:
    """What an element's name and attributes say: 'aside' (set aside unless it holds the
    article), 'away' (set aside in any case) or None; the bonus; and the class."""
    given = attributes(raw) if raw and not raw.isspace() else {}
    label = given.get("class", "")
    names = [_WORDS.findall(_CAMEL.sub("-", name).lower())
             for name in [*label.split(), *given.get("id", "").split()]]
    role = given.get("role", "").lower()
    bonus = CONTENT_BONUS if tag in ("article", "main") or role in ("main", "article") or any(
        ARTICLE_WORDS.intersection(parts) for parts in names) else 0.0
    if tag in ("html", "body"):
        return None, 0.0, label
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" \
            or _UNSEEN.search(given.get("style", "").lower()):
        return "away", 0.0, label
    if _named(COMMENT_WORDS, names):
        return "away", 0.0, label
    if tag in ("article", "main"):
        return ("away" if _named(ASIDE_WORDS - {"header", "page"}, names) else None), bonus, label
    if tag in ASIDE_TAGS or role in ASIDE_ROLES:
        return "aside", 0.0, label
    judged = [parts for parts in names if not (parts and parts[-1] == "header" and (
        tag in HEADINGS or parts[0] in ARTICLE_WORDS))]
    return ("aside" if _named(ASIDE_WORDS, judged) else None), bonus, label


def _set_aside(page: Page, verdicts: list) -> list[bool]:
    """Which elements are set aside: those judged so, unless they hold an article or main (a form
    or a header around the whole page) or are an article's own heading, and all below them."""
    n = len(page.tags)
    holds = [False] * n
    heading = [False] * n
    within = [False] * n
    for i in range(1, n):
        within[i] = within[page.parents[i]] or page.tags[i] in ("article", "main")
    for i in range(n - 1, 0, -1):
        if verdicts[i] != "away":
            up = page.parents[i]
            holds[up] |= holds[i] or page.tags[i] in ("article", "main")
            heading[up] |= heading[i] or page.tags[i] == "h1"
    out = [False] * n
    for i in range(1, n):
        kept = holds[i] or (page.tags[i] == "header" and within[i] and heading[i])
        out[i] = out[page.parents[i]] or verdicts[i] == "away" or (verdicts[i] == "aside" and not kept)
    return out


def _blocks(page: Page, out: list[bool]) -> Iterator[tuple[int, str, int]]:
    """(block element, text, characters in links) of each stretch of text that no block starts or
    ends in, in page order."""
    above = list(range(len(page.tags)))
    for i, tag in enumerate(page.tags):
        if tag in INLINE:
            above[i] = above[page.parents[i]]
    parts: list[str] = []
    linked = 0
    block = None
    for element, text, link in page.runs:
        if out[element]:
            continue
        if block is not None and above[element] != block:
            if joined := " ".join("".join(parts).split()):
                yield block, joined, min(linked, len(joined))
            parts, linked = [], 0
        block = above[element]
        parts.append(" " if text is None else text)
        if link and text is not None:
            linked += len(" ".join(text.split()))
    if parts and (joined := " ".join("".join(parts).split())):
        yield block, joined, min(linked, len(joined))


def main_text(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = Page(source)
    n, parents, tags = len(page.tags), page.parents, page.tags
    judged = [_judge(tag, raw) for tag, raw in zip(tags, page.attrs)]
    out = _set_aside(page, [verdict for verdict, _, _ in judged])
    blocks = list(_blocks(page, out))
    if not blocks:
        return ""

    length, linked, links, points = [0] * n, [0] * n, [0] * n, [0.0] * n
    up = [0] * n  # the nearest possible container above an element
    for i in range(1, n):
        up[i] = parents[i] if tags[parents[i]] not in PARTS else up[parents[i]]
        if tags[i] == "a" and not out[i]:
            links[i] = 1
    for block, text, in_links in blocks:
        length[block] += len(text)
        linked[block] += in_links
        worth = min(len(text) / 100, 3.0) + len(_COMMAS.findall(text))
        if tags[block] not in HEADINGS and len(text) >= 25:
            worth += 1
        worth *= 1 - in_links / len(text)
        holder = up[block] if tags[block] in PARAGRAPHS or tags[block] in PARTS else block
        for share in SHARES:
            points[holder] += worth * share
            if not holder:
                break
            holder = up[holder]
    for i in range(n - 1, 0, -1):
        length[parents[i]] += length[i]
        linked[parents[i]] += linked[i]
        links[parents[i]] += links[i]

    def density(i: int) -> float:
        return linked[i] / length[i] if length[i] else 0.0

    best, most = 0, 0.0
    for i in range(n):
        if length[i] and not out[i] and tags[i] not in PARTS:
            score = (points[i] + judged[i][1]) * (1 - density(i))
            if score > most:
                best, most = i, score
    if not most:
        return ""
    best = _whole(page, best)
    headed = _holds_title(page, best)
    enough = max(10.0, points[best] / 5)

    def sibling(i: int) -> bool:
        if not best or parents[i] != parents[best] or not length[i] or out[i]:
            return False
        if tags[i] in HEADINGS:
            return i < best and not headed
        if tags[i] in PARAGRAPHS:
            return density(i) < 0.25
        alike = tags[i] == tags[best] and judged[i][2] == judged[best][2] != ""
        return alike or points[i] * (1 - density(i)) >= enough

    def menu(i: int) -> bool:
        return (links[i] >= 3 and tags[i] not in INLINE and tags[i] not in ("p", "body", "html")
                and linked[i] > 0.8 * length[i] and linked[i] <= 40 * links[i])

    kept = [False] * n
    kept[best] = True
    for i in range(1, n):
        if i != best:
            kept[i] = (kept[parents[i]] or sibling(i)) and not menu(i)
    return " ".join(text for block, text, _ in blocks if kept[block])


def _whole(page: Page, best: int) -> int:
    """The outermost article around the best container, else the nearest main, else itself."""
    article = main = None
    i = best
    while i > 0:
        if page.tags[i] == "article":
            article = i
        elif page.tags[i] == "main" and main is None:
            main = i
        i = page.parents[i]
    return article or main or best


def _holds_title(page: Page, best: int) -> bool:
    inside = [False] * len(page.tags)
    inside[best] = True
    for i in range(best + 1, len(page.tags)):
        inside[i] = inside[page.parents[i]]
        if inside[i] and page.tags[i] == "h1":
            return True
    return False


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages``: page_id, url, html; other columns are ignored. Returns one row per row of
    ``pages``: page_id and url as they are (null or repeated ones too), text (empty for null or
    empty html and for pages without an article) and n_chars, its code points. Pages are read
    whole; no shuffle."""
    prepare(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column("html").to_pylist()
            for part in by_bytes(sources):
                texts = [main_text(source) for source in sources[part]]
                given = batch.slice(part.start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [given.column("page_id"), given.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, schema)
