"""A small HTML tree for text extraction: elements with their parents, and runs of text.

The reader follows the parts of the HTML parsing rules that decide which element a text belongs
to: void elements, raw text elements, implied ends of paragraphs, list items, table cells and
options, comments, and quoted attribute values that hold ``>``. It never recurses and looks at
each character a bounded number of times, so deeply nested or broken pages cost linear time.
"""

from __future__ import annotations

import html
import re
from collections import Counter

# Element names of the HTML standard, by the role they play in parsing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
# Elements whose start does not end an open paragraph.
KEEP_PARAGRAPH = frozenset("area base br button col embed img input link map meta object param "
                           "script select source style svg td th textarea template track wbr "
                           "iframe math noscript picture video audio canvas option".split())
# A start tag of the name ends open elements of these names right above it.
IMPLIED_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
               "optgroup": ("option", "optgroup"), "td": ("td", "th"), "th": ("td", "th"),
               "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "thead", "tbody"),
               "tfoot": ("td", "th", "tr", "thead", "tbody"), "thead": ("td", "th", "tr", "tbody")}

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_LONG_NUMBER = re.compile(r"&#[0-9]{8,};?")


def decode(text: str) -> str:
    """Character references decoded as browsers do; numbers beyond Unicode become U+FFFD."""
    if "&" not in text:
        return text
    return html.unescape(_LONG_NUMBER.sub("\N{REPLACEMENT CHARACTER}", text)
                         if "&#" in text else text)


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), a or b or c)
    return found


class Page:
    """The tree of one page. ``tags``, ``attrs`` and ``parents`` hold the elements in page order
    (element 0 is the root, a parent always comes before its children); ``runs`` holds
    (element, text, inside a link) in page order. A run of None is a line break."""

    def __init__(self, source: str):
        self.tags, self.attrs, self.parents = ["#root"], [""], [-1]
        self.runs: list[tuple[int, str | None, bool]] = []
        self._stack = [0]               # open elements
        self._blocks = [0]              # positions in the stack of the open blocks
        self._open: Counter = Counter()  # open blocks by name
        self._inline: list[Counter] = [Counter()]  # open inline elements, per open block
        self._link = None               # stack height at which a link was opened
        self._read(source)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            tag = source.find("<", at)
            if tag < 0:
                tag = end
            if tag > at:
                self._text(source[at:tag])
            if tag == end:
                return
            if source.startswith("<!--", tag):
                if source.startswith((">", "->"), tag + 4):
                    at = source.index(">", tag) + 1
                    continue
                close = re.compile(r"--!?>").search(source, tag + 4)
                if close is None:
                    return
                at = close.end()
                continue
            following = source[tag + 1:tag + 2]
            if following in ("!", "?") or (following == "/" and not source[tag + 2:tag + 3].isalpha()):
                close = source.find(">", tag)
                if close < 0:
                    return
                at = close + 1
                continue
            if not (following == "/" or (following.isascii() and following.isalpha())):
                self._text("<")
                at = tag + 1
                continue
            found = _TAG.match(source, tag)
            if found is None:
                return  # the page ends inside a tag
            at = found.end()
            name = found[2].lower()
            if found[1]:
                self._close(name)
                continue
            self._start(name, found[3])
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(source, at)
                if close is None:
                    return
                ending = source.find(">", close.end())
                self._close(name)
                if ending < 0:
                    return
                at = ending + 1

    def _text(self, raw: str) -> None:
        if not raw.isspace():
            self._end_block(("head",))
        self.runs.append((self._stack[-1], decode(raw), self._link is not None))

    def _pop_to(self, height: int) -> None:
        while len(self._stack) > height:
            element = self._stack.pop()
            if self._blocks[-1] == len(self._stack):
                self._blocks.pop()
                self._inline.pop()
                self._open[self.tags[element]] -= 1
        if self._link is not None and len(self._stack) <= self._link:
            self._link = None

    def _start(self, name: str, raw: str) -> None:
        if name in ("br", "hr"):
            self.runs.append((self._stack[-1], None, False))
        inline = name in INLINE
        if name not in IN_HEAD:
            self._end_block(("head",))
        if not inline and name not in KEEP_PARAGRAPH:
            self._end_block(("p",))
        while name in IMPLIED_END and self._end_block(IMPLIED_END[name]):
            pass
        if name == "a":
            self._close("a")
            if "href" in raw.lower():
                self._link = len(self._stack)
        self.tags.append(name)
        self.attrs.append(raw)
        self.parents.append(self._stack[-1])
        if name in VOID:
            return
        if inline:
            self._inline[-1][name] += 1
        else:
            self._blocks.append(len(self._stack))
            self._inline.append(Counter())
            self._open[name] += 1
        self._stack.append(len(self.tags) - 1)

    def _end_block(self, names: tuple) -> bool:
        """End the innermost open block if it has one of these names."""
        height = self._blocks[-1]
        if height and self.tags[self._stack[height]] in names:
            self._pop_to(height)
            return True
        return False

    def _close(self, name: str) -> None:
        if name in INLINE:
            if not self._inline[-1][name]:
                if name == "a":
                    self._link = None
                return
            height = len(self._stack) - 1
            while self.tags[self._stack[height]] != name:
                self._inline[-1][self.tags[self._stack[height]]] -= 1
                height -= 1
            self._inline[-1][name] -= 1
            self._pop_to(height)
        elif name == "br":
            self.runs.append((self._stack[-1], None, False))
        elif name not in ("html", "body") and self._open[name]:
            while self.tags[self._stack[self._blocks[-1]]] != name:
                self._pop_to(self._blocks[-1])
            self._pop_to(self._blocks[-1])
