"""Values of HTML pages by selector: text, attribute and count, read in one pass over each page."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the markup language: elements without content, what ends an open paragraph, what ends what up to where.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
PARAGRAPH_SCOPE = frozenset("button caption html marquee object table td template th".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
UNSEEN = frozenset({"script", "style", "template", "noscript"})

_NAME = r"[A-Za-z_\-\u0080-\U0010ffff][\w\-\u0080-\U0010ffff]*"
_PART = re.compile(
    rf"""(?P<tag>\*|{_NAME})|\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<raw>[\w\-]+))\s*)?\]"""
)
_BETWEEN = re.compile(r"\s*(?P<child>>)\s*|\s*(?P<next>,)\s*|(?P<below>\s+)")


@dataclass
class Compound:
    """One element of a selector: tag, id, classes and attribute tests."""

    tag: str | None = None
    tests: list[tuple[str, str, str]] = field(default_factory=list)

    def holds(self, tag: str, attributes: Mapping[str, str]) -> bool:
        if self.tag not in (None, "*", tag):
            return False
        for name, test, value in self.tests:
            own = attributes.get(name)
            if own is None:
                return False
            words = own.split()
            good = {
                "": True, "=": own == value, "~=": value in words and bool(value), "^=": bool(value) and own.startswith(value), "$=": bool(value) and own.endswith(value),
                "*=": bool(value) and value in own, "|=": own == value or own.startswith(value + "-"),
            }[test]
            if not good:
                return False
        return True


def parse_selector(text: str) -> list[list[tuple[str, Compound]]]:
    """Alternatives of a selector, each as (relation to the element before it, compound) from left to right.

    Tags, ``*``, ``#id``, ``.class``, attribute tests, descendants, children and commas are known; anything else raises ValueError.
    """
    alternatives: list[list[tuple[str, Compound]]] = [[]]
    at, relation, text = 0, "", text.strip()
    while at < len(text):
        compound, start = Compound(), at
        while part := _PART.match(text, at):
            if part["tag"]:
                if at != start:
                    break
                compound.tag = part["tag"].lower()
            elif part["id"]:
                compound.tests.append(("id", "=", part["id"]))
            elif part["cls"]:
                compound.tests.append(("class", "~=", part["cls"]))
            else:
                value = next((v for v in (part["dq"], part["sq"], part["raw"]) if v is not None), "")
                compound.tests.append((part["attr"].lower(), part["op"] or "", value))
            at = part.end()
        between = _BETWEEN.match(text, at)
        if at == start or (at < len(text) and not between):
            raise ValueError(f"selector {text!r} at {at}")
        alternatives[-1].append((relation, compound))
        if between:
            at = between.end()
            relation = ">" if between["child"] else " "
            if between["next"]:
                alternatives.append([])
                relation = ""
            if at == len(text):
                raise ValueError(f"selector {text!r} ends early")
    if not alternatives[-1]:
        raise ValueError("empty selector")
    return alternatives


def marked(chain: list[tuple[str, Compound]], tag: str, attributes: Mapping[str, str], parent: tuple[int, int]) -> tuple[int, int]:
    """(which beginnings of ``chain`` end in this element, which end in it or above it), as bits; ``parent`` has them for the element it is in."""
    own = 0
    for n, (relation, compound) in enumerate(chain):
        above = 1 if n == 0 else parent[relation != ">"] >> (n - 1) & 1
        if above and compound.holds(tag, attributes):
            own |= 1 << n
    return own, parent[1] | own


class Reader(HTMLParser):
    """Reads one page and keeps count, first attribute or first text of each wanted selector."""

    def __init__(self, wanted: list[tuple[str, list, str | None]]) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted = wanted
        self.counts = [0] * len(wanted)
        self.values: list[str | None] = [None] * len(wanted)
        self.chains = [(n, chain) for n, (_, alternatives, _) in enumerate(wanted) for chain in alternatives]
        self.stack: list[tuple[str, list[tuple[int, int]], list[int]]] = []
        self.open = Counter()
        self.texts: dict[int, list[str]] = {}

    def _pop(self) -> None:
        tag, _, captured = self.stack.pop()
        self.open[tag] -= 1
        for n in captured:
            self.values[n] = " ".join("".join(self.texts.pop(n)).split())

    def _close(self, tags: set[str] | frozenset[str], scope: set[str] | frozenset[str]) -> None:
        """End the outermost open element of ``tags`` above the nearest one of ``scope``."""
        found = None
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] in scope:
                break
            if self.stack[depth][0] in tags:
                found = depth
        while found is not None and len(self.stack) > found:
            self._pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_PARAGRAPH and self.open["p"]:
            self._close({"p"}, PARAGRAPH_SCOPE)
        if tag in ENDS and any(self.open[t] for t in ENDS[tag][0]):
            self._close(*ENDS[tag])
        attributes = {name: value or "" for name, value in reversed(attrs)}  # of two, the first counts
        captured: list[int] = []
        above = self.stack[-1][1] if self.stack else [(0, 0)] * len(self.chains)
        marks = [marked(chain, tag, attributes, m) for (_, chain), m in zip(self.chains, above)]
        self.stack.append((tag, marks, captured))
        self.open[tag] += 1
        for n in {n for (n, chain), (own, _) in zip(self.chains, marks) if own >> (len(chain) - 1)}:
            kind, _, attribute = self.wanted[n]
            self.counts[n] += 1
            if self.counts[n] == 1:
                if kind == "attribute":
                    self.values[n] = attributes.get(attribute)
                elif kind == "text":
                    captured.append(n)
                    self.texts[n] = []
        if tag in VOID:
            self._pop()

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()
        elif tag == "p":  # an end without a beginning is an empty paragraph
            self.handle_starttag("p", [])
            self._pop()

    def handle_data(self, data: str) -> None:
        if self.texts and not any(self.open[t] for t in UNSEEN):
            for parts in self.texts.values():
                parts.append(data)

    def read(self, html: str) -> list[int | str | None]:
        self.feed(html)
        self.close()
        while self.stack:
            self._pop()
        return [n if kind == "count" else value for (kind, _, _), n, value in zip(self.wanted, self.counts, self.values)]


def selector_values(pages: DataFrame, wanted: Mapping[str, tuple[str, ...]], html: str = "html") -> DataFrame:
    """``pages`` without its ``html`` column, with a column for each of ``wanted``: name -> (``count``, selector), (``text``, selector) or (``attribute``, selector, name).

    A count is that of all selected elements. Text and attribute are those of the first selected element in the order of the page, null if there is none
    or it lacks the attribute; white space in texts is one space, scripts and styles are left out, and all character references are decoded. Tags may be in any case, attributes unquoted or in either
    quotes, end tags missing; elements that are only implied, such as table bodies, are not there. A null page counts 0 and has no values.
    """
    plan = [(kind, parse_selector(selector), rest[0].lower() if rest else None) for kind, selector, *rest in wanted.values()]
    for name, (kind, _, attribute) in zip(wanted, plan):
        if kind not in ("count", "text", "attribute") or (kind == "attribute") != (attribute is not None):
            raise ValueError(f"{name}: {kind}")
    kept = [c for c in pages.columns if c != html and c not in wanted]
    types = [pa.int32() if kind == "count" else pa.string() for kind, _, _ in plan]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [Reader(plan).read(page or "") for page in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [pa.array(values, kind) for values, kind in zip(zip(*read), types)] if read else [pa.array([], kind) for kind in types]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*kept, *wanted])

    rows = pages.select(*kept, F.col(html).alias(html))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != html]
    schema += [f"`{name}` {'int' if kind == 'count' else 'string'}" for name, (kind, _, _) in zip(wanted, plan)]
    return rows.mapInArrow(work, ", ".join(schema))
