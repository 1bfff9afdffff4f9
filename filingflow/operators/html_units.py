"""Translatable units of HTML pages: a table function that extracts them and a function that splices answers back.

A small tree with source offsets is made by the standard library's parser; a unit is known by the offsets of what its
answer replaces, so untouched markup stays byte for byte. An open p, li, td, th or tr is closed by the next one of its kind
(p by any block element too), inline elements by the end of their block; script and style hold raw text.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import LOW_VALUE, PROTECTED_TERMS
from ..session import fresh

#: Fixed value: elements that hold units, and elements whose text never is one.
BLOCKS = frozenset("p li td th caption h1 h2 h3 h4 h5 h6 div".split())
SKIPPED = frozenset("script style meta link head noscript code pre".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
STOPS = {"li": {"ul", "ol"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}, "p": {"div", "td", "th", "li", "table", "body"}}
CONTAINERS = BLOCKS | {"table", "tr", "ul", "ol", "body", "html", "section", "article", "blockquote", "form", "main", "nav", "header", "footer"}
FALLBACK_CLASS, FALLBACK_TITLE, FALLBACK_MARK = "fallback-translation", "fallback model translation", "data-filingflow"
FALLBACK_CSS = f".{FALLBACK_CLASS} {{ background: #fff3cd; }}"

_PLACEHOLDER = re.compile(r"<(PH_\d+)>(.*?)</\1>", re.DOTALL)
_MARKUP = re.compile(r"</?PH_\d+>")
_SHAPES = re.compile("(?:" + "|".join(LOW_VALUE) + r")\Z")


def low_value(text: str) -> bool:
    """The Python twin of ``functions.text.is_low_value``: numbering needs it while a page is read."""
    t = " ".join(text.split())
    return not t or t.lower() in PROTECTED_TERMS or _SHAPES.match(t) is not None or re.search("[A-Za-z]", t) is None


class Node:
    __slots__ = ("children", "end", "hidden", "inner", "inner_end", "name", "start", "text")

    def __init__(self, name: str | None, start: int, inner: int, hidden: bool = False, text: str = ""):
        self.name, self.start, self.inner, self.hidden, self.text = name, start, inner, hidden, text
        self.inner_end = self.end = inner
        self.children: list[Node] = []

    def strings(self) -> Iterator[str]:
        if self.name is None:
            yield self.text
        for c in self.children:
            yield from c.strings()

    def words(self) -> str:
        return " ".join(s.strip() for s in self.strings() if s.strip())

    def blocks(self) -> Iterator[Node]:
        for c in self.children:
            if c.name in BLOCKS:
                yield c
            if c.name:
                yield from c.blocks()


class _Tree(HTMLParser):
    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.page, self.lines = page, [0]
        for m in re.finditer("\n", page):
            self.lines.append(m.end())
        self.root = Node("", 0, 0)
        self.open = [self.root]
        self.feed(page)
        self.close()
        while len(self.open) > 1:
            self._pop(len(page), len(page))
        self.root.inner_end = self.root.end = len(page)

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _pop(self, inner_end: int, end: int) -> None:
        node = self.open.pop()
        node.inner_end, node.end = inner_end, end

    def _close(self, names: set[str], stops: set[str], at: int) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name in names:
                while len(self.open) > k:
                    self._pop(at, at)
                return
            if self.open[k].name in stops:
                return

    def handle_starttag(self, tag, attrs):
        at = self._at()
        if tag in CLOSES:
            self._close(CLOSES[tag], STOPS[tag], at)
        if tag in CONTAINERS:
            self._close({"p"}, STOPS["p"], at)
        style = next((v or "" for k, v in attrs if k == "style"), "").replace(" ", "").lower()
        hidden = tag in SKIPPED or "display:none" in style or tag.startswith(("ix:header", "ix:hidden"))
        node = Node(tag, at, at + len(self.get_starttag_text() or ""), hidden or self.open[-1].hidden)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        depth = len(self.open)
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            node = self.open[-1]
            if len(self.open) > depth or node.inner == node.start + len(self.get_starttag_text() or ""):
                self._pop(node.inner, node.inner)

    def handle_endtag(self, tag):
        at = self._at()
        end = self.page.find(">", at)
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                while len(self.open) > k + 1:
                    self._pop(at, at)
                self._pop(at, end + 1 if end >= 0 else len(self.page))
                return
            if self.open[k].name in CONTAINERS and tag not in CONTAINERS:
                return

    def handle_data(self, data):
        at = self._at()
        self.open[-1].children.append(Node(None, at, at, text=data))


def _target(tag: Node) -> Node | None:
    """The innermost element of a chain of only children that holds nothing but text."""
    now = tag
    while True:
        inside = [c for c in now.children if c.name is not None or c.text.strip()]
        if now is not tag and inside and all(c.name is None for c in inside):
            return now
        if len(inside) != 1 or inside[0].name is None or inside[0].name in BLOCKS or inside[0].name in SKIPPED:
            return None
        now = inside[0]


def units_of(page: str) -> Iterator[tuple[int, int, int, str, str, list[tuple[str, str]]]]:
    """(ordinal, start, end, text, source text, placeholders): the replaced range and each placeholder's start tag."""
    ordinal = 0
    for tag in _Tree(page).root.blocks():
        if tag.hidden or next(tag.blocks(), None) is not None:
            continue
        source = " ".join(tag.words().split())
        if low_value(source):
            continue
        target, held = _target(tag), []
        if target is not None:
            text = target.words()
        else:
            target, parts = tag, []
            for c in tag.children:
                if c.name is None:
                    parts.append(c.text)
                elif c.name not in BLOCKS:
                    name = f"PH_{len(held)}"
                    held.append((name, page[c.start : c.inner]))
                    parts.append(f"<{name}>{c.words()}</{name}>")
            text = "".join(parts)
        if low_value(_MARKUP.sub("", text)):
            continue
        ordinal += 1
        yield ordinal, target.inner, target.inner_end, " ".join(text.split()), source, held


def splice(page: str, answers: list[tuple[int, str, bool]]) -> str:
    """The page with (ordinal, text, fallback) put in place, from the back to the front; other markup stays as it is."""
    found = {u[0]: u for u in units_of(page)}
    for ordinal, text, fallback in sorted(answers, reverse=True):
        if ordinal not in found:
            continue
        _, start, end, _, _, held = found[ordinal]
        tags = dict(held)
        out, at = [], 0
        for m in _PLACEHOLDER.finditer(text) if tags else ():
            out.append(_html.escape(text[at : m.start()], quote=False))
            tag = tags.get(m[1], "")
            name = re.match(r"<\s*([^\s/>]+)", tag)
            close = f"</{name[1]}>" if name and name[1].lower() not in VOID and not tag.endswith("/>") else ""
            out.append(tag + _html.escape(m[2], quote=False) + close)
            at = m.end()
        out.append(_html.escape(text[at:], quote=False))
        body = "".join(out)
        page = page[:start] + (f'<span class="{FALLBACK_CLASS}" title="{FALLBACK_TITLE}">{body}</span>' if fallback else body) + page[end:]
    if any(a[2] for a in answers) and f'{FALLBACK_MARK}="fallback"' not in page:
        style = f'<style {FALLBACK_MARK}="fallback">{FALLBACK_CSS}</style>'
        head = re.search(r"(?i)</head\s*>", page)
        root = re.search(r"(?i)<html[^>]*>", page)
        at = head.start() if head else root.end() if root else 0
        page = page[:at] + (style if head else f"<head>{style}</head>") + page[at:]
    return page


UNIT = T.StructType([
    T.StructField("ordinal", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("source_text", T.StringType()),
    T.StructField("placeholders", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("html", T.StringType())]))),
])


#: Pages whose units are Python objects at a time: a batch of Arrow can hold thousands.
SLICE = 50


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each unit of the pages (key, page), written slice by slice."""
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.struct([("name", pa.string()), ("html", pa.string())])))
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            found = [(n, *u[:5], [{"name": name, "html": h} for name, h in u[5]]) for n, p in enumerate(part.column(1).to_pylist()) for u in units_of(p)]
            columns = [pa.array([u[i + 1] for u in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([u[0] for u in found], pa.int32())), *columns], names=["doc_id", *UNIT.names])
        del batch
        pa.default_memory_pool().release_unused()  # else a worker keeps what its largest batch took


def extract_units(pages: DataFrame, key: str = "doc_id", column: str = "html") -> DataFrame:
    """doc_id, ordinal, unit_id, start, stop, text, source_text, placeholders of every unit; null pages have none.

    A narrow stage: only the key and the page are read, and pages without any letter tag are left out before Python runs.
    """
    rows = pages.select(F.col(key).alias("doc_id"), F.col(column).alias("_page")).where(F.col("_page").contains("<"))
    units = rows.mapInArrow(_units, T.StructType([rows.schema["doc_id"], *UNIT]))
    return units.withColumn("unit_id", F.concat(F.lit("u_"), F.lpad(F.col("ordinal").cast("string"), F.greatest(F.lit(4), F.length(F.col("ordinal").cast("string"))), F.lit("0"))))


@F.arrow_udf(T.StringType())
def _splice(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for pages, answers in batches:
        for k in range(0, len(pages), SLICE):
            both = zip(pages.slice(k, SLICE).to_pylist(), answers.slice(k, SLICE).to_pylist(), strict=True)
            yield pa.array([p if p is None or a is None else splice(p, [(x["ordinal"], x["text"], bool(x["is_fallback"])) for x in a]) for p, a in both], pa.string())
        del pages, answers
        pa.default_memory_pool().release_unused()


def apply_units(pages: DataFrame, answers: DataFrame, key: str = "doc_id", column: str = "html") -> DataFrame:
    """``pages`` with the answers (doc_id, ordinal, text, is_fallback) spliced in; pages without answers stay as they are."""
    own, held = fresh(pages, "key"), fresh(pages, "answers")
    given = answers.groupBy("doc_id").agg(F.collect_list(F.struct("ordinal", "text", "is_fallback")).alias(held)).withColumnRenamed("doc_id", own)
    joined = pages.join(given, F.col(key) == F.col(own), "left")
    done = F.when(F.col(held).isNull(), F.col(column)).otherwise(_splice(F.col(column), F.col(held)))
    return joined.withColumn(column, done).drop(own, held)
