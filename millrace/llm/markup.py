"""Documents with HTML, Markdown, wiki or LaTeX markup turned into clean text that keeps its structure.

HTML is parsed to a tree. Composite text density tells content from boilerplate: each node's characters per tag, adjusted by
its links, is its density; the node whose children's densities have the largest sum is the content, and the smallest density
on the path from the body to it is the threshold. Below every node that reaches the threshold the subtree of the largest sum is
selected too; the rest is dropped, but for text, headings, paragraphs, tables, code and lists that stand on the path itself. What
is kept, of HTML and of the other kinds alike, is written in one plain form: ``# `` before headings, ``- `` or ``1. `` before
list items, `` | `` between cells, code and formulas as they are.

All walks over the tree are loops over its nodes in the order they were opened, so neither depth nor breadth costs more than
their number.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Names of HTML elements.
BLOCKS = set("address article aside blockquote body center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
INLINE = set("a abbr b big br caption cite code col colgroup del em font head i img input ins kbd label link mark meta q ref s samp script small span strike strong style sub sup title tt u var".split())
VOID = set("br hr img input link meta col".split())
ELEMENT = re.compile(r"</?(?:" + "|".join(sorted(BLOCKS | INLINE, key=len, reverse=True)) + r")(?:\s+[^<>]*|\s*/)?>", re.I)
COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>", re.S | re.I)
ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")

FENCE = re.compile(r"^(```|~~~)[^\n]*\n(.*?)(?:^\1[^\S\n]*$|\Z)", re.M | re.S)
DISPLAY = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\begin\{(equation|align|gather|displaymath|eqnarray|multline)(\*?)\}(.+?)\\end\{\3\4\}", re.S)
FORMULA = re.compile(r"(?<![\\$A-Za-z0-9])\$(?=[^\s\d$，。])((?:\\.|[^$\n㐀-鿿，。]){1,200}?)(?<=[^\s\\])\$(?![\d$])|\\\((.+?)\\\)")
LATEX = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|paragraph|textbf|textit|emph|texttt|underline|footnote|cite[pt]?|ref|label|caption|begin|end|title|author|href|url|item)\b|\\[%&_#$](?=[^A-Za-z]|$)")
TEX_HEADING = re.compile(r"^[^\S\n]*\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", re.M)

WIKI_TABLE = re.compile(r"^\{\|[^\n]*\n(.*?)^\|\}", re.M | re.S)
WIKI_HEADING = re.compile(r"^(={2,6})[^\S\n]*([^=\n].*?)[^\S\n]*\1[^\S\n]*$", re.M)
WIKI_LINK = re.compile(r"\[\[([^\[\]\n]+)\]\]")
TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
QUOTES = re.compile(r"'''?'?'?(?=[^'\n])([^\n]+?)'''?'?'?(?!')")

HEADING = re.compile(r"^[^\S\n]{0,3}(#{1,6})[^\S\n]+(.+?)(?:[^\S\n]+#+)?[^\S\n]*$", re.M)
SETEXT = re.compile(r"^([^\n|]+)\n(={3,}|-{3,})[^\S\n]*$", re.M)
NO_TITLE = re.compile(r"\s*(?:$|(?:[-+*>|]|\d+[.)])\s)")
RULE = re.compile(r"^[^\S\n]{0,3}(?:(?:-[^\S\n]*){3,}|(?:\*[^\S\n]*){3,}|(?:_[^\S\n]*){3,})$", re.M)
BULLET = re.compile(r"^([^\S\n]*)[-*+][^\S\n]+(?!\d+[^\S\n]*-[^\S\n]*$)(\S.*)$", re.M)
ORDERED = re.compile(r"(?:^[^\S\n]*\d{1,3}[.)][^\S\n]+\S.*(?:\n|\Z)){2,}", re.M)
QUOTE = re.compile(r"^[^\S\n]{0,3}>[^\S\n]?(?=\S)(.*)$", re.M)
TABLE_LINE = re.compile(r"^[^\S\n]*\|?(?:[^\S\n]*:?-+:?[^\S\n]*\|)+(?:[^\S\n]*:?-+:?[^\S\n]*)?$", re.M)
TABLE_ROW = re.compile(r"^[^\S\n]*\|(.*)\|[^\S\n]*$", re.M)
IMAGE = re.compile(r"!\[([^\]\n]*)\]\([^()\s]+(?:\s+\"[^\"]*\")?\)")
LINK = re.compile(r"\[([^\[\]\n]+)\]\((?:[a-z]+://|/|#|\.|[\w-]+\.)[^()\s]*(?:\s+\"[^\"]*\")?\)")
NOTE = re.compile(r"\[\^[^\]\n]+\](:?)")
CODE = re.compile(r"(?<!`)`([^`\n]+)`(?!`)")
STRONG = re.compile(r"(\*\*|__)(?=\S)([^\n]+?)(?<=\S)\1")
STRUCK = re.compile(r"~~(?=\S)([^\n]+?)(?<=\S)~~")
EMPHASIS = re.compile(r"(?<![\w*])\*(?![\s*])([^*\n]+?)(?<![\s*])\*(?![\w*])|(?<![\w_])_(?![\s_])([^_\n]+?)(?<![\s_])_(?![\w_])")


STRUCTURE = ("p", "ul", "ol", "dl", "li", "blockquote", "pre", "table", "figure")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
UNSEEN = ("script", "style", "head")


class Node:
    __slots__ = ("name", "parent", "children", "linked", "items", "number", "chars", "link_chars", "tags", "link_tags", "density", "sum", "best", "chosen", "holds")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent, self.children = name, parent, []  # children are nodes and strings
        self.linked = name == "a" or parent is not None and parent.linked
        self.items = self.number = 0
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0
        self.best, self.chosen, self.holds = self, False, False


class Tree(HTMLParser):
    """A tolerant tree: unknown elements stay text, elements left open end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("body", None)
        self.nodes = [self.root]  # in the order they open: a node stands behind its ancestors
        self.open = Counter()

    def _add(self, tag: str) -> Node:
        node = Node(tag, self.at)
        if tag == "li":
            self.at.items += 1
            node.number = self.at.items
        self.at.children.append(node)
        self.nodes.append(node)
        return node

    def _close(self) -> None:
        self.open[self.at.name] -= 1
        self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "td", "th") and self.at.name == tag:
            self._close()
        node = self._add(tag)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self._add(tag)

    def handle_endtag(self, tag):
        if self.open[tag]:
            while self.at.name != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        self.at.children.append(data)


def measure(nodes: list[Node]) -> None:
    """Characters, tags, and those within links, of each node."""
    for node in reversed(nodes):
        if node.name in UNSEEN:
            node.chars = node.link_chars = node.tags = node.link_tags = 0
            continue
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.chars += own
        node.link_chars += own * node.linked
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
            node.parent.tags += node.tags + 1
            node.parent.link_tags += node.link_tags + (node.name == "a")


def weigh(nodes: list[Node]) -> None:
    """Composite text density of each node, the sum of its children's, and the node of the largest sum below it."""
    body = nodes[0]
    for node in reversed(nodes):
        if node.chars:
            other = max(node.chars - node.link_chars, 1)
            base = math.log(node.chars / other * node.link_chars + body.link_chars / max(body.chars, 1) * node.chars + math.e)
            adjusted = node.chars / max(node.link_chars, 1) * max(node.tags, 1) / max(node.link_tags, 1)
            # The base is at least e, or a few characters without links would outweigh any text.
            node.density = node.chars / max(node.tags, 1) * math.log(max(adjusted, 1.0)) / math.log(max(base, math.e))
        if node.best.sum <= node.sum:
            node.best = node
        if node.parent is not None:
            node.parent.sum += node.density
            if node.best.sum >= node.parent.best.sum and node.best is not node.parent.best:
                node.parent.best = node.best


def choose(nodes: list[Node]) -> float:
    """Marks the subtrees of content, and the nodes above them; returns the threshold."""
    node = nodes[0].best
    low = node.density
    while node.parent is not None:
        node = node.parent
        low = min(low, node.density)
    nodes[0].best.chosen = True
    for node in nodes:
        if node.density >= low and node.chars:
            node.best.chosen = True
    for node in reversed(nodes):
        if (node.chosen or node.holds) and node.parent is not None:
            node.parent.holds = True
    return low


def mostly_links(node: Node) -> bool:
    return node.link_chars * 2 > node.chars


def dropped(node: Node, inside: bool, threshold: float) -> bool:
    """Whether a node is left out: blocks outside the content, and within it blocks below the threshold that are mostly links."""
    if node.name in UNSEEN or node.name == "img":
        return True
    if node.density < threshold and (node.name in ("nav", "footer", "aside") or node.name in ("div", "section", "header", "form", "ul", "ol") and mostly_links(node)):
        return True
    if inside or node.chosen or node.holds or node.name not in BLOCKS or node.name in (*HEADINGS, "pre", "table", "hr"):
        return False
    return node.name not in STRUCTURE or mostly_links(node)


def written(node: Node, inner: str) -> str:
    """A node in plain form around what it holds."""
    if node.name in HEADINGS:
        return f"\n{'#' * int(node.name[1])} {inner.strip()}\n"
    if node.name == "li":
        number = f"{node.number}. " if node.parent is not None and node.parent.name == "ol" else "- "
        return f"\n{number}{inner.strip()}"
    if node.name in ("td", "th"):
        return inner.strip() + " | "
    if node.name == "tr":
        return "\n" + inner.strip().removesuffix("|").rstrip()
    if node.name == "pre":
        return "\n" + inner.strip("\n") + "\n"
    if node.name in BLOCKS and node.name != "body":
        only = node.children[0] if len(node.children) == 1 else None
        # A block that holds only a block is written like it: no copy for each of many nested blocks.
        return inner if isinstance(only, Node) and inner[:1] == inner[-1:] == "\n" and only.name not in ("pre", "li", "tr") else f"\n{inner.strip()}\n"
    return inner


def render(root: Node, threshold: float) -> str:
    """The chosen subtrees in plain form. Each open node has its next child and what it holds so far."""
    stack: list[list] = [[root, 0, [], root.chosen]]
    while True:
        frame = stack[-1]
        node, at, parts, inside = frame
        if at < len(node.children):
            frame[1] += 1
            child = node.children[at]
            if isinstance(child, str):
                parts.append(child)
            elif child.name == "br":
                parts.append("\n")
            elif not dropped(child, inside or child.chosen, threshold):
                stack.append([child, 0, [], inside or child.chosen or child.name in STRUCTURE])
            continue
        stack.pop()
        text = written(node, parts[0] if len(parts) == 1 else "".join(parts))
        if not stack:
            return text
        stack[-1][2].append(text)


def clean_html(text: str) -> str:
    tree = Tree()
    # What looks like an element but isn't one (comparisons, titles) stays text.
    tree.feed("".join(html.escape(part, quote=False).replace("&amp;", "&") if not ELEMENT.fullmatch(part) else part for part in re.split(f"({ELEMENT.pattern})", text, flags=re.I)))
    tree.close()
    measure(tree.nodes)
    weigh(tree.nodes)
    return render(tree.root, choose(tree.nodes))


def clean_markup(text: str) -> tuple[str, list[str]]:
    """(clean text, kinds of markup it held): html, markdown, wiki, latex."""
    kinds: set[str] = set()
    held: list[str] = []

    def hold(content: str) -> str:
        held.append(content)
        return f"\ue000{len(held) - 1}\ue001"

    def using(kind: str, value):
        def put(match: re.Match) -> str:
            kinds.add(kind)
            return value(match)

        return put

    text = text.replace("\ue000", "").replace("\ue001", "")
    text = FENCE.sub(using("markdown", lambda m: hold(m[2].strip("\n")) + "\n"), text)
    text = CODE.sub(using("markdown", lambda m: hold(m[1])), text)
    text = DISPLAY.sub(using("latex", lambda m: hold(f"$$ {(m[1] or m[2] or m[5]).strip()} $$")), text)
    text = FORMULA.sub(using("latex", lambda m: hold(f"${m[1] or m[2]}$")), text)
    if COMMENT.search(text):
        kinds.add("html")
        text = COMMENT.sub("", text)
    if ELEMENT.search(text):
        kinds.add("html")
        text = clean_html(text)
    if ENTITY.search(text):
        kinds.add("html")
        text = ENTITY.sub(lambda m: html.unescape(m[0]), text).replace("\xa0", " ")
    if LATEX.search(text):
        kinds.add("latex")
        levels = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
        text = TEX_HEADING.sub(lambda m: "#" * levels[m[1]] + " " + m[2], text)
        text = re.sub(r"~?\\(?:cite[pt]?|ref|label)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", text)
        text = re.sub(r"^[^\S\n]*\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?[^\S\n]*\n?", "", text, flags=re.M)
        text = re.sub(r"^[^\S\n]*\\item\b[^\S\n]*(?:\[([^\]]*)\])?", lambda m: "- " + (m[1] or ""), text, flags=re.M)
        for _ in range(3):  # groups within groups
            text = re.sub(r"\\footnote\{([^{}]*)\}", r"（\1）", text)
            text = re.sub(r"\\(?:textbf|textit|emph|texttt|underline|caption|title|author|url)\{([^{}]*)\}", r"\1", text)
            text = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", text)
        text = re.sub(r"\\([%&_#$])", r"\1", text)

    def wiki_table(match: re.Match) -> str:
        kinds.add("wiki")
        rows = [" | ".join(cell.strip() for cell in re.split(r"\|\||!!|\n[|!]", "\n" + row.strip())[1:]) for row in re.split(r"^\|-[^\n]*\n", match[1], flags=re.M)]
        return "\n".join(row for row in rows if row)

    text = WIKI_TABLE.sub(wiki_table, text)
    text = WIKI_HEADING.sub(using("wiki", lambda m: "#" * min(len(m[1]) - 1, 6) + " " + m[2]), text)
    text = WIKI_LINK.sub(using("wiki", lambda m: "" if re.match("(?i)(?:category|file|image|分类|文件|图像):", m[1]) else m[1].rsplit("|", 1)[-1]), text)
    text = TEMPLATE.sub(using("wiki", lambda m: m[1].rsplit("|", 1)[-1].rsplit("=", 1)[-1] if "|" in m[1] else ""), text)
    text = QUOTES.sub(using("wiki", lambda m: m[1]), text)

    markdown = [
        (IMAGE, lambda m: m[1]), (LINK, lambda m: m[1]), (NOTE, lambda m: ""), (STRONG, lambda m: m[2]), (STRUCK, lambda m: m[1]), (EMPHASIS, lambda m: m[1] or m[2]),
        (TABLE_LINE, lambda m: "\ue003"), (RULE, lambda m: ""), (QUOTE, lambda m: m[1]),
    ]

    def setext(match: re.Match) -> str:
        if NO_TITLE.match(match[1]):
            return match[0]
        kinds.add("markdown")
        return ("# " if match[2][0] == "=" else "## ") + match[1].strip()

    if "\n===" in text or "\n---" in text:
        text = SETEXT.sub(setext, text)
    for pattern, value in markdown:
        text = pattern.sub(using("markdown", value), text)
    if "\ue003" in text:
        text = TABLE_ROW.sub(lambda m: " | ".join(cell.strip() for cell in m[1].split("|")), text)
        text = re.sub(r"\n?\ue003", "", text)
    return _finish(text, kinds, held)


def _finish(text: str, kinds: set[str], held: list[str]) -> tuple[str, list[str]]:
    text = re.sub(r"[^\S\n]+\n", "\n", text)
    text = re.sub(r"\n{3,}", "\n\n", text).strip("\n")
    for _ in range(3):
        text = re.sub("\ue000(\\d+)\ue001", lambda m: held[int(m[1])], text)
    return text, sorted(kinds)


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [markup_of(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([k for _, k in done], pa.list_(pa.string()))], ["key", "clean", "markup"])


def markup_of(text: str | None) -> tuple[str | None, list[str]]:
    """Clean text and kinds of markup; the lines of lists and headings count as Markdown where the text itself has them."""
    if text is None:
        return None, []
    clean, kinds = clean_markup(text)
    if "markdown" not in kinds:
        bare = FENCE.sub("", text)
        if HEADING.search(bare) or BULLET.search(bare) or ORDERED.search(bare):
            kinds = sorted([*kinds, "markdown"])
    return clean, kinds


def clean_documents(records: DataFrame) -> DataFrame:
    """(key, clean, markup) of each record's text: the clean text, and the sorted kinds of markup it held.

    Null texts stay null with no markup, empty ones stay empty. Other columns are ignored. One pass, no shuffle.
    """
    kind = records.schema["key"].dataType.simpleString()
    return records.select("key", "text").mapInArrow(_converted, f"key {kind}, clean string, markup array<string>")
