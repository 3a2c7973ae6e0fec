"""The block tree of a Markdown document: read line by line with a stack of open containers, headings
changed in the tree, and written again in one form.

Blocks are those of CommonMark with pipe tables. Text within blocks stays as it is written; only
white space at the ends of its lines goes. Written form: a blank line between blocks (none within
tight lists), headings with marks in front, lists numbered on from their first number, the contents
of quotes and items behind their marks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HEADING = re.compile(r"(#{1,6})(?:[ \t]+|$)(.*)")
UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
BULLET = re.compile(r"[-+*](?=[ \t]|$)")
NUMBER = re.compile(r"(\d{1,9})([.)])(?=[ \t]|$)")
DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
CELL_BORDER = re.compile(r"(?<!\\)\|")
SUBSECTION = re.compile(r"\d+\.\d+")
#: Beginnings and ends of HTML blocks (fixed values of CommonMark); None: up to a blank line.
HTML: list[tuple[re.Pattern, re.Pattern | None]] = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile("-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (
        re.compile(
            r"</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|"
            r"figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|"
            r"param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:\s|/?>|$)",
            re.I,
        ),
        None,
    ),
]
#: Any other whole tag alone on its line; it can't break a paragraph.
LONE_TAG = re.compile(r"(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)[ \t]*$")


def _title(text: str) -> str:
    """A heading's text without closing marks."""
    text = text.strip(" \t")
    bare = text.rstrip("#")
    return bare.rstrip(" \t") if not bare or bare[-1] in " \t" else text


@dataclass
class Node:
    """A block. ``kind``: document, quote, list, item; heading, paragraph, code, indented, html, rule, table."""

    kind: str
    mark: str = ""  # a list's bullet or delimiter, a fence, a rule as written
    level: int = 0  # of a heading; an item's columns up to its content; a fence's indent
    start: int = 0  # a list's first number; the columns before an item's mark
    loose: bool = False
    end: re.Pattern | None = None
    lines: list[str] = field(default_factory=list)
    parts: list[Node] = field(default_factory=list)


def _indent(rest: str, col: int) -> tuple[int, str]:
    """Columns of white space that ``rest`` begins with (tabs reach the next multiple of four), and what follows."""
    body = rest.lstrip(" \t")
    head = rest[: len(rest) - len(body)]
    if "\t" not in head:
        return len(head), body
    at = col
    for c in head:
        at += 4 - at % 4 if c == "\t" else 1
    return at - col, body


class Tree:
    """Reads lines into ``root``."""

    def __init__(self):
        self.root = Node("document")
        self.open = [self.root]  # containers, the outermost first
        self.leaf: Node | None = None  # the block of the last one that still takes lines
        self.blank = False  # whether the line before was blank (but not within code)

    def _add(self, node: Node, depth: int) -> Node:
        """Puts a new block into the container at ``depth``; deeper ones and the leaf are closed."""
        del self.open[depth + 1 :]
        self.leaf = None
        into = self.open[-1]
        if self.blank and into.parts:
            if into.kind == "list":
                into.loose = True
            elif into.kind == "item":
                self.open[-2].loose = True
        into.parts.append(node)
        return node

    def _text(self, kind: str, line: str, depth: int, **more) -> None:
        self.leaf = self._add(Node(kind, lines=[line], **more), depth)

    def line(self, text: str) -> None:
        rest, col, depth = text, 0, 0
        while depth + 1 < len(self.open):  # how many containers go on
            box = self.open[depth + 1]
            width, body = _indent(rest, col)
            if box.kind == "quote":
                if width > 3 or not body.startswith(">"):
                    break
                rest, col = self._after(body[1:], col + width + 1, 1)
            elif box.kind == "item":
                if width < box.level if body else not box.parts:  # an item that begins with a blank line has just one
                    break
                if body:
                    rest, col = self._after(rest, col, box.level)
            depth += 1
        whole = depth + 1 == len(self.open)
        if self.open[depth].kind == "list":
            depth -= 1  # a list by itself holds nothing but items
        if whole and self.leaf is not None and self._goes_on(rest, col):
            return
        self._begin(rest, col, depth, whole)

    @staticmethod
    def _after(rest: str, col: int, most: int) -> tuple[str, int]:
        """``rest`` without up to ``most`` columns of white space; what a tab has beyond them stays as spaces."""
        width, body = _indent(rest, col)
        gone = min(width, most)
        return " " * (width - gone) + body, col + gone

    def _goes_on(self, rest: str, col: int) -> bool:
        """Whether an open code or HTML block takes the line."""
        leaf = self.leaf
        width, body = _indent(rest, col)
        if leaf.kind == "code":
            closing = body.rstrip(" \t")
            if width <= 3 and len(closing) >= len(leaf.mark) and closing == leaf.mark[0] * len(closing):
                self.leaf = None
            else:
                leaf.lines.append(self._after(rest, col, leaf.level)[0])
            self.blank = False
            return True
        if leaf.kind == "html" and (leaf.end or body):
            leaf.lines.append(rest)
            self.blank = False
            if leaf.end and leaf.end.search(rest):
                self.leaf = None
            return True
        if leaf.kind == "indented" and (width >= 4 or not body):
            leaf.lines.append(self._after(rest, col, 4)[0])
            self.blank = not body
            return True
        return False

    def _begin(self, rest: str, col: int, depth: int, whole: bool) -> None:
        """Opens the blocks that the line begins, or adds it to a paragraph."""
        opened = False
        while True:
            width, body = _indent(rest, col)
            paragraph = self.leaf if self.leaf is not None and self.leaf.kind == "paragraph" else None
            goes_on = paragraph if whole else None  # a paragraph of this very container
            if not body:
                if self.leaf is not None and self.leaf.kind != "indented":
                    self.leaf = None
                if not whole:
                    del self.open[depth + 1 :]
                    self.leaf = None
                self.blank = not opened
                return
            if width >= 4:
                if paragraph is not None:
                    break
                self._text("indented", self._after(rest, col, 4)[0], depth)
                self.blank = False
                return
            if body[0] == ">":
                self.open.append(self._add(Node("quote"), depth))
                rest, col = self._after(body[1:], col + width + 1, 1)
            elif (found := HEADING.match(body)) is not None:
                self._add(Node("heading", level=len(found[1]), lines=[_title(found[2])]), depth)
                self.blank = False
                return
            elif (found := FENCE.match(body)) is not None:
                self.leaf = self._add(Node("code", mark=found[1] or found[3], level=width, lines=[(found[2] if found[1] else found[4]).strip()]), depth)
                self.blank = False
                return
            elif body[0] == "<" and (kind := self._html(body, paragraph)) is not None:
                self._text("html", rest, depth, end=kind[0])
                if kind[0] and kind[0].search(body):
                    self.leaf = None
                self.blank = False
                return
            elif goes_on is not None and (found := UNDERLINE.match(body)) is not None:
                goes_on.kind, goes_on.level = "heading", 1 if body[0] == "=" else 2
                self.leaf = None
                return
            elif RULE.match(body):
                self._add(Node("rule", mark=body.rstrip(" \t")), depth)
                self.blank = False
                return
            elif (found := self._item(body, goes_on)) is not None:
                mark, number, size = found
                box = self.open[depth + 1] if len(self.open) > depth + 1 else None
                if box is None or box.kind != "list" or box.mark != mark:
                    self.open.append(self._add(Node("list", mark=mark, start=number), depth))
                depth += 1
                after, tail = _indent(body[size:], col + width + size)
                content = 1 if not tail or after > 4 else after
                self.open.append(self._add(Node("item", mark=mark if mark in "-+*" else f"#{mark}", level=width + size + content, start=width), depth))
                rest, col = self._after(body[size:], col + width + size, content)
            elif goes_on is not None and self._table(goes_on, body):
                return
            elif self.leaf is not None and self.leaf.kind == "table" and whole:
                self.leaf.lines.append(body)
                return
            else:
                break
            depth, whole, opened, self.blank = len(self.open) - 1, True, True, False
        if paragraph is not None:  # a later line, be it of this container or a lazy one
            paragraph.lines.append(body)
        else:
            self._text("paragraph", body, depth)
        self.blank = False

    @staticmethod
    def _html(body: str, paragraph: Node | None) -> tuple[re.Pattern | None] | None:
        for begin, end in HTML:
            if begin.match(body):
                return (end,)
        return (None,) if paragraph is None and LONE_TAG.match(body) else None

    @staticmethod
    def _item(body: str, paragraph: Node | None) -> tuple[str, int, int] | None:
        """(mark, number, size of the mark) of an item; not every one can break a paragraph."""
        if found := BULLET.match(body):
            return (found[0], 0, 1) if paragraph is None or body[1:].strip(" \t") else None
        if found := NUMBER.match(body):
            if paragraph is None or int(found[1]) == 1 and body[found.end() :].strip(" \t"):
                return found[2], int(found[1]), found.end()
        return None

    def _table(self, paragraph: Node, body: str) -> bool:
        """Makes the paragraph's last line the head of a table if ``body`` has as many delimiters."""
        head = paragraph.lines[-1]
        if "|" not in head or not DELIMITERS.match(body) or len(cells(head)) != len(cells(body)):
            return False
        box = self.open[-1]
        if len(paragraph.lines) > 1:
            paragraph.lines.pop()
        else:
            box.parts.pop()
        self.leaf = Node("table", lines=[head, body])
        box.parts.append(self.leaf)
        return True


def cells(row: str) -> list[str]:
    row = row.strip(" \t")
    row = row.removeprefix("|")
    if row.endswith("|") and not row.endswith("\\|"):
        row = row[:-1]
    return [c.strip(" \t") for c in CELL_BORDER.split(row)]


def parse(text: str) -> Node:
    tree = Tree()
    lines = re.split(r"\r\n|\n|\r", text)
    for line in lines if lines[-1] else lines[:-1]:
        tree.line(line)
    return tree.root


def nodes(root: Node):
    """All blocks, in the order of the document."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += reversed(node.parts)


def _paragraph(lines: list[str]) -> list[str]:
    """Lines without white space at their ends; two spaces stay where they break a line."""
    out = [x.strip(" \t") + ("  " if x.endswith("  ") and x.strip(" \t") else "") for x in lines]
    return [*out[:-1], out[-1].rstrip(" ")]


def _table_lines(lines: list[str]) -> list[str]:
    head = cells(lines[0])
    rule = [f"{':' * c.startswith(':')}---{':' * (c.endswith(':') and len(c) > 1)}" for c in cells(lines[1])]
    rows = [(cells(x) + [""] * len(head))[: len(head)] for x in lines[2:]]
    return ["|" + "|".join(r) + "|" for r in (head, rule, *rows)]


def _leaf_lines(node: Node) -> list[str]:
    if node.kind == "heading":
        lines = _paragraph(node.lines)
        if len(lines) > 1 and node.level <= 2:
            return [*lines, "=-"[node.level - 1] * 3]
        return [f"{'#' * node.level} {lines[0]}", *lines[1:]]
    if node.kind == "paragraph":
        return _paragraph(node.lines)
    if node.kind == "code":
        return [node.mark + node.lines[0], *node.lines[1:], node.mark]
    if node.kind == "indented":
        lines = list(node.lines)
        while not lines[-1].strip(" \t"):
            lines.pop()
        return [f"    {x}" for x in lines]
    if node.kind == "table":
        return _table_lines(node.lines)
    return [node.mark] if node.kind == "rule" else node.lines


def render(root: Node) -> str:
    """The document in its written form."""
    out: list[str] = []
    prefix: list[str] = []  # what stands before a later line, by container
    first: list[str] = []  # marks that the next line begins with
    tight: list[bool] = [False]
    gap = 0  # lines between the last block and the next: 0 at the beginning
    numbers: list[int] = []

    def flush(lines: list[str]) -> None:
        nonlocal gap
        before = "".join(prefix[: len(prefix) - len(first)])
        if gap == 2:
            out.append(before if before.strip() else "")
        out.append(before + "".join(first) + lines[0])
        whole = "".join(prefix)
        out.extend(whole + x if x or whole.strip() else "" for x in lines[1:])
        first.clear()
        gap = 1 if tight[-1] else 2

    todo: list[tuple[Node, bool]] = [(root, True)]
    while todo:
        node, entering = todo.pop()
        if not entering:
            if node.kind in ("quote", "item"):
                if first:  # nothing inside
                    flush([""])
                prefix.pop()
            if node.kind == "item":
                numbers[-1] += 1
            if node.kind == "list":
                tight.pop()
                numbers.pop()
            gap = gap and (1 if tight[-1] else 2)
            continue
        if node.kind in ("document", "quote", "list", "item"):
            if node.kind == "quote":
                prefix.append("> ")
                first.append("> ")
            elif node.kind == "list":
                tight.append(not node.loose)
                numbers.append(node.start)
            elif node.kind == "item":
                mark = " " * node.start + node.mark.replace("#", str(numbers[-1]))
                mark += " " * max(node.level - len(mark), 1)
                prefix.append(" " * len(mark))
                first.append(mark)
            todo.append((node, False))
            todo += [(p, True) for p in reversed(node.parts)]
        else:
            flush(_leaf_lines(node))
    return "\n".join(out)


#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
LOW = "".join(map(chr, range(33)))
ESCAPED = re.compile(r"\\([*#|\->.`])")


def unescaped(text: str) -> str:
    """Backslashes before marks go outside of code fences; empty lines at the beginning go."""
    inside, out = False, []
    for line in text.split("\n"):
        fence = line.strip(LOW).startswith("```")
        out.append(line if inside or fence else ESCAPED.sub(r"\1", line))
        inside ^= fence
    return "\n".join(out).lstrip("\n")


def strict(text: str) -> str:
    """The document with numbered second-level headings ("2.1 ...") on the third level, in its written form."""
    root = parse(text)
    for node in nodes(root):
        if node.kind == "heading" and node.level == 2 and SUBSECTION.match(node.lines[0].lstrip(" \t")):
            node.level = 3
    return render(root)


#: Texts of a batch that are Python objects at once.
SLICE = 256


def in_slices(texts: pa.Array, rule: Callable[[str | None], object], kind: pa.DataType) -> pa.Array:
    """``rule`` of each text, as Arrow's ``kind``; a batch is never whole as Python objects."""
    parts = [pa.array(map(rule, texts.slice(at, SLICE).to_pylist()), kind) for at in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def strict_document(text: Column) -> Column:
    """``strict`` of each row, without white space at its ends and unescaped twice."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return in_slices(texts, lambda t: None if t is None else unescaped(unescaped(strict(t).strip(WHITE))), pa.string())

    return run(text)
