"""HTML to text blocks and table grids, with the standard library's parser."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

BLOCK_TAGS = frozenset("address article blockquote dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section ul tr table".split())
HIDDEN = frozenset(("script", "style", "head", "title", "noscript", "template"))
# The largest spans that HTML knows, down and across; larger ones count as these.
MOST_DOWN, MOST_ACROSS = 65_534, 1_000


@dataclass
class Cell:
    text: str
    header: bool = False
    inherited: bool = False


@dataclass
class Block:
    """A run of text lines, or a grid of cells in which spans are spread out."""

    kind: str
    lines: list[str] = field(default_factory=list)
    rows: list[list[Cell]] = field(default_factory=list)


@dataclass
class _Table:
    rows: list[list[tuple[str, int, int, bool]]] = field(default_factory=list)
    row: list[tuple[str, int, int, bool]] | None = None
    cell: list[str] | None = None
    span: tuple[int, int, bool] = (1, 1, False)
    nested: bool = False
    #: Blocks found inside the cells of a table that only lays out others.
    inner: list[Block] = field(default_factory=list)


def squeeze(text: str) -> str:
    return re.sub(r"[^\S\n]+", " ", text.replace("\xa0", " ")).strip()


def text_lines(text: str) -> list[str]:
    """Trimmed lines without blanks; a line equal to the one before it is dropped."""
    out: list[str] = []
    for line in map(squeeze, text.split("\n")):
        if line and (not out or out[-1] != line):
            out.append(line)
    return out


def spread(rows: list[list[tuple[str, int, int, bool]]]) -> list[list[Cell]]:
    """Spans repeated over the places they cover; the repeated cells are marked inherited; all rows one width."""
    grid: list[list[Cell]] = []
    hanging: dict[int, tuple[int, Cell]] = {}  # column -> rows still covered, cell
    for row in rows:
        line: list[Cell] = []
        todo = list(row)
        col = 0
        while todo or any(c >= col for c in hanging):
            if col in hanging:
                left, cell = hanging.pop(col)
                line.append(Cell(cell.text, cell.header, True))
                if left > 1:
                    hanging[col] = (left - 1, cell)
                col += 1
                continue
            if not todo:
                line.append(Cell(""))
                col += 1
                continue
            text, down, across, header = todo.pop(0)
            for k in range(across):
                cell = Cell(text, header, k > 0)
                line.append(cell)
                if down > 1:
                    hanging[col] = (down - 1, cell)
                col += 1
        grid.append(line)
    width = max(map(len, grid), default=0)
    return [r + [Cell("") for _ in range(width - len(r))] for r in grid]


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.tables: list[_Table] = []
        self.hidden = 0

    def _flush(self) -> None:
        lines = text_lines("".join(self.text))
        self.text = []
        if lines:
            (self.tables[-1].inner if self.tables else self.blocks).append(Block("text", lines))

    def _out(self, text: str) -> None:
        if self.hidden:
            return
        if self.tables and self.tables[-1].cell is not None:
            self.tables[-1].cell.append(text)
        else:
            self.text.append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "br":
            self._out("\n")
        elif tag == "table":
            if self.tables:
                self.tables[-1].nested = True
            else:
                self._flush()
            self.tables.append(_Table())
        elif self.tables and tag == "tr":
            self._end_row()
            self.tables[-1].row = []
        elif self.tables and tag in ("td", "th"):
            self._end_cell()
            t = self.tables[-1]
            if t.row is None:
                t.row = []
            a = dict(attrs)
            number = lambda k, most: min(int(m[0]), most) if (m := re.match(r"\d+", a.get(k) or "")) and int(m[0]) else 1
            t.span = (number("rowspan", MOST_DOWN), number("colspan", MOST_ACROSS), tag == "th")
            t.cell = []
        elif tag in BLOCK_TAGS:
            self._out("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.tables:
            self._end_row()
            t = self.tables.pop()
            block = [*t.inner] if t.nested else [Block("table", rows=spread(t.rows))] if t.rows else []
            if t.nested:  # its own cells' text is kept as lines
                lines = [x for r in t.rows for c in r for x in text_lines(c[0])]
                block = ([Block("text", lines)] if lines else []) + block
            (self.tables[-1].inner if self.tables else self.blocks).extend(block)
        elif tag == "tr" and self.tables:
            self._end_row()
        elif tag in ("td", "th") and self.tables:
            self._end_cell()
        elif tag in BLOCK_TAGS:
            self._out("\n")

    def _end_cell(self) -> None:
        t = self.tables[-1]
        if t.cell is not None and t.row is not None:
            t.row.append((" ".join(text_lines("".join(t.cell))), *t.span))
        t.cell = None

    def _end_row(self) -> None:
        self._end_cell()
        t = self.tables[-1]
        if t.row:
            t.rows.append(t.row)
        t.row = None

    def handle_data(self, data: str) -> None:
        self._out(re.sub(r"\s+", " ", data))


def blocks(markup: str) -> list[Block]:
    """The text and table blocks of a page in order; a table that holds tables only lays out and is dissolved."""
    r = _Reader()
    r.feed(markup)
    r.close()
    while r.tables:
        r.handle_endtag("table")
    r._flush()
    return r.blocks


def to_lines(found: list[Block]) -> list[str]:
    """Blocks as lines: text as it is, table rows with ' | ' between cells, a blank line between blocks."""
    out: list[str] = []
    for b in found:
        part = b.lines if b.kind == "text" else [" | ".join(c.text for c in r) for r in b.rows if any(c.text for c in r)]
        if part:
            out += ([""] if out else []) + part
    return out
