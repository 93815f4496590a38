"""HTML templates as rows of elements, tags and attributes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from sluice.sources._rows import parsed

NODE = "name string, code string, line int, col int"
ELEMENT, OPEN, CLOSE, ATTRIBUTE = "HTMLElement", "HTMLOpenElement", "HTMLClosingElement", "HTMLElementAttribute"


class _Walk(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str, int, int]] = []
        self.script: list | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._flush()
        line, col = self.getpos()
        named = [f'{k}="{v or ""}"' for k, v in dict(reversed(attrs)).items()][::-1]
        self.rows += [(ATTRIBUTE, a, line, col + 1) for a in named]
        if tag == "script":
            self.script = [named, line, col + 1, ""]
        else:
            self._element(tag, named, line, col + 1)

    def handle_data(self, data: str) -> None:
        if self.script:
            self.script[3] += data

    def handle_endtag(self, tag: str) -> None:
        if tag == "script":
            self._flush()

    def _flush(self) -> None:
        if self.script:
            named, line, col, text = self.script
            self.script = None
            text = re.sub(r"/\*.*?\*/", "", re.sub(r"(?<!http:)(?<!https:)//.*?(\n|$)", "", text))
            self._element("script", [*named, f'content="{text}"'] if text else named, line, col)

    def _element(self, tag: str, named: list[str], line: int, col: int) -> None:
        opened, closed = f"<{tag} {''.join(' ' + a for a in named)} >", f"</{tag}>"
        self.rows += [(OPEN, opened, line, col), (CLOSE, closed, line, col), (ELEMENT, f"{opened} {closed}", line, col)]


def node_rows(page: str) -> Iterator[tuple]:
    walk = _Walk()
    walk.feed(page)
    walk.close()
    walk._flush()
    yield from walk.rows


def nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """Rows of each element of a page: its attributes, open tag, closing tag (at the open one's place) and whole."""
    return parsed(pages, html, node_rows, NODE)
