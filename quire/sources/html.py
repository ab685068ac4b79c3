"""Text of HTML sections by a parser, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def text_of(html: str) -> str:
    p = _Text()
    p.feed(html)
    p.close()
    out: list[str] = []
    for line in (x.strip() for x in "".join(p.parts).split("\n")):
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip("\n")


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    """Text content without scripts and styles, lines stripped, one blank line at most in a row."""
    return s.map(lambda x: None if x is None else text_of(x))
