"""HTML to text, on the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose text is not content.
SKIPPED = frozenset({"script", "style", "nav", "header", "footer", "aside"})


class _Events(HTMLParser):
    """A page as a list of steps: a tag with +1 where it opens and -1 where it closes, or a text with 0."""

    def __init__(self, page: str) -> None:
        super().__init__()
        self.steps: list[tuple[str, int]] = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs) -> None:
        self.steps.append((tag, 1))

    def handle_endtag(self, tag) -> None:
        self.steps.append((tag, -1))

    def handle_data(self, data) -> None:
        self.steps.append((data, 0))


def html_text(html: str | None) -> tuple[str | None, str | None]:
    """Title and content outside of skipped elements, pieces joined by one space, white space collapsed; null if empty."""
    words: dict[bool, list[str]] = {True: [], False: []}
    hidden, titled = 0, False
    for value, change in _Events(html or "").steps:
        if not change:
            words[titled] += [] if hidden else value.split()
        elif value in SKIPPED:
            hidden = max(0, hidden + change)
        elif value == "title":
            titled = change > 0
    return " ".join(words[True]) or None, " ".join(words[False]) or None


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType())]))
def extracted_html(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([html_text(p) for p in pages], columns=["title", "content"])
