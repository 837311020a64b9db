"""HTML to text: the one operation that Spark's built-ins cannot express.

The markup reading itself is left to the standard library inside an Arrow-batched UDF; the layout
clean-up around it stays in Spark expressions.
"""

from __future__ import annotations

import html
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dossier import constants as K
from dossier.functions.text import looks_like_html, normalize_layout



def _reader() -> Callable[..., Column]:
    """The UDF, built from nested definitions so that it travels to workers without this package."""
    breaks, skipped = frozenset(K.BLOCK_TAGS), frozenset(K.SKIPPED_TAGS)

    class VisibleText(HTMLParser):
        """Collects visible text; block-level tags break the line on both sides."""

        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.pieces: list[str] = []
            self.hidden = 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in skipped
            self.line_break(tag)

        def handle_endtag(self, tag):
            if tag in skipped:
                self.hidden = max(self.hidden - 1, 0)
            self.line_break(tag)

        def line_break(self, tag):
            if tag in breaks:
                self.pieces.append("\n")

        def handle_data(self, data):
            visible = "" if self.hidden else html.unescape(data)
            if not visible.isspace():
                self.pieces.append(visible)

    def visible(document: str) -> str:
        reader = VisibleText()
        reader.feed(document)
        reader.close()
        return html.unescape("".join(reader.pieces))

    def resolve(markup: pd.Series, plain: pd.Series) -> pd.Series:
        return markup.map(visible, na_action="ignore").fillna(plain.map(html.unescape, na_action="ignore"))

    return F.pandas_udf(resolve, StringType())


_resolve = _reader()


def extract_text(document: Column) -> Column:
    """Readable text of a filing document, HTML or plain.

    Plain text without an ampersand has no entities to resolve; such rows send only nulls to the
    Python workers.
    """
    is_html = looks_like_html(document)
    markup = F.when(is_html, document)
    plain = F.when(~is_html & F.contains(document, F.lit("&")), document)
    return normalize_layout(F.coalesce(_resolve(markup, plain), document))
