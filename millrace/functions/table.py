"""Table functions for SQL: ``text_pieces`` gives the pieces of a text as rows.

``register(spark)`` makes it known to the session; then

    SELECT d.doc_id, p.* FROM documents d, LATERAL text_pieces(d.text) p
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from millrace.functions.text import NUMBER
from millrace.operators.redact import EMAIL, URL_END, URL_SHAPES
from millrace.runtime import ship

SHAPES = [("email", re.compile(EMAIL, re.ASCII)), *(("url", re.compile(p, re.ASCII | re.IGNORECASE)) for p in URL_SHAPES), ("number", re.compile(NUMBER, re.ASCII))]
_END = re.compile(URL_END)


def pieces(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, piece) of the emails, URLs and numbers of a text, in
    code points, by start, then end, then kind; kinds may overlap."""
    found = set()
    for kind, shape in SHAPES:
        for m in shape.finditer(text):
            piece = _END.sub("", m[0]) if kind == "url" else m[0]
            if piece:
                found.add((m.start(), m.start() + len(piece), kind, piece))
    return sorted(found)


@udtf(returnType="start int, end int, kind string, piece string", useArrow=True)
class TextPieces:
    """The rows of ``pieces``; none for a null text."""

    def eval(self, text: str):
        yield from pieces(text or "")


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.udtf.register("text_pieces", TextPieces)
