"""Bounded reading of documents by cursor, and chunks for an index (from the design specification).

A cursor is a keyset: page, order and offset of the next character, so it stays right whatever was read before
it and needs no state.  Reads end after a number of characters, within a block if need be; reading to the end
gives every character once.

Chunks are packed from a document's blocks in their order: a heading begins one, paragraphs fill it up to a number
of tokens, a table that goes on in the next chunk repeats its header there.  Blocks are cut between tokens
alone, and a number with its separators is one token.

Rows: null texts count as empty; blocks without text take no room; (page, order) must not repeat within a document,
else their order is open; documents without blocks give nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import in_order

#: Characters of a read: usual and most. Fixed values.
USUAL, MOST = 12_000, 32_000
#: Tokens of a chunk, and of its overlap with the one before. Fixed values.
TOKENS, OVERLAP = 256, 32
#: A Han character, or a run without white space and Han characters; digits that blanks group are one token.
TOKEN = re.compile(r"\d{1,3}(?:[   ]\d{3})+(?![\d])(?:[.,]\d+)?%?|[一-鿿]|[^\s一-鿿]+")


def _cursor(page, order, offset):
    return F.concat_ws(":", page, order, offset)


def read_on(blocks: DataFrame, cursors: DataFrame, most: int = USUAL, doc: str = "document_id") -> DataFrame:
    """One read of each document that has a cursor (a null one: from the start): its pieces, and the cursor to go on at.

    blocks: ``doc``, page, ord, text; cursors: ``doc``, cursor.  Returns ``doc``, page, ord, first, end, text, cursor
    (null: the document ends here), which is the same on all rows of a read.
    """
    if not 0 < most <= MOST:
        raise ValueError(f"a read has up to {MOST} characters")
    part = lambda i: F.split_part("cursor", F.lit(":"), F.lit(i)).cast("long")
    start = cursors.select(doc, F.coalesce(part(1), F.lit(-1)).alias("c_page"), F.coalesce(part(2), F.lit(-1)).alias("c_ord"), F.coalesce(part(3), F.lit(0)).alias("c_at"))
    rows = blocks.select(doc, "page", "ord", F.coalesce("text", F.lit("")).alias("text")).join(start, doc)
    here = (F.col("page") == F.col("c_page")) & (F.col("ord") == F.col("c_ord"))
    rows = rows.filter(here | (F.col("page") > F.col("c_page")) | (F.col("page") == F.col("c_page")) & (F.col("ord") > F.col("c_ord")))
    rows = rows.withColumn("first", F.when(here, F.col("c_at")).otherwise(F.lit(0)).cast("int")).withColumn("left", F.length("text") - F.col("first"))
    order = Window.partitionBy(doc).orderBy("page", "ord")
    rows = rows.withColumn("before", F.sum("left").over(order) - F.col("left")).withColumns({"n_page": F.lead("page").over(order), "n_ord": F.lead("ord").over(order)})
    read = rows.filter(F.col("before") < most).withColumn("take", F.least(F.col("left"), most - F.col("before")).cast("int"))
    stop = F.when(F.col("take") < F.col("left"), _cursor("page", "ord", F.col("first") + F.col("take"))).when(F.col("n_page").isNotNull(), _cursor("n_page", "n_ord", F.lit(0)))
    last = F.max_by(F.struct(stop.alias("c")), F.struct("page", "ord")).over(Window.partitionBy(doc))["c"]
    return read.select(doc, "page", "ord", "first", (F.col("first") + F.col("take")).alias("end"), F.substring(F.col("text"), F.col("first") + 1, F.col("take")).alias("text"), last.alias("cursor"))


def all_reads(blocks: DataFrame, most: int = USUAL, doc: str = "document_id") -> DataFrame:
    """The pieces of all reads of all documents, as ``read_on`` would give them one after the other, numbered by ``read``.

    Places are sums over pages first, then within pages, so no document is summed in one task.
    """
    rows = blocks.select(doc, "page", "ord", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.length("text").cast("long"))
    pages = rows.groupBy(doc, "page").agg(F.sum("n").alias("p_n"))
    pages = pages.select(doc, "page", (F.sum("p_n").over(Window.partitionBy(doc).orderBy("page")) - F.col("p_n")).alias("p_at"))
    at = F.sum("n").over(Window.partitionBy(doc, "page").orderBy("ord")) - F.col("n")
    rows = rows.withColumn("at", at).join(pages, [doc, "page"]).withColumn("at", F.col("at") + F.col("p_at")).filter("n > 0")
    each = rows.withColumn("read", F.explode(F.sequence(F.floor(F.col("at") / most), F.floor((F.col("at") + F.col("n") - 1) / most))))
    first = F.greatest(F.lit(0), F.col("read") * most - F.col("at")).cast("int")
    end = F.least(F.col("n"), (F.col("read") + 1) * most - F.col("at")).cast("int")
    return each.select(doc, "read", "page", "ord", first.alias("first"), end.alias("end"), F.substring(F.col("text"), first + 1, end - first).alias("text"))


class Packer:
    """The chunk that is being filled of one document."""

    def __init__(self, doc, tokens: int, overlap: int):
        self.doc, self.tokens, self.overlap = doc, tokens, overlap
        self.no, self.size, self.fresh = 0, 0, 0  # number, tokens, and tokens that no chunk before had
        self.parts: list[tuple[int, str]] = []  # block and text
        self.header: tuple[int, str] | None = None

    def flush(self) -> Iterator[tuple]:
        if self.fresh:
            yield self.doc, self.no, self.parts[0][0], self.parts[-1][0], self.size, "\n".join(x for _, x in self.parts)
            self.no += 1
        self.parts, self.size, self.fresh = [], 0, 0

    def _put(self, block: int, text: str, n: int, new: bool = True) -> None:
        self.parts.append((block, text))
        self.size += n
        self.fresh += n if new else 0

    def row(self, block: int, text: str) -> Iterator[tuple]:
        """A table's row stays whole if a chunk can hold it with the header."""
        n = len(TOKEN.findall(text))
        head = len(TOKEN.findall(self.header[1])) if self.header else 0
        if head + n > self.tokens:
            yield from self.text(block, text)
            return
        if self.size + n > self.tokens:
            yield from self.flush()
            if self.header:
                self._put(*self.header, head, new=False)
        self._put(block, text, n)

    def text(self, block: int, text: str) -> Iterator[tuple]:
        """A block is cut where a chunk is full; the next one begins with the last tokens of it."""
        places = [m.span() for m in TOKEN.finditer(text)]
        i = 0
        while i < len(places):
            if self.size == self.tokens:
                yield from self.flush()
                back = min(self.overlap, i)
                if back:
                    self._put(block, text[places[i - back][0] : places[i - 1][1]], back, new=False)
            n = min(self.tokens - self.size, len(places) - i)
            piece = text[places[i][0] : places[i + n - 1][1]]
            if i and self.parts and self.parts[-1][0] == block:  # goes on behind its overlap
                _, before = self.parts.pop()
                piece = f"{before}{text[places[i - 1][1] : places[i][0]]}{piece}"
            self._put(block, piece, n)
            i += n

    def add(self, block: int, kind: str, text: str) -> Iterator[tuple]:
        if kind == "heading":
            yield from self.flush()
        self.header = (block, text) if kind == "table_header" else self.header if kind == "table_row" else None
        yield from self.row(block, text) if kind in ("table_header", "table_row") else self.text(block, text)


def chunks(blocks: DataFrame, tokens: int = TOKENS, overlap: int = OVERLAP, doc: str = "document_id") -> DataFrame:
    """Chunks of documents' blocks (``doc``, page, ord, kind, text): ``doc``, chunk, first_ord, last_ord, n_tokens, text.

    kind: heading, table_header, table_row, or anything else for running text.  A document's blocks are streamed in
    their order, and of it no more than the chunk that is being filled is kept.
    """
    if not 0 <= overlap < tokens:
        raise ValueError("chunks must be longer than their overlap")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None
        for frame in frames:
            out: list[tuple] = []
            for r in frame.itertuples(index=False):
                if own is None or own.doc != r[0]:
                    out += own.flush() if own else ()
                    own = Packer(r[0], tokens, overlap)
                out += own.add(r[2], r[3], r[4])
            yield pd.DataFrame(out, columns=names)
        if own:
            yield pd.DataFrame(list(own.flush()), columns=names)

    names = [doc, "chunk", "first_ord", "last_ord", "n_tokens", "text"]
    rows = blocks.select(doc, F.col("page").cast("long").alias("page"), F.col("ord").cast("long").alias("ord"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    fields = [rows.schema[doc], T.StructField("chunk", T.IntegerType()), T.StructField("first_ord", T.LongType()), T.StructField("last_ord", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("text", T.StringType())]
    return in_order(rows, [doc], ["page", "ord"], run, T.StructType(fields))
