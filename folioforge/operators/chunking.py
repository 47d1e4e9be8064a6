"""Texts cut into overlapping chunks at white space."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from folioforge.functions.urls import chunk_id

WINDOW = 2400
OVERLAP = 240
HELD = 1 << 20  # characters of chunks that a task holds before it sends them on


def spans(text: str, window: int = WINDOW, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Begin and end of the pieces of a text without white space at its ends, each `overlap` before the end of the one before.

    A piece ends at the last white space of its window.  One within the overlap
    would not move on, so it counts as none and the window is cut hard.
    """
    start = 0
    while start < len(text):
        end = min(start + window, len(text))
        if end < len(text):
            at = next((i for i in range(end - 1, start + overlap, -1) if text[i].isspace()), None)
            end = at if at is not None else end
        yield start, end
        if end == len(text):
            break
        start = end - overlap


def pieces(text: str | None, window: int = WINDOW, overlap: int = OVERLAP) -> Iterator[str]:
    """Pieces of at most `window` characters, trimmed; empty ones are left out."""
    text = (text or "").strip()
    for begin, end in spans(text, window, overlap):
        if piece := text[begin:end].strip():
            yield piece


def cut(text: str | None, window: int = WINDOW, overlap: int = OVERLAP) -> list[str]:
    return list(pieces(text, window, overlap))


def counts(docs: DataFrame, document: str, text: str) -> DataFrame:
    """document and chunk_count of every row; a task holds one text's characters at a time, and of its chunks one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [sum(1 for _ in pieces(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[document, "chunk_count"])

    source = docs.select(document, text)
    return source.mapInArrow(run, f"`{document}` {source.dtypes[0][1]}, chunk_count long")


def chunks(docs: DataFrame, document: str, text: str, *keep: str) -> DataFrame:
    """document, keep, sequence, text and chunk_id of every chunk; a task holds some HELD characters of chunks at a time."""
    source = docs.select(document, *keep, F.col(text).alias("text"))
    wanted = source.select(document, *keep, F.lit(0).alias("sequence"), "text").schema
    wire = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, texts, size = [], [], [], 0

            def made() -> pa.RecordBatch:
                kept = batch.select(range(batch.num_columns - 1)).take(pa.array(rows, pa.int64()))
                out = pa.RecordBatch.from_arrays([*kept.columns, pa.array(places, pa.int32()), pa.array(texts, wire.field("text").type)], names=wire.names)
                rows.clear(), places.clear(), texts.clear()
                return out

            for row, own in enumerate(batch.column(batch.num_columns - 1)):
                for place, piece in enumerate(pieces(own.as_py())):
                    rows.append(row), places.append(place), texts.append(piece)
                    size += len(piece)
                    if size >= HELD:
                        yield made()
                        size = 0
            if rows:
                yield made()

    return source.mapInArrow(run, wanted).withColumn("chunk_id", chunk_id(F.col(document), F.col("sequence")))
