"""Sentence-aware chunks of paragraphs with code-point offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Characters after which a text may be cut.
SENTENCE_ENDS = "。！？!?；;"
SOFT_BREAKS = "，,、）)】」』"
TARGET, LONGEST, SHORTEST = 400, 700, 60
#: Characters of texts whose chunks leave a worker at a time, but for the last text.
CUT = 1_000_000


def split_after(text: Column, breakers: str, limit: int) -> Column:
    """Pieces that end with a breaker once they have ``limit`` characters; the last is what is left."""
    pattern = rf"(?s).{{{max(limit - 1, 0)},}}?[{breakers}]|.+\z"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def unit_spans(text: str, target: int = TARGET, longest: int = LONGEST) -> Iterator[tuple[int, int]]:
    """Paragraphs as [start, end); those longer than ``longest`` by sentences at ``target``; such sentences by soft breaks."""
    sentence, soft = (re.compile(rf".{{{max(target - 1, 0)},}}?[{b}]|.+\Z", re.DOTALL) for b in (SENTENCE_ENDS, SOFT_BREAKS))
    for paragraph in re.finditer(r"[^\n]+", text):
        for coarse in sentence.finditer(text, *paragraph.span()) if len(paragraph[0]) > longest else [paragraph]:
            for fine in soft.finditer(text, *coarse.span()) if len(coarse[0]) > longest else [coarse]:
                yield fine.span()


def chunk_spans(text: str, target: int = TARGET, longest: int = LONGEST, shortest: int = SHORTEST) -> Iterator[tuple[int, int]]:
    """Units with short neighbours joined, as [start, end) of the text; each unit is looked at once."""
    open_: tuple[int, int] | None = None
    for start, end in unit_spans(text, target, longest):
        if open_ is None:
            open_ = start, end
            continue
        first, last = open_
        small = min(last - first, end - start) < shortest or last - first < target
        if start - last <= 1 and end - first <= longest and small:
            open_ = first, end
        else:
            yield open_
            open_ = start, end
    if open_:
        yield open_


def chunks(text: Column, target: int = TARGET, longest: int = LONGEST, shortest: int = SHORTEST) -> Column:
    """Structs of offset and text; a newline inside a chunk becomes a space, blank chunks are dropped. Linear in the text."""

    @pandas_udf("array<struct<off:int,text:string>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            rows, held = [], 0
            for t in s:
                rows.append([{"off": a, "text": x} for a, z in chunk_spans(t or "", target, longest, shortest) if (x := t[a:z].replace("\n", " ")).strip()])
                held += len(t or "")
                if held >= CUT:
                    yield pd.Series(rows, dtype="object")
                    rows, held = [], 0
            if rows or not len(s):
                yield pd.Series(rows, dtype="object")

    return cut(text)


def chunk_rows(docs: DataFrame, text: str = "text", target: int = TARGET, longest: int = LONGEST, shortest: int = SHORTEST) -> DataFrame:
    """One row per chunk: the other columns of ``docs`` with seq, chunk_id, char_offset, chunk_text."""
    rest = [c for c in docs.columns if c != text]
    out = docs.select(*rest, F.posexplode(chunks(F.col(text), target, longest, shortest)).alias("seq", "c"))
    number = F.col("seq").cast("string")
    return out.select(*rest, "seq", F.concat(F.col("doc_id").cast("string"), F.lit("::c"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))).alias("chunk_id"), F.col("c.off").alias("char_offset"), F.col("c.text").alias("chunk_text"))
