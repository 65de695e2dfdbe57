"""Token counts by field or section: whole documents are encoded once, and token spans are joined to section spans.

A token belongs to the section that holds all of its code points. A token that crosses a boundary is allocated by a rule:
`start` (the section of its first code point), `end` (of its last), `majority` (the one with most of its code points, the
earlier of equals) or `split` (to each by its share of the code points; counts are then fractions). Counts of a document's
sections always add up to its tokens.

Defined results: a null or empty text is one empty section without tokens; a null field is an empty one; the line feed that
ends a line belongs to it, and no section follows a last line feed; repeated rows are counted one by one; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm._common import read
from storyloom.llm._encode import encoder, vocabulary

RULES = ("start", "end", "majority", "split")


def line_starts(text: str) -> np.ndarray:
    """The first code point of each line."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.flatnonzero(points[:-1] == 10) + 1 if len(points) else np.zeros(0, np.int64)
    return np.concatenate([[0], starts])


def allocate(first: np.ndarray, past: np.ndarray, starts: np.ndarray, length: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of its code-point spans cross a boundary, for token spans [first, past).

    starts are ascending, and repeat where a section is empty; such a section gets no token.
    """
    n = len(starts)
    ends = np.append(starts[1:], length)
    at = np.searchsorted(starts, first, side="right") - 1
    to = np.searchsorted(starts, np.maximum(past - 1, first), side="right") - 1
    whole = at == to
    counts = np.bincount(at[whole], minlength=n).astype(np.float64)
    crossing = np.zeros(n, dtype=np.int64)
    for f, p, a, b in zip(first[~whole], past[~whole], at[~whole], to[~whole], strict=True):
        shared = np.minimum(ends[a : b + 1], p) - np.maximum(starts[a : b + 1], f)
        crossing[a : b + 1] += shared > 0
        if rule == "split":
            counts[a : b + 1] += shared / shared.sum()
        else:
            counts[{"start": a, "end": b, "majority": a + int(np.argmax(shared))}[rule]] += 1
    return counts, crossing


def _count(docs: DataFrame, tokenizer: str, rule: str, lines: bool) -> DataFrame:
    """docs: doc_id, text and, unless lines, starts."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    number = ("double", pa.float64()) if rule == "split" else ("long", pa.int64())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        names = ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column("text").to_pylist()]
                given = [None] * len(texts) if lines else part.column("starts").to_pylist()
                columns: list[list[np.ndarray]] = [[] for _ in names]
                rows = []
                for i, (text, (first, past), own) in enumerate(zip(texts, enc.offsets(texts), given, strict=True)):
                    starts = line_starts(text) if own is None else np.array(own, dtype=np.int64)
                    counts, crossing = allocate(first, past, starts, len(text), rule)
                    rows.append(np.full(len(starts), i))
                    for column, values in zip(columns[1:], (np.arange(len(starts)), starts, np.append(starts[1:], len(text)), counts, crossing), strict=True):
                        column.append(values)
                if rows:
                    ids = part.column("doc_id").take(pa.array(np.concatenate(rows)))
                    kinds = (pa.int32(), pa.int64(), pa.int64(), number[1], pa.int64())
                    made = [pa.array(np.concatenate(c)).cast(kind) for c, kind in zip(columns[1:], kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids, *made], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(count, f"doc_id {kind}, section int, char_start long, char_end long, n_tokens {number[0]}, n_crossing long")


def count_line_tokens(docs: DataFrame, tokenizer: str, rule: str = "majority", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, section, char_start, char_end, n_tokens, n_crossing) with the lines of each text as its sections."""
    return _count(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), tokenizer, rule, lines=True)


def count_field_tokens(docs: DataFrame, fields: list[str], tokenizer: str, rule: str = "majority", key: str = "doc_id", separator: str = "\n") -> DataFrame:
    """The same with string columns as sections: a row is encoded as its fields, each followed by the separator but the last."""
    bodies = [F.coalesce(F.col(f), F.lit("")) for f in fields]
    starts, at = [], F.lit(0)
    for body in bodies:
        starts.append(at.cast("long"))
        at = at + F.char_length(body) + len(separator)
    whole = docs.select(F.col(key).alias("doc_id"), F.concat_ws(separator, *bodies).alias("text"), F.array(*starts).alias("starts"))
    names = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("section") + 1)
    return _count(whole, tokenizer, rule, lines=False).withColumn("field", names)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_line_tokens(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), "majority")
