"""Token counts of fields and sections from one encoding of the whole document."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import ship
from runlens.llm.tokens import byte_encoder, vocabulary_path

RULES = ("majority", "first", "last")


def char_spans(text: str, ids: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character, and the one after the last, that each token touches; tokens may share a character of several bytes."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    end = np.cumsum(widths[ids])
    return char[end - widths[ids]], char[end - 1] + 1


def attribute(start: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of tokens with sections that tile the text -> (section of each token, whether it crosses a boundary).

    sections: the sorted first characters. A crossing token goes to the section with most of its characters, of
    equal ones the earliest (`majority`), to the one with its first character (`first`) or its last (`last`).
    """
    low = np.searchsorted(sections, start, side="right") - 1
    high = np.searchsorted(sections, end - 1, side="right") - 1
    crossing = low != high
    if rule == "last":
        return high, crossing
    if rule == "majority":
        low = low.copy()
        for t in np.flatnonzero(crossing).tolist():
            edges = np.concatenate([[start[t]], sections[low[t] + 1 : high[t] + 1], [end[t]]])
            low[t] += int(np.argmax(np.diff(edges)))
    return low, crossing


def token_counts(docs: DataFrame, id_col: str = "doc_id", fields: Sequence[str] = ("text",), path: str | None = None, rule: str = "majority") -> DataFrame:
    """Tokens of every field and section (line) of every document, from one encoding of the whole document.

    The fields are laid end to end with a line feed between them and encoded once, whole. A section is a line of a
    field with the line feed that ends it, so sections tile the document and their counts add up to its tokens.
    Returns one row per document, field and line: doc_id, field, section (from 0 in the document), start, n_chars,
    n_tokens, n_crossing (tokens given to it that touch another section too), doc_tokens.

    Null fields count as empty; an empty field is one section without characters of its own. Special tokens' strings
    are recognised as the library does by default. A null identifier is kept, repeated rows are counted one by one,
    an empty table gives no rows, other columns are ignored. One pass, no shuffle; memory follows the longest text.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    spark = docs.sparkSession
    ship(spark)
    place, names = path, list(fields)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(place or vocabulary_path())
        for b in batches:
            parts = [[x or "" for x in c.to_pylist()] for c in b.columns[1:]]
            texts = ["\n".join(p) for p in zip(*parts)]
            rows: list[list[np.ndarray]] = []
            owner: list[np.ndarray] = []
            for k, (text, ids) in enumerate(zip(texts, encoder.batch(texts))):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                lengths = np.array([len(p[k]) for p in parts])
                field_at = np.cumsum(lengths + 1) - lengths - 1
                at = np.append(0, np.flatnonzero(codes == 10) + 1)
                field = np.searchsorted(field_at, at, side="right") - 1
                keep = np.ones(len(at), bool)  # a line feed that ends the document's last line opens no section
                if len(at) > 1 and at[-1] == len(codes) and lengths[-1]:
                    keep[-1] = False
                at, field = at[keep], field[keep]
                count = cross = np.zeros(len(at), np.int64)
                if len(ids):
                    to, over = attribute(*char_spans(text, ids, encoder.widths), at, rule)
                    count, cross = np.bincount(to, minlength=len(at)), np.bincount(to[over], minlength=len(at))
                rows.append([field, np.arange(len(at)), at, np.diff(np.append(at, len(codes))), count, cross, np.full(len(at), len(ids))])
                owner.append(np.full(len(at), k))
            if not rows:
                continue
            field, section, *rest = (np.concatenate(x) for x in zip(*rows))
            columns = [b.column(0).take(pa.array(np.concatenate(owner))), pa.array(np.array(names, object)[field], pa.string()), pa.array(section, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in rest]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "field", "section", "start", "n_chars", "n_tokens", "n_crossing", "doc_tokens"])

    schema = f"doc_id {kind}, field string, section int, start long, n_chars long, n_tokens long, n_crossing long, doc_tokens long"
    return docs.select(F.col(id_col).alias("doc_id"), *[F.col(f).cast("string").alias(f"_f{k}") for k, f in enumerate(names)]).mapInArrow(run, schema)
