"""Fill-in-the-middle transformation over piece tables.

A document is a list of descriptors (buffer, start, length) over two immutable buffers: its own text and the sentinels.
It begins as one descriptor of the whole text. Cutting splits a descriptor at byte offsets, an arrangement is a
permutation of the pieces with sentinels put before them, and the inverse permutation restores the text. No piece is
copied for that: hashes stream the descriptors, and a text is put together only where one is asked for.

The cuts lie after whole units (lines, or characters) and come from a hash of a seed and the doc_id, so reruns agree. A
text that holds a sentinel stays plain; so the sentinels of an output are those put there, and reading them gives the
pieces back. Each document is transformed where it lies: no shuffle.

Edge cases: a null text is empty, and an empty one is plain; the id of a null doc_id is hashed as nothing; rows that
repeat, or share a doc_id, are cut by the same hashes and give a row each; a text without a line end is one line, with
the end after its last line it has no line more; cuts at either end or at the same place leave empty pieces; a very long
text is held once, with its output where that is rebuilt; extra columns, whatever their names, are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_jobs.llm.common import table
from estate_jobs.llm.tokens import buffers

TEXT, SENTINEL = 0, 1
#: Rows that a batch of results holds at most; texts go out in batches of this many bytes.
ROWS, BYTES = 4096, 8 << 20


class Piece(NamedTuple):
    """A stretch of bytes of one of the buffers."""

    buffer: int
    start: int
    length: int


class Rule(NamedTuple):
    """How documents are cut and arranged; shares are out of 100."""

    rate: int = 100
    spm: int = 50
    seed: int = 7
    unit: str = "line"
    #: What goes before prefix, suffix and middle.
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")


# Pieces in the order of the text are 0 prefix, 1 middle, 2 suffix. An arrangement lists them in the output's order.
ARRANGEMENTS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
#: The sentinel that goes before a piece.
_MARK_OF = (0, 2, 1)


def split(piece: Piece, *at: int) -> list[Piece]:
    """The piece, cut at ascending offsets within it."""
    edges = [0, *at, piece.length]
    return [Piece(piece.buffer, piece.start + a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def permute(pieces: list[Piece], order: tuple[int, ...]) -> list[Piece]:
    return [pieces[k] for k in order]


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(sorted(range(len(order)), key=lambda k: order[k]))


def stream(pieces: list[Piece], views: tuple[memoryview, ...]) -> Iterator[memoryview]:
    return (views[p.buffer][p.start : p.start + p.length] for p in pieces)


def digest(pieces: list[Piece], views: tuple[memoryview, ...]) -> str:
    """SHA-256 of what the descriptors stand for."""
    h = hashlib.sha256()
    for part in stream(pieces, views):
        h.update(part)
    return h.hexdigest()


class Sentinels:
    """The sentinel buffer, and the descriptor of each."""

    def __init__(self, marks: tuple[str, str, str]) -> None:
        self.marks = [m.encode() for m in marks]
        self.view = memoryview(b"".join(self.marks))
        starts = np.cumsum([0, *map(len, self.marks)])
        self.pieces = [Piece(SENTINEL, int(a), len(m)) for a, m in zip(starts, self.marks, strict=False)]

    def before(self, pieces: list[Piece], order: tuple[int, ...]) -> list[Piece]:
        """The pieces of the text in an arrangement's order, each after its sentinel."""
        return [x for k, p in zip(order, permute(pieces, order), strict=True) for x in (self.pieces[_MARK_OF[k]], p)]

    def read(self, output: bytes, order: tuple[int, ...]) -> list[Piece]:
        """The text's pieces in their order, as descriptors over an output, found by its sentinels."""
        found, at = [], 0
        for k in order:
            at = output.index(self.marks[_MARK_OF[k]], at)
            found.append(at)
            at += len(self.marks[_MARK_OF[k]])
        ends = [*found[1:], len(output)]
        parts = [Piece(TEXT, a + len(self.marks[_MARK_OF[k]]), b - a - len(self.marks[_MARK_OF[k]])) for k, a, b in zip(order, found, ends, strict=True)]
        return permute(parts, inverse(order))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned numbers of 32 bits: for the two cuts, the rate and the arrangement."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def unit_ends(raw: np.ndarray, unit: str) -> np.ndarray:
    """Byte offsets after each unit of a text."""
    if unit == "char":
        return np.append(np.flatnonzero((raw & 0xC0) != 0x80)[1:], len(raw)) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(raw == 10) + 1
    return np.append(ends, len(raw)) if len(raw) and (not len(ends) or ends[-1] < len(raw)) else ends


def _chars(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def _transform(rule: Rule, texts: bool):
    sentinels = Sentinels(rule.sentinels)

    def one(doc_id: int | None, raw: np.ndarray) -> dict:
        text, whole = raw.tobytes(), Piece(TEXT, 0, len(raw))
        ends = unit_ends(raw, rule.unit)
        h1, h2, h3, h4 = draws(doc_id, rule.seed)
        row = {"doc_id": doc_id, "n": len(ends), "form": "plain", "prefix_chars": None, "middle_chars": None}
        views = (memoryview(text), sentinels.view)
        if not text or h3 % 100 >= rule.rate or any(m in text for m in sentinels.marks):
            pieces = [whole]
            row |= {"output_sha256": digest(pieces, views), "restored_sha256": digest(pieces, views)}
        else:
            cuts = [int(ends[k - 1]) if k else 0 for k in sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))]
            row["form"] = "spm" if h4 % 100 < rule.spm else "psm"
            order = ARRANGEMENTS[row["form"]]
            pieces = sentinels.before(split(whole, *cuts), order)
            # what an output's reader does, from the output alone
            output = b"".join(stream(pieces, views))
            row |= {"prefix_chars": _chars(raw[: cuts[0]]), "middle_chars": _chars(raw[cuts[0] : cuts[1]])}
            row |= {"output_sha256": digest(pieces, views), "restored_sha256": digest(sentinels.read(output, order), (memoryview(output),))}
        row["pieces"] = [p._asdict() for p in pieces]
        if texts:
            row["output"] = b"".join(stream(pieces, views)).decode()
        return row

    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())]
    fields += [("pieces", pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])))]
    schema = pa.schema(fields + [("output", pa.string())] * texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            rows, size = [], 0
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                rows.append(one(doc_id, data[offsets[k] : offsets[k + 1]]))
                size += int(offsets[k + 1] - offsets[k])
                if len(rows) == ROWS or size >= BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def fill_in_middle(documents: DataFrame, rule: Rule = Rule(), texts: bool = True) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output_sha256, restored_sha256, pieces and, if asked for, output.

    pieces are the output's descriptors: buffer 0 is the document's text, 1 the sentinels in the order of the rule.
    restored_sha256 is that of the text as read back from the output.
    """
    kinds = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, pieces array<struct<buffer: int, start: long, length: long>>"
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_transform(rule, texts), kinds + ", output string" * texts)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"), texts=False)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


_SQL_DRAWS = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
OP11_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, {_SQL_DRAWS} FROM docs),
placed AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(units[1:lo], '') AS p, array_to_string(units[lo + 1:hi], '') AS m, array_to_string(units[hi + 1:], '') AS s FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
