"""Fill-in-the-middle transformation of documents (operator 13).

A text is decoded to a UTF-32 array of code points. Each code point has a class, and a unit is a maximal run of one class:
neighbouring classes are compared, and flatnonzero of the places where they differ yields the boundaries. Two
ranks drawn from the document's id choose two boundaries; the array is sliced there, and the pieces are encoded again. The
default unit is the code point itself (a class of its own each); "words" cuts at changes between white space and other text, "lines" after line feeds.

The draws come from the hex SHA-256 of `<seed>:<doc_id>`, so a document gets the same cut on every run, whatever the partitions. A
share of the documents stays plain, the others are in the order prefix, suffix, middle (psm) or suffix, prefix, middle (spm), behind marks. A text that is empty or
holds a mark stays plain, so every output can be turned back into its text: no piece holds a mark, and no mark can begin in one
piece and end in another.

Defined cases: a null text is empty; a null doc_id draws from the seed and the colon alone; repeated rows give a result each; very long texts are cut whole, one at a time;
an empty table gives an empty result; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
UNITS = ("code points", "words", "lines")
#: Bytes of output after which a task hands on what it has.
SLAB = 1 << 20


@dataclass(frozen=True)
class Plan:
    """How documents are cut: shares in percent, of all documents and of those that are not plain."""

    seed: int = 1
    plain_from: int = 90
    spm_below: int = 20
    unit: str = "code points"


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """A value for each code point; equal neighbours are one unit."""
    if unit == "code points":
        return np.arange(len(points))
    if unit == "words":
        return (points == 0x20) | (points >= 9) & (points <= 13)
    if unit == "lines":
        return np.cumsum(points == 10) - (points == 10)
    raise ValueError(f"unit must be one of {UNITS}")


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin, and the end of the text."""
    if not len(points):
        return np.zeros(1, np.int64)
    own = classes(points, unit)
    return np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(points)]))


def cut(doc_id: int | None, text: str, plan: Plan) -> tuple[int, str, int | None, int | None, str]:
    """n (units), form, prefix_chars, middle_chars, output."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    at = boundaries(points, plan.unit)
    n = len(at) - 1
    digest = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    first, second, form, order = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in MARKS) or form % 100 >= plan.plain_from:
        return n, "plain", None, None, text
    a, b = sorted((first % (n + 1), second % (n + 1)))
    x, y = int(at[a]), int(at[b])
    prefix, middle, suffix = (p.tobytes().decode("utf-32-le") for p in (points[:x], points[x:y], points[y:]))
    if order % 100 < plan.spm_below:
        return n, "spm", x, y - x, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", x, y - x, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


RESULT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, size = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows.append((doc_id, *cut(doc_id, text.as_py() or "", plan)))
            size += len(rows[-1][-1])
            if size >= SLAB:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RESULT, strict=True)], schema=RESULT)


def transform(documents: DataFrame, plan: Plan | None = None) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row."""
    plan = plan or Plan()
    classes(np.zeros(0, "<u4"), plan.unit)  # refuses unknown units on the driver
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(lambda b: _cut(b, plan), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output, form):
    """The text that an output was made of, from the output and its form alone."""
    first, second = F.when(form == "psm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX)), F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    body = F.substr(output, F.length(first) + 1)
    one = F.split_part(body, second, F.lit(1))
    two, three = (F.split_part(F.split_part(body, second, F.lit(2)), F.lit(MIDDLE), F.lit(k)) for k in (1, 2))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def digests(transformed: DataFrame) -> DataFrame:
    """The rows of transform() with digests of the output, and of the text that it is turned back into."""
    back = restored(F.col("output"), F.col("form"))
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )
