"""Fill-in-the-middle transformation on piece tables.

A document is a short list of descriptors (buffer, start, length) over two buffers that never change: its text and the
sentinels. Cutting splits descriptors, an arrangement permutes them and puts sentinel descriptors between them, the inverse
permutation restores the document, and a hash streams the descriptors. Text is copied only when an output is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querycorpus.llm.common import documents

# The sentinels before prefix, suffix and middle, and the order of the parts in each form.
SENTINELS = ("<P>", "<S>", "<M>")
FORMS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
#: For each part (prefix, middle, suffix) the place of its sentinel.
MARK_OF = (0, 2, 1)
TEXT, MARKS = 0, 1

Piece = tuple[int, int, int]


def split(pieces: Iterable[Piece], cuts: Iterable[int]) -> list[list[Piece]]:
    """Cut a piece table at ascending offsets: one list of descriptors per part, without copying text."""
    parts, ends, at = [[]], iter([*cuts, None]), 0
    end = next(ends)
    for buffer, start, length in pieces:
        while end is not None and end <= at + length:
            if end > at:
                parts[-1].append((buffer, start, end - at))
                start, length = start + end - at, length - (end - at)
                at = end
            parts.append([])
            end = next(ends)
        if length:
            parts[-1].append((buffer, start, length))
            at += length
    return [*parts, *([[]] if end is not None else [])]


def arranged(parts: list[list[Piece]], order: tuple[int, ...], marks: tuple[str, ...]) -> list[Piece]:
    """The parts in the order given, each after its sentinel's descriptor."""
    out, starts = [], [sum(len(m) for m in marks[:i]) for i in range(len(marks))]
    for part in order:
        mark = MARK_OF[part]
        out += [(MARKS, starts[mark], len(marks[mark])), *parts[part]]
    return out


def restored(output: str, order: tuple[int, ...], marks: tuple[str, ...]) -> list[Piece]:
    """Descriptors over ``output`` that give the document back: its sentinels bound the parts, the inverse permutation orders them.

    A document that holds a sentinel is never arranged, so each sentinel occurs once. (A sentinel can't arise where text and
    sentinel meet: it starts with a sign that it holds only once.)
    """
    starts = {part: output.index(marks[MARK_OF[part]]) for part in order}
    bounds = [*(starts[part] for part in order), len(output)]
    where = {part: (starts[part] + len(marks[MARK_OF[part]]), bounds[place + 1]) for place, part in enumerate(order)}
    return [(TEXT, start, end - start) for start, end in (where[part] for part in range(len(order)))]


def streamed(pieces: Iterable[Piece], buffers: tuple[str, str]) -> str:
    """sha256 of what the descriptors stand for, piece by piece."""
    digest = hashlib.sha256()
    for buffer, start, length in pieces:
        digest.update(buffers[buffer][start : start + length].encode())
    return digest.hexdigest()


def rendered(pieces: Iterable[Piece], buffers: tuple[str, str]) -> str:
    return "".join(buffers[buffer][start : start + length] for buffer, start, length in pieces)


def plan(doc_id: int | None, text: str, marks: tuple[str, ...], seed: int, rate: int, spm: int) -> tuple[str, list[int]]:
    """Form and cuts of a document, from a hash of its identifier."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or three % 100 >= rate or any(m in text for m in marks):
        return "plain", []
    return "spm" if four % 100 < spm else "psm", sorted((one % (len(text) + 1), two % (len(text) + 1)))


SCHEMA = """doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string,
    pieces array<struct<buffer: int, start: long, length: long>>, output string"""


def _transformed(marks: tuple[str, ...], seed: int, rate: int, spm: int, outputs: bool):
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "pieces", "output"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    kinds += [pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])), pa.string()]

    def one(doc_id: int | None, text: str) -> tuple:
        form, cuts = plan(doc_id, text, marks, seed, rate, spm)
        buffers = (text, "".join(marks))
        whole = [(TEXT, 0, len(text))]
        if form == "plain":
            sha = streamed(whole, buffers)
            return (doc_id, len(text), form, None, None, sha, sha, whole, text if outputs else None)
        pieces = arranged(split(whole, cuts), FORMS[form], marks)
        output = rendered(pieces, buffers)
        back = streamed(restored(output, FORMS[form], marks), (output, ""))
        return (doc_id, len(text), form, cuts[0], cuts[1] - cuts[0], streamed(pieces, buffers), back, pieces, output if outputs else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                rows.append(one(doc_id, text.as_py() or ""))
                held += rows[-1][1] if outputs else 0
                if held > 1 << 24:
                    yield batch_of(rows)
                    rows, held = [], 0
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        columns[7] = [[{"buffer": b, "start": s, "length": m} for b, s, m in pieces] for pieces in columns[7]]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return run


def fill_in_middle(
    docs: DataFrame, marks: tuple[str, str, str] = SENTINELS, seed: int = 1, rate: int = 90, spm: int = 20, outputs: bool = True
) -> DataFrame:
    """Cut documents into prefix, middle and suffix and put the middle last, in the forms psm and spm.

    Returns per row: doc_id, n (code points), form, prefix_chars and middle_chars (null if plain), output_sha256, restored_sha256,
    pieces (the descriptors of the output over the buffers text and sentinels), output (null with ``outputs=False``).
    ``rate`` and ``spm`` are percentages of arranged documents and of spm among those.

    * A null text is an empty text. Empty texts, texts that hold a sentinel and the documents left out by ``rate`` stay plain.
    * The cuts depend on doc_id and length only; a null doc_id counts as the word null. Repeated rows give equal rows.
    * Other columns are not read; a table without rows gives none. A narrow step: no shuffle, one document in memory at a time
      besides its batch.
    """
    if any(not m or m[0] in m[1:] for m in marks) or len({m[0] for m in marks}) > 1 or len(set(marks)) < 3 or any(a != b and a in b for a in marks for b in marks):
        raise ValueError("sentinels must differ, share a first sign that they hold once, and not hold each other")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_transformed(marks, seed, rate, spm, outputs), SCHEMA)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    return fill_in_middle(documents(spark, sf_dir), outputs=False).select(*columns)


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLES = {
    "op11_fill_in_middle": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
        u AS (SELECT *, ('0x' || substring(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substring(h, 9, 8))::BIGINT % (n + 1) AS b,
                     CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                               OR ('0x' || substring(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
                          WHEN ('0x' || substring(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
        v AS (SELECT *, substring(text, 1, least(a, b)) AS p, substring(text, least(a, b) + 1, abs(a - b)) AS m,
                     substring(text, greatest(a, b) + 1) AS s FROM u)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN abs(a - b) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
        FROM v
    """
}
