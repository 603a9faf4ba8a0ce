"""Fill-in-middle transformation by secondary sort: pieces of texts keyed by document and place, streamed in order.

A text is cut into three sections at two line ends. Its sections leave the first task as pieces of a few
thousand whole lines at most, keyed by document and output position; ``repartitionAndSortWithinPartitions``
brings each document's pieces together in output order, and they are read one at a time. Restoration
keys what was read by section again and sorts inside the same partitions, without another shuffle.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks before the prefix, the middle and the suffix. Fixed values.
MARKS = ("<P>", "<M>", "<S>")
#: Sections of the output by form, as places in MARKS.
ORDERS = {"plain": (0,), "psm": (0, 2, 1), "spm": (2, 0, 1)}
#: Characters of a piece at most, and bytes of text in a partition: its sort then stays in memory.
PIECE = 1 << 15
PARTITION_BYTES = 64 << 20
_HEAD = -1


class Plan(NamedTuple):
    """How one text is rearranged."""

    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None


def count_lines(text: str) -> int:
    return text.count("\n") + (text != "" and not text.endswith("\n"))


def _line_ends(text: str, *numbers: int) -> list[int]:
    """Where the first so many lines of the text end."""
    lines = text.split("\n")
    return [min(len(text), sum(map(len, lines[:n])) + n) for n in numbers]


def plan(identity, text: str, rate: int = 100, spm: int = 50, seed: int = 7) -> Plan:
    """Form and sections of a text, drawn from the digest of its id; a null id counts as an empty one."""
    n = count_lines(text)
    name = f"{seed}:" + ("" if identity is None else str(identity))
    digest = hashlib.sha256(name.encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= rate:
        return Plan(n, "plain", None, None)
    low, high = _line_ends(text, *sorted((h[0] % (n + 1), h[1] % (n + 1))))
    return Plan(n, "spm" if h[3] % 100 < spm else "psm", low, high - low)


def _pieces(text: str) -> Iterator[str]:
    """The text in runs of whole lines of ``PIECE`` characters at most; a longer line is cut. At least one piece."""
    at = 0
    while len(text) - at > PIECE:
        end = text.rfind("\n", at, at + PIECE) + 1 or at + PIECE
        yield text[at:end]
        at = end
    yield text[at:]


def _owner(key: tuple) -> int:
    """The partition of a key: by document only."""
    return int.from_bytes(key[0][:8], "big")


def _keyed(rows: Iterator[Row], split: Callable) -> Iterator[tuple]:
    """Key, value for the head and the pieces of each row (id, text, ...).

    A row is known by a digest of its values, the task and its number among equal rows of the task. So equal rows
    spread over the partitions, and a task that runs again names its rows alike, in whatever order it meets them.
    """
    seen: Counter = Counter()
    task = TaskContext.get().partitionId().to_bytes(4, "big")
    for row in rows:
        digest = hashlib.blake2b(repr(tuple(row)).encode("utf-8", "surrogatepass"), digest_size=12).digest()
        nth, seen[digest] = seen[digest], seen[digest] + 1
        name = hashlib.blake2b(digest + task + nth.to_bytes(8, "big"), digest_size=16).digest()
        head, pieces = split(row)
        yield (name, _HEAD, 0), head
        for key, piece in pieces:
            yield (name, *key), piece


def _output_pieces(rate: int, spm: int, seed: int) -> Callable:
    """Cuts (id, text) into pieces keyed by place in the output and number in the section; marks open their section."""
    def split(row):
        text = row[1] or ""
        own = plan(row[0], text, rate, spm, seed)

        def pieces():
            low = own.prefix_chars or 0
            high = low + (own.middle_chars or 0)
            sections = (text,) if own.form == "plain" else (text[:low], text[low:high], text[high:])
            for place, section in enumerate(ORDERS[own.form]):
                mark = "" if own.form == "plain" else MARKS[section]
                for i, piece in enumerate(_pieces(sections[section])):
                    yield (place, i), ((mark if i == 0 else "") + piece).encode()

        return (row[0], *own), pieces()

    return split


def _sorted(pieces: RDD, partitions: int) -> RDD:
    return pieces.repartitionAndSortWithinPartitions(partitions, _owner, keyfunc=lambda key: key)


def _documents(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(name, head, pieces) of each document of a sorted partition; pieces are read as they come."""
    rows = iter(rows)
    row = next(rows, None)
    while row is not None:
        (name, _, _), head = row
        row = None

        def pieces():
            nonlocal row
            for following in rows:
                if following[0][0] != name:
                    row = following
                    return
                yield following

        own = pieces()
        yield name, head, own
        for _ in own:
            pass


def _sections_again(form: str, pieces: Iterator[tuple]) -> Iterator[tuple[tuple, bytes]]:
    """((section, number), bytes) of output pieces in order: only the output's marks and the form tell the sections."""
    marks = {m.encode(): i for i, m in enumerate(MARKS)}
    section, i = 0, 0
    for _, piece in pieces:
        if form != "plain" and piece[:3] in marks:
            section, i, piece = marks[piece[:3]], 0, piece[3:]
        yield (section, i), piece
        i += 1


def _digest_outputs(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The digest of each output, in its head, and its pieces keyed by section."""
    for name, head, pieces in _documents(rows):
        seen = hashlib.sha256()

        def read():
            for key, piece in pieces:
                seen.update(piece)
                yield key, piece

        for key, piece in _sections_again(head[2], read()):
            yield (name, *key), piece
        yield (name, _HEAD, 0), (*head, seen.hexdigest())


def _digest_texts(rows: Iterator[tuple]) -> Iterator[tuple]:
    for _, head, pieces in _documents(rows):
        seen = hashlib.sha256()
        for _, piece in pieces:
            seen.update(piece)
        yield (*head, seen.hexdigest())


def _joined(rows: Iterator[tuple]) -> Iterator[tuple]:
    for _, head, pieces in _documents(rows):
        yield (*head, b"".join(piece for _, piece in pieces).decode())


def _partitions(docs: DataFrame, text_column: str) -> int:
    """Partitions for the pieces: those of the session, and more where they would hold over ``PARTITION_BYTES`` of text."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_column).cast("string")))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def _arranged(docs: DataFrame, partitions: int, rate: int, spm: int, seed: int, id_column: str, text_column: str) -> RDD:
    split = _output_pieces(rate, spm, seed)
    texts = docs.select(id_column, docs[text_column].cast("string").alias("text")).rdd
    return _sorted(texts.mapPartitions(lambda rows: _keyed(rows, split)), partitions)


def _schema(docs: DataFrame, id_column: str, *more: str) -> T.StructType:
    fields = T.StructType([T.StructField("id", docs.schema[id_column].dataType)])
    for f in T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long").fields:
        fields.add(f)
    for name in more:
        fields.add(name, T.StringType())
    return fields


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of each row: its text with the middle moved to the end.

    Of ``n`` lines, prefix and middle end after two drawn numbers. ``rate`` percent of the texts change, ``spm``
    percent of these put the suffix first; the draw is by id and ``seed`` alone. A null text is empty. Empty texts
    and those that hold a mark stay plain, with null sizes. Sizes are in code points. Repeated rows give repeated
    results; other columns are not read. A task holds one document's output at a time.
    """
    partitions = _partitions(docs, text_column)
    rows = _arranged(docs, partitions, rate, spm, seed, id_column, text_column).mapPartitions(_joined)
    return docs.sparkSession.createDataFrame(rows, _schema(docs, id_column, "output"))


def restored(outputs: DataFrame, id_column: str = "id", form_column: str = "form", output_column: str = "output") -> DataFrame:
    """(id, text): the texts from outputs and forms alone, as the rows of ``fill_in_middle`` hold them.

    A null output is empty, a null form plain. Outputs whose marks do not fit their form fail the job.
    """
    def split(row):
        output, form = row[1] or "", row[2] or "plain"
        if form not in ORDERS:
            raise ValueError(f"unknown form {form!r}")

        def pieces():
            rest, order = output, ORDERS[form] if form != "plain" else ()
            for section, following in zip(order, [*order[1:], None]):
                if not rest.startswith(MARKS[section]):
                    raise ValueError(f"the output of row {row[0]!r} does not fit its form")
                rest = rest[len(MARKS[section]):]
                end = len(rest) if following is None else rest.index(MARKS[following])
                for i, piece in enumerate(_pieces(rest[:end])):
                    yield (section, i), piece.encode()
                rest = rest[end:]
            if not order:
                for i, piece in enumerate(_pieces(rest)):
                    yield (0, i), piece.encode()

        return (row[0],), pieces()

    rows = outputs.select(id_column, output_column, form_column).rdd.mapPartitions(lambda rows: _keyed(rows, split))
    schema = T.StructType([T.StructField("id", outputs.schema[id_column].dataType), T.StructField("text", T.StringType())])
    return outputs.sparkSession.createDataFrame(_sorted(rows, _partitions(outputs, output_column)).mapPartitions(_joined), schema)


def digests(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of each row, as in ``fill_in_middle``.

    Digests grow piece by piece, so a task holds no whole output. The restored text comes from the output's
    pieces and form: they are keyed by section and sorted again in the partition where they are.
    """
    partitions = _partitions(docs, text_column)
    arranged = _arranged(docs, partitions, rate, spm, seed, id_column, text_column)
    outputs = arranged.mapPartitions(_digest_outputs, preservesPartitioning=True)
    texts = _sorted(outputs, partitions).mapPartitions(_digest_texts)
    return docs.sparkSession.createDataFrame(texts, _schema(docs, id_column, "output_sha256", "restored_sha256"))
