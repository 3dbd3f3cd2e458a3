"""Formatting of whole conversations with a compiled template, and reading them back.

Turns are dealt by conversation, sorted, and streamed through the template, so that no
conversation is gathered in memory. The output has a row for every ``part_chars`` characters
of a conversation, numbered; all but very long ones have one row.

Cases: null text and null role are empty; turns of equal number follow by role and text, null
turns come last; a null conversation id is a conversation of its own; repeated rows are
turns of their own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.llm.chat_template import Template, unescape, unescape_line

#: The production template. Only what an assistant says counts for the loss.
CHATML = """{% for m in messages %}<|im_start|>{{ m.role | escape_line }}
{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|im_end|>
{% endfor %}"""

_TURN = re.compile(r"<\|im_start\|>(?P<role>[^\n]*)\n(?P<text>.*?)<\|im_end\|>\n", re.S)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def format_conversations(turns: DataFrame, template: str = CHATML, part_chars: int = 4_000_000) -> DataFrame:
    """``turns``: conv_id, turn, role, text. Returns conv_id, part, text, loss: spans under the mask in this part."""
    Template(template)  # errors show here, not in a task
    clean = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = clean.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)

        def parts() -> Iterator[tuple]:
            for conv, rows in groupby(_rows(batches), lambda r: r[0]):
                part, out, loss, at = 0, [], [], 0
                for text, counts in compiled.pieces({"role": r[2], "text": r[3]} for r in rows):
                    if at and at + len(text) > part_chars:
                        yield conv, part, "".join(out), loss
                        part, out, loss, at = part + 1, [], [], 0
                    if counts and text:
                        loss.append({"start": at, "end": at + len(text)})
                    out.append(text)
                    at += len(text)
                yield conv, part, "".join(out), loss

        yield from _batches(parts(), [("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("loss", spans)], 2)

    return dealt.mapInArrow(run, "conv_id long, part long, text string, loss array<struct<start:long,end:long>>")


def _batches(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]], text: int | None = None, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of 2,000 rows, or of ``most`` characters in column ``text``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text]) if text is not None else 0
        if len(held) >= 2000 or size >= most:
            yield _batch(held, fields)
            held, size = [], 0
    if held:
        yield _batch(held, fields)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text says: see ``judged``. ``formatted`` as from ``format_conversations``, in its order."""
    fields = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[tuple]:
            for conv, parts in groupby(_rows(batches), lambda r: r[0]):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n = chars = total = 0
                rest = ""
                for _, _, text, spans in parts:
                    total += len(text)
                    for span in spans:
                        said = unescape(text[span["start"] : span["end"]])
                        chars += len(said)
                        loss.update(said.encode("utf-8", "surrogatepass"))
                    rest += text
                    end = 0
                    for m in _TURN.finditer(rest):
                        if m.start() != end:
                            raise ValueError(f"conversation {conv}: unexpected text between turns")
                        turns.update(f"{unescape_line(m['role'])}\n{unescape(m['text'])}\n".encode("utf-8", "surrogatepass"))
                        n, end = n + 1, m.end()
                    rest = rest[end:]
                if rest:
                    raise ValueError(f"conversation {conv}: a turn has no end")
                yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), total

        yield from _batches(conversations(), fields)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def judged(turns: DataFrame, **options) -> DataFrame:
    """A row a conversation, read back from its formatted text: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    return read_back(format_conversations(turns, **options))
