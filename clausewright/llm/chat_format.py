"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its prefix and
only its text is trainable. ``expand`` writes every example out, prefix and target, so its
output grows with the square of a conversation's length, as that of the method does. An
example of more than ``PART_CHARS`` characters is written in parts of whole turns. A
conversation is read in order from sorted partitions; of its formatted text a task holds a
few parts, and the rest waits in a temporary file of the task, however long it is.

A turn is ``<|im_start|>role`` newline text ``<|im_end|>`` newline. Control strings inside
roles and texts, of this and other common templates, get a backslash behind their first
character, one more than they had, and lose it again when read back; roles have their
backslashes doubled and line breaks written as backslash n.

Defined results: null text and null role are empty; a null conversation id is a
conversation; turns are ordered by turn, then role, then text, so ties and repeated rows
are kept in a fixed order; turns behind the last reply, and conversations without one,
give parts without example; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from tempfile import SpooledTemporaryFile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
PART_CHARS = 1 << 20
#: Parts of the last example that ``digests`` keeps to compare; no result depends on it.
KEPT = 16
_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_REST})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_REST})")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text) if "\\" in text else text


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text begins and ends there."""
    head, body = f"{OPEN}{_role(role)}\n", escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn; the inverse of ``format_turn``."""
    turns = (turn.removeprefix(OPEN).partition("\n") for turn in formatted.split(f"{CLOSE}\n")[:-1])
    return [(_unrole(role), unescape(text)) for role, _, text in turns]


class Context:
    """The formatted turns of a conversation so far, in parts of whole turns."""

    def __init__(self, part_chars: int):
        self.part_chars, self.chars = part_chars, 0
        self.open, self.open_chars, self.sizes, self.file = [], 0, [], None

    def add(self, shown: str) -> None:
        self.chars += len(shown)
        self.open.append(shown)
        self.open_chars += len(shown)
        if self.open_chars > self.part_chars:
            self.file = self.file or SpooledTemporaryFile(8 * self.part_chars)
            self.file.seek(0, 2)
            self.sizes.append(self.file.write("".join(self.open).encode()))
            self.open, self.open_chars = [], 0

    def parts(self, start: int = 0) -> Iterator[tuple[int, str]]:
        """(characters before it, text) of every part, from the turn that begins at ``start``."""
        at = 0
        if self.sizes:
            self.file.seek(0)
        for size in self.sizes:
            text = self.file.read(size).decode()
            if at + len(text) > start:
                yield max(at, start), text[max(start - at, 0) :]
            at += len(text)
        if self.chars > max(at, start):
            self.open = ["".join(self.open)]
            yield max(at, start), self.open[0][max(start - at, 0) :]


def expand(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant", part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, example, prefix_chars, text, loss_start, loss_end): every whole example, and then the turns behind the last one.

    An example is its parts, numbered from 0, one after the other; mostly it has one. ``prefix_chars``
    is the number of code points of the conversation before the part, the loss span counts them from
    the start of the example. ``example`` is null for turns that no example holds. Rows of a
    conversation stay together in one partition, in order. No digest and no whole example depends
    on ``part_chars``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        conv, example, told, upto = None, 0, None, 0
        rows: list[tuple] = []
        size = 0

        def close(example: int | None, start: int, span: tuple) -> Iterator[pa.RecordBatch]:
            nonlocal size
            for part, (before, text) in enumerate(told.parts(start)):
                rows.append((conv, part, example, before, text, *span))
                size += len(text)
                if size > 8 * part_chars:
                    yield flush()

        def flush() -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
            rows.clear()
            size = 0
            return batch

        for b in batches:
            schema = schema or pa.schema([("conv_id", b.schema.field("conv_id").type), ("part", pa.int64()), ("example", pa.int64()), ("prefix_chars", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
            for c, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if told is None or c != conv:
                    if told is not None:
                        yield from close(None, upto, (None, None))
                    conv, example, told, upto = c, 0, Context(part_chars), 0
                shown, start, end = format_turn(role, text)
                before = told.chars
                told.add(shown)
                if role == target:
                    yield from close(example, 0, (before + start, before + end))
                    example, upto = example + 1, told.chars
        if told is not None:
            yield from close(None, upto, (None, None))
        if rows:
            yield flush()

    kind = conversations.schema[conv_col].dataType.simpleString()
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, part long, example long, prefix_chars long, text string, loss_start long, loss_end long").withColumnRenamed("conv_id", conv_col)


def materialize(parts: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end) with the parts of an example in one text."""
    whole = parts.where("example is not null").groupBy(conv_col, "example", "loss_start", "loss_end").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("x"))
    return whole.select(conv_col, "example", F.concat_ws("", F.transform("x", lambda s: s["text"])).alias("text"), "loss_start", "loss_end")


def digests(parts: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What reading the examples back gives, per conversation; rows come as ``expand`` leaves them.

    Every example is read from its first part to its last; what equals the beginning of the same part
    of the last example is compared and not parsed again. The turns are those of the last example,
    which holds all others, and what follows it; the loss is that of each example.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, known = None, False
        kind = None

        def end() -> None:
            if known:
                out.append((conv, turns, all_hash.hexdigest(), loss, loss_hash.hexdigest(), chars, examples))

        def flush() -> pa.RecordBatch:
            types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"])
            out.clear()
            return batch

        for b in batches:
            kind = b.schema.field("conv_id").type
            for c, part, example, prefix, text, start, stop in zip(*(b.column(x).to_pylist() for x in ("conv_id", "part", "example", "prefix_chars", "text", "loss_start", "loss_end")), strict=True):
                if not known or c != conv:
                    end()
                    conv, known, turns, all_hash, loss, loss_hash, chars, examples, seen = c, True, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, []
                if example is not None and part == 0:
                    turns, all_hash, examples = 0, hashlib.sha256(), examples + 1
                fresh = text
                if example is not None and part < len(seen) and text.startswith(seen[part][0]):
                    old, turns, all_hash = seen[part]
                    all_hash, fresh = all_hash.copy(), text[len(old) :]
                for role, said in read_turns(fresh):
                    turns += 1
                    all_hash.update(f"{role}\n{said}\n".encode())
                if example is not None and fresh and part < KEPT:
                    seen[part:] = [(text, turns, all_hash.copy())]
                chars += len(text)
                if example is not None and prefix <= start < prefix + len(text):  # a reply ends in the part where it begins
                    reply = unescape(text[start - prefix : stop - prefix])
                    loss += len(reply)
                    loss_hash.update(reply.encode())
            if len(out) > 5000:
                yield flush()
        end()
        if out:
            yield flush()

    kind = parts.schema[conv_col].dataType.simpleString()
    return parts.select(F.col(conv_col).alias("conv_id"), "part", "example", "prefix_chars", "text", "loss_start", "loss_end").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long").withColumnRenamed("conv_id", conv_col)
