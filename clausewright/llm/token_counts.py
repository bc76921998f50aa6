"""Token counts: batch encoding in Arrow functions that return lengths only.

The texts of an Arrow batch are split at safe boundaries, the distinct parts are
encoded together in calls balanced by bytes, and each text's length is the sum over
its parts. A boundary is safe when no entry of the vocabulary crosses it, so that the
tokenizer can merge nothing over it; this is read from the vocabulary when a worker
loads it, not assumed. Parts recur, so lengths already known to a worker are kept, up
to ``KEEP`` parts. No ids, and no more than one batch, are held.

Defined results: null text counts as empty (0 bytes, 0 tokens); an empty table gives
an empty table; repeated rows give repeated rows; columns of ``docs`` other than the
id and the text are ignored unless named in ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import slices

SPACE = "▁"
KEEP = 600_000
CALL_BYTES = 1 << 18


class PieceLengths:
    """Lengths by a sentencepiece model file (.model)."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        # spaces are kept as they are, and no character is rewritten: a ligature, a full-width letter and a loose accent come back
        spaced = [self.model.encode(t, out_type=str) for t in ("a  b", " a")]
        same = all(self.model.decode(self.model.encode(t)) == t for t in ("ﬁ", "Ａ", "e\u0301", "①", "a\u00a0b", "x\ty"))
        self.splits = same and not any(SPACE in p.lstrip(SPACE) for p in plain) and spaced == [self.model.encode("a", out_type=str) + [SPACE, SPACE + "b"], [SPACE, SPACE + "a"]]
        self.known: dict[str, int] = {"": 0}

    def parts(self, text: str) -> list[str]:
        """The words, each as if the space before it were the mark that the model itself puts before a text.

        Runs of spaces stay with the word behind them, less one space.
        """
        if not self.splits or not text:
            return [text]
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [p[1:] or SPACE for p in re.findall(r" +[^ ]*", " " + text)]
        return text.split(" ")

    def measure(self, parts: list[str]) -> None:
        if self.splits:
            # a lone space is the model's own mark, which it leaves out before an empty text
            parts = [p for p in parts if p != SPACE]
            self.known[SPACE] = 1
        for p, ids in zip(parts, self.model.encode(parts, num_threads=1), strict=True):
            self.known[p] = len(ids)


class JsonLengths:
    """Lengths by a tokenizers file (.json); texts are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.known: dict[str, int] = {"": 0}

    def parts(self, text: str) -> list[str]:
        return [text]

    def measure(self, parts: list[str]) -> None:
        for p, e in zip(parts, self.model.encode_batch(parts, add_special_tokens=False), strict=True):
            self.known[p] = len(e)


@lru_cache(maxsize=1)
def lengths_for(path: str) -> PieceLengths | JsonLengths:
    """One model per worker process, which its tasks share with what it knows already."""
    return PieceLengths(path) if path.endswith(".model") else JsonLengths(path)


def calls(parts: list[str], most: int = CALL_BYTES) -> Iterator[list[str]]:
    """Calls of about equal bytes: longest first, each call closed when it holds ``most``."""
    call, size = [], 0
    for p in sorted(parts, key=len, reverse=True):
        call.append(p)
        size += len(p)
        if size >= most:
            yield call
            call, size = [], 0
    if call:
        yield call


def count_texts(model: PieceLengths | JsonLengths, texts: list[str]) -> list[int]:
    split = [model.parts(t) for t in texts]
    every = set().union(*split)
    new = every.difference(model.known)
    if len(model.known) + len(new) > KEEP:
        model.known = {"": 0}
        new = every - {""}
    for call in calls(list(new)):
        model.measure(call)
    get = model.known.__getitem__
    return [sum(map(get, s)) for s in split]


def token_counts(docs: DataFrame, tokenizer: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``; ``tokenizer`` is the vocabulary file's path, or a function that finds it on a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lengths_for(tokenizer() if callable(tokenizer) else tokenizer)
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                n = count_texts(model, ["" if t is None else t for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
