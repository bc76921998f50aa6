"""Sum-of-squares packing of token sequences.

Every document is encoded in Arrow batches and cut into pieces of at most ``capacity``
tokens. Pieces are then dealt by a hash into groups of about ``GROUP`` pieces, whose
number follows the input, and each group is packed on its own: a piece goes where the
sum of the squared numbers of open bins per residual gap becomes smallest, a new bin
being one of the choices. Only a piece's key and length enter the packing, so a group
is a bounded table of numbers. Bins that a group leaves less than ``FULL`` full are
opened again and their pieces packed together in a second round of the same kind.

The tokenizer drops white space before anything else, so its output for a text is the
concatenation of its output for the words; distinct words are encoded once in a worker
and their ids kept as bytes, up to ``KEEP`` words. Texts where that does not hold are
encoded whole.

Defined results: null or empty text is one piece that holds the end id alone; an empty
table gives an empty table; repeated rows are packed as often as they occur; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import cut
from .textnum import slices

GROUP = 50_000
FULL = 0.97
KEEP = 400_000
#: Letters of Latin-1 and ASCII signs, which are lower-cased one by one and composed already.
_PLAIN = re.compile(r"(?!.*<\|)[!-~À-ÖØ-öø-ÿ]+")
_CONTROL = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself where printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit bytes, word by word where white space parts words for the tokenizer.

    Words in plain letters are merged by a second, faster encoder that is given the same
    merges in the same order; its only difference is the end-of-word mark, here a zero
    byte joined to the last byte before all other merges. All other words, and files of
    another kind, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        whole = lambda t: self.model.encode(t, add_special_tokens=False).ids
        self.by_word = whole("Ab 'S c\n d1 2") == [i for w in ("Ab", "'S", "c", "d1", "2") for i in whole(w)]
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.fast = self.by_word and spec["model"].get("end_of_word_suffix") == "</w>" and [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and steps[0].get("invert") is True and "Regex" in steps[0].get("pattern", {})
        if self.fast:
            self.split = regex.compile(steps[0]["pattern"]["Regex"]).findall
            self.encoder, self.ids, self.ends = self._encoder(spec["model"])
            self.fast = all(self._fast([w])[w] == np.array(whole(w), "<u4").tobytes() for w in ("Hello", "l'été", "x1y2!!", "Straße,", "don't"))

    @staticmethod
    def _encoder(model: dict):
        import tiktoken

        letter = _byte_letters()
        byte = {c: b for b, c in letter.items()}
        joined = lambda t: bytes(byte[c] for c in t.removesuffix("</w>")) + (b"\0" if t.endswith("</w>") else b"")
        order = {bytes([b, 0]): letter[b] + "</w>" for b in range(1, 256)} | {bytes([b]): letter[b] for b in range(256)}
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            order.setdefault(joined(a) + joined(b), a + b)
        ids = np.array([model["vocab"].get(t, 0) for t in order.values()], "<u4")
        ends = np.array([len(t) > 1 and t[-1] == 0 for t in order])
        return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={}), ids, ends

    def _fast(self, words: list[str]) -> dict[str, bytes]:
        parts = [self.split(w.lower()) for w in words]
        ranks = np.array(self.encoder.encode_ordinary("".join(p + "\0" for s in parts for p in s)), np.int64)
        last = np.flatnonzero(self.ends[ranks]) + 1
        upto = np.concatenate([[0], last])[np.concatenate([[0], np.cumsum([len(s) for s in parts])])] * 4
        raw, at = self.ids[ranks].tobytes(), upto.tolist()
        return {w: raw[i:j] for w, i, j in zip(words, at[:-1], at[1:], strict=True)}

    def words(self, text: str) -> list[str]:
        # str.split() also parts at four control characters that the tokenizer keeps
        if not self.by_word or _CONTROL.search(text) or any(s in text for s in self.special):
            return [text]
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        new = (every := set().union(*split)).difference(self.known)
        if len(self.known) + len(new) > KEEP:
            self.known, new = {}, every
        plain = list(filter(_PLAIN.fullmatch, new)) if self.fast else []
        for at in range(0, len(plain), 20_000):
            self.known.update(self._fast(plain[at : at + 20_000]))
        for w in new.difference(plain):
            self.known[w] = np.array(self.model.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One encoder per worker process, which its tasks share with what it knows already."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str | Callable[[], str], capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, its ids followed by ``end_id``."""
    closing = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_ids(tokenizer() if callable(tokenizer) else tokenizer)
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                rows: list[tuple] = []
                for doc, ids in zip(b.column("id").to_pylist(), model.encode(["" if t is None else t for t in b.column("text").to_pylist()]), strict=True):
                    ids += closing
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc, k, k * capacity, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (b.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, taken longest first. Open bins are kept per residual gap; each step adds least to the sum of squared counts."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    where, offset, bins = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        # moving a bin from gap g to g - s adds 2 (count[g - s] - count[g]) + 2; one that fills leaves the count and adds 1 - 2 count[s]
        cost = np.where(count[s:] > 0, 2 * (count[: capacity - s + 1] - count[s:]) + 2, np.iinfo(np.int64).max)
        if count[s]:
            cost[0] = 1 - 2 * count[s]
        g = int(cost.argmin()) + s
        fresh = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if count[g] == 0 or fresh < cost[g - s]:
            b, g = bins, capacity
            bins += 1
        else:
            b = open_at[g].pop()
            count[g] -= 1
        where[i], offset[i] = b, capacity - g
        if g > s:
            open_at[g - s].append(b)
            count[g - s] += 1
    return where, offset


def _pack(rows: DataFrame, groups: int, capacity: int, round_no: int) -> DataFrame:
    """Adds sequence_id, offset and fill to rows, which are dealt into so many groups."""
    added = ("sequence_id", "offset", "fill")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"`{c}` long" for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or table.num_rows == 0:
            return
        table = table.sort_by([(c, "ascending") for c in table.column_names])
        lengths = table.column("length").to_numpy()
        where, offset = sum_of_squares(lengths, capacity)
        fill = np.bincount(where, lengths).astype(np.int64)[where]
        base = (round_no << 56) | (TaskContext.get().partitionId() << 32)
        for name, values in zip(added, (where + base, offset, fill), strict=True):
            table = table.append_column(name, pa.array(values, pa.int64()))
        yield from table.to_batches(max_chunksize=20_000)

    dealt = rows.withColumn("__deal", F.pmod(F.xxhash64(*rows.columns, F.lit(round_no)), F.lit(groups)).cast("int"))
    return dealt.repartitionById(groups, "__deal").drop("__deal").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str | Callable[[], str], capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document with the sequence that holds each and its place there."""
    cuts = cut(pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    n = cuts.count()
    first = cut(_pack(cuts, max(1, -(-n // GROUP)), capacity, 0))
    loose = F.col("fill") < int(FULL * capacity)
    again = first.where(loose).drop("sequence_id", "offset", "fill")
    m = again.count()
    second = _pack(again, max(1, -(-m // GROUP)), capacity, 1)
    return first.where(~loose).unionByName(second).drop("fill")
