"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds hashes of its distinct k-word shingles. Documents with equal sets
are one node, named by a 64-bit hash of the set, before anything is paired.

1. Shards. Each map task reads whole texts and deals the shingles of its nodes into
   shards by hash, 40 bits a shingle within a shard, packed per task and shard. A shard
   sees every node of its shingles, so it knows their document frequencies; it returns
   only shingles that two or more nodes share, with their frequency class.
2. Profiles. The returns of a node meet. Shingles that no other node has come first in
   rare-first order and need no index; a node whose shared shingles are too few to reach
   the threshold with anyone ends here. The others keep their shared shingles in order.
3. Pairs. The prefix of a profile, less its unshared part, is posted by shingle. Nodes
   that share a prefix shingle are candidates if they pass the length filter, the
   positional filter (what can still match behind the shingle) and the suffix filter
   (shingles of one that cannot be in the other, by the marks that they leave in bitmaps
   of ``MARKS`` words). Nodes meet by shingle and size class, within the sizes that
   their shared shingles allow; each pair is verified once.
4. Links within a group of copies would be quadratic, while the answer is the component.
   So rounds come first, in which every shingle has one hub, at first the node with the
   fewest shingles of its own, later any, and each node is verified with the hubs that
   share most of its prefix. Rounds go on while the pairs of different components that
   share a prefix shingle are more than ``FEW`` times the postings and still become
   fewer. All pairs of different components that are left are then verified, so the
   rounds save work and decide nothing.

Sizes: a shard holds about the corpus's shingles over the number of shuffle partitions,
which should grow with the corpus; a shingle costs a shard about 6 bytes per node.

Defined results: texts without words, and null texts, have an empty set and link with
nothing; a text with fewer than k words is one shingle; repeated rows, and repeated ids
with different texts, are rows of their own; a row without id has a component only
through others; an empty table gives an empty table; other columns are ignored, and kept
by ``keep``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spark_io import HOT, connected_components, cut, joined_with_hot_keys, shuffle_partitions, written
from .textnum import mix, release, shingle_sets, slices

FLUSH = 2_000_000
LOW = np.uint64((1 << 40) - 1)
MARKS = 16
CLASS = 1.03
ROUNDS, HUBS, FEW = 12, 1, 1.0
SPLIT = 1000
_FIELDS = "part int, kind int, doc long, node long, n long, shard int, blob binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("doc", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("shard", pa.int32()), ("blob", pa.binary())])
MEMBER, SIZE, BLOB = 0, 1, 2


def _rows(kind: int, part, doc=None, node=None, n=None, shard=None, blob=None) -> pa.RecordBatch:
    m = len(part)
    make = lambda x, t: pa.nulls(m, t) if x is None else pa.array(x, t) if not isinstance(x, pa.Array) else x
    return pa.RecordBatch.from_arrays([make(part, pa.int32()), pa.array(np.full(m, kind, np.int32)), make(doc, pa.int64()), make(node, pa.int64()), make(n, pa.int64()), make(shard, pa.int32()), make(blob, pa.binary())], schema=_SCHEMA)


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view("<u8").ravel()


def _pack(groups: np.ndarray, nodes: np.ndarray, tokens: np.ndarray, classes: np.ndarray | None) -> Iterator[tuple[int, bytes]]:
    """One blob per group: number of runs, their nodes and lengths, 40-bit tokens, classes. Rows come sorted by group, then node."""
    edge = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]])) if len(groups) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        at = np.flatnonzero(np.concatenate([[True], nodes[a + 1 : b] != nodes[a : b - 1], [True]]))
        parts = [np.array([len(at) - 1], "<i8").tobytes(), nodes[a:b][at[:-1]].astype("<u8").tobytes(), np.diff(at).astype("<i4").tobytes(), _five(tokens[a:b])]
        yield int(groups[a]), b"".join(parts if classes is None else [*parts, classes[a:b].astype(np.uint8).tobytes()])


def _unpack(blob: bytes, with_class: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(blob, np.uint8)
    runs = int(raw[:8].view("<i8")[0])
    nodes, counts = raw[8 : 8 + 8 * runs].view("<u8"), raw[8 + 8 * runs : 8 + 12 * runs].view("<i4")
    m, at = int(counts.sum()), 8 + 12 * runs
    return np.repeat(nodes, counts), _from_five(raw[at : at + 5 * m]), raw[at + 5 * m :] if with_class else np.zeros(0, np.uint8)


def _deal(k: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            nodes = np.fromiter(held, np.uint64, len(held))
            lengths = np.array([len(v) for v in held.values()])
            tokens, of = np.concatenate(list(held.values())), np.repeat(nodes, lengths)
            yield _rows(SIZE, (mix(nodes) % np.uint64(parts)).astype(np.int32), node=nodes.view(np.int64), n=lengths)
            shard = ((tokens >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            for s, blob in _pack(shard[order], of[order], tokens[order] & LOW, None):
                yield _rows(BLOB, [s], shard=[s], blob=[blob])
            held.clear()

        for whole in batches:
            for b in slices(whole, "text"):
                hashes, at = shingle_sets(b.column("text"), k)
                n = np.diff(at)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
                name = mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64))
                doc = b.column("doc")
                where = mix(np.arange(len(n)).astype(np.uint64) + name) % np.uint64(parts)
                yield _rows(MEMBER, where.astype(np.int32), doc=doc, node=pa.array(name.view(np.int64), mask=n == 0), n=n, blob=b.column("key").cast(pa.binary()))
                for i in np.flatnonzero(n):
                    if (v := int(name[i])) not in held:
                        held[v] = hashes[at[i] : at[i + 1]]
                        size += int(n[i])
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()
        release()

    return run


def _shards(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            kind = b.column("kind").to_numpy()
            if (kind != BLOB).any():
                yield b.filter(pa.array(kind != BLOB))
            own = b.filter(pa.array(kind == BLOB))
            for s, blob in zip(own.column("shard").to_pylist(), own.column("blob"), strict=True):
                blobs.setdefault(s, []).append(_unpack(blob.as_buffer(), False)[:2])
        for s in list(blobs):
            got = blobs.pop(s)
            nodes, tokens = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
            del got
            order = np.argsort(tokens, kind="stable")
            tokens, nodes = tokens[order], nodes[order]
            # only runs of equal tokens matter further
            same = tokens[1:] == tokens[:-1]
            shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            tokens, nodes = tokens[shared], nodes[shared]
            order = np.lexsort((nodes, tokens))
            tokens, nodes = tokens[order], nodes[order]
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
            tokens, nodes = tokens[new], nodes[new]
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
            count = np.diff(np.concatenate([first, [len(tokens)]]))
            df = np.repeat(count, count)
            tokens, nodes, df = tokens[df > 1], nodes[df > 1], df[df > 1]
            level = np.minimum(255, np.log2(np.maximum(df, 1)) * 8).astype(np.uint8)
            bucket = (mix(nodes) % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((nodes, bucket))
            for p, blob in _pack(bucket[order], nodes[order], tokens[order], level[order]):
                yield _rows(BLOB, [p], shard=[s], blob=[blob])
        release()

    return run


_PROFILE = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("doc", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64()))])


def _profiles(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple[np.ndarray, ...]] = []
        sizes: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            kind = b.column("kind").to_numpy()
            if (own := b.filter(pa.array(kind == MEMBER))).num_rows:
                yield pa.RecordBatch.from_arrays([own.column("kind"), own.column("blob"), own.column("doc"), own.column("node"), own.column("n"), pa.nulls(own.num_rows, pa.list_(pa.int64())), pa.nulls(own.num_rows, pa.list_(pa.int64()))], schema=_PROFILE)
            own = b.filter(pa.array(kind == SIZE))
            sizes.append((own.column("node").to_numpy().view(np.uint64), own.column("n").to_numpy()))
            own = b.filter(pa.array(kind == BLOB))
            for s, blob in zip(own.column("shard").to_pylist(), own.column("blob"), strict=True):
                nodes, tokens, level = _unpack(blob.as_buffer(), True)
                got.append((nodes, tokens | np.uint64(s << 40), level))
        if not got:
            return
        names, at = np.unique(np.concatenate([x[0] for x in sizes]), return_index=True)
        lengths = np.concatenate([x[1] for x in sizes])[at]
        nodes, tokens, level = (np.concatenate([x[i] for x in got]) for i in range(3))
        which = np.searchsorted(names, nodes)
        shared = np.bincount(which, minlength=len(names))
        keep = shared * den >= lengths * num
        kept = keep[which]
        which, tokens, level = which[kept], tokens[kept], level[kept]
        order = np.lexsort((tokens, level, which))
        tokens = tokens[order].view(np.int64)
        begin = np.concatenate([[0], np.cumsum(shared[keep])])
        marks = np.zeros((int(keep.sum()), MARKS), np.uint64)
        bit = mix(tokens.view(np.uint64)) % np.uint64(64 * MARKS)
        np.bitwise_or.at(marks, (np.repeat(np.arange(len(marks)), shared[keep]), (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
        marks = marks.view(np.int64).ravel()
        for a in range(0, int(keep.sum()), 500):
            m = min(500, int(keep.sum()) - a)
            lists = pa.ListArray.from_arrays(pa.array((begin[a : a + m + 1] - begin[a]).astype(np.int32)), pa.array(tokens[begin[a] : begin[a + m]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, SIZE, np.int32)), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.array(names[keep][a : a + m].view(np.int64)), pa.array(lengths[keep][a : a + m]), lists, pa.ListArray.from_arrays(pa.array(np.arange(0, MARKS * m + 1, MARKS, dtype=np.int32)), pa.array(marks[MARKS * a : MARKS * (a + m)]))], schema=_PROFILE)
        release()

    return run


def profiles(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, key: Column | None = None) -> DataFrame:
    """Members (kind 0: key, doc, node, n) and the nodes that share enough (kind 1: node, n, shared shingles rare-first)."""
    parts = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), (F.lit(None) if key is None else key).cast("binary").alias("key"))
    dealt = rows.mapInArrow(_deal(k, parts), _FIELDS).repartitionById(parts, "part")
    back = dealt.mapInArrow(_shards(parts), _FIELDS).repartitionById(parts, "part")
    return written(back.mapInArrow(_profiles(num, den), "kind int, key binary, doc long, node long, n long, tokens array<long>, marks array<long>"))


def _least(x: Column, y: Column, num: int, den: int) -> Column:
    """What sets of these sizes must share to reach the threshold."""
    return F.ceil((x + y) * num / (num + den))


def _may_share(m: Column, marks: Column, other: Column) -> Column:
    """An upper bound of what a node's m shared shingles can have in common with another's: each mark that the other lacks is one shingle or more that it lacks."""
    lacking = F.lit(0)
    for i in range(MARKS):
        lacking = lacking + F.bit_count(marks[i].bitwiseAND(F.bitwise_not(other[i])))
    return m - lacking


def _bounded(x: str, y: str, num: int, den: int) -> Column:
    """The length filter and the suffix filter on columns n, m and marks of two nodes."""
    c = lambda s, name: F.col(f"{s}_{name}")
    length = den * F.least(c(x, "n"), c(y, "n")) >= num * F.greatest(c(x, "n"), c(y, "n"))
    share = F.least(_may_share(c(x, "m"), c(x, "marks"), c(y, "marks")), _may_share(c(y, "m"), c(y, "marks"), c(x, "marks")))
    return length & (share >= _least(c(x, "n"), c(y, "n"), num, den))


def _verified(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the threshold; unshared shingles count in the union alone."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("same", F.size(F.array_intersect("t_a", "t_b")))
    return both.where(den * F.col("same") >= num * (F.col("n_a") + F.col("n_b") - F.col("same"))).select("a", "b")


def _merged(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, comp) after the links (a, b): only the components that links join are looked at again."""
    of = lambda x: comp.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
    links = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = connected_components(links).select(F.col("node").alias("comp"), "root")
    return cut(comp.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))


def components(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root) of all nodes; linked nodes share a root.

    The nodes are kept partitioned by name, so that what is joined to them moves and they do not.
    """
    nodes = nodes.withColumn("m", F.size("tokens")).repartition(shuffle_partitions(nodes.sparkSession), "node").persist(StorageLevel.MEMORY_AND_DISK)
    need = lambda n: F.ceil(n * num / den).cast("int")
    small = lambda x: nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "m", "marks")))
    # a prefix is the first n - ceil(t n) + 1 shingles, of which the unshared n - size(tokens) come first
    head = F.slice("tokens", 1, F.size("tokens") - need(F.col("n")) + 1)
    slim = written(nodes.select("node", ((F.col("n") - F.size("tokens")) / F.col("n")).alias("alone"), F.posexplode(head).alias("pos", "token")))
    size = slim.count()
    comp = cut(nodes.select("node", F.col("node").alias("comp")))
    tried = cut(slim.where("false").select(F.col("node").alias("a"), F.col("node").alias("b")))
    before, idle = None, 0
    for turn in range(ROUNDS):
        here = slim.join(comp, "node")
        load = here.groupBy("token", "comp").agg(F.count("*").alias("c"))
        mixed = cut(load.groupBy("token").agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("q")).where("t * t > q").select("token", F.col("t").alias("load"), ((F.col("t") * F.col("t") - F.col("q")) / 2).alias("cross")))
        cross, left = mixed.agg(F.coalesce(F.sum("cross"), F.lit(0.0)), F.coalesce(F.sum("load"), F.lit(0))).head()
        # components only grow, so a shingle within one component is done with for good
        live = written(joined_with_hot_keys(here, mixed.select("token", "load"), "token", left).select("token", "node", "pos", "alone", "comp"))
        slim = live.drop("comp")
        idle = idle + 1 if before is not None and cross > 0.9 * before else 0
        if cross <= FEW * size or idle >= 1:
            break
        before = cross
        # first the node that has least of its own, then any
        order = F.struct("alone", "node") if turn == 0 else F.struct(F.xxhash64("node", "token", F.lit(turn)), "node")
        hubs = cut(live.groupBy("token").agg(F.min_by(F.struct("node", "comp"), order).alias("hub"), F.count("*").alias("load")).select("token", F.col("hub.node").alias("b"), F.col("hub.comp").alias("b_comp"), "load"))
        near = joined_with_hot_keys(live, hubs, "token", left).where("comp <> b_comp").groupBy("node", "b").agg(F.count("*").alias("c"))
        near = near.withColumn("rn", F.row_number().over(W.partitionBy("node").orderBy(F.desc("c"), "b"))).where(F.col("rn") <= HUBS)
        pairs = near.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        pairs = cut(pairs.join(tried, ["a", "b"], "left_anti").join(small("a"), "a").join(small("b"), "b").where(_bounded("a", "b", num, den)).select("a", "b"))
        tried = tried.unionAll(pairs)
        comp = _merged(comp, _verified(pairs, nodes, num, den))
    here = slim.join(comp, "node")
    load = here.groupBy("token", "comp").agg(F.count("*").alias("c"))
    mixed = cut(load.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("c").alias("load")).where("comps > 1").select("token", "main", "load"))
    left = mixed.agg(F.coalesce(F.sum("load"), F.lit(0))).head()[0]
    # the postings of a shingle are met in splits of about SPLIT rows, or of a HOT of all where that is more
    splits = F.ceil(F.col("load") / max(SPLIT, left / HOT)).cast("int").alias("splits")
    live = joined_with_hot_keys(here, mixed.select("token", "main", splits, "load"), "token", left).join(nodes.select("node", "n", "m", "marks"), "node")
    # the most that a partner's size may be, with no more in common than the m shared shingles
    live = live.withColumn("most", F.floor(F.col("m") * (num + den) / num) - F.col("n")).drop("alone")
    size_class = lambda n: F.floor(F.log(n) / math.log(CLASS)).cast("int")
    index = live.withColumn("class", size_class(F.col("n")))
    probe = live.withColumn("class", F.explode(F.sequence(size_class(need(F.col("n"))), size_class(F.greatest(F.lit(1), need(F.col("n")), F.least("n", "most"))))))
    out_of_main = F.col("comp") != F.col("main")

    def met(larger: DataFrame, smaller: DataFrame, spread: str) -> DataFrame:
        """Pairs across components; the side ``spread`` is dealt over a shingle's splits, and the other is copied to each of them."""
        dealt, copied = F.pmod(F.xxhash64("node", F.lit(3)), F.col("splits")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1))
        larger, smaller = (d.withColumn("split", dealt if s == spread else copied) for d, s in ((larger, "x"), (smaller, "y")))
        x, y = (d.select("token", "class", "split", *(F.col(c).alias(f"{s}_{c}") for c in ("node", "pos", "comp", "n", "m", "marks", "most"))) for d, s in ((larger, "x"), (smaller, "y")))
        sizes = (F.col("y_n") <= F.least("x_n", "x_most")) & (F.col("x_n") <= F.col("y_most"))
        # what stands behind this shingle in each, and the shingles before it in the shorter part
        position = F.least(F.col("x_m") - F.col("x_pos"), F.col("y_m") - F.col("y_pos")) + F.least("x_pos", "y_pos") >= _least(F.col("x_n"), F.col("y_n"), num, den)
        return x.join(y, ["token", "class", "split"]).where((F.col("x_comp") != F.col("y_comp")) & sizes & position & _bounded("x", "y", num, den)).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))

    # two nodes of a shingle's main component need not meet
    pairs = met(probe.where(out_of_main), index, "y").unionAll(met(probe, index.where(out_of_main), "x")).distinct()
    pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"))
    out = _merged(comp, _verified(pairs, nodes, num, den)).withColumnRenamed("comp", "root")
    nodes.unpersist()
    return out


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 3, den: int = 4, key: Column | None = None) -> DataFrame:
    """(key, doc, n, group, component_id) for every row: ``key`` as given, the size of its set, and the name of its component, null for an empty set."""
    rows = profiles(docs, id_col, text_col, k, num, den, key)
    members = rows.where(F.col("kind") == MEMBER).select("key", "doc", "node", "n")
    roots = components(rows.where(F.col("kind") == SIZE).select("node", "n", "tokens", "marks"), num, den)
    least = members.where("node is not null").groupBy("node").agg(F.min("doc").alias("low"), F.count("*").alias("load"))
    placed = cut(least.join(roots, "node", "left").select("node", "low", "load", F.coalesce("root", "node").alias("group")))
    per = cut(placed.groupBy("group").agg(F.min("low").alias("component_id"), F.count("*").alias("load")))
    nodes, total = placed.agg(F.count("*"), F.coalesce(F.sum("load"), F.lit(0))).head()
    named = joined_with_hot_keys(placed.withColumnRenamed("load", "members"), per, "group", nodes).select("node", "group", "component_id", F.col("members").alias("load"))
    out = joined_with_hot_keys(members, named, "node", total, "left")
    return out.select("key", "doc", "n", "group", F.coalesce("component_id", "doc").alias("component_id"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """(id, n_shingles, component_id) for every row; documents link at Jaccard similarity num / den or more."""
    return groups(docs, id_col, text_col, k, num, den).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """One row of each component, that with the smallest id, with all its columns; rows with empty sets all stay.

    A row is told by its id and two hashes of its text, so ids may repeat. Texts are shuffled once, by that.
    """
    text, ident = F.col(text_col), F.col(id_col).cast("long")
    key = F.to_binary(F.concat(*(F.lpad(F.hex(F.xxhash64(*x)), 16, "0") for x in ((F.lit(1), F.isnull(ident), ident, text), (text, F.lit(2), ident)))), F.lit("hex"))
    found = written(groups(docs, id_col, text_col, k, num, den, key))
    first = found.where("group is not null").groupBy("group").agg(F.min(F.struct(F.isnull("doc").alias("none"), "doc", "key")).alias("row"))
    stay = first.select("row.key").withColumn("once", F.lit(True)).unionAll(found.where("group is null").select("key", F.lit(False).alias("once")).distinct())
    every = docs.select(F.struct("*").alias("row"), key.alias("key")).join(stay, "key")
    # equal rows stand together after the join; those with empty sets are told apart
    apart = every.withColumn("other", F.when(F.col("once"), F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    return apart.dropDuplicates(["key", "other"]).select("row.*")
