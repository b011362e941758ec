"""N-gram Jaccard join by token-combination prefixes.

A text's set holds its distinct 5-word shingles as 64-bit hashes. Texts with one set form a
class, known by a hash of the set, and only classes are joined. Two classes link when
``100 * |intersection| >= 80 * |union|``; a set of n shingles may then miss at most
``e = n - ceil(0.8 n)`` shingles of its partner.

1. Pool: shingles whose hash lies in the lowest ``POOL`` of all hashes. Every set sends its pool
   shingles (and its next lowest hashes where the pool holds fewer than its prefix needs), and
   one aggregation counts exactly how many sets hold each. This gives one global order: pool
   shingles by count, then the others by hash. A shingle that one class alone holds comes first and
   can never be shared, so it takes its place in the prefix but is not sent on.
2. Prefixes: the first common shingle of two partners lies among the first e + 1 of both, their
   first p + 1 common ones among the first e + p + 1. Rare shingles of the first are indexed singly.
   Frequent ones (a count of ``rare`` or more, and all outside the pool) are indexed as pairs: hashes
   divide them into p parts, and of p + 1 shingles two lie in one part, so pairs inside parts are
   enough. With p in proportion to the size of the smaller partner, a set of any size has
   about 0.6 n pairs. A set indexes with the p of both sizes that a smaller partner may fall in.
3. Hubs: of each index entry, every class is compared with the least. Entries whose classes
   are connected by such links are done.
4. The others are gathered into groups that share entries, and a group is compared block by block
   inside tasks: a bound from bitmaps of 1024 bits, then the exact count of common shingles. Classes
   already connected are not compared again, and a block hands on at most a tree of new
   links. Of a group, classes outside its largest component are dealt to all blocks, those inside it
   only to blocks with the former. So components are exact, and no group is expanded into pairs.

Nulls: a null text has an empty set and stays alone; a null id is ignored in the minimum, and
a component of null ids has a null id. Repeated rows and ids each get their row. Texts of
fewer than five words have one shingle, the whole sequence. An empty table gives an empty
result. Memory follows the block size or the longest text. The one table broadcast is a bitmap of at
most ``2**MARK_BITS`` bits (8 MB); it only saves sending sets that nothing asks for. Of two different
sets with one 64-bit hash the smaller would be lost; below 10**8 documents the chance of any is under
one in 3,000.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.llm.arrays import WORDS, Text, blocks, mix, prefix_sums, span_hashes, tidy, utf8, windows
from strandmill.operators.graph import connected_components
from strandmill.session import discard, durable, ship, table

WIDTH = 5
#: Share of all hashes that is counted.
POOL = 0.3
#: Shingles of fewer sets are indexed singly.
RARE = 16
#: A part of frequent shingles for so many shingles of a set.
PART = 20
SKETCH_BITS = 1024
#: Shingles that are made into index entries at once.
STEP = 50_000
MARK_BITS = 26
#: Classes and bytes of a block of a group.
BLOCK_ROWS, BLOCK_BYTES = 2048, 16 << 20


def _spread(n: np.ndarray) -> np.ndarray:
    return n - (4 * n + 4) // 5


def _parts(n: np.ndarray) -> np.ndarray:
    """Parts of the frequent shingles for a smaller partner of ``n`` shingles, the same between powers of two."""
    octave = 1 << np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    return np.maximum(1, octave // PART)


def _need(n: np.ndarray) -> np.ndarray:
    return _spread(n) + _parts(n) + 1


class Sets:
    """Shingle sets of a block of texts, sorted by text and hash."""

    def __init__(self, data: np.ndarray, off: np.ndarray, width: int = WIDTH):
        text = Text(data, off, lower=True)
        hashes, words = text.word_hashes(), text.counts()
        first, found = windows(hashes, text.doc, width)
        doc = text.doc[first]
        few = np.flatnonzero((words > 0) & (words < width))
        if len(few):
            begin = np.searchsorted(text.doc, few)
            whole = span_hashes(prefix_sums(hashes, WORDS), WORDS, begin, begin + words[few])
            doc, found = np.concatenate([doc, few]), np.concatenate([found, whole])
        order = np.argsort(found)
        doc, found = doc[order], found[order]
        order = np.argsort(doc.astype(np.uint16) if text.n < 65536 else doc, kind="stable")
        doc, found = doc[order], found[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
        self.doc, self.hash = doc[new], found[new]
        self.n = np.bincount(self.doc, minlength=text.n)
        self.off = np.concatenate([[0], np.cumsum(self.n)])
        mark = span_hashes(prefix_sums(self.hash, WORDS), WORDS, self.off[:-1], self.off[1:])
        self.ref = mark.view(np.int64)

    def only(self, keep: np.ndarray) -> Sets:
        """The sets of the texts marked in ``keep``."""
        out = object.__new__(Sets)
        inside = np.repeat(keep, self.n)
        out.hash, out.n, out.ref = self.hash[inside], self.n[keep], self.ref[keep]
        out.off = np.concatenate([[0], np.cumsum(out.n)])
        out.doc = np.repeat(np.arange(len(out.n)), out.n)
        return out

    def fresh(self, seen: np.ndarray) -> Sets:
        """The sets that ``seen``, a table of fixed size, does not hold; repeats that it has forgotten do no harm."""
        keep = np.zeros(len(self.n), bool)
        for i in np.flatnonzero(self.n).tolist():
            at = self.ref[i] & (len(seen) - 1)
            keep[i] = seen[at] != self.ref[i]
            seen[at] = self.ref[i]
        return self.only(keep)

    def in_pool(self) -> np.ndarray:
        return self.hash < np.uint64(int(POOL * 2**64))


def _each_sets(df: DataFrame, text: str, schema: str, make: Callable[[Sets], pa.RecordBatch | None]) -> DataFrame:
    """Run ``make`` over the sets of each block of texts, most repeats in a task left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in blocks(batch, text):
                made = make(Sets(*utf8(part.column(0))).fresh(seen))
                if made is not None and made.num_rows:
                    yield made

    return df.select(text).mapInArrow(tidy(run), schema)


def classes_of(df: DataFrame, keep: list[str], text: str, names: tuple[str, str, str] = ("n_shingles", "ref", "pooled")) -> DataFrame:
    """``keep`` of every row with the size of its set, the hash of its set (null if empty) and how many of its shingles lie in the pool."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(x, T.LongType()) for x in names])
    every = list(dict.fromkeys([*keep, text]))
    # by place, so that no name of the table clashes
    flat = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(every)))
    at = f"c{every.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, at):
                sets = Sets(*utf8(part.column(part.schema.get_field_index(at))))
                pooled = np.bincount(sets.doc[sets.in_pool()], minlength=len(sets.n))
                made = [pa.array(sets.n, pa.int64()), pa.array(sets.ref, mask=sets.n == 0), pa.array(pooled, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=[*keep, *names])

    return flat.mapInArrow(tidy(run), schema)


def _pool(sets: Sets) -> pa.RecordBatch:
    place = np.arange(len(sets.doc)) - sets.off[sets.doc]
    sent = sets.in_pool() | (place < _need(sets.n)[sets.doc])
    return pa.RecordBatch.from_arrays([pa.array(sets.hash[sent].view(np.int64)), pa.array(sets.ref[sets.doc[sent]])], names=["token", "ref"])


def shared_tokens(df: DataFrame, text: str) -> DataFrame:
    """``(token, ref, sets)``: what sets send, as far as two classes or more share it, with its exact count."""
    index = _each_sets(df, text, "token long, ref long", _pool)
    counts = index.groupBy("token").agg(F.min("ref").alias("low"), F.max("ref").alias("high"), F.count("*").cast("int").alias("sets"))
    common = counts.where("low < high").select("token", "sets")
    # one row a token here, of a few of all tokens: its hash table needs no sorting of the index
    return index.join(common.hint("shuffle_hash"), "token")


def _pairs_within(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs inside runs of equal keys."""
    left, right, step = [], [], 1
    while step < len(key):
        same = np.flatnonzero(key[step:] == key[:-step])
        if not len(same):
            break
        left.append(same)
        right.append(same + step)
        step += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def signatures(ref: np.ndarray, n: np.ndarray, pooled: np.ndarray, off: np.ndarray, token: np.ndarray, count: np.ndarray, rare: int) -> tuple[np.ndarray, np.ndarray]:
    """Index entries ``(sig, ref)`` of sets from their shared shingles ``token[off[i]:off[i + 1]]``."""
    own = np.repeat(np.arange(len(ref)), np.diff(off))
    pool = token < np.uint64(int(POOL * 2**64))
    # outside the pool counts are of no meaning: last, by hash
    count = np.where(pool, count, 1 << 40)
    order = np.lexsort((token, count, own))
    own, token, count, pool = own[order], token[order], count[order], pool[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (token[1:] != token[:-1])
    own, token, count, pool = own[new], token[new], count[new], pool[new]
    first = np.searchsorted(own, np.arange(len(ref)))
    alone = pooled - np.bincount(own[pool], minlength=len(ref))
    place = np.arange(len(own)) - first[own] + alone[own]
    single = pool & (count < rare) & (place <= _spread(n)[own])
    sigs, owners = [mix(token[single] ^ np.uint64(0x5851F42D4C957F2D))], [own[single]]
    # those outside the pool are sent only where they belong to the prefix
    often = np.flatnonzero(((count >= rare) & (place < _need(n)[own])) | ~pool)
    parts = _parts(n)
    smaller = _parts((4 * n + 4) // 5)
    for p, usable in ((parts, np.ones(len(n), bool)), (smaller, smaller != parts)):
        at = often[usable[own[often]]]
        part = ((token[at] >> np.uint64(7)) % p[own[at]].astype(np.uint64)).astype(np.int64)
        at, part = (x[np.lexsort((token[at], part, own[at]))] for x in (at, part))
        x, y = _pairs_within(own[at] * (int(p.max(initial=1)) + 1) + part)
        x, y = at[x], at[y]
        sigs.append(mix(token[x] * np.uint64(0xDA942042E4DD58B5) + mix(token[y]) + p[own[x]].astype(np.uint64)))
        owners.append(own[x])
    return np.concatenate(sigs).view(np.int64), ref[np.concatenate(owners)]


def index_entries(tokens: DataFrame, classes: DataFrame, rare: int) -> DataFrame:
    """``(sig, ref)`` of every class whose prefix holds a shared shingle."""
    lists = tokens.groupBy("ref").agg(F.collect_list(F.struct("token", "sets")).alias("found"))
    lists = lists.join(classes.select("ref", "n_shingles", "pooled"), "ref")
    n = F.col("n_shingles")
    # a set with more shingles of its own than its prefix takes indexes nothing; the exact places come below
    spread = n - F.floor((4 * n + 4) / 5)
    lists = lists.where((F.col("pooled") - F.size("found")) <= spread + F.greatest(n / F.lit(PART), F.lit(1)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])
            start = 0
            while start < batch.num_rows:
                # about so many shingles at once, whatever the length of the texts
                end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + STEP, "right")) - 1)
                part = batch.slice(start, end - start)
                ref, n, pooled = (part.column(i).to_numpy() for i in (0, 2, 3))
                each = part.column(1).flatten()
                token, count = (each.field(x).to_numpy() for x in ("token", "sets"))
                off = sizes[start : end + 1] - sizes[start]
                sig, owner = signatures(ref, n, pooled, off, token.view(np.uint64), count.astype(np.int64), rare)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(owner)], names=["sig", "ref"])
                start = end

    return lists.select("ref", "found", "n_shingles", "pooled").mapInArrow(tidy(run), "sig long, ref long")


def _packed(sets: Sets) -> pa.RecordBatch:
    """Sets as bytes with bitmaps for the bound on overlaps."""
    bits = np.zeros((len(sets.n), SKETCH_BITS), np.uint8)
    np.bitwise_xor.at(bits, (sets.doc, (sets.hash & np.uint64(SKETCH_BITS - 1)).astype(np.int64)), 1)
    sketches = np.packbits(bits, axis=1)
    raw, off = sets.hash.astype("<u8").tobytes(), (sets.off * 8).tolist()
    bodies = [raw[a:b] for a, b in zip(off, off[1:], strict=False)]
    columns = [pa.array(sets.ref), pa.array(sets.n, pa.int64()), pa.array([x.tobytes() for x in sketches], pa.binary()), pa.array(bodies, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["ref", "n", "sketch", "body"])


def needed_sets(df: DataFrame, text: str, refs: DataFrame) -> DataFrame:
    """``(ref, n, sketch, body)`` of the classes in ``refs``, from one more pass over the texts.

    A bitmap of bounded size keeps most other texts from being sent; the join decides.
    """
    context = df.sparkSession.sparkContext
    bits = min(MARK_BITS, max(12, (16 * refs.count()).bit_length()))
    spot = F.shiftrightunsigned("ref", 64 - bits)
    marked = refs.select(spot.alias("spot")).selectExpr("cast(spot >> 6 as int) AS word", "shiftleft(1L, cast(spot & 63 as int)) AS bit")
    words = marked.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = context.broadcast(bitmap.view(np.uint64))

    def make(sets: Sets) -> pa.RecordBatch | None:
        at = sets.ref.view(np.uint64) >> np.uint64(64 - bits)
        wanted = (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return _packed(sets.only(wanted)) if wanted.any() else None

    found = _each_sets(df, text, "ref long, n long, sketch binary, body binary", make)
    sets = durable(found.join(refs, "ref", "left_semi").dropDuplicates(["ref"]))
    shared.destroy()
    return sets


def _bytes(column: pa.Array) -> list[np.ndarray]:
    """Values of a binary column as uint64 arrays, read where Arrow holds them."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return [raw[x:y].view("<u8") for x, y in zip(off, off[1:], strict=False)]


def _may_link(differ: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Parity bitmaps differ in at most as many bits as the sets differ in shingles: overlap <= (total - differ) / 2."""
    return 180 * (total - differ) >= 160 * total


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # merges the two sorted runs
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 80 * (len(both) - common)


def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            n = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            a, b = (np.stack(_bytes(batch.column(i))) for i in (3, 5))
            keep = _may_link(np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64), n)
            yield batch.select([0, 1]).filter(pa.array(keep))


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            keep = [_linked(x, y) for x, y in zip(_bytes(part.column(2)), _bytes(part.column(3)), strict=True)]
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of classes that link."""

    def side(c: str, *columns: str) -> DataFrame:
        return sets.select(F.col("ref").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in columns))

    slim = pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b").where(_near(F.col("n_a"), F.col("n_b")))
    likely = slim.select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(_bound, "a long, b long")
    whole = likely.join(side("a", "body"), "a").join(side("b", "body"), "b").select("a", "b", "body_a", "body_b")
    return durable(whole.mapInArrow(tidy(_exact), "a long, b long"))


def _near(x: Column, y: Column) -> Column:
    return 5 * F.least(x, y) >= 4 * F.greatest(x, y)


def links(df: DataFrame, text: str, classes: DataFrame, rare: int = RARE) -> DataFrame:
    """``(vertex, component)`` for every class that links with another one."""
    none = df.sparkSession.createDataFrame([], "vertex long, component long")
    every = durable(index_entries(shared_tokens(df, text), classes, rare))
    hubs = every.groupBy("sig").agg(F.min("ref").alias("hub"), F.max("ref").alias("last")).where("hub < last")
    entries = durable(every.join(hubs.select("sig", "hub"), "sig"))
    refs = durable(entries.select("ref").distinct())
    discard(every)
    if refs.isEmpty():
        return none
    sets = needed_sets(df, text, refs)
    stars = entries.where("ref <> hub").select(F.col("ref").alias("a"), F.col("hub").alias("b")).distinct()
    edges = verify(stars, sets)
    labels = durable(connected_components(edges, "a", "b"))
    known = labels.select(F.col("vertex").alias("ref"), "component")
    labelled = entries.join(known, "ref", "left").withColumn("label", F.coalesce("component", "ref"))
    open_ = labelled.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    # the hub of an open entry stands for its group
    spokes = durable(labelled.join(open_.select("sig"), "sig", "left_semi").select("ref", "hub").distinct())
    discard(entries, refs)
    if spokes.isEmpty():
        return labels
    groups = connected_components(spokes, "ref", "hub").select(F.col("vertex").alias("ref"), F.col("component").alias("g"))
    nodes = groups.join(known, "ref", "left").withColumn("label", F.coalesce("component", "ref")).drop("component")
    more = within_groups(durable(nodes.join(sets.select("ref", "n"), "ref")), sets)
    discard(sets)
    return durable(connected_components(edges.union(more), "a", "b"))


def within_groups(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between classes of one group ``g`` that do not have one ``label`` yet: a forest for each pair of blocks."""
    sizes = nodes.groupBy("g", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("bytes"))
    sizes = sizes.withColumn("bytes", 8 * F.col("bytes") + 256 * F.col("rows"))
    main = sizes.groupBy("g").agg(
        F.max(F.struct("rows", "label", "bytes")).alias("most"),
        F.sum("rows").alias("rows"),
        F.sum("bytes").alias("bytes"),
        F.count("*").alias("labels"),
    ).where("labels > 1")
    main = main.withColumn("main", F.col("most.label"))
    count = lambda rows, size: F.ceil(F.greatest(rows / BLOCK_ROWS, size / BLOCK_BYTES)).cast("int")
    main = main.withColumn("open_blocks", F.greatest(F.lit(1), count(F.col("rows") - F.col("most.rows"), F.col("bytes") - F.col("most.bytes"))))
    main = durable(main.withColumn("main_blocks", F.greatest(F.lit(1), count(F.col("most.rows"), F.col("most.bytes")))))
    small = (F.col("rows") <= BLOCK_ROWS) & (F.col("bytes") <= BLOCK_BYTES)
    held = main.where(small).agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).first()
    shelves = max(1, -(-(held["rows"] or 0) // BLOCK_ROWS), -(-(held["bytes"] or 0) // BLOCK_BYTES))
    rows = nodes.join(main.select("g", "main", "open_blocks", "main_blocks", small.alias("small")), "g")
    is_open = F.col("label") != F.col("main")
    deal = lambda blocks: F.pmod(F.xxhash64("ref"), blocks).cast("int")
    block = F.when(is_open, deal(F.col("open_blocks"))).otherwise(F.col("open_blocks") + deal(F.col("main_blocks")))
    last = F.when(is_open, F.col("open_blocks") + F.col("main_blocks")).otherwise(F.col("open_blocks")) - 1
    # a small group is one cell, and shares its task with others
    cells = F.when(F.col("small"), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), last))
    spread = rows.withColumn("block", F.when(F.col("small"), F.lit(-1)).otherwise(block)).withColumn("other", F.explode(cells))
    lot = F.when(F.col("small"), F.pmod(F.xxhash64("g"), F.lit(shelves))).otherwise(F.col("g"))
    spread = spread.select(
        lot.alias("lot"), F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "g", "ref", "label"
    )
    whole = spread.join(sets.select("ref", "n", "sketch", "body"), "ref")
    columns = ["lot", "bi", "bj", "block", "g", "ref", "label", "n", "sketch", "body"]
    return durable(whole.select(*columns).groupBy("lot", "bi", "bj").applyInArrow(_cell, "a long, b long"))


def _cell(rows: pa.Table) -> pa.Table:
    """Links between two blocks, or inside one or inside each of several small groups, that connect what is not connected yet."""
    g, n = rows.column("g").to_numpy(), rows.column("n").to_numpy()
    order = np.lexsort((rows.column("ref").to_numpy(), n, g))
    rows = rows.take(pa.array(order))
    g, n, ref, block, label = (rows.column(c).to_numpy() for c in ("g", "n", "ref", "block", "label"))
    label = np.unique(label, return_inverse=True)[1]
    sides = block if rows.num_rows and rows.column("bi")[0] != rows.column("bj")[0] else None
    sketches, bodies = (_bytes(pa.concat_arrays(rows.column(c).chunks)) for c in ("sketch", "body"))
    bits = np.stack(sketches)
    ends = np.searchsorted(g, g, "right")
    out: list[tuple[int, int]] = []
    for i in range(len(ref)):
        # sizes ascend inside a group, and a partner is at most 5 / 4 as large
        end = i + 1 + int(np.searchsorted(n[i + 1 : ends[i]], 5 * int(n[i]) // 4, "right"))
        near = label[i + 1 : end] != label[i]
        if sides is not None:
            near &= sides[i + 1 : end] != sides[i]
        js = np.flatnonzero(near) + i + 1
        if not len(js):
            continue
        js = js[_may_link(np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1, dtype=np.int64), n[js] + n[i])]
        while len(js):
            j, js = js[0], js[1:]
            if _linked(bodies[i], bodies[j]):
                out.append((int(ref[i]), int(ref[j])))
                label[label == label[j]] = label[i]
                js = js[label[js] != label[i]]
    a, b = ([x[k] for x in out] for k in (0, 1))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _named(rows: DataFrame, df: DataFrame, text: str, id_col: str, rare: int) -> DataFrame:
    """``(ref, component, least)`` for every class: its component and the least id of its rows."""
    filled = rows.where("ref IS NOT NULL")
    classes = filled.groupBy("ref").agg(F.min(id_col).alias("least"), F.max("n_shingles").alias("n_shingles"), F.max("pooled").alias("pooled"))
    classes = durable(classes)
    found = links(df, text, classes, rare).withColumnRenamed("vertex", "ref")
    return durable(classes.select("ref", "least").join(found, "ref", "left").withColumn("component", F.coalesce("component", "ref")))


def components(df: DataFrame, keep: list[str], text: str = "text", id_col: str = "doc_id", rare: int = RARE) -> DataFrame:
    """``keep`` of every row with ``n_shingles`` and ``component_id``, the least id in its component."""
    rows = durable(classes_of(df, list(dict.fromkeys([*keep, id_col])), text))
    named = _named(rows, df, text, id_col, rare)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = named.join(least, "component").select("ref", "component_id")
    alone = F.when(F.col("ref").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
    return rows.join(found, "ref", "left").withColumn("component_id", alone).select(*keep, "n_shingles", "component_id")


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", rare: int = RARE) -> DataFrame:
    """The rows of ``docs``, of each component one: that with the least id (null ids last), then the least hash of its set, then the least text.

    Ids may repeat: rows are known by id and set. Texts without words are linked with nothing and all stay.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = durable(classes_of(slim, ["id"], "text"))
    named = _named(rows, slim, "text", "id", rare)
    first = named.groupBy("component").agg(F.min(F.struct(F.col("least").isNull(), "least", "ref")).alias("first"))
    first = first.select(F.col("first.ref").alias("__ref"), F.col("first.least").alias("__id"))
    on = F.col("ref").eqNullSafe(F.col("__ref")) & F.col("id").eqNullSafe(F.col("__id"))
    stay = durable(rows.where("ref IS NOT NULL").join(first, on).groupBy("__ref", "__id").agg(F.count("*").alias("__rows")))
    names = ("__n", "__own", "__pooled")
    tagged = classes_of(docs, docs.columns, text, names).drop("__n", "__pooled")
    empty = F.col("__own").isNull()
    none = F.lit(None).cast("long")
    # rows without words have no entry to meet; they pass as a key of their own
    keys = stay.where("__rows = 1").select("__ref", "__id").withColumn("__empty", F.lit(False))
    same = F.col("__own").eqNullSafe(F.col("__ref")) & F.col(id_col).eqNullSafe(F.col("__id"))
    kept = tagged.join(keys, same, "left").where(empty | F.col("__empty").isNotNull()).select(*docs.columns)
    twice = stay.where("__rows > 1").select("__ref", "__id")
    if twice.isEmpty():
        return kept
    repeats = tagged.join(twice, same, "left_semi").groupBy(F.col(id_col).alias("__id"), "__own")
    once = repeats.agg(F.min_by(F.struct(*docs.columns), F.struct(text, F.xxhash64(*docs.columns))).alias("row"))
    return kept.unionByName(once.select("row.*"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and the least id of its component, for 5 words and a similarity of 0.8."""
    return components(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
