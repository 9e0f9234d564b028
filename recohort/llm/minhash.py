"""Near duplicates by b-bit MinHash.

Each text becomes its set of distinct shingles of five words (64-bit hashes) and MINIMA minima of them. The low BITS bits of
the minima are packed into a signature; runs of whole minima are the keys of bands. Then, in Spark:

1. Texts with equal sets are one class, named by its least doc_id; from here on only classes are worked on.
2. In each band bucket all classes are compared with the least one. The share of equal lanes, corrected for lanes that are
   equal by chance, estimates the similarity by counting bits; only unlikely pairs are left out, and the rest is confirmed
   on the full sets. Links make components.
3. Buckets that still hold several components are cut into blocks of bounded size, and pairs of blocks are compared inside
   tasks: by their signatures and, where different components are likely to be linked, on the full sets. Only links go on, no
   more of them than join the components.

So no bucket is capped, none is written out as pairs, and every candidate pair is either confirmed, refused on its full
sets, unlikely by SLACK standard errors and more, or within one component already.

Defined results: a text without words (or null) has no shingles, is linked with nothing and is its own component; rows that
share a doc_id stand and fall together, so texts linked with any of them are one component, even if the texts of that doc_id
are not alike; a null doc_id that is alone in its class has a null component and is kept; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recohort.llm.text import NOT_SPACE, Chunk, chunks, giving_back, mix, small_batches
from recohort.session import pin

SHINGLE = 5
BANDS, ROWS = 32, 4
MINIMA, BITS = BANDS * ROWS, 2
#: A pair goes on if its estimate is at least the threshold less so many standard errors (of 0.046).
SLACK = 6.0
#: Similarity of a link: PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Bounds of a block of a bucket: rows and shingles.
CELL_ROWS, CELL_SHINGLES = 4096, 500_000
#: Up to this many ids (8 bytes each) are broadcast; beyond, the join is shuffled.
BROADCAST_IDS = 500_000

_MULTIPLIERS = np.random.Generator(np.random.PCG64(99)).integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within it, and the number of them before each text."""
    own = chunk.lowered()
    starts, ends, before = own.words(NOT_SPACE)
    words, count = own.hash_spans(starts, ends), np.diff(before)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(chunk) + 1, np.int64)
    size = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(chunk)), size)
    first = np.repeat(before[:-1] - (np.cumsum(size) - size), size) + np.arange(len(doc))
    long = np.minimum(count, SHINGLE)[doc]
    value = long.astype(np.uint64)
    for k in range(SHINGLE):
        inside = k < long
        value = np.where(inside, mix(value * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(first + k, len(words) - 1)]), value)
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    value, doc = value[order], doc[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(chunk)))])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lanes = np.arange(MINIMA, dtype=np.uint64)
    for chunk in chunks(batches):
        value, before = shingles(chunk)
        size = np.diff(before)
        full = np.flatnonzero(size)
        minima = np.zeros((len(full), MINIMA), np.uint64)
        name = np.zeros((len(chunk), 2), np.uint64)
        if len(full):
            begins = before[full]
            for k in range(MINIMA):
                minima[:, k] = np.minimum.reduceat(value * _MULTIPLIERS[k] >> np.uint64(32), begins)
            # The whole set, named by two sums that do not depend on order.
            name[full, 0] = np.add.reduceat(mix(value), begins)
            name[full, 1] = np.add.reduceat(mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begins) + size[full].astype(np.uint64)
        low = mix(minima ^ (lanes << np.uint64(40))) & np.uint64((1 << BITS) - 1)
        per = 64 // BITS
        packed = np.bitwise_or.reduce(low.reshape(len(full), MINIMA // per, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)
        bands = np.zeros((len(full), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + minima[:, k::ROWS])
        at = np.full(len(chunk), -1)
        at[full] = np.arange(len(full))
        lists = lambda x: pa.array([x[i].view(np.int64) if i >= 0 else None for i in at], pa.list_(pa.int64()))  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(size), pa.array(name[:, 0].view(np.int64)), pa.array(name[:, 1].view(np.int64)), lists(packed), lists(bands)],
                                         names=["doc_id", "n_shingles", "name_a", "name_b", "signature", "bands"])


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, name_a, name_b, signature, bands) of every document; the last two are null without shingles."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(giving_back(_signatures), "doc_id long, n_shingles long, name_a long, name_b long, signature array<long>, bands array<long>")


def similarity(a, b):
    """Estimated similarity of two packed signatures: equal lanes, less those that are equal by chance."""
    lanes = sum(1 << k for k in range(0, 64, BITS))
    lanes = lanes - (1 << 64) if lanes >= 1 << 63 else lanes
    differ = F.lit(0)
    for k in range(MINIMA * BITS // 64):
        x = a[k].bitwiseXOR(b[k])
        for bit in range(1, BITS):
            x = x.bitwiseOR(F.shiftrightunsigned(x, bit)) if bit == 1 else x.bitwiseOR(F.shiftrightunsigned(a[k].bitwiseXOR(b[k]), bit))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(lanes)))
    chance = 1 / (1 << BITS)
    return ((1 - differ / MINIMA) - chance) / (1 - chance)


LIKELY = PERCENT / 100 - SLACK * 0.046


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text_a, text_b): the pairs whose full sets are similar enough."""
    for batch in batches:
        # Cut by the longer texts of the pairs, so that a few very long ones do not meet in one piece.
        for cut in chunks(iter([batch]), "text_a"):
            for piece in chunks(iter([cut.batch]), "text_b"):
                part = piece.batch
                (va, na), (vb, nb) = (shingles(next(chunks(iter([part]), name, 1 << 62))) for name in ("text_a", "text_b"))
                row = np.concatenate([np.repeat(np.arange(part.num_rows), np.diff(n)) for n in (na, nb)])
                value = np.concatenate([va, vb])
                order = np.argsort(value, kind="stable")
                order = order[np.argsort(row[order], kind="stable")]
                value, row = value[order], row[order]
                same = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
                both = np.bincount(row[1:][same], minlength=part.num_rows)
                union = np.diff(na) + np.diff(nb) - both
                linked = (100 * both >= PERCENT * union) & (both > 0)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(linked)), part.column(1).filter(pa.array(linked))], names=["a", "b"])


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents with the ids, written down."""
    wanted = pin(ids, "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    return pin(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id", "left_semi"), "wanted-texts")


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids that are links by the full sets of their texts."""
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs)
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(giving_back(_confirm), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all ends of links (a, b): the least id reachable.

    Each round lets every node point to the least neighbour of its neighbours (large star, then small star); both steps
    are joins on the node after a minimum that is taken before the shuffle, and each round is written down. The number of
    rounds grows with the logarithm of the longest path.
    """
    edges = pin(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = pin(small.where("a > b").distinct(), "edges")
        changed = new.exceptAll(edges).limit(1).count() + edges.exceptAll(new).limit(1).count()
        edges = new
        if not changed:
            break
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (a, b) of sets: bits of shingles that several sets have, counted in columns."""
    value = np.concatenate(sets)
    names, column, count = np.unique(value, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    several = count > 1
    numbers = np.cumsum(several) - 1
    keep = several[column]
    row, column = row[keep], numbers[column[keep]]
    out = np.zeros(len(a), np.int64)
    step = 1 << 15
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for begin in range(0, int(several.sum()), step):
        low, high = np.searchsorted(column, (begin, begin + step))
        bits = np.zeros((len(sets), step // 8), np.uint8)
        own, bit = row[low:high], column[low:high] - begin
        np.bitwise_or.at(bits, (own, bit >> 3), (1 << (bit & 7)).astype(np.uint8))
        words = bits.view(np.uint64)
        for at in range(0, len(a), 4096):
            out[at:at + 4096] += np.bitwise_count(words[a[at:at + 4096]] & words[b[at:at + 4096]]).sum(axis=1, dtype=np.int64)
    return out


def _links_between(band_key: int, side: np.ndarray, node: np.ndarray, part: np.ndarray, sign: np.ndarray, bands: np.ndarray, texts: pa.Array) -> list[tuple[int, int]]:
    """Links between components in one cell of a bucket, no more than join them."""
    lanes = np.uint64(sum(1 << k for k in range(0, 64, BITS)))
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(side)),) * 2
    band = int(np.flatnonzero(bands[0] == band_key)[0])
    chance = 1 / (1 << BITS)
    found = []
    for at in range(0, len(left), 8):
        some = left[at:at + 8]
        x = sign[some, None, :] ^ sign[None, right, :]
        y = x.copy()
        for bit in range(1, BITS):
            y |= x >> np.uint64(bit)
        equal = 1 - np.bitwise_count(y & lanes).sum(axis=2) / MINIMA
        good = ((equal - chance) / (1 - chance) >= LIKELY) & (part[some, None] != part[None, right])
        p, q = np.nonzero(good)
        p, q = some[p], right[q]
        # A pair that meets in several bands is looked at in the first of them, and once.
        mine = (bands[p] == bands[q]).argmax(axis=1) == band
        if not side.any():
            mine &= p < q
        found.append(np.stack([p[mine], q[mine]]))
    p, q = np.concatenate(found, axis=1)
    if not len(p):
        return []
    used, number = np.unique(np.concatenate([p, q]), return_inverse=True)
    a, b = number[:len(p)], number[len(p):]
    sets: list[np.ndarray] = []
    for chunk in chunks(iter([pa.RecordBatch.from_arrays([texts.take(pa.array(used))], names=["text"])])):
        value, before = shingles(chunk)
        sets += np.split(value, before[1:-1])
    size = np.array([len(s) for s in sets])
    both = _shared(sets, a, b)
    linked = 100 * both >= PERCENT * (size[a] + size[b] - both)
    root: dict[int, int] = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for k, m in zip(p[linked].tolist(), q[linked].tolist(), strict=True):
        u, v = top(int(part[k])), top(int(part[m]))
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append((int(node[k]), int(node[m])))
    return out


def _link_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, side, node, component, signature, bands, text), those of a cell (key, i, j) together: links."""
    held: list[pa.RecordBatch] = []

    def cell():
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        flat = lambda n: np.asarray(rows[n].combine_chunks().flatten() if rows[n].num_chunks else [], np.int64).reshape(rows.num_rows, -1)
        links = []
        if rows.num_rows > 1:
            links = _links_between(rows["key"][0].as_py(), *(rows[n].to_numpy() for n in ("side", "node", "component")),
                                   flat("signature").view(np.uint64), flat("bands"), rows["text"].combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    last = None
    for batch in batches:
        key, i, j = (batch.column(k).to_numpy() for k in range(3))
        begins = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(key)], strict=True):
            own = (key[a], i[a], j[a])
            if held and own != last:
                yield cell()
            held.append(batch.slice(a, b - a))
            last = own
    if held:
        yield cell()


def _left_over(keyed: DataFrame, parts: DataFrame, heads: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between components in buckets that hold several. keyed: (key, node) of buckets with more than one class.

    A large bucket is cut into blocks, and each pair of blocks is a cell, so a cell is bounded in rows and in shingles. Its
    pairs are compared in its task on signatures and, where likely, on the full sets; no pair leaves it but links.
    """
    named = keyed.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    rows = named.join(mixed.select("key"), "key", "left_semi").join(heads.select(F.col("doc_id").alias("node"), "n_shingles"), "node")
    sized = rows.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / CELL_ROWS, F.sum("n_shingles") / CELL_SHINGLES)).cast("int").alias("blocks"))
    rows = rows.join(sized, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A class of block k goes to the cells (i, k) with i <= k and (k, j) with k < j.
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j"), (x < F.col("own")).cast("int").alias("side")))
    rows = pin(rows.withColumn("cell", F.explode(cells)).select("key", "cell.*", "node", "component"), "cells")
    full = texts_of(rows.select(F.col("node").alias("doc_id")).distinct(), docs).join(heads.select("doc_id", "signature", "bands"), "doc_id")
    rows = rows.join(full.withColumnRenamed("doc_id", "node"), "node")
    rows = rows.select("key", "i", "j", "side", "node", "component", "signature", "bands", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(giving_back(_link_cells), "a long, b long").distinct()


def _components_of(every: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept). every: the signatures of docs, in which a doc_id has one set."""
    classes = every.where("n_shingles > 0").groupBy("name_a", "name_b").agg(F.min("doc_id").alias("class"))
    named = pin(every.join(classes, ["name_a", "name_b"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class")).otherwise(F.col("doc_id")).alias("class"), "signature", "bands"), "classes")
    heads = named.where("doc_id = class and n_shingles > 0")
    keyed = heads.select(F.explode("bands").alias("key"), F.col("doc_id").alias("node")).distinct()
    centres = keyed.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1")
    keyed = pin(keyed.join(centres.select("key", "centre"), "key"), "buckets")
    signed = heads.select("doc_id", "signature").dropDuplicates(["doc_id"])
    pairs = keyed.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(signed.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa")), "a").join(signed.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb")), "b")
    pairs = pin(pairs.where(similarity(F.col("sa"), F.col("sb")) >= LIKELY).select("a", "b"), "pairs")
    links = pin(confirm(pairs, docs), "links")
    parts = components(links)
    unique = heads.select("doc_id", "n_shingles", "signature", "bands").dropDuplicates(["doc_id"])
    parts = components(links.union(_left_over(keyed.select("key", "node"), parts, unique, docs)))
    found = named.join(parts, named["class"] == parts["node"], "left")
    component = F.coalesce("component", "class")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _of_repeated_ids(docs: DataFrame) -> DataFrame:
    """The same where rows with different sets share a doc_id: rows are compared by numbers of their own, and what shares a
    doc_id is linked."""
    rows = pin(docs.select(F.col("doc_id").cast("long").alias("named"), "text").withColumn("doc_id", F.monotonically_increasing_id()), "rows")
    numbered = rows.select("doc_id", "text")
    found = _components_of(pin(sign(numbered), "signatures"), numbered).select("doc_id", "n_shingles", F.col("component_id").alias("part"))
    found = pin(found.join(rows.select("doc_id", "named"), "doc_id").select("named", "n_shingles", "part"), "parts")
    known = found.where("named is not null")
    least = known.groupBy("named").agg(F.min("part").alias("a"), F.max("part").alias("high")).where("a < high").select("named", "a")
    joined = components(known.join(least, "named").select("a", F.col("part").alias("b")))
    found = found.join(joined, found["part"] == joined["node"], "left").withColumn("part", F.coalesce("component", "part")).drop("node", "component")
    names = found.groupBy("part").agg(F.min("named").alias("component_id"))
    found = found.join(names, "part").withColumnRenamed("named", "doc_id")
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    every = pin(sign(docs), "signatures")
    sets = every.where("doc_id is not null").groupBy("doc_id").agg(F.min("name_a").alias("low"), F.max("name_a").alias("high"))
    if sets.where("low < high").limit(1).count():
        return _of_repeated_ids(docs)
    return _components_of(every, docs)


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
