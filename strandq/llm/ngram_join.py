"""Grouped prefix join: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.75.

1. A sketch of shingle frequencies, made from every document, fixes one global order: rare shingles first.  Any
   order gives the same links; a good one keeps passages that many documents share out of the prefixes.
2. Documents with equal sets become one class; classes with equal prefix and size become one group, and only
   groups emit prefix tokens, with position and size for the exact length and position filters.  A token that the
   sketch tells to be frequent carries a number of cells, to which its groups are dealt.
3. Star round: each token's groups are paired with the one whose token stands earliest, per cell and then over cells.
   Pairs are verified on whole texts; links give first components.
4. Rest: a group looks for partners of its own size or larger in the bands of sizes that the position of the shared
   token leaves possible, which are none for the later tokens of a prefix.  Pairs of groups in different components are
   expanded to members, filtered by the distance of parity bitmaps (an exact bound), verified, and linked.  Nothing is
   capped, and groups of copies never form all their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MASK40, WordHasher, batches, bitmap, boxed, components, copied, dealt, heavy, is_set, materialise, shingles, slices, unboxed

#: 100 * intersection >= 75 * union is 7 * intersection >= 3 * (sum of sizes).
NEED, OF = 3, 7
SKETCH_BITS = (14, 22)  # at most 4 Mi counters of 4 bytes: the proven bound of what is broadcast
BLOCK = 4096
FILTER_BITS = 24
CLIP = np.uint64((1 << 24) - 1)
#: A token is dealt to cells if more than CELL groups may have it, and more than a share of all shingles.
CELL, SHARE = 1024, 8
#: A document is a number made of its id and bits of its text's hash, so that rows of one id with other texts are others.
UNIT = 1 << 60
BITS = ("b0", "b1", "b2", "b3")


def _sets(texts: list[bytes], hasher: WordHasher) -> Iterator[tuple[int, np.ndarray]]:
    for at, part in batches(texts):
        words, first, _, _ = hasher(part)
        for i in range(len(part)):
            yield at + i, np.unique(shingles(words[first[i] : first[i + 1]]))


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def shingle_sketch(docs: DataFrame, bits: int) -> np.ndarray:
    """How often each of 2**bits buckets of shingles occurs over all documents."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, out = WordHasher(), np.zeros(1 << bits, dtype=np.int64)
        for batch in slices(rows):
            for _, part in batches(_bytes(batch.column(0))):
                words, first, _, _ = hasher(part)
                n = len(words)
                if n < 5:
                    continue
                h = shingles(words)
                inside = np.ones(len(h), dtype=bool)
                for f in first[1:-1]:  # those across two texts don't count
                    inside[max(0, f - 4) : f] = False
                out += np.bincount((h[inside] & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        out = np.minimum(out, 2**31 - 1).astype("<i4").reshape(-1, BLOCK)
        yield pa.record_batch({"block": pa.array(np.arange(len(out), dtype=np.int32)), "counts": pa.array([x.tobytes() for x in out], pa.binary())})

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in rows:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(counts, dtype="<i4").astype(np.int64)
                total[block] = total[block] + x if block in total else x
        yield pa.record_batch({"block": pa.array(list(total), pa.int32()), "counts": pa.array([np.minimum(x, 2**31 - 1).astype("<i4").tobytes() for x in total.values()], pa.binary())})

    schema = "block int, counts binary"
    blocks = docs.select("text").mapInArrow(count, schema).repartition(max(1, min(64, (1 << bits) // BLOCK)), "block").mapInArrow(add, schema)
    out = np.zeros(1 << bits, dtype=np.int32)
    for block, counts in blocks.toLocalIterator():
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(counts, dtype="<i4")
    return out


def node(doc_id: Column, text: Column) -> Column:
    """A number for id and text, in the order of ids; null without id."""
    wide = lambda c: c.cast("long").cast("decimal(19,0)")
    return wide(doc_id) * wide(F.lit(UNIT)) + wide(F.xxhash64(text).bitwiseAND(UNIT - 1))


def _id(n: str) -> Column:
    return F.expr(f"cast(({n} - pmod({n}, {UNIT}BD)) div {UNIT}BD as bigint)")


def signatures(docs: DataFrame) -> DataFrame:
    """Of each row: doc_id, node, n (size of the set), set_hash, bits (which of 256 hash values occur an odd number of times),
    g (a hash of size and prefix), prefix (tokens, rarest first: 40 bits of a shingle, above them log2 of its cells)."""
    spark = docs.sparkSession
    bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], math.ceil(math.log2(4 * docs.count() + 1))))
    counted = shingle_sketch(docs, bits)
    cell = max(CELL, int(counted.sum(dtype=np.int64)) // (SHARE * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sketch = spark.sparkContext.broadcast(counted)

    def sign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        hasher, freq, low = WordHasher(), sketch.value, np.uint64((1 << bits) - 1)
        for batch in slices(rows):
            n, digest, parity, group, prefix, offsets = [], [], [], [], [], [0]
            for _, s in _sets(_bytes(batch.column(2)), hasher):
                n.append(len(s))
                digest.append(blake2b(s.tobytes(), digest_size=16).digest())
                parity.append(np.packbits(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256) & 1))
                often = freq[(s & low).astype(np.int64)].astype(np.uint64)
                keep = _prefix(len(s))
                order = np.argsort((np.minimum(often, CLIP) << np.uint64(40)) | (s >> np.uint64(24)))[:keep]
                cells = np.ceil(np.log2(np.maximum(often[order], np.uint64(cell)) / cell)).astype(np.uint64)
                tokens = (s[order] >> np.uint64(24) & MASK40 | cells << np.uint64(40)).astype(np.int64)
                group.append(blake2b(tokens.tobytes(), digest_size=16, salt=len(s).to_bytes(8, "little")).digest())
                prefix.append(tokens)
                offsets.append(offsets[-1] + keep)
            tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(prefix) if prefix else [], pa.int64()))
            words = np.array(parity, np.uint8).reshape(-1, 32).view(">i8").astype(np.int64)
            yield pa.record_batch({"row": batch.column(0), "node": batch.column(1), "n": pa.array(n, pa.int32()), "set_hash": pa.array(digest, pa.binary()), "g": pa.array(group, pa.binary()),
                                   **{b: pa.array(words[:, k]) for k, b in enumerate(BITS)}, "prefix": tokens})

    schema = "row long, node decimal(38,0), n int, set_hash binary, g binary, " + ", ".join(f"{b} long" for b in BITS) + ", prefix array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("row"), node(F.col("doc_id"), F.col("text")).alias("node"), "text").mapInArrow(sign, schema)


def _prefix(n: int) -> int:
    """Sets that reach 0.75 share one of their first n - ceil(0.75 n) + 1 shingles in any common order."""
    return n - -(-3 * n // 4) + 1 if n else 0


def _slot() -> Column:
    return F.xxhash64("id").bitwiseAND((1 << FILTER_BITS) - 1)


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose whole texts link; b's text travels to a, whose text is copied to the cells of its many pairs."""
    spark = docs.sparkSession

    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    wanted = spark.sparkContext.broadcast(bitmap(ids.select(_slot().alias("s")), FILTER_BITS))  # spares most texts the shuffle

    def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in slices(rows):
            batch = batch.filter(pa.array(is_set(wanted.value, batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64))))
            yield pa.record_batch({"id": batch.column(0), "z": pa.array([z.compress(x) for x in _bytes(batch.column(1))], pa.binary())})

    def judge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, z, last, left = WordHasher(), zstandard.ZstdDecompressor(), None, None
        for batch in slices(rows, 64):
            ok = []
            for za, zb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if za != last:
                    last, left = za, next(_sets([z.decompress(za)], hasher))[1]
                right = next(_sets([z.decompress(zb)], hasher))[1]
                both = len(np.intersect1d(left, right, assume_unique=True))
                ok.append(len(left) > 0 and OF * both >= NEED * (len(left) + len(right)))
            yield pa.record_batch({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(ok, pa.bool_()))

    texts = docs.select(node(F.col("doc_id"), F.col("text")).alias("id"), "text").withColumn("slot", _slot()).mapInArrow(packed, "id decimal(38,0), z binary")
    texts = materialise(texts.join(ids, "id", "left_semi").dropDuplicates(["id"]))
    hot = heavy(pairs, ["a"], pairs.count())
    joined = dealt(pairs, hot, ["a"], "b").join(texts.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")
    joined = joined.join(copied(texts.select(F.col("id").alias("a"), F.col("z").alias("za")), hot, ["a"]), ["a", "cell"])
    return joined.select("a", "b", "za", "zb").mapInArrow(judge, "a decimal(38,0), b decimal(38,0)")


def _may_link(n1: str, p1: str, n2: str, p2: str) -> str:
    """A shared token at these positions leaves room for enough common shingles."""
    return f"{OF} * least({n1} - {p1}, {n2} - {p2}) >= {NEED} * ({n1} + {n2})"


def _cells(t: str = "t") -> Column:
    return F.expr(f"shiftleft(1, cast(shiftright({t}, 40) as int))")


def _band(n: str) -> Column:
    """Sets of sizes a third apart at most lie in one band or in neighbouring ones."""
    return F.floor(F.log(n) / math.log(4 / 3)).cast("int")


def _star(groups: DataFrame, *keys: str) -> DataFrame:
    """groups (head, n, p, g) with the one that comes first in each set of keys, and how many there are."""
    w = Window.partitionBy(*keys)
    first = w.orderBy("p", "g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return groups.withColumns({"many": F.count("*").over(w), "h0": F.first("head").over(first), "n0": F.first("n").over(first), "p0": F.first("p").over(first)})


def classes_of(signed: DataFrame, docs: DataFrame) -> DataFrame:
    """n, set_hash, rep (the least node) and comp (the least node that links reach) of each class of signed rows."""
    known = signed.filter("n > 0 and node is not null")
    classes = materialise(known.groupBy("g", "n", "set_hash", *BITS).agg(F.min("node").alias("rep")))
    groups = known.groupBy("g", "n").agg(F.min("node").alias("head"), F.first("prefix").alias("prefix"))  # one prefix per group
    tokens = groups.select("g", "n", "head", F.posexplode("prefix").alias("p", "t")).withColumn("cell", F.pmod(F.xxhash64("g"), _cells()).cast("int"))
    tokens = materialise(_star(tokens, "t", "cell").filter(f"many > 1 or t >= {1 << 40}").drop("many"))
    leaders = tokens.filter(f"t >= {1 << 40} and h0 = head").select("g", "n", "head", "p", "t")  # at most one per cell
    stars = tokens.select("h0", "n0", "p0", "head", "n", "p").unionByName(_star(leaders, "t").select("h0", "n0", "p0", "head", "n", "p"))
    stars = stars.filter("h0 <> head").filter(_may_link("n", "p", "n0", "p0")).select(F.col("h0").alias("a"), F.col("head").alias("b"))

    members = classes.select("g", "n", "rep", *BITS)
    big = heavy(members, ["g", "n"], members.count())
    heads = members.groupBy("g", "n").agg(F.min("rep").alias("a"), F.count("*").alias("many")).filter("many > 1").drop("many")
    own = dealt(members, big, ["g", "n"], "rep")
    inside = own.join(copied(heads, big, ["g", "n"]), ["g", "n", "cell"]).filter("rep <> a").select("a", F.col("rep").alias("b"))
    links = materialise(_verified(materialise(stars.unionByName(inside).distinct()), docs))
    comp = components(links)
    own = materialise(own.join(comp, F.col("rep") == F.col("node"), "left").select("g", "n", "cell", "rep", *BITS, F.coalesce("comp", "rep").alias("comp")))

    # What is left: groups that share a token, or members of one group, in different components.
    ends = own.groupBy("g", "n").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    held = materialise(tokens.select("t", "cell", "g", "n", "p").join(ends, ["g", "n"]))
    every = F.explode(F.sequence(F.lit(0), _cells() - 1))
    mixed = held.groupBy("t").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).filter("l <> h").select("t", every.alias("cell"))
    open_ = materialise(held.join(mixed, ["t", "cell"], "left_semi").withColumn("most", F.expr(f"({OF - NEED} * n - {OF} * p) div {NEED}").cast("int")))
    side = lambda x, k: x.select("t", "cell", "band", *(F.col(c).alias(c + k) for c in ("g", "n", "p", "lo", "hi")))
    smaller = side(open_.filter("most >= n").withColumn("band", F.explode(F.sequence(_band("n"), _band("most")))), "1")
    larger = side(open_.withColumns({"band": _band("n"), "cell": every}), "2")
    pairs = smaller.join(larger, ["t", "cell", "band"]).filter("(n1 < n2 or (n1 = n2 and g1 < g2)) and (lo1 <> hi2 or hi1 <> lo2)").filter(_may_link("n1", "p1", "n2", "p2"))
    pairs = pairs.select("g1", "n1", "g2", "n2").distinct().unionByName(
        ends.filter("lo <> hi").select(F.col("g").alias("g1"), F.col("n").alias("n1"), F.col("g").alias("g2"), F.col("n").alias("n2")))
    for k in "12":
        named = lambda x, k=k: x.select(*(F.col(c).alias(c if c.startswith("cell") else c + k) for c in x.columns))
        pairs = copied(pairs, named(big), [f"g{k}", f"n{k}"]).join(named(own), [f"g{k}", f"n{k}", "cell"]).drop("cell")
    apart = " + ".join(f"bit_count({b}1 ^ {b}2)" for b in BITS)
    rest = pairs.filter(f"comp1 <> comp2 and {OF} * ({apart}) <= n1 + n2").select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b")).distinct()
    rest = materialise(rest)
    if not rest.isEmpty():
        comp = components(materialise(links.unionByName(_verified(rest, docs))))
    return classes.join(comp, F.col("rep") == F.col("node"), "left").select("n", "set_hash", "rep", F.coalesce("comp", "rep").alias("comp"))


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text; further columns are ignored).

    Null, empty and blank texts have no shingles: they are linked with nothing and are their own component.
    Repeated rows are classes like equal texts, and each comes back.  A row without doc_id takes part in no link and
    has no component.  Rows of one doc_id with different texts are judged each by its own text.  An empty table gives
    an empty result.  The order of ties doesn't matter: links are exact.
    """
    signed = materialise(signatures(docs))
    own = ["n", "set_hash"]
    copies = heavy(signed, own, signed.count())
    out = dealt(signed.select("row", "node", *own), copies, own, "node").join(copied(classes_of(signed, docs).select(*own, "comp"), copies, own), [*own, "cell"], "left")
    return out.select(F.col("row").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("row").isNull(), None).when(F.col("n") == 0, F.col("row")).otherwise(_id("comp")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component, one of each: its smallest doc_id, and of that one's linked texts one.

    Texts without words stay, rows of equal id and text once; rows of one id with texts that don't link stay each; rows
    without id stay.  Further columns may have any name; of rows that differ in them alone, one is chosen by their hash.
    """
    signed = materialise(signatures(docs))
    stay = classes_of(signed, docs).filter("rep = comp").select(F.col("rep").alias("node")).unionByName(signed.filter("n = 0").select("node")).distinct()
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = boxed(docs, node=node(F.col("doc_id"), F.col("text")), order=F.xxhash64(*hashed))
    kept = rows.join(stay, "node", "left_semi").groupBy("node").agg(F.min_by("row_", "order").alias("row_"))
    return unboxed(kept.select("row_").unionByName(rows.filter("node is null").select("row_")), docs.columns)
