"""SimHash near-dedup over pigeonhole blocks.

Fingerprint. Lower-cased (``A-Z``) words make three-word shingles, repeats included; bit b of
the fingerprint is 1 if it is set in over half of the shingles' XXH64 hashes (seed 42). Arrow
batches of texts go through NumPy in slices of bounded size; a text is never cut.

Join. Exact copies of a fingerprint collapse first. The 64 bits are split into ``bound + 3``
blocks; fingerprints within ``bound`` bits agree in at least 3 of them, so every triple of
blocks is a join key (38 bits or so: selective at billions of rows). Keys held by one
fingerprint go. Keys of up to ``hot`` fingerprints are joined pairwise and the Hamming
distance is checked. A larger key would emit a square number of pairs, so its members are
linked exactly another way: each emits itself and its variants with one bit flipped outside the key's
blocks; members share a variant exactly if they are within 2 bits. Every variant links its
members to its smallest one: the same components, with as many links as members.

Components. Smallest label over links, with pointer jumping; every round is a written table
on shared storage, nothing is gathered on the driver.

Defined cases: texts that are null or have no words have fingerprint zero and link like any
other; fewer words than a shingle make one shingle of all of them; repeated ids keep one row
each; a null id never becomes a component id unless no other is reachable; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.common import given_back, store
from trolley.session import release

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SLICE = 1 << 16
HOT_KEY = 32


def fingerprint(text: str | None, width: int = 3) -> int:
    """Fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
        return _majority([xxhash.xxh64_intdigest(shingles[0], 42)])
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate(([0], np.cumsum(size[:-1] + 1)))
    stop = (start + size)[width - 1:]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return _majority([digest(view[a:b], 42) for a, b in zip(start[:len(stop)].tolist(), stop.tolist())])


def _majority(hashes: list[int]) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _SLICE):
        part = np.array(hashes[k:k + _SLICE], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Rows (id, fp): one per input row, the fingerprint as a signed 64-bit integer."""
    plain = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc", "fp"])

    kind = plain.schema["doc"].dataType.simpleString()
    return plain.mapInArrow(lambda batches: given_back(run(batches)), f"doc {kind}, fp bigint")


def _blocks(bound: int) -> list[int]:
    """Bit masks of the blocks, as signed 64-bit integers."""
    n = bound + 3
    edges = [64 * k // n for k in range(n + 1)]
    return [_signed(((1 << (b - a)) - 1) << a) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, bound: int = 2, hot: int = HOT_KEY) -> DataFrame:
    """Rows (a, b), a < b: links between distinct fingerprints ``fp``; connected exactly as "within ``bound`` bits" connects them."""
    if bound not in (0, 2):
        raise ValueError("the bound must be 0 or 2 bits")
    masks = _blocks(bound)
    keys = [_signed(reduce(lambda x, y: x | y, (masks[i] for i in c))) for c in combinations(range(len(masks)), 3)]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(keys)]))
    keyed = fps.select("fp", rows.alias("key")).select("fp", "key.k", "key.v")
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    shared = store(keyed.join(sizes, ["k", "v"]))

    small = shared.where(F.col("n") <= hot)
    other = small.select("k", "v", F.col("fp").alias("b"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("b")))
    pairs = small.join(other, ["k", "v"]).where((F.col("fp") < F.col("b")) & (apart <= bound)).select(F.col("fp").alias("a"), "b")

    outside = F.array(*[F.lit(_signed(~m)) for m in keys])
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << b)) for b in range(64)])
    usable = F.filter(flips, lambda f: f.bitwiseAND(F.element_at(outside, F.col("k") + 1)) == f)
    variants = shared.where(F.col("n") > hot).select("fp", F.explode(usable if bound else F.array(F.lit(0).cast("bigint"))).alias("f")) \
        .select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("variant")).distinct()
    hubs = variants.groupBy("variant").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    star = variants.join(hubs, "variant").where(F.col("fp") != F.col("hub")).select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(star).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Rows (node, root): every node of the edges (a, b) and the smallest node it is connected with."""
    both = store(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("low"))
        # pointer jump: take the label that the new root has itself
        up = labels.select(F.col("node").alias("up_node"), F.col("root").alias("up_root"))
        step = store(lower.join(up, F.col("low") == F.col("up_node"), "left")
                     .select("node", F.least("low", F.coalesce("up_root", "low")).alias("new_root"), "root"))
        changed = step.where(F.col("new_root") != F.col("root")).limit(1).count()
        release(labels)
        labels = step.select("node", F.col("new_root").alias("root"))
        labels._trolley_table = step._trolley_table
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bound: int = 2) -> DataFrame:
    """One row per input row: (id, fingerprint as 16 hex digits, component_id)."""
    prints = store(fingerprints(docs, id_col, text_col, width))
    distinct = prints.groupBy("fp").agg(F.min("doc").alias("first"))
    edges = store(links(distinct.select("fp"), bound))
    roots = components(edges)
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    heads = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = grouped.join(heads, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                              "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bound: int = 2) -> DataFrame:
    """``docs`` with one document of each component: the one whose id names it; rows with a null id stay."""
    gone = near_copies(docs, id_col, text_col, width, bound).where(F.col(id_col) != F.col("component_id")) \
        .select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
