"""Substring dedup by repeated-phrase automata.

A window is ``window`` (50) consecutive words of one text. A word goes if a window over it also
starts in a document with a smaller id; windows are judged on the input.

1. Phrases. Every window elects one of its ``phrase``-word (10) phrases, the one of the
   smallest hash, so equal windows elect equal phrases wherever they stand. Elected phrases
   (a twentieth of the words) are grouped by hash with partial minima; those of one document
   only drop out. The smallest document of a phrase owns it.
2. Confirmed passages. An owner's windows under phrases it owns, merged, are its passages; the
   windows of another document under such a phrase are its segments for that owner.
3. Automata. Passages and segments meet by owner. For each owner an Aho-Corasick automaton
   (pyahocorasick, over word numbers, so matches are exact) holds the passages' aligned
   25-word blocks: any 50 shared words hold one. Segments stream through it; each block found is
   extended to both sides, and stretches of 50 words or more are repeats. Owners are the
   shards. An owner with many segments is dealt over several tasks with a copy of its
   passages each; segments are streamed, never held together.
4. The rest. A window that shares its phrase with the owner but is not in it can still stand
   in a third document, where it is not the owner's either. Such windows alone are compared
   by 128-bit hashes, with partial minima.

Defined cases: null and blank texts have no words; texts under 50 words keep all; rows with a
null id are neither removed from nor a source of removal; rows that share an id never remove
each other's words; repeats inside one document stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm import textbytes as tb
from trolley.llm.common import store, text_key
from trolley.session import release

WINDOW, PHRASE = 50, 10
#: Bytes of segments that meet one copy of an owner's passages.
SALT_BYTES = 2 << 20
_P1, _P2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _runs(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of the ``width`` word hashes from each place on (places whose run would pass the end are left out)."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    weight = tb.powers(base, width)
    out = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        out += h[j:j + len(out)] * weight[j]
    return tb.mix(out)


def elect(h: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all phrases, for each window the place of the phrase it elects: the leftmost of the smallest hash)."""
    grams = _runs(h, phrase, _P1)
    width = window - phrase + 1
    if len(grams) < width:
        return grams, np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    step = 1 << 15  # of windows looked at together
    at = np.concatenate([view[k:k + step].argmin(axis=1) for k in range(0, len(view), step)])
    return grams, at + np.arange(len(view))


class Words:
    """Words of many texts, cut in slices; hashes are of the bytes as they are."""

    def __init__(self):
        self.hasher = tb.SpanHasher()

    def __call__(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: (bytes, word starts, word stops, word hashes)."""
        for part in tb.slices(texts):
            buf, stops = tb.pack(part)
            start, stop = tb.words(buf)
            h = self.hasher(buf, start, stop)
            first = np.searchsorted(start, np.concatenate(([0], stops)))
            for a, b in zip(first[:-1], first[1:]):
                yield buf, start[a:b], stop[a:b], h[a:b]


def phrases(docs: DataFrame, id_col: str, text_col: str, window: int, phrase: int) -> DataFrame:
    """Rows (phrase, doc, tkey): the distinct elected phrases of each text."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc"), text_key(F.col(text_col)).alias("tkey"),
                                                        F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            doc, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, (_, _, _, h) in enumerate(words([tb.encode(t.as_py()) for t in batch.column(2)])):
                grams, at = elect(h, window, phrase)
                if len(at):
                    got = np.unique(grams[np.unique(at)])
                    found.append(got)
                    owner.append(np.full(len(got), i))
            fp, who = np.concatenate(found).view(np.int64), np.concatenate(owner)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(doc[who]), pa.array(key[who])], ["phrase", "doc", "tkey"])

    return rows.mapInArrow(run, "phrase bigint, doc bigint, tkey bigint")


def passages(docs: DataFrame, shared: DataFrame, id_col: str, text_col: str, window: int, phrase: int) -> DataFrame:
    """Rows (owner, doc, tkey, at, text, n_bytes): merged windows under each owner's phrases; an owner's passages have doc = owner."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc"), text_key(F.col(text_col)).alias("tkey"),
                                                        F.col(text_col).alias("text")).join(shared, ["doc", "tkey"])
    rows = rows.select("doc", "tkey", "text", F.col("shared.phrase").alias("phrase"), F.col("shared.owner").alias("owner"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            doc, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out: list[tuple] = []
            texts = [tb.encode(t.as_py()) for t in batch.column(2)]
            for i, (buf, start, stop, h) in enumerate(words(texts)):
                grams, at = elect(h, window, phrase)
                known = np.array(batch.column(3)[i].as_py(), np.int64)
                owner = np.array(batch.column(4)[i].as_py(), np.int64)
                order = np.argsort(known)
                known, owner = known[order], owner[order]
                mine = grams.view(np.int64)[at]
                k = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                whose = np.where(known[k] == mine, owner[k], -1)
                is_known = known[k] == mine
                # runs of windows under one owner
                cut = np.flatnonzero((np.diff(whose) != 0) | (np.diff(is_known.astype(np.int8)) != 0)) + 1
                for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(whose)]))):
                    if len(whose) and is_known[a]:
                        text = b" ".join(bytes(buf[start[j]:stop[j]]) for j in range(a, b - 1 + window))
                        out.append((int(whose[a]), int(doc[i]), int(key[i]), int(a), text))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, [pa.int64()] * 4 + [pa.binary()])],
                                             ["owner", "doc", "tkey", "at", "text"])

    return rows.mapInArrow(run, "owner bigint, doc bigint, tkey bigint, at bigint, text binary")


class Automaton:
    """The blocks of one owner's passages, over word numbers."""

    def __init__(self, texts: list[bytes], window: int):
        import ahocorasick
        self.window, self.block = window, window // 2
        self.number: dict[bytes, int] = {}
        self.passages = [np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in t.split(b" ")), np.int64) for t in texts]
        places: dict[tuple, list[tuple[int, int]]] = {}
        for p, ids in enumerate(self.passages):
            listed = ids.tolist()
            for k in range(0, len(listed) - self.block + 1, self.block):
                places.setdefault(tuple(listed[k:k + self.block]), []).append((p, k))
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for block, where in places.items():
            self.auto.add_word(block, where)
        if places:
            self.auto.make_automaton()
        self.empty = not places

    def repeats(self, text: bytes) -> tuple[int, list[tuple[int, int]]]:
        """(number of words, stretches of at least a window that each stand whole in a passage)."""
        ids = np.fromiter((self.number.get(w, 0) for w in text.split(b" ")), np.int64)
        n, found, reach = len(ids), [], {}
        if self.empty:
            return n, found
        for end, where in self.auto.iter(tuple(ids.tolist())):
            at = end - self.block + 1
            low, high = max(0, at + self.block - self.window), min(n, at + self.window)
            if found and found[-1][0] <= low and found[-1][1] >= high:
                continue  # every window over this block is covered
            for p, k in where:
                lane = (p, at - k)  # a passage laid against the text at one offset
                if reach.get(lane, -1) >= at + self.block:
                    continue  # this stretch is known
                theirs = self.passages[p]
                left, right = min(at, k), min(n - at, len(theirs) - k)
                differ = np.flatnonzero(ids[at - left:at] != theirs[k - left:k])
                a = at - left + (int(differ[-1]) + 1 if len(differ) else 0)
                differ = np.flatnonzero(ids[at:at + right] != theirs[k:k + right])
                b = at + (int(differ[0]) if len(differ) else right)
                reach[lane] = b
                if b - a >= self.window:
                    found.append((a, b))
                    if a <= low and b >= high:
                        break
        return n, found


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def locate(met: DataFrame, window: int) -> DataFrame:
    """Rows (doc, tkey, start, stop, w1, w2): repeats of an owner's passages, and (stop null) hashes of the windows that are none."""
    # an owner's passages come first, then its segments
    placed = met.repartition("owner", "salt").sortWithinPartitions("owner", "salt", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names = Words(), ["doc", "tkey", "start", "stop", "w1", "w2"]

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(7)))

        out: list[tuple] = []
        for _, group in groupby(rows(), key=lambda r: r[:2]):
            sources, auto = [], None
            for _, _, segment, doc, tkey, at, text in group:
                if not segment:
                    sources.append(text)
                    continue
                auto = auto or Automaton(sources, window)
                n, found = auto.repeats(text)
                out += [(doc, tkey, at + a, at + b, None, None) for a, b in found]
                other = np.ones(n - window + 1, bool)
                for a, b in found:
                    other[a:b - window + 1] = False
                left = np.flatnonzero(other)
                if len(left):
                    _, _, _, h = next(words([text]))
                    w1, w2 = _runs(h, window, _P1).view(np.int64)[left].tolist(), _runs(tb.mix(h ^ np.uint64(_P2)), window, _P2).view(np.int64)[left].tolist()
                    out += [(doc, tkey, at + x, None, y, z) for x, y, z in zip(left.tolist(), w1, w2)]
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return placed.select("owner", "salt", "segment", "doc", "tkey", "at", "text") \
        .mapInArrow(run, "doc bigint, tkey bigint, start bigint, stop bigint, w1 bigint, w2 bigint")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """Rows (doc, tkey, ranges of word places): what goes from each distinct text of an id that loses words."""
    elected = store(phrases(docs, id_col, text_col, window, phrase))
    owners = elected.groupBy("phrase").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).where("owner < last").select("phrase", "owner")
    shared = store(elected.join(owners, "phrase").groupBy("doc", "tkey").agg(F.collect_list(F.struct("phrase", "owner")).alias("shared")))
    release(elected)
    cut = store(passages(docs, shared, id_col, text_col, window, phrase).withColumn("segment", F.col("owner") != F.col("doc")))
    release(shared)
    segments = cut.where("segment")
    salts = segments.groupBy("owner").agg(F.ceil(F.sum(F.length("text")) / SALT_BYTES).cast("int").alias("salts"))
    salted = segments.join(salts, "owner").withColumn("salt", F.pmod(F.xxhash64("doc", "tkey", "at"), F.col("salts")).cast("int"))
    copies = cut.where("not segment").join(salts, "owner").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    columns = ["owner", "salt", "segment", "doc", "tkey", "at", "text"]
    found = store(locate(salted.select(columns).unionByName(copies.select(columns)), window))
    release(cut)

    rest = found.where("stop is null")
    firsts = rest.groupBy("w1", "w2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("w1", "w2", "first")
    third = rest.join(firsts, ["w1", "w2"]).where("first < doc").select("doc", "tkey", "start", (F.col("start") + window).alias("stop"))
    ranges = found.where("stop is not null").select("doc", "tkey", "start", "stop").unionByName(third)
    return ranges.groupBy("doc", "tkey").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("ranges"))


def dedup_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """One row per input row: (id, n_words, n_removed, kept: the words left, joined by one space)."""
    gone = store(repeats(docs, id_col, text_col, window, phrase)).withColumnRenamed("doc", "g_doc").withColumnRenamed("tkey", "g_key")
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("tkey"))
    joined = rows.join(gone, (F.col("doc").cast("bigint") == F.col("g_doc")) & (F.col("tkey") == F.col("g_key")), "left").select("doc", "text", "ranges")
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, lost, kept = [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2)):
                words = tb.encode(text.as_py()).split()
                total.append(len(words))
                parts, at = [], 0
                for a, b in _merge([(r["start"], r["stop"]) for r in ranges.as_py() or ()]):
                    parts += words[at:a]
                    at = b
                parts += words[at:]
                lost.append(len(words) - len(parts))
                kept.append(b" ".join(parts).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())],
                                             ["doc", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, f"doc {kind}, n_words bigint, n_removed bigint, kept string").withColumnRenamed("doc", id_col)
