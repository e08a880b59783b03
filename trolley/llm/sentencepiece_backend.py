"""SentencePiece encoding and decoding on the tokenizers library.

A SentencePiece model file is a protobuf message. Its pieces, scores, types and normaliser are
read from the wire format, and a tokenizer of the tokenizers library is rebuilt from them:
the normaliser (its precompiled character map, white-space rules, dummy prefix), the
metaspace marker in place of spaces, unigram scores or, for a BPE model, merges in the order
of the scores, and byte fallback. Encoding runs in batches, multithreaded inside a task.

Where no piece holds a marker after another character, a text is cut before each group of
markers: merges never cross such a cut, so the ids stay the same and runs of text can be cached.

Parity with the sentencepiece library is verified in every task: on a probe of whole texts, and on each
run of the data that the worker has not met before. A model that cannot be rebuilt exactly stops
the job instead of writing other ids; so does a unigram model with byte pieces, whose names the library would
find in a text. Nothing of it happens on the driver, which only reads the file.

Defined cases: null and empty texts have no ids; the name of a control piece in a text is
ordinary text; a lone surrogate never occurs (Spark strings are UTF-8); long texts are
encoded whole; the model's bytes travel with the job, the file is read by the driver only; other columns
are passed on, but for those that have the name of a new one.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from trolley.llm.common import given_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
SLICE_CHARS = 1 << 20
#: Runs that a worker keeps with their ids, and the longest run that is kept.
CACHE_RUNS, CACHE_CHARS = 1 << 17, 48
#: New runs that the libraries are given at once: an encoding holds much more than its ids.
LEARN_RUNS = 1 << 11
#: New runs of a BPE model that are joined to one text: a call costs as much as some of them.
JOINED_RUNS = 1 << 6
#: Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; varints as integers, all else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, buf[at:at + size]
            at += size


@dataclass
class Spec:
    """What a model file says."""
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True
    suffix_space: bool = False


def parse(model: bytes) -> Spec:
    spec = Spec()
    for number, value in _fields(model):
        if number == 1:  # a piece
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode("utf-8")
                elif k == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif k == 3:
                    kind = v
            spec.pieces.append((piece, score, kind))
        elif number == 2:  # how it was trained
            for k, v in _fields(value):
                if k == 3:
                    spec.kind = v
                elif k == 35:
                    spec.byte_fallback = bool(v)
                elif k == 24:
                    spec.suffix_space = bool(v)
        elif number == 3:  # normaliser
            for k, v in _fields(value):
                if k == 2:
                    spec.charsmap = v
                elif k == 3:
                    spec.dummy_prefix = bool(v)
                elif k == 4:
                    spec.trim_spaces = bool(v)
                elif k == 5:
                    spec.escape_spaces = bool(v)
    return spec


def _merges(spec: Spec) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first."""
    scores = {p: s for p, s, kind in spec.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = [(-scores[p], len(p[:k]), p[:k], p[k:]) for p in scores for k in range(1, len(p)) if p[:k] in scores and p[k:] in scores]
    return [(a, b) for _, _, a, b in sorted(found, key=lambda x: (x[0], x[1]))]


def build(model: bytes):
    """Tokenizer of the tokenizers library with the ids of the model file."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    spec = parse(model)
    if spec.suffix_space or not spec.escape_spaces:
        raise ValueError("models that treat white space as a suffix, or do not mark it, are not supported")
    unk = next((p for p, _, kind in spec.pieces if kind == UNKNOWN), None)
    if spec.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in spec.pieces], unk_id=[k for _, _, k in spec.pieces].index(UNKNOWN),
                              byte_fallback=spec.byte_fallback)
    elif spec.kind == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, _merges(spec), unk_token=unk, fuse_unk=True,
                          byte_fallback=spec.byte_fallback)
    else:
        raise ValueError(f"model type {spec.kind} is not supported")
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.trim_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(r"\A | \z"), "")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARKER))
    steps.append(normalizers.Replace(" ", MARKER))
    t.normalizer = normalizers.Sequence(steps)
    if any(p == MARKER for p, _, _ in spec.pieces) and not any(MARKER in p[1:] and p.strip(MARKER) and MARKER in p.lstrip(MARKER) for p, _, kind in spec.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARKER}+[^{MARKER}]*"), "isolated")
    strip = [decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), *([decoders.ByteFallback()] if spec.byte_fallback else []), decoders.Fuse(), *strip])
    return t


#: Texts that try the corners: white space, other scripts, bytes beyond the vocabulary, piece names.
PROBE = ("", " ", "  two  spaces ", "a", "Hello world", "tab\tand\nline\r\n", "▁marker ▁▁x", "<s> </s> <unk> <0x0A>",
         "café naïve Über ñ", "你好 世界", "\U0001F600\U0001F680 emoji", "русский",
         "مرحبا", "1234567890 3.14159", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "mixed space wide", "\x00\x01\x7f", "é ﬁ")


def verify(model: bytes, texts: list[str]) -> None:
    """Raise if the rebuilt tokenizer and the sentencepiece library differ on any of the texts."""
    import sentencepiece
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
    ours = build(model).encode_batch(texts, add_special_tokens=False)
    for text, mine in zip(texts, ours):
        if mine.ids != theirs.encode(text):
            raise ValueError(f"ids differ from sentencepiece for {text[:60]!r}")


def _tokenizer(model: bytes, threads: int):
    """The rebuilt tokenizer; its pool has ``threads`` threads in each worker."""
    os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = ("true" if threads > 1 else "false"), str(threads)
    return build(model)


def _slices(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of consecutive slices of about ``limit`` in size; a larger row is a slice of its own."""
    first, n, total = 0, 0, 0
    for size in sizes:
        if n and total + size > limit:
            yield first, n
            first, n, total = first + n, 0, 0
        n, total = n + 1, total + size
    if n:
        yield first, n


def normalised(t, spec: Spec, text: str) -> str:
    """The text as the tokenizer ``t`` reads it, with spaces for markers and without the prefixed one."""
    if not spec.charsmap and not spec.trim_spaces:  # only the marking of spaces and the prefix are left of the normaliser
        return text.replace(MARKER, " ")
    read = t.normalizer.normalize_str(text).replace(MARKER, " ")
    return read[1:] if spec.dummy_prefix else read


class Codec:
    """Encodes and decodes texts run by run, and checks each new run against the sentencepiece library.

    A run is a piece of normalised text from its markers to the next ones. Where the model allows (``separable``)
    runs are coded on their own, in batches, and short ones kept in a cache of two generations of ``CACHE_RUNS``;
    otherwise a text is one run.
    """

    def __init__(self, model: bytes, threads: int, check: bool = True):
        from tokenizers import decoders, normalizers
        import sentencepiece

        self.t, spec = _tokenizer(model, threads), parse(model)
        self.spec = replace(spec, pieces=[])
        self.marked = np.array([[p[:1] == MARKER, p[-1:] == MARKER] for p, _, _ in spec.pieces])  # whether pieces begin and end with a marker
        self.normalizer = self.t.normalizer
        self.separable = self.t.pre_tokenizer is not None
        self.theirs = sentencepiece.SentencePieceProcessor(model_proto=model, num_threads=threads) if check else None
        if check:  # whole texts: the normaliser and the cuts
            for text, mine in zip(PROBE, self.t.encode_batch(list(PROBE), add_special_tokens=False)):
                self._same(text, mine.ids, self.theirs.encode(text))
        # from here on texts are normalised and cut before they are encoded, and prefixes taken off after decoding
        self.t.normalizer = normalizers.Sequence([])
        self.t.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), *([decoders.ByteFallback()] if self.spec.byte_fallback else []), decoders.Fuse()])
        self.cut = re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the runs kept before the last ``CACHE_RUNS`` new ones
        self.odd: dict[str, str] = {}  # decoded text of the runs that do not decode to themselves

    @staticmethod
    def _same(text: str, ours: list[int], theirs: list[int]) -> None:
        if ours != theirs:
            raise ValueError(f"ids differ from sentencepiece for {text[:60]!r}")

    def normal(self, text: str) -> str:
        if self.spec.charsmap or self.spec.trim_spaces:
            return self.normalizer.normalize_str(text)
        return (MARKER if self.spec.dummy_prefix else "") + text.replace(" ", MARKER) if text else ""

    def _learn(self, runs: list[str]) -> tuple[dict[str, bytes], dict[str, str]]:
        """Ids of new runs, and what those decode to that do not decode to themselves."""
        joined = []
        if self.separable and self.spec.kind == BPE:  # sums of unigram scores are rounded otherwise in a longer text
            joined = [run for run in runs if run[0] == MARKER and run[-1] != MARKER]
        found = self._learn_joined(joined) if joined else None
        if found is None:
            return self._learn_alone(runs)
        ids, odd = found
        if len(ids) < len(runs):
            more = self._learn_alone([run for run in runs if run not in ids])
            ids.update(more[0])
            odd.update(more[1])
        return ids, odd

    def _learn_joined(self, runs: list[str]) -> tuple[dict[str, bytes], dict[str, str]] | None:
        """The same of runs that begin with a marker and end with another character, several to a text; None if their ids cannot be told apart."""
        lots = [runs[k:k + JOINED_RUNS] for k in range(0, len(runs), JOINED_RUNS)]
        texts = ["".join(lot) for lot in lots]
        ids = [e.ids for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]
        if self.theirs:
            lead = 1 if self.spec.dummy_prefix else 0  # the library puts the first marker back
            theirs = self.theirs.encode([text[lead:] for text in texts])
            if theirs != ids:
                for text, mine, ref in zip(texts, ids, theirs):
                    self._same(text, mine, ref)
        flat = np.concatenate([np.array(x, np.int32) for x in ids])
        begins, ends = self.marked[flat].T
        # a run begins with the first marker after another character
        first = np.flatnonzero(begins & np.concatenate([[True], ~ends[:-1]]))
        if len(first) != len(runs) or first[0]:
            return None
        coded, at = flat.tobytes(), [*(4 * first).tolist(), 4 * len(flat)]
        known = {run: coded[a:b] for run, a, b in zip(runs, at, at[1:])}
        odd = {}
        for lot, text, back in zip(lots, texts, self.t.decode_batch(ids, skip_special_tokens=False)):
            if back != text.replace(MARKER, " "):
                odd.update(self._odd(lot, [np.frombuffer(known[run], np.int32).tolist() for run in lot]))
        return known, odd

    def _learn_alone(self, runs: list[str]) -> tuple[dict[str, bytes], dict[str, str]]:
        """The same, each run a text."""
        ids = [e.ids for e in self.t.encode_batch_fast(runs, add_special_tokens=False)]
        if self.theirs:
            # the library puts the first marker back; a run of markers alone needs a word before it
            lead, before = (1 if self.spec.dummy_prefix else 0), self.theirs.encode("a")
            given = ["a" + run if run[-1] == MARKER else run[lead:] for run in runs]
            theirs = self.theirs.encode(given)
            if theirs != ids:
                for run, mine, ref in zip(runs, ids, theirs):
                    self._same(run, before + mine if run[-1] == MARKER else mine, ref)
        return {run: array("i", x).tobytes() for run, x in zip(runs, ids)}, self._odd(runs, ids)

    def _odd(self, runs: list[str], ids: list[list[int]]) -> dict[str, str]:
        return {run: text for run, text in zip(runs, self.t.decode_batch(ids, skip_special_tokens=False)) if text != run.replace(MARKER, " ")}

    def code(self, texts: list[str]) -> tuple[list[bytes], list[str], list[str]]:
        """(ids as 32-bit numbers, decoded text, normalised text) of each text."""
        normal = [self.normal(x) for x in texts]
        runs = [self.cut.findall(x) if self.separable else [x] if x else [] for x in normal]
        if len(self.ids) > CACHE_RUNS:
            self.old, self.ids = self.ids, {}
            self.odd = {run: text for run, text in self.odd.items() if run in self.old}
        new = set().union(*runs).difference(self.ids)
        met = new.intersection(self.old)
        self.ids.update(zip(met, map(self.old.__getitem__, met)))
        new -= met
        unmet = list(new)
        for k in range(0, len(unmet), LEARN_RUNS):
            ids, odd = self._learn(unmet[k:k + LEARN_RUNS])
            self.ids.update(ids)
            self.odd.update(odd)
        plain, decoded = [x.replace(MARKER, " ") for x in normal], []
        for row, text in zip(runs, plain):
            if self.odd and not self.odd.keys().isdisjoint(row):
                text = "".join(self.odd.get(run, run.replace(MARKER, " ")) for run in row)
            decoded.append(text[1:] if self.spec.dummy_prefix and text[:1] == " " else text)
        read = [x[1:] if self.spec.dummy_prefix else x for x in plain]
        out = [b"".join(map(self.ids.__getitem__, row)) for row in runs]
        if self.theirs and (self.spec.charsmap or self.spec.trim_spaces):  # a normaliser that does more than mark spaces is verified on whole texts
            for text, mine, ref in zip(texts, out, self.theirs.encode(texts)):
                self._same(text, np.frombuffer(mine, np.int32).tolist(), ref)
        for run in new:
            if not self.separable or len(run) > CACHE_CHARS:
                del self.ids[run]
                self.odd.pop(run, None)
        return out, decoded, read


def _codec(model: bytes, threads: int, check: bool) -> Codec:
    """The codec of this Python worker, which serves its later tasks as well."""
    kept = sys.__dict__.setdefault("_sentencepiece_codecs", {})
    key = (hashlib.sha256(model).digest(), threads, check)
    if key not in kept:
        kept.clear()
        kept[key] = Codec(model, threads, check)
    return kept[key]


def encode(docs: DataFrame, text_col: str = "text", model_path: str = MODEL, ids_col: str = "ids", check: bool = True,
           threads: int = 2, slice_chars: int = SLICE_CHARS, back: bool = False) -> DataFrame:
    """``docs`` with an array column of piece ids.

    With ``back``, the ids of every row are decoded as well: ``decoded_sha256`` of the decoded text, and ``round_trip``,
    whether it equals the normalised text. Columns of ``docs`` with the names of new ones are replaced.
    With ``check``, parity is verified in the tasks on every text: each run that a worker has not met before is
    encoded by the sentencepiece library as well. Texts are encoded and passed on in slices of about ``slice_chars`` characters.
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the model file's bytes
    made = [StructField(ids_col, ArrayType(IntegerType())),
            *([StructField("decoded_sha256", StringType()), StructField("round_trip", BooleanType())] if back else [])]
    fresh = {f.name.lower() for f in made}
    kept = [c for c in docs.columns if c.lower() not in fresh]
    names, n_kept = [*kept, *(f.name for f in made)], len(kept)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col))  # the text once more, last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, threads, check)
        gc.disable()  # no cycles here, and the cache is long to walk through
        try:
            for batch in batches:
                texts = batch.column(n_kept)
                for first, n in _slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), slice_chars):
                    ids, decoded, read = codec.code([x.as_py() or "" for x in texts.slice(first, n)])
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                    arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                    more = []
                    if back:
                        more = [pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded], pa.string()),
                                pa.array([x == y for x, y in zip(decoded, read)], pa.bool_())]
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, n).columns[:n_kept], arrays, *more], names)
        finally:
            gc.enable()

    return rows.mapInArrow(lambda batches: given_back(run(batches)), StructType([*[rows.schema.fields[k] for k in range(n_kept)], *made]))


def decode(rows: DataFrame, ids_col: str = "ids", model_path: str = MODEL, text_col: str = "decoded", threads: int = 2,
           slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``rows`` with the text of an id column."""
    with open(model_path, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())
    names, at = [*rows.columns, text_col], rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(shared.value, threads)
        for batch in batches:
            ids = batch.column(at)
            for first, n in _slices((4 * len(x) if x.is_valid else 0 for x in ids), slice_chars):
                texts = t.decode_batch([x or [] for x in ids.slice(first, n).to_pylist()], skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, n).columns, pa.array(texts, pa.string())], names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(text_col, StringType())]))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the ids, comma-joined."""
    return F.sha2(F.array_join(ids, ","), 256)
