"""Language identification of mixed-language text: script ranges, word scores, Viterbi.

Words are runs of letters. A word's script (by code-point range of its first letter) narrows
the candidate languages to those that use the script in training. Its score under a language
is the sum of smoothed log-probabilities of its character 1- to 3-grams, with word ends
marked, in hashed tables. Viterbi over the words of a text, with a penalty for each switch
of language, labels spans; the text's language is the one whose spans hold most letters.

Training counts n-grams of at most ``max_rows`` labelled texts (those of the smallest id
hashes, so the sample does not grow with the table). The counts are added up by Spark; a table
of languages x buckets comes to the driver. Prediction is one scan in Arrow batches, in slices
of bounded size, and shuffles nothing; Viterbi steps through many texts at once.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and no spans;
rows with a null or empty language train nothing; without training rows every text is
``und``; an empty table gives an empty result; only the id, text and language columns are read, so
others may have any names, and a column named ``language`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm import textbytes as tb

BUCKETS, ORDERS, MAX_ROWS = 1 << 16, (1, 2, 3), 12_000
SWITCH, MIN_SHARE = 12.0, 0.001
#: Characters of texts whose words are scored together, and of texts whose spans are found together.
CHARS, GROUP = 1 << 19, 1 << 22

#: First code points of script ranges, ascending; a range ends where the next begins.
SCRIPT_RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0750, "Arabic"), (0x0780, "Other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Latin"), (0x2C80, "Other"), (0x2D00, "Georgian"), (0x2D30, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Han"),
    (0x3040, "Kana"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "Other"),
    (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"),
    (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x40000, "Other"))
SCRIPTS = tuple(dict.fromkeys(name for _, name in SCRIPT_RANGES))
_SALT = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


_MADE: list[np.ndarray] = []  # filled once in each process


def _tables() -> list[np.ndarray]:
    """Whether a code point is a letter (or a mark inside a word), and its script."""
    if _MADE:
        return _MADE
    letter = np.zeros(0x110000, bool)
    # surrogates stand out of the way: they are no characters
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = np.fromiter((m.start() for m in regex.finditer(r"[\p{L}\p{M}]", every)), np.int64)
    letter[np.where(found < 0xD800, found, found + 0x800)] = True
    first = np.array([a for a, _ in SCRIPT_RANGES])
    kind = np.array([SCRIPTS.index(b) for _, b in SCRIPT_RANGES], np.uint8)
    _MADE.extend((letter, kind[np.searchsorted(first, np.arange(0x110000), side="right") - 1]))
    return _MADE


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # (len(ORDERS) * BUCKETS) x langs
    allowed: np.ndarray  # scripts x langs
    prior: np.ndarray


@dataclass
class Words:
    doc: np.ndarray
    length: np.ndarray
    script: np.ndarray
    gram_word: np.ndarray
    gram: np.ndarray


def cut(texts: list[str]) -> Words:
    """Words of the texts, with the table index of each of their n-grams."""
    letter, scripts = _tables()
    low = [t.lower() for t in texts]
    code = np.frombuffer(("\n".join(low) + "\n" * max(ORDERS)).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[code]
    start, stop = tb.spans(~is_letter)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), start, side="right")
    word = np.zeros(len(code), np.int64)
    word[start] = 1
    word = np.cumsum(word) - 1  # of a letter, its word
    value = np.where(is_letter, code, 0).astype(np.uint64) + np.uint64(1)  # all marks alike
    grams, owners = [], []
    total, inner = value, np.ones(len(code), bool)
    for k, order in enumerate(ORDERS):
        n = len(code) - order + 1
        if order > 1:
            total = total[:n] * np.uint64(0x100000001B3) + tb.mix(value[order - 1:])
        if order > 2:  # a mark may stand first or last, never inside
            inner = inner[:n] & is_letter[order - 2:n + order - 2]
        valid = is_letter if order == 1 else is_letter[:n] | is_letter[1:n + 1] if order == 2 else inner[:n]
        at = np.flatnonzero(valid)
        grams.append((tb.mix(total[at] ^ _SALT[k]) % np.uint64(BUCKETS)).astype(np.int64) + k * BUCKETS)
        owners.append(np.where(is_letter[at], word[at], word[np.minimum(at + 1, len(code) - 1)]))
    return Words(doc, stop - start, scripts[code[start]], np.concatenate(owners), np.concatenate(grams))


def viterbi(score: np.ndarray, size: np.ndarray, penalty: float, prior: np.ndarray) -> np.ndarray:
    """Best language of every word; ``score`` holds the words of all texts in turn, ``size`` how many each has."""
    order = np.argsort(-size, kind="stable")
    size_sorted = size[order]
    first = (np.cumsum(size) - size)[order]
    steps = int(size_sorted[0]) if len(size) else 0
    active = np.searchsorted(-size_sorted, -np.arange(steps), side="left") if steps else np.zeros(0, int)
    kind = np.min_scalar_type(score.shape[1])  # holds every language's index
    out = np.zeros(len(score), kind)
    from_lang = np.zeros(score.shape, kind)
    own = np.arange(score.shape[1], dtype=kind)
    best = np.zeros((0, score.shape[1]))
    for t in range(steps):
        a = active[t]
        if t == 0:
            best = score[first[:a]] + prior
            continue
        best = best[:a]
        top = best.argmax(axis=1)
        jump = best[np.arange(a), top] - penalty
        leave = jump[:, None] > best
        at = first[:a] + t
        from_lang[at] = np.where(leave, top[:, None].astype(kind), own)
        stay = np.where(leave, jump[:, None], best) + score[at]
        if t + 1 < steps and active[t + 1] < a:  # texts that end here
            done = slice(active[t + 1], a)
            out[at[done]] = stay[done].argmax(axis=1)
        best = stay
    if steps:
        for t in (0, steps - 1):  # texts of one word, and the longest ones
            a, b = (active[t + 1] if t + 1 < steps else 0), active[t]
            if t == steps - 1:
                out[first[a:b] + t] = best[a:b].argmax(axis=1)
            elif b > a:
                out[first[a:b]] = (score[first[a:b]] + prior).argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            at = first[:active[t]] + t
            out[at - 1] = from_lang[at, out[at]]
    return out


def word_scores(w: Words, m: Model) -> np.ndarray:
    n = len(w.doc)
    score = np.stack([np.bincount(w.gram_word, m.logp[w.gram, k], minlength=n) for k in range(len(m.langs))], axis=1)
    return np.where(m.allowed[w.script], score, -1e5).astype(np.float32)


def label(texts: list[str], m: Model) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans of words) of each text."""
    if not m.langs:
        return [("und", 0.0, []) for _ in texts]
    score, length, size, at = [], [], np.zeros(len(texts), np.int64), 0
    part, chars = [], 0

    def flush() -> None:
        nonlocal at, part, chars
        w = cut(part)
        score.append(word_scores(w, m))
        length.append(w.length)
        size[at:at + len(part)] = np.bincount(w.doc, minlength=len(part))[:len(part)]
        at += len(part)
        part, chars = [], 0

    for t in texts:
        if part and chars + len(t) > CHARS:
            flush()
        part.append(t)
        chars += len(t)
    if part:
        flush()
    if not score:
        return []
    scores, lengths = np.concatenate(score), np.concatenate(length)
    keep = size > 0
    best = viterbi(scores, size[keep], SWITCH, m.prior) if keep.any() else np.zeros(0, np.int8)
    doc = np.repeat(np.arange(len(texts)), size)
    share = np.bincount(doc * len(m.langs) + best, lengths, minlength=len(texts) * len(m.langs)).reshape(len(texts), -1)
    stop = np.cumsum(size)
    out = []
    for d in range(len(texts)):
        if not size[d]:
            out.append(("und", 0.0, []))
            continue
        a, b = stop[d] - size[d], stop[d]
        mine = best[a:b]
        edge = np.flatnonzero(np.diff(mine)) + 1
        top = int(share[d].argmax())
        out.append((m.langs[top], float(share[d, top] / share[d].sum()),
                    [(int(x), int(y), m.langs[mine[x]]) for x, y in zip([0, *edge], [*edge, b - a])]))
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """Count n-grams of at most ``max_rows`` labelled rows of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) \
        .where("lang IS NOT NULL AND lang != '' AND text IS NOT NULL AND id IS NOT NULL")
    chosen = rows.select(F.col("id").alias("c_id")).distinct().orderBy(F.xxhash64("c_id"), "c_id").limit(max_rows)
    # at most max_rows ids: small enough to send everywhere
    sample = rows.join(F.broadcast(chosen), F.col("id") == F.col("c_id")).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            counts: dict[str, list[np.ndarray]] = {}
            for lang in sorted(set(langs)):
                texts = [t for t, x in zip(batch.column(0).to_pylist(), langs) if x == lang]
                got = counts.setdefault(lang, [])
                for part in _by_chars(texts):
                    w = cut(part)
                    got += [w.gram, len(ORDERS) * BUCKETS + np.repeat(w.script, w.length).astype(np.int64)]
                got.append(np.full(len(texts), len(ORDERS) * BUCKETS + len(SCRIPTS)))
            for lang, got in counts.items():
                bucket, times = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket)), pa.array(bucket.astype(np.int32)), pa.array(times)], ["lang", "bucket", "n"])

    counts = sample.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    total = np.zeros((len(ORDERS) * BUCKETS + len(SCRIPTS) + 1, len(langs)))
    if langs:
        total[counts.column("bucket").to_numpy(), np.searchsorted(langs, counts.column("lang").to_pylist())] = counts.column("n").to_numpy()
    grams = total[:len(ORDERS) * BUCKETS].reshape(len(ORDERS), BUCKETS, len(langs))
    logp = np.log((grams + 0.1) / (grams.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)).reshape(len(ORDERS) * BUCKETS, len(langs))
    # one scale for all orders: their evidence overlaps
    script = total[len(ORDERS) * BUCKETS:-1]
    allowed = script >= np.maximum(1, MIN_SHARE * script.sum(axis=0))
    allowed[~allowed.any(axis=1)] = True
    prior = np.log(total[-1] + 1) - np.log(max(1.0, (total[-1] + 1).sum()))
    return Model(langs, (logp / len(ORDERS) * 2).astype(np.float32), allowed, prior)


def _by_chars(texts: list[str], limit: int = CHARS) -> Iterator[list[str]]:
    part, chars = [], 0
    for t in texts:
        if part and chars + len(t) > limit:
            yield part
            part, chars = [], 0
        part.append(t)
        chars += len(t)
    if part:
        yield part


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``language``: (lang_pred, score, spans of (start, stop, lang) over words)."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))  # languages x buckets, whatever the rows

    @F.pandas_udf("lang_pred string, score double, spans array<struct<start:int,stop:int,lang:string>>")
    def labels(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for batch in batches:
            rows = []
            for part in _by_chars([t if isinstance(t, str) else "" for t in batch], GROUP):
                rows += label(part, model)
            spans = [[{"start": a, "stop": b, "lang": x} for a, b, x in s] for _, _, s in rows]
            yield pd.DataFrame({"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "spans": spans})

    return docs.withColumn("language", labels(F.col(text_col)))
