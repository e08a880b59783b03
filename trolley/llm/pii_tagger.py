"""Personal data: rules for the plain forms, a character BiLSTM with CRF transitions for the rest.

Rules find e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers; what they find
always stays. The tagger reads characters as shapes (digit, lower case, upper case, other letter,
each ASCII mark), runs an LSTM in both directions, and a linear-chain CRF gives the best
sequence of tags (begin and inside of each kind, or outside).

Training (numpy, on the driver). Labelled spans come from the rules' forms in at most ``max_rows``
distinct texts, those of the smallest hashes, so the sample is the same on every run and does not
grow with the table; only their windows of ``WIDTH`` characters travel, at most
``max_windows``. Each phone and card span is also written in another way (without its prefix, with
other separators), so that the tagger learns forms beyond the rules.

Tagging. A text is covered by windows of ``WIDTH`` characters, half of them shared with the next. A span
the tagger may add holds a digit or an ``@`` outside the rules' spans, so only windows with one in
their middle half are run; the others cannot change the result. Windows are decoded one by one (Viterbi) and
reconciled over the whole text: spans that a window's edge cuts go, the others must be well formed for their
kind, and of overlapping ones the set with the largest total score stays. Nothing is shuffled.

Defined cases: null and empty texts have no spans; texts without digits and ``@`` are not tagged; long
texts are read whole, in time linear in their length; without training windows the rules alone count; repeated rows are
alike; an empty table gives an empty result. Only the id and text columns are read and returned,
so other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE, HIDDEN = 128, 64, 16
N_TAGS = 1 + 2 * len(KINDS)
MAX_ROWS, MAX_WINDOWS = 1500, 1500
_BATCH = 1024
_SLICE = 1 << 22

Span = tuple[str, int, int]

# ---- rules ------------------------------------------------------------------------------

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile("[0-9@]")


def _n_digits(s: str) -> int:
    return sum("0" <= c <= "9" for c in s)


def luhn(s: str) -> bool:
    """Whether the digits of ``s`` pass the Luhn check."""
    total = 0
    for k, c in enumerate(reversed([c for c in s if "0" <= c <= "9"])):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    # a local part ends at an "@" and cannot cross one: each is looked for backwards from its "@"
    done, at = 0, text.find("@")
    while at >= 0:
        head = text[done:at]
        local = len(head) - len(head.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if local else None
        if m:
            yield "email", at - local, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[Span]:
    runs = [(m.start(), m.end()) for m in _DIGITS.finditer(text)]
    k = 0
    while k + 3 < len(runs):
        four = runs[k:k + 4]
        if all(b - a == 1 and text[a] == "." for (_, a), (b, _) in zip(four, four[1:])):
            if all(len(part) <= 3 and int(part) <= 255 for part in (text[a:b].lstrip("0") or "0" for a, b in four)):
                yield "ip", four[0][0], four[3][1]
            k += 4
        else:
            k += 1


def _forms(text: str) -> Iterator[Span]:
    """The rules' spans, card numbers without their Luhn check."""
    yield from _emails(text)
    yield from _ips(text)
    for kind, pattern, low, high in (("card", _CARD, 14, 19), ("phone", _PHONE, 10, 15)):
        for m in pattern.finditer(text):
            if m.end() - m.start() >= low and low <= _n_digits(m.group()) <= high:
                yield kind, m.start(), m.end()


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def rule_spans(text: str | None) -> list[Span]:
    """Spans of the rules by start, then kind; leftmost and not overlapping within a kind."""
    if not text or not _TRIGGER.search(text):
        return []
    return in_order([s for s in _forms(text) if s[0] != "card" or luhn(text[s[1]:s[2]])])


def well_formed(kind: str, text: str, start: int, end: int) -> bool:
    """Whether a span that the tagger proposes can be of its kind."""
    s = text[start:end]
    before, after = text[max(0, start - 1):start], text[end:end + 1]
    if kind == "email":
        local, _, domain = s.partition("@")
        return bool(local.strip()) and "@" not in domain and "." in domain.strip().strip(".") and not (before.isalnum() or after.isalnum())
    if before.isdigit() or after.isdigit():
        return False
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts) \
            and before != "." and not re.match(r"\.[0-9]", text[end:end + 2])
    if kind == "card":
        return bool(re.fullmatch(r"[0-9]+(?:[ ./-][0-9]+)*", s)) and 13 <= _n_digits(s) <= 19 and luhn(s)
    return bool(re.fullmatch(r"\+?[0-9(][ ()./0-9-]+[0-9]", s)) and 10 <= _n_digits(s) <= 15 and s.count("(") == s.count(")") \
        and not re.fullmatch(r"[0-9]+", s) and not re.fullmatch(r"[0-9]+(\.[0-9]+)+", s)


# ---- characters and windows -------------------------------------------------------------

_SHAPE = np.full(128, 5, np.uint8)  # 0 nothing, 1 digit, 2 lower case, 3 upper case, 4 above ASCII, 5 control
_SHAPE[48:58], _SHAPE[97:123], _SHAPE[65:91] = 1, 2, 3
_MARKS = [c for c in range(32, 127) if not chr(c).isalnum()] + [10]
_SHAPE[_MARKS] = np.arange(6, 6 + len(_MARKS))
N_SHAPES = 6 + len(_MARKS)


def shapes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, _SHAPE[np.minimum(points, 127)], np.uint8(4))


def window_starts(n: int, places: np.ndarray) -> np.ndarray:
    """Starts of the windows of a text of ``n`` characters that hold one of ``places`` in their middle half."""
    last = max(0, -(-(n - WIDTH) // STRIDE))
    return np.unique(np.clip((places - (WIDTH - STRIDE) // 2) // STRIDE, 0, last)) * STRIDE


def _cut(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(starts), WIDTH), np.uint8)
    for k, s in enumerate(starts):
        part = codes[s:s + WIDTH]
        out[k, :len(part)] = part
    return out


def _tags(n: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(n, np.uint8)
    for kind, a, b in spans:
        if not tags[a:b].any():
            k = 1 + 2 * KINDS.index(kind)
            tags[a:b] = k + 1
            tags[a] = k
    return tags


def _rewritten(text: str, span: Span, draw: int) -> str:
    """The same number written in another way."""
    s = text[span[1]:span[2]]
    if span[0] == "phone":
        bare = re.sub(r"^\+[0-9]{1,2}[ .-]?", "", s)
        return bare if _n_digits(bare) >= 10 and draw % 3 else s.replace(" ", ".-/"[draw % 3]).replace("-", ".-/"[draw % 3])
    digits, gap = re.sub("[^0-9]", "", s), " -./"[draw % 4]
    return gap.join(digits[k:k + 4] for k in range(0, len(digits), 4))


def training_windows(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shapes, tags) of the windows around every digit and ``@``, and around rewritten spans."""
    spans, codes = list(_forms(text)), shapes(text)
    tags = _tags(len(text), spans)
    starts = window_starts(len(text), np.array([m.start() for m in _TRIGGER.finditer(text)], np.int64))
    out = list(zip(_cut(codes, starts), _cut(tags, starts)))
    for span in spans:
        if span[0] in ("card", "phone"):
            draw = xxhash.xxh32_intdigest(text[span[1]:span[2]].encode())
            new = shapes(_rewritten(text, span, draw))
            lead = min(span[1], 20 + draw % 60)
            tagged = _tags(len(new), [(span[0], 0, len(new))])
            whole = [np.concatenate([x[span[1] - lead:span[1]], y, x[span[2]:span[2] + WIDTH]])[:WIDTH] for x, y in ((codes, new), (tags, tagged))]
            out.append(tuple(_cut(x, np.zeros(1, int))[0] for x in whole))
    return out


# ---- the tagger -------------------------------------------------------------------------

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(p: Params, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (n, WIDTH, 2 HIDDEN) of both directions, and with ``keep`` what their gradients need."""
    n, width = codes.shape
    both = np.stack([codes, codes[:, ::-1]])
    h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    states, cache = np.empty((2, width, n, HIDDEN), np.float32), []
    for t in range(width):
        z = np.matmul(h, p["u"])
        z[0] += p["x"][0][both[0, :, t]]
        z[1] += p["x"][1][both[1, :, t]]
        gates, g = _sigmoid(z[:, :, :3 * HIDDEN]), np.tanh(z[:, :, 3 * HIDDEN:])
        i, f, o = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:2 * HIDDEN], gates[:, :, 2 * HIDDEN:]
        new = f * c + i * g
        squashed = np.tanh(new)
        if keep:
            cache.append((i, f, o, g, c, squashed, h))
        c, h = new, o * squashed
        states[:, t] = h
    return np.concatenate([states[0], states[1][::-1]], axis=2).transpose(1, 0, 2), cache


def _lstm_gradients(p: Params, codes: np.ndarray, cache: list, d: np.ndarray) -> Params:
    n, width = codes.shape
    both = np.stack([codes, codes[:, ::-1]])
    back = np.stack([d[:, :, :HIDDEN].transpose(1, 0, 2), d[:, ::-1, HIDDEN:].transpose(1, 0, 2)])
    dz, du = np.empty((2, width, n, 4 * HIDDEN), np.float32), np.zeros_like(p["u"])
    dh, dc, turned = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32), p["u"].transpose(0, 2, 1)
    for t in reversed(range(width)):
        i, f, o, g, c, squashed, h = cache[t]
        dh = dh + back[:, t]
        dc = dc + dh * o * (1 - squashed ** 2)
        z = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g ** 2)], axis=2)
        du += np.matmul(h.transpose(0, 2, 1), z)
        dh, dc = np.matmul(z, turned), dc * f
        dz[:, t] = z
    dx = np.empty_like(p["x"])
    for k in (0, 1):
        one = np.zeros((N_SHAPES, width * n), np.float32)
        one[both[k].T.ravel(), np.arange(width * n)] = 1
        dx[k] = one @ dz[k].reshape(width * n, -1)
    return {"x": dx, "u": du}


def _crf(p: Params, e: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(mean negative log likelihood, gradient of the emissions, gradient of the transitions)."""
    n, width, _ = e.shape
    top = e.max(axis=2, keepdims=True)
    w, a = np.exp(e - top).astype(np.float64), np.exp(p["a"]).astype(np.float64)
    ahead, scale = np.empty(w.shape), np.empty((n, width))
    for t in range(width):
        now = w[:, 0] if t == 0 else (ahead[:, t - 1] @ a) * w[:, t]
        scale[:, t] = now.sum(axis=1)
        ahead[:, t] = now / scale[:, t, None]
    behind, da = np.ones((n, w.shape[2])), np.zeros_like(a)
    marginal = np.empty(w.shape)
    marginal[:, -1] = ahead[:, -1]
    for t in range(width - 1, 0, -1):
        right = w[:, t] * behind / scale[:, t, None]
        da += (ahead[:, t - 1].T @ right) * a
        behind = right @ a.T
        marginal[:, t - 1] = ahead[:, t - 1] * behind
    rows, at = np.arange(n)[:, None], np.arange(width)[None, :]
    path = e[rows, at, tags].sum() + p["a"][tags[:, :-1], tags[:, 1:]].sum()
    loss = np.log(scale).sum() + top.sum() - path
    marginal[rows, at, tags] -= 1
    np.add.at(da, (tags[:, :-1], tags[:, 1:]), -1)
    return float(loss) / n, (marginal / n).astype(np.float32), (da / n).astype(np.float32)


def emissions(p: Params, codes: np.ndarray) -> np.ndarray:
    return _lstm(p, codes)[0] @ p["w"] + p["b"]


def loss_and_gradients(p: Params, codes: np.ndarray, tags: np.ndarray) -> tuple[float, Params]:
    h, cache = _lstm(p, codes, keep=True)
    loss, de, da = _crf(p, h @ p["w"] + p["b"], tags)
    grads = _lstm_gradients(p, codes, cache, de @ p["w"].T)
    return loss, grads | {"w": np.einsum("nth,ntk->hk", h, de), "b": de.sum(axis=(0, 1)), "a": da}


def train(codes: np.ndarray, tags: np.ndarray, epochs: int = 14, batch: int = 40, step: float = 0.03, seed: int = 5) -> Params | None:
    """Adam on the likelihood of the tags; None without windows."""
    if not len(codes):
        return None
    rng = np.random.default_rng(seed)
    p = {"x": rng.normal(0, 0.3, (2, N_SHAPES, 4 * HIDDEN)), "u": rng.normal(0, 0.2, (2, HIDDEN, 4 * HIDDEN)),
         "w": rng.normal(0, 0.2, (2 * HIDDEN, N_TAGS)), "b": np.zeros(N_TAGS), "a": np.zeros((N_TAGS, N_TAGS))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["x"][:, :, HIDDEN:2 * HIDDEN] += 1  # remember at first
    one, two, t = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for epoch in range(epochs):
        for ids in np.array_split(rng.permutation(len(codes)), -(-len(codes) // batch)):
            t += 1
            _, grads = loss_and_gradients(p, codes[ids], tags[ids])
            norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads.values()))
            pace = step * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / max(norm, 1e-9))
                one[k], two[k] = 0.9 * one[k] + 0.1 * g, 0.999 * two[k] + 0.001 * g * g
                p[k] = p[k] - (pace * (one[k] / (1 - 0.9 ** t)) / (np.sqrt(two[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
    return p


def viterbi(p: Params, e: np.ndarray) -> np.ndarray:
    """The best tags of each window."""
    n, width, k = e.shape
    back, best = np.empty((width, n, k), np.uint8), e[:, 0]
    for t in range(1, width):
        to = best[:, :, None] + p["a"]
        back[t] = to.argmax(axis=1)
        best = to.max(axis=1) + e[:, t]
    tags = np.empty((n, width), np.uint8)
    tags[:, -1] = best.argmax(axis=1)
    for t in range(width - 1, 0, -1):
        tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
    return tags


def _window_spans(tags: np.ndarray, e: np.ndarray) -> Iterator[tuple[int, str, int, int, float]]:
    """(window, kind, start, end, score) of every tagged span: the score is what its tags gain over none."""
    gain = np.take_along_axis(e, tags[:, :, None].astype(np.int64), axis=2)[:, :, 0] - e[:, :, 0]
    kind = (tags.astype(np.int64) + 1) // 2
    new = (tags > 0) & ((tags % 2 == 1) | np.pad(kind[:, 1:] != kind[:, :-1], ((0, 0), (1, 0)), constant_values=True))
    for row, start in zip(*(x.tolist() for x in np.nonzero(new))):
        end = start + 1
        while end < WIDTH and tags[row, end] and not new[row, end]:
            end += 1
        yield row, KINDS[kind[row, start] - 1], start, end, float(gain[row, start:end].sum())


def reconcile(found: list[tuple[str, int, int, float]]) -> list[Span]:
    """Spans that do not overlap, with the largest total score; of equal totals the one that ends first."""
    rows = sorted(set(found), key=lambda s: (s[2], s[1], KINDS.index(s[0]), -s[3]))
    ends = [s[2] for s in rows]
    total, take = [0.0], []
    for k, (_, start, _, score) in enumerate(rows):
        free = int(np.searchsorted(ends[:k], start, side="right"))
        take.append(free if total[free] + score > total[k] else -1)
        total.append(max(total[k], total[free] + score))
    out, k = [], len(rows)
    while k:
        if take[k - 1] >= 0:
            out.append(rows[k - 1][:3])
            k = take[k - 1]
        else:
            k -= 1
    return out[::-1]


def tag_texts(p: Params | None, texts: list[str], known: list[list[Span]]) -> list[list[Span]]:
    """What the tagger adds to the ``known`` spans of each text."""
    jobs, codes, covers = [], [], {}
    for k, text in enumerate(texts):
        places = np.array([m.start() for m in _TRIGGER.finditer(text)], np.int64) if p else np.zeros(0, np.int64)
        if len(places):
            edges = np.zeros(len(text) + 1, np.int32)
            for _, a, b in known[k]:
                edges[a] += 1
                edges[b] -= 1
            covers[k] = np.cumsum(edges) > 0
            places = places[~covers[k][places]]
        if len(places):
            starts = window_starts(len(text), places)
            jobs += [(k, int(s)) for s in starts]
            codes.append(_cut(shapes(text), starts))
    found: list[list] = [[] for _ in texts]
    codes = np.concatenate(codes) if codes else np.zeros((0, WIDTH), np.uint8)
    for x in range(0, len(jobs), _BATCH):
        e = emissions(p, codes[x:x + _BATCH])
        for row, kind, a, b, score in _window_spans(viterbi(p, e), e):
            k, at = jobs[x + row]
            text = texts[k]
            if score <= 0 or (a == 0 and at > 0) or (b == WIDTH and at + WIDTH < len(text)):
                continue
            piece = text[at + a:at + b]
            a, b = at + a + len(piece) - len(piece.lstrip()), at + b - (len(piece) - len(piece.rstrip()))
            if a < b and not covers[k][a:b].any() and well_formed(kind, text, a, b):
                found[k].append((kind, a, b, round(score, 3)))
    return [reconcile(x) for x in found]


# ---- Spark ------------------------------------------------------------------------------

def fit(docs: DataFrame, text_col: str = "text", max_rows: int = MAX_ROWS, max_windows: int = MAX_WINDOWS, **options) -> Params | None:
    """Train on the rules' forms in at most ``max_rows`` distinct texts that hold a digit or an ``@``."""
    keyed = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("place"))
    chosen = keyed.select(F.col("place").alias("p")).distinct().orderBy("p").limit(max_rows)  # max_rows numbers
    sample = keyed.join(F.broadcast(chosen), F.col("place") == F.col("p")).select("place", "text").dropDuplicates(["place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = training_windows(text.as_py())
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([place] * len(got)), pa.array(range(len(got)), pa.int64()),
                                                      *[pa.array([w[k].tobytes() for w in got], pa.binary()) for k in (0, 1)]], ["place", "no", "shapes", "tags"])

    got = sample.mapInArrow(run, "place bigint, no bigint, shapes binary, tags binary") \
        .orderBy(F.xxhash64("place", "no"), "place", "no").limit(max_windows).toArrow()
    codes, tags = (np.frombuffer(b"".join(got.column(c).to_pylist()), np.uint8).reshape(-1, WIDTH) for c in ("shapes", "tags"))
    return train(codes, tags, **options)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of slices of about ``_SLICE`` bytes; a larger text is a slice of its own."""
    first, size = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if k > first and size + n > _SLICE:
            yield first, k - first
            first, size = k, 0
        size += n
    if first < len(texts):
        yield first, len(texts) - first


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(docs: DataFrame, model: Params | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, base, spans): spans of the rules, and all spans with those that the tagger adds, as (kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some ten thousand numbers, whatever the data
    plain = docs.select(id_col, text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in _slices(batch.column(1)):
                part = batch.slice(first, n)
                texts = [t.as_py() or "" for t in part.column(1)]
                base = [rule_spans(t) for t in texts]
                every = [in_order(b + more) for b, more in zip(base, tag_texts(shared.value, texts, base))]
                lists = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in row] for row in rows], kind) for rows in (base, every)]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*part.schema.names, "base", "spans"])

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(run, f"{given}, base {_SPANS}, spans {_SPANS}")


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(found: DataFrame, text_col: str = "text") -> DataFrame:
    """``found`` with every span of the texts replaced by its kind in brackets; spans that overlap become one of the first's kind."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        lead = F.substr(F.col(text_col), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], lead, mark).alias("out"))

    text = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substr(F.col(text_col), acc["at"] + 1)))
    return found.withColumn(text_col, text)
