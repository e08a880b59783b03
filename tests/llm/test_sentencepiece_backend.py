import hashlib
import struct

import numpy as np
import pytest
import sentencepiece
from helpers import docs, prose

from trolley.llm import sentencepiece_backend as B


@pytest.fixture(scope="module")
def model():
    with open(B.MODEL, "rb") as f:
        return f.read()


def test_probe_has_the_ids_of_the_sentencepiece_library(model):
    B.verify(model, [*B.PROBE, " ".join(prose(3000, 1)), "x" * 50_000])


def test_verify_finds_a_difference(model, monkeypatch):
    monkeypatch.setattr(B, "_merges", lambda spec: [])
    with pytest.raises(ValueError):
        B.verify(model, ["hello"])


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(number, body):
    return varint(number << 3 | 2) + varint(len(body)) + body


def unigram_piece(text, score, kind=1):
    return message(1, message(1, text.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + varint(kind))


def unigram_model():
    """A small unigram model file: pieces with scores, byte pieces, byte fallback."""
    piece = unigram_piece
    pieces = [piece("<unk>", 0, 2), piece("<s>", 0, 3), piece("</s>", 0, 3)] + [piece("<0x%02X>" % b, 0, 6) for b in range(256)]
    pieces += [piece(t, s, 1) for t, s in (("▁", -2.0), ("▁the", -3.0), ("▁th", -5.0), ("e", -4.0), ("re", -4.5), ("▁there", -6.0), ("a", -4.0),
                                            ("t", -4.2), ("h", -4.4), ("r", -4.6), ("at", -5.5), ("▁a", -3.5))]
    trainer = message(2, varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1))
    normaliser = message(3, message(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(1) + varint(5 << 3) + varint(1))
    return b"".join(pieces) + trainer + normaliser


def test_unigram_model_with_trimmed_spaces_and_byte_fallback():
    data = unigram_model()
    spec = B.parse(data)
    assert (spec.kind, spec.byte_fallback, spec.trim_spaces) == (B.UNIGRAM, True, True)
    texts = ["", "the", "there at", "  there   the ", "thé", "aaa the 你 there"]
    B.verify(data, texts)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    tok = B.build(data)
    assert [tok.decode(e.ids, skip_special_tokens=False) for e in tok.encode_batch(texts, add_special_tokens=False)] == [theirs.decode(theirs.encode(t)) for t in texts]


def test_encode_and_decode_tables(spark, model):
    texts = [None, "", "plain words", "tab\tand\nline", "日本語 \U0001F600", " ".join(prose(4000, 3)), "<s> ▁ </s>"]
    table = docs(spark, texts)
    rows = B.decode(B.encode(table), "ids").collect()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert [r["ids"] for r in rows] == [sp.encode(t or "") for t in texts]
    assert [r["decoded"] for r in rows] == [(t or "").replace("▁", " ") for t in texts]
    assert B.encode(table.where("false")).count() == 0


def test_the_query_decodes_every_row(spark, model, tmp_path):
    from trolley.llm.queries import QUERIES
    texts = [None, "", "  plain  words ", "tab\tand\nline", "日本語 \U0001F600", " ".join(prose(400, 3)), "<s> ▁ </s> <0x0A>", "\x00 ﬁ"]
    docs(spark, texts).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["decoded_sha256"], r["round_trip"]) for r in QUERIES["op6_sentencepiece"](spark, str(tmp_path)).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert got == {k: (hashlib.sha256(sp.decode(sp.encode(t or "")).encode()).hexdigest(), True) for k, t in enumerate(texts)}


def test_normalised_text_is_what_a_trimming_model_reads():
    data = unigram_model()
    tok, spec = B.build(data), B.parse(data)
    for text in ("", "the", "  there   the ", "thé"):
        ids = tok.encode(text, add_special_tokens=False).ids
        assert tok.decode(ids, skip_special_tokens=False) == B.normalised(tok, spec, text)


def test_runs_are_coded_as_whole_texts_are(model, monkeypatch):
    texts = ["", " ", "a", "a ", " a", "▁", "a▁ b", "  two  spaces  ", "end \n", "日本 語 \U0001F600\U0001F600", "\x00 \x01", "x" * 300 + " y", " ".join(prose(2000, 3)), "the the the"]
    monkeypatch.setattr(B, "CACHE_RUNS", 100)
    monkeypatch.setattr(B, "PROBE", tuple(t for t in B.PROBE if "<0x" not in t))  # see the module on unigram models
    for data in (model, unigram_model()):
        theirs, codec = sentencepiece.SentencePieceProcessor(model_proto=data), B.Codec(data, 1)
        assert codec.separable
        # a trimming model takes markers in a text for spaces at its ends, which stops the job
        given = [t for t in texts if data is model or B.MARKER not in t]
        for part in (given, given[::-1], *[[t] for t in given]):
            ids, decoded, read = codec.code(part)
            assert [np.frombuffer(x, np.int32).tolist() for x in ids] == [theirs.encode(t) for t in part]
            assert decoded == [theirs.decode(theirs.encode(t)) for t in part] == read
        assert all(len(run) <= B.CACHE_CHARS for run in codec.ids)


def test_a_model_whose_pieces_cross_markers_is_coded_whole(monkeypatch):
    monkeypatch.setattr(B, "PROBE", tuple(t for t in B.PROBE if "<0x" not in t))
    data = unigram_model() + unigram_piece("e▁t", -1.0)
    theirs, codec = sentencepiece.SentencePieceProcessor(model_proto=data), B.Codec(data, 1)
    texts = ["the the", "there at", "", "a"]
    ids, decoded, read = codec.code(texts)
    assert not codec.separable and not codec.ids and decoded == read
    assert [np.frombuffer(x, np.int32).tolist() for x in ids] == [theirs.encode(t) for t in texts]


def test_a_unigram_model_that_reads_piece_names_stops_the_job():
    with pytest.raises(ValueError):
        B.Codec(unigram_model(), 1)


def test_every_text_is_verified(spark, monkeypatch, model):
    codec = B.Codec(model, 1)
    codec.code(["known words"])
    codec.theirs = type("Other", (), {"encode": lambda self, x: [[-1]] * len(x) if isinstance(x, list) else [-1]})()
    codec.code(["words known words"[6:]])  # nothing new to verify
    with pytest.raises(ValueError):
        codec.code(["known words and new ones"])


def test_new_runs_are_learnt_in_bounded_lots(model, monkeypatch):
    monkeypatch.setattr(B, "LEARN_RUNS", 7)
    theirs, codec, lots = sentencepiece.SentencePieceProcessor(model_proto=model), B.Codec(model, 1), []
    learn = codec._learn
    codec._learn = lambda runs: lots.append(len(runs)) or learn(runs)
    texts = [" ".join(f"w{k}x{j}" for j in range(10)) for k in range(5)] + ["x" * 100]
    ids, decoded, _ = codec.code(texts)
    assert [np.frombuffer(x, np.int32).tolist() for x in ids] == [theirs.encode(t) for t in texts] and decoded == texts
    assert max(lots) <= 7 and sum(lots) == 51 and len(codec.ids) == 50


def test_columns_named_as_the_results(spark):
    table = docs(spark, ["one two", None]).withColumnRenamed("tkey", "ids").withColumnRenamed("words", "decoded_sha256").withColumnRenamed("doc", "ROUND_TRIP")
    out = B.encode(table, back=True)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded_sha256", "round_trip"]
    assert [(len(r["ids"]) > 0, r["round_trip"]) for r in out.orderBy("doc_id").collect()] == [(True, True), (False, True)]


def bpe_model():
    """A small BPE model file without byte pieces: what no piece holds is unknown."""
    pieces = [unigram_piece("<unk>", 0, 2), unigram_piece("<s>", 0, 3), unigram_piece("</s>", 0, 3)]
    pieces += [unigram_piece(t, -float(k)) for k, t in enumerate(("▁a", "ab", "▁ab", "▁▁", "▁", "a", "b", "c"))]
    trainer = message(2, varint(3 << 3) + varint(2))
    normaliser = message(3, message(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1))
    return b"".join(pieces) + trainer + normaliser


def test_joined_runs_have_the_ids_of_each_alone(model):
    runs = ["▁ab", "▁▁ab", "▁☃", "▁a☃☃b", "▁", "▁▁", "▁☃", "▁cab", "▁▁▁c", "▁" + "ab" * 200, *("▁" + w for w in sorted(set(prose(300, 5))))]
    for data in (bpe_model(), model):
        codec = B.Codec(data, 1)
        ids, odd = codec._learn(runs)
        assert (ids, odd) == codec._learn_alone(runs) and ids.keys() == set(runs)
        assert ("▁a☃☃b" in odd) == (data is not model) and "▁cab" not in odd
        texts, theirs = ["ab  ab ☃ a☃☃b  ", "☃☃ cab   c", "", " ", "ab ab"], sentencepiece.SentencePieceProcessor(model_proto=data)
        assert [np.frombuffer(x, np.int32).tolist() for x in codec.code(texts)[0]] == [theirs.encode(t) for t in texts]


def test_new_runs_are_joined_for_the_libraries(model):
    codec, given = B.Codec(model, 1), []
    theirs = codec.theirs
    codec.theirs = type("Counted", (), {"encode": lambda self, x: given.append(len(x) if isinstance(x, list) else 0) or theirs.encode(x)})()
    texts = [" ".join(f"w{k}x{j}" for j in range(64)) for k in range(10)]
    ids, decoded, _ = codec.code(texts)
    assert [np.frombuffer(x, np.int32).tolist() for x in ids] == [theirs.encode(t) for t in texts] and decoded == texts
    assert sum(given) == 10  # 640 new runs, 64 to a text
