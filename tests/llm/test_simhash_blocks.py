import random
import re

import xxhash
from helpers import docs, prose

from trolley.llm import simhash_blocks as S


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    root = {i: i for i in prints}
    find = lambda i: i if root[i] == i else find(root[i])
    for i, x in prints.items():
        for j, y in prints.items():
            if i < j and (x ^ y).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in prints}


def test_fingerprints_and_components_equal_brute_force(spark):
    base = prose(300, 1)
    texts = [None, "", " \t", "One", "one", "one two", "One two Three", " ".join(base), " ".join(base).upper(), " ".join(base[:-1] + ["q"]),
             " ".join(base[1:]), " ".join(prose(300, 2)), " ".join(prose(40_000, 3)), "a\x1cb c", "é É"]
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in S.near_copies(docs(spark, texts)).collect()}
    assert {i: p for i, (p, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == components(prints)


def test_links_of_hot_and_small_keys_give_the_same_components(spark):
    random.seed(3)
    seeds = [random.getrandbits(64) for _ in range(4)]
    values = {x ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for x in seeds for _ in range(40)} | {random.getrandbits(64) for _ in range(50)}
    values |= {seeds[0] ^ 0b111000, seeds[0] ^ 0b111111 << 20}
    prints = {S._signed(v): v for v in values}
    want = components({k: prints[k] for k in sorted(prints)})
    fps = spark.createDataFrame([(k,) for k in prints], "fp bigint")
    for hot in (2, 1000):
        got = {r["node"]: r["root"] for r in S.components(S.links(fps, hot=hot)).collect()}
        assert {k: got.get(k, k) for k in prints} == want


def test_keep_one_and_empty_table(spark):
    text = " ".join(prose(100, 5))
    table = docs(spark, [text, text, None, "", "alone here"], [7, 3, 9, None, 5])
    assert sorted(r["doc_id"] or -1 for r in S.keep_one(table).collect()) == [-1, 3, 5, 9]
    assert S.near_copies(table.where("false")).count() == 0
