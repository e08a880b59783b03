import zlib

import numpy as np
import pytest
from helpers import docs, prose

from trolley.llm import training_order as T


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 255, 1000, 4097])
def test_permutation_is_a_keyed_bijection(n):
    x = T.permute(np.arange(n), n, 11)
    assert sorted(x) == list(range(n)) and np.array_equal(T.permute(x, n, 11, inverse=True), np.arange(n))
    if n > 200:
        assert not np.array_equal(x, T.permute(np.arange(n), n, 12)) and np.mean(x == np.arange(n)) < 0.05


def stream_of(spec):
    seqs = list(T.read_slots(spec, 0, spec["sequences"]))
    order = T.permute(np.arange(spec["sequences"]), spec["sequences"], spec["key"])
    return np.concatenate([seqs[s] for s in order])


def test_round_trip_manifest_and_resumed_reads(spark, tmp_path):
    texts = [None, "", "a", " ".join(prose(5000, 2)), "ünï çødé \U0001F600", "dup", "dup"] + [" ".join(prose(n, n)) for n in range(40)]
    path = str(tmp_path / "docs.parquet")
    docs(spark, texts, [None, 1, 2, 3, 4, 5, 5, *range(7, 47)]).repartition(3).write.parquet(path)
    rows, spec = T.write_shards(spark, path, str(tmp_path / "out"), length=64, per_shard=50)
    flat = stream_of(spec).tobytes()
    assert flat[spec["ids"]:] == bytes([T.BYTE_PAD]) * (len(flat) - spec["ids"])
    assert sorted(flat[:spec["ids"]].split(b"\xff")[:-1]) == sorted((t or "").encode() for t in texts)
    got = rows.orderBy("slot").collect()
    assert [r["slot"] for r in got] == list(range(spec["sequences"]))
    for r, block in zip(got, T.read_slots(spec, 0, spec["sequences"])):
        assert zlib.crc32(block.tobytes()) == r["crc32"] and (r["shard"], r["byte_offset"]) == (r["slot"] // 50, r["slot"] % 50 * 64)
    late = list(T.read_slots(spec, 47, 6))
    assert len(late) == 6 and np.array_equal(late[0], list(T.read_slots(spec, 0, 48))[47])
    again, other = T.write_shards(spark, path, str(tmp_path / "again"), length=64, per_shard=50)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))


def test_integer_ids_and_empty_table(spark, tmp_path):
    path = str(tmp_path / "ids.parquet")
    spark.createDataFrame([(1, [5, 70000, 9]), (2, []), (3, None), (4, list(range(300)))], "doc_id bigint, ids array<int>").write.parquet(path)
    _, spec = T.write_shards(spark, path, str(tmp_path / "out"), ids_col="ids", length=16, per_shard=4, dtype="uint32", end=100_000, pad=100_001)
    flat = stream_of(spec)[:spec["ids"]].tolist()
    assert len(flat) == 303 + 4 and flat.count(100_000) == 4 and 70000 in flat
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "none.parquet"))
    rows, spec = T.write_shards(spark, str(tmp_path / "none.parquet"), str(tmp_path / "no"))
    assert rows.count() == 0 and spec["sequences"] == 0
    with pytest.raises(ValueError):
        T.write_shards(spark, str(tmp_path / "none.parquet"), dtype="uint16")
