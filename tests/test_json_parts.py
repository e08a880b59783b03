"""Objects of a JSON document read in splits equal those of a parser."""

import json
import random

import pytest

from trolley.sources.json_parts import document_objects


def documents(seed):
    rng = random.Random(seed)
    odd = ["plain", "a}b", "{", 'quote " inside', "back\\slash", 'ends with \\"', "}{}", "é \u2028 \U0001F600", "[", "", "x" * 200, '"playlists": [ {']

    def thing(depth=0):
        out = {rng.choice(odd) + str(k): rng.choice(odd) for k in range(rng.randint(0, 3))}
        if depth < 2 and rng.random() < 0.6:
            out["tracks"] = [thing(depth + 1) for _ in range(rng.randint(0, 3))]
        return out

    for _ in range(5):
        doc = {"info": thing(), "slice": rng.choice(odd), "playlists": [{"pid": k, **thing()} for k in range(rng.randint(0, 40))], "a}b": [thing()], "tags": ["{", "}"]}
        keys = list(doc)
        rng.shuffle(keys)
        yield {k: doc[k] for k in keys}


@pytest.mark.parametrize("size", ["400", "128m"])
def test_objects_equal_those_of_a_parser(spark, tmp_path, size):
    want = []
    for n, doc in enumerate(documents(3)):
        text = json.dumps(doc, ensure_ascii=n % 2 == 0, indent=[None, 1, "\t"][n % 3])
        (tmp_path / f"d{n}.json").write_text(text + "\n" * (n % 2))
        want += [(n, x) for x in doc["playlists"]]
    (tmp_path / "e.json").write_text("{}")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], "1")
        rows = document_objects(spark, str(tmp_path), "playlists").orderBy("no").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [(int(r["file"][-6]), json.loads(r["text"])) for r in rows] == want


def test_a_document_is_not_broadcast_and_its_objects_stay_spread(spark, tmp_path, monkeypatch):
    """The pieces' places pack so well that the planner took them for small: 1,110 MB were broadcast for 4.5 million pieces."""
    from trolley.sources import json_parts
    (tmp_path / "d.json").write_text(json.dumps({"info": {"a": 1}, "playlists": [{"pid": k, "tracks": [{"t": "x"}] * 3} for k in range(50)]}))
    plans, write = {}, json_parts.materialize
    monkeypatch.setattr(json_parts, "materialize", lambda df: plans.setdefault(tuple(df.columns), df._jdf.queryExecution().sparkPlan().toString()) and write(df))
    rows = document_objects(spark, str(tmp_path), "playlists")
    assert sorted(json.loads(r["text"])["pid"] for r in rows.collect()) == list(range(50))
    joins = [x for x in plans["file", "no", "key", "text"].splitlines() if "Join [line_no" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = document_objects(spark, str(tmp_path), "playlists")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [file" in plan  # by their file, all objects would go to one task
