"""Registered queries without SQL, and the stages of the pipeline, against brute force on the smallest given tables."""

import collections
import hashlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from foldsmith.scratch import materialise
from tests.llm import fixture

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def items(spark):
    return {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}


def holds(text, item):
    """The item's words stand in the text, but for case and what is glued to the first and last one."""
    t, w = fixture.words(text.lower()), fixture.words(item.lower())
    inner = w[1:-1]
    return any(t[i : i + len(inner)] == inner for i in range(len(t) - len(inner) + 1))


def test_all_operators_and_the_pipeline_are_registered():
    names = [n for n in QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in QUERIES


def test_near_dedup(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op1_minhash_near_dedup"](spark, SF).collect()}
    want = fixture.near_duplicates(list(texts.items()))
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_shards(spark, texts):
    got = QUERIES["op3_shards"](spark, SF).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["text_crc32"] == fixture.crc(texts[r["doc_id"]]) and r["size"] == len(texts[r["doc_id"]].encode()) + 16
    assert len(got) == len(texts) and {r["doc_id"] for r in got} == set(texts)
    assert all(sorted(v) == list(range(5)) for v in slots.values()) and set(slots) == set(range(40))


def test_decontamination(spark, texts, items):
    got = {(r["doc_id"], i) for r in QUERIES["op4_benchmark_decontamination"](spark, SF).collect() for i in r["items"]}
    assert got == {(d, i) for d, t in texts.items() for i, x in items.items() if holds(t, x)} and got


def test_secrets(spark, texts):
    kinds = [k for k, *_ in fixture.BASE]
    for r in QUERIES["op6_secret_scan"](spark, SF).collect():
        want = sorted(fixture.secret_spans(texts[r["doc_id"]]))
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[1] == i for s in want) for i in range(3)]
        listed = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(r["spans"].split(","))


def test_toxicity_held_out(spark):
    """Scores of held-out labelled rows rank toxic ones first."""
    sf = "/root/testdata/sf0.1"
    scored = QUERIES["op7_toxicity"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = sorted((r["score"], r["toxic"], r["predicted"]) for r in scored.select("score", "toxic", "predicted").collect())
    bad, good = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    won = sum(b[0] > g[0] for b in bad for g in good) / (len(bad) * len(good))
    assert won > 0.97 and sum(g[2] for g in good) <= 0.01 * len(good)


def test_line_passages(spark, texts):
    """Exactly what all windows of two lines with text say: recall and precision are 1."""
    got = QUERIES["op9_line_chunk_dedup"](spark, SF).collect()
    from tests.llm.test_operators import passages_by_brute_force

    want = passages_by_brute_force(list(texts.items()))
    assert {(r["doc_id"], r["kept_sha256"]) for r in got} == {(d[0], hashlib.sha256(k.encode()).hexdigest()) for d, k in want.items()}
    assert sum(r["n_removed"] for r in got) > 0


def test_pipeline_stages(spark, docs, texts, items):
    """Each stage is judged on its own input."""
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "decontamination", "source_mix", "shards"]
    first = materialise(stages["quality_rules"](spark, docs, SF), "t-1")
    one = {r["doc_id"]: r["text"] for r in first.collect()}
    for d, t in texts.items():
        n, *_, again = fixture.quality(t)
        assert d not in one or (n >= 50 and 100 * again <= 50 * n)
    assert all(set(t.split("\n")) <= set(texts[d].split("\n")) for d, t in one.items()) and len(one) > 0.7 * len(texts)
    second = materialise(stages["near_dedup"](spark, first, SF), "t-2")
    two = {r["doc_id"]: r["text"] for r in second.collect()}
    assert two == {d: one[d] for d, (_, c) in fixture.near_duplicates(list(one.items())).items() if d == c}
    third = materialise(stages["decontamination"](spark, second, SF), "t-3")
    three = {r["doc_id"]: r["text"] for r in third.collect()}
    assert three == {d: t for d, t in two.items() if not any(holds(t, x) for x in items.values())}
    fourth = materialise(stages["source_mix"](spark, third, SF), "t-4")
    copies = collections.Counter(r["doc_id"] for r in fourth.collect())
    assert set(copies) <= set(three) and max(copies.values()) <= 2
    size = {d: len(fixture.words(t)) for d, t in three.items()}
    mixed = sum(size[d] * n for d, n in copies.items())
    assert abs(mixed - 1.5 * sum(size.values())) <= 20 * max(size.values()) / 2
    last = stages["shards"](spark, fourth, SF).collect()
    assert collections.Counter(r["doc_id"] for r in last) == copies
    assert all(d.columns == docs.columns for d in (first, second, third, fourth))
