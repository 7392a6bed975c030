"""Registered queries against their SQL, and the pipeline, on the smallest tables."""

import hashlib
import os
import sys
from collections import Counter

import pytest
import test_neardup
import test_packing
import test_substring
from llm_tables import documents
from tokenizers import Tokenizer

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]
import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402
import corpus_pipeline  # noqa: E402
from crestline.llm import catalogue, mixing  # noqa: E402
from crestline.llm.common import table  # noqa: E402


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalogue.QUERIES) == list(range(1, 14))
    assert set(catalogue.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(catalogue.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, name):
    ok, text = compare.compare(spark, compare.connect(sf), sf, name)
    assert ok, text


def test_pipeline_brute_force(spark, sf):
    """Each stage against a plain version over its own input."""
    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "repeated-passages", "source-mix", "packing"]
    results, now = {"": docs}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = results[name] = corpus_pipeline.written(stage(spark, now, sf), f"test-{name}")
        if name != "packing":
            assert now.columns == docs.columns and dict(now.dtypes) == dict(docs.dtypes)
    texts = {n: {r["doc_id"]: r["text"] for r in df.collect()} for n, df in results.items() if n != "packing"}

    judged = catalogue.QUERIES["op4_toxicity"](spark, sf)
    assert texts["toxicity"] == {i: texts[""][i] for i in (r["doc_id"] for r in judged.filter("predicted = 0").collect())}
    kept = [i for i, _, _, first in test_neardup.brute(sorted(texts["toxicity"].items())) if first]
    assert texts["near-duplicates"] == {i: texts["toxicity"][i] for i in kept}
    for i, n_words, n_removed, sha in test_substring.brute(sorted(texts["near-duplicates"].items())):
        left, before = texts["repeated-passages"][i], texts["near-duplicates"][i]
        own = (left or "").encode().split()
        assert len(own) == n_words - n_removed and (n_removed or left == before)
        assert hashlib.sha256(b" ".join(own)).hexdigest() == sha
    assert texts["source-mix"] == texts["repeated-passages"]
    plain = Tokenizer.from_file(test_packing.PATH)
    lengths = {i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts["source-mix"].items()}
    rows = results["packing"].collect()
    found = {}
    for r in rows:
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
    assert found == lengths
    assert len(test_packing.check(rows)) <= 1.02 * sum(lengths.values()) / 4096 + 1


def test_scratch_of_earlier_stages_is_dropped(spark):
    """Tables that nothing reads any more go, those that the next stage's documents read stay."""
    from crestline.llm import common

    def files(df):
        return [f.split(":", 1)[-1].removeprefix("//") for f in df.inputFiles()]

    with common.pipeline_stage(spark.range(1)):
        first, lazy = common.written(spark.range(3), "first"), common.written(spark.range(5), "lazy")
    result = common.written(first, "result")  # not of a stage
    gone, kept = files(first), files(result) + files(lazy)
    with common.pipeline_stage(lazy.filter("id > 1")):
        pass
    assert not any(os.path.exists(f) for f in gone) and all(os.path.exists(f) for f in kept)
    assert lazy.count() == 5 and result.count() == 3
    with common.pipeline_stage(result):
        pass
    assert not any(os.path.exists(f) for f in files(lazy)) and result.count() == 3


def test_pipeline_on_an_empty_table(spark, sf):
    now = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
    assert now.count() == 0


def test_sequences_follow_the_mix(spark):
    """Up to any group, the numbers of documents are those of the mix, whatever order the table has."""
    rows = [(n, "word " * (n % 40), "hot" if n % 3 else f"s{n % 4}") for n in range(3000)] + [(None, "x", "hot"), (5, "y", "s0")] * 20
    docs = documents(spark, rows).orderBy("lang", "doc_id").repartition(5)
    packed = corpus_pipeline.in_mix_order(docs, group_pieces=300).collect()
    assert len(packed) == len(rows)
    mix = [r["source"] for r in mixing.interleaved(docs).orderBy("position").select("source").collect()]
    source = {r[0]: r[2] for r in rows[:3000]}
    groups = {}
    for r in packed:
        name = "hot" if r["doc_id"] is None else source[r["doc_id"]]
        if r["doc_id"] == 5 and r["length"] == 2:
            name = "s0"
        groups.setdefault(r["sequence_id"] >> 32, Counter())[name] += 1
    assert len(groups) == 11 and sorted(groups) == list(range(11))
    done, at = Counter(), 0
    for g in sorted(groups):
        done += groups[g]
        at += sum(groups[g].values())
        assert done == Counter(mix[:at])
    test_packing.check(packed)
