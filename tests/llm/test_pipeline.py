"""The corpus pipeline, each stage against a plain version on the stage's own input."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import contaminated, fingerprint, near_groups, without_boilerplate
from conftest import SMALL
from test_llm_operators import table

import corpus_pipeline
from plumbline.llm import quality_rules
from plumbline.llm.storage import stored


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SMALL), name))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stage_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash", "decontamination", "packing"]
    assert all(s.columns == steps[0].columns for s in steps[1:5])


def test_good_documents_stay_as_they_are(steps):
    kept = {r.doc_id for r in quality_rules.report(steps[0]).collect() if r.kept}
    before = texts(steps[0])
    assert texts(steps[1]) == {i: before[i] for i in kept}


def test_boilerplate_goes(steps):
    rows = [(r.doc_id, r.source, r.text) for r in steps[1].collect()]
    assert texts(steps[2]) == dict(zip((i for i, _, _ in rows), without_boilerplate(rows)))


def test_one_of_each_group_stays(steps):
    before = sorted(texts(steps[2]).items())
    group = near_groups([fingerprint(t) for _, t in before])
    first = {}
    for (i, t), g in zip(before, group):
        first.setdefault(g, (i, t))
    assert texts(steps[3]) == dict(first.values())


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    rng = random.Random(3)
    long_text = " ".join(rng.choice(["the", "of", "alpha", "beta", "gamma"]) + str(rng.randint(0, 99)) for _ in range(3000))
    good = [" ".join(rng.choice(["the", "of", "and"]) if k % 3 else f"word{rng.randint(0, 999)}" for k in range(80)) for _ in range(4)]
    odd = [(1, None), (2, ""), (3, " \n"), (4, good[0]), (4, good[0]), (4, good[1]), (None, good[2]), (None, good[2]), (5, good[3]), (6, good[3]), (7, long_text)]
    for rows in (odd, []):
        for items in ([(1, "alpha beta"), (2, None)], []):
            folder = str(tmp_path / f"t{len(rows)}{len(items)}")
            table(spark, [(i, t, "s") for i, t in rows], 2).write.parquet(f"{folder}/documents.parquet")
            spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
            docs = spark.read.parquet(f"{folder}/documents.parquet")
            for name, stage in corpus_pipeline.STAGES:
                out = stored(stage(spark, docs, folder), name)
                assert name == "packing" or out.columns == docs.columns
                docs = out
            assert (docs.count() > 0) == bool(rows)


def test_benchmark_words_go(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before, after = texts(steps[3]), texts(steps[4])
    assert before.keys() == after.keys()
    for (i, t), (_, hit, _) in zip(before.items(), contaminated(before.items(), items)):
        assert (after[i] == t) == (not any(hit))
    assert not any(any(hit) for _, hit, _ in contaminated(after.items(), items))


def test_every_piece_is_packed(spark, steps):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    plain, want = Tokenizer.from_file(public.path("word_bpe_49k.json")), Counter()
    for i, t in texts(steps[4]).items():
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.update((i, k, a, len(ids[a:a + 4096]), zlib.crc32(ids[a:a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096)))
    got = steps[5].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert len({r.sequence_id for r in got}) <= -(-sum(k[3] for k in want) // 4096) + 1
    assert corpus_pipeline.run(spark, SMALL).count() == len(got)
