"""The stages on odd rows: each on what its predecessor kept, each decision against brute force."""

from collections import Counter

import corpus_pipeline as pipeline
import pytest
from loom.llm import toxicity as toxic
from loom.llm.common import written

from tests.llm.test_corpus_operators import jaccard_by_hand, lines_by_hand, mix_by_hand, odd  # noqa: F401

SF = "/root/testdata/sf0.001"


def plain(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, odd):  # noqa: F811
    docs, seen = odd[0], []
    for name, stage in pipeline.STAGES:
        after = written(stage(spark, docs, SF), "test-stage")
        seen.append((name, docs, after))
        docs = after
    return seen


def test_stage_names():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing", "packing"]


def test_columns_stay(stages):
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_toxic_documents_go(spark, stages):
    from loom.llm.common import table

    _, before, after = stages[0]
    scored = toxic.toxicity(before, table(spark, SF, "labels")).collect()
    assert Counter(r.doc_id for r in scored if not r.predicted) == Counter(r.doc_id for r in after.collect())


def test_lines_go(stages):
    _, before, after = stages[1]
    assert Counter((i, t) for i, _, _, t in lines_by_hand(plain(before))) == Counter((i, t) for i, t, _ in plain(after))


def test_one_of_each_group_stays(stages):
    _, before, after = stages[2]
    want = {r[1] for r in jaccard_by_hand(plain(before)) if r[1] is not None}
    got = Counter(i for i, *_ in plain(after))
    assert {i for i in got if i is not None} == want
    assert all(n == 1 for i, n in got.items() if i is not None)
    assert set(plain(after)) <= set(plain(before))


def test_mix_takes_its_words(stages):
    _, before, after = stages[3]
    want = Counter()
    for i, _, _, _, taken in mix_by_hand(plain(before)):
        want[i] += taken
    got = Counter()
    for i, t, _ in plain(after):
        got[i] += len((t or "").split())
    assert +got == +want


def test_all_tokens_are_packed(stages):
    _, before, after = stages[4]
    ends = Counter(i for i, *_ in plain(before))
    by = Counter()
    for r in after.collect():
        by[r.doc_id] += r.start + r.length == r.doc_tokens
    assert by == ends


def test_run_on_empty_tables(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_keeps_the_order_of_stages(spark):
    out = pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert 0 < out.select("doc_id").distinct().count() < 200
