"""The pipeline against its stages by brute force, on small tables written as Parquet."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from panelyard.llm import gru_toxicity, queries
from panelyard.session import scratch_path

from . import test_metric_join, test_mixing, test_wu_manber


@pytest.fixture
def folder(spark, documents, monkeypatch):
    monkeypatch.setattr(gru_toxicity, "STEPS", 60)
    r = random.Random(12)
    word = lambda: "".join(r.choice("aeioktlmn") for _ in range(4))
    texts = [" ".join(word() for _ in range(r.randrange(5, 70))) for _ in range(60)]
    item = " ".join(word() for _ in range(16))
    rows = list(enumerate(texts)) + [(60 + i, texts[i] + " end") for i in range(10)] + [(70 + i, f"{texts[20 + i]} {item}") for i in range(6)]
    rows += [(80 + i, f"{texts[30 + i]} zork {word()} zork") for i in range(12)] + [(None, "one null"), (95, None), (96, "")]
    path = scratch_path(spark, "tables")
    documents(rows, [f"s{k % 4}" if k % 7 else None for k in range(len(rows))]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(80 <= i < 92), 1) for i in range(92)], "doc_id bigint, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, item


def test_pipeline(spark, folder):
    path, item = folder
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, path).collect()))
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    model = queries.toxicity_model(spark, path)
    scorer = gru_toxicity.Scorer(model)
    docs = [d for d in docs if scorer([(d.text or "").encode()])[0] < queries.TOXIC]
    near = {x[0]: x[2] for x in test_metric_join.brute([(d.doc_id, d.text) for d in docs])}
    docs = [d for d in docs if d.doc_id is None or near[d.doc_id] == d.doc_id]
    bad = {x[0] for x in test_wu_manber.brute([(d.doc_id, d.text) for d in docs], [(1, item)], 13) if x[5]}
    docs = [d for d in docs if d.doc_id not in bad]
    assert bad and len(docs) > 30
    taken = {x[0]: x[4] for x in test_mixing.brute([(d.doc_id, d.text) for d in docs], [d.source for d in docs])}
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for d in docs:
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2]
        n = len((d.text or "").split())
        if n:
            want += [(d.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] * (taken[d.doc_id] // n)
    blank = [g for g in got if g[1] in (95, 96)]
    assert sorted((g[1:] for g in got if g[1] not in (95, 96)), key=str) == sorted(want, key=str) and all(g[2] == 1 for g in blank)
    assert [g[0] for g in got] == np.cumsum([0, *(g[2] for g in got[:-1])]).tolist()


def test_stages_keep_columns_and_take_empty_tables(spark, folder, documents):
    path, _ = folder
    docs = documents([])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() == 0
