"""What Python workers hold: one worker for a task that masks, one operator's model at a time."""

import re

import public_tokenizers as P
import pyarrow as pa

from tidepanel.llm import bpe, pii, toxicity


def test_masking_takes_one_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "mail a@b.example.com, call +49 30 1234567", 41), (2, None, None)], "doc_id long, text string, n_chars int")
    masked = pii.redact(docs)
    plan = masked._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow", plan)) == 1, plan
    assert masked.orderBy("doc_id").collect() == [(1, "mail [email], call [phone]", 26), (2, None, None)]
    joined = pii.redact(docs, few=-1)  # patterns joined with the documents
    assert joined.columns == docs.columns and joined.orderBy("doc_id").collect() == masked.orderBy("doc_id").collect()


def test_workers_hold_one_model(spark):
    docs = spark.range(400).selectExpr("id doc_id", "concat('kind words number ', id, if(id % 3 = 0, ' nasty fool.', '.')) text").repartition(16)
    labels = spark.range(400).selectExpr("id doc_id", "cast(id % 3 = 0 as int) toxic")
    path = P.path("byte_bpe_multi_50k.tiktoken")

    def look(batches):
        import sys
        import time

        time.sleep(0.2)
        held = list(vars(sys.modules["_tidepanel_worker"]).values()) if "_tidepanel_worker" in sys.modules else []
        models = [type(m).__name__ for v in held for m in (v.values() if type(v) is dict else [v])]
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(m in ("NoisyOr", "ByteBPE") for m in models)], pa.int64())], ["n"])

    for _ in range(2):
        assert toxicity.score_toxicity(docs, labels).count() == 400
        assert bpe.encode_documents(docs, path, P.PATTERN).agg({"n_tokens": "sum"}).first()[0] > 400
    counts = [r["n"] for r in docs.select("doc_id").mapInArrow(look, "n long").collect()]
    assert max(counts) == 1, counts
