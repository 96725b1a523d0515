"""What the pipeline's stages hold in an executor: Python workers of a task, and rows that are shuffled."""

import numpy as np

from casewright.llm import sentencepiece_scan, simhash


def _two_workers_a_task(node, fed=False):
    """Whether a Python function gets its rows from another one in the same task."""
    name = node.nodeName()
    if fed and name in ("MapInArrow", "FlatMapGroupsInArrow"):
        return True
    fed = name == "MapInArrow" or fed and name in ("Project", "Filter", "Union")
    return any(_two_workers_a_task(node.children().apply(i), fed) for i in range(node.children().size()))


def test_tokens_take_one_python_worker_a_task(spark, frame, odd_rows):
    model, docs = sentencepiece_scan.default_model(), frame(odd_rows)
    rows = sentencepiece_scan.token_rows(docs, model, chunk=30_000)
    assert not _two_workers_a_task(rows._jdf.queryExecution().optimizedPlan())
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids) for r in rows.collect())
    want = sentencepiece_scan.encode_documents(docs, model, chunk=30_000).collect()
    assert got == sorted((r.doc_id or 0, len(r.ids) // 4, np.frombuffer(r.ids, "<i4").tolist()) for r in want)
    assert rows.schema.simpleString() == "struct<doc_id:bigint,n_tokens:bigint,ids:array<int>>"


def test_keys_are_shuffled_without_their_rows(spark, monkeypatch):
    kept, staged = {}, simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, name: kept.setdefault(name, staged(df, name)))
    line = [f"w{i}" for i in range(60)]
    texts = [(None, " ".join(line)), (2, " ".join(line)), (3, " ".join(line[:58] + ["x"])), (3, "other words"), (4, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    left = simhash.keep_one_of_each(docs)
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in left.collect()) == [(2, "w0 w1"), (3, "other"), (4, "")]
    assert sorted(kept["bands"].columns) == ["fp", "key", "n", "size"]
