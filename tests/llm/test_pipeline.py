"""The pipeline, stage by stage, against brute force on its own input."""

from __future__ import annotations

import re

import corpus_pipeline as pipeline
from conftest import DATA
from driftwell.llm import secrets
from test_operators import _components, documents, lower


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(*pipeline.COLUMNS)
    columns, states = set(docs.columns), [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, states[-1], DATA).write.parquet(str(tmp_path / name))
        states.append(spark.read.parquet(str(tmp_path / name)))
        assert name == "packing" or set(states[-1].columns) == columns
    start, known, lined, deduped, clean, packed = [{r[0]: r for r in s.collect()} for s in states]
    assert len(known) >= 0.98 * sum(bool(re.search(r"[^\W\d_]", r["text"])) for r in start.values())
    assert all(start[i] == r for i, r in known.items())
    seen, want = {}, {}
    key = lambda x: lower(x.strip(" \t\n\v\f\r"))
    for i in sorted(known):
        for x in set(known[i]["text"].split("\n")):
            seen.setdefault(key(x), i)
    for i, r in known.items():
        kept = [x for x in r["text"].split("\n") if len(key(x)) < 10 or seen[key(x)] == i]
        if len(kept) == len(r["text"].split("\n")) or "\n".join(kept).strip(" \t\n\v\f\r"):
            want[i] = "\n".join(kept)
    assert {i: r["text"] for i, r in lined.items()} == want
    ids = sorted(lined)
    component = _components([lined[i]["text"] for i in ids], 5, 80)
    assert sorted(deduped) == [i for k, i in enumerate(ids) if component[k] == k]
    for i, r in clean.items():
        spans = secrets.base_spans(deduped[i]["text"])
        assert (r["text"] == deduped[i]["text"]) or spans or "[secret]" in r["text"]
        assert not secrets.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
    assert set(clean) == set(deduped) == set(packed)


def test_run_and_edges(spark):
    assert pipeline.run(spark, DATA).count() > 0
    odd = documents(spark).select(*pipeline.COLUMNS)
    for docs in (odd, odd.limit(0)):
        for _, stage in pipeline.STAGES:
            out = stage(spark, docs, DATA)
            out.collect()
            docs = out if "text" in out.columns else docs
