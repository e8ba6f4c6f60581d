"""The pipeline against its operators' brute-force meaning."""

import hashlib

import corpus_pipeline
from test_llm_operators import brute_components

from veilframe.llm.mixing import mix_sources


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, steps[-1], sf)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        steps.append(spark.read.parquet(str(tmp_path / name)))
    start, clean, exact, near, mixed = ({r["doc_id"]: r["text"] for r in s.collect()} for s in steps)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    assert len(toxic & set(start) - set(clean)) <= 0.03 * len(toxic)
    best = {}
    for i, t in clean.items():
        best[t] = max(i, best.get(t, -1))
    assert set(exact) == set(best.values())
    comps = brute_components(sorted(exact.items()), 5, 80)
    assert set(near) == {i for i, (_, c) in comps.items() if c == i}
    assert set(mixed) <= set(near)
    total = lambda d: sum(len(t.encode().split()) for t in d)
    assert abs(total([r["text"] for r in steps[-1].collect()]) - 1.5 * total(near.values())) < 0.15 * total(near.values())
    mixed_rows, taken = {}, {}
    for r in steps[-1].collect():
        mixed_rows[r["source"]] = mixed_rows.get(r["source"], 0) + len((r["text"] or "").encode().split())
    longest = {}
    for r in mix_sources(steps[-2]).collect():
        taken[r["source"]] = r["target"]
        longest[r["source"]] = max(longest.get(r["source"], 0), r["size"])
    assert all(abs(mixed_rows.get(s, 0) - t) <= 0.01 * t + longest[s] for s, t in taken.items())
    last = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in last) == sorted(r["doc_id"] for r in steps[-1].collect())
    assert all(r["decoded_sha256"] == hashlib.sha256(mixed[r["doc_id"]].encode()).hexdigest() for r in last)
