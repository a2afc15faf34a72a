import corpus_pipeline
from pulsegrid.llm import pieces

SF = "/root/testdata/sf0.01"


def test_stages_pass_on_what_they_kept(spark, tmp_path):
    """Each stage on its own input, against that stage's rule."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        step(spark, docs, SF).write.parquet(out)
        after = spark.read.parquet(out)
        before = {r["doc_id"]: r for r in docs.collect()}
        rows = {r["doc_id"]: r for r in after.collect()}
        assert len(rows) == after.count() and set(rows) <= set(before) and rows
        assert after.columns[:len(columns)] == columns and (k == len(corpus_pipeline.STAGES) - 1 or after.columns == columns)
        seen[name] = (before, rows)
        docs = after
    before, rows = seen["near_duplicates"]
    shingles = lambda t: (lambda w: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())((t or "").encode().lower().split())
    kept = [(d, shingles(r["text"])) for d, r in rows.items()]
    for i, (a, x) in enumerate(kept):
        assert not any(100 * len(x & y) >= 75 * len(x | y) for _, y in kept[:i] if x & y)
    for d in set(before) - set(rows):  # what went is like something that came in
        x = shingles(before[d]["text"])
        assert any(100 * len(x & y) >= 75 * len(x | y) for e, y in ((e, shingles(r["text"])) for e, r in before.items() if e != d))
    before, rows = seen["secret_masking"]
    assert set(before) == set(rows) and any("[secret]" in (r["text"] or "") for r in rows.values())
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
    before, rows = seen["piece_encoding"]
    model = pieces.Pieces(pieces.default_model())
    assert set(before) == set(rows) and all(list(r["piece_ids"]) == model.encode(r["text"]) for r in rows.values())


def test_run_is_repeatable(spark):
    a = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    b = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    assert a == b and a
