"""Registered queries against their SQL, and the pipeline's stages against what they promise."""

import pytest

import corpus_pipeline
from turnweave.llm import decontaminate, jaccard, pieces, pii, quality, registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    got = duck.execute(registry.SQL[name])
    names = [c[0] for c in got.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(repr([r[names.index(c)] for c in cols]) for r in got.fetchall())


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        assert {r.doc_id for r in rows} <= before and rows
        if name == "quality rules":
            assert {r.doc_id for r in rows} == {r.doc_id for r in kept.collect() if quality.keep(r.text, quality.RULES)}
        if name == "benchmark decontamination":
            items = [t for r in bench.collect() if len(t := decontaminate.tokens(r.text))]
            held = {r.doc_id: decontaminate.tokens(r.text) for r in kept.collect()}
            stay = {r.doc_id for r in rows}
            meets = lambda t: any(decontaminate.overlaps_at(t, 0, x, s) for x in items for s in range(-len(x), len(t)))
            short = [k for k in stay if len(held[k]) < 150][:15]
            assert all(meets(held[k]) for k in before - stay) and short and not any(meets(held[k]) for k in short)
        if name == "n-gram Jaccard join":
            sets = {r.doc_id: set(jaccard.shingles(r.text, 5).tolist()) for r in kept.collect()}
            parent = {k: k for k in sets}

            def find(k):
                while parent[k] != k:
                    k = parent[k]
                return k

            for a in sets:
                for b in sets:
                    if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) > 0:
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
            assert {r.doc_id for r in rows} == {k for k in sets if find(k) == k}
        if name == "PII":
            assert {r.doc_id for r in rows} == before and all(r.n_chars == len(r.text) for r in rows)
            spans = {r.doc_id: r.spans for r in pii.find_spans(kept).collect()}

            def masked(text, found):
                out, at = [], 0
                for a, kind, b in found:
                    if a >= at:
                        out += [text[at:a], f"<{pii.ALL[kind]}>"]
                    at = max(at, b)
                return "".join(out) + text[at:]

            assert {r.doc_id: r.text for r in rows} == {r.doc_id: masked(r.text, spans[r.doc_id]) for r in kept.collect()}
        kept = spark.createDataFrame(rows, docs.schema)
    last = corpus_pipeline.STAGES[4][1](spark, kept, sf).collect()
    model = pieces.piece_model(pieces.default_model())
    text = {r.doc_id: r.text for r in kept.collect()}
    import numpy as np

    assert {r.doc_id: model.decode(np.array(r.ids, np.int64)) for r in last} == text


def test_stages_take_nulls_empty_tables_and_extra_columns(spark, sf):
    import numpy as np

    text = " ".join(f"word{k} and more of it." for k in range(30))
    rows = [(1, text, "en", "a", 3, "x"), (1, text, "en", "a", 3, "x"), (2, None, None, None, None, None), (None, text, "en", "a", 3, "y"), (3, "", "en", "a", 0, "x"), (4, text + " mail me at a.b@c.org", "de", "b", 9, None), (5, "é " * 5000 + text, "fr", "c", 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for given in (docs, docs.where("false")):
        kept = given
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, kept, sf)
            assert out.columns == docs.columns
            kept = spark.createDataFrame(out.collect(), docs.schema)
        last = corpus_pipeline.STAGES[4][1](spark, kept, sf)
        assert last.count() == kept.count()
        if given is docs:
            assert "<email>" in {r.doc_id: r.text for r in kept.collect()}.get(4, "<email>") and kept.count() > 0
            assert all(r.ids is None or len(r.ids) == r.n_ids for r in last.collect()) and np.iinfo(np.int64)
