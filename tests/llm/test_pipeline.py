"""The pipeline, stage by stage."""

import collections

import corpus_pipeline
from rcaspark.llm import queries

from .conftest import SF
from .test_search_and_join import brute_groups
from .test_text_operators import brute_spans


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), [documents]
    assert list(stages) == ["language ID", "near duplicates", "personal data", "mixture", "packing"]
    for i, stage in enumerate(stages.values()):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
        if i < 4:
            assert kept[-1].columns == documents.columns
    rows = [x.collect() for x in kept]
    assert {r.doc_id for r in rows[1]} == {r.doc_id for r in rows[0] if any(c.isalpha() for c in r.text or "")}
    groups = brute_groups([(r.doc_id, r.text) for r in rows[1]], 5, 80, 100)
    assert {r.doc_id for r in rows[2]} == {i for i, _, c in groups if i == c}
    assert len(rows[3]) == len(rows[2]) and not any(brute_spans(r.text) for r in rows[3])
    before = {r.doc_id: r.text for r in rows[2]}
    assert all(r.text == before[r.doc_id] for r in rows[3] if not brute_spans(before[r.doc_id]))
    assert all(r.n_chars == len(r.text) for r in rows[3])
    assert {r.doc_id for r in rows[4]} <= {r.doc_id for r in rows[3]}
    whole, pieces = Tokenizer.from_file(queries.tokenizer()), collections.defaultdict(list)
    for r in sorted(rows[5], key=lambda r: r.start):
        pieces[r.doc_id] += r.ids
    # The mixture repeats documents; a repeated one is packed as often.
    copies = collections.Counter(r.doc_id for r in rows[4])
    for r in rows[4]:
        assert sorted(pieces[r.doc_id]) == sorted((whole.encode(r.text, add_special_tokens=False).ids + [0]) * copies[r.doc_id])
    assert set(pieces) == set(copies)


def test_stages_on_odd_and_empty_tables(odd_documents, no_documents, spark):
    for rows in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES:
            rows = spark.createDataFrame(stage(spark, rows, SF).collect(), stage(spark, rows, SF).schema)
        assert rows.where("doc_id in (1, 2, 3, 8)").count() == 0


def test_mixture_repeats_the_documents_of_a_small_source(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    tiny = documents.limit(1).selectExpr("-1L as doc_id", "'rare words of a new source' as text", "lang", "'new' as source", "26L as n_chars")
    rows = corpus_pipeline.mixture(spark, documents.unionByName(tiny.select(documents.columns)), SF).collect()
    counts = collections.Counter(r.doc_id for r in rows)
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert counts[-1] > 1 and words(rows) > 0.15 * words(documents.collect())


def test_one_row_of_a_group_stays_and_no_other_text_goes(odd_documents, spark):
    rows = corpus_pipeline.near_duplicates(spark, odd_documents, SF).collect()
    assert collections.Counter(r.doc_id for r in rows) == {1: 1, 2: 1, 3: 1, 4: 1, 6: 1, None: 1, 7: 1, 8: 1}
    # One id with two texts: both stay, the copies of either go, whatever the order of the rows.
    texts = {"x": "one two three four five six seven", "y": "a quite different text of more than five words"}
    made = [(9, texts["y"]), (9, texts["x"]), (9, texts["x"]), (10, texts["y"]), (None, texts["x"])]
    for order in (made, made[::-1]):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in order], "doc_id long, text string, lang string, source string, n_chars long")
        kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
        assert sorted((r.doc_id, r.text) for r in kept) == [(9, texts["y"]), (9, texts["x"])]


def test_the_mixture_has_the_tokens_of_its_input(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    count = lambda rows: sum(len((r.text or "").split()) for r in rows.collect())
    assert 0.8 < count(corpus_pipeline.mixture(spark, documents, SF)) / count(documents) < 1.25
