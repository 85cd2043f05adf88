"""The pipeline's stages against what each is to do with its own input."""

import corpus_pipeline
from test_decontaminate import brute as contaminated_by
from test_ngram_join import brute as components_of
from test_pii import brute as spans_of

from cardwatch.llm import base, piece_codec, toxicity


def test_stages_in_turn(lm, sf):
    docs = base.table(lm, sf, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, base.stash(stage(lm, docs, sf), name)
        if name != "sentencepiece":
            assert docs.dtypes == before.dtypes
        kept[name] = [(r.doc_id, r.text) for r in before.collect()], [(r.doc_id, r.text) for r in docs.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "pii", "sentencepiece"]

    before, after = kept["toxicity"]
    documents = base.table(lm, sf, "documents")
    model = toxicity.fit(documents, base.table(lm, sf, "labels").where(~toxicity.fold(3, 1)))
    gone = {r.doc_id for r in toxicity.scores(documents, model).where(f"score >= {toxicity.THRESHOLD}").collect()}
    assert gone and sorted(after) == sorted(x for x in before if x[0] not in gone)

    before, after = kept["ngram_join"]
    least = {e[1] for e in components_of(before).values()}
    assert sorted(after) == sorted(x for x in before if x[0] in least) and len(after) < len(before)

    before, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in base.table(lm, sf, "benchmark").collect()]
    hit = {d for d, e in contaminated_by(before, items).items() if e[3]}
    assert hit and sorted(after) == sorted(x for x in before if x[0] not in hit)

    before, after = (dict(x) for x in kept["pii"])
    assert set(before) == set(after)
    for d, text in before.items():
        assert (after[d] == text) == (not spans_of(text))
        assert not spans_of(after[d])

    vocabulary = piece_codec.read_vocabulary()
    rows = docs.collect()
    assert len(rows) == len(kept["pii"][1])
    assert all(piece_codec.decode_ids(r.token_ids, vocabulary) == r.text for r in rows)


def test_run_gives_the_last_stage(lm, sf):
    out = corpus_pipeline.run(lm, sf)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "token_ids"]
    assert out.count() > 0


def test_stages_take_empty_and_odd_rows(lm, sf, frame):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "a" * 5000, None, "s", 5000), (2, "a" * 5000, None, "s", 5000), (None, "x y", "en", "s", 3)]
    for rows in ([], odd):
        docs = frame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = base.stash(stage(lm, docs, sf), name)
        assert docs.count() == (4 if rows else 0)
