"""The pipeline's stages against their operators by brute force."""

import collections
import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages(spark):
    from lexipulse.llm.queries import VOCABULARY
    from test_corpus_ops import components
    from test_text_ops import base_spans
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    given, columns = docs.collect(), docs.columns
    for (name, stage), check in zip(corpus_pipeline.STAGES, ("quality", "near", "pii", "mix", "bpe")):
        out = stage(spark, docs, FOLDER)
        rows = out.collect()
        if check == "quality":
            kept = {r.doc_id for r in rows}
            assert all(len((r.text or "").split()) >= 50 for r in rows) and len(kept) > 0.5 * len(given)
        elif check == "near":
            found = components([r.text for r in given], 5, 80, 100)
            first = {c: min(given[i].doc_id for i in found if found[i][1] == c) for c in {c for _, c in found.values()}}
            assert sorted(r.doc_id for r in rows) == sorted(first.values())
        elif check == "pii":
            assert [r.doc_id for r in rows] == [r.doc_id for r in given]
            changed = 0
            for a, b in zip(given, rows):
                changed += a.text != b.text
                assert not base_spans(b.text) and (bool(base_spans(a.text)) <= (a.text != b.text))
            assert changed
        elif check == "mix":
            n = collections.Counter(r.doc_id for r in rows)
            assert set(n) == {r.doc_id for r in given} and max(n.values()) <= 2
        else:
            library = Tokenizer.from_file(VOCABULARY)
            want = sorted((r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids)) for r in given)
            assert sorted((r.doc_id, r.n_tokens) for r in rows) == want
            break
        assert out.columns == columns
        docs, given = out, rows
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, FOLDER).collect()) == want
