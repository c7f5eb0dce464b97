"""The registered queries and the pipeline on the smallest tables."""

import zlib

import pytest

from . import fixtures as fx

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op2_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op3_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op6_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op7_suffix_array": ["doc_id"],
    "op8_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9_sentencepiece": ["doc_id", "n_pieces", "ids", "decoded_sha256"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_covers_the_whole_table(spark, rows, name):
    import __spark_entry__ as E

    df = E.queries()[name](spark, SF)
    assert df.columns[:len(COLUMNS[name])] == COLUMNS[name]
    got = df.collect()
    ids = {d for d, _ in rows}
    if name == "op1_ngram_jaccard":
        assert sorted(tuple(r[:3]) for r in got) == sorted(fx.jaccard_components(rows, 3, 90, 100))
    elif name == "op7_suffix_array":
        assert {r.doc_id for r in got} == set(fx.repeated_words(rows))
    elif name == "op3_packing":
        assert {r.doc_id for r in got} == ids
    else:
        assert sorted(r.doc_id for r in got) == sorted(ids)


def test_pipeline_stages(spark, rows, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    texts = dict(rows)
    first = kept["identify_language"]
    assert set(first) <= set(texts) and len(first) >= 0.97 * len(texts)
    # of each group of near copies the smallest id, brute force over what the first stage kept
    comps = fx.jaccard_components(sorted(first.items()), 5, 8, 10)
    assert set(kept["ngram_jaccard_join"]) == {d for d, _, c in comps if d == c}
    # passages that repeat across what is left go from the later documents, nothing else does
    second, third = kept["ngram_jaccard_join"], kept["suffix_array_dedup"]
    repeated = fx.repeated_words(sorted(second.items()))
    assert all(third[d] == t for d, t in second.items() if d not in repeated)
    assert not fx.repeated_words(sorted(third.items()))
    from tests.llm.test_texts import plain_spans

    last = kept["redact_pii"]
    assert set(last) == set(third) and all(last[d] == t for d, t in third.items() if not plain_spans(t) and "[" not in last[d])
    assert not any(plain_spans(t) for t in last.values())
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(last)
    assert all(zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids)) == r.ids_crc32 for r in pieces)
