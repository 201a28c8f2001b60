"""The pipeline on a small table against what its rules say, done plainly."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdeimnorst") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]
    texts = {i: " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(40, 120))) for i in range(40)}
    passage = " ".join(rnd.choice(vocabulary) for _ in range(90))
    words = texts[3].split()
    texts[50] = " ".join([*words[:-1], "changed"])  # a near copy of 3
    texts[51] = texts[4]  # a copy
    texts[52] = "too short"
    texts[53], texts[54] = texts[10] + " " + passage, passage + " " + texts[11]  # a passage in two documents
    short = " ".join(rnd.choice([w for w in vocabulary if len(w) < 6]) for _ in range(52))  # of little more than 50 words
    texts[57], texts[58] = texts[12] + " " + short, short + " " + texts[13]
    texts[55] = None
    texts[56] = "one two three four five six seven eight " * 20  # repeats itself
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["quality rules"]) == set(texts) - {52, 55, 56}
    assert set(kept["language ID"]) == set(kept["quality rules"])
    assert set(kept["near copies"]) == set(kept["language ID"]) - {50, 51}
    out = kept["repeated passages"]
    assert set(out) == set(kept["near copies"])
    assert passage[5:-5] not in out[53] + out[54]
    assert short[3:-3] not in out[57] + out[58] and short[50:90] not in out[57] + out[58]
    assert all(out[i] == texts[i] for i in out if i not in (10, 11, 12, 13, 53, 54, 57, 58))
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.doc_tokens for r in pieces} == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in out.items()}


def test_stages_on_odd_and_empty_tables(spark):
    """Null ids and texts, repeated rows, a long text and columns of names used inside: columns stay, clean rows too."""
    rnd = random.Random(10)
    texts = [" ".join("".join(rnd.choice("abcdeimnorst") for _ in range(6)) for _ in range(50)) for _ in range(4)]
    rows = [(1, texts[0]), (1, texts[0]), (None, texts[1]), (2, None), (3, ""), (4, texts[2]), (4, texts[3]), (5, "x" * 40_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, t string, row int")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").collect() == [], name
        out = stage(spark, docs, "")
        found = out.collect()
        if name == "packing":
            assert {r.doc_id for r in found} == {i for i, _ in rows}
            continue
        assert out.columns == docs.columns
        clean = {(r.doc_id, r.text) for r in found}
        if name != "repeated passages":
            assert {(None, texts[1]), (1, texts[0]), (4, texts[2]), (4, texts[3])} <= clean, name
        else:
            assert len(found) == len(rows) and {(None, texts[1]), (4, texts[2]), (4, texts[3]), (3, "")} <= clean
