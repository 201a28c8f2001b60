"""Text operators against brute force, and on nulls, empty and repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from basketgraph.llm import ann, bpe, common, jaccard, langid, licenses, lmscore, packing, quality, suffix, toxicity

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "Alone here."), (4, "x" * 50_000), (5, " \n\t "), (6, "é日本 <|endoftext|> 'll")]


def odd(spark):
    """Odd rows, with extra columns of names that operators use inside."""
    rows = [(i, t, None if i == 1 else "en", None if i == 2 else "s", 1, "z", 0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key int, t string, row int")


OPERATORS = {
    "bpe": lambda d: bpe.encode(d, P.path("byte_bpe_50k.json"), decode=True),
    "suffix": suffix.deduplicate,
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d.selectExpr("text", "CAST(doc_id % 2 AS INT) AS label"))),
    "lm": lambda d: lmscore.score(d, lmscore.fit(d, epochs=1)),
    "packing": lambda d: packing.pack(packing.pieces(d, P.path("word_bpe_49k.json")), d.count()),
    "licenses": licenses.scan,
    "jaccard": jaccard.similar_components,
    "langid": lambda d: langid.predict(d, langid.fit(d)),
    "quality": quality.quality,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, name):
    docs = odd(spark)
    out = OPERATORS[name](docs).collect()
    assert collections.Counter(r.doc_id for r in out).keys() == {i for i, _ in ODD}
    if name != "packing":
        assert len(out) == len(ODD)
    assert OPERATORS[name](docs.limit(0)).collect() == []


def test_bpe_round_trip_and_tree(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in bpe.encode(odd(spark), P.path("byte_bpe_50k.json"), decode=True, leaf=16, spread=64, raw_leaf=48).collect():
        text = dict(ODD)[r.doc_id] or ""
        assert r.ids == library.encode(text, add_special_tokens=False).ids and r.decoded == text
    enc, rnd = bpe.encoder(P.path("byte_bpe_50k.json")), random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choice(rnd.choice(["ab", " ab'", " \n a1", "日本語中文字。 a", "'sretl x1 ."])) for _ in range(rnd.randrange(300)))
        for raw_leaf in (8, 100, 1000):
            assert bpe.encode_tree(enc, text, 10, raw_leaf).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_bpe_joins_documents(spark, monkeypatch):
    """Documents of ordinary size go through the tree, and their ids are the library's."""
    from tokenizers import Tokenizer

    joins = []
    monkeypatch.setattr(bpe, "join_texts", lambda *x, was=bpe.join_texts: joins.append(1) or was(*x))
    library, enc = Tokenizer.from_file(P.path("byte_bpe_50k.json")), bpe.encoder(P.path("byte_bpe_50k.json"))
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in texts:
        assert bpe.encode_tree(enc, t).tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(joins) >= sum(len(t) > bpe.LEAF for t in texts) > 0


def test_packing_holds_each_id_once(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = packing.pack(packing.pieces(odd(spark).dropDuplicates(["doc_id"]), P.path("word_bpe_49k.json"), length=64), 7, length=64, group_docs=3).collect()
    of, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, own in of.items():
        ids = library.encode(dict(ODD)[i] or "", add_special_tokens=False).ids + [2]
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in own)
    for own in sequences.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 64


def test_first_fit_decreasing():
    rnd = random.Random(2)
    for _ in range(50):
        sizes = sorted((rnd.randrange(1, 101) for _ in range(rnd.randrange(1, 60))), reverse=True)
        where, offset = packing.first_fit_decreasing(np.array(sizes), 100)
        room, want = [], []
        for s in sizes:
            i = next((i for i, r in enumerate(room) if r >= s), len(room))
            room += [100] * (i == len(room))
            want.append((i, 100 - room[i]))
            room[i] -= s
        assert list(zip(where.tolist(), offset.tolist())) == want


def test_suffix_arrays():
    rnd = random.Random(3)
    for i in range(300):
        kinds = rnd.choice([1, 2, 3, 20, 200])
        t = np.array([rnd.randrange(1, kinds + 1) for _ in range(rnd.randrange(1, 200))] * (1 + 3 * (i % 2)) + [0], np.int16)
        sa, s = suffix.suffix_array(t, int(t.max()) + 1), t.tolist()
        assert sa.tolist() == sorted(range(len(s)), key=lambda j: s[j:])
        plcp = suffix.common_prefixes(t, sa)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
            n = next((k for k in range(len(s)) if max(a, b) + k >= len(s) or s[a + k] != s[b + k]), 0)
            assert plcp[b] == n


def test_substrings_that_differ_early_are_not_compared_further(monkeypatch):
    """One long substring among short ones: all are in order, and few are sorted again for its sake."""
    rnd = random.Random(9)
    t = np.array([*(rnd.randrange(1, 300) for _ in range(3000)), *sorted(rnd.randrange(1, 300) for _ in range(600)), *sorted((rnd.randrange(1, 300) for _ in range(600)), reverse=True), 5, 0] * 2)
    t = np.append(t[t > 0], 0)
    small = [True]
    for i in range(len(t) - 2, -1, -1):
        small.append(t[i] < t[i + 1] or (t[i] == t[i + 1] and small[-1]))
    small = small[::-1]
    lms = np.array([i for i in range(1, len(t)) if small[i] and not small[i - 1]], np.int32)
    stop = np.append(lms[1:], len(t) - 1)
    sorts, argsort, unique = [], np.argsort, np.unique
    with monkeypatch.context() as m:
        m.setattr(np, "argsort", lambda x, *a, **k: sorts.append(len(x)) or argsort(x, *a, **k))
        m.setattr(np, "unique", lambda x, *a, **k: sorts.append(len(x)) or unique(x, *a, **k))
        order, differs = suffix._sort_directly(t, lms, stop)
    strings = {int(a): (*t[a : z + 1].tolist(), 1000) for a, z in zip(lms, stop)}
    got = [strings[i] for i in order.tolist()]
    assert max(map(len, got)) > 400 and got == sorted(strings.values())
    assert differs.tolist() == [a != b for a, b in zip(got, got[1:])]
    assert sum(sorts) < 6 * len(lms)


@pytest.mark.parametrize("hot", [100_000, 300])
def test_suffix_dedup(spark, hot):
    rnd, length = random.Random(4), 40
    base = "".join(rnd.choice("abcdef ") for _ in range(300))
    rows = []
    for i in range(60):
        t = "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(200)))
        rows.append((i, [t + base + "".join(rnd.choice("xyz") for _ in range(40)), base[:150] + t + base[100:], "ab" * rnd.randrange(100), "é日" * 3 + base, base[:45] + t, t][i % 6]))
    rows += [(100, None), (5, rows[5][1])]
    raw = [(t or "").encode() for _, t in rows]
    count = collections.Counter(d[i : i + length] for d in raw for i in range(len(d) - length + 1))
    want = []
    for d in raw:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        want.append((len(d), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    out = suffix.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), length=length, grams=(8, 32), hot=hot).collect()
    assert sorted((r.text_bytes, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out) == sorted(want)


def test_jaccard_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 8)
    rnd, vocabulary = random.Random(5), [f"w{i}" for i in range(40)]
    families = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(3, 60))] for _ in range(8)]
    rows = []
    for i in range(160):
        w = list(rnd.choice(families))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(w)))

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    out = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == {i: (len(sets[i]), find(i)) for i in range(len(rows))}


def test_jaccard_plans_are_short(spark, monkeypatch):
    """The driver holds a plan again for each of its stages, so no plan has many steps."""
    rnd, steps, write = random.Random(3), [], jaccard.materialize

    def counted(df, name):
        steps.append(len(df._jdf.queryExecution().executedPlan().toString().strip().split("\n")))
        return write(df, name)

    monkeypatch.setattr(jaccard, "materialize", counted)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = base[i % 3 * 15 :][:45]
        for _ in range(rnd.choice([0, 1, 3, 6])):
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(30)}"
        rows.append((i, " ".join(w)))
    jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert max(steps) <= 80, steps


def test_hashes_of_words_of_a_text():
    texts = ["", " ", "a", " a ", "A\x0bb\x1cC\x85 d e\u3000f\ng", "x" * 300_000 + " y X", "é É ab AB ba b\0 \0b \0", *(t or "" for _, t in ODD)]
    seen: dict = {}
    for t in texts:
        words = t.encode().translate(common.LOWER).split()
        got = common.text_hashes(t).tolist()
        assert len(got) == len(words) and all(seen.setdefault(w, h) == h for w, h in zip(words, got))
    assert len(set(seen.values())) == len(seen)


def test_arrow_batches_are_short_within(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    rows = spark.range(5000).coalesce(1)
    with common.arrow_rows(spark, 700):
        within = {r.n for r in rows.mapInArrow(sizes, "n long").collect()}
    assert max(within) <= 700 and {r.n for r in rows.mapInArrow(sizes, "n long").collect()} == {5000}


def test_language_id(spark):
    rnd = random.Random(6)
    words = {"aa": ["kato", "miru", "sena", "tori"], "bb": ["grum", "blont", "strask", "wumph"]}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(60)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.filter("doc_id < 80"))
    out = langid.predict(docs.filter("doc_id >= 80").drop("lang"), model).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] and not r.rejected for r in out)
    other = spark.createDataFrame([(1, "12 34"), (2, "zzzqx qqxzv vvxq " * 30)], "doc_id long, text string")
    assert {r.doc_id: r.rejected for r in langid.predict(other, model).collect()} == {1: True, 2: True}


def test_toxicity(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(240):
        words = [rnd.choice(["calm", "river", "stone", "walks", "tall"]) for _ in range(30)]
        if i % 4 == 0:
            words[rnd.randrange(30)] = rnd.choice(["grobnak", "grobnaks", "Gr0bnak"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(docs.filter("doc_id < 160"))
    assert all((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in toxicity.score(docs, model).collect())
    assert toxicity.fold("ѕtu9 gr0bnak 2024") == "stu9 grobnak 2024"
    lexicon = toxicity.Lexicon({"trash": 4.0}, ("trash can",))
    assert lexicon.sums("a trash can")[0] == 0 and lexicon.sums("trashy")[0] == 4


def test_licenses(spark):
    texts = ["Some words. Licensed under the Apache License, Version 2.0, then more", "all  rights-reserved; CC by cc BY", "rights reserved all", "this work is licensed under the really new GNU General Public License version 3"]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = {i: sorted({(s.label, s.start, s.phrase) for s in r.spans}) for i, r in out.items()}
    assert found[0] == [("apache-2.0", 2, False)]
    assert found[1] == [("cc-by", 3, True), ("cc-by", 5, True), ("reserved", 0, True)]
    assert found[2] == [] and ("gpl", 0, False) in found[3] and ("gpl", 9, True) in found[3]
    assert out[1].n_words == 7


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((400, 8))
    vectors[50:90] = vectors[50]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (904, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS point", "2 AS query")
    out = ann.neighbours(table, table.vec_id % 20 == 0, 5).collect()
    for q in range(0, 400, 20):
        scores = (vectors * vectors[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(400), -scores)).tolist() if i != q][:5]
        assert [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)] == want
    assert ann.neighbours(table.limit(0), table.vec_id % 20 == 0).collect() == []


def test_lm_prefers_seen_order(spark):
    rows = [(i, "one two three four five six " * 30) for i in range(40)] + [(100, "six two five one four three " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = {r.doc_id: r.mean_log_probability for r in lmscore.score(docs, lmscore.fit(docs.filter("doc_id < 40"), epochs=8)).collect()}
    assert score[0] > score[100] + 0.5


def test_lm_counts_the_whole_corpus(spark, monkeypatch):
    """Rare words have their own counts, and texts of all partitions are learnt."""
    monkeypatch.setattr(lmscore, "FIRST", 4)
    monkeypatch.setattr(lmscore, "KNOWN", 1)
    monkeypatch.setattr(lmscore, "SHARE", 1)
    buckets = {}
    for i in range(5000):
        buckets.setdefault(lmscore.word_hashes([f"x{i}".encode()])[0] % lmscore.BUCKETS, []).append(f"x{i}")
    once, twice, often, never = max(buckets.values(), key=len)[:4]
    base = "one two three four " * 50
    texts = [base + w for w in [once, twice, twice, *[often] * 5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(lmscore, "TASK_TOKENS", 200)
    model = lmscore.fit(docs)
    assert len(model.words) == 4 and model.totals.sum() == 8
    probe = spark.createDataFrame([(i, base + w) for i, w in enumerate([once, twice, often, never])], "doc_id long, text string")
    got = {r.doc_id: r.log_likelihood for r in lmscore.score(probe, model).collect()}
    assert [round(np.exp(got[i] - got[0]), 3) for i in range(4)] == [1, 2, 5, 1]
    texts = ["one two three four five six " * 60] * 4 + ["six two five one four three " * 60] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    model = lmscore.fit(docs, epochs=2)
    start = lmscore.Network(lmscore.classes_of(len(model.words))).state()
    assert all((a != b).any() for a, b in zip(model.state, start))


def test_quality_removes_common_lines(spark):
    rows = [(i, "Common line that all have here today\n" + " ".join(f"w{i}x{j}" for j in range(30 if i % 2 else 2)), "h") for i in range(20)]
    out = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), line_docs=5, keep_share=0.5).collect()}
    assert out[0].removed_chars == 0 and out[1].removed_chars > 0
    assert out[1].kept and not out[2].kept


def test_quality_same_as_sql_where_lines_are_removed(spark, tmp_path):
    import duckdb

    rows = [(i, "Common LINE 12 of all\n" * (1 + i % 3) + f"Only here {chr(97 + i)}\n" + " ".join(f"w{chr(97 + i)}x{j}" for j in range(60 if i % 2 else 2)), "h" if i < 20 else "g") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    limits = {"line_docs": 5, "line_share": 0.01, "keep_share": 0.86}
    theirs = con.sql(quality.oracle_sql(**limits)).fetchall()
    assert sorted(tuple(r) for r in quality.quality(docs, **limits).collect()) == sorted(theirs)
    assert sum(r[-1] > 0 for r in theirs) == 19 and any(r[-1] > 0 and not r[-2] and not r[-3] for r in theirs)
    left = {r.doc_id: r.text for r in quality.cleaned(docs, **limits).collect()}
    assert set(left) == {r[0] for r in theirs if r[-2]}
    assert all(("Common" in t) == (i >= 20) and f"Only here {chr(97 + i)}" in t for i, t in left.items())


def test_quality_rows_without_an_id_of_their_own(spark):
    line, long = "Common line of all here\n", " ".join(f"y{j}" for j in range(40))
    rows = [(i, line + " ".join(f"w{chr(97 + i)}x{j}" for j in range(40)), "h") for i in range(6)]
    rows += [(5, "short", "h"), (None, "short too", "h"), (None, long, "h"), (None, line + long, "h"), (3, rows[3][1], "h")]
    limits = {"line_docs": 4, "keep_share": 0.85}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in quality.cleaned(docs, **limits).collect())
    assert got == sorted((i is None, i or 0, t if i == 0 else t.removeprefix(line)) for i, t, _ in rows if "short" not in t)


def test_rows_with_null_and_repeated_ids(spark):
    """Copies under a null or repeated id link only the texts that they copy."""
    import corpus_pipeline

    texts = [" ".join(f"{chr(97 + i)}w{j}" for j in range(30)) for i in range(5)]
    rows = [(1, texts[0]), (2, texts[1]), (None, texts[0]), (None, texts[1]), (None, texts[4]), (7, texts[2]), (7, texts[3]), (8, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id or 0) for r in jaccard.similar_components(docs).collect()))
    assert got == [(0, 0), (0, 1), (0, 2), (1, 1), (2, 2), (7, 7), (7, 7), (8, 7)]
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert kept == {(1, texts[0]), (2, texts[1]), (None, texts[4]), (7, texts[2]), (7, texts[3])}
    nulls = spark.createDataFrame([(None, f"word{i} " * (i % 9 + 1)) for i in range(60)], "doc_id long, text string")
    packed = packing.pack(packing.pieces(nulls, P.path("word_bpe_49k.json")), 60, group_docs=10).collect()
    assert len(packed) == 60 and len({r.sequence_id >> 32 for r in packed}) > 1


def test_language_id_of_short_texts(spark):
    texts = {"aa": ["kato miru", "sena tori", "miru sena"], "bb": ["grum blont", "strask wumph", "blont grum"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, own in texts.items() for t in own * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert not any(r.rejected for r in langid.predict(docs, model).collect())
    other = spark.createDataFrame([(1, "12 34"), (2, None)], "doc_id long, text string")
    assert all(r.rejected for r in langid.predict(other, model).collect())


def test_licence_query_against_a_plain_search(spark, tmp_path):
    from basketgraph.llm import queries

    rnd = random.Random(9)
    pieces = ["cc", "by", "CC BY", "general", "public license", "General Public License", "all rights", "reserved", "All Rights Reserved", "é", "x1", "all"]
    rows = [(i, rnd.choice([" ", "-", "\n, "]).join(rnd.choice(pieces) for _ in range(rnd.randrange(40)))) for i in range(60)] + [(60, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in queries.op7_licenses(spark, str(tmp_path)).collect()}
    for i, t in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        hits = [(at, label) for phrase, label in licenses.PHRASES.items() for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
        starts = [at for at, _ in hits]
        assert got[i] == (len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits})))


def test_lexicon_against_a_plain_matcher():
    rnd = random.Random(10)
    for _ in range(100):
        terms = {"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 4))) + rnd.choice(["", "."]): float(rnd.randrange(1, 9)) for _ in range(6)}
        harmless = ("ab ba", "a b")
        text = "".join(rnd.choice("aab  é") for _ in range(60))
        hits = {}
        for at in range(len(text)):
            for term, weight in terms.items():
                word = term.rstrip(".")
                end = at + len(word)
                closed = end >= len(text) or not text[end].isalpha()
                if text.startswith(word, at) and not (at and text[at - 1].isalpha()) and (closed or not term.endswith(".")):
                    hits[at] = max(hits.get(at, 0), weight)
        for phrase in harmless:
            for at in range(len(text)):
                end = at + len(phrase)
                if text.startswith(phrase, at) and not (at and text[at - 1].isalpha()) and (end >= len(text) or not text[end].isalpha()):
                    hits = {h: w for h, w in hits.items() if not at <= h < end}
        assert toxicity.Lexicon(terms, harmless).sums(text)[0] == sum(hits.values())


def test_kneser_ney_against_plain_counts():
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 8))) for _ in range(200)]
    order, windows = langid.ORDER, langid.codes_of(words)[0]
    _, first, times = np.unique(langid.hashes(windows), return_index=True, return_counts=True)
    model = langid.Model(["x"], [langid.kneser_ney(windows[first], times)])
    counts = {order: collections.Counter()}
    for w in words:
        padded = " " * (order - 1) + w + " "
        counts[order].update(padded[i : i + order] for i in range(len(padded) - order + 1))
    for m in range(order - 1, 0, -1):
        counts[m] = collections.Counter(g[1:] for g in counts[m + 1])

    def chance(gram):
        m = len(gram)
        if m == 0:
            return 1 / langid.ALPHABET
        own = counts[m]
        ones, twos = (sum(c == k for c in own.values()) for k in (1, 2))
        d = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        follow = [c for g, c in own.items() if g[:-1] == gram[:-1]]
        rest = d * len(follow) / sum(follow) if follow else 1
        return (max(own[gram] - d, 0) / sum(follow) if follow and gram in own else 0) + rest * chance(gram[1:])

    probes = ["abca", "ccc", "xa", "b"]
    got = model.of_words(probes)
    for w, (cost, n) in zip(probes, got.tolist()):
        padded = " " * (order - 1) + w + " "
        want = -sum(np.log(chance(padded[i : i + order])) for i in range(len(padded) - order + 1))
        assert n == len(w) + 1 and abs(cost - want) < 1e-3


def test_lm_scores_and_gradients_against_plain_loops():
    rng = np.random.default_rng(12)
    net = lmscore.Network.of(tuple(p.astype(np.float64) + 0.3 * rng.standard_normal(p.shape) for p in lmscore.Network(3).state()))
    ids = np.array([9, 9, *rng.integers(0, 9, 30), 9, 9])
    at = np.arange(2, 32)

    def plain():
        out = []
        for i in at:
            h = np.tanh(net.bias + sum(net.embed[ids[i + o]] @ net.project[j] for j, o in enumerate(lmscore.OFFSETS)))
            kind, place = divmod(int(ids[i]), 3)
            a, b = h @ net.classes + net.class_bias, h @ net.words[kind] + net.word_bias[kind]
            out.append(a[kind] - np.log(np.exp(a).sum()) + b[place] - np.log(np.exp(b).sum()))
        return np.array(out)

    assert np.allclose(net.log_probabilities(ids, at), plain(), atol=1e-4)
    rows, grads = net._gradients(ids, at)
    for k, (p, g) in enumerate(zip(net.state(), grads)):
        whole = np.zeros(p.shape)
        whole[rows if k == 0 else ...] = g
        for _ in range(6):
            where = tuple(rng.integers(0, n) for n in p.shape)
            was = p[where]
            losses = []
            for step in (1e-5, -1e-5):
                p[where] = was + step
                losses.append(-plain().mean())
            p[where] = was
            assert abs((losses[0] - losses[1]) / 2e-5 - whole[where]) < 1e-6


def test_lm_training_loops_over_large_classes_only(monkeypatch):
    """Steps are the same whether classes are reckoned one by one or side by side; a few large classes take few turns."""
    rng = np.random.default_rng(4)
    ids = np.concatenate([[400, 400], np.minimum(rng.geometric(0.01, 3000) - 1, 399), [400, 400]])
    at, turns, softmax = np.arange(2, 3002), [], lmscore._softmax

    def counted(x):
        turns.append(x.shape)
        return softmax(x)

    def trained():
        net = lmscore.Network(20)
        net.train([(ids, at)] * 3, batch=500)
        return net.state()

    one_by_one = []
    with monkeypatch.context() as m:
        m.setattr(lmscore, "SIDE", 0)
        one_by_one = trained()
    monkeypatch.setattr(lmscore, "_softmax", counted)
    together = trained()
    assert all(np.allclose(a, b, atol=2e-3) for a, b in zip(one_by_one, together))
    assert len(turns) < 18 * 10


def test_lm_reads_texts_once(spark, monkeypatch):
    """Training and scores share one reading of the texts, and give what they give apart."""
    rnd, reads, read = random.Random(6), [], lmscore._read
    texts = [None, "", *(" ".join(f"w{int(rnd.expovariate(0.02))}" for _ in range(rnd.randrange(400))) for _ in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(lmscore, "FIRST", 30)
    monkeypatch.setattr(lmscore, "SHARE", 20)
    monkeypatch.setattr(lmscore, "KNOWN", 20)
    monkeypatch.setattr(lmscore, "_read", lambda *a: reads.append(1) or read(*a))
    got = {r.doc_id: r for r in lmscore.fit_and_score(docs).collect()}
    assert len(reads) == 1 and len(got) == len(texts)
    for r in lmscore.score(docs, lmscore.fit(docs)).collect():
        assert r.n_tokens == got[r.doc_id].n_tokens == len((texts[r.doc_id] or "").split())
        assert abs(r.log_likelihood - got[r.doc_id].log_likelihood) < 1e-6 * (1 + r.n_tokens)


def test_lm_sums_of_rows_and_far_logits():
    rng = np.random.default_rng(3)
    of, x = np.minimum(rng.geometric(0.02, 3000), 150), rng.standard_normal((3000, 5))
    numbers, sums = lmscore._summed(x, of, 200)
    want = np.zeros((200, 5))
    np.add.at(want, of, x)
    assert numbers.tolist() == sorted(set(of.tolist())) and np.allclose(sums, want[numbers])
    far = np.array([[1000.0, 0, 999], [-900, -901, -902], [1, 2, 3]], np.float32)
    want = np.exp(far - far.max(1, keepdims=True).astype(np.float64))
    assert np.allclose(lmscore._log_sum(far.copy()), far.max(1) + np.log(want.sum(1)), rtol=1e-5)
    assert np.allclose(lmscore._softmax(far.copy()), want / want.sum(1, keepdims=True), rtol=1e-5)


def test_neighbours_recall_of_many_vectors(spark):
    """20,000 vectors in clumps: nine of ten of the true nearest are found from under a third of all."""
    rng = np.random.default_rng(13)
    vectors = np.repeat(rng.standard_normal((500, 12)), 40, axis=0) + 0.25 * rng.standard_normal((20_000, 12))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    asked = range(0, 20_000, 200)
    got = collections.defaultdict(set)
    for r in ann.neighbours(table, table.vec_id % 200 == 0, share=0.02).select("query_id", "vec_id").collect():
        got[r.query_id].add(r.vec_id)
    found = 0
    for q in asked:
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        found += len(got[q] & set(np.argsort(-scores)[:20].tolist()))
    assert found >= 0.9 * 20 * len(asked)
    forest = ann.Forest(vectors, ann.TREES, ann.LEAF)
    own = np.zeros(len(forest.leaf_sizes), bool)
    own[forest.search(vectors[0], 0.02)] = True
    assert own[forest.leaves(vectors)].any(1).mean() < 1 / 3


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_line_limits_act_on_given_tables(spark):
    """Production limits remove the lines that many texts of a host share and no clean document, and do the same as SQL."""
    import duckdb

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = quality.quality(docs).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, rows)) == sorted(con.execute(f"SELECT {', '.join(rows[0].__fields__)} FROM ({quality.oracle_sql()})").fetchall())
    assert sum(r.removed_chars > 0 for r in rows) > 50 and all(r.kept == (not r.base_failed) for r in rows)
    shared = [f"cookie notice of the host, number {i}" for i in range(3)]
    mine = lambda i: " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + j)}" for j in range(25))
    own = [(i, "\n".join([*shared, mine(i)]) if i < 30 else mine(i) if i < 60 else "\n".join([*shared, mine(i)[:8]]), "h") for i in range(62)]
    got = {r.doc_id: (r.removed_chars, r.kept, r.base_failed) for r in quality.quality(spark.createDataFrame(own, "doc_id int, text string, source string")).collect()}
    length = sum(map(len, shared))
    assert got[0] == (0, True, False) and all(got[i] == (length, True, False) for i in range(1, 30)) and all(got[i] == (0, True, False) for i in range(30, 60))
    assert got[60] == got[61] == (length, False, False)  # depleted
