"""WARC archives, prefix tries and tokenizer alignment against brute force, and on odd and empty tables."""

import base64
import collections
import glob
import gzip
import hashlib
import random
import zlib

import pytest

from basketgraph.llm import align, common, queries, trie, warc

P = pytest.importorskip("public_tokenizers")
BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# WARC

PAGES = [(1, "http://a/ b\r\nX: y", "same"), (2, None, "same"), (3, "http://c/é", None), (4, "http://d", ""), (5, "http://e", "x" * 300_000), (None, "http://f", "same"), (6, "http://g", "日本\r\n\r\n"), (6, "http://g", "日本\r\n\r\n"), (None, "h", "alone"), (None, "i", "alone"), (7, "j", "")]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, 1, "z") for p in PAGES], "page_id long, url string, html string, key int, digest string")
    warc.write(pages, f"{tmp_path}/w", "page_id", "html", "url", archive_bytes=500)
    files = glob.glob(f"{tmp_path}/w/part*")
    assert len(files) > 2
    text = b"".join(gzip.open(f).read() for f in files)  # plain readers of gzip take the archives too
    assert text.count(b"WARC/1.1\r\n") == len(PAGES) and b"\r\nX: y" not in text
    records = warc.read(spark, f"{tmp_path}/w")
    rows = records.collect()
    assert all(r.error is None for r in rows) and len(rows) == len(PAGES)
    first = {}
    for i, _, h in PAGES:
        first[h or ""] = min(first.get(h or "", 99), 99 if i is None else i)
    want = collections.Counter()
    for i, u, h in PAGES:
        data, of = (h or "").encode(), first[h or ""]
        refers = str(of) if of != 99 and (i is None or i > of) else None
        want[None if i is None else str(i), len(data), b32(data), "response" if refers is None else "revisit", refers] += 1
    assert collections.Counter((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    urls = {r.key: r.target_uri for r in rows if r.key}
    assert urls["1"] == "http://a/%20b%0D%0AX:%20y" and urls["2"] is None and urls["3"] == "http://c/é"
    whole = warc.resolved(records, copies=1).collect()
    assert sorted(b32(r.payload) for r in whole) == sorted(b32((h or "").encode()) for _, _, h in PAGES) and not any(r.error for r in whole)


def test_warc_least_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(i, "ab" * (i % 2)) for i in range(8)], "page_id long, html string")
    warc.write(pages, f"{tmp_path}/w", "page_id", "html", least=1)
    rows = warc.read(spark, f"{tmp_path}/w").collect()
    assert {r.key for r in rows if r.refers_to == "1"} == {"3", "5", "7"} and sum(r.record_type == "response" for r in rows) == 5
    warc.write(pages.limit(0), f"{tmp_path}/none", "page_id", "html")
    assert warc.read(spark, f"{tmp_path}/none").collect() == []
    assert warc.round_trip(pages.limit(0), "page_id", "html").collect() == []


def test_broken_archives_are_told():
    good = [warc.record(str(i), f"u{i}", b"payload %d" % i, None) for i in range(3)]
    whole = b"".join(map(warc.member, good)) + warc.END

    def read(data, size):
        return list(warc.read_archive(data[s : s + size] for s in range(0, len(data), size)))

    for size in (1, 7, 100_000):
        assert [(r[0], r[5], r[-1]) for r in read(whole, size)] == [(str(i), b"payload %d" % i, None) for i in range(3)]
    assert [r[-1] for r in read(whole[: len(warc.member(good[0])) + 40], 64)] == [None, "member cut off"]
    for change, said in ((lambda x: x.replace(b"payload 1\r", b"payload 9\r"), "block digest, payload digest"), (lambda x: x[:-5], "shorter than its content length"), (lambda x: x + b"!", "more than its content length"), (lambda x: x.replace(b"Content-Length", b"Kontent-Length", 1), "no content length"), (lambda x: b"HTTP" + x, "no WARC record"), (lambda x: b"WARC/1.1\r\n", "no end of header")):
        assert read(warc.member(good[0]) + warc.member(change(good[1])), 33)[1][-1] == said
    assert "payload length" in read(warc.member(warc.record("1", None, b"abc", None).replace(b"Content-Length: 3", b"Content-Length: 5")), 50)[0][-1]
    assert read(b"no gzip at all", 5)[0][-1].startswith("Error -3")


def test_lookup_of_hot_cold_and_null_keys(spark):
    rows = spark.createDataFrame([(0,)] * 3000 + [(i,) for i in range(1, 1500)] + [(None,)], "k int")
    table = rows.filter("k % 2 = 0").groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 10 AS v")
    got = collections.Counter((r.k, r.v) for r in common.lookup(rows, table, ["k"], "n", total=100_000).collect())
    assert got == collections.Counter([(0, 0)] * 3000 + [(i, i * 10 if i % 2 == 0 else None) for i in range(1, 1500)] + [(None, None)])


# Tries


def brute_trie(rows, group=20, head=4):
    turns = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    of = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % head
        base = c - (abs(c) % group) * (1 if c > 0 else -1)
        of[c] = tuple(own.get(base, [])[:h] + v[h:])
    nodes = collections.defaultdict(list)
    for c in sorted(of):
        for d in range(len(of[c]) + 1):
            nodes[of[c][:d]].append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        words = lambda q: len(q[-1][1].split()) if q else 0
        ends = ",".join(str(c) for c in members if len(of[c]) == len(p))
        childless = [q for q in below if not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in nodes)]
        out.append((members[0], len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below), len(childless), sum((len(nodes[q]) - 1) * words(q) for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, shard, block", [(1, 512, 64), (2, 3, 2), (3, 5, 3)])
def test_trie_is_brute_force(spark, seed, shard, block):
    rnd = random.Random(seed)
    rows = [(c, rnd.choice([None, 0, 1, 2, 2, 5]), rnd.choice(["user", None, "bot"]), rnd.choice(["a b", "a  b c", "", None, "\n", "x" * 2000])) for c in [*range(-25, 60, 2), *rnd.choices(range(60), k=30)] for _ in range(rnd.randrange(1, 6))]
    rows += [(40, i, "user", f"t{i % 7}") for i in range(40)] + [(41, i, "user", f"t{i % 7}") for i in range(33)] + [(None, 0, "user", "lost"), (7, 1, "u", "z"), (7, 1, "u", "z")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, shard int, block int")
    got = trie.conversation_trie(df, shard=shard, block=block).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_trie_of_turnless_and_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.conversation_trie(none).collect() == []
    turnless = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0]  # their base is absent, and they have one turn
    rows = [(c, 0, "u", "x") for c in turnless]
    got = trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == brute_trie(rows) and got[0].n_convs == len(turnless) and got[0].n_leaves == 1


# Alignment


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    library, model = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    library.encode_special_tokens = True
    a_bytes, b_bytes = align.byte_tokens(BYTES), align.piece_tokens(PIECES)
    each, counts = [], collections.Counter()
    for text in texts:
        a, b = library.encode(" " + (text or ""), add_special_tokens=False).ids, model.encode(text or "")
        at, bt = [a_bytes[i] for i in a], [b_bytes[i] for i in b]
        if not text or not b"".join(at) == b"".join(bt) == (" " + text).encode():
            a, b, at, bt = [], [], [], []
        ends_a, ends_b = [sum(map(len, at[: i + 1])) for i in range(len(at))], [sum(map(len, bt[: i + 1])) for i in range(len(bt))]
        links = [(x, y) for x, e in zip(a, ends_a) for y, f in zip(b, ends_b) if e == f]
        cuts = sorted({*ends_a} & {*ends_b})
        groups = ";".join(",".join(str(x) for x, e in zip(a, ends_a) if s < e <= t) + "|" + ",".join(str(y) for y, e in zip(b, ends_b) if s < e <= t) for s, t in zip([0, *cuts], cuts))
        counts.update(links)
        each.append((len(a), len(b), len(cuts), links, groups))
    most = {y: max(n for (_, z), n in counts.items() if z == y) for _, y in counts}
    return [(n_a, n_b, n, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for n_a, n_b, n, links, g in each]


def test_alignment_is_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    pool = ["ab", "  ", "the ", "\n", " \n", " b", "é", "日本", "'s", "<|endoftext|>", "<s>", "\x85", "\xa0", "　x", "\t", "1 2", "ß ", "<0x0A>", "🙂", "́", " of", " understanding"]
    texts = [None, "", " ", "a▁b", "\n", "word " * 500, "x" * 9000, *("".join(rnd.choice(pool) for _ in range(rnd.randrange(14))) for _ in range(300))]
    texts += texts[10:20]
    spark.createDataFrame([(i % 250, t, "p", 0) for i, t in enumerate(texts)], "doc_id long, text string, pair string, row int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_alignment(spark, str(tmp_path)).select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_alignment(texts))
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), BYTES, PIECES).collect() == []


def test_pairs_are_bounded(spark):
    a, b = align.byte_tokens(BYTES), align.piece_tokens(PIECES)
    docs = spark.createDataFrame([(1, "Understanding the 12 tokenizers' ends, naïvely: 日本語 and code_like(x) == y;")], "doc_id long, text string")
    pairs = align.align(docs, BYTES, PIECES).first().pairs
    assert pairs and all(a[x >> 32].endswith(b[x & 0xFFFFFFFF]) or b[x & 0xFFFFFFFF].endswith(a[x >> 32]) for x in pairs)
    assert len(pairs) < align.pair_bound(BYTES, PIECES) < 1_000_000
