import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from spanforge.llm import common, embeddings, langid, mixing, packing, pii, quality, queries, rans, simhash, token_counts, tokens, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, fp string, q string, row string, target string"


def documents(spark, texts, langs=None, sources=None, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    n = len(texts)
    rows = [((ids or range(n))[k], t, (langs or ["en"] * n)[k], (sources or ["s"] * n)[k], len(t) if t else 0, "a", "b", "c", "d", "e") for k, t in enumerate(texts)]
    return spark.createDataFrame([tuple(int(x) if isinstance(x, np.integer) else x for x in r) for r in rows], DOCS)


def prose(rng, n):
    words = "is and retition ouen the of nterti thorreou ndernt ble whst by for threa ores oredat anntly re".split()
    return " ".join(rng.choice(words) + rng.choice("abcdefgh") + str(rng.choice("xyz")) for _ in range(n))


ODD = [None, "", " \n\t ", "one", "one two three", "Ünïcode 😀 é <|endoftext|> İ", "x" * 300_000, "a b c d " * 20_000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 900)) for _ in range(120)]
    texts = base + base[:20] + [b.replace(" ", "  ", 1) for b in base[:5]] + ODD
    rng.shuffle(texts)
    langs = [rng.choice(["en", "de", None]) for _ in texts]
    sources = [rng.choice(["s1", "s1", "s2", "é", None]) for _ in texts]
    return documents(spark, texts, langs, sources).cache()


# tokens


def test_word_encoder_equals_the_tokenizer(tokenizer):
    rng = random.Random(1)
    parts = list("aéßАТ 中 \t\n'1٣½.,!#́̈가ﬁİſ<|>") + ["'s", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", "\x85", "don't", "I'LL", "T̈"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]
    enc = tokens.WordEncoder(tokens.default_path())
    for at in range(0, len(texts), 700):
        part = texts[at : at + 700]
        ids, sizes = enc.encode([t.encode() for t in part])
        ends = np.cumsum(sizes)
        for t, a, b in zip(part, ends - sizes, ends, strict=True):
            assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_encoder_starts_anew_beyond_its_bound(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "KEEP", 3)
    enc = tokens.WordEncoder(tokens.default_path())
    for t in ("a b c d e f b", "g h a b", "a b c b b", "bb aa b c", "b bb"):
        assert enc.encode([t.encode()])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


# 1


def test_token_counts(spark, corpus, tokenizer):
    lengths = [len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in corpus.collect()]
    sums = token_counts.suffix_sums(token_counts.length_histogram(corpus)).cache()
    got = {r.length: r for r in sums.collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(lengths)
    for k, r in got.items():
        assert r.docs_at_least == sum(x >= k for x in lengths) and r.tokens_at_least == sum(x for x in lengths if x >= k)
        assert r.docs_longer == sum(x > k for x in lengths) and r.tokens_kept == sum(min(x, k) for x in lengths)
    for limit in (0, 1, 7, 100, 10**7):
        assert token_counts.truncated_total(sums, limit) == sum(min(x, limit) for x in lengths)
    s = sorted(lengths)
    for q in (0.1, 0.5, 0.99, 1.0):
        assert token_counts.length_quantile(sums, q) == s[max(0, int(np.ceil(q * len(s))) - 1)]


def test_token_counts_empty(spark):
    sums = token_counts.suffix_sums(token_counts.length_histogram(documents(spark, [])))
    assert sums.count() == 0 and token_counts.truncated_total(sums, 5) == 0 and token_counts.length_quantile(sums, 0.5) is None


# 2


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def archive(spark, rows):
    arc, out = common.new_path(spark, "arc"), common.new_path(spark, "warc")
    warc.write_arc(pages(spark, rows), arc)
    warc.convert(spark, arc, out)
    return warc.read_warc(spark, out)


def test_warc_round_trip(spark):
    big, other = "é" * 600, "\r\n\r\nHTTP/1.1 200\n\n" * 80
    rows = [(1, "http://a/b c\nd", big), (2, None, big), (3, "http://a/", "small"), (4, "http://a/", "small"), (5, "", None), (9, "http://ü/", other), (7, "x", big), (8, "x", "x" * 999), (6, "x", "x" * 999), (11, "y", other)]
    got = {r.page_id: r for r in archive(spark, rows).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and len(data) >= 1000]
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        revisit = bool(same) and page != max(same)
        assert r.record_type == ("revisit" if revisit else "response") and r.refers_to == (max(same) if revisit else None)
    assert got[2].url == "urn:x-page:2" and got[1].date == "2020-01-01T00:00:00Z"


def test_warc_repeated_null_and_empty(spark):
    big = "z" * 2000
    got = archive(spark, [(1, "u", big), (1, "u", big), (None, "u", big), (None, None, "")]).collect()
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == {(1, "response", None): 1, (1, "revisit", 1): 1, (None, "revisit", 1): 1, (None, "response", None): 1}
    assert archive(spark, []).count() == 0


def test_warc_ids_revisits_and_rolled_files(spark):
    """Repeated rows have ids of their own, revisits name their response as any reader expects, a bound makes many files."""
    rng = random.Random(2)
    rows = [(k, f"http://h/{k}", "é" * 700 if k % 3 == 0 else "".join(rng.choice("abcdefgh ") for _ in range(3000))) for k in range(300)] + [(5, "http://h/5", "same")] * 4
    arc, out = common.new_path(spark, "arc"), common.new_path(spark, "warc")
    warc.write_arc(pages(spark, rows).repartition(2), arc, size=50_000)
    warc.convert(spark, arc, out, size=50_000)
    files = common.read_blobs(spark, out).collect()
    assert len(files) > 4 and max(len(f.content) for f in files) < 60_000
    found = {f["warc-record-id"]: f for x in files for f, _ in warc.parse_warc(x.content) if f["warc-type"] != "warcinfo"}
    assert len(found) == len(rows)
    for f in found.values():
        if f["warc-type"] == "revisit":
            to = found[f["warc-refers-to"]]
            assert to["warc-type"] == "response" and (to["warc-target-uri"], to["warc-date"], to["warc-payload-digest"]) == (f["warc-refers-to-target-uri"], f["warc-refers-to-date"], f["warc-payload-digest"])
    got = warc.read_warc(spark, out).collect()
    assert Counter(r.record_type for r in got) == {"response": 205, "revisit": 99} and {r.refers_to for r in got} == {None, 297}
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows)


def test_warc_takes_clashing_columns_and_a_long_page(spark):
    df = pages(spark, [(1, "http://x/", "ab" * 3_000_000), (2, None, None)]).withColumns({c: F.lit("clash") for c in ("data", "file", "k", "digest", "n", "block", "record_type")})
    arc, out = common.new_path(spark, "arc"), common.new_path(spark, "warc")
    warc.write_arc(df, arc)
    warc.convert(spark, arc, out)
    assert {(r.page_id, r.payload_bytes, r.record_type) for r in warc.read_warc(spark, out).collect()} == {(1, 6_000_000, "response"), (2, 0, "response")}


def test_arc_lines_with_spaces_and_dates():
    block = warc.http_block(7, b"p")
    for version, tail in ((1, ""), (2, " 200 sum - 9 n.arc")):
        line = f"http://x/a b c 1.2.3.4 20030901 text/html; charset=x{tail} {len(block)}"
        data = warc.version_block(version, "n.arc") + line.encode() + b"\n" + block + b"\n"
        assert list(warc.parse_arc(data)) == [(("n.arc", warc.CAPTURED), "http://x/a b c", "1.2.3.4", "20030901", "text/html; charset=x", block)]
    dates = {"2003": "2003-01-01T00:00:00Z", "200309": "2003-09-01T00:00:00Z", "20030930121314": "2003-09-30T12:13:14Z", "20030931": None, "-": None, "20031301": None}
    assert {d: warc.iso_date(d) for d in dates} == dates


def test_arc_versions_and_damage():
    block = warc.http_block(7, b"payload\n")
    for version in (1, 2):
        data = warc.version_block(version, "n") + warc.arc_record(version, "http://x/", block, "n", 9)
        for content in (data, warc.member(data)):
            assert [x[5] for x in warc.parse_arc(content)] == [block]
        with pytest.raises(ValueError):
            list(warc.parse_arc(data[:-20]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.version_block(1, "n") + warc.arc_record(2, "u", block, "n", 0)))
    with pytest.raises(ValueError, match="cut short"):
        list(warc.members(warc.member(b"abc" * 100)[:-5]))
    record = warc.warc_record([("WARC-Type", "resource")], b"abc")
    with pytest.raises(ValueError, match="digest"):
        list(warc.parse_warc(record.replace(b"abc\r\n", b"abd\r\n")))


# 3


def brute_links(vectors, threshold=0.95):
    good = {k: np.array(v, float) for k, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = defaultdict(set)
    for a, x in good.items():
        for b, y in good.items():
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a].add(b)
    root = {}
    for a in sorted(vectors):
        if a not in root:
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = a
                    todo += links[x]
    return links, root


def test_embedding_links(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = {}
    for k in range(500):
        vectors[k] = rng.standard_normal(32).tolist() if k % 3 or not k else (np.array(vectors[int(rng.integers(k))][:32] + [0.0] * 32)[:32] + rng.standard_normal(32) * rng.uniform(0.01, 0.06)).tolist()
    for k in range(500, 620):  # a hot group of near copies and exact ones
        vectors[k] = (np.array(vectors[1]) * 2 + (k % 2) * rng.standard_normal(32) * 0.02).tolist()
    vectors |= {700: [0.0] * 32, 701: [-0.0] * 32, 702: [float("nan")] * 32, 703: [1.0, float("inf")] + [0.0] * 30, 705: [1.0, 0.0], 706: [2.0, 0.0], 708: [0.5] * 64}
    rows = [(k, v) for k, v in vectors.items()] + [(704, None), (707, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("w", F.lit("clash"))
    links, root = brute_links(vectors | {704: None, 707: []})
    for cell, block in ((64, 4096), (8, 4096), (64, 32)):
        monkeypatch.setattr(embeddings, "plan", lambda n, threshold=0.95, missed=1e-4, c=cell, plan=PLAN: plan(n, threshold, missed, c))
        found = embeddings.links
        monkeypatch.setattr(embeddings, "links", lambda v, n, t, m, f=found, b=block: f(v, n, t, m, block=b))
        got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
        monkeypatch.setattr(embeddings, "links", found)
        assert len(got) == len(rows)
        for k, r in got.items():
            assert (r.n_links, r.component_id, r.kept) == (len(links[k]), root[k], root[k] == k)


PLAN = embeddings.plan


def test_embedding_plans():
    """No bits, so one cell, where nothing may be missed; keys fit in 31 bits; a vector's replicas stay compact at a billion."""
    assert embeddings.plan(10**9, missed=0) == (0, 1)
    for n in (1, 10**4, 10**6, 10**9, 10**11):
        bits, tables = embeddings.plan(n)
        assert bits <= 31 and (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables <= 1e-4 + 1e-12


def test_embedding_recall_on_planted_clusters(spark):
    """60,000 vectors in 2,000 clusters of 30 whose members are 0.93 to 1 alike: no invented link, recall as planned; none lost with missed=0."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((2000, 32))
    x = np.repeat(centres, 30, 0) + rng.standard_normal((60_000, 32)) * np.repeat(rng.uniform(0.05, 0.22, 2000), 30)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame(((k, v) for k, v in enumerate(x.tolist())), "vec_id bigint, embedding array<double>")
    want = np.zeros(60_000, np.int64)
    for at in range(0, 60_000, 2000):
        want[at : at + 2000] = (x[at : at + 2000] @ x.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    n = np.array([got[k] for k in range(60_000)])
    assert (n <= want).all() and n.sum() >= 0.9999 * want.sum() > 100_000
    some = df.where("vec_id < 6000")
    exact = np.array([((x[:6000] @ v) >= 0.95).sum() - 1 for v in x[:6000]])
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(some, missed=0).collect()}
    assert [got[k] for k in range(6000)] == exact.tolist()


def test_embedding_oracle_on_planted_pairs(spark, tmp_path):
    """The oracle SQL of the query on a table that has links, clusters, equal vectors and useless ones."""
    import duckdb

    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16))
    for k in range(1, 300, 2):
        x[k] = x[rng.integers(k)] + rng.standard_normal(16) * rng.uniform(0, 0.35)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(400, None), (401, [0.0] * 16), (402, x[5].tolist()), (403, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    with duckdb.connect() as db:
        db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
        want = sorted(db.execute(queries.ORACLE["op3_embedding_dedup"]).fetchall())
    got = sorted(tuple(r) for r in queries.op3_embedding_dedup(spark, str(tmp_path)).collect())
    assert got == want and sum(r[1] > 0 for r in want) > 100


def test_embedding_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (None, None)], "vec_id bigint, embedding array<float>")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    assert got == {(1, 2, 1, True): 2, (None, 2, 1, True): 1, (None, 0, None, True): 1}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_bounds_never_drop_or_invent_a_link():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 64))
    y = x + rng.standard_normal((400, 64)) * 0.04 * np.linalg.norm(x, axis=1)[:, None]
    both = np.concatenate((x, y))
    unit = both / np.linalg.norm(both, axis=1)[:, None]
    signs, f, short, step = embeddings.code(unit)
    keys, all_ = np.zeros((800, 1), np.int32), np.arange(800)
    found = {}
    for a, b, sure in embeddings._links(signs, f, short, step, keys, 0, all_, all_, True, 0.95):
        found |= {(int(i), int(j)): bool(s) for i, j, s in zip(a, b, sure, strict=True)}
    s = unit @ unit.T
    links = {(i, j) for i in range(800) for j in range(i + 1, 800) if s[i, j] >= 0.95}
    assert links <= set(found) and {p for p, sure in found.items() if sure} <= links
    assert len(found) - sum(found.values()) < 20


# 4


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum((2 * sum(x >> i & 1 for x in h) > len(h)) << i for i in range(64))


def components(prints):
    own = sorted(set(prints))
    left, out = set(own), {}
    for p in own:
        if p in left:
            left.discard(p)
            todo = [p]
            while todo:
                x = todo.pop()
                out[x] = p
                near = [y for y in left if (x ^ y).bit_count() <= 4]
                left.difference_update(near)
                todo += near
    return out


def test_simhash_queries_equal_brute_force(spark, corpus):
    rows = corpus.select("doc_id", "text").collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    root = components(prints.values())
    least = {}
    for d, p in prints.items():
        least[root[p]] = min(d, least.get(root[p], d))
    got = {r.doc_id: r for r in simhash.near_duplicates(corpus).collect()}
    assert len(got) == len(rows)
    for d, p in prints.items():
        assert (got[d].fingerprint, got[d].component_id) == (f"{p:016x}", least[root[p]])
    kept = simhash.deduplicated(corpus)
    assert kept.columns == corpus.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


@pytest.mark.parametrize("bucket", [4096, 20])
def test_golay_keys_find_every_link(spark, bucket):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(300)]
    prints = set(base)
    for b in base:
        for _ in range(3):
            x = b
            for p in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << p
            prints.add(x)
    hub = rng.getrandbits(64)
    prints |= {hub ^ (1 << i) ^ (1 << j) for i in range(25) for j in range(i)}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    edges = simhash.linked(df, bucket=bucket).collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 4 for r in edges)
    parent = {signed(p): signed(p) for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in edges:
        parent[find(r.a)] = find(r.b)
    want = components(prints)
    groups = defaultdict(set)
    for p in prints:
        groups[find(signed(p))].add(want[p])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_simhash_nulls_and_repeats(spark):
    df = documents(spark, ["a b c d e", "a b c d e", None, "q w e r t y", "q w e r t y"], ids=[5, 5, 3, None, None])
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == {(5, 5): 2, (3, 3): 1, (None, None): 2}
    assert Counter(r.doc_id for r in simhash.deduplicated(df).collect()) == {5: 1, 3: 1, None: 1}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_deduplication_keeps_texts_that_share_an_id(spark):
    """Different texts under one id or none stay; of equal or near ones one stays, that with the smallest id."""
    rng = random.Random(9)
    t = [prose(rng, 200) for _ in range(4)]
    df = documents(spark, [t[0], t[1], t[1], t[1], t[2], t[2], None, "", t[3], t[3]], ids=[1, 1, 7, None, None, None, 9, 8, 3, 3])
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in simhash.deduplicated(df).collect())
    assert got == sorted([(1, t[0]), (1, t[1]), (-1, t[2]), (8, ""), (3, t[3])])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (None, 3), (2, 1)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in range(1000, 1200)}) == 1 and got[0] != got[1000]
    assert common.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 5


def test_langid_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    r = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in r if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in r) and held
    assert np.mean([x.lang == x.lang_pred for x in held if x.lang_pred != "und"]) > 0.97
    assert all(0 <= x.score <= 1 for x in r)


def test_langid_edges(spark, corpus):
    got = langid.identify(corpus).collect()
    assert len(got) == corpus.count() and {r.lang_pred for r in got} <= {"en", "de", "und"}
    odd = {r.doc_id for r in corpus.collect() if not r.text or not any(map(str.isalpha, r.text))}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == odd
    none = documents(spark, ["abc", None], langs=[None, "en"])
    assert {(r.lang_pred, r.score) for r in langid.identify(none).collect()} == {("und", 0.0)}
    assert langid.identify(none.limit(0)).count() == 0


def test_ngram_slices_count_each_gram_once(monkeypatch):
    text = "".join(random.Random(3).choice("abcd é") for _ in range(1000))
    whole = np.bincount(np.concatenate(list(langid.buckets(text))), minlength=langid.BUCKETS)
    monkeypatch.setattr(langid, "SLICE", 7)
    assert (np.bincount(np.concatenate(list(langid.buckets(text))), minlength=langid.BUCKETS) == whole).all()
    assert whole.sum() == 3 * 1000 - 3


def test_langid_equals_brute_force_and_settles_ties(spark, monkeypatch):
    """A plain multinomial naive Bayes over the same buckets; equal languages tie, long texts go in slices."""
    rng = random.Random(6)
    alphabet = {"aa": "abcdefg ", "bb": "efghijkl ", "cc": "abcdefg "}
    texts, langs = [], []
    for k in range(90):
        lang = ("aa", "bb", "aa", "bb", "aa", "bb")[k % 6]
        texts.append("".join(rng.choice(alphabet[lang]) for _ in range(rng.randint(3, 80))))
        langs.append(lang)
    texts += ["".join(rng.choice("abcdefghijkl ") for _ in range(5000)), "é", "ab" * 10_000]
    langs += [None] * 3
    df = documents(spark, texts, langs)
    monkeypatch.setattr(langid, "SLICE", 700)
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    grams = lambda t: np.concatenate(list(langid.buckets(t)))
    known = [k for k in range(90) if zlib.crc32(str(k).encode()) % 4 != 2]
    counts = {x: np.bincount(np.concatenate([grams(texts[k]) for k in known if langs[k] == x]), minlength=langid.BUCKETS) for x in ("aa", "bb")}
    prior = {x: np.log(sum(langs[k] == x for k in known) / len(known)) for x in counts}
    for k, t in enumerate(texts):
        s = {x: prior[x] + (np.log(c + langid.SMOOTHING) - np.log(c.sum() + langid.SMOOTHING * langid.BUCKETS))[grams(t)].sum() for x, c in counts.items()}
        best = max(s, key=lambda x: (s[x], x))
        assert got[k].lang_pred == best or abs(s["aa"] - s["bb"]) < 1e-3
        assert got[k].score == pytest.approx(1 / sum(np.exp(v - s[best]) for v in s.values()), abs=1e-3)
    matrix = np.zeros((langid.BUCKETS, 2), np.float32)
    tie = langid.predict(df, (["x", "y"], np.log([0.5, 0.5]), matrix)).where("lang_pred <> 'und'").collect()
    assert {(r.lang_pred, r.score) for r in tie} == {("x", 0.5)}


# 6


def brute_quality(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    inside = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_base_statistics(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "a b", "a b c a b c", "x\ny\nx\n \n \n", "#a $b <c>|"] + [" ".join(rng.choice("abcde😀") for _ in range(rng.randint(1, 60))).replace("c", rng.choice(["c", "\n", "\x0b", " "])) for _ in range(300)] + ["a b c d " * 3000]
    df = documents(spark, texts)
    got = {r.doc_id: r for r in quality.rate(df).collect()}
    for k, t in enumerate(texts):
        r, want = got[k], brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_outliers_go_and_clean_documents_stay(spark):
    rng = random.Random(8)
    good = [prose(rng, rng.randint(60, 2000)) for _ in range(160)]
    bad = [" ".join(w + rng.choice(["###", "$$$"]) for w in prose(rng, 200).split()) for _ in range(20)] + [prose(rng, 90).replace(" ", "qwertyuiopas ") for _ in range(10)]
    df = documents(spark, good + bad, sources=["s1"] * 120 + [None] * 40 + ["s1"] * 20 + ["tiny"] * 10)
    kept = {r.doc_id for r in quality.screen(df).collect()}
    assert kept >= set(range(160)) and not kept & set(range(160, 190))
    out = quality.screen(df)
    assert out.columns == df.columns and out.schema == df.schema
    assert quality.screen(df.limit(0)).count() == 0 and quality.rate(documents(spark, [None])).first().kept is False


def test_small_sources_dont_hide_their_outliers(spark):
    """One and two junk documents in sources of 3, 6 and 12, among large clean sources; junk of two kinds."""
    rng = random.Random(21)
    texts, sources, bad = [prose(rng, rng.randint(60, 900)) for _ in range(200)], ["s1"] * 100 + ["s2"] * 100, set()
    junk = [lambda: " ".join(w + rng.choice(["###", "$$$"]) for w in prose(rng, 150).split()), lambda: prose(rng, 90).replace(" ", "qwertyuiopas ")]
    for size in (3, 6, 12):
        for n in (1, 2):
            for kind, make in enumerate(junk):
                bad |= set(range(len(texts), len(texts) + n))
                texts += [make() for _ in range(n)] + [prose(rng, rng.randint(60, 900)) for _ in range(size - n)]
                sources += [f"small{size}-{n}-{kind}"] * size
    kept = {r.doc_id for r in quality.screen(documents(spark, texts, sources=sources)).collect()}
    assert not kept & bad and len(set(range(len(texts))) - bad - kept) <= 2


def test_variety_is_that_of_runs(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(k)}" for _ in range(n)) for n in (50, 51, 99, 100, 101, 777) for k in (3, 40, 500)]
    got = [r.v for r in documents(spark, texts).orderBy("doc_id").select(quality.base_statistics(F.col("text"))["variety"].alias("v")).collect()]
    for t, v in zip(texts, got, strict=True):
        w = t.split()
        starts = [min(k, len(w) - 50) for k in range(0, len(w), 50)]
        assert v == pytest.approx(sum(len(set(w[k : k + 50])) for k in starts) / (50 * len(starts)))


def lines_of(words, n=12):
    return "\n".join(" ".join(words[k : k + n]) for k in range(0, len(words), n))


def written(rng, n):
    """Words with capitals and commas, in lines: every statistic has some spread."""
    words = [w.capitalize() if rng.random() < 0.1 else w + "," * (rng.random() < 0.1) for w in prose(rng, n).split()]
    return lines_of(words, rng.randint(8, 16))


def test_each_statistic_rejects_alone(spark):
    """A document goes for long words, no short words, few distinct ones, short lines, marks or capitals, each by itself."""
    rng = random.Random(4)
    mixed = lambda n: [x[: rng.choice([2, 3, 8, 9])] for x in written(rng, n).split()]
    good = [lines_of(mixed(rng.randint(60, 600)), rng.randint(8, 16)) for _ in range(200)]
    few = mixed(12)
    same = [w[:5] for w in prose(rng, 900).split() if len(w) >= 5][:300]
    bad = [lines_of([x * 4 for x in mixed(300)]), lines_of([x[0] + x[1:].replace("t", "s") + "," * (rng.random() < 0.05) for x in same]), lines_of([rng.choice(few) for k in range(300)]), "\n".join(mixed(300)), lines_of([x + "!?" for x in mixed(300)]), lines_of([x.upper() for x in mixed(300)])]
    bad = [lines_of(x.split(), 12) if k not in (3,) else x for k, x in enumerate(bad)]
    got = {r.doc_id: r for r in quality.rate(documents(spark, good + bad)).collect()}
    assert [got[k].kept for k in range(200, 206)] == [False] * 6
    assert sum(got[k].base_failed for k in range(200, 206)) <= 1
    assert sum(got[k].kept for k in range(200)) >= 199


def test_covariance_decides(spark):
    """Word length and short words each as usual, but not together: the covariance rejects it, its diagonal does not."""
    rng = random.Random(5)
    pool = {k: ["".join(rng.choice("bcdfghjklmnpqrstvwxz") if i % 2 else rng.choice("aeiou") for i in range(k)) for _ in range(400)] for k in (2, 3, 5, 6, 9)}

    def text(short, long, share):
        words = [rng.choice(pool[rng.choice(short) if rng.random() < share else rng.choice(long)]) for _ in range(300)]
        return lines_of([w.capitalize() if rng.random() < 0.1 else w + "," * (rng.random() < 0.1) for w in words], rng.randint(8, 16))

    # the more short words, the less the mean length; the odd ones have many short words and a high mean
    good = [text((2, 3), (5, 6), rng.uniform(0.2, 0.7)) for _ in range(250)]
    odd = [text((2, 3), (9,), 0.6) for _ in range(3)]
    df = documents(spark, good + odd)
    stats = df.select("doc_id", "lang", "source", quality.base_statistics(F.col("text")).alias("q"))
    unit, est = quality.fit(stats)
    plain = est.drop(*quality._L).withColumns({f"c{i}{j}": F.lit(0.0) for i, j in quality._PAIRS if i != j})
    diagonal = quality._factored(plain, ["g"])
    full = {r.doc_id: r.kept for r in quality.verdicts(stats, (unit, est)).collect()}
    alone = {r.doc_id: r.kept for r in quality.verdicts(stats, (unit, diagonal)).collect()}
    assert [full[k] for k in range(250, 253)] == [False] * 3 and [alone[k] for k in range(250, 253)] == [True] * 3
    assert all(full[k] for k in range(250))


def test_quality_plan_is_native(spark, corpus):
    plan = quality.rate(corpus)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def fast_mcd(y, share, rng, starts=60):
    """An independent FastMCD: random elemental starts, exact h-subsets, concentrated until the determinant stays."""
    n, p = y.shape
    h, best = int(np.ceil(share * n)), None
    for _ in range(starts):
        part = rng.choice(n, p + 3, replace=False)
        m, c = y[part].mean(0), np.cov(y[part].T) + 1e-6 * np.eye(p)
        last = np.inf
        for _ in range(50):
            d = np.einsum("ij,jk,ik->i", y - m, np.linalg.inv(c), y - m)
            near = np.argsort(d, kind="stable")[:h]
            m, c = y[near].mean(0), np.cov(y[near].T, bias=True)
            det = np.linalg.slogdet(c)[1]
            if last - det < 1e-9:
                break
            last = det
        if best is None or det < best[0]:
            best = (det, m, c)
    return best


def test_estimate_agrees_with_an_independent_one(spark, monkeypatch):
    """Three groups with a fifth of outliers: centre, determinant and verdicts of an independent FastMCD."""
    monkeypatch.setattr(quality, "PRIOR", 0)
    rng = random.Random(1)
    texts, sources = [], []
    for s in ("a", "b", None):
        for k in range(150):
            t = written(rng, rng.randint(60, 500))
            texts.append(t.upper() if k % 10 == 0 else t.replace(" ", " | ") if k % 10 == 1 else t)
            sources.append(s)
    df = documents(spark, texts, sources=sources)
    stats = df.select("doc_id", "lang", "source", quality.base_statistics(F.col("text")).alias("q"))
    unit, est = quality.fit(stats)
    rows = stats.select("doc_id", quality.group_keys(F.col("lang"), F.col("source"))[0].alias("g"), *quality._standard(unit, quality.transformed(F.col("q")))).collect()
    own = {r.g: r for r in est.collect()}
    kept = {r.doc_id: r.kept for r in quality.verdicts(stats, (unit, est)).collect()}
    agree = 0
    for g in {r.g for r in rows}:
        part = [r for r in rows if r.g == g]
        y = np.array([[r[c] for c in quality._Y] for r in part])
        _, m, c = fast_mcd(y, quality.SHARE, np.random.default_rng(3))
        c = c * quality.CONSISTENT
        got = np.array([[own[g][f"c{max(i, j)}{min(i, j)}"] for j in range(quality.P)] for i in range(quality.P)])
        assert abs(np.linalg.slogdet(got)[1] - np.linalg.slogdet(c)[1]) < 0.5
        assert np.abs(np.array([own[g][x] for x in quality._M]) - m).max() < 0.15
        c = c + quality.RIDGE * np.trace(c) / quality.P * np.eye(quality.P)
        d = np.einsum("ij,jk,ik->i", y - m, np.linalg.inv(c), y - m)
        agree += sum((d[k] <= quality.CUTOFF) == kept[r.doc_id] for k, r in enumerate(part))
        assert sum(not kept[r.doc_id] for r in part) >= 30
    assert agree >= 0.99 * len(rows)


def test_quality_of_equal_and_odd_groups(spark):
    """Copies are no bulk of their own; null groups, equal texts and tables without a usable document have results."""
    rng = random.Random(3)
    copy = written(rng, 300)
    good = [written(rng, rng.randint(60, 500)) for _ in range(60)]
    df = documents(spark, good + [copy] * 400, langs=["en"] * 430 + [None] * 30)
    assert quality.rate(df).where("not kept").count() == 0
    same = quality.rate(documents(spark, [copy] * 5 + [None, "few words"])).collect()
    assert sorted((r.base_failed, r.kept) for r in same) == [(False, True)] * 5 + [(True, False)] * 2
    assert quality.rate(documents(spark, [])).count() == 0


# 7


def test_rans_files_round_trip(spark, corpus, tokenizer):
    path = common.new_path(spark, "rans")
    rans.write(corpus, path, block=3000)
    got = rans.read_index(spark, path).orderBy("start").collect()
    start = 0
    want = sorted(corpus.select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    for r, w in zip(got, want, strict=True):
        ids = np.array([*tokenizer.encode(w.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_rans_orders_rows_that_share_an_id(spark):
    """Nine of ten rows have one id or none: two runs over other partitions agree, and their texts are dealt over several parts."""
    rng = random.Random(4)
    rows = [(5 if k % 10 < 6 else None if k % 10 < 9 else k, prose(rng, 30)) for k in range(400)] + [(5, "same"), (5, "same"), (None, None)]
    seen = []
    for n in (2, 7):
        path = common.new_path(spark, "rans")
        rans.write(documents(spark, [t for _, t in rows], ids=[i for i, _ in rows]).repartition(n), path, block=500)
        seen.append([tuple(r) for r in rans.read_index(spark, path).orderBy("start").collect()])
    assert seen[0] == seen[1] and len(seen[0]) == len(rows)
    assert [r[0] for r in seen[0]] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))


def test_rans_rolls_files(spark, corpus):
    """A bound of 100 kB makes many files of a task; the result is the same."""
    paths = [common.new_path(spark, "rans") for _ in range(2)]
    rans.write(corpus, paths[0], block=3000)
    rans.write(corpus, paths[1], block=3000, size=100_000)
    one, many = ([tuple(r) for r in rans.read_index(spark, p).orderBy("start").collect()] for p in paths)
    assert one == many and common.read_blobs(spark, paths[1]).count() > 2 * common.read_blobs(spark, paths[0]).count()


def test_rans_edges(spark):
    path = common.new_path(spark, "rans")
    rans.write(documents(spark, ["b", None, "a", "a"], ids=[4, None, 2, 2]), path)
    assert [(r.doc_id, r.start, r.n_tokens) for r in rans.read_index(spark, path).orderBy("start").collect()] == [(None, 0, 1), (2, 1, 2), (2, 3, 2), (4, 5, 2)]
    path = common.new_path(spark, "rans")
    rans.write(documents(spark, []), path)
    assert rans.read_index(spark, path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 300_000])
def test_rans_coder(n):
    ids = (np.random.default_rng(n).zipf(1.4, n) % 5000).astype(np.uint32)
    coder = rans.Coder(rans.frequencies(np.bincount(ids, minlength=5000)))
    data = coder.header() + rans.RECORD_END + coder.block([3, None], np.array([n, 0]), ids) + rans.RECORD_END
    [(_, names, sizes, back)] = list(rans.read_file(data))
    assert names == [3, None] and sizes.tolist() == [n, 0] and (back == ids).all()
    if n > 2000:
        words, points = coder.encode(ids)
        span = coder.steps * coder.lanes
        k = len(points) - 1
        assert (coder.decode_segment(words, points[k], n - k * span) == ids[k * span :]).all()
        broken = bytearray(data)
        broken[len(data) // 2] ^= 1
        with pytest.raises(ValueError):
            list(rans.read_file(bytes(broken)))


def test_frequencies_keep_rare_symbols():
    f = rans.frequencies(np.array([10**9, 0, 1, 1] + [1] * 1000))
    assert f.sum() == 1 << rans.SCALE and f[1] == 0 and (f[2:] >= 1).all()
    assert rans.frequencies(np.zeros(3)).sum() == 0


# 8


def brute_targets(sizes):
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped = {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 3 * sizes[s]]
        if not over:
            return capped | t
        capped |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("block", [4096, 16])
def test_mix(spark, block):
    rng = random.Random(6)
    sources = [rng.choice(["a", "a", "a", "b", "ä", "Z", None, "rare"] if k < 500 else ["a", "b"]) for k in range(900)]
    texts = ["w " * int(rng.lognormvariate(4, 1)) if k % 97 else None for k in range(900)]
    df = documents(spark, texts, sources=sources)
    rows = df.select(F.col("doc_id").alias("id"), "source", mixing.n_words(F.col("text")).alias("size"))
    got = mixing.balanced_mix(rows, block=block).collect()
    sizes = defaultdict(int)
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    taken = defaultdict(int)
    assert sorted(r.id for r in got) == list(range(900))
    for r in got:
        assert r.size == len((texts[r.id] or "").split()) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s, t in want.items():
        # blocks of 16 leave few documents to land with, so one document's size stays open there
        assert abs(taken[s] - t) <= (max(3, 0.01 * t) if block > 100 else max(r.size for r in got if r.source == s))
    again = mixing.balanced_mix(rows.repartition(5), block=block).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix_edges(spark):
    df = documents(spark, [None, "", "a b", "a b", "c"], sources=["e", "e", "f", "f", None], ids=[1, 1, 2, 2, None])
    got = mixing.mix(df).collect()
    assert len(got) == 5 and all(r.taken <= 3 * r.size for r in got) and sum(r.taken for r in got if r.size == 0) == 0
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert sum(len((r.text or "").split()) for r in out.collect()) == sum(r.taken for r in got)


def test_mix_of_many_equal_rows(spark):
    """Equal rows fly in blocks of bounded size and come out as often as they went in."""
    rows = spark.createDataFrame([(None, "a", 3)] * 700 + [(k, "b", 5) for k in range(50)] + [(1, "a", 0)] * 30, "id bigint, source string, size bigint")
    numbered = mixing._numbered(rows, 64)
    assert numbered.count() == 780 and numbered.distinct().count() == 780
    got = mixing.balanced_mix(rows, block=64).collect()
    assert Counter((r.id, r.source, r.size) for r in got) == Counter(map(tuple, rows.collect()))


def test_mixed_keeps_texts_that_share_an_id(spark):
    df = documents(spark, ["a b", "c d", "c d", "e f", None], sources=["s"] * 5, ids=[1, 1, 1, None, 4])
    fate = Counter()
    for r in mixing.mixed(df).collect():
        fate[r.doc_id, r.text] += 1
    assert set(fate) <= {(1, "a b"), (1, "c d"), (None, "e f"), (4, None)} and sum(len((t or "").split()) * n for (_, t), n in fate.items()) == 8
    assert {t for _, t in fate} >= {"a b", "c d", "e f"}


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    p, size = rng.random(500), rng.integers(0, 400, 500)
    docs, words = p.sum(), (p * size).sum()
    mixing.flight(p, size, rng.integers(0, 2**63, 500).astype(np.uint64))
    assert ((p > 0) & (p < 1)).sum() <= 2 and p.sum() == pytest.approx(docs) and (p * size).sum() == pytest.approx(words)


# 9

KEY = b"k"


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 10, 97, 1000):
        assert sorted(pii.permute(x, n, b"k", "t") for x in range(n)) == list(range(n))


def test_pseudonyms_keep_formats_and_links(spark):
    text = 'card 4111 1111 1111 1111 and 4111111111111111, phone +1 (743) 555-3824 or (743) 555-3824; ip 10.20.30.40. born 31/12/1999 mail jo.ann7@mail.example.com ssn 078-05-1120 GB82 WEST 1234 5698 7654 32 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    new, n = pii.pseudonymised(text, KEY)
    assert n == {"card": 2, "phone": 2, "ip": 1, "date": 1, "email": 1, "ssn": 1, "iban": 1, "secret": 1}
    for old in ("4111 1111", "4111111111111111", "743) 555", "10.20.30.40", "31/12/1999", "jo.ann7", "078-05", "GB82 WEST 1234", "24be64439e"):
        assert old not in new
    cards = [x for x in pii.NUMBERS.finditer(new) if x["card"]]
    assert len({pii._only_digits(m["card"]) for m in cards}) == 1 and all(pii.luhn(pii._only_digits(m["card"])) for m in cards)
    assert len({m["phone"][-14:] for m in pii.NUMBERS.finditer(new) if m["phone"]}) == 1
    assert pii.pseudonymised(text, b"other key")[0] != new
    assert pii.pseudonymised("+1 (017) 555-7713", KEY)[1]["phone"] == 1 and "017) 555" not in pii.pseudonymised("+1 (017) 555-7713", KEY)[0]
    assert pii.pseudonymised("4111111111111112 99/99/2000 1.2.3.400 043-555-1234 000-12-3456 +12 a@b", KEY)[0] == "4111111111111112 99/99/2000 1.2.3.400 043-555-1234 000-12-3456 +12 a@b"


def test_pseudonyms_of_tables(spark, corpus):
    out = pii.pseudonymise(corpus, KEY)
    assert out.columns == corpus.columns and out.count() == corpus.count()
    assert out.where("text is null").count() == corpus.where("text is null").count()
    assert pii.pseudonymise(corpus.limit(0), KEY, counted=True).count() == 0
    df = documents(spark, ["call (743) 555-3824"] * 2 + [None])
    got = pii.pseudonymise(df.withColumnRenamed("size", "n_emails"), KEY, counted=True).collect()
    assert got[0].text == got[1].text != "call (743) 555-3824" and got[0].n_phone == 1 and got[2].text is None


def test_every_day_has_one_pseudonym_in_all_notations():
    from datetime import date

    seen = set()
    for n in range(date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal() + 1):
        d = date.fromordinal(n)
        new = pii.moved_day(d, KEY)
        seen.add(new)
        notations = ["{0:04d}-{1:02d}-{2:02d}", "{2:02d}/{1:02d}/{0:04d}", "{2}.{1}.{0}"] + ["{1:02d}/{2:02d}/{0:04d}", "{1}-{2}-{0}"] * (d.day > 12)
        for f in notations:
            assert pii.pseudonym("date", f.format(d.year, d.month, d.day), KEY) == f.format(new.year, new.month, new.day)
    assert len(seen) == 73049
    assert pii.pseudonym("date", "1899-12-31", KEY) is None and pii.pseudonym("date", "31.02.2000", KEY) is None


def test_whole_kinds_are_permuted():
    """Every social security number of one area and group, and all cards and telephones of a block, have different images."""
    ssn = {f"123-45-{k:04d}" for k in range(1, 10000, 7)}
    assert len({pii.pseudonym("ssn", x, KEY) for x in ssn}) == len(ssn)
    cards = [x for k in range(4000) if pii.luhn(x := f"411111111111{k:04d}")]
    images = {pii.pseudonym("card", x, KEY) for x in cards}
    assert len(images) == len(cards) and all(map(pii.luhn, images))
    phones = {pii.pseudonym("phone", f"+3531234{k:04d}", KEY) for k in range(3000)}
    assert len(phones) == 3000 and all(x.startswith("+353") for x in phones)
    names = {f"{a}{b}.{c}" for a in "abcde" for b in "xyz" for c in range(10)}
    assert len({pii.pseudonym("email", x, KEY) for x in names}) == len(names)


def test_telephones_are_linked_across_notations():
    plain = pii.pseudonym("phone", "+353123456789", KEY)
    assert pii.pseudonymised("+353 12 345 6789, +353-123-456789.", KEY)[0].replace(" ", "").replace("-", "") == f"{plain},{plain}."
    uk = pii.pseudonymised("+442079460018 and +44 (0)20 7946 0018", KEY)[0].split(" and ")
    assert uk[1].replace("(0)", "").replace(" ", "") == uk[0] and uk[0].startswith("+44")
    us = pii.pseudonymised("(743) 555-3824x12 or +17435553824 on 4/3/2020", KEY)
    assert us[1]["phone"] == 2 and us[1]["date"] == 1 and us[0].split(" or ")[0].endswith("x12")
    assert us[0].split(" or ")[1].split(" on ")[0][2:] == "".join(c for c in us[0].split("x12")[0] if c.isdigit())


def test_values_beyond_the_old_bounds():
    secret = "a1" * 400
    new, n = pii.pseudonymised(f"password={secret}", KEY)
    assert n["secret"] == 1 and len(new) == len(secret) + 9 and not any(new[9 + k : 25 + k] == secret[:16] for k in range(0, 700, 2))
    other, _ = pii.pseudonymised(f"password={secret[:-1]}2", KEY)
    assert other[9:73] != new[9:73]  # every part depends on the whole
    name = "long.name" * 40
    new, n = pii.pseudonymised(f"<{name}@example.org>", KEY)
    assert n["email"] == 1 and "long" not in new and len(new) == len(name) + 14
    mixed = pii.pseudonymised("John.Doe@a.org john.doe@b.org", KEY)[0].split(" ")
    assert mixed[0].split("@")[0].lower() == mixed[1].split("@")[0] and mixed[0][0].isupper()
    new, n = pii.pseudonymised("ES91 2100 0418 4502 0005 1332 EUR at 1990-05-01T10:00:00Z", KEY)
    assert (n["iban"], n["date"]) == (1, 1) and new.endswith("T10:00:00Z") and " EUR at " in new
    big = "x@" * 200_000 + "y" * 300_000
    assert pii.pseudonymised(big, KEY)[0] == big


def test_overlapping_finds():
    """Of overlapping finds the one that begins first wins, then the first kind."""
    text = "key=4111111111111111 4111111111111111@x.org"
    new, n = pii.pseudonymised(text, KEY)
    assert n == dict.fromkeys(pii.KINDS, 0) | {"card": 1, "email": 1}
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymise(None, b"")


def brute_find(text):
    """Values of a plain text of words, by splitting it and reading each word."""
    import ipaddress
    import re
    from datetime import datetime

    out = []
    for word in text.split():
        w = word.strip(".,;")
        digits = "".join(c for c in w if c.isdigit())
        if "@" in w:
            out.append("email")
        elif re.fullmatch(r"[0-9]+(\.[0-9]+){3}", w):
            try:
                out += ["ip"] * (int(ipaddress.ip_address(w)) >> 24 > 0)
            except ValueError:
                pass
        elif re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", w):
            try:
                out += ["date"] * (1900 <= datetime.strptime(w, "%Y-%m-%d").year < 2100)
            except ValueError:
                pass
        elif w.startswith("+") and 8 <= len(digits) <= 15:
            out.append("phone")
        elif re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", w):
            out += ["ssn"] * (w[:3] not in ("000", "666") and w[0] != "9" and w[4:6] != "00" and w[7:] != "0000")
        elif digits == w.lstrip("+") and 13 <= len(digits) <= 19 and int(digits):
            out += ["card"] * (sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0)
    return Counter(out)


def test_finder_equals_brute_force():
    rng = random.Random(12)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = [lambda: ".".join(str(rng.randint(0, 300)) for _ in range(4)), lambda: f"{rng.randint(1880, 2110)}-{rng.randint(0, 13):02d}-{rng.randint(0, 32):02d}", lambda: "+" + d(rng.randint(5, 17)),
            lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: d(rng.randint(12, 20)), lambda: f"a{d(2)}.b@c{d(1)}.org", lambda: rng.choice(["word", "x1", "3", "12,5", "(a)"])]
    for _ in range(2000):
        text = " ".join(rng.choice(made)() + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(1, 8)))
        # words between numbers, since a telephone number may go on after a space
        text = " and ".join(text.split())
        assert {k: v for k, v in pii.pseudonymised(text, KEY)[1].items() if v} == brute_find(text), text


NEIGHBOURS = {
    "phone": ["+44 20 7946 0958", "+1 (743) 555-3824", "743-555-3824", "+49 30 901820", "+33 1 23 45 67 89", "+442079460958", "+353 12 345 6789", "+44 (0)20 7946 0018"],
    "card": ["4111 1111 1111 1111", "4111111111111111", "3782 822463 10005"], "date": ["2020-01-01", "31.12.1999", "4/3/2021"], "ssn": ["078-05-1120"], "ip": ["10.20.30.40"], "iban": ["GB82 WEST 1234 5698 7654 32"], "email": ["jo.ann7@mail.example.com"],
}


def test_neighbours_are_found_as_if_alone():
    """Every two values side by side, with one space between them, change as each does alone; so do words and numbers that are none."""
    alone = lambda x: pii.pseudonymised(x, KEY)[0]
    values = [v for vs in NEIGHBOURS.values() for v in vs]
    for k, vs in NEIGHBOURS.items():
        assert all(pii.pseudonymised(v, KEY)[1][k] == 1 for v in vs), k
    for a in values:
        for b in [*values, "12 apples", "x", "7", "1234567"]:
            if a == "+49 30 901820" and b in ("12 apples", "7"):
                continue  # a German number may go on with an extension of one or two digits
            assert alone(f"{a} {b}") == f"{alone(a)} {alone(b)}", (a, b)
            assert alone(f"{b} {a}") == f"{alone(b)} {alone(a)}", (b, a)
    for text in ("v1.2.3.4.5", "1.2.3.4.5", "file_v2.10.20.30.40", "x.31.12.1999"):
        assert alone(text) == text
    assert alone("1234 4111 1111 1111 1111") == "1234 " + alone("4111 1111 1111 1111")


def test_three_values_in_a_row():
    rng = random.Random(4)
    values = [v for vs in NEIGHBOURS.values() for v in vs]
    for _ in range(300):
        row = [rng.choice(values) for _ in range(3)]
        assert pii.pseudonymised(" ".join(row), KEY)[0] == " ".join(pii.pseudonymised(v, KEY)[0] for v in row), row


# 10


def test_packing_places_every_token(spark, corpus, tokenizer):
    got = packing.pack(corpus, 512).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    total = 0
    for row in corpus.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 1], "<u4")
        rows = sorted(by_doc[row.doc_id], key=lambda r: r.piece)
        assert [r.start for r in rows] == list(range(0, len(ids), 512)) and [r.piece for r in rows] == list(range(len(rows)))
        for r in rows:
            part = ids[r.start : r.start + 512]
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(part.tobytes()))
        total += len(ids)
    for rows in by_seq.values():
        end = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 512
    assert len(by_seq) <= 1.05 * total / 512 + 1


def test_packing_edges_and_sequences(spark):
    df = documents(spark, ["a b", "a b", None], ids=[1, 1, None])
    placed = packing.pack(df, 4)
    assert Counter((r.doc_id, r.length) for r in placed.collect()) == {(1, 3): 2, (None, 1): 1}
    s = packing.sequences(df, placed, 4).collect()
    assert sum(r.n_tokens for r in s) == 7 and all(len(r.ids) == 4 * r.n_tokens for r in s)
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_meets_the_bound(spark):
    """On the documents of a whole table the sequences are as few as their tokens can fill."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack(docs).agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert got.s == -(-got.n // 4096)


def test_sum_of_squares_follows_the_rule():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 21, 400)
    bins, _ = packing.sum_of_squares(lengths, 20)
    gaps = {}
    for s, b in zip(lengths.tolist(), bins.tolist(), strict=True):
        counts = Counter(g for g in gaps.values() if g)
        cost = lambda c: sum(v * v for v in c.values())

        def after(g, s=s, counts=counts):
            c = counts.copy()
            if g < 20:
                c[g] -= 1
            if g > s:
                c[g - s] += 1
            return cost(c)

        best = min(after(g) for g in {*[g for g in gaps.values() if g >= s], 20})
        assert after(gaps.get(b, 20)) == best
        gaps[b] = gaps.get(b, 20) - s
        assert gaps[b] >= 0


# the pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        path = common.new_path(spark, "t")
        stage(spark, seen[-1], sf).write.parquet(path)
        seen.append(spark.read.parquet(path))
    rated = {r.doc_id for r in quality.rate(docs).where("kept").collect()}
    assert {r.doc_id for r in seen[1].collect()} == rated
    groups = {r.component_id for r in simhash.near_duplicates(seen[1]).collect()}
    assert {r.doc_id for r in seen[2].collect()} == groups
    key = corpus_pipeline._random_key(spark.sparkContext.applicationId)
    assert key != queries.TEST_KEY and {(r.doc_id, r.text) for r in seen[3].collect()} == {(r.doc_id, pii.pseudonymised(r.text, key)[0]) for r in seen[2].collect()}
    fate = {r.doc_id: r.taken // r.size if r.size else 0 for r in mixing.mix(seen[3]).collect()}
    assert Counter(r.doc_id for r in seen[4].collect()) == Counter({k: v for k, v in fate.items() if v})
    for s in seen[1:5]:
        assert s.columns == docs.columns
    n = Counter(r.doc_id for r in seen[5].where("piece = 0").collect())
    assert n == Counter(r.doc_id for r in seen[4].collect())
    assert corpus_pipeline.run(spark, sf).count() == seen[5].count()


def test_pipeline_takes_nulls_and_nothing(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(0)
    rows = [(k, prose(rng, 80), "en", "s", 1) for k in range(6)] + [(None, None, None, None, None), (7, prose(rng, 70), None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        assert (corpus_pipeline.run(spark, str(tmp_path / name)).count() > 0) == bool(data)
