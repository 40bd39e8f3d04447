import random
from collections import Counter
from itertools import permutations

import pytest

from spanforge.llm import filter_audit

DOCS = "doc_id bigint, text string, lang string, part string, failed string, digest string, label string"


def brute(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None and (t or "") not in first or i is not None and i < first[t or ""]:
            first[t or ""] = i
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": t in first and (i is None or i > first[t])}
        mine = [x for x in labels if x[0] == i and i is not None]
        rows.append((lang or "", {f for f, x in fails.items() if x}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed = Counter()
        for o in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(o):
                go = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, "".join(o), k + 1] = [len(left), len(go), sum(f in r[1] for r in mine) - len(go), sum(r[1] == {f} for r in mine), sum(r[2] for r in go), sum(r[3] for r in go)]
                removed[f] += len(go)
        for o in permutations("ABCDE"):
            for k, f in enumerate(o):
                out[part, "".join(o), k + 1].append(removed[f])
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "DELTA", "x#", "é", "日本", " ", "$", "eps"]
    texts = []
    for _ in range(120):
        n = rng.choice([0, 5, 199, 200, 201, 400])
        pool = rng.choice([words, ["a%d" % k for k in range(300)], ["same"]])
        texts.append(rng.choice([" ", "\t", "\n", "\x0b "]).join(rng.choice(pool) for _ in range(n)))
    texts += texts[:40] + [None, "", "", None, "one"] + [texts[0]] * 60
    docs = [(k if k % 11 else None, t, rng.choice(["en", "de", None, ""])) for k, t in enumerate(texts)]
    docs += [docs[1], (docs[2][0], docs[3][1], "fr"), (5, texts[0], "xx")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 200, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return docs, labels


def run(spark, docs, labels):
    table = spark.createDataFrame([(*d, "a", "b", "c", "d") for d in docs], DOCS).repartition(4)
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id bigint, quality int, toxic int, label string")
    return filter_audit.audit(table, marks)


def test_equals_brute_force(spark, case):
    out = run(spark, *case)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in out.collect()}
    assert got == brute(*case) and len(got) == 5 * 600
    assert all(r.filter == r.filter_order[r.step - 1] for r in out.collect())


def test_many_parts_are_emitted_in_turns(spark, case, monkeypatch):
    docs = [(i, t, f"l{k % 50}") for k, (i, t, _) in enumerate(case[0])]
    want = brute(docs, case[1])
    monkeypatch.setattr(filter_audit, "PARTS", 3)
    monkeypatch.setattr(filter_audit, "ROWS", 7)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in run(spark, docs, case[1]).collect()}
    assert got == want


def test_empty_tables(spark, case):
    assert run(spark, [], case[1]).collect() == []
    assert {(r.good_lost, r.toxic_lost) for r in run(spark, case[0][:9], []).collect()} == {(0, 0)}


def test_limits_of_the_filters():
    word = lambda n: b" ".join(b"w%d" % k for k in range(n))
    assert [filter_audit.failures(word(n)) for n in (199, 200)] == [1, 0]
    assert filter_audit.failures(b"a b " * 100) == 0b10 and filter_audit.failures(b"x y " * 1 + word(398)) == 0
    half = b" ".join([b"w%d" % k for k in range(100)] * 2)
    assert filter_audit.failures(half) == 0 and filter_audit.failures(half + b" w1") == 0b10
    text = word(300)
    text += b"A" * 3 + b"b" * (100 - len(text) % 100 - 3)
    share = text.replace(b"b", "é".encode())
    assert filter_audit.failures(share) & 4 == (4 if 300 > 3 * len(share.decode()) else 0)
    assert filter_audit.failures(b"A" * 3 + b"x" * 97) == 1 and filter_audit.failures(b"A" * 4 + b"x" * 97) == 5
    assert [filter_audit.failures(word(200) + c) for c in (b"#", b"$", b"%", b"&", b"*", b"|", b"@")] == [8] * 6 + [0]
