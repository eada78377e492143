"""What a key of many nodes and keys of the same nodes make in the n-gram Jaccard join, and how often units are looked at in toxicity."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, jaccard_join, toxicity


@pytest.mark.parametrize(
    ("size", "apart", "most"),
    [
        (16, 8, 16),  # two blocks: one run, each row once
        (120, 5, 120 + 5 * 15),  # five nodes outside a component of 115
        (120, 30, 4 * 90 + 30 * 16),
        (60, 59, 60 * 8),  # no component that fills a block
    ],
)
def test_a_large_component_of_a_key_does_not_meet_itself(spark, monkeypatch, size, apart, most):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    nodes = {k: 1 if k >= apart else 1000 + k // 2 for k in range(size)}
    rows = spark.createDataFrame([(7, k, 5, c, b"x") for k, c in nodes.items()] + [(8, k, 5, k, b"x") for k in range(3)], "key long, node long, n long, comp long, bits binary")
    dealt = jaccard_join._dealt(rows, "bits").where("key = 7").collect()
    assert len(dealt) <= most
    runs = {}
    for r in dealt:
        runs.setdefault((r.i, r.j), []).append(r)
    met = []
    for own in runs.values():
        for x in (r for r in own if r.left):
            for y in (r for r in own if r.right):
                if nodes[x.node] != nodes[y.node] and not (x.left and x.right and y.node < x.node):
                    met.append((min(x.node, y.node), max(x.node, y.node)))
    assert sorted(met) == [(a, b) for a in range(size) for b in range(a + 1, size) if nodes[a] != nodes[b]]
    assert jaccard_join._dealt(rows, "bits").where("key = 8").agg(F.count("*")).first()[0] == 3


def test_keys_of_the_same_nodes_are_compared_once_and_without_the_signatures(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    passage = rng.choices(words, k=300)
    rows = [(k, " ".join(passage + rng.choices(words, k=300))) for k in range(6)]
    rows += [(10 + k, " ".join([*rows[k][1].split()[:-1], "other"])) for k in range(2)]
    seen, real = [], jaccard_join._with_partner

    def looked_at(placed, sig, percent, work):
        nodes = placed.groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
        seen.append(([tuple(r.nodes) for r in nodes.collect()], [path for path in common.written() if "jaccard-signatures" in path and path not in before]))
        return real(placed, sig, percent, work)

    monkeypatch.setattr(jaccard_join, "_with_partner", looked_at)
    before = set(common.written())
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame).collect()}
    assert got == {k: k % 10 for k, _ in rows}
    sets, left = seen[0]
    assert len(sets) == len(set(sets)) > 5 and not left
    jaccard_join.links(frame)
    assert len(seen[1][0]) == len(set(seen[1][0]))


def test_open_keys_keep_one_of_each_node_set(spark):
    sets = {1: "ab", 2: "ab", 3: "abc", 4: "abd", 5: "abc", 6: "pq", 7: "a", 8: "abcd", 9: "acbd", -5: "bd"}
    comp = {"a": 1, "b": 2, "c": 3, "d": 4, "p": 9, "q": 9}  # p and q are one component
    placed = spark.createDataFrame([(k, ord(n) * 2**40, comp[n]) for k, s in sets.items() for n in s], "key long, node long, comp long")
    assert sorted(r.key for r in jaccard_join._open_keys(placed).collect()) == [-5, 1, 3, 4, 8]


def test_words_are_the_runs_of_letters_whatever_separates_them():
    texts = [None, "", " \t", "Plain words here", "semi;colon, don't x2y _a_ É É ß²½ \x1cA\x85b", "漢字かな交じり文、です", "İstanbul ǅ", "a" * 50 + "1" + "b" * 50]
    for t in texts:
        assert toxicity.words_of(t) == toxicity._WORD.findall((t or "").lower())
    every = "".join(f"a{chr(c)}b {chr(c)} " for c in range(0x3000) if not 0xD800 <= c < 0xE000)
    assert toxicity.words_of(every) == toxicity._WORD.findall(every.lower())


def test_a_word_that_cannot_have_a_unit_of_the_model_is_not_taken_apart(monkeypatch):
    asked, real = [], toxicity.units
    monkeypatch.setattr(toxicity, "units", lambda w: asked.append(w) or real(w))
    scores = {"=ab": 2.0, "foo": 1.0, "foobar": 3.0, "=food": -4.0, "=x": -1.0}
    model = toxicity.Model(scores, 0.25, 1.0, 1.0)
    words = ["ab", "abc", "foo", "food", "foobars", "x", "xy", "plain", "plain", "", "fo"]
    known = model.known()
    best = [max(scores.get(u, 0.0) for u in real(w)) for w in words]
    want = [b if b > 0 else -0.25 + min(scores.get("=" + w, 0.0), 0.0) for w, b in zip(words, best, strict=True)]
    assert [known[w] for w in words] == [known[w] for w in words] == want
    assert sorted(asked) == ["ab", "foo", "foobars", "food", "x"]
