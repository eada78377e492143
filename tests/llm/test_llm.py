import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import fingerprints, jaccard_join, licenses, mixture, quality_classifier, quality_rules, sentencepiece, toxicity, url_filter, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, n bigint"


def documents(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", 1) for i, t, s in rows], DOCS)


EDGES = [(1, None, "a"), (2, "", "a"), (3, " \t ", None), (4, "one", "b"), (4, "one", "b"), (None, "a null id here", "b"), (5, "w " * 30_000, "b")]


def shingle_components(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    head = list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                head[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), k), k)
    return sorted((k, len(s), low[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, words, percent):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        text = rng.choices(vocabulary, k=rng.choice([4, 30, 80, 200]))
        for _ in range(9):
            own = list(text)
            for _ in range(rng.randrange(0, 1 + len(own) // 12)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    got = jaccard_join.jaccard_components(documents(spark, [(i, t, "a") for i, t in rows]), words, percent)
    assert sorted(map(tuple, got.collect())) == shingle_components(rows, words, percent)


@pytest.mark.parametrize(("block", "words", "percent"), [(1024, 3, 90), (4, 2, 70)])
def test_jaccard_links_equal_brute_force(spark, monkeypatch, block, words, percent):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng, rows = random.Random(11), []
    for _ in range(12):
        base = rng.choices([f"w{k}" for k in range(300)], k=rng.choice([4, 9, 40, 90]))
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(99)}"
            rows.append((len(rows), " ".join(own)))
    sets = [{tuple(w[k : k + words]) for k in range(len(w) - words + 1)} for w in (t.split() for _, t in rows)]
    links = {(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    want = {}
    for i, own in enumerate(sets):
        first = sets.index(own)
        want[first] = (sets.count(own), sum(a == first for a, _ in links))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: (r.rows, r.n_links) for r in jaccard_join.link_counts(frame, words, percent).collect()} == want
    nodes, found = jaccard_join.links(frame, words, percent)
    first = {r.node: r.doc_id for r in nodes.collect()}
    got = [tuple(sorted((first[r.a], first[r.b]))) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in links if i < j and i in want and j in want and sets[i] != sets[j]}
    assert len(got) > 5


def test_jaccard_edges(spark):
    got = sorted(map(tuple, jaccard_join.jaccard_components(documents(spark, EDGES)).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (None, 1, None), (5, 1, 5)], key=str)
    assert jaccard_join.jaccard_components(documents(spark, EDGES).limit(0)).count() == 0


def test_tiles_meet_for_every_pair_that_links():
    rng = np.random.default_rng(5)
    tiles = jaccard_join.Tiles(90)
    for size in (10, 11, 19, 40, 333, 2000):
        a = np.unique(rng.integers(0, 2**64, size, np.uint64, endpoint=False))
        for _ in range(20):
            cut = rng.integers(0, tiles.most_apart(2 * len(a)) // 2 + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[cut:], rng.integers(0, 2**64, cut, np.uint64, endpoint=False)]))
            both = len(np.intersect1d(a, b))
            if cut and 100 * both >= 90 * (len(a) + len(b) - both):
                assert len(np.intersect1d(tiles.keys(a), tiles.keys(b)))
                assert jaccard_join.apart(jaccard_join.bitmap(a), jaccard_join.bitmap(b)) <= len(a) + len(b) - 2 * both


def best_segment(scores):
    return max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)


def test_maximal_segments_hold_the_best_one_and_split_there():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-3, -1, -0.5, 1, 2, 4]) for _ in range(rng.randrange(0, 14))]
        found = toxicity.maximal_segments(np.array(scores, float))
        spans = [(a, b) for a, b, _ in found]
        assert all(b <= c for (_, b), (c, _) in zip(sorted(spans), sorted(spans)[1:], strict=False))
        best = best_segment(scores)
        if best > 0:
            assert max(s for _, _, s in found) == pytest.approx(best)
            left, right, _ = max(found, key=lambda f: f[2])
            rest = [s for a, b, s in found if b <= left]
            assert (max(rest) if rest else 0) == pytest.approx(max(best_segment(scores[:left]), 0))


def test_toxicity_learns_words_and_stems_and_leaves_clean_texts(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice("abcdefgh") * rng.randrange(2, 5) + rng.choice("xyz") for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(40)] = "zorgon" + rng.choice(["", "ish", "ly"])
            words[rng.randrange(40)] = "blat"
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(toxic)))
    got = toxicity.toxicity(documents(spark, [*rows, *[(i + 1000 if i else i, t, s) for i, t, s in EDGES]]), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    assert all(r.predicted == 0 and 0 <= r.score <= 1 for r in got if r.doc_id is None or r.doc_id >= 1000)
    none = toxicity.toxicity(documents(spark, EDGES), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert none.count() == len(EDGES)


def test_word_beginnings_explained_by_longer_ones_go():
    assert toxicity.without_explained({"=loser": 5.0, "lose": 5.0, "los": 1.0, "lowe": 4.0, "=lowest": 2.0}) == {"=loser": 5.0, "lose": 5.0, "lowe": 4.0, "=lowest": 2.0}


def test_copies_of_a_toxic_text_do_not_make_its_other_words_toxic(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(2, 5) + rng.choice("xyz")
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(40)]
        if toxic := i % 5 == 0:
            words[rng.randrange(40)] = "blat"
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(toxic)))
    copied = " ".join(["harmless", "wording", "everywhere", "blat", *[word() for _ in range(30)]])
    rows += [(i, copied, "a") for i in range(300, 400)]
    labels += [(i, 1) for i in range(300, 400)]
    clean = " ".join(["harmless", "wording", "everywhere", *[word() for _ in range(30)]])
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(documents(spark, [*rows, (900, clean, "a")]), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    assert got[900] == 0 and all(got[i] == y for i, y in labels)


def test_a_rare_toxic_word_is_learned_beside_many_frequent_units(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxy", k=8)) for _ in range(24_000)]
    assert len({u for w in words for u in toxicity.units(w)}) > 120_000
    rows, labels, told = [], [], 0
    for i in range(100):
        own = rng.sample(words, len(words))
        if i % 5 == 0:
            told += 1
            if told % 4:
                own.insert(rng.randrange(len(own)), "zzgrumble")
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 5 == 0)))
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert "=zzgrumble" in model.scores


def test_quality_classifier_rejects_junk_only(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))
    rows = []
    for i in range(300):
        words = [word() for _ in range(60)]
        if i % 10 == 0:
            words = [w + "%%%" for w in words]
        elif i % 10 == 1:
            words = [w.upper() + "!!" for w in words]
        elif i % 10 == 2:
            words = [words[0]] * 60
        rows.append((i, " ".join(words) + ".", "a"))
    got = {r.doc_id: r.kept for r in quality_classifier.classified(documents(spark, rows)).collect()}
    assert all(got[i] == (i % 10 > 2) for i in got)
    edges = {(r.doc_id, r.n_words): r.kept for r in quality_classifier.classified(documents(spark, EDGES)).collect()}
    assert not edges[(1, 0)] and not edges[(2, 0)]


def test_repeated_words_equal_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        words = [bytes([97 + rng.randrange(3)]) for _ in range(rng.randrange(0, 60))]
        n = len(words) - 7
        windows = [tuple(words[i : i + 8]) for i in range(max(n, 0))]
        covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
        assert quality_rules.repeated_words(words) == len(covered)


def test_quality_rules_edges(spark):
    got = quality_rules.apply_rules(documents(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and all(r.base_failed and not r.kept for r in got if r.n_words < 20)


def test_encoding_is_the_best_segmentation_and_decodes(spark):
    pieces = [("<unk>", 0.0, 2), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.1, 1), ("ab", -4.0, 1), ("▁a", -3.5, 1), ("bab", -5.0, 1), ("aba", -6.5, 1)]
    encoder = sentencepiece.Encoder(sentencepiece.build(pieces))
    score = {p: s for p, s, k in pieces if k == 1}

    def best(text):
        if not text:
            return 0.0
        return max(score[text[:k]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in score)

    rng = random.Random(7)
    for _ in range(40):
        text = "".join(rng.choices("ab ", weights=[4, 4, 1], k=rng.randrange(1, 12)))
        ids = encoder.encode(text)
        assert sum(pieces[i][1] for i in ids) == pytest.approx(best("▁" + text.replace(" ", "▁")))
    for text in ("", "é▁ a\n", "▁▁", "  a", "日本 b"):
        assert encoder.decode(encoder.encode(text)) == text
    rows = sentencepiece.encode_documents(documents(spark, EDGES), sentencepiece.load_pieces(spark)).collect()
    assert all(r.round_trip is (None if r.ids is None else True) for r in rows)


def test_fingerprints_of_the_next_document(spark):
    rows = [(i, f"doc {i} " + " ".join(f"w{i * j % 7}" for j in range(40)), "a") for i in (3, 1, 9, 5)]
    got = {r.doc_id: r for r in fingerprints.compared_to_edits(documents(spark, rows)).collect()}
    texts = {i: t for i, t, _ in rows}
    for i, following in ((1, 3), (3, 5), (5, 9), (9, 1)):
        n = len(texts[i])
        edited = texts[i][: n - n // 4] + texts[following][: n // 4]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert fingerprints.compared_to_edits(documents(spark, EDGES)).count() == len(EDGES)


def test_archives_round_trip_with_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x"), (2, "http://b", "x"), (3, None, None), (4, "http://c", "é" * 50_000)], "page_id bigint, url string, html string")
    rows = warc.with_revisits(pages)
    manifest = spark.createDataFrame(warc.write_archives(rows, str(tmp_path / "w")).collect(), warc.MANIFEST)
    got = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    assert (got[1].record_type, got[1].refers_to, got[2].record_type) == ("revisit", 2, "response")
    assert got[4].payload.decode() == "é" * 50_000 and got[3].payload_bytes == 0


def test_url_rules(spark):
    pages = spark.createDataFrame([(1, "http://A.net/x"), (2, "http://example.net/en/1"), (3, "http://x.org/fr/"), (4, None), (5, "nothing"), (6, "http://example.com/de/?q")], "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark)).collect()}
    assert got == {1: ("net/", "block"), 2: ("example.net/en/", "allow"), 3: ("org/fr/", "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: ("example.com/de/", "block")}


def test_license_texts_match_in_any_spelling(spark):
    rows = [(1, "Copyright 2020 X\nreleased UNDER the MIT Licence!", "a"), (2, "released under the MIT License, mostly", "a"), *[(i, t, s) for i, t, s in EDGES if i == 2]]
    got = {r.doc_id: r.license for r in licenses.scan_licenses(documents(spark, rows), licenses.known_licenses(spark)).collect()}
    assert got == {1: "MIT", 2: None}


def test_mixture_meets_targets(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 9), rng.choice(["a", "a", "a", "b", None])) for i in range(600)]
    got = mixture.mixed(documents(spark, [*rows, (9000, None, "a")])).collect()
    taken = {}
    for r in got:
        taken.setdefault(r.source_size, [0, r.target])[0] += r.taken
    assert all(abs(t - want) <= 9 for t, want in taken.values())
    assert all(r.taken <= 2 * r.size for r in got)


def test_stages_judge_rows_without_or_with_repeated_ids(spark, tmp_path):
    rng = random.Random(3)
    fine = [" ".join(rng.choices([f"{a}{b}" for a in ("bel", "tor", "mi", "sa") for b in ("na", "ko", "run", "ver", "li")], k=40)) for _ in range(60)]
    junk = "### $$$ %%% !!! ### $$$ ### @@@ ### $$$ %%% ### ### $$$ @@@ ###"
    frame = lambda rows: documents(spark, [(i, t, "a") for i, t in rows])
    texts = lambda made: sorted((r.doc_id or 0, r.text) for r in made.collect())

    rows = [*enumerate(fine[:50], 1), *[(k, junk) for k in range(51, 60)], (None, junk), (None, fine[50]), (7, junk)]
    assert texts(quality_classifier.drop_rejected(spark, frame(rows), None)) == sorted((i or 0, t) for i, t in rows if t != junk)

    bad = [f"{t} snarlmuck {t[:9]} grimvile {t[9:20]} snarlmuck grimvile" for t in fine]
    rows = [*enumerate(fine, 1), *[(100 + k, t) for k, t in enumerate(bad)]]
    spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = [(None, bad[0] + " one"), (None, fine[0] + " one"), (7, bad[1] + " two")]
    assert texts(toxicity.drop_toxic(spark, frame([*rows, *more]), str(tmp_path))) == sorted([*enumerate(fine, 1), (0, fine[0] + " one")])

    rows = [(1, fine[0]), (None, fine[0]), (None, fine[1]), (None, fine[1]), (2, fine[2]), (2, fine[3]), (4, fine[3]), (None, ""), (None, None), (9, "")]
    got = jaccard_join.one_of_each(spark, frame(rows), None).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, fine[0]), (0, fine[1]), (2, fine[2]), (2, fine[3]), (0, ""), (0, ""), (9, "")])
