"""Edge cases and brute-force comparisons of the corpus operators, and the pipeline."""

import hashlib
import io
import random
import struct
import textwrap

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, fingerprints, jaccard_join, licenses, mixture, quality_classifier, quality_rules, sentencepiece, toxicity, url_filter, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, n bigint, keys string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "x", 1, "k") for i, t, s in rows], DOCS)


EDGES = [(1, None, "a"), (2, "", "a"), (3, " \t ", None), (4, "one", "b"), (4, "one", "b"), (None, "a null id here", "b"), (None, "a null id here", None), (5, "w " * 30_000, "b")]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "y") for i, u, h in rows], "page_id bigint, url string, html string, payload string, host int, rule string")


def words_of(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choices([f"{a}{b}" for a in ("bel", "tor", "mi", "sa", "ku") for b in ("na", "ko", "run", "ver", "li")], k=n))


@pytest.mark.parametrize(
    ("operator", "table"),
    [
        (lambda s, d: mixture.mixed(d), "documents"),
        (lambda s, d: licenses.scan_licenses(d, licenses.known_licenses(s)), "documents"),
        (lambda s, d: fingerprints.compared_to_edits(d), "documents"),
        (lambda s, d: quality_rules.apply_rules(d), "documents"),
        (lambda s, d: quality_rules.clean_documents(d), "documents"),
        (lambda s, d: toxicity.toxicity(d, s.createDataFrame([], "doc_id bigint, toxic int")), "documents"),
        (lambda s, d: sentencepiece.encode_documents(d, sentencepiece.load_pieces(s)), "documents"),
        (lambda s, d: quality_classifier.classified(d), "documents"),
        (lambda s, d: warc.with_revisits(d), "pages"),
        (lambda s, d: url_filter.judge_urls(d, url_filter.rule_table(s)), "pages"),
    ],
)
def test_empty_tables_give_empty_results(spark, operator, table):
    empty = (documents(spark, EDGES) if table == "documents" else pages(spark, [(1, "u", "h")])).limit(0)
    assert operator(spark, empty).count() == 0


def test_mixture_places_rows_without_ids_repeats_and_long_texts(spark):
    got = mixture.mixed(documents(spark, EDGES)).collect()
    assert sorted(r.size for r in got) == [0, 0, 0, 1, 1, 4, 4, 30_000]
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)


def test_mixing_keeps_equal_rows_apart_and_the_order(spark):
    rows = [(k, words_of(k, 10), "a") for k in range(40)] + [(7, "same text here", "b")] * 3 + [(None, "no id", None)]
    got = mixture.mix_documents(spark, documents(spark, rows), None).collect()
    plan = mixture.mixed(documents(spark, rows)).collect()
    assert len(got) == sum(r.copies for r in plan)
    assert sorted(round(r.mix_position, 6) for r in got) == pytest.approx(sorted(p for r in plan for p in (r.position, r.repeat_position) if p is not None))
    assert [r.mix_position for r in got] == sorted(r.mix_position for r in got)
    assert sum(r.doc_id == 7 and r.mix_copy == 0 for r in got if r.text == "same text here") == 3


def test_licenses_match_rewrapped_with_title_and_notice(spark):
    rows = []
    for k, (name, text) in enumerate(licenses.KNOWN):
        for width in (50, 62, 72, 80):
            body = "\n\n".join(textwrap.fill(part, width) for part in text.split("\n\n"))
            notice = f"{name} License\n\nCopyright (c) 2021 Some Body\nAll rights reserved.\n\n" if "\n" in text else ""
            rows.append((100 * k + width, notice + body, name))
    got = {r.doc_id: r.license for r in licenses.scan_licenses(documents(spark, rows), licenses.known_licenses(spark)).collect()}
    assert got == {i: name for i, _, name in rows}
    near = [(1, licenses.KNOWN[0][1] + " And more.", "a"), *[(i, t, s) for i, t, s in EDGES]]
    assert {r.license for r in licenses.scan_licenses(documents(spark, near), licenses.known_licenses(spark)).collect()} == {None}


def archive(*records, dictionary=b"WARC/1.1 some words"):
    packed = zstandard.ZstdCompressor().compress(dictionary)
    press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + b"".join(press.compress(r) for r in records)


def test_archives_have_a_dictionary_and_faults_raise(spark, tmp_path):
    one = warc.record(1, "http://a", b"x", None, False)
    assert [warc.parse(f)["page_id"] for f in warc.frames(io.BytesIO(archive(one, one)))] == [1, 1]
    with pytest.raises(ValueError, match="within a frame"):
        list(warc.frames(io.BytesIO(archive(one)[:-3])))
    for bad in (one.replace(b"WARC/1.1", b"WARC/9"), one.replace(b"WARC-Date", b" WARC-Date"), one[:-5] + one[-4:], one.replace(b"\r\n\r\nx", b"\r\n\r\ny"), one.replace(b"WARC-Type: response\r\n", b"")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    rows = [(k, f"http://{k}", f"page {k % 5} " * 400) for k in range(90)] + [(None, None, None), (3, "http://again", "page 3 " * 400)]
    manifest = spark.createDataFrame(warc.write_archives(warc.with_revisits(pages(spark, rows)).repartition(4), str(tmp_path / "w")).collect(), warc.MANIFEST)
    for r in manifest.collect():
        with open(r.path, "rb") as f:
            assert struct.unpack("<I", f.read(4))[0] == warc.DICTIONARY_MAGIC
    assert warc.dealt(manifest).rdd.getNumPartitions() == 4
    got = warc.read_archives(warc.dealt(manifest)).collect()
    assert len(got) == 92 and sum(r.record_type == "response" for r in got) == 6
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(k, 85 + k % 5) for k in range(85)}


def test_url_rules_edges(spark):
    rows = [(None, "http://a.net/", "h"), (1, None, "h"), (1, "", "h"), (2, "x" * 100_000 + "://Sub.EXAMPLE.com/de/" + "y" * 100_000, "h"), (2, "http://", "h")]
    got = sorted(((r.page_id, r.host, r.rule, r.verdict) for r in url_filter.judge_urls(pages(spark, rows), url_filter.rule_table(spark)).collect()), key=str)
    assert got == sorted([(None, "a.net", "net/", "block"), (1, "", None, "allow"), (1, "", None, "allow"), (2, "sub.example.com", "example.com/de/", "block"), (2, "", None, "allow")], key=str)


def sketch_of(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(fingerprints.bottom_k(fingerprints.shingle_hashes(F.col("t"))).alias("s")).first().s


def test_fingerprints_equal_brute_force_and_merge(spark):
    rows = [(k, words_of(k // 3, 90) + f" end {k}", "a") for k in range(30)] + [(None, words_of(99 + k), "a") for k in range(9)]
    got = {r.doc_id: r for r in fingerprints.compared_to_edits(documents(spark, rows)).where("doc_id is not null").collect()}
    texts = {i: t for i, t, _ in rows if i is not None}
    for i in range(29):
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (texts[i].split(), texts[i + 1].split()))
        assert abs(got[i].near_next - len(a & b) / len(a | b)) < 0.25
        n = len(texts[i])
        assert got[i].edited_sha256 == hashlib.sha256((texts[i][: n - n // 4] + texts[i + 1][: n // 4]).encode()).hexdigest()
    parts = fingerprints.fingerprinted(documents(spark, rows[:6])).withColumn("all", F.lit(1))
    whole = fingerprints.corpus_fingerprint(parts, ["all"]).first().sketch
    assert whole == sorted({h for _, t, _ in rows[:6] for h in sketch_of(spark, t)})[: fingerprints.K]


def test_neighbours_of_a_hot_id_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", 1)
    rows = [(None, f"text {k}", "a") for k in range(300)] + [(k, f"doc {k}", "a") for k in range(0, 900, 3)]
    got = fingerprints.compared_to_edits(documents(spark, rows)).collect()
    assert len(got) == 600
    texts = {i: t for i, t, _ in rows if i is not None}
    for r in got:
        if r.doc_id is not None and r.doc_id < 897:
            n = len(texts[r.doc_id])
            assert r.edited_sha256 == hashlib.sha256((texts[r.doc_id][: n - n // 4] + texts[r.doc_id + 3][: n // 4]).encode()).hexdigest()


def test_quality_rules_equal_plain_counts_and_remove_lines(spark):
    body = "This line of running text has ten words and ends."
    text = "\n".join([body, "HOME | NEWS | ABOUT | MORE", body, "click here to go on", "a line of running text that just stops somewhere", "Kurz.", body.replace("ten", "many")])
    r = quality_rules.apply_rules(documents(spark, [(1, text, "a")])).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(text.split()), sum(map(len, text.split())), text.count("|"), 1)
    assert r.n_bad_lines == 3
    kept = quality_rules.clean_documents(documents(spark, [(1, text, "a"), (2, "too short.", "a"), (None, None, "a")])).collect()
    want = [] if r.base_failed else [(1, "\n".join([body, body, "Kurz.", body.replace("ten", "many")]))]
    assert [(x.doc_id, x.text) for x in kept] == want


def test_expectation_maximisation_recovers_known_rates():
    rng = np.random.default_rng(3)
    n, m = 20_000, len(quality_classifier.LABELLERS)
    good = rng.random(n) < 0.8
    truth = np.where(good[:, None], 0.01, 0.6)
    votes = np.where(rng.random((n, m)) < truth, quality_classifier.BAD, quality_classifier.GOOD)
    patterns, counts = np.unique((votes * 3 ** np.arange(m)).sum(axis=1), return_counts=True)
    share, rates, posterior = quality_classifier.fit_labellers(patterns.tolist(), counts.tolist())
    assert share == pytest.approx(0.8, abs=0.02)
    assert rates[1][:, quality_classifier.BAD] == pytest.approx(np.full(m, 0.01), abs=0.005)
    assert (rates[0][:, quality_classifier.BAD] > 0.35).all()
    assert np.allclose(rates.sum(axis=2), 1)
    w = quality_classifier.fit_scorer([np.array([1]), np.array([2])] * 50, [np.array([1.0]), np.array([1.0])] * 50, np.array([1.0, 0.0] * 50))
    assert w[1] > 0 > w[2]


def test_piece_scores_are_log_probabilities(spark):
    pieces = sentencepiece.load_pieces(spark)
    scores = np.array([s for _, s, kind in pieces if kind == sentencepiece.NORMAL])
    assert np.exp(scores).sum() == pytest.approx(1) and (scores < 0).all()
    texts = ["international house of words", "  two  spaces", "▁ mark", "日本"]
    encoded = sentencepiece.encode_documents(documents(spark, [(k, t, "a") for k, t in enumerate(texts)]), pieces)
    got = {r.doc_id: r.text for r in sentencepiece.decode_documents(encoded, pieces).collect()}
    assert got == dict(enumerate(texts))
    names = [pieces[i][0] for i in encoded.where("doc_id = 0").first().ids]
    assert "▁international" in names and "▁house" in names
    with pytest.raises(ValueError):
        sentencepiece.parse_model(b"\x12\x02\x18\x03")


def test_contexts_are_counted_at_any_number(spark):
    for n in (10, 200, 5_000, 200_000):
        bits = 0
        for k in range(n):
            bits |= toxicity.context_place(f"b{k}", f"a{k}")
        used = [(bits >> k * toxicity.PLACES & ((1 << toxicity.PLACES) - 1)).bit_count() for k in range(toxicity.RATES)]
        got = spark.range(1).select(toxicity.contexts_column([F.lit(u) for u in used]).alias("n")).first().n
        assert 0.6 * n < got < 1.6 * n


def test_pipeline_equals_a_chain_of_its_parts(spark, tmp_path):
    """Each stage's rows against plain Python over what the operators say row by row."""
    rng = random.Random(5)
    rows = [(k, words_of(k), rng.choice("abc")) for k in range(80)]
    rows += [(200 + k, words_of(k) + " tail", "a") for k in range(10)] + [(300 + k, words_of(k) + f" snarlmuck {words_of(k, 5)} grimvile", "b") for k in range(40)]
    rows += [(None, words_of(500), "a"), (None, words_of(500), "a"), (7, words_of(501), None), (400, "", "a"), (401, None, "b"), (402, "### $$$ %%% !!! ### $$$ ### @@@", "c")]
    frame = documents(spark, rows).drop("node", "n", "keys").withColumn("n_chars", F.length("text").cast("long"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(300 <= i < 340)) for i, _, _ in rows if i is not None], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = quality_classifier.scored(docs, docs.columns)
    texts = [(r.doc_id, r.text, r.source) for r in kept.where("kept__").collect()]
    assert not {400, 401, 402} & {i for i, _, _ in texts} and len(texts) == len(rows) - 3
    left = [r for r in texts if "snarlmuck" not in r[1]]
    groups = {}
    for i, t, s in left:
        groups.setdefault(t.removesuffix(" tail"), []).append((i is None, i or 0, t, s))
    one = [min(g) for g in groups.values()]
    assert len(one) == 82
    plan = mixture.mixed(spark.createDataFrame([(None if no else i, t, s) for no, i, t, s in one], "doc_id bigint, text string, source string")).collect()
    before = set(common.written())
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns[-2:] == ["mix_position", "mix_copy"]
    found = sorted((str(r.doc_id), r.mix_position) for r in got.collect())
    assert found == sorted((str(r.doc_id), p) for r in plan for p in (r.position, r.repeat_position) if p is not None)
    assert got.where("not round_trip").count() == 0
    assert len(set(common.written()) - before) <= 3  # the rest is deleted on the way
    empty = str(tmp_path / "none")
    frame.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_components_of_clashing_names_and_edges(spark):
    got = sorted(map(tuple, jaccard_join.jaccard_components(documents(spark, EDGES)).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (None, 1, None), (None, 1, None), (5, 1, 5)], key=str)
