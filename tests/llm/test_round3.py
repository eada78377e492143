"""Decontamination, spelling variants and fill-in-middle against plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, fim, spelling
from tidemark.llm.common import Scratch

EXTRA = "doc_id bigint, text string, id string, tie string, n bigint, word string, pos string, form string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", 1, "x", "x", "x") for i, t in rows], EXTRA).repartition(3)


def nonsense(rng, n, size=60):
    return " ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, size))) + f" w{n}"


# --- 11


def item_words(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def hits_of(text, items):
    w, hit, found = item_words(text), set(), set()
    for item, t in items:
        v = item_words(t)
        k = min(len(v), decontamination.WINDOW)
        for s in range(len(v) - k + 1 if k else 0):
            for p in range(len(w) - k + 1):
                if w[p : p + k] == v[s : s + k]:
                    hit.update(range(p, p + k))
                    found |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(found)


def bench_case(rng):
    passages = [" ".join(rng.choice(["Alpha", "beta", "GAMMA", "delta", "é", "été", "7"]) for _ in range(rng.randint(11, 25))) for _ in range(6)]
    items = [(k, t) for k, t in enumerate(passages)] + [(10, passages[0]), (11, "beta"), (12, "Alpha beta gamma"), (13, ""), (14, None), (None, "zeta eta"), (2, passages[2]), (100, "..., !"), (15, "la la la la la la la la la la la la")]
    docs = [(k, nonsense(rng, k) + " " + (rng.choice(passages).upper() if k % 3 else passages[k % 6][5:]) + ", " + nonsense(rng, k)) for k in range(60)]
    docs += [(70, None), (71, ""), (72, "?!"), (73, "ALPHA-beta.Gamma alpha"), (73, "zeta ETA"), (73, "zeta ETA"), (None, passages[1]), (None, passages[1]), (None, None), (80, "la " * 30), (81, passages[3] * 400), (82, "ÉTÉ" + passages[4])]
    return docs, items


def test_op11_equals_a_search_by_hand(spark):
    docs, items = bench_case(random.Random(3))
    got = decontamination.decontaminated(documents(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    rows = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, *r["items"]) for r in got.collect())
    want = [(i, *hits_of(t, items)) for i, t in docs]
    assert rows == sorted((str(i), n, h, len(f), *f) for i, n, h, f in want)
    assert any(h == 0 for _, _, h, _ in want) and any(len(f) > 1 for _, _, _, f in want)


def test_op11_empty_tables(spark):
    docs, items = bench_case(random.Random(4))
    some, tests = documents(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")
    assert decontamination.decontaminated(some.limit(0), tests).count() == 0
    clean = decontamination.decontaminated(some, tests.limit(0))
    assert clean.count() == len(docs) and clean.where("n_hit > 0 or n_items > 0").count() == 0


def test_near_matches_equal_the_least_spans_around_the_rarest_word(spark):
    rng, slop = random.Random(5), 3
    docs = [(k, " ".join(rng.choice("abcd") for _ in range(60)) + " e " + " ".join(rng.choice("abcd") for _ in range(20))) for k in range(12)]
    items = [(0, "a b c d"), (1, "d e a"), (2, "a a b"), (3, "e"), (4, "a q b")]
    index = decontamination.postings(documents(spark, docs))
    found = decontamination.windows(spark.createDataFrame(items, "item_id bigint, text string"))
    ranked = decontamination.by_rarity(found, index)
    order = {r.wid: [(o.off, o.term) for o in r.order] for r in ranked.collect()}
    item = {r.wid: r.item_id for r in found.collect()}
    assert 4 not in {item[w] for w in order}  # a word that the index lacks
    keys = {(r.id, r.tie): r.doc_id for r in decontamination.keyed(documents(spark, docs), "doc_id", "text").collect()}
    got = sorted((keys[r.id, r.tie], item[r.wid], r.start, r.end) for r in decontamination.near_matches(ranked, index, slop).collect())
    want = set()
    for wid, ranks in order.items():
        v, at = item_words(items[item[wid]][1]), ranks[0][0]
        for i, t in docs:
            w = item_words(t)
            for p in (p for p, x in enumerate(w) if x == v[at]):
                low = high = p
                for x in v[at + 1 :]:
                    high = next((q for q in range(high + 1, len(w)) if w[q] == x), 10**6)
                for x in reversed(v[:at]):
                    low = next((q for q in range(low - 1, -1, -1) if w[q] == x), -(10**6))
                if high - low <= len(v) - 1 + slop:
                    want.add((i, item[wid], low, high + 1))
    assert got == sorted(want) and len(want) > 50
    exact = {(keys[r.id, r.tie], item[r.wid], r.start) for r in decontamination.phrase_matches(ranked, index, Scratch(spark)).collect()}
    assert exact <= {(i, t, s) for i, t, s, e in want if e - s == len(item_words(items[t][1]))} and exact


# --- 12


def variants_of(docs):
    counts = {}
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] = counts.get(w, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    by_gap = {}
    for w in words:
        for k in range(len(w)):
            by_gap.setdefault((w[:k], w[k + 1 :]), set()).add(w)
    form, near_n = {}, {}
    for w in words:
        shared = set().union(*(by_gap[w[:k], w[k + 1 :]] for k in range(len(w)))) | {v for k in range(len(w)) if (v := w[:k] + w[k + 1 :]) in words}
        shared |= {v for k in range(len(w) + 1) for v in by_gap.get((w[:k], w[k:]), ())}
        shared.discard(w)
        near_n[w] = len(shared)
        best = min(shared, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near_n[w], words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def spelled(rng):
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["Colour", "color", "colours", "ÀÉÎÕ×÷ü", "straße", "elephant", "elephants", "elehpant"]
    base += ["".join(p) + "ation" for p in ("aaa", "aab", "abb", "bbb", "aabb", "aa", "ab", "abab", "ba", "baa")]  # one ending
    base += [w[:k] + w[k + 1 :] for w in base[:30] for k in (0, 2, len(w) - 1)] + [w[:2] + "z" + w[2:] for w in base[:20]] + ["x" * 40, "x" * 41, "x" * 20 + "y" + "x" * 20]
    docs = []
    for k in range(60):
        words = [rng.choice(base) if rng.random() < 0.7 else rng.choice(base[:20]) for _ in range(60)]
        docs.append((k, " ".join(w.upper() if rng.random() < 0.1 else w for w in words) + "\n3.4 x1y"))
    return docs + [(None, "elephant colour" * 3), (None, None), (70, ""), (71, "...")] + [(72, "elephants Elephant elephant")] * 4


@pytest.mark.parametrize("heavy", [spelling.HEAVY, 2])
def test_op12_equals_all_pairs_by_hand(spark, monkeypatch, heavy):
    monkeypatch.setattr(spelling, "HEAVY", heavy)
    monkeypatch.setattr(spelling, "WORDS_PER_SHARD", 40)
    docs = spelled(random.Random(6))
    got = spelling.variants(spelling.word_counts(documents(spark, docs)))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants_of(docs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert any(w[1] and w[1] != w[2] for w in want) and max(w[4] for w in want) > 3


def test_op12_long_chains_and_empty_tables(spark):
    chain = ["abcde" + "f" * k for k in range(12)]
    counted = spark.createDataFrame([(w, 3 * 2**k) for k, w in enumerate(chain)], "word string, n bigint")
    got = {r.word: (r.form, r.root) for r in spelling.variants(counted).collect()}
    assert got == {w: (chain[k + 1] if k < 11 else None, chain[-1]) for k, w in enumerate(chain)}
    assert spelling.variants(spelling.word_counts(documents(spark, [(1, "a")]).limit(0))).count() == 0


def test_near_is_distance_one(spark):
    words = ["", "a", "b", "ab", "ba", "abc", "abd", "aab", "acb"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    assert all(spelling.near(a, b) == (distance(a, b) == 1) for a in words for b in words)


# --- 13


def middle_of(i, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest, n = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest(), len(units)
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text):
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = [None, "", "\n", "\n\n", "a", "a\n", "a\nb", "é\r\n日本 x\n\n𝒳\n", "<P>", "a <S> b\nc", "<", "<M", "<S\n<P\n<M\n>", "><P\n<<S\n", "tab\tnul\0\n end", "line\n" * 30_000]


def test_op13_equals_the_cuts_by_hand_and_goes_back(spark):
    docs = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, "\n".join(f"line {j} <{'PSM'[j % 3]}" for j in range(k))) for k in range(40)] + [(None, "x\ny\n"), (None, "x\ny\n"), (7, "other\n")]
    made = fim.transformed(documents(spark, docs)).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.collect())
    assert got == sorted((str(i), *middle_of(i, t), t or "") for i, t in docs)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.transformed(documents(spark, docs).limit(0)).count() == 0


def test_op13_settings(spark):
    docs = documents(spark, [(k, "a b c\nd e") for k in range(200)])
    half = fim.transformed(docs, rate=50, spm_share=0, seed=3, unit=r"\S+\s*", markers=("[P]", "[S]", "[M]"))
    forms = {r.form: r["count"] for r in half.groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 60 < forms["plain"] < 140
    assert half.where("n != 5").count() == 0
    assert half.where(fim.restored(F.col("output"), F.col("form"), ("[P]", "[S]", "[M]")) != "a b c\nd e").count() == 0


# --- stages of the pipeline


CLASHING = ["text__", "n_words__", "pattern__", "buckets__", "shares__", "weak__", "score__", "kept__", "row_one__", "row_two__", "row_nth__", "one", "two", "carried_0", "scanned"]


@pytest.mark.parametrize(("names", "written"), [(CLASHING, True), (CLASHING[:1], False)])
def test_stages_take_maps_and_clashing_names_and_need_no_write_between(spark, tmp_path, names, written):
    import corpus_pipeline

    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi") for b in ("lan", "mer", "not", "ris", "ten")]
    rows = [(k, " ".join(rng.choice(words) for _ in range(80)) + ".", rng.choice("ab"), {"k": k}, "t") for k in range(40)] + [(50, None, "a", None, None), (7, "", None, {}, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, more map<string, int>, clash string").withColumns({n: F.col("clash") for n in names}).drop("clash")
    docs.unionByName(docs.where("doc_id = 3")).write.parquet(f"{tmp_path}/documents.parquet")
    out = docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, out, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns
        if written:
            out.write.parquet(f"{tmp_path}/stage-{k}")
            out = spark.read.parquet(f"{tmp_path}/stage-{k}")
    got = out.collect()
    kept = {r.doc_id for r in got}
    assert kept <= set(range(40)) and len(kept) > 15 and all(r.more == {"k": r.doc_id} and r.text__ == "t" for r in got)
    last = corpus_pipeline.STAGES[4][1](spark, out, str(tmp_path))
    assert last.count() == len(got) and last.where("not round_trip").count() == 0
