"""Each operator against a brute-force version on whole small tables, and its defined results on odd rows."""

import hashlib
import html
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from cohortlens.llm import components, decontaminate, html_text, imatch, language_id, licenses, lm_score, mixing
from cohortlens.llm import queries, simhash, token_count, url_filter, words
from tests.conftest import SF001, SF01

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, name, sf=SF001):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def run(spark, name, sf=SF001):
    return queries.QUERIES[name](spark, sf).collect()


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def test_word_hashes_follow_the_pattern():
    random.seed(3)
    texts = ["".join(random.choice("aB9 é-ß\n語.") for _ in range(random.randint(0, 60))) for _ in range(300)]
    h, which, _, _ = words.cut([t.encode() for t in texts])
    seen, i = {}, 0
    for n, t in enumerate(texts):
        for w in words_of(t):
            assert which[i] == n
            assert seen.setdefault(w, h[i]) == h[i]
            i += 1
    assert i == len(h)
    assert len(set(seen.values())) == len(seen)


# -- 1 ---------------------------------------------------------------------------------------------------------------
def test_url_rules(spark):
    rules = queries.URL_RULES
    got = {r["page_id"]: r for r in run(spark, "op1_url_filter")}
    pages = table(spark, "pages")
    assert len(got) == len(pages)
    for p in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", p["url"] or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        r = max(fit, key=lambda r: len(r.text), default=None)
        assert (got[p["page_id"]]["host"], got[p["page_id"]]["path"]) == (host, path)
        assert got[p["page_id"]]["rule"] == (r.text if r else None)
        if r:
            assert got[p["page_id"]]["verdict"] == r.verdict


def test_url_reputation_shrinks_and_blocks(spark):
    rows = [(i, f"http://good{i % 3}.site.example/{i}") for i in range(90)]
    rows += [(100 + i, f"HTTP://BAD.site.example/{100 + i}") for i in range(40)] + [(200, "http://new.site.example"), (201, None),
                                                                          (202, "no scheme"), (200, "http://x.y/?://z")]
    from pyspark.sql import functions as F
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns(
        {c: F.lit("x") for c in ("host", "path", "key", "label_id", "good")})
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(140)] + [(None, 1)], "label_id long, good int")
    got = {(r["page_id"], r["host"]): r for r in url_filter.judge_urls(
        pages, labels, [], queries.page_label_id(F.col("path"))).collect()}
    assert got[5, "good2.site.example"]["verdict"] == "allow"
    assert got[100, "bad.site.example"]["verdict"] == "block"
    assert got[201, ""]["path"] == got[202, ""]["path"] == ""
    new = got[200, "new.site.example"]
    assert got[100, "bad.site.example"]["host_rate"] < new["host_rate"] < got[5, "good2.site.example"]["host_rate"]
    assert url_filter.judge_urls(pages.limit(0), labels, [], queries.page_label_id(F.col("path"))).count() == 0


# -- 2 ---------------------------------------------------------------------------------------------------------------
def test_language_id_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in run(spark, "op2_language_id", SF01)}
    docs = table(spark, "documents", SF01)
    assert len(got) == len(docs)
    held = [d for d in docs if got[d["doc_id"]]["held_out"] and d["lang"]]
    right = sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held)
    assert right / len(held) > 0.97
    assert sum(r["rejected"] for r in got.values()) == sum(not re.search(r"[^\W\d_]", d["text"] or "") for d in docs)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_rejects_other_scripts_and_odd_rows(spark, odd_docs, no_docs):
    model = queries.fitted_language_model(spark.read.parquet(f"{SF01}/documents.parquet"))
    lang, score, out = language_id.predict_texts(model, [None, "", "12 ***", "это совершенно другой язык " * 20])
    assert lang[:3] == ["und"] * 3 and score[:3] == [0.0] * 3 and out == [True] * 4
    got = language_id.predict(odd_docs, model)
    assert got.count() == 12
    assert got.select("row.*").columns == odd_docs.columns
    assert language_id.predict(no_docs, model).count() == 0
    empty = language_id.fit(no_docs.select("text", "lang"))
    assert language_id.predict_texts(empty, ["a text"])[0] == ["und"]


def test_language_sample_does_not_depend_on_copies(spark):
    random.seed(5)

    def texts(letters, n):
        return [" ".join("".join(random.choices(letters, k=5)) for _ in range(30)) for _ in range(n)]

    few, others = texts("abcdef", 30), texts("stuvwxyz", 40)
    rows = [(t, "few") for t in few] + [(t, "other") for t in others]
    plain = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    copied = language_id.fit(spark.createDataFrame(rows + [(few[0], "few")] * 20_000, "text string, lang string"))
    assert copied.langs == plain.langs == ["few", "other"]
    assert np.array_equal(copied.centroids, plain.centroids) and np.array_equal(copied.reach, plain.reach)
    assert language_id.predict_texts(copied, few)[0] == ["few"] * 30


def test_long_text_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Über den Wolken " * 500
    whole = language_id.gram_counts(text)
    monkeypatch.setattr(language_id, "PIECE", 97)
    assert np.array_equal(whole, language_id.gram_counts(text))


# -- 3 ---------------------------------------------------------------------------------------------------------------
def brute_fingerprint(text, k=4):
    w = SPACED.findall((text or "").translate(LOWER))
    sh = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, bits=4):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= bits:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {f: find(f) for f in parent}


def test_simhash_against_brute_force(spark):
    docs = table(spark, "documents")
    fps = {d["doc_id"]: brute_fingerprint(d["text"]) for d in docs}
    root = brute_components(set(fps.values()))
    low = {}
    for i, f in fps.items():
        low[root[f]] = min(i, low.get(root[f], i))
    got = run(spark, "op3_simhash_near_dedup")
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == \
        sorted((i, f"{f:016x}", low[root[f]]) for i, f in fps.items())


@pytest.mark.parametrize("bits,block", [(1, 2048), (4, 2048), (4, 7), (6, 16)])
def test_links_are_complete_also_in_hot_groups(spark, bits, block):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (1 << 64) - 1 for b in base for _ in range(12)}
    fps |= {base[0] ^ (1 << i) ^ (1 << j) for i in range(0, 64, 2) for j in range(1, 64, 7)}  # one dense ball
    want = brute_components(fps, bits)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.link_fingerprints(spark.createDataFrame(signed, "fp long"), bits, block)
    roots = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    groups = {}
    for f in fps:
        s = f - (1 << 64) if f >> 63 else f
        groups.setdefault(roots.get(s, s), set()).add(want[f])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500)], "a long, b long")
    assert {tuple(r) for r in components.connected_components(links).collect()} == {(i, 0) for i in range(201)}


def test_simhash_odd_rows(odd_docs, no_docs):
    got = simhash.simhash_components(odd_docs).collect()
    assert len(got) == 12
    own = Counter((r["doc_id"], r["component_id"]) for r in got)
    assert own[1, 1] == 1 and own[2, 1] == 2 and own[3, 3] == own[4, 3] == own[7, 3] == 1 and own[None, 3] == 1
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    # 1, 3 (for all without words), the text without an id, 5, 6, 8, 9
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, None, 5, 6, 8, 9])
    assert simhash.keep_one(no_docs).count() == 0


# -- 4 ---------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_counts_equal_the_library(name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    t = token_count.load(path)
    rng = random.Random(5)
    alphabet = [*"abcABC '!?<|>.,0123é ñ\n\t́̇İ \x0b\x1c\x85ßΣ한글가가", "<|endoftext|>", "'re",
                "'s ", "the ", "<|startoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(1500)] + [None, ""]
    want = [len(t.encode(x or "", add_special_tokens=False)) for x in texts]
    assert token_count.count_tokens(texts, path, 10_000, 16, {}) == want
    assert token_count.count_tokens(texts, path, 40, 8, {}) == want


def test_token_counts_without_any_stable_boundary():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "a" * 3000
    assert token_count.count_tokens([text], path, 100, 10, {}) == \
        [len(token_count.load(path).encode(text, add_special_tokens=False))]


def test_token_counts_query(spark, odd_docs, no_docs):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    t = token_count.load(path)
    got = {r["doc_id"]: r for r in run(spark, "op4_token_counts")}
    for d in table(spark, "documents"):
        n = len(t.encode(d["text"] or "", add_special_tokens=False))
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((d["text"] or "").encode()), n, n > 2048)
    odd = token_count.token_counts(odd_docs, path, chunk=500, overlap=20).collect()
    assert len(odd) == 12
    long = next(d["text"] for d in odd_docs.collect() if d["doc_id"] == 5)
    assert {r["n_tokens"] for r in odd if r["doc_id"] == 5} == {len(t.encode(long, add_special_tokens=False))}
    assert {r["n_tokens"] for r in odd if r["doc_id"] == 4} == {0}
    assert token_count.token_counts(no_docs, path).count() == 0


# -- 5 ---------------------------------------------------------------------------------------------------------------
def test_imatch_edits_and_likeness(spark):
    docs = sorted(table(spark, "documents", SF01), key=lambda d: d["doc_id"])
    got = {r["doc_id"]: r for r in run(spark, "op5_imatch", SF01)}
    assert len(got) == len(docs)
    by_text = {}
    for i, d in enumerate(docs):
        own, following = d["text"] or "", docs[(i + 1) % len(docs)]["text"] or ""
        half = len(own) // 2
        edited = own[:len(own) - half] + following[:half]
        r = got[d["doc_id"]]
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(own, r["fingerprint"]) == r["fingerprint"]
        following_fp = got[docs[(i + 1) % len(docs)]["doc_id"]]["fingerprint"]
        mine, other, cut_ = map(imatch.as_signature, (r["fingerprint"], following_fp, r["edited_fingerprint"]))
        assert (r["near_next"], r["near_edited"]) == (imatch.likeness(mine, other), imatch.likeness(mine, cut_))
    edited = [r["near_edited"] for r in got.values() if r["n_chars"] > 400]
    following = [r["near_next"] for r in got.values() if r["n_chars"] > 400]
    assert np.mean(edited) > np.mean(following) + 0.15


def test_imatch_lexicon_band(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    df = Counter(w for d in docs.collect() for w in set(words_of(d["text"])))
    n = docs.count()
    want = [w for w, k in df.items() if 0.02 * n <= k <= 0.15 * n]
    got = imatch.band_lexicon(docs, least_share=0.02)
    assert np.array_equal(got, np.sort(words.word_hashes(want)))


def test_imatch_odd_rows(odd_docs, no_docs):
    lexicon = imatch.band_lexicon(odd_docs)
    got = imatch.fingerprint_edits(odd_docs, lexicon, 3).collect()
    assert len(got) == 12
    fps = {r["fingerprint"] for r in got if r["doc_id"] in (1, 2)}
    assert len(fps) == 1
    assert {r["n_chars"] for r in got if r["doc_id"] in (3, 4)} == {0}
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert imatch.fingerprint_edits(no_docs, lexicon, 3).count() == 0


def test_imatch_equal_keys_and_rows_are_spread(spark):
    from pyspark.sql import functions as F
    random.seed(6)

    def some():
        return " ".join(random.choice("abcdefghijklmnop") * 3 + str(random.randint(0, 40)) for _ in range(20))

    rows = [(i, some()) for i in range(300)] + [(None, some()) for _ in range(300)] + [(7, None), (7, "")] * 2
    rows += [(5, some())] * 3 + [(None, "one text " * 9)] * 4000
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    lexicon = imatch.band_lexicon(docs)
    found = imatch.fingerprint_edits(docs, lexicon, 8)
    got = found.collect()
    ordered = sorted(((k is not None, k or 0, t or "") for k, t in rows),
                     key=lambda r: (*r[:2], r[2][:64], xxhash.xxh64_intdigest(r[2].encode(), 42)))
    want = Counter()
    for (given, k, own), (_, _, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        a, b, c = (imatch.signature(t, lexicon) for t in imatch._terms(
            [x.encode() for x in (own, imatch.edited_text(own, following), following)]))
        want[k if given else None, len(own), hashlib.sha256(imatch.edited_text(own, following).encode()).hexdigest(),
             imatch.as_text(a), imatch.as_text(b), imatch.likeness(a, b), imatch.likeness(a, c)] += 1
    assert Counter(map(tuple, got)) == want
    for part in (found.where("doc_id IS NULL AND n_chars <> 81"), found.where("n_chars = 81")):
        by_task = [r["count"] for r in part.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(by_task) < 0.75 * sum(by_task)


# -- 6 ---------------------------------------------------------------------------------------------------------------
def brute_hits(text, items, window=10):
    w = words_of(text)
    hit, found = set(), set()
    for item, own in items:
        n = min(window, len(own))
        wins = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(w) - n + 1) if wins else ():
            if tuple(w[i:i + n]) in wins:
                hit.update(range(i, i + n))
                found.update([str(item)] if item is not None else [])  # an item without an id is not listed
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_against_brute_force(spark):
    items = [(b["item_id"], words_of(b["text"])) for b in table(spark, "benchmark", SF01)]
    got = {r["doc_id"]: r for r in run(spark, "op6_decontaminate", SF01)}
    docs = table(spark, "documents", SF01)
    for d in docs:
        r = got[d["doc_id"]]
        want = brute_hits(d["text"], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == want
        assert r["contaminated"] == (want[1] > 0)
    assert any(r["contaminated"] for r in got.values())


@pytest.mark.parametrize("shard", [1_000_000, 23])
def test_decontamination_on_few_words(spark, odd_docs, no_docs, monkeypatch, shard):
    rng = random.Random(shard)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 120))) for _ in range(40)] + [None, ""]
    items = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 3, 9, 10, 11, 30)] + [None]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, "a b c a b c")], "item_id long, text string")
    blocks = decontaminate.load_items(bench)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    n_words, spans, found = decontaminate.hits([(t or "").encode() for t in texts], blocks)
    plain = [(i, words_of(t)) for i, t in enumerate(items)] + [(None, words_of("a b c a b c"))]
    for t, n, s, f in zip(texts, n_words, spans, found, strict=True):
        got = (n, sum(b - a for a, b in s), len(f), hashlib.sha256(",".join(sorted(map(str, f))).encode()).hexdigest())
        assert got == brute_hits(t, plain)
    res = decontaminate.contamination(odd_docs, bench.where("item_id > 3"))
    assert res.count() == 12 and res.select("row.*").columns == odd_docs.columns
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert decontaminate.contamination(odd_docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_longest_matches(spark):
    item = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(["x", *item[5:30], "y", *item[0:12]])), (2, "w1 w2 w3")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {tuple(r) for r in decontaminate.longest_matches(docs, bench).collect()}
    assert got == {(1, "7", 5, 1, 25), (1, "7", 0, 27, 12)}
    unnamed = bench.selectExpr("CAST(NULL AS BIGINT) AS item_id", "text")
    assert {r["item_id"] for r in decontaminate.longest_matches(docs, bench.union(unnamed)).collect()} == {"7", None}
    _, longest = decontaminate.search(np.append(words.word_hashes(item[5:30]), np.uint64(0)), decontaminate.load_items(bench)[0])
    assert longest.tolist() == [0] * 5 + list(range(25, 0, -1)) + [0] * 10


def test_longest_matches_go_over_shard_edges(spark, monkeypatch):
    item = [f"w{i}" for i in range(100)]
    text = " ".join([*(f"x{i}" for i in range(50)), *item, *(f"y{i}" for i in range(150))])
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(decontaminate)  # so that the workers get the small shards
    try:
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", 100)
        got = [tuple(r) for r in decontaminate.longest_matches(docs, bench).collect()]
    finally:
        cloudpickle.unregister_pickle_by_value(decontaminate)
    assert got == [(1, "7", 0, 50, 100)]


def test_a_benchmark_beyond_the_bound_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 1)
    bench = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    with pytest.raises(ValueError, match="in parts"):
        decontaminate.load_items(bench)


def test_suffix_array_order():
    rng = np.random.default_rng(0)
    rank = np.append(rng.integers(1, 3, 400), 0)
    order = decontaminate.suffix_array(rank, 500)
    assert order.tolist() == sorted(range(401), key=lambda i: rank[i:].tolist())


# -- 7 ---------------------------------------------------------------------------------------------------------------
def test_main_text_of_generated_pages(spark):
    got = {r["page_id"]: r for r in run(spark, "op7_html_extract")}
    pages = table(spark, "pages")
    assert len(got) == len(pages)
    for p in pages:
        body = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", p["html"])[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " " if False else "", x)).split())
                  for x in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
        assert got[p["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])


def test_lines_without_main_text():
    page = """<head><title>T</title></head><body class="no-sidebar"><header>H</header><div class="cookie-notice">C</div>
    <main><h1>One &amp; two&nbsp;&lt;b&gt;</h1><p>First <b>bold</b>,<br>second<p>Third<aside>A</aside>
    <form><label>Name</label><button>Go</button></form><p data-x="a>b">Fourth</p><ul><li>x<li>y</ul>
    <section id="comments"><article><p>Reader</p></article></section></main><footer>F"""
    assert html_text.main_text(html_text.lines_of(page), set())[0].split("\n\n") == \
        ["One & two <b>", "First bold, second", "Third", "Fourth", "x", "y"]
    assert html_text.lines_of("") == [] and html_text.lines_of("plain <") == [("plain <", False, False)]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        x, y = html_text.shared_lines(a, b)
        assert len(x) == len(y) == t[-1][-1]
        assert [a[i] for i in sorted(x)] == [b[j] for j in sorted(y)]


def test_differencing_without_article(spark):
    page = "<body><div>Site title</div><div>{}</div><p>Call us</p></body>"
    rows = [(i, f"http://h{i % 2}.example/a/{i:03}", page.format(f"Own text {i}")) for i in range(40)]
    rows += [(50, "http://alone.example/", page.format("Only")), (51, None, None), (52, "", ""), (53, "http://h0.example/a/000", rows[0][2])]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("x") for c in ("host", "path", "key", "data", "text", "_range")})
    for ranges in (1, 7):
        got = {r["page_id"]: r for r in html_text.extract(df, ranges).collect()}
        assert len(got) == len(rows)
        assert all(got[i]["text"] == f"Own text {i}" for i in range(2, 40))
        assert got[50]["text"] == "Site title\n\nOnly\n\nCall us"
        assert got[51]["text"] == got[52]["text"] == ""
    assert html_text.extract(df.limit(0), 3).count() == 0


# -- 8 ---------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores_against_brute_force(spark, order):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(d["doc_id"], words_of(d["text"])) for d in docs.collect()]
    grams = [Counter(tuple(w[i:i + n]) for _, w in rows for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total = sum(len(w) for _, w in rows)
    got = {r["doc_id"]: r for r in lm_score.lm_scores(docs, 5, order).collect()}
    for k, w in rows:
        mine = [Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
        rest = lambda g: grams[len(g) - 1][g] - mine[len(g) - 1][g]  # noqa: E731, B023
        score, backed = 0.0, 0
        for i in range(len(w)):
            first = min(i, order - 1)
            for n in range(first, -1, -1):
                g = tuple(w[i - n:i + 1])
                if rest(g) > 0:
                    score += (first - n) * math.log(0.4) + math.log(rest(g)) - math.log(
                        rest(g[:-1]) if n else max(total - len(w), 1))
                    break
            else:
                n = -1
                score += (first + 1) * math.log(0.4) - math.log(max(total - len(w), 1))
            backed += n < first
        assert got[k]["n_words"] == len(w) and got[k]["n_backoff"] == backed
        assert got[k]["score"] == pytest.approx(score / max(len(w), 1), abs=1e-9)


def test_lm_odd_rows(odd_docs, no_docs):
    got = lm_score.lm_scores(odd_docs, 3).collect()
    assert len(got) == 12
    assert {(r["n_words"], r["score"]) for r in got if r["doc_id"] in (3, 4)} == {(0, 0.0)}
    assert lm_score.lm_scores(no_docs, 3).count() == 0


def test_lm_equal_rows_are_few_of_a_block(spark):
    random.seed(7)
    distinct = [(i, " ".join(random.choices(["a", "b", "c", "d", "e"], k=12))) for i in range(20)]
    rows = distinct + [(None, "a b c a b zz")] * 3000 + [(3, distinct[3][1])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert lm_score.block_texts(docs, 3, "doc_id", "text").count() < 60
    grams = [Counter(), Counter()]
    for _, t in rows:
        w = t.split()
        grams[0].update(w)
        grams[1].update(zip(w, w[1:], strict=False))
    want, total = Counter(), sum(grams[0].values())
    for k, t in rows:
        w = t.split()
        rest = [{g: grams[0][g] - n for g, n in Counter(w).items()},
                {g: grams[1][g] - n for g, n in Counter(zip(w, w[1:], strict=False)).items()}]
        score = math.log(rest[0][w[0]] / (total - len(w)))
        backed = 0
        for a, b in zip(w, w[1:], strict=False):
            seen = rest[1][a, b] > 0
            score += math.log(rest[1][a, b] / rest[0][a]) if seen else math.log(0.4 * rest[0][b] / (total - len(w)))
            backed += not seen
        want[k, len(w), backed, round(score / len(w), 9)] += 1
    got = lm_score.lm_scores(docs, 3).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_backoff"], round(r["score"], 9)) for r in got) == want


# -- 9 ---------------------------------------------------------------------------------------------------------------
def test_targets():
    assert mixing.share_out([100, 100, 100], [5, 2, 1], 450, 2) == [200.0, pytest.approx(250 * 2 / 3), pytest.approx(250 / 3)]
    assert mixing.share_out([10, 1000], [5, 1], 1515, 2) == [20.0, 1495.0]
    assert mixing.share_out([], [], 0, 2) == [] and mixing.share_out([0, 4], [5, 2], 6, 2) == [0.0, 6.0]


def test_mix(spark):
    docs = table(spark, "documents", SF01)
    got = run(spark, "op9_mix", SF01)
    assert sorted(got) == sorted(run(spark, "op9_mix", SF01))
    size = {d["doc_id"]: len(SPACED.findall(d["text"] or "")) for d in docs}
    source = {d["doc_id"]: d["source"] for d in docs}
    assert {r["doc_id"]: r["size"] for r in got} == size
    names = sorted({s for s in source.values() if s is not None}) + [None] * (None in source.values())
    sizes = [sum(n for i, n in size.items() if source[i] == s) for s in names]
    want = mixing.share_out(sizes, [[5, 2, 1][i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2)
    taken = Counter()
    for r in got:
        i = names.index(source[r["doc_id"]])
        assert r["source_size"] == sizes[i] and r["target"] == pytest.approx(want[i])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[i] += r["taken"]
    assert all(abs(taken[i] - w) <= 0.02 * w for i, w in enumerate(want))


def test_schedule_is_low_discrepancy(spark):
    sources = [mixing.Source(str(i), 10**6, t, 1) for i, t in enumerate([5000.0, 2000.0, 1000.0])]
    rows = mixing.schedule(spark, sources, 2).orderBy("slot").collect()
    seen = Counter()
    for n, r in enumerate(rows, 1):
        assert r["rank"] == seen[r["src"]]
        seen[r["src"]] += 1
        assert all(abs(seen[i] - n * s.target / 8000) < 4 for i, s in enumerate(sources))


def test_mix_odd_rows(odd_docs, no_docs):
    got = mixing.mix(odd_docs, [5, 2, 1]).collect()
    assert len(got) == 12
    assert {r["source_size"] for r in got if r["source"] is None} == {60_000}
    assert {r["taken"] for r in got if r["size"] == 0} == {0}
    assert mixing.mix(no_docs, [1.0]).count() == 0


def test_mix_spreads_equal_keys_and_rows(spark, monkeypatch):
    rows = [(None, f"text {'x ' * (i % 7)}{i}", "a") for i in range(2000)] + [(1, "one two", "a")] * 2500 + [(None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter((k, len(SPACED.findall(t or ""))) for k, t, _ in rows)
    first, second = (mixing.mix(docs.repartition(n), [1.0]).collect() for n in (3, 7))
    assert sorted(map(repr, first)) == sorted(map(repr, second))
    assert Counter((r["doc_id"], r["size"]) for r in first) == sizes
    assert sum(r["taken"] for r in first) == pytest.approx(1.5 * sum(r["size"] for r in first), rel=0.02)
    monkeypatch.setattr(mixing, "mix_sized", lambda spark, sized, *_: sized)
    sized = mixing.mix(docs, [1.0])
    assert sized.select("h").distinct().count() == sized.count() == len(rows)


# -- 10 --------------------------------------------------------------------------------------------------------------
def test_license_base_against_brute_force(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in run(spark, "op10_license_scan", SF01)}
    for d in table(spark, "documents", SF01):
        w = words_of(d["text"])
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        r = got[d["doc_id"]]
        base = sorted({x for _, x in at})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(base))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(base) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    odd = {r["doc_id"]: r for r in licenses.license_scan(odd_docs).collect()}
    assert odd[9]["base_labels"] == "cc-by,mit" and odd[9]["labels"] == "cc-by,cc-by-nc,mit"
    assert licenses.license_scan(no_docs).count() == 0


def test_matching_statistics_find_template_spans():
    a = licenses.build()
    text = "x y " + licenses.TEMPLATES[0][1].replace("associated", "related") + " z"
    s = licenses.scan_texts(a, [text.encode()])[0]
    assert s.scores[0] > 0.95 and s.spans[0][0][0] == 2
    assert licenses.scan_texts(a, [b"apache license apache license cc by cc"])[0].places == [(0, 1), (2, 1), (4, 2)]
    # every substring of a template is accepted, and its first place is right
    words_ = licenses.TEMPLATES[2][1].split()
    for i, n in itertools.product(range(len(words_) - 4), (4, 5)):
        s = licenses.scan_texts(a, [" ".join(words_[i:i + n]).encode()])[0]
        assert s.scores[2] == pytest.approx(n / len(words_))


# -- pipeline --------------------------------------------------------------------------------------------------------
def test_pipeline_against_brute_force(spark):
    docs = table(spark, "documents")
    columns = spark.read.parquet(f"{SF001}/documents.parquet").columns
    items = [(b["item_id"], words_of(b["text"])) for b in table(spark, "benchmark")]
    keep = [d for d in docs if re.search(r"[^\W\d_]", d["text"] or "")]
    fps = {d["doc_id"]: brute_fingerprint(d["text"]) for d in keep}
    root, low = brute_components(set(fps.values())), {}
    for i, f in fps.items():
        low[root[f]] = min(i, low.get(root[f], i))
    keep = [d for d in keep if low[root[fps[d["doc_id"]]]] == d["doc_id"]]
    keep = [d for d in keep if brute_hits(d["text"], items)[1] == 0]
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, SF001)
        assert df.columns == columns
    assert sorted(r["doc_id"] for r in df.collect()) == sorted(d["doc_id"] for d in keep)
    final = corpus_pipeline.run(spark, SF001).collect()
    assert {r["doc_id"] for r in final} <= {d["doc_id"] for d in keep}
    total = sum(len(SPACED.findall(d["text"])) for d in keep)
    assert sum(r["taken"] for r in final) == pytest.approx(1.5 * total, rel=0.02)


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        df = docs
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF001)
            df.count()
