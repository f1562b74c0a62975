"""BPE encoding and decoding, collocations and the conversation trie against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import bpe, collocations, html_text, language_id, licenses, prefix_trie, queries, shared
from tests.conftest import SF001, SF01

SF1 = "/root/testdata/sf0.1"

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- shared ------------------------------------------------------------------------------------------------------------
def test_prefix_sums_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(shared, "BLOCK", 4)
    df = spark.range(100).select("id", (F.col("id") * 7 % 11).alias("v"), (F.col("id") % 2).alias("g"))
    got = shared.prefix_sums(df, "id", {"s": F.col("v")}, 100).orderBy("id").collect()
    assert [r["s"] for r in got] == np.cumsum([i * 7 % 11 for i in range(100)]).tolist()
    keyed = df.select("g", F.floor(F.col("id") / 2).alias("p"), "v")
    got = shared.prefix_sums(keyed, "p", {"s": F.col("v")}, 50, ("g",)).collect()
    assert {(r["g"], r["p"]): r["s"] for r in got} == {
        (g, p): sum((2 * q + g) * 7 % 11 for q in range(p + 1)) for g in (0, 1) for p in range(50)}


# -- 2 -----------------------------------------------------------------------------------------------------------------
#: Three languages that are not learned.
OTHERS = {
    "it": "il governo ha annunciato ieri che le nuove misure per la scuola saranno presentate nel corso della prossima settimana "
          "e che i genitori potranno scegliere tra diverse soluzioni per i loro figli mentre la città continua a crescere ",
    "pt": "o governo anunciou ontem que as novas medidas para a escola serão apresentadas na próxima semana e que os pais "
          "poderão escolher entre várias soluções para os seus filhos enquanto a cidade continua a crescer muito ",
    "nl": "de regering heeft gisteren aangekondigd dat de nieuwe maatregelen voor de school volgende week worden gepresenteerd "
          "en dat de ouders kunnen kiezen tussen verschillende oplossingen voor hun kinderen terwijl de stad blijft groeien "}


@pytest.mark.parametrize("sf", [SF01, SF1])
def test_language_rejection(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = queries.fitted_language_model(docs)
    random.seed(2)
    noise = [" ".join("".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(2, 9))) for _ in range(n))
             for n in (60, 100, 200, 500, 1000) for _ in range(20)]
    strange = noise + [text * n for text in OTHERS.values() for n in (2, 5, 40)]
    assert all(language_id.predict_texts(model, strange)[2])
    rows = docs.where("lang IS NOT NULL").select("text").collect()
    letters = [r["text"] for r in rows if re.search(r"[^\W\d_]", r["text"] or "")]
    rejected = language_id.predict_texts(model, letters)[2]
    assert sum(rejected) <= 0.001 * len(letters)


def test_wrong_labels_hardly_move_the_bound(spark):
    random.seed(4)

    def text(letters):
        return " ".join("".join(random.choices(letters, k=5)) for _ in range(120))
    rows = [(text("abcdefgh"), "x") for _ in range(400)] + [(text("stuvwxyz"), "y") for _ in range(400)]
    clean = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    mixed = language_id.fit(spark.createDataFrame(rows + [(text("0123 éèàù"), "x") for _ in range(2)], "text string, lang string"))
    assert mixed.reach[0, 5] > 0.8 * clean.reach[0, 5]


# -- 7 -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("page,text", [
    ('<article class="post no-comments"><p>Body text</p></article>', "Body text"),
    ('<div class="search-page"><p>Found</p><article><p>Body</p></article><p>Below</p></div>', "Body"),
    ('<div class="has-sidebar page"><article><p>Body</p></article><div class="sidebar">S</div></div>', "Body"),
    ('<header>Site</header><article><header><h1 class="page-header">Title</h1></header><p>Body</p></article>', "Title\n\nBody"),
    ('<main><p>A</p></main><div class="story"><p>Real</p></div>', "A\n\nReal"),
    ('<article><p>Body</p></article><section id="comments"><article><p>Reader</p></article></section>', "Body"),
    ('<article><p>Body</p><article class="comment"><p>Reader</p></article></article>', "Body"),
    ('<div class="related-posts"><article><p>Other</p></article></div><p>Own</p>', "Own"),
])
def test_main_text_by_markup(page, text):
    assert html_text.main_text(html_text.lines_of(page), set())[0] == text


def html_brute(rows):
    """The method stated plainly over all pages of a host in order."""
    out, hosts = Counter(), defaultdict(list)
    for key, url, page in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        hosts[m[1].translate(LOWER) if m else ""].append((m[2] if m else "", key is not None, key or 0, url, page))
    for pages in hosts.values():
        pages.sort(key=lambda p: p[:3])
        pages = [p for i, p in enumerate(pages) if not i or p != pages[i - 1]]  # equal rows are one page
        lines = [html_text.lines_of(p[4] or "") for p in pages]

        def shared(i, j, lines=lines):
            mine = html_text.shared_lines([x[0] for x in lines[i]], [x[0] for x in lines[j]])[0]
            return None if html_text.mirrors(lines[i], lines[j], mine) else mine
        for i, p in enumerate(pages):
            found = shared(i, i + 1) if i + 1 < len(pages) else None
            back = i - 1
            while found is None and back >= 0:
                both = html_text.shared_lines([x[0] for x in lines[back]], [x[0] for x in lines[back + 1]])[0]
                if not html_text.mirrors(lines[back], lines[back + 1], both):
                    found = html_text.shared_lines([x[0] for x in lines[back]], [x[0] for x in lines[i]])[1]
                back -= 1
            text = html_text.main_text(lines[i], found or set())[0]
            out[p[2] if p[1] else None, p[3], text] += sum((k, u, h) == (p[2] if p[1] else None, p[3], p[4]) for k, u, h in rows)
    return out


def test_mirrors_and_repeated_rows_keep_their_text(spark):
    page = "<body><div>Site title</div><div>{}</div><p>Call us</p></body>"
    story = "A long story that two addresses show, with more words than the frame around it has. " * 3
    rows = [(1, "http://a.example/1", page.format(story)), (2, "http://a.example/1?p=2", page.format(story))]
    rows += [(3, "http://b.example/x", page.format(story))] * 3000
    rows += [(10 + i, f"http://c.example/{i:02}", page.format(f"{story} {i} {story}" if i % 3 else story)) for i in range(12)]
    rows += [(100 + i, f"http://d.example/{i:02}", page.format(f"{i} " * 30 + story[:40 * i])) for i in range(9)] + [(None, None, None), (7, None, "")]
    random.seed(7)
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = Counter((r["page_id"], r["url"], r["text"]) for r in html_text.extract(df, 1).collect())
    assert got == html_brute(rows)
    many = Counter((r["page_id"], r["url"], r["text"]) for r in html_text.extract(df, 5).collect())
    assert sum(many.values()) == len(rows)
    for (key, _, text), n in (many | got).items():
        if key in (1, 2, 3):
            assert story.strip() in text
    assert html_text.extract(df.select(F.col("page_id").cast("short").alias("page_id"), "url", "html"), 2).count() == len(rows)


# -- 10 ----------------------------------------------------------------------------------------------------------------
def test_templates_that_begin_others_and_single_words():
    short = "licensed under the apache license version 2 0"
    long = short + " the license you may not use this file except in compliance with the license and its terms"
    a = licenses.build([("short", short), ("long", long)], {"mit": "mit", "apache license": "apache"})
    scan = licenses.scan_texts(a, [(short + " the license").encode(), long.encode(), b"x mit y", b"mit", short[:20].encode()])
    assert scan[0].scores[0] == 1.0 and scan[0].spans[0] == [(0, 8)] and 0.3 < scan[0].scores[1] < 0.75
    assert scan[1].scores == {0: 1.0, 1: 1.0}
    assert scan[2].places == [(1, 0)] and scan[3].places == [(0, 0)] and scan[4].scores == {}


def test_covered_share_against_brute_force():
    random.seed(10)
    for _ in range(60):
        template = [random.choice("abcdefgh") + random.choice("xyz") for _ in range(random.randint(6, 25))]
        a = licenses.build([("t", " ".join(template))], {"zz zz": "z"})
        first = random.randint(0, len(template) - 4)
        part = template[first:first + random.randint(4, len(template))]
        text = ["no"] * random.randint(0, 5) + part + ["no"] * random.randint(0, 5)
        got = licenses.scan_texts(a, [" ".join(text).encode()])[0].scores.get(0, 0.0)
        assert got >= len(part) / len(template) - 1e-9  # the copied run at least


# -- 11 ----------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BYTE_BPE)
    t.no_padding()
    t.no_truncation()
    return t


def bpe_expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_bpe_equals_the_library(spark, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_bpe(spark, SF01).collect()}
    docs = spark.read.parquet(f"{SF01}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        assert got[d["doc_id"]] == bpe_expected(library, d["text"])


def test_bpe_splits_as_the_library(library):
    split = bpe.Splitter(BYTE_BPE)
    random.seed(11)
    letters = [*map(chr, range(0x250)), *map(chr, range(0x2000, 0x2070)), "語", "é", "\U0001f600", "'s", "'ll", "  ", "᠎", "٣", "ⅷ"]
    for _ in range(20_000):
        text = "".join(random.choices(letters, k=random.randint(1, 8)))
        assert split(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_bpe_odd_rows_small_blocks_and_memo(spark, odd_docs, no_docs, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 300)
    monkeypatch.setattr(bpe, "PART_CHARS", 100)
    monkeypatch.setattr(bpe, "MEMO", 20)
    special = spark.createDataFrame([(20, "a <|endoftext|> b<|endoftext|><|endoftext|>c \n\n\n x  語語 \U0001f600'll ''s"),
                                     (21, "x" * 5000)], "doc_id long, text string")
    docs = odd_docs.unionByName(special, allowMissingColumns=True)
    got = Counter(map(tuple, bpe.encode_and_decode(docs, BYTE_BPE, 3).collect()))
    assert got == Counter((r["doc_id"], *bpe_expected(library, r["text"])) for r in docs.collect())
    assert bpe.encode_and_decode(no_docs, BYTE_BPE, 3).count() == 0


def test_bpe_decode_joins_ids_to_pieces(spark, library):
    texts = ["ein Text, übrigens", "", "<|endoftext|>\n語", None]
    rows = [(i, None if t is None else library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)]
    rows.append((9, library.encode("語").ids[:1]))  # a cut character
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), BYTE_BPE).collect()}
    assert got == {i: "" if ids is None else library.decode(ids, skip_special_tokens=False) for i, ids in rows}


def test_bpe_wants_a_byte_level_tokenizer(spark, odd_docs):
    with pytest.raises(ValueError, match="byte-level"):
        bpe.encode_and_decode(odd_docs, public_tokenizers.path("word_bpe_49k.json"), 3)


# -- 12 ----------------------------------------------------------------------------------------------------------------
def collocations_expected(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(5, len(w) - i) + 1):
                    f[lang][tuple(w[i:i + m])] += 1
    out = []
    for lang, count in f.items():
        wanted = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        gone = {p[i:i + m] for p, a in wanted.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
                if a >= count[p[i:i + m]]}
        found = []
        for p, a in wanted.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for i, r in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,top,budget", [(5, 2000, collocations.BUDGET), (5, 50, 200), (3, 2000, 40), (300, 10, 200)])
def test_collocations(spark, least, top, budget):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = sorted(map(tuple, collocations.collocations(docs, least, top, budget=budget).collect()))
    assert got == collocations_expected([(r["text"], r["lang"]) for r in docs.collect()], least, top)


def test_collocations_split_prefixes_and_full_counters(spark, monkeypatch):
    monkeypatch.setattr(collocations, "COUNTER_BITS", 8)  # hardly a pair is surely rare any more
    monkeypatch.setattr(collocations, "SLICE_BITS", 4)
    monkeypatch.setattr(collocations, "GROUP_BYTES", 500)
    random.seed(12)
    rows = [(" ".join(random.choice("ab") for _ in range(60)), random.choice(["en", None])) for _ in range(60)]
    rows += [("one hot line of many words, here\nagain A  b\tA!b", "en")] * 400
    got = sorted(map(tuple, collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), 5, 2000, budget=8).collect()))
    assert got == collocations_expected(rows, 5, 2000)


@pytest.mark.parametrize("most_bits", [27, 8])
def test_collocation_counters_follow_the_number_of_words(spark, monkeypatch, most_bits):
    monkeypatch.setattr(collocations, "COUNTER_BITS", 8)
    monkeypatch.setattr(collocations, "MOST_COUNTER_BITS", most_bits, raising=False)
    monkeypatch.setattr(collocations, "SLICE_BITS", 4)
    rows = [(" ".join(f"w{i}x{j}" for j in range(500)), "en") for i in range(40)]  # 20,000 pairs, each of them once
    rows += [("a phrase often seen", "en"), ("A phrase", None)] * 10
    sizes = {}

    def written(df, name):
        out = shared.written(df, name)
        sizes[name] = out.count()
        return out
    monkeypatch.setattr(collocations, "written", written)
    got = sorted(map(tuple, collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), 10, 2000).collect()))
    assert got == collocations_expected(rows, 10, 2000) and len(got) == 2
    # 2^8 counters all get to 10 and every pair's suffix is kept; the sized table leaves those of the four pairs
    assert sizes["phrase-suffixes"] > 15_000 if most_bits == 8 else sizes["phrase-suffixes"] < 100


def test_collocations_on_odd_rows(spark, odd_docs, no_docs):
    got = sorted(map(tuple, collocations.collocations(odd_docs, 2, 2000).collect()))
    assert got == collocations_expected([(r["text"], r["lang"]) for r in odd_docs.collect()], 2, 2000)
    assert collocations.collocations(no_docs, 2).count() == 0
    assert collocations.collocations(odd_docs.where("doc_id = 4"), 1).count() == 0


def test_collocation_products_may_pass_64_bits(spark):
    nodes = spark.createDataFrame([(1, 2, 0, 0, 0, 9 * 10**12)], "w1 long, w2 long, w3 long, w4 long, w5 long, f long")
    words = spark.createDataFrame([("en", 1, 9 * 10**12 + 1), ("en", 2, 9 * 10**12 + 7)], "lang string, w long, n long")
    totals = spark.createDataFrame([("en", 9999999999999)], "lang string, n long")
    r = collocations.score_cuts(nodes, nodes, words, totals).first()
    assert r["score"] == 1000 * 9 * 10**12 * 9999999999999 // ((9 * 10**12 + 1) * (9 * 10**12 + 7))


# -- 13 ----------------------------------------------------------------------------------------------------------------
def trie_expected(rows):
    conv = defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            conv[r["conv_id"]].append(((r["turn"] is not None, r["turn"] or 0), r["role"] or "", r["text"] or ""))
    own = {c: [t[1:] for t in sorted(v, key=lambda t: t[0])] for c, v in conv.items()}
    again = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        again[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + v[h:])
    members, kids, leaves, saved = defaultdict(list), defaultdict(set), Counter(), Counter()
    for c, v in again.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    sha(",".join(str(c) for c in sorted(m) if len(again[c]) == len(p)))) for p, m in members.items())


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_trie(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    assert Counter(map(tuple, queries.op13_prefix_trie(spark, sf).collect())) == trie_expected(turns)


def test_trie_odd_rows_hot_and_deep_conversations(spark, monkeypatch):
    for module in (shared, prefix_trie):
        monkeypatch.setattr(module, "BLOCK", 8)
    random.seed(13)
    rows = [(c, t, random.choice(["user", "assistant"]), random.choice("ab")) for c in range(100, 260) for t in range(random.randint(1, 4))]
    rows += [(300 + c, 0, "user", f"{c}") for c in range(90)]  # a wide node
    rows += [(7, t, "user", f"turn {t}") for t in range(300)] + [(8, t, "user", f"turn {t}") for t in range(290)]
    rows += [(400, 1, "user", "again")] * 50 + [(-250, 0, None, "é\U0001f600"), (-200, None, "user", None), (-200, 3, "user", "x")]
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None), (1234567, 0, "", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {c: F.lit("x") for c in ("id", "place", "h", "arc", "next", "n_turns", "_range")})
    assert Counter(map(tuple, prefix_trie.prefix_trie(df).collect())) == trie_expected(df.collect())
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


@pytest.mark.parametrize("n,blocks,run", [(1, 1, 1), (2, 2, 1), (500, 7, 1), (500, 7, 20), (300, 300, 1), (400, 1, 50)])
def test_list_rank(spark, n, blocks, run):
    random.seed(n + blocks)
    block = [b for _ in range(0, n, run) for b in [random.randrange(blocks)] * run][:n]  # runs of the list share a block
    random.shuffle(ids := list(range(n)))
    arcs = [(b << 34) + i for i, b in zip(ids, block, strict=True)]
    rows = [(a, b) for a, b in zip(arcs, [*arcs[1:], None], strict=True)]
    random.shuffle(rows)
    got = prefix_trie.list_rank(spark.createDataFrame(rows, "arc long, next long").repartition(3), n).collect()
    assert sorted((r["place"], r["arc"]) for r in got) == list(enumerate(arcs))


def test_turns_of_equal_number_have_one_order(spark):
    rows = [(1, 0, "user", x) for x in "abcabc"] + [(1, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    a, b = (prefix_trie.turns_in_order(d).orderBy("place").collect() for d in (df, df.repartition(5, "text")))
    assert a == b and [r["place"] for r in a] == list(range(7)) and a[0]["size"] == 0
