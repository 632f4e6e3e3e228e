"""Each operator against brute force, on the hard cases and on the given tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldreports.llm import fingerprints, gram_values, language_id, ngram_join, packing, quality_rules, queries, secret_scans, source_mix, substring_dedup, url_filters
from tests.conftest import SF_SMALL

from .cases import base_counts, base_spans, hard_documents, linked, near_groups, ordered, prose, swapped_words, without_repeats, words


@pytest.fixture(scope="module")
def given(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def test_every_query_gives_nothing_for_empty_tables(spark, empty_dir):
    for name, query in queries.QUERIES.items():
        assert query(spark, empty_dir).count() == 0, name


# ------------------------------------------------------------ fingerprints


def brute_winnow(points, k, w):
    h = fingerprints.gram_hashes(points, k).tolist()
    if not h:
        return []
    w = min(w, len(h))
    at = {max(j for j in range(i, i + w) if h[j] == min(h[i : i + w])) for i in range(len(h) - w + 1)}
    return [(h[j], j) for j in sorted(at)]


@pytest.mark.parametrize("text", ["", "a", "ab", "a" * 90, prose(1, 60), "abcab" * 30, "é\U0001f600ñ" * 20])
@pytest.mark.parametrize("k, w", [(16, 32), (3, 5), (4, 1), (5, 7)])
def test_winnowing_picks_the_rightmost_minimum(text, k, w):
    points = fingerprints.code_points(text)
    hashes, at = fingerprints.winnow(points, k, w)
    assert list(zip(hashes.tolist(), at.tolist())) == brute_winnow(points, k, w)


def test_grams_of_equal_characters_have_equal_hashes():
    h = fingerprints.gram_hashes(fingerprints.code_points("abcXabc"), 3)
    assert h[0] == h[4] and len(set(h.tolist())) == 4


def test_matches_of_the_guaranteed_length_share_a_hash():
    common = prose(3, 12)[:47]
    a, b = ("qq " + common + " zz", prose(4, 30) + common + prose(5, 30))
    one, two = (set(fingerprints.winnow(fingerprints.code_points(t))[0].tolist()) for t in (a, b))
    assert one & two


def check_neighbours(got, rows):
    key = lambda r: (r[0] is not None, r[0] if r[0] is not None else 0)
    order = sorted(rows, key=lambda r: r[1] or "")
    order.sort(key=key, reverse=True)
    # ids descending, texts of one id ascending
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r[1] or "")
    order = [(i, t) for i in sorted(groups, key=lambda i: (i is not None, i or 0), reverse=True) for t in sorted(groups[i])]
    expected = Counter()
    for n, (i, t) in enumerate(order):
        following, half = order[(n + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        f = lambda x: fingerprints.winnow(fingerprints.code_points(x))
        own, changed, other = f(t), f(edited), f(following)
        expected[
            i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.digest(*own), fingerprints.digest(*changed),
            fingerprints.likeness(own[0], changed[0]), fingerprints.likeness(own[0], other[0]),
        ] += 1
    assert Counter(tuple(r) for r in got) == expected


def test_fingerprints_of_hard_cases(hard, rows):
    check_neighbours(fingerprints.compare_with_next(hard).collect(), rows)


def test_fingerprints_of_given_documents(spark, given):
    check_neighbours(queries.op1_fingerprints(spark, SF_SMALL).collect(), given)


def test_fingerprint_arrays(hard, rows):
    got = fingerprints.fingerprints(hard).collect()
    assert len(got) == len(rows)
    assert all(len(r["hashes"]) == len(r["positions"]) for r in got)


# ------------------------------------------------------------ url filters

URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://Shop.COM/x", "http://com", "http://com/", "http://a.b.com?x=/", "https://example.com/en/1",
    "https://www.example.com/en/1", "https://m.www.example.com/en/", "http://xexample.com/en/", "http://example.net/fr/9", "http://net/es/", "http://net/de/",
    "http://a.net/fr", "x://y.example.com/en/#a?b", "http://a.org/p?u=http://b.com/", "http://É.com/", "http://a.com:80/", "http://a.com//en/", "http://a\nb.com/x\ny",
]


def brute_url(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for said, h, p in url_filters.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, said)
    return host, path, *(best or (None, None))


def test_urls_of_hard_cases(spark):
    pages = spark.createDataFrame([(i, u, "h", "x", 1.0) for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, verdict string, score double")
    got = {r["page_id"]: r for r in url_filters.judge(pages).collect()}
    assert len(got) == 2 * len(URLS)
    for i, u in enumerate(URLS * 2):
        host, path, rule, said = brute_url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] in ("allow", "block") and (said is None or got[i]["verdict"] == said)


def test_models_separate_the_covered_urls(spark):
    got = queries.op2_url_filters(spark, "/root/testdata/sf0.01")
    covered = got.where("rule is not null").select((F.col("verdict") == "allow").alias("good"), "score").collect()
    good, bad = ([r["score"] for r in covered if r["good"] is g] for g in (True, False))
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_url_models_keep_every_gram(spark):
    r = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz/-_?=&#%:~+@,;!"))
    word = lambda n: "".join(r.choice(letters, n))
    urls = ["http://a.com/" + word(40) for _ in range(20_000)] + ["http://net/es/" + word(20) for _ in range(30)]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    rule, said = url_filters.rule_of(*url_filters.host_and_path(F.col("url")))
    judged = pages.withColumn("rule", rule).withColumn("verdict", said)
    counts = url_filters.counted(judged.where("verdict is not null").select("url", (F.col("verdict") == "allow").cast("int").alias("good")))
    model = url_filters.learn(counts)
    length = {x["verdict"]: x["n"] for x in judged.groupBy("verdict").agg(F.sum(F.length("url")).alias("n")).collect()}
    assert model.root[0].tolist() == [length["block"], length["allow"]]
    full = model.table.where(F.col("kind") == url_filters.ORDER + 1)
    assert full.count() == counts.select("gram").distinct().count() > 500_000
    assert full.select(F.inline("entries")).agg(F.sum("a")).first()[0] == length["block"] + length["allow"]


def brute_witten_bell(taught, url):
    """Log probability of every character of ``url``, by the definition."""
    symbol = lambda u: [0] * 5 + [int(url_filters._SYMBOL[c]) for c in u.encode()]
    after = defaultdict(Counter)
    for u in taught:
        x = symbol(u)
        for i in range(5, len(x)):
            for k in range(6):
                after[tuple(x[i - k : i])][x[i]] += 1
    x, out = symbol(url), []
    for i in range(5, len(x)):
        p = 1 / url_filters.SYMBOLS
        for k in range(6):
            seen = after.get(tuple(x[i - k : i]))
            if seen:
                p = (seen[x[i]] + len(seen) * p) / (sum(seen.values()) + len(seen))
        out.append(math.log(p))
    return out


@pytest.mark.parametrize("cells", [gram_values.HEAD_CELLS, 60, 0])
def test_url_scores_by_the_definition(spark, monkeypatch, cells):
    monkeypatch.setattr(gram_values, "HEAD_CELLS", cells)
    good, bad = ["http://a.com/abcabc", "http://b.com/cab?x=1", "http://a.com/abcabc"], ["http://net/es/zzyzx", "http://q.net/fr/zyx"]
    covered = spark.createDataFrame([(u, 1) for u in good] + [(u, 0) for u in bad], "url string, good int")
    model = url_filters.learn(url_filters.counted(covered))
    assert 2 * len(model.head.value.keys) <= cells
    asked = [*good, *bad, "http://new.org/Ünseen;§", "abc", "", None, "http://a.com/" + "xyz" * 3000]
    got = url_filters.scored(spark.createDataFrame(list(enumerate(asked)), "page_id long, url string"), model)[0].collect()
    for r in got:
        url = asked[r["page_id"]]
        expected = np.mean(np.subtract(brute_witten_bell(good, url), brute_witten_bell(bad, url))) if url else 0
        assert r["score"] == pytest.approx(expected, abs=2e-6)


def test_markov_probabilities_sum_to_one(spark):
    covered = spark.createDataFrame([("http://abc.com/abcabc", 1), ("xyz/xyyz", 0)], "url string, good int")
    model = url_filters.learn(url_filters.counted(covered))
    raw = np.frombuffer(b"http://abc.com/abcabc", np.uint8)
    packed, _ = url_filters._grams(raw, np.array([0, len(raw)]))
    nexts = [(int(c) << url_filters.BITS | x) & url_filters.SHAPE.mask(6) for c in packed[[3, 9, 15]] for x in range(url_filters.SYMBOLS)]
    asked = spark.createDataFrame([(x,) for x in nexts], "gram long")
    found = gram_values.values(asked, model.table, url_filters.SHAPE, model.root, url_filters.witten_bell).collect()
    p = {r["gram"]: np.exp(np.array(r["logs"]) / gram_values.SCALE) for r in found}
    for at in range(0, len(nexts), url_filters.SYMBOLS):
        assert sum(p[x] for x in nexts[at : at + url_filters.SYMBOLS]) == pytest.approx([1, 1], abs=1e-4)


# ------------------------------------------------------------ packing


def check_packing(got, rows, capacity=2048):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    expected = Counter()
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        start, end = 0, len(ids) % capacity or capacity
        for piece in range(-(-len(ids) // capacity)):
            expected[r[0], piece, start, end - start, zlib.crc32(ids[start:end].tobytes())] += 1
            start, end = end, end + capacity
    assert Counter(tuple(r)[:5] for r in got) == expected
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), -(-sum(r["length"] for r in got) // capacity)


def test_packing_of_hard_cases(hard, rows):
    made, least = check_packing(packing.pack(hard).collect(), rows)
    assert made <= least + 1


def test_packing_of_given_documents(spark, given):
    made, least = check_packing(queries.op3_packing(spark, SF_SMALL).collect(), given)
    assert made <= 1.01 * least + 1


def test_pieces_of_added_tokens_and_long_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # as it is, without other settings
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext", "a" + " " * 1_000_001 + "b", "\n" * 1_000_001]
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in packing.pieces(docs, 1 << 21).select("doc_id", "length", "ids_crc32").collect()}
    ids = [np.array([*t.encode(x, add_special_tokens=False).ids, packing.END_ID], "<u4") for x in texts]
    assert got == {(i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)}


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_once(seed):
    r = np.random.default_rng(seed)
    counts = np.zeros(129, np.int64)
    lengths = r.integers(1, 129, r.integers(1, 2000)) if seed % 2 else r.integers(40, 129, 500)
    np.add.at(counts, lengths, 1)
    used, made = np.zeros_like(counts), 0
    for shape, repeats in packing.plan(counts, 128):
        assert sum(shape) <= 128 and repeats > 0
        for x in shape:
            used[x] += repeats
        made += repeats
    assert (used == counts).all()
    # never worse than first fit decreasing by more than the rounding of the fit
    room: list[int] = []
    for x in sorted(lengths.tolist(), reverse=True):
        i = next((i for i, free in enumerate(room) if free >= x), None)
        if i is None:
            room.append(128 - x)
        else:
            room[i] -= x
    assert made <= 1.03 * len(room) + 2


def test_fitted_repeats_meet_a_histogram_of_patterns():
    counts = np.zeros(101, np.int64)
    counts[[60, 40]] = 500
    counts[[50, 30, 20]] = 300
    patterns = packing.few_document_patterns(counts, 100)
    x = packing.fit_repeats(patterns, counts)
    made = np.zeros(101)
    for p, n in zip(patterns, x):
        for length in p[p > 0]:
            made[length] += n
    assert np.abs(made - counts).max() < 5


def test_tokenizer_agrees_on_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in ["", " ", "\n\n  x", "<|endoftext|> a", "naïve \u00a0\u2003 x\x85y\x1cz", "日本語テキスト 한국어", "\U0001f600" * 5, "I'll we've 's 12345", "a" * 5000, "\u0301e", "\u0660\u0661 ²"]:
        assert packing.encoder().encode_to_numpy(text, disallowed_special=()).tolist() == t.encode(text, add_special_tokens=False).ids, text


# ------------------------------------------------------------ n-gram join


def test_near_groups_of_hard_cases(hard, rows):
    got = ngram_join.near_duplicates(hard).select("doc_id", "class_id", "n_links", "copy_of").collect()
    assert ordered(got) == ordered(near_groups(rows))


def test_near_groups_of_given_documents(spark, given):
    got = queries.op4_ngram_join(spark, SF_SMALL).select("doc_id", "class_id", "n_links", "copy_of").collect()
    assert ordered(got) == ordered(near_groups(given))


def chain_documents():
    """A large group of near copies, and a chain whose ends are not alike."""
    base = prose(20, 120).split(" ")
    r = np.random.default_rng(1)
    texts = []
    for i in range(150):
        w = list(base)
        w[int(r.integers(120))] = f"changed{i}"
        texts.append(" ".join(w))
    chain = prose(21, 200).split(" ")
    for i in range(0, 60, 4):
        texts.append(" ".join(f"x{j}" if j < i else w for j, w in enumerate(chain)))
    texts += [prose(100 + i, 60) for i in range(40)]
    return [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[0]) for i in range(80)]


@pytest.mark.parametrize("blocks", [(512, 400_000), (16, 3_000)])
def test_near_groups_of_chains_and_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", blocks[0])
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", blocks[1])
    rows = chain_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_duplicates(docs).select("doc_id", "class_id", "n_links", "copy_of").collect()
    assert ordered(got) == ordered(near_groups(rows))


def test_links_where_blocks_hold_no_class(spark, monkeypatch):
    # blocks of fewer shingles than one text: about as many blocks as classes, some of them empty
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 100)
    rows = chain_documents()[:12]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_duplicates(docs).select("doc_id", "class_id", "n_links", "copy_of").collect()
    assert ordered(got) == ordered(near_groups(rows))


def test_pairs_of_two_blocks_are_across_them():
    for side, n in (([0, 0, 0], 3), ([1, 1, 1], 0), ([2, 2], 0), ([1, 2, 1], 2)):
        assert sum(len(i) for i, _ in ngram_join._pairs_of(0, len(side), np.array(side))) == n


def test_one_document_of_each_group_stays(hard, rows):
    kept = ngram_join.keep_first(hard)
    assert kept.columns == hard.columns
    _, group, _ = linked(rows)
    got = kept.collect()
    assert sorted(group[r["text"]] for r in got if r["text"] is not None) == sorted(set(group.values()))
    assert {r["doc_id"] for r in got} == {g[1] for g in near_groups(rows)}
    assert sum(r["text"] is None for r in got) == sum(r[1] is None for r in rows)


def test_pruning_keeps_pairs_at_the_threshold():
    least = ngram_join.least_matches()
    assert list(least) == sorted(least) and least[0] < 8 < least[-1] < 103
    r = np.random.default_rng(0)
    a = r.integers(0, 2**16, (20_000, ngram_join.HASHES)).astype(np.uint16)
    b = np.where(r.random(a.shape) < 0.8, a, a + 1).astype(np.uint16)
    c = np.where(r.random(a.shape) < 0.4, a, a + 1).astype(np.uint16)
    i = np.arange(len(a))
    assert ngram_join.survivors(a, b, i, i).mean() > 0.9999
    assert ngram_join.survivors(a, c, i, i).mean() < 0.01


def test_shared_counts_both_ways():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 300, 80).astype(np.uint64)) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    expected = [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(i, j)]
    assert ngram_join.shared_counts(sets, i, j).tolist() == expected
    assert ngram_join.shared_counts(sets, i[:9], j[:9]).tolist() == expected[:9]


def test_components_of_random_edges(spark):
    from fieldreports.llm.components import components

    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 120, (80, 2))] + [(i, i + 1) for i in range(200, 260)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# ------------------------------------------------------------ language id


def test_languages_of_hard_cases(hard, rows):
    got = language_id.identify(hard).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    for i in (3, 4, 5, 19):  # no letter
        assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in by_id[i])
    assert all(r["lang_pred"] in ("en", "fr") for r in by_id[13])
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op5_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert right / n > 0.98


def test_a_rare_language_stays_beside_many_grams(spark):
    r = np.random.default_rng(7)
    rows = [(i, "".join(map(chr, r.integers(0x4E00, 0x9FA5, 20_000))), "zh") for i in range(120)]
    rows += [(1000 + i, prose(i, 8), "rare") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8).cache()
    models = language_id.fit(docs)
    assert models.languages == ("rare", "zh")
    trains = docs.where(language_id._train_part(F.col("doc_id"))[0]).select("text", "lang")
    grams = trains.mapInArrow(language_id._count_grams, "lang string, gram long, n long").select("gram").distinct().count()
    assert grams > 1_000_000 and models.table.where(F.col("kind") == language_id.ORDER).count() == grams
    assert models.head.value.logs.size <= gram_values.HEAD_CELLS
    got = language_id.predict(docs.where("doc_id >= 1000"), models, "doc_id")[0].collect()
    assert len(got) == 12 and all(x["lang_pred"] == "rare" for x in got)


class BruteKneserNey:
    """Interpolated Kneser-Ney over letters and single spaces, by the definition."""

    def __init__(self, texts_by_language):
        self.counts, letters = {}, set()
        for lang, texts in texts_by_language.items():
            top = Counter(g for t in texts for g in self.grams(t))
            levels = {4: top}
            for k in (3, 2, 1):
                levels[k] = Counter(g[1:] for g in levels[k + 1])
            letters |= set(levels[1])
            self.counts[lang] = levels
        self.discounts = {lang: {k: self.discount(level) for k, level in levels.items()} for lang, levels in self.counts.items()}
        self.alphabet = len(letters) + 1

    @staticmethod
    def grams(text):
        x = re.sub(" +", " ", "".join(c.lower()[0] if c.isalpha() else " " for c in text)).lstrip(" ")
        x = "   " + x
        return [x[i - 3 : i + 1] for i in range(3, len(x))]

    @staticmethod
    def discount(level):
        ones, twos = (sum(n == m for n in level.values()) + 0.5 for m in (1, 2))
        return ones / (ones + 2 * twos)

    def probability(self, lang, gram):
        p = 1 / self.alphabet
        for k in (1, 2, 3, 4):
            level, g, d = self.counts[lang][k], gram[-k:], self.discounts[lang][k]
            follows = [n for h, n in level.items() if h[:-1] == g[:-1]]
            if follows:
                p = max(level[g] - d, 0) / sum(follows) + d * len(follows) / sum(follows) * p
        return p

    def entropy(self, lang, text):
        return -np.mean([math.log(self.probability(lang, g)) for g in self.grams(text)])


@pytest.mark.parametrize("cells", [gram_values.HEAD_CELLS, 60, 0])
def test_languages_by_the_definition(spark, monkeypatch, cells):
    monkeypatch.setattr(gram_values, "HEAD_CELLS", cells)
    taught = {"a": [prose(1, 60), "één  Été-là"], "b": [prose(2, 60, ("ña", "lo", "que", "el", "ción"))] * 2, "c": ["xx"]}
    docs = [(t, lang) for lang, texts in taught.items() for t in texts]
    trains = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 != 1 and zlib.crc32(str(i).encode()) // 3 % language_id.CALIBRATES)
    models = language_id.learn(language_id.counted(spark.createDataFrame([(trains, *d) for d in docs], "doc_id long, text string, lang string")))
    assert models.languages == ("a", "b", "c") and models.head.value.logs.size <= cells
    asked = [*(d[0] for d in docs), "ÉTÉ? que lo漢 𐐀 12", "zzz", "x", prose(9, 4000), "12 3", "", None]
    got = {r["i"]: r for r in language_id.predict(spark.createDataFrame(list(enumerate(asked)), "i long, text string"), models, "i")[0].collect()}
    brute = BruteKneserNey(taught)
    for i, text in enumerate(asked):
        if i in (9, 10, 11):
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["entropy"]) == ("und", 0, 0)
            continue
        entropies = {x: brute.entropy(x, text) for x in taught} if len(text) < 2000 else None
        if entropies:
            best, second = sorted(entropies.values())[:2]
            assert got[i]["entropy"] == pytest.approx(best, abs=2e-6)
            assert entropies[got[i]["lang_pred"]] == pytest.approx(best, abs=2e-6)
            assert got[i]["lead"] == pytest.approx((second - best) * math.sqrt(len(brute.grams(text))), abs=1e-4)
        else:
            assert got[i]["lang_pred"] == "a"


def test_a_language_without_letters_and_clashing_names(spark):
    rows = [(i, (None, "", "abc def", "abc def")[i % 4], "en" if i % 2 else "fr", "x", 1, 2, 3) for i in range(40)] + [(40, "été " * 700_000, "fr", "x", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, chars string, sums int, text_row int, added int").repartition(2)
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert len(got) == 41 and all((got[i]["lang_pred"] == "und") == (i % 4 < 2) for i in range(40))
    assert len({(got[i]["lang_pred"], got[i]["score"], got[i]["entropy"]) for i in range(40) if i % 4 > 1}) == 1


def test_kneser_ney_probabilities_sum_to_one():
    r = np.random.default_rng(4)
    counts = r.integers(0, 4, (4, 50, 2)).astype(float)
    counts[:, 0] = 3  # every context is seen
    contexts = {k: tuple(np.broadcast_to(x, (50, 2)) for x in (counts[k - 1].sum(0), (counts[k - 1] > 0).sum(0))) for k in range(1, 5)}
    logs = language_id.kneser_ney({k: counts[k - 1] for k in range(1, 5)}, contexts, np.full((4, 2), 0.4), 50)
    assert np.exp(logs).sum(0) == pytest.approx([1, 1])


# ------------------------------------------------------------ source mix


def brute_targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free = {}, set(names)
    while free:
        left = share * sum(sizes.values()) - sum(out.values())
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= most * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: float(most * sizes[s]) for s in over}
        free -= set(over)
    return out


def check_mix(got, rows, slack):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target = brute_targets(dict(sizes))
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= slack, s
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)


def test_mix_of_hard_cases(hard, rows):
    first = source_mix.mix(hard).collect()
    check_mix(first, rows, 3 * source_mix.BLOCK_WORDS)
    assert ordered(first) == ordered(source_mix.mix(hard.repartition(5)).collect())


@pytest.mark.parametrize("shard_words", [500_000, 300])
def test_mix_of_given_documents(spark, given, shard_words):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    check_mix(source_mix.mix(docs, shard_words=shard_words).collect(), given, 0.03 * 4000 + 3 * source_mix.BLOCK_WORDS if shard_words == 300 else 3 * source_mix.BLOCK_WORDS)


def test_mixed_documents_have_the_taken_words(hard):
    mixed = source_mix.mixed_documents(hard)
    assert mixed.columns == hard.columns and mixed.dtypes == hard.dtypes
    by_source = lambda rows, size: Counter({s: sum(size(r) for r in rows if r["source"] == s) for s in ("a", "b", "z", None)})
    assert by_source(mixed.collect(), lambda r: len(words(r["text"]))) == by_source(source_mix.mix(hard).collect(), lambda r: r["taken"])


@pytest.mark.parametrize("seed", range(4))
def test_sainte_lague_gives_the_highest_quotients(spark, seed):
    r = np.random.default_rng(seed)
    votes = {i: float(v) for i, v in enumerate(r.choice([0, 1, 2, 3, 10, 500, 9999], 12))}
    seats = int(r.integers(0, 60))
    df = spark.createDataFrame([(i, v, seats) for i, v in votes.items()], "item int, votes double, seats long")
    got = {x["item"]: x["quota"] for x in source_mix.sainte_lague(df, [], [F.col("item")], "votes", "seats", "quota").collect()}
    expected = dict.fromkeys(votes, 0)
    for _ in range(seats if sum(votes.values()) else 0):
        best = max(votes, key=lambda i: (votes[i] / (2 * expected[i] + 1), -i))
        expected[best] += 1
    assert sum(got.values()) == sum(expected.values())
    # equal but for ties of quotients
    lowest = min((votes[i] / (2 * n - 1) for i, n in got.items() if n), default=0)
    assert all(votes[i] / (2 * n + 1) <= lowest + 1e-9 for i, n in got.items())


def test_the_mix_is_native(hard):
    plan = source_mix.mix(hard)._jdf.queryExecution().toString() + source_mix.mixed_documents(hard)._jdf.queryExecution().toString() + secret_scans.digests(hard)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ------------------------------------------------------------ substring dedup


def test_repeats_of_hard_cases(hard, rows):
    got = substring_dedup.remove_repeats(hard).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert ordered(got) == ordered(without_repeats(rows))


def test_repeats_of_given_documents(spark, given):
    assert ordered(queries.op7_substring_dedup(spark, SF_SMALL).collect()) == ordered(without_repeats(given))


@pytest.mark.parametrize("n", [34, 35, 36, 53])
def test_repeats_at_every_offset(spark, n):
    passage = prose(30, n)
    rows = [(i, " ".join([prose(40 + i, i), passage, prose(80 + i, 20)]).strip()) for i in range(37)]
    rows.append((90, "tick " * 60))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert ordered(got) == ordered(without_repeats(rows))


# ------------------------------------------------------------ quality rules


def test_counts_of_hard_cases(hard, rows):
    got = Counter(tuple(r) for r in quality_rules.measure(hard).select("doc_id", *quality_rules.BASE).collect())
    assert got == Counter((r[0], *base_counts(r[1])) for r in rows)


def test_counts_and_verdicts_of_given_documents(spark, given, hard_dir):
    got = queries.op8_quality_rules(spark, SF_SMALL).collect()
    text = {r[0]: r[1] for r in given}
    for r in got:
        counts = base_counts(text[r["doc_id"]])
        assert tuple(r[c] for c in quality_rules.BASE) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["base_failed"] and r["kept"])
    assert queries.op8_quality_rules(spark, hard_dir).count() == len(hard_documents())


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = quality_rules.fit(docs, labels.where(half))
    got = quality_rules.judge(docs, model).join(labels.where(~half), "doc_id").where("not base_failed").collect()
    good, bad = ([r["kept"] for r in got if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and (not bad or np.mean(bad) < 0.2)


def test_trees_obey_their_signs():
    r = np.random.default_rng(0)
    x = r.normal(size=(800, 3)).astype(np.float32)
    y = (x[:, 0] + 0.5 * r.normal(size=800) - 2 * np.tanh(x[:, 1]) > 0).astype(float)
    trees = quality_rules.fit_trees(x, y, signs=(1, -1, 0), rounds=30)
    assert ((trees.margin(x) > 0) == y).mean() > 0.85
    for feature, sign in ((0, 1), (1, -1)):
        line = np.repeat(x[:50], 40, axis=0)
        line[:, feature] = np.tile(np.linspace(-3, 3, 40), 50)
        steps = np.diff(trees.margin(line).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-6).all()


def test_kept_documents_are_unchanged(hard, hard_dir, spark):
    model = quality_rules.fit(hard, spark.read.parquet(f"{hard_dir}/labels.parquet"))
    kept = quality_rules.keep_documents(hard, model)
    assert kept.dtypes == hard.dtypes
    judged = quality_rules.judge(hard, model).where("kept").select("doc_id")
    assert sorted((r[0] is None, r[0] or 0) for r in judged.collect()) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())


# ------------------------------------------------------------ secret scans


def check_spans(got, rows):
    names = secret_scans.KINDS
    text = lambda s: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in s)
    expected = Counter()
    for r in rows:
        s = base_spans(r[1])
        expected[r[0], *(sum(x[1] == k for x in s) for k in range(3)), hashlib.sha256(text(s).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:5] for r in got) == expected
    whole = {r[0]: r[1] or "" for r in rows}
    for r in got:
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert [x for x in spans if x[0] != "random"] == [x.split(":") for x in text(base_spans(whole[r["doc_id"]])).split(",") if x] or r["doc_id"] in (9, None)
        assert [int(x[1]) for x in spans] == sorted(int(x[1]) for x in spans)


def test_spans_of_hard_cases(hard, rows):
    check_spans(secret_scans.digests(hard).collect(), rows)


def test_spans_of_given_documents(spark, given):
    check_spans(queries.op10_secret_scans(spark, SF_SMALL).collect(), given)


def test_random_runs_are_found_and_words_are_not(spark):
    import base64

    r = np.random.default_rng(5)
    rows = []
    for i in range(60):
        key = base64.b64encode(r.bytes(30)).decode()
        rows.append((i, f"see {key} and {prose(i, 30)} supercalifragilisticexpialidocious thisisaverylongplainwordindeed some_long_identifier_name_here"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [x for x in secret_scans.digests(docs).collect()]
    hits = sum(f"random:4:{4 + 40}" in x["spans"] for x in found)
    assert hits >= 54
    extra = sum(x["spans"].count("random") for x in found) - hits
    assert extra <= 2


def test_parts_of_runs_around_base_spans_are_judged(spark):
    import base64

    r = np.random.default_rng(6)
    keys = [base64.b64encode(r.bytes(30)).decode() for _ in range(60)]
    rows = [(i, f"see {k}{'0123456789abcdef' * 2}_ and AKIA{'A1' * 8} {prose(i, 30)}") for i, k in enumerate(keys)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x["doc_id"]: [tuple(p.split(":")) for p in x["spans"].split(",")] for x in secret_scans.digests(docs).collect()}
    hits = 0
    for i, text in rows:
        base = {(s, e) for s, _, e in base_spans(text)}
        added = {(int(s), int(e)) for k, s, e in found[i] if k == "random"}
        assert all(e <= b or f <= s for s, e in added for b, f in base)
        hits += any(s == 4 and e == min(b for b, _ in base) for s, e in added)
    assert hits >= 54


def test_redaction_replaces_spans_only(hard, rows):
    out = secret_scans.redact(hard)
    assert out.dtypes == hard.dtypes
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[14]["text"].startswith("my [secret]") and "abcDEF123456" not in got[14]["text"]
    assert got[14]["n_chars"] == len(got[14]["text"])
    assert got[0]["text"] == rows[0][1] and got[4]["text"] is None and len(out.collect()) == len(rows)


# ------------------------------------------------------------ importance resampling


def test_resampling_takes_the_largest_keys(spark):
    got = queries.op9_importance_resampling(spark, SF_SMALL).collect()
    k = sum(r["kept"] for r in got)
    order = sorted(got, key=lambda r: (-r["key"], r["doc_id"]))
    assert {r["doc_id"] for r in order[:k]} == {r["doc_id"] for r in got if r["kept"]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    assert k == round(sum(labels.values()) / len(labels) * len(got))


def test_weights_are_sums_of_log_ratios(hard, rows):
    from fieldreports.llm import quality_classifier as qc
    from fieldreports.llm.common import Words, mix64, windows

    ratios = np.random.default_rng(0).normal(size=qc.BUCKETS)
    got = Counter((r["doc_id"], None if r["log_weight"] is None else round(r["log_weight"], 6)) for r in qc.weigh(hard, ratios).collect())
    expected = Counter()
    for r in rows:
        raw = np.frombuffer((r[1] or "").encode(), np.uint8)
        if not words(r[1]):
            expected[r[0], None] += 1
            continue
        pairs = windows(Words(raw, np.array([0, len(raw)])).hash, np.array([0, len(words(r[1]))]), 2)[0]
        half = qc.BUCKETS // 2
        runs = [int(mix64(np.array([raw[i] | raw[i + 1].astype(int) << 8 | raw[i + 2].astype(int) << 16], np.uint64))[0]) % half for i in range(len(raw) - 2)]
        expected[r[0], round(float(ratios[runs + [int(p) % half + half for p in pairs]].sum()), 6)] += 1
    assert got == expected


def test_resampled_documents_are_the_good_ones(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op9_importance_resampling(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["kept"] for r in got if r["quality"] == 1]) > 0.97
    assert np.mean([r["kept"] for r in got if r["quality"] == 0]) < 0.2


def test_resampling_of_hard_cases(hard, hard_dir, spark, rows):
    from fieldreports.llm import quality_classifier as qc

    got = qc.resample(hard, spark.read.parquet(f"{hard_dir}/labels.parquet"), k=7).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 7
    assert all(not r["kept"] for r in got if r["log_weight"] is None)
    assert sum(r["kept"] for r in qc.resample(hard, spark.read.parquet(f"{hard_dir}/labels.parquet"), k=1000).collect()) == sum(bool(words(r[1])) for r in rows)


@pytest.mark.parametrize("k", [0, 1, 3, 37, 199, 200, 500])
def test_top_k_with_ties(spark, k):
    from fieldreports.llm.quality_classifier import top_k

    r = np.random.default_rng(k)
    values = [float(v) for v in r.choice([1.0, 1.0 + 2**-52, -5.0, 3.25, 1e9, 7.0], 120)] + [float(v) for v in r.normal(size=80)] + [None] * 5
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, key double")
    got = top_k(df, "key", k, "doc_id").collect()
    order = sorted((x for x in enumerate(values) if x[1] is not None), key=lambda x: (-x[1], x[0]))
    assert {r["doc_id"] for r in got if r["kept"]} == {i for i, _ in order[:k]} and len(got) == len(values)


# ------------------------------------------------------------ exact equality


def test_span_hashes_tell_spans_apart():
    from fieldreports.llm.common import span_hashes, span_ids

    r = np.random.default_rng(7)
    one, other = (w.encode() for w in swapped_words())
    spans = [b"", b"a", b"b", b"ab", b"a\0", b"abcdefgh", b"abcdefghi", b"abcdefgh\0", one, other, one[:64], other[:64], one[:65], other[:65]]
    spans += [bytes(r.integers(97, 99, int(n)).astype(np.uint8)) for n in r.integers(0, 40, 500)]
    raw = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    starts = ends - [len(s) for s in spans]
    ids = span_ids(raw, np.ones(len(raw), bool), ends - starts)
    hashes, second = span_hashes(raw, starts, ends), span_hashes(raw, starts, ends, 1)
    for values in (ids, hashes, second):
        by = defaultdict(set)
        for s, v in zip(spans, values.tolist()):
            by[v].add(s)
        assert len(by) == len(set(spans)) and all(len(x) == 1 for x in by.values())
    assert not (hashes == second).any()


def test_repeated_windows_of_very_many_distinct_words(monkeypatch):
    """Three-word windows whose numbers do not fit 62 bits are told apart too."""
    r = np.random.default_rng(1)
    ids = r.integers(0, 5, 300) * (1 << 40)
    first = np.array([0, 120, 121, 300])
    runs, at = quality_rules._window_ids(ids, first, 3)
    want = [(int(i), tuple(ids[i : i + 3])) for d in range(3) for i in range(first[d], first[d + 1] - 2)]
    assert at.tolist() == [i for i, _ in want]
    same = defaultdict(set)
    for n, (_, run) in zip(runs.tolist(), want):
        same[n].add(run)
    assert all(len(x) == 1 for x in same.values()) and len(same) == len({run for _, run in want})


def test_windows_that_agree_in_one_hash_are_no_repeats():
    keys = substring_dedup._full_keys(np.array([5, 5, 5, 7, 7], np.uint64), np.array([1, 2, 1, 3, 4], np.uint64))
    places, left, at, flags = substring_dedup._found_here(keys, np.arange(5), np.ones(5, bool))
    assert sorted(places.tolist()) == [0, 2] and len(left) == 4


def test_classes_whose_hashes_collide_get_numbers_of_their_own(spark, monkeypatch):
    real = F.xxhash64

    def few(*cols):  # eight values for all, until salted
        return (F.pmod(real(*cols), F.lit(8)) if len(cols) == 1 and str(cols[0]) == "class" else real(*cols)).cast("long")

    monkeypatch.setattr(ngram_join.F, "xxhash64", few)
    classes = spark.range(40).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("class"), F.col("id").alias("first_number"))
    numbered, moved = ngram_join._numbered(classes)
    assert numbered.select("node").distinct().count() == 40 == numbered.count() and 32 <= moved.count() < 40
    again = ngram_join._with_node(classes, moved)
    assert sorted(map(tuple, again.select("class", "node").collect())) == sorted(map(tuple, numbered.select("class", "node").collect()))


def test_links_with_colliding_class_numbers(spark, hard, rows, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(ngram_join.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(8)).cast("long") if len(c) == 1 and str(c[0]) == "class" else real(*c))
    assert ordered(ngram_join.near_duplicates(hard).collect()) == ordered(near_groups(rows))


def test_many_short_near_copies_are_dealt_into_blocks(spark, monkeypatch):
    """A cluster of many short texts: blocks are bounded by classes too."""
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 20)
    base = prose(21, 60).split()
    texts = [" ".join(base[:i] + [f"w{i}"] + base[i + 1 :]) for i in range(60)] + [" ".join(base)]
    docs = [(i, t) for i, t in enumerate(texts)]
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert ordered(got) == ordered(near_groups(docs))


# ------------------------------------------------------------ texts of very many spans


def many_spans(n: int, seed: int = 1) -> str:
    """A key list: hex runs, assignments that overlap them, access keys, letters beyond ASCII."""
    r = np.random.default_rng(seed)
    digits = np.array(list("0123456789abcdef"))
    out = []
    for i in range(n):
        run = "".join(r.choice(digits, 16 + i % 9))
        out.append((run, f"token={run}é", f"AKIA{run.upper()}", f"ñ\U0001f600 {run}")[i % 4])
    return "\n".join(out)


def test_many_spans_are_those_of_brute_force(spark):
    texts = [many_spans(n, n) for n in (1, 63, 64, 65, 200, 5000)] + ["é" * 3000 + many_spans(70) + "x" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    clean_texts = {r["doc_id"]: r["text"] for r in secret_scans.redact(docs).collect()}
    for r in secret_scans.scan(docs).collect():
        assert [(x["start"], x["kind"], x["end"]) for x in r["base"]] == base_spans(r["text"])
        clean, at = [], 0
        for x in r["spans"]:
            if x["start"] >= at:
                clean += [r["text"][at : x["start"]], "[secret]"]
            at = max(at, x["end"])
        assert clean_texts[r["doc_id"]] == "".join(clean) + r["text"][at:]


def test_time_grows_with_the_spans(spark):
    import time

    def seconds(n):
        docs = spark.createDataFrame([(1, many_spans(n))], "doc_id long, text string").cache()
        docs.count()
        begin = time.perf_counter()
        assert secret_scans.digests(docs).first()["n_hex"] >= n // 2
        secret_scans.redact(docs).collect()
        return time.perf_counter() - begin

    seconds(100)
    few, many = seconds(10_000), seconds(50_000)
    assert many < 60 and many < 12 * few, (few, many)
