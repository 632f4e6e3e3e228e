"""License scans, lexical search and spelling variants against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldreports.llm import lexical_search, license_scans, queries, spelling_variants
from tests.conftest import SF_SMALL

from .cases import hard_items, ordered, prose

# ------------------------------------------------------------ license scans

NOTICES = [
    None,
    "",
    "   ",
    "Released under the MIT License.",
    "MIT mit license the under",
    "mit der license, the end; under a rest",
    "CC-BY 4.0, cc\nby; ccby, by cc",
    "GNU General Public License, version 3. All rights reserved. ALL RIGHTS RESERVED",
    "all rights, rights reserved all rights reserved",
    "general public public license general public license",
    "Licenſe under the MIT Licenſe. Known all rightſ reserved",
    "éall rights reserved, all rights reservedé, _all_rights_reserved_",
    "Permission is hereby granted, without charge, to any person obtaining a copy of this software",
    "Permission is hereby granted, free of charge, to some people obtaining a copy of this software",
    "license " * 3000 + "under the mit license",
    "the of and " * 2000 + "cc by nc 4 0 under",
    prose(1, 3000) + " Licensed under the Apache License, Version 2.0. " + prose(2, 300),
    "under cc by nc 4.0 under cc by sa 4.0",
]


def license_words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_blocks(text, templates):
    """Every block that starts with a template's token and meets its threshold."""
    w, out = license_words(text), []
    for number, t in enumerate(templates):
        tokens = set(t.words)
        for s in range(len(w)):
            block = w[s : s + t.width]
            shared = len(tokens & set(block))
            if w[s] in tokens and shared >= t.need and (not t.exact or block == t.words):
                out.append((number, s, shared))
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.9, 1.0])
def test_blocks_are_all_that_meet_the_threshold(spark, threshold):
    templates = tuple(license_scans.Template(t.phrase, t.label, 1.0 if t.exact else threshold, t.exact) for t in license_scans.TEMPLATES)
    r = random.Random(5)
    vocabulary = sorted({w for t in templates for w in t.words}) + ["x", "Y", "é"]
    texts = NOTICES + [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60))) for _ in range(40)]
    for _ in range(40):  # templates with words dropped, swapped and put in
        w = list(r.choice(templates).words)
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([[], ["x"], [w[at], "Y"], [w[at], w[at]]])
            if not w:
                break
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in enumerate(texts)], "doc_id int, text string, n_words int, w string")
    got = license_scans.scan(docs.drop("n_words"), templates).collect()
    assert len(got) == len(texts) and set(got[0].asDict()) == {"doc_id", "text", "w", "n_words", "blocks"}
    for row in got:
        assert row["n_words"] == len(license_words(row["text"]))
        want = brute_blocks(row["text"], templates)
        found = [tuple(b) for b in row["blocks"]]
        assert found == sorted(set(found)) and found == sorted(want), row["text"]


def test_need_is_the_least_number_that_reaches_the_threshold():
    for n, threshold in itertools.product(range(1, 20), (0.1, 0.5, 0.75, 0.9, 1.0)):
        t = license_scans.Template(" ".join(f"w{i}" for i in range(n)), "x", threshold)
        assert t.need == next(k for k in range(1, n + 1) if k >= threshold * n - 1e-9)


def check_licenses(got, rows):
    phrases = [(p.split(), label) for p, label in license_scans.BASE]
    want = []
    for i, text in rows:
        w = license_words(text)
        places = [(s, label) for p, label in phrases for s in range(len(w)) if w[s : s + len(p)] == p]
        starts = [s for s, _ in places]
        blocks = brute_blocks(text, license_scans.TEMPLATES)
        labels = {license_scans.TEMPLATES[n].label for n, _, _ in blocks}
        score = max((k / len(set(license_scans.TEMPLATES[n].words)) for n, _, k in blocks), default=0.0)
        want.append((i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score))
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert ordered(got.select(*columns).collect()) == ordered(want)


def test_licenses_of_hard_cases(spark, hard, rows):
    check_licenses(license_scans.labelled(hard), [(r[0], r[1]) for r in rows])
    check_licenses(license_scans.labelled(spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")), list(enumerate(NOTICES)))


def test_licenses_of_given_documents(spark):
    base = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_license_scans(spark, base)
    check_licenses(got, rows)
    assert {r["labels"] for r in got.select("labels").distinct().collect()} > {"", "mit", "apache-2.0", "reserved"}


def test_license_scan_uses_built_in_functions_only(spark):
    plan = queries.op11_license_scans(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExternalRDD|Exchange", plan)


# ------------------------------------------------------------ lexical search


def brute_search(docs, items, top):
    terms = lambda t: license_words(t)
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t}:
        scored = []
        for i, c in counts:
            m = 100 - 75 + (75 * c.total() * n_docs) // total
            w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            s = sum(w(t) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:top])]
    return ordered(out)


@pytest.mark.parametrize("block_bytes, step, piece", [(16 << 20, 1 << 21, 1 << 20), (60, 50, 100)])
@pytest.mark.parametrize("top", [1, 10, 1000])
def test_search_of_hard_cases(spark, hard, rows, monkeypatch, block_bytes, step, piece, top):
    monkeypatch.setattr(lexical_search, "STEP", step)
    monkeypatch.setattr(lexical_search, "PIECE", piece)
    items = spark.createDataFrame(hard_items(), "item_id long, text string, doc_id int")
    got = lexical_search.search(hard, items, top, block_bytes)
    assert ordered(got.collect()) == brute_search([(r[0], r[1]) for r in rows], [r[:2] for r in hard_items()], top)


def test_search_of_given_documents(spark):
    docs, items = (
        [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id"))
    )
    assert ordered(queries.op12_lexical_search(spark, SF_SMALL).collect()) == brute_search(docs, items, 10)


def test_search_with_an_empty_side(spark, hard):
    none = spark.createDataFrame([], "item_id string, text string")
    assert lexical_search.search(hard, none).collect() == []
    some = spark.createDataFrame([("a", "one two")], "item_id string, text string")
    assert lexical_search.search(hard.where("false"), some).collect() == []
    assert dict(lexical_search.search(hard, some).dtypes) == {"item_id": "string", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_heaps_keep_the_best_of_any_order():
    r = np.random.default_rng(3)
    rows = [(int(r.integers(4)), int(r.integers(1, 6)), int(r.integers(50)), bool(r.random() < 0.1)) for _ in range(500)]
    heaps = lexical_search.Heaps(4, 7)
    for at in range(0, len(rows), 13):
        item, score, ids, null = (np.array(c) for c in zip(*rows[at : at + 13]))
        good = score >= heaps.least[item]
        heaps.add(item[good], score[good], ids[good], null[good])
    got = list(zip(heaps.item.tolist(), heaps.score.tolist(), heaps.null.tolist(), heaps.id.tolist()))
    want = []
    for i in range(4):
        own = sorted((-s, null, d) for item, s, d, null in rows if item == i)
        want += [(i, -s, null, d) for s, null, d in own[:7]]
    assert got == want


# ------------------------------------------------------------ spelling variants


def brute_words(docs):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counted):
    near = defaultdict(list)
    for a, b in itertools.combinations(counted, 2):
        if abs(len(a) - len(b)) <= 1 and one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counted[o], o))
        if counted[best] >= 10 * counted[w]:
            form[w] = best
    out = []
    for w, n in counted.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counted.get(form.get(w))))
    return ordered(out)


def variant_documents():
    """Words with edits at every place, chains of forms, anagrams, long and odd words, ties."""
    r = random.Random(11)
    letters = "abcdeéÿñ"
    out = []

    def edited(w):
        at, c = r.randrange(len(w) + 1), r.choice(letters)
        return r.choice([w[:at] + c + w[at:], w[: max(at - 1, 0)] + w[at:], w[: max(at - 1, 0)] + c + w[at:]])

    for k in range(25):
        w = "".join(r.choice(letters) for _ in range(r.randint(6, 12)))
        chain = [w, edited(w)]
        chain += [edited(chain[-1]), "".join(r.sample(w, len(w))), edited(w), edited(w)]
        for word, n in zip(chain, (250, 24, 2, 30, 20, 20)):
            out += [word] * n
    out += ["x" * 5000] * 30 + ["x" * 5001] * 3 + ["Zürich" * 2] * 40 + ["ZÜRICH" * 2] * 2 + ["abcdefg"] * 20 + ["abcdefh"] * 20 + ["abcdefi"] * 2
    out += ["chainaa"] * 2 + ["chainab"] * 20 + ["chainbb"] * 200 + ["chainbbb"] * 2000  # a chain over three hops
    r.shuffle(out)
    return [(i if i % 50 else None, "1, ".join(out[i::97]) + " Ā aĀbcdefghi×jk") for i in range(97)] + [(5, None), (6, ""), (None, "")]


def test_variants_against_brute_force(spark, monkeypatch):
    docs = variant_documents()
    monkeypatch.setattr(spelling_variants, "PIECE", 50)
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, n int, key string").repartition(4)
    got = spelling_variants.group_variants(frame)
    want = brute_variants(brute_words(docs))
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    assert ordered(got.select(*columns).collect()) == want
    assert any(r[2] not in (r[0], r[1]) for r in want)  # some chain has two steps


def test_variants_of_hard_and_given_documents(spark, hard, rows):
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    assert ordered(spelling_variants.group_variants(hard).select(*columns).collect()) == brute_variants(brute_words([r[:2] for r in rows]))
    given = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(queries.op13_spelling_variants(spark, SF_SMALL).select(*columns).collect()) == brute_variants(brute_words(given))


@pytest.mark.parametrize("parts", [(1, 3), (1, 4), (2, 3), (2, 4), (3, 1), (3, 2)])
def test_multisets_within_the_distance_share_a_signature(parts):
    r = random.Random(2)
    found = []
    for _ in range(300):
        w = [r.choice("abcde") for _ in range(r.randint(7, 14))]
        v = w[:]
        at = r.randrange(len(v))
        v[at : at + 1] = r.choice([[], [r.choice("xyzab")], [v[at], "q"]])
        r.shuffle(v)
        found += ["".join(w), "".join(v)]
    first = np.cumsum([0] + [len(w) for w in found])
    letters = np.array([ord(c) for w in found for c in w], np.int64)
    signed = spelling_variants.signatures(letters, first, parts)
    one, two = parts
    k2 = -(-3 // one) - 1
    assert signed.shape == (len(found), one * math.comb(two, two - k2))
    assert all((signed[i] == signed[i + 1]).any() for i in range(0, len(found), 2))


@pytest.mark.parametrize("parts", [(1, 3), (2, 3), (3, 1)])
def test_near_words_share_a_key_as_shorter_and_other(parts):
    r = random.Random(4)
    found = ["".join(r.choice("abcdé") for _ in range(r.randint(7, 9))) for _ in range(60)]
    found = sorted({w[:i] + c + w[i + d :] for w in found for i in range(len(w)) for c in ("", "x") for d in (0, 1)} | set(found))
    found = [w for w in found if len(w) >= 7][:600]
    at, keys, short = spelling_variants.join_keys(found, parts)
    own = defaultdict(set)
    for i, k, s in zip(at.tolist(), keys.tolist(), short.tolist()):
        own[i, s].add(k)
    for i, j in itertools.combinations(range(len(found)), 2):
        a, b = sorted((i, j), key=lambda x: len(found[x]))
        if one_apart(found[a], found[b]):
            assert own[a, True] & own[b, len(found[a]) == len(found[b])], (found[a], found[b])


def test_variants_without_any_near_word(spark):
    docs = spark.createDataFrame([(1, "aaaaaaa bbbbbbbb aaaaaaa bbbbbbbb once")], "doc_id long, text string")
    got = spelling_variants.group_variants(docs).where(F.col("n") == 2).collect()
    assert all(r["root"] == r["word"] and r["form"] is None and r["form_n"] is None and r["n_near"] == 0 for r in got)
