"""Small tables with the hard cases, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

SEP = re.compile(rb"[\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return [w for w in SEP.split((text or "").encode()) if w]


def prose(seed: int, n: int, syllables=("tha", "ne", "ti", "on", "er", "shi", "bo", "lu", "ka")) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
        out.append(w + ("." if r.random() < 0.1 else ""))
    return " ".join(out)


def swapped_words() -> tuple[str, str]:
    """A Thue-Morse word of 1,024 letters and its swap: sums over the places of
    their bytes, modulo 2**64, are equal for every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def hard_documents() -> list[tuple]:
    """``doc_id, text, lang, source, n_chars, size, class, text2``: nulls, empty and very long texts,
    repeated rows and ids, copies and near copies, odd white space and characters."""
    base = prose(1, 300)
    near = base.replace(" ", "  ", 3) + " ending here"
    passage = prose(2, 60)
    one, other = swapped_words()
    texts = {
        0: base,
        1: base,
        2: near,
        3: "",
        4: None,
        5: " \n\t ",
        6: "one two",
        7: "one  two",
        8: prose(3, 40) + " " + passage + " " + prose(4, 45),
        9: prose(5, 70) + "\n" + passage,
        10: "ab " * 200,
        11: "no\u00a0break \u2003wide \x1c\x85 " + prose(6, 80) + " \U0001f600 éñß",
        12: "\n".join(["same line here"] * 5 + ["other # line $ | <x>"]) + prose(7, 60),
        13: prose(8, 20_000),
        14: 'my password = "abcDEF123456" and TOKEN:xyz AKIA' + "A1B2C3D4E5F6G7H8" + " 0123456789abcdef0123 deadbeef secret: token: abcdefghijklmn",
        15: "kw9Xz2Lq8Rt5Yv1Bn4Mc7Pd0Sg3Hj6Fw " + prose(9, 60) + " thisisaverylongplainwordindeed",
        16: base[: len(base) // 2],
        17: "x",
        18: passage,
        19: "12 34 -- !!",
        # different words, lines and texts whose positional sums are equal
        20: f"ab cd ef {one} gh",
        21: f"ab cd ef {other} gh",
        22: one,
        23: other,
        24: prose(12, 17) + f" {one} " + prose(13, 17),
        25: prose(12, 17) + f" {other} " + prose(13, 17),
        26: f"{one}\n{other}\n{one} {other} {one}\n{other} {one} {other}\n" + prose(14, 55),
    }
    rows = [(i, t, ("en", "fr", None)[i % 3] if i != 13 else "en", ("a", "b", None, "z")[i % 4], len(t or ""), i, "c", "x") for i, t in texts.items()]
    rows.append(rows[8])  # a repeated row
    rows.append((9, "same id, another text " + prose(10, 55), "en", "a", 1, 0, None, None))
    rows.append((None, prose(11, 90), "en", None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None))
    return rows


def hard_items() -> list[tuple]:
    """``item_id, text, doc_id``: null, empty, repeated, one id with two texts, terms no document has."""
    texts = [prose(2, 20), None, "", "one TWO two", "zzzzqqqq", "éñß \U0001f600 12 34", prose(8, 50), prose(1, 40)]
    return [(i, t, 1) for i, t in enumerate(texts)] + [(3, "one TWO two", 1), (3, "tha ne", 2), (None, "one same line", 3)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, `class` string, text2 string"


def shingle_set(text: str | None) -> frozenset:
    w = words(text)
    if len(w) >= 5:
        return frozenset(zip(*[w[i:] for i in range(5)]))
    return frozenset([tuple(w)]) if w else frozenset()


def linked(rows: list[tuple]) -> tuple[dict, dict, dict]:
    """By text: the ids of its rows, its group (a text of it), its links."""
    by_text = defaultdict(list)
    for r in rows:
        if r[1] is not None:
            by_text[r[1]].append(r[0])
    texts = list(by_text)
    sets = [shingle_set(t) for t in texts]
    parent, links = list(range(len(texts))), [0] * len(texts)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    return by_text, {t: texts[find(i)] for i, t in enumerate(texts)}, dict(zip(texts, links))


def near_groups(rows: list[tuple]) -> list[tuple]:
    """``(doc_id, class_id, n_links, copy_of)`` of every row, sorted."""
    key = lambda d: -(2**63) if d is None else d
    by_text, group, links = linked(rows)
    head = {}
    for t, ids in by_text.items():
        head[group[t]] = min([*ids, *([head[group[t]]] if group[t] in head else [])], key=key)
    out = [(d, head[group[t]], links[t], min(ids, key=key)) for t, ids in by_text.items() for d in ids]
    out += [(r[0], r[0], 0, r[0]) for r in rows if r[1] is None]
    return sorted(out, key=lambda r: tuple((v is not None, v or 0) for v in r))


def without_repeats(rows: list[tuple], size: int = 35) -> list[tuple]:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row, sorted."""
    split = [words(r[1]) for r in rows]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for r, w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        left = [x for x, g in zip(w, gone) if not g]
        out.append((r[0], len(w), sum(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def base_counts(text: str | None) -> tuple:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    w = words(text)
    lines = [x for x in (text or "").encode().split(b"\n") if words(x.decode())]
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text: str | None) -> list[tuple]:
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found)


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r))
