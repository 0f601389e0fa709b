"""Operators 11 to 13 against brute-force versions and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lodewright.llm import passages, prefix_tree, tries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_words(rows):
    """Every window against the smallest id it starts in."""
    least = {}
    for i, text in rows:
        words = WORD.findall(text or "")
        for p in range(len(words) - 49):
            w = tuple(words[p : p + 50])
            if i is not None:
                least[w] = min(least.get(w, i), i)
    out = []
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for p in range(len(words) - 49):
            first = least.get(tuple(words[p : p + 50]))
            if first is not None and (i is None or first < i):
                gone |= set(range(p, p + 50))
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: [word() for _ in range(n)]
    shared, line, long = text(80), text(30), text(400)
    rows = []
    for i in range(60):
        body = text(rng.randint(0, 120))
        if i % 3 == 0:
            a, b = rng.randint(0, 25), rng.randint(60, 80)
            body = body[:40] + shared[a:b] + body[40:]
        if i % 4 == 0:
            body = line + body + line
        if i % 10 == 0:  # near copies
            body = list(long)
            for _ in range(i // 20):
                body[rng.randrange(400)] = word()
        rows.append((1000 - i if i % 2 else i, rng.choice([" ", "  ", "\n", "\t "]).join(body)))
    rows += [(200, None), (201, ""), (202, "word " * 700), (203, "x " + "word " * 300), (204, "word " * 49), (3, " ".join(long)), (3, " ".join(long)), (3, "another text " * 40),
             (None, " ".join(shared)), (None, "free " * 60), (None, "free " * 60), (205, "a\x1cb \x85c " * 40), (206, "a\x1cb \x85c " * 41), (207, "\x0b".join(long[:50])), (208, " ".join(long[1:50]))]
    return rows


@pytest.mark.parametrize("most", [passages.MOST_BROADCAST, 0])
def test_passages_by_brute_force(spark, planted, most, monkeypatch):
    monkeypatch.setattr(passages, "SHARD", 4000)
    docs = spark.createDataFrame([(*r, 1, "x") for r in planted], "doc_id long, text string, first int, anchors string")
    got = passages.without_repeats(docs, most_broadcast=most)
    rows = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()]
    assert sorted(rows, key=repr) == kept_words(planted)
    assert sum(r[2] > 0 for r in rows) > 20


def test_kept_text_is_what_the_hash_says(spark, planted):
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    got = [r for r in passages.without_repeats(docs).collect() if r.kept is not None]
    assert got and all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_equal_windows_have_equal_anchors():
    import numpy as np

    rng = np.random.default_rng(3)
    words = [b"%d" % x for x in rng.integers(0, 50, 300)]
    text = b" ".join(words + words[100:200])
    p = passages._Piece(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    of = defaultdict(set)
    for s, a, h, place in zip(p.start, p.anchor, p.hash, p.place - p.start):
        of[int(h)].add((int(a), int(place)))
    assert all(len(x) == 1 for x in of.values()) and len(of) < len(p.start)


def test_no_documents_no_passages(spark):
    assert passages.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


CUT = re.compile(r"[.,;:!?\x0A-\x0D]")


def best_phrases(rows, least, top, depth=5):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in CUT.split(low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, depth + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        found, every = [], [(p, a) for p, a in counts.items() if a >= least and len(p) > 1]
        for p, a in every:
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in every):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("bits", [tries.MOST_BITS, 1 << 16])
def test_collocations_by_brute_force(spark, monkeypatch, bits):
    """Small shards and ranges, so that nodes are cut by range edges; with small filters too."""
    monkeypatch.setattr(tries, "RANGE", 300)
    monkeypatch.setattr(tries, "MOST_BITS", bits)
    rng = random.Random(11)
    vocabulary = ["of", "The", "é", "über", "new", "York", "a", "b", "aa", "a\x01", "in", "x" * 40, "to", "be"]
    rows = []
    for i in range(160):
        words = rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randint(0, 60))
        for _ in range(3):
            words[rng.randint(0, len(words)) : 0] = rng.choice([["new", "york", "city"], ["to", "be", "or", "not", "to", "be"], ["A", "a", "a", "a", "a", "a"]])
        rows.append((rng.choice(["en", "en", None, "", "de"]), "".join(w + rng.choice([" ", " ", " ", " \t", ", ", "\n", ".", "\x0b"]) for w in words)))
    rows += [("en", None), (None, ""), ("fr", "..., !"), ("und", "new york city " * 20), ("long", "big data " * 5000)] + [rows[0]] * 3
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, n int, a int")
    got = tries.collocations(docs, top=40, least=12, shard=3000)
    assert sorted(tuple(r) for r in got.collect()) == best_phrases(rows, 12, 40)


def test_scores_beyond_64_bits(spark):
    """a * 1000 * n and l * r as whole numbers of more than 64 bits."""
    a, n = 9_000_000_000_001, 14_999_999_999_999
    one = spark.range(1).selectExpr(f"{a}L AS a", f"{n}L AS n", "9100000000003L AS l", "9200000000007L AS r")
    big = one.selectExpr("(CAST(a * 1000 AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS s").first().s
    assert big == 1000 * a * n // (9100000000003 * 9200000000007)


def test_no_documents_no_phrases(spark):
    assert tries.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert tries.collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0


def tree(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    every = {}
    for c in plain:
        h = zlib.crc32(str(c).encode()) % 6
        every[c] = plain.get(c - c % 100, [])[:h] + plain[c][h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in every.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, x in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(x) - 1) * len(k[-1][1]) if k else 0
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(x), len(k), min(members[k[:-1]]) if k else -1, len(x), children[k], leaves[k], saved[k], sha(k)) for k, x in members.items())


def test_prefix_tree_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_tree, "IDS", 7)
    rng, rows = random.Random(5), []
    say = ["hi", "é", "", "ok", None]
    for c in [*range(0, 40), *range(100, 160), *range(305, 330), 999, 1234, *range(500, 540)]:
        n = rng.choice([1, 2, 3, 6, 8])
        if c >= 500 and c < 540:
            rows += [(c, t, "user", "same") for t in range(7)]  # one group of equal conversations
            continue
        for t in range(n):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(say)))
    rows += [(700, t, "user", "deep") for t in range(300)] + [(701, t, "user", "deep") for t in range(290)] + [(702, t, "user", "deep") for t in range(299)]
    rows += [(None, 0, "user", "nobody"), (800, 1, "a", "b"), (800, 1, "a", "b")]
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, digest string")
    got = [tuple(-1 if v is None else v for v in r) for r in prefix_tree.prefix_tree(turns).collect()]
    assert sorted(got) == tree(rows)


def test_no_turns_no_tree(spark):
    assert prefix_tree.prefix_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
