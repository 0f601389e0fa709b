"""Operators 1, 3, 5, 7 and 10 and the pipeline against brute-force versions and odd inputs."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodewright.llm import components, golay, mixing, ranking, spaced_seeds, wavelet
from lodewright.llm.queries import queries, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, s int, h int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash with inner ones."""
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, "one", "en", "a", 3), (4, "one two", "en", "b", 7), (4, "one two", "en", "b", 7),
            (5, "word " * 30000, "en", None, 150000), (None, "null id text here", "de", "b", 17), (6, "é ü ß " * 50, "de", "a", 300), (7, "x\x1cy z w", "fr", "c", 7)]
    return spark.createDataFrame([(*r, "q", 1, 2) for r in rows], SCHEMA)


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_golay_code_is_perfect():
    x = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    e = golay._ERRORS
    assert len(set(e.tolist())) == 2048 and max(bin(v).count("1") for v in e.tolist()) == 3
    fixed = x ^ e[golay._syndromes(x)]
    assert not golay._syndromes(fixed).any()
    assert (golay.decode(x) == fixed >> 11).all()
    keys, first = golay.near(x, 23)
    assert set(first.sum(1).tolist()) <= {1, 2, 3, 4, 5, 6}


def test_linked_prints_always_meet():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    ra, ka = golay.bucket_keys(a.view(np.int64), 0)
    rb, kb = golay.bucket_keys(b.view(np.int64), 1)
    left, right = defaultdict(set), defaultdict(set)
    for r, k in zip(ra, ka):
        left[r].add(k)
    for r, k in zip(rb, kb):
        right[r].add(k)
    assert all(left[i] & right[i] for i in range(len(a)))


def test_simhash_components_by_brute_force(spark, sf):
    got = {r.doc_id: (r.fingerprint, r.component_id, r.links) for r in queries()["op10_golay_simhash"](spark, sf).collect()}
    prints = {r.doc_id: simhash(r.text) for r in documents(spark, sf).collect()}
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if bin(prints[a] ^ prints[b]).count("1") <= 3]
    want = roots(ids, pairs)
    distinct = set(prints.values())
    for i in ids:
        links = sum(1 for p in distinct if p != prints[i] and bin(p ^ prints[i]).count("1") <= 3)
        assert got[i] == (f"{prints[i]:016x}", want[i], links)


def test_simhash_odd_rows(spark, odd):
    got = golay.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = {r.doc_id: r.component_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {1: 1, 2: 1}
    assert sorted((r.doc_id for r in golay.one_per_group(odd).collect()), key=str) == [1, 3, 4, 5, 6, 7, None]  # the row without an id has a text of its own
    assert golay.near_duplicates(odd.limit(0)).count() == 0
    assert golay.one_per_group(odd).columns == odd.columns


def test_one_row_of_every_group_with_repeated_ids(spark):
    """Rows of one id with other texts stand in their own groups: every group keeps exactly one row, and the same one each time."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "p"), (4, a, "p"), (4, b, "p"), (4, b, "q"), (4, b, "q"), (7, c, "x"), (7, c, "y"), (7, c, "y"), (None, a, "p"), (None, c + " d", "z"), (None, "", "z"), (None, None, "y"), (9, "  ", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at string")
    kept = [sorted(map(str, golay.one_per_group(d).collect())) for d in (docs, docs.repartition(5), docs.orderBy(F.desc("at")).coalesce(1))]
    assert kept[0] == kept[1] == kept[2]
    got = [(r.doc_id, (r.text or "").strip()[:2]) for r in golay.one_per_group(docs).collect()]
    near = simhash(c + " d") ^ simhash(c)
    assert sorted(got, key=str) == sorted([(1, "a0"), (4, "b0"), (7, "c0"), (9, "")] + ([(None, "c0")] if bin(near).count("1") > 3 else []), key=str)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(10, 60)] + [(7, 7), (None, 3), (200, 100), (200, 100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in [*range(100, 161), 200]}, **{i: 5 for i in [5, *range(10, 60)]}}


def test_ranking_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = queries()["op3_bradley_terry"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    assert right >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert {r.doc_id for r in rows} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}


def test_ranking_odd_rows(spark, odd, sf):
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (6, None), (6, 1)], "doc_id long, quality int")
    model = ranking.train(odd, labels)
    got = ranking.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert ranking.keep_good(odd, model).columns == odd.columns
    nothing = ranking.train(odd, labels.limit(0))
    assert all(r.predicted == 1 for r in ranking.score(odd, nothing).collect())
    assert ranking.score(odd.limit(0), model).count() == 0


def normal(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def agreeing(doc, item):
    """Best number of equal tokens over all alignments that meet the rule."""
    best = 0
    for at in range(-len(item) + 1, len(doc)):
        same = [0 <= at + j < len(doc) and doc[at + j] == w for j, w in enumerate(item)]
        run = max((len(x) for x in "".join("1" if s else "0" for s in same).split("0")), default=0)
        if sum(same) >= 6 and 5 * sum(same) >= 4 * len(item) or run >= spaced_seeds.LEAST_RUN:
            best = max(best, sum(same))
    return best


def test_spaced_seeds_by_brute_force(spark, sf):
    docs = documents(spark, sf).where("n_chars < 2500").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    parsed = [(i.item_id, normal(i.text)) for i in items]
    want = {}
    for d in docs:
        words = normal(d.text)
        have = set(words)
        for k, w in parsed:
            if sum(x in have for x in w) >= min(13, 0.8 * len(w)) and (n := agreeing(words, w)):
                want[d.doc_id, k] = n
    rows = spaced_seeds.overlaps(spark.createDataFrame(docs), spark.createDataFrame(items)).collect()
    assert want and {(r.doc_id, r.item_id): r.matched for r in rows} == want


def test_spaced_seeds_tolerate_substitutions(spark, odd):
    item = [f"tok{i}" for i in range(30)]
    changed = [w if i not in (9, 19, 26) else "other" for i, w in enumerate(item)]
    far = [w if i % 3 else "other" for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, "lead in " + " ".join(changed) + " tail"), (2, " ".join(far)), (3, " ".join(item[:14])), (4, ", ".join(item).upper()), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "a b"), (None, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.matched, r.at) for r in spaced_seeds.overlaps(docs, bench).collect()}
    assert got == {1: (27, 2), 3: (14, 0), 4: (30, 0)}
    assert sorted(r.doc_id for r in spaced_seeds.decontaminated(docs, bench).collect()) == [2, 5]
    assert spaced_seeds.overlaps(odd, bench).count() == 0 and spaced_seeds.overlaps(docs.limit(0), bench).count() == 0
    assert spaced_seeds.decontaminated(odd, bench.limit(0)).count() == odd.count()


def patterns(n, k, rng):
    """Every choice of ``k`` of ``n`` positions if there are few, else some at random and the even ones."""
    import itertools

    if math.comb(n, k) <= 2000:
        return list(itertools.combinations(range(n), k))
    return [tuple(rng.choice(n, k, replace=False)) for _ in range(500)] + [tuple(range(o, n, 5))[:k] for o in range(5)]


def test_every_accepted_pattern_is_hit_by_a_place():
    rng = np.random.default_rng(6)
    for n in range(1, 121):
        at = [{o + x for x in spaced_seeds.MASKS[m]} for m, o in spaced_seeds.places(n)]
        assert at and all(max(p) < n for p in at)
        k = n // 5 if n >= spaced_seeds.LEAST_TOKENS else 0
        for gone in patterns(n, k, rng):
            assert any(not p & set(gone) for p in at), (n, gone)
        if n > 16:
            assert all(any(p <= set(range(a, a + spaced_seeds.LEAST_RUN)) for p in at) for a in range(n - spaced_seeds.LEAST_RUN + 1))


def test_index_has_the_places(spark):
    items = spark.createDataFrame([(n, list(range(n))) for n in range(1, 60)], "i long, g array<long>")
    got = defaultdict(set)
    for r in spaced_seeds.index(items).collect():
        assert r.key is not None
        got[r.i].add((r.mask, r.item_at))
    assert got == {n: set(spaced_seeds.places(n)) for n in range(1, 60)}


@pytest.mark.parametrize("broadcast", [True, False])
def test_all_substitutions_are_found_at_any_length(spark, monkeypatch, broadcast):
    """Items of 1 to 40 tokens with as many substitutions as the rule allows, and with one more."""
    if not broadcast:
        monkeypatch.setattr(spaced_seeds, "BROADCAST_KEYS", 0)
    rng = np.random.default_rng(7)
    items, docs, want = [], [], set()
    for n in range(1, 41):
        item = [f"n{n}t{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        k = n - max(min(n, 6), -(-4 * n // 5))
        for extra in (0, 1):
            for _ in range(6):
                gone = set(rng.choice(n, min(n, k + extra), replace=False).tolist())
                words = ["x"] * int(rng.integers(0, 3)) + [w if i not in gone else "other" for i, w in enumerate(item)] + ["y"] * int(rng.integers(0, 3))
                docs.append((len(docs), " ".join(words)))
                if agreeing(words, item) or n < 6 and not gone:
                    want.add((len(docs) - 1, n))
                assert extra or (len(docs) - 1, n) in want
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in spaced_seeds.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == want


def test_repeated_ids_with_other_texts_are_all_sought(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    bench = spark.createDataFrame([(1, one), (1, two), (1, one)], "item_id long, text string")
    docs = spark.createDataFrame([(5, "nothing here"), (5, two), (6, one), (6, one), (7, one + " " + two)], "doc_id long, text string")
    for rows in (spaced_seeds.overlaps(docs, bench), spaced_seeds.overlaps(docs.repartition(5), bench.repartition(3))):
        assert sorted((r.doc_id, r.item_id, r.matched, r.item_tokens, r.at) for r in rows.collect()) == [(5, 1, 20, 20, 0), (6, 1, 20, 20, 0), (7, 1, 20, 20, 0)]


def test_mix_meets_targets(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows, again = (queries()["op5_mix"](spark, sf).collect() for _ in range(2))
    assert sorted(rows) == sorted(again)
    docs = {r.doc_id: r for r in documents(spark, sf).collect()}
    assert len(rows) == len(docs)
    per, target, size = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == len(WORD.findall(docs[r.doc_id].text or "")) and 0 <= r.taken <= 3 * r.size
        per[s] += r.taken
        size[s] += r.size
        target[s] = r.target
    order = sorted(size)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    share = sum(size.values()) / sum(weight.values())
    if all(share * weight[s] <= 3 * size[s] for s in order):
        assert all(math.isclose(target[s], share * weight[s]) for s in order)
    assert math.isclose(sum(target.values()), sum(size.values()))
    assert all(abs(per[s] - target[s]) <= 0.01 * target[s] + 100 for s in order)


def test_targets_stop_and_reshare():
    got = mixing.targets({"a": 1000, "b": 10, None: 100})
    assert got["b"] == 30 and got[None] == 300 and math.isclose(got["a"], 780)


def test_schedule_is_even(spark):
    rows = mixing.schedule(spark, [500, 1000, 2500]).orderBy("slot").collect()
    seen = defaultdict(int)
    for r in rows:
        assert r.rank == seen[r.s]
        seen[r.s] += 1
        if r.slot < 3900:
            for s, w in enumerate((1, 2, 5)):
                assert abs(seen[s] - (r.slot + 1) * w / 8) < 4
    assert seen == {0: 500, 1: 1000, 2: 2500}
    rows = mixing.schedule(spark, [1, 3, 9000, 0]).collect()
    assert sorted((r.s, r.rank) for r in rows) == [(0, 0), *((1, k) for k in range(3)), *((2, k) for k in range(9000))]
    assert len({r.slot for r in rows}) == len(rows)


def signed_order(spark, docs, seed=42):
    return {(r.doc_id, r.text, r.source): r.h for r in docs.select("doc_id", "text", "source", mixing.order_of(F.col("doc_id"), F.col("text"), seed).alias("h")).collect()}


@pytest.mark.parametrize("block", [1, 64, 1024])
def test_mix_by_brute_force_schedule(spark, sf, monkeypatch, block):
    """Streams, blocks, slots and pieces recomputed one by one."""
    monkeypatch.setattr(mixing, "BLOCK", block)
    docs = documents(spark, sf).where("n_chars < 1500")
    rows, h = docs.collect(), signed_order(spark, docs)
    size = {r: len(WORD.findall(r.text or "")) for r in rows}
    per = defaultdict(int)
    for r in rows:
        per[r.source] += size[r]
    names = sorted(per, key=lambda s: (s is None, s or ""))
    want = {s: round(t) for s, t in mixing.targets(per).items()}
    blocks = [-(-want[s] // block) for s in names]
    edges, slots, seen = np.cumsum(blocks)[:-1] / sum(blocks), [], defaultdict(int)
    for n in range(sum(blocks)):
        s = int((edges <= n * mixing.PHI - math.floor(n * mixing.PHI)).sum())
        if seen[s] < blocks[s]:
            slots.append((n, s, seen[s]))
        seen[s] += 1
    late = sorted((k, s) for s, n in enumerate(blocks) for k in range(seen[s], n))
    slots += [(sum(blocks) + i, s, k) for i, (k, s) in enumerate(late)]
    taken, stream = defaultdict(int), {}
    for s in names:
        stream[s] = [(r.doc_id, w) for r in sorted((r for r in rows if r.source == s and size[r]), key=lambda r: (h[r.doc_id, r.text, r.source], r.doc_id)) for w in range(size[r])]
    mix = []
    for n, s, k in slots:
        name = names[s]
        for x in range(k * block, min((k + 1) * block, want[name])):
            doc, w = stream[name][x % len(stream[name])]
            taken[doc] += 1
            mix.append((n, doc, w))
    mixed = mixing.mixed(docs).collect()
    assert {r.doc_id: r.taken for r in mixed} == {r.doc_id: taken[r.doc_id] for r in rows}
    at = defaultdict(list)
    for n, doc, _ in mix:
        at[doc].append(n)
    assert {r.doc_id: (r.first_slot, r.last_slot) for r in mixed} == {r.doc_id: (min(at[r.doc_id]), max(at[r.doc_id])) if at[r.doc_id] else (None, None) for r in rows}
    got = [(r.slot, r.doc_id, r.first + i) for r in mixing.pieces(docs).collect() for i in range(r.words)]
    assert sorted(got) == sorted(mix)


def test_mix_odd_rows(spark, odd):
    rows = mixing.mixed(odd).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: (r.size, r.taken) for r in rows if r.doc_id in (1, 2)} == {1: (0, 0), 2: (0, 0)}
    assert all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mixed(odd.limit(0)).count() == 0 and mixing.pieces(odd.limit(0)).count() == 0 and mixing.remixed(odd.limit(0)).count() == 0
    assert mixing.mixed(odd.where("doc_id < 3")).count() == 2
    clash = odd.withColumns({c: F.lit(1) for c in ("_id", "_n", "_c", "d", "n", "cut", "row", "size", "rank", "group", "before", "slot", "pass", "p")})
    assert mixing.remixed(clash).columns == clash.columns and mixing.remixed(clash).count() == mixing.remixed(odd).count()


def test_mixed_documents_stand_in_slot_order(spark, sf, monkeypatch):
    """The files' order is the schedule's: a copy stands where its reading begins, and sources alternate by weight."""
    monkeypatch.setattr(mixing, "BLOCK", 64)
    docs = documents(spark, sf)
    begins = defaultdict(dict)
    _, met, _ = mixing._mix(docs, "doc_id", "text", "source", mixing.WEIGHTS, 42)
    for r in met.collect():
        begins[r.doc_id][r["pass"]] = min(r.slot, begins[r.doc_id].get(r["pass"], r.slot))
    got = [r.doc_id for part in mixing.remixed(docs).rdd.glom().collect() for r in part]
    seen, slots = defaultdict(int), []
    for doc in got:
        slots.append(begins[doc][seen[doc]])
        seen[doc] += 1
    assert slots == sorted(slots) and len(set(slots)) > 50


def test_mix_lays_out_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LAID_OUT", 7)
    monkeypatch.setattr(mixing, "BLOCK", 16)
    docs = spark.createDataFrame([(1, "a b c", "x")] * 100 + [(i, "d e f g", "x") for i in range(2, 30)] + [(50, "one two", "y")], "doc_id long, text string, source string")
    rows = mixing.mixed(docs).collect()
    assert len(rows) == 129
    per = defaultdict(int)
    for r in rows:
        per[r.source] += r.taken
    assert per == {"x": round(next(r.target for r in rows if r.source == "x")), "y": 6}
    whole = [r.taken for r in rows if r.doc_id == 1]
    assert len(whole) == 100 and sum(t % 3 > 0 for t in whole) <= 1


def test_mix_of_repeated_rows_and_ties(spark):
    """Rows of one id with other texts, and equal rows: the parts do not depend on how the rows lie."""
    rows = [(1, "a b c d", "x"), (1, "a b", "x"), (1, "a b", "x"), (2, "a b c d", "x"), (2, "q", "y"), (2, "q", "y"), (None, "r s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    parts = [sorted(map(str, mixing.mixed(d).drop("h").collect())) for d in (docs, docs.repartition(5), docs.orderBy(F.desc("text")).coalesce(1))]
    assert parts[0] == parts[1] == parts[2]


def test_tokens_by_brute_force(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    start = 0
    got = {r.doc_id: r for r in queries()["op1_wavelet_tokens"](spark, sf).collect()}
    for d in documents(spark, sf).orderBy("doc_id").collect():
        ids = tok.encode(d.text or "", add_special_tokens=False).ids + [2]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_tokens_odd_rows(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = sorted(wavelet.digest(spark, wavelet.write_shards(odd, tokenizer_path())).collect(), key=lambda r: r.start)
    docs = sorted(odd.withColumn("x", F.xxhash64("text")).collect(), key=lambda d: (d.doc_id is not None, d.doc_id or 0, d.x, d.text or ""))
    start = 0
    for r, d in zip(rows, docs, strict=True):
        ids = tok.encode(d.text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert wavelet.digest(spark, wavelet.write_shards(odd.limit(0), tokenizer_path())).count() == 0


@pytest.mark.parametrize("n,top", [(0, 1), (1, 9), (200_000, 300), (70_000, 90_000)])
def test_wavelet_rank_select(n, top):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, top, n) ** 2 // max(top, 1)).astype("<u4")
    s = wavelet.Shard(wavelet.build(ids, np.array([n // 2, n])))
    assert (s.tokens() == ids).all() and len(s.tokens()) == n
    for i in rng.integers(0, n, 20) if n else []:
        t = int(ids[i])
        where = np.flatnonzero(ids == t)
        assert s.access(int(i)) == t
        assert s.count(t) == len(where) and s.count(t, n // 3, n // 2) == ((where >= n // 3) & (where < n // 2)).sum()
        k = int(rng.integers(0, len(where)))
        assert s.occurrence(t, k) == where[k]
    assert s.count(10**7) == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as c

    docs = documents(spark, sf)
    good = c.quality(spark, docs, sf)
    predicted = {r.doc_id for r in queries()["op3_bradley_terry"](spark, sf).collect() if r.predicted}
    assert {r.doc_id for r in good.collect()} == predicted
    apart = c.near_copies(spark, docs, sf)
    groups = queries()["op10_golay_simhash"](spark, sf).collect()
    assert {r.doc_id for r in apart.collect()} == {r.component_id for r in groups}
    clean = c.leaks(spark, docs, sf)
    leaked = {r.doc_id for r in queries()["op7_spaced_seeds"](spark, sf).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - leaked
    mixed = c.mix(spark, docs, sf)
    want = {r.doc_id: (2 * r.taken + r.size) // (2 * r.size) for r in queries()["op5_mix"](spark, sf).collect() if r.size}  # whole documents
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert all(x.columns == docs.columns for x in (good, apart, clean, mixed))
    assert c.run(spark, sf).agg(F.max("start")).first()[0] > 0


def test_words_taken_apart_keep_their_ids():
    from tokenizers import Tokenizer

    whole, enc = Tokenizer.from_file(tokenizer_path()), wavelet.Encoder(tokenizer_path())
    enc.MOST = 8
    assert enc.apart
    texts = ["<|endoftext|>. x<|startoftext|>, <a>. b<c,", "It's, IT'S. o'clock's' 'S a'.'s ,'s 's, ' 'été l'été", "ẖ H̱. É, é. ä̸. İI. ǅ Σας, ΣΑΣ.", "a b. c , 1,2.3. 5%%%", "\x00a\x01. \x1c. 😀!! ...", "a b c a b c A B. c", ""]
    for text in texts * 2:
        assert np.frombuffer(enc.texts([text.encode()])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
    chars = list("abzTSdmlveré'’ß.,;<>=|!-_ \t\n\x0b\x1c\x85 İıªºµĸŉДя1²½٣é̸̈ǅΣσς😀中가가ᄀ' ' '")
    rng = np.random.default_rng(4)
    for _ in range(4000):
        text = "".join(rng.choice(chars, rng.integers(0, 30)))
        assert np.frombuffer(enc.texts([text.encode()])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_any_other_tokenizer_gets_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(tokenizer_path(), encoding="utf-8"))
    spec["normalizer"]["normalizers"].append({"type": "Replace", "pattern": {"String": "a b"}, "content": "c"})
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    whole, enc = Tokenizer.from_file(str(tmp_path / "t.json")), wavelet.Encoder(str(tmp_path / "t.json"))
    assert not enc.apart
    for text in ("a b, a b. c", "", "Été a b"):
        assert np.frombuffer(enc.texts([text.encode()])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_shards_answer_without_decoding(spark, sf):
    from collections import Counter

    path = wavelet.write_shards(documents(spark, sf), tokenizer_path(), partitions=5)
    shards = wavelet.read_shards(spark, path).orderBy("shard").collect()
    ids = np.concatenate([wavelet.Shard(bytes(r.payload)).tokens() for r in shards]).tolist()
    most = [t for t, _ in Counter(ids).most_common(5)] + [2, 49_000]
    assert {r.token: r.n for r in wavelet.counts(spark, path, most).collect()} == {t: ids.count(t) for t in set(most)}
    where = np.flatnonzero(np.array(ids) == most[0]).tolist()
    asked = [(most[0], k) for k in (0, 7, len(where) // 2, len(where) - 1, len(where))]
    assert {(r.k, r.position) for r in wavelet.occurrences(spark, path, asked).collect()} == {(k, where[k]) for _, k in asked[:-1]}
    at = [0, len(ids) // 3, len(ids) - 1, len(ids)]
    assert {(r.position, r.token) for r in wavelet.tokens_at(spark, path, at).collect()} == {(i, ids[i]) for i in at[:-1]}


def test_mix_meets_targets_of_small_sources_beside_a_huge_one(spark):
    huge = spark.range(16).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 1_000_000).alias("text"), F.lit("huge").alias("source"))
    small = spark.createDataFrame([(100 + 10 * k + i, "w " * (n // 10), f"s{n}") for k, n in enumerate((300, 1000, 3000)) for i in range(10)], "doc_id long, text string, source string")
    rows = mixing.mixed(huge.union(small)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert {r.source: r.taken for r in rows if r.source != "huge"} == {"s300": 900, "s1000": 3000, "s3000": 9000}
    assert all(abs(r.taken - r.target) <= 0.5 for r in rows)


def slow_features(text):
    """The ranker's features, one text at a time."""
    raw = (text or "").encode()
    low = re.sub(b"[A-Z]", lambda m: m[0].lower(), raw)
    words = raw.split()
    if not words:
        return [0.0] * len(ranking.FEATURES)
    keys = low.split()
    chars = max(1, sum(map(len, words)))
    n = len(words)
    later = lambda xs: len(xs) - len(set(xs))
    lines = [x for x in raw.split(b"\n") if x]
    inside = b"".join(words)
    count = lambda s: sum(inside.count(bytes([c])) for c in s)
    return [
        math.log1p(n), count(range(65, 91)) / chars, count(b"#*$%&<>{}[]\\^~=_@") / chars, count(b"!?") / n, count(b"0123456789") / chars, count(range(128, 256)) / chars,
        len(inside.decode()) / n / 10, sum(w[-1:] in (b".", b",", b";", b":") for w in words) / n, 1 - later(keys) / n, later(list(zip(keys, keys[1:]))) / n,
        later(list(zip(keys, keys[1:], keys[2:]))) / n, sum(a == b for a, b in zip(keys, keys[1:])) / n, later(lines) / max(1, len(lines)), len(lines) / n,
        sum(65 <= w[0] <= 90 for w in words) / n, count(b"|") / n,
    ]


def test_ranking_by_brute_force(spark, sf):
    """Scores recomputed text by text from the model; the fitted weights lower the pairs' loss and stand near its minimum."""
    docs = documents(spark, sf)
    model = ranking.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r.score for r in ranking.score(docs, model).collect()}
    for d in docs.collect():
        x = np.array(slow_features(d.text))
        z = np.clip((x - model.mean) / model.spread, -6, 6)
        bent = [*z, *(max(0.0, v - k) if k > 0 else max(0.0, k - v) for k in ranking.KNOTS for v in z)]
        s = (sum(a * b for a, b in zip(bent, model.weights)) - model.threshold) / model.scale
        assert math.isclose(got[d.doc_id], 1 / (1 + math.exp(-max(-30, min(30, s)))), abs_tol=1e-6), d.doc_id
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(slow_features(d.text), label[d.doc_id]) for d in docs.collect() if d.doc_id in label]
    b = ranking.basis((np.array([x for x, _ in rows]) - model.mean) / model.spread)
    good, bad = (b[[i for i, (_, y) in enumerate(rows) if y == v]] for v in (1, 0))
    diff = (good[:, None] - bad[None]).reshape(-1, b.shape[1])
    loss = lambda w: np.logaddexp(0, -diff @ w).mean() + 5e-4 * w @ w
    best = model.weights.copy()
    for _ in range(300):
        best -= 0.05 * (-(diff * (1 / (1 + np.exp(np.clip(diff @ best, -30, 30))))[:, None]).mean(0) + 1e-3 * best)
    assert loss(model.weights) < 0.2 * loss(np.zeros_like(best)) and loss(model.weights) < loss(best) + 0.05


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_rows(spark, odd, sf, tmp_path, empty):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables go through every stage."""
    import corpus_pipeline as c

    (odd.limit(0) if empty else odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (5, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").limit(0 if empty else 3).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "null id text here and more"), (None, "x"), (2, None)], "item_id long, text string").limit(0 if empty else 3).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in c.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    rows = c.run(spark, str(tmp_path)).collect()
    assert all(r.n_tokens >= 1 for r in rows) and (not rows) == empty
