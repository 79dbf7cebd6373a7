"""SimHash near-duplicates, decontamination and mixing against brute force."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from .conftest import frame, prose

WORD = r"[^\x20\x09-\x0D]+"


# -- SimHash ---------------------------------------------------------------------------

def slow_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORD, lower)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(fps, max_bits):
    """Class of each position: the smallest position reachable."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aB \t\n\x0b\x1c\x85é　", max_size=60))
def test_fingerprint_of_any_text(text):
    from storelens.llm import simhash
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("max_bits,n,flips", [(4, 300, 3), (3, 500, 2), (4, 700, 5), (0, 60, 1), (6, 200, 6)])
def test_trie_join_against_all_pairs(max_bits, n, flips):
    from storelens.llm import simhash
    r = random.Random(n)
    centres = [r.getrandbits(64) for _ in range(12)]
    fps = set()
    while len(fps) < n:
        x = r.choice(centres) if r.random() < 0.8 else r.getrandbits(64)
        for _ in range(r.randrange(flips + 1)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    fps = list(fps)
    got = simhash.trie_join(np.array(fps, dtype=np.uint64), np.zeros(n, int), np.zeros(n, int), max_bits)
    want = slow_classes(fps, max_bits)
    assert len(set(zip(got.tolist(), want, strict=True))) == len(set(want)) == len(set(got.tolist()))


def test_trie_join_groups_and_sides(monkeypatch):
    """Two tries meet across sides only; groups don't meet; small frontiers."""
    from storelens.llm import simhash
    monkeypatch.setattr(simhash, "FRONTIER", 7)
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 1)
    r = random.Random(4)
    fps = [r.getrandbits(8) | r.getrandbits(3) << 50 for _ in range(160)]
    group = [i % 3 for i in range(160)]
    side = [(i // 3) % 2 if i % 3 else 0 for i in range(160)]
    got = simhash.trie_join(np.array(fps, dtype=np.uint64), np.array(group), np.array(side), 2)
    links = [(i, j) for i in range(160) for j in range(i) if group[i] == group[j]
             and (fps[i] ^ fps[j]).bit_count() <= 2 and (group[i] == 0 or side[i] != side[j])]
    for i, j in links:
        assert got[i] == got[j]
    for i in range(160):
        assert group[got[i]] == group[i]


def slow_near_duplicates(rows):
    fps = [slow_fingerprint(t) for _, t, *_ in rows]
    classes = slow_classes(fps, 4)
    least = defaultdict(lambda: None)
    for (i, *_), c in zip(rows, classes, strict=True):
        if i is not None:
            least[c] = i if least[c] is None else min(least[c], i)
    return sorted((repr(i), f"{f:016x}", repr(least[c])) for (i, *_), f, c in zip(rows, fps, classes, strict=True))


def test_near_duplicates_against_brute_force(spark, edge_rows, monkeypatch):
    from storelens.llm import simhash
    monkeypatch.setattr(simhash, "CHUNK", 8)  # hot values are cut, in pairs of chunks
    rows = list(edge_rows)
    base = prose(400, 77).split()
    for i in range(60):  # a large group of near copies
        words = list(base)
        words[i % 400] = f"w{i}"
        rows.append((1000 + i, " ".join(words), "en", "s", 1))
    rows += [(2000 + i, prose(60, i), "en", "s", 1) for i in range(40)]
    rows += [(3000 + i, "copy of a text", "en", "s", 1) for i in range(30)]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == slow_near_duplicates(rows)


def test_near_duplicates_empty_and_nameless(spark):
    from storelens.llm import simhash
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    got = simhash.near_duplicates(frame(spark, [(None, "a b c d e", "en", "s", 1), (None, "v w x y z", "en", "s", 1)]))
    assert [r.component_id for r in got.collect()] == [None, None]


def test_blocks_grow_with_the_count():
    from storelens.llm import simhash
    for count in (0, 10, 10 ** 5, 10 ** 8, 10 ** 11):
        blocks, choices = simhash._blocks(count, 4)
        assert all(len(c) == blocks - 4 for c in choices)
    assert simhash._blocks(10, 4)[0] == 5 and simhash._blocks(10 ** 9, 4)[0] == 6


def test_components_of_a_chain_and_a_star(spark):
    from storelens.llm import simhash
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(500, 500)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(2, 41)) and all(got[i] == 100 for i in range(101, 160)) and 500 not in got


# -- decontamination --------------------------------------------------------------------

def bench_rows(n=30):
    return [(i, prose(25 + i, 5000 + i) + f" unique{i} answer{i}") for i in range(n)]


def paraphrase(text, seed):
    r = random.Random(seed)
    words = text.split()
    for _ in range(len(words) // 8):
        words[r.randrange(len(words) - 6)] = "changed"
    words.insert(5, "inserted")
    return " ".join(words)


@pytest.fixture(scope="module")
def contaminated(spark):
    bench = bench_rows()
    rows = [(i, prose(r, i), "en", "s", 1) for i, r in enumerate([5, 40, 90, 300, 1000] * 12)]
    truth = set()
    for i, text in bench:
        rows.append((1000 + i, prose(i * 9, 70 + i) + " " + text.upper() + ", " + prose(33, i), "en", "s", 1))
        rows.append((2000 + i, prose(50, 90 + i) + "\n" + paraphrase(text, i) + "\n" + prose(60, i), "en", "s", 1))
        truth |= {(1000 + i, i), (2000 + i, i)}
    return bench, rows, truth


def test_decontamination_finds_copies_and_paraphrases(spark, contaminated):
    from storelens.llm import decontam
    bench, rows, truth = contaminated
    b = spark.createDataFrame(bench, "item_id long, text string")
    found = decontam.search(frame(spark, rows), b).collect()
    assert {(r.doc_id, x.item) for r in found for x in r.leaks} == truth


def test_decontamination_in_blocks_gives_the_same(spark, contaminated):
    from storelens.llm import decontam
    bench, rows, truth = contaminated
    b = spark.createDataFrame(bench, "item_id long, text string")
    found = decontam.search(frame(spark, rows[:20] + rows[60:]), b, params=decontam.DecontamParams(block=7)).collect()
    assert {(r.doc_id, x.item) for r in found for x in r.leaks} == truth


def test_blocks_give_one_row_a_document(spark, contaminated):
    from storelens.llm import decontam
    bench, rows, _ = contaminated
    both = (5000, " ".join([prose(40, 1), bench[2][1], prose(40, 2), bench[25][1], prose(40, 3), bench[11][1]]), "en", "s", 1)
    docs = frame(spark, rows[60:70] + [both, both, (None, *both[1:])])
    b = spark.createDataFrame([*bench, (None, bench[2][1])], "item_id long, text string")

    def told(p):
        return Counter((r.doc_id, tuple((x.item, x.parts, round(x.cosine, 4), round(x.lcs, 6)) for x in r.leaks))
                       for r in decontam.search(docs, b, params=p).collect())

    whole = told(decontam.DecontamParams())
    assert sum(whole.values()) == 13 and [x[0] for i, leaks in whole if i == 5000 for x in leaks] == [None, 2, 11, 25]
    assert told(decontam.DecontamParams(block=7)) == whole


def test_part_of_a_long_item(spark):
    """A long run of an item is a leak, whatever its share of the item; scattered passages are not."""
    from storelens.llm import decontam
    r = random.Random(4)
    item = syllables(r, 320)
    texts = [item[64:192], item[96:128], item[:32] + syllables(r, 80) + item[160:192]]
    rows = [(i, " ".join(syllables(r, 60) + t + syllables(r, 60)), "en", "s", 1) for i, t in enumerate(texts)]
    found = decontam.search(frame(spark, rows, clash=False),
                            spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(x.doc_id, [(y.item, y.parts) for y in x.leaks]) for x in found] == [(0, [(7, 4)])]


def test_retrieval_recall_against_brute_force(spark, contaminated):
    """Windows that pass the word checks are found by the latent search."""
    from storelens.llm import decontam
    bench, rows, truth = contaminated
    p = decontam.DecontamParams(rank=24)  # fewer dimensions than items
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, x.item) for r in decontam.search(frame(spark, rows), b, params=p, cut=False).collect()
           for x in r.leaks}
    assert len(got & truth) / len(truth) >= 0.9


def syllables(r, n):
    """Words of a vocabulary of some thousands, the first ones common."""
    return ["".join("bcdfghklmnprstvz"[int(c, 16)] + "aeio"[int(c, 16) % 4] for c in f"{int(4000 * r.random() ** 3):03x}")
            for _ in range(n)]


@pytest.fixture(scope="module")
def large_benchmark():
    """Some thousands of items, and texts that hold one each with a fifth of its words changed."""
    r = random.Random(17)
    bench = [(i, " ".join(syllables(r, r.randrange(12, 32)))) for i in range(2500)]
    rows = []
    for i in range(0, 2500, 25):
        words = bench[i][1].split()
        for at in r.sample(range(len(words) - 5), len(words) // 5):
            words[at] = "changed"
        k = r.randrange(150)
        rows.append((i, " ".join([*syllables(r, k), *words, *syllables(r, 150 - k)]), "en", "s", 1))
    return bench, rows


def test_large_benchmark_against_brute_force(spark, large_benchmark):
    """Every planted copy that a comparison with all items reports is found."""
    from storelens.llm import decontam
    bench, rows = large_benchmark
    want = set()
    for i, text, *_ in rows:
        words, item = decontam.words_of(text.encode()), decontam.words_of(bench[i][1].encode())
        if decontam.lcs_length(item, words) >= 0.6 * len(item):
            want.add((i, i))
    b = spark.createDataFrame(bench, "item_id long, text string")
    found = decontam.search(frame(spark, rows, clash=False), b).collect()
    got = {(r.doc_id, x.item) for r in found for x in r.leaks}
    assert len(want) == 100 and want <= got and len(got) < 110


def test_index_misses_no_window(large_benchmark):
    """Windows that pass the word comparison come from the index alone, without any cosine."""
    from storelens.llm import decontam
    bench, rows = large_benchmark
    p = decontam.DecontamParams()
    items = [decontam.words_of(t.encode()) for _, t in bench[:300]] + [[b"ba"] * 9 + [b"co"]]
    docs = [decontam.words_of(t.encode()) for _, t, *_ in rows[:12]] + [[b"ba", b"da"] * 20 + [b"co"]]
    known = np.unique(np.concatenate([decontam._buckets(w, p.bits) for w in items]))
    place = np.full(1 << p.bits, -1, dtype=np.int32)
    place[known] = np.arange(len(known))
    space = decontam.Space(place, np.zeros((len(known), 1), dtype=np.float32), np.linspace(1, 3, len(known)))
    got = {(d, start // p.stride, i) for d, start, _, i, _ in
           decontam._indexed(docs, space, decontam._index(items, space, p), p)}
    want = {(d, k, i) for d, doc in enumerate(docs) for k in range(-(-len(doc) // 32)) for i, own in enumerate(items)
            if decontam.lcs_length(own, doc[max(0, 32 * k - 16):32 * k + 80]) >= 0.6 * len(own)}
    assert len(want) >= 12 and want <= got


def test_svd_against_numpy(spark, contaminated):
    from storelens.llm import decontam
    bench, _, _ = contaminated
    p = decontam.DecontamParams(rank=10, oversample=20, power=2)
    parts = decontam.passages(spark.createDataFrame(bench, "item_id long, text string"), params=p)
    words = [[bytes(w) for w in r.words] for r in parts.collect()]
    known = np.unique(np.concatenate([decontam._buckets(w, p.bits) for w in words]))
    place = np.full(1 << p.bits, -1, dtype=np.int32)
    place[known] = np.arange(len(known))
    idf = np.linspace(1, 3, len(known))
    v = decontam.svd(parts, place, idf, p)
    a = np.zeros((len(words), len(known)))
    for i, w in enumerate(words):
        at, x = decontam._weighted(w, place, idf, p.bits)
        a[i, at] = x
    exact = np.linalg.svd(a)[1][:10]
    assert np.allclose(np.sort(np.linalg.norm(a @ v, axis=0))[::-1], exact, rtol=0.05)
    assert np.allclose(v.T @ v, np.eye(10), atol=1e-8)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=14))
def test_lcs_against_table(a, b):
    from storelens.llm import decontam
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert decontam.lcs_length(a, b) == table[-1][-1]


def test_decontamination_ignores_case_of_any_letter(spark):
    from storelens.llm import decontam
    item = " ".join(f"é{w}ñ" for w in prose(30, 9).split())
    docs = frame(spark, [(1, prose(50, 1) + " " + item.upper() + ". " + prose(50, 2), "fr", "s", 1), (2, prose(80, 3), "fr", "s", 1)])
    found = decontam.search(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, [x.item for x in r.leaks]) for r in found] == [(1, [7])]


def test_words_of_any_script(spark):
    from storelens.llm import decontam
    told = lambda t: [w.decode() for w in decontam.words_of(t.encode())]
    assert told("\u201cÉté\u201d\u2014l\u2019eau\u2026 a_b\u00a0x1") == ["été", "l", "eau", "a", "b", "x1"]
    assert told("日本語のtext、東京。") == ["日", "本", "語", "の", "text", "東", "京"]
    assert told("हिन्दी में e\u0301t") == ["हिन्दी", "में", "e\u0301t"]
    r = random.Random(6)
    han = lambda n: "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n))
    item = han(40)
    rows = [(1, han(90) + item[:20] + "，" + item[20:] + "。" + han(70), "zh", "s", 1), (2, han(200), "zh", "s", 1)]
    found = decontam.search(frame(spark, rows, clash=False),
                            spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(x.doc_id, [y.item for y in x.leaks]) for x in found] == [(1, [7])]


def test_decontamination_answer_column(spark, contaminated):
    """With an answer column a passage without its answer is no leak."""
    from storelens.llm import decontam
    bench, rows, truth = contaminated
    b = spark.createDataFrame([(i, t, f"answer{i}" if i % 2 else "quite another reply") for i, t in bench],
                              "item_id long, text string, reply string")
    found = decontam.search(frame(spark, rows), b, answer="reply").collect()
    assert {x.item for r in found for x in r.leaks} == {i for i, _ in bench if i % 2}


def test_decontamination_of_cut_and_reworded_endings(spark):
    """Without an answer column the share of the passage's words decides, wherever they are missing."""
    from storelens.llm import decontam
    r = random.Random(3)
    bench = [(i, " ".join(syllables(r, r.randrange(15, 60)))) for i in range(40)]
    rows = []
    for i, text in bench:
        words = text.split()
        around = syllables(r, 150)
        for k, copy in enumerate([words[:len(words) * 17 // 20], words[:-4] + ["other"] * 4]):
            rows.append((2 * i + k, " ".join(around[:70 + i] + copy + around[70 + i:]), "en", "s", 1))
    found = decontam.search(frame(spark, rows, clash=False),
                            spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(x.doc_id, y.item) for x in found for y in x.leaks} == {(i, i // 2) for i in range(80)}


def test_scattered_words_are_no_copy(spark):
    from storelens.llm import decontam
    item = [f"w{i}" for i in range(12)]
    text = " ".join(f"{w} {prose(4, i)}" for i, w in enumerate(item))
    found = decontam.search(frame(spark, [(1, text, "en", "s", 1), (2, " ".join(item[:9]), "en", "s", 1)], clash=False),
                            spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [x.doc_id for x in found] == [2]


def test_decontamination_edges(spark, edge_rows, contaminated):
    from storelens.llm import decontam
    bench, rows, _ = contaminated
    b = spark.createDataFrame(bench + [(50, None), (51, ""), (None, "x y z"), (0, bench[0][1])],
                              "item_id long, text string")
    docs = frame(spark, edge_rows + rows[60:64] + rows[60:61])
    found = decontam.search(docs, b).collect()
    assert Counter(r.doc_id for r in found) == Counter({1000: 2, 2000: 1, 1001: 1, 2001: 1})
    kept = decontam.clean(docs, b)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, *_ in edge_rows)
    assert decontam.search(docs, b.limit(0)).count() == 0
    assert decontam.search(docs.limit(0), b).count() == 0


# -- mixing ---------------------------------------------------------------------------------

def slow_targets(sizes):
    """By repeated capping, as the rule is told."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        new = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not new:
            return {s: 2.0 * sizes[s] if s in capped else share[s] for s in names}
        capped |= new


def mix_rows(n=400):
    r = random.Random(8)
    sources = ["hot"] * 6 + ["a", "b", "ä", "Z", None, "tiny"]
    return [(i, prose(r.randrange(0, 80), i), "en", r.choice(sources) if i else "tiny", 1) for i in range(n)]


def test_targets_and_shares_against_brute_force(spark):
    from storelens.llm import mixing
    rows = mix_rows()
    sizes, source = defaultdict(int), {}
    for i, t, _, s, _ in rows:
        sizes[s] += len(t.split())
        source[i] = s
    want, taken, by = slow_targets(sizes), defaultdict(int), defaultdict(int)
    for r in mixing.shares(frame(spark, rows)).collect():
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (len(rows[r.doc_id][1].split()), sizes[s])
        assert r.target == pytest.approx(want[s]) and r.taken <= 2 * r.size
        taken[s] += r.taken
        by[s] += 1
    for s in want:
        assert abs(taken[s] - want[s]) <= 20


def test_mix_is_reproducible_and_whole(spark):
    from storelens.llm import mixing
    rows = mix_rows()
    docs = frame(spark, rows)
    p = mixing.MixParams(shards=5, block_docs=8)
    a = mixing.mix(docs, shard="part", params=p)
    b = mixing.mix(docs.repartition(9), shard="part", params=p)
    key = lambda df: Counter((r.doc_id, r.part, r.text) for r in df.collect())
    first = key(a)
    assert first == key(b) and a.columns == docs.columns + ["part"]
    shares = {r.doc_id: r for r in mixing.shares(docs, params=p).collect()}
    copies = Counter()
    for (i, _, _), n in first.items():
        copies[i] += n
    assert all(copies[i] == len(r.draws) for i, r in shares.items())
    places = [(rows[i][3], d.place) for i, r in shares.items() for d in r.draws]
    shard = {}
    for i, r in shares.items():
        for d in r.draws:  # a place of a source's list lies in one shard
            assert shard.setdefault((rows[i][3], d.place), d.shard) == d.shard
    assert places and mixing.mix(docs, params=p).columns == docs.columns


def test_splitting_tree_quotas_are_exact(spark):
    from storelens.llm import mixing
    quotas = [1000, 0, 37, 3, 260]
    got = mixing._split(quotas, 7, mixing.MixParams(), spark).collect()
    by = defaultdict(list)
    total = Counter()
    for r in got:
        by[r["rank"]].append((r.start, r.start + r.n, r.shard))
        total[r.shard] += r.n
    for rank, spans in by.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == quotas[rank]
        assert all(a[1] == b[0] and a[2] < b[2] for a, b in zip(spans, spans[1:], strict=False))
    assert sum(total.values()) == 1300 and max(total.values()) - min(total.values()) <= 3


def test_hypergeometric_moments():
    from storelens.llm import mixing
    rng = np.random.default_rng(1)
    for good, bad, n in ((30, 70, 20), (3 * 10 ** 9, 7 * 10 ** 9, 10 ** 9)):
        x = np.array([mixing._hypergeometric(rng, good, bad, n) for _ in range(4000)])
        mean = n * good / (good + bad)
        var = mean * bad / (good + bad) * (good + bad - n) / (good + bad - 1)
        assert abs(x.mean() - mean) < 5 * (var / 4000) ** 0.5 and 0.85 < x.var() / var < 1.15


def test_mixing_edges(spark, edge_rows):
    from storelens.llm import mixing
    docs = frame(spark, edge_rows)
    got = mixing.shares(docs).collect()
    assert len(got) == len(edge_rows)
    assert all(r.taken <= 2 * r.size for r in got)
    assert mixing.shares(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    nothing = frame(spark, [(1, None, None, None, None), (2, "", None, "s", 0)])
    assert [(r.target, r.taken) for r in mixing.shares(nothing).collect()] == [(0.0, 0), (0.0, 0)]


# -- the retrieval decides what decontamination finds ----------------------------------------

@pytest.mark.parametrize("changed", [0.0, 0.2, 0.3])
def test_recall_of_the_latent_search_against_the_exact_mode(spark, large_benchmark, changed):
    from storelens.llm import decontam
    bench, _ = large_benchmark
    r = random.Random(int(changed * 10))
    rows = []
    for i in range(0, 2500, 25):
        words = bench[i][1].split()
        for at in r.sample(range(len(words)), int(changed * len(words))):
            words[at] = syllables(r, 1)[0]
        k = r.randrange(150)
        rows.append((i, " ".join([*syllables(r, k), *words, *syllables(r, 150 - k)]), "en", "s", 1))
    docs, b = frame(spark, rows, clash=False), spark.createDataFrame(bench, "item_id long, text string")

    def found(**how):
        return {(x.doc_id, y.item) for x in decontam.search(docs, b, **how).collect() for y in x.leaks}

    exact, own = found(exact=True), found()
    assert own <= exact and len(exact) >= 95
    assert len(own) >= 0.9 * len(exact)
    # without the cosine nothing is left
    assert found(params=decontam.DecontamParams(cosine=9.0)) == set()


def test_decontamination_against_all_items_by_brute_force(spark, large_benchmark):
    """What is reported is what a comparison of every text with every item accepts."""
    from storelens.llm import decontam
    bench, rows = large_benchmark
    bench, rows = bench[:100], rows[:4] + [(9000 + k, prose(150, k), "en", "s", 1) for k in range(3)]
    want = set()
    for i, text, *_ in rows:
        words = decontam.words_of(text.encode())
        for item, t in bench:
            own = decontam.words_of(t.encode())
            span = 2 * len(own)
            if max(decontam.lcs_length(own, words[k:k + span]) for k in range(len(words))) >= 0.6 * len(own):
                want.add((i, item))
    b = spark.createDataFrame(bench, "item_id long, text string")
    found = decontam.search(frame(spark, rows, clash=False), b).collect()
    got = {(r.doc_id, x.item) for r in found for x in r.leaks}
    assert got <= want and len(got) >= 0.9 * len(want) and {(i, i) for i, *_ in rows[:4]} <= got


def test_clean_judges_rows_by_their_text(spark):
    from storelens.llm import decontam
    item = prose(40, 88) + " unique"
    rows = [(None, "before " + item, "en", "s", 1), (None, prose(60, 1), "en", "s", 1), (3, item, "en", "s", 1),
            (3, prose(70, 2), "en", "s", 1), (4, None, "en", "s", 1)]
    docs = frame(spark, rows)
    kept = decontam.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted(["", rows[1][1], rows[3][1]])


def test_large_hypergeometric_has_the_exact_probabilities():
    """Beyond the generator's range: few draws are all but binomial, and half of
    the blocks of one kind give the spread that the distribution has."""
    import math
    from storelens.llm import mixing
    rng = np.random.default_rng(5)
    x = np.array([mixing._hypergeometric(rng, 10 ** 12, 3 * 10 ** 12, 4) for _ in range(20_000)])
    share = np.bincount(x, minlength=5) / len(x)
    want = [math.comb(4, k) * 0.25 ** k * 0.75 ** (4 - k) for k in range(5)]
    assert np.abs(share - want).max() < 0.015
    good, bad, n = 10 ** 9, 10 ** 9, 10 ** 9
    x = np.array([mixing._hypergeometric(rng, good, bad, n) for _ in range(1500)])
    spread = (n * 0.25 * 0.5) ** 0.5
    assert abs(x.mean() - n / 2) < 5 * spread / 1500 ** 0.5 and abs(x.std() / spread - 1) < 0.1
    # what is certain
    assert mixing._hypergeometric(rng, 10 ** 10, 0, 7) == 7 and mixing._hypergeometric(rng, 0, 10 ** 10, 7) == 0
    assert mixing._hypergeometric(rng, 10 ** 10, 5, 10 ** 10 + 5) == 10 ** 10


def test_simhash_ids_of_any_size(spark):
    from storelens.llm import simhash
    text = "one two three four five six seven"
    ids = [2 ** 63 - 1, 2 ** 62 + 5, -2 ** 63, None]
    got = simhash.near_duplicates(frame(spark, [(i, text, "en", "s", 1) for i in ids[:2]] + [
        (2 ** 62, "alone " + prose(30, 3), "en", "s", 1)])).collect()
    assert {r.doc_id: r.component_id for r in got} == {
        2 ** 63 - 1: 2 ** 62 + 5, 2 ** 62 + 5: 2 ** 62 + 5, 2 ** 62: 2 ** 62}
    got = simhash.near_duplicates(frame(spark, [(i, text, "en", "s", 1) for i in ids])).collect()
    assert all(r.component_id == -2 ** 63 for r in got)
