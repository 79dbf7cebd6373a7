"""Repeat removal, tokenizer alignment and periodic runs against brute force."""
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from .conftest import frame, prose

SMOKE = "/root/testdata/sf0.001"


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


# -- repeats ----------------------------------------------------------------------------


def naive_repeats(rows, length=50):
    def rank(i):
        return (i is None, i or 0)

    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k:k + length]
            first[s] = min(first.get(s, rank(i)), rank(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < rank(i):
                gone[k:k + length] = b"\1" * length
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]),
                    hashlib.sha256(kept).hexdigest()))
    return ordered(out)


@pytest.fixture(scope="module")
def shared_texts():
    r = random.Random(5)
    parts = ["".join(r.choice("abcdé -") for _ in range(r.randint(20, 120))) for _ in range(30)]
    parts += ["-" * 300, "ab" * 100, "x" * 49, "x" * 50]

    def text():
        return "".join(r.choice(parts) if r.random() < .8 else "".join(r.choices("abcd", k=r.randint(1, 90)))
                       for _ in range(r.randint(0, 6)))

    rows = [(r.randint(0, 300), text()) for _ in range(300)]
    return rows + [(None, rows[3][1]), (None, parts[0] * 2), (7, None), (1000, rows[5][1]), (1001, rows[5][1]),
                   (1001, rows[5][1]), (1002, "short"), (1003, "short"), (-2, prose(30_000, 5)), (5000, prose(30_000, 5))]


@pytest.mark.parametrize("chunk_bytes, hot", [(4_000_000, 2000), (6000, 2000), (900, 1)])
def test_repeats_equal_brute_force(spark, shared_texts, chunk_bytes, hot):
    from storelens.llm import repeats
    docs = frame(spark, [(i, t, None, None, None) for i, t in shared_texts]).repartition(5)
    got = repeats.remove_repeats(docs, chunk_bytes=chunk_bytes, hot=hot).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert ordered(got) == naive_repeats(shared_texts)


def test_repeats_of_other_lengths_and_no_rows(spark, shared_texts):
    from storelens.llm import repeats
    rows = shared_texts[:60]
    docs = frame(spark, [(i, t, None, None, None) for i, t in rows])
    assert ordered(repeats.remove_repeats(docs, length=33, chunk_bytes=3000).collect()) == naive_repeats(rows, 33)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="length"):
        repeats.remove_repeats(docs, length=10)


def test_repeats_query_equals_brute_force(spark):
    from storelens.llm.queries import op11_repeats
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    got = op11_repeats(spark, SMOKE)
    assert ordered(got.collect()) == naive_repeats(rows)
    assert got.agg({"n_removed": "sum"}).first()[0] > 1000
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("repeats_")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=120), min_size=1, max_size=6))
def test_previous_factors_of_small_alphabets(texts):
    from storelens.llm import repeats
    body = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    owner = np.arange(len(texts))
    at, earlier = repeats.previous_factors(body, ends, owner, 24)
    want = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - 23):
            want[int(ends[k]) - len(t) + i] = any(t[i:i + 24] in texts[j] for j in range(k))
    assert dict(zip(at.tolist(), earlier.tolist(), strict=True)) == want


# -- alignment -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabularies():
    import public_tokenizers
    return (str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model")))


def naive_alignment(rows, sides):
    per, count = [], Counter()
    for i, t in rows:
        groups, a, b = [], [], []
        if t:
            a, b = sides.a.encode(" " + t, add_special_tokens=False).ids, sides.b.encode(t)
            whole = (" " + t).encode()
            if not b"".join(sides.a_bytes[x] for x in a) == whole == b"".join(sides.b_bytes[x] for x in b):
                a, b = [], []
        ends = [np.cumsum([len(table[x]) for x in ids]).tolist() for table, ids in ((sides.a_bytes, a), (sides.b_bytes, b))]
        i_a = i_b = 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            j_a, j_b = ends[0].index(e, i_a) + 1, ends[1].index(e, i_b) + 1
            groups.append((a[i_a:j_a], b[i_b:j_b]))
            i_a, i_b = j_a, j_b
        found = [(x, y) for own_a, own_b in groups for x in own_a for y in own_b]
        count.update(set(found))
        per.append((i, a, b, groups, found))
    top = {}
    for (x, _), c in count.items():
        top[x] = max(top.get(x, 0), c)
    return ordered(
        (i, len(a), len(b), len(groups), len(found), sum(count[f] == top[f[0]] for f in found),
         sum(count[f] for f in found),
         hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode())
         .hexdigest() if a else "") for i, a, b, groups, found in per)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["a", "b", " ", "  ", "\n", " \n", " ", "é", "日本", "　", "the", " The", "\t", "</s>", "<|endoftext|>", "▁",
       "x1", "'s", "\x00", "́", "\U0001f600", "....", "-", "\x1c", "ﬁ", "\x85", "\xa0"]


@pytest.mark.parametrize("chunk_bytes, fan_in", [(16_000_000, 64), (700, 3)])
def test_alignment_equals_brute_force(spark, vocabularies, chunk_bytes, fan_in):
    from storelens.llm import align
    r = random.Random(3)
    rows = [(k, "".join(r.choice(ODD) for _ in range(r.randint(0, 25)))) for k in range(300)]
    rows += [(700, None), (700, "dup"), (700, "dup"), (None, "no id"), (-1, prose(5000, 2)), (800, "日" * 400)]
    docs = frame(spark, [(i, t, None, None, None) for i, t in rows]).repartition(4)
    got = align.align(docs, *vocabularies, chunk_bytes=chunk_bytes, fan_in=fan_in).select(*COLUMNS).collect()
    assert ordered(got) == naive_alignment(rows, align.Sides(*vocabularies))
    assert align.align(docs.limit(0), *vocabularies).count() == 0


def test_alignment_query_equals_brute_force(spark, vocabularies):
    from storelens.llm import align
    from storelens.llm.queries import op12_alignment
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    assert ordered(op12_alignment(spark, SMOKE).collect()) == naive_alignment(rows, align.Sides(*vocabularies))


def test_wide_groups_and_whole_texts(vocabularies, monkeypatch):
    from storelens.llm import align
    sides = align.Sides(*vocabularies)
    assert sides.by_units
    texts = ["日本語 " * 30 + "abc", prose(50, 3), "\U0001f600" * 40]
    units = align.Units(sides)
    plain = [units.of([t])[0] for t in texts]
    whole = align.Units(sides)
    monkeypatch.setattr(sides, "by_units", False)
    monkeypatch.setattr(align, "WIDE", 2)
    for t, own in zip(texts, plain, strict=True):
        one = whole.of([t])[0]
        assert len(one) == 1
        assert units.sizes[own].sum(axis=0).tolist() == whole.sizes[one[0]].tolist()
        assert b";".join(units.written[u] for u in own) == whole.written[one[0]]
        links = [Counter(), Counter()]
        for c, table, ids in ((links[0], units, own), (links[1], whole, one)):
            for u in ids:
                part = slice(table.offsets[u], table.offsets[u + 1])
                for pair, n in zip(table.pairs[part].tolist(), table.weights[part].tolist(), strict=True):
                    c[pair] += n
        assert links[0] == links[1]


def test_merged_runs_sum_their_counts():
    from storelens.llm import align
    r = np.random.default_rng(4)
    runs, want = [], Counter()
    for _ in range(9):
        pairs = np.unique(r.integers(0, 400, 150))
        counts = r.integers(1, 9, len(pairs))
        runs.append(align.unpack_counts(align.pack_counts(pairs, counts)))
        want.update(dict(zip(pairs.tolist(), counts.tolist(), strict=True)))
    got = list(align.merge_counts(runs, 4))
    pairs, counts = (np.concatenate(c) for c in zip(*got, strict=True))
    assert (np.diff(pairs) > 0).all()
    assert dict(zip(pairs.tolist(), counts.tolist(), strict=True)) == want


# -- periodic runs -------------------------------------------------------------------------

def naive_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q):
                out.setdefault((i, size), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def runs_of(words):
    from storelens.llm import periods
    hashes = np.array([hash(w) for w in words], np.int64).view(np.uint64)
    return periods._runs_of(words, periods.stretches(hashes, np.array([0, len(words)])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=50), st.integers(1, 9), st.integers(0, 40))
def test_runs_of_small_alphabets(words, q, tail):
    words = words + (words[-q:] * (tail // max(1, len(words[-q:])) + 1))[:tail]
    assert runs_of(words) == naive_runs(words)


def test_runs_within_runs():
    words = ([b"x"] * 6 + [b"y"]) * 5 + [b"z"]
    found = runs_of(words)
    assert found == naive_runs(words)
    assert (0, 35, 7) in found and (0, 6, 1) in found


def test_a_long_period_and_a_long_run():
    root = [b"%d" % k for k in range(3000)]
    assert runs_of([b"s"] + root * 4 + [b"e"]) == [(1, 12_000, 3000)]
    assert runs_of([b"s"] + root * 4 + root[:-1] + [b"e"]) == [(1, 14_999, 3000)]
    assert runs_of(root * 3 + root[:-1]) == []
    assert runs_of([b"w"] * 20_000) == [(0, 20_000, 1)]


def naive_periods(rows):
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        n, h = len(words), zlib.crc32(b"" if i is None else str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = naive_runs(words)
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        best = None
        for run in runs:
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        line = "".join("%d,%d,%d\n" % r for r in runs)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
                    hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    return ordered(out)


def test_period_query_equals_brute_force(spark, edge_rows, tmp_path):
    from storelens.llm.queries import op13_periods
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    assert ordered(op13_periods(spark, SMOKE).collect()) == naive_periods(rows)
    short = [(i, t[:4000] if t else t, *rest) for i, t, *rest in edge_rows]
    short += [(k, "a b a b a b a b c c c c c c \n\x0b" + prose(40, k), None, None, None) for k in range(40, 80)]
    frame(spark, short).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_periods(spark, str(tmp_path)).collect()
    assert ordered(got) == naive_periods([(r[0], r[1]) for r in short])
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op13_periods(spark, f"{tmp_path}/none").count() == 0
