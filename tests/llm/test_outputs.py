"""Token files, chat formatting, LM scores, WARC archives and the pipeline."""
import base64
import gzip
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from .conftest import DOC, frame, prose

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


# -- token files ---------------------------------------------------------------------

TRICKY = ["", " ", "don't I'LL 'sx a's's", "<|endoftext|> x<|startoftext|>y", "é ́a\ń", "Ａ　ｂ c d",
          "ΑΣ ΟΔΟΣ\x85İ", "12a34 --!!a", "\U0001f600‍\U0001f600 日本 語", "a\x00b\x1cc"]


def test_word_by_word_encoding_equals_whole_texts(vocabulary):
    from tokenizers import Tokenizer

    from storelens.llm import tokens
    own, whole = tokens.Encoder(vocabulary), Tokenizer.from_file(vocabulary)
    texts = TRICKY + [prose(300, 1)]
    got = own.encode([t.encode() for t in texts], 2)
    assert [g.tolist() for g in got] == [
        [*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]


WORDS = st.one_of(st.text(max_size=40), st.text(alphabet="aZ09ÀÖ×ØßàÿéÑ'-.,<|>ſK \t", max_size=30),
                  st.sampled_from(["<|ENDOFTEXT|>", "a<|endoftext|>b", "İstanbul", "ﬁ", "Σς", "x<|", "don'T", "Ÿ÷ÿ", "A\x7fB"]))


@settings(max_examples=400, deadline=None)
@given(WORDS)
def test_encoding_of_any_text(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    from storelens.llm import tokens
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    cache = test_encoding_of_any_text.__dict__.setdefault("cache", {})
    own = cache.setdefault("own", None) or cache.update(own=tokens.Encoder(path), whole=Tokenizer.from_file(path)) or cache["own"]
    assert own.encode([text.encode()], 2)[0].tolist() == [
        *cache["whole"].encode(text, add_special_tokens=False).ids, 2]


def test_encoder_forgets_but_stays_right(vocabulary, monkeypatch):
    from storelens.llm import tokens
    monkeypatch.setattr(tokens, "KEPT_WORDS", 10)
    own, fresh = tokens.Encoder(vocabulary), None
    for k in range(5):
        text = prose(30, k).encode()
        fresh = tokens.Encoder(vocabulary)
        assert own.encode([text], 2)[0].tolist() == fresh.encode([text], 2)[0].tolist()


def test_a_run_is_encoded_once_whatever_stands_beside_it(vocabulary):
    from storelens.llm import tokens
    own = tokens.Encoder(vocabulary)
    own.encode([b"tell Tell. (tell) tell,tell2", "22 don't É été. x<|EndOfText|> EndOfText".encode()], 2)
    assert set(own.kept) == {w.encode() for w in ["tell", ".", "(", ")", ",", "2", "don't", "é", "été", "x<|EndOfText|>", "endoftext"]}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(
    ["a", "B", "É", "é", "×", "'s", "'", "1", "23", "--", "!", "<|", "|>", "<|endoftext|>", "<|EndOfText|>", " ", "  ", "\n",
     "\x0b", "\u00a0", "\x85", "\u0301", "İ", "ÿ", "ß", "Ã", "日", "\x1c", "\x7f"]), max_size=14).map("".join), max_size=5))
def test_texts_encoded_together_and_by_parts(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    from storelens.llm import tokens
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    cache = test_texts_encoded_together_and_by_parts.__dict__.setdefault("cache", {})
    if not cache:
        cache.update(own=tokens.Encoder(path), whole=Tokenizer.from_file(path))
    own, raw = cache["own"], [t.encode() for t in texts]
    want = [[*cache["whole"].encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert [g.tolist() for g in own.encode(raw, 2)] == want
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tokens, "PIECE_BYTES", 6)  # longer texts go by parts
        assert [own.encode([t], 2)[0].tolist() for t in raw] == want


def test_bytes_that_are_no_utf8(vocabulary):
    from tokenizers import Tokenizer

    from storelens.llm import tokens
    raw = [b"a\xff b\xc3", b"\xa9\xc3", b"\xc3 \xa9 \xc3\xc3\xa9"]
    whole = Tokenizer.from_file(vocabulary)
    assert [g.tolist() for g in tokens.Encoder(vocabulary).encode(raw, 2)] == [
        [*whole.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, 2] for t in raw]


def test_token_files_round_trip(spark, edge_rows, vocabulary, tmp_path):
    from tokenizers import Tokenizer

    from storelens.llm import tokens
    whole = Tokenizer.from_file(vocabulary)
    docs = frame(spark, edge_rows)
    files = tokens.write(docs, str(tmp_path / "ids"), vocabulary, sequence=16, partitions=3) if (
        tmp_path / "ids").mkdir() is None else None
    want, at = [], 0
    order = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    for i, text, *_ in order:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in tokens.read_digests(files).collect()]
    key = lambda r: (r[1], r[2])
    assert sorted(got, key=key) == sorted(want, key=key)
    # any sequence by its number, and its mask
    rows = sorted(files.collect(), key=lambda r: r.part)
    reader = tokens.SequenceReader(rows[0].path)
    n = rows[0].n_tokens
    real = 0
    for s in range(-(-n // 16)):
        ids, mask = reader[s]
        assert len(ids) == len(mask) == 16 and not ids.flags.owndata  # a view of the file
        assert mask.tolist() == [k < n - s * 16 for k in range(16)]
        real += int(mask.sum())
    assert real == n
    with pytest.raises(ValueError):
        list(reader.ids(n, 1))


def test_token_files_of_nothing(spark, vocabulary, tmp_path):
    from storelens.llm import tokens
    files = tokens.write(frame(spark, []), str(tmp_path), vocabulary)
    assert files.count() == 0 and tokens.read_digests(files).count() == 0


# -- chat ---------------------------------------------------------------------------------

CONTROL_TEXT = st.lists(st.sampled_from(["<|turn|>", "<|end|>", "</s>", "[INST]", "[/INST]", "<|image|>", "<", "|", ">", "\\",
                                         "\n", "<|", "|>", "s", "[", "]", "/", "é", " "]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(CONTROL_TEXT, CONTROL_TEXT)
def test_escaping_is_reversible_and_hides_controls(text, role):
    from storelens.llm import chat
    shown = chat.escape(text)
    assert chat.unescape(shown) == text
    assert not any(c in shown for c in chat.CONTROLS)
    turn = chat.format_turn(role, [{"type": "text", "text": text}])
    assert chat.parse_piece(turn["piece"]) == (role, text)
    assert turn["piece"].count(chat.TURN) == 1 and turn["piece"].count(chat.TURN_END) == 1


def test_parts_become_ordered_placeholders():
    from storelens.llm import chat
    parts = [{"type": "text", "text": "see <|image|> "}, {"type": "image", "ref": "a.png", "width": 28, "height": 15},
             {"type": "audio", "ref": "b.wav", "seconds": 1.5}, None, {"type": "document", "ref": None, "pages": 2, "text": "two words"},
             {"type": "video", "text": " end"}]
    turn = chat.format_turn("assistant", parts)
    assert turn["piece"] == "<|turn|>assistant\nsee <\\|image|> <|image|><|audio|><|document|>two words end<|end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in turn["attachments"]] == [
        ("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "", 1024)]
    for a in turn["attachments"]:
        assert turn["piece"][a["at"]:].startswith(chat.PLACEHOLDERS[a["kind"]])
    assert turn["tokens"] == 2 + 4 + 38 + 1024 + 2 + 1
    (span,) = turn["loss"]
    assert turn["piece"][span["start"]:span["end"]].startswith("see") and turn["piece"][span["end"]:] == "<|end|>\n"


def test_conversations_against_brute_force(spark):
    from storelens.llm import chat
    rows = [(1, 0, "user", "hi <|end|>"), (1, 1, "assistant", "yes\\ [INST]"), (1, 2, "assistant", None), (2, 5, "assistant", "zwei é\n"),
            (2, 4, "system", ""), (3, None, None, "x"), (3, 0, "a\nb", "y"), (None, 0, "user", "lost"), (None, 1, "assistant", "found"),
            (4, 1, "assistant", "same"), (4, 1, "assistant", "same")] + [(9, t, "assistant", f"t{t} " + "w" * 5000) for t in range(300)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("parts", "piece", "loss", "tokens"):
        df = df.withColumn(c, F.lit("clash"))
    pieces = chat.format_conversations(df)
    assert pieces.count() == len(rows)
    got = {r.conv_id: r for r in chat.digests(pieces).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert set(got) == set(by)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == sum(len(chat.format_turn(r[2], [{"text": r[3]}])["piece"]) for r in own)
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_parts_column(spark):
    from storelens.llm import chat
    rows = [(1, 0, "user", "fallback", None), (1, 1, "assistant", "unused", [("image", None, "r", 14, 14, None, None)]), (1, 2, "user", None, [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, content {chat.PART_TYPE}")
    got = [r.piece for r in chat.format_conversations(df, parts="content").orderBy("turn").collect()]
    assert got == ["<|turn|>user\nfallback<|end|>\n", "<|turn|>assistant\n<|image|><|end|>\n", "<|turn|>user\n<|end|>\n"]


# -- LM scores --------------------------------------------------------------------------------

def slow_scores(rows, held, deleted, p):
    """The model with dictionaries of words; the weights by EM over exact cells."""
    from storelens.llm import lm
    texts = [(i, [*(t or "").encode().lower().split(), "end"]) for i, t, *_ in rows]
    uni, pair, begin = (Counter() for _ in range(3))
    runi, rpair = Counter(), Counter()
    for i, w in texts:
        if held(i):
            continue
        for table, pairs in ((uni, pair), (runi, rpair))[:1 if deleted(i) else 2]:
            table.update(w)
            pairs.update(zip([None, *w], w))
    total, types = sum(uni.values()), len(uni)
    p0 = 1 / (types + 1)
    context = lambda c, h: c["end"] if h is None else c[h]
    bucket = lambda c: min(int(math.log2(c)) + 1, lm.BUCKETS - 1) if c else 0
    cells = Counter()
    step = lambda x: 2.0 ** (round(p.cells * math.log2(x)) / p.cells) if x else 0.0
    for i, w in texts:
        if not held(i) and deleted(i):
            for h, x in zip([None, *w], w):
                c = context(runi, h)
                cells[bucket(c), step(runi[x] / max(sum(runi.values()), 1)), step(rpair[h, x] / max(c, 1))] += 1
    weights = lm.learn_weights([(*k, n) for k, n in cells.items()], p0, p.rounds)
    out = []
    for i, w in texts:
        score = base = 0.0
        for h, x in zip([None, *w], w):
            c = context(uni, h)
            l0, l1, l2 = weights[bucket(c)]
            score += math.log10(l0 * p0 + l1 * uni[x] / max(total, 1) + l2 * pair[h, x] / max(c, 1))
            base += math.log10((uni[x] + 1) / (total + types + 1))
        out.append((repr(i), not held(i), len(w), sum(uni[x] > 0 for x in w), total, base, score))
    return sorted(out)


@pytest.mark.parametrize("chunk_bytes", [12_000_000, 2_000])
def test_lm_against_brute_force(spark, edge_rows, chunk_bytes):
    from storelens.llm import lm
    from storelens.llm.common import fold
    rows = edge_rows + [(100 + i, prose(20 + i % 60, i % 50), "en", "s", 1) for i in range(120)]
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    p = lm.LmParams(chunk_bytes=chunk_bytes, range_keys=500)
    got = sorted((repr(r.doc_id), r.training, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                 for r in lm.score(frame(spark, rows), training=fold("doc_id", 7) != 2, params=p).collect())
    want = slow_scores(rows, lambda i: crc(i) == 2, lambda i: crc(i) == 6, p)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


def test_lm_is_a_distribution_and_beats_the_base(spark):
    from storelens.llm import lm
    from storelens.llm.common import fold
    r = random.Random(3)
    chain = {w: r.sample(prose(60, 1).split(), 3) for w in set(prose(60, 1).split())}

    def walk(seed):
        s = random.Random(seed)
        w = [s.choice(sorted(chain))]
        while len(w) < 50:
            w.append(s.choice(chain.get(w[-1]) or sorted(chain)))
        return " ".join(w)

    rows = [(i, walk(i), "en", "s", 1) for i in range(400)]
    got = lm.score(frame(spark, rows), training=fold("doc_id", 7) != 2).collect()
    held = [g for g in got if not g.training]
    assert held and sum(g.score for g in held) > 0.7 * sum(g.base_score for g in held)
    # over all next tokens after one context the probabilities add up to one
    w = lm.learn_weights([(2, 0.1, 0.5, 10), (3, 0.01, 0.0, 4)], 0.001, 50)
    assert np.allclose(w.sum(axis=1), 1) and (w[:, 0] > 0).all() and w[0, 2] == 0


def test_em_finds_the_maximum():
    from storelens.llm import lm
    cells = [(4, 0.02, 0.3, 50), (4, 0.1, 0.0, 30), (4, 0.0, 0.0, 5), (4, 0.005, 0.05, 40)]
    w = lm.learn_weights(cells, 0.001, 500)[4]
    like = lambda w: sum(n * math.log(w[0] * 0.001 + w[1] * a + w[2] * b) for _, a, b, n in cells)
    r = np.random.default_rng(0)
    assert all(like(w) >= like(x) - 1e-6 for x in r.dirichlet([1, 1, 1], 3000))


def test_lm_without_training_or_rows(spark):
    from pyspark.sql import functions as F

    from storelens.llm import lm
    assert lm.score(frame(spark, [])).count() == 0
    (r,) = lm.score(frame(spark, [(1, "a b", None, None, 1)]), training=F.lit(False)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.score == r.base_score == 0


# -- WARC -----------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def warc_rows():
    rows = [(i, f"https://h.example/{i}?q=é \n", f"<p>{prose(i * 7, i)}\r\n\r\n</p>") for i in range(30)]
    rows += [(100 + i, "https://h.example/copy", "the same page") for i in range(50)]
    rows += [(200, None, None), (201, "", ""), (202, "x", "x" * 700_000), (300, "u", "twice"), (300, "u", "twice"),
             (299, "u", "twice"), (None, "u", "nameless"), (None, None, "the same page")]
    return rows


def slow_archive(rows, min_bytes=0):
    largest = {}
    for i, _, t in rows:
        if i is not None:
            largest[t or ""] = max(largest.get(t or "", i), i)
    out = []
    for i, _, t in rows:
        raw = (t or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        to = largest.get(t or "")
        again = to is not None and to != i and len(raw) >= min_bytes
        out.append((i, len(raw), digest, "revisit" if again else "response", to if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_archives_round_trip(spark, tmp_path, min_bytes):
    from pyspark.sql import functions as F

    from storelens.llm import warc
    rows = warc_rows()
    pages = spark.createDataFrame(rows, PAGES)
    for c in ("id", "payload", "digest", "refers_to"):
        pages = pages.withColumn(c, F.lit("clash"))
    files = warc.archive(pages, str(tmp_path), min_bytes=min_bytes)
    back = warc.read(files, keep_payload=True).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=repr)
    assert got == slow_archive(rows, min_bytes)
    texts = {(r.page_id, bytes(r.payload)) for r in back if r.record_type == "response"}
    assert texts == {(i, (t or "").encode()) for i, _, t in rows
                     if ("response" in [w[3] for w in slow_archive(rows, min_bytes) if w[0] == i
                                        and w[2] == base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()])}
    assert sum(r.records for r in files.collect()) == len(rows)


def test_archive_is_plain_gzip_members(tmp_path):
    from storelens.llm import warc
    one = warc.record(5, "http://a/b c", b"hello", None, "2020-01-01T00:00:00Z")
    two = warc.record(6, None, b"hello", 5, "2020-01-01T00:00:00Z")
    text = gzip.decompress(one + two).decode()
    assert text.count("WARC/1.1\r\n") == 2 and "WARC-Target-URI: http://a/b%20c\r\n" in text
    assert "WARC-Refers-To: <urn:page:5>" in text and "WARC-Target-URI: urn:page:6\r\n" in text
    got = list(warc.records(io.BytesIO(one + two), keep_payload=True))
    assert [(g["page_id"], g["payload"], g["payload_bytes"]) for g in got] == [(5, b"hello", 5), (6, None, 5)]
    assert list(warc.records(io.BytesIO(b""))) == []


@pytest.mark.parametrize("harm", ["cut", "payload", "length", "version", "junk"])
def test_reader_names_what_is_wrong(harm):
    from storelens.llm import warc
    raw = gzip.decompress(warc.record(5, "http://a", b"hello world" * 100, None, "2020-01-01T00:00:00Z"))
    if harm == "cut":
        data = gzip.compress(raw)[:-40]
    elif harm == "payload":
        data = gzip.compress(raw.replace(b"hello world", b"hellO world", 1))
    elif harm == "length":
        data = gzip.compress(re.sub(rb"(application/http; msgtype=response\r\nContent-Length: )\d+", rb"\g<1>900", raw))
    elif harm == "version":
        data = gzip.compress(raw.replace(b"WARC/1.1", b"WARC/0.9"))
    else:
        data = gzip.compress(raw) + b"no gzip"
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(io.BytesIO(data)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=5), st.integers(1, 50))
def test_reader_takes_any_step_size(payloads, step):
    from unittest import mock

    from storelens.llm import warc
    data = b"".join(warc.record(i, "u", x, None, "2020-01-01T00:00:00Z") for i, x in enumerate(payloads))
    with mock.patch.object(warc, "STEP_BYTES", step):
        got = [r["payload"] for r in warc.records(io.BytesIO(data), keep_payload=True)]
    assert got == payloads


def test_archive_of_nothing(spark, tmp_path):
    from storelens.llm import warc
    assert warc.read(warc.archive(spark.createDataFrame([], PAGES), str(tmp_path))).count() == 0


# -- registered queries and the pipeline ------------------------------------------------------

def test_all_queries_are_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in names)] == []
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


@pytest.fixture(scope="module")
def stages(spark, edge_rows):
    """Each stage's input and output over edge rows and rows it decides on."""
    import corpus_pipeline
    bench = [r.text for r in spark.read.parquet(f"{SMOKE}/benchmark.parquet").limit(3).collect()]
    # a third of the rows shares one source; copies and benchmark passages are planted
    rows = edge_rows + [(100 + i, prose(80 + i, i), "en", f"s{i % 4}", 1) for i in range(40)]
    rows += [(200 + i, prose(150, 7) + (" end" if i else ""), "en", "s1", 1) for i in range(3)]
    rows += [(300 + i, prose(60, 50 + i) + "\n" + t + "\n" + prose(60, 60 + i), "en", "s2", 1) for i, t in enumerate(bench)]
    docs, out = frame(spark, rows), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SMOKE)
        out.append((name, docs, after))
        docs = after
    return out


def test_stage_columns_and_names(stages):
    assert [n for n, *_ in stages] == ["language_id", "simhash_dedup", "decontaminate", "mix_sources", "token_output"]
    for _, _, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stage_language(stages):
    _, before, after = stages[0]
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert {1, 2, 3, None} <= gone and not any(i is not None and i >= 100 for i in gone)


def test_stage_near_duplicates(stages):
    from .test_dedup_mix import slow_near_duplicates
    _, before, after = stages[1]
    classes = slow_near_duplicates([tuple(r) for r in before.collect()])
    assert sorted(repr(r.doc_id) for r in after.collect()) == sorted({c for *_, c in classes})


def test_stage_decontamination(stages):
    _, before, after = stages[2]
    gone = Counter(r.doc_id for r in before.collect()) - Counter(r.doc_id for r in after.collect())
    assert gone == Counter({300: 1, 301: 1, 302: 1})


def test_stage_mix(stages):
    from .test_dedup_mix import slow_targets
    _, before, after = stages[3]
    size, source = {}, {}
    for r in before.collect():
        size[r.doc_id], source[r.doc_id] = len((r.text or "").encode().split()), r.source
    sizes, taken = Counter(), Counter()
    for i, s in source.items():
        sizes[s] += size[i]
    for r in after.collect():
        taken[source[r.doc_id]] += size[r.doc_id]
    for s, target in slow_targets(dict(sizes)).items():
        assert abs(taken[s] - target) <= max([size[i] for i in size if source[i] == s]) / 2 + 1


def test_stage_mix_deals_and_shuffles(spark):
    """The stage's rows come by shard, in the order of the shuffle inside it."""
    import corpus_pipeline
    from storelens.llm import mixing
    docs = frame(spark, [(i, prose(20, i), "en", f"s{i % 3}", 1) for i in range(200)], clash=False)
    want = [r.doc_id for r in mixing.mix(docs, shard="shard").collect()]
    got = [r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SMOKE).collect()]
    assert got == want and got != sorted(got)


def test_stage_tokens(spark, stages, vocabulary):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(vocabulary)
    _, before, after = stages[4]
    want = Counter()
    for r in before.collect():
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = after.orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False))


def test_stages_on_no_rows(spark):
    import corpus_pipeline
    docs = frame(spark, [], clash=False)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMOKE)
        assert docs.count() == 0


def test_pipeline_runs_over_documents(spark):
    import corpus_pipeline
    got = corpus_pipeline.run(spark, SMOKE).orderBy("start").collect()
    assert len(got) > 150 and got[0].start == 0


# -- other vocabularies, archives of other writers, odd parts --------------------------

def _vocabularies(folder):
    from tokenizers import AddedToken, Tokenizer, models, normalizers, pre_tokenizers
    letters = {c: i for i, c in enumerate("ĠabcdefABCDEFĊ")}
    byte = Tokenizer(models.BPE({**letters, "Ġa": 20, "ab": 21}, [("Ġ", "a"), ("a", "b")]))
    byte.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    cased = Tokenizer(models.WordLevel({"[UNK]": 0, "ab": 1, "AB": 2, "c": 3}, "[UNK]"))
    cased.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    folded = Tokenizer(models.WordLevel({"[UNK]": 0, "ab": 1, "c": 3, "<Sep>": 9}, "[UNK]"))
    folded.normalizer, folded.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.WhitespaceSplit()
    folded.add_special_tokens([AddedToken("<Sep>", normalized=False)])
    marked = Tokenizer(models.BPE({"▁": 0, "a": 1, "b": 2, "▁a": 3}, [("▁", "a")]))
    marked.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    out = {}
    for name, one in {"byte": byte, "cased": cased, "folded": folded, "marked": marked}.items():
        out[name] = str(folder / f"{name}.json")
        one.save(out[name])
    return out


@pytest.mark.parametrize("name", ["byte", "cased", "folded", "marked"])
def test_any_vocabulary_gives_its_own_ids(tmp_path, name):
    from tokenizers import Tokenizer
    from storelens.llm.tokens import Encoder
    path = _vocabularies(tmp_path)[name]
    encoder, whole, rng = Encoder(path), Tokenizer.from_file(path), random.Random(name)
    assert encoder.by_words == (name in ("cased", "folded"))
    parts = ["ab", "AB", "c", "a", "b", " ", "  ", "\n", "\t", "<Sep>", "<sep>", "<SEP>", " a"]
    texts = ["", *("".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(300))]
    got = encoder.encode([t.encode() for t in texts], 7)
    assert [g.tolist() for g in got] == [[*whole.encode(t, add_special_tokens=False).ids, 7] for t in texts]


def test_the_given_vocabulary_goes_word_by_word(vocabulary):
    from storelens.llm.tokens import Encoder
    encoder = Encoder(vocabulary)
    assert encoder.by_words and encoder.folds and encoder.plain
    import public_tokenizers
    assert not Encoder(str(public_tokenizers.path("byte_bpe_50k.json"))).by_words


def _foreign(kind, block, version="WARC/1.0", **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{kind}>", "WARC-Date": "2020-01-01T00:00:00Z",
            **{k.replace("_", "-"): v for k, v in fields.items()}, "Content-Length": str(len(block))}
    lines = version + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(lines.encode() + block + b"\r\n\r\n")


def test_archive_of_another_writer():
    from storelens.llm import warc
    http = "application/http; msgtype=response"
    sha = base64.b32encode(hashlib.sha1(b"hi").digest()).decode()
    answer = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    data = b"".join([
        _foreign("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
        _foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", Content_Type="application/http; msgtype=request",
                 WARC_Target_URI="<http://a/>"),
        _foreign("response", answer, Content_Type=http, WARC_Target_URI="http://a/"),
        _foreign("response", answer, "WARC/1.1", Content_Type=http, WARC_Payload_Digest=f"sha1:{sha}",
                 WARC_Block_Digest="sha256:" + hashlib.sha256(answer).hexdigest()),
        _foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nhi\r\n0\r\n\r\n", Content_Type=http),
        _foreign("response", answer, Content_Type=http, WARC_Payload_Digest="xyz:abc"),
        _foreign("resource", b"<p>\r\n\r\n</p>", Content_Type="text/html", WARC_Target_URI="file:///x"),
        _foreign("metadata", b"")])
    got = list(warc.records(io.BytesIO(data), keep_payload=True))
    assert [r["record_type"] for r in got] == ["warcinfo", "request", *["response"] * 4, "resource", "metadata"]
    assert all(r["page_id"] is None and r["record_id"] == f"<urn:uuid:{r['record_type']}>" for r in got)
    assert [r["payload"] for r in got[2:]] == [b"hi", b"hi", b"2\r\nhi\r\n0\r\n\r\n", b"hi", b"<p>\r\n\r\n</p>", b""]
    assert got[1]["url"] == "http://a/" and got[2]["payload_digest"] == sha and got[0]["url"] is None
    wrong = _foreign("response", answer, Content_Type=http, WARC_Payload_Digest="md5:" + "0" * 32)
    with pytest.raises(ValueError, match="payload digest"):
        list(warc.records(io.BytesIO(wrong)))


@pytest.mark.parametrize("size", [float("nan"), float("inf"), -3, None])
def test_odd_sizes_of_parts_count_nothing(size):
    from storelens.llm.chat import Expansion, Visitor
    visitor = Visitor(Expansion())
    for part in ({"type": "audio", "seconds": size}, {"type": "image", "width": size, "height": 20},
                 {"type": "document", "pages": size}):
        visitor.visit(part)
    assert visitor.tokens == 0 and len(visitor.attachments) == 3


def test_a_megabyte_of_open_tags_takes_no_quadratic_time():
    import time
    from storelens.llm.langid import visible_text
    begin = time.perf_counter()
    assert visible_text("a<b>c" + "<" * 1_000_000) == "a c" + "<" * 1_000_000
    assert time.perf_counter() - begin < 5
