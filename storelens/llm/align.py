"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked ids.

The tokens of both sides are cut into groups at the byte offsets where tokens
of both end; every pair of tokens in a group is a link.  How many documents
hold a pair of ids linked is counted by external runs:

* A task encodes its documents chunk by chunk.  A chunk's records (A id, B id,
  document, links) are sorted with the A side first, dealt by the leading bits
  of the (scrambled) A id to radix parts, and written as zstd runs to a table in
  the shared folder: the pairs with their numbers of documents in one column,
  the documents in another.
* The counts of a part are merged from at most FAN_IN runs at a time by a heap
  over their A ids, level by level, until one run is left; as an A id's pairs
  follow each other there, its highest count is known when it ends.
* The runs are read again beside the counts of their part and stream what they
  add to each document back to the document's chunk, where it is summed.

A run has no more rows than its chunk has distinct pairs, so a token that every
document holds costs one number a chunk; tasks hold FAN_IN runs of a part or one
chunk.  Parts follow ``spark.sql.shuffle.partitions`` up to 4096.

Texts are encoded by units: a space, and what follows up to the next single
space before a character that isn't white space.  Neither side joins anything
across such a place if the A vocabulary is byte-level BPE with its usual pattern
and no B piece holds a space after another character; for other vocabularies the
unit is the whole text.  Results of units are kept, as texts repeat them.

Defined results: a text that is null, empty, not valid UTF-8, or that either
side's tokens don't spell has no tokens (zeros, an empty digest); rows with one
id are separate documents; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored, utf8

CHUNK_BYTES = 16_000_000  # text of a chunk; a longer document stands alone
CHUNK_DOCS = 1 << 16
FAN_IN = 64  # runs that one merge reads
KEPT_UNITS = 400_000  # units kept between the chunks of a worker
WIDE = 4096  # groups of more links count the ids of both sides first

DOCS = ("array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_DOC = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                  ("n_links", pa.int64()), ("groups_sha256", pa.string())])
_RUNS = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("heads", pa.binary()), ("body", pa.binary()),
                   ("docs", pa.list_(_DOC))])
_BREAK = re.compile(r"(?<! ) (?=\S)")


# -- runs ------------------------------------------------------------------------

def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers >= 0 as one zstd frame, each in its least width."""
    out = []
    for c in columns:
        top = int(c.max()) if len(c) else 0
        width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
        out.append(np.array([width, len(c)], np.int64).tobytes() + c.astype(f"<u{width}").tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        width, n = np.frombuffer(raw, np.int64, 2, at).tolist()
        out.append(np.frombuffer(raw, f"<u{width}", n, at + 16).astype(np.int64))
        at += 16 + width * n
    return out


def pack_counts(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    return pack(np.diff(pairs, prepend=0), counts)


def unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = unpack(data)
    return np.cumsum(steps), counts


def _sides(run: int, pairs: np.ndarray, b_bits: int) -> Iterator[tuple[int, int, int, int]]:
    """(A id, run, from, to) of each A id of a run."""
    a = pairs >> b_bits
    first = np.flatnonzero(np.diff(a, prepend=-1))
    for side, lo, hi in zip(a[first].tolist(), first.tolist(), [*first[1:].tolist(), len(a)], strict=True):
        yield side, run, lo, hi


def merge_counts(runs: list[tuple[np.ndarray, np.ndarray]], b_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs and summed counts of sorted runs, one A id after the other."""
    merged = heapq.merge(*(_sides(k, pairs, b_bits) for k, (pairs, _) in enumerate(runs)))
    for _, group in itertools.groupby(merged, key=lambda g: g[0]):
        held = list(group)
        if len(held) == 1:
            _, k, lo, hi = held[0]
            yield runs[k][0][lo:hi], runs[k][1][lo:hi]
            continue
        pairs = np.concatenate([runs[k][0][lo:hi] for _, k, lo, hi in held])
        counts = np.concatenate([runs[k][1][lo:hi] for _, k, lo, hi in held])
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        yield pairs[first], np.add.reduceat(counts, first)


# -- encoding and groups -----------------------------------------------------------

def _byte_alphabet() -> dict[str, int]:
    """Characters of a byte-level vocabulary: printable bytes stand for themselves,
    the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Sides:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        alphabet = _byte_alphabet()
        n_a = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        entries = [self.a.id_to_token(i) or "" for i in range(n_a)]
        self.a_bytes = [bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else e.encode() for e in entries]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(names)]
        self.a_bits, self.b_bits = max(len(entries) - 1, 1).bit_length(), max(len(names) - 1, 1).bit_length()
        self.by_units = self._by_units(names)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = (
            {sep: np.array([b"%d%s" % (i, sep) for i in range(len(t))], dtype=object) for sep in seps}
            for t, seps in ((self.a_bytes, (b",", b"|")), (self.b_bytes, (b",", b";"))))

    def _by_units(self, names: list[str]) -> bool:
        spec = json.loads(self.a.to_str())
        split = spec.get("pre_tokenizer") or {}
        usual = (split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
                 and not spec.get("normalizer") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout"))
        probe = "x▁ y  z \n w"
        return bool(usual and not any("▁" in p.lstrip("▁") for p in names)
                    and self.b.normalize(probe).replace("▁", " ") == " " + probe.replace("▁", " "))

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides of a space and each part."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        return a, self.b.encode(parts, num_threads=1)


def links(a: list[list[int]], b: list[list[int]], sides: Sides) -> tuple[np.ndarray, ...]:
    """Groups and links of units whose tokens of both sides spell the same bytes:
    (groups, links) by unit, distinct pairs with their links and offsets by
    unit, and the groups written out."""
    n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    a_ids, b_ids = (np.fromiter(itertools.chain.from_iterable(x), np.int64, n.sum()) for x, n in ((a, n_a), (b, n_b)))
    a_unit, b_unit = np.repeat(np.arange(len(a)), n_a), np.repeat(np.arange(len(b)), n_b)
    a_end, b_end = np.cumsum(sides.a_size[a_ids]), np.cumsum(sides.b_size[b_ids])
    ends = np.intersect1d(a_end, b_end)
    a_group, b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
    of_a, of_b = np.bincount(a_group, minlength=len(ends)), np.bincount(b_group, minlength=len(ends))
    a_first, b_first = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
    unit = a_unit[a_first] if len(ends) else np.empty(0, np.int64)
    total = of_a * of_b
    n_groups = np.bincount(unit, minlength=len(a))
    n_links = np.bincount(unit, weights=total, minlength=len(a)).astype(np.int64)

    # every A token with every B token of its group
    near = total <= WIDE
    use = near[a_group]
    times = of_b[a_group[use]]
    at = np.repeat(b_first[a_group[use]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    keys, weights = [], []
    shift = sides.a_bits + sides.b_bits
    keys.append((np.repeat(a_unit[use], times) << shift) | (np.repeat(a_ids[use], times) << sides.b_bits) | b_ids[at])
    weights.append(np.ones(len(at), np.int64))
    for g in np.flatnonzero(~near).tolist():
        ga, na = np.unique(a_ids[a_first[g]:a_first[g] + of_a[g]], return_counts=True)
        gb, nb = np.unique(b_ids[b_first[g]:b_first[g] + of_b[g]], return_counts=True)
        keys.append(((unit[g] << shift) | (ga[:, None] << sides.b_bits) | gb[None, :]).ravel())
        weights.append((na[:, None] * nb[None, :]).ravel())
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    pairs = keys[first] & ((1 << shift) - 1)
    weights = np.add.reduceat(weights, first) if len(first) else weights
    offsets = np.searchsorted(keys[first] >> shift, np.arange(len(a) + 1))

    # tokens in the order a1,a2|b1;a3|b2,b3
    words = np.empty(len(a_ids) + len(b_ids), dtype=object)
    a_more, b_more = (np.append(x[1:] == x[:-1], False) for x in (a_group, b_group))
    a_at = np.arange(len(a_ids)) + b_first[a_group]
    b_at = np.arange(len(b_ids)) + (a_first + of_a)[b_group]
    for ids, place, more, text, last in ((a_ids, a_at, a_more, sides.a_text, b"|"), (b_ids, b_at, b_more, sides.b_text, b";")):
        words[place[more]] = text[b","][ids[more]]
        words[place[~more]] = text[last][ids[~more]]
    words, cut = words.tolist(), np.cumsum([0, *(n_a + n_b).tolist()]).tolist()
    written = [b"".join(words[lo:hi])[:-1] for lo, hi in itertools.pairwise(cut)]
    return n_groups, n_links, pairs, weights, offsets, written


class Units:
    """Encoded units of a worker: their sizes, distinct pairs and written groups."""

    def __init__(self, sides: Sides):
        self.sides = sides
        self.clear()

    def clear(self) -> None:
        self.plain: dict[str, int] = {}
        self.odd: dict[str, int] = {}
        self.sizes = np.empty((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.pairs = self.weights = np.empty(0, np.int64)
        self.offsets = np.zeros(1, np.int64)
        self.written: list[bytes | None] = []  # None: the two sides don't spell the unit

    def _learn(self, parts: list[str]) -> None:
        a, b = self.sides.encode(parts)
        a_bytes, b_bytes = self.sides.a_bytes, self.sides.b_bytes
        spelt = []
        for p, x, y in zip(parts, a, b, strict=True):
            whole = b" " + p.encode()
            spelt.append(b"".join([a_bytes[i] for i in x]) == whole and b"".join([b_bytes[i] for i in y]) == whole)
        empty: list[int] = []
        a, b = ([x if ok else empty for x, ok in zip(side, spelt, strict=True)] for side in (a, b))
        n_groups, n_links, pairs, weights, offsets, written = links(a, b, self.sides)
        sizes = np.stack([[len(x) for x in a], [len(x) for x in b], n_groups, n_links], axis=1)
        self.sizes = np.concatenate([self.sizes, sizes])
        self.offsets = np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])
        self.pairs, self.weights = np.concatenate([self.pairs, pairs]), np.concatenate([self.weights, weights])
        self.written += [w if ok else None for w, ok in zip(written, spelt, strict=True)]

    def _find(self, new: list[tuple[dict, str]]) -> None:
        for lo in range(0, len(new), 20_000):
            part = new[lo:lo + 20_000]
            base = len(self.written)
            self._learn([p for _, p in part])
            for k, (names, p) in enumerate(part):
                names[p] = base + k

    def of(self, texts: list[str | None]) -> list[list[int]]:
        """Units of each text (null or empty: none)."""
        split: list[tuple[list[dict] | None, list[str]]] = []
        missing: dict[tuple[int, str], dict] = {}
        for t in texts:
            if not t:
                split.append((None, []))
                continue
            parts = t.split(" ") if self.sides.by_units else [t]
            names = None
            fresh = [p for p in parts if p not in self.plain]
            if not self.sides.by_units or any(not p or p[0].isspace() for p in fresh):
                if self.sides.by_units:
                    first, *parts = _BREAK.split(" " + t)
                    if first:
                        parts.insert(0, first[1:])
                names = [self.odd if not self.sides.by_units or not p or p[0].isspace() else self.plain for p in parts]
                for d, p in zip(names, parts, strict=True):
                    if p not in d:
                        missing[id(d), p] = d
            else:
                for p in fresh:
                    missing[id(self.plain), p] = self.plain
            split.append((names, parts))
        self._find([(d, p) for (_, p), d in missing.items()])
        find = self.plain.__getitem__
        return [[d[p] for d, p in zip(names, parts, strict=True)] if names else list(map(find, parts))
                for names, parts in split]


# Workers outlive a task: Spark uses a Python worker for many.
_UNITS: dict[tuple[str, str], Units] = {}


def units_of(a_file: str, b_file: str) -> Units:
    if (a_file, b_file) not in _UNITS:
        _UNITS[a_file, b_file] = Units(Sides(a_file, b_file))
    return _UNITS[a_file, b_file]


def _text(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


class _Chunk:
    """Documents of a task up to CHUNK_BYTES, with their records."""

    def __init__(self, units: Units, parts_bits: int):
        self.units, self.parts_bits = units, parts_bits
        self.docs: list[dict] = []
        self.keys: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: list, texts: list[bytes]) -> None:
        units, sides = self.units, self.units.sides
        found = units.of([_text(t) for t in texts])
        for k, doc in enumerate(found):
            if any(units.written[u] is None for u in set(doc)):
                found[k] = []
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int64)
        count = [len(doc) for doc in found]
        ends = np.cumsum(count)
        sums = np.zeros((len(flat) + 1, 4), np.int64)
        np.cumsum(units.sizes[flat], axis=0, out=sums[1:])
        sizes = (sums[ends] - sums[ends - count]).tolist()
        # records of every unit, once for each of its links
        doc = np.repeat(np.arange(len(self.docs), len(self.docs) + len(found)), count)
        lo, hi = units.offsets[flat], units.offsets[flat + 1]
        times = hi - lo
        at = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
        keys = (scrambled(units.pairs[at], sides) << 24) | np.repeat(doc, times)
        self.keys.append(np.repeat(keys, units.weights[at]))
        for i, doc, (n_a, n_b, n_groups, n_links) in zip(ids, found, sizes, strict=True):
            digest = hashlib.sha256(b";".join([units.written[u] for u in doc])).hexdigest() if n_a else ""
            self.docs.append({"doc_id": i, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
                              "groups_sha256": digest})
        self.size += sum(map(len, texts))

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        """The chunk's documents and its runs, one for each part that has pairs."""
        sides = self.units.sides
        bits = sides.a_bits + sides.b_bits
        keys = np.concatenate(self.keys)
        self.keys = []
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        weights = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        pairs, docs = keys >> 24, keys & 0xFFFFFF
        part = pairs >> (bits - self.parts_bits)
        rows = [{"chunk": chunk, "part": -1, "heads": None, "body": None, "docs": self.docs}]
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True):
            new = np.flatnonzero(np.diff(pairs[lo:hi], prepend=-1))
            counts = np.diff(np.append(new, hi - lo))
            rows.append({"chunk": chunk, "part": int(part[lo]), "heads": pack_counts(pairs[lo:hi][new], counts),
                         "body": pack(docs[lo:hi], weights[lo:hi] - 1), "docs": None})
        yield pa.RecordBatch.from_pylist(rows, schema=_RUNS)


def scrambled(pairs: np.ndarray, sides: Sides) -> np.ndarray:
    """Pairs with their A id multiplied by an odd number within its bits, so that
    its leading bits deal frequent ids evenly; no two ids meet."""
    a, b = pairs >> sides.b_bits, pairs & ((1 << sides.b_bits) - 1)
    return (((a * 40503) & ((1 << sides.a_bits) - 1)) << sides.b_bits) | b


# -- the whole corpus ------------------------------------------------------------------

def _merge(b_bits: int):
    def run(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        groups = list(merge_counts([unpack_counts(h) for h in held["heads"]], b_bits))
        heads = pack_counts(*(np.concatenate(c) for c in zip(*groups, strict=True)))
        return pd.DataFrame({"part": [key[0]], "chunk": [key[1]], "heads": [heads]})
    return run


def _contribute(b_bits: int):
    """What the runs of a part add to the documents of their chunks."""
    def run(key: tuple, runs: pd.DataFrame, whole: pd.DataFrame) -> pd.DataFrame:
        pairs, counts = unpack_counts(whole["total"].iloc[0])
        a_first = np.flatnonzero(np.diff(pairs >> b_bits, prepend=-1))
        best = counts == np.repeat(np.maximum.reduceat(counts, a_first), np.diff(np.append(a_first, len(pairs))))
        out = []
        for chunk, heads, body in zip(runs["chunk"], runs["heads"], runs["body"], strict=True):
            own, n_docs = unpack_counts(heads)
            docs, weights = unpack(body)
            weights = weights + 1
            at = np.repeat(np.searchsorted(pairs, own), n_docs)
            order = np.argsort(docs, kind="stable")
            first = np.flatnonzero(np.diff(docs[order], prepend=-1))
            n_best = np.add.reduceat((weights * best[at])[order], first)
            total = np.add.reduceat((weights * counts[at])[order], first)
            out.append((chunk, pack(docs[order][first], n_best, total)))
        return pd.DataFrame(out, columns=["chunk", "added"])
    return run


def _finish(key: tuple, held: pd.DataFrame, added: pd.DataFrame) -> pd.DataFrame:
    docs = held["docs"].iloc[0]
    n_best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    for data in added["added"]:
        at, best, sums = unpack(data)
        n_best[at] += best
        total[at] += sums
    out = pd.DataFrame(list(docs))
    out["n_best"], out["count_sum"] = n_best, total
    return out[["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]].astype(
        {"doc_id": "Int64"})


def align(docs: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text",
          chunk_bytes: int = CHUNK_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """Alignment counts of every document.  ``a_file`` is a byte-level tokenizers
    file and ``b_file`` a sentencepiece model; executors read both."""
    spark = docs.sparkSession
    sides = Sides(a_file, b_file)
    if sides.a_bits + sides.b_bits > 39:
        raise ValueError("the two vocabularies need more than 39 bits for a pair")
    b_bits = sides.b_bits
    parts_bits = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4096, 1 << sides.a_bits).bit_length() - 1

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = units_of(a_file, b_file)
        base, made = TaskContext.get().partitionId() << 32, 0
        chunk = _Chunk(units, parts_bits)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in pieces(texts):
                coming = sum(map(len, texts[lo:hi]))
                if chunk.docs and (chunk.size + coming > chunk_bytes or len(chunk.docs) + hi - lo > CHUNK_DOCS):
                    yield from chunk.rows(base + made)
                    made += 1
                    if len(units.written) > KEPT_UNITS:
                        units.clear()
                    chunk = _Chunk(units, parts_bits)
                chunk.add(ids[lo:hi], texts[lo:hi])
        if chunk.docs:
            yield from chunk.rows(base + made)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("t"))
    runs, _ = stored(rows.mapInArrow(encode, f"chunk long, part int, heads binary, body binary, docs {DOCS}"),
                     "align-runs")
    chunks = runs.where("part = -1").count()
    pairs = runs.where("part >= 0")
    groups = -(-chunks // fan_in)
    totals, left = pairs.select("part", "chunk", "heads"), max(chunks, 1)
    while True:
        left = -(-left // fan_in)
        totals = totals.groupBy("part", F.pmod(F.xxhash64("chunk"), F.lit(left)).alias("fan")).applyInPandas(
            _merge(b_bits), "part int, chunk long, heads binary")
        if left == 1:
            break
    totals, _ = stored(totals.select("part", F.col("heads").alias("total")), "align-totals")
    dealt = pairs.select("part", "chunk", "heads", "body",
                         F.pmod(F.xxhash64("chunk"), F.lit(max(groups, 1))).alias("fan"))
    # each group of runs has the counts of its part beside it
    wanted = dealt.select("part", "fan").distinct().join(totals, "part").toDF("of_part", "of_fan", "total")
    added = dealt.groupBy("part", "fan").cogroup(wanted.groupBy("of_part", "of_fan")).applyInPandas(
        _contribute(b_bits), "chunk long, added binary")
    return runs.where("part = -1").select("chunk", "docs").groupBy("chunk").cogroup(
        added.groupBy("chunk")).applyInPandas(_finish, RESULT)
