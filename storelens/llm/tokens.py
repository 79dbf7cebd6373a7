"""Token-ID output: Arrow files of fixed-size-list batches.

Documents go to files in ascending id order.  A file is in Arrow's IPC file
format, uncompressed: each batch has ``ids`` (fixed-size lists of the
sequence length) and ``mask`` (True on real ids), so any sequence is a slice
of a memory map, without copying.  Ids are 16 bits wide where the vocabulary
allows, else 32.  The ids of a file's documents are joined and cut into
sequences; the last one is filled up with the end id under a False mask.
Beside it lies the file's index (doc_id, start, n_tokens), start counted in
the file.

The tokenizer drops white space and no token spans it, so a text's ids are
the ids of its white-space-separated words, and a plain word's are those of
its runs of letters, digits and marks; a task encodes a run once and keeps a
bounded number of them for the next texts.

Defined results: a null or empty text has the end id only; repeated ids are
written as often as they stand, in the order of their texts; a null id comes
first; an empty table writes no file and reads as no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PIECE_BYTES, file_system, fresh_name, pieces, stored, utf8

SEQUENCE = 2048
END_ID = 2
# Sequences of one record batch, and runs or words that a generation keeps with their ids.
BATCH_SEQUENCES = 256
KEPT_WORDS = 200_000


# Words that the tokenizer's normaliser and splitter treat by simple rules, here plain
# words: printable ASCII without the apostrophe (contractions) and the letters of
# Latin-1.  They are lower-cased, and split into runs of letters, single digits and runs of marks.
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[ord("'")] = _OTHER
_KIND[list(b" \t\n\v\f\r")] = _SPACE
_KIND[list(b"0123456789")] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
# Letters of Latin-1 are c3 and one of these.
_SECOND = np.zeros(256, bool)
_SECOND[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True
_GAP = re.compile(rb"[ \t\n\v\f\r]")
# Byte-level alphabet: a visible Latin-1 character stands for itself, the others
# for the characters from 256 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [b for b in range(256) if b not in set(_SHOWN)]
_ALPHABET = [chr(256 + _HIDDEN.index(b)) if b in _HIDDEN else chr(b) for b in range(256)]
# Normalisers that treat each word of a text by itself.
_WORDWISE = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "BertNormalizer", "Replace", "Strip"}


class Encoder:
    """Texts to ids, word by word where the vocabulary allows it.

    It does if its normaliser works on single words and its pre-tokenizer drops
    white space; texts are lower-cased first only if it does so itself.  Any other
    vocabulary encodes whole texts.  The runs of plain words go straight to the
    vocabulary's merges, all other words through the whole tokenizer.  Both are kept
    with their ids in two generations, so frequent ones stay and memory is bounded.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.width = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        rules = json.loads(self.tokenizer.to_str())
        added = [t["content"].lower().encode() for t in rules["added_tokens"]]
        # what all added tokens begin with, without letters; no text has the byte ff
        self.prefix = re.match(rb"[^a-z\x80-\xff]*", os.path.commonprefix(added))[0] if added else b"\xff"
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        steps = self._normalisers(rules["normalizer"])
        self.by_words = self._drops_space(steps) and not any(re.search(rb"\s", t) for t in added)
        self.folds = any(s["type"] == "Lowercase" or s.get("lowercase") for s in steps)
        self.kept: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.plain = self.by_words and self.folds and rules["model"]["type"] == "BPE"
        self.plain = self.plain and self._splits_by_rule()

    @staticmethod
    def _normalisers(rule: dict | None) -> list[dict]:
        """The single steps of a normaliser's description."""
        if rule is None:
            return []
        if rule["type"] != "Sequence":
            return [rule]
        return [s for part in rule["normalizers"] for s in Encoder._normalisers(part)]

    def _drops_space(self, steps: list[dict]) -> bool:
        """Whether words between white space are encoded by themselves."""
        for s in steps:
            if s["type"] not in _WORDWISE or (
                    s["type"] == "Replace" and (s["pattern"].get("Regex"), s["content"]) != (r"\s+", " ")):
                return False
        if self.tokenizer.pre_tokenizer is None:
            return False
        probe = "ab  c\td\n\ne\r\nf\x0bg\x0ch "
        ends = [at for _, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
        return "".join(probe[lo:hi] for lo, hi in ends) == "abcdefgh"

    def _splits_by_rule(self) -> bool:
        """Whether this vocabulary treats plain words by the rules above."""
        words = ["Äb1", "x--Y2", "été", "ÿ/ß"]
        got = self.encode([w.encode() for w in words], 0)
        self.kept = {}
        return all(g.tolist()[:-1] == self.tokenizer.encode(w, add_special_tokens=False).ids
                   for g, w in zip(got, words, strict=True))

    def _units(self, text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Runs of the plain words and all other words of a text, where each
        begins and whether it is a run.  An added token's case matters, so words that
        may hold one stay as they are.
        """
        raw = np.frombuffer(text, np.uint8)
        kind = _KIND[raw]
        wide = np.flatnonzero(raw == 0xC3)
        paired = _SECOND[raw[np.minimum(wide + 1, len(raw) - 1)]]
        kind[wide[~paired]] = _OTHER
        wide = wide[paired]
        kind[wide] = kind[wide + 1] = _LETTER
        black = kind != _SPACE
        begins = black.copy()
        begins[1:] &= ~black[:-1]
        words = np.flatnonzero(begins)
        if not len(words):
            return pa.array([], pa.binary()), words, np.empty(0, bool)
        spans = np.diff(words, prepend=0, append=len(raw))  # white space before, then the words
        added = np.zeros(len(words), bool)
        if self.added and self.prefix in text:
            at = [m.start() for m in self.added.finditer(text.lower())]
            added[np.searchsorted(words, np.array(at, dtype=np.int64), "right") - 1] = True
        whole = added | np.logical_or.reduceat(kind == _OTHER, words) if self.plain else np.ones(len(words), bool)
        in_run = np.repeat(np.append(False, ~whole), spans) & black
        begins[1:] |= in_run[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        if self.folds:
            folded = _LOWER[raw]
            capital = wide[(raw[wide + 1] < 0x9F) & in_run[wide]] + 1
            folded[capital] += 0x20
            raw = np.where(np.repeat(np.append(False, added), spans), raw, folded) if added.any() else folded
        at = np.flatnonzero(begins)
        # behind one another in the text without its white space
        ends = np.append(np.flatnonzero(begins[black]), np.count_nonzero(black)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(raw[black])])
        return units, at, in_run[at]

    def _learn(self, units: list[bytes], runs: list[bool]) -> None:
        """Keep the ids of all units."""
        rest, tokenize, code = [], self.tokenizer.model.tokenize, "H" if self.width is np.uint16 else "I"
        for u, run in zip(units, runs, strict=True):
            if u in self.kept:
                continue
            ids = self.older.get(u)
            if ids is None and run:
                ids = array(code, [t.id for t in tokenize("".join([_ALPHABET[b] for b in u]))]).tobytes()
            if ids is None:
                rest.append(u)
            else:
                self.kept[u] = ids
        for lo in range(0, len(rest), 1000):
            part = rest[lo:lo + 1000]
            got = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part],
                                                   add_special_tokens=False)
            self.kept.update(zip(part, (np.array(e.ids, dtype=self.width).tobytes() for e in got), strict=True))

    def _encode_long(self, text: bytes, at: int, end: int) -> list[np.ndarray]:
        """The ids of a text by parts that end at white space, so memory follows a part."""
        got, lo = [], 0
        while lo < len(text):
            got.append(self.encode([text[lo:at]], end)[0])
            lo = at + 1
            gap = _GAP.search(text, lo + PIECE_BYTES)
            at = gap.start() if gap else len(text)
        return [np.concatenate([*(g[:-1] for g in got[:-1]), got[-1]])]

    def encode(self, texts: list[bytes], end: int) -> list[np.ndarray]:
        if not self.by_words:
            got = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts],
                                                   add_special_tokens=False)
            return [np.array([*e.ids, end], dtype=self.width) for e in got]
        if not texts:
            return []
        if len(texts) == 1 and len(texts[0]) > 2 * PIECE_BYTES and (gap := _GAP.search(texts[0], PIECE_BYTES)):
            return self._encode_long(texts[0], gap.start(), end)
        if len(self.kept) > KEPT_WORDS:
            self.older, self.kept = self.kept, {}
        units, at, in_run = self._units(b" ".join(texts))
        units = units.dictionary_encode()
        which, found = units.indices.to_numpy(), units.dictionary.to_numpy(zero_copy_only=False).tolist()
        runs = np.empty(len(found), bool)
        runs[which] = in_run
        self._learn(found, runs.tolist())
        # ids of the different units, the end id last, and where each unit's lie
        held = [*map(self.kept.__getitem__, found), np.array([end], dtype=self.width).tobytes()]
        table = np.frombuffer(b"".join(held), dtype=self.width)
        size = np.fromiter(map(len, held), np.int64, len(held)) // table.itemsize
        start = np.cumsum(size) - size
        # units up to the end of each text, with one end id for each
        upto = np.searchsorted(at, np.cumsum([len(t) + 1 for t in texts]))
        which = np.insert(which, upto, len(found))
        n = size[which]
        stop = np.cumsum(n)
        ids = table[np.arange(n.sum()) + np.repeat(start[which] - stop + n, n)]
        return np.split(ids, stop[upto + np.arange(len(texts))][:-1])


# Encoders outlive a task: Spark uses a Python worker for many.
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(vocabulary: str) -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


class _SequenceFile:
    """One Arrow file that grows by ids, with its index."""

    def __init__(self, folder: str, stem: str, width: type, sequence: int, end: int):
        self.sequence, self.end, self.width = sequence, end, width
        fs, base = file_system(folder)
        self.path = f"{folder}/{fresh_name(stem, '.arrow')}"
        name = self.path.rsplit("/", 1)[1]
        kind = pa.from_numpy_dtype(width)
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [fs.open_output_stream(f"{base}/{n}", compression=None)
                      for n in (name, name.replace(".arrow", ".index"))]
        self.out, self.index = (pa.ipc.new_file(s, k) for s, k in
                                zip(self.sinks, (self.schema, self.index_schema), strict=True))
        self.held: list[np.ndarray] = []
        self.size = self.total = self.docs = 0

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.out.write_batch(pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(ids), self.sequence),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence)], schema=self.schema))

    def add(self, doc_ids: list, ids: list[np.ndarray]) -> None:
        n = np.array([len(x) for x in ids], dtype=np.int64)
        starts = self.total + np.cumsum(n) - n
        self.index.write_batch(pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(n)], schema=self.index_schema))
        self.held += ids
        self.size += int(n.sum())
        self.total += int(n.sum())
        self.docs += len(ids)
        step = self.sequence * BATCH_SEQUENCES
        if self.size >= step:
            flat = np.concatenate(self.held)
            whole = len(flat) // step * step
            for lo in range(0, whole, step):
                self._write(flat[lo:lo + step], step)
            self.held, self.size = [flat[whole:]], len(flat) - whole

    def close(self) -> dict:
        flat = np.concatenate(self.held) if self.size else np.empty(0, self.width)
        if len(flat):
            fill = -len(flat) % self.sequence
            self._write(np.concatenate([flat, np.full(fill, self.end, self.width)]), len(flat))
        for x in (self.out, self.index, *self.sinks):
            x.close()
        return {"path": self.path, "docs": self.docs, "n_tokens": self.total}


def write(docs: DataFrame, folder: str, vocabulary: str, key: str = "doc_id", text: str = "text",
          sequence: int = SEQUENCE, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Write the ids of ``docs`` below the shared ``folder``; returns the table
    of files (part, path, docs, n_tokens, base): base counts the ids of all
    files before.  ``vocabulary`` is a tokenizers file that executors can read.

    Rows are dealt by ranges of the id.  Each attempt of a task writes files
    of its own names; the table has those of the accepted attempts.
    """
    spark = docs.sparkSession
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, out = None, None
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            if encoder is None and texts:
                encoder = encoder_of(vocabulary)
                out = _SequenceFile(folder, f"part-{part:05d}", encoder.width, sequence, end_id)
            for lo, hi in pieces(texts):
                out.add(ids[lo:hi], encoder.encode(texts[lo:hi], end_id))
        if out is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, **out.close()}], schema=schema)

    rows = docs.select(F.col(key).cast("long").alias("id"), utf8(text).alias("t"))
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    files, _ = stored(rows.repartitionByRange(partitions, "id", F.xxhash64("t")).sortWithinPartitions("id", "t")
                      .mapInArrow(run, "part int, path string, docs long, n_tokens long"), "token-files")
    # one row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _open(path: str):
    fs, base = file_system(path)
    if fs.type_name == "local":
        return pa.memory_map(base)
    return fs.open_input_file(base)


class SequenceReader:
    """Random access to the sequences of one file."""

    def __init__(self, path: str):
        self.file = pa.ipc.open_file(_open(path))
        self.sequence = self.file.schema.field("ids").type.list_size
        self.held: tuple[int, np.ndarray, pa.Array] | None = None

    def _batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        if self.held is None or self.held[0] != k:
            batch = self.file.get_batch(k)
            self.held = (k, batch.column(0).flatten().to_numpy(zero_copy_only=True), batch.column(1).flatten())
        return self.held[1:]

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence ``i`` and its mask; the ids are a view of the file."""
        ids, mask = self._batch(i // BATCH_SEQUENCES)
        at = i % BATCH_SEQUENCES * self.sequence
        return (ids[at:at + self.sequence],
                mask.slice(at, self.sequence).to_numpy(zero_copy_only=False))

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids start .. start + n - 1 in views of at most a batch."""
        step = self.sequence * BATCH_SEQUENCES
        while n:
            ids, mask = self._batch(start // step)
            at = start % step
            part = ids[at:at + min(n, step - at)]
            if not len(part) or mask.slice(at, len(part)).false_count:
                raise ValueError("the index points behind the file's ids")
            yield part
            start, n = start + len(part), n - len(part)


def read_digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = SequenceReader(path)
                index = pa.ipc.open_file(_open(path.replace(".arrow", ".index")))
                for k in range(index.num_record_batches):
                    docs = index.get_batch(k)
                    crcs = []
                    for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True):
                        crc = 0
                        for part in reader.ids(start, n):
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    yield pa.RecordBatch.from_arrays([
                        docs.column(0), pa.array(docs.column(1).to_numpy() + base), docs.column(2),
                        pa.array(crcs, pa.int64())], schema=schema)

    spark = files.sparkSession
    tasks = max(1, min(files.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return files.select("path", "base").repartition(tasks, "path").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
