"""Chat formatting: conversations of typed content parts.

A visitor flattens the parts of a turn in order.  A text part becomes its
escaped text; an image, audio or document part becomes a placeholder, its
reference is recorded as an attachment and its tokens are counted as the
model will expand it.  A turn is formatted as

    <|turn|>ROLE\\nCONTENT<|end|>\\n

and the loss mask covers the content of assistant turns.  Control strings
inside roles and texts are escaped with a backslash after their first
character, backslashes are doubled; ``unescape`` restores the text exactly.

A turn is one output row, so a conversation of any length needs no group in
memory; a formatted conversation is its rows' pieces in order.

Defined results: a null text, part or reference counts as empty, a null
number as none; a null role is the empty role; a part of an unknown type is
its text; null turns come first, equal turns in the order of role and
formatted text;
rows with a null conversation id form one conversation; a turn without text
and parts has empty content; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
TURN, TURN_END = "<|turn|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROLS = [TURN, TURN_END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]",
            "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
TRAINED_ROLE = "assistant"

_HIDE = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROLS))
_SHOW = re.compile(r"\\(.)", re.DOTALL)
# a role ends at the first line end that isn't escaped
_HEAD = re.compile(r"((?:[^\\\n]|\\.)*)\n(.*)", re.DOTALL)


def escape(text: str) -> str:
    """Double backslashes, and break control strings by one."""
    return _HIDE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"\1", text)


@dataclass(frozen=True)
class Expansion:
    """Tokens that a placeholder stands for."""

    patch: int = 14
    audio_per_second: float = 25.0
    document_per_page: int = 512

    def image(self, width: int, height: int) -> int:
        return math.ceil(width / self.patch) * math.ceil(height / self.patch)

    def audio(self, seconds: float) -> int:
        return math.ceil(seconds * self.audio_per_second)

    def document(self, pages: int) -> int:
        return pages * self.document_per_page


def _amount(part: dict, name: str) -> float:
    """A size of a part; nothing, a negative and a non-finite one count as 0."""
    size = part.get(name) or 0
    return size if math.isfinite(size) and size > 0 else 0


@dataclass
class Visitor:
    """Flattens the parts of one turn."""

    expansion: Expansion
    content: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0
    length: int = 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.tokens += len(text.split())
        self._add(escape(text))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, self.expansion.image(_amount(part, "width"), _amount(part, "height")))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, self.expansion.audio(_amount(part, "seconds")))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, self.expansion.document(_amount(part, "pages")))
        if part.get("text"):  # the document's caption follows its placeholder
            self.visit_text(part)

    def _add(self, text: str) -> None:
        self.content.append(text)
        self.length += len(text)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref") or "", "at": self.length, "tokens": tokens})
        self.tokens += tokens
        self._add(PLACEHOLDERS[kind])


# Typed parts as a column: array of these structs.
PART_TYPE = ("array<struct<type: string, text: string, ref: string, width: int, height: int, "
             "seconds: double, pages: int>>")
_PIECE = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("piece", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()),
                                        ("tokens", pa.int64())]))),
    ("tokens", pa.int64())])
PIECE_DDL = ("conv_id long, turn long, role string, piece string, loss array<struct<start: long, `end`: long>>, "
             "attachments array<struct<kind: string, ref: string, at: long, tokens: long>>, tokens long")


def format_turn(role: str | None, parts: list[dict], expansion: Expansion = Expansion()) -> dict:
    """Formatted piece of one turn; loss spans and ``at`` count code points of the piece."""
    visitor = Visitor(expansion)
    for part in parts:
        visitor.visit(part or {})
    shown = escape(role or "").replace("\n", "\\\n")
    head = f"{TURN}{shown}\n"
    content = "".join(visitor.content)
    trained = role == TRAINED_ROLE and content
    return {"role": role, "piece": f"{head}{content}{TURN_END}\n",
            "loss": [{"start": len(head), "end": len(head) + len(content)}] if trained else [],
            "attachments": [a | {"at": a["at"] + len(head)} for a in visitor.attachments],
            "tokens": visitor.tokens}


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", parts: str | None = None,
                         expansion: Expansion = Expansion()) -> DataFrame:
    """One formatted piece for each turn.  ``parts`` names a column of
    ``PART_TYPE``; where it is null or not given the text is the only part."""
    typed = F.col(parts).cast(PART_TYPE) if parts else F.lit(None).cast(PART_TYPE)
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.col(role).alias("role"), F.col(text).alias("text"), typed.alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = row["parts"] if row["parts"] is not None else [{"type": "text", "text": row["text"]}]
                out.append({"conv_id": row["conv_id"], "turn": row["turn"],
                            **format_turn(row["role"], own, expansion)})
            yield pa.RecordBatch.from_pylist(out, schema=_PIECE)

    return rows.mapInArrow(run, PIECE_DDL)


def parse_piece(piece: str) -> tuple[str, str]:
    """Role and text of a formatted piece (placeholders stay as they are)."""
    if not piece.startswith(TURN) or not piece.endswith(TURN_END + "\n"):
        raise ValueError("not a formatted turn")
    both = _HEAD.fullmatch(piece[len(TURN):-len(TURN_END) - 1])
    return unescape(both[1]), unescape(both[2])


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from formatted pieces: number of turns,
    digests of all turns and of the text under the loss mask, and lengths.

    Rows are dealt by conversation and sorted; a task holds one turn and the
    running digests of one conversation.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, loss, counts = None, None, None, [0, 0, 0]

        def row() -> dict:
            return {"conv_id": now[0], "n_turns": counts[0], "turns_sha256": turns.hexdigest(),
                    "loss_chars": counts[1], "loss_sha256": loss.hexdigest(), "formatted_chars": counts[2]}

        for batch in batches:
            out = []
            for conv, piece, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss")),
                                          strict=True):
                if now != (conv,):
                    if now is not None:
                        out.append(row())
                    now, turns, loss, counts = (conv,), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                role, text = parse_piece(piece)
                turns.update(f"{role}\n{text}\n".encode())
                for span in spans:
                    shown = unescape(piece[span["start"]:span["end"]])
                    loss.update(shown.encode())
                    counts[1] += len(shown)
                counts[0] += 1
                counts[2] += len(piece)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    return (pieces.select("conv_id", "turn", "role", "piece", "loss").repartition("conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "piece").select("conv_id", "piece", "loss")
            .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                             "loss_sha256 string, formatted_chars long"))
