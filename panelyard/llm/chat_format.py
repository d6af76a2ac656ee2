"""Chat formatting of typed content parts, reversible, with a loss mask.

A turn's content is a list of parts: text, image, audio or document. A visitor turns them, in order, into one string:
texts as they are but for escapes, every attachment as a placeholder line that names its number in the conversation. What
the placeholder stands for is recorded beside it: kind, reference, place in the formatted text and the number of tokens it
expands to (image patches, audio frames, document pages).

    <turn user>
    look at this
    <image 0>
    what is it?
    </turn>

Control strings (``CONTROL``) inside texts get one more backslash in front, behind any backslashes that already stand
there; reading takes it away again. Template marks always follow a line break or the start, never a backslash, so every
text, whatever it holds, comes back unchanged. Roles are escaped in full.

Formatted conversations are rows of whole turns (``chunk`` of about ``CHUNK`` code points), so a conversation of any
length is written and read piece by piece. Turns are formatted where they lie; only the joining of one conversation's turns
is in order, as a stream: memory is bounded by a chunk and one turn, whatever the length of a conversation. One hash of a
whole conversation is sequential by its nature, so one task reads a long conversation's chunks for it; conversations of
one chunk, which nearly all are, are read where they lie.

Defined results. A null text is empty, a null role the empty role, null or empty content an empty turn; unknown kinds of
parts are an error. Turns of equal number are ordered by role, then text; a null number comes first. Rows with a null
conv_id are one conversation. Repeated rows are all turns. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import slices

KINDS = ("image", "audio", "document")
CONTROL = rf"</?turn|<(?:{'|'.join(KINDS)}) "
#: Tokens that attachments expand to: one per image patch, audio frames a second, tokens a page.
PATCH, FRAMES, PAGE_TOKENS = 14, 25, 256
CHUNK = 1 << 18
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<number:bigint,kind:string,ref:string,at:bigint,tokens:bigint>"
FORMATTED = (f"conv_id bigint, chunk bigint, last boolean, n_turns bigint, text string, loss array<bigint>, attachments array<{ATTACHMENT}>")

_ESCAPE, _UNESCAPE = re.compile(rf"(\\*(?:{CONTROL}))"), re.compile(rf"\\(\\*(?:{CONTROL}))")
_PLACE = re.compile(rf"\n<({'|'.join(KINDS)}) (\d+)>\n")
_TURN = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n(.*?)\n</turn>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace(">", "\\>").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


@dataclass
class Formatter:
    """Visits the parts of a conversation's turns; ``numbers`` counts its attachments across chunks."""

    patch: int = PATCH
    frames: float = FRAMES
    page_tokens: int = PAGE_TOKENS
    numbers: int = 0
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    size: int = 0

    def put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.size += len(piece)

    def visit(self, part: dict) -> None:
        method = getattr(self, f"visit_{part['kind']}", None)
        if method is None:
            raise ValueError(f"unknown kind of content part: {part['kind']}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self.put(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (-(-(part.get(side) or 0) // self.patch) for side in ("width", "height"))
        self.attach(part, across * down)

    def visit_audio(self, part: dict) -> None:
        self.attach(part, math.ceil((part.get("seconds") or 0.0) * self.frames))

    def visit_document(self, part: dict) -> None:
        self.attach(part, (part.get("pages") or 0) * self.page_tokens)

    def attach(self, part: dict, tokens: int) -> None:
        self.attachments.append({"number": self.numbers, "kind": part["kind"], "ref": part.get("ref"), "at": self.size + 1, "tokens": tokens})
        self.put(f"\n<{part['kind']} {self.numbers}>\n")
        self.numbers += 1

    def turn(self, role: str, parts: list[dict]) -> tuple[int, int]:
        """Formats one turn and gives the [start, end) of its content."""
        self.put(f"<turn {escape_role(role)}>\n")
        start, text = self.size, []
        for part in [*parts, None]:  # neighbouring texts are one, so that their joint can't form a control string
            if part is not None and part["kind"] == "text":
                text.append(part.get("text") or "")
                continue
            if text:
                self.visit({"kind": "text", "text": "".join(text)})
                text = []
            if part is not None:
                self.visit(part)
        end = self.size
        self.put("\n</turn>\n")
        return start, end

    def chunk(self) -> tuple[str, list[dict]]:
        out = "".join(self.pieces), self.attachments
        self.pieces, self.attachments, self.size = [], [], 0
        return out


def read_turns(formatted: str) -> Iterator[tuple[str, list[str | tuple[str, int]], tuple[int, int]]]:
    """(role, content, span of the content) of each turn; content is texts and (kind, number) in order."""
    at = 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError("not a formatted conversation")
        at, parts = found.end(), _PLACE.split(found[2])
        content: list = []
        for i in range(0, len(parts), 3):
            if parts[i]:
                content.append(unescape(parts[i]))
            if i + 1 < len(parts):
                content.append((parts[i + 1], int(parts[i + 2])))
        yield unescape_role(found[1]), content, found.span(2)


def contents(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and content (typed parts) from a table with ``content``, or with ``text`` alone."""
    ids = [F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role")]
    if "content" in conversations.columns:
        return conversations.select(*ids, F.col("content").cast(f"array<{PART}>").alias("content"))
    text = F.struct(F.lit("text").alias("kind"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
                    F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))
    return conversations.select(*ids, F.array(text).cast(f"array<{PART}>").alias("content"))


def format_conversations(conversations: DataFrame, trained: tuple[str, ...] = ("assistant",), chunk: int = CHUNK, **tokens) -> DataFrame:
    """One row for each chunk of a conversation: its text, the spans under the loss mask (flat start, end pairs of code
    points of this chunk, the contents of turns of the roles in ``trained``) and the attachments."""
    first = F.transform("content", lambda part: F.coalesce(part["text"], F.lit("")))
    turns = contents(conversations).withColumn("order", F.concat_ws("", first))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "order").drop("order")

    def run(batches):
        current, formatter, loss, n, number = object(), None, [], 0, 0

        def row(last: bool) -> pa.RecordBatch:
            text, attached = formatter.chunk()
            return pa.RecordBatch.from_pydict({
                "conv_id": pa.array([current], pa.int64()), "chunk": pa.array([number], pa.int64()), "last": pa.array([last]), "n_turns": pa.array([n], pa.int64()),
                "text": pa.array([text], pa.string()), "loss": pa.array([loss], pa.list_(pa.int64())),
                "attachments": pa.array([attached], pa.list_(pa.struct([("number", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])))})

        def joined(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.Table.from_batches(rows).combine_chunks().to_batches()[0]

        held: list[pa.RecordBatch] = []
        for part in slices(batches):
            for conv, role, content in zip(*(part.column(c).to_pylist() for c in ("conv_id", "role", "content")), strict=True):
                if formatter is None or conv != current:
                    if formatter is not None:
                        held.append(row(True))
                    current, formatter, loss, n, number = conv, Formatter(**tokens), [], 0, 0
                elif formatter.size >= chunk:
                    held.append(row(False))
                    loss, n, number = [], 0, number + 1
                span = formatter.turn(role, content or [])
                n += 1
                if role in trained:
                    loss += span
                if len(held) >= 256 or held and formatter.size >= chunk:
                    yield joined(held)
                    held = []
        if formatter is not None:
            held.append(row(True))
        if held:
            yield joined(held)

    return turns.mapInArrow(run, FORMATTED)


class Digest:
    """What a conversation's chunks hold, read in their order."""

    def __init__(self):
        self.turns, self.all, self.loss, self.loss_chars, self.chars = 0, hashlib.sha256(), hashlib.sha256(), 0, 0

    def add(self, text: str, loss: list[int]) -> None:
        self.chars += len(text)
        spans = set(zip(loss[::2], loss[1::2], strict=True))
        for role, content, span in read_turns(text):
            told = "".join(c if isinstance(c, str) else json.dumps(c) for c in content)
            self.turns += 1
            self.all.update(f"{role}\n{told}\n".encode())
            if span in spans:
                spans.remove(span)
                for piece in content:
                    if isinstance(piece, str):
                        self.loss.update(piece.encode())
                        self.loss_chars += len(piece)
        if spans:
            raise ValueError("a loss span is not the content of a turn")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted text: n_turns, turns_sha256 (role, text), loss_chars, loss_sha256, formatted_chars."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches):
        digest = Digest()
        for part in slices(batches, column="text"):
            rows = []
            for conv, last, text, loss in zip(*(part.column(c).to_pylist() for c in ("conv_id", "last", "text", "loss")), strict=True):
                digest.add(text, loss)
                if last:
                    rows.append((conv, digest.turns, digest.all.hexdigest(), digest.loss_chars, digest.loss.hexdigest(), digest.chars))
                    digest = Digest()
            if rows:
                conv, turns, every, chars, loss, size = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"conv_id": pa.array(conv, pa.int64()), "n_turns": pa.array(turns, pa.int64()), "turns_sha256": every,
                                                  "loss_chars": pa.array(chars, pa.int64()), "loss_sha256": loss, "formatted_chars": pa.array(size, pa.int64())})

    needed = formatted.select("conv_id", "chunk", "last", "text", "loss")
    alone = needed.where("chunk = 0 AND last").mapInArrow(run, schema)
    several = needed.where("chunk > 0 OR NOT last").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return alone.unionByName(several.mapInArrow(run, schema))
