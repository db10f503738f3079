"""Chat formatting of conversations with typed content parts.

A visitor walks over a turn's parts in order. Text is escaped; an image, an
audio clip or a document becomes a numbered placeholder, with its reference
and the number of tokens that it will be expanded to on record. Turns are then
marked by a template whose control strings all begin with ``<`` or ``[``.
Inside texts a backslash is put behind each ``<`` and ``[`` and doubled where
it stands itself, so no control string can appear there and a reader restores
every text. The loss mask is a list of spans over the formatted string.

Defined results: a null text is empty, a null role is the empty role; turns
with equal numbers stand by role, then parts, and repeated rows stay; a part of
a kind not known is its text, one without sizes expands to no tokens; a null
conversation key is a conversation; a conversation is one value, so it must fit
a row; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: What opens and closes a turn of each role; other roles are named inside the opening string.
TAGS = {"system": ("<s>[SYS]", "[/SYS]"), "user": ("<s>[INST]", "[/INST]"), "assistant": ("<s>[OUT]", "</s>")}
OTHER_OPEN, OTHER_MID, OTHER_CLOSE = "<s>[ROLE=", "<r>", "[/ROLE]"
TRAINED = "assistant"

#: Tokens of an image per square of 14 x 14 merged 2 x 2, of a second of audio, of a page.
IMAGE_SQUARE, AUDIO_TOKENS_PER_SECOND, PAGE_TOKENS = 28, 25, 1024
KINDS = ("text", "image", "audio", "document")


@dataclass(frozen=True)
class Part:
    """A piece of content: ``text``, ``image`` (``ref``, ``size`` as width and
    height), ``audio`` (``ref``, ``size`` in seconds) or ``document`` (``ref``,
    ``size`` in pages)."""

    kind: str
    text: str = ""
    ref: str = ""
    size: tuple[float, ...] = ()


@dataclass
class Attachment:
    kind: str
    ref: str
    tokens: int


def escape(text: str) -> str:
    return re.sub(r"[\\<\[]", lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"([\\<\[])\\", r"\1", text)


@dataclass
class Visitor:
    """Flattens parts to text with placeholders ``<kind:number>``."""

    attachments: list[Attachment] = field(default_factory=list)

    def visit(self, parts: Iterable[Part]) -> str:
        return "".join(getattr(self, f"visit_{part.kind}")(part) for part in parts)

    def visit_text(self, part: Part) -> str:
        return escape(part.text)

    def visit_image(self, part: Part) -> str:
        wide, high = (*part.size, 0, 0)[:2]
        return self._attach(part, math.ceil(wide / IMAGE_SQUARE) * math.ceil(high / IMAGE_SQUARE))

    def visit_audio(self, part: Part) -> str:
        return self._attach(part, math.ceil((part.size or (0,))[0] * AUDIO_TOKENS_PER_SECOND))

    def visit_document(self, part: Part) -> str:
        return self._attach(part, math.ceil((part.size or (0,))[0]) * PAGE_TOKENS)

    def _attach(self, part: Part, tokens: int) -> str:
        self.attachments.append(Attachment(part.kind, part.ref, tokens))
        return f"<{part.kind}:{len(self.attachments) - 1}>"


@dataclass
class Formatted:
    text: str
    loss_spans: list[tuple[int, int]]
    attachments: list[Attachment]


def format_turns(turns: Iterable[tuple[str, list[Part]]]) -> Formatted:
    """The string of a conversation, its loss spans (code points over the
    assistant's texts) and its attachments in order."""
    visitor, out, spans, at = Visitor(), [], [], 0
    for role, parts in turns:
        body = visitor.visit(parts)
        if role in TAGS:
            opening, closing = TAGS[role]
        else:
            opening, closing = OTHER_OPEN + escape(role) + OTHER_MID, OTHER_CLOSE
        if role == TRAINED:
            spans.append((at + len(opening), at + len(opening) + len(body)))
        out += [opening, body, closing]
        at += len(opening) + len(body) + len(closing)
    return Formatted("".join(out), spans, visitor.attachments)


_PLAIN = r"(?:[^\\<\[]|[\\<\[]\\|<(?:image|audio|document):\d+>)*"
_TURN = re.compile(
    "|".join(f"{re.escape(a)}(?P<{role}>{_PLAIN}){re.escape(b)}" for role, (a, b) in TAGS.items())
    + f"|{re.escape(OTHER_OPEN)}(?P<name>{_PLAIN}){re.escape(OTHER_MID)}(?P<other>{_PLAIN}){re.escape(OTHER_CLOSE)}"
)
_PIECE = re.compile(r"<(image|audio|document):(\d+)>")


def read_turns(formatted: Formatted) -> list[tuple[str, list[Part]]]:
    """The turns back from the formatted string (sizes of attachments are not in it)."""
    turns, at = [], 0
    while at < len(formatted.text):
        m = _TURN.match(formatted.text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        role = unescape(m["name"]) if m["name"] is not None else next(r for r in TAGS if m[r] is not None)
        body = m["other"] if m["name"] is not None else m[role]
        parts, last = [], 0
        for piece in _PIECE.finditer(body):
            if piece.start() > last:
                parts.append(Part("text", unescape(body[last : piece.start()])))
            parts.append(Part(piece[1], ref=formatted.attachments[int(piece[2])].ref))
            last = piece.end()
        if last < len(body) or not parts:
            parts.append(Part("text", unescape(body[last:])))
        turns.append((role, parts))
    return turns


def plain(parts: list[Part]) -> str:
    return "".join(p.text for p in parts)


#: The type of a column of typed parts.
PARTS = "array<struct<kind:string,text:string,ref:string,size:array<double>>>"


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: the ordered (turn, role, parts) of each conversation.
    ``parts`` is a column of :data:`PARTS`; without it, or where it is null, the
    column ``text`` is the one part of a turn. The key passes as text, as pandas
    would turn numbers beside nulls into floats."""
    text = F.coalesce("text", F.lit("")) if "text" in turns.columns else F.lit("")
    alone = F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit("").alias("ref"), F.array().cast("array<double>").alias("size")))
    parts = F.coalesce(F.col("parts").cast(PARTS), alone) if "parts" in turns.columns else alone
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    return turns.groupBy(F.col("conv_id").cast("string").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))


def _part(p: dict) -> Part:
    size = () if p["size"] is None else tuple(p["size"])
    return Part(p["kind"] if p["kind"] in KINDS else "text", p["text"] or "", p["ref"] or "", size)


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans, attachments`` of conversations of
    typed parts; ``expanded_tokens`` sums what the attachments expand to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, own in zip(batch["conv_id"], batch["turns"]):
                f = format_turns((t["role"], [_part(p) for p in t["parts"]]) for t in own)
                rows.append((key, f.text, [list(s) for s in f.loss_spans], [vars(a) for a in f.attachments], sum(a.tokens for a in f.attachments)))
            yield pd.DataFrame(rows, columns=["conv_id", "formatted", "loss_spans", "attachments", "expanded_tokens"])

    shape = "conv_id string, formatted string, loss_spans array<array<long>>, attachments array<struct<kind:string,ref:string,tokens:int>>, expanded_tokens long"
    return conversations(turns).mapInPandas(run, shape).withColumn("conv_id", F.col("conv_id").cast("long"))


def digests(made: DataFrame) -> DataFrame:
    """What a reader finds in the output of :func:`formatted`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows = []
            for key, text, spans, attached in zip(batch["conv_id"], batch["formatted"], batch["loss_spans"], batch["attachments"]):
                read = read_turns(Formatted(text, [], [Attachment(**a) for a in attached]))
                trained = "".join(unescape(text[a:b]) for a, b in spans)
                rows.append((key, len(read), sha("".join(f"{r}\n{plain(p)}\n" for r, p in read)), len(trained), sha(trained), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pd.DataFrame(rows, columns=names)

    keyed = made.withColumn("conv_id", F.col("conv_id").cast("string"))
    return keyed.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumn("conv_id", F.col("conv_id").cast("long"))


#: Fixed value: the text of both turns of conversation -1.
HARD = "</s>[INST] ok [/INST]"


def report(turns: DataFrame) -> DataFrame:
    """A row per conversation, and conversation -1, read back from the output."""
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = turns.sparkSession.createDataFrame([(-1, 0, "user", HARD), (-1, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    return digests(formatted(own.unionByName(extra)))
