"""Chat formatting by a finite-state machine over roles.

A declarative ``Template`` names, for every role, the strings before and after its text and whether its text is learned from,
and the machine: which role may follow which. Each turn gives text segments, each with a loss flag: the control strings never
carry loss, an assistant's text does. Control strings inside texts are broken by an escape character after their first
character, and the escape character itself is doubled, so that they can be taken back and never pass for control.

Turns stream through a task in order, one at a time, with the machine's state carried along, so a conversation of any length
needs no more memory than its longest turn.

Defined cases: a null text is empty; a role that the template does not know is formatted under its own name without loss, and
makes its conversation invalid; turns follow (turn, role, text), so ties and repeated rows are kept in a fixed order, and two
rows of one turn are two turns; a null conv_id is one conversation; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path

ESCAPE = "␛"


@dataclass(frozen=True)
class Template:
    """``before`` holds the role's name at ``{role}``. ``follows`` maps a state to the roles that may come next; '' is the start."""

    before: str = "<|turn|>{role}\n"
    after: str = "<|end|>\n"
    learned: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: States in which a conversation may end.
    final: frozenset[str] = frozenset({"assistant"})
    #: Strings that must not stand in a text; those of other common templates too.
    control: tuple[str, ...] = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    def pattern(self) -> re.Pattern:
        return re.compile("(" + re.escape(ESCAPE) + ")|(?=(?:" + "|".join(map(re.escape, self.control)) + "))(.)", re.DOTALL)


def escaped(text: str, pattern: re.Pattern) -> str:
    """Control strings broken after their first character, overlapping ones too; the escape character doubled."""
    return pattern.sub(lambda m: ESCAPE * 2 if m[1] else m[2] + ESCAPE, text)


def unescaped(text: str) -> str:
    return re.sub(re.escape(ESCAPE) + "(" + re.escape(ESCAPE) + "?)", lambda m: m[1], text)


_SEGMENTS = "conv_id {key}, place long, segment int, kind string, text string, loss boolean, valid_so_far boolean, closes boolean"


def _format(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = template.pattern()
        started, conv, state, place, valid = False, None, "", 0, True
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("conv_id", "place", "segment", "kind", "text", "loss", "valid_so_far", "closes")}
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not started or key != conv:
                    started, conv, state, place, valid = True, key, "", 0, True
                valid = valid and role in template.follows.get(state, ())
                state = role
                parts = ((("before", template.before.replace("{role}", escaped(role or "", pattern))), False), (("text", escaped(text or "", pattern)), role in template.learned), (("after", template.after), False))
                for segment, ((kind, piece), loss) in enumerate(parts):
                    for c, v in zip(out, (key, place, segment, kind, piece, loss, valid, valid and role in template.final)):
                        out[c].append(v)
                place += 1
            yield pa.RecordBatch.from_arrays([pa.array(out["conv_id"], batch.column("conv_id").type), pa.array(out["place"], pa.int64()), pa.array(out["segment"], pa.int32()), pa.array(out["kind"], pa.string()), pa.array(out["text"], pa.string()), pa.array(out["loss"], pa.bool_()), pa.array(out["valid_so_far"], pa.bool_()), pa.array(out["closes"], pa.bool_())], list(out))

    return run


def segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Text segments in order: conv_id, place of the turn, segment, kind, text, loss, and the machine's verdict so far."""
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(_format(template or Template()), _SEGMENTS.format(key=conversations.schema["conv_id"].dataType.simpleString()))


def write(conversations: DataFrame, path: str | None = None, template: Template | None = None) -> str:
    """Write the segments, each conversation's in order within one file; returns the path."""
    path = path or fresh_path(conversations.sparkSession, "chat")
    segments(conversations, template).write.option("compression", "zstd").parquet(path)
    return path


def _digest(template: Template):
    head = re.compile(re.escape(template.before).replace(re.escape("{role}"), "(.*?)"), re.DOTALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type, open_, conv = None, False, None
        n, chars, learned, turns, loss, verdict = 0, 0, 0, hashlib.sha256(), hashlib.sha256(), False

        def row() -> pa.RecordBatch:
            values = (conv, n, turns.hexdigest(), learned, loss.hexdigest(), chars, verdict)
            types = (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

        for batch in batches:
            key_type = batch.column("conv_id").type
            for key, kind, text, flag, closes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "text", "loss", "closes"))):
                if not open_ or key != conv:
                    if open_:
                        yield row()
                    open_, conv = True, key
                    n, chars, learned, turns, loss, verdict = 0, 0, 0, hashlib.sha256(), hashlib.sha256(), False
                chars += len(text)
                if kind == "before":
                    n += 1
                    turns.update(unescaped(head.fullmatch(text)[1]).encode() + b"\n")
                elif kind == "text":
                    plain = unescaped(text)
                    turns.update(plain.encode() + b"\n")
                    if flag:
                        learned += len(plain)
                        loss.update(plain.encode())
                verdict = closes
        if open_:
            yield row()

    return run


def read_digests(conversations: DataFrame, path: str, template: Template | None = None) -> DataFrame:
    """Read segments back and return per conversation its turns, learned text and size, by digest."""
    found = conversations.sparkSession.read.parquet(path)
    ordered = found.repartition("conv_id").sortWithinPartitions("conv_id", "place", "segment")
    key = conversations.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(_digest(template or Template()), f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def format_and_read(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    return read_digests(conversations, write(conversations, template=template), template)
