"""Chat formatting: a state machine over roles, and text segments with a loss flag, from a declarative template.

A turn becomes three segments: its header, its text, its end. A segment bears loss if it is the text of a role that the
template names for it. Control strings inside a text are escaped by a backslash after their first character (one more if
backslashes are there already), which is undone by taking one away. `read_back` parses formatted text alone.

Conversations of any length pass through a task turn by turn; nothing of a conversation is held but its state and digests.

Defined results: a null text or role is empty; turns are ordered by turn, then role and text, a null turn first; a null
conv_id is a conversation of its own; rows that repeat are turns each; a turn that the machine does not allow is formatted
all the same and makes the conversation invalid; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


class Template(NamedTuple):
    """What a chat format is made of. `header` holds {role}; `turns` maps a state (the last role, "" at first) to the roles
    that may follow; a conversation is complete in the states of `last`."""

    header: str
    end: str
    reserved: tuple[str, ...]
    loss: frozenset[str]
    turns: dict[str, frozenset[str]]
    last: frozenset[str]


CHAT = Template(
    header="<|turn|>{role}\n", end="<|end|>\n",
    # Strings that some tokenizer or chat format treats as control.
    reserved=("<|turn|>", "<|end|>", "[INST]", "[/INST]", "<s>", "</s>"),
    loss=frozenset({"assistant"}),
    turns={"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})},
    last=frozenset({"assistant"}),
)


class Format:
    """A template's functions on strings."""

    def __init__(self, template: Template) -> None:
        self.template = template
        tails = lambda slash: "|".join(f"{re.escape(c[0])}\\\\*{slash}{re.escape(c[1:])}" for c in template.reserved)
        self._plain, self._escaped = re.compile(tails("")), re.compile(tails(r"\\"))
        before, after = template.header.split("{role}")
        self._turn = re.compile(f"{re.escape(before)}(.*?){re.escape(after)}(.*?){re.escape(template.end)}", re.S)

    def escape(self, text: str) -> str:
        return self._plain.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][0] + m[0][2:], text)

    def escape_role(self, role: str) -> str:
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def unescape_role(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(role), flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        return [(self.template.header.replace("{role}", self.escape_role(role)), False), (self.escape(text), role in self.template.loss), (self.template.end, False)]

    def read(self, formatted: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        found = self._turn.fullmatch(formatted)
        if not found:
            raise ValueError("not one turn of this template")
        return self.unescape_role(found[1]), self.unescape(found[2])

    def follows(self, state: str | None, role: str) -> str | None:
        """The state after a role; None once a turn was not allowed."""
        return role if state is not None and role in self.template.turns.get(state, ()) else None


SEGMENTS = "conv_id bigint, place bigint, part int, segment string, loss boolean, state string"


def chat_segments(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, place (of the turn, from 0), part (0 header, 1 text, 2 end), segment, loss and the machine's state after the
    turn, in order within each partition; a conversation lies in one."""
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"),
                                 F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        format_, current, place, state = Format(template), object(), 0, ""
        for batch in batches:
            out: list[tuple] = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv_id != current:
                    current, place, state = conv_id, 0, ""
                state = format_.follows(state, role)
                out += [(conv_id, place, part, segment, loss, state) for part, (segment, loss) in enumerate(format_.segments(role, text))]
                place += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds],
                                             ["conv_id", "place", "part", "segment", "loss", "state"])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(cut, SEGMENTS)


DIGESTS = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
           "valid boolean, complete boolean")


def read_back(segments: DataFrame, template: Template = CHAT) -> DataFrame:
    """Parses what chat_segments gives, in its order, and sums each conversation up: turns, digests of all turns and of the
    text under the loss mask, and whether the turn order is valid and complete."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        format_, current = Format(template), None
        done: list[tuple] = []

        def close() -> None:
            if current:
                state = current["state"]
                done.append((current["id"], current["turns"], current["all"].hexdigest(), current["chars"], current["loss"].hexdigest(),
                             current["formatted"], state is not None, state is not None and state in template.last))

        whole: list[str] = []
        for batch in batches:
            for conv_id, place, part, segment, loss, state in zip(*(c.to_pylist() for c in batch.columns)):
                if place == 0 and part == 0:
                    close()
                    current = {"id": conv_id, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "formatted": 0, "state": ""}
                whole = [segment] if part == 0 else [*whole, segment]
                current["formatted"] += len(segment)
                current["state"] = state
                if loss:
                    plain = format_.unescape(segment)
                    current["chars"] += len(plain)
                    current["loss"].update(plain.encode("utf-8", "surrogatepass"))
                if part == 2:
                    role, text = format_.read("".join(whole))
                    current["turns"] += 1
                    current["all"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if done:
                yield rows(done)
                done = []
        close()
        yield rows(done)

    def rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [[]] * 8, kinds)], names)

    return segments.select("conv_id", "place", "part", "segment", "loss", "state").mapInArrow(digest, DIGESTS)


def formatted(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row a turn: conv_id, place and the formatted turn, for writing out."""
    segments = chat_segments(conversations, template)
    by_part = [F.max(F.when(F.col("part") == i, F.col("segment"))) for i in range(3)]
    return segments.groupBy("conv_id", "place").agg(F.concat(*by_part).alias("formatted"))
