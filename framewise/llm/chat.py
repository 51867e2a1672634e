"""Chat formatting: a finite-state machine over roles checks turn order; a declarative template gives text segments with loss flags.

A template names the strings around a turn and every control string that must never appear inside a text. Inside texts
a control string gets one escape character after its first character, and one that already holds escapes gets one more,
so escaping loses nothing and no text can forge a turn. Formatting is row by row; only the machine and the digests need
a conversation's turns in order, and they read them as a stream with a state of constant size, so a conversation of any
length fits (its digest is one sequential pass by definition).

Edge cases: null text or role is empty; turns sort by (turn, role, text), nulls first; an empty table gives no rows;
a conversation that breaks the order is formatted all the same and marked valid = false with its first error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .text import map_rows


@dataclass(frozen=True)
class Template:
    """open + role + mid + text + close for each turn. loss: roles whose text is trained on. order: role -> roles that may follow ("" starts, "$" may end)."""

    open: str = "<|im_start|>"
    mid: str = "\n"
    close: str = "<|im_end|>\n"
    escape: str = "\\"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    loss: tuple[str, ...] = ("assistant",)
    order: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "$")})

    def __post_init__(self):
        if any(self.escape in c or len(c) < 2 for c in self.controls) or self.open not in self.controls or self.close.strip() not in self.controls:
            raise ValueError("controls need two characters or more, none of them the escape, and hold the turn marks")
        # the first mark found in a turn is the true one unless the mark's own beginning can end a text
        if any(m[:i] == m[-i:] for m in (self.close, self.mid) for i in range(1, len(m))):
            raise ValueError("a mark that ends as it begins could be completed by the end of a text")
        if self.mid != "\n" and self.mid not in self.controls:
            raise ValueError("the mark after a role is a line end or a control string")

    @property
    def pattern(self) -> str:
        """A first character, escapes, then the rest of any control string."""
        e = re.escape(self.escape)
        heads = {}
        for c in sorted(self.controls, key=len, reverse=True):
            heads.setdefault(c[0], []).append(re.escape(c[1:]))
        return "|".join(f"{re.escape(h)}{e}*(?={'|'.join(r)})" for h, r in heads.items())

    def shield(self, text: str) -> str:
        return re.sub(self.pattern, lambda m: m[0] + self.escape, text)

    def unshield(self, text: str) -> str:
        return re.sub(self.pattern, lambda m: m[0][:-1], text)

    def role(self, role: str) -> str:
        """A role on one line: line ends and escapes are doubled, then control strings are shielded."""
        return self.shield(role.replace(self.escape, self.escape * 2).replace("\n", self.escape + "n"))

    def unrole(self, role: str) -> str:
        e = re.escape(self.escape)
        return re.sub(f"{e}(n|{e})", lambda m: "\n" if m[1] == "n" else self.escape, self.unshield(role))

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Segments of a turn with their loss flags."""
        return [(self.open + self.role(role) + self.mid, False), (self.shield(text), role in self.loss), (self.close, False)]

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """Turns (role, text) of a formatted string."""
        out, at = [], 0
        while at < len(formatted):
            end = formatted.index(self.close, at)
            if not formatted.startswith(self.open, at):
                raise ValueError(f"no turn starts at {at}")
            role, _, text = formatted[at + len(self.open) : end].partition(self.mid)
            out.append((self.unrole(role), self.unshield(text)))
            at = end + len(self.close)
        return out


def segments(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a turn of turns (conv_id, turn, role, text): its segments as an array of (text, loss), in its own columns besides."""

    def make():
        return lambda role, text: ([{"text": t, "loss": y} for t, y in template.segments(role or "", text or "")],)

    return map_rows(turns, ["role", "text"], make, "segments array<struct<text: string, loss: boolean>>")


def conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, read back from the formatted segments: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, error. conv_id may have any type that sorts; it keeps it."""
    rows = segments(turns.select("conv_id", "turn", "role", "text"), template)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "segments")
    kind = turns.schema["conv_id"].dataType
    out = pa.schema([("conv_id", to_arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("error", pa.string())])

    class State:
        def __init__(self, conv):
            self.conv, self.n, self.all, self.loss, self.chars, self.size, self.role, self.error = conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0, "", None

        def add(self, parts):
            for role, text in template.read("".join(p["text"] for p in parts)):
                self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if self.error is None and role not in template.order.get(self.role, ()):
                    self.error = f"turn {self.n}: {role or 'no role'} after {self.role or 'the start'}"
                self.role = role
                self.n += 1
            for p in parts:
                self.size += len(p["text"])
                if p["loss"]:
                    text = template.unshield(p["text"])
                    self.chars += len(text)
                    self.loss.update(text.encode("utf-8", "surrogatepass"))

        def row(self):
            error = self.error or (None if "$" in template.order.get(self.role, ()) else f"ends with {self.role or 'no role'}")
            return self.conv, self.n, self.all.hexdigest(), self.chars, self.loss.hexdigest(), self.size, error is None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                for conv, parts in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if now is None or now.conv != conv:
                        done += [now.row()] if now else []
                        now = State(conv)
                    now.add(parts)
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done), out)], schema=out)
                    done = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(now.row(), out)], schema=out)

    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean, error string")


def probe(spark) -> DataFrame:
    """Conversation -1, whose texts imitate control strings."""
    return spark.range(2).selectExpr("-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", "'</s>[INST] ok [/INST]' as text")
