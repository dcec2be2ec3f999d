"""Chat formatting by incremental black-box rendering (operator 7).

A template is a function from turns to text, and nothing else is known of it.  Rendering successive prefixes of a
conversation and comparing each output with the one before locates each turn's span: what the longer output adds.  A
template whose longer output doesn't begin with the shorter one rewrites history, which is reported, not hidden.

All prefixes are rendered, however many turns there are: of a template of which nothing is known, only that shows where
a turn stands and whether history is rewritten.  So a conversation costs as the square of its turns.

The template here marks turns with control strings, and escapes, reversibly, what looks like one in a text.

Edge cases: null text and null role are empty; rows without an id make one conversation, and turns without a number come
first; turns of one number are ordered by role and text; repeated rows are turns of their own; an empty table gives an
empty result; extra columns of any name are left out; a conversation is one record however long, since its formatted
text is one value, but it is streamed from a sorted partition and never held twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

# The control strings.  U+27E8 and U+27E9 open and close each; an escape doubles as one.
OPEN, CLOSE = "⟨", "⟩"
BEGIN, END = f"{OPEN}turn{CLOSE}", f"{OPEN}end{CLOSE}"
#: What templates of other makes use as control strings; these are escaped too, so that no reader takes them for marks.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_ESCAPE = re.compile("|".join(map(re.escape, (OPEN, CLOSE, *FOREIGN))))
_CODES = {OPEN: "o", CLOSE: "c"} | {s: str(i) for i, s in enumerate(FOREIGN)}
_BACK = {v: k for k, v in _CODES.items()} | {"n": "\n"}
_UNESCAPE = re.compile(f"{OPEN}x([ocn0-9]+){CLOSE}")


def escape(text: str) -> str:
    """text without any control string; unescape() gives it back."""
    return _ESCAPE.sub(lambda m: f"{OPEN}x{_CODES[m[0]]}{CLOSE}", text)


def escape_role(role: str) -> str:
    """role without a control string or a line end, which would end it."""
    return escape(role).replace("\n", f"{OPEN}xn{CLOSE}")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _BACK[m[1]], text)


def marked(turns: Sequence[Turn]) -> str:
    """The template: a mark, the role, a line end, the text, a mark, a line end."""
    return "".join(f"{BEGIN}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


class RewritesHistory(ValueError):
    """A longer conversation's rendering doesn't begin with the shorter one's."""


def spans(turns: Sequence[Turn], template: Template) -> tuple[str, list[tuple[int, int]]]:
    """The rendering and each turn's span in it."""
    last, found = template(()), []
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        if not now.startswith(last):
            raise RewritesHistory(f"turn {k - 1} changes what was rendered before it")
        found.append((len(last), len(now)))
        last = now
    return last, found


#: A text that no turn is likely to hold; rendered in a turn's place, it shows where the template puts texts.
PROBE = "\ue000\ue001\ue000"


def body_span(whole: str, span: tuple[int, int], before: Sequence[Turn], role: str, template: Template) -> tuple[int, int]:
    """Where a turn's text stands within its span, seen from a rendering with another text in its place."""
    shown = template([*before, (role, PROBE)])[len(template(before)) :]
    head, found, tail = shown.partition(PROBE)
    if not found or not whole.startswith(head, *span) or not whole.endswith(tail, *span):
        raise RewritesHistory("what stands around a text depends on the text")
    return span[0] + len(head), span[1] - len(tail)


def format_turns(turns: Sequence[Turn], template: Template = marked) -> dict:
    """formatted, turn spans, loss spans (assistants' texts) and whether the template rewrites history."""
    try:
        whole, found = spans(turns, template)
        loss = [body_span(whole, s, turns[:k], t[0], template) for k, (s, t) in enumerate(zip(found, turns, strict=True)) if t[0] == "assistant"]
    except RewritesHistory:
        return {"formatted": template(turns), "spans": [], "loss": [], "rewrites": True}
    return {"formatted": whole, "spans": found, "loss": loss, "rewrites": False}


def read_turns(formatted: str) -> list[Turn]:
    """The turns of a text of the template's, from the text alone."""
    out = []
    for part in formatted.split(BEGIN)[1:]:
        head, _, rest = part.partition("\n")
        out.append((unescape(head), unescape(rest[: rest.rindex(END)])))
    return out


SCHEMA = "conv_id long, formatted string, spans array<struct<start:int,end:int>>, loss array<struct<start:int,end:int>>, rewrites boolean"


def format_conversations(df: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = marked) -> DataFrame:
    """A row for each conversation: its formatted text, turn spans, loss spans (offsets in code points), rewrites."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def out(got: list[tuple]) -> pa.RecordBatch:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        pairs = lambda s: [{"start": a, "end": b} for a, b in s]
        return pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1]["formatted"] for g in got], pa.string()), pa.array([pairs(g[1]["spans"]) for g in got], span), pa.array([pairs(g[1]["loss"]) for g in got], span), pa.array([g[1]["rewrites"] for g in got], pa.bool_())],
            names=["conv_id", "formatted", "spans", "loss", "rewrites"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, got, size, any_ = None, [], [], 0, False
        for batch in batches:
            for i, r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if any_ and i != now:
                    got.append((now, format_turns(turns, template)))
                    size += len(got[-1][1]["formatted"])
                    turns = []
                    if size > 4_000_000:
                        yield out(got)
                        got, size = [], 0
                now, any_ = i, True
                turns.append((r, t))
        if any_:
            got.append((now, format_turns(turns, template)))
        yield out(got)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from formatted text and loss spans alone: n_turns, digests, loss_chars, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_turns(text)
                masked = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                every = hashlib.sha256()
                for r, t in turns:
                    every.update(f"{r}\n{t}\n".encode())
                rows.append((len(turns), every.hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
