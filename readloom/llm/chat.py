"""Chat formatting with a template that is only ever called, never looked into.

Successive prefixes of a conversation are rendered, each output compared to the
one before: what is new is the span of the added turn. If an output does not
start with the one before, the template rewrote its history; the turn at which
it did so is reported and the spans of the turns before are not trusted. Where a
turn's text lies inside its span is found by rendering the turn once more with a
probe character for text.

Each prefix is rendered once, and once more with the probe where the added turn
counts for the loss: a conversation of n turns costs some 2n renderings, so work
grows with the square of its turns. That is the price of not looking into a
template.

Rows come in order of conversation and turn; a task holds one conversation and
one batch at a time, so a conversation has to fit in a task.

Defined results: a null text is empty; a null role is the empty role; a row
with a null conversation id is a conversation of its own, so such rows are not
gathered; a null turn number stands first; rows of equal turn number are ordered
by role and text; repeated rows are turns of their own; a very long text is
rendered whole; where a template rewrites history, spans that it broke are left
out and ``loss_lost`` counts the loss texts among them; an empty table gives an
empty result; other columns are not returned, so none can clash.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Stands for a text when its place is looked for.
PROBE = "\ue000"


class BracketTemplate:
    """Turns between control strings, which texts can hold only with a break inside.

    A backslash before anything but a backslash is such a break and is dropped
    on reading; a backslash of a text is doubled.
    """

    MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
    _OTHER = ("<<ROLE:", ">>", "<</ROLE>>")
    _BREAK = re.compile(r"\\|<(?=<SYS>>|</SYS>>|<ROLE:|</ROLE>>|s>|/s>)|\[(?=/?INST\])")
    _UNBREAK = re.compile(r"\\(\\?)")
    _TOKEN = re.compile(r"<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<assistant>.*?)</s>|<<ROLE:(?P<role>.*?)>>(?P<other>.*?)<</ROLE>>", re.S)

    def escape(self, text: str) -> str:
        return self._BREAK.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._UNBREAK.sub(r"\1", text)

    def render(self, turns: list[tuple[str, str]]) -> str:
        out = []
        for role, text in turns:
            if role in self.MARKS:
                a, b = self.MARKS[role]
                out += (a, self.escape(text), b)
            else:
                a, m, b = self._OTHER
                out += (a, self.escape(role).replace(">", ">\\"), m, self.escape(text), b)
        return "".join(out)

    def parse(self, output: str) -> list[tuple[str, str]]:
        """The turns of an output."""
        turns, at = [], 0
        for m in self._TOKEN.finditer(output):
            if m.start() != at:
                raise ValueError(f"no turn at {at}")
            at = m.end()
            kind = m.lastgroup
            if kind == "other":
                turns.append((self.unescape(m["role"]), self.unescape(m["other"])))
            else:
                turns.append((kind, self.unescape(m[kind])))
        if at != len(output):
            raise ValueError(f"no turn at {at}")
        return turns


def render_spans(render, turns: list[tuple[str, str]], loss_roles=("assistant",)):
    """Output, span of each turn, spans of the loss texts, and the first turn whose
    addition changed what stood before (else None)."""
    before, spans, loss, rewritten = "", [], [], None
    for k, (role, text) in enumerate(turns):
        now = render(turns[: k + 1])
        if not now.startswith(before):
            rewritten = k if rewritten is None else rewritten
            same = next((i for i, (a, b) in enumerate(zip(before, now)) if a != b), min(len(before), len(now)))
            spans = [s if s and s[1] <= same else None for s in spans]
            loss = [s for s in loss if s[1] <= same]
            start = same
        else:
            start = len(before)
        spans.append((start, len(now)))
        if role in loss_roles:
            probe = render([*turns[:k], (role, PROBE)])
            at = probe.find(PROBE, start)
            if at >= 0 and now[:at] == probe[:at]:
                loss.append((at, len(now) - (len(probe) - at - 1)))
        before = now
    return before, spans, loss, rewritten


FORMATTED = "conv_id long, formatted string, turn_spans array<struct<start:int,end:int>>, loss_spans array<struct<start:int,end:int>>, rewritten_at int, loss_lost int"


def format_chats(df: DataFrame, template=None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, formatted, turn_spans, loss_spans, rewritten_at, loss_lost)``, a row for each conversation."""
    template = template or BracketTemplate()
    rows = df.select(
        F.col(conv_id).cast("long").alias("c"),
        F.col(turn).alias("n"),
        F.coalesce(F.col(role), F.lit("")).alias("r"),
        F.coalesce(F.col(text), F.lit("")).alias("t"),
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alone = F.when(F.col("c").isNull(), F.xxhash64("n", "r", "t"))
    rows = rows.repartition(parts, "c", alone).sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t")

    def run(batches):
        conv, turns, out = None, [], []

        def close():
            text, spans, loss, at = render_spans(template.render, turns)
            pair = lambda s: s and {"start": s[0], "end": s[1]}
            lost = sum(r == "assistant" for r, _ in turns) - len(loss)
            out.append((conv, text, [pair(s) for s in spans], [pair(s) for s in loss], at, lost))

        def flush():
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            kinds = (pa.int64(), pa.string(), span, span, pa.int32(), pa.int32())
            names = ("conv_id", "formatted", "turn_spans", "loss_spans", "rewritten_at", "loss_lost")
            row = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
            out.clear()
            return row

        size = 0
        for batch in batches:
            for c, r, t in zip(*(x.to_pylist() for x in batch.columns)):
                if turns and (c is None or c != conv):
                    close()
                    turns, size = [], size + len(out[-1][1])
                    if size > 2_000_000:
                        yield flush()
                        size = 0
                conv = c
                turns.append((r, t))
        if turns:
            close()
        if out:
            yield flush()

    return rows.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, template=None) -> DataFrame:
    """Turns and loss texts that an output holds, as digests: ``(conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars)``."""
    template = template or BracketTemplate()
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        import hashlib

        for batch in batches:
            rows = []
            for c, text, loss in zip(*(x.to_pylist() for x in batch.columns)):
                turns = template.parse(text)
                seen = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                masked = "".join(template.unescape(text[s["start"] : s["end"]]) for s in loss)
                rows.append((c, len(turns), seen.hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [f.split()[0] for f in schema.split(", ")])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)
