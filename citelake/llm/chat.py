"""Chat formatting by token-level assembly.

Template: ``<s>`` opens a conversation; a user turn is ``[INST]text[/INST]``, a system turn
``[SYS]text[/SYS]``, an assistant turn ``text</s>``, a turn of any other role ``[ROLE]role[BODY]text[/ROLE]``.
Control strings inside texts are escaped by one backslash after their first sign, and backslashes already
there get one more, so escaping is reversible and no text can form a control string.

Every segment (a text or a role) is encoded by itself; control strings are reserved ids above the
vocabulary, spliced between the segments and never produced by a text. The loss mask covers exactly the
assistant texts; its bounds are prefix sums of segment lengths. Encoding runs where the rows lie; then the
rows of a conversation pass one task in order, held one Arrow batch at a time, so a conversation of any
length needs no more memory than that.

Defined results: rows go by turn, then role, then text, nulls first; null texts and roles are empty; a
null conv_id is a conversation of its own; repeated rows are repeated turns. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[BODY]", "[/ROLE]"]
BATCH = 256  # rows encoded at once

_TAIL = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAIL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_TAIL})")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def layout(role: str, text: str) -> list[tuple[str, bool, bool]]:
    """Pieces of a turn: (string, is it a control string, is it under the loss mask)."""
    if role == "assistant":
        return [(escape(text), False, True), ("</s>", True, False)]
    if role in ("user", "system"):
        name = "INST" if role == "user" else "SYS"
        return [(f"[{name}]", True, False), (escape(text), False, False), (f"[/{name}]", True, False)]
    return [
        ("[ROLE]", True, False), (escape(role), False, False), ("[BODY]", True, False), (escape(text), False, False),
        ("[/ROLE]", True, False),
    ]


_PIECE = re.compile(
    r"(?s)\[INST\](?P<user>.*?)\[/INST\]|\[SYS\](?P<system>.*?)\[/SYS\]"
    r"|\[ROLE\](?P<role>.*?)\[BODY\](?P<other>.*?)\[/ROLE\]|(?P<assistant>.*?)</s>"
)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns, without the opening ``<s>``."""
    out, at = [], 0
    while at < len(formatted):
        m = _PIECE.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        g, at = m.groupdict(), m.end()
        if g["other"] is not None:
            out.append((unescape(g["role"]), unescape(g["other"])))
        else:
            out.extend((k, unescape(g[k])) for k in ("user", "system", "assistant") if g[k] is not None)
    return out


def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    return t


def encode_turns(conversations: DataFrame, path: str) -> DataFrame:
    """conv_id, turn, role, text, formatted, ids, loss_from and loss_to (positions in the turn's ids)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        base = coder.get_vocab_size()
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                turns = [layout(r or "", t or "") for r, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                plain = [s for turn in turns for s, control, _ in turn if not control]
                coded = iter([e.ids for e in coder.encode_batch(plain, add_special_tokens=False)])
                formatted, ids, low, high = [], [], [], []
                for turn in turns:
                    parts = [[base + CONTROL.index(s)] if control else next(coded) for s, control, _ in turn]
                    ends = np.cumsum([len(p) for p in parts])
                    loss = [k for k, (_, _, m) in enumerate(turn) if m]
                    low.append(int(ends[loss[0]] - len(parts[loss[0]])) if loss else 0)
                    high.append(int(ends[loss[0]]) if loss else 0)
                    ids.append([x for p in parts for x in p])
                    formatted.append("".join(s for s, _, _ in turn))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(formatted), pa.array(ids, pa.list_(pa.int32())), pa.array(low, pa.int32()), pa.array(high, pa.int32())],
                    [*part.schema.names, "formatted", "ids", "loss_from", "loss_to"],
                )

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.mapInArrow(
        encode, "conv_id long, turn long, role string, text string, formatted string, ids array<int>, loss_from int, loss_to int"
    )


def assemble(turns: DataFrame) -> DataFrame:
    """Turns in order, each with ``at``: the position of its first id in the conversation (``<s>`` is 0),
    and its loss bounds there. Running sums in one ordered pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, begun = None, 1, False
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                if not begun or row["conv_id"] != last:
                    last, at, begun = row["conv_id"], 1, True
                row["at"] = at
                row["loss_from"] += at
                row["loss_to"] += at
                at += len(row["ids"])
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    out = pa.schema([
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())),
        ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("at", pa.int64()),
    ])
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.drop("role", "text").mapInArrow(
        run, "conv_id long, turn long, formatted string, ids array<int>, loss_from long, loss_to long, at long"
    )


def digest(assembled: DataFrame, path: str) -> DataFrame:
    """What a reader of the output finds, one row per conversation: texts by parsing what is formatted,
    loss text by decoding the ids under the mask. Keeps ``assemble``'s order and partitions."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        state = None

        def close():
            return {
                "conv_id": state[0], "n_turns": state[1], "turns_sha256": state[2].hexdigest(), "loss_chars": state[3],
                "loss_sha256": state[4].hexdigest(), "formatted_chars": state[5], "n_ids": state[6],
            }

        for batch in batches:
            done = []
            rows = batch.to_pylist()
            masked = [r["ids"][r["loss_from"] - r["at"] : r["loss_to"] - r["at"]] for r in rows]
            texts = [unescape(t) for t in coder.decode_batch(masked, skip_special_tokens=False)]
            for row, loss in zip(rows, texts):
                if state is None or state[0] != row["conv_id"]:
                    if state is not None:
                        done.append(close())
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), len("<s>"), 1]
                for role, text in parse(row["formatted"]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(row["formatted"])
                state[6] += len(row["ids"])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=out)
        if state is not None:
            yield pa.RecordBatch.from_pylist([close()], schema=out)

    out = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_ids", pa.int64()),
    ])
    return assembled.mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long"
    )
