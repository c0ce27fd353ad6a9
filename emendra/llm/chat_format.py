"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are the
context, and only that reply is under the loss mask. Turns that follow the last
reply are kept in one closing example without a target, so that the output
holds the whole conversation.

Template: ``<s>`` opens an example; a user turn is ``[INST] text [/INST]``, an
assistant turn `` text </s>``, any other role ``<<ROLE>> role <<TEXT>> text
<</ROLE>>``. Inside texts and roles a backslash escapes itself and breaks each
control string after its first character, which can be undone exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emendra.llm.common import map_arrow

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
_CONTROL = re.compile("|".join(re.escape(c[0]) + f"(?={re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

EXAMPLES = "conv_id long, example int, n_turns long, formatted string, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: Characters of examples handed on at once.
FLUSH_CHARS = 1 << 21


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_markup(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the escaped text of a turn, the text, and what stands after it."""
    if role == "user":
        return "[INST] ", escape(text), " [/INST]"
    if role == "assistant":
        return " ", escape(text), " </s>"
    return f"<<ROLE>> {escape(role)} <<TEXT>> ", escape(text), " <</ROLE>>"


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of an example."""
    at = len("<s>")
    while at < len(formatted):
        role = None
        if formatted.startswith("[INST] ", at):
            role, at, close = "user", at + 7, " [/INST]"
        elif formatted.startswith("<<ROLE>> ", at):
            middle = formatted.index(" <<TEXT>> ", at)
            role, at, close = unescape(formatted[at + 9 : middle]), middle + 10, " <</ROLE>>"
        else:
            role, at, close = "assistant", at + 1, " </s>"
        end = formatted.index(close, at)
        yield role, unescape(formatted[at:end])
        at = end + len(close)


def _expand(batches: Iterator) -> Iterator:
    """Examples from rows that come conversation by conversation, in turn order."""
    import pyarrow as pa

    names = [x.split()[0] for x in EXAMPLES.split(", ")]
    out: list[tuple] = []
    held = 0
    conv, parts, length, example, turns, open_turns = None, ["<s>"], 3, 0, 0, 0

    def batch() -> pa.RecordBatch:
        nonlocal held
        columns = list(zip(*out))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        held = 0
        made = pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)
        out.clear()
        return made

    started = False
    for rows in batches:
        for key, role, text in zip(*(rows.column(k).to_pylist() for k in range(3))):
            if started and key != conv:
                if open_turns:
                    out.append((conv, example, turns, "".join(parts), None, None))
                    held += length
                parts, length, example, turns, open_turns = ["<s>"], 3, 0, 0, 0
            conv, started = key, True
            before, body, after = turn_markup(role or "", text or "")
            parts += (before, body, after)
            start = length + len(before)
            length = start + len(body) + len(after)
            turns += 1
            if role == "assistant":
                parts = ["".join(parts)]
                out.append((conv, example, turns, parts[0], start, start + len(body)))
                held += length
                example, open_turns = example + 1, 0
            else:
                open_turns += 1
            if held > FLUSH_CHARS:
                yield batch()
    if open_turns:
        out.append((conv, example, turns, "".join(parts), None, None))
    if out:
        yield batch()


def chat_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, formatted, loss_start, loss_end): one row per assistant turn, and a closing one.

    loss_start and loss_end count code points in `formatted` and are null in a
    closing example. Rows with equal turn numbers are ordered by role and text.
    Null texts and roles count as empty, rows with a null conv_id form one
    conversation, a null turn comes first, an empty table gives no examples;
    further columns are ignored. Examples of a conversation stand in one
    partition, one after another. Rows are sorted within partitions and
    streamed, so a very long conversation is never held as one group: only its
    current prefix is.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_arrow(dealt.select("conv_id", "role", "text"), _expand, EXAMPLES)


def _read_back(batches: Iterator) -> Iterator:
    """One row per conversation, from its examples alone."""
    import hashlib

    import pyarrow as pa

    names = [x.split()[0] for x in DIGESTS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    conv, started, last, loss, loss_chars, total = None, False, "", None, 0, 0
    out: list[tuple] = []

    def close() -> None:
        turns, n = hashlib.sha256(), 0
        for role, text in parse(last):
            turns.update(f"{role}\n{text}\n".encode("utf-8"))
            n += 1
        out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), total))

    for rows in batches:
        columns = {n: rows.column(k).to_pylist() for k, n in enumerate(rows.schema.names)}
        for key, formatted, start, end in zip(columns["conv_id"], columns["formatted"], columns["loss_start"], columns["loss_end"]):
            if not started or key != conv:
                if started:
                    close()
                conv, started, loss, loss_chars, total = key, True, hashlib.sha256(), 0, 0
            last = formatted
            total += len(formatted)
            if start is not None:
                target = unescape(formatted[start:end])
                loss.update(target.encode("utf-8"))
                loss_chars += len(target)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
    if started:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=names)


def chat_digests(examples: DataFrame) -> DataFrame:
    """What the formatted examples hold, read back from them: see DIGESTS.

    `examples` must come straight from `chat_examples`, whose order it relies on.
    """
    return map_arrow(examples, _read_back, DIGESTS)
