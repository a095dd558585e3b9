"""Chat formatting: every assistant turn becomes an example with all turns before it as context.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. Inside roles and texts a backslash is put into each
`<|` (after backslashes that already stand there), which parse() takes out again, so no text can open or close a turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<(\\*)\\\|")
SCHEMA = "conv_id long, example int, n_turns long, trainable boolean, text string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def _role(role: str) -> str:
    """A role on one line: its backslashes doubled, its line ends written as \\n."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> str:
    return f"{START}{_role(role)}\n{escape(text)}{END}"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted example."""
    out = []
    for turn in formatted.split(START)[1:]:
        role, _, text = turn.removesuffix(END).partition("\n")
        out.append((_unrole(role), unescape(text)))
    return out


def _frames(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["conv_id", "example", "n_turns", "trainable", "text", "loss_start", "loss_end"])
    f["conv_id"] = f["conv_id"].astype("Int64")
    return f


def _expand(batches: Iterator[pd.DataFrame], most: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """Rows sorted by conversation and turn -> examples; holds one conversation's prefix and `most` characters of examples."""
    now, begun, prefix, held, example, turns, trained = None, False, [], 0, 0, 0, 0
    rows: list[tuple] = []
    size = 0

    def tail() -> list[tuple]:
        return [(now, example, turns, False, "".join(prefix), 0, 0)] if begun and turns > trained else []

    for batch in batches:
        for conv, role, text in zip(batch["conv_id"].tolist(), batch["role"].tolist(), batch["text"].tolist(), strict=True):
            conv = None if conv is None or conv != conv else int(conv)
            if not begun or conv != now:
                rows += tail()
                size += held
                now, begun, prefix, held, example, turns, trained = conv, True, [], 0, 0, 0, 0
            role = role if isinstance(role, str) else ""
            text = text if isinstance(text, str) else ""
            piece = render(role, text)
            if role == "assistant":
                end = held + len(piece) - len(END)
                begin = end - len(escape(text))
                prefix = ["".join(prefix) + piece]
                rows.append((now, example, turns + 1, True, prefix[0], begin, end))
                size += held + len(piece)
                example, trained = example + 1, turns + 1
            else:
                prefix.append(piece)
            held += len(piece)
            turns += 1
            if size >= most:
                yield _frames(rows)
                rows, size = [], 0
    rows += tail()
    if rows:
        yield _frames(rows)


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows -> one example for each assistant turn, in order, numbered from 0.

    An example's `text` holds all turns up to its reply; only `loss_start:loss_end` (code points; the reply's escaped
    text) is trainable. Turns after the last reply, or of a conversation without one, form a last example with
    trainable false and an empty span, so that no turn is lost.

    Turns are taken by turn (nulls first), ties by role and text; null roles and texts are empty; rows with a null conv_id are one conversation; repeated rows are repeated turns; an empty
    table has no examples; extra columns are ignored. Rows are shuffled by conversation and streamed in sorted order:
    a task holds one conversation's prefix (itself an example) and a few MB of examples, however long a conversation is.
    """
    return (
        conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
        .drop("turn")
        .mapInPandas(_expand, SCHEMA)
    )


def read_back(examples: DataFrame) -> DataFrame:
    """One row for each conversation, all of it read from formatted examples: turns, loss text, formatted length.

    Examples must come as prefix_target_examples() deals them: those of a conversation in one partition, in order.
    """
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        out: list[tuple] = []

        def close() -> None:
            if state:
                turns = parse(state["last"])
                h = hashlib.sha256()
                for role, text in turns:
                    h.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                out.append((state["conv"], len(turns), h.hexdigest(), state["loss"], state["digest"].hexdigest(), state["chars"]))
                state.clear()

        for f in batches:
            for conv, example, text, trainable, a, b in zip(f["conv_id"].tolist(), f["example"].tolist(), f["text"].tolist(), f["trainable"].tolist(), f["loss_start"].tolist(), f["loss_end"].tolist(), strict=True):
                if example == 0:
                    close()
                    state.update(conv=None if conv is None or conv != conv else int(conv), loss=0, chars=0, digest=hashlib.sha256())
                if trainable:
                    loss = unescape(text[a:b])
                    state["loss"] += len(loss)
                    state["digest"].update(loss.encode("utf-8", "surrogatepass"))
                state["chars"] += len(text)
                state["last"] = text
            if len(out) >= 1000:
                yield _done(out)
                out = []
        close()
        if out:
            yield _done(out)

    def _done(rows: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        f["conv_id"] = f["conv_id"].astype("Int64")
        return f

    return examples.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


__all__ = ["escape", "parse", "prefix_target_examples", "read_back", "render", "unescape"]
