r"""Chat formatting checked by a grammar round trip.

Grammar: a conversation is ``<s>`` and its turns, each ``OPEN blank text blank CLOSE``:

    user       [INST] text [/INST]        system     <<SYS>> text <</SYS>>
    assistant  [ANS] text </s>            any other  [ROLE name] text [/ROLE]

``!`` before the closing bracket of OPEN says that the text (and the name) is escaped: backslashes are doubled and each
control string has a backslash after its first character. A turn is first rendered as it is, read back by the
parser and compared; while it differs, or holds a control string, the next stronger escaping is taken:
control strings, then every bracket. Turns are self-delimiting, so each is rendered and checked on its own, in
parallel, whatever the length of its conversation; texts come out as ordered pieces with the
span of the text under the loss mask (assistant texts).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm.frames import table

BEGIN = "<s>"
FORMS = {"user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE ", "[/ROLE]")
CONTROL = re.compile(r"<s>|</s>|\[/?INST!?\]|\[/?ANS!?\]|<</?SYS!?>>|\[/?ROLE(?=[ \]])")
STRONG = re.compile(CONTROL.pattern + r"|[\[\]<>]")
ESCAPED = re.compile(r"\\(.)", re.S)
OPENING = re.compile(r"\[INST(!?)\] |\[ANS(!?)\] |<<SYS(!?)>> |\[ROLE ((?:[^\]\\]|\\.)*?)(!?)\] ", re.S)
PIECES = "conv_id bigint, turn bigint, role string, piece string, loss_start int, loss_end int, escaped boolean"


def escape(text: str, level: int) -> str:
    """Level 0: unchanged. 1: break control strings. 2: a backslash before every bracket as well."""
    if not level:
        return text
    text = text.replace("\\", "\\\\")
    if level > 1:
        return STRONG.sub(lambda m: "".join("\\" + c if c in "[]<>" or i == 1 else c for i, c in enumerate(m[0])), text)
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(role: str, text: str, level: int) -> tuple[str, int, int]:
    """The turn's piece and the place of its text in it."""
    opening, closing = FORMS.get(role, OTHER)
    if role not in FORMS:
        opening += escape(role, level) + "]"
    if level:
        at = opening.index(">>") if role == "system" else len(opening) - 1
        opening = opening[:at] + "!" + opening[at:]
    body = escape(text, level)
    return f"{opening} {body} {closing}", len(opening) + 1, len(opening) + 1 + len(body)


def parse(text: str, at: int = 0) -> Iterator[tuple[str, str, int, int, int]]:
    """``role, text, start and end of the text, end of the turn`` per turn from ``at`` on; ends where no turn begins."""
    while m := OPENING.match(text, at):
        user, answer, system, name, other = m.groups()
        role = "user" if user is not None else "assistant" if answer is not None else "system" if system is not None else name
        mark = user or answer or system or other
        closing = " " + (FORMS.get(role, OTHER) if name is None else OTHER)[1]
        end = text.find(closing, m.end())
        if end < 0:
            return
        body = text[m.end() : end]
        if mark:
            body, role = unescape(body), unescape(role) if name is not None else role
        at = end + len(closing)
        yield role, body, m.end(), end, at


def format_turn(role: str, text: str) -> tuple[str, int, int, bool]:
    """The piece with the weakest escaping under which it holds no stray control string and reads back as it was."""
    for level in (0, 1, 2):
        piece, start, end = render(role, text, level)
        clean = not CONTROL.search(piece, start, end) and (level or role in FORMS or not CONTROL.search(role))
        if clean and list(parse(piece)) == [(role, text, start, end, len(piece))]:
            return piece, start, end, level > 0
    raise ValueError(f"no escaping makes this turn readable: {role!r}")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        done = [format_turn(r or "", t or "") for r, t in zip(roles, texts)]
        piece, start, end, escaped = zip(*done) if done else ((), (), (), ())
        loss = [r == "assistant" for r in roles]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("turn"),
                pa.array([r or "" for r in roles], pa.string()),
                pa.array(piece, pa.string()),
                pa.array([s if x else None for s, x in zip(start, loss)], pa.int32()),
                pa.array([e if x else None for e, x in zip(end, loss)], pa.int32()),
                pa.array(escaped, pa.bool_()),
            ],
            names=["conv_id", "turn", "role", "piece", "loss_start", "loss_end", "escaped"],
        )


def formatted(turns: DataFrame) -> DataFrame:
    """``PIECES``: one row per turn of ``turns`` (``conv_id, turn, role, text``).

    ``<s>`` and the pieces of a conversation by ``turn, role, piece`` are its text. Null texts and roles are empty; a
    null turn comes first; turns with equal numbers come by role and rendered text, and repeated rows are
    all kept. Rows without ``conv_id`` belong to no conversation and are left out; other columns are ignored; an
    empty table gives no rows.
    """
    named = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return named.where("conv_id is not null").mapInArrow(_format, PIECES)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation from its ordered pieces, one piece at a time."""
    current, state, rows = None, None, []

    def closed():
        turns, loss = state["turns"].hexdigest(), state["loss"].hexdigest()
        return current, state["n"], turns, state["chars"], loss, state["size"]

    for batch in batches:
        for conv, piece in zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist()):
            if conv != current or state is None:
                if state is not None:
                    rows.append(closed())
                current = conv
                state = {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "chars": 0, "size": len(BEGIN)}
            read = 0
            for role, text, _, _, read in parse(piece):
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    state["loss"].update(text.encode())
                    state["chars"] += len(text)
            if read != len(piece):
                raise ValueError(f"conversation {conv} cannot be read back")
            state["size"] += len(piece)
        if rows:
            yield _digests(rows)
            rows = []
    if state is not None:
        yield _digests([closed()])


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_back(pieces: DataFrame) -> DataFrame:
    """``DIGESTS`` per conversation, parsed from the pieces.

    The digests run over a whole conversation in order, so its pieces pass through one task as a
    stream; nothing of it is held but the running digests.
    """
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece")
    return ordered.select("conv_id", "piece").mapInArrow(_read_back, DIGESTS)


PROBE = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of two turns whose texts are made of control strings."""
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(formatted(turns.unionByName(probe)))
