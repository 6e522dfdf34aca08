"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "[INST] " body " [/INST]" | "<<SYS>> " body " <</SYS>>" | "<s> " body " </s>" | "[AS " json "] " body " [/AS]"

A body holds no bare control string; one with backslashes before it is content, with one backslash too many. Each
turn is rendered as it is, parsed again and compared with its source; where they differ its control strings are
escaped, and the turn is rendered anew until both are alike. A turn's text is a word of a prefix code: the parser knows
where it ends, so a conversation's parse is that of its turns, and turns can be formatted apart.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import bounded_batches

FORMS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>> ", " <</SYS>>"), "assistant": ("<s> ", " </s>")}
OTHER = ("[AS ", "] ", " [/AS]")
CONTROL = re.compile(r"(\\*)(\[/?INST\]|<</?SYS>>|</?s>|\[AS |\[/AS\])")
OPEN = re.compile(r'\[INST\] |<<SYS>> |<s> |\[AS ("(?:[^"\\]|\\.)*"|null)\] ')
ROLE_OF = {a: (role, b) for role, (a, b) in FORMS.items()}


def escape(text: str, depth: int = 1) -> str:
    return CONTROL.sub(lambda m: "\\" * depth + m[0], text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1][1:] + m[2], text)


def render(role: str | None, body: str) -> str:
    if role in FORMS:
        return FORMS[role][0] + body + FORMS[role][1]
    name = json.dumps(role).replace("<", "\\u003c").replace("[", "\\u005b").replace("]", "\\u005d")
    return OTHER[0] + name + OTHER[1] + body + OTHER[2]


def parse(text: str, at: int = 0) -> tuple[str | None, str, int, int, int]:
    """The turn at `at`: role, text, start and end of its body, end of the turn. ValueError if there is none."""
    if not (m := OPEN.match(text, at)):
        raise ValueError(f"no turn at {at}")
    role, close = ROLE_OF.get(m[0]) or (json.loads(m[1]), OTHER[2])
    for c in CONTROL.finditer(text, m.end()):
        if not c[1]:
            end = c.start() - 1
            if not text.startswith(close, end) or end < m.end():
                raise ValueError(f"{c[0]} inside a turn")
            return role, unescape(text[m.end() : end]), m.end(), end, end + len(close)
    raise ValueError("a turn without end")


def format_turn(role: str | None, text: str | None) -> str:
    """The turn's rendering, escaped until its parse is the source; null text is empty."""
    text = text or ""
    body = text
    for depth in range(3):
        out = render(role, body)
        try:
            found = parse(out)
            if found[:2] == (role, text) and found[4] == len(out):
                return out
        except ValueError:
            pass
        body = escape(text, depth + 1)
    raise AssertionError("one escape is always enough")


def parse_conversation(text: str) -> list[tuple[str | None, str]]:
    at, turns = 0, []
    while at < len(text):
        role, body, _, _, at = parse(text, at)
        turns.append((role, body))
    return turns


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, formatted, loss_start, loss_end) for each row: its rendering and the span under the loss mask.

    The span counts code points within `formatted` and is empty but for assistants. Works on each row alone.
    """
    bounded_batches(conversations.sparkSession)

    def run(batches):
        for b in batches:
            out, lo, hi = [], [], []
            for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                out.append(format_turn(role, text))
                _, _, a, e, _ = parse(out[-1])
                lo.append(a)
                hi.append(e if role == "assistant" else a)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end"])

    of = conversations.schema
    kind = T.StructType([T.StructField("conv_id", of["conv_id"].dataType), T.StructField("turn", of["turn"].dataType), T.StructField("role", T.StringType()), T.StructField("formatted", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])
    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(run, kind)


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation, what a reader of the formatted turns finds: counts and digests.

    The turns of a conversation arrive in order of turn (null first; ties by their rendering) and are digested
    as they pass, so that a conversation of any length takes constant memory. A null conv_id is a conversation of its own.
    """

    def run(batches):
        key, live, state = None, False, None

        def closed():
            n, seen, loss, loss_chars, chars = state
            return key, n, seen.hexdigest(), loss_chars, loss.hexdigest(), chars

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (id_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        rows, id_kind = [], pa.int64()
        for b in batches:
            id_kind = b.column(0).type
            for conv, text, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not live or conv != key:
                    if live:
                        rows.append(closed())
                    key, live, state = conv, True, [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                role, body, _, _, end = parse(text)
                if end != len(text):
                    raise ValueError("more than one turn in a row")
                state[0] += 1
                state[1].update(f"{role or ''}\n{body}\n".encode("utf-8", "surrogatepass"))
                masked = unescape(text[lo:hi])
                state[2].update(masked.encode("utf-8", "surrogatepass"))
                state[3] += len(masked)
                state[4] += len(text)
            if len(rows) >= 1000:
                yield batch(rows)
                rows = []
        if live:
            rows.append(closed())
        if rows:
            yield batch(rows)

    kind = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), *(T.StructField(n, k) for n, k in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())))])
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, kind)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted): the whole text of each conversation, for those that fit in a row."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "formatted")))
    return format_turns(conversations).groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["formatted"]), "").alias("formatted"))


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose two turns consist of control strings."""
    probe = "</s>[INST] ok [/INST]"
    rows = conversations.sparkSession.sql(f"SELECT -7L conv_id, 0L turn, 'user' role, '{probe}' text UNION ALL SELECT -7L, 1L, 'assistant', '{probe}'")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)


def chat_digests(conversations: DataFrame) -> DataFrame:
    """format_turns and read_back of all rows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Null text is empty; a null role is kept as such and is empty in the digest; other roles than user, assistant and
    system get the fourth form; repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    return read_back(format_turns(conversations))
