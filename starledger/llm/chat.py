"""Chat formatting driven by schema fingerprints.

A record's layout is told by a hash of its nested field paths, of those paths that any known layout uses, so other
columns don't matter. The fingerprint selects a declarative mapping to canonical turns (id, turn, role, text).
Tables are mapped by their schema, as column expressions; JSON records of mixed layouts one by one in Arrow
batches. ``format_turns`` writes the turns by a template whose control strings are escaped inside texts, with
the loss mask as spans, and ``read_back`` recovers roles and texts from that output alone.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Layout:
    """A declarative mapping.

    ``turns`` is the path of an array with ``role`` and ``text`` in each element, or empty, and then either each
    row is a turn (``role`` and ``text`` are its columns) or ``fixed`` lists (role, paths) whose texts are joined by
    an empty line, empty ones left out.
    """

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()


#: Field names of common public layouts.
LAYOUTS = (
    Layout("turn_rows", ("role", "text", "turn"), role="role", text="text"),
    Layout("messages", ("messages[].role", "messages[].content"), "messages", "role", "content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Layout("dialog", ("dialog[].speaker", "dialog[].text"), "dialog", "speaker", "text"),
    Layout("prompt_completion", ("prompt", "completion"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", ("instruction", "input", "output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system_instruction", ("system", "instruction", "input", "output"), fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question_answer", ("question", "answer"), fixed=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("context_question", ("context", "question", "answer"), fixed=(("user", ("context", "question")), ("assistant", ("answer",)))),
)
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant", "prompter": "user"}
_KNOWN = frozenset(p for layout in LAYOUTS for p in layout.paths)


def fingerprint(paths) -> str:
    """Hash of those field paths that some layout uses."""
    return hashlib.sha256("\n".join(sorted(set(paths) & _KNOWN)).encode()).hexdigest()[:16]


_BY_FINGERPRINT = {fingerprint(layout.paths): layout for layout in LAYOUTS}


def schema_paths(schema: T.DataType, at: str = "") -> list[str]:
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{at}[]")
    return [at]


def value_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, f"{at}[]")}
    return {at}


def layout_of(paths) -> Layout | None:
    return _BY_FINGERPRINT.get(fingerprint(paths))


def table_turns(df: DataFrame, id_column: str, order: str = "turn") -> DataFrame:
    """Canonical turns (id, turn, role, text) of a table of one layout; ValueError if its fingerprint is unknown.

    Rows that are turns already keep their roles; lists of turns get canonical ones. Null roles and texts are empty, an empty table gives no
    turns, other columns are left out.
    """
    layout = layout_of(schema_paths(df.schema))
    if layout is None:
        raise ValueError(f"no mapping for the fields {sorted(set(schema_paths(df.schema)) & _KNOWN)}")
    i = F.col(id_column).alias("id")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role = lambda c: F.coalesce(*[F.when(F.col(c) == k, v) for k, v in ROLES.items()], F.col(c).cast("string"), F.lit(""))
    if layout.turns:
        turns = df.select(i, F.posexplode(layout.turns).alias("turn", "t"))
        return turns.select("id", F.col("turn").cast("long"), role(f"t.{layout.role}").alias("role"), text(f"t.{layout.text}").alias("text"))
    if layout.fixed:
        made = [F.struct(F.lit(r).alias("role"), F.array_join(F.filter(F.array(*[text(p) for p in paths]), lambda x: x != ""), "\n\n").alias("text")) for r, paths in layout.fixed]
        turns = df.select(i, F.posexplode(F.array(*made)).alias("turn", "t")).where("t.role != 'system' or t.text != ''")
        return turns.select("id", F.col("turn").cast("long"), "t.role", "t.text")
    return df.select(i, F.col(order).cast("long").alias("turn"), text(layout.role).alias("role"), text(layout.text).alias("text"))


_TURNS = pa.schema([("id", pa.int64()), ("layout", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _plain(v) -> str:
    return v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False)


def record_turns_of(record: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """Layout name and turns of one JSON record; (None, []) for null, bad JSON or an unknown layout."""
    try:
        value = json.loads(record or "")
    except ValueError:
        return None, []
    layout = layout_of(value_paths(value)) if isinstance(value, dict) else None
    if layout is None:
        return None, []
    if layout.turns:
        return layout.name, [(ROLES.get(_plain(t.get(layout.role)), _plain(t.get(layout.role))), _plain(t.get(layout.text))) for t in value[layout.turns]]
    if layout.fixed:
        turns = [(r, "\n\n".join(x for p in paths if (x := _plain(value.get(p))))) for r, paths in layout.fixed]
        return layout.name, [t for t in turns if t[0] != "system" or t[1]]
    return layout.name, [(_plain(value.get(layout.role)), _plain(value.get(layout.text)))]


def record_turns(df: DataFrame, id_column: str, record: str) -> DataFrame:
    """(id, layout, turn, role, text) of JSON records of any layouts; a record without a mapping gives one row of nulls."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for i, r in zip(b.column("id").to_pylist(), b.column("record").to_pylist(), strict=True):
                name, turns = record_turns_of(r)
                rows += [(i, name, n, role, text) for n, (role, text) in enumerate(turns)] or [(i, name, None, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TURNS, strict=True)] if rows else [pa.array([], f.type) for f in _TURNS], schema=_TURNS)

    return df.select(F.col(id_column).cast("long").alias("id"), F.col(record).alias("record")).mapInArrow(run, "id long, layout string, turn long, role string, text string")


# --- template -------------------------------------------------------------------------------------------

#: What opens and closes a turn of each role; any other role stands between <| and |>.
_OPEN = {"user": "<s>[INST] ", "assistant": "[OUT] ", "system": "<<SYS>> "}
_CLOSE = {"user": " [/INST]", "assistant": " </s>", "system": " <</SYS>>"}
_OTHER_CLOSE = " <|end|>"
_CONTROL = r"\\|<s>|</s>|\[/?INST\]|\[OUT\]|<</?SYS>>|<\||\|>"
_ESCAPE, _UNESCAPE = re.compile(_CONTROL), re.compile(rf"\\({_CONTROL})")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's formatted text and the span of it under the loss mask (empty unless the assistant speaks)."""
    opened = _OPEN.get(role) or f"<|{escape(role)}|> "
    body = escape(text)
    start = len(opened)
    return opened + body + _CLOSE.get(role, _OTHER_CLOSE), start, start + len(body) if role == "assistant" else start


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    for role, opened in _OPEN.items():
        if formatted.startswith(opened):
            return role, unescape(formatted[len(opened) : len(formatted) - len(_CLOSE[role])])
    m = re.match(rf"<\|((?:\\(?:{_CONTROL})|(?!\|>)[\s\S])*)\|> ", formatted)
    return unescape(m[1]), unescape(formatted[m.end() : len(formatted) - len(_OTHER_CLOSE)])


_FORMATTED = pa.schema([("id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32())])


def format_turns(turns: DataFrame) -> DataFrame:
    """(id, turn, formatted, loss_start, loss_end): a row for each turn, a conversation's rows together and in order.

    A conversation's text is its rows' ``formatted`` in turn; spans count code points of their row. Conversations
    are streamed, so one with very many turns fits too. Turns are ordered by turn, role and text, so repeated
    rows stay; a null id is a conversation of its own. An empty table gives no rows; a text of any length is one value.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            made = [format_turn(r or "", t or "") for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            columns = [b.column("id"), b.column("turn"), *[pa.array([m[i] for m in made], _FORMATTED.field(i + 2).type) for i in range(3)]]
            yield pa.RecordBatch.from_arrays(columns, schema=_FORMATTED)

    dealt = turns.select(F.col("id").cast("long"), F.col("turn").cast("long"), "role", "text").repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    return dealt.mapInArrow(run, "id long, turn long, formatted string, loss_start int, loss_end int")


def whole_texts(formatted: DataFrame) -> DataFrame:
    """(id, formatted) with one row for each conversation; for conversations that fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "formatted")))
    return formatted.groupBy("id").agg(F.concat_ws("", F.transform(parts, lambda x: x["formatted"])).alias("formatted"))


class _Digest:
    def __init__(self, key):
        self.key, self.turns, self.loss_chars, self.chars = key, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, end: int) -> None:
        role, text = parse_turn(formatted)
        masked = unescape(formatted[start:end])
        self.turns += 1
        self.chars += len(formatted)
        self.loss_chars += len(masked)
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.loss.update(masked.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_READ = pa.schema([("id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of roles, texts and masked texts read from the rows of ``format_turns``, one row for each conversation; none of an empty table."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for b in it:
            done = []
            for key, *row in zip(*[b.column(c).to_pylist() for c in ("id", "formatted", "loss_start", "loss_end")], strict=True):
                if now is None or now.key != key:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(key)
                now.add(*row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _READ, strict=True)], schema=_READ)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(now.row(), _READ, strict=True)], schema=_READ)

    return formatted.mapInArrow(run, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
