"""Chat formatting: schema fingerprints select declarative mappings from any layout to canonical turns.

The fingerprint of a record is the hash of its sorted nested field paths. A registry maps fingerprints to mappings, which
are data: where the turns are, which fields hold role and text, and how role names translate. Canonical turns are
marked, their texts escaped reversibly, and the texts that a model learns from are given as a loss mask.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    r"""Put a backslash into every <| so that no control string is left: <| becomes <\|, <\| becomes <\\|."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def _role_line(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line), flags=re.DOTALL)


def paths(value: Any, at: str = "") -> set[str]:
    """Nested field paths: a.b for fields, a[] for what lists hold. Values do not matter, nor does their order."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)} or {f"{at}{{}}"}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def schema_fingerprint(found: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """Either `turns`: the list of turns with its `role` and `text` fields (an empty path: the record is one turn),
    or `parts`: (role, field, field to append) for layouts with a field per role. `number` orders one-turn records;
    `first` names the number of a list's first turn, where it is not 0; `leads` are (role, field) beside a list that are
    turns before it."""

    turns: str | None = None
    role: str = "role"
    text: str = "content"
    parts: tuple[tuple[str, str, str | None], ...] = ()
    number: str | None = None
    first: str | None = None
    roles: dict[str, str] = field(default_factory=dict)
    leads: tuple[tuple[str, str], ...] = (("system", "system"), ("user", "prompt"))


_SHARE = {"human": "user", "gpt": "assistant", "system": "system", "bot": "assistant", "chatgpt": "assistant"}
#: Layouts by the field paths that they have; extra paths may be registered.
LAYOUTS: tuple[tuple[tuple[str, ...], Mapping], ...] = (
    (("conv_id", "turn", "role", "text"), Mapping(turns="", text="text", number="turn")),
    (("messages[].role", "messages[].content"), Mapping(turns="messages")),
    (("conversation[].role", "conversation[].content"), Mapping(turns="conversation")),
    (("turn", "messages[].role", "messages[].content"), Mapping(turns="messages", first="turn")),
    (("turn", "conversation[].role", "conversation[].content"), Mapping(turns="conversation", first="turn")),
    (("conversations[].from", "conversations[].value"), Mapping(turns="conversations", role="from", text="value", roles=_SHARE)),
    (("instruction", "input", "output"), Mapping(parts=(("user", "instruction", "input"), ("assistant", "output", None)))),
    (("instruction", "output"), Mapping(parts=(("user", "instruction", None), ("assistant", "output", None)))),
    (("system", "instruction", "input", "output"), Mapping(parts=(("system", "system", None), ("user", "instruction", "input"), ("assistant", "output", None)))),
    (("system", "instruction", "output"), Mapping(parts=(("system", "system", None), ("user", "instruction", None), ("assistant", "output", None)))),
    (("prompt", "completion"), Mapping(parts=(("user", "prompt", None), ("assistant", "completion", None)))),
    (("prompt", "response"), Mapping(parts=(("user", "prompt", None), ("assistant", "response", None)))),
    (("question", "answer"), Mapping(parts=(("user", "question", None), ("assistant", "answer", None)))),
)


def registry(layouts: Iterable[tuple[tuple[str, ...], Mapping]] = LAYOUTS) -> dict[str, Mapping]:
    return {schema_fingerprint(found): mapping for found, mapping in layouts}


def _string(value: Any) -> str:
    """What a text field says: a text itself, nothing for null, the texts of a list of parts line by line, else JSON."""
    if isinstance(value, list) and value:
        return "\n".join(_string(v.get("text") if isinstance(v, dict) and isinstance(v.get("text"), str) else v) for v in value)
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def _number(value: Any) -> int | None:
    """A turn's number: whole numbers, also as text; anything else, or what 64 bits can't hold, is none."""
    if isinstance(value, str) and re.fullmatch(r"\s*[+-]?\d{1,19}\s*", value):
        value = int(value)
    elif isinstance(value, float) and value.is_integer():
        value = int(value)
    return value if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63 else None


def turns_of(record: dict, mapping: Mapping) -> list[tuple[int | None, str, str]]:
    """(number, role, text) of a record's turns. Missing roles and texts are empty.

    An item of a list that is no object is a turn without a role, its text what the item says. Fields beside a list that
    are turns (mapping.leads) come before it, unless the list begins by saying the same; where the list's number is given
    by a field they have no number, else the list counts on from them. What stands in a list's place but is none is one item.
    """
    if mapping.parts:
        out = []
        for role, name, more in mapping.parts:
            pieces = [_string(record.get(n)) for n in (name, more) if n]
            out.append((len(out), role, "\n".join(p for k, p in enumerate(pieces) if p or not k)))
        return out
    role = lambda t: mapping.roles.get(r := _string(t.get(mapping.role)), r)
    said = lambda t: (role(t), _string(t.get(mapping.text))) if isinstance(t, dict) else ("", _string(t))
    if mapping.turns == "":
        return [(_number(record.get(mapping.number)) if mapping.number else 0, *said(record))]
    items = record.get(mapping.turns)
    items = [said(t) for t in (items if isinstance(items, list) else [] if items is None else [items])]
    leads = [(r, _string(record[name])) for r, name in mapping.leads if record.get(name) not in (None, "", [])]
    leads = [lead for lead in leads if lead not in items[: len(leads)]]
    if mapping.first:
        first = _number(record.get(mapping.first))
        numbers = [None] * len(leads) + [None if first is None else first + k for k in range(len(items))]
    else:
        numbers = range(len(leads) + len(items))
    return [(number, *turn) for number, turn in zip(numbers, leads + items, strict=True)]


def canonical_turns(records: DataFrame, layouts: tuple[tuple[tuple[str, ...], Mapping], ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, role, text, layout of records (conv_id, record: JSON text).

    layout is the record's fingerprint. Where no layout has exactly its field paths, the layout with the most of them
    chooses the mapping, so that further fields, or parts where a text is expected, do no harm; layouts with as many are
    too many, and the record is unknown. A record that is null, no JSON object or of an unknown layout gives one row with a
    null role and text, so that nothing vanishes unseen (see unknown_layouts), and so does one whose list of turns is empty,
    its layout marked as empty; known layouts never give a null role otherwise. What turns_of() says of fields of
    unexpected kinds holds: none is an error. A null conv_id stays; repeated records each give their turns; an empty table
    gives an empty table; other columns are not read.
    """
    key = records.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache = registry(layouts), {}
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for row, text in enumerate(batch.column(1)):
                try:
                    record = json.loads(text.as_py() or "null")
                except ValueError:
                    record = None
                name, mapping = None, None
                if isinstance(record, dict):
                    found = frozenset(paths(record))
                    name = cache.get(found) or cache.setdefault(found, schema_fingerprint(found))
                    mapping = known.get(name) or _widest(found, layouts)
                turns = turns_of(record, mapping) if mapping else []
                if mapping and not turns:
                    name = f"{EMPTY}{name}"
                for number, role, said in turns or [(None, None, None)]:
                    for column, value in zip(out, (row, number, role, said, name), strict=True):
                        column.append(value)
                if len(cache) > 10_000:
                    cache.clear()
            ids = batch.column(0).take(pa.array(out[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out[1], pa.int64()), *(pa.array(out[k], pa.string()) for k in (2, 3, 4))], names=["conv_id", "turn", "role", "text", "layout"])

    shape = f"conv_id {key.simpleString()}, turn long, role string, text string, layout string"
    return records.select("conv_id", "record").mapInArrow(run, shape)


#: Marks the layout of records whose list of turns is empty.
EMPTY = "empty:"


def _widest(found: frozenset[str], layouts: tuple[tuple[tuple[str, ...], Mapping], ...]) -> Mapping | None:
    """The mapping of the layout with the most of the record's paths, all of its own among them.

    A path is there if the record has it or anything below it, so a content of several parts is a content. Failing that,
    a list under a layout's name, empty or of texts alone, chooses the first layout with that list.
    """
    above = {p[:k] for p in found for k in (m.start() for m in re.finditer(r"[.\[{]", p))} | found
    fitting = sorted(((len(paths), k) for k, (paths, _) in enumerate(layouts) if above.issuperset(paths)), reverse=True)
    if fitting:
        return layouts[fitting[0][1]][1] if len(fitting) == 1 or fitting[0][0] > fitting[1][0] else None
    return next((m for _, m in layouts if m.turns and f"{m.turns}[]" in above and not m.first), None)


def unknown_layouts(turns: DataFrame) -> DataFrame:
    """layout (null: no JSON object) and records: how many records of canonical turns no mapping fits."""
    unknown = F.col("role").isNull() & ~F.coalesce(F.startswith("layout", F.lit(EMPTY)), F.lit(False))
    return turns.where(unknown).groupBy("layout").agg(F.count("*").alias("records"))


def turn_records(turns: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text as records of one turn each, in one of three layouts by conversation.

    A conversation without an id takes the flat layout; null fields are fields.
    """
    text = F.coalesce("text", F.lit(""))
    one = F.array(F.struct("role", text.alias("content")))
    write = lambda *fields: F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    kind = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    listed = F.when(kind == 1, write("turn", one.alias("messages"))).when(kind == 2, write("turn", one.alias("conversation")))
    record = F.coalesce(F.when(F.col("conv_id").isNotNull(), listed), write("conv_id", "turn", "role", text.alias("text")))
    return turns.select("conv_id", record.alias("record"))


def formatted(turns: DataFrame) -> DataFrame:
    """Adds to canonical turns: segment, the turn as it stands in the formatted text, and loss_start, loss_stop.

    A conversation's formatted text is its segments by turn, then role, then text, without anything between. The loss
    mask covers an assistant's escaped text (offsets in the segment, in code points); elsewhere both are null. Turns
    without a number come first; turns that fit no layout have no segment. A null text is an empty one; repeated turns
    stay; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments, starts, stops = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if role is None:
                    segment, start, stop = None, None, None
                else:
                    head, body = f"{START}{_role_line(role)}\n", escape(text or "")
                    segment = f"{head}{body}{END}\n"
                    start, stop = (len(head), len(head) + len(body)) if role == "assistant" else (None, None)
                segments.append(segment)
                starts.append(start)
                stops.append(stop)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segments, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=[*batch.schema.names, "segment", "loss_start", "loss_stop"])

    turns = turns.select("conv_id", "turn", "role", "text", "layout")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema) + ", segment string, loss_start int, loss_stop int"
    return turns.mapInArrow(run, shape)


def read_segments(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted text: the inverse of formatting."""
    out = []
    for part in text.split(START)[1:]:
        role, _, body = part.partition("\n")
        if not body.endswith(f"{END}\n"):
            raise ValueError("a turn is not closed")
        out.append((_role_of(role), unescape(body[: -len(END) - 1])))
    return out


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, segment: str, start: int | None, stop: int | None) -> None:
        for role, text in read_segments(segment):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        if start is not None:
            learned = unescape(segment[start:stop])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)
        self.chars += len(segment)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(segments: DataFrame) -> DataFrame:
    """What is read back from the formatted text of each conversation: turns, learned text, lengths.

    Segments stream through in order, a conversation at a time, so one of any length takes no memory. A conversation
    is in one task: its digest is sequential by nature. Turns that fit no layout are not counted; a null conv_id is a
    conversation of its own; an empty table gives an empty table.
    """
    key = segments.schema["conv_id"].dataType
    rows = segments.where("segment is not null").select("conv_id", "turn", "role", "text", "segment", "loss_start", "loss_stop")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "segment", "loss_start", "loss_stop")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def batch_of(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, kind = None, None, None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for conv_id, *segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is None or conv_id != now:
                    if digest:
                        done.append((now, *digest.row()))
                    now, digest = conv_id, _Digest()
                digest.add(*segment)
            if done:
                yield batch_of(done, kind)
        if digest:
            yield batch_of([(now, *digest.row())], kind)

    return rows.mapInArrow(run, f"conv_id {key.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
