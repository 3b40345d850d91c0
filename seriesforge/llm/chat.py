"""Chat formatting by schema fingerprints.

Records arrive as JSON in many layouts.  The nested field paths of a record (array positions left out) are sorted and
hashed; the fingerprint selects a declarative mapping, which says where turns, roles and texts stand.  Records are
turned into canonical turns, then into one string by a template that marks turns and escapes control strings, so that
:func:`parse` gives back exactly the same turns whatever the texts say.  Loss spans cover the assistant texts.

Defined cases: null text is empty; null role is ``user``; roles of ``messages`` stay as they are; a record that is null, not
JSON or of no known layout yields null turns with its fingerprint, so it can be listed and mapped; turns with equal
numbers are ordered by role and text; turns without a number come last.  A conversation is the unit of work and its
text one value; copies of a conversation are separate rows.  Other columns pass through.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "<|turn ", "|>\n", "\n<|end|>\n"
ROLE_OF = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: a list under ``turns`` with ``role`` and ``text`` fields, or ``parts``, an
    ordered list of (role, field path, field path of an optional addition).  Where ``rename`` holds, roles are stripped,
    lowered and renamed by ``ROLE_OF``, an empty one being ``user``; elsewhere they stay as given."""

    turns: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, str, str], ...] = ()
    rename: bool = False


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a record; list items share one path."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint(fields: set[str] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode()).hexdigest()[:16]


#: Layouts by their field paths; a registry of one's own may be passed instead.
LAYOUTS: dict[str, Mapping] = {fingerprint(f): m for f, m in (
    (["messages[].role", "messages[].content"], Mapping("messages", "role", "content")),
    (["messages[].role", "messages[].text"], Mapping("messages", "role", "text")),
    (["messages[]"], Mapping("messages", "role", "content")),
    (["conversations[].from", "conversations[].value"], Mapping("conversations", "from", "value", rename=True)),
    (["prompt", "completion"], Mapping(parts=(("user", "prompt", ""), ("assistant", "completion", "")))),
    (["prompt", "response"], Mapping(parts=(("user", "prompt", ""), ("assistant", "response", "")))),
    (["instruction", "output"], Mapping(parts=(("user", "instruction", ""), ("assistant", "output", "")))),
    (["instruction", "input", "output"], Mapping(parts=(("user", "instruction", "input"), ("assistant", "output", "")))),
    (["system", "instruction", "input", "output"], Mapping(parts=(("system", "system", ""), ("user", "instruction", "input"), ("assistant", "output", "")))),
    (["question", "answer"], Mapping(parts=(("user", "question", ""), ("assistant", "answer", "")))),
    (["data.prompt", "data.completion"], Mapping(parts=(("user", "data.prompt", ""), ("assistant", "data.completion", "")))),
)}


def _get(value, path: str):
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _text(x) -> str:
    return x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False, sort_keys=True)


def canonical(record: dict, m: Mapping) -> list[tuple[str, str]]:
    if m.turns:
        out = []
        for t in _get(record, m.turns) or []:
            role = "user" if t.get(m.role) is None else _text(t[m.role])
            if m.rename:
                role = role.strip().lower() or "user"
                role = ROLE_OF.get(role, role)
            out.append((role, _text(t.get(m.text))))
        return out
    out = []
    for role, main, more in m.parts:
        text, extra = _text(_get(record, main)), _text(_get(record, more)) if more else ""
        if role != "system" or text:
            out.append((role, text + ("\n\n" + extra if extra else "")))
    return out


def escape(s: str) -> str:
    """No escaped text holds ``<|``: backslashes are doubled and the bar after ``<`` gets one."""
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and the (start, length) spans of assistant texts in it, in code points."""
    out, at, spans = [], 0, []
    for role, text in turns:
        name = escape(role).replace("|>", "|\\>")
        head, body = f"{OPEN}{name}{MID}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


TURN = re.compile(r"<\|turn (.*?)\|>\n(.*?)\n<\|end\|>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted)]


def format_records(records: DataFrame, record: str = "record", layouts: dict[str, Mapping] | None = None) -> DataFrame:
    """Add schema_id, turns, formatted and loss_spans to rows with a JSON column."""
    layouts = LAYOUTS if layouts is None else layouts
    known = "schema_id string, turns array<struct<role:string,text:string>>, formatted string, loss_spans array<struct<start:int,length:int>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for raw in pdf[record]:
                try:
                    value = json.loads(raw) if isinstance(raw, str) else None
                except ValueError:
                    value = None
                key = fingerprint(paths(value)) if isinstance(value, dict) else None
                m = layouts.get(key)
                if m is None:
                    rows.append((key, None, None, None))
                    continue
                turns = canonical(value, m)
                text, spans = render(turns)
                rows.append((key, [{"role": r, "text": t} for r, t in turns], text, [{"start": s, "length": n} for s, n in spans]))
            add = pd.DataFrame(rows, columns=["schema_id", "turns", "formatted", "loss_spans"], dtype=object, index=pdf.index)
            yield pd.concat([pdf.drop(columns=[c for c in add.columns if c in pdf.columns]), add], axis=1)

    kept = [f for f in records.schema.fields if f.name not in ("schema_id", "turns", "formatted", "loss_spans")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + known
    return records.mapInPandas(run, schema)


def records_of_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Gather rows by turn into one JSON record per conversation, in the layout of ``messages``."""
    one = F.struct(F.col(turn).isNull().alias("last"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("user")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    g = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("_m"))
    messages = F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return g.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text says when it is read back: turns, and all text under the loss mask."""
    def run(frames):
        for pdf in frames:
            rows = []
            for conv, text, spans in zip(pdf["conv_id"], pdf["formatted"], pdf["loss_spans"]):
                back = parse(text)
                loss = "".join(unescape(text[s["start"]:s["start"] + s["length"]]) for s in spans)
                rows.append((conv, len(back), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in back).encode()).hexdigest(),
                             len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    slim = formatted.where("formatted is not null").select("conv_id", "formatted", "loss_spans")
    return slim.mapInPandas(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
