"""Chat formatting: records of any known layout to canonical turns, and to one training string with a loss mask.

A record's schema fingerprint is the hash of its sorted nested field paths (list elements as ``[]``). A fingerprint
selects a declarative mapping; it's looked up once for each distinct fingerprint and kept.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"

#: Layouts in order of choice. ``needs``: paths a record must have. ``list`` with ``role`` and ``text``: a list of turns.
#: ``fields``: turns made of top-level fields, joined by a blank line where several are present and not empty.
MAPPINGS = [
    {"name": "turns", "needs": ["turns[].role", "turns[].text"], "list": "turns", "role": "role", "text": "text"},
    {"name": "messages", "needs": ["messages[].role", "messages[].content"], "list": "messages", "role": "role", "text": "content"},
    {"name": "from_value", "needs": ["conversations[].from", "conversations[].value"], "list": "conversations", "role": "from", "text": "value"},
    {"name": "instruction", "needs": ["instruction", "output"], "fields": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"name": "prompt_completion", "needs": ["prompt", "completion"], "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])]},
    {"name": "prompt_response", "needs": ["prompt", "response"], "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "question_answer", "needs": ["question", "answer"], "fields": [("system", ["system"]), ("user", ["context", "question"]), ("assistant", ["answer"])]},
]
#: Other names of the three roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


def field_paths(value, at: str = "") -> set[str]:
    """Nested field paths of a parsed record."""
    if isinstance(value, dict):
        own = {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k)}
        return own or {at}
    if isinstance(value, list):
        own = {p for v in value for p in field_paths(v, at + "[]")}
        return own or {at + "[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


class Mapper:
    """Chooses the mapping of a record by its fingerprint, and applies it."""

    def __init__(self, mappings=MAPPINGS, roles=ROLES, limit: int = 10_000):
        self.mappings, self.roles, self.known, self.limit = mappings, roles, {}, limit

    def __call__(self, record) -> tuple[str, str | None, list[tuple[str, str]]]:
        """Fingerprint, name of the layout (None where no mapping fits), and turns."""
        paths = field_paths(record)
        print_ = fingerprint(paths)
        if print_ not in self.known:
            if len(self.known) >= self.limit:
                self.known.clear()
            self.known[print_] = next((m for m in self.mappings if paths.issuperset(m["needs"])), None)
        m = self.known[print_]
        if m is None:
            return print_, None, []
        if "list" in m:
            turns = [(t.get(m["role"]), t.get(m["text"])) for t in record[m["list"]] if isinstance(t, dict)]
        else:
            turns = [(role, "\n\n".join(s for n in names if (s := _text(record.get(n))))) for role, names in m["fields"]]
            turns = [t for t in turns if t[1] or t[0] != "system"]
        return print_, m["name"], [(self.roles.get(_text(r), _text(r)), _text(t)) for r, t in turns]


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def escape(text: str) -> str:
    """One more backslash inside every ``<|``, ``<\\|`` and so on, so that no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The training string, and the spans of it (in characters) under the loss mask: the assistants' texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a training string."""
    found = re.findall(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", formatted, re.S)
    return [(unescape_role(r), unescape(t)) for r, t in found]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_records(records: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """id, fingerprint, layout, formatted and loss_spans of each record, given as JSON text.

    A null, unparsable or unmapped record keeps its row with a null layout and an empty string. A turn's missing role or
    text counts as empty. Repeated ids stay. Other columns are not read.
    """

    def run(batches):
        mapper = Mapper()
        for b in batches:
            rows = []
            for raw in b.column(1).to_pylist():
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                print_, layout, turns = mapper(record) if isinstance(record, dict) else (None, None, [])
                rows.append((print_, layout, *render(turns)))
            spans = pa.array([[{"start": a, "end": z} for a, z in r[3]] for r in rows], _SPANS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.string()) for k in range(3)), spans], ["id", "fingerprint", "layout", "formatted", "loss_spans"])

    return records.select(F.col(id_column).cast("bigint").alias("id"), F.col(json_column).alias("record")).mapInArrow(
        run, "id bigint, fingerprint string, layout string, formatted string, loss_spans array<struct<start:bigint,end:bigint>>"
    )


def records_of_rows(rows: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One JSON record of the ``turns`` layout for each conversation given as rows; null roles and texts as empty.

    Turns go by ``order``, then role and text. A conversation is one string in the end, so its rows are gathered.
    """
    turn = F.struct(F.col(order).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy(key).agg(F.to_json(F.struct(F.array_sort(F.collect_list(turn)).alias("turns"))).alias("record"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the training strings and masks hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns, loss = parse(text), "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names)

    return formatted.select("id", "formatted", "loss_spans").mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
