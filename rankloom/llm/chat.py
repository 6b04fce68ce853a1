"""Chat formatting: heterogeneous layouts to canonical turns, to one marked string, and back.

A layout is known by its fingerprint: the md5 of the sorted nested field paths that any mapping
names.  The fingerprint selects a declarative mapping, which says where turns or their parts are.
`canonical` reads tables (fingerprint of the schema), `canonical_json` columns of JSON objects of
mixed layouts (fingerprint of each row).

The template writes a turn as `### role:` LF text LF `</turn>` LF.  In roles and texts `\\`, `#`,
`<` (and `:` in roles) carry a backslash, so control strings in them are never read as marks, and
reading back gives the exact strings.  Loss spans are code point ranges of the formatted string that
hold the (escaped) texts of the assistant.

Null roles and texts are empty strings.  Rows of a conversation are ordered by turn, ties by role
and text, null turns first; rows of a null conversation id form one conversation.  Repeated rows stay.
A conversation without turns formats to the empty string.  Columns a mapping doesn't name are ignored;
if the fields of several mappings are there, the one with most fields is taken, then the first listed."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rankloom.llm.registry import query, table

TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


@dataclass(frozen=True)
class Mapping:
    """kind `rows`: a row per turn; `list`: an array of turns; `parts`: a turn per group of fields."""
    name: str
    kind: str
    fields: tuple  # rows: key, turn, role, text.  list: array, role, text.  parts: (role, (field, ...)), ...

    def paths(self) -> tuple[str, ...]:
        if self.kind == "rows":
            return self.fields
        if self.kind == "list":
            return tuple(f"{self.fields[0]}[].{f}" for f in self.fields[1:])
        return tuple(f for _, names in self.fields for f in names)


MAPPINGS = [
    Mapping("turn rows", "rows", ("conv_id", "turn", "role", "text")),
    Mapping("messages", "list", ("messages", "role", "content")),
    Mapping("conversations", "list", ("conversations", "from", "value")),
    Mapping("instruction with input", "parts", (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction", "parts", (("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("prompt with system", "parts", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt", "parts", (("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("completion", "parts", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question", "parts", (("user", ("question",)), ("assistant", ("answer",)))),
]
# Names that layouts give to the two speakers.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaves below a type; `[]` steps into an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def fingerprint(paths) -> str:
    return hashlib.md5("|".join(sorted(set(paths))).encode("utf-8")).hexdigest()


def _table(mappings) -> dict[str, Mapping]:
    return {fingerprint(m.paths()): m for m in reversed(mappings)}


def mapping_of(paths, mappings=None) -> Mapping | None:
    """The mapping whose fingerprint the named fields have; else the largest that fits in them."""
    mappings = MAPPINGS if mappings is None else mappings
    named = {p for m in mappings for p in m.paths()}
    exact = _table(mappings).get(fingerprint(p for p in paths if p in named))
    if exact:
        return exact
    inside = [m for m in mappings if set(m.paths()) <= set(paths)]
    return max(inside, key=lambda m: len(m.paths()), default=None)


def canonical(df: DataFrame, mappings=None) -> DataFrame:
    """(conv_id, turns) of a table of any known layout; without a conv_id column the id is null."""
    m = mapping_of(field_paths(df.schema), mappings)
    if m is None:
        raise ValueError(f"no mapping for the fields {field_paths(df.schema)}")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if m.kind == "rows":
        key, turn, role, said = (F.col(f"`{f}`") for f in m.fields)
        rows = df.select(key.alias("conv_id"), F.struct(turn.alias("turn"), text(role).alias("role"), text(said).alias("text")).alias("t"))
        return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
            "conv_id", F.transform("t", lambda t: F.struct(t["role"], t["text"])).cast(TURNS).alias("turns"))
    key = F.col("conv_id") if "conv_id" in df.columns else F.lit(None).cast("bigint")
    if m.kind == "list":
        array, role, said = m.fields
        turns = F.coalesce(_items(F.col(f"`{array}`"), role, said).cast(TURNS), F.array().cast(TURNS))
    else:
        turns = _parts(m, lambda f: F.col(f"`{f}`").cast("string"))
    return df.select(key.alias("conv_id"), turns.cast(TURNS).alias("turns"))


def _role(role):
    out = role
    for name, canonical_name in ROLES.items():
        out = F.when(role == name, F.lit(canonical_name)).otherwise(out)
    return out


def _items(items, role: str, said: str):
    return F.transform(items, lambda t: F.struct(_role(F.coalesce(t[role], F.lit(""))).alias("role"), F.coalesce(t[said], F.lit("")).alias("text")))


def _parts(m: Mapping, read):
    """A turn per group of fields: its non-empty fields, a line each; groups without any are no turn."""
    turns = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[read(f) for f in names]), lambda x: x.isNotNull() & (x != "")), "\n").alias("text"))
             for role, names in m.fields]
    return F.filter(F.array(*turns), lambda t: t["text"] != "")


def canonical_json(df: DataFrame, column: str, mappings=None) -> DataFrame:
    """Add (layout, turns) to rows with a JSON object of any known layout; unknown layouts and text
    that is no JSON object give nulls.  The fingerprint of each row selects its mapping; rows whose
    named fields have no mapping's fingerprint get the largest one that fits in them, as tables do.
    A field of a list is there if any element has it."""
    mappings = [m for m in (MAPPINGS if mappings is None else mappings) if m.kind != "rows"]
    v = F.try_parse_json(F.col(f"`{column}`"))

    def there(path: str):
        array, _, field = path.partition("[].")
        if not field:
            return F.try_variant_get(v, f"$.{path}", "string").isNotNull()
        return F.exists(F.try_variant_get(v, f"$.{array}", "array<variant>"), lambda e: F.try_variant_get(e, f"$.{field}", "string").isNotNull())

    def turns_by(m: Mapping):
        if m.kind == "list":
            array, role, said = m.fields
            return _items(F.try_variant_get(v, f"$.{array}", f"array<struct<`{role}`: string, `{said}`: string>>"), role, said)
        return _parts(m, lambda f: F.try_variant_get(v, f"$.{f}", "string"))

    named = F.array_compact(F.array(*[F.when(there(p), F.lit(p)) for p in sorted({p for m in mappings for p in m.paths()})]))
    found = F.md5(F.concat_ws("|", named).cast("binary"))
    fits = lambda m: F.size(F.array_except(F.array(*[F.lit(p) for p in m.paths()]), named)) == 0
    exact = [F.when(found == print_, F.lit(m.name)) for print_, m in _table(mappings).items()]
    inside = [F.when(fits(m), F.lit(m.name)) for m in sorted(mappings, key=lambda m: -len(m.paths()))]
    layout, turns = F.coalesce(*exact, *inside), F.lit(None).cast(TURNS)
    for m in reversed(mappings):
        turns = F.when(layout == m.name, turns_by(m).cast(TURNS)).otherwise(turns)
    return df.withColumns({"layout": layout, "turns": turns})


_HEAD, _END = "### ", "\n</turn>\n"
_START = re.compile(r"### ((?:\\.|[^\\:])*):\n", re.DOTALL)
_TEXT, _ROLE, _BACK = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]"), re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, pattern: re.Pattern = _TEXT) -> str:
    return pattern.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def write(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans under the loss mask."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{_HEAD}{escape(role, _ROLE)}:\n", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, _END]
        at += len(head) + len(body) + len(_END)
    return "".join(out), spans


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string."""
    turns, at = [], 0
    while at < len(formatted):
        head = _START.match(formatted, at)
        if head is None:
            raise ValueError(f"no turn begins at {at}")
        end = formatted.index(_END, head.end() - 1)
        turns.append((unescape(head.group(1)), unescape(formatted[head.end():end])))
        at = end + len(_END)
    return turns


def _mapped(df: DataFrame, added: T.StructType, function) -> DataFrame:
    """The rows with new columns, computed batch by batch; columns of the same name are replaced."""
    names = added.names
    schema = T.StructType([f for f in df.schema.fields if f.name not in names] + added.fields)
    from pyspark.sql.pandas.types import to_arrow_schema
    kinds = to_arrow_schema(added)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                kept = [n for n in batch.schema.names if n not in names]
                new = function(batch)
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + [pa.array(new[n], kinds.field(n).type) for n in names], names=kept + names)

    return df.mapInArrow(run, schema)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def format_turns(df: DataFrame, learn: str = "assistant") -> DataFrame:
    """Add (formatted, loss_spans) to rows with canonical turns."""

    def run(batch):
        done = [write([(t["role"] or "", t["text"] or "") for t in turns or []], learn) for turns in batch.column("turns").to_pylist()]
        return {"formatted": [d[0] for d in done], "loss_spans": [[{"start": a, "end": b} for a, b in d[1]] for d in done]}

    return _mapped(df, T.StructType([T.StructField("formatted", T.StringType()), T.StructField("loss_spans", SPANS)]), run)


def read_back(df: DataFrame) -> DataFrame:
    """Replace the turns by those read from `formatted`, and add loss_text: all text under the spans."""

    def run(batch):
        formatted, spans = batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()
        return {"turns": [[{"role": r, "text": t} for r, t in read(f)] for f in formatted],
                "loss_text": ["".join(unescape(f[s["start"]:s["end"]]) for s in ss) for f, ss in zip(formatted, spans)]}

    return _mapped(df, T.StructType([T.StructField("turns", TURNS), T.StructField("loss_text", T.StringType())]), run)


@query("op2_chat_format")
def op2_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    back = read_back(format_turns(canonical(rows.unionByName(extra))))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))
