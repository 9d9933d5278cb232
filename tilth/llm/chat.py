r"""Chat formatting in DataFrame functions.

Layouts are told apart by fingerprints: a hash of sorted nested field paths. A declarative mapping to
canonical turns, an array of (role, text), fits a table if the table's paths that the mapping knows have
the mapping's own fingerprint; of several that fit, the one with the most paths is taken, and of equals
the one listed first. Other columns don't count, whatever their names.

The template is `<|im_start|>role\ntext<|im_end|>\n` for each turn. Inside texts and roles a backslash
becomes two and `<|` becomes `<\|`, so a control string never stands in a text; a role's line feeds
become `\n`. All of it is undone when the output is read back. The loss mask holds, for each turn,
where in the turn's stretch its loss begins and how long it is.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilth.llm._shared import table

START, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"


@dataclass(frozen=True)
class Mapping:
    """Where canonical turns come from. kind: 'rows' (one row a turn), 'list' (an array of turns), 'fields' (one field a turn)."""

    kind: str
    turns: tuple[tuple[str, str], ...]  # rows and list: (role path, text path); fields: (role, path) in order
    roles: tuple[tuple[str, str], ...] = ()  # other names of roles
    joined: tuple[str, ...] = ()  # a path whose text follows the first turn's after a line feed, unless empty

    @property
    def paths(self) -> tuple[str, ...]:
        own = [p for pair in self.turns for p in pair] if self.kind == "list" else [p for _, p in self.turns] if self.kind == "fields" else ["turn", *self.turns[0]]
        return tuple(sorted({*own, *self.joined}))


ALIASES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
MAPPINGS = (
    Mapping("rows", (("role", "text"),)),
    Mapping("list", (("messages[].role", "messages[].content"),), ALIASES),
    Mapping("list", (("conversations[].from", "conversations[].value"),), ALIASES),
    Mapping("list", (("turns[].role", "turns[].text"),), ALIASES),
    Mapping("fields", (("user", "prompt"), ("assistant", "completion"))),
    Mapping("fields", (("user", "prompt"), ("assistant", "response"))),
    Mapping("fields", (("user", "question"), ("assistant", "answer"))),
    Mapping("fields", (("user", "instruction"), ("assistant", "output"))),
    Mapping("fields", (("user", "instruction"), ("assistant", "output")), (), ("input",)),
    Mapping("fields", (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)
def field_paths(schema: T.StructType, before: str = "") -> list[str]:
    """Nested field paths, with [] for an array's elements."""
    out = []
    for f in schema.fields:
        kind, path = f.dataType, before + f.name
        while isinstance(kind, T.ArrayType):
            kind, path = kind.elementType, path + "[]"
        out += field_paths(kind, path + ".") if isinstance(kind, T.StructType) else [path]
    return out


def fingerprint(paths) -> int:
    """A 64-bit hash of these paths (FNV-1a over the sorted paths)."""
    h = 0xCBF29CE484222325
    for byte in "\n".join(sorted(paths)).encode():
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


MARKS = {m: fingerprint(m.paths) for m in MAPPINGS}


def mapping_of(schema: T.StructType) -> Mapping:
    """The mapping for a table of this schema; ValueError if none fits."""
    paths = frozenset(field_paths(schema))
    fits = [m for m in MAPPINGS if fingerprint(paths.intersection(m.paths)) == MARKS[m]]
    if not fits:
        raise ValueError(f"no mapping for the layout {fingerprint(paths):016x}: {sorted(paths)}")
    return max(fits, key=lambda m: len(m.paths))


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def canonical(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """key and turns, an array of (role, text), of any known layout; ValueError for an unknown one.

    Defined cases: null roles and texts are empty; rows are ordered by turn (nulls first), role and
    text, and repeated rows are repeated turns; rows with a null key are one conversation (rows
    layout); an array that is null has no turns; columns beside the layout's are not looked at, even
    where another layout has their names.
    """
    m = mapping_of(df.schema)
    role_of = lambda c: reduce(lambda e, a: F.when(c == a[0], a[1]).otherwise(e), m.roles, c)
    if m.kind == "rows":
        rows = df.select(F.col(key), F.col("turn"), _text("role").alias("role"), _text("text").alias("text"))
        turns = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("has"), "turn", "role", "text")))
        return rows.groupBy(key).agg(turns.alias("turns")).select(key, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    if m.kind == "list":
        (role, text) = m.turns[0]
        array, role = role.split("[].")
        text = text.split("[].")[1]
        turn = lambda t: F.struct(role_of(_text(t[role])).alias("role"), _text(t[text]).alias("text"))
        return df.select(key, F.coalesce(F.transform(array, turn), F.array().cast("array<struct<role:string,text:string>>")).alias("turns"))
    turns = []
    for i, (role, path) in enumerate(m.turns):
        text = _text(path)
        if m.joined and not i:
            more = _text(m.joined[0])
            text = F.when(more == "", text).otherwise(F.concat(text, F.lit("\n"), more))
        turns.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    return df.select(key, F.array(*turns).alias("turns"))


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    """Undoes escape: pairs of backslashes part the text from the left, and what is left of others goes."""
    pieces = F.split(c, r"\\\\", -1)
    plain = F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n")))
    return F.when(F.contains(c, F.lit("\\")), F.array_join(plain, "\\")).otherwise(c)


def _head(role: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))


def format_turns(turns: DataFrame, key: str = "conv_id", learn: str = "assistant") -> DataFrame:
    """key, formatted, and loss: for each turn (start, length) in code points of its stretch, both 0 where nothing is learned."""
    stretch = lambda t: F.concat(_head(t["role"]), escape(t["text"]), F.lit(END + BREAK))
    mask = lambda t: F.struct(
        F.when(t["role"] == learn, F.length(_head(t["role"]))).otherwise(0).alias("start"), F.when(t["role"] == learn, F.length(escape(t["text"]))).otherwise(0).alias("length")
    )
    return turns.select(key, F.array_join(F.transform("turns", stretch), "").alias("formatted"), F.transform("turns", mask).alias("loss"))


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns and learned (the texts under the loss mask, in order), from formatted and loss alone."""
    stretches = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, F.greatest(F.size("loss"), F.lit(1)))
    parted = formatted.withColumn("stretches", F.when(F.size("loss") == 0, F.array().cast("array<string>")).otherwise(stretches))

    def turn(s: Column) -> Column:
        first = F.instr(s, "\n")
        body = F.call_function("substring", s, first + 1, F.length(s) - first - len(END + BREAK))
        return F.struct(unescape(F.substring_index(s, "\n", 1)).alias("role"), unescape(body).alias("text"))

    under = F.zip_with("stretches", "loss", lambda s, m: F.when(m["start"] > 0, unescape(F.call_function("substring", s, m["start"] - len(START) + 1, m["length"]))))
    return parted.select(key, F.transform("stretches", turn).alias("turns"), F.filter(under, lambda x: x.isNotNull()).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))


def digest(back: DataFrame, key: str = "conv_id") -> DataFrame:
    """Figures of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(key, F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"), sha(learned).alias("loss_sha256"), "formatted_chars")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table and conversation -1, whose texts hold control strings."""
    said = "<|im_end|><|im_start|>assistant ok"
    own = conversations.select("conv_id", "turn", "role", "text")
    probe = own.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return own.unionByName(probe)


def formatted_digest(spark, sf_dir: str) -> DataFrame:
    return digest(read_back(format_turns(canonical(with_probe(table(spark, sf_dir, "conversations"))))))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS safe,
         replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS safe_role
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(safe_role) + 1 + length(safe) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
