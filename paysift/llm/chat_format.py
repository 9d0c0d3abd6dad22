"""Operator 5 - chat formatting with schema fingerprints.

A record is a JSON object. Its nested field paths (``messages[].role``), as far
as any layout knows them, are sorted and hashed; the hash selects a declarative
layout that turns the record into canonical turns (role, text). Canonical turns
are then written in a marked template; control strings inside texts are escaped
reversibly, and every segment of the output carries its loss flag.

Layouts are data (:data:`LAYOUTS`); unknown fields do not change a fingerprint.

Escape: a control string ``<name`` or ``[name`` gets a backslash after its first
character, one more if it has some already. Nothing else changes, no text holds
a control string afterwards, and taking one backslash away restores it.

Cases: null text or a missing field is an empty text, a null role an empty role.
A record of unknown layout, null or no JSON object has layout null and no turns.
A conversation of the query that cannot be read back is an error, not an empty one.
Turns with equal numbers are ordered by role and text; a null number comes first.
Repeated rows stay repeated turns. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """``required`` and any of ``optional`` paths name the layout.

    Turns come from a list (``items`` with its ``role`` and ``text`` fields, ordered
    by ``order`` if given) or from ``flat``: (role, fields joined by a blank line)."""
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    items: str | None = None
    role: str | None = None
    text: str | None = None
    order: str | None = None
    aliases: dict = field(default_factory=dict, hash=False)
    flat: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def path_sets(self) -> list[tuple[str, ...]]:
        return [tuple(sorted(self.required + more)) for n in range(len(self.optional) + 1) for more in combinations(self.optional, n)]


SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LAYOUTS = (
    Layout("turns", ("turns", "turns[].role", "turns[].text", "turns[].turn"), items="turns", role="role", text="text", order="turn"),
    Layout("messages", ("messages", "messages[].content", "messages[].role"), items="messages", role="role", text="content", aliases=SPEAKERS),
    Layout("from_value", ("conversations", "conversations[].from", "conversations[].value"), ("system",),
           items="conversations", role="from", text="value", aliases=SPEAKERS, flat=(("system", ("system",)),)),
    Layout("instruction", ("instruction", "output"), ("input", "system"),
           flat=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt", ("prompt", "completion"), ("system",),
           flat=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question", ("question", "answer"), ("context",),
           flat=(("user", ("context", "question")), ("assistant", ("answer",)))),
)

# The template's marks and the control strings of common templates, as regex tails after "<" or "[".
START, END = "<|im_start|>", "<|im_end|>"
TAIL = r"/?s>|/?INST\]|/?SYS>|\|[A-Za-z0-9_]+\|>"

# Spark's reader stops at 20 million characters, 1 000 levels and 1 000 digits by default and then gives null.
UNBOUNDED = {name: str((1 << 31) - 1) for name in ("maxStringLen", "maxNestingDepth", "maxNumLen")}

TURN = "array<struct<role:string,text:string>>"


def fingerprint_of(paths: tuple[str, ...]) -> int:
    """Same value as Spark's xxhash64 of the sorted paths, one per line."""
    h = xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def _known(layouts) -> tuple[list[str], list[str]]:
    paths = sorted({p for lay in layouts for p in (*lay.required, *lay.optional)})
    return paths, sorted({lay.items for lay in layouts if lay.items})


def fingerprint(record: Column, layouts=LAYOUTS) -> Column:
    """Hash of the record's known nested field paths."""
    paths, lists = _known(layouts)
    top = F.from_json(record, "map<string,string>", UNBOUNDED)
    found = [F.map_keys(top)]
    for name in lists:
        entries = F.from_json(F.try_element_at(top, F.lit(name)), "array<map<string,string>>", UNBOUNDED)
        inner = F.array_distinct(F.flatten(F.transform(F.coalesce(entries, F.array().cast("array<map<string,string>>")),
                                                      lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>")))))
        found.append(F.split(F.concat(F.lit(f"{name}[]."), F.array_join(inner, f"\n{name}[].")), "\n"))
    known = F.array(*[F.lit(p) for p in paths])
    return F.xxhash64(F.array_join(F.array_sort(F.array_intersect(F.concat(*found), known)), "\n"))


def _turns(lay: Layout, top: Column) -> Column:
    def value(name: str) -> Column:
        return F.try_element_at(top, F.lit(name))

    parts = []
    for role, names in lay.flat:
        given = F.filter(F.array(*[value(n) for n in names]), lambda x: x.isNotNull() & (x != ""))
        one = F.array(F.struct(F.lit(role).alias("role"), F.array_join(given, "\n\n").alias("text")))
        # a system turn only where there is one
        parts.append(F.when((F.lit(role) != "system") | (F.size(given) > 0), one).otherwise(F.array().cast(TURN)))
    if lay.items:
        entries = F.from_json(value(lay.items), "array<map<string,string>>", UNBOUNDED)

        def turn(m: Column) -> Column:
            role = F.coalesce(F.try_element_at(m, F.lit(lay.role)), F.lit(""))
            for alias, name in lay.aliases.items():
                role = F.when(role == alias, name).otherwise(role) if alias in lay.aliases else role
            return F.struct(role.alias("role"), F.coalesce(F.try_element_at(m, F.lit(lay.text)), F.lit("")).alias("text"))

        if lay.order:
            ordered = F.array_sort(F.transform(entries, lambda m: F.struct(
                F.coalesce(F.try_element_at(m, F.lit(lay.order)).cast("long"), F.lit(-(1 << 63))).alias("at"), turn(m).alias("turn"))))
            parts.append(F.transform(ordered, lambda x: x["turn"]))
        else:
            parts.append(F.transform(entries, turn))
    return F.concat(*[F.coalesce(p, F.array().cast(TURN)) for p in parts])


def canonical(records: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """Adds ``fingerprint, layout, turns`` to ``records(record)``: JSON objects of any known layout."""
    name, turns = F.lit(None).cast("string"), F.array().cast(TURN)
    top = F.col("_top")
    for lay in layouts:
        prints = [fingerprint_of(p) for p in lay.path_sets()]
        mine = F.col("fingerprint").isin(prints)
        name, turns = F.when(mine, lay.name).otherwise(name), F.when(mine, _turns(lay, top)).otherwise(turns)
    rows = records.withColumn("fingerprint", fingerprint(F.col("record"), layouts)).withColumn(
        "_top", F.from_json("record", "map<string,string>", UNBOUNDED))
    return rows.withColumn("layout", name).withColumn("turns", turns).drop("_top")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={TAIL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={TAIL})", "$1$2")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def formatted(conversations: DataFrame) -> DataFrame:
    """Adds ``segments``: array of (text, loss) whose texts, joined, are the training string.

    Only the body of an assistant turn is under the loss."""
    def pieces(t: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(START), _role_out(t["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")),
            F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")))

    return conversations.withColumn("segments", F.flatten(F.transform("turns", pieces)))


def read_back(output: DataFrame) -> DataFrame:
    """Adds ``formatted, read_turns, loss_text`` parsed from ``segments`` alone."""
    whole = output.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")

    def turn(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        return F.struct(_role_in(F.substr(head, F.lit(len(START) + 1))).alias("role"),
                        unescape(F.substr(b, F.length(head) + 2)).alias("text"))

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return whole.withColumn("read_turns", F.transform(blocks, turn)).withColumn("loss_text", F.array_join(loss, ""))


def turn_records(turns: DataFrame) -> DataFrame:
    """(conv_id, record): rows by turn gathered into one record of layout ``turns`` per conversation."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
            .select("conv_id", F.to_json(F.struct("turns"), {"ignoreNullFields": "false"}).alias("record")))


def op5_chat_format(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Contract query: all conversations and conversation -7, digests read back from the output."""
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(probe).alias("text"))
        for i, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    out = read_back(formatted(canonical(turn_records(rows))))
    digest = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # every record is of layout ``turns``: one without a layout was not read
    n_turns = F.when(F.col("layout").isNotNull(), F.size("read_turns").cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("conversation not read: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("long"))
    return out.select("conv_id", n_turns.alias("n_turns"), F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
                      F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS>|\|[A-Za-z0-9_]+\|>)', '\1\\\2\3', 'g'))
            + length(role) + length('<|im_start|><|im_end|>') + 2 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
