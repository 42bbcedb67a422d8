"""Chat formatting checked by a grammar round trip, in DataFrame functions only.

Text written for a model is a line of turns:

    [INST] user text [/INST]
    <s> assistant text </s>
    <<SYS>> system text <</SYS>>
    [ROLE hex-of-role] other text [/ROLE]
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# role -> what opens and closes its turn
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("[ROLE ", "] ", " [/ROLE]")
GRAMMAR = r"(?s)\[INST\] .*? \[/INST\]|<s> .*? </s>|<<SYS>> .*? <</SYS>>|\[ROLE [0-9A-F]*\] .*? \[/ROLE\]"


def _by_role(role: Column, values: dict[str, Column], other: Column) -> Column:
    out = other
    for name, value in values.items():
        out = F.when(role == name, value).otherwise(out)
    return out


def opening(role: Column) -> Column:
    other = F.concat(F.lit(OTHER[0]), F.hex(F.encode(role, "UTF-8")), F.lit(OTHER[1]))
    return _by_role(role, {k: F.lit(v[0]) for k, v in MARKS.items()}, other)


def closing(role: Column) -> Column:
    return _by_role(role, {k: F.lit(v[1]) for k, v in MARKS.items()}, F.lit(OTHER[2]))


def escape(text: Column) -> Column:
    r"""A backslash after every ``[``, ``<`` and ``\``, so no mark can appear."""
    return F.regexp_replace(text, r"([\[<\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<\\])\\", "$1")


def _role_of(piece: Column) -> Column:
    out = F.decode(F.unhex(F.regexp_extract(piece, r"^\[ROLE ([0-9A-F]*)\]", 1)), "UTF-8")
    for name, (start, _) in MARKS.items():
        out = F.when(piece.startswith(start), F.lit(name)).otherwise(out)
    return out


def pieces(formatted: Column) -> Column:
    """The turns of a formatted text, marks included."""
    return F.regexp_extract_all(formatted, F.lit(GRAMMAR), F.lit(0))


def _turn(piece: Column) -> Column:
    role = _role_of(piece)
    skip, tail = F.length(opening(role)), F.length(closing(role))
    return F.struct(role.alias("role"), unescape(F.substring(piece, skip + 1, F.length(piece) - skip - tail)).alias("text"))


def parse(formatted: Column) -> Column:
    """The deterministic parser: ``array<struct<role, text>>`` of a formatted text."""
    return F.transform(pieces(formatted), _turn)


def format_chats(turns: DataFrame) -> DataFrame:
    """One formatted text per conversation of ``turns(conv_id, turn, role, text, ...)``.

    -> ``conv_id, formatted, loss_spans`` (start and end code points of each assistant text in
    ``formatted``, as written there), ``escaped_turns``.

    Every turn is first written as it is and parsed again; a turn that does not come back
    identical is escaped. The whole text is then parsed once more and must give the source
    turns, or the job fails with the conversation's id. Turns are in order of turn (null
    first), role and text, so ties and repeated rows keep a defined place. A null role or
    text is empty; rows with a null conv_id are one conversation; extra columns are ignored.
    A conversation is one value by nature, so it must fit in one row.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain = F.concat(opening(F.col("role")), F.col("text"), closing(F.col("role")))
    rows = rows.withColumn("back", parse(plain))
    intact = F.col("back") == F.array(F.struct("role", "text"))
    written = F.when(intact, F.col("text")).otherwise(escape(F.col("text")))
    rows = rows.withColumn("body", written).withColumn("escaped", (~intact).cast("int"))
    rows = rows.withColumn("piece", F.concat(opening(F.col("role")), F.col("body"), closing(F.col("role"))))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece") + 1).over(before), F.lit(0)))
    start = F.col("at") + F.length(opening(F.col("role")))
    span = F.struct(start.alias("start"), (start + F.length("body")).alias("end"))
    packed = rows.select("conv_id", "escaped", F.struct("at", "role", "text", "piece", span.alias("span")).alias("t"))
    whole = packed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"), F.sum("escaped").alias("escaped_turns"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("ts", lambda t: t["piece"]), "\n"))
    source = F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    failed = F.raise_error(F.concat(F.lit("conversation does not come back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    checked = F.when(parse(F.col("formatted")) == source, F.col("formatted")).otherwise(failed.cast("string"))
    spans = F.transform(F.filter("ts", lambda t: t["role"] == "assistant"), lambda t: t["span"])
    return whole.select("conv_id", checked.alias("formatted"), spans.alias("loss_spans"), "escaped_turns")


def digests(chats: DataFrame) -> DataFrame:
    """What a reader recovers from ``format_chats``: turns, their digest and the text under the loss spans."""
    read = chats.select("conv_id", "formatted", "loss_spans", parse(F.col("formatted")).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
    return read.select("conv_id", "formatted", F.size("turns").cast("bigint").alias("n_turns"), lines.alias("lines"), loss.alias("loss")).select(
        "conv_id",
        "n_turns",
        F.sha2(F.encode("lines", "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked as (
  select *, case role when 'user' then '[INST] ' when 'assistant' then '<s> ' when 'system' then '<<SYS>> ' else '[ROLE ' || hex(encode(role)) || '] ' end as opens,
    case role when 'user' then ' [/INST]' when 'assistant' then ' </s>' when 'system' then ' <</SYS>>' else ' [/ROLE]' end as closes
  from turns
), written as (
  select *, case when instr(text || closes, closes) <> length(text) + 1 or regexp_replace(text, '([\[<\\])\\', '\1', 'g') <> text
    then regexp_replace(text, '([\[<\\])', '\1\\', 'g') else text end as body from marked
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(length(opens) + length(body) + length(closes) + 1) - 1)::bigint as formatted_chars
from written group by conv_id"""
