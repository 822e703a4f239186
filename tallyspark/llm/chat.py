"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation becomes segments of text, each with a flag that says whether it counts in the loss, and the formatted
text is their concatenation. Control strings inside turns are escaped, so the formatted text can be split into the
turns it was made from, whatever they say.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import let


@dataclass(frozen=True)
class Template:
    """Marks of a turn: before + role + between + text + after, repeated.

    guards: pairs of characters that every mark starts with or holds and that no escaped text holds, as the escape
    is put between them. A backslash is itself doubled, so a text is read back by dropping one backslash of each
    escape. loss: roles whose texts count in the loss.
    """

    before: str = "### "
    between: str = ": "
    after: str = "</turn>\n"
    guards: tuple[str, ...] = ("##", "</", ": ")
    loss: tuple[str, ...] = ("assistant",)
    #: state and role: next state. A conversation is valid if no step is missing and it ends in one of accepting.
    steps: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accepting: tuple[str, ...] = ("answered",)


def escaped(text: Column, template: Template) -> Column:
    out = F.regexp_replace(text, r"\\", r"\\\\")
    for first, second in template.guards:
        out = F.regexp_replace(out, f"\\Q{first}\\E(?=\\Q{second}\\E)", f"{first}\\\\")
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, template: Template = Template(), conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """conv_id, n_turns, segments (array of text, loss), formatted, state, valid: one row per conversation.

    Turns go in the order of turn (null first), then role and text, which settles ties; repeated rows are repeated
    turns. Null roles and texts count as empty. Conversations out of order are formatted too, with valid false and
    state naming where the machine stopped. A turn without conv_id belongs to no other and is a conversation by itself,
    so turns without one never meet. A conversation's turns meet in one row because its formatted text is one value;
    texts of any length are formatted whole. An empty table gives an empty one; other columns are not read.
    """
    given = turns.select(
        F.col(conv).alias("conv_id"),
        F.when(F.col(conv).isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    grouped = given.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    steps = F.create_map(*[F.lit(x) for (state, said), to in template.steps.items() for x in (f"{state}|{said}", to)])
    mark = lambda s: F.struct(s.alias("text"), F.lit(False).alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                mark(F.concat(F.lit(template.before), escaped(t["role"], template), F.lit(template.between))),
                F.struct(escaped(t["text"], template).alias("text"), t["role"].isin(list(template.loss)).alias("loss")),
                mark(F.lit(template.after)),
            ),
        )
    )
    state = F.aggregate("turns", F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(steps, F.concat_ws("|", s, t["role"])), F.lit("refused")))
    out = grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"), state.alias("state"))
    return out.select(
        "*", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.col("state").isin(list(template.accepting)).alias("valid")
    )


def parsed(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted text holds, read from its marks alone."""
    pieces = F.filter(F.split(formatted, f"\\Q{template.after}\\E", -1), lambda p: p != "")
    inner = lambda p: F.substring(p, len(template.before) + 1, F.length(p))
    at = lambda p: F.instr(p, template.between)
    return F.transform(
        pieces,
        lambda p: let(
            inner(p),
            lambda x: F.struct(
                unescaped(F.substring(x, F.lit(1), at(x) - 1)).alias("role"), unescaped(F.substring(x, at(x) + len(template.between), F.length(x))).alias("text")
            ),
        ),
    )


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What the formatted output says about itself: its turns and the text under the loss mask, read back."""
    under_loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    read = formatted.select("conv_id", "valid", "state", "formatted", parsed(F.col("formatted"), template).alias("turns"), under_loss.alias("loss_text"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "state",
    )


#: The conversation that every run adds: its texts hold the template's own marks and escapes.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text")
    )
    return digests(format_conversations(turns.unionByName(probe)))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, replace(regexp_replace(regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'), '</', '<\\/', 'g'), ': ', ':\\ ', 'g'), '', '') AS e FROM turns
), lengths AS (
  -- between each two neighbouring # goes one escape: as many as a run of # is long, less one
  SELECT *, 4 + length(role) + 2 + length(e) + length(regexp_replace(e, '[^#]', '', 'g'))
         - length(regexp_replace(regexp_replace(e, '#+', '#', 'g'), '[^#]', '', 'g')) + 8 AS n
  FROM marked
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(n) AS n,
         string_agg(role, '>' ORDER BY turn, role, text) AS roles
  FROM lengths GROUP BY conv_id, alone
), walked AS (
  SELECT *, CASE WHEN NOT regexp_full_match(roles, '(system|system>user(>assistant>user)*(>assistant)?|user(>assistant>user)*(>assistant)?)') THEN 'refused'
                 WHEN roles LIKE '%assistant' THEN 'answered' WHEN roles LIKE '%user' THEN 'asked' ELSE 'told' END AS state
  FROM whole
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       n::BIGINT AS formatted_chars, state = 'answered' AS valid, state
FROM walked
"""
