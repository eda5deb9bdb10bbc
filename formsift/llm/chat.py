"""Chat formatting with Spark expressions only.

Template: a turn is START role MIDDLE text END; texts of adjacent rows of the
same role share one turn and are divided by NEXT. Inside roles and texts a
backslash is doubled and every control string, ours and those of common chat
templates, gets one after its first character, so that none is left; dropping
each backslash and keeping what follows it restores the text.

Rows are sorted by turn (nulls first), then role, then text; repeated rows
stay. Null text or role counts as empty. A null conv_id is one conversation. Texts
of any length are kept whole. An empty table gives an empty result; only the four
columns named are read, so others may have any names.
A conversation's rows meet in one task, as its text is one value; collecting
combines on the map side, so that task reads one row from each map task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formsift.llm.common import let

START, MIDDLE, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>\n"
#: What follows the first character of each control string.
CONTROL = r"\|im_start\|>|\|im_sep\|>|\|im_next\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>|\|system\|>|\|user\|>|\|assistant\|>"
TRAINED_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([<\[])(?={CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turns_of(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turns): the sorted turn structs of each conversation."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return df.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: tuple[str, ...] = TRAINED_ROLES) -> DataFrame:
    """conv_id, formatted, segments: array of (text, loss) whose texts joined are
    formatted. loss marks the texts of trained roles, nothing of the template."""
    last = F.size("turns") - 1

    def starts(turns: Column) -> Column:
        """Positions at which the role changes."""
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (turns[i]["role"] != turns[F.greatest(i - 1, F.lit(0))]["role"]))

    def merged(turns: Column, at: Column) -> Column:
        """One struct (role, texts) for each run of the same role."""
        stop = lambda k: F.coalesce(F.try_element_at(at, k + 2), F.size(turns))
        return F.transform(at, lambda i, k: F.struct(turns[i]["role"].alias("role"), F.slice(turns, i + 1, stop(k) - i)["text"].alias("texts")))

    def segments(run: Column) -> Column:
        piece = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
        texts = F.flatten(F.transform(run["texts"], lambda t, k: F.array(piece(F.when(k > 0, NEXT).otherwise(""), F.lit(False)), piece(escape(t), run["role"].isin(*trained)))))
        head = piece(F.concat(F.lit(START), escape(run["role"]), F.lit(MIDDLE)), F.lit(False))
        return F.concat(F.array(head), texts, F.array(piece(F.lit(END), F.lit(False))))

    chats = turns_of(df, conv, turn, role, text)
    runs = let(F.col("turns"), lambda turns: let(starts(turns), lambda at: merged(turns, at)))
    found = chats.select("conv_id", F.flatten(F.transform(runs, segments)).alias("segments"))
    # The empty dividers before first texts are left out.
    found = found.withColumn("segments", F.filter("segments", lambda s: s["loss"] | (s["text"] != "")))
    return found.select("conv_id", F.concat_ws("", F.col("segments")["text"]).alias("formatted"), "segments")


def parse_chat(formatted: Column) -> Column:
    """Array of (role, text), one for each original row, read from formatted text."""
    blocks = F.filter(F.split(formatted, END.replace("|", r"\|")), lambda b: b != "")

    def rows(block: Column) -> Column:
        parts = F.split(F.substr(block, F.lit(len(START) + 1)), MIDDLE.replace("|", r"\|"), 2)
        return let(parts, lambda p: F.transform(F.split(p[1], NEXT.replace("|", r"\|")), lambda t: F.struct(unescape(p[0]).alias("role"), unescape(t).alias("text"))))

    return F.flatten(F.transform(blocks, rows))


def trained_text(segments: Column) -> Column:
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])))


def chat_digests(conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -1, digests read back from the output."""
    spark = conversations.sparkSession
    both = F.lit("</s>[INST] ok [/INST]")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), both.alias("text"))
    chats = format_chats(conversations.select("conv_id", "turn", "role", "text").union(extra))
    back = chats.select("conv_id", "formatted", parse_chat(F.col("formatted")).alias("rows"), trained_text(F.col("segments")).alias("loss_text"))
    lines = F.concat_ws("", F.transform("rows", lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("rows").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before,
    regexp_replace(replace(text, '\', '\\'), '([<\[])(\|im_start\|>|\|im_sep\|>|\|im_next\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>|\|system\|>|\|user\|>|\|assistant\|>)', '\1\\\2', 'g') AS escaped
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(escaped) + CASE WHEN before IS NULL OR before <> role THEN 33 + length(role) ELSE 11 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
