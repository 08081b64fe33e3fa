r"""Operator 4: chat formatting with typed content parts (native).

A message is an ordered list of typed parts: text, image, audio or document. The
visitor walks the parts in order and writes text parts escaped and every other part as
a placeholder; beside that it records, for each placeholder, its kind, its
reference, its order in the message and the tokens that it expands to (image tiles,
audio frames, document pages). Messages of one conversation are then joined in the
order of their turns: <|im_start|>role<|im_sep|>content<|im_end|>. The loss mask
covers the contents of the trained roles and nothing else.

Control strings inside a text or a role are broken by a backslash behind their first
character, adjacent text parts are kept apart by one, and backslashes are doubled, so that no
control string of the template can come from a text or from several, and every text can be read
back exactly.

Everything is a SQL expression over one row until the messages of a conversation
are numbered by a window and gathered, in one exchange; a formatted conversation is one string and
is held by one task. The time is linear in the turns: places are running sums, and what lies under the
mask is read from its own message.

Cases: a null text or role is empty; a null or empty list of parts is an empty text;
unknown part types become document placeholders; rows of an equal turn are ordered by role
and text; repeated rows are repeated turns; rows of a null conversation form
one; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound, table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# fixed values: control strings of common chat templates, broken wherever a text holds them
CONTROLS = [START, SEP, END, "<|image|>", "<|audio|>", "<|document|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TILE, TILE_TOKENS, FRAMES_A_SECOND, TOKENS_A_PAGE = 512, 256, 25, 1024
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"


def _tails() -> str:
    quoted = [c[1:] for c in CONTROLS]
    for special in "|[]":
        quoted = [q.replace(special, "\\" + special) for q in quoted]
    return "|".join(quoted)


ESCAPE = rf"([<\[])(?=(?:{_tails()}))"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, ESCAPE, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def text_part(text: Column) -> Column:
    """A list of parts that holds one text."""
    null = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(kind).alias(name) for name, kind in null.items())))


def _placeholder(part: Column) -> Column:
    return F.when(part["type"] == "image", "<|image|>").when(part["type"] == "audio", "<|audio|>").otherwise("<|document|>")


def _tokens(part: Column) -> Column:
    whole = lambda x: F.ceil(F.coalesce(x, F.lit(0))).cast("long")
    return (
        F.when(part["type"] == "image", F.greatest(F.lit(1), whole(part["width"] / TILE) * whole(part["height"] / TILE)) * TILE_TOKENS)
        .when(part["type"] == "audio", F.greatest(F.lit(1), whole(part["seconds"] * FRAMES_A_SECOND)))
        .otherwise(F.greatest(F.lit(1), whole(part["pages"])) * TOKENS_A_PAGE)
        .cast("long")
    )


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def visit(parts: Column) -> Column:
    """struct(content, attachments): the flattened message."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    said = F.filter(parts, lambda p: ~_is_text(p) | (F.coalesce(p["text"], F.lit("")) != ""))

    def written(own: Column) -> Column:
        # what two texts would form together is broken; no control string holds a backslash
        ends = lambda n: F.get(own, n - 1)["text"].endswith("\\")
        apart = lambda p, n: F.when((n > 0) & _is_text(F.get(own, n - 1)) & ~ends(n) & ~p["text"].startswith("\\"), "\\").otherwise("")
        return F.transform(own, lambda p, n: F.when(_is_text(p), F.concat(apart(p, n), escape(p["text"]))).otherwise(_placeholder(p)))

    content = F.array_join(bound(said, written), "")
    attachments = F.transform(F.filter(parts, lambda p: ~_is_text(p)), lambda p, n: F.struct(n.alias("order"), p["type"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    return F.struct(content.alias("content"), attachments.alias("attachments"))


def _raw(parts: Column) -> Column:
    """The texts of a message as they are: they order messages of one turn and role."""
    return F.coalesce(F.array_join(F.transform(F.filter(parts, _is_text), lambda p: p["text"]), "", ""), F.lit(""))


def format_conversations(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: its id, formatted, loss_spans (start and length in code
    points; message and offset tell where in which message that is), attachments and
    attachment_tokens."""
    own = messages.select(F.col(conversation).alias("id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), visit(F.col(parts)).alias("v"), _raw(F.col(parts)).alias("raw"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    own = own.select("id", "turn", "role", "raw", "v.content", "v.attachments", F.char_length(head).alias("head"), F.concat(head, F.col("v.content"), F.lit(END)).alias("text"))
    order = Window.partitionBy("id").orderBy("turn", "role", "raw", "content", "attachments")
    before = F.coalesce(F.sum(F.char_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumns({"number": F.row_number().over(order) - 1, "start": (before + F.col("head")).cast("int"), "length": F.char_length("content")})
    gathered = own.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("number", "role", "start", "head", "length", "text", "attachments"))).alias("ms"))
    spans = F.transform(F.filter("ms", lambda m: m["role"].isin(*trained)), lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length"), m["number"].alias("message"), m["head"].alias("offset")))
    attachments = F.flatten(F.transform("ms", lambda m, n: F.transform(m["attachments"], lambda a: F.struct(n.alias("message"), a["order"].alias("order"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = gathered.select("id", F.array_join(F.transform("ms", lambda m: m["text"]), "").alias("formatted"), spans.alias("loss_spans"), attachments.alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"])).withColumnRenamed("id", conversation)


def read_back(formatted: Column) -> Column:
    """The turns, as an array of struct(role, content), that a formatted conversation holds."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>"), lambda b: b != "")
    halves = F.transform(blocks, lambda b: F.split(F.substring(b, F.lit(len(START) + 1), F.char_length(b)), r"<\|im_sep\|>"))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("content")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped; each span is cut from its own message."""
    blocks = F.split(formatted, r"<\|im_end\|>")
    cut = lambda own: F.transform(spans, lambda s: unescape(F.substring(F.get(own, s["message"]), s["offset"] + 1, s["length"])))
    return F.array_join(bound(blocks, cut), "")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    out = format_conversations(own.unionByName(extra).withColumn("parts", text_part(F.col("text"))))
    turns = read_back(F.col("formatted"))
    out = out.withColumn("turns", turns).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_SQL_CONTROLS = "|".join(c[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in CONTROLS)
_SQL_ESCAPED = rf"regexp_replace(replace({{}}, '\', '\\'), '([<\[])({_SQL_CONTROLS})', '\1\\\2', 'g')"

QUERIES = {"op4_chat_format": op4_chat_format}
ORACLES = {
    "op4_chat_format": f"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length({_SQL_ESCAPED.format("role")}) + length({_SQL_ESCAPED.format("text")}) + {len(START + SEP + END)} AS n FROM c),
l AS (SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, count(*) AS n_turns, sum(n) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns FROM e GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM l"""
}
