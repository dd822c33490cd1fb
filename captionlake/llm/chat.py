"""Chat formatting with typed content parts (DataFrame functions only).

A turn is an ordered array of typed parts (text, image, audio, document). A visitor flattens the parts into
one string in which every attachment is a placeholder, and records the attachments and the number of tokens
into which the placeholders expand. Control strings in texts are escaped reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: Placeholder of each kind of attachment, and the tokens into which it expands where the part gives none.
PLACEHOLDERS = {"image": ("<|image|>", 256), "audio": ("<|audio|>", 128), "document": ("<|document|>", 512)}
#: What follows the first character of a control string.
AFTER_ANGLE = r"<(/?s>|</?SYS>>|\|[a-z]+\|>)"
AFTER_BRACKET = r"\[(/?INST\])"

PART = "struct<kind:string,text:string,ref:string,tokens:int>"


def text_part(text: Column) -> Column:
    """A turn of one text part; a null text is an empty one."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("tokens")))


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\\``; the first character of a control string becomes ``\l`` (<) or ``\b`` ([)."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, AFTER_ANGLE, r"\\l$1")
    return F.regexp_replace(text, AFTER_BRACKET, r"\\b$1")


def unescape(text: Column) -> Column:
    """Every backslash begins an escape, so pairs of backslashes are found from the left, and what is left between them holds single escapes."""
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def _visit(part: Column) -> Column:
    """The string of one part; a part of an unknown kind is its text."""
    out = escape(F.coalesce(part["text"], F.lit("")))
    for kind, (mark, _) in PLACEHOLDERS.items():
        out = F.when(part["kind"] == kind, F.lit(mark)).otherwise(out)
    return out


def _tokens(part: Column) -> Column:
    default = F.lit(None).cast("int")
    for kind, (_, n) in PLACEHOLDERS.items():
        default = F.when(part["kind"] == kind, F.lit(n)).otherwise(default)
    return F.coalesce(part["tokens"], default)


def format_chat(turns: DataFrame) -> DataFrame:
    """Format conversations. ``turns``: conv_id, turn, role and parts (an array of PART).

    Returns a row for each conv_id: formatted; loss_spans, the [start, length) in code points of each
    assistant turn's content in formatted; attachments (turn number, kind, ref, tokens) in order of their
    placeholders; expanded_tokens, the tokens that stand for attachments.

    Rows are ordered by turn, nulls first, then role and content, so repeated and tied rows have one order
    and all stay. A null role is empty; null parts or a null text are empty text; rows whose conv_id is null
    are one conversation. A conversation is one record of the output and so one group, gathered with a sort
    that spills; its length is bounded by what a string holds (2 GB). Other columns are not read.
    """
    role = F.replace(escape(F.coalesce(F.col("role"), F.lit(""))), F.lit("\n"), F.lit("\\n"))
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    attached = F.filter(parts, lambda p: p["kind"].isin(*PLACEHOLDERS))
    flat = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), F.array_join(F.transform(parts, _visit), "").alias("body"),
        F.transform(attached, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))).alias("atts"),
    )
    gathered = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("has"), "turn", "role", "body", "atts"))).alias("t"))
    pieces = gathered.select(
        "conv_id", "t", F.transform("t", lambda x: F.concat(F.lit(TURN), x["role"], F.lit("\n"), x["body"], F.lit(END))).alias("pieces")
    )
    # a running end for every piece; the mask covers the body of assistant turns
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        head = F.length(x["role"]) + len(TURN) + 1
        body = F.length(x["body"])
        span = F.array(F.struct((acc["at"] + head).cast("long").alias("start"), body.cast("long").alias("length")))
        return F.struct((acc["at"] + head + body + len(END)).cast("long").alias("at"), F.when(x["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    numbered = F.flatten(F.transform("t", lambda x, i: F.transform(x["atts"], lambda a: F.struct(i.alias("turn_no"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return pieces.select(
        "conv_id", F.array_join("pieces", "").alias("formatted"), F.aggregate("t", zero, step)["spans"].alias("loss_spans"), numbered.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse what format_chat() made: turns (role, text), loss_texts, the unescaped text under the mask, and placeholders (turn number, kind), those of the attachments in their order; escaped ones of texts are none."""
    chunks = F.slice(F.split("formatted", r"<\|turn\|>", -1), 2, 2_000_000_000)
    cut = lambda c: F.substr(c, F.lit(1), F.length(c) - len(END))

    def parsed(chunk: Column) -> Column:
        whole = cut(chunk)
        at = F.instr(whole, "\n")
        return F.struct(unescape(F.substr(whole, F.lit(1), at - 1)).alias("role"), unescape(F.substr(whole, at + 1)).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    kinds = lambda c, i: F.transform(F.regexp_extract_all(c, F.lit(r"<\|(" + "|".join(PLACEHOLDERS) + r")\|>"), F.lit(1)), lambda k: F.struct(i.alias("turn_no"), k.alias("kind")))
    return formatted.withColumns({"turns": F.transform(chunks, parsed), "loss_texts": masked, "placeholders": F.flatten(F.transform(chunks, kinds))})
