"""Rules that a caption must meet, as expressions: validity of replies, Japanese typography, phrases, readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequences import match_ratio
from .text import display_width

#: Patterns and limits of valid replies.
HAN_RUN = r"[㐀-䶿一-鿿豈-﫿]+"
MARKUP = r"(?i)</?think\b|<\|[^|]{0,40}\|>|(?:^|\s)/(?:no_)?think\b"
PREAMBLE = r"(?i)(?:here(?:'|’)s the translation\b|here is the translation\b|the translation is\s*:|(?:^|\n)\s*(?:translation|english translation|output|explanation)\s*:)"
EXTRA_LINE = r"(?i)(?:^|\n)[ \t]*(?:note|explanation|ps|p\.s\.)\s*:"
REPLY_FIELDS = ("current", "translation", "en")
JAPANESE, KANA = r"[぀-ヿ一-鿿㐀-䶿ｦ-ﾟ]", r"[぀-ヿｦ-ﾟ]"
NOT_TEXT = r"[\s\u3000-〿＀-／：-＠\.,!?;:'\"()\[\]\-]"
KANA_FREE, COPY_RATIO = 8, 0.8
#: Typography of Japanese lines, and where phrases end.
CHINESE_GLYPHS, BRACKETS, LINE_WIDTH = "这们说为对汉语吗", "「」『』（）", 16
PHRASE_END, PHRASE_CHARS = "、。，．！？!?）」』】〉》", 12
SCRIPT = r"[ぁ-ゖゝ-ゟァ-ヺー-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ｯｱ-ﾝ]"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"^[\s\u3000\u00a0\x85]+|[\s\u3000\u00a0\x85]+\z", "")


def bare(text: Column) -> Column:
    """Without spaces and marks."""
    return F.regexp_replace(text, NOT_TEXT, "")


def plain_english(text: Column, allowed: Column | None = None) -> Column:
    """Whether a text is one English caption: no control characters but line feeds, no Han but runs inside a string of ``allowed``, no markup, preface, note, second paragraph, quotes around it, fence or bracket before it."""
    t = F.regexp_replace(strip(text), r"\r\n?", "\n")
    runs = F.regexp_extract_all(t, F.lit(f"({HAN_RUN})"))
    han = F.size(runs) == 0 if allowed is None else F.forall(runs, lambda r: F.exists(allowed, lambda a: F.contains(a, r)))
    quoted = t.rlike("(?s)^([\"'`]).*\\1\\z") & (F.length(t) >= 2)
    bad = t.rlike(r"[\p{C}\p{Zl}\p{Zp}&&[^\n]]") | t.rlike(MARKUP) | t.contains("\n\n") | t.rlike(PREAMBLE) | t.rlike(EXTRA_LINE) | quoted | t.rlike(r"^[{\[]|^```")
    return F.coalesce((t != "") & han & ~bad, F.lit(False))


def reply_text(reply: Column) -> Column:
    """A reply, or the first non-empty string among the named fields of a reply that is a JSON object; null for other JSON."""
    t = strip(reply)
    v = F.try_parse_json(t)
    kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    fields = [F.when((kind(f) == "STRING") & (F.trim(F.try_variant_get(v, f"$.{f}", "string")) != ""), F.trim(F.try_variant_get(v, f"$.{f}", "string"))) for f in REPLY_FIELDS]
    return F.when(t.startswith("["), F.lit(None)).when(t.startswith("{"), F.coalesce(*fields)).otherwise(t)


def english_reply(reply: Column, source: Column, allowed: Column | None = None) -> Column:
    """The caption that a reply holds, or null where it holds none; eight characters for each of the source, 400 to 600, are allowed."""
    t = reply_text(reply)
    most = F.least(F.lit(600), F.greatest(F.lit(400), 8 * F.coalesce(F.length(source), F.lit(0))))
    return F.when((F.length(F.trim(reply)) <= most) & (F.length(t) <= most) & plain_english(t, allowed), t)


def japanese_reply(reply: Column, source: Column) -> Column:
    """A Japanese caption, or null: one line in Japanese script, no copy of the Chinese source, and kana unless it is short."""
    t, b, z = strip(reply), bare(strip(reply)), bare(F.coalesce(source, F.lit("")))
    copied = (b != "") & (z != "") & ((b == z) | (~b.rlike(KANA) & (match_ratio(b, z) >= COPY_RATIO)))
    fits = F.length(t) <= F.greatest(F.lit(200), 4 * F.coalesce(F.length(source), F.lit(0)))
    bad = t.rlike(MARKUP) | t.rlike(r"[\x00-\x1f\x7f\u2028\u2029]") | copied | (~b.rlike(KANA) & (F.length(b) > KANA_FREE)) | t.rlike(r"^[{\[]|^```")
    return F.when(fits & t.rlike(JAPANESE) & ~bad, t)


def typography(text: Column) -> dict[str, Column]:
    """How often a line breaks each rule; of ``{text|reading}`` only the text is judged. Marks inside Latin words, numbers and abbreviations are fine."""
    t = F.regexp_replace(text, r"\{([^{}|]+)\|[^{}|]+\}", "$1")
    # the last stop of an abbreviation goes, the inner ones stand inside a word
    latin = F.regexp_replace(F.regexp_replace(t, r"((?:[A-Za-z]\.)+[A-Za-z])\.", "$1"), r"[A-Za-z0-9]+(?:[,.?!:;][A-Za-z0-9]+)*", "")
    open_close = {BRACKETS[i]: BRACKETS[i + 1] for i in range(0, len(BRACKETS), 2)}
    zero = F.struct(F.lit("").alias("open"), F.lit(0).alias("bad"))

    def step(s: Column, c: Column) -> Column:
        top = F.right(s["open"], F.lit(1))
        opens, closes = c.isin(*open_close), c.isin(*open_close.values())
        pairs = closes & (F.translate(top, "".join(open_close), "".join(open_close.values())) == c)
        left = F.when(opens, F.concat(s["open"], c)).when(pairs, F.left(s["open"], F.length(s["open"]) - 1)).otherwise(s["open"])
        return F.struct(left.alias("open"), (s["bad"] + F.when(closes & ~pairs, 1).otherwise(0)).alias("bad"))

    marks = F.regexp_extract_all(t, F.lit(f"([{BRACKETS}])"))
    balance = F.aggregate(marks, zero, step)
    count = lambda pattern, s=t: F.regexp_count(s, F.lit(pattern))
    return {
        "ascii_punctuation": F.when(t.rlike(SCRIPT), count("[,.?!:;]", latin)).otherwise(0),
        "unbalanced_brackets": balance["bad"] + F.length(balance["open"]),
        "chinese_residue": count(f"[{CHINESE_GLYPHS}]") + count(f"(?<={SCRIPT})，(?={SCRIPT})"),
        "doubled_punctuation": count("。(?=。)|、(?=、)"),
        "kinsoku_line_start": F.regexp_replace(t, r"^\s+", "").rlike("^[、。]").cast("int"),
        "line_too_long": (display_width(t) > LINE_WIDTH).cast("int"),
    }


def phrases(text: Column) -> Column:
    """A text cut after each closing mark, and after twelve characters without one; the phrases joined are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)([^{PHRASE_END}]{{0,{PHRASE_CHARS - 1}}}[{PHRASE_END}]|[^{PHRASE_END}]{{1,{PHRASE_CHARS}}})"))


def readings_in(text: Column, terms: Column) -> Column:
    """Of ``terms`` (array of text, reading) those that a text holds and that have a reading, each text once, in the order given."""
    held = F.filter(terms, lambda x: (F.trim(x["text"]) != "") & (F.trim(x["reading"]) != "") & F.contains(text, F.trim(x["text"])))
    return F.filter(held, lambda x, i: F.array_position(F.transform(held, lambda y: F.trim(y["text"])), F.trim(x["text"])) == i + 1)
