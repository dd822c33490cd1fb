"""Text functions: normal forms, scripts, widths, timecodes; the Unicode-exact ones as Arrow-backed functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Bounds of the quality cascade.
MAX_CHARS, LEAST_RATIO, MOST_RATIO = 4000, 0.5, 2.0
#: Code point ranges of scripts.
HAN, KANA = "\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff", "\\u3040-\\u30ff"


@F.pandas_udf(StringType())
def nfkc_fold(texts: pd.Series) -> pd.Series:
    """NFKC, trimmed, case folded."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).strip().casefold())


@F.pandas_udf(StringType())
def memory_key(texts: pd.Series) -> pd.Series:
    """The form under which a translation memory compares texts: NFKC, case folded, without punctuation, symbols and spaces."""

    def form(t: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if unicodedata.category(c)[0] not in "PSZC")

    return texts.map(lambda t: None if t is None else form(t))


#: Simplified characters and their traditional forms, and what a translation memory leaves out of its keys.
SIMPLIFIED, TRADITIONAL = "学会观经数开静禅语头话调务师处关习觉围产缘净无为进说佛门众戒乐现见实们这个时间问题应该还没发对来过", "學會觀經數開靜禪語頭話調務師處關習覺圍產緣淨無為進說佛門眾戒樂現見實們這個時間問題應該還沒發對來過"
LEFT_OUT = "[\\s\u3000-\u303f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65\u2000-\u206f!-/:-@\\[-`{-~]"


@F.pandas_udf(StringType())
def translation_key(texts: pd.Series) -> pd.Series:
    """The key of a translation memory: NFKC, without punctuation and spaces, case folded, simplified characters as traditional ones."""
    import re

    out, fold = re.compile(LEFT_OUT), str.maketrans(SIMPLIFIED, TRADITIONAL)
    return texts.map(lambda t: None if t is None else out.sub("", unicodedata.normalize("NFKC", t)).casefold().translate(fold))


#: Fixed value: how many of the characters above a glossary folds.
GLOSSARY_FOLDS = 20


class _Folds(dict):
    """Character -> folded character, filled as characters come: NFKC and case folded where that is one character, simplified as traditional."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        wide = unicodedata.normalize("NFKC", c)
        small = wide.casefold() if len(wide) == 1 else ""
        low = small if len(small) == 1 else c
        at = SIMPLIFIED.find(low, 0, GLOSSARY_FOLDS)
        self[code] = low if at < 0 else TRADITIONAL[at]
        return self[code]


@F.pandas_udf(StringType())
def match_fold(texts: pd.Series) -> pd.Series:
    """How a glossary compares texts: each character becomes one character, so places stay."""
    folds = _Folds()
    return texts.map(lambda t: None if t is None else t.translate(folds))


@F.pandas_udf(DoubleType())
def display_width(texts: pd.Series) -> pd.Series:
    """Wide and full-width characters count 1, others one half."""
    return texts.map(lambda t: None if t is None else sum(1.0 if unicodedata.east_asian_width(c) in "WF" else 0.5 for c in t))


def loose_key(text: Column) -> Column:
    """Lower case without punctuation and spaces, by built-in functions."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9\\u00c0-\\u024f]", "")


def scrub(text: Column, status: Column) -> tuple[Column, Column]:
    """A text without bytes that aren't UTF-8, and its status: degraded where some went."""
    odd = ~F.is_valid_utf8(text)
    return F.when(odd, F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))).otherwise(text), F.when(odd, "degraded").otherwise(status)


def plain_key(text: Column) -> Column:
    """Lower case (ß as ss) without punctuation, symbols, separators and control characters, for scripts of any kind."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[\p{P}\p{S}\p{Z}\p{C}]", "")


#: Marks of hits, and how those that a text holds itself are written meanwhile.
ESCAPE = "\ue012"
SIGNS = {ESCAPE: f"{ESCAPE}0", "\ue010": f"{ESCAPE}1", "\ue011": f"{ESCAPE}2"}
#: Fixed value: characters of a name that is masked, at least.
LEAST_NAME = 2
#: Patterns of personal data, in the order in which they are masked.
URL = r"(?i)\b(?:https?://|www\.)[^\s<>\"'，。、）)\]]+"
URL_SECRET = r"(?i)(?:[?&#;](?:[a-z_]*token|key|apikey|api_key|sig|signature|secret|password|pwd|auth|code|session|sid|x-amz-[a-z-]+)=)|//[^/@\s]+:[^/@\s]+@"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
TW_ID = r"(?<![A-Za-z0-9])[A-Z][1289]\d{8}(?![A-Za-z0-9])"
PHONE = (
    r"(?<![0-9A-Za-z+])(?:\+?886[\s\-]?\(?0?\)?9\d{2}[\s\-]?\d{3}[\s\-]?\d{3}|09\d{2}[\s\-]?\d{3}[\s\-]?\d{3}|\+?886[\s\-]?\(?0?\)?[2-8][\s\-]?\d{3,4}[\s\-]?\d{4}|\(?0[2-8]\)?[\s\-]?\d{3,4}[\s\-]?\d{4}"
    r"|\+?81[\s\-]?\(?0?\)?[1-9]\d{0,3}[\s\-]?\d{1,4}[\s\-]?\d{4}|0[5-9]0[\s\-]?\d{4}[\s\-]?\d{4}|0\d{1,4}[\s\-]\d{1,4}[\s\-]\d{4}|\+\d{1,3}[\s\-]?(?:\(?\d{1,4}\)?[\s\-]?){2,4}\d{2,4})(?![0-9A-Za-z])"
)


def redact(text: Column, names: list[str] | None = None, all_urls: bool = False) -> tuple[Column, dict[str, Column]]:
    """A text with URLs (that hold a secret, or all), mails, identity numbers, phone numbers of 8 digits or more and names masked, in that order, and how many of each there were.

    Each step marks its hits, and those that must stay are unmarked again, so one pass over the text does. A text
    without any of a step's signs skips it.
    """
    import re

    full = "".join(map(chr, range(0xFF01, 0xFF5F)))
    for sign, code in SIGNS.items():
        text_in = F.replace(text if sign == ESCAPE else text_in, F.lit(sign), F.lit(code))
    t, counts = F.translate(text_in, full + "\u3000", "".join(map(chr, range(0x21, 0x7F))) + " "), {}
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
    steps = [
        ("url", URL, F.contains(t, F.lit("://")) | F.contains(F.lower(t), F.lit("www.")), (lambda x: F.lit(True)) if all_urls else (lambda x: x.rlike(URL_SECRET))),
        ("email", EMAIL, F.contains(t, F.lit("@")), None), ("id", TW_ID, t.rlike("[A-Z][1289][0-9]"), None), ("phone", PHONE, t.rlike("[0-9]{2}"), lambda x: digits(x) >= 8),
    ]
    longest: dict[int, set[str]] = {}
    for name in map(str.strip, names or []):
        longest.setdefault(len(name), set()).add(name)
    known = [re.escape(name) for size in sorted(longest, reverse=True) if size >= LEAST_NAME for name in sorted(longest[size])]
    if known:
        steps.append(("name", "|".join(known), F.lit(True), None))
    for name, pattern, may, keep in steps:
        parts = F.split(F.when(may, F.regexp_replace(t, f"({pattern})", "\ue010$1\ue011")), "[\ue010\ue011]", -1)
        masked = F.transform(parts, lambda p, i: F.when(i % 2 == 0, p).otherwise(F.lit(f"[{name.upper()}]") if keep is None else F.when(keep(p), f"[{name.upper()}]").otherwise(p)))  # noqa: B023
        counts[name] = F.coalesce(F.size(F.filter(parts, lambda p, i: (i % 2 == 1) & (F.lit(True) if keep is None else keep(p)))), F.lit(0)).cast("long")  # noqa: B023
        t = F.coalesce(F.array_join(masked, ""), t)
    for sign, code in reversed(SIGNS.items()):  # the marks of a text itself, as they were
        t = F.replace(t, F.lit(code), F.lit(sign))
    return F.when(sum(counts.values()) > 0, t).otherwise(text), counts


def space_han(text: Column) -> Column:
    """A space around each Han or kana character, so that words and characters are tokens."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, f"([{HAN}{KANA}])", " $1 "), " +", " "))


def script_counts(text: Column) -> dict[str, Column]:
    return {"han": F.regexp_count(text, F.lit(f"[{HAN}]")), "kana": F.regexp_count(text, F.lit(f"[{KANA}]")), "latin": F.regexp_count(text, F.lit("[A-Za-z]"))}


def half_width(text: Column) -> Column:
    """Width where ASCII counts one half and all else 1."""
    return F.length(text) - F.length(F.regexp_replace(text, "[^\\x00-\\x7f]", "")) * 0.5


def timecode(ms: Column, comma: str = ",") -> Column:
    """HH:MM:SS,mmm of milliseconds from 0 to 48 hours."""
    t = F.greatest(F.lit(0), F.least(ms, F.lit(172_800_000))).cast("long")
    part = lambda x, n: F.lpad(F.floor(x).cast("string"), n, "0")
    return F.concat(part(t / 3_600_000, 2), F.lit(":"), part(t / 60_000 % 60, 2), F.lit(":"), part(t / 1000 % 60, 2), F.lit(comma), part(t % 1000, 3))


def timecode_ms(code: Column) -> Column:
    """Milliseconds of a timecode; null if it isn't one or a field is out of range."""
    pattern = r"^(\d{2,3}):([0-5]\d):([0-5]\d)[,.](\d{3})$"
    g = lambda i: F.regexp_extract(code, pattern, i).try_cast("long")
    return F.when(code.rlike(pattern), ((g(1) * 60 + g(2)) * 60 + g(3)) * 1000 + g(4))


def visible_text(html: Column) -> Column:
    """HTML without comments, scripts, styles and tags, the common entities decoded, spaces collapsed."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\n\r]+", " "))


def edit_rate(reference: Column, hypothesis: Column) -> Column:
    """Character error rate: edits by the reference's length without punctuation and spaces; null where that is empty."""
    r, h = loose_key(reference), loose_key(hypothesis)
    return F.when(F.length(r) > 0, F.levenshtein(r, h) / F.length(r))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds, or null."""
    return F.coalesce(*[F.when(c, name) for c, name in rules])
