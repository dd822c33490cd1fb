"""Functions of one text or array for which Spark has no built-in: ratio, line breaking, rewriting, folds."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * matches / length of both, by longest matching blocks; null where a side is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


#: Common words within which no alias is replaced.
GUARDS = ("開始", "法式", "師傅", "社科", "只觀", "工案", "開事", "一座", "產修", "建設", "建設課程", "開設", "開設課程", "天空", "學會")


def _scanner(aliases: dict[str, str], guards: tuple[str, ...]):
    """Two functions of a text: to the text after one pass, and to the canonical forms of aliases that stay because they overlap a guard word, each once.

    Both are one pattern, so no code runs for a character that begins no word: at a place the longest word that is free, and where none is, one character with the longest word looked ahead at.
    """
    import re

    def rest(word: str) -> str | None:
        """The pattern of a word after its first character; none where a guard is always over it."""
        unless = set()
        for g in set(guards) if word in aliases else ():
            for o in range(1 - len(g), len(word) if g else 0):  # where the guard begins, counted from the word
                if word[max(o, 0) : o + len(g)] == g[max(-o, 0) : len(word) - o]:
                    before, after = re.escape(g[: max(-o, 0)] + word) if o < 0 else "", re.escape(g[len(word) - o :])
                    if not before and not after:
                        return None
                    unless.add(f"(?!(?<={before}){after})" if before and after else f"(?<!{before})" if before else f"(?!{after})")
        return re.escape(word[1:]) + "".join(sorted(unless))

    by_first: dict[str, list[str]] = {}
    for word in sorted({*aliases, *aliases.values()} - {""}, key=lambda w: (-len(w), w)):
        by_first.setdefault(word[0], []).append(word)
    free = {c: [r for r in map(rest, words) if r is not None] for c, words in by_first.items()}
    stays = {c: f"(?=({'|'.join(re.escape(w[1:]) for w in words)}))" for c, words in by_first.items()}
    one_of = lambda of: re.compile("|".join(f"{re.escape(c)}(?:{'|'.join(x)})" for c, x in of.items() if x) or "(?!)")
    changes, all_places = one_of(free), one_of({c: [*x, stays[c]] for c, x in free.items()})

    def once(text: str) -> str:
        return changes.sub(lambda m: aliases.get(m[0], m[0]), text)

    def told(text: str) -> list[str]:
        return list(dict.fromkeys(aliases[m[0] + m[m.lastindex]] for m in all_places.finditer(text) if m.lastindex))

    return once, told


def rewrite(aliases: dict[str, str], passes: int = 8, guards: tuple[str, ...] = GUARDS):
    """A function that replaces aliases by canonical forms, from left to right and the longest first, until nothing changes; a cycle leaves the text as it was.

    Canonical forms in the text are protected, and an alias that overlaps a guard word stays (a shorter one at its place may do).
    """
    once, _ = _scanner(aliases, guards)

    def one(text: str) -> str:
        seen, now = {text}, text
        for _ in range(passes):
            new = once(now)
            if new == now:
                return now
            if new in seen:
                return text
            seen.add(new)
            now = new
        return now if once(now) == now else text

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else one(t))

    return run


def guarded(aliases: dict[str, str], guards: tuple[str, ...] = GUARDS):
    """A function to the canonical forms whose aliases a text holds, but which rewrite() leaves since they overlap a guard word: in order, each once; of several at a place the longest alias's."""
    _, told = _scanner(aliases, guards)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else told(t))

    return run


#: Characters that may not begin or end a line; particles after which a line ends well, verb endings and number units that stay whole, and how much narrower a line that ends well may be.
NOT_FIRST = "、。，．・？！ゝゞー」』）】ぁぃぅぇぉっゃゅょゎゕゖァィゥェォッャュョヮヵヶ〃々〻ヽヾｧｨｩｪｫｬｭｮｯｰ" + "".join(map(chr, range(0x31F0, 0x3200)))
NOT_LAST = "「『（【〈《〔〖〘〚"
PAUSE_MARKS, PARTICLES, NO_PARTICLE = "、。", ("から", "まで", "は", "が", "を", "に", "で", "と", "も", "へ"), ("で", "す")
ENDINGS = ("ませんでした", "でしょう", "ました", "ません", "です", "ます")
UNITS = (
    "キログラム", "キロメートル", "センチメートル", "ミリメートル", "グラム", "リットル", "分間", "秒間", "週間", "ヶ月", "か月", "時間", "キロ", "メートル", "センチ", "ミリ", "ドル",
    "kg", "mg", "km", "cm", "mm", "ml", "L", "％", "%", "℃", "°C", "°", "年", "月", "日", "時", "分", "秒", "個", "本", "枚", "人", "円", "回", "歳", "階", "台",
)
NARROWER = 2.0


def break_lines(width: float, lines: int = 2):
    """A function that breaks a text into lines of a display width (wide 1, narrow 1/2; readings in {base|reading} take none) and keeps the newest.

    Words of katakana, Latin letters, numbers with their units, verb endings and readings stay whole. A line doesn't begin or end with a forbidden
    character; of the ends that fit, the last one after a pause or particle is taken if it isn't much narrower than the widest, else the widest;
    where none fits, the first that is allowed.
    """
    import bisect
    import unicodedata

    import regex

    longest = lambda words: "|".join(regex.escape(w) for w in sorted(words, key=len, reverse=True))
    number = rf"\d+(?:[.,:：．，/／\-−]\d+)*(?:{longest(UNITS)})?"

    def span(text: str) -> float:
        shown = regex.sub(r"\{([^{}|]+)\|[^{}|]+\}", r"\1", text)
        return sum(1.0 if unicodedata.east_asian_width(c) in "WF" else 0.5 for c in shown)

    whole = [e for e in ENDINGS if span(e) <= width]
    token = regex.compile(rf"(?s)\{{[^{{}}|]+\|[^{{}}|]+\}}|{longest(whole) or '(?!)'}|{number}|[\u30a0-\u30ff\u31f0-\u31ff\uff66-\uff9f]+|\p{{Latin}}+|.")
    well = regex.compile(f"(?:[{PAUSE_MARKS}]|{longest(PARTICLES)})$")

    def one(text: str) -> list[str]:
        ends = [m.end() for m in token.finditer(text)]
        widths, total = [], 0.0
        for a, b in zip([0, *ends], ends, strict=False):
            total += span(text[a:b])
            widths.append(total)
        follow = [text[e : e + 1] for e in ends]
        # ends at which a line may stop, and those of them at which it stops well
        legal = [i for i, e in enumerate(ends) if text[e - 1] not in NOT_LAST and (not follow[i] or follow[i] not in NOT_FIRST)]
        if ends and (not legal or legal[-1] != len(ends) - 1):
            legal.append(len(ends) - 1)
        out, start, used, k = [], 0, 0.0, 0
        while start < len(text):
            fit = bisect.bisect_right(legal, used + width, lo=k, key=lambda i: widths[i])
            chosen = max(fit - 1, k)
            widest = widths[legal[chosen]] - used
            for j in range(chosen, k - 1, -1) if fit > k else ():
                i = legal[j]
                if widths[i] - used < widest - NARROWER:
                    break
                line = text[start : ends[i]]
                if well.search(line) and not (line.endswith(NO_PARTICLE[0]) and follow[i] == NO_PARTICLE[1]):
                    chosen = j
                    break
            i = legal[chosen]
            out.append(text[start : ends[i]])
            start, used, k = ends[i], widths[i], chosen + 1
        return out[-lines:]

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else one(t))

    return run


def longest_first(text: Column, terms: list[str], most: int = 8):
    """Non-overlapping terms of a text, longest first, then leftmost, at most ``most``."""
    ordered = sorted(terms, key=lambda t: (-len(t), t))

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def pick(t: str) -> list[str]:
            taken: list[tuple[int, int, str]] = []
            for term in ordered:
                at = t.find(term)
                while at >= 0 and len(taken) < most:
                    if all(at >= e or at + len(term) <= s for s, e, _ in taken):
                        taken.append((at, at + len(term), term))
                    at = t.find(term, at + 1)
            return [x for _, _, x in taken]

        return texts.map(lambda t: None if t is None else pick(t))

    return run(text)


def has_loop(text: Column, least: int = 3, share: float = 0.4) -> Column:
    """Whether a unit of 1 to 12 characters is repeated ``least`` times or more in a row and the run makes up that share of the text without white space, six characters at least. All runs of each unit length are looked at."""
    t = F.regexp_replace(text, r"\s", "")
    runs = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(rf"(?s)((.{{{n}}})\2{{{least - 1},}})"), F.lit(1)) for n in range(1, 13)]))
    longest = F.aggregate(runs, F.lit(0), lambda a, x: F.greatest(a, F.length(x)))
    return F.coalesce(longest >= F.greatest(F.lit(6.0), share * F.length(t)), F.lit(False))


#: How fast a noise floor falls and rises, its least value, and from which level on a frame is speech.
FALL, RISE, LEAST_FLOOR, SPEECH_FLOOR, SPEECH_RATIO = (0.7, 0.3), (0.995, 0.005), 1e-4, 0.008, 3.0


def smoothed_floor(levels: Column, speech_floor: float = SPEECH_FLOOR, ratio: float = SPEECH_RATIO) -> Column:
    """A noise floor that follows an array of levels: fast down, slowly up, and not up where the level is speech, at ``ratio`` times the floor and ``speech_floor`` or more."""

    def step(f: Column, x: Column) -> Column:
        speech = x >= F.greatest(F.lit(speech_floor), f * ratio)
        return F.greatest(F.when(x < f, FALL[0] * f + FALL[1] * x).when(speech, f).otherwise(RISE[0] * f + RISE[1] * x), F.lit(LEAST_FLOOR))

    return F.aggregate(levels, F.lit(speech_floor), step)
