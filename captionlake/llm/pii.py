"""Surrogates for personal data (DataFrame functions only).

One regular expression finds the mentions and tells their types; names need a title at one place of a text, and
then are found at the others without one. Every distinct entity gets a keyed surrogate of the same type, script,
gender and format; names are one kind, so a name has one surrogate after any title and as a given or family name; surrogates that meet each other or a real entity are drawn again,
so distinct entities stay distinct and mentions of one entity keep one surrogate over the whole corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

_WORD = r"[\p{L}\p{N}]"
_NAME = r"\p{Lu}[\p{L}'’\-]+"
_TITLES = {
    "M": r"(?:Mr|Herr|Herrn|Señor|Sr|Monsieur|Don|г-н|господин)",
    "F": r"(?:Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Doña|г-жа|госпожа)",
    "N": r"(?:Dr|Prof|Dra)",
}
_KEYWORDS = ["password", "passwd", "secret", "token", "api_key", "apikey", "access_key"]
#: Type -> pattern, in order of precedence where several match at one place. Groups in patterns don't capture.
PATTERNS = {
    "EMAIL": rf"(?<![\p{{L}}\p{{N}}._%+\-])[\p{{L}}\p{{N}}._%+\-]{{1,64}}@[A-Za-z0-9\-]{{1,63}}(?:\.[A-Za-z0-9\-]{{1,63}}){{0,8}}\.[A-Za-z]{{2,24}}(?!{_WORD})",
    "KEY": rf"(?<!{_WORD})AKIA[0-9A-Z]{{16}}(?!{_WORD})",
    "SECRET": rf"""(?<=[=:\s"'])(?<![A-Za-z0-9+/_\-])(?=(?:\.*+[A-Za-z0-9+/_=\-]){{8}})(?<=(?i:{'|'.join(_KEYWORDS)})["']?\s{{0,2}}[=:]\s{{0,2}}["']?)(?:\.*+[A-Za-z0-9+/_=\-]++)++""",
    "IBAN": rf"(?<!{_WORD})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?!{_WORD})",
    "IP": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?\w)",
    "SSN": r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])",
    "CARD": r"(?<!\w)(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?!\w)",
    "PHONE": r"(?<!\w)(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[ .\-]?[0-9]{2,4}){2,4}|\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4})(?!\w)",
    **{f"GIVEN_{g}": rf"(?=\p{{Lu}})(?<=(?<!\p{{L}}){t}\.? ){_NAME}(?= \p{{Lu}}\p{{Ll}})" for g, t in _TITLES.items()},
    "SURNAME": rf"(?=\p{{Lu}})(?<=(?<!\p{{L}})(?:{'|'.join(_TITLES.values())})\.? (?:\p{{Lu}}[\p{{L}}'’\-]{{1,30}} )?){_NAME}",
    "HAN_NAME": r"\p{IsHan}{2,3}(?=先生|女士|小姐)",
}
#: NAME is a name without a title, in a text that has it with one. Patterns of names come last.
TYPES = [*PATTERNS, "NAME"]
N_NAMES = 5
#: Texts without any of these and of the keywords in any case have no mention; looking for strings is much cheaper than the patterns.
_WORDS = "Mr Herr Herrn Señor Sr Monsieur Don г-н господин Mrs Ms Miss Frau Señora Sra Madame Mme Doña г-жа госпожа Dr Prof Dra"
HINTS = [*"0123456789@", "AKIA", "先生", "女士", "小姐", *[w + end for w in _WORDS.split() for end in (" ", ". ")]]
OPEN, CLOSE, SEP, ESC = "\ue000", "\ue001", "\ue002", "\ue003"  # marks; those in a text are escaped
#: Names by gender, and syllables of surnames.
GIVEN = {
    "M": "Adam Albert Arthur Bruno Carlos Daniel David Edgar Emil Felix Georg Hugo Ivan Jacob Julian Karl Leon Louis Marco Martin Oscar Paul Samuel Victor",
    "F": "Alice Amelia Anna Bianca Clara Diana Elena Emma Eva Flora Greta Helena Irene Julia Laura Lena Lucia Maria Marta Nina Nora Olivia Rosa Sara",
    "N": "Alex Andrea Chris Dominique Jamie Kim Lee Morgan Robin Sacha Sam Sascha Toni Valery",
}
CYRILLIC = {"M": "Антон Борис Виктор Глеб Денис Егор Игорь Кирилл Максим Олег", "F": "Алина Вера Галина Дарья Елена Жанна Ирина Ксения Мария Ольга", "N": "Саша Женя Валя Слава"}
SYLLABLES = "bar den fel gor han kel lam mer nor pal ros sel tan vel wes zin dor mal rin sten"
CYRILLIC_SYLLABLES = "бар ден вол гор зин кел лам мер нов пол рос сел тан вел рин"
HAN = "安白陈程邓方高何胡江李林刘马宁潘钱沈唐王吴徐叶张赵周"
_CYR = "абвгдежзиклмнопрстуфхцчшэюя"
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: The attempts from which surrogates are longer than the entity, and addresses of version 6.
SAME_LENGTH, IPV6 = 3, 8


def mark(text: Column) -> Column:
    """Every mention between OPEN and CLOSE, its type told by the place of the one group that isn't empty."""
    clean = F.regexp_replace(text, f"([{OPEN}-{ESC}])", f"{ESC}$1{ESC}")
    clean = F.translate(clean, OPEN + CLOSE + SEP, "012")
    found = F.regexp_replace(clean, "|".join(f"({p})" for p in PATTERNS.values()), OPEN + SEP.join(f"${i}" for i in range(1, len(PATTERNS) + 1)) + CLOSE)
    return F.when(reduce(lambda a, b: a | b, [*[F.contains(text, F.lit(h)) for h in HINTS], text.rlike(f"(?i:{'|'.join(_KEYWORDS)})")]), found)


def _untitled(marked: Column) -> Column:
    """Mark the other places of names that a text has with a title: names of three letters or more, as written or in capitals, and Han names."""
    parts = F.split(marked, f"[{OPEN}{CLOSE}]", -1)
    mentions = F.filter(parts, lambda p, i: i % 2 == 1)
    named = F.transform(mentions, lambda p: F.array_join(F.slice(F.split(p, SEP, -1), len(PATTERNS) - N_NAMES + 1, N_NAMES), ""))
    names = F.array_distinct(F.flatten(F.transform(named, lambda x: F.array(x, F.upper(x)))))
    names = F.array_sort(F.filter(names, lambda x: (F.length(x) > 2) | x.rlike(r"^\p{IsHan}{2}")), lambda a, b: F.length(b) - F.length(a))
    pattern = F.concat(F.lit(r"((?<![\p{L}\p{N}\-])(?:"), F.array_join(names, "|"), F.lit(r")(?![\p{L}\p{N}]|-\p{L})|"), F.array_join(F.concat(F.filter(names, lambda x: x.rlike(r"^\p{IsHan}")), F.array(F.lit("(?!)"))), "|"), F.lit(")"))
    again = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.concat(F.lit(OPEN), p, F.lit(CLOSE))).otherwise(F.regexp_replace(p, pattern, F.lit(OPEN + SEP * len(PATTERNS) + "$1" + CLOSE))))
    return F.when(F.size(names) > 0, F.array_join(again, "")).otherwise(marked)


def _unmarked(text: Column) -> Column:
    for c, d in zip(OPEN + CLOSE + SEP, "012", strict=True):
        text = F.replace(text, F.lit(f"{ESC}{d}{ESC}"), F.lit(c))
    return F.replace(text, F.lit(ESC * 3), F.lit(ESC))


def _pick(words: str | list[str], value: Column) -> Column:
    words = words.split() if isinstance(words, str) else words
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(value, F.lit(len(words))) + 1).cast("int"))


def canonical(kind: Column, mention: Column) -> Column:
    """What all mentions of an entity share: digits and letters of numbers, small letters of mails and names."""
    bare = F.regexp_replace(mention, r"[^\p{L}\p{N}]", "")
    return (
        F.when(kind == "PHONE", F.concat(F.when(F.startswith(mention, F.lit("+")), "+").otherwise(""), bare))
        .when(kind.isin("CARD", "SSN", "IBAN"), bare)
        .when(kind.isin("KEY", "SECRET"), mention)
        .otherwise(F.lower(mention))
    )


def entity_kind(kind: Column, mention: Column) -> Column:
    """Names of any title and place are one kind."""
    han = mention.rlike(r"^\p{IsHan}")
    return F.when((kind == "NAME") & han, "HAN_NAME").when(kind.startswith("GIVEN") | kind.isin("SURNAME", "NAME"), "NAME").otherwise(kind)


def entities_of(mentions: DataFrame) -> DataFrame:
    """entity, canon, role: distinct entities of ``mentions`` (entity, canon, kind). Role of a NAME: M, F or N for given names (N where titles of both genders or none tell), else S."""
    has = lambda k: F.max(F.col("kind") == k)
    m, f, n = has("GIVEN_M"), has("GIVEN_F"), has("GIVEN_N")
    role = F.when(m & ~f, "M").when(f & ~m, "F").when(m | f | n, "N").otherwise("S")
    return mentions.groupBy("entity", "canon").agg(role.alias("role")).withColumnRenamed("entity", "kind")


def _mod97(text: Column) -> Column:
    """The remainder by 97 of an account number whose letters count 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(F.upper(c)) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: F.pmod(acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)).cast("int"))


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of an array of digits."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.pmod(F.aggregate(doubled, F.lit(0), lambda a, x: a + x), F.lit(10))


def _head(kind: Column, form: Column, plus: int) -> Column:
    """How many leading characters stay: country, network or vendor. ``plus``: how many of them a phone number with "+" has."""
    return F.when(kind == "IBAN", 2).when(kind == "KEY", 4).when(kind == "CARD", 1).when((kind == "PHONE") & F.startswith(form, F.lit("+")), plus).otherwise(0)


def draw(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, canon, role, attempt) with new, the keyed surrogate of a canonical form: of its length and kinds of characters; of names, by gender and script.

    The space of surrogates grows with the attempt, so that any number of entities finds distinct ones: names get a
    syllable more in each attempt, other forms a character more from attempt SAME_LENGTH on, after their head. Addresses
    keep their numbers of digits in attempts 0 and 1, then are any address, and from attempt IPV6 on of version 6.

    The keyed stream and the drawn characters are columns of their own, written before they are used: within a
    lambda they would be computed again for every character.
    """
    kind, canon, role, attempt, stream, drawn = (F.col(c) for c in ("kind", "canon", "role", "attempt", "stream", "drawn"))
    seed = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"))
    streamed = written(entities.withColumn("stream", F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{i}")), 256) for i in range(4)])))
    value = lambda i: F.conv(F.substr(stream, (F.pmod(2 * i, F.lit(254)) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    number = lambda i: F.conv(F.substr(stream, (F.pmod(F.lit(8) * i, F.lit(248)) + 1).cast("int"), F.lit(7)), 16, 10).cast("long")
    hexes = (kind == "SECRET") & canon.rlike("^[0-9a-f]+$")

    def char(c: Column, i: Column) -> Column:
        v = value(i)
        small = F.substr(F.lit(ALPHABET), F.pmod(v, F.when(hexes, 6).otherwise(26)) + 1, F.lit(1))
        cyr = F.substr(F.lit(_CYR), F.pmod(v, F.lit(len(_CYR))) + 1, F.lit(1))
        han = F.substr(F.lit(HAN), F.pmod(v, F.lit(len(HAN))) + 1, F.lit(1))
        return (
            F.when(c.rlike("[0-9]"), F.pmod(v, F.lit(10)).cast("string")).when(c.rlike("[a-z]"), small).when(c.rlike("[A-Z]"), F.upper(small))
            .when(c.rlike(r"\p{IsHan}"), han).when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), F.upper(cyr)).otherwise(cyr))
            .when(c.rlike(r"\p{Lu}"), F.upper(small)).when(c.rlike(r"\p{L}"), small).when((kind == "SECRET") & (attempt > 0), small).otherwise(c)
        )

    each = lambda x: F.split(x, "")  # noqa: E731  (in time linear in the length, unlike substr by place)
    # trailing characters that stay: a mail's top-level domain
    head, tail = _head(kind, canon, 2), F.when(kind == "EMAIL", F.instr(F.reverse(canon), ".")).otherwise(0)
    filler = F.when(kind.isin("IBAN", "CARD", "PHONE", "SSN"), "0").when(kind == "KEY", "A").when(kind == "HAN_NAME", HAN[0]).otherwise("a")
    form = F.concat(F.substr(canon, F.lit(1), head), F.repeat(filler, F.greatest(attempt - SAME_LENGTH + 1, F.lit(0))), F.substr(canon, head + 1))
    chars = each(form)
    kept = lambda c, i: F.when((i < head) | (i >= F.length(form) - tail), c).otherwise(char(c, i))
    with_drawn = written(streamed.withColumn("drawn", F.array_join(F.transform(chars, kept), "")))
    # a card's last digit keeps the card's Luhn sum
    zeroed = F.transform(F.transform(F.sequence(F.lit(1), F.length(drawn)), lambda i: F.substr(drawn, i, F.lit(1))), lambda c, i: F.when(i == F.length(form) - 1, 0).otherwise(c.cast("int")))
    own = _luhn(F.transform(each(canon), lambda c: c.cast("int")))
    card = F.concat(F.substr(drawn, F.lit(1), F.length(drawn) - 1), F.pmod(own - _luhn(zeroed), F.lit(10)).cast("string"))
    # an account number's check digits keep its remainder by 97, so that valid ones stay valid
    country, own_account, account = F.substr(drawn, F.lit(1), F.lit(2)), F.concat(F.substr(canon, F.lit(5)), F.substr(canon, F.lit(1), F.lit(4))), F.substr(drawn, F.lit(5))
    check = F.pmod(_mod97(own_account) - _mod97(F.concat(account, country, F.lit("00"))), F.lit(97))
    iban = F.concat(country, F.lpad(F.when(check < 2, check + 97).otherwise(check).cast("string"), 2, "0"), account)
    # parts of an address keep their number of digits at first
    octet = lambda x, i: F.when(F.length(x) == 1, 1 + F.pmod(value(i), F.lit(9))).when(F.length(x) == 2, 10 + F.pmod(value(i), F.lit(90))).otherwise(100 + F.pmod(value(i), F.lit(156))).cast("string")
    wide = lambda x, i: F.when(attempt < 2, octet(x, i)).otherwise(value(i).cast("string"))
    v6 = F.concat_ws(":", F.lit("2001:db8"), *[F.substr(stream, F.lit(4 * i + 1), F.lit(4)) for i in range(6)])
    ip = F.when(attempt < IPV6, F.array_join(F.transform(F.split(canon, r"\."), wide), ".")).otherwise(v6)
    cyrillic = canon.rlike(r"\p{IsCyrillic}")
    grown = lambda syllables, first: F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(0), attempt - 1), lambda i: _pick(syllables, number(i + first))), "")).otherwise("")
    latin, cyr = (F.initcap(F.concat(*[_pick(s, number(i)) for i in range(3)], grown(s, 5))) for s in (SYLLABLES, CYRILLIC_SYLLABLES))
    more = F.when(attempt > 0, F.concat(F.lit("-"), F.initcap(F.when(cyrillic, grown(CYRILLIC_SYLLABLES, 6)).otherwise(grown(SYLLABLES, 6))))).otherwise("")
    out = F.when(kind == "CARD", card).when(kind == "IP", ip).when(kind == "IBAN", iban).when((kind == "NAME") & (role == "S"), F.when(cyrillic, cyr).otherwise(latin))
    for g in GIVEN:
        out = out.when((kind == "NAME") & (role == g), F.concat(F.when(cyrillic, _pick(CYRILLIC[g], number(0))).otherwise(_pick(GIVEN[g], number(0))), more))
    return with_drawn.withColumn("new", out.otherwise(drawn)).drop("stream", "drawn")


def render(kind: Column, mention: Column, new: Column) -> Column:
    """The surrogate in the format of a mention: its separators and capitals; characters that it has more stand after the head."""
    bare = lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]", "")
    letters = bare(new)
    extra, head = F.greatest(F.length(letters) - F.length(bare(mention)), F.lit(0)), _head(kind, mention, 1)
    chars = F.transform(F.sequence(F.lit(1), F.length(mention)), lambda i: F.substr(mention, i, F.lit(1)))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))

    def step(acc: Column, c: Column) -> Column:
        takes = c.rlike(r"[\p{L}\p{N}]")
        n = F.when(acc["i"] == head, extra + 1).otherwise(1)
        x = F.substr(letters, acc["i"] + 1, n)
        return F.struct(F.concat(acc["out"], F.when(takes, F.when(c.rlike(r"\p{Lu}"), F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.substr(x, F.lit(2)))).otherwise(x)).otherwise(c)).alias("out"), (acc["i"] + F.when(takes, n).otherwise(0)).alias("i"))

    named = kind.startswith("GIVEN") | kind.isin("SURNAME", "NAME")
    shouted = named & (F.upper(mention) == mention) & (F.length(mention) > 1)
    return F.when(shouted, F.upper(new)).when(named | kind.isin("IP", "KEY", "SECRET", "HAN_NAME"), new).otherwise(F.aggregate(chars, zero, step)["out"])


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, new: distinct surrogates for distinct entities (kind, canon, role). Those that meet another's surrogate or a real entity are drawn again, the smallest of those that meet apart."""
    drawn = written(draw(entities.withColumn("attempt", F.lit(0)), key))
    while True:
        folded = F.lower("new")
        first = drawn.groupBy("kind", folded.alias("low")).agg(F.min("canon").alias("winner"))
        real = entities.select(F.col("kind").alias("r_kind"), F.lower("canon").alias("r_low")).distinct()
        judged = drawn.withColumn("low", folded).join(first, ["kind", "low"]).join(real, (F.col("kind") == F.col("r_kind")) & (F.col("low") == F.col("r_low")), "left")
        judged = written(judged.select("kind", "canon", "role", "attempt", "new", ((F.col("canon") != F.col("winner")) | F.col("r_low").isNotNull()).alias("again")))
        if judged.filter("again").isEmpty():
            return judged.select("kind", "canon", "new")
        more = draw(judged.filter("again").select("kind", "canon", "role", (F.col("attempt") + 1).alias("attempt")), key)
        drawn = written(judged.filter("NOT again").select("kind", "canon", "role", "attempt", "new").unionByName(more))


@tidy
def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replace every mention of personal data or a secret in ``text`` by its surrogate under ``key``.

    Returns ``docs`` with text replaced and a column entities (array of (kind, new) in order of the mentions,
    empty where there are none); an existing column of that name is replaced.

    Names are known by a title before (Han names: after) them; the same name elsewhere in the same text is replaced
    too, as the kind NAME, and a name has one surrogate in all texts. Names that no title tells stay.

    Null texts stay null and empty ones empty; very long ones are read whole. Repeated rows stay and get equal texts. Texts without mentions
    come back byte for byte. An entity that a third of all rows mention is one row of the table of entities.
    Row order isn't kept. An empty table gives an empty result.
    """
    own = docs.drop("entities")
    kind_of = "array<struct<kind:string,new:string>>"
    marked = own.withColumn("_cl_marked", mark(F.col(text)))
    has = F.coalesce(F.contains("_cl_marked", F.lit(OPEN)), F.lit(False))
    plain = marked.filter(~has).drop("_cl_marked").withColumn("entities", F.array().cast(kind_of))
    hits = written(marked.filter(has).withColumns({"_cl_marked": _untitled(F.col("_cl_marked")), "_cl_row": F.monotonically_increasing_id()}))

    pieces = hits.select("_cl_row", F.posexplode(F.split("_cl_marked", f"[{OPEN}{CLOSE}]", -1)).alias("place", "piece")).filter("place % 2 = 1")
    fields = pieces.withColumn("fields", F.split("piece", SEP, -1))
    at = F.array_position(F.transform("fields", lambda x: x != ""), F.lit(True)).cast("int")
    typed = fields.withColumn("at", at).select("_cl_row", "place", F.element_at(F.array(*[F.lit(t) for t in TYPES]), F.col("at")).alias("kind"), F.element_at("fields", F.col("at")).alias("mention"))
    mentions = written(typed.withColumns({"canon": canonical(F.col("kind"), F.col("mention")), "entity": entity_kind(F.col("kind"), F.col("mention"))}))
    names = assign(written(entities_of(mentions)), key).withColumnRenamed("kind", "entity")
    new = mentions.join(names, ["entity", "canon"]).select("_cl_row", F.struct("place", "kind", render(F.col("kind"), F.col("mention"), F.col("new")).alias("new")).alias("x"))
    lists = new.groupBy("_cl_row").agg(F.array_sort(F.collect_list("x")).alias("_cl_new"))
    parts = F.split("_cl_marked", f"[{OPEN}{CLOSE}]", -1)
    rebuilt = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.get("_cl_new", F.floor(i / 2).cast("int"))["new"]).otherwise(p)), "")
    done = hits.join(lists, "_cl_row").withColumn(text, _unmarked(rebuilt)).withColumn("entities", F.transform("_cl_new", lambda x: F.struct(x["kind"].alias("kind"), x["new"].alias("new"))))
    return plain.unionByName(done.select(*plain.columns))
