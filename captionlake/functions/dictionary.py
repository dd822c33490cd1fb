"""Keys of dictionary entries and of sentences that are looked up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no keys, and the limits of keys, words, glosses and queries.
STOP_WORDS = tuple(
    """
    a an the of and or to in on for with at by from as
    is are was were be been being am
    it its this that these those
    not no nor but if then than
    into onto upon over under
    i we you he she they them his her their
    """.split()
)
MOST_KEYS, MOST_CHARS, MOST_QUERY, MOST_TOKENS, MOST_QUERY_KEYS, HAN_SPAN = 64, 160, 600, 80, 96, 8
TOKEN = "[a-z][a-z0-9]*(?:['-][a-z0-9]+)*"


def entry_keys(word: Column, alternative: Column, glosses: Column, inflections: Column | None = None) -> Column:
    """Distinct keys of an entry in order: word, alternative, each gloss and then its words without stop words, inflections; 64 at most, none longer than 160 characters. Glosses are cut at line ends and slashes."""
    parts = F.filter(F.transform(F.flatten(F.transform(glosses, lambda g: F.split(g, r"[\n/]+"))), lambda g: F.lower(F.trim(g))), lambda g: g != "")
    of_gloss = F.flatten(F.transform(parts, lambda g: F.concat(F.array(g), F.filter(F.regexp_extract_all(g, F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS)))))
    keys = F.concat(F.array(F.lower(word), F.lower(alternative)), of_gloss, *([] if inflections is None else [F.transform(inflections, lambda x: F.lower(F.trim(x)))]))
    return F.slice(F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "") & (F.length(k) <= MOST_CHARS))), 1, MOST_KEYS)


def query_keys(sentence: Column) -> Column:
    """Keys under which a sentence's first 600 characters are looked up: its words, 80 at most, then its Han substrings from eight characters down to one, 96 in all."""
    text = F.substring(F.lower(F.trim(sentence)), 1, MOST_QUERY)
    words = F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z][a-z'-]{1,39}"), F.lit(0))), 1, MOST_TOKENS)
    runs = F.regexp_extract_all(text, F.lit("[\\u3400-\\u4dbf\\u4e00-\\u9fff]+"), F.lit(0))

    def cuts(r: Column, n: int) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(1), F.length(r)), lambda i: i + n - 1 <= F.length(r)), lambda i: F.substr(r, i, F.lit(n)))

    each = F.flatten(F.transform(runs, lambda r: F.flatten(F.array(*[cuts(r, n) for n in range(HAN_SPAN, 0, -1)]))))
    return F.slice(F.array_distinct(F.concat(words, each)), 1, MOST_QUERY_KEYS)
