"""Rewriting within guards: equal to a walk over each character, in time that follows the words and not the characters."""

import random
import time

import pytest

from captionlake.functions import sequences as Q


def walk(aliases, guards, text):
    """One pass, character by character, and the forms that stay."""
    words = sorted({*aliases, *aliases.values()} - {""}, key=lambda w: (-len(w), w))
    held = {k for g in guards if g for s in range(len(text)) if text.startswith(g, s) for k in range(s, s + len(g))}
    out, kept, i = "", [], 0
    while i < len(text):
        here = [w for w in words if text.startswith(w, i)]
        free = next((w for w in here if w not in aliases or not held & set(range(i, i + len(w)))), None)
        if here and free is None and aliases[here[0]] not in kept:
            kept.append(aliases[here[0]])
        out += aliases.get(free, free or text[i])
        i += len(free or text[i])
    return out, kept


@pytest.mark.parametrize("seed", range(8))
def test_a_pass_equals_a_walk(seed):
    rng = random.Random(seed)
    some = lambda least, most: "".join(rng.choices("ab(é緣\U0001f600\n", [5, 5, 1, 1, 1, 1, 1], k=rng.randint(least, most)))
    for _ in range(300):
        aliases = {some(1, 3): some(0, 3) for _ in range(rng.randrange(5))}
        guards = tuple(some(0, 4) for _ in range(rng.randrange(4)))
        once, told = Q._scanner(aliases, guards)
        for _ in range(6):
            text = some(0, 25)
            assert (once(text), told(text)) == walk(aliases, guards, text), (aliases, guards, text)


def test_a_long_text_is_not_walked_through():
    """4 MB with few words: a walk takes over a second."""
    text, (once, told) = "lorem ipsum dolor sit amet " * 150_000 + "the he", Q._scanner({"he": "HE"}, ("the",))
    began = time.process_time()
    assert once(text) == text[:-2] + "HE" and told(text) == ["HE"]
    assert time.process_time() - began < 0.4
