"""Toxicity: the matcher against a brute-force one, exceptions however they are written, texts full of matches."""

import random
import re
import time

from newsloom.llm import toxicity

MODEL = toxicity.Model((("idiot", 4.0), ("trash", 3.0), ("tras*", 2.0), ("moron", 2.5), ("scum", 1.0)), ("trash can", "idiot proof", "can idiot"), (-2.0, 1.0, 1.0))


def folded(phrase):
    return toxicity.fold(phrase)


FOLDED = toxicity.Model(tuple((folded(t.rstrip("*")) + ("*" if t.endswith("*") else ""), w) for t, w in MODEL.terms), tuple(map(folded, MODEL.exceptions)), MODEL.coefficients)


def brute(text):
    """Summed weight: the weightiest term at each word, unless an exception of whole words covers it."""
    words = toxicity.fold(text).split()
    spared = set()
    for e in FOLDED.exceptions:
        parts = e.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                spared |= set(range(i, i + len(parts)))
    total = 0.0
    for i, w in enumerate(words):
        best = [x for t, x in FOLDED.terms if (w.startswith(t[:-1]) if t.endswith("*") else w == t)]
        if best and i not in spared:
            total += max(best)
    return total


def test_matches_as_brute_force_does():
    draw, matcher = random.Random(12), toxicity.Matcher(FOLDED)
    pieces = ["idiot", "1d10t", "іdiоt", "IDIOT", "trash", "tr@sh", "trashy", "can", "proof", "moron", "sc​um", "calm", "idiots", "x"]
    seps = [" ", "  ", "\n", "-", ", ", "_", "—", "...", "\t"]
    for _ in range(500):
        text = "".join(x for _ in range(draw.randint(0, 12)) for x in (draw.choice(pieces), draw.choice(seps)))
        assert matcher.weigh(text)[0] == brute(text), text


def test_exceptions_however_they_are_parted():
    matcher = toxicity.Matcher(FOLDED)
    for text in ("trash can", "trash  can", "trash\ncan", "trash-can", "Trash, can", "TRASH—CAN", "tr4sh can"):
        assert matcher.weigh(text)[0] == 0.0, text
    assert matcher.weigh("trash canopy")[0] == 3.0


def test_a_text_full_of_exceptions():
    matcher = toxicity.Matcher(FOLDED)
    start = time.perf_counter()
    weight, matches, words = matcher.weigh("idiot trash can x " * 100_000)
    assert time.perf_counter() - start < 10
    assert (weight, matches, words) == (400_000.0, 100_000, 400_000)
    assert re.fullmatch(r"[^ ]+( [^ ]+)*", toxicity.fold(" a  b_c\n"))
