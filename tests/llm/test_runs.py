"""Runs of pieces against a plain version, and their time on a text that repeats itself."""

import random
import re
import textwrap
import time

import pytest

from tallyspark.llm import licenses

SETS = [(n, licenses.template_bigrams(t)) for n, t in sorted(licenses.TEMPLATES)]
MIT = dict(licenses.TEMPLATES)["mit-permission"]


def pieces(text):
    out, start = [], 0
    for m in [*re.finditer(r"(?<=[.!?])[ \t\r\n]+|\n", text), None]:
        end = m.start() if m else len(text)
        words = re.findall("[a-z0-9]+", text[start:end].lower())
        if words:
            out.append((start, end, words))
        start = m.end() if m else end
    return out


def plain_best(text, least):
    """(license, dice) over all runs of pieces with their sets built anew."""
    units, best = pieces(text), None
    most = max(len(s) for _, s in SETS) * (2 - least) / least
    for i in range(len(units)):
        for j in range(i, len(units)):
            words = [w for u in units[i : j + 1] for w in u[2]]
            if (j > i and len(words) > licenses.REPEATS * most) or units[j][1] - units[i][0] < 8:
                continue
            own = {f"{a} {b}" for a, b in zip(words, words[1:])}
            for name, grams in SETS:
                dice = 2.0 * len(own & set(grams)) / (len(own) + len(grams))
                if dice >= least and (best is None or (-dice, name) < best):
                    best = (-dice, name)
    return best and (best[1], -best[0])


def texts():
    rng = random.Random(11)
    for k in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice([t for _, t in licenses.TEMPLATES]).split()
            for _ in range(rng.randint(0, len(words) // 12)):
                words[rng.randrange(len(words))] = rng.choice(["other", "words", "here."])
            parts += [" ".join(words), " ".join(rng.choice(["lorem", "ipsum.", "dolor"]) for _ in range(rng.randint(0, 20)))]
        text = rng.choice(["\n", " ", "\n\n"]).join(parts)
        yield textwrap.fill(text, rng.choice([30, 60, 200])) * rng.choice([1, 1, 3]) if k % 2 else text


@pytest.mark.parametrize("least", [0.8, 0.6])
def test_best_run_equals_the_plain_version(least):
    hits = 0
    for text in texts():
        got = licenses.runs_of_pieces(text, SETS, least)
        want = plain_best(text, least)
        assert (got and got[:1]) == (want and want[:1])
        assert got is None or abs(got[1] - want[1]) < 1e-12
        hits += got is not None
    assert hits > 20


def test_a_megabyte_of_repeated_notices_takes_seconds():
    text = (textwrap.fill(MIT, 60) + "\n") * (1_000_000 // len(MIT))
    began = time.process_time()
    name, dice, _, runs = licenses.runs_of_pieces(text, SETS, 0.8)
    assert (name, round(dice, 6)) == ("mit-permission", 1.0) and runs >= 1_000_000 // len(MIT) - 1
    assert time.process_time() - began < 60


def test_time_grows_with_the_length_of_mixed_notices():
    rng = random.Random(1)
    lines = textwrap.wrap(MIT, 60) + ["some other words"]
    text = lambda n: "\n".join(rng.choice(lines) for _ in range(n))
    took = []
    for n in (1500, 6000):
        own, began = text(n), time.process_time()
        licenses.runs_of_pieces(own, SETS, 0.8)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1
