"""What the method adds to the patterns, against a plain version, and texts that share very many entities."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import pii

from . import brute


def plain_added(texts):
    """{text: [(kind, start, end)]} by counting every entity and word over the distinct texts."""
    spans = {t: [(pii.KINDS.index(k), a, b) for k, a, b in brute.base_spans(t)] for t in set(texts)}
    entities = {t: {x for e in pii.entities_of(t, own) for x in (e, pii.group_of(e))} for t, own in spans.items()}
    words = {t: {w for w, _, _ in pii.words_of(t, own)} for t, own in spans.items()}
    n = len(spans)
    with_entity, with_word = ({} for _ in range(2))
    for t in spans:
        for e in entities[t]:
            with_entity.setdefault(e, set()).add(t)
        for w in words[t]:
            with_word.setdefault(w, set()).add(t)
    out = {}
    for t, own in spans.items():
        kinds = {}
        for e in entities[t]:
            for w in words[t]:
                both, ne, nw = len(with_entity[e] & with_word[w]), len(with_entity[e]), len(with_word[w])
                if both < pii.SUPPORT or ne == n:
                    continue
                share = math.log(n * both / (ne * nw)) / math.log(n / ne)
                if share >= pii.GENERALISE:
                    kinds[w] = max(kinds.get(w, 4), 5 if share >= pii.REMOVE else 4)
        out[t] = sorted([(kinds[w], a, b) for w, a, b in pii.words_of(t, own) if w in kinds] + [(5, a, b) for a, b in pii.secret_spans(t)], key=lambda s: (s[0], s[1], s[2]))
    return out


def corpus(seed):
    rng = random.Random(seed)
    people = {f"{a}@{d}.example.com": names for (a, d), names in zip([(a, d) for d in ("north", "south") for a in ("x", "y", "z")], ["alpha beta", "gamma", "delta epsilon", "zeta", "eta theta", "iota"])}
    out = []
    for k in range(260):
        words = [rng.choice(["common", "words", "stand", "here", "there", "often", "enough"]) for _ in range(rng.randint(3, 20))]
        if rng.random() < 0.4:
            for address in rng.sample(sorted(people), rng.choice([1, 1, 2])):
                words.insert(rng.randrange(len(words)), address)
                words += people[address].split() if rng.random() < 0.9 else []
        if rng.random() < 0.07:
            words.append(rng.choice(["gamma", "zeta", "alpha", "iota"]))
        if rng.random() < 0.1:
            words.append(f"10.0.0.{rng.randint(1, 4)} router")
        out.append(" ".join(words))
    return out + out[:9] + ["", "token=" + "Ab1" * 2000 + "xYz9Kq"]


@pytest.mark.parametrize("seed", [1, 2])
def test_added_spans_equal_the_plain_version(spark, seed):
    texts = corpus(seed)
    want = plain_added(texts)
    rows = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("id", "more").collect()
    got = {r["id"]: sorted((s["kind"], s["start"], s["end"]) for s in r["more"]) for r in rows}
    assert got == {k: want[t] for k, t in enumerate(texts)}
    kinds = [s[0] for own in got.values() for s in own]
    assert kinds.count(4) > 0 and kinds.count(5) > 20


def test_a_secret_of_any_length_goes(spark):
    secret = "Ab1dE2xYz9Kq" * 1500
    rows = pii.sanitise(spark.createDataFrame([(1, f"key={secret} end", 5)], "doc_id long, text string, h int")).collect()
    assert rows[0]["text"] == "key= end"


def test_a_thousand_shared_entities_take_seconds(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    shared = " ".join([f"{word()}@{word()}.example.com" for _ in range(1000)] + [word() for _ in range(1000)])
    docs = [(k, f"{shared} {word()}") for k in range(6)] + [(k, " ".join(word() for _ in range(20))) for k in range(6, 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pii.span_digests(spark.createDataFrame(docs[6:], df.schema)).collect()
    began = time.time()
    rows = {r["doc_id"]: r for r in pii.span_digests(df).collect()}
    assert time.time() - began < 60
    assert all(rows[k]["n_email"] == 1000 and rows[k]["spans"].count("removed") == 1000 for k in range(6))
    assert all("removed" not in rows[k]["spans"] for k in range(6, 60))


def test_entities_of_the_same_texts_come_once(spark):
    found = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["d"])], "h long, entities array<string>")
    assert sorted(tuple(r) for r in pii.entity_counts(found).collect()) == [("a", 2), ("c", 1), ("d", 1)]
    assert pii.bitmap(found.select(F.lit("").alias("e")).limit(0)) == bytes(pii.BITS // 8)
