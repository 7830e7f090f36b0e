"""Personal data: patterns, and sanitisation by how much a term tells about what the patterns found.

Patterns find emails, IP addresses, card and phone numbers in whole texts. Then the corpus is asked which words
would reveal them all the same: for a value e (an entity) and a word t of a text that has it, over distinct texts,
PMI(t; e) = log(N n(t,e) / (n(t) n(e))) is the information t gives about e, and IC(e) = log(N / n(e)) all there is.
A word whose share PMI / IC reaches REMOVE is removed wherever it stands in the documents of that entity, one that
reaches GENERALISE is replaced by the general class of all such words, [TERM]. All counts are of whole texts, of words outside pattern matches. Pairs
seen in fewer than SUPPORT distinct texts are no evidence, so neither is an entity of fewer: of a value seen once,
every word that stands nowhere else would tell all. Counts cover all documents: pairs come from the documents with
entities; for the words of those pairs, all documents are counted (bitmaps of fixed size let other entities, words
and pairs drop out early; they never drop one that counts).

Entities are the single values and what they have in common with others (an email's domain, a network, an issuer, a
phone's prefix), so words that tell whose addresses these are get evidence even where each address is seen once.
Secrets (the value of an assignment, with LEAST_BITS of information a character) are entities that are their own
term: PMI is all of IC, without any need for evidence, so they are removed.

Pattern matches are leftmost and do not overlap within a kind; a match that fails its check is dropped and the
search goes on behind it. The search is linear in the text.

Defined results: null text is empty; texts are read whole; rows that repeat are judged one by one and count once as
evidence; an empty table gives an empty result; other columns aren't read (sanitise() passes them on).
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .minhash import id_bitmap
from .shared import drop, materialize, table, tidy_after

#: Fixed values.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

#: A value that something is set to; a secret if its characters carry enough information.
VALUE = re.compile(r"""[=:][\x20\t]*["']?([A-Za-z0-9+/_-]{20,}+)""")
LEAST_BITS = 3.0  # a character of a secret, by the frequencies of its own characters
WORD = re.compile(r"[^\W\d_]{3,}")
SUPPORT = 5
GENERALISE, REMOVE = 0.85, 0.95
BITS = 1 << 22
LABELS = {0: "[EMAIL]", 1: "[IP]", 2: "[CARD]", 3: "[PHONE]", 4: "[TERM]", 5: ""}
SPAN_KINDS = [*KINDS, "generalised", "removed"]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def secret_spans(text: str) -> list[tuple[int, int]]:
    """Values with three digits, three letters and LEAST_BITS a character: keys and tokens, not words or file names."""
    out = []
    if "=" in text or ":" in text:
        for m in VALUE.finditer(text):
            counts = Counter(m[1])
            digits = sum(n for c, n in counts.items() if c.isdigit())
            letters = sum(n for c, n in counts.items() if c.isalpha())
            bits = -sum(n * math.log2(n / len(m[1])) for n in counts.values()) / len(m[1])
            if digits >= 3 and letters >= 3 and bits >= LEAST_BITS:
                out.append((m.start(1), m.end(1)))
    return out


def entity(kind: int, value: str) -> str:
    return f"{kind}:{value.lower() if kind < 2 else ''.join(c for c in value if c.isdigit())}"


def entities_of(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    return list(dict.fromkeys(entity(kind, text[a:b]) for kind, a, b in spans))


def with_groups(entities: Column) -> Column:
    """The entities and what they have in common with others: an email's domain, a network, a card's issuer, a phone's prefix."""
    value = lambda e: F.substr(e, F.lit(3))
    group = lambda e: F.when(e.startswith("0:"), F.concat(F.lit("0@"), F.substring_index(e, "@", -1))).when(e.startswith("1:"), F.concat(F.lit("1/"), F.substring_index(value(e), ".", 3))).when(e.startswith("2:"), F.concat(F.lit("2/"), F.substr(value(e), F.lit(1), F.lit(6)))).otherwise(F.concat(F.lit("3/"), F.substr(value(e), F.lit(1), F.lit(5))))
    return F.array_distinct(F.concat(entities, F.transform(entities, group)))


def group_of(entity_: str) -> str:
    """with_groups for one entity."""
    kind, value = entity_[0], entity_[2:]
    return f"{kind}@{value.rpartition('@')[2]}" if kind == "0" else f"{kind}/{value.rpartition('.')[0] if kind == '1' else value[: 6 if kind == '2' else 5]}"


def words_of(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(word, start, end) for the words that no span touches, in their order."""
    covered = sorted((a, b) for _, a, b in spans)
    k, reach = 0, 0
    for m in WORD.finditer(text):
        while k < len(covered) and covered[k][0] < m.end():
            reach = max(reach, covered[k][1])
            k += 1
        if m.start() >= reach:
            yield m[0].lower(), m.start(), m.end()


def word_set(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    return {w for w, _, _ in words_of(text, spans)} if spans else {w.lower() for w in set(WORD.findall(text))}


def place(*names: str) -> int:
    return zlib.crc32("\0".join(names).encode()) % BITS


def bitmap(names: DataFrame) -> bytes:
    """BITS bits with those at the places of the rows set."""
    return id_bitmap(names.select(F.crc32(F.concat_ws("\0", *names.columns).cast("binary")).alias("id")), BITS).tobytes()


def held(bits: bytes, at: int) -> bool:
    return bool(bits[at >> 3] >> (at & 7) & 1)


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
FOUND = "row long, id {id}, h long, kinds array<int>, starts array<long>, ends array<long>, entities array<string>, secrets array<struct<kind:int,start:long,end:long>>"


def find_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, kinds, starts, ends, entities, secrets = [], [], [], [], [], []
            for value in batch.column(2):
                text = value.as_py()
                spans = base_spans(text)
                rows.append(row)
                row += 1
                kinds.append([s[0] for s in spans])
                starts.append([s[1] for s in spans])
                ends.append([s[2] for s in spans])
                entities.append(entities_of(text, spans))
                secrets.append([{"kind": 5, "start": a, "end": b} for a, b in secret_spans(text)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column(0), batch.column(1), pa.array(kinds, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(entities, pa.list_(pa.string())), pa.array(secrets, pa.list_(SPAN))],
                ["row", "id", "h", "kinds", "starts", "ends", "entities", "secrets"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return source.mapInArrow(run, FOUND.format(id=source.schema["id"].dataType.simpleString()))


def word_counts(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """Rows (term, n_term): the distinct texts in which each of the terms occurs outside pattern matches."""
    flags = bitmap(terms)
    some = any(flags)

    @tidy_after
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            lists = []
            for value in batch.column(1):
                own, text = [], value.as_py()
                for word in word_set(text, base_spans(text)):
                    hit = known.get(word)
                    if hit is None:
                        if len(known) > 500_000:
                            known.clear()
                        hit = known[word] = held(flags, place(word))
                    if hit:
                        own.append(word)
                lists.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string()))], ["h", "terms"])

    @tidy_after
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for terms_ in batch.column(0).to_pylist():
                counts.update(terms_)
            if len(counts) > 200_000:
                yield pa.RecordBatch.from_pydict({"term": list(counts), "n": list(counts.values())})
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    source = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).filter("text is not null")
    words = source if some else source.limit(0)
    once = words.mapInArrow(listed, "h long, terms array<string>").filter(F.size("terms") > 0).dropDuplicates(["h"])  # each text counts once
    return once.select("terms").mapInArrow(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term")).join(terms, "term", "left_semi")


def entity_counts(found: DataFrame) -> DataFrame:
    """Rows (entity, n_entity): the distinct texts that have each entity, whether or not any word stands by it.

    Of entities that stand in the same texts, which words reveal alike, only the least comes; so a list of addresses that some texts
    share counts as one of them.
    """
    named = found.filter(F.size("entities") > 0).select("h", F.explode("entities").alias("entity")).distinct()
    one, two = (F.bit_xor(F.xxhash64(F.lit(k), "h")) for k in (1, 2))
    counts = named.groupBy("entity").agg(F.count("*").alias("n_entity"), one.alias("one"), two.alias("two"))
    return counts.groupBy("n_entity", "one", "two").agg(F.min("entity").alias("entity")).select("entity", "n_entity")


def entity_texts(docs: DataFrame, text_col: str, entities: DataFrame) -> DataFrame:
    """Rows (h, text, entities): each distinct text with any of the entities, once; a few other entities may come along."""
    flags = bitmap(entities)

    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, texts, lists = [], [], []
            for k, value in enumerate(batch.column(1)):
                text = value.as_py()
                named = entities_of(text, base_spans(text))
                own = [e for e in dict.fromkeys([*named, *map(group_of, named)]) if held(flags, place(e))]
                if own:
                    h.append(batch.column(0)[k].as_py())
                    texts.append(text)
                    lists.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(texts, pa.string()), pa.array(lists, pa.list_(pa.string()))], ["h", "text", "entities"])

    source = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).filter("text is not null")
    words = source if any(flags) else source.limit(0)
    return words.mapInArrow(run, "h long, text string, entities array<string>").dropDuplicates(["h"])


def pair_counts(texts: DataFrame) -> DataFrame:
    """Rows (entity, term, n_both) from rows of entity_texts; entity "" counts the term in all of them."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e for e, _ in counts], pa.string()), pa.array([t for _, t in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["entity", "term", "n"])

    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for value, own in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = value.as_py()
                words = word_set(text, base_spans(text))
                for e in ["", *own]:
                    counts.update((e, w) for w in words)
                    if len(counts) > 500_000:
                        yield rows(counts)
                        counts.clear()
        yield rows(counts)

    return texts.mapInArrow(run, "entity string, term string, n long").groupBy("entity", "term").agg(F.sum("n").alias("n_both"))


def disclosing(docs: DataFrame, found: DataFrame, held_texts: DataFrame, entities: DataFrame, text_col: str, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Rows (entity, term, kind): the words that reveal an entity; kind 4 generalises, 5 removes."""
    texts = found.select("h").distinct().count()
    log = lambda c: F.log(F.col(c).cast("double"))
    all_ = math.log(max(texts, 1))
    share = lambda n_term: F.when(F.col("n_entity") < texts, (all_ + log("n_both") - log(n_term) - log("n_entity")) / (F.lit(all_) - log("n_entity")))
    counts = materialize(pair_counts(held_texts).filter(F.col("n_both") >= support), "pairs")
    # A term is in as many texts as it is in those with entities, or more, which bounds its share from above.
    least = counts.filter("entity = ''").select("term", F.col("n_both").alias("n_least"))
    pairs = counts.join(entities, "entity").join(least, "term").filter(share("n_least") >= generalise - 1e-9).drop("n_least")
    pairs = materialize(pairs, "bounded")
    drop(counts)
    scored = pairs.join(word_counts(docs, text_col, pairs.select("term").distinct()), "term").withColumn("share", share("n_term"))
    return scored.filter(F.col("share") >= generalise).select("entity", "term", F.when(F.col("share") >= remove, 5).otherwise(4).alias("kind"))


def added_spans(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """Rows (h, more): for distinct texts, the spans (kind, start, end) of all occurrences of words that reveal one of their entities."""
    grouped = found.withColumn("entities", with_groups(F.col("entities")))
    entities = materialize(entity_counts(grouped).filter(F.col("n_entity") >= SUPPORT), "entities")
    texts = materialize(entity_texts(docs, text_col, entities.select("entity")), "texts")
    flagged = materialize(disclosing(docs, found, texts, entities, text_col), "flagged")
    flags = bitmap(flagged.select("entity", "term"))

    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h, value, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = value.as_py()
                where: dict[str, list[tuple[int, int]]] = {}
                for word, a, b in words_of(text, base_spans(text)):
                    where.setdefault(word, []).append((a, b))
                for word, at in where.items():
                    out += [(h, e, word, [a for a, _ in at], [b for _, b in at]) for e in own if held(flags, place(e, word))]
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["h", "entity", "term", "starts", "ends"])

    met = texts.mapInArrow(run, "h long, entity string, term string, starts array<long>, ends array<long>").join(flagged, ["entity", "term"])
    words = met.groupBy("h", "term").agg(F.max("kind").alias("kind"), F.first("starts").alias("starts"), F.first("ends").alias("ends"))
    spots = words.select("h", F.transform(F.arrays_zip("starts", "ends"), lambda s: F.struct(F.col("kind"), s["starts"].alias("start"), s["ends"].alias("end"))).alias("s"))
    return spots.groupBy("h").agg(F.sort_array(F.flatten(F.collect_list("s"))).alias("more"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (row, id, h, kinds, starts, ends, more): base spans, and in more those that the method adds."""
    found = materialize(find_base(docs, id_col, text_col), "found")
    rows = found.drop("entities").join(added_spans(docs, found, text_col), "h", "left")
    return rows.withColumn("more", F.array_sort(F.concat(F.coalesce("more", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")), "secrets"))).drop("secrets")


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    label = F.array(*map(F.lit, SPAN_KINDS))
    base = F.arrays_zip(F.col("kinds").alias("kind"), F.col("starts").alias("start"), F.col("ends").alias("end"))
    text = lambda s: F.concat_ws(":", F.element_at(label, s["kind"] + 1), s["start"], s["end"])
    rows = find_spans(docs, id_col, text_col).withColumn("base", F.transform(base, text)).withColumn("added", F.transform("more", text))
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select(
        F.col("id").alias(id_col), *[count(k) for k in range(4)], F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat("base", "added"), ",").alias("spans")
    )


def rewritten(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span's label in its place; of overlapping spans, the first that begins gives the label."""
    out, at = [], 0
    for start, _, end, kind in sorted((s, -e, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], LABELS[kind]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with spans replaced in the text; all other columns, whatever their names, stay as they are."""
    found = find_base(docs, id_col, text_col)
    found = materialize(found, "found")
    more = added_spans(docs, found, text_col).select(F.col("h").alias("_h"), F.col("more").alias("_more"))
    names = docs.columns
    at = names.index(text_col)

    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, more_ in zip(batch.column(at), batch.column(len(names)).to_pylist(), strict=True):
                text = value.as_py()
                spans = base_spans(text) if text else []
                spans += [(5, a, b) for a, b in secret_spans(text or "")] + [(s["kind"], s["start"], s["end"]) for s in more_ or []]
                texts.append(rewritten(text, spans) if spans else text)
            columns = [batch.column(k) for k in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.withColumn("_h", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(more, "_h", "left").select(*[F.col(f"`{n}`") for n in names], "_more")
    return rows.mapInArrow(run, docs.schema)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op2_pii": op2_pii}
SQL: dict[str, str] = {}
