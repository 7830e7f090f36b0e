"""Spelling variants: words one edit apart, found in a dictionary of pairs of trie nodes.

Words are the runs of letters of all texts with A-Z in small letters; some, picked by a hash of document and run, lose a
character. Distinct words are sorted and dealt by borders (a bounded sample of their beginnings), and each part of
them numbers the nodes of its trie: a word keeps the numbers of the beginning that it shares with the word before and
gets new ones for the rest. A beginning that stands in two parts is the beginning of a border between them, and the
trie of the borders is numbered first, alike everywhere; so equal beginnings have one number, and others none in
common. The reversed words are numbered the same way.

A word of L characters then has L pairs (node before a skipped character, reversed node behind it) and L + 1 pairs
(node before an inserted character, reversed node behind it). Two words with a skipped pair in common differ in that
character alone; a skipped pair of one that is an inserted pair of another tells that the other lacks that character.
Where a run of equal characters could be skipped anywhere, only its first counts, so every pair of near words comes
once. Equal pairs are joined; at most one word for each letter has the same skipped pair, so no group is large.

A word's form is its near word of largest n, if that n is at least `ratio` times the word's own; forms are followed by
pointer jumping, at most 18 steps as n grows tenfold with each.

Defined results: null and empty texts have no words; a null id is an empty text in the hash; rows that repeat count as
often as they stand; words of any length are treated alike; ties go to the smallest in code-point order; without words
there are no rows; other columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, materialize, shuffle_partitions, table, tidy_after

RUN = "[A-Za-zÀ-ÿ]"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAMPLED, BEGINNING = 64, 64  # words sampled for each border, and how much of them
PART_BITS = 40  # below the number of a part, for nodes or words of it
PAIRS = 1 << 16  # rows of a batch
INSERTED, SKIPPED, REPEATED = 0, 1, 2  # kinds of pairs; REPEATED skips a character that follows its like
MOST_JUMPS = 5


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, often: int = 2, one_in: int = 31) -> DataFrame:
    """Rows (word, n): the words of at least `least` characters that occur `often` times and more.

    Of a run whose crc32 with its document's id is divisible by `one_in`, the character at crc32 modulo its length goes.
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({RUN}{{{least},}})"), 1))  # no shorter run gives such a word
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run")).select("id", F.translate("run", CAPITALS, SMALL).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run"))).withColumn("k", (F.col("h") % F.length("run")).cast("int"))
    cut = F.concat(F.col("run").substr(F.lit(1), F.col("k")), F.col("run").substr(F.col("k") + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


def common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(k for k in range(n) if a[k] != b[k])


def borders(words: DataFrame, word: Column, parts: int) -> list[str]:
    """Beginnings of words that cut them into about `parts` parts of like size, from parts * SAMPLED of them by hash."""
    sample = words.select(word.alias("w"), F.xxhash64(word).alias("h")).orderBy("h", F.col("w").substr(1, BEGINNING)).limit(parts * SAMPLED)
    some = sorted(r[0] for r in sample.select(F.col("w").substr(1, BEGINNING)).collect())
    return sorted(set(some[SAMPLED::SAMPLED]))


class Trie:
    """Numbers of the beginnings of sorted words: 0 is the empty one."""

    def __init__(self, first: int):
        self.last, self.path, self.next = "", [0], first

    def nodes(self, word: str, known: list[int]) -> list[int]:
        """The numbers of the word's beginnings, by length; `known` gives those of the shortest ones."""
        del self.path[common(word, self.last) + 1 :]
        self.path += known[len(self.path) : len(word) + 1]
        new = len(word) + 1 - len(self.path)
        self.path += range(self.next, self.next + new)
        self.next += new
        self.last = word
        return self.path


def border_paths(cuts: list[str]) -> list[list[int]]:
    trie = Trie(1)
    return [list(trie.nodes(c, [])) for c in cuts]


def number(cuts: list[str], paths: list[list[int]], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str, list[int], pa.RecordBatch, int]]:
    """For rows (part, word, ...) sorted by both: (part, place in it, word, nodes of its beginnings, batch, row)."""
    part, place, trie = None, 0, None
    for batch in batches:
        for row, (own, word) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if own != part:
                part, place, trie = own, 0, Trie((own + 1) << PART_BITS)
            near = [(common(word, cuts[k]), k) for k in (own - 1, own) if 0 <= k < len(cuts)]
            shared, k = max(near, default=(0, 0))
            yield part, place, word, trie.nodes(word, paths[k][: shared + 1] if shared else []), batch, row
            place += 1


def dealt(words: DataFrame, word: str, cuts: list[str], kind: str) -> DataFrame:
    """The rows (word, ...) behind their part, each part sorted in one task."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([bisect_right(cuts, w) for w in batch.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([own, *batch.columns], ["part", *batch.schema.names])

    return words.mapInArrow(parts, f"part int, {kind}").repartition("part").sortWithinPartitions("part", word)


def forward(words: DataFrame, parts: int) -> DataFrame:
    """Rows (id, word, n, nodes): words numbered in code-point order, and the trie nodes of their beginnings."""
    cuts = borders(words, F.col("word"), parts)
    paths = border_paths(cuts)

    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "word", "n", "nodes"]
        rows, size = [], 0
        for part, place, word, nodes, batch, row in number(cuts, paths, batches):
            rows.append(((part << PART_BITS) + place, word, batch.column(2)[row].as_py(), np.array(nodes, np.int64)))
            size += len(nodes)
            if size > PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())]
    return dealt(words.select("word", "n"), "word", cuts, "word string, n long").mapInArrow(run, "id long, word string, n long, nodes array<long>")


def node_pairs(words: DataFrame, parts: int) -> DataFrame:
    """Rows (before, behind, kind, id, n) of words (id, word, n, nodes): the pairs around each skipped and each inserted character."""
    backward = words.select(F.reverse("word").alias("back"), "id", "n", "nodes")
    cuts = borders(words, F.reverse("word"), parts)
    paths = border_paths(cuts)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        before, behind, kind = (np.concatenate([r[k] for r in rows]) for k in range(3))
        many = [len(r[0]) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array(before), pa.array(behind), pa.array(kind, pa.int8()), *[pa.array(np.repeat([r[k] for r in rows], many)) for k in (3, 4)]], ["before", "behind", "kind", "id", "n"])

    @tidy_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for _, _, back, nodes, batch, row in number(cuts, paths, batches):
            before = np.asarray(batch.column(4)[row].values)
            behind = np.array(nodes, np.int64)[::-1]
            letters = np.frombuffer(back[::-1].encode("utf-32-le"), np.uint32)
            skipped = np.full(len(letters), SKIPPED)
            skipped[1:][letters[1:] == letters[:-1]] = REPEATED
            own = batch.column(2)[row].as_py(), batch.column(3)[row].as_py()
            rows += [(before[:-1], behind[1:], skipped, *own), (before, behind, np.full(len(before), INSERTED), *own)]
            size += 2 * len(before)
            if size > PAIRS:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return dealt(backward, "back", cuts, "back string, id long, n long, nodes array<long>").mapInArrow(run, "before long, behind long, kind byte, id long, n long")


def near_words(pairs: DataFrame) -> DataFrame:
    """Rows (id, near, near_n): each word with each word one edit apart, once."""
    side = lambda rows, name: rows.select("before", "behind", F.col("id").alias(f"{name}_id"), F.col("n").alias(f"{name}_n"))
    skipped, on = pairs.filter(F.col("kind") != INSERTED), ["before", "behind"]
    replaced = side(skipped, "a").join(side(skipped, "b"), on).filter("a_id != b_id").select(F.col("a_id").alias("id"), F.col("b_id").alias("near"), F.col("b_n").alias("near_n"))
    lacking = side(pairs.filter(F.col("kind") == SKIPPED), "a").join(side(pairs.filter(F.col("kind") == INSERTED), "b"), on)
    both = lacking.select(F.explode(F.array(*[F.struct(F.col(f"{x}_id").alias("id"), F.col(f"{y}_id").alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba")])).alias("p")).select("p.*")
    return replaced.unionByName(both)


def last_forms(links: DataFrame) -> DataFrame:
    """Rows (id, root) from (id, form): the end of the chain of forms, by pointer jumping."""
    now = materialize(links.select("id", F.col("form").alias("root")), "forms")
    for _ in range(MOST_JUMPS):
        hop = now.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        after = materialize(now.join(hop, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "forms")
        drop(now)
        now = after.select("id", "root")
        now._shared_path = after._shared_path
        if after.filter("moved").isEmpty():
            break
    return now


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of distinct words (word, n), null words left out."""
    parts = 2 * shuffle_partitions(words.sparkSession)
    counted = materialize(words.filter("word is not null").select("word", F.col("n").cast("long").alias("n")), "counts")
    named = materialize(forward(counted, parts), "words")
    pairs = materialize(node_pairs(named, parts), "pairs")
    best = near_words(pairs).groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = named.select("id", "word", "n").join(best, "id", "left")
    form_n = -F.col("best.less")
    holds = form_n >= ratio * F.col("n")
    judged = materialize(judged.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("best.near")).alias("form_id"), F.when(holds, form_n).alias("form_n")), "judged")
    for old in (counted, pairs):
        drop(old)
    chains = judged.filter("form_id is not null").select("id", F.col("form_id").alias("form"))
    named_as = lambda key, name: judged.select(F.col("id").alias(key), F.col("word").alias(name))
    changed = chains.join(last_forms(chains), "id").join(named_as("form", "form_word"), "form").join(named_as("root", "root_word"), "root").select("id", "form_word", "root_word")
    out = judged.join(changed, "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(counted_words(table(spark, sf_dir, "documents")))


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  GROUP BY doc_id, run),
bytes AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda j: 16 * (strpos('0123456789ABCDEF', x[j]) - 1) + strpos('0123456789ABCDEF', x[j + 1]) - 1)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h FROM bytes, crc),
w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS (SELECT word, n, i, left(word, i) AS a, substr(word, i + 2) AS b FROM w, unnest(range(length(word))) AS u(i)),
near AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM gaps x JOIN gaps y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM gaps x JOIN w y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM gaps x JOIN w y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM near GROUP BY word),
judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN most END AS form_n,
    CASE WHEN most >= 10 * w.n THEN (SELECT min(near) FROM near WHERE near.word = w.word AND near_n = most) END AS form
  FROM w LEFT JOIN best ON best.word = w.word),
chain(word, reached, step) AS (
  SELECT word, form, 1 FROM judged WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, judged.form, step + 1 FROM chain JOIN judged ON judged.word = chain.reached WHERE judged.form IS NOT NULL)
SELECT word, form, coalesce((SELECT arg_max(reached, step) FROM chain WHERE chain.word = judged.word), word) AS root, n, n_near, form_n FROM judged
"""

QUERIES = {"op12_spelling": op12_spelling}
SQL = {"op12_spelling": ORACLE}
