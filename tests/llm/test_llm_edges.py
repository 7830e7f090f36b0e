"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import ann, bpe, language, licenses, media, minhash, packing, pii, suffixes, urls
from tallyspark.llm.components import star_components

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, rejected int, score int, h1 int, h int, key int, part int, copy int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", len(t or ""), "a", "b", 1, 2, 3, 4, 5, 6, 7) for i, t, x in rows], SCHEMA)


@pytest.fixture(scope="module")
def edge_rows():
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(4000))
    base = long[:3000]
    return [
        (1, base, "en"), (2, base, "en"), (2, base, "en"), (3, base[:1500] + " inserted words here " + base[1500:], "en"), (4, None, "en"), (5, "", None), (6, "   \n\t ", "fr"),
        (7, "word", "fr"), (8, "word", "fr"), (None, base, "en"), (9, long, "en"), (10, "é" * 300 + base[100:200], "de"), (11, "12345 !!!", None), (12, base[200:260] * 4, "de"),
        (13, "Released under the MIT License.\nmail a.b@c.example.com or +1 (017) 555-7713, 10.0.0.255 and 4539 1488 0343 6467", "en"), (14, "x" * 60000, "en"), (15, "日本語のテキスト 🙂 " * 30, "ja"),
    ]


@pytest.fixture(scope="module")
def edges(spark, edge_rows):
    return documents(spark, edge_rows).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark, [])


OPERATORS = {
    "pii": pii.span_digests, "licenses": licenses.scan_licenses, "minhash": minhash.near_duplicates, "media": media.media_digests, "bpe": bpe.token_digests,
    "encode": bpe.encode_documents, "suffixes": suffixes.repeat_digests, "without_repeats": suffixes.without_repeats, "packing": packing.pack_documents, "sanitise": pii.sanitise,
    "language": lambda d: language.predict_languages(d, language.fit_languages(d)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edges_keep_rows(edges, edge_rows, name):
    rows = OPERATORS[name](edges).collect()
    if name == "packing":
        rows = [r for r in rows if r["piece"] == 0]
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _, _ in edge_rows)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(nothing, name):
    assert OPERATORS[name](nothing).collect() == []


def test_near_duplicates_equal_brute_force(edges, edge_rows):
    for shingle in (2, 5):
        want = brute.near_components([(i, t) for i, t, _ in edge_rows if i is not None], shingle)
        for r in minhash.near_duplicates(edges, shingle=shingle).collect():
            if r["doc_id"] is None:
                assert r["component_id"] is None or r["kept"] in (True, False)
            else:
                assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], want[r["doc_id"]][1] == r["doc_id"])


def test_chains_and_families_equal_brute_force(spark):
    rng = random.Random(8)
    rows, n = [], 0
    for family in range(6):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
        for _ in range(25):
            n += 1
            rows.append((n, " ".join(w), "en"))
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(60)] = f"v{rng.randint(0, 10**6)}"
    want = brute.near_components([(i, t) for i, t, _ in rows], 2)
    old, minhash.BLOCK = minhash.BLOCK, 8
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(documents(spark, rows), shingle=2).collect()}
    finally:
        minhash.BLOCK = old
    assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(500, 500)]
    got = {r["u"]: r["v"] for r in star_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 100 for k in range(101, 161)} | {k: 1 for k in range(2, 40)}


@pytest.mark.parametrize(("shard", "hot", "bucket", "unit"), [(30_000, 250_000, 2_000_000, 400_000), (5, 250_000, 300, 20), (5, 3, 300, 20)])
def test_repeats_equal_brute_force(spark, edges, edge_rows, monkeypatch, shard, hot, bucket, unit):
    """In one array, in several of a shard, and over shards."""
    for name, value in (("SHARD_CONTEXTS", shard), ("HOT_ANCHOR", hot), ("BUCKET_ANCHORS", bucket), ("UNIT_CONTEXTS", unit)):
        monkeypatch.setattr(suffixes, name, value)
    want = brute.repeats([(i, t) for i, t, _ in edge_rows if i is not None and i != 14])
    for r in suffixes.repeat_digests(edges.filter("doc_id is null or doc_id != 14")).collect():
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]


@pytest.mark.parametrize("order", ["descending", "shuffled"])
def test_repeats_do_not_depend_on_the_order_of_copies(spark, order):
    """Several copies of a text in one task, the least id last or anywhere; each shares passages with others."""
    rng = random.Random(21)
    prose = lambda: "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = []
    for k in range(0, 60, 6):
        first, shared, last = prose(), prose(), prose()
        text = first + shared + last
        rows += [(1000 + k, text, "en"), (3 + k, text, "en"), (500 + k, text, "en"), (1 + k, prose() + first, "en"), (700 + k, prose() + shared, "en")]
    rows.sort(reverse=True)
    if order == "shuffled":
        rng.shuffle(rows)
    want = brute.repeats([(i, t) for i, t, _ in rows])
    got = suffixes.repeat_digests(documents(spark, rows).coalesce(1)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_hot_anchors_are_split_by_their_contexts(spark, monkeypatch):
    """A passage in most documents: anchors over the limit are known by value, and groups hold distinct contexts only."""
    rng = random.Random(22)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = prose(200)
    rows = [(k, prose(80) + passage[: rng.randint(100, 200)] + prose(60), "en") for k in range(90)]
    monkeypatch.setattr(suffixes, "HOT_ANCHOR", 20)
    seen = {}
    plain = suffixes.hot_contexts

    def watched(contexts, hot):
        seen["hot"] = {r["anchor"] for r in hot.collect()}
        seen["met"] = {r["anchor"]: r["n"] for r in contexts.select("anchor", (F.length("who") / 20).cast("int").alias("k")).groupBy("anchor").agg(F.sum("k").alias("n")).collect()}
        out = plain(contexts, hot)
        seen["rows"], seen["columns"] = [(r["anchor"], bytes(r["context"])) for r in out.collect()], out.columns
        return out

    monkeypatch.setattr(suffixes, "hot_contexts", watched)
    got = suffixes.repeat_digests(documents(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute.repeats([(i, t) for i, t, _ in rows])
    assert seen["hot"] == {a for a, n in seen["met"].items() if n > 20} and seen["hot"]
    assert len(set(seen["rows"])) == len(seen["rows"]) < sum(seen["met"][a] for a in seen["hot"]) / 2 and "who" not in seen["columns"]


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(texts), np.uint8)
    order, inverse = suffixes.suffix_array(data, starts, lengths)
    where = [(t[k:], i) for i, t in enumerate(texts) for k in range(len(t))]
    assert [where[k] for k in order] == sorted(where)
    prefix = suffixes.common_prefixes(data, starts, lengths, order, inverse)
    for r in range(1, len(order)):
        a, b = where[order[r - 1]][0], where[order[r]][0]
        assert prefix[r] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_base_spans_on_random_texts():
    rng = random.Random(2)
    for _ in range(20000):
        t = "".join(rng.choice("aA0123456789..--@@  ++()é%_") for _ in range(rng.randint(0, 60)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)] == brute.base_spans(t)


def test_base_spans_are_linear():
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "@" + "." * 1000) == []


def test_disclosing_words_go_only_where_the_entity_is(spark):
    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choice("mnopqr") for _ in range(5)) for _ in range(30))
    rows = [(k, f"{prose()} zebrafish keeper zk.01@mail1.example.com {prose()}", "en") for k in range(12)] + [(100 + k, prose() + " keeper " + prose(), "en") for k in range(200)] + [(400, "zebrafish alone", "en")]
    got = {r["doc_id"]: r for r in pii.span_digests(documents(spark, rows)).collect()}
    assert all("removed:" in got[k]["spans"] for k in range(12)) and all(got[k]["spans"] == "" for k in [*range(100, 300), 400])
    text = {r["doc_id"]: r["text"] for r in pii.sanitise(documents(spark, rows)).collect()}
    assert "zebrafish" not in text[3] and "[EMAIL]" in text[3] and "keeper" in text[3] and text[400] == "zebrafish alone"


def test_disclosing_words_are_found_in_whole_texts(spark):
    """A name paragraphs away from the address goes with all its occurrences; counts of windows would not reach it."""
    rng = random.Random(33)
    prose = lambda n: " ".join("".join(rng.choice("mnopqr") for _ in range(5)) for _ in range(n))
    rows = [(k, f"Zebrafish {prose(60)}\n\n{prose(60)} mail zk.01@mail1.example.com {prose(40)} zebrafish, {prose(3)}", "en") for k in range(12)]
    rows += [(100 + k, prose(60), "en") for k in range(200)] + [(k, f"{prose(50)} 10.0.0.{k - 300} {prose(50)} Zebrafish", "en") for k in range(300, 302)]
    text = {r["doc_id"]: r["text"] for r in pii.sanitise(documents(spark, rows)).collect()}
    spans = {r["doc_id"]: r["spans"] for r in pii.span_digests(documents(spark, rows)).collect()}
    for k in range(12):
        assert "zebrafish" not in text[k].lower() and spans[k].count("removed:") + spans[k].count("generalised:") >= 2
    assert all(text[k] == t for k, t, _ in rows if 100 <= k < 300)


def test_entities_count_without_words_beside_them(spark):
    """Texts in which only numbers stand by the entity count for it too."""
    rows = [(k, f"{k} 1 2 10.0.0.7 3 4", "en") for k in range(6)] + [(10, "word 10.0.0.7 word", "en"), (11, "word", "en")]
    counts = {r["entity"]: r["n_entity"] for r in pii.entity_counts(pii.find_base(documents(spark, rows), "doc_id", "text")).collect()}
    assert counts == {"1:10.0.0.7": 7}


def test_language_rejects_what_has_no_letters(edges):
    got = {r["doc_id"]: r for r in language.predict_languages(edges, language.fit_languages(edges)).collect()}
    for k in (4, 5, 6, 11):
        assert (got[k]["lang_pred"], got[k]["score"], got[k]["rejected"]) == ("und", 0.0, True)
    assert got[15]["lang_pred"] != "und"


def test_prediction_does_not_depend_on_the_batch():
    model = language.train([b"the cat and the dog", b"le chat et le chien"] * 30, ["en", "fr"] * 30)
    texts = [b"the dog", b"le chien", b"a", b"the cat and le chat"]
    assert np.array_equal(model.logits(texts), np.concatenate([model.logits([t]) for t in texts]))


def test_bpe_on_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY)), bpe.encoder()
    rng = random.Random(5)
    texts = ["", "<|endoftext|>x<|startoftext|> ", "a" * 3000, "\x1c\x1d a\x85b\u2028c", "ΑΣ ΣΑΣ İ", "a\u0301 e\u0301 ＡＢＣ", "\u1c89 \u0378", "don't we'll 12 3.5 $%^ 漢字🙂</w>"]
    texts += ["".join(rng.choice("aaabcdeéß'<|>endoftext </w>0123 \n\tİΣ漢🙂\u0301") for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(6)
    lengths = np.minimum(rng.lognormal(6, 1.2, 5000).astype(int) + 1, 4096)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan = packing.plan_packing(histogram)
    back = {}
    for many, slots in plan:
        assert sum(n * m for n, m in slots) <= 4096
        for n, m in slots:
            back[n] = back.get(n, 0) + many * m
    assert back == histogram and sum(g for g, _ in plan) <= -(-int(lengths.sum()) // 4096) * 1.02 + 1


def test_nnls():
    rng = np.random.default_rng(2)
    a, x = rng.random((20, 8)), np.maximum(rng.normal(size=8), 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    worse = packing.nnls(a, -np.ones(20))
    assert (worse == 0).all()


def test_vectors_that_take_no_part(spark):
    rows = [(k, [float(k % 3), 1.0]) for k in range(60)] + [(60, None), (61, []), (62, [0.0, 0.0]), (63, [float("nan"), 1.0]), (64, [None, 1.0]), (65, [float("inf"), 1.0]), (80, [1.0]), (None, [1.0, 1.0]), (0, [0.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=5).collect()
    assert {r["query_id"] for r in got} == {0, 20, 40}
    for q in (0, 20, 40):
        own = [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        score = {k: (k % 3) * (q % 3) + 1.0 for k in range(60) if k != q}
        assert own == sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]
    few = ann.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in few] == [(1, 1)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).collect() == []


def test_full_leaves_are_cut_and_other_columns_are_not_read(spark, monkeypatch):
    for name in ("SHARD", "BLOCK", "ASK_BYTES"):
        monkeypatch.setattr(ann, name, 7)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(150, 4)), np.tile(rng.normal(size=4), (50, 1))])
    rows = [(k, v.tolist(), k, "x", 1) for k, v in enumerate(x)]
    vectors = spark.createDataFrame(rows + rows[:20], "vec_id long, embedding array<double>, id long, leaf string, shard int")
    got = ann.nearest(vectors, F.col("vec_id") % 10 == 0, k=5, recall=1.01).toPandas()  # every leaf is visited
    assert len(got) == 20 * 5
    for q, own in got.groupby("query_id"):
        exact = x @ x[q]
        exact[q] = -np.inf
        assert own.sort_values("rank").vec_id.tolist() == np.lexsort((np.arange(200), -np.round(exact, 12)))[:5].tolist()
    first, parts = ann.shards_of([3, 4, 1, 20, 0, 2], 7)
    assert first.tolist() == [0, 0, 1, 2, 5, 5] and parts.tolist() == [1, 1, 1, 3, 1, 1]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://A.Example.org/es/1?q#f", ("a.example.org", "/es/1", "example.org/es/", "block")), ("https://example.org", ("example.org", "", None, "allow")),
        ("https://example.org/en/12", ("example.org", "/en/12", "example.org/en/1", "block")), ("x://notexample.org/es/", ("notexample.org", "/es/", "org/", "allow")),
        ("http://b.com/de/x", ("b.com", "/de/x", "com/de/", "block")), ("http://org:80/a", ("org:80", "/a", None, "allow")), ("no scheme", ("", "", None, "allow")),
        (None, ("", "", None, "allow")), ("a://b://c.org/x", ("b:", "//c.org/x", None, "allow")), ("http://x.net?u=://example.org/es/", ("x.net", "", None, "allow")),
    ],
)
def test_urls(spark, url, want):
    rows = spark.createDataFrame([(1, url, "k"), (1, url, "k")], "page_id long, url string, key string")
    assert [tuple(r)[1:] for r in urls.judge_urls(rows, urls.rule_frame(spark)).collect()] == [want, want]


def test_url_filter_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = urls.judge_urls(pages, urls.rule_frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_archive_members_are_retried_alone(tmp_path):
    archive = media.Archive(f"file://{tmp_path}")
    for k in range(5):
        archive.add(f"{k}/{k}.png", media.to_png(b"text %d" % k))
    uri, size, _ = archive.close()
    system, path = media.opened(uri)
    fails = {"left": 2}

    class Flaky:
        def __init__(self):
            self.file = system.open_input_file(path)

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            if n > 30 and fails["left"]:
                fails["left"] -= 1
                raise OSError("lost")
            return self.file.read(n)

        def close(self):
            self.file.close()

    found = list(media.members(uri, 0, size, Flaky))
    assert [media.from_png(data)[0].rstrip(b"\0") for _, _, data in found] == [b"text %d" % k for k in range(5)]
    offsets = [o for _, o, _ in found]
    parts = [list(media.members(uri, a, b)) for a, b in ((0, offsets[2]), (offsets[2], size))]
    assert [len(p) for p in parts] == [2, 3]


def test_archive_directory_source(spark, tmp_path):
    archive = media.Archive(f"file://{tmp_path}/a")
    archive.add("1/0.png", media.to_png(b"x"))
    archive.close()
    spark.dataSource.register(media.ArchiveSource)
    rows = spark.read.format("archive_members").option("rangeBytes", 50).load(f"file://{tmp_path}").collect()
    assert len(rows) == 1 and media.from_png(bytes(rows[0]["data"])) == (b"x".ljust(64, b"\0"), 1)


def test_licenses(edges):
    got = {r["doc_id"]: (r["license"], r["n_passages"]) for r in licenses.scan_licenses(edges).collect()}
    assert got.pop(13) == ("mit", 1) and set(got.values()) == {(None, 0)}


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_license_notices_over_lines_and_paragraphs(spark):
    """Each template hard-wrapped, in a comment and among prose, and the Apache header as it is published."""
    prose = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon."
    rows, want = [(0, f"{prose}\n\n{APACHE}\n\n{prose}", "en"), (1, f"{prose} {' '.join(APACHE.split())} {prose}", "en")], {0: "apache-2.0-header", 1: "apache-2.0-header"}
    for name, text in licenses.TEMPLATES:
        for width in (24, 60):
            wrapped = textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False)
            for made in ("\n".join(wrapped), f"{prose}\n" + "\n".join(f" * {x}" for x in wrapped) + f"\n{prose}", f"{prose} " + "\n".join(wrapped) + ("" if text.endswith(".") else "\n") + f" {prose}"):
                want[len(rows)] = name
                rows.append((len(rows), made, "en"))
    rows.append((999, "The license\nof this software\nis not known.", "en"))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    assert {k: got[k]["license"] for k in want} == want and got[999]["license"] is None
    assert all(got[k]["dice"] > 0.95 and got[k]["n_passages"] >= 1 for k in want)


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """Each stage on what the one before kept; language, near copies, passages, personal data and tokens."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    texts = [prose(80) for _ in range(60)]
    texts += [texts[0], texts[1] + " tail", f"{prose(20)} {passage} {prose(20)}", f"{prose(20)} {passage} {prose(20)}", None, "123 456", f"{prose(30)} a.b@c.example.com {prose(30)}"]
    rows = documents(spark, [(k, t, "en" if k % 2 else "fr") for k, t in enumerate(texts)])
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stage = [docs]
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage.append(f(spark, stage[-1], str(tmp_path)).cache())
        assert stage[-1].columns == docs.columns
    kept = [{r["doc_id"]: r["text"] for r in s.collect()} for s in stage]
    assert set(kept[0]) - set(kept[1]) == {64, 65}
    want = brute.near_components(list(kept[1].items()), 5)
    assert set(kept[2]) == {i for i, (_, c) in want.items() if c == i} and not {60, 61} & set(kept[2])
    mask = brute.repeat_mask(list(kept[2].items()))
    assert kept[3] == {i: bytes(x for x, gone in zip(b, c) if not gone).decode() for i, (b, c) in mask.items()}
    assert kept[3][62].count(passage) == 1 and passage[10:-10] not in kept[3][63]
    assert kept[4][66] == kept[3][66].replace("a.b@c.example.com", "[EMAIL]") and {i: t for i, t in kept[4].items() if i != 66} == {i: t for i, t in kept[3].items() if i != 66}
    assert all(r["n_chars"] == len(r["text"]) for r in stage[4].collect())
    e = bpe.encoder()
    for i, t in kept[4].items():
        ids = np.array([*e.encode(t), 1], "<u4")
        assert got[got.doc_id == i].ids_crc32.tolist() == [zlib.crc32(ids.tobytes())]
    assert set(got.doc_id) == set(kept[4])


def test_digest_helper():
    assert pii.digest([(0, 1, 2), (3, 4, 5)]) == hashlib.sha256(b"email:1:2,phone:4:5").hexdigest()


def test_groups_and_secrets(spark):
    """Words that only go with one domain, though each address is seen once; keys and tokens; what merely looks like one."""
    rng = random.Random(34)
    prose = lambda n: " ".join("".join(rng.choice("mnopqr") for _ in range(5)) for _ in range(n))
    rows = [(k, f"{prose(30)} Zebrafish {prose(30)} write to u{k}.x@zoo.example.com {prose(10)}", "en") for k in range(12)] + [(100 + k, prose(60) + f" w{k}@other{k}.example.org", "en") for k in range(150)]
    rows += [(400, 'token = "ab59b03a9d0189cc1ff5513a5b496212436c9d01" é', "en"), (401, "path: aaaaaaaaaaaaaaaaaaaaaaaa1112 and x = abcdefghijklmnopqrstuvwxyz", "en")]
    got = {r["doc_id"]: r["spans"] for r in pii.span_digests(documents(spark, rows)).collect()}
    text = {r["doc_id"]: r["text"] for r in pii.sanitise(documents(spark, rows)).collect()}
    for k in range(12):
        a = rows[k][1].index("Zebrafish")
        assert f"removed:{a}:{a + 9}" in got[k] and "Zebrafish" not in text[k]
    assert all("removed" not in got[k] and "generalised" not in got[k] for k in range(100, 250))
    assert got[400] == "removed:9:49" and text[400] == 'token = "" é' and got[401] == "" and text[401] == rows[-1][1]
    for e in ("0:a.b@c.example.com", "1:10.0.0.7", "2:4539148803436467", "3:10175557713"):
        made = spark.createDataFrame([(e,)], "e string").select(pii.with_groups(F.array("e")).alias("g")).first()["g"]
        assert made == [e, pii.group_of(e)]


def test_many_spans_take_time_in_proportion(spark):
    text = " ".join(f"word 10.{k >> 8 & 255}.{k & 255}.7 u{k}@m.example.com" for k in range(25_000))
    rows = pii.span_digests(documents(spark, [(1, text, "en")])).collect()
    assert (rows[0]["n_ip"], rows[0]["n_email"]) == (25_000, 25_000)


def test_several_texts_of_one_id_are_judged_row_by_row(spark):
    """A text that no other row has stays, though its id also stands on a copy."""
    rows = [(1, "a b c d e f g", "en"), (2, "a b c d e f g", "en"), (2, "x y z u v w", "en"), (None, "a b c d e f g", "en"), (3, None, "en")]
    docs = documents(spark, rows)
    got = sorted((r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, shingle=2).collect() if r["doc_id"] == 2)
    assert got == [(5, 2, True), (6, 1, False)]
    assert {(r["doc_id"], r["text"]) for r in minhash.without_near_duplicates(docs, shingle=2).collect()} == {(i, t) for i, t, _ in rows} - {(2, "a b c d e f g")}
