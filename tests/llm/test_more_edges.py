"""Edges that the other tests leave out: urls of any length, empty tables, the pipeline without documents and with null or repeated ids."""

import corpus_pipeline
from tallyspark.llm import urls

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def plain(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def judged(spark, rows):
    pages = spark.createDataFrame([(i, u, "h", 1, "k") for i, u in rows], "page_id long, url string, host string, part int, key string")
    return sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, urls.rule_frame(spark)).collect()), key=str)


def test_urls_of_any_kind(spark):
    long = "https://a." + "sub." * 2000 + "example.org/es/" + "x/" * 100_000
    rows = [
        (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://ORG"), (6, "http://org/"), (7, long), (8, "http://example.org/es/1?q=/en/1"), (9, "http://example.org/en/12"), (10, "http://notexample.org/es/"),
        (11, "ftp://x.COM/de/y#z"), (12, "http://com/fr/"), (13, "http://com"), (14, "http://É.org/é"), (15, "http://example.org./es/"), (16, "a://b://c.com/de/"), (6, "http://org/"), (17, "http://.org/"), (18, "http://x.example.org?/es/"),
    ]
    assert judged(spark, rows) == sorted(((i, *plain(u)) for i, u in rows), key=str)


def test_urls_of_an_empty_table(spark):
    assert judged(spark, []) == []


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCUMENT).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_keeps_null_and_repeated_ids(spark, tmp_path):
    words = [f"{a}{b}" for a in ("north", "south", "river", "stone") for b in ("house", "field", "wood", "bridge", "mill")]
    text = lambda k: " ".join(words[(k * 7 + j * j + k * j) % len(words)] for j in range(60))
    rows = [(k, text(k), "en", "s", 1) for k in range(1, 25)] + [(None, text(30), "en", "s", 1), (3, text(31), "en", "s", 1), (None, text(2), "en", "s", 1), (26, None, None, "s", 0)]
    spark.createDataFrame(rows, DOCUMENT).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = [r["doc_id"] for r in out if r["piece"] == 0]
    assert pieces.count(None) == 2 and set(pieces) <= {r[0] for r in rows} and pieces.count(3) >= 1
