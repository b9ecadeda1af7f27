"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from runlens.llm import decontamination, html_text, jaccard, langid, language_model, line_dedup, pieces, quality, token_counts, url_rules
from runlens.llm.queries import tokenizer_path

LONG = " ".join(f"word{i % 9973} of text" for i in range(40_000)) + "\n" + "x" * 300_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs into the deep forest.\nA second line of this text here.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \n\t ", "fr"),
    (5, "Le petit chat mange la souris dans la maison.\nA second line of this text here.", "fr"),
    (5, "Le petit chat mange la souris dans la maison.\nA second line of this text here.", "fr"),
    (None, "Der kleine Hund spielt im Garten mit dem Ball.", "de"),
    (None, None, None),
    (6, LONG, "en"),
    (7, "123 456 !!", "en"),
    (8, "one", "en"),
]
SCHEMA = "doc_id bigint, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("score", "sim", "node", "kept", "n_tokens", "held_out", "line", "key", "words", "id", "n_lines", "piece_ids", "component_id"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df, c="doc_id"):
    return sorted((r[0] for r in df.select(c).collect()), key=str)


ALL = sorted((r[0] for r in ROWS), key=str)

PER_ROW = {
    "tokens": lambda d: token_counts.count_tokens(d, tokenizer_path()),
    "language": langid.held_out_languages,
    "quality": quality.judge_quality,
    "model": language_model.score_texts,
    "jaccard": jaccard.jaccard_components,
    "lines": line_dedup.dedup_lines,
    "pieces": lambda d: pieces.encode_pieces(d, tokenizer_path()),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_every_row_gives_one_row(name, docs, empty):
    assert ids(PER_ROW[name](docs)) == ALL
    assert ids(PER_ROW[name](empty)) == []


def test_token_counts_equal_the_library(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = sorted((str(i), len((t or "").encode()), len(model.encode(t or ""))) for i, t, _ in ROWS)
    got = token_counts.count_tokens(docs, tokenizer_path(), split_bytes=1000, batch_bytes=5000).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want


def test_language_of_texts_without_letters(docs):
    got = {(r.doc_id, r.lang_pred, r.score) for r in langid.held_out_languages(docs).where("doc_id in (2, 3, 4, 7)").collect()}
    assert got == {(i, "und", 0.0) for i in (2, 3, 4, 7)}


def test_quality_counts(docs):
    got = {r.doc_id: r for r in quality.judge_quality(docs).where("doc_id is not null").collect()}
    assert (got[2].n_words, got[2].base_failed, got[2].kept) == (0, True, False)
    assert (got[1].n_words, got[1].n_dup_lines, got[1].n_repeat_words) == (22, 0, 0)
    assert got[4].n_words == 0 and got[7].word_chars == 8


def test_components(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).where("doc_id is not null").collect()}
    assert got[2] == (0, 2) and got[3] == (0, 3) and got[8] == (1, 8) and got[5] == (12, 5)


def test_lines(docs):
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).where("doc_id is not null").collect()}
    assert got[2] == (None, 0, 0) and got[3] == ("", 1, 0)
    assert got[5] == ("Le petit chat mange la souris dans la maison.", 2, 1)
    assert got[6][0] == LONG


def test_passages(spark, docs, empty):
    items = spark.createDataFrame(
        [(1, "quick BROWN fox jumps over the lazy dog"), (2, None), (3, ""), (4, "petit chat mange"), (5, "one"), (1, "quick BROWN fox jumps over the lazy dog"), (6, "nothing of the kind is here at all")],
        "item_id bigint, text string",
    )
    got = {(r.doc_id, r.item_id) for r in decontamination.find_passages(docs, items).collect()}
    assert got == {(1, 1), (5, 4), (8, 5)}
    assert decontamination.find_passages(empty, items).count() == 0
    assert decontamination.find_passages(docs, items.limit(0)).count() == 0


def test_pieces_round_trip(docs):
    encoded = pieces.encode_pieces(docs, tokenizer_path())
    assert encoded.where("not round_trip").count() == 0
    back = pieces.decode_pieces(encoded.drop("text"), tokenizer_path())
    got = sorted((str(r.doc_id), r.text) for r in back.select("doc_id", "text").collect())
    assert got == sorted((str(i), t or "") for i, t, _ in ROWS)


PAGES = [
    (1, "https://a.example.com/en/1?x", "<html><nav>Menu</nav><article><h1>T &amp; U</h1><p>One<p>Two <b>three</b><br>four<aside>no</aside><div class='comments'>no</div></article><footer>f</footer>"),
    (2, None, None),
    (None, "no scheme", ""),
    (3, "HTTP://EXAMPLE.net/de/81#a://b", "<p>plain words alone in a page that has no article at all</p><div id=sidebar>links</div>"),
    (3, "HTTP://EXAMPLE.net/de/81#a://b", "<p>plain words alone in a page that has no article at all</p><div id=sidebar>links</div>"),
    (4, "x://example.com/en/7", "<script>if (a < b) {}</script><style>p{}</style>"),
    (5, "x://other.org/" + "/".join(map(str, range(30))), "<p>a<"),
]


def test_pages(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(pages).collect()}
    assert got[1] == ("T & U\nOne\nTwo three four", 24)
    assert got[2] == ("", 0) and got[None] == ("", 0) and got[4] == ("", 0)
    assert got[3][0] == "plain words alone in a page that has no article at all"
    urls = url_rules.judge_urls(pages).collect()
    assert len(urls) == len(PAGES)
    told = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls}
    assert told[1] == ("a.example.com", "/en/1", "com/en/", "block")
    assert told[2][:3] == ("", "", None) and told[None][:3] == ("", "", None)
    assert told[3] == ("example.net", "/de/81", "example.net/de/8", "block")
    assert told[4] == ("example.com", "/en/7", "example.com/en/7", "allow")
    assert all(r.verdict in ("allow", "block") for r in urls)
    assert html_text.extract_text(pages.limit(0)).count() == 0 and url_rules.judge_urls(pages.limit(0)).count() == 0


def test_scores(docs):
    """Base scores against brute force over the training texts; a very long text is read in pieces."""
    import math
    from collections import Counter
    from zlib import crc32

    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    counts = Counter(w for i, t, _ in ROWS if i is not None and crc32(str(i).encode()) % 10 for w in tokens(t))
    n, v = counts.total(), len(counts)
    want = sorted((str(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 2)) for i, t, _ in ROWS)
    got = language_model.score_texts(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 2)) for r in got) == want
    assert all(r.score < 0 and r.train_tokens == n for r in got)
