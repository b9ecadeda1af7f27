"""Counts and learned models against brute force, the library and held-out labels."""

import random
import re

import numpy as np

from runlens.llm import langid, pieces, quality
from runlens.llm.queries import tokenizer_path

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def test_counts_of_quality_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in quality.judge_quality(docs).collect()}
    for r in docs.collect():
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows: dict = {}
        for i in range(len(words) - 4):
            windows.setdefault(tuple(words[i : i + 5]), []).append(i)
        repeated = {i + k for own in windows.values() if len(own) > 1 for i in own for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        own = got[r.doc_id]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words) == want
        assert own.base_failed == (len(words) < 10 or 100 * len(repeated) > 20 * len(words)) and not (own.kept and own.base_failed)


def test_em_finds_the_better_rules():
    """Votes of five rules of known accuracy about texts of which seven tenths are good."""
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.9, 0.7, 0.6, 0.55])
    votes = np.where(rng.random((20_000, 5)) < right, good[:, None], ~good[:, None]) * 2 - 1
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = quality.posterior_by_em(patterns, counts.astype(float))[at.ravel()]
    majority = votes.sum(axis=1) > 0
    assert ((p >= 0.5) == good).mean() > max(0.93, (majority == good).mean())
    assert abs(p.mean() - 0.7) < 0.05


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(DOCUMENTS)
    found = langid.held_out_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    right, n = found.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert n > 150 and right / n > 0.98


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "½ ² ① Ⅷ 12", None), (4, "12the½", None)], "doc_id bigint, text string, lang string")
    model = langid.fit_language_model(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_language(docs, model).collect()}
    assert got[3] == ("und", 0.0) and got[4][0] == "en" and got[1][0] == "en" and got[2][0] == "fr"


def test_only_runs_with_numerals_are_cut(monkeypatch):
    seen, whole = [], langid.LETTERS

    class Watched:
        def findall(self, text):
            seen.append(text)
            return whole.findall(text)

    monkeypatch.setattr(langid, "LETTERS", Watched())
    model = langid.LanguageModel(["x"], {}, {}, np.zeros((0, 1)), np.zeros((0, 1)))
    text = "Plain wörds_of 12 letters\u4e00 " * 100 + "a\u00bdb\u2160c \u2460"
    assert model.scores(text)[1] == len(whole.findall(text.lower()))
    assert seen == ["a\u00bdb\u2170c", "\u2460"]


def test_ids_equal_the_library(spark):
    import sentencepiece

    rng = random.Random(8)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    texts = [r.text or "" for r in spark.read.parquet(DOCUMENTS).select("text").limit(300).collect()]
    texts += ["".join(rng.choice("ab eé▁ \n\t0.,-_漢x") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    got = {r.doc_id: list(r.piece_ids) for r in pieces.encode_pieces(docs, tokenizer_path()).collect()}
    assert [got[i] for i in range(len(texts))] == library.encode(texts)
