"""Language of texts by word-first backoff (operator 9)."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_bytes, column
from .workspace import crc32_of_id

# Word characters that are neither letters nor decimal digits, such as fractions and Roman or circled numbers.
_NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
LETTERS = re.compile(rf"[^\W\d_{_NUMERALS}]+")
# With the numerals, which one class can tell by category alone; the sets of LETTERS are gone through for every character.
_RUNS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Bounds of the fitted model: labelled texts in the sample, known words, known character n-grams, and their length.
SAMPLE_DOCS, MOST_WORDS, MOST_GRAMS, LONGEST_GRAM = 10_000, 100_000, 100_000, 5
#: Words that count as evidence for a posterior at most.
MOST_EVIDENCE = 10
#: Unseen words whose scores a worker remembers.
WORDS_KEPT = 200_000


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between its boundary marks."""
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def letter_runs(text: str) -> list[str]:
    """The runs of letters, as LETTERS finds them, which cuts only runs that hold numerals."""
    found = _RUNS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [word for run in found for word in ([run] if run.isalpha() else LETTERS.findall(run))]


@dataclass
class LanguageModel:
    """Log frequencies per language of words and of character n-grams; its size is bounded by the fit's parameters."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_scores: np.ndarray
    gram_scores: np.ndarray
    unseen: dict[str, np.ndarray] = field(default_factory=dict)

    def backoff(self, word: str) -> np.ndarray:
        """Scores of an unseen word: the mean over its longest n-grams of which the model knows any; else nothing."""
        for n in range(min(LONGEST_GRAM, len(word) + 2), 0, -1):
            rows = [self.grams[g] for g in grams(word, n) if g in self.grams]
            if rows:
                return self.gram_scores[rows].mean(axis=0)
        return np.zeros(len(self.languages))

    def scores(self, text: str) -> tuple[np.ndarray, int] | None:
        """Mean of the word scores per language and the number of words; None for a text without letters."""
        words = letter_runs(text.lower())
        if not words or not self.languages:
            return None
        rows, total = [], np.zeros(len(self.languages))
        known, unseen = self.words, self.unseen
        for w in words:
            row = known.get(w)
            if row is not None:
                rows.append(row)
            else:
                own = unseen.get(w)
                if own is None:
                    if len(unseen) >= WORDS_KEPT:
                        unseen.clear()
                    own = unseen[w] = self.backoff(w)
                total += own
        if rows:
            total = total + self.word_scores[rows].sum(axis=0)
        return total / len(words), len(words)

    def predict(self, text: str | None) -> tuple[str, float]:
        """A language and its posterior, with even priors and the evidence of a text weighted as that of ten words at most."""
        found = self.scores(text or "")
        if found is None:
            return UNKNOWN, 0.0
        mean, words = found
        weight = np.exp((mean - mean.max()) * min(words, MOST_EVIDENCE))
        weight /= weight.sum()
        best = int(weight.argmax())
        return self.languages[best], float(weight[best])


def _counts(texts: DataFrame, text: str, lang: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text):
            found: Counter = Counter()
            for t, language in zip(column(batch, text).to_pylist(), column(batch, lang).to_pylist(), strict=True):
                for word, c in Counter(letter_runs((t or "").lower())).items():
                    found[language, 0, word] += c
                    for n in range(1, LONGEST_GRAM + 1):
                        for g in grams(word, n):
                            found[language, n, g] += c
            if found:
                languages, sizes, units = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(languages, pa.string()), pa.array(sizes, pa.int32()), pa.array(units, pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "n", "unit", "c"])

    return texts.select(text, lang).mapInArrow(run, "lang string, n int, unit string, c bigint").groupBy("lang", "n", "unit").agg(F.sum("c").alias("c"))


def fit_language_model(labelled: DataFrame, text: str = "text", lang: str = "lang", id_: str = "doc_id", sample_docs: int = SAMPLE_DOCS, most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS) -> LanguageModel:
    """Fits on a bounded sample of labelled rows: about sample_docs of them, chosen by a hash of the id.

    Rows without text or language teach nothing. At most most_words words and, for each length, most_grams n-grams are kept: those with
    at least their share of all occurrences, which bounds their number.
    """
    labelled = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    n = labelled.count()
    if not n:
        return LanguageModel([], {}, {}, np.zeros((0, 0)), np.zeros((0, 0)))
    if n > sample_docs:
        labelled = labelled.where(F.pmod(F.xxhash64(F.col(id_)), F.lit(1_000_000)) < int(1_000_000 * sample_docs / n))
    counts = _counts(labelled, text, lang).persist()
    totals = {(r["lang"], r["n"]): r["c"] for r in counts.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect()}
    languages = sorted({language for language, _ in totals})
    sums = counts.groupBy("n").agg(F.sum("c").alias("all"))
    units = counts.groupBy("n", "unit").agg(F.sum("c").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("by"))
    enough = F.greatest(F.lit(2.0), F.col("all") / F.when(F.col("n") == 0, most_words).otherwise(most_grams))
    rows = units.join(F.broadcast(sums), "n").where(F.col("total") >= enough).select("n", "unit", "by").collect()
    counts.unpersist()
    at = {language: i for i, language in enumerate(languages)}
    words, chars, word_rows, gram_rows = {}, {}, [], []
    base = {n: np.array([totals.get((language, n), 0) for language in languages], float) for n in range(LONGEST_GRAM + 1)}
    kinds = Counter(r["n"] for r in rows)
    for r in sorted(rows, key=lambda r: (r["n"], r["unit"])):
        c = np.full(len(languages), 0.1)
        for language, k in r["by"].items():
            c[at[language]] += k
        score = np.log(c / (base[r["n"]] + 0.1 * (kinds[r["n"]] + 1)))
        if r["n"] == 0:
            words[r["unit"]] = len(word_rows)
            word_rows.append(score)
        else:
            chars[r["unit"]] = len(gram_rows)
            gram_rows.append(score)
    shape = (-1, len(languages))
    return LanguageModel(languages, words, chars, np.array(word_rows).reshape(shape), np.array(gram_rows).reshape(shape))


def predict_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns of docs, then lang_pred and score (0 to 1); columns of these names are replaced.

    Whole texts are scored. A null text, or one without letters, is `und` with score 0. Ties go to the first language in
    order of name. Every row gives one row.
    """
    new = ("lang_pred", "score")
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in new])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in by_bytes(batches, text):
            found = [fitted.predict(t) for t in column(batch, text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*batch.schema.names, *new])

    return docs.mapInArrow(run, schema)


def held_out_languages(docs: DataFrame, folds: int = 5, text: str = "text", lang: str = "lang", id_: str = "doc_id") -> DataFrame:
    """Fits on documents whose crc32(id) mod folds is not 0 and predicts all: id, held_out, lang_pred, score.

    A row with a null id belongs to no fold: held_out is null and it is not learned from.
    """
    fold = F.pmod(crc32_of_id(F.col(id_)), F.lit(folds))
    model = fit_language_model(docs.where(fold != 0), text, lang, id_)
    return predict_language(docs.select(id_, (fold == 0).alias("held_out"), text), model, text).select(id_, "held_out", "lang_pred", "score")
