"""Quality of texts by weak supervision (operator 4): rules vote or abstain, EM weighs them, a posterior decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import SPACE, by_bytes, column, flat, shingle_hashes, word_hashes
from .workspace import Workspace

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
LETTER_BYTES = np.zeros(256, bool)
LETTER_BYTES[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True

#: Words in a window that may repeat; rounds of EM at most, and the change at which it stops.
WINDOW, ROUNDS, CHANGE = 5, 200, 1e-9
#: Share of right votes that a rule is taken to have beforehand, and the weight of that as a share of all rows.
PRIOR_RIGHT, PRIOR_WEIGHT = 0.8, 0.01
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters", "n_bytes", "n_distinct", "n_lines", "longest_word")


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that occur twice or more in the text, the first occurrence included."""
    if len(words) < window:
        return 0
    runs = shingle_hashes(words, window)
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(runs), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    change = np.zeros(len(words) + 1, np.int64)
    change[:-window] += again
    change[window:] -= again
    return int((np.cumsum(change)[:-1] > 0).sum())


def text_counts(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Per row: id and the counts that the rules read; a null text counts as empty. One row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text):
            texts = column(batch, text)
            data, offsets = flat(texts)
            words, first = word_hashes(data, offsets, lower=False)

            def per_text(flag: np.ndarray, offsets: np.ndarray = offsets) -> np.ndarray:
                total = np.zeros(len(flag) + 1, np.int64)
                np.cumsum(flag, out=total[1:])
                return np.diff(total[offsets])

            inside = ~SPACE[data]
            found = {
                "n_words": np.diff(first),
                "word_chars": per_text(inside & ((data & 0xC0) != 0x80)),
                "n_symbols": per_text(SYMBOLS[data]),
                "n_letters": per_text(LETTER_BYTES[data]),
                "n_bytes": per_text(inside),
            }
            dup, lines_of, repeat, distinct, longest = [], [], [], [], []
            raw = data.tobytes()
            for i in range(len(texts)):
                own = raw[offsets[i] : offsets[i + 1]]
                lines = [x for x in own.split(b"\n") if x.strip()]
                dup.append(len(lines) - len(set(lines)))
                lines_of.append(len(lines))
                w = words[first[i] : first[i + 1]]
                repeat.append(repeated_words(w))
                distinct.append(len(np.unique(w)))
                longest.append(max(map(len, own.split()), default=0))
            found |= {"n_dup_lines": dup, "n_repeat_words": repeat, "n_distinct": distinct, "n_lines": lines_of, "longest_word": longest}
            yield pa.RecordBatch.from_arrays([column(batch, id_), *[pa.array(found[c], pa.int64()) for c in COUNTS]], [id_, *COUNTS])

    fields = ", ".join(f"{c} bigint" for c in COUNTS)
    return docs.select(id_, text).mapInArrow(run, f"`{id_}` {docs.schema[id_].dataType.simpleString()}, {fields}")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def default_rules() -> dict[str, Column]:
    """Rules over the counts: 1 votes for a text, -1 against it, 0 abstains. A text without words gets a vote from the first only."""
    n, c = F.col("n_words"), F.col
    some = n >= 1
    return {
        "length": _vote(n >= 40, n < 10),
        "word_length": _vote(some & c("word_chars").between(3 * n, 10 * n), some & ((c("word_chars") < 2 * n) | (c("word_chars") > 15 * n))),
        "symbols": _vote(some & (50 * c("n_symbols") <= n), 10 * c("n_symbols") > n),
        "repeated_lines": _vote((c("n_lines") >= 2) & (c("n_dup_lines") == 0), 2 * c("n_dup_lines") > c("n_lines")),
        "repeated_words": _vote((n >= 40) & (20 * c("n_repeat_words") <= n), 5 * c("n_repeat_words") > n),
        "letters": _vote(some & (100 * c("n_letters") >= 93 * c("n_bytes")), 4 * c("n_letters") < 3 * c("n_bytes")),
        "longest_word": _vote(some & (c("longest_word") <= 40), c("longest_word") > 200),
        "vocabulary": _vote((n >= 40) & (c("n_distinct") * 10 >= n * 3), (n >= 40) & (c("n_distinct") * 10 < n)),
    }


def posterior_by_em(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, change: float = CHANGE) -> np.ndarray:
    """Probability that a text of each vote pattern is good, by EM over the patterns and their counts.

    A rule has two accuracies, the shares of its votes that are right on good and on bad texts; an abstention says
    nothing. They are estimated without labels; a weak prior takes rules for right in PRIOR_RIGHT of their votes, which
    fixes which class is the good one. The start is the share of votes for the text. Without rows the result is empty.
    """
    if not len(patterns):
        return np.zeros(0)
    up, down = (patterns == 1).astype(float), (patterns == -1).astype(float)
    p = (up.sum(axis=1) + 1) / (up.sum(axis=1) + 3 * down.sum(axis=1) + 2)
    weight = PRIOR_WEIGHT * counts.sum()
    for _ in range(rounds):
        good, bad = counts * p, counts * (1 - p)
        right_good = (good @ up + PRIOR_RIGHT * weight) / (good @ (up + down) + weight)
        right_bad = (bad @ down + PRIOR_RIGHT * weight) / (bad @ (up + down) + weight)
        odds = np.log((good.sum() + 1) / (bad.sum() + 1)) + up @ np.log(right_good / (1 - right_bad)) + down @ np.log((1 - right_good) / right_bad)
        new = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        done = np.max(np.abs(new - p)) < change
        p = new
        if done:
            break
    return p


def judge_quality(docs: DataFrame, text: str = "text", id_: str = "doc_id", rules: dict[str, Column] | None = None, least: float = 0.5) -> DataFrame:
    """Per row: id, the counts of its whole text, base_failed, the posterior and kept (posterior of `least` or more).

    Texts are read once; their counts are written to the shared folder. Votes of all rows are counted by pattern: with r
    rules there are 3**r patterns at most, whatever the input, so EM and the posteriors fit the driver. A row that fails
    the base rules (n_words < 10, or 100 * n_repeat_words > 20 * n_words) is not kept. Null and empty texts have counts of
    0 and fail; rows with equal or null ids are judged one by one; an empty table gives an empty result.
    """
    rules = rules or default_rules()
    names = [f"vote_{r}" for r in rules]
    counted = Workspace(docs.sparkSession).keep(text_counts(docs, text, id_), "text-counts")
    voted = counted.withColumns(dict(zip(names, rules.values(), strict=True)))
    found = voted.groupBy(*names).count().collect()
    patterns = np.array([[r[n] for n in names] for r in found], dtype=int).reshape(-1, len(names))
    p = posterior_by_em(patterns, np.array([r["count"] for r in found], float))
    code = sum((F.col(n) + 1) * 3**i for i, n in enumerate(names))
    codes = ((patterns + 1) * 3 ** np.arange(len(names))).sum(axis=1)
    known = docs.sparkSession.createDataFrame([(int(c), float(x)) for c, x in zip(codes, p, strict=True)], "pattern int, posterior double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        voted.withColumn("pattern", code.cast("int"))
        .join(F.broadcast(known), "pattern")
        .select(id_, *COUNTS[:5], failed.alias("base_failed"), (~failed & (F.col("posterior") >= least)).alias("kept"), "posterior", *names)
    )
