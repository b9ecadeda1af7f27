"""Token counts of texts under a public tokenizer (operator 5)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .batches import by_bytes, column

#: Bytes of text that the library encodes in one call, and of text from which a text is split.
BATCH_BYTES, SPLIT_BYTES = 1 << 20, 1 << 18
MARK = "▁"
MODEL = "piece_bpe_32k.model"

_loaded: dict[str, tuple] = {}


def load_model(path: str) -> tuple:
    """The processor and whether its pieces allow splitting between words; loaded once per worker process."""
    if path not in _loaded:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        inner = re.compile(f"[^{MARK}]{MARK}")
        # A piece with a mark behind another character could span a blank: then texts are never split.
        splits = not any(inner.search(model.id_to_piece(i)) for i in range(model.vocab_size()))
        # The rule below also needs a marked beginning and blanks kept as they are.
        splits &= model.encode("a  a ", out_type=str)[:1] == [MARK + "a"] and model.decode(model.encode("a  a ")) == "a  a "
        _loaded[path] = model, splits
    return _loaded[path]


def safe_parts(text: str, most: int) -> list[str]:
    """Parts of about `most` characters whose tokens together are those of the text.

    A cut replaces one blank between two characters that are not blanks. No piece spans such a place, and the library
    puts the mark of that blank before the next part again.
    """
    parts, at = [], 0
    while len(text) - at > most:
        cut = at + most
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= len(text):
                cut = -1
                break
            if text[cut - 1] not in (" ", MARK) and text[cut + 1] not in (" ", MARK):
                break
            cut += 1
        if cut < 0:
            break
        parts.append(text[at:cut])
        at = cut + 1
    parts.append(text[at:])
    return parts


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, text: str = "text", id_: str = "doc_id", batch_bytes: int = BATCH_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Adds nothing to the texts and drops none: per row id_, n_bytes, n_tokens and over_limit (n_tokens > limit).

    Only lengths leave the Python workers. A batch holds about batch_bytes of text; a text over split_bytes is encoded in
    parts cut at safe boundaries. A null text counts as empty: 0 bytes, 0 tokens. A null id stays null, equal rows stay.
    """
    model = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, splits = load_model(model)
        for batch in by_bytes(batches, text, batch_bytes):
            texts = column(batch, text).fill_null("")
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            parts, owner = [], []
            for i, (t, n) in enumerate(zip(texts.to_pylist(), n_bytes.to_pylist(), strict=True)):
                own = safe_parts(t, split_bytes) if splits and n > split_bytes else [t]
                parts += own
                owner += [i] * len(own)
            counts = [0] * len(texts)
            at = 0
            while at < len(parts):  # a long text's parts also go to the library in bounded calls
                end, size = at, 0
                while end < len(parts) and (end == at or size + len(parts[end]) <= batch_bytes):
                    size += len(parts[end])
                    end += 1
                for i, ids in zip(owner[at:end], encoder.encode(parts[at:end], num_threads=1), strict=True):
                    counts[i] += len(ids)
                at = end
            n_tokens = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, id_), n_bytes, n_tokens, pc.greater(n_tokens, limit)], [id_, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_].dataType.simpleString()
    return docs.select(id_, text).mapInArrow(run, f"`{id_}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
