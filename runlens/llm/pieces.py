"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass (operator 10).

The distinct marked words of a batch are sorted, which lays them out as a trie in depth-first order: a word shares with
its predecessor the nodes of their common prefix. Every node holds its forward state: the last piece of the best
segmentation that ends there, and the pieces under way, as places in the trie of all pieces. Only the nodes below the common
prefix are computed, each by one step from the node above it; nothing before them is read again.

The public model is of the BPE kind. The sum of piece scores, which plain Viterbi maximises, does not give that
model's pieces. The recurrence therefore takes, among the pieces that end at a node, the one that BPE merging leaves next to
the last piece of the node where it begins. A segmentation is what BPE gives exactly when each two neighbours are what BPE
gives for their concatenation, so the best path is unique and the ids equal those of the library.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import by_bytes, column

MARK = "▁"
#: Bytes of text encoded at once; words and pairs that a worker remembers between batches.
SLICE_BYTES, WORDS_KEPT, PAIRS_KEPT = 1 << 22, 250_000, 400_000


class PieceModel:
    """Vocabulary of a SentencePiece BPE model with byte fallback, with its segmentation and its inverse."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        texts = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {texts[i]: i for i in plain}
        self.score = {texts[i]: model.get_score(i) for i in plain}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece spans a blank: words can't be encoded apart")
        self.words = re.compile(_word_pattern(self.ids))
        out = [b""] * n
        for i in plain:
            out[i] = texts[i].replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        out[model.unk_id()] = " ⁇ ".encode()
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.out_at = np.cumsum([0, *map(len, out)])
        self.text = texts
        self.pairs: dict[int, bool] = {}
        #: Pieces that merging really reaches from their characters; only these can stand in a result.
        self.reached = {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}
        #: Trie of those pieces: a place is the dict of the places below it by character, with the piece's id under "".
        self.root: dict = {}
        for piece in sorted(self.reached):
            place = self.root
            for c in piece:
                place = place.setdefault(c, {})
            place[""] = self.ids[piece]
        self.length = [len(t) for t in texts]
        self.kept: dict[str, tuple[int, ...]] = {}

    def merged(self, word: str) -> list[str]:
        """Pieces of a word by merging the best pair again and again; the leftmost of equal pairs."""
        symbols: list[str | None] = list(word)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            pair = symbols[i] + symbols[j]
            if (s := self.score.get(pair)) is not None:
                heapq.heappush(heap, (-s, i, j, pair))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, pair = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or after[i] != j or len(symbols[i]) + len(symbols[j]) != len(pair):
                continue
            symbols[i], symbols[j] = pair, None
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in symbols if s is not None]

    def together(self, left: int, right: int) -> bool:
        """True if merging leaves the pieces with these ids side by side."""
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        a, b = self.text[left], self.text[right]
        found = self.pairs[left << 32 | right] = a + b not in self.reached and self.merged(a + b) == [a, b]
        return found

    def piece_ids(self, piece: str) -> list[int]:
        """A piece's id, or the ids of its bytes if the vocabulary lacks it."""
        i = self.ids.get(piece)
        return [i] if i is not None else [self.byte_ids[b] for b in piece.encode()]

    def segment(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct words, in one pass over their trie in depth-first order.

        A node keeps the id of its last piece, or -1 where a character outside the vocabulary stands alone. Of the pieces
        that end at a node one only fits.
        """
        result: dict[str, tuple[int, ...]] = {}
        pairs, together, length, root = self.pairs, self.together, self.length, self.root
        before = ""  # the word whose nodes stand in `last` and `active`
        last: list[int] = [-1]
        active: list[list[tuple[int, dict]]] = [[]]  # begin and place of each piece under way, the longest first
        for word in sorted(words):
            if word.startswith(MARK + MARK) or word[0] == "\n":
                # Runs of marks have equal scores, where neighbours alone don't decide; line feeds are bytes.
                result[word] = tuple(i for p in self.merged(word) for i in self.piece_ids(p))
                continue
            common, most = 0, min(len(before), len(word))
            while common < most and before[common] == word[common]:
                common += 1
            del last[common + 1 :], active[common + 1 :]
            for at in range(common, len(word)):
                c, on, chosen = word[at], [], -1
                for begin, place in (*active[at], (at, root)):
                    place = place.get(c)
                    if place is None:
                        continue
                    on.append((begin, place))
                    piece = place.get("")
                    if piece is None or chosen >= 0:
                        continue
                    left = last[begin]
                    if left >= 0:
                        fits = pairs.get(left << 32 | piece)
                        if fits is None:
                            fits = together(left, piece)
                        if not fits:
                            continue
                    chosen = piece
                active.append(on)
                last.append(chosen)
            before = word
            at, back = len(word), []
            while at:
                piece = last[at]
                if piece >= 0:
                    back.append(piece)
                    at -= length[piece]
                else:
                    at -= 1
                    back += [self.byte_ids[b] for b in reversed(word[at].encode())]
            back.reverse()
            result[word] = tuple(back)
        return result

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and n + 1 offsets."""
        number: dict[str, int] = defaultdict(itertools.count().__next__)
        owners, counts = [], [0]
        for text in texts:
            words = self.words.findall(MARK + text.replace(" ", MARK)) if text else []
            owners.extend(map(number.__getitem__, words))
            counts.append(len(owners))
        kept = self.kept
        fresh = [w for w in number if w not in kept]
        if len(kept) + len(fresh) > WORDS_KEPT:
            kept = self.kept = {w: kept[w] for w in number if w in kept}
        known = self.segment(fresh)
        own = [known[w] if w in known else kept[w] for w in number]
        if len(kept) + len(known) <= WORDS_KEPT:
            kept.update(known)
        size = np.fromiter(map(len, own), np.int64, len(own))
        ids = np.fromiter(itertools.chain.from_iterable(own), np.int32, int(size.sum()))
        first = np.cumsum(size) - size
        owner = np.array(owners, np.int64)
        taken, offsets = gathered(ids, first[owner], size[owner])
        return taken, offsets[np.array(counts)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts and n + 1 offsets; the blank that encoding puts first is taken away."""
        data, at = gathered(self.out, self.out_at[ids], np.diff(self.out_at)[ids])
        ends = at[offsets]
        begin, size = ends[:-1].copy(), np.diff(ends)
        if len(data):
            lead = (size > 0) & (data[np.minimum(begin, len(data) - 1)] == 0x20)
            begin, size = begin + lead, size - lead
        return gathered(data, begin, size)


def gathered(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[first[k] : first[k] + size[k]] for all k one after another, and offsets."""
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    if not offsets[-1]:
        return values[:0], offsets
    at = np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1])
    return values[at], offsets


def _word_pattern(pieces: Iterable[str]) -> str:
    """Expression of the runs of characters that merging can't leave: cuts are where no piece spans the two characters.

    These are the place before a mark, both sides of a line feed if no piece holds one, and the places between a letter or
    digit and a character that never stands beside one in a piece.
    """
    apart, beside = set(), set()
    for piece in pieces:
        for left, right in zip(piece, piece[1:], strict=False):
            beside |= {left} if right.isalnum() else set()
            beside |= {right} if left.isalnum() else set()
        apart.update(c for c in piece if not c.isalnum() and c not in (MARK, "\n", "_"))
    feed = "" if any("\n" in p for p in pieces) else "\n"
    cut = "".join(re.escape(c) for c in sorted(apart - beside))
    run = f"(?:[^\\W_]+|[{cut}]+)"
    other = f"(?:[^\\w{MARK}{feed}{cut}]|_)"
    return f"{MARK}*(?:{run}(?:{other}+{run}?)*|{other}+(?:{run}{other}*)*)|{MARK}+" + (f"|{feed}+" if feed else "")


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The model of a file, once per worker process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    try:
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
        texts.validate(full=True)
        return texts.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8 text become replacement characters
        raw = data.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:], strict=False)], pa.string())


def encode_pieces(docs: DataFrame, path: str, text: str = "text", ids: str = "piece_ids", n: str = "n_pieces", round_trip: str = "round_trip") -> DataFrame:
    """All columns of docs and three more: ids array<int>, their number, and whether decoding gives the text again.

    Every row is kept, repeated rows as well. A null or empty text has no ids and its round trip is true. A character
    U+2581 in a text is the model's mark of a blank and decodes to a blank; the round trip is held against that. Columns of
    docs named like the new ones are replaced.
    """
    new = (ids, n, round_trip)
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in new])
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(n, T.LongType()), T.StructField(round_trip, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in by_bytes(batches, text, SLICE_BYTES):
            texts = column(batch, text).fill_null("").to_pylist()
            flat, offsets = model.encode(texts)
            back = _strings(*model.decode(flat, offsets))
            same = pc.equal(back, pa.array([t.replace(MARK, " ") for t in texts], pa.string()))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(np.diff(offsets), pa.int64()), same], [*batch.schema.names, *new])

    return docs.mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, path: str, ids: str = "piece_ids", text: str = "text") -> DataFrame:
    """All columns of encoded, with `text` decoded from `ids` (a column of that name is replaced); null ids: null text."""
    encoded = encoded.select(*[f"`{c}`" for c in encoded.columns if c != text])
    schema = T.StructType([*encoded.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = column(part, ids)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                back = _strings(*model.decode(flat, offsets))
                back = pc.if_else(lists.is_valid(), back, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, back], [*part.schema.names, text])

    return encoded.mapInArrow(run, schema)
