"""Order-preserving packing of token streams into windows of bounded length.

A stream of documents is cut at document ends, at sentence ends, and, inside very long sentences, at fixed steps. The
cuts of a stream are chosen by dynamic programming: the cost of a window is its padding plus a penalty for a cut that
truncates a document (more for one inside a sentence). As a window's cost splits into a term of its start and one of its
end, the best start of every window is the front of a monotone queue, and the whole choice takes linear time.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import kernels as K

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_IS_TAIL = np.isin(np.arange(256), list(b".,!?;:%$#*&|"))
_IS_ALPHA = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARKS = np.array([0xCC, 0xCD], np.uint8)  # lead bytes of the marks that compose with ASCII letters
#: Entries of the word cache of a Python worker; beyond that it starts anew.
CACHE_WORDS = 600_000


class WordTokens:
    """Token ids of pieces of white-space separated words, as little-endian 32-bit ids.

    The tokenizers this is for fold case, drop white space and never let a token span it, so the ids of a word do not
    depend on its neighbours. Words of Latin letters go straight to the tokenizer's BPE model, with their bytes written
    as the byte-level alphabet has them; all others pass its normalizer and pre-tokenizer first.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        assert set(self.alphabet.values()) == set(pre_tokenizers.ByteLevel.alphabet())

    def piece(self, piece: bytes) -> bytes:
        """Ids of a piece; the result is kept."""
        text = piece.decode()
        if _LATIN.fullmatch(text):
            low = text.lower()
            ids = [t.id for t in self.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(self.alphabet))]
        else:
            normal = self.tokenizer.normalizer.normalize_str(text)
            ids = [t.id for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) for t in self.model.tokenize(part)]
        got = self.known[piece] = array("I", ids).tobytes()
        return got

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def choose_cuts(ends: np.ndarray, penalties: np.ndarray, size: int) -> list[int]:
    """Indices of the boundaries to cut at, the last included; ends: rising token positions at most `size` apart."""
    at, cost = [0, *ends.tolist()], [0.0, *penalties.tolist()]
    last = len(at) - 1
    cost[last] = 0.0
    back, starts, keys = [0] * (last + 1), [0], [0.0]  # the queue: starts with rising keys (what came before, plus the place)
    front = 0
    for j in range(1, last + 1):
        here = at[j]
        low = here - size
        while at[starts[front]] < low:
            front += 1
        back[j] = starts[front]
        key = keys[front] + size + cost[j]
        while len(keys) > front and keys[-1] >= key:
            keys.pop()
            starts.pop()
        keys.append(key)
        starts.append(j)
    out, j = [], last
    while j:
        out.append(j - 1)
        j = back[j]
    return out[::-1]


def pack_batches(path: str, end_id: int, size: int, sentence_penalty: float, inner_penalty: float, segment: int):
    """mapInArrow function from (doc_id, text, partition) to the pieces of PIECES, in the order of the rows."""

    def run(batches):
        tokens = _worker_tokens(path)
        step = max(1, size // 64)
        next_sequence = None
        parts: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_sequence
            base = np.cumsum([0, *(len(p[1]) for p in parts)])
            ids = np.concatenate([p[1] for p in parts])
            doc = np.concatenate([p[0] for p in parts])
            doc_end = np.concatenate([p[2] + b for p, b in zip(parts, base, strict=False)])
            bound = np.concatenate([p[3] + b for p, b in zip(parts, base, strict=False)])
            cut = bound[choose_cuts(bound, np.concatenate([p[4] for p in parts]), size)]
            hi = np.union1d(cut, doc_end)
            lo = np.append(0, hi[:-1])
            owner, window = np.searchsorted(doc_end, lo, "right"), np.searchsorted(cut, lo, "right")
            doc_start, window_start = np.append(0, doc_end[:-1])[owner], np.append(0, cut[:-1])[window]
            raw = ids.tobytes()
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
            columns = (doc[owner], lo - doc_start, hi - lo, crc, doc_end[owner] - doc_start, next_sequence + window, lo - window_start)
            next_sequence += len(cut)
            return pa.record_batch([pa.array(c, pa.int64(), from_pandas=True) for c in columns], [c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            ident = np.array(batch.column(0).to_pylist(), object)
            if next_sequence is None and len(ident):
                next_sequence = batch.column(2)[0].as_py() << 33
            for lo, hi, data, offsets in K.text_slices(batch.column(1), 3 << 20):
                parts.append((ident[lo:hi], *_tokenize(tokens, data, offsets, end_id, step, sentence_penalty, inner_penalty)))
                held += len(parts[-1][1])
                if held >= segment:
                    yield flush()
                    parts, held = [], 0
                    K.release()
        if parts:
            yield flush()

    return K.releasing(run)


_tokens: dict[str, WordTokens] = {}


def _worker_tokens(path: str) -> WordTokens:
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def _tokenize(tokens: WordTokens, data: np.ndarray, offsets: np.ndarray, end_id: int, step: int, sentence: float, inner: float):
    """Of a slice of rows: all ids, each row's with end_id behind them; where each row ends among them; the rising token
    positions where the stream may be cut; and what each such cut costs."""
    if len(tokens.known) > CACHE_WORDS:
        tokens.known.clear()
    original = data.tobytes()
    if any(s in original for s in tokens.special):
        own = [np.append(tokens.whole(original[a:b].decode()), np.uint32(end_id)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        ids, row_end = np.concatenate(own).astype("<u4"), np.cumsum([len(x) for x in own])
        stops = np.empty(0, np.int64)
    else:
        starts, ends, first = K.words(data, offsets)
        # Folding ASCII case here is safe unless a combining mark follows that might compose with the letter.
        folded = data if np.isin(data, _MARKS).any() else K.LOWER[data]
        raw = folded.tobytes()
        # A word of ASCII letters and final marks is two pieces: tokens never span the border.
        head = ends.copy()
        for _ in range(3 if len(ends) else 0):
            head -= _IS_TAIL[data[head - 1]] & (head - starts > 1)
        letters = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_IS_ALPHA[data], out=letters[1:])
        split = (head < ends) & (letters[head] - letters[starts] == head - starts)
        piece_of = np.cumsum(1 + split) - (1 + split)
        lo = np.empty(len(starts) + int(split.sum()), np.int64)
        hi = np.empty_like(lo)
        lo[piece_of], hi[piece_of] = starts, np.where(split, head, ends)
        lo[piece_of[split] + 1], hi[piece_of[split] + 1] = head[split], ends[split]
        _, index, which = np.unique(K.hash_spans(folded, lo, hi), return_index=True, return_inverse=True)
        known, make = tokens.known.get, tokens.piece
        pieces = [known(p := raw[a:b]) or make(p) for a, b in zip(lo[index].tolist(), hi[index].tolist(), strict=True)]
        pieces.append(array("I", [end_id]).tobytes())
        row_piece = np.append(piece_of, len(lo))[first[1:]]
        which = np.insert(which, row_piece, len(pieces) - 1)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        flat = np.frombuffer(b"".join(pieces), "<u4")
        n = sizes[which]
        done = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - done + n, n) + np.arange(int(done[-1]))]
        row_end = done[row_piece + np.arange(len(row_piece))]
        mark = data[ends - 1] if len(ends) else data[:0]
        after = data[np.minimum(ends, len(data) - 1)] if len(ends) else data[:0]
        word = np.flatnonzero((mark == 46) | (mark == 33) | (mark == 63) | (after == 10))
        row = np.searchsorted(first, word, "right") - 1
        stops = done[piece_of[word] + split[word] + row]
    bounds = np.union1d(stops[stops > 0], row_end)
    costs = np.where(np.isin(bounds, row_end) | np.isin(bounds, row_end - 1), 0.0, sentence)
    gaps = np.diff(bounds, prepend=0)
    if len(long := np.flatnonzero(gaps > 2 * step)):  # a long sentence may be cut at every step
        more = np.concatenate([np.arange(bounds[k] - gaps[k] + step, bounds[k], step) for k in long])
        bounds, costs = np.concatenate([bounds, more]), np.concatenate([costs, np.full(len(more), inner)])
        order = np.argsort(bounds, kind="stable")
        bounds, costs = bounds[order], costs[order]
    return ids, row_end, bounds, costs


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1,
    sentence_penalty: float = 2.0, inner_penalty: float = 6.0, segment: int = 1 << 21,
) -> DataFrame:
    """Pieces of all documents, packed in the order of the rows of each input partition into windows of at most `size`.

    Each document's tokens are followed by end_id; a null or empty text is end_id alone. A row is a run of one
    document's tokens in one window: its place in the document, its length, the CRC32 of its ids as little-endian 32-bit
    numbers, the document's token count, the window, and its place there. Windows are filled without gaps; each token
    lies in exactly one. A stream is closed at the first document end after `segment` tokens, which bounds memory and
    costs at most one part-filled window; one longer document is a stream of its own. No shuffle takes place, and
    sequence ids hold the partition's number, so a task that is run again gives the same rows. Repeated rows and null
    ids are packed like any other row. The tokenizer must drop white space and keep tokens within words.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().cast("long").alias("partition"))
    return rows.mapInArrow(pack_batches(tokenizer_path, end_id, size, sentence_penalty, inner_penalty, segment), PIECES)
