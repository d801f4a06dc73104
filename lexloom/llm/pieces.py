"""SentencePiece encoding and decoding by suffix-array matching.

The segments of a batch that weren't met before are joined into one text and indexed by a suffix array;
each piece of the vocabulary is binary-searched for the range of suffixes that it begins. The edges so
found (place, length, piece), sorted by place, are then relaxed: as the vocabulary is a byte-pair one,
a segment's neighbouring symbols merge along the edge of best rank, leftmost first, until none is left; all
segments take a step together, long ones by a heap. Characters without a piece fall back to bytes.

A segment is a run of word marks with the characters up to the next mark. No piece reaches from one
segment into the next, so the joined encodings are the text's. A segment of more than WINDOW characters is
encoded by windows, whose tokens are joined where each pair of neighbours is the encoding of its own text, which makes the
row of tokens the encoding of the whole; around a place where it isn't, more tokens are encoded anew.
A text is worked on in blocks of BLOCK characters, so that memory doesn't grow with it but for its own ids.

Defined cases: a null or empty text has no ids and is exact; the mark U+2581 in a text is decoded as a
space; texts of any length are encoded whole; repeated rows are encoded each; an empty table gives an empty
result; of edges of equal rank the leftmost is taken; columns beside the id and text play no part.
"""

from __future__ import annotations

import heapq
import itertools
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import columns, sliced, table
from .quality import MODEL, TOKENIZERS

MARK = "▁"
#: Segments remembered by a task, characters from which a segment's merges go by a heap, of a window, and of a block.
REMEMBERED, LONG, WINDOW, BLOCK = 300_000, 192, 4096, 1_000_000
NONE = np.int64(1 << 40)


class Vocabulary:
    """texts of ordinary pieces, their ids and ranks (0 is best), the byte pieces, and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.vocab_size())
        plain = [k for k in every if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        scores = sorted({model.get_score(k) for k in plain}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        self.texts = [model.id_to_piece(k) for k in plain]
        self.ids = np.array(plain, np.int32)
        self.ranks = np.array([place[model.get_score(k)] for k in plain], np.int64)
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.longest = int(self.lengths.max())
        if self.longest > 62:
            raise ValueError("pieces of over 62 characters")
        self.codes = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.first = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.by_text = {t: int(k) for t, k in zip(self.texts, self.ids, strict=True)}
        self.of_byte = np.zeros(256, np.int32)
        self.raw = [b""] * model.vocab_size()
        for k in every:
            if model.is_byte(k):
                value = int(model.id_to_piece(k)[3:5], 16)
                self.of_byte[value], self.raw[k] = k, bytes((value,))
        for k, t in zip(plain, self.texts, strict=True):
            self.raw[k] = t.replace(MARK, " ").encode()
        self.unknown = model.unk_id()
        inner = {c for t in self.texts if len(t) > 1 for c in t}
        self.segments = re.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if "\n" not in inner else rf"{MARK}*[^{MARK}]+|{MARK}+")


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def matches(text: str, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(place, piece) of every occurrence of every piece in the text, sorted by place, then by length."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, own = np.unique(codes, return_inverse=True)
    # a letter is one byte from 1, or two: the order of suffixes is that of these bytes, and none is zero
    unit = 2 if len(letters) > 253 else 1
    in_bytes = lambda at: np.stack([at // 253 + 1, at % 253 + 1], axis=1).astype(np.uint8) if unit == 2 else (at + 1).astype(np.uint8)[:, None]
    width = unit * vocab.longest
    padded = np.concatenate([in_bytes(own).ravel(), np.zeros(width, np.uint8)])
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width)[: len(codes) * unit : unit])
    words = -(-width // 8)
    keys = np.zeros((len(codes), words * 8), np.uint8)
    keys[:, :width] = windows
    order = np.lexsort(keys.view(">u8").astype(np.uint64).T[::-1])
    del keys
    suffixes = windows.view(f"S{width}").ravel()[order]
    at = np.minimum(np.searchsorted(letters, vocab.codes), len(letters) - 1)
    which = np.flatnonzero(np.minimum.reduceat(letters[at] == vocab.codes, vocab.first))
    if not len(which):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = vocab.lengths[which]
    ends = np.cumsum(lengths)
    column = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    low = np.zeros((len(which), vocab.longest, unit), np.uint8)
    low[np.repeat(np.arange(len(which)), lengths), column] = in_bytes(at[np.repeat(vocab.first[which], lengths) + column])
    low = low.reshape(len(which), width)
    high = np.where(np.arange(width) < (lengths * unit)[:, None], low, np.uint8(255))
    as_text = lambda x: np.ascontiguousarray(x).view(f"S{width}").ravel()
    begins, ends = np.searchsorted(suffixes, as_text(low), "left"), np.searchsorted(suffixes, as_text(high), "right")
    n = ends - begins
    at = np.repeat(begins - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    bits = len(vocab.texts).bit_length()
    packed = np.sort(order[at] << (6 + bits) | np.repeat(lengths << bits | which, n))
    return packed >> (6 + bits), packed & ((1 << bits) - 1)


class Edges:
    """The edges of a text by place: which lengths there are (a bit each), where they begin, their pieces and ranks."""

    def __init__(self, text: str, vocab: Vocabulary):
        places, self.piece = matches(text, vocab)
        self.rank, self.length = vocab.ranks[self.piece], vocab.lengths[self.piece]
        self.first = np.searchsorted(places, np.arange(len(text) + 1))
        self.lengths = np.zeros(len(text), np.uint64)
        if len(places):
            new = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
            self.lengths[places[new]] = np.add.reduceat(np.uint64(1) << self.length.astype(np.uint64), new)

    def __call__(self, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether there is one, its number)"""
        bit, here = np.minimum(length, 63).astype(np.uint64), self.lengths[place]
        below = np.bitwise_count(here & ((np.uint64(1) << bit) - np.uint64(1)))
        return (here >> bit & np.uint64(1)).astype(bool), self.first[place] + below


def tokens_of(segments: list[str], vocab: Vocabulary) -> tuple[str, Edges, np.ndarray, np.ndarray, np.ndarray]:
    """(the segments joined, its edges, segment, place and length of every token in order)"""
    text = "\0".join(segments) + "\0"
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
    edges = Edges(text, vocab)
    inside = np.ones(len(text), bool)
    inside[starts + sizes] = False
    place = np.flatnonzero(inside)
    segment = np.repeat(np.arange(len(segments)), sizes)
    length = np.ones(len(place), np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    long = sizes[segment] > LONG
    if long.any():
        for k in np.flatnonzero(sizes > LONG).tolist():
            a, n = _merged_by_heap(int(starts[k]), int(sizes[k]), edges)
            done.append((np.full(len(a), k, np.int64), a, n))
        place, segment, length = place[~long], segment[~long], length[~long]

    def rank_of(at: np.ndarray) -> np.ndarray:
        """Of the symbols at these indices with the next one."""
        out = np.full(len(at), NONE, np.int64)
        ok = at + 1 < len(place)
        ok[ok] = segment[at[ok]] == segment[at[ok] + 1]
        k = at[ok]
        there, edge = edges(place[k], length[k] + length[k + 1])
        found = np.full(len(k), NONE, np.int64)
        found[there] = edges.rank[edge[there]]
        out[ok] = found
        return out

    rank = rank_of(np.arange(len(place)))
    while len(place):
        first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        best = np.minimum.reduceat((rank << 20) | (np.arange(len(place)) - np.repeat(first, np.diff(np.concatenate((first, [len(place)]))))), first)
        ended = best >= NONE << 20
        if ended.any():
            over = np.repeat(ended, np.diff(np.concatenate((first, [len(place)]))))
            done.append((segment[over], place[over], length[over]))
            stays = ~over
            at = (np.cumsum(stays) - 1)[first[~ended]] if stays.any() else first[:0]
            place, segment, length, rank = place[stays], segment[stays], length[stays], rank[stays]
            best = best[~ended]
        else:
            at = first
        if not len(place):
            break
        merged = at + (best & ((1 << 20) - 1))
        length[merged] += length[merged + 1]
        stays = np.ones(len(place), bool)
        stays[merged + 1] = False
        merged = (np.cumsum(stays) - 1)[merged]
        place, segment, length, rank = place[stays], segment[stays], length[stays], rank[stays]
        rank[merged] = rank_of(merged)
        before = merged[merged > 0] - 1
        rank[before] = rank_of(before)
    segment, place, length = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
    order = np.argsort(place)
    return text, edges, segment[order], place[order], length[order]


def encode_segments(segments: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all segments joined, how many each has)"""
    text, edges, segment, place, length = tokens_of(segments, vocab)
    there, edge = edges(place, length)
    ids = np.full(len(place), -1, np.int64)
    ids[there] = vocab.ids[edges.piece[edge[there]]]
    times = np.ones(len(ids), np.int64)
    lost = np.flatnonzero(ids < 0)
    if len(lost):
        raw = [text[k].encode("utf-8", "replace") for k in place[lost].tolist()]
        times[lost] = [len(b) for b in raw]
        ids = np.repeat(ids, times)
        ids[ids < 0] = vocab.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
    return ids.astype(np.int32), np.bincount(segment, times, len(segments)).astype(np.int64)


def token_lengths(segments: list[str], vocab: Vocabulary) -> list[list[int]]:
    """The characters of each token, by segment; a few segments at a time."""
    out: list[list[int]] = []
    at = 0
    while at < len(segments):
        end, size = at, 0
        while end < len(segments) and (size == 0 or size + len(segments[end]) <= BLOCK):
            size += len(segments[end])
            end += 1
        _, _, segment, _, length = tokens_of(segments[at:end], vocab)
        out += [x.tolist() for x in np.split(length, np.cumsum(np.bincount(segment, minlength=end - at))[:-1])]
        at = end
    return out


def encode_long(segment: str, vocab: Vocabulary, window: int = WINDOW) -> np.ndarray:
    """The ids of one segment by windows."""
    n = max(1, len(segment) // window)
    cuts = [len(segment) * k // n for k in range(n + 1)]
    parts = token_lengths([segment[a:b] for a, b in itertools.pairwise(cuts)], vocab)
    for wide in [w for w in (1, 4, 16, 48) if 2 * w + 2 < window // vocab.longest]:  # tokens on each side that are encoded anew; a window has more
        ends = np.cumsum([sum(p) for p in parts]).tolist()
        seams = []
        for k in range(len(parts) - 1):
            a, b, at = parts[k][-wide:], parts[k + 1][:wide], ends[k]
            seams.append((k, at - sum(a), at + sum(b), parts[k][-wide - 1], parts[k + 1][wide]))
        new = token_lengths([segment[a:b] for _, a, b, _, _ in seams], vocab)
        # the old tokens before and behind must be left alone by the new ones
        borders = [x for (_, a, b, left, right), t in zip(seams, new, strict=True) for x in (segment[a - left : a + t[0]], segment[b - t[-1] : b + right])]
        kept = token_lengths(borders, vocab)
        open_ = False
        for (k, _, _, left, right), t, before, after in zip(seams, new, kept[::2], kept[1::2], strict=True):
            if before == [left, t[0]] and after == [t[-1], right]:
                parts[k], parts[k + 1] = parts[k][:-wide] + t, parts[k + 1][wide:]
            else:
                open_ = True
        if not open_:
            break
    else:
        parts = token_lengths([segment], vocab)
    out, at = [], 0
    for n in (x for p in parts for x in p):
        k = vocab.by_text.get(segment[at : at + n])
        out += [k] if k is not None else vocab.of_byte[list(segment[at : at + n].encode("utf-8", "replace"))].tolist()
        at += n
    return np.array(out, np.int32)


def _merged_by_heap(start: int, size: int, edges: Edges) -> tuple[np.ndarray, np.ndarray]:
    """(places, lengths) of the symbols that are left of one segment."""
    length, before = [1] * size, list(range(-1, size - 1))
    a, b = int(edges.first[start]), int(edges.first[start + size])
    place = np.repeat(np.arange(size), np.diff(edges.first[start : start + size + 1]))
    rank = dict(zip((place << 6 | edges.length[a:b]).tolist(), edges.rank[a:b].tolist(), strict=True))
    heap = []

    def offer(k: int) -> None:
        nxt = k + length[k]
        if nxt < size:
            both = length[k] + length[nxt]
            if both < 63 and (r := rank.get(k << 6 | both)) is not None:
                heapq.heappush(heap, (r, k, both))

    for k in range(size - 1):
        offer(k)
    while heap:
        _, k, both = heapq.heappop(heap)
        nxt = k + length[k]
        if not length[k] or nxt >= size or length[k] + length[nxt] != both:
            continue
        length[nxt], length[k] = 0, both
        if k + both < size:
            before[k + both] = k
        offer(k)
        if before[k] >= 0:
            offer(before[k])
    left = [k for k in range(size) if length[k]]
    return np.array(left, np.int64) + start, np.array([length[k] for k in left], np.int64)


class Known(dict):
    """segment -> its number; ``fresh`` has those that weren't met before, in order."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, segment: str) -> int:
        self[segment] = at = len(self)
        self.fresh.append(segment)
        return at


class Encoder:
    """Remembers the segments it has met, up to a bound."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.known = Known()
        self.flat, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The text's segments, about BLOCK characters at a time."""
        marked = MARK + text.replace(" ", MARK)
        if len(marked) <= BLOCK:
            yield self.vocab.segments.findall(marked)
            return
        own, size = [], 0
        for m in self.vocab.segments.finditer(marked):
            own.append(m[0])
            size += len(m[0])
            if size > BLOCK:
                yield own
                own, size = [], 0
        yield own

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts joined, how many each has)"""
        out, sizes, waiting, size = [], np.zeros(len(texts), np.int64), [], 0

        def flush() -> None:
            fresh, self.known.fresh = self.known.fresh, []
            long = {k: encode_long(s, self.vocab) for k, s in enumerate(fresh) if len(s) > WINDOW}
            ids, n = encode_segments([s if k not in long else "" for k, s in enumerate(fresh)], self.vocab) if fresh else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            if long:
                ends = np.cumsum(n)
                ids = np.concatenate([x for k, part in enumerate(np.split(ids, ends[:-1])) for x in (part, long.get(k, part[:0]))])
                n[list(long)] += [len(x) for x in long.values()]
            self.flat, self.first = np.concatenate([self.flat, ids]), np.concatenate([self.first, self.first[-1] + np.cumsum(n)])
            which = np.concatenate([w for _, w in waiting]) if waiting else np.zeros(0, np.int64)
            n = self.first[which + 1] - self.first[which]
            ends = np.concatenate(([0], np.cumsum(n)))
            out.append(self.flat[np.repeat(self.first[which] - ends[:-1], n) + np.arange(ends[-1])])
            borders = np.cumsum([0, *(len(w) for _, w in waiting)])
            np.add.at(sizes, [k for k, _ in waiting], np.diff(ends[borders]))
            waiting.clear()
            if len(self.known) > REMEMBERED or len(self.flat) > 16 * REMEMBERED:
                self._forget()

        for k, text in enumerate(texts):
            for own in self.blocks(text) if text else ():
                waiting.append((k, np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))))
                size += sum(map(len, own)) if len(own) < 100 else len(text) if len(text) <= BLOCK else BLOCK
                if size > 2 * BLOCK:
                    flush()
                    size = 0
        flush()
        return np.concatenate(out), sizes

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.vocab.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_tokens, exact (decoding gives the text back), ids. No shuffle."""
    path = os.path.join(tokenizers, MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in sliced(batches, "text", 2_000_000):
            texts = batch.column("text").to_pylist()
            ids, n = encoder.encode(texts)
            ends = np.concatenate(([0], np.cumsum(n)))
            exact = [encoder.decode(ids[a:b]) == (t or "").replace(MARK, " ") for t, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(exact, pa.bool_()), lists], names=["doc_id", "n_tokens", "exact", "ids"])

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, n_tokens long, exact boolean, ids array<int>")


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizers: str = TOKENIZERS) -> DataFrame:
    """doc_id, text; null ids give an empty text."""
    path = os.path.join(tokenizers, MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            texts = [encoder.decode(np.array(x or [], np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return columns(encoded, doc_id=id_col, ids=ids_col).mapInArrow(run, "doc_id long, text string")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))
