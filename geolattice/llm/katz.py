"""Katz backoff language model: counting, Good-Turing discounts, exact backoff weights, scores.

Tokens are words and one end token a text; an n-gram that reaches back over a text's start is
filled with start symbols. All tables are binary columns of numpy arrays, and every stage is
a map or a grouped map over bounded pieces:

1. *Chunks.* Tasks turn texts into codes into a chunk's own sorted vocabulary of 64-bit word
   hashes. The chunk table is written to the shared folder. A chunk's n-grams of every length
   up to the order follow from it, each known by a 64-bit hash of its words' hashes.
2. *Counting.* Each chunk sends its distinct n-grams with training counts to ranges of their
   hashes, so a frequent word or history loads no range more than another. A range adds up the
   counts and answers each chunk; of the chunks that hold an n-gram the first is its owner.
   Answers are written to the shared folder: they are the model's count tables by chunk.
3. *Histories.* Owners add up, for the histories that text outside the training rows needs,
   what their n-grams take of a history's mass, and send the sums, with the histories that
   they ask for, to ranges of histories. What chunks asked for goes back to them.
4. *Scores.* A chunk evaluates its n-grams from short to long: one seen in training has its
   discounted relative frequency, others the history's backoff weight times the probability
   of the same n-gram without its first word.

With d the discounts, c* = d*c. A history's backoff weight is the mass its discounts free
over the shorter model's mass of the words not seen after it, so every history's
probabilities, unknown words included as one class, add up to one. Counts over ``CUT`` lose
``FLOOR``, so no history is left without mass.

The number of ranges follows from the number of tokens, so a range has the same size
whatever the corpus. A chunk sends a message to each range that one of its n-grams is in:
never more messages than it has n-grams.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolattice.llm.common import materialize, small_slices

CUT = 5
FLOOR = 0.05
ORDER = 3
#: Hashes that stand for the end of a text and for its start as a history.
END, START = (1 << 64) - 1, (1 << 64) - 2
CHUNK_TEXT = 16 << 20
#: Bytes of messages in a range, and about what a token gives for each length: repeats within a chunk are sent once.
RANGE_BYTES = 8 << 20
GRAM_BYTES = 4
#: Kept for each history: n-grams by count up to CUT, all n-grams, and of their shorter forms the counts over CUT added up and the number by count up to CUT.
SUMS = 2 + 2 * CUT


#: How a byte plane is kept: all zero, as it is, or compressed by itself.
_ZERO, _PLAIN, _PACKED = range(3)
#: Low bytes of 64-bit steps between hashes, which are random: not worth compressing.
_RANDOM_PLANES = 5


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one value of byte planes, each compressed by itself where that shrinks it."""
    parts, packer = [], zstandard.ZstdCompressor(level=1, write_content_size=True, write_checksum=False)
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(struct.pack("<2sq", a.dtype.str[1:3].encode(), len(a)))
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else ()
        for i, plane in enumerate(planes):
            raw = plane.tobytes()
            if a.dtype == np.uint64 and i < _RANDOM_PLANES:
                parts += [bytes([_PLAIN]), raw]
            elif not plane.any():
                parts.append(bytes([_ZERO]))
            elif len(packed := packer.compress(raw)) + 4 < len(raw):
                parts += [struct.pack("<BI", _PACKED, len(packed)), packed]
            else:
                parts += [bytes([_PLAIN]), raw]
    return b"".join(parts)


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    out, at, unpacker = [], 0, zstandard.ZstdDecompressor()
    while at < len(blob):
        kind, n = struct.unpack_from("<2sq", blob, at)
        at += 10
        dtype = np.dtype("<" + kind.decode())
        values = np.zeros((n, dtype.itemsize), dtype=np.uint8)
        for i in range(dtype.itemsize if n else 0):
            how = blob[at]
            at += 1
            if how == _PLAIN:
                values[:, i] = np.frombuffer(blob, dtype=np.uint8, count=n, offset=at)
                at += n
            elif how == _PACKED:
                (size,) = struct.unpack_from("<I", blob, at)
                values[:, i] = np.frombuffer(unpacker.decompress(blob[at + 4 : at + 4 + size]), dtype=np.uint8)
                at += 4 + size
        out.append(values.reshape(-1).view(dtype))
    return out


def _steps(sorted_: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, the first value first."""
    return np.diff(sorted_, prepend=sorted_.dtype.type(0)) if len(sorted_) else sorted_


def _small(a: np.ndarray) -> np.ndarray:
    """Counts in the least number of bytes."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65_536 else np.uint32 if top < 1 << 32 else np.uint64)


def _range_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Which of ``buckets`` (at most 2**32) equal ranges of 64-bit values each hash is in."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _extend(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from the hash of its history and that of its last word; the order of the two counts."""
    key = history * np.uint64(0x9E3779B97F4A7C15) + (word ^ (word >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        key = (key ^ (key >> np.uint64(shift))) * np.uint64(factor)
    return key ^ (key >> np.uint64(33))


def _start_hashes(order: int) -> list[np.ndarray]:
    """Hashes of one start symbol, two, and so on."""
    symbol = np.array([START], dtype=np.uint64)
    out = [symbol]
    for _ in range(order - 1):
        out.append(_extend(out[-1], symbol))
    return out


# --- chunks ---------------------------------------------------------------------------------


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words, a slice at a time: few of them are Python objects at once."""
    out = np.empty(len(words), dtype=np.uint64)
    for at in range(0, len(words), 1 << 15):
        part = words.slice(at, 1 << 15).to_pylist()
        out[at : at + len(part)] = [xxhash.xxh64_intdigest(w) for w in part]
    return out


def _full_slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of about ``limit`` bytes of text, across batches; a longer text is in one part."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in small_slices(batches, "text", max(1, limit // 4)):
        n = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
        if held and size + n > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(part)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _chunks(chunk_text: int):
    names = ["chunk", "docs", "codes", "words", "tokens", "texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        for batch in _full_slices(batches, chunk_text):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
            words = lists.flatten()
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lengths)), lengths)[real]
            coded = words.filter(pa.array(real)).dictionary_encode()
            hashes = np.append(_hashes(coded.dictionary), np.uint64(END))
            vocabulary, place = np.unique(hashes, return_inverse=True)
            sizes = np.bincount(owner, minlength=len(lengths)) + 1
            ends = np.cumsum(sizes) - 1
            codes = np.empty(int(sizes.sum()), dtype=np.int32)
            inner = np.ones(len(codes), dtype=bool)
            inner[ends] = False
            codes[ends] = place[-1]
            codes[inner] = place[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else []
            trains = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            ids = batch.column("doc_id")
            docs = pack_arrays(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), trains.astype(np.uint8), _small(sizes))
            row = [chunk, docs, pack_arrays(codes), pack_arrays(_steps(vocabulary)), len(codes), int(trains.sum())]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in row], names=names)
            chunk += 1
            del lists, words, coded, codes, inner, real, owner, place
            pa.default_memory_pool().release_unused()

    return run


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, where each occurs first, and the place of every value among them."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    distinct = ordered[new]
    del ordered
    at = np.empty(len(values), dtype=np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return distinct, order[new].astype(np.int32), at


class Grams:
    """A chunk's distinct n-grams by length: sorted hashes, the tokens that they end at, histories and shorter forms.

    Index k - 1 stands for length k. ``history`` is the place of an n-gram without its last word
    and ``shorter`` that without its first, among those of one word less; the place past the last
    one stands for start symbols only.
    """

    def __init__(self, row: dict, order: int) -> None:
        self.ids, self.null, trains, sizes = unpack_arrays(row["docs"])
        (codes,) = unpack_arrays(row["codes"])
        words = np.cumsum(unpack_arrays(row["words"])[0], dtype=np.uint64)
        self.sizes = sizes.astype(np.int64)
        self.trains = trains.astype(bool)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.taught = np.repeat(self.trains, self.sizes)
        first_token = np.zeros(len(codes), dtype=bool)
        first_token[self.starts] = True
        self.opens = first_token
        self.hashes, self.at = [words], [codes]
        self.history: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.shorter: list[np.ndarray] = [np.zeros(0, np.int64)]
        token, begin = words[codes], _start_hashes(order)
        gram = token
        for k in range(2, order + 1):
            before = np.empty_like(gram)
            before[1:] = gram[:-1]
            before[self.starts] = begin[k - 2]
            gram = _extend(before, token)
            distinct, first, at = _distinct(gram)
            history = np.where(first_token[first], np.int32(len(self.hashes[-1])), self.at[-1][first - 1])
            self.shorter.append(self.at[-1][first])
            self.history.append(history.astype(np.int32))
            self.hashes.append(distinct)
            self.at.append(at)

    def counts(self, k: int) -> np.ndarray:
        """Training counts of the n-grams of length k."""
        return np.bincount(self.at[k - 1][self.taught], minlength=len(self.hashes[k - 1]))

    def asked(self, k: int) -> np.ndarray:
        """Whether each n-gram of length k is the history of a token outside the training rows."""
        out = np.zeros(len(self.hashes[k - 1]), dtype=bool)
        later = np.flatnonzero(~self.taught & ~self.opens)
        out[self.at[k - 1][later - 1]] = True
        return out


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(_range_of(hashes, buckets), np.arange(buckets + 1))


def _messages(numbers: list[int], chunk: int, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([chunk] * len(numbers), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "blob"])


def _send_grams(buckets: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                grams = Grams(row, order)
                counts = [grams.counts(k) for k in range(1, order + 1)]
                asked = [grams.asked(k).astype(np.uint8) for k in range(1, order)]
                cuts = [_cuts(h, buckets) for h in grams.hashes]
                numbers, blobs = [], []
                for b in range(buckets):
                    parts = []
                    for k in range(order):
                        low, high = cuts[k][b], cuts[k][b + 1]
                        parts += [_steps(grams.hashes[k][low:high]), _small(counts[k][low:high])]
                        if k < order - 1:
                            parts.append(asked[k][low:high])
                    if any(map(len, parts)):
                        numbers.append(b)
                        blobs.append(pack_arrays(*parts))
                yield _messages(numbers, row["chunk"], blobs)

    return run


# --- ranges ---------------------------------------------------------------------------------

_ANSWERS = pa.schema([("chunk", pa.int32()), ("bucket", pa.int64()), ("blob", pa.binary()), ("stats", pa.list_(pa.int64()))])
_TOTALS = -1


def _by_count(values: np.ndarray) -> list[int]:
    """How many values are 1, 2, up to CUT + 1."""
    return [int((values == r).sum()) for r in range(1, CUT + 2)]


def _merge_grams(order: int):
    """Adds up a range's counts over chunks; answers each chunk with total, owner and need of its n-grams."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True))
        messages = [unpack_arrays(blob) for _, _, blob in rows]
        answers: list[list[np.ndarray]] = [[] for _ in rows]
        stats: list[int] = []
        for k in range(order):
            hashes = [np.cumsum(m[3 * k], dtype=np.uint64) for m in messages]
            spans = np.cumsum([0, *map(len, hashes)])
            distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
            counts = np.concatenate([m[3 * k + 1] for m in messages]).astype(np.int64)
            total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)
            known = np.flatnonzero(counts)
            owner = np.zeros(len(place), dtype=np.uint8)
            owner[known[np.unique(place[known], return_index=True)[1]]] = 1
            need = np.zeros(len(distinct), dtype=np.uint8)
            if k < order - 1:
                need[place[np.concatenate([m[3 * k + 2] for m in messages]).astype(bool)]] = 1
            for i, answer in enumerate(answers):
                mine = slice(spans[i], spans[i + 1])
                answer += [_small(total[place[mine]]), owner[mine] | need[place[mine]] << 1]
            stats += [int(total.sum()), int((total > 0).sum()), *_by_count(total)]
        bucket = rows[0][1]
        out = [(chunk, bucket, pack_arrays(*a), None) for (chunk, _, _), a in zip(rows, answers, strict=True)]
        out.append((_TOTALS, bucket, None, stats))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ANSWERS.types, strict=True)], schema=_ANSWERS)

    return run


class Counted:
    """A chunk's n-grams with the totals, owners and needs that the ranges answered; start symbols are the last place."""

    def __init__(self, row: dict, answers: list[tuple[int, bytes]], buckets: int, order: int, texts: int) -> None:
        self.grams = Grams(row, order)
        self.total = [np.append(np.zeros(len(h), dtype=np.int64), texts) for h in self.grams.hashes]
        self.owner = [np.zeros(len(h), dtype=bool) for h in self.grams.hashes]
        self.need = [np.append(np.zeros(len(h), dtype=bool), True) for h in self.grams.hashes]
        cuts = [_cuts(h, buckets) for h in self.grams.hashes]
        for bucket, blob in answers:
            arrays = unpack_arrays(blob)
            for k in range(order):
                mine = slice(cuts[k][bucket], cuts[k][bucket + 1])
                self.total[k][mine] = arrays[2 * k]
                self.owner[k][mine] = arrays[2 * k + 1] & 1
                self.need[k][mine] = arrays[2 * k + 1] >> 1

    def wanted(self, k: int) -> np.ndarray:
        """Places of the histories, known in training, of n-grams of length k that were not seen there."""
        past = np.unique(self.grams.history[k - 1][self.total[k - 1][:-1] == 0])
        return past[self.total[k - 2][past] > 0]


def _send_histories(buckets: int, order: int, texts: int):
    """Owners' sums by needed history and what the chunk asks for, to ranges of histories."""
    begin = _start_hashes(order)

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        (row,) = chunk.to_pylist()
        counted = Counted(row, list(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True)), buckets, order, texts)
        grams = counted.grams
        parts: list[list[np.ndarray]] = [[] for _ in range(buckets)]
        for k in range(2, order + 1):
            hashes = np.append(grams.hashes[k - 2], begin[k - 2])
            mine = np.flatnonzero(counted.owner[k - 1] & counted.need[k - 2][grams.history[k - 1]])
            total = counted.total[k - 1][mine]
            less = counted.total[k - 2][grams.shorter[k - 1][mine]]
            past, at = np.unique(grams.history[k - 1][mine], return_inverse=True)
            n = len(past)
            by = lambda values: [np.bincount(at[values == r], minlength=n) for r in range(1, CUT + 1)]  # noqa: B023, E731
            sums = [*by(total), np.bincount(at, minlength=n), np.bincount(at, weights=np.where(less > CUT, less, 0), minlength=n).astype(np.int64), *by(less)]
            order_past = np.argsort(hashes[past])
            past, sums = hashes[past][order_past], [s[order_past] for s in sums]
            asks = np.sort(hashes[counted.wanted(k)])
            pe, ae = _cuts(past, buckets), _cuts(asks, buckets)
            for b in range(buckets):
                p, a = slice(pe[b], pe[b + 1]), slice(ae[b], ae[b + 1])
                parts[b] += [_steps(past[p]), *[_small(s[p]) for s in sums], _steps(asks[a])]
        sent = [(b, pack_arrays(*p)) for b, p in enumerate(parts) if any(map(len, p))]
        return pa.Table.from_batches([_messages([b for b, _ in sent], row["chunk"], [blob for _, blob in sent])])

    return run


def _merge_histories(order: int):
    """Adds up the sums of a range's histories over chunks and answers what chunks asked for, in the order of hashes."""
    width = SUMS + 2

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True))
        messages = [unpack_arrays(blob) for _, _, blob in rows]
        answers: list[list[np.ndarray]] = [[] for _ in rows]
        for k in range(order - 1):
            base = width * k
            past = [np.cumsum(m[base], dtype=np.uint64) for m in messages]
            known, at = np.unique(np.concatenate(past), return_inverse=True)
            merged = [np.bincount(at, weights=np.concatenate([m[base + 1 + i] for m in messages]), minlength=len(known)).astype(np.int64) for i in range(SUMS)]
            for m, answer in zip(messages, answers, strict=True):
                place = np.searchsorted(known, np.cumsum(m[base + width - 1], dtype=np.uint64))
                answer += [_small(s[place]) for s in merged]
        out = [(chunk, bucket, pack_arrays(*a)) for (chunk, bucket, _), a in zip(rows, answers, strict=True) if any(map(len, a))]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"chunk": pa.array(columns[0], pa.int32()), "bucket": pa.array(columns[1], pa.int64()), "blob": pa.array(columns[2], pa.binary())})

    return run


# --- discounts and scores -------------------------------------------------------------------


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Good-Turing discounts of the counts 1 to CUT (index 0 unused), scaled so that the counts above CUT keep theirs.

    Where counts of counts are too few for discounts between zero and one that way, each
    count r loses n1 / (n1 + 2 n2) at most, or FLOOR.
    """
    n = [0, *counts_of_counts]
    d = np.ones(CUT + 1)
    if all(n[r] > 0 for r in range(1, CUT + 2)):
        common = (CUT + 1) * n[CUT + 1] / n[1]
        if common < 1:
            d[1:] = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, CUT + 1)]
    if not ((d[1:] > 0) & (d[1:] < 1)).all():
        lost = max(FLOOR, min(0.9, n[1] / (n[1] + 2 * n[2]))) if n[1] else FLOOR
        d[1:] = [(r - lost) / r for r in range(1, CUT + 1)]
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """c* of each count: d*c up to CUT, c - FLOOR beyond; zero stays zero."""
    c = counts.astype(np.float64)
    return np.where(counts > CUT, c - FLOOR, c * d[np.minimum(counts, CUT)])


class KatzParameters:
    """Global numbers of the model: sizes and discounts by length."""

    def __init__(self, stats: list[int], texts: int, order: int) -> None:
        per = len(stats) // order
        self.tokens, self.types = stats[0], stats[1]
        self.texts = texts
        self.d = [discounts(stats[per * k + 2 : per * (k + 1)]) for k in range(order)]
        of_counts = np.array(stats[2 : 2 + CUT], dtype=float)
        freed = float(((1 - self.d[0][1:]) * np.arange(1, CUT + 1) * of_counts).sum()) + FLOOR * (self.types - float(of_counts.sum()))
        self.unknown = freed / self.tokens if self.tokens else 1.0

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d[0]) / max(1, self.tokens), self.unknown)

    def backoff(self, k: int, count: np.ndarray, shorter: np.ndarray, sums: list[np.ndarray]) -> np.ndarray:
        """Backoff weights to length k - 1 of histories, from their counts, those of their shorter forms and summed rows."""
        r = np.arange(1, CUT + 1)[:, None]
        n_r, types, mass, m_r = np.array(sums[:CUT], dtype=float), sums[CUT].astype(float), sums[CUT + 1].astype(float), np.array(sums[CUT + 2 :], dtype=float)
        freed = ((1 - self.d[k - 1][1:, None]) * r * n_r).sum(axis=0) + FLOOR * (types - n_r.sum(axis=0))
        seen = (mass - FLOOR * (types - m_r.sum(axis=0)) + (self.d[k - 2][1:, None] * r * m_r).sum(axis=0)) / np.maximum(1, shorter)
        return (freed / count) / np.maximum(1 - seen, 1e-300)


def _probabilities(counted: Counted, weights: dict[int, np.ndarray], p: KatzParameters, order: int) -> np.ndarray:
    """Probability of the last word of each n-gram of the longest length, by recursion over shorter ones."""
    grams = counted.grams
    found = p.unigram(counted.total[0][:-1])
    for k in range(2, order + 1):
        total, history = counted.total[k - 1][:-1], grams.history[k - 1]
        direct = discounted(total, p.d[k - 1]) / np.maximum(1, counted.total[k - 2][history])
        found = np.where(total > 0, direct, weights[k][history] * found[grams.shorter[k - 1]])
    return found


def _score(buckets: int, p: KatzParameters, order: int):
    begin = _start_hashes(order)

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        (row,) = chunk.to_pylist()
        counts, sums = [], []
        for kind, bucket, blob in zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True):
            (counts if kind == 0 else sums).append((bucket, blob))
        counted = Counted(row, counts, buckets, order, p.texts)
        grams = counted.grams
        blobs = {bucket: unpack_arrays(blob) for bucket, blob in sums}
        weights = {}
        for k in range(2, order + 1):
            weight = np.ones(len(grams.hashes[k - 2]) + 1)
            wanted = counted.wanted(k)
            hashes = np.append(grams.hashes[k - 2], begin[k - 2])[wanted]
            wanted = wanted[np.argsort(hashes)]
            cuts = _cuts(np.sort(hashes), buckets)
            shorter = np.append(grams.shorter[k - 2], len(grams.hashes[k - 3])) if k > 2 else None
            for b in np.flatnonzero(np.diff(cuts)):
                places = wanted[cuts[b] : cuts[b + 1]]
                less = counted.total[k - 3][shorter[places]] if k > 2 else np.full(len(places), p.tokens)
                weight[places] = p.backoff(k, counted.total[k - 2][places], less, blobs[int(b)][SUMS * (k - 2) : SUMS * (k - 1)])
            weights[k] = weight
        log = np.log10(_probabilities(counted, weights, p, order))
        count = counted.total[0][:-1]
        base_log = np.log10((count + 1) / (p.tokens + p.types + 1))
        add = lambda values: np.add.reduceat(values, grams.starts)
        codes = grams.at[0]
        return pa.table(
            {
                "doc_id": pa.array(grams.ids, pa.int64(), mask=grams.null.astype(bool)),
                "held_out": pa.array(~grams.trains),
                "n_tokens": pa.array(grams.sizes),
                "n_known": pa.array(add((count[codes] > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(grams.ids), p.tokens, dtype=np.int64)),
                "base_score": pa.array(add(base_log[codes])),
                "score": pa.array(add(log[grams.at[order - 1]])),
            }
        )

    return run


def _numbered(chunks: DataFrame) -> DataFrame:
    """Chunks numbered from 0 without gaps, by the counts of the tasks that made them, a row per task."""
    task = F.shiftright("chunk", 24).alias("task")
    order = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = chunks.groupBy(task).agg(F.count("*").alias("n"))
    before = materialize(counts.select("task", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before")), "katz-places")
    place = (F.col("before") + F.col("chunk").bitwiseAND((1 << 24) - 1)).cast("int")
    return chunks.withColumn("task", task).join(F.broadcast(before), "task").withColumn("chunk", place)


def score_katz(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk_text: int = CHUNK_TEXT, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Trains a model of n-grams up to ``order`` words on the rows where ``train`` holds and scores every whole text.

    Returns one row per input row: ``id_col``, held_out (not trained on), n_tokens, n_known
    (tokens seen in training), train_tokens, base_score (add-one unigram log10 probability),
    score (the model's log10 probability). A NULL or empty text is its end token. NULL and
    repeated ids come back as they are; a NULL ``train`` counts as false. Without training
    rows every token is unknown and has probability one. A text of any length is scored whole,
    as a chunk of its own if it is longer than ``chunk_text`` bytes. An empty table gives no
    rows. Other columns are ignored, whatever their names. Words and n-grams are told apart by
    64-bit hashes: of n distinct ones about n * n / 2**65 pairs share one by chance and are
    counted together.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    chunks = materialize(rows.mapInArrow(_chunks(chunk_text), "chunk long, docs binary, codes binary, words binary, tokens long, texts long"), "katz-chunks")
    sizes = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("texts"), F.lit(0)).alias("texts")).first()
    buckets = max(1, -(-sizes.tokens * order * GRAM_BYTES // range_bytes))
    own = _numbered(chunks).select("chunk", "docs", "codes", "words")
    across = max(sizes.n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_chunk = lambda df: df.repartitionById(across, F.col("chunk")).groupBy("chunk")
    by_range = lambda df: df.repartitionById(buckets, F.col("bucket")).groupBy("bucket")

    message = "bucket int, chunk int, blob binary"
    counts = by_range(own.mapInArrow(_send_grams(buckets, order), message)).applyInArrow(_merge_grams(order), "chunk int, bucket long, blob binary, stats array<long>")
    counts = materialize(counts, "katz-counts")
    totals = {r.i: r.n for r in counts.filter(F.col("chunk") == _TOTALS).select(F.posexplode("stats").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()}
    p = KatzParameters([totals.get(i, 0) for i in range(order * (CUT + 3))], sizes.texts, order)
    counts = counts.filter(F.col("chunk") != _TOTALS).select("chunk", "bucket", "blob", F.lit(0).alias("kind"))
    answers = counts
    if order > 1:
        sent = by_chunk(own).cogroup(by_chunk(counts)).applyInArrow(_send_histories(buckets, order, p.texts), message)
        sums = by_range(sent).applyInArrow(_merge_histories(order), "chunk int, bucket long, blob binary")
        answers = counts.union(sums.select("chunk", "bucket", "blob", F.lit(1)))
    scored = by_chunk(own).cogroup(by_chunk(answers)).applyInArrow(_score(buckets, p, order), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("doc_id", id_col)
