"""Sequence packing as a cutting-stock problem solved by column generation.

1. Tasks tokenise whole documents and cut them into full pieces and one remainder. Each
   piece carries its rank among the pieces of its length in its task.
2. The histogram of lengths, at most one row per length, goes to the driver. A linear
   program over patterns is solved by the revised simplex method; a knapsack dynamic
   program over exact fills prices new columns. Patterns are rounded down, and the few
   pieces left over (bounded by the number of patterns, whatever the input) are packed
   by best fit.
3. The rounded patterns become slots, a table bounded by the number of lengths and
   patterns. Every piece finds its slot by its global rank within its length.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolattice.llm.common import materialize, small_slices

#: The pattern by which the byte-level tokenizer parts a text into pieces, each encoded by itself.
_PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Characters whose classes are the same in every edition of Unicode; texts with others are encoded whole.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏͰ-ϿЀ-ӿ‐-‧€]*")
_SPECIAL = "<|endoftext|>"
#: A space between two others that are none: pieces always end before it, so a long text may be parted there.
_SEAM = re.compile(r"(?<=\S) (?=\S)")
_SEGMENT = 1 << 20


class PieceIds(dict):
    """Ids of pieces, as little-endian unsigned 32-bit bytes, remembered for short ones; at most ``most`` are kept."""

    def __init__(self, vocabulary: str, most: int = 1 << 19, longest: int = 32) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.longest = Tokenizer.from_file(vocabulary), most, longest
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = "".join(_byte_letters())

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(self.letters)
        found = [t.id for t in self.tokenize(spelled)]
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies spell each byte: printable ones stand for themselves, the others for those from 256 on."""
    spare = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173 else chr(next(spare)) for b in range(256)]


@functools.lru_cache(maxsize=4)
def _piece_ids(vocabulary: str) -> PieceIds:
    return PieceIds(vocabulary)


def token_ids(text: str, vocabulary: str) -> np.ndarray:
    """Ids of a whole text of any length by the tokenizer of ``vocabulary`` (a json file), without special tokens added.

    The tokenizer encodes each piece of a text by itself, so pieces that were met before are
    looked up. Texts with characters that the libraries might part differently, or with the
    special token's string, are encoded whole.
    """
    known = _piece_ids(vocabulary)
    if _SPECIAL in text or not _PLAIN.fullmatch(text):
        return np.frombuffer(known.whole(text), dtype="<u4")
    parts, at = [], 0
    while at < len(text):
        seam = _SEAM.search(text, at + _SEGMENT)
        end = seam.start() if seam else len(text)
        parts += map(known.__getitem__, _PIECES.findall(text, at, end))
        at = end
    return np.frombuffer(b"".join(parts), dtype="<u4")


def _cut(vocabulary: str, capacity: int, separator: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "local"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in small_slices(batches, "text"):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(token_ids(text.as_py() or "", vocabulary), np.array([separator], dtype="<u4")).astype("<u4", copy=False)
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    n = len(piece)
                    rows.append((doc_id, start, n, zlib.crc32(piece.tobytes()), len(ids), task, seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return run


def padded(total: int, capacity: int) -> int:
    """Length of a sequence once padded: powers of two stay as they are."""
    return total if total & (total - 1) == 0 else capacity


def price_columns(lengths: np.ndarray, values: np.ndarray, capacity: int, most: int) -> list[np.ndarray]:
    """Patterns (counts by length) with the most negative reduced costs, by one knapsack table.

    ``best[s]`` is the largest value of a multiset of lengths that adds up to exactly s.
    """
    worth = np.full(capacity + 1, -np.inf)
    place = np.zeros(capacity + 1, dtype=np.int64)
    worth[lengths], place[lengths] = values, np.arange(len(lengths))
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0.0
    choice = np.zeros(capacity + 1, dtype=np.int64)
    for s in range(1, capacity + 1):
        options = worth[1 : s + 1] + best[s - 1 :: -1][:s] if s > 1 else worth[1:2] + best[0]
        at = int(options.argmax())
        best[s], choice[s] = options[at], at + 1
    costs = np.array([padded(s, capacity) for s in range(capacity + 1)], dtype=float)
    reduced = costs - best
    reduced[0] = 0.0
    found = []
    for s in np.argsort(reduced, kind="stable")[:most]:
        if reduced[s] > -1e-7:
            break
        pattern, left = np.zeros(len(lengths)), int(s)
        while left:
            pattern[place[choice[left]]] += 1
            left -= int(choice[left])
        found.append(pattern)
    return found


def fill_bin(left: np.ndarray, capacity: int, whole: bool = True) -> list[int]:
    """Takes the longest piece of ``left`` (amounts by length) and what fills its bin best, exact fills by one or two more first.

    With ``whole`` the pieces leave ``left``; without, a length may be used again and again.
    """
    length = int(np.flatnonzero(left)[-1])
    pieces, room = [length], capacity - length
    left[length] -= whole
    while room:
        have = left[: room + 1] > 0
        if have[room]:
            parts = [room]
        else:
            pairs = np.flatnonzero(have & have[::-1])
            if whole and room % 2 == 0 and left[room // 2] < 2:
                pairs = pairs[pairs * 2 != room]
            fits = np.flatnonzero(have)
            if len(pairs):
                parts = [int(pairs[-1]), room - int(pairs[-1])]
            elif len(fits):
                parts = [int(fits[-1])]
            else:
                break
        for part in parts:
            pieces.append(part)
            left[part] -= whole
            room -= part
    return pieces


def starting_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis and its inverse.

    Each greedy pattern is used, in fractions, until one of its lengths runs out, and becomes
    that length's column. A pattern holds no length that ran out before, so in the order of
    running out the basis is triangular, and substitution inverts it.
    """
    place = np.full(capacity + 1, -1)
    place[lengths] = np.arange(len(lengths))
    left = np.zeros(capacity + 1)
    left[lengths] = demand
    basis = np.zeros((len(lengths), len(lengths)))
    order: list[int] = []
    while left.any():
        pattern = np.bincount(fill_bin(left, capacity, whole=False), minlength=capacity + 1)
        used = np.flatnonzero(pattern)
        ratios = left[used] / pattern[used]
        out = used[ratios.argmin()]
        left[used] = np.maximum(left[used] - pattern[used] * ratios.min(), 0.0)
        left[out] = 0.0
        basis[place[used], place[out]] = pattern[used]
        together = [int(place[n]) for n in used if not left[n] and n != out]
        for i in together:
            basis[i, i] = capacity // lengths[i]
        order += [int(place[out]), *together]
    inverse = np.zeros_like(basis)
    for i in order:
        inverse[i, i] = 1.0
        for j in np.flatnonzero(basis[i]):
            if j != i:
                inverse[i] -= basis[i, j] * inverse[j]
        inverse[i] /= basis[i, i]
    return basis, inverse


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", matrix, vector)  # one thread, whatever the driver's BLAS does


def solve_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.0005, max_pivots: int = 400, per_round: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Basic solution of the pattern program by column generation: (patterns by column, amounts).

    Minimises padded tokens subject to using every piece. Stops when the objective is within
    ``gap`` of the number of tokens, which no packing can beat, when no column prices out, or
    after ``max_pivots`` exchanges (the solution is then feasible but may be improvable).
    """
    basis, inverse = starting_basis(lengths, demand, capacity)
    nudged = demand * (1 + 1e-9 * np.arange(1, len(lengths) + 1))  # no two ratios tie, so no cycles
    amounts = np.maximum(_times(inverse, nudged), 0.0)
    costs = np.array([padded(int(t), capacity) for t in _times(basis.T, lengths.astype(float))], dtype=float)
    least = float(lengths @ demand)
    pivots = 0
    while pivots < max_pivots and costs @ amounts > least * (1 + gap):
        moved = False
        for pattern in price_columns(lengths, _times(inverse.T, costs), capacity, per_round):
            cost = float(padded(int(pattern @ lengths), capacity))
            used = np.flatnonzero(pattern)
            direction = _times(inverse[:, used], pattern[used])
            if cost - costs @ direction > -1e-7:
                continue
            up = np.flatnonzero(direction > 1e-9)
            if not len(up):
                continue
            row = int(up[(amounts[up] / direction[up]).argmin()])
            pivot_row = inverse[row] / direction[row]
            inverse -= np.outer(direction, pivot_row)
            inverse[row] = pivot_row
            basis[:, row], costs[row] = pattern, cost
            amounts = np.maximum(_times(inverse, nudged), 0.0)
            pivots += 1
            moved = True
        if not moved:
            break
    return basis, amounts


def plan_slots(histogram: dict[int, int], capacity: int, **limits) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, per, sequence, offset): pieces of ``length`` ranked low to high - 1 go, ``per`` to each, to sequences counted from ``sequence``, from ``offset``."""
    slots: list[tuple[int, int, int, int, int, int]] = []
    taken = dict.fromkeys(histogram, 0)
    sequence = 0

    def place(pieces: list[tuple[int, int]], copies: int) -> None:
        nonlocal sequence
        offset = 0
        for length, per in pieces:
            low = taken[length]
            taken[length] = high = low + per * copies
            slots.append((length, int(low), int(high), per, int(sequence), offset))
            offset += per * length
        sequence += copies

    if histogram.get(capacity):
        place([(capacity, 1)], histogram[capacity])
    rest = sorted(n for n in histogram if n < capacity)
    if rest:
        lengths, demand = np.array(rest), np.array([histogram[n] for n in rest], dtype=float)
        patterns, amounts = solve_patterns(lengths, demand, capacity, **limits)
        left = demand.astype(np.int64)
        order = np.argsort(-amounts, kind="stable")
        for rounds in (0, 1):  # whole copies first, then one more where its pieces are still there
            for p in order:
                counts = patterns[:, p].astype(np.int64)
                used = np.flatnonzero(counts)
                most = int((left[used] // counts[used]).min())
                copies = min(int(amounts[p] + 1e-6), most) if not rounds else min(1, most) * (amounts[p] % 1 > 0.5)
                if copies:
                    left[used] -= copies * counts[used]
                    place([(int(lengths[i]), int(counts[i])) for i in used[::-1]], copies)
        held = np.zeros(capacity + 1, dtype=np.int64)
        held[lengths] = left
        while held.any():
            pieces = fill_bin(held, capacity)
            place([(n, pieces.count(n)) for n in sorted(set(pieces), reverse=True)], 1)
    return slots


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, separator: int = 0) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens with little padding.

    A document's ids are those of ``vocabulary`` (a tokenizer's json file that every machine
    has), then ``separator``. Returns one row per piece: ``id_col``, start, length, ids_crc32
    (unsigned CRC-32 of its ids as little-endian unsigned 32-bit), doc_tokens, sequence_id
    (from 0, without gaps), offset. Pieces of one sequence do not overlap and leave no gap.

    Texts of any length are encoded whole. NULL and empty texts are a piece with the separator alone. Rows that repeat an id are
    packed as often; a NULL id stays NULL. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, local long"
    pieces = materialize(rows.mapInArrow(_cut(vocabulary, capacity, separator), schema), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.expr("coalesce(sum(n) OVER (PARTITION BY length ORDER BY task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    counts = materialize(counts.select("length", "task", "n", before.alias("before")), "piece-ranks")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length, at most capacity
    slots = docs.sparkSession.createDataFrame(plan_slots(histogram, capacity), "length long, low long, high long, per long, first long, at long")
    ranked = pieces.join(counts, ["length", "task"]).withColumn("rank", F.col("before") + F.col("local"))
    placed = ranked.join(F.broadcast(slots), "length").filter("rank >= low AND rank < high")
    nth = F.col("rank") - F.col("low")
    return placed.select(
        F.col("doc_id").alias(id_col),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.expr("first + (rank - low) div per").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("per")) * F.col("length")).alias("offset"),
    )
