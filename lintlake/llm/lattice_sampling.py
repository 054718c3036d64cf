"""SentencePiece encoding by sampling distinct segmentations without replacement, and decoding.

A text's segmentations are the paths of its piece lattice. A path's probability is the product of its pieces', normalised
over all paths; a piece's follows Zipf's law over its rank in the vocabulary. Gumbel top-k samples k distinct paths
with one perturbed score each, in falling order. The scores are drawn top down: the best of a region of the lattice
is a Gumbel variable around the region's log mass, at most its parent's score. A best-first (A*) search keeps regions
in a heap. Taking the best one draws its path word by word from the lattice's backward sums, and leaves as new regions,
for each word of the rest, all paths that agree before that word and differ in it. The score of the first region
left after k gives each sample its inclusion score. In every piece blanks only lead, so texts are cut before each run of
blanks and the lattice of a text is a chain of word lattices; those of a group of texts are built and drawn from together, in arrays. Every number drawn follows from the
row's key, the round and the word's place, so a text gets the same samples in any group, partition or repeated task.
"""

from __future__ import annotations

import heapq
import math
import random
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LONG_WORD = 64
_GROUP_CHARS = 4_000_000
_NEAR = 80  # Gumbel variables of 53 bits differ by at most 41; regions this far behind k + 1 others can't be taken
_STEP, _PLACE, _ROUND = 0x632BE59BD9B4E019, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd constants that spread keys


class Pieces:
    """The pieces of a SentencePiece model with byte fallback, with a table of their trie."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        total = math.log(sum(1 / (r + 1) for r in range(size)))
        self.known: dict[str, tuple[float, tuple[int, ...]]] = {}
        self.bytes_of, self.byte = [b""] * size, {}
        for i in range(size):
            piece, score = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.bytes_of[i] = piece.replace("▁", " ").encode()
                if "▁" not in piece.lstrip("▁"):
                    self.known[piece] = (-math.log(max(0.0, -score) + 1) - total, (i,))
        self.byte_log = -math.log(size) - total
        self.longest = max(map(len, self.known))
        self.lines = not any("\n" in p for p in self.known)
        self._table()

    def _table(self) -> None:
        """The trie of the pieces as a table of next states; frequent characters have low codes, to lie together.

        Only characters of pieces of two or more have a code. All others stand alone, with one piece or their bytes.
        """
        used = Counter(c for p in self.known if len(p) > 1 for c in p)
        number = {c: k for k, (c, _) in enumerate(used.most_common(), 1)}
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in number]] = list(number.values())
        rows, piece_of = [np.zeros(len(number) + 1, np.int32) for _ in range(2)], [-1, -1]
        self.log, self.ids, self.n_ids, self.lone = np.zeros(0), np.zeros((0, 4), np.int32), np.zeros(0, np.int64), {}
        listed = [(p, own) for p, own in self.known.items() if all(c in number for c in p)]
        for n, (piece, _) in enumerate(listed):
            at = 1
            for c in piece:
                if not rows[at][number[c]]:
                    rows[at][number[c]] = len(rows)
                    rows.append(np.zeros(len(number) + 1, np.int32))
                    piece_of.append(-1)
                at = rows[at][number[c]]
            piece_of[at] = n
        self.next, self.piece_of = np.array(rows).ravel(), np.array(piece_of, np.int32)
        self.width = np.int32(len(number) + 1)
        self._add([own for _, own in listed])

    def _add(self, entries: list[tuple[float, tuple[int, ...]]]) -> None:
        self.log = np.concatenate([self.log, [w for w, _ in entries]])
        self.ids = np.concatenate([self.ids, np.array([(*own, 0, 0, 0)[:4] for _, own in entries], np.int32).reshape(-1, 4)])
        self.n_ids = np.concatenate([self.n_ids, np.array([len(own) for _, own in entries], np.int64)])

    def by_itself(self, char: str) -> tuple[float, tuple[int, ...]]:
        """Log probability and ids of a character: its piece, or else its bytes."""
        if own := self.known.get(char):
            return own
        raw = char.encode("utf-8", "replace")
        return self.byte_log * len(raw), tuple(self.byte[b] for b in raw)

    def entries_of(self, chars: np.ndarray) -> np.ndarray:
        """Numbers of the entries of characters that stand alone."""
        distinct, where = np.unique(chars, return_inverse=True)
        fresh = [c for c in distinct.tolist() if c not in self.lone]
        self.lone |= {c: len(self.log) + k for k, c in enumerate(fresh)}
        if fresh:
            self._add([self.by_itself(chr(c)) for c in fresh])
        return np.array([self.lone[c] for c in distinct.tolist()], np.int32)[where]


class Lattice:
    """The lattice of one word: the log mass of the paths from each place on; edges are found again when they are drawn."""

    def __init__(self, word: str, pieces: Pieces):
        self.word, self.pieces, self.mass = word, pieces, np.zeros(len(word) + 1)
        for i in range(len(word) - 1, -1, -1):
            logs = [v for _, v, _ in self._leaving(i)]
            top = max(logs)
            self.mass[i] = top + math.log(sum([math.exp(v - top) for v in logs]))

    def _leaving(self, i: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """End, log mass of the paths through it, and ids of every edge from a place."""
        word, pieces, n = self.word, self.pieces, len(self.word)
        found = [(j, own) for j in range(i + 1, min(n, i + pieces.longest) + 1) if (own := pieces.known.get(word[i:j]))]
        found = found or [(i + 1, pieces.by_itself(word[i]))]
        return [(j, w + float(self.mass[j]), own) for j, (w, own) in found]

    def edges(self, i: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """End, share of the paths from there on, and ids of every edge from a place."""
        return [(j, math.exp(v - self.mass[i]), own) for j, v, own in self._leaving(i)]

    def draw(self, uniform, ruled: dict[tuple[int, ...], float] | None = None) -> tuple[float, tuple[int, ...]]:
        """A path by its probability among those that are not in `ruled` (ids to log probabilities): its own, and its ids."""
        i, log, ids = 0, 0.0, []
        ruled = ruled or {}
        while i < len(self.word):
            at, ways = len(ids), self.edges(i)
            free = [max(0.0, p - sum([math.exp(v - log) for r, v in ruled.items() if r[at : at + len(own)] == own])) for _, p, own in ways]
            u = uniform() * sum(free)
            for (j, p, own), share in zip(ways, free, strict=True):  # noqa: B007
                u -= share
                if u < 0:
                    break
            log += math.log(p)
            ids += own
            i = j
            ruled = {r: v for r, v in ruled.items() if r[at : at + len(own)] == own}
        return min(log, 0.0), tuple(ids)


def _mixed(key: np.ndarray) -> np.ndarray:
    """64-bit keys, mixed."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        key = (key ^ (key >> np.uint64(shift))) * np.uint64(factor)
    return key ^ (key >> np.uint64(31))


def _uniform(key: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 by mixing 64-bit keys."""
    return (_mixed(key) >> np.uint64(11)).astype(float) / 2.0**53


class Words:
    """Texts with their leading marks, cut before each run of blanks and, if no piece holds one, around line ends."""

    def __init__(self, texts: list[str], lines: bool):
        self.whole = "▁" + "▁".join(texts).replace(" ", "▁")
        self.chars = chars = np.frombuffer(self.whole.encode("utf-32-le"), np.uint32)
        begins = chars == ord("▁")
        begins[1:] &= chars[:-1] != ord("▁")
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        begins[text_ends[:-1]] = True
        if lines:
            ends = chars == ord("\n")
            begins |= ends
            begins[1:] |= ends[:-1]
        self.starts = np.flatnonzero(begins)
        self.sizes = np.diff(self.starts, append=len(chars))
        self.ends = np.searchsorted(self.starts, text_ends)
        self.counts = np.diff(self.ends, prepend=0)

    def word(self, t: int) -> str:
        return self.whole[self.starts[t] : self.starts[t] + self.sizes[t]]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """One place of every distinct word, the longest first, and every word's number among them."""
        chars, starts = self.chars, self.starts
        spot = np.arange(len(chars)) - np.repeat(starts, self.sizes)
        parts = _mixed(np.arange(1, int(chars.max()) + 2, dtype=np.uint64))[chars]
        parts *= (_mixed(np.arange(int(self.sizes.max()), dtype=np.uint64)) | np.uint64(1))[spot]
        _, one, number = np.unique(np.add.reduceat(parts, starts) + self.sizes.astype(np.uint64), return_index=True, return_inverse=True)
        like = one[number]
        end = np.minimum(spot, np.repeat(self.sizes[like] - 1, self.sizes)) + np.repeat(starts[like], self.sizes)
        same = np.logical_and.reduceat(chars[end] == chars, starts) & (self.sizes == self.sizes[like])
        lone = np.flatnonzero(~same)  # words whose hash is that of another word
        number[lone] = len(one) + np.arange(len(lone))
        one = np.concatenate([one, lone])
        order = np.argsort(-self.sizes[one], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return one[order], rank[number]


class WordLattices:
    """The lattices of many words, the longest first, in arrays.

    Place 0 is the end of every word. The places with d characters left lie together, in the words' order, so the
    backward sums go over whole ranges. Edges of a place lie together as well, the longest piece first.
    """

    def __init__(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pieces: Pieces):
        self.pieces = pieces
        last, most = starts + sizes, int(sizes[0]) if len(sizes) else 0
        with_left = np.searchsorted(-sizes, -np.arange(1, most + 1), side="right")
        block = np.concatenate([[1], 1 + np.cumsum(with_left)])
        n = int(block[-1])
        char, following = np.zeros(n, np.uint32), np.zeros(n, np.int32)
        for d in range(1, most + 1):
            here = slice(block[d - 1], block[d])
            char[here] = chars[last[: with_left[d - 1]] - d]
            if d > 1:
                following[here] = np.arange(block[d - 2], block[d - 2] + with_left[d - 1])
        self.first = block[sizes - 1] + np.arange(len(sizes)) if len(sizes) else np.zeros(0, np.int64)
        code = pieces.code[char]
        at = np.arange(1, n, dtype=np.int32)
        to, state, parts = at, np.ones(len(at), np.int32), []
        count = np.zeros(n + 1, np.int32)
        for _ in range(pieces.longest):
            state = pieces.next[state * pieces.width + code[to]]
            on = np.flatnonzero(state)
            at, to, state = at[on], following[to[on]], state[on]
            piece = pieces.piece_of[state]
            own = np.flatnonzero(piece >= 0)
            count[at[own]] += 1
            parts.append((at[own], to[own], piece[own]))
            if not len(at):
                break
        bare = np.flatnonzero(count[1:n] == 0) + 1
        count[bare] = 1
        parts.append((bare, following[bare], pieces.entries_of(char[bare])))
        self.low = low = np.concatenate([[0], np.cumsum(count[:-1], dtype=np.int32)])
        m = int(low[-1])
        self.to, self.piece = np.zeros(m, np.int32), np.zeros(m, np.int32)
        filled = low.copy()
        for at, to, piece in reversed(parts):
            where = filled[at]
            self.to[where], self.piece[where] = to, piece
            filled[at] += 1
        mass, self.up_to = np.zeros(n), pieces.log[self.piece]
        for d in range(1, most + 1):
            a, b = low[block[d - 1]], low[block[d]]
            own, starts = self.up_to[a:b], low[block[d - 1] : block[d]] - a
            own += mass[self.to[a:b]]
            each = count[block[d - 1] : block[d]]
            top = np.maximum.reduceat(own, starts)
            own -= np.repeat(top, each)
            np.exp(own, out=own)
            mass[block[d - 1] : block[d]] = top + np.log(np.add.reduceat(own, starts))
        self._running(count[1:n])
        self.mass = mass[self.first]

    def _running(self, count: np.ndarray) -> None:
        """Turns the edges' shares into running sums at each place, of which the last is over 1."""
        starts, run = self.low[1:-1], self.up_to
        at, k = np.flatnonzero(count > 1), 1
        while len(at):
            run[starts[at] + k] += run[starts[at] + k - 1]
            k += 1
            at = at[count[at] > k]
        ends = starts + count - 1
        run /= np.repeat(run[ends], count)
        run[ends] = 2.0

    def draw(self, word: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """A path of each listed word (by number), with a 64-bit key each: log probabilities, numbers of ids, steps."""
        pieces, at, steps = self.pieces, self.first[word], []
        log, wrote = -self.mass[word], np.zeros(len(word), np.int64)
        live = np.arange(len(word))
        while len(live):
            u, e = _uniform(key), self.low[at]
            late = np.flatnonzero(u >= self.up_to[e])
            while len(late):
                e[late] += 1
                late = late[u[late] >= self.up_to[e[late]]]
            piece = self.piece[e]
            log[live] += pieces.log[piece]
            steps.append((live, wrote[live], piece))
            wrote[live] += pieces.n_ids[piece]
            at = self.to[e]
            on = np.flatnonzero(at)
            live, at, key = live[on], at[on], key[on] + np.uint64(_STEP)
        return np.minimum(log, 0.0), wrote, steps

    def written(self, steps: list, offset: np.ndarray, out: np.ndarray) -> None:
        """Puts the ids of drawn paths to their offsets in `out`."""
        for live, wrote, piece in steps:
            where, n = offset[live] + wrote, self.pieces.n_ids[piece]
            out[where] = self.pieces.ids[piece, 0]
            for k in range(1, 4):
                more = np.flatnonzero(n > k)
                if not len(more):
                    break
                out[where[more] + k] = self.pieces.ids[piece[more], k]


@cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def decode(ids: bytes, pieces: Pieces) -> str:
    """Text of little-endian 32-bit ids."""
    out = b"".join(map(pieces.bytes_of.__getitem__, np.frombuffer(ids, "<i4").tolist()))
    return out.decode("utf-8", "replace")[1:]


def sampled(text: str, k: int, key: int, pieces: Pieces) -> list[tuple[float, float, float, bytes]]:
    """(log probability, perturbed score, inclusion score, ids) of at most k distinct segmentations, best first."""
    return sampled_group([text], k, [key], pieces)[0]


def sampled_group(texts: list[str], k: int, keys: list[int], pieces: Pieces) -> list[list[tuple[float, float, float, bytes]]]:
    """`sampled` for several texts: k whole draws of every text, of which the search takes the parts it needs."""
    words = Words(texts, pieces.lines)
    one, word = words.distinct()
    n_long = int(np.searchsorted(-words.sizes[one], -_LONG_WORD))
    word -= n_long
    many = WordLattices(words.chars, words.starts[one[n_long:]], words.sizes[one[n_long:]], pieces)
    long = [Lattice(words.word(t), pieces) for t in one[:n_long]]
    counts, ends = words.counts, words.ends
    place = np.arange(len(word)) - np.repeat(ends - counts, counts)
    base = np.repeat(np.array(keys, np.uint64), counts) + place.astype(np.uint64) * np.uint64(_PLACE)
    short, others = np.flatnonzero(word >= 0), np.flatnonzero(word < 0)
    rounds = []
    for r in range(k):
        key = base + np.uint64(r * _ROUND % 2**64)
        log, size = np.zeros(len(word)), np.zeros(len(word), np.int64)
        log[short], size[short], steps = many.draw(word[short], key[short])
        drawn = [long[word[at] + n_long].draw(random.Random(int(key[at])).random) for at in others.tolist()]
        log[others], size[others] = [w for w, _ in drawn], [len(own) for _, own in drawn]
        offset = np.concatenate([[0], np.cumsum(size)])
        ids = np.zeros(offset[-1], "<i4")
        many.written(steps, offset[short], ids)
        for at, (_, own) in zip(others.tolist(), drawn, strict=True):
            ids[offset[at] : offset[at + 1]] = own
        rounds.append((log, offset, ids))
    out = []
    for a, b, key in zip((ends - counts).tolist(), ends.tolist(), keys, strict=True):
        lattice = lambda t, a=a: Lattice(words.word(a + t), pieces)
        out.append(_best_first(lattice, [(log[a:b], offset[a : b + 1], ids) for log, offset, ids in rounds], k, key))
    return out


def _regions(log: np.ndarray, before: np.ndarray, ruled: dict) -> tuple[np.ndarray, np.ndarray]:
    """The words at which other paths leave a path, and the log mass of those."""
    gone = np.exp(log)
    if ruled:
        gone[0] = sum(map(math.exp, ruled.values()))
    at = np.flatnonzero(gone < 1 - 1e-12)
    return at, before[at] + np.log1p(-gone[at])


def _best_first(lattice: Callable[[int], Lattice], rounds: list[tuple], k: int, key: int) -> list[tuple[float, float, float, bytes]]:
    uniform, seed = random.Random(key).random, np.random.default_rng(key)
    # A region: score, tie-break, the path it leaves, the word at which it leaves it, what it rules out there.
    heap = [(math.log(-math.log(uniform() or 1e-300)), 0, None, 0, {})]
    ties, found = 1, []
    while heap and len(found) < k:
        score, _, parent, start, ruled = heapq.heappop(heap)
        score, (log, offset, ids) = -score, rounds[len(found)]
        if ruled:
            step, own = lattice(start).draw(uniform, ruled)
            ruled = ruled | {own: step}
            log0, offset0, ids0 = parent
            kept, rest = ids0[offset0[0] : offset0[start]], ids[offset[start + 1] : offset[-1]]
            log = np.concatenate([log0[:start], [step], log[start + 1 :]])
            turn = len(kept) + len(own)
            offset = np.concatenate([offset0[: start + 1] - offset0[0], offset[start + 1 :] - offset[start + 1] + turn])
            ids = np.concatenate([kept, np.array(own, "<i4"), rest])
        path = (log, offset, ids)
        before = np.cumsum(log) - log
        found.append((float(log.sum()), score, ids[offset[0] : offset[-1]].tobytes()))
        near = int(np.searchsorted(-before[start:], _NEAR - before[start]))
        at, mass = _regions(log[start : start + near], before[start : start + near], ruled)
        if near < len(log) - start and (len(mass) <= k or np.partition(mass, -k - 1)[-k - 1] < before[start] - _NEAR + 41):
            at, mass = _regions(log[start:], before[start:], ruled)
        bound = mass + seed.gumbel(size=len(at))
        best = np.argpartition(-bound, k)[: k + 1] if len(bound) > k + 1 else np.arange(len(bound))
        low = -np.logaddexp(-score, -bound[best])  # Gumbel variables around the masses, cut off at the score
        for c, bound in zip(at[best].tolist(), low.tolist(), strict=True):
            t = start + c
            out = ruled if t == start and ruled else {tuple(ids[offset[t] : offset[t + 1]].tolist()): float(log[t])}
            heapq.heappush(heap, (-bound, ties, path, t, out))
            ties += 1
    limit = -heap[0][0] if heap else -math.inf
    return [(w, s, 1.0 if limit == -math.inf else -math.expm1(-math.exp(min(w - limit, 700.0))), own) for w, s, own in found]


def sampled_texts(docs: DataFrame, model: str, k: int = 2, with_ids: bool = True) -> DataFrame:
    """doc_id, sample (0: the best), log_prob, perturbed, inclusion, n_pieces, ids, ids_crc32, round_trip.

    Up to `k` rows for every row of `docs`, fewer where a text has fewer segmentations (what is left of a region at a word
    counts as none under a share of 1e-12). Words of `_LONG_WORD` characters or more, runs of blanks before them included,
    are drawn one by one and from other random numbers, by the same law. `round_trip` tells whether
    decoding gives the text back. A null or empty text has the segmentations of the leading mark alone; repeated rows
    draw the same samples, as the seed follows from id and text; an empty table gives an empty one; further
    columns are ignored. `with_ids` leaves the ids themselves out if false.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            sizes = pc.utf8_length(batch["_text"]).to_numpy(zero_copy_only=False)
            group = (np.cumsum(sizes + 1) - 1) // _GROUP_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
            for low, high in pairwise(cuts if len(batch) else []):
                part, rows = batch.slice(low, high - low), []
                docs_, texts = part["doc_id"].to_pylist(), part["_text"].to_pylist()
                keys = [xxhash.xxh64_intdigest(f"{doc}\n{text}", 3) for doc, text in zip(docs_, texts, strict=True)]
                for doc, text, found in zip(docs_, texts, sampled_group(texts, k, keys, pieces), strict=True):
                    for r, (w, s, inclusion, ids) in enumerate(found):
                        listed = np.frombuffer(ids, "<u4").astype(np.int32) if with_ids else None
                        rows.append((doc, r, w, s, inclusion, len(ids) // 4, listed, zlib.crc32(ids), decode(ids, pieces) == text))
                kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.bool_())
                names = ["doc_id", "sample", "log_prob", "perturbed", "inclusion", "n_pieces", "ids", "ids_crc32", "round_trip"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    shape = "doc_id bigint, sample int, log_prob double, perturbed double, inclusion double, n_pieces int, ids array<int>, ids_crc32 bigint, round_trip boolean"
    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(sample, shape)
