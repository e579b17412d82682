"""SentencePiece segmentations sampled without replacement, and decoding.

The pieces of a SentencePiece model that may stand at each place of a text form a lattice.  A path's
probability is the product of its pieces' (a unigram model: frequency falls with a piece's rank in the
model as 1 / (rank + SHIFT), raised to `alpha`), over the sum for all paths.  The k samples of a text are
its Gumbel top-k: the k paths with the largest perturbed log-probabilities, in that order, each with its
inclusion score, the chance of being above the (k + 1)-th.

The search for them is an A* over sets of paths.  The largest perturbed value in a set of total mass M,
known to be below t, is a Gumbel variable of location log M cut at t; so a set's best value is drawn
before its paths are, and the set with the best value is opened first.  Opening draws its best path
forward through the lattice (backward sums give the chance of each next piece) and leaves the rest of the
set, sorted by the place where a path first departs from the drawn one; the path and its departures'
masses are vectors, so a text costs k forward draws and no expansion of nodes.  Values are drawn from
hashes of (seed, row key, place), never from the order of rows.

Pieces never reach over a blank that follows another character, so texts are lattices of words in a row.
The lattices of all words of a batch are built and summed together.

Defined results: a null text has no rows; an empty text has one sample without pieces; texts with fewer
than k segmentations have fewer samples; characters outside the vocabulary become byte pieces; equal
row keys with equal texts sample alike; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, ship, trimmed
from .encoding import token_path
from .neardup import _M1, _M2, mix
from .steps import steps

MODEL, SHIFT, ALPHA, SAMPLES, SEED = "piece_bpe_32k.model", 2.7, 1.0, 2, 11
_STEP, _GIVE_BACK = 1 << 20, 8 << 20
_BASE, _ALL = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1
_WORDS = re.compile("▁+[^▁]*|[^▁]+")
#: Edges of the lattices that a worker keeps, of 20 bytes each besides their nodes and words.
_KEEP_EDGES = 1_500_000
#: Words whose lattices are built at once.
_BUILD = 16_000
_vocabularies: dict[tuple[str, float], "Vocabulary"] = {}


class Vocabulary:
    """Pieces by length with their log-probabilities, found by hash."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=token_path(path))
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.raw = [p.replace("▁", " ").encode() for p in self.pieces]
        self.bytes = np.full(256, -1, np.int64)
        normal = []
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append(i)
        best = max(sp.get_score(i) for i in normal)
        weight = {i: -np.log(best - sp.get_score(i) + SHIFT) for i in normal}
        total = np.log(sum(np.exp(w) for w in weight.values()))
        self.byte_logp = alpha * (-np.log(n + SHIFT) - total)
        self.longest = max(len(self.pieces[i]) for i in normal)
        self.words = pa.array([], pa.string())  # whose lattices are kept
        self.by_length, self.filter = {}, np.zeros(1 << 20, bool)
        for length in range(1, self.longest + 1):
            own = [i for i in normal if len(self.pieces[i]) == length]
            if not own:
                continue
            codes = np.array([[ord(c) for c in self.pieces[i]] for i in own], np.uint64)
            h = mix(codes[:, 0])
            for k in range(1, length):
                h = h * _BASE + mix(codes[:, k])
            order = np.argsort(h)
            self.by_length[length] = h[order], np.array(own)[order], np.array([alpha * (weight[i] - total) for i in own])[order]
            self.filter[(h >> np.uint64(44)).astype(np.int64)] = True
        self.lattices = Shelf(self)


def vocabulary(path: str, alpha: float = ALPHA) -> Vocabulary:
    """One for each Python worker and model."""
    claim(f"lattice {path}", _vocabularies.clear)
    if (path, alpha) not in _vocabularies:
        _vocabularies[path, alpha] = Vocabulary(path, alpha)
    return _vocabularies[path, alpha]


class Lattices:
    """The lattices of words, their nodes numbered by distance from the word's end.

    start[w]: first node of a word.  Edges of a node are first[node]:first[node + 1]; an edge has its
    piece (or minus the code of a character without a piece), its target, its chance and, on a grid,
    the chance of the node's edges up to it.
    """

    def __init__(self, words: list[str], v: Vocabulary):
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(len(code))  # characters to the end of the word, from 1
        single = np.zeros(len(code), bool)
        h = mixed = mix(code)
        here = np.arange(len(code))  # places with enough characters to the end of their word
        found = []  # for each length (places, pieces, log-probabilities)
        for length in range(1, min(v.longest, int(lengths.max(initial=0))) + 1):
            if length > 1:
                go = left[here] >= length
                here = here[go]
                h = h[go] * _BASE + mixed[here + length - 1]
            if length not in v.by_length:
                continue
            maybe = np.flatnonzero(v.filter[(h >> np.uint64(44)).astype(np.int64)])
            at, mine = here[maybe], h[maybe]
            known, ids, logp = v.by_length[length]
            k = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            hit = known[k] == mine
            at, k = at[hit], k[hit]
            if length == 1:
                single[at] = True
            found.append((length, at, ids[k], logp[k]))
        odd = np.flatnonzero(~single)
        if len(odd):
            c = code[odd].astype(np.int64)
            found.insert(0, (1, odd, -c, v.byte_logp * (1.0 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))))
        # nodes by distance from the end, ends (distance 0) first; node_of[i] is the node of character i
        by_left = np.argsort(left.astype(np.uint16) if lengths.max(initial=0) < 1 << 16 else left, kind="stable")
        node_of = np.empty(len(code), np.int64)
        node_of[by_left] = np.arange(len(code)) + 1
        sizes = np.zeros(len(code), np.int64)
        for _, at, _, _ in found:
            sizes[at] += 1
        self.first = np.zeros(len(code) + 2, np.int64)
        np.cumsum(sizes[by_left], out=self.first[2:])
        # a node's edges lie from the longest piece, most often the likeliest, to the shortest
        n = int(self.first[-1])
        self.target, self.piece, logp = np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n)
        free = self.first[node_of]
        for length, at, ids, p in reversed(found):
            to = free[at]
            free[at] += 1
            self.piece[to], logp[to] = ids, p
            self.target[to] = np.where(left[at] == length, 0, node_of[np.minimum(at + length, len(code) - 1)])
        beta = np.zeros(len(code) + 1)
        self.chance = np.ones(n)
        levels = np.append(0, np.cumsum(np.bincount(left, minlength=1)[1:])) + 1
        for a, b in zip(levels[:-1].tolist(), levels[1:].tolist()):
            if a == b:
                continue
            lo, hi = int(self.first[a]), int(self.first[b])
            w, starts = logp[lo:hi] + beta[self.target[lo:hi]], self.first[a:b] - lo
            top = np.maximum.reduceat(w, starts)
            counts = np.diff(np.append(starts, hi - lo))
            e = np.exp(w - np.repeat(top, counts))
            total = np.add.reduceat(e, starts)
            beta[a:b] = top + np.log(total)
            self.chance[lo:hi] = e / np.repeat(total, counts)
        # chances add up within a node in its own order, then lie on a grid of 2^-32: choices don't depend on the batch
        run, begin, size = self.chance.copy(), self.first[1:-1], np.diff(self.first)[1:]
        for r in range(1, int(size.max(initial=0))):
            go = np.flatnonzero(size > r)
            begin, size = begin[go], size[go]
            run[begin + r] += run[begin + r - 1]
        self.upto = np.clip(run * 2.0**32 - 1, 0, 2.0**32 - 1).astype(np.uint32)
        self.upto[self.first[2:] - 1] = 0xFFFFFFFF
        self.start = node_of[ends - lengths] if len(words) else np.empty(0, np.int64)

    def step(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge that each u (32 bits) chooses at its node."""
        edge = self.first[node]
        at = np.flatnonzero(u > self.upto[edge])
        while len(at):
            edge[at] += 1
            at = at[u[at] > self.upto[edge[at]]]
        return edge


class Shelf(Lattices):
    """The lattices of kept words and, behind them, those of the words at hand, in arrays that are written in place."""

    def __init__(self, v: Vocabulary):
        super().__init__([], v)
        self.room = {name: getattr(self, name) for name in ("target", "piece", "chance", "upto", "first", "start")}
        self.kept = {name: len(x) for name, x in self.room.items()}

    def add(self, other: Lattices, keep: bool) -> None:
        """Other lattices behind those that are there; kept ones come before all that are not."""
        n, m = len(self.first) - 2, len(self.target)
        more = {"target": np.where(other.target > 0, other.target + np.int32(n), np.int32(0)), "first": other.first[2:] + m, "start": other.start + n}
        for name, room in self.room.items():
            x, at = more.get(name, getattr(other, name, None)), len(getattr(self, name))
            if at + len(x) > len(room):
                self.room[name] = np.empty((at + len(x)) * 9 // 8, room.dtype)
                self.room[name][:at] = room[:at]
            self.room[name][at : at + len(x)] = x
            setattr(self, name, self.room[name][: at + len(x)])
        if keep:
            self.kept = {name: len(getattr(self, name)) for name in self.room}

    def forget(self) -> None:
        """Back to the kept lattices; the room of an unusually large step goes too."""
        if len(self.room["target"]) > 2 * max(_KEEP_EDGES, self.kept["target"]):
            self.room = {name: x[: self.kept[name]].copy() for name, x in self.room.items()}
        for name, x in self.room.items():
            setattr(self, name, x[: self.kept[name]])


def _draw(lattices: Lattices, start: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A path through each word: (edges in order, offsets by word)."""
    steps_, active, node, t = [], np.arange(len(start)), start, 0
    counts = np.zeros(len(start), np.int64)
    while len(active):
        edge = lattices.step(node, (mix(keys + np.uint64(t * int(_BASE) & _ALL)) >> np.uint64(32)).astype(np.uint32))
        steps_.append((active, edge))
        node = lattices.target[edge]
        go = np.flatnonzero(node)
        t += 1
        if len(go) < len(active):
            counts[active] = t
        active, node, keys = active[go], node[go], keys[go]
    offsets = np.append(0, np.cumsum(counts))
    out = np.empty(offsets[-1], np.int64)
    for t, (active, edge) in enumerate(steps_):
        out[offsets[active] + t] = edge
    return out, offsets


class _Set:
    """Paths that depart from a drawn path at or after a place, but not by its excluded edges."""

    def __init__(self, path: np.ndarray, offsets: np.ndarray, before: float, fixed: int, lattices: Lattices):
        self.path, self.offsets, self.out = path, offsets, {}
        c = lattices.chance[path[fixed:]]
        self.log_before = np.empty(len(c) + 1)
        self.log_before[0] = 0.0
        np.cumsum(np.log(c), out=self.log_before[1:])
        self.log_before += before
        self.mass = np.exp(self.log_before[:-1]) * (1 - c)  # nothing where a node has one edge
        self.fixed, self.value = fixed, -math.inf

    def lower(self, below: float, u: float) -> None:
        total = float(self.mass.sum())
        self.value = -math.inf if total <= 0 else math.log(total) - float(np.logaddexp(math.log(total) - below, math.log(-math.log(u))))


def _units(key: int) -> Iterator[float]:
    """Numbers in (0, 1) that follow from a key."""
    for tick in count(1):
        x = (key + 0x51ED2701 * tick) & _ALL
        x = ((x ^ (x >> 30)) * int(_M1)) & _ALL
        x = ((x ^ (x >> 27)) * int(_M2)) & _ALL
        yield (((x ^ (x >> 31)) >> 12) + 0.5) * 2.0**-52


def top_k(lattices: Lattices, draws: list[tuple[np.ndarray, np.ndarray]], key: int, k: int) -> list[tuple[np.ndarray, float, float]]:
    """(edges, log-probability, perturbed log-probability) of the k samples and the value below them.

    draws: k independent draws of the text, each as (edges, offsets by word).
    """
    units = _units(key)
    path, offsets = draws[0]
    value = -math.log(-math.log(next(units)))
    sets = [_Set(path, offsets, 0.0, 0, lattices)]
    out = [(path, float(sets[0].log_before[-1]), value)]
    sets[0].lower(value, next(units))
    while True:
        best = max(sets, key=lambda s: s.value)
        if best.value == -math.inf or len(out) == k:
            return [*out, (None, 0.0, best.value)]
        value, run = best.value, np.cumsum(best.mass)
        m = int(np.searchsorted(run, next(units) * run[-1], "right"))
        if m == len(run) or not best.mass[m]:
            m = int(np.flatnonzero(best.mass)[-1])
        at = best.fixed + m
        taken = int(best.path[at])
        node = int(np.searchsorted(lattices.first, taken, "right")) - 1
        lo, hi = int(lattices.first[node]), int(lattices.first[node + 1])
        others = [e for e in range(lo, hi) if e != taken and e not in best.out.get(m, ())]
        chances = list(accumulate(lattices.chance[others].tolist()))
        edge = others[min(bisect_right(chances, next(units) * chances[-1]), len(others) - 1)]
        chance = float(lattices.chance[edge])
        best.out.setdefault(m, set()).add(edge)
        best.mass[m] = max(0.0, best.mass[m] - math.exp(best.log_before[m]) * chance) if len(others) > 1 else 0.0
        # the departing edge, then a free draw to the end of the word and through the words after it
        tail, there = [edge], int(lattices.target[edge])
        while there:
            u, e = int(next(units) * 2**32), int(lattices.first[there])
            while u > lattices.upto[e]:
                e += 1
            tail.append(e)
            there = int(lattices.target[e])
        free, off = draws[len(out)]
        word = int(np.searchsorted(best.offsets, at, "right")) - 1
        new = np.concatenate([best.path[:at], np.array(tail, np.int64), free[off[word + 1] :]])
        new_offsets = np.concatenate([best.offsets[: word + 1], off[word + 1 :] + (at + len(tail) - off[word + 1])])
        inner = _Set(new, new_offsets, float(best.log_before[m]) + math.log(chance), at + 1, lattices)
        out.append((new, float(inner.log_before[-1]), value))
        best.lower(value, next(units))
        inner.lower(value, next(units))
        sets.append(inner)


def _split(texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
    """The words of texts, without the mark that each starts with, and the rows of the texts, which change places."""
    # runs of blanks, blanks at the start and marks in the text make words that begin with several marks
    odd = pc.match_substring_regex(texts, r"  |\A |▁|\A\z")
    rows = np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")
    plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    rest = [[w[1:] for w in _WORDS.findall("▁" + t.replace(" ", "▁"))] if t else [] for t in texts.filter(odd).to_pylist()]
    return pa.concat_arrays([plain, pa.array(rest, plain.type)]), rows


def sample_texts(texts: pa.Array | list[str], keys: list[int], v: Vocabulary, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples: ids, log-probability, perturbed value, inclusion score."""
    lists, rows = _split(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    numbered = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    codes, words = np.array(numbered.indices), numbered.dictionary
    del lists, numbered
    v.lattices.forget()
    lattices, own = v.lattices, pc.fill_null(pc.index_in(words, v.words), -1).to_numpy().astype(np.int64)
    new = own < 0
    # the words that come again are kept while there is room
    often = np.bincount(codes, minlength=len(own)) > 1
    for some, keep in ((new & often, True), (new & ~often, False)):
        at = np.flatnonzero(some)
        for few in np.array_split(at, -(-len(at) // _BUILD)) if len(at) else ():
            mine, keep = words.take(pa.array(few)), keep and len(lattices.target) < _KEEP_EDGES
            own[few] = len(lattices.start) + np.arange(len(few))
            lattices.add(Lattices([f"▁{w}" for w in mine.to_pylist()], v), keep)
            if keep:
                v.words = pa.concat_arrays([v.words, mine])
    counts = np.diff(bounds)
    starts = lattices.start[own][codes] if len(codes) else codes
    place = np.arange(len(codes), dtype=np.uint64) - np.repeat(bounds[:-1], counts).astype(np.uint64)
    key_of = [keys[r] for r in rows.tolist()]
    row = np.repeat(np.array(key_of, np.uint64), counts)
    draws = [_draw(lattices, starts, mix(row + np.uint64((r + 1) * 0x2545F4914F6CDD1D & _ALL)) + mix(place + np.uint64(r))) for r in range(k if len(codes) else 0)]
    out: list = [[(np.empty(0, np.int64), 0.0, 0.0, 1.0)]] * len(key_of)
    for r, key, a, b in zip(rows.tolist(), key_of, bounds.tolist(), bounds[1:].tolist()):
        if a == b:
            continue
        mine = [(e[o[a] : o[b]], o[a : b + 1] - o[a]) for e, o in draws]
        *found, (_, _, below) = top_k(lattices, mine, key, k)
        out[r] = [(_ids(lattices.piece[path], v), logp, value, 1.0 if below == -math.inf else -math.expm1(-math.exp(min(50.0, logp - below)))) for path, logp, value in found]
    return out


def _ids(pieces: np.ndarray, v: Vocabulary) -> np.ndarray:
    """ids of pieces; characters without a piece become the bytes of their UTF-8 form."""
    odd = np.flatnonzero(pieces <= 0)
    if not len(odd):
        return pieces
    spelled = {c: v.bytes[np.frombuffer(chr(-c).encode("utf-8", "replace"), np.uint8)] for c in set(pieces[odd].tolist())}
    sizes = np.ones(len(pieces), np.int64)
    parts = [spelled[c] for c in pieces[odd].tolist()]
    sizes[odd] = np.fromiter(map(len, parts), np.int64, len(parts))
    out = np.repeat(pieces, sizes)
    out[out <= 0] = np.concatenate(parts)
    return out


def decode(ids: list[int], v: Vocabulary) -> str:
    """The text of ids: pieces joined, byte pieces as UTF-8, blanks for the mark, without the first one."""
    return b"".join(map(v.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode_samples(docs: DataFrame, k: int = SAMPLES, seed: int = SEED, model: str = MODEL, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sample (from 1), ids, n_pieces, log_prob, perturbed, inclusion, text_crc32 of the decoded ids."""
    ship(docs.sparkSession)
    names = ["doc_id", "sample", "ids", "n_pieces", "log_prob", "perturbed", "inclusion", "text_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, alpha)
        for some in trimmed((some for batch in batches for some in steps(batch, 1, _STEP)), _GIVE_BACK):
            doc_ids = some.column(0).to_pylist()
            keys = [xxhash.xxh3_64_intdigest(f"{seed}|{d}") for d in doc_ids]
            rows, ids, sizes = [], [], [0]
            for d, samples in zip(doc_ids, sample_texts(some.column(1), keys, v, k)):
                for j, (own, logp, value, inclusion) in enumerate(samples, 1):
                    rows.append((d, j, len(own), logp, value, inclusion, zlib.crc32(decode(own.tolist(), v).encode("utf-8", "surrogatepass"))))
                    ids.append(own)
                    sizes.append(sizes[-1] + len(own))
            if not rows:
                continue
            c = list(zip(*rows))
            flat = pa.array(np.concatenate(ids).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)
            arrays = [pa.array(c[0], some.column(0).type), pa.array(c[1], pa.int32()), lists, pa.array(c[2], pa.int32()), pa.array(c[3]), pa.array(c[4]), pa.array(c[5]), pa.array(c[6], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, sample int, ids array<int>, n_pieces int, log_prob double, perturbed double, inclusion double, text_crc32 long")
