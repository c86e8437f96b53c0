"""Segmentation lattices of many words at once, as numpy tables.

Words (a space and what follows it) are laid out one after the other with a closing place each.
An edge is a piece that starts at a place; most places have one or two.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from capsonde.llm import tokens as W

SPACE = 32  # written as the meta sign in pieces
META = 0x2581
LITERAL = 0x110000  # a meta sign of the text itself: no piece holds it
FALLBACK = 1 << 24  # plus the character: spelled in byte pieces
SLOTS = 18  # bits of a lookup table


def char_symbols(chars: np.ndarray) -> np.ndarray:
    return W.mix(chars.astype(np.uint64) + np.uint64(0x51ED270B))


@dataclass
class Vocabulary:
    """Pieces with log-probabilities; `bytes_` are the ids of the 256 byte pieces. `hashes` are those
    of all beginnings of pieces, whole ones included, and `whole` the piece that each is, or -1."""

    ids: np.ndarray
    log_probs: np.ndarray
    hashes: np.ndarray
    whole: np.ndarray
    bytes_: np.ndarray
    byte_log_prob: float
    longest: int
    texts: list[bytes]

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Lookup tables from a hash's slot to a beginning; where some collide, all but one go to the
        next table, and the slot is marked."""
        if not hasattr(self, "_tables"):
            left, tables = np.arange(len(self.hashes)), []
            while len(left):
                slot = self._slot(self.hashes[left], len(tables))
                _, first = np.unique(slot, return_index=True)
                table, more = np.full(1 << SLOTS, -1, np.int32), np.zeros(1 << SLOTS, bool)
                table[slot[first]] = left[first]
                left, slot = np.delete(left, first), np.delete(slot, first)
                more[slot] = True
                tables.append((table, more))
            self._tables = tables
        return self._tables

    @staticmethod
    def _slot(hashes: np.ndarray, number: int) -> np.ndarray:
        return ((hashes * np.uint64(2 * number + 0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The beginning with each hash, and the piece that it is, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for number, (table, more) in enumerate(self.tables()):
            slot = self._slot(hashes[open_], number)
            at = table[slot]
            known = np.flatnonzero(at >= 0)
            same = known[self.hashes[at[known]] == hashes[open_[known]]]
            out[open_[same]] = at[same]
            open_ = open_[more[slot]]
        return out, np.where(out >= 0, self.whole[out], -1)


def load_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file. Its merge ranks become log-probabilities by Zipf's rule.

    Pieces with a meta sign behind their first character are left out: words end at spaces.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    texts = [b""] * n
    bytes_, plain = np.zeros(256, np.int64), []
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_[int(piece[1:-1], 16)] = i
            texts[i] = bytes([int(piece[1:-1], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            texts[i] = piece.replace(chr(META), " ").encode()
            if chr(META) not in piece[1:]:
                plain.append((i, piece.replace(chr(META), " ")))
    weight = np.array([-np.log(rank + 2.7) for rank in range(len(plain))])
    log_z = np.logaddexp.reduce(weight)
    beginnings, whole = [], []
    for number, (_, piece) in enumerate(plain):
        sums = W.prefix_sums(char_symbols(np.array([ord(c) for c in piece])))[1:]
        beginnings.append(sums)
        whole.append(np.where(np.arange(len(sums)) == len(sums) - 1, number, -1))
    hashes, of = np.unique(np.concatenate(beginnings), return_inverse=True)
    piece_of = np.full(len(hashes), -1)
    np.maximum.at(piece_of, of, np.concatenate(whole))
    return Vocabulary(
        np.array([i for i, _ in plain]), weight - log_z, hashes, piece_of, bytes_,
        float(weight.min() - log_z), max(len(p) for _, p in plain), texts,
    )


@dataclass
class Lattice:
    """Places and the edges between them, in the order of their place and length; word w starts at
    place first[w], and place p has the edges edges[p] up to edges[p + 1], none at a word's end."""

    first: np.ndarray
    edges: np.ndarray
    place: np.ndarray  # of every edge
    target: np.ndarray  # the place that it leads to
    lengths: np.ndarray  # its characters
    pieces: np.ndarray  # its piece's id
    steps: np.ndarray  # log-probability of taking it, given that a way has come to its place
    chosen: np.ndarray  # cumulated probability of a place's edges, for drawing
    goes_on: np.ndarray  # whether a place has edges

    def draw(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """For every place the first edge whose cumulated probability is not under that share of all."""
        edge, least = self.edges[place + 1] - 1, self.edges[place]
        limit = u * self.chosen[edge]
        open_ = np.flatnonzero(edge > least)
        while len(open_):
            open_ = open_[self.chosen[edge[open_] - 1] >= limit[open_]]
            edge[open_] -= 1
            open_ = open_[edge[open_] > least[open_]]
        return edge


def build(chars: np.ndarray, sums: np.ndarray, starts: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary, smoothing: float) -> Lattice:
    """Lattices of the words chars[starts:starts + lengths]; log-probabilities are times `smoothing`.

    `sums` are the prefix sums of the characters' symbols.
    """
    slots = lengths + 1
    first = np.cumsum(slots) - slots
    total = int(slots.sum())
    offset = np.arange(total) - np.repeat(first, slots)
    left = np.repeat(lengths, slots) - offset
    source = np.repeat(starts, slots) + offset
    back = W.powers(len(sums))[1]
    # Only places whose characters so far begin some piece are looked up with one character more.
    at, found_at, found, counts = np.flatnonzero(left > 0), [], [], np.zeros(total, np.int64)
    begin = source[at]
    begun, scale = sums[begin], back[begin]
    for n in range(1, vocabulary.longest + 1):
        node, piece = vocabulary.find((sums[begin + n] - begun) * scale)
        hit = piece >= 0
        place, piece = at[hit], piece[hit]
        if n == 1:
            alone = np.ones(total, bool)
            alone[left <= 0] = alone[place] = False
            place, piece = np.concatenate([place, np.flatnonzero(alone)]), np.concatenate([piece, np.full(int(alone.sum()), -1)])
        found_at.append(place.astype(np.int32))
        found.append(piece.astype(np.int32))
        counts[place] += 1
        more = np.flatnonzero((node >= 0) & (left[at] > n))
        if not len(more):
            break
        at, begin, begun, scale = at[more], begin[more], begun[more], scale[more]
    edges = np.concatenate([[0], np.cumsum(counts)])
    size = int(edges[-1])
    place, length, piece = np.empty(size, np.int32), np.empty(size, np.int32), np.empty(size, np.int32)
    free = edges[:-1].copy()
    for n, (p, x) in enumerate(zip(found_at, found, strict=True), 1):
        to = free[p]
        place[to], length[to], piece[to] = p, n, x
        free[p] += 1
    del found_at, found, free, at, begin, begun, scale
    pieces, log_probs = vocabulary.ids[piece].astype(np.int32), (smoothing * vocabulary.log_probs[piece]).astype(np.float32)
    spelled = np.flatnonzero(piece < 0)
    actual = chars[source[place[spelled]]]
    actual = np.where(actual == LITERAL, META, actual)
    pieces[spelled] = FALLBACK + actual
    log_probs[spelled] = smoothing * vocabulary.byte_log_prob * utf8_lengths(actual)
    # Places in the order of what is left behind them: a place's beta needs shorter rests only.
    short = left.astype(np.uint16) if int(left.max(initial=0)) < 1 << 16 else left  # sorted by radix
    order = np.argsort(short, kind="stable")
    cuts = np.searchsorted(short[order], np.arange(1, int(left.max(initial=0)) + 2))
    begins = np.concatenate([[0], np.cumsum(counts[order])])
    by_left = np.arange(size) + np.repeat(edges[order] - begins[:-1], counts[order])
    target = place + length
    target_l, weight_l = target[by_left], log_probs[by_left].astype(np.float64)
    beta = np.zeros(total)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        e = slice(begins[a], begins[b])
        ways, own = weight_l[e] + beta[target_l[e]], begins[a:b] - begins[a]
        top = np.maximum.reduceat(ways, own)
        ways -= np.repeat(top, counts[order[a:b]])
        beta[order[a:b]] = top + np.log(np.add.reduceat(np.exp(ways, out=ways), own))
    del by_left, target_l, weight_l
    steps = log_probs + beta[target]
    steps -= beta[place]
    chosen = np.exp(steps).astype(np.float32)
    later = np.flatnonzero(counts > 1)
    for n in range(1, int(counts.max(initial=0))):
        to = edges[later] + n
        chosen[to] += chosen[to - 1]
        later = later[counts[later] > n + 1]
    return Lattice(first, edges, place, target, length, pieces, np.minimum(steps, 0.0, out=steps), chosen, counts > 0)


def utf8_lengths(chars: np.ndarray) -> np.ndarray:
    return 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)


def expand_fallback(pieces: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids with characters spelled in byte pieces, and how many ids each entry became."""
    odd = pieces >= FALLBACK
    if not odd.any():
        return pieces, np.ones(len(pieces), np.int64)
    counts = np.ones(len(pieces), np.int64)
    chars = pieces[odd].astype(np.int64) - FALLBACK
    counts[odd] = utf8_lengths(chars)
    out = np.repeat(pieces, counts)
    spelled = np.frombuffer("".join(map(chr, chars.tolist())).encode("utf-8"), np.uint8)
    out[np.repeat(odd, counts)] = vocabulary.bytes_[spelled]
    return out, counts
