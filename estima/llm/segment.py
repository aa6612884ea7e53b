"""SentencePiece segmentations sampled without replacement, and their decoding (operator 9).

A text's pieces form a lattice. Pieces never cross from another character into a space or a
line end, so it is a chain of small lattices, one per word with the spaces before it. Pieces
get Zipf log-probabilities from their order in the vocabulary; a character without a piece is
spelt by its bytes. Backward sums turn the scores into exact step probabilities.

Gumbel top-k: give every whole segmentation its log-probability plus Gumbel noise; the k
largest are k distinct samples without replacement. They are found top down by an A-star
search, whose bound is exact because the largest value below a node is itself a Gumbel
variable: the root's value is drawn, and a node's value is handed to the child that holds its
maximum, while what else is below the node stays one unopened node with a value drawn below.
The search opens the best unopened node: first "any other segmentation of this word", then
"any other step at this position", then the step. A popped node fixes the text up to it, and
everything after is sampled. Paths are drawn for many documents at a time, in numpy.

Every number is a hash of the seed, the row's key, the sample, the word's place and the step,
so a row always gets the same samples. With the next best value as threshold, a sample's
inclusion probability is 1 - exp(-exp(log p - threshold)); its logarithm is reported.

Defined cases: a null or empty text has one segmentation of no pieces; a text with fewer than
k segmentations gives as many samples; rows that repeat a key and text get the same samples;
very long words cost time in proportion; an empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import functools
import gc
import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estima.llm.common import tidy

#: Words handled at a time, and edges in a task's table of word lattices.
CHUNK_WORDS = 120_000
CACHE_EDGES = 8_000_000
#: Words, and finer: letters, single digits and other characters apart, each with the spaces before.
_WORD = re.compile(r" *[^ \n]+| +|\n")
# (the first alternative is a shorter way to the second where a run of letters is plain)
_FINE = re.compile(r" *+[A-Za-z]++(?![^\W\d_²])| *[^\W\d_²]+| *\d| *(?:[^\w\s]|[_²]|[^\S \n])+| +|\n")
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASK = 0xFFFFFFFFFFFFFFFF


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _C2
    h = (h ^ (h >> np.uint64(27))) * _C3
    return h ^ (h >> np.uint64(31))


def uniform(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((mix(h) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def below(limit: np.ndarray, location: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``location`` given that they are below ``limit``."""
    # -log(exp(-limit) - log(u) * exp(-location)), without overflow
    return -np.logaddexp(-limit, np.log(-np.log(u)) - location)


class Vocabulary:
    """Pieces of a SentencePiece model: ids by text, bytes by id, log-probabilities by id."""

    def __init__(self, model_file: str, sharpness: float = 1.0):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.vocab_size()
        self.bytes, pieces, self.byte_id = [b""] * n, {}, np.zeros(256, np.int64)
        for i in range(n):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(text[1:-1], 16)] = i
                self.bytes[i] = bytes([int(text[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[text.replace("▁", " ")] = i
                self.bytes[i] = text.replace("▁", " ").encode()
        # the bytes of all pieces in a row
        self.blob, size = np.frombuffer(b"".join(self.bytes), np.uint8), np.array([len(b) for b in self.bytes], np.int64)
        self.byte_start, self.byte_size = np.cumsum(size) - size, size
        order = np.array(sorted(pieces.values()))
        self.score = np.full(n, -sharpness * np.log(n + 1.0))
        self.score[order] = -sharpness * np.log(np.arange(1, len(order) + 1) + 1.0)
        # the finest split that no piece crosses
        self.split = next(x for x in (_FINE, _WORD, re.compile(r"(?s).+")) if all(len(x.findall(t)) == 1 for t in pieces)).findall
        # every beginning of a piece by its hash; the id where it is a piece
        known: dict[str, int] = {}
        for text, i in pieces.items():
            for k in range(1, len(text)):
                known.setdefault(text[:k], -1)
            known[text] = i
        texts = list(known)
        h, length = np.zeros(len(texts), np.uint64), max(map(len, texts))
        codes = np.zeros((len(texts), length), np.uint64)
        for r, t in enumerate(texts):
            codes[r, : len(t)] = [ord(c) for c in t]
        size = np.array([len(t) for t in texts])
        for k in range(length):
            at = size > k
            h[at] = mix(h[at] * _C1 + codes[at, k] + np.uint64(1))
        # two tables of slots by different bits of the hash; what collides in the first is in the second,
        # what collides there as well in a sorted rest
        self.hashes, self.ids, self.longest = np.append(h, np.uint64(0)), np.array([*(known[t] for t in texts), -1]), length
        self.slots, left = [], np.arange(len(texts))
        for shift in (42, 20):
            table = np.full(1 << 22, len(texts), np.int32)
            slot = (h[left] >> np.uint64(shift) & np.uint64((1 << 22) - 1)).astype(np.int64)
            table[slot] = left
            self.slots.append((np.uint64(shift), table))
            left = left[table[slot] != left]
        self.rest = left

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether hashes are of beginnings of pieces, and the pieces' ids (-1: none)."""
        at = self.slots[0][1][(h >> self.slots[0][0] & np.uint64((1 << 22) - 1)).astype(np.int64)]
        miss = np.flatnonzero((self.hashes[at] != h) & (at < len(self.hashes) - 1))  # an empty slot is a sure miss
        at[miss] = self.slots[1][1][(h[miss] >> self.slots[1][0] & np.uint64((1 << 22) - 1)).astype(np.int64)]
        there = (self.hashes[at] == h) & (at < len(self.hashes) - 1)
        if len(self.rest):
            for r in self.rest.tolist():
                hit = h == self.hashes[r]
                there |= hit
                at[hit] = r
        return there, np.where(there, self.ids[at], -1)


def decode_bytes(vocabulary: Vocabulary, ids: list[int] | np.ndarray) -> bytes:
    """The UTF-8 bytes of ids; the space before the first word goes."""
    ids = np.asarray(ids, np.int64)
    size = vocabulary.byte_size[ids]
    end = np.cumsum(size)
    return vocabulary.blob[np.repeat(vocabulary.byte_start[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)].tobytes()[1:]


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of ids."""
    return decode_bytes(vocabulary, ids).decode("utf-8", "replace")


class _Known(dict):
    """Numbers of words; a word that is asked for the first time is noted in ``fresh``."""

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = -len(self.fresh)
        return self[word]


class Lattices:
    """Lattices of distinct words. Positions of all words are numbered in a row; position p has the
    edges first[p] ... first[p + 1] - 1, longest piece first."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.known = _Known()  # word -> its first position
        self.first, self.span = np.zeros(1, np.int64), np.zeros(0, np.int32)  # span: of a word at its first position
        self.edges = 0
        self.length, self.id, self.logq, self.cum = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.float32)

    def starts(self, words: list[str]) -> np.ndarray:
        if self.edges > CACHE_EDGES:
            self.clear()
        known = self.known
        known.fresh = []
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if known.fresh:  # they have got -1, -2, ... in their order
            self._add(known.fresh)
            new = np.flatnonzero(at < 0)
            first = np.fromiter(map(known.__getitem__, known.fresh), np.int64, len(known.fresh))
            at[new] = first[-at[new] - 1]
        return at

    def _add(self, words: list[str]) -> None:
        v, size = self.v, np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        total, end = len(codes), np.repeat(np.cumsum(size), size)
        # edges: from each position as long as the text goes on as the beginning of a piece
        at, h, edges = np.arange(total), np.zeros(total, np.uint64), []
        for n in range(1, v.longest + 1):
            h = mix(h * _C1 + codes[at + n - 1] + np.uint64(1))
            if n == 1:  # single characters are found once each
                distinct, where = np.unique(codes, return_inverse=True)
                there, ids = (x[where] for x in v.find(mix(distinct + np.uint64(1))))
            else:
                there, ids = v.find(h)
            hit = ids >= 0
            edges.append((at[hit], np.full(hit.sum(), n, np.int32), ids[hit]))
            if n == 1:  # no piece for the character: its byte, or minus the character for several
                none = np.flatnonzero(~hit)
                c = codes[at[none]].astype(np.int64)
                edges.append((at[none], np.ones(len(none), np.int32), np.where(c < 128, v.byte_id[c & 127], -c - 1)))
            on = there & (at + n < end[at])
            at, h = at[on], h[on]
            if not len(at):
                break
        # longer pieces first: they are likelier as a rule, and a step tries the edges in order
        start, length, ids = (np.concatenate([e[k] for e in edges[::-1]]) for k in range(3))
        score = v.score[np.maximum(ids, 0)]
        spelt = np.flatnonzero(ids < 0)
        for e in spelt:
            score[e] = sum(v.score[v.byte_id[b]] for b in _utf8(-int(ids[e]) - 1))
        order = np.argsort(start.astype(np.int32), kind="stable")
        start, length, ids, score = start[order], length[order], ids[order], score[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=total))])
        # backward sums, all positions at the same distance from their word's end together
        beta = np.zeros(total + 1)
        distance = end - np.arange(total)
        by = np.argsort(distance, kind="stable")
        bounds = np.searchsorted(distance[by], np.arange(1, distance.max() + 2))
        value = np.empty(len(ids))
        for d in range(len(bounds) - 1):
            p = by[bounds[d]:bounds[d + 1]]
            if not len(p):
                continue
            n = first[p + 1] - first[p]
            e = np.repeat(first[p] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            to = start[e] + length[e]
            s = score[e] + np.where(to == end[start[e]], 0.0, beta[to])
            cut = np.cumsum(n) - n
            top = np.maximum.reduceat(s, cut)
            beta[p] = top + np.log(np.add.reduceat(np.exp(s - np.repeat(top, n)), cut))
            value[e] = s - np.repeat(beta[p], n)
        q = np.exp(value)
        cum = np.cumsum(q)
        n = np.diff(first)
        cum -= np.repeat(cum[first[:-1]] - q[first[:-1]], n)
        cum[first[1:] - 1] = 2.0  # the last edge takes what rounding leaves
        base = len(self.first) - 1
        self.known.update(zip(words, (base + np.cumsum(size) - size).tolist(), strict=True))
        self.first = np.concatenate([self.first, first[1:] + self.edges])
        span = np.zeros(total, np.int32)
        span[np.cumsum(size) - size] = size
        self.span = np.concatenate([self.span, span])
        if len(self.id) < self.edges + len(ids):
            room = self.edges + 2 * len(ids)
            for name in ("length", "id", "logq", "cum"):
                old = getattr(self, name)
                new = np.zeros(max(room, len(old) * 3 // 2), old.dtype)
                new[: self.edges] = old[: self.edges]
                setattr(self, name, new)
        for name, x in (("length", length), ("id", ids), ("logq", value), ("cum", cum)):
            getattr(self, name)[self.edges:self.edges + len(ids)] = x
        self.edges += len(ids)


def _utf8(code: int) -> bytes:
    return chr(code).encode("utf-8", "surrogatepass")


class Drawn:
    """Paths through words: ids of each (offsets), log-probabilities, and the steps taken."""

    def __init__(self, lattices: Lattices, at: np.ndarray, room: np.ndarray, key: np.ndarray):
        """``at``: positions to start from, ``room``: characters left in the word, ``key``: hashes."""
        n = len(at)
        self.logp, count = np.zeros(n), np.zeros(n, np.int64)
        who, at, room, steps = np.flatnonzero(room > 0), at[room > 0], room[room > 0], []
        k = 0
        while len(who):
            k += 1
            u = uniform(key[who] + np.uint64(k * int(_C1) & _MASK))
            e = lattices.first[at]
            on = np.flatnonzero(lattices.cum[e] < u)
            while len(on):
                e[on] += 1
                on = on[lattices.cum[e[on]] < u[on]]
            self.logp[who] += lattices.logq[e]
            steps.append((who, at, e))
            count[who] = k
            at, room = at + lattices.length[e], room - lattices.length[e]
            go = room > 0
            who, at, room = who[go], at[go], room[go]
        self.offset = np.concatenate([[0], np.cumsum(count)])
        self.edge, self.position = np.empty(self.offset[-1], np.int64), np.empty(self.offset[-1], np.int64)
        for k, (who, at, e) in enumerate(steps):
            self.edge[self.offset[who] + k], self.position[self.offset[who] + k] = e, at


class _Search:
    """The unopened nodes of one document, and the segments of its paths."""

    def __init__(self, words: int):
        self.words, self.nodes, self.order = words, [], 0

    def push(self, value: float, node: tuple) -> None:
        if value > -np.inf:
            self.order += 1
            heapq.heappush(self.nodes, (-value, self.order, node))


def sample(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
    """(text, rank, ids, log p, perturbed value, log inclusion probability) of up to ``k`` distinct
    segmentations of each text, best first. ``keys``: a hash per text."""
    split = [lattices.v.split(" " + t) if t else [] for t in texts]
    count = np.fromiter(map(len, split), np.int64, len(split))
    start = lattices.starts(list(chain.from_iterable(split)))
    size = lattices.span[start].astype(np.int64)
    base = np.cumsum(count) - count
    searches = [_Search(int(c)) for c in count]
    root = -np.log(-np.log(uniform(keys + _C2)))
    # what each text goes on with: (value, words fixed before: list of edge arrays, log p of them, first free word, rest of a word)
    todo = {i: (float(root[i]), [], 0.0, 0, None) for i in range(len(texts))}
    done: list[list[tuple[float, float, list[np.ndarray]]]] = [[] for _ in texts]
    for r in range(k):
        if not todo:
            break
        texts_now = list(todo)
        free = np.array([todo[i][3] for i in texts_now])
        # a word that was opened goes on from inside; then come whole words
        inside = [j for j, i in enumerate(texts_now) if todo[i][4] is not None]
        n = count[texts_now] - free
        word = np.repeat(base[texts_now] + free - (np.cumsum(n) - n), n) + np.arange(n.sum())
        owner = np.repeat(np.arange(len(texts_now)), n)
        in_at = np.array([todo[texts_now[j]][4][0] for j in inside], np.int64)
        in_room = np.array([todo[texts_now[j]][4][1] for j in inside], np.int64)
        seed = keys[texts_now] + np.uint64((r + 1) * int(_C3) & _MASK)
        place = (word - base[np.array(texts_now)[owner]]).astype(np.uint64) if len(word) else np.zeros(0, np.uint64)
        key = mix(mix(seed[owner]) + place * _C1) if len(word) else np.zeros(0, np.uint64)
        in_key = mix(mix(seed[inside] + _C1) + _C2) if inside else np.zeros(0, np.uint64)
        drawn = Drawn(lattices, np.concatenate([start[word], in_at]), np.concatenate([size[word], in_room]), np.concatenate([key, in_key]))
        whole = len(word)
        # values of "any other segmentation" of each whole word, below the path's value
        value = np.array([todo[i][0] for i in texts_now])
        prefix = np.array([todo[i][2] for i in texts_now])
        for m, j in enumerate(inside):
            prefix[j] += drawn.logp[whole + m]
        logp = drawn.logp[:whole]
        run = np.cumsum(logp)
        before = run - logp
        head = np.cumsum(n) - n
        if whole:
            before = before - np.repeat(before[np.minimum(head, whole - 1)], n) + prefix[owner]
        other = np.full(whole, -np.inf)
        ok = np.flatnonzero(logp < -1e-12)
        rest_mass = -np.expm1(logp[ok])
        # below(value, before + log(rest_mass), u), with one logarithm for both
        other[ok] = -np.logaddexp(-value[owner[ok]], np.log(-np.log(uniform(key[ok] + _C3)) / rest_mass) - before[ok])
        todo_next: dict[int, tuple] = {}
        for j, i in enumerate(texts_now):
            g, fixed, fixed_logp, first_free, rest = todo[i]
            a, b = head[j], head[j] + n[j]
            segment = drawn.edge[drawn.offset[a]:drawn.offset[b]] if b > a else np.zeros(0, np.int64)
            path, total = list(fixed), fixed_logp
            search = searches[i]
            if rest is not None:
                m = whole + inside.index(j) if len(inside) < 8 else whole + int(np.searchsorted(inside, j))
                tail = drawn.edge[drawn.offset[m]:drawn.offset[m + 1]]
                _open_steps(lattices, search, tail, drawn.position[drawn.offset[m]:drawn.offset[m + 1]], g, path, total, first_free - 1,
                            rest[0] + rest[1], int(in_key[m - whole]))
                path, total = [*path, tail], total + float(drawn.logp[m])
            if b > a:
                # the words of this path as one source of unopened nodes, best first
                best = np.argpartition(-other[a:b], k)[: k + 1] if b - a > k + 1 else np.arange(b - a)
                for x in best.tolist():
                    search.push(float(other[a + x]), ("word", path, segment, drawn.offset[a:b + 1] - drawn.offset[a], before[a + x], first_free + x, x,
                                                      int(start[word[a + x]] + size[word[a + x]]), drawn.position[drawn.offset[a + x]:drawn.offset[a + x + 1]],
                                                      int(key[a + x])))
                total += float(run[b - 1] - run[a] + logp[a])
            done[i].append((g, total, [*path, segment]))
            if r + 1 < k and (got := _pop(lattices, search)) is not None:
                todo_next[i] = got
        todo = todo_next
    for i in range(len(texts)):
        # the next best value is the threshold; with fewer than k samples all are included
        limit = -searches[i].nodes[0][0] if searches[i].nodes and len(done[i]) == k else -np.inf
        for rank, (g, logp, path) in enumerate(done[i], 1):
            x = logp - limit
            with np.errstate(over="ignore", under="ignore"):
                inclusion = 0.0 if x > 40 else float(x) if x < -30 else float(np.log(-np.expm1(-np.exp(x))))
            yield i, rank, _ids(lattices, np.concatenate(path)) if path else np.zeros(0, np.int64), float(logp), g, inclusion


def _open_steps(lattices: Lattices, search: _Search, edges: np.ndarray, positions: np.ndarray, g: float, path: list, logp: float, word: int, end: int,
                key: int) -> None:
    """Pushes "any other step" for each position of a path inside a word, below the path's value."""
    q = lattices.logq[edges]
    run = logp + np.cumsum(q) - q
    there = np.flatnonzero((q < -1e-12) & (lattices.first[positions + 1] - lattices.first[positions] > 1))
    rest = run[there] + np.log(-np.expm1(q[there]))
    u = uniform(np.array([(key + (s + 1) * 0xD1B54A32D192ED03) & _MASK for s in there.tolist()], np.uint64))
    for s, v in zip(there.tolist(), below(g, rest, u).tolist(), strict=True):
        search.push(v, ("step", [*path, edges[:s]], float(run[s]), word, int(positions[s]), int(edges[s]), end, (key + s) & _MASK))


def _pop(lattices: Lattices, search: _Search) -> tuple | None:
    """Opens the best nodes until a step is found: what the next path starts from; None if no node is left."""
    while search.nodes:
        value, _, node = heapq.heappop(search.nodes)
        g = -value
        if node[0] == "word":
            _, path, segment, offset, before, word, x, end, positions, key = node
            edges = segment[offset[x]:offset[x + 1]]
            # one of the positions where another segmentation of the word leaves this one holds the
            # maximum; the others get values below it
            q = lattices.logq[edges]
            run = np.cumsum(q) - q
            with np.errstate(divide="ignore"):
                mass = run + np.where(q < -1e-12, np.log(-np.expm1(np.minimum(q, -1e-300))), -np.inf)
            several = lattices.first[positions + 1] - lattices.first[positions] > 1
            mass[~several] = -np.inf
            if not np.isfinite(mass).any():
                continue
            h = np.uint64((key * 3 + 7) & _MASK) + np.arange(len(edges), dtype=np.uint64) * _C1
            noisy = mass - np.log(-np.log(uniform(h)))
            top = int(np.argmax(noisy))
            fixed = [*path, segment[: offset[x]]]
            there = np.flatnonzero(np.isfinite(mass))
            values = below(g, before + mass[there], uniform(h[there] + _C3))
            values[there == top] = g
            for s, v in zip(there.tolist(), values.tolist(), strict=True):
                search.push(v, ("step", [*fixed, edges[:s]], before + float(run[s]), word, int(positions[s]), int(edges[s]), end, (key + 31 * s) & _MASK))
            continue
        if node[0] == "step":
            _, path, before, word, p, taken, end, key = node
            e = np.arange(lattices.first[p], lattices.first[p + 1])
            e = e[e != taken]
            h = np.uint64((key * 5 + 11) & _MASK) + np.arange(len(e), dtype=np.uint64) * _C1
            noisy = lattices.logq[e] - np.log(-np.log(uniform(h)))
            top = int(np.argmax(noisy))
            values = below(g, before + lattices.logq[e], uniform(h + _C3)).tolist()
            for s, edge in enumerate(e.tolist()):
                if s != top:
                    search.push(values[s], ("edge", path, before, word, p, edge, end))
            node = ("edge", path, before, word, p, int(e[top]), end)
        _, path, before, word, p, edge, end = node
        at = p + int(lattices.length[edge])
        return g, [*path, np.array([edge])], before + float(lattices.logq[edge]), word + 1, (at, end - at)
    return None


def _ids(lattices: Lattices, edges: np.ndarray) -> np.ndarray:
    """Ids of edges; characters without a piece become their bytes' ids."""
    ids = lattices.id[edges].astype(np.int64)
    at = np.flatnonzero(ids < 0)
    if not len(at):
        return ids
    spelt = {int(i): [int(lattices.v.byte_id[b]) for b in _utf8(-int(i) - 1)] for i in np.unique(ids[at])}
    return np.array([y for i in ids.tolist() for y in (spelt[i] if i < 0 else (i,))], np.int64)


# ---- on Spark ------------------------------------------------------------------------

def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=1)
def _loaded(path: str, sharpness: float) -> Lattices:
    """One vocabulary and one bounded table of word lattices for all tasks of a worker."""
    return Lattices(Vocabulary(path, sharpness))


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, words = 0, 0
    for i, t in enumerate(texts):
        words += t.count(" ") + t.count("\n") + 1
        if words >= CHUNK_WORDS or i + 1 == len(texts):
            yield first, i + 1
            first, words = i + 1, 0


def sampled_segmentations(docs: DataFrame, k: int = 2, seed: int = 1, model=public_model, id_col: str = "doc_id", text_col: str = "text",
                          sharpness: float = 1.0, ids: bool = True) -> DataFrame:
    """Per row up to ``k`` rows: doc_id, sample (from 1), n_ids, ids_crc32 (little-endian unsigned 32-bit
    ids), log_p, perturbed, log_inclusion, round_trip (the ids decode to the text), and the ids if asked."""
    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("key"), text.alias("text"))
    schema = f"doc_id {kind}, sample int, n_ids long, ids_crc32 long, log_p double, perturbed double, log_inclusion double, round_trip boolean"
    schema += ", ids array<int>" if ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = _loaded(model(), sharpness)
        vocabulary = lattices.v
        gc.disable()  # a search holds many tuples and no cycles: a collection would only read them
        try:
            for batch in batches:
                texts = [t.replace("▁", " ") for t in batch.column("text").to_pylist()]
                keys = mix(batch.column("key").to_numpy().view(np.uint64))
                for a, b in _batches(texts):
                    out: list[list] = [[] for _ in range(9)]
                    for i, rank, got, logp, value, inclusion in sample(lattices, texts[a:b], keys[a:b], k):
                        row = (a + i, rank, len(got), zlib.crc32(got.astype("<u4").tobytes()), logp, value, inclusion,
                               decode_bytes(vocabulary, got) == texts[a + i].encode("utf-8", "surrogatepass"), got if ids else None)
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
                    types = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
                    arrays = [batch.column("doc_id").take(pa.array(out[0], pa.int64()))]
                    arrays += [pa.array(x, t) for x, t in zip(out[1:8], types, strict=True)]
                    if ids:
                        ends = np.cumsum([0, *out[2]], dtype=np.int32)
                        arrays.append(pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *out[8]], dtype=np.int32, casting="unsafe")))
                    names = ["doc_id", "sample", "n_ids", "ids_crc32", "log_p", "perturbed", "log_inclusion", "round_trip", "ids"]
                    yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])
        finally:
            gc.enable()

    return rows.mapInArrow(tidy(run), schema)


def decoded(segmentations: DataFrame, model=public_model, ids_col: str = "ids") -> DataFrame:
    """``segmentations`` with ``text``: what the ids decode to (null ids: null)."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = _loaded(model(), 1.0).v
        for batch in batches:
            yield pd.Series([None if x is None else decode(vocabulary, list(x)) for x in batch])

    return segmentations.withColumn("text", text(F.col(ids_col)))
