"""SentencePiece encoding with sampled segmentations, and decoding.

All segmentations of a text into pieces are the paths of a lattice; a path's weight is the product of its pieces' weights. The
``k`` paths with the largest Gumbel-perturbed log probabilities are a sample without replacement. They are found by perturbed A-star
search from the top down: a node is a set of paths with a common beginning; its priority is the largest perturbed value
among them, which is a Gumbel variable at the set's log mass, cut off at its parent's. The set's best path is drawn by the
backward masses alone, and what is left of the set falls apart into one node for each place at which a path can leave
it. Popping the best open node k times gives the sample; the next best value, kappa, gives
each path's inclusion log probability, log(1 - exp(-exp(log p - kappa))).

Pieces never cross the place where a space follows another character, so the lattice of a text is a chain of small ones; those
of the different units of a batch are built once, all at the same time, and paths are drawn for all texts of a batch in
step. Places to leave a path count as long as the path's beginning has log probability above -37; what lies beyond has, in double
precision, no mass.

A unigram model's scores are its log weights. A model of merges has ranks instead of weights: piece number r weighs
1 / (r + 2). A character without a piece is spelled in bytes. Random numbers are hashes of seed, row key, sample and place.

Defined results: a null text counts as empty; an empty text has one, empty, segmentation with log probability 0 and is included
surely, as are all of a text that has at most k; units of any length are whole, but those of over ``LONG`` bytes are not remembered; repeated rows
get equal samples; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setweave.llm.common import pieces, texts
from setweave.llm.remembered import Remembered, same_bytes
from setweave.llm.repeats import U, mix, powers, prefix_hashes, run_hashes

SPACE = "▁"
LONG = 256
#: Where fewer units than this are still as long, their nodes are taken one by one.
FEW = 8
REMEMBERED = 60_000
FAINT = -37.0
_SYMBOL = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


class Vocabulary:
    """Pieces of a model file: their bytes, weights and hashes."""

    def __init__(self, path: str):
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.processor = p
        n = p.get_piece_size()
        self.bytes_of, self.byte_id = [b""] * n, np.full(256, p.unk_id(), np.int64)
        plain = []
        for i in range(n):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_of[i], self.byte_id[value] = bytes([value]), i
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                plain.append((i, piece))
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        scores = np.array([p.get_score(i) for i, _ in plain])
        ranks = len(plain) > 1 and np.all(scores == np.round(scores))  # merges: 0, -1, -2, ...
        weight = -np.log(2 - scores) if ranks else scores
        raw = [piece.encode() for _, piece in plain]
        prefix = prefix_hashes(_SYMBOL[np.frombuffer(b"".join(raw), np.uint8)])
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        h = run_hashes(prefix, np.cumsum(size) - size, size)
        order = np.argsort(h)
        self.hashes, self.ids, self.weights = h[order], np.array([i for i, _ in plain])[order], weight[order]
        self.raw, self.raw_at, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), (np.cumsum(size) - size)[order], size[order]
        # By a hash's upper bits: the one entry with them, -1 if there is none, -2 if there are several.
        slot = (self.hashes >> U(44)).astype(np.int64)
        self.slots = np.full(1 << 20, -1, np.int32)
        self.slots[slot] = np.arange(len(slot))
        self.slots[slot[1:][slot[1:] == slot[:-1]]] = -2
        self.begins = self._beginnings(raw)
        self.longest = max(len(piece) for _, piece in plain)
        self.byte_weight = float(weight.min()) - np.log(2)
        self.splits = all(SPACE not in piece.lstrip(SPACE) for _, piece in plain)
        lone = {"\n"} if not any("\n" in piece for _, piece in plain) else set()
        self.lone = lone
        probe = "a  b\tc\n d "
        self.plain = p.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        self.base: Lattices | None = None
        self.units, self.unit_numbers = Remembered(), np.zeros(0, np.int64)
        flat, sizes = b"".join(self.bytes_of), np.fromiter(map(len, self.bytes_of), np.int64, n)
        self.flat, self.size, self.at = np.frombuffer(flat, np.uint8), sizes, np.cumsum(sizes) - sizes

    def _beginnings(self, raw: list[bytes]) -> np.ndarray:
        """By a hash's upper bits: whether a proper beginning of some piece has them. Others can't grow into a piece."""
        whole = np.frombuffer(b"".join(raw), np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        first = np.repeat(np.cumsum(size) - size, size)
        some = (np.arange(len(whole)) > first) & ((whole & 0xC0) != 0x80)
        out = np.zeros(1 << 20, bool)
        at = np.flatnonzero(some)
        out[(run_hashes(prefix_hashes(_SYMBOL[whole]), first[at], at - first[at]) >> U(44)).astype(np.int64)] = True
        return out

    def find(self, h: np.ndarray, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each run raw[at : at + size] with hash ``h``, or -1: the hash finds it, the bytes decide."""
        entry = self.slots[(h >> U(44)).astype(np.int64)].astype(np.int64)
        several = np.flatnonzero(entry == -2)
        if len(several):
            entry[several] = np.minimum(np.searchsorted(self.hashes, h[several]), len(self.hashes) - 1)
        some = np.flatnonzero(entry >= 0)
        entry[some[(self.hashes[entry[some]] != h[some]) | (self.raw_size[entry[some]] != size[some])]] = -1
        some = np.flatnonzero(entry >= 0)
        entry[some[~same_bytes(raw, at[some], self.raw, self.raw_at[entry[some]], size[some])]] = -1
        return entry

    def lattices(self, units: pa.Array) -> tuple[Lattices, np.ndarray]:
        """Lattices that include those of these units, and each unit's number there. The first ``REMEMBERED`` units are kept for later batches."""
        _, offsets, data = units.buffers()
        at = np.frombuffer(offsets, np.int32, len(units) + 1).astype(np.int64)
        raw = np.frombuffer(data, np.uint8, at[-1]) if len(units) and at[-1] else np.zeros(0, np.uint8)
        begin, size = at[:-1], np.diff(at)
        h = run_hashes(prefix_hashes(_SYMBOL[raw]), begin, size) if len(units) else np.zeros(0, U)
        place = self.units.find(h, raw, begin, size)
        known = place >= 0
        number, new = np.zeros(len(h), np.int64), np.flatnonzero(~known)
        number[known] = self.unit_numbers[place[known]]
        before = 0 if self.base is None else len(self.base.root)
        long = np.diff(at)[new] > LONG
        new, far = new[~long], new[long]
        number[new], number[far] = before + np.arange(len(new)), before + len(new) + np.arange(len(far))
        lat = self.base
        if len(new) or lat is None:
            lat = Lattices(self, pa.concat_arrays([units.take(pa.array(new, pa.int64()))]))
            lat = lat if self.base is None else self.base.followed_by(lat)
        if len(new) and len(lat.root) <= REMEMBERED:
            self.base = lat
            first = self.units.add(h[new], raw, begin[new], size[new])
            self.unit_numbers = np.concatenate((self.unit_numbers, number[new[first]]))
        if len(far):
            lat = lat.followed_by(Lattices(self, pa.concat_arrays([units.take(pa.array(far))])))
        return lat, number

    def spell(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts, as UTF-8, of ids[at[t]:at[t+1]], without the space that encoding puts in front."""
        size = self.size[ids]
        upto = np.concatenate(([0], np.cumsum(size)))
        data = self.flat[np.repeat(self.at[ids] - upto[:-1], size) + np.arange(upto[-1])]
        ends = upto[at]
        full = np.flatnonzero(ends[1:] > ends[:-1])
        keep = np.ones(len(data), bool)
        keep[ends[:-1][full][data[ends[:-1][full]] == 32]] = False
        ends = ends - np.concatenate(([0], np.cumsum(~keep)))[ends]
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[keep])])

    def normalized(self, text: pa.Array) -> pa.Array:
        if self.plain:
            marked = pc.binary_join_element_wise("", pc.replace_substring(text, " ", SPACE), SPACE)
            return pc.if_else(pc.equal(pc.binary_length(text), 0), "", marked)
        return pa.array(self.processor.normalize(text.to_pylist()), pa.string())


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """This process's vocabulary of a model file."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


class Lattices:
    """The lattices of several units, side by side: a node for each character and one for the unit's end, edges in order of the node they leave, the longest first."""

    def __init__(self, v: Vocabulary, units: pa.Array):
        _, offsets, data = units.buffers()
        at = np.frombuffer(offsets, np.int32, len(units) + 1).astype(np.int64)
        raw = np.frombuffer(data, np.uint8, at[-1]) if at[-1] else np.zeros(0, np.uint8)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        border = np.append(lead, at[-1])
        first = np.searchsorted(lead, at)  # of each unit, in characters
        unit = np.repeat(np.arange(len(units)), np.diff(first))
        left = first[unit + 1] - np.arange(len(lead))  # characters to the unit's end
        node = np.arange(len(lead)) + unit
        self.root, self.final = first[:-1] + np.arange(len(units)), first[1:] + np.arange(len(units))
        n_nodes = len(lead) + len(units)

        prefix = prefix_hashes(_SYMBOL[raw])
        _, down = powers(len(prefix))
        here, scale = prefix[lead], down[lead]
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        char = np.arange(len(lead))
        for n in range(1, v.longest + 1):
            char = char[left[char] >= n]
            if not len(char):
                break
            h = (prefix[border[char + n]] - here[char]) * scale[char]
            entry = v.find(h, raw, lead[char], border[char + n] - lead[char])
            ok = entry >= 0
            found.append((n, char[ok], entry[ok]))
            char = char[v.begins[(h >> U(44)).astype(np.int64)]]
        single = np.zeros(len(lead), bool)
        if found:
            single[found[0][1]] = True
        spelled = np.flatnonzero(~single)

        degree = np.bincount(np.concatenate([node[c] for _, c, _ in found] + [node[spelled]]) if len(lead) else np.zeros(0, np.int64), minlength=n_nodes)
        self.edge_at = np.concatenate(([0], np.cumsum(degree)))
        size = int(self.edge_at[-1])
        self.target, self.ids, weight = np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros(size)
        free = self.edge_at[1:] - 1
        # Characters without a piece of their own are spelled in bytes: such an edge's id is -1 - (its place in ``spellings``).
        self.spellings = [v.byte_id[raw[border[c] : border[c + 1]]] for c in spelled.tolist()]
        put = free[node[spelled]]
        self.target[put], self.ids[put] = node[spelled] + 1, -1 - np.arange(len(spelled))
        weight[put] = v.byte_weight * np.fromiter(map(len, self.spellings), np.int64, len(spelled))
        free[node[spelled]] -= 1
        for n, c, entry in found:
            put = free[node[c]]
            self.target[put], self.ids[put], weight[put] = node[c] + n, v.ids[entry], v.weights[entry]
            free[node[c]] -= 1

        # Backward log masses, from the units' ends.
        depth = np.zeros(n_nodes, np.uint16 if left.max(initial=0) < 1 << 16 else np.int32)
        depth[node] = left
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 2))
        beta = np.zeros(n_nodes)
        self.logp = np.zeros(size)
        many = int(np.count_nonzero((np.diff(cuts) >= FEW) | (np.arange(1, len(cuts)) <= LONG)))
        for a, b in zip(cuts[:many].tolist(), cuts[1 : many + 1].tolist(), strict=True):
            nodes = order[a:b]
            sizes = degree[nodes]
            begin = np.cumsum(sizes) - sizes
            edges = np.repeat(self.edge_at[nodes] - begin, sizes) + np.arange(int(sizes.sum()))
            score = weight[edges] + beta[self.target[edges]]
            most = np.maximum.reduceat(score, begin)
            beta[nodes] = most + np.log(np.add.reduceat(np.exp(score - np.repeat(most, sizes)), begin))
            self.logp[edges] = np.minimum(score - np.repeat(beta[nodes], sizes), 0.0)
        # What is left of the longest units, in blocks from behind.
        for i in np.flatnonzero(self.final - self.root > many).tolist():
            for end in range(int(self.final[i]) - many, int(self.root[i]), -4096):
                self._masses(max(int(self.root[i]), end - 4096), end, weight, beta)
        upto = np.concatenate(([0.0], np.cumsum(np.exp(self.logp))))
        self.cdf = (upto[1:] - np.repeat(upto[self.edge_at[:-1]], degree)).astype(np.float32)

    def _masses(self, begin: int, end: int, weight: np.ndarray, beta: np.ndarray) -> None:
        """Backward log masses of the nodes of one unit from ``begin`` to before ``end``, and their edges' log probabilities, node by node."""
        at = self.edge_at[begin : end + 1]
        edges = slice(int(at[0]), int(at[-1]))
        target, w, at = (self.target[edges] - begin).tolist(), weight[edges].tolist(), (at - at[0]).tolist()
        own = beta[begin : max(end, begin + max(target) + 1)].tolist()
        for node in range(end - begin - 1, -1, -1):
            score = [w[e] + own[target[e]] for e in range(at[node], at[node + 1])]
            most = max(score)
            own[node] = most + math.log(sum(math.exp(x - most) for x in score))
        beta[begin:end] = own[: end - begin]
        self.logp[edges] = np.minimum(weight[edges] + beta[self.target[edges]] - np.repeat(beta[begin:end], np.diff(at)), 0.0)

    def followed_by(self, other: Lattices) -> Lattices:
        """Both, the other's units numbered after one's own."""
        out = Lattices.__new__(Lattices)
        nodes = len(self.edge_at) - 1
        out.root, out.final, out.target = (np.concatenate((getattr(self, c), getattr(other, c) + nodes)) for c in ("root", "final", "target"))
        out.ids = np.concatenate((self.ids, np.where(other.ids < 0, other.ids - len(self.spellings), other.ids)))
        out.logp, out.cdf = (np.concatenate((getattr(self, c), getattr(other, c))) for c in ("logp", "cdf"))
        out.edge_at = np.concatenate((self.edge_at, other.edge_at[1:] + self.edge_at[-1]))
        out.spellings = self.spellings + other.spellings
        return out

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge for each node, by probability."""
        e, last = self.edge_at[node], self.edge_at[node + 1] - 1
        go = np.flatnonzero((e < last) & (u > self.cdf[e]))
        while len(go):
            e[go] += 1
            go = go[(e[go] < last[go]) & (u[go] > self.cdf[e[go]])]
        return e

    def source_of(self, edges: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edge_at, edges, side="right") - 1

    def ids_of(self, edges: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of paths' edges, and where each path's begin."""
        ids = self.ids[edges].astype(np.int64)
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, at
        sizes = np.ones(len(ids), np.int64)
        parts = [self.spellings[-1 - i] for i in ids[odd].tolist()]
        sizes[odd] = np.fromiter(map(len, parts), np.int64, len(parts))
        upto = np.concatenate(([0], np.cumsum(sizes)))
        out = np.repeat(ids, sizes)
        out[out < 0] = np.concatenate(parts)
        return out, upto[at]


def uniforms(key: np.ndarray, sample: int, *places: np.ndarray) -> np.ndarray:
    h = mix(key ^ U(sample * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    for p in places:
        h = mix(h ^ (p.astype(U) * U(0xC2B2AE3D27D4EB4F)))
    return ((h >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)


class Paths:
    """One path for each text: its edges, text after text."""

    def __init__(self, edges: np.ndarray, at: np.ndarray, logp: np.ndarray):
        self.edges, self.at = edges, at
        total = np.concatenate(([0.0], np.cumsum(logp)))
        self.before = total[:-1] - np.repeat(total[at[:-1]], np.diff(at))  # log probability of what comes before each edge
        self.total = total[at[1:]] - total[at[:-1]]


def walk(lat: Lattices, node: np.ndarray, final: np.ndarray, key: np.ndarray, place: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Draw from each node to its unit's end; the walkers' edges, walker after walker, and their numbers."""
    who, edges, step = [], [], 0
    active = np.flatnonzero(node != final)
    node, final = node[active], final[active]
    h = mix(mix(key[active] ^ U(sample * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) ^ (place[active].astype(U) * U(0xC2B2AE3D27D4EB4F)))
    while len(active):
        u = ((mix(h ^ U(step * 0x165667B19E3779F9 & (1 << 64) - 1)) >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)
        e = lat.draw(node, u)
        who.append(active)
        edges.append(e)
        node = lat.target[e]
        go = np.flatnonzero(node != final)
        active, node, final, h = active[go], node[go], final[go], h[go]
        step += 1
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    who, edges = np.concatenate(who), np.concatenate(edges)
    order = np.argsort(who.astype(np.int32), kind="stable")
    return edges[order], who[order]


def sample_batch(lat: Lattices, unit: np.ndarray, at: np.ndarray, keys: np.ndarray, k: int) -> list[tuple[np.ndarray, list, float, float]]:
    """For texts made of units[at[t]:at[t+1]]: (text, edges, log p, inclusion log p) of each sampled path, best first."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    place = np.arange(len(unit)) - at[doc]
    root, final = lat.root[unit], lat.final[unit]
    edges, who = walk(lat, root, final, keys[doc], place, 0)
    first = np.searchsorted(doc[who], np.arange(n + 1))
    paths = [Paths(edges, first, lat.logp[edges])]
    unit_of = [who]  # which unit each edge is in
    values = [-np.log(-np.log(uniforms(keys, 0, np.zeros(n))))]
    alive = [np.ones(n, bool)]
    open_: list[tuple[np.ndarray, np.ndarray, np.ndarray, list]] = []  # per path: value of each place to leave it, edges ruled out there

    def expand(j: int, start: np.ndarray, taken: dict[int, list[int]]) -> None:
        """Places to leave path j, from edge ``start`` of each text; ``taken`` has edges ruled out at that first place."""
        p = paths[j]
        index = np.arange(len(p.edges)) - np.repeat(p.at[:-1], np.diff(p.at))
        d = np.repeat(np.arange(n), np.diff(p.at))
        some = np.flatnonzero((index >= start[d]) & (p.before > FAINT) & alive[j][d])
        gone = np.exp(lat.logp[p.edges[some]])
        for t, out in taken.items():
            a = np.searchsorted(some, p.at[t] + start[t])
            if a < len(some) and some[a] == p.at[t] + start[t]:
                gone[a] = np.exp(lat.logp[out]).sum()
        left = 1.0 - gone
        source = lat.source_of(p.edges[some])
        choice = lat.edge_at[source + 1] - lat.edge_at[source]
        ruled = np.ones(len(some), np.int64)
        for t, out in taken.items():
            a = np.searchsorted(some, p.at[t] + start[t])
            if a < len(some) and some[a] == p.at[t] + start[t]:
                ruled[a] = len(out)
        ok = (choice > ruled) & (left > 1e-15)
        some, left = some[ok], left[ok]
        mass = p.before[some] + np.log(left)
        u = uniforms(keys[d[some]], 1000 + j, index[some])
        cap = values[j][d[some]]
        with np.errstate(over="ignore", divide="ignore"):
            v = -np.logaddexp(-cap, np.log(-np.log(u)) - mass)
        open_.append((some, d[some], v, taken))

    expand(0, np.zeros(n, np.int64), {})
    starts = [np.zeros(n, np.int64)]

    def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text, the largest open value, its path and its place in that path's list."""
        value, path, spot = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for j, (_, d, v, _) in enumerate(open_):
            if not len(v):
                continue
            begin = np.flatnonzero(np.diff(d, prepend=-1))  # entries are in order of their texts
            most = np.maximum.reduceat(v, begin)
            top = np.flatnonzero(v == np.repeat(most, np.diff(np.append(begin, len(d)))))
            top = top[np.diff(d[top], prepend=-1) > 0]
            better = top[v[top] > value[d[top]]]
            value[d[better]], path[d[better]], spot[d[better]] = v[better], j, better
        return value, path, spot

    for j in range(1, k):
        value, path, spot = best()
        go = np.flatnonzero(value > -np.inf)
        start, taken, heads = np.zeros(n, np.int64), {}, {}
        node, unit_at = np.zeros(len(go), np.int64), np.zeros(len(go), np.int64)
        u = uniforms(keys[go], 2000 + j, np.zeros(len(go)))
        left_at = np.zeros(len(go), np.int64)
        for which in range(len(open_)):
            of = np.flatnonzero(path[go] == which)
            left_at[of] = paths[which].edges[open_[which][0][spot[go[of]]]] if len(of) else 0
        sources = lat.source_of(left_at).tolist()
        for x, t in enumerate(go.tolist()):
            some, _, v, ruled = open_[path[t]]
            v[spot[t]] = -np.inf
            p = paths[path[t]]
            at_edge = int(some[spot[t]])
            here = at_edge - int(p.at[t])
            out = ruled.get(t, [int(p.edges[at_edge])]) if here == starts[path[t]][t] and t in ruled else [int(p.edges[at_edge])]
            s = sources[x]
            choices = [e for e in range(int(lat.edge_at[s]), int(lat.edge_at[s + 1])) if e not in out]
            upto = np.cumsum(np.exp(lat.logp[choices]))
            e = choices[min(int(np.searchsorted(upto, u[x] * upto[-1])), len(choices) - 1)]
            start[t], taken[t] = here, [*out, e]
            heads[t] = np.append(p.edges[p.at[t] : at_edge], e)
            node[x], unit_at[x] = lat.target[e], unit_of[path[t]][at_edge]
        # Finish the unit in which the path left, then draw all later units afresh.
        lens = at[go + 1] - unit_at
        w = np.repeat(unit_at, lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        nodes = root[w]
        nodes[np.cumsum(lens) - lens] = node
        edges, who = walk(lat, nodes, final[w], keys[doc[w]], place[w], j)
        owner = doc[w][who]
        cut = np.searchsorted(owner, np.arange(n + 1))
        new_edges, new_units, sizes = [], [], np.zeros(n, np.int64)
        for t in go.tolist():
            tail = slice(cut[t], cut[t + 1])
            p, i = paths[path[t]], int(paths[path[t]].at[t])
            new_edges += [heads[t], edges[tail]]
            new_units += [unit_of[path[t]][i : i + len(heads[t])], w[who[tail]]]
            sizes[t] = len(heads[t]) + cut[t + 1] - cut[t]
        new_edges = np.concatenate(new_edges) if new_edges else np.zeros(0, np.int64)
        paths.append(Paths(new_edges, np.concatenate(([0], np.cumsum(sizes))), lat.logp[new_edges]))
        unit_of.append(np.concatenate(new_units) if new_units else np.zeros(0, np.int64))
        values.append(value)
        alive.append(value > -np.inf)
        starts.append(start)
        expand(j, start, taken)
    kappa, _, _ = best()
    out = []
    for j in range(len(paths)):
        with np.errstate(over="ignore", divide="ignore"):
            x = np.minimum(paths[j].total - kappa, 700.0)
            inclusion = np.where(kappa > -np.inf, np.where(x < -30, x, np.log(-np.expm1(-np.exp(x)))), 0.0)
        out.append((np.flatnonzero(alive[j]), paths[j], paths[j].total, inclusion))
    return out


def segmentations(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", *, k: int = 3, seed: int = 42, decode: bool = False) -> DataFrame:
    """(id, sample, n_pieces, log_prob, log_inclusion, ids): the sampled segmentations of each text; ids as little-endian unsigned 32-bit integers.

    With ``decode`` there is also ``text``, decoded from each one's ids (as UTF-8).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in pieces(batches, "text", 1 << 20):
            text = pa.concat_arrays([v.normalized(texts(b.column("text")))])
            n = len(text)
            keys = np.array([xxhash.xxh64_intdigest(repr(i).encode(), seed) for i in b.column("id").to_pylist()], U)
            _, offsets, data = text.buffers()
            at = np.frombuffer(offsets, np.int32, n + 1).astype(np.int64)
            raw = np.frombuffer(data, np.uint8, at[-1]) if at[-1] else np.zeros(0, np.uint8)
            begins = np.zeros(len(raw) + 1, bool)
            begins[at] = True
            if v.splits and len(raw) > 2:
                mark = np.zeros(len(raw), bool)
                mark[:-2] = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)
                begins[:-1] |= mark & ~np.concatenate((np.zeros(3, bool), mark[:-3]))
                for c in v.lone:
                    lone = raw == ord(c)
                    begins[:-1] |= lone
                    begins[1:] |= lone
            cuts = np.flatnonzero(begins)
            if len(cuts) < 2:
                cuts = np.zeros(1, np.int64)
            units = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), data).dictionary_encode() if len(cuts) > 1 else pa.array([], pa.string()).dictionary_encode()
            lat, number = v.lattices(pa.concat_arrays([units.dictionary]))
            found = sample_batch(lat, number[units.indices.to_numpy(zero_copy_only=False)], np.searchsorted(cuts, at), keys, k)
            for j, (some, paths, total, inclusion) in enumerate(found):
                ids, begin = lat.ids_of(paths.edges, paths.at)
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * begin).astype(np.int32)), pa.py_buffer(ids.astype("<u4").tobytes())])
                pick = pa.array(some)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pick), pa.array(np.full(len(some), j), pa.int32()), pa.array(np.diff(begin)[some]), pa.array(total[some]), pa.array(inclusion[some]), packed.take(pick), *([v.spell(ids, begin).take(pick)] if decode else [])],
                    names=["id", "sample", "n_pieces", "log_prob", "log_inclusion", "ids", *(["text"] if decode else [])],
                )

    fields = [("id", docs.schema[id_col].dataType), ("sample", T.IntegerType()), ("n_pieces", T.LongType()), ("log_prob", T.DoubleType()), ("log_inclusion", T.DoubleType()), ("ids", T.BinaryType()), *([("text", T.BinaryType())] if decode else [])]
    return docs.selectExpr(f"`{id_col}` AS id", f"cast(`{text_col}` AS string) AS text").mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def decoded(rows: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """The rows with ``text``: what their ids spell, without the space that encoding puts in front."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                raws = b.column(ids_col).to_pylist()
                ids = np.frombuffer(b"".join(raws), "<u4").astype(np.int64)
                n = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
                text = v.spell(ids, np.concatenate(([0], np.cumsum(n))))
                yield pa.RecordBatch.from_arrays([*b.columns, text], names=[*b.schema.names, "text"])

    shape = T.StructType([*rows.schema.fields, T.StructField("text", T.BinaryType())])
    return rows.mapInArrow(run, shape).withColumn("text", F.col("text").cast("string"))
