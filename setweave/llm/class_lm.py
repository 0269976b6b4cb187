"""Scoring by a Brown class-based bigram model.

log10 p(text) = sum over its tokens of log10 p(class | class before) + log10 p(token | its class). A token is a word or
the end of the text; a text begins in the end's class.

Counts are over all training documents, and every word that they have twice or more is assigned by exchange: it goes to the class in which
the bigrams that it is part of are likeliest. The ``top`` most frequent words are exchanged one after another, on the matrix of their own bigrams, until none
moves or ``sweeps`` are done. All others, however many, are then exchanged side by side: each out of the class of rare words into the one
where it raises the likelihood most, by its own counts of the classes before and after it; rarer neighbours count as the class of rare words. Words that training
has once stay in that class, and stand there for the unknown ones. There are as many classes as the fourth root of the number of different words, ``classes`` at least; so vocabulary, assignments and classes
grow with the corpus, and no word is left to a stand-in.

Transitions are smoothed by adding ``alpha``. In its class a word has count / N; in the class of rare words (count - D) / N, and
what that leaves is for unknown words, D being n1 / (n1 + 2 n2) of the counts of counts.

Documents are tokenized once, into packs (see ``packs``) of numbered words. Each pack sends its different words, with their counts, to the parts of the vocabulary and gets
back counts and classes, as arrays, so neither driver nor executor ever holds the vocabulary, whatever its size. What reaches the driver is the ``top`` words, at
most top * top bigram counts, and tables of classes. Words are told apart by 64-bit digests.

Defined results: a null or empty text is the end alone; a null id hashes as the empty string; without training documents N
and V are 0; repeated rows are trained on and scored once each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setweave.llm.common import remove, save, texts
from setweave.llm.packs import ROW, dealt, dealt_to, joined, n_parts, packed, read, rows_of, together, unpack, with_parts, written
from setweave.llm.repeats import U, mix

END = U(0xE4D0F7E47E0F0D4E)
#: What parts hold: a word and its count in a pack; a word, a class before it (or, from ``classes`` on, after it; at the end, itself), and how often; a count and a class.
COUNT = (("h", "<u8"), ("n", "<u4"))
BESIDE = (("h", "<u8"), ("slot", "<u2"), ("n", "<u4"))
ANSWER = (("n", "<u8"), ("cls", "<u2"))


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different tokens (the end is the last), the token at each place, and each text's number of tokens."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts(column)))
    flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(lists)), sizes)[full]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    hashes = np.array([*map(xxhash.xxh64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), int(END)], U)
    code = coded.indices.to_numpy(zero_copy_only=False)
    counts = np.bincount(doc, minlength=len(lists)) + 1
    place = np.full(int(counts.sum()), len(hashes) - 1)
    at = np.ones(len(place), bool)
    at[np.cumsum(counts) - 1] = False
    place[at] = code
    return hashes, place, counts


def tokenized(b: pa.RecordBatch) -> pa.RecordBatch:
    """One row of arrays: ids, whether held out, numbers of tokens, the different words, and the word at each place."""
    hashes, place, counts = tokens_of(b.column("text"))

    def one(values: pa.Array) -> pa.Array:
        values = pa.concat_arrays([values])
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    arrays = {"id": b.column("id"), "held": b.column("held"), "counts": pa.array(counts.astype(np.int64)), "hashes": pa.array(hashes), "place": pa.array(place.astype(np.uint32))}
    return pa.RecordBatch.from_arrays([one(v) for v in arrays.values()], names=list(arrays))


class Tokens:
    """A pack of tokenized documents."""

    def __init__(self, body: bytes):
        b = read(body)
        self.id, held, *rest = (b.column(c).values for c in ("id", "held", "counts", "hashes", "place"))
        self.held, (self.counts, self.hashes, self.place) = held.to_numpy(zero_copy_only=False).astype(bool), (v.to_numpy() for v in rest)

    def training(self) -> np.ndarray:
        """The words, as numbers, of the documents to train on, one after another."""
        return self.place[~np.repeat(self.held, self.counts)]


class Units:
    """The unit of every word: its rank among the frequent ones, or else the unit of all others. The last unit is the end's."""

    def __init__(self, frequent: np.ndarray):
        order = np.argsort(frequent)
        self.sorted, self.rank, self.top = frequent[order], order, len(frequent)
        self.n = self.top + 2

    def of(self, hashes: np.ndarray) -> np.ndarray:
        unit = np.full(len(hashes), self.top)
        if self.top:
            at = np.minimum(np.searchsorted(self.sorted, hashes), self.top - 1)
            unit = np.where(self.sorted[at] == hashes, self.rank[at], unit)
        return np.where(hashes == END, self.n - 1, unit)


def _send_words(n: int):
    """Of each pack, its different words with their counts in training (kind 0): what the parts count, and what they will answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, body in zip(b.column("pack").to_pylist(), b.column("body"), strict=True):
                t = Tokens(body.as_py())
                x = {"h": t.hashes, "n": np.bincount(t.training(), minlength=len(t.hashes))}
                yield rows_of(dealt(0, number, (mix(t.hashes) % U(n)).astype(np.int64), x, COUNT))

    return run


def _summed(parts: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    x = joined(parts, COUNT)
    h, at = np.unique(x["h"], return_inverse=True)
    return h, np.bincount(at, x["n"], len(h)).astype(np.int64)


def _frequent(top: int):
    """Per part of the words: the most frequent, and in the first row how many words and tokens there are, and words that occur once and twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = _summed([unpack(raw, COUNT)[0] for b in batches for raw in b.column("payload").to_pylist()])
        words = np.flatnonzero((h != END) & (n > 1))
        often = words[np.lexsort((h[words], -n[words]))[:top]]
        total = [int((n > 0).sum()), int(n.sum()), int((n == 1).sum()), int((n == 2).sum())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *h[often].view(np.int64).tolist()], pa.int64()), pa.array([0, *n[often].tolist()], pa.int64()), *(pa.array([x] + [0] * len(often), pa.int64()) for x in total)], names=["h", "n", "words", "tokens", "once", "twice"]
        )

    return run


def _count_bigrams(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(units.n * units.n, np.int64)
        for b in batches:
            for body in b.column("body"):
                t = Tokens(body.as_py())
                unit = units.of(t.hashes)[t.training()]
                total += np.bincount(np.concatenate(([units.n - 1], unit[:-1])) * units.n + unit, minlength=len(total))  # each text ends with the end, which begins the next
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    return run


def _send_neighbours(units: Units, of: np.ndarray, classes: int, n: int):
    """Of each pack, how often its words that are not frequent have which class before and after them (kind 1), other such words being in the class of rare ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, body in zip(b.column("pack").to_pylist(), b.column("body"), strict=True):
                t = Tokens(body.as_py())
                words = t.training()
                unit = units.of(t.hashes)
                open_ = unit == units.top
                cls, here = of[unit][words], np.flatnonzero(open_[words])
                found: list[dict[str, np.ndarray]] = []
                for side, by in enumerate((-1, 1)):  # an open word is never a text's last token
                    other = here + by
                    same = (other >= 0) & (words[other] == words[here])
                    slots = np.where(other < 0, classes - 1, cls[other]) + side * classes
                    slots[same] = 2 * classes
                    keep = here[~same] if side else here  # a word after itself counts once
                    slots = slots[~same] if side else slots
                    many = np.bincount(words[keep].astype(np.int64) * (2 * classes + 1) + slots) if len(keep) else np.zeros(0, np.int64)
                    some = np.flatnonzero(many)
                    found.append({"h": t.hashes[some // (2 * classes + 1)], "slot": some % (2 * classes + 1), "n": many[some]})
                x = joined(found, BESIDE)
                out = dealt(1, number, (mix(x["h"]) % U(n)).astype(np.int64), x, BESIDE)
                if out:
                    yield rows_of(out)

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int, fixed: int = 1) -> np.ndarray:
    """A class for each unit (rows and columns of ``bigrams``); the last ``fixed`` units keep the last classes, one each, for themselves."""
    n = len(bigrams)
    weight = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    by_weight = np.argsort(-weight[: n - fixed], kind="stable")
    of = np.empty(n, np.int64)
    of[by_weight] = np.arange(n - fixed) % (classes - fixed)
    of[n - fixed :] = np.arange(classes - fixed, classes)
    one_hot = np.eye(classes)
    right = bigrams @ one_hot[of]  # unit -> class after it
    left = bigrams.T @ one_hot[of]  # unit -> class before it
    joint = one_hot[of].T @ right
    own = np.diag(bigrams).astype(float)
    for _ in range(sweeps):
        moved = 0
        for w in by_weight.tolist():
            c = of[w]
            r, s, d = right[w].copy(), left[w].copy(), own[w]
            if not r.sum() + s.sum():
                continue
            # Take w out of its class.
            joint[c] -= r
            joint[:, c] -= s
            joint[c, c] += d
            r[c] -= d
            s[c] -= d
            # What each class would gain: its row and column with w, where they cross w with itself and the class.
            gain = (_xlogx(joint + r) - _xlogx(joint)).sum(axis=1) + (_xlogx(joint + s[:, None]) - _xlogx(joint)).sum(axis=0)
            at = np.diag(joint)
            gain += _xlogx(at + r + s + d) - _xlogx(at + r) - _xlogx(at + s) + _xlogx(at)
            before, after = joint.sum(axis=1), joint.sum(axis=0)
            gain -= _xlogx(before + r.sum() + d) - _xlogx(before) + _xlogx(after + s.sum() + d) - _xlogx(after)
            gain[classes - fixed :] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + 1e-9:
                best = int(c)
            moved += best != c
            joint[best] += r
            joint[:, best] += s
            joint[best, best] += d
            if best != c:
                of[w] = best
                column, row = bigrams[:, w], bigrams[w]
                right[:, c] -= column
                right[:, best] += column
                left[:, c] -= row
                left[:, best] += row
        if not moved:
            break
    return of


def best_classes(word: np.ndarray, slot: np.ndarray, n: np.ndarray, size: int, joint: np.ndarray) -> np.ndarray:
    """The class of each of ``size`` words to which it moves from the class of rare words, the last but one, where it is.

    ``joint`` has the bigrams of classes, these words' among them; of each word there are counts of the classes before it (slots from 0), of those
    after it (slots from the number of classes on), and of itself after itself (the last slot). Gains are those of each word's own move from this state.
    """
    order = np.argsort(word, kind="stable")
    word, slot, n = word[order], slot[order], n[order].astype(float)
    out, step = np.zeros(size, np.int64), 1 << 13
    cuts = np.searchsorted(word, np.arange(0, size + step, step))
    for k, (i, j) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
        some = min(step, size - k * step)
        if some > 0:
            out[k * step : k * step + some] = _best(word[i:j] - k * step, slot[i:j], n[i:j], some, joint)
    return out


def _best(word: np.ndarray, slot: np.ndarray, n: np.ndarray, size: int, joint: np.ndarray) -> np.ndarray:
    classes = len(joint)
    rare, at = classes - 2, np.diag(joint)
    dense = np.bincount(word * (2 * classes + 1) + slot, n, size * (2 * classes + 1)).reshape(size, -1)
    before, after, itself = dense[:, :classes], dense[:, classes:-1], dense[:, -1:]
    # What a class would gain in its bigrams with each class beside the word. Those with rare words and with itself follow below, as the word changes both ends.
    gain = np.zeros((size, classes))
    for own, table in ((before, joint), (after, joint.T)):
        w, c = np.nonzero(own)
        w, c = w[c != rare], c[c != rare]
        for i in range(0, len(w), 1 << 16):
            words, beside = w[i : i + (1 << 16)], c[i : i + (1 << 16)]
            rows = _xlogx(table[beside] + own[words, beside][:, None]) - _xlogx(table[beside])
            rows[np.arange(len(words)), beside] = 0.0
            begin = np.flatnonzero(np.diff(words, prepend=-1))
            gain[words[begin]] += np.add.reduceat(rows, begin)
    gain += _xlogx(at + before + after + itself) - _xlogx(at)
    for out, back, table in ((after, before, joint[:, rare]), (before, after, joint[rare])):
        less = table - back  # without the word, which stands among the rare ones
        gain += _xlogx(less + out[:, [rare]]) - _xlogx(less)
    sums = before.sum(axis=1, keepdims=True) + itself, after.sum(axis=1, keepdims=True) + itself
    for total, own in zip((joint.sum(axis=0), joint.sum(axis=1)), sums, strict=True):
        gain -= _xlogx(total + own) - _xlogx(total)
    # To stay is to go back to where it was taken from.
    others = np.arange(classes) != rare
    stay = sum((_xlogx(t[others]) - _xlogx(t[others] - x[:, others])).sum(axis=1) for t, x in ((joint[:, rare], before), (joint[rare], after)))
    corner = at[rare] - before[:, rare] - after[:, rare] - itself[:, 0]
    stay += _xlogx(at[rare]) - _xlogx(corner)
    for total, own in zip((joint.sum(axis=0), joint.sum(axis=1)), sums, strict=True):
        stay -= _xlogx(total[rare]) - _xlogx(total[rare] - own[:, 0])
    gain[:, rare] = stay
    gain[:, -1] = -np.inf
    return np.argmax(gain, axis=1)


def _answer(units: Units, of: np.ndarray, joint: np.ndarray):
    """Of one part of the words: counts and classes of each pack's words, in their order (kind 1), and tokens and words of each class (kind 2)."""
    classes = len(joint)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, beside = [], []
        for b in batches:
            for kind, target, source, raw in zip(*(b.column(c).to_pylist() for c in ("kind", "target", "source", "payload")), strict=True):
                if kind == 0:
                    asked.append((target, source, unpack(raw, COUNT)[0]))
                else:
                    beside.append(unpack(raw, BESIDE)[0])
        if not asked:
            return
        h, n = _summed([x for _, _, x in asked])
        unit = units.of(h)
        cls = of[unit]
        x = joined(beside, BESIDE)
        at = np.searchsorted(h, x["h"])
        moves = np.flatnonzero((unit == units.top) & (n > 1))
        number = np.full(len(h), -1)
        number[moves] = np.arange(len(moves))
        some = np.flatnonzero(number[at] >= 0)
        if len(moves):
            cls[moves] = best_classes(number[at[some]], x["slot"][some].astype(np.int64), x["n"][some], len(moves), joint)
        out = []
        for part, source, own in asked:
            place = np.searchsorted(h, own["h"])
            out += dealt(1, part, np.full(len(place), source), {"n": n[place], "cls": cls[place]}, ANSWER)
        known = n > 0
        sums = {"n": np.bincount(cls[known], n[known], classes).astype(np.int64), "cls": np.bincount(cls[known], minlength=classes)}
        yield rows_of(out + dealt(2, -1, np.zeros(classes, np.int64), sums, (("n", "<u8"), ("cls", "<u8"))))

    return run


def _classed(n: int, classes: int):
    """Packs with the counts and classes of their words (kind 0), and the bigrams of classes in training (kind 1, one row for each task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for number, body, parts in with_parts(batches):
            t = Tokens(body)
            part = (mix(t.hashes) % U(n)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            # Every part answers in the order in which it was asked.
            answers = {source: unpack(raw, ANSWER)[0] for _, source, raw in parts}
            x = joined([answers[p] for p in np.unique(part).tolist()], ANSWER)
            counts, cls = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            counts[order], cls[order] = x["n"], x["cls"]
            words = cls[t.training()]
            total += np.bincount(np.concatenate(([classes - 1], words[:-1]))[: len(words)] * classes + words, minlength=len(total))
            b = read(body)
            one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))
            names = [c for c in b.schema.names if c != "hashes"]
            whole = pa.RecordBatch.from_arrays([*(b.column(c) for c in names), one(counts), one(cls.astype(np.uint16))], names=[*names, "n", "cls"])
            yield rows_of([(0, number, number, written(whole))])
        if total.any():
            yield rows_of([(1, 0, 0, total.astype("<i8").tobytes())])

    return run


class Model:
    """Transitions between classes and emissions from them. ``words`` and ``kinds`` are the tokens and the different words of each class."""

    def __init__(self, joint: np.ndarray, words: np.ndarray, kinds: np.ndarray, total: int, different: int, discount: float, alpha: float):
        classes = len(joint)
        self.rare, self.total, self.different, self.discount, self.words = classes - 2, total, different, discount, words
        self.transition = np.log10((joint + alpha) / (joint.sum(axis=1, keepdims=True) + alpha * classes))
        rare = words[self.rare]
        self.unknown = math.log10(discount * kinds[self.rare] / rare) if rare else 0.0

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.total + self.different + 1))

    def emission(self, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
        known = np.log10(np.maximum(count - np.where(cls == self.rare, self.discount, 0.0), 1e-9) / np.maximum(self.words[cls], 1))
        return np.where(count > 0, known, self.unknown)


def _scores(model: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("payload"):
                b = read(body.as_py())
                ids, held, counts, place, n, cls = (b.column(c).values for c in ("id", "held", "counts", "place", "n", "cls"))
                counts, place, n, cls = counts.to_numpy(), place.to_numpy(), n.to_numpy(), cls.to_numpy().astype(np.int64)
                if not len(counts):
                    continue
                base, emission = model.base(n), model.emission(n, cls)
                begin = np.cumsum(counts) - counts
                now = cls[place]
                step = model.transition[np.concatenate(([len(model.transition) - 1], now[:-1])), now] + emission[place]
                known = np.add.reduceat((n[place] > 0).astype(np.int64), begin)
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(counts), pa.array(known), pa.array(np.add.reduceat(base[place], begin)), pa.array(np.add.reduceat(step, begin))], names=names)

    return run


def train(docs: DataFrame, *, top: int = 1024, classes: int = 16, sweeps: int = 4, alpha: float = 0.1) -> tuple[Model, DataFrame]:
    """The model of those of (id, held, text) that are not held out, and packs (payload) of all of them, with counts and classes of their words."""
    spark = docs.sparkSession
    packs = packed(docs, tokenized, name="lm-packs")
    n = n_parts(spark, packs)
    bodies = packs.select("pack", "body")
    asked = save(bodies.mapInArrow(_send_words(n), ROW), "lm-words")
    counted = save(dealt_to(asked, n).mapInArrow(_frequent(top), "h long, n long, words long, tokens long, once long, twice long"), "lm-counts")
    different, total, once, twice = (x or 0 for x in counted.agg(*(F.sum(c) for c in ("words", "tokens", "once", "twice"))).first())
    often = counted.filter(F.col("h").isNotNull()).orderBy(F.desc("n"), "h").limit(top).select("h").collect()
    units = Units(np.array([r[0] for r in often], np.int64).view(U))
    classes = max(classes, round(different**0.25)) + 2

    bigrams = np.zeros(units.n * units.n)
    found = bodies.mapInArrow(_count_bigrams(units), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most a number for each pair of units
    bigrams[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    bigrams = bigrams.reshape(units.n, units.n)
    of = exchange(bigrams, classes, sweeps, fixed=2)
    joint = np.zeros((classes, classes))
    np.add.at(joint, (of[:, None], of[None, :]), bigrams)

    beside = bodies.mapInArrow(_send_neighbours(units, of, classes, n), ROW)
    answers = save(dealt_to(asked.union(beside), n).mapInArrow(_answer(units, of, joint), ROW), "lm-answers")
    remove(spark, asked, counted)
    words, kinds = np.zeros(classes), np.zeros(classes)
    for (raw,) in answers.filter("kind = 2").select("payload").toLocalIterator():  # one row for each part
        x, _ = unpack(raw, (("n", "<u8"), ("cls", "<u8")))
        words, kinds = words + x["n"], kinds + x["cls"]

    classed = save(together(packs, answers.filter("kind = 1"), n).mapInArrow(_classed(n, classes), ROW), "lm-classes")
    remove(spark, packs, answers)
    joint = np.zeros((classes, classes))
    for (raw,) in classed.filter("kind = 1").select("payload").toLocalIterator():  # one row for each task
        joint += np.frombuffer(raw, "<i8").reshape(classes, classes)
    discount = min(once / (once + 2 * twice), 0.999) if once else 0.5
    return Model(joint, words, kinds, total, different, discount, alpha), classed.filter("kind = 0").select("payload")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document; trained on those not held out."""
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    model, packs = train(rows, **options)
    shape = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])
    out = packs.mapInArrow(_scores(model, shape.names), shape)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(model.total)).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(score: float, tokens: int) -> float:
    return math.pow(10, -score / max(1, tokens))
