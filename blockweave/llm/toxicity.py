"""Toxicity scores of texts restored by a noisy-channel decoder.

1. A character trigram model is counted over all texts.
2. Words that may be disguised (symbols or digits that stand for letters, letters set apart, repeated
   letters, letters and symbols spaced out over words, words of symbols alone) become character lattices: every position offers the letters it
   may stand for, or nothing, each at a cost. Viterbi decoding under the character model picks the restored
   word, or words where spaced letters make up more than one. Other words have a lattice with one path, which
   is the word itself.
3. Restored words and their prefixes are features. Their weights come from labelled documents: features that
   toxic documents have much more often are selected by the G statistic, then a logistic regression with an
   L2 penalty is fitted on which of them each document has.

Labels are learnt only from documents whose crc32 of the id (as text) mod 5 is not 0, at most
``per_class`` of each label (those of the smallest id hash, a bounded and repeatable sample). The character
model covers all texts. Only ``text`` is an input of a score.

Edge cases: null and empty texts get the score of a document without any feature; very long texts are read whole;
words of more than LONG characters are decoded in pieces, cut where the decoder's state is certain, and where a
long stretch has no such place, with OVERLAP characters of context; a row without a doc_id is scored, is not
held out and teaches nothing; without labels of both kinds every score is the share of toxic labels (0 without labels);
a document with several labels is toxic if any says so; rows that repeat give a row each; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written
from .textkit import BASE, BASE_INV, BYTE, SPACE, U, _power, bytes_of, chunks, give_back, mix

#: Letters that a symbol may stand for, beside itself being a mere mark.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h", "%": "o", "&": "a"}
#: Log costs of the channel: a symbol for a letter, a mark dropped, a symbol dropped, a repeated letter dropped.
STAND_COST, MARK_COST, DROP_COST, REPEAT_COST = -1.0, -0.2, -4.0, -0.5
#: Log costs of a doubled letter dropped (where not all letters are doubled), and of a word's end between spaced letters.
DOUBLE_COST, BOUND_COST = -2.5, -1.0
#: Bytes that a prefix feature takes.
PREFIXES = (4, 5, 6, 7, 8)
#: Labelled documents of each label that the fit takes at most.
PER_CLASS = 3000
#: Characters from which a word is decoded in pieces, of a piece at least, and of context where a cut is not exact.
LONG, PIECE, OVERLAP = 512, 96, 128
#: Paths up to which a lattice's paths are scored one by one.
FEW_PATHS = 16
#: Least G statistic of a selected feature; penalty of the fit.
LEAST_G, L2 = 18.0, 0.1
#: A feature counts once for each of these numbers of times that a document has it.
TIMES = (1, 2, 4)
#: Words that a generation of a worker's memo holds, of this many characters at most.
MEMO, MEMO_CHARS = 100_000, 64
#: Character classes: 0 the edge of a word, 1-26 letters, 27 any other letter.
CLASSES = 28

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[128:] = True
CLASS = np.zeros(256, np.int64)
CLASS[65:91] = CLASS[97:123] = np.arange(1, 27)
CLASS[128:] = 27
#: The class of a character of a restored word in ASCII: a space is an edge, "?" is any letter beyond ASCII.
PLAIN_CLASS = np.full(128, 27, np.int64)
PLAIN_CLASS[97:123] = np.arange(1, 27)
PLAIN_CLASS[32] = 0
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in STANDS_FOR]] = True


def trigrams(data: np.ndarray) -> np.ndarray:
    """Counts of three successive character classes (CLASSES cubed) in a buffer of text; a word's edge counts twice."""
    c = CLASS[data[LETTER[data] | SPACE[data]]]
    total = np.zeros(CLASSES**3, np.int64)
    if len(c) > 2:
        total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        # what follows an edge has the edge before that, too
        heads = c[1:][c[:-1] == 0]
        total[:CLASSES] += np.bincount(heads, minlength=CLASSES)
    return total


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a class after two others: counts of one, two and three classes, interpolated."""
    three = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    share = lambda x: x / np.maximum(x.sum(axis=-1, keepdims=True), 1)
    return np.log(0.8 * share(three) + 0.15 * share(two)[None] + 0.04 * share(one)[None, None] + 0.01 / CLASSES)


def character_model(texts: DataFrame) -> np.ndarray:
    """Log probabilities of a character class after two others, counted over all of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            data, off = bytes_of(batch.column(0))
            for a, b in chunks(off):
                total += trigrams(data[off[a] : off[b]])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["three", "n"])

    counts = np.zeros(CLASSES**3)
    for r in texts.select(F.col("text").cast("string")).mapInArrow(run, "three long, n long").groupBy("three").agg(F.sum("n").alias("n")).collect():  # CLASSES cubed rows at most
        counts[r["three"]] += r["n"]
    return smoothed(counts)


def double_cost(low: str) -> float:
    """The cost of dropping one of two equal letters in a word: less where all its letters are doubled."""
    solid = low.replace(" ", "")
    first = next((i for i, ch in enumerate(solid) if ch.isalpha()), len(solid))
    if solid[first : first + 1] != solid[first + 1 : first + 2]:  # most words: the first letter stands once
        return DOUBLE_COST
    stretches = [len(list(g)) for ch, g in groupby(solid) if ch.isalpha()]
    return REPEAT_COST if len(stretches) > 1 and min(stretches) > 1 else DOUBLE_COST


def lattice(word: str, double: float | None = None) -> list[list[tuple[str, float]]]:
    """For each character what it may stand for, with costs; "" is nothing."""
    out: list[list[tuple[str, float]]] = []
    low = word.lower()
    solid = low.replace(" ", "")
    double = double_cost(low) if double is None else double
    run, i = 0, -1
    for ch in low:
        if ch == " ":  # between spaced letters: nothing, or a word's end
            out.append([("", 0.0), (" ", BOUND_COST)])
            continue
        i += 1
        run = run + 1 if i and solid[i - 1] == ch else 1
        if ch.isalpha():
            again = run > 2 or i + 1 < len(solid) and run > 1 and solid[i + 1] == ch
            out.append([(ch, 0.0), ("", REPEAT_COST if again else double)] if run > 1 else [(ch, 0.0)])
        elif ch in STANDS_FOR:
            out.append([*((x, STAND_COST) for x in STANDS_FOR[ch]), ("", DROP_COST if ch.isdigit() or ch in "@$!" else MARK_COST)])
        else:
            out.append([("", MARK_COST)])
    return out


def _class(ch: str) -> int:
    return 0 if ch == " " else ord(ch) - 96 if "a" <= ch <= "z" else 27


@dataclass
class Piece:
    """Part of a word: its lattice, the last two classes before it, whether the word ends with it, the places whose outcome counts."""

    lattice: list
    before: tuple[int, int] = (0, 0)
    final: bool = True
    places: slice = slice(None)


def pieces(word: str) -> list[Piece]:
    """A word in parts that are decoded apart.

    After two letters in a row that can only stand for themselves the decoder's state is certain, so a cut there
    changes nothing. A long stretch without such a place is cut with OVERLAP places of context on both sides.
    """
    if len(word) <= LONG:
        return [Piece(lattice(word))]
    low = word.lower()
    double, out, lo, known, begin = double_cost(low), [], 0, (0, 0), 0
    for c in range(2, len(low)):
        if c - lo < PIECE:
            continue
        p, q, nxt = low[c - 2], low[c - 1], low[c]
        if p.isalpha() and q.isalpha() and p != q and q != nxt and low[c - 3] != p:
            out.append(Piece(lattice(low[begin:c], double), known, False, slice(lo - begin, None)))
            lo = begin = c
            known = (_class(p), _class(q))
        elif c - lo >= 8 * PIECE:
            out.append(Piece(lattice(low[begin : c + OVERLAP], double), known, c + OVERLAP >= len(low), slice(lo - begin, c - begin)))
            lo, begin, known = c, c - OVERLAP, (0, 0)
    out.append(Piece(lattice(low[begin:], double), known, True, slice(lo - begin, None)))
    return out


def restored(words: list[str], model: np.ndarray, at_once: int = 1 << 14) -> list[str]:
    """The most likely plain word behind each of ``words``: Viterbi over their lattices, many together, long words in pieces."""
    parts: list[Piece] = []
    of: list[int] = []
    out: list[list[str]] = [[] for _ in words]

    def flush() -> None:
        text = [""] * len(parts)
        order = sorted(range(len(parts)), key=lambda i: len(parts[i].lattice))
        k = 0
        while k < len(order):
            j, longest = k, len(parts[order[k]].lattice)
            while j < len(order) and (j - k + 1) * max(1, len(parts[order[j]].lattice)) <= at_once:
                longest = len(parts[order[j]].lattice)
                j += 1
            j = max(j, k + 1)
            for i, w in zip(order[k:j], _viterbi([parts[i] for i in order[k:j]], longest, model), strict=True):
                text[i] = w
            k = j
        for i, w in zip(of, text, strict=True):
            out[i].append(w)
        parts.clear()
        of.clear()

    held = 0
    few: list[tuple[int, list]] = []
    for i, word in enumerate(words):
        own = pieces(word)
        if len(own) == 1 and prod(map(len, own[0].lattice)) <= FEW_PATHS:
            few.append((i, own[0].lattice))
            continue
        for piece in own:
            parts.append(piece)
            of.append(i)
            held += len(piece.lattice)
            if held > 16 * at_once:  # lattices held at a time
                flush()
                held = 0
    flush()
    for (i, _), w in zip(few, _best_of_few([x for _, x in few], model), strict=True):
        out[i].append(w)
    return ["".join(x) for x in out]


def _best_of_few(lattices: list[list], model: np.ndarray) -> list[str]:
    """The best path of lattices with few paths, each path scored whole: what Viterbi's recursion gives, at less cost."""
    if not lattices:
        return []
    texts, costs, count = [], [], []
    for x in lattices:
        paths = [("", 0.0)]
        for options in x:
            paths = [(t + options[0][0], c + options[0][1]) for t, c in paths] if len(options) == 1 else [(t + ch, c + y) for t, c in paths for ch, y in options]
        texts += [t for t, _ in paths]
        costs += [c for _, c in paths]
        count.append(len(paths))
    # every path as classes between two edges before it and one after it
    flat = PLAIN_CLASS[np.frombuffer("".join(f"  {t} " for t in texts).encode("ascii", "replace"), np.uint8)]
    size = np.array([len(t) for t in texts])
    start = np.concatenate(([0], np.cumsum(size + 3)))[:-1]
    upto = np.concatenate(([0.0], np.cumsum(model.reshape(-1)[(flat[:-2] * CLASSES + flat[1:-1]) * CLASSES + flat[2:]])))
    score = np.array(costs) + upto[start + size + 1] - upto[start]
    out, at = [], 0
    for n in count:
        out.append(texts[at + int(score[at : at + n].argmax())])
        at += n
    return out


_MEMO: dict = {"model": None, "young": {}, "old": {}}


def remembered(words: list[str], model: np.ndarray) -> dict[str, str]:
    """``restored`` for distinct words, most of which a worker has met before: a young and an old generation of bounded size."""
    if _MEMO["model"] is not model and (_MEMO["model"] is None or not np.array_equal(_MEMO["model"], model)):
        _MEMO.update(model=model, young={}, old={})
    young, old = _MEMO["young"], _MEMO["old"]
    out, fresh = {}, []
    for w in words:
        known = young.get(w)
        if known is None:
            known = old.get(w)
            if known is None:
                fresh.append(w)
                continue
            young[w] = known
        out[w] = known
    for w, plain in zip(fresh, restored(fresh, model), strict=True):
        out[w] = plain
        if len(w) <= MEMO_CHARS:
            young[w] = plain
    if len(young) > MEMO:
        _MEMO.update(young={}, old=young)
    return out


def _viterbi(parts: list[Piece], longest: int, model: np.ndarray) -> list[str]:
    n, width = len(parts), max((len(o) for x in parts for o in x.lattice), default=1)
    code = np.full((n, longest, width), -2, np.int64)  # -1: nothing, -2: no such option
    cost = np.full((n, longest, width), -np.inf)
    for i, x in enumerate(parts):
        for p, options in enumerate(x.lattice):
            for o, (ch, c) in enumerate(options):
                code[i, p, o] = -1 if not ch else _class(ch)
                cost[i, p, o] = c
    code[code[:, :, 0] == -2, 0], cost[cost[:, :, 0] == -np.inf, 0] = -1, 0.0  # past the end: nothing, free
    # a state is the last two letters; score[i, b, c] is the best path's that ends with them
    score = np.full((n, CLASSES, CLASSES), -np.inf)
    score[np.arange(n), [x.before[0] for x in parts], [x.before[1] for x in parts]] = 0
    came = np.zeros((longest, n, CLASSES, CLASSES), np.int8)
    took = np.full((longest, n, CLASSES, CLASSES), -1, np.int8)
    for p in range(longest):
        new = np.full_like(score, -np.inf)
        for o in range(width):
            c = code[:, p, o]
            drop = np.flatnonzero(c == -1)
            if len(drop):
                stay = score[drop] + cost[drop, p, o][:, None, None]
                better = stay > new[drop]
                new[drop] = np.where(better, stay, new[drop])
                took[p][drop] = np.where(better, np.int8(o), took[p][drop])
            emit = np.flatnonzero(c >= 0)
            if len(emit):
                to = c[emit]
                paths = score[emit] + model[:, :, to].transpose(2, 0, 1)  # word, before last, last
                best = paths.argmax(axis=1)
                value = np.take_along_axis(paths, best[:, None, :], 1)[:, 0] + cost[emit, p, o][:, None]
                better = value > new[emit, :, to]
                new[emit, :, to] = np.where(better, value, new[emit, :, to])
                came[p][emit, :, to] = np.where(better, best.astype(np.int8), came[p][emit, :, to])
                took[p][emit, :, to] = np.where(better, np.int8(o), took[p][emit, :, to])
        score = new
    final = np.array([x.final for x in parts])[:, None, None]
    ends = (score + np.where(final, model[:, :, 0], 0.0)).reshape(n, -1).argmax(axis=1)
    b, c = ends // CLASSES, ends % CLASSES
    i = np.arange(n)
    picks = np.empty((n, longest), np.int8)
    for p in range(longest - 1, -1, -1):
        picks[:, p] = took[p, i, b, c]
        dropped = code[i, p, picks[:, p]] == -1
        b, c = np.where(dropped, b, came[p, i, b, c]), np.where(dropped, c, b)
    return ["".join([options[picks[k, p]][0] for p, options in enumerate(x.lattice)][x.places]) for k, x in enumerate(parts)]


def _hash(run: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((run[b] - run[a]) * down[a] + (b - a).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def _with_prefixes(run, down, a, b, row):
    """(hash, row) of the pieces [a, b) of a buffer and of their prefixes."""
    hashes, rows = [_hash(run, down, a, b)], [row]
    for n in PREFIXES:
        far = np.flatnonzero(b - a > n)
        hashes.append(_hash(run, down, a[far], a[far] + n) ^ U(0x5851F42D4C957F2D))
        rows.append(row[far])
    return np.concatenate(hashes), np.concatenate(rows)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * _power("up", BASE, n)[:n], out=run[1:])
    return run, _power("down", BASE_INV, n + 1)[: n + 1]


def folded_marks(data: np.ndarray) -> np.ndarray:
    """The bytes with capitals of the Latin-1 range (UTF-8: C3 80 to C3 9E) as small letters."""
    cap = np.flatnonzero(data[:-1] == 0xC3) + 1
    cap = cap[(data[cap] >= 0x80) & (data[cap] <= 0x9E) & (data[cap] != 0x97)]
    if len(cap):
        data = data.copy()
        data[cap] += 32
    return data


def features(data: np.ndarray, off: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the restored words of each row of a chunk, and of their prefixes; repeats included."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data = folded_marks(data)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    solid = ~SPACE[data]
    head = solid.copy()
    head[1:] &= ~solid[:-1] | cut[1:n]
    tail = solid.copy()
    tail[:-1] &= ~solid[1:] | cut[1:n]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    row = np.searchsorted(off, starts, "right") - 1
    letter = LETTER[data]
    places = np.flatnonzero(letter)
    upto = np.zeros(n + 1, np.int64)
    np.cumsum(letter, out=upto[1:])
    count = upto[ends] - upto[starts]
    has = count > 0
    # the part from the first to the last letter of a word
    a, b = starts.copy(), ends.copy()
    a[has], b[has] = places[upto[starts[has]]], places[upto[ends[has]] - 1] + 1
    odd = has & (b - a != count)  # marks among the letters
    folded = FOLD[data]
    same = np.zeros(n, bool)
    same[1:] = letter[1:] & (folded[1:] == folded[:-1]) & (data[1:] < 128)
    reps = np.zeros(n + 1, np.int64)
    np.cumsum(same, out=reps[1:])
    odd |= reps[b] - reps[np.minimum(a + 1, b)] > 0
    # symbols right before or after the letters, but for runs of one mark, which are decoration
    lead, trail = has & (a > starts), has & (b < ends)
    left = np.flatnonzero(lead)
    odd[left] |= SYMBOL[data[a[left] - 1]] & ((a[left] - starts[left] < 3) | (data[a[left] - 1] != data[np.maximum(a[left] - 2, 0)]))
    right = np.flatnonzero(trail)
    last = data[b[right]]
    odd[right] |= SYMBOL[last] & (last != 33) & ((ends[right] - b[right] < 3) | (last != data[np.minimum(b[right] + 1, n - 1)]))
    # words of symbols alone, but for runs of one mark
    signs, turns = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    np.cumsum(SYMBOL[data], out=signs[1:])
    np.cumsum(np.r_[False, data[1:] != data[:-1]], out=turns[1:])
    odd |= ~has & (signs[ends] - signs[starts] > 1) & (turns[ends] - turns[starts + 1] > 0)
    # letters spaced out: one-character words in a row, three or more of them letters or symbols, one a letter
    single = ends - starts == 1
    joined: list[tuple[int, int]] = []
    if single.any():
        brk = np.r_[True, ~(single[1:] & single[:-1] & (row[1:] == row[:-1]))]
        group = np.flatnonzero(brk)
        length = np.diff(np.r_[group, len(single)])
        member = np.add.reduceat((letter | SYMBOL[data])[starts].astype(np.int64), group)
        some = single[group] & (length > 2) & (member > 2) & (np.add.reduceat(has.astype(np.int64), group) > 0)
        joined = list(zip(group[some].tolist(), length[some].tolist(), strict=True))
    plain = has & ~odd
    for g, m in joined:
        plain[g : g + m] = False
    run, down = _sums(data)
    h, r = _with_prefixes(run, down, a[plain], b[plain], row[plain])
    raw = [bytes(data[i:j]).decode("utf-8", "replace") for i, j in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)]
    raw_row = row[odd].tolist()
    for g, m in joined:
        text = " ".join(bytes(data[starts[g : g + m]]).decode())
        raw.append(text)
        raw_row.append(int(row[g]))
        if m > 3 and text[0] in "aAiI":  # it may be a word before a spaced one
            raw.append(text[2:])
            raw_row.append(int(row[g]))
    if not raw:
        return h, r
    plain_of = remembered(list(dict.fromkeys(raw)), model)
    parts = [(w.encode(), r) for x, r in zip(raw, raw_row, strict=True) for w in plain_of[x].split(" ")]
    words, raw_row = [w for w, _ in parts], [r for _, r in parts]
    buffer = np.frombuffer(b"".join(words), np.uint8)
    edge = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    run, down = _sums(buffer)
    some = np.flatnonzero(np.diff(edge) > 0)
    h2, r2 = _with_prefixes(run, down, edge[some], edge[some + 1], np.array(raw_row, np.int64)[some])
    return np.concatenate([h, h2]), np.concatenate([r, r2])


def distinct_pairs(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (row, hash) pairs, as (hash, row, count)."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    heads = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.empty(0, np.int64)
    return h[heads], row[heads], np.diff(np.r_[heads, len(h)])


@dataclass
class Model:
    """What scoring needs: the character model, the sorted selected features, their weights (by TIMES), the intercept."""

    characters: np.ndarray
    chosen: np.ndarray
    weights: np.ndarray
    intercept: float

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.chosen & U(0xFFFF)).astype(np.int64)] = True

    def found(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature number, row) of the selected features among the pairs, once for each of TIMES that they reach."""
        k = len(self.chosen)
        if not k:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        near = self.maybe[(h & U(0xFFFF)).astype(np.int64)]
        h, row = h[near], row[near]
        at = np.minimum(np.searchsorted(self.chosen, h), len(self.chosen) - 1)
        hit = self.chosen[at] == h
        f, row, n = distinct_pairs(at[hit], row[hit])
        parts = [(f[n >= t] + i * k, row[n >= t]) for i, t in enumerate(TIMES)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        f, row = self.found(*features(data, off, self.characters))
        z = self.intercept + np.bincount(row, self.weights[f], minlength=len(off) - 1) if len(f) else np.full(len(off) - 1, self.intercept)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id="doc_id"):
    """Whether the id's crc32 (as text) mod 5 is 0: not to be learnt from. No id: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _g(n1, t1: int, n0, t0: int):
    """G statistic (a column) of a feature seen in n1 of t1 toxic and n0 of t0 other documents."""
    total, seen = t1 + t0, n1 + n0
    out = F.lit(0.0)
    for o, e in ((n1, seen * t1 / total), (n0, seen * t0 / total), (t1 - n1, (total - seen) * t1 / total), (t0 - n0, (total - seen) * t0 / total)):
        out = out + F.when(o > 0, 2 * o * F.ln(o / e)).otherwise(0.0)
    return out


def _logistic(x_row: np.ndarray, x_col: np.ndarray, y: np.ndarray, k: int, weight: np.ndarray, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-penalised logistic regression on a sparse 0/1 matrix, by accelerated gradient steps."""
    n = len(y)
    w, b = np.zeros(k), 0.0
    v, c = w.copy(), b
    # a bound of the curvature: rows' squared lengths
    longest = np.bincount(x_row, minlength=n).max(initial=0) + 1
    per_col = np.bincount(x_col, weight[x_row], minlength=k).max(initial=0)
    step = 1 / (0.25 * min(longest * max(per_col, weight.sum()), longest * weight.sum()) / 4 + l2)
    for t in range(2000):
        z = c + np.bincount(x_row, v[x_col], minlength=n)
        r = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        gw, gb = np.bincount(x_col, r[x_row], minlength=k) + l2 * v, r.sum()
        w2, b2 = v - step * gw, c - step * gb
        m = t / (t + 3)
        v, c = w2 + m * (w2 - w), b2 + m * (b2 - b)
        if t > 50 and max(np.abs(w2 - w).max(initial=0), abs(b2 - b)) < 1e-6:
            w, b = w2, b2
            break
        w, b = w2, b2
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """The model from ``docs`` (doc_id, text: the character model) and ``labels`` (doc_id, toxic: the weights)."""
    characters = character_model(docs)
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("y"))
    known = known.filter(~held_out())
    pick = lambda y: known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    sample = F.broadcast(pick(0).union(pick(1)))  # at most 2 * per_class rows
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = written(own.join(sample, "doc_id").select("y", "text"), "labelled")
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    size = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        p = share.get(1, 0) / max(1, sum(share.values()))
        dropped(seen)
        return Model(characters, np.empty(0, np.uint64), np.empty(0), float(np.log(max(p, 1e-9) / max(1 - p, 1e-9))))

    def rows(batches, inner):
        for batch in batches:
            data, off = bytes_of(batch.column(1))
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in chunks(off):
                yield from inner(y[a:b], *features(data[off[a] : off[b]], off[a : b + 1] - off[a], characters))

    def counted(batches):
        """(h, n1, n0): how many toxic and other documents of a task have each feature."""

        def one(y, h, row):
            f, at, _ = distinct_pairs(h, row)
            yield f, y[at] == 1

        every = [*rows(batches, one), (np.empty(0, np.uint64), np.empty(0, bool))]
        h, at = np.unique(np.concatenate([f for f, _ in every]), return_inverse=True)
        bad = np.concatenate([y for _, y in every])
        n1 = np.bincount(at[bad], minlength=len(h))
        n0 = np.bincount(at[~bad], minlength=len(h))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n1, pa.int64()), pa.array(n0, pa.int64())], ["h", "n1", "n0"])

    t1, t0 = size[1], size[0]
    sums = seen.mapInArrow(counted, "h long, n1 long, n0 long").groupBy("h").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    much = (F.col("n1") + 0.5) / (t1 + 1) >= 4 * (F.col("n0") + 0.5) / (t0 + 1)
    # all that the statistic selects: each stands in several of the bounded sample's toxic documents
    selected = sums.filter(much & (_g(F.col("n1"), t1, F.col("n0"), t0) >= LEAST_G)).select("h").toPandas()["h"].to_numpy(np.int64)
    selected = np.sort(selected.view(np.uint64))
    chosen = Model(characters, selected, np.zeros(len(selected)), 0.0)

    def which(batches):
        def one(y, h, row):
            f, at = chosen.found(h, row)
            order = np.argsort(at, kind="stable")
            f, at = f[order], at[order]
            cuts = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(y))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(f, pa.int32()))], ["y", "f"])

        yield from rows(batches, one)

    got = seen.mapInArrow(which, "y int, f array<int>").collect()  # at most 2 * per_class rows
    dropped(seen)
    x_row = np.repeat(np.arange(len(got)), [len(r["f"]) for r in got])
    x_col = np.array([f for r in got for f in r["f"]], np.int64)
    y = np.array([r["y"] for r in got], np.float64)
    # the sample may hold other shares of the labels than all labelled documents do
    weight = np.where(y == 1, share[1] / t1, share[0] / t0)
    w, b = _logistic(x_row, x_col, y, len(selected) * len(TIMES), weight / weight.mean())
    return Model(characters, chosen.chosen, w, b)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs`` (doc_id, text)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = bytes_of(batch.column(1))
            s = [shipped.value.scores(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in chunks(off)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(s) if s else np.empty(0), pa.float64())], ["doc_id", "score"])
        give_back()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Scores of ``docs`` by a model trained on ``labels``."""
    return scored(docs, train(docs, labels, per_class))


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns stay. One pass, without a join."""
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = bytes_of(batch.column(place))
            for a, b in chunks(off):
                keep = shipped.value.scores(data[off[a] : off[b]], off[a : b + 1] - off[a]) < 0.5
                yield batch.slice(a, b - a).filter(pa.array(keep))
        give_back()

    return docs.mapInArrow(run, docs.schema)
