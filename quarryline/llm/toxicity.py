r"""Operator 9, toxicity through a noisy channel.

Obfuscated words are restored first.  What was written is taken as the noisy form of a plain word: a
lattice gives, for each written character, the letters it may stand for (leetspeak), that it may be an
inserted mark, or that a run of one letter may be a shorter run; letters spelled out one by
one are taken together, as one word and with a blank allowed between any two.  A mark before a word is
read as punctuation and, where it can be a letter, as that letter; a letter with an accent as itself and without.  Blanks inside a word are a channel of their own: up to
``_PIECES`` short neighbours that add up to a word of the lexicon are read as that word where the letter model finds it, with the blanks'
cost, likelier than the pieces.  The Viterbi algorithm finds the path that is likeliest under a
letter trigram model times the channel's costs.  A word whose lattice has but one path is its own restoration.

Restored words are scored by a lexicon: log odds of a word, or of its beginning, between documents
labelled toxic and others.  A document's hits (their sum, number, density and the largest) give a calibrated
probability by logistic regression; for the fit a labelled document's own count is left out of its words' odds.

The letter model, lexicon and calibration learn from all labelled documents: letter trigrams and the documents that hold each key are counted by grouping, and
each Newton step of the calibration adds up the tasks' gradients.  The driver holds the trigrams of letters and the lexicon, which keeps at most ``lexicon_size`` entries.  Scoring reads whole texts.  A task restores every distinct word once for each batch.

Defined results: null and empty texts, and texts without words, have no hits, and get the score of that; labels of one kind
only, or none, give every text the smoothed rate of label 1; a document labelled twice counts twice; repeated rows score alike; no other columns are read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import logistic
from .filters import unused, with_text
from .sampling import all_labelled_texts
from .store import materialize, scratch
from .words import hash_words, slices, text_bytes

# Letters that marks and digits stand for in leetspeak.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "¡": "i", "£": "l",
}
_ANY = "*"
_MARKS = "-._~'`^​·"
_ENDS = "\"'“”‘’«»()[]{}<>.,;:?!…|*_~&%#=\\/-"
_TRAIL = "&%#*$@!+"
_RUN = re.compile(r"(.)\1\1")
_PLAIN = re.compile(r"[A-Za-z]{2,30}\Z")
_LETTER = re.compile(r"[^\W\d_]")
_NOISE = re.compile("[" + re.escape("".join(LEET) + _ANY + _MARKS) + "]")
# channel costs, as log probabilities
_SWAP, _DROP, _SHORTEN, _WILD, _SPLIT, _JOIN = -1.0, -2.0, -0.5, -1.5, -0.5, -1.0
#: The most letters of a piece of a word, and the most pieces.
_PIECE, _PIECES = 5, 3
_NO_PIECE = "", False, False
_BEGINNINGS = (5, 6, 7)
_HEAD = 4  # of a key, and of every word that has it
_FLOOR, _BY_CHANCE = 2.0, 20


class LetterModel:
    """Trigram model of letters; words run from two blanks to one."""

    def __init__(self, words: Counter, size: int = 64, trigrams: dict[str, int] | None = None):
        """From counts of words, or of the ``trigrams`` of padded words."""
        if trigrams is None:
            trigrams = Counter()
            for w, n in words.items():
                for i in range(len(w) + 1):
                    trigrams[f"  {w} "[i : i + 3]] += n
        letters = Counter()
        for t, n in trigrams.items():
            letters[t[2]] += n
        self.letters = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0])) if _LETTER.match(c)][: size - 2]
        self.index = {c: i + 2 for i, c in enumerate(self.letters)}  # 0: blank, 1: any other character
        n = len(self.letters) + 2
        tri = np.zeros((n, n, n))
        for t, k in trigrams.items():
            tri[tuple(0 if c == " " else self.index.get(c, 1) for c in t)] += k
        bi = tri.sum(axis=0)
        uni = bi.sum(axis=0) + 0.5
        p1 = uni / uni.sum()
        p2 = (bi + 4 * p1) / (bi.sum(axis=1, keepdims=True) + 4)
        self.log = np.log((tri + 2 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 2))

    def likelihood(self, word: str) -> float:
        """The log probability of a plain word, its end included."""
        a = b = 0
        total = 0.0
        for c in word:
            i = self.index.get(c, 1)
            total += self.log[a, b, i]
            a, b = b, i
        return total + float(self.log[a, b, 0])

    def decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest string: each step of the lattice offers strings (of no, one or two letters, or a blank before one) at a cost.

        A path is its last option and the path before that, so a step costs the same however long the word is.
        """
        log, index = self.log, self.index
        paths: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}
        for options in lattice:
            after: dict[tuple[int, int], tuple] = {}
            for (a, b), (score, made) in paths.items():
                for text, cost in options:
                    x, y, z = a, b, score + cost
                    for c in text:
                        if c == " ":
                            z += log[x, y, 0]
                            x = y = 0
                            continue
                        i = index.get(c, 1)
                        z += log[x, y, i]
                        x, y = y, i
                    if (x, y) not in after or z > after[x, y][0]:
                        after[x, y] = (z, (text, made))
            paths = after
        made = max(((s + log[a, b, 0], -a, -b), made) for (a, b), (s, made) in paths.items())[1]
        out = []
        while made is not None:
            text, made = made
            out.append(text)
        return "".join(reversed(out))


def lattice(word: str, letters: list[str]) -> list[list[tuple[str, float]]]:
    """What each character, or run of one letter, of a written word may stand for."""
    out: list[list[tuple[str, float]]] = []
    plain: dict[str, list[tuple[str, float]]] = {}  # one list for each letter, however long the word
    at = 0
    while at < len(word):
        c, end = word[at], at + 1
        while end < len(word) and word[end] == c:
            end += 1
        run = end - at
        if c in LEET:
            option = [(x, _SWAP) for x in LEET[c]] + [("", _DROP)]
            out += [option] if run > 2 else [option] * run
        elif c == _ANY:
            out += [[(x, _WILD) for x in letters] + [("", _DROP)]] * min(run, 2)
        elif c in _MARKS:
            out.append([("", _DROP / 2)])
        elif run > 2:
            out.append([(c, _SHORTEN), (c + c, _SHORTEN)])
        else:
            base = unaccented(c)
            out += [plain.setdefault(c, [(c, 0.0)] if base == c else [(c, 0.0), (base, _SWAP)])] * run
        at = end
    return out


class _Unaccented(dict):
    """Letters by code point, each taken apart once."""

    def __missing__(self, code: int) -> str:
        d = unicodedata.normalize("NFD", chr(code))
        self[code] = d[0] if d[0].isascii() and len(d) > 1 else chr(code)
        return self[code]


_unaccented = _Unaccented()


def unaccented(text: str) -> str:
    """Without the accents of Latin letters; other scripts keep their marks."""
    return text if text.isascii() else text.translate(_unaccented)


def bare(word: str) -> str:
    """A written word in lower case without outer punctuation, in time that grows with its length."""
    w = word.lower()
    if w and w[-1] in _TRAIL:
        cut = w.rstrip(w[-1])
        w = cut if len(w) - len(cut) > 2 else w
    return w.strip(_ENDS)


def _stands(word: str) -> bool:
    """Whether a written word is ASCII letters alone without a run of three, and so its own only reading."""
    return word.isascii() and word.isalpha() and not _RUN.search(word.lower())


def restore(word: str, model: LetterModel) -> str:
    """The plain word behind a written one, in lower case and without outer punctuation."""
    if _stands(word):
        return word.lower()
    return _decoded(bare(word), model)


def _decoded(w: str, model: LetterModel) -> str:
    if not w or not _LETTER.search(w):
        return ""
    if not _NOISE.search(w) and not _RUN.search(w):
        return w
    return model.decode(lattice(w, model.letters))


def readings(word: str, model: LetterModel, spelled: bool = False) -> list[str]:
    """All that a written word may stand for: its restoration; where the mark before it can be a letter, the word with that
    letter; and for letters spelled out one by one, the words that a lattice with blanks between letters splits them into.
    """
    w = bare(word)
    if not spelled and _stands(w) and word[: len(w)].lower() == w:  # nothing but marks after it
        return [w]
    out = [_decoded(w, model)]
    if spelled and out[0]:
        steps = lattice(w, model.letters)
        out += model.decode([*steps[:1], *([*o, *((" " + x, c + _SPLIT) for x, c in o if x)] for o in steps[1:])]).split()
    if (folded := unaccented(w)) != w:
        out.append(_decoded(folded, model))
    lower = word.lower()
    at = lower.find(w) if w else -1
    if at > 0 and lower[at - 1] in LEET:
        out.append(_decoded(lower[at - 1 : at] + w, model))
    return [x for x in out if x]


def features(word: str) -> list[str]:
    """A restored word's lexicon keys: itself, and its beginnings."""
    return [word, *(word[:k] + "-" for k in _BEGINNINGS if len(word) > k)] if word else []


class Joiner:
    """Words of a lexicon that are written in pieces."""

    def __init__(self, words: list[str], model: LetterModel):
        self.model = model
        self.words = {w for w in words if len(w) > 3}
        self.starts = {w[:i] for w in self.words for i in range(1, min(len(w), _PIECE + 1))}
        self.ends = {w[-i:] for w in self.words for i in range(1, min(len(w), _PIECE + 1))}

    def piece(self, word: str) -> tuple[str, bool, bool]:
        """What a short written word may be a piece of: its letters, and whether a listed word begins or ends with them."""
        if len(word) > _PIECE + 3:
            return _NO_PIECE
        if word.isascii() and word.isalpha():
            w = word.lower()
            return w, w in self.starts, w in self.ends
        b = bare(word)
        w = unaccented(b)
        if _NOISE.search(w) and _LETTER.search(w):  # too short to tell what could be left out
            w = self.model.decode([[o for o in step if o[0]] or step for step in lattice(w, self.model.letters)])
        return w, w in self.starts and word.lower() == b, w in self.ends

    def joined(self, pieces: list[str]) -> str | None:
        """The listed word that the pieces make, if that is the likelier reading."""
        word = "".join(pieces)
        if word not in self.words or any(p in self.words for p in pieces):
            return None
        apart = sum(self.model.likelihood(p) for p in pieces)
        return word if self.model.likelihood(word) + _JOIN * (len(pieces) - 1) > apart else None


def documents_words(column: pa.Array, restored, respelled=None, joiner: Joiner | None = None) -> Iterator[tuple[int, list[tuple], np.ndarray]]:
    """For each text its number of words, and the restored entries of its distinct words with their counts.

    ``restored`` maps a written word to whatever is wanted of it, once for each distinct word of the batch;
    ``respelled`` (or ``restored``) does so for words spelled out letter by letter.  ``joiner`` finds words that are written in pieces.
    """
    data, _ = text_bytes(column)
    w = hash_words(column)
    if not len(w.hashes):
        for _ in range(len(column)):
            yield 0, [], np.zeros(0, np.int64)
        return
    u, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()
    joins = joiner is not None and bool(joiner.words)
    entries, pieces = [], []
    for s, e in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True):
        word = raw[s:e].decode("utf-8", "replace")
        entries.append(restored(word))
        if joins:
            pieces.append(joiner.piece(word) if e - s <= 3 * _PIECE and len(word) <= _PIECE + 3 else _NO_PIECE)
    short = w.ends - w.starts <= 2  # single letters, beyond ASCII as well
    if joins:
        starts, ends, some = (np.array([p[i] if i else bool(p[0]) for p in pieces])[back] for i in (1, 2, 0))
        places = []  # of all runs of n pieces, and each text's own among them
        for n in range(2, min(_PIECES, len(back)) + 1):
            runs = len(back) - n + 1
            at = np.flatnonzero(starts[:runs] & ends[n - 1 :] & np.logical_and.reduce([some[k : runs + k] for k in range(n)]))
            places.append((n, at.tolist(), np.searchsorted(at, w.bounds[:-1]).tolist(), np.searchsorted(at, w.bounds[1:] - n + 1).tolist()))
    for d in range(len(column)):
        a, z = int(w.bounds[d]), int(w.bounds[d + 1])
        own, counts = np.unique(back[a:z], return_counts=True)
        mine = [entries[i] for i in own.tolist()]
        spelled = _spelled(raw, w, short, a, z)
        if spelled:
            mine += [(respelled or restored)(x) for x in spelled]
            counts = np.concatenate([counts, np.ones(len(spelled), np.int64)])
        if joins:
            found = []
            for n, at, begin, end in places:
                for i in at[begin[d] : max(end[d], begin[d])]:
                    word = joiner.joined([pieces[k][0] for k in back[i : i + n].tolist()])
                    found += [word] if word else []
            mine += [restored(x) for x in found]
            counts = np.concatenate([counts, np.ones(len(found), np.int64)])
        yield z - a, mine, counts


def _spelled(raw: bytes, w, short: np.ndarray, a: int, z: int) -> list[str]:
    """Words spelled out letter by letter: runs of three or more words of one character each."""
    if z - a < 3:
        return []
    s = short[a:z]
    runs = np.flatnonzero(s[:-2] & s[1:-1] & s[2:])
    out, done = [], -1
    for r in runs.tolist():
        if r <= done:
            continue
        e = r
        text = ""
        while e < len(s) and s[e]:
            c = raw[w.starts[a + e] : w.ends[a + e]].decode("utf-8", "replace")
            if len(c) != 1:
                break
            text += c
            e += 1
        if len(text) >= 3:
            out.append(text)
        done = max(e - 1, r)
    return out


class ToxicityModel:
    def __init__(self, letters: LetterModel):
        self.letters = letters
        self.lexicon: dict[str, float] = {}
        self.learned = (0, 0)  # documents of label 0 and 1
        self.mean, self.spread, self.weights = np.zeros(4), np.ones(4), np.zeros(5)

    def weight(self, word: str, spelled: bool = False) -> float:
        """The largest log odds of the keys of a written word's readings, 0 if none is in the lexicon."""
        lexicon, heads = self.lexicon, self.heads
        read = [word.lower()] if not spelled and _stands(word) else readings(word, self.letters, spelled)
        return max((lexicon.get(k, 0.0) for w in read if w[:_HEAD] in heads for k in features(w)), default=0.0)

    @cached_property
    def heads(self) -> set[str]:
        """How the lexicon's keys begin; for scoring, when the lexicon is whole."""
        return {k[:_HEAD] for k in self.lexicon}

    def joiner(self) -> Joiner:
        return Joiner([k for k in self.lexicon if not k.endswith("-")], self.letters)

    def spelled_weight(self, word: str) -> float:
        return self.weight(word, spelled=True)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.spread @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def hit_features(words: int, weights: np.ndarray, counts: np.ndarray) -> tuple[float, float, float, float]:
    hit = weights > 0
    n = int(counts[hit].sum())
    return (
        math.log1p(float((weights[hit] * counts[hit]).sum())),
        float(weights.max()) if hit.any() else 0.0,
        math.log1p(int(hit.sum())),
        math.sqrt(n / words) if words else 0.0,
    )


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ToxicityModel = model.value
        joiner = m.joiner()
        for b in batches:
            for part in slices(b, b.num_columns - 1, most=6 << 20):
                x = np.array([hit_features(n, np.array(w, float), c) for n, w, c in documents_words(part.column(part.num_columns - 1), m.weight, m.spelled_weight, joiner)]).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(m.score(x))], names=[f"c{i}" for i in range(part.num_columns)])

    return run


def _sample_words(letters):
    """(id, label, words, restored words, counts) of labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = letters.value
        for b in batches:
            for part in slices(b, 2):
                n, words, counts = [], [], []
                for k, w, c in documents_words(part.column(2), lambda x: restore(x, m)):
                    n.append(k)
                    words.append(w)
                    counts.append(c.tolist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
                    names=["id", "label", "n", "words", "counts"],
                )

    return run


def _plain_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, n): the words of labelled texts that need no restoring, and how many of a batch's texts hold them."""
    for b in batches:
        for part in slices(b, 2):
            n: Counter = Counter()
            for _, words, _ in documents_words(part.column(2), str.lower):
                n.update(words)
            plain = [w for w in n if _PLAIN.match(w) and not _RUN.search(w)]
            yield pa.RecordBatch.from_arrays([pa.array(plain, pa.string()), pa.array([n[w] for w in plain], pa.int64())], names=["w", "n"])


def _coded(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of a batch's lists, each entry as the place of its word among them, and where each list ends and the next one begins."""
    coded = pc.list_flatten(column).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())])


def _key_counts(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """(key, p, q): the keys of restored words, and how many of a batch's texts of label 1 and 0 hold them; about ``most`` words are told apart at once."""
    for b in batches:
        words, codes, bounds = _coded(b.column(3))
        place: dict[str, int] = {}
        listed = [[place.setdefault(k, len(place)) for k in features(w)] for w in words]
        each = np.array([len(x) for x in listed], np.int64)
        first, flat = np.cumsum(each) - each, np.array([k for x in listed for k in x], np.int64)
        label, n, held = b.column(1).to_numpy(), len(place), np.zeros((2, len(place)), np.int64)
        part = bounds[:-1] // most
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(label)).tolist()
        for d, e in zip(cuts[:-1], cuts[1:], strict=True):
            mine = codes[bounds[d] : bounds[e]]
            doc, times = np.repeat(np.arange(d, e), np.diff(bounds[d : e + 1])), each[mine]
            at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - first[mine], times)
            once = np.unique(np.repeat(doc, times) * n + flat[at])  # a text holds a key once
            for k in (0, 1):
                held[k] += np.bincount(once[label[once // max(n, 1)] == k] % max(n, 1), minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(list(place), pa.string()), pa.array(held[1]), pa.array(held[0])], names=["key", "p", "q"])


def train(docs: DataFrame, labels: DataFrame, *, label_column: str = "toxic", id_column: str = "doc_id", text_column: str = "text", lexicon_size: int = 20_000) -> ToxicityModel:
    """Letter model, lexicon and calibration from all labelled documents."""
    marked = labels.where(F.col(label_column).isin(0, 1)).select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    with scratch(docs.sparkSession):  # the texts go when their words are restored
        model, restored = _restored(all_labelled_texts(docs, marked, id_column, text_column))
    sc = docs.sparkSession.sparkContext
    left_out = _list(model, restored, lexicon_size)
    x = materialize(restored.mapInArrow(_left_out_features(sc.broadcast(left_out)), "y double, x0 double, x1 double, x2 double, x3 double"), "toxic-features")
    model.mean, model.spread, model.weights = logistic.fit_rows(x)
    return model


def _restored(rows: DataFrame) -> tuple[ToxicityModel, DataFrame]:
    """The letter model of rows(id, label, text), and (id, label, n, words, counts) of their restored words, which outlives the scratch around it."""
    sc = rows.sparkSession.sparkContext
    schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("n", T.LongType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    # the letter model learns from what needs no restoring
    seen = rows.mapInArrow(_plain_words, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    padded = F.concat(F.lit("  "), F.col("w"), F.lit(" "))
    triples = seen.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substring(padded, i, F.lit(3)))).alias("t"))
    trigrams = {r.t: r.n for r in triples.groupBy("t").agg(F.sum("n").alias("n")).collect()}  # of plain letters
    model = ToxicityModel(LetterModel(Counter(), trigrams=trigrams))
    return model, materialize(rows.mapInArrow(_sample_words(sc.broadcast(model.letters)), schema), "restored-words", outlives=True)


def odds(p: np.ndarray, q: np.ndarray, totals: tuple[int, int], keys: int) -> np.ndarray:
    """Log odds that a toxic rather than another document holds each of ``keys`` keys, which ``p`` and ``q`` of the ``totals`` (others, toxic) hold.

    0 where chance could do as well: where more than _BY_CHANCE of all tested keys are
    expected to have as large a share of toxic documents by chance.
    """
    p, q = np.maximum(p, 0).astype(float), np.maximum(q, 0).astype(float)
    lgamma = np.frompyfunc(math.lgamma, 1, 1)
    chance = (lgamma(p + q + 1) - lgamma(p + 1) - lgamma(q + 1)).astype(float) + p * math.log((totals[1] + 1) / (sum(totals) + 2))
    v = np.log((p + 0.3) / (totals[1] + 1)) - np.log((q + 0.7) / (totals[0] + 1))
    return np.where((p >= 2) & (chance <= -math.log((1 + keys) / _BY_CHANCE)) & (v >= _FLOOR), v, 0.0)


def _list(model: ToxicityModel, restored: DataFrame, size: int) -> dict[str, tuple[float, float]]:
    """Set a model's lexicon from (label, words) of all labelled documents; returns each entry's weight as a document of label 0 or 1 sees it that is left out itself."""
    counted = {r.label: r["count"] for r in restored.groupBy("label").count().collect()}
    totals = model.learned = (counted.get(0, 0), counted.get(1, 0))
    held = restored.mapInArrow(_key_counts, "key string, p long, q long").groupBy("key").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    held = materialize(held, "toxic-keys")
    keys = held.count()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, q = b.column(1).to_numpy(), b.column(2).to_numpy()
            w = odds(p, q, totals, keys)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w), pa.array(w * np.log1p(p))], names=["key", "p", "q", "w", "rank"])

    able = held.where("p >= 2").mapInArrow(weigh, "key string, p long, q long, w double, rank double").where("w <> 0").orderBy(F.desc("rank"), "key").limit(size).collect()
    model.lexicon = {r.key: r.w for r in able}
    p, q = np.array([r.p for r in able], float), np.array([r.q for r in able], float)
    others, toxic = odds(p, q - 1, totals, keys), odds(p - 1, q, totals, keys)
    return {r.key: (float(a), float(b)) for r, a, b in zip(able, others, toxic, strict=True)}


def _left_out_features(lexicon):
    """(label, hit features) of labelled documents, whose own count is left out of their words' weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        for b in batches:
            words, codes, bounds = _coded(b.column(3))
            seen = np.zeros((2, len(words)))  # each distinct word is looked up once
            for i, w in enumerate(words):
                found = [known[k] for k in features(w) if k in known]
                if found:
                    seen[:, i] = [max(x) for x in zip(*found, strict=True)]
            counts = pc.list_flatten(b.column(4)).to_numpy()
            out = []
            for i, (label, n) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                own = slice(bounds[i], bounds[i + 1])
                out.append((float(label), *hit_features(n, seen[label][codes[own]], counts[own])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.float64()) for v in zip(*out, strict=True)], names=["y", "x0", "x1", "x2", "x3"])

    return run


def score(docs: DataFrame, model: ToxicityModel, *, text_column: str = "text", keep: list[str | Column], score_column: str = "score") -> DataFrame:
    """The ``keep`` columns and the probability of label 1, for every row; ``score_column`` gets underscores at its end where it is kept already."""
    rows = with_text(docs, keep, text_column)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(unused(score_column, docs.select(*keep)), T.DoubleType())])
    by_place = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), by_place).toDF(*schema.names)
