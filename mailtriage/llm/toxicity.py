"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Text is folded before it is matched: lower case, look-alike letters of other scripts and digits or signs that stand
for letters become plain letters, and letters that are spelled out one by one are joined. A token is folded once in
a while and remembered; only texts with a token that matches, or with a spelled-out word, are folded as a whole. Lexicon entries are starts
of words with a weight, the logarithm of how much likelier a toxic document holds them. Exception phrases, a word
and its neighbour in which the entry is harmless, take their match back. The sum of the weights, as it is and for a
hundred words, goes through a fitted logistic curve.

Entries, weights, phrases and the curve are learned from labelled rows whose fold allows it, at most about
``sample_labels`` of them, chosen by a hash of the id; the labels are joined by id only, and only the text is an
input, each text once. Evidence is counted in votes: a text has one for each start of a word it holds, which is the pair
of words around the first place of it there, and equal votes count once. So near copies of a text add no more votes than
they have different words beside an entry, and take none away. Starts of words are kept that have at least
``LEAST_VOTES`` of toxic texts and few of others; an entry that adds nothing to a shorter one is dropped, and at most
``most_entries`` stay. Texts are counted, and weighed for the curve, by the least hash of three words in a row that they
hold, which most near copies share; of some hash functions the one is taken that leaves fewest texts. Phrases have one vote for each pair of words around an entry.

Every row gives one row, repeated rows alike. A null text is empty; an empty text gets the curve's value for no
match. Of several labels of one id the highest counts; null labels and ids do not. Without toxic training rows the
lexicon is empty and all scores are the curve's base. An empty table gives an empty result. Extra columns are not
read.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailtriage.llm.tables import fold_column, texts, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_LABELS = 30_000
MOST_ENTRIES = 4_000
MOST_CANDIDATES = 100_000
THRESHOLD = 0.7
SHORTEST, LONGEST = 4, 12
LEAST_WEIGHT = 3.0
LEAST_VOTES = 3
SKETCHES = 8
#: Letters that look like a Latin one, and digits and signs that stand for one.
LOOK_ALIKES = {
    "а": "a", "α": "a", "ɑ": "a", "@": "a", "4": "a", "в": "b", "ß": "ß", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e",
    "ё": "e", "3": "e", "є": "e", "ɡ": "g", "һ": "h", "і": "i", "ι": "i", "ı": "i", "1": "i", "ј": "j", "κ": "k", "к": "k",
    "ӏ": "l", "м": "m", "п": "n", "η": "n", "о": "o", "ο": "o", "0": "o", "р": "p", "ρ": "p", "ԛ": "q", "г": "r", "ѕ": "s",
    "$": "s", "5": "s", "т": "t", "τ": "t", "7": "t", "υ": "u", "ս": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "х": "x", "χ": "x",
    "у": "y", "ү": "y", "γ": "y", "ᴢ": "z",
}
_FOLD = str.maketrans(LOOK_ALIKES)
_WIDE = {i: i - 0xFEE0 for i in range(0xFF01, 0xFF5F)} | {0x200B: None, 0x200C: None, 0x200D: None, 0xAD: None}
_DOTTED = re.compile(r"(?<![^\W_])[^\W\d_](?:[.\-_*][^\W\d_]){3,}(?![^\W_])")
_SPACED = re.compile(r"(?<!\S)[^\W\d_](?: [^\W\d_]){3,}(?!\S)")
_SPELLED_LEAST = 4
_REMEMBERED = 200_000  # tokens
_REMEMBERED_STARTS = 20_000  # tokens, each with a set of strings
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case with look-alikes, wide forms and spelled-out words replaced."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_WIDE)
    text = text.translate(_FOLD)
    text = _DOTTED.sub(lambda m: re.sub(r"[.\-_*]", "", m[0]), text)
    return _SPACED.sub(lambda m: m[0].replace(" ", ""), text)


def spelled(tokens: Sequence[str]) -> bool:
    """Whether a word may be spelled out over several tokens; else folding a text is folding its tokens."""
    short = np.fromiter(map(len, tokens), np.int64, len(tokens)) == 1
    run = short[: len(short) - _SPELLED_LEAST + 1]
    for i in range(1, _SPELLED_LEAST):
        run = run & short[i : len(short) - _SPELLED_LEAST + 1 + i]
    return bool(run.any())


class PerToken(dict):
    """A function of a token, remembered; forgotten all at once when there is too much."""

    def __init__(self, work: Callable[[str], object], most: int = _REMEMBERED):
        super().__init__()
        self.work, self.most = work, most

    def __missing__(self, token: str) -> object:
        if len(self) >= self.most:
            self.clear()
        value = self[token] = self.work(token)
        return value


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    phrases: dict[str, list[str]] = field(default_factory=dict)  # entry -> words beside it that make it harmless
    curve: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0)


class Matcher:
    def __init__(self, weights: Mapping[str, float], phrases: Mapping[str, Sequence[str]]):
        self.weights, self.phrases = weights, {k: set(v) for k, v in phrases.items()}
        self.automaton = ahocorasick.Automaton()
        for entry in weights:
            self.automaton.add_word(entry, entry)
        if weights:
            self.automaton.make_automaton()
        self.hit = PerToken(lambda token: any(True for _ in self.matches(fold(token))))

    def may_match(self, tokens: Sequence[str]) -> bool:
        """Whether a text of these tokens can have a match: most have none, and are folded no further."""
        return any(map(self.hit.__getitem__, tokens)) or spelled(tokens)

    def matches(self, folded: str) -> Iterator[tuple[str, int, int]]:
        """The longest entry at the start of each word: entry, start, end."""
        if not self.weights:
            return
        longest: dict[int, str] = {}
        for last, entry in self.automaton.iter(folded):
            start = last - len(entry) + 1
            if not start or not folded[start - 1].isalnum():
                longest[start] = entry  # those that end later are longer
        for start, entry in longest.items():
            yield entry, start, start + len(entry)

    def beside(self, folded: str, start: int) -> tuple[str, str]:
        """The words before and after the word that starts here, marked by their side."""
        word = _WORD.match(folded, start)
        end = word.end() if word else start
        after = _WORD.search(folded, end, end + 64)
        before = _WORD.findall(folded, max(0, start - 64), start)
        return "<" + (before[-1] if before else ""), ">" + (after[0] if after else "")

    def sums(self, text: str) -> tuple[float, int]:
        """Weights of the matches that no exception takes back, and the number of words."""
        tokens, total = text.split(), 0.0
        if not self.may_match(tokens):
            return total, len(tokens)
        folded = fold(text)
        for entry, start, _ in self.matches(folded):
            harmless = self.phrases.get(entry)
            if not harmless or harmless.isdisjoint(self.beside(folded, start)):
                total += self.weights[entry]
        return total, len(tokens)


def signals(totals: Sequence[tuple[float, int]]) -> np.ndarray:
    """Rows of: 1, whether anything matched, the sum, the sum for a hundred words (both as logarithms)."""
    total = np.array([t for t, _ in totals], float)
    words = np.array([w for _, w in totals], float)
    return np.stack(
        [np.ones(len(total)), total > 0, np.log1p(total), np.log1p(100 * total / np.maximum(words, 10))], axis=1
    ).astype(float)


def scores(curve: Sequence[float], rows: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(rows @ np.array(curve), -30, 30)))


def fit_curve(rows: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method, with a small penalty and no negative weight on a signal."""
    free = list(range(rows.shape[1]))
    while True:
        x, w = rows[:, free], np.zeros(len(free))
        penalty = np.diag([1e-3 if i == 0 else 0.1 for i in free])
        for _ in range(50):
            p = scores(w, x)
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (labels - p) - penalty @ w)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        bad = [i for i, v in zip(free, w, strict=True) if i and v < 0]
        if not bad:
            return tuple(float(w[free.index(i)]) if i in free else 0.0 for i in range(rows.shape[1]))
        free = [i for i in free if i not in bad]


def _starts(text: str) -> frozenset[str]:
    """Words and starts of words of the folded text, each once."""
    words = {w[:LONGEST] for w in _WORD.findall(fold(text))}
    return frozenset(w[:n] for w in words for n in range(SHORTEST, len(w) + 1))


def _count(docs: DataFrame) -> DataFrame:
    """``term, n``: the documents that hold each start of a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["term", "n"]
            )

        found: Counter = Counter()
        of_token = PerToken(_starts, _REMEMBERED_STARTS)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                tokens = text.split()
                if spelled(tokens):
                    found.update(_starts(text))
                else:
                    found.update(frozenset().union(*map(of_token.__getitem__, set(tokens))))
            if len(found) > 300_000:
                yield rows(found)
                found = Counter()
        yield rows(found)

    return docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Words:
    """Words of folded texts as small numbers, with their hashes and the numbers of the wanted starts they have."""

    def __init__(self, wanted: Mapping[str, int]):
        self.wanted = wanted
        self.number: dict[str, int] = {}
        self.hashes: list[int] = []
        self.starts: list[list[int]] = []
        self.of_token = PerToken(lambda token: self.numbered(fold(token)))

    def numbered(self, folded: str) -> list[int]:
        found = []
        for word in _WORD.findall(folded):
            if word not in self.number:
                self.number[word] = len(self.hashes)
                self.hashes.append(xxhash.xxh3_64_intdigest(word))
                own = (word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1))
                self.starts.append([self.wanted[t] for t in own if t in self.wanted])
            found.append(self.number[word])
        return found

    def of_text(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of the words, their hashes, and the hash of the two words around each."""
        tokens = text.split()
        own = self.numbered(fold(text)) if spelled(tokens) else chain.from_iterable(map(self.of_token.__getitem__, tokens))
        numbers = np.fromiter(own, np.int64)
        hashes = np.fromiter((self.hashes[n] for n in numbers.tolist()), np.uint64, len(numbers))
        edge = np.zeros(1, np.uint64)
        before, after = np.concatenate([edge, hashes[:-1]]), np.concatenate([hashes[1:], edge])
        return numbers, hashes, _mixed(_mixed(before[: len(hashes)]) + after[: len(hashes)] * np.uint64(0x9E3779B97F4A7C15))

    def votes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The wanted starts, each once, and the hash of the words around their first place."""
        numbers, _, around = self.of_text(text)
        first = np.sort(np.unique(numbers, return_index=True)[1])
        starts = [self.starts[n] for n in numbers[first].tolist()]
        many = np.fromiter(map(len, starts), np.int64, len(starts))
        terms, at = np.unique(np.fromiter(chain.from_iterable(starts), np.int64, many.sum()), return_index=True)
        return terms, np.repeat(around[first], many)[at]

    def sketches(self, text: str) -> list[int]:
        """The least of the hashes of three words in a row, by each of some hash functions."""
        _, hashes, around = self.of_text(text)
        if not len(hashes):
            return [0] * SKETCHES
        rows = _mixed(around + hashes)
        return [int(_mixed(rows * np.uint64(2 * i + 1)).min().astype(np.int64)) for i in range(SKETCHES)]


def _sketched(rows: DataFrame) -> DataFrame:
    """``text, toxic, sketches``"""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words({})
        for batch in batches:
            if len(words.number) > _REMEMBERED:
                words = Words({})
            sketches = pa.array([words.sketches(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, sketches], names=["text", "toxic", "sketches"])

    return rows.select("text", "toxic").mapInArrow(add, "text string, toxic int, sketches array<long>")


def _one_sketch(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """The rows with, of their sketches, the one that most texts of their kind share as ``sketch``, and the different
    ones of toxic and of other texts."""
    each = rows.select((F.col("toxic") > 0).alias("kind"), F.posexplode("sketches").alias("i", "sketch"))
    counted = each.distinct().groupBy("kind", "i").agg(F.count("*").alias("n")).collect()  # two rows for each hash function
    best = {kind: min(((r.n, r.i) for r in counted if r.kind == kind), default=(0, 0)) for kind in (True, False)}
    own = F.when(F.col("toxic") > 0, F.col("sketches")[best[True][1]]).otherwise(F.col("sketches")[best[False][1]])
    return rows.select("text", "toxic", own.alias("sketch")), best[True][0], best[False][0]


def _votes(rows: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """``term, toxic, n``: the different votes of either kind of texts, for each of the wanted starts by its place."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {t: i for i, t in enumerate(wanted)}
        words = Words(places)
        for batch in batches:
            if len(words.number) > _REMEMBERED:
                words = Words(places)
            found = [words.votes(t) for t in batch.column(0).to_pylist()]
            toxic = np.repeat(batch.column(1).to_numpy() > 0, [len(terms) for terms, _ in found])
            columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1].astype(np.int64)), pa.array(toxic)],
                names=["term", "around", "toxic"],
            )

    found = rows.select("text", "toxic").mapInArrow(gather, "term long, around long, toxic boolean")
    return found.distinct().groupBy("term", "toxic").agg(F.count("*").alias("n"))


def choose_entries(
    toxic: Mapping[str, int], other: Mapping[str, int], n_toxic: int, n_other: int, most: int = MOST_ENTRIES
) -> dict[str, float]:
    """Weights of the starts of words that are kept; ``toxic, other``: their votes."""

    def weight(term: str) -> float:
        return float(
            np.log((toxic[term] + 0.5) / (n_toxic + 1)) - np.log((other.get(term, 0) + 0.5) / (n_other + 1))
        )

    kept: dict[str, float] = {}
    for term in sorted((t for t in toxic if toxic[t] >= LEAST_VOTES), key=lambda t: (len(t), t)):
        w = weight(term)
        shorter = max((kept.get(term[:n], 0.0) for n in range(SHORTEST, len(term))), default=0.0)
        if w >= LEAST_WEIGHT and w > shorter + 1:
            kept[term] = round(w, 6)
    best = sorted(kept, key=lambda t: (-kept[t], t))[:most]
    return {t: kept[t] for t in best}


def learn(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 3,
    held_out: int = 1,
    label_col: str = "toxic",
    sample_labels: int = SAMPLE_LABELS,
    most_entries: int = MOST_ENTRIES,
) -> Model:
    """The model from the labelled rows outside the held-out fold; ``docs``: ``doc_id, text``."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(fold_column(F.col("doc_id"), folds) != held_out)
    share = min(1.0, sample_labels / max(1, known.count()))
    at = F.xxhash64("doc_id").bitwiseAND(0xFFFFFF) / F.lit(float(1 << 24))
    known = known.where(at < share).limit(2 * sample_labels)  # the bound of what is broadcast
    joined = docs.join(F.broadcast(known), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    rows, n_toxic, n_other = _one_sketch(written(_sketched(joined), "toxicity-sample"))  # each text once: copies are no evidence
    toxic_rows = rows.where("toxic > 0")
    if not n_toxic:
        return Model()
    frequent = _count(toxic_rows).where(F.col("n") >= LEAST_VOTES)  # no more votes than texts
    candidates = [r.term for r in frequent.orderBy(F.desc("n"), "term").limit(MOST_CANDIDATES).collect()]
    votes = {True: {}, False: {}}
    for r in _votes(rows, candidates).collect():  # at most two rows for each candidate
        votes[r.toxic][candidates[r.term]] = r.n
    weights = choose_entries(votes[True], votes[False], n_toxic, n_other, most_entries)
    phrases = _phrases(_neighbours(rows, weights))
    schema = "total double, words long, toxic int, sketch long"
    sums = rows.mapInArrow(_sums(Model(weights, phrases)), schema).groupBy("sketch", "toxic")
    sums = written(sums.agg(F.max(F.struct("total", "words")).alias("sum")).select("sum.*", "toxic"), "toxicity-sums")
    sample = sums.groupBy("total", "words", "toxic").agg(F.count("*").alias("n")).limit(4 * sample_labels).toArrow()
    many = np.repeat(np.arange(len(sample)), sample.column("n").to_numpy())
    pairs = list(zip(sample.column("total").to_pylist(), sample.column("words").to_pylist(), strict=True))
    x = signals(pairs)[many]
    y = (sample.column("toxic").to_numpy()[many] > 0).astype(float)
    return Model(weights, phrases, fit_curve(x, y))


def _neighbours(rows: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """``term, side, other, toxic``: in how many pairs of words around an entry a word is, in texts of either kind."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weights, {})
        for batch in batches:
            found: set[tuple] = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not matcher.may_match(text.split()):
                    continue
                folded = fold(text)
                found.update((e, *matcher.beside(folded, start), int(toxic > 0)) for e, start, _ in matcher.matches(folded))
            terms, before, after, toxics = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array(before, pa.string()), pa.array(after, pa.string()), pa.array(toxics, pa.int32())],
                names=["term", "before", "after", "toxic"],
            )

    around = rows.select("text", "toxic").mapInArrow(gather, "term string, before string, after string, toxic int").distinct()
    both = around.select("term", F.explode(F.array("before", "after")).alias("side"), "toxic").groupBy("term", "side").agg(
        F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("other"),
        F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"),
    )
    return written(both, "toxicity-neighbours")


def _phrases(beside: DataFrame, least: int = 5) -> dict[str, list[str]]:
    """Neighbours beside which an entry stands in other texts at least ``least`` times and ten times as often as in
    toxic ones."""
    harmless = beside.where((F.col("other") >= least) & (F.col("other") >= 10 * F.col("toxic")) & (F.length("side") > 1))
    phrases: dict[str, list[str]] = {}
    for r in harmless.orderBy(F.desc("other"), "term", "side").limit(MOST_ENTRIES).collect():
        phrases.setdefault(r.term, []).append(r.side)
    return phrases


def _sums(model: Model):
    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.weights, model.phrases)
        for batch in batches:
            found = [matcher.sums(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([round(t, 3) for t, _ in found], pa.float64()),
                    pa.array([w for _, w in found], pa.int64()),
                    batch.column("toxic"),
                    batch.column("sketch"),
                ],
                names=["total", "words", "toxic", "sketch"],
            )

    return sums


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.weights, model.phrases)
        for batch in batches:
            score = scores(model.curve, signals([matcher.sums(t) for t in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype("i4"))],
                names=["doc_id", "score", "predicted"],
            )

    return texts(docs, id_col, text_col).mapInArrow(judge, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are not judged toxic, with the columns they came with."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.weights, model.phrases)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            score = scores(model.curve, signals([matcher.sums(t or "") for t in batch.column(at).to_pylist()]))
            yield batch.filter(pa.array(score < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
