"""Personal data: generators propose spans, boosted trees judge them, calibrated thresholds choose.

High-recall generators propose spans that may overlap. Four base kinds have strict forms and are always found; all
other proposals are judged by gradient-boosted trees on features of their format and context. The trees are trained
on the proposals of all documents but every fourth, by a hash of the id: proposals that a strict form accepts are the
positive examples, those that every strict form refuses the negative ones. Whether a form accepts is no feature; the
trees see lengths, digit and separator counts, neighbours and words nearby. For each generator the threshold is the
lowest score at which, on all proposals of the held-out documents, at least ``precision`` of those above it are
positive; a generator without such a score, or training proposals of a single class, add no spans. Where a tree may cut a
feature with more than 32 values is left to Spark's ML library, which places its bins by 10,000 proposals or more; all
proposals are counted in them.

A null text is empty and has no spans. Every row gives one row, repeated rows alike; a null id is carried along. An
empty table gives an empty result. Spans are in code points with the end exclusive. Extra columns are not read.
Texts of any length are read whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailtriage.llm.tables import fold_column, texts, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE_KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
SCORE_RANGES = 256
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match cannot begin inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What the method adds beside the base kinds; their matches are proposals only.
GENERATORS = (
    ("email_like", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?:\x20?[(\[](?:at|AT)[)\]]\x20?|@)[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)[A-Za-z0-9-]{1,63}){1,8}")),
    ("number", re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,24}(?![0-9A-Za-z])")),
    ("account", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
)
_NEAR = {
    "email": re.compile(r"mail|contact|write|@", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|ring", re.I),
    "card": re.compile(r"card|visa|credit|pay|account|iban", re.I),
    "net": re.compile(r"\bip\b|host|server|address|login", re.I),
}
FEATURES = (
    "is_email_like", "is_number", "is_account", "length", "digits", "letters", "upper", "dots", "dashes", "spaces",
    "brackets", "plus", "at", "groups", "longest_group", "distinct_digits", "before_space", "after_space",
    "near_email", "near_phone", "near_card", "near_net", "at_start",
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, ``@`` and dotted domain. A match can only begin where the run of local
    characters before an ``@`` begins, or where the match before ended."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        end = at + 1
        if domain and at > last:
            low = at
            while low > last and text[low - 1] in _LOCAL:
                low -= 1
            if low < at:
                found.append((low, domain.end()))
                last = end = domain.end()
        at = text.find("@", end)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strict kinds: leftmost matches, without those that fail their check; by kind, then start."""
    found = [("email", *span) for span in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(number := _digits(m[0])) <= 19 and luhn(number):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Generator number, start, end."""
    return [(n, *m.span()) for n, (_, search) in enumerate(GENERATORS) for m in search.finditer(text)]


def features(text: str, n: int, start: int, end: int) -> list[float]:
    """Format and context of a proposal."""
    own = text[start:end]
    near = text[max(0, start - 32) : start] + " " + text[end : end + 16]
    groups = re.findall(r"[0-9]+", own)
    return [
        *(float(n == i) for i in range(len(GENERATORS))),
        float(len(own)),
        float(sum(map(len, groups))),
        float(sum(c.isalpha() for c in own)),
        float(sum(c.isupper() for c in own)),
        *(float(own.count(c)) for c in ".- "),
        float(own.count("(") + own.count("[")),
        float(own.count("+")),
        float(own.count("@")),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(len(set("".join(groups)))),
        float(text[start - 1 : start].isspace()),
        float(text[end : end + 1].isspace()),
        *(float(bool(search.search(near))) for search in _NEAR.values()),
        float(start == 0),
    ]


class Trees:
    """Boosted trees as arrays; scores a matrix of features at once."""

    def __init__(self, trees: Sequence[tuple[float, list[tuple[int, float, int, int, float]]]]):
        self.trees = [(w, *(np.array(x) for x in zip(*nodes, strict=True))) for w, nodes in trees]

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for weight, feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(rows), int)
            while (inner := feature[at] >= 0).any():
                go_left = rows[every, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(go_left, left[at], right[at]), at)
            total += weight * value[at]
        return 1 / (1 + np.exp(-2 * total))


def _nodes(root: object) -> list[tuple[int, float, int, int, float]]:
    """A tree of the ML library as rows of feature (-1: leaf), threshold, children, value."""
    rows: list = []

    def walk(node: object) -> int:
        at = len(rows)
        rows.append(None)
        if node.subtreeDepth():
            split = node.split()
            rows[at] = (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()), 0.0)
        else:
            rows[at] = (-1, 0.0, at, at, node.prediction())
        return at

    walk(root)
    return rows


def lowest_scores(judged: DataFrame, precision: float) -> dict[int, float]:
    """For each generator of ``generator, label, score`` that has one, the lowest score at which ``precision`` of those not
    below it are positive. The running sums have two levels, over ranges of scores and within them."""
    equal = judged.groupBy("generator", "score").agg(F.count("*").alias("n"), F.sum("label").alias("good"))  # are chosen together
    equal = equal.withColumn("range", F.floor(F.col("score") * SCORE_RANGES))
    above = Window.partitionBy("generator").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = equal.groupBy("generator", "range").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).select(
        "generator", "range", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("n", "good"))
    )
    within = Window.partitionBy("generator", "range").orderBy(F.desc("score"))
    held = equal.select("*", F.sum("n").over(within).alias("n_here"), F.sum("good").over(within).alias("good_here"))
    share = (F.col("good_above") + F.col("good_here")) / (F.col("n_above") + F.col("n_here"))
    found = held.join(ranges, ["generator", "range"]).where(share >= precision)
    return {r.generator: r.score for r in found.groupBy("generator").agg(F.min("score").alias("score")).collect()}


def train(
    rows: DataFrame, precision: float = PRECISION, rounds: int = 12, depth: int = 3
) -> tuple[Trees | None, list[float]]:
    """The trees and each generator's threshold, from the proposals of all rows."""
    schema = "doc_id long, generator int, label double, features array<double>"

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found := proposals(text):
                    strict = {span[1:] for span in base_spans(text)}
                    for n, start, end in found:
                        for column, x in zip(
                            out, (doc_id, n, float((start, end) in strict), features(text, n, start, end)), strict=True
                        ):
                            column.append(x)
            types = (pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, types, strict=True)],
                names=["doc_id", "generator", "label", "features"],
            )

    proposed = written(rows.mapInArrow(propose, schema), "pii-proposals")
    held = fold_column(F.col("doc_id"), 4) == 0
    fit, check = proposed.where(~held), proposed.where(held)
    classes = {r.label for r in fit.select("label").distinct().collect()}
    if len(classes) < 2:
        return None, [2.0] * len(GENERATORS)
    data = fit.select("label", array_to_vector("features").alias("features"))
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, subsamplingRate=1.0).fit(data)
    trees = Trees([(w, _nodes(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array(batch.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("generator"), batch.column("label"), pa.array(trees.score(values), pa.float64())],
                names=["generator", "label", "score"],
            )

    judged = check.select("generator", "label", "features").mapInArrow(judge, "generator int, label double, score double")
    lowest = lowest_scores(judged, precision)
    return trees, [lowest.get(n, 2.0) for n in range(len(GENERATORS))]


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    precision: float = PRECISION,
) -> DataFrame:
    """``doc_id`` and ``found``, an array of ``kind, start, end, base, score``: base spans by kind and start, then
    the chosen proposals that are no base span."""
    rows = texts(docs, id_col, text_col)
    trees, thresholds = train(rows, precision)
    span = pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, asked, values = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                base = base_spans(text)
                out.append([dict(kind=k, start=s, end=e, base=True, score=1.0) for k, s, e in base])
                if trees is not None and (found := proposals(text)):
                    strict = {x[1:] for x in base}
                    for n, start, end in found:
                        if (start, end) not in strict:
                            asked.append((i, n, start, end))
                            values.append(features(text, n, start, end))
            if asked:
                for (i, n, start, end), score in zip(asked, trees.score(np.array(values)).tolist(), strict=True):
                    if score >= thresholds[n]:
                        kind = GENERATORS[n][0]
                        out[i].append(dict(kind=kind, start=start, end=end, base=False, score=score))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.list_(span))], names=["doc_id", "found"]
            )

    return rows.mapInArrow(
        find, "doc_id long, found array<struct<kind:string,start:long,end:long,base:boolean,score:double>>"
    )


def redact(text: str, spans: Sequence[tuple[int, int]], mark: str = "[PRIVATE]") -> str:
    """The text with every stretch that spans cover, overlaps merged, replaced by a mark."""
    out, last = [], 0
    for start, end in sorted(spans):
        if start >= last:
            out += [text[last:start], mark]
        last = max(last, end)
    return "".join([*out, text[last:]])


def digest(spans: Sequence[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
