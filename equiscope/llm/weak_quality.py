"""Quality scores from a weak-label model.

Overlapping heuristic labellers each vote good, bad or nothing on a document.
Expectation-maximisation estimates, without labels, how often each labeller
votes what on good and on bad documents. It works on the counts of the vote
patterns of all documents (at most 3^labellers rows, a partial aggregate), so
every document counts and the driver sees patterns only. The posterior of a
pattern is the soft label on which a linear scorer over hashed features is
trained, on about ``SAMPLE`` rows chosen by a hash (the bound is a
parameter). All documents are scored, whole, in one pass.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import packed, unpacked

SAMPLE, SLOTS = 3000, 1 << 14
NEW = ["votes", "label_posterior", "score", "kept"]
#: Labellers: name, the measure from which it votes bad, the measure up to which it votes good (None: it never votes that).
LABELLERS = [
    ("marks", 0.08, None),  # characters that are neither letters, digits, white space nor plain punctuation
    ("bars", 0.10, None),  # words that are a table's bar
    ("capitals", 0.50, None),  # letters A-Z among A-Z and a-z
    ("stutter", 0.20, None),  # words equal to the word before
    ("repeats", 0.50, None),  # lines that occurred before, by length
    ("shouts", 0.30, None),  # words that end in an exclamation mark
    ("monotony", 0.60, 0.30),  # neighbouring word pairs that occurred before
    ("digits", 0.50, None),  # characters that are digits
    ("odd_words", 0.40, 0.10),  # words other than letters with one mark of plain punctuation behind
    ("unfinished", None, 0.34),  # lines of three words or more that end in no full stop, question or exclamation mark
]


#: Bytes by kind, as counted below.
SPACES, DIGITS, UPPER, LOWER = b" \t\n\r\x0b\x0c", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123))
MARKS = b"#$%&*+/<=>@\\^_`{}~\x7f" + bytes(range(9)) + bytes(range(14, 32))
PLAIN_WORD = re.compile(rb"[A-Za-z\x80-\xff'-]+[.,;:?!]?")


class PlainWords(dict):
    """Word -> whether it is letters with at most one mark of plain punctuation behind. It holds 65,536 words of up to 64 bytes, then begins anew."""

    def __missing__(self, word: bytes) -> bool:
        plain = PLAIN_WORD.fullmatch(word) is not None
        if len(word) <= 64:
            if len(self) >= 1 << 16:
                self.clear()
            self[word] = plain
        return plain


def shares(text: bytes, plain: PlainWords) -> list[float]:
    """What each labeller measures. A text without words measures 0 everywhere."""
    words = text.split()
    if not words:
        return [0.0] * len(LABELLERS)
    count = lambda kind: len(text) - len(text.translate(None, kind))
    n, size = len(words), max(1, len(text) - count(SPACES))
    upper, lower = count(UPPER), count(LOWER)
    lines = [x.strip() for x in text.split(b"\n") if x.strip()]
    total = sum(map(len, lines))
    once = sum(map(len, set(lines)))
    return [
        count(MARKS) / size,
        words.count(b"|") / n,
        upper / (upper + lower) if upper + lower >= 20 else 0.2,
        sum(map(eq, words, words[1:])) / n,
        (total - once) / total,
        sum(w.endswith(b"!") for w in words) / n,
        1 - len(set(zip(words, words[1:]))) / (n - 1) if n >= 20 else 0.4,
        count(DIGITS) / size,
        1 - sum(map(plain.__getitem__, words)) / n,
        sum(x[-1:] not in b".?!" for x in long) / len(long) if (long := [x for x in lines if x.count(b" ") >= 2]) else 1.0,
    ]


def votes(text: bytes, plain: PlainWords) -> str:
    """A letter a labeller: ``g``ood, ``b``ad or ``-``. A text without words has no vote."""
    if not text.split():
        return "-" * len(LABELLERS)
    return "".join("b" if bad is not None and s >= bad else "g" if good is not None and s <= good else "-" for s, (_, bad, good) in zip(shares(text, plain), LABELLERS))


@dataclass(frozen=True)
class LabelModel:
    prior: float  # P(good)
    on_good: list[dict[str, float]]  # P(vote | good) by labeller
    on_bad: list[dict[str, float]]

    def posterior(self, pattern: str) -> float:
        """P(good | votes)."""
        odds = math.log(self.prior / (1 - self.prior)) + sum(math.log(g[v] / b[v]) for v, g, b in zip(pattern, self.on_good, self.on_bad) if v != "-")
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))

    def accuracies(self) -> list[float]:
        """P(a vote is right | it is cast), by labeller."""
        out = []
        for g, b in zip(self.on_good, self.on_bad):
            right = self.prior * g["g"] + (1 - self.prior) * b["b"]
            out.append(right / (right + self.prior * g["b"] + (1 - self.prior) * b["g"]))
        return out


def fit_labels(counts: dict[str, int], rounds: int = 200) -> LabelModel:
    """EM over vote patterns. It starts where any vote ``b`` makes a document rather bad, which fixes which class is the good one."""
    width = len(next(iter(counts), "-" * len(LABELLERS)))
    soft = {p: 0.1 if "b" in p else 0.95 for p in counts}
    total = sum(counts.values())
    model = LabelModel(0.9, [{"g": 0.6, "b": 0.02, "-": 0.38}] * width, [{"g": 0.3, "b": 0.3, "-": 0.4}] * width)
    for _ in range(rounds if total else 0):
        good = sum(n * soft[p] for p, n in counts.items())
        share = lambda i, v, on: (sum(n * (soft[p] if on else 1 - soft[p]) for p, n in counts.items() if p[i] == v) + 1.0) / ((good if on else total - good) + 3.0)  # noqa: E731, B023
        model = LabelModel(min(0.999, max(0.001, (good + 1) / (total + 2))), [{v: share(i, v, True) for v in "gb-"} for i in range(width)],
                           [{v: share(i, v, False) for v in "gb-"} for i in range(width)])
        after = {p: model.posterior(p) for p in counts}
        moved = max(abs(after[p] - soft[p]) for p in counts)
        soft = after
        if moved < 1e-9:
            break
    return model


def features(text: bytes):
    """Slots and weights of hashed byte trigrams (letters a-z and A-Z count as one each, so form matters more than words), shrunk towards
    none for short texts, whose score is then mostly the intercept."""
    import numpy as np

    b = np.frombuffer(b"  " + text + b" ", np.uint8)
    kind = b.copy()
    kind[(b >= 97) & (b <= 122)] = 97
    kind[(b >= 65) & (b <= 90)] = 65
    kind[(b >= 48) & (b <= 57)] = 48
    kind[b >= 128] = 128
    kind = kind.astype(np.uint32)
    at = ((kind[:-3] * 131 + kind[1:-2]) * 131 + kind[2:-1]) * 131 + kind[3:]
    at = (at * np.uint32(2654435761)) >> np.uint32(18)
    if len(at) < 1024:
        slot, n = np.unique(at, return_counts=True)
    else:
        n = np.bincount(at, minlength=SLOTS)
        slot = np.flatnonzero(n)
        n = n[slot]
    weight = np.log1p(n)
    return slot.astype(np.int64), weight / float(np.sqrt((weight * weight).sum() + 100.0))


def fit_scorer(rows: list[tuple[float, list[int], list[float]]], steps: int = 300, rate: float = 20.0, decay: float = 1e-5):
    """Logistic regression on soft labels by gradient steps; returns weights (the last is the intercept)."""
    import numpy as np

    w = np.zeros(SLOTS + 1)
    if not rows:
        return w
    y = np.array([r[0] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    slot, value = np.concatenate([r[1] for r in rows]).astype(np.int64), np.concatenate([r[2] for r in rows])
    weight = np.where(y > 0.5, 0.5 / max(1e-9, (y > 0.5).sum()), 0.5 / max(1e-9, (y <= 0.5).sum()))  # both classes weigh the same
    weight /= weight.sum()
    for _ in range(steps):
        z = np.bincount(row, value * w[slot], minlength=len(rows)) + w[-1]
        error = weight * (1 / (1 + np.exp(-z)) - y)
        w[:-1] -= rate * (np.bincount(slot, value * error[row], minlength=SLOTS) + decay * w[:-1])
        w[-1] -= rate * error.sum()
    return w


def quality(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, least_score: float = 0.2, keep_columns: list[str] | None = None) -> DataFrame:
    """The input columns with ``votes``, ``label_posterior``, ``score`` and ``kept`` (score at least ``least_score``), one row per input row.

    A text without words (null, empty, white space) has no votes, score 0 and
    is not kept. Texts of any length are read whole. Repeated rows score
    alike. An empty table gives an empty result. An input column named like a
    new one gives way to it.
    """
    columns = docs.columns if keep_columns is None else keep_columns
    sc = docs.sparkSession.sparkContext

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        plain = PlainWords()
        for batch in batches:
            for t in batch.column(0):
                p = votes((t.as_py() or "").encode(), plain)
                counts[p] = counts.get(p, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["p", "n"])

    patterns = docs.select(F.col(text).cast("string")).mapInArrow(voted, "p string, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()
    counts = {r["p"]: r["n"] for r in patterns}
    model = fit_labels({p: n for p, n in counts.items() if set(p) != {"-"}})

    rate = min(1.0, sample / max(1, sum(counts.values())))
    chosen = docs.where(F.pmod(F.xxhash64(F.lit("quality"), doc_id), F.lit(1_000_000)) < int(math.ceil(rate * 1_000_000))).select(F.col(text).cast("string"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = PlainWords()
        for batch in batches:
            rows = []
            for t in batch.column(0):
                body = (t.as_py() or "").encode()
                if body.split():
                    rows.append((model.posterior(votes(body, plain)), *(x.tolist() for x in features(body))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())])], ["y", "slots", "weights"])

    taken = chosen.mapInArrow(featured, "y double, slots array<long>, weights array<double>").collect()
    weights = sc.broadcast(fit_scorer([(r["y"], r["slots"], r["weights"]) for r in sorted(taken, key=lambda r: (r["y"], r["slots"], r["weights"]))]))
    given = docs.select(packed(docs, columns).alias("_row"), F.col(text).cast("string").alias("_text"))
    schema = T.StructType([given.schema["_row"]]).add("votes", "string").add("label_posterior", "double").add("score", "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        w, plain = weights.value, PlainWords()
        for batch in batches:
            out: list[tuple[str, float, float]] = []
            for t in batch.column(1):
                body = (t.as_py() or "").encode()
                pattern = votes(body, plain)
                if not body.split():
                    out.append((pattern, 0.0, 0.0))
                    continue
                slot, value = features(body)
                out.append((pattern, model.posterior(pattern), float(1 / (1 + np.exp(-np.clip(value @ w[slot] + w[-1], -60, 60))))))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in zip(*out)]], ["_row", "votes", "label_posterior", "score"])

    new = given.mapInArrow(scored, schema)
    return new.select(*unpacked("_row", columns, NEW), "votes", F.round("label_posterior", 6).alias("label_posterior"), F.round("score", 6).alias("score"), (F.col("score") >= least_score).alias("kept"))
