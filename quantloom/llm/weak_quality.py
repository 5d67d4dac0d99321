"""Quality by weak supervision: rules vote or abstain, expectation-maximisation finds how far each is right.

Every rule votes good (1), bad (-1) or abstains (0). The model: a document is good
with probability ``prior``; a rule that votes is right with probability
``accuracy``, its own for good and for bad documents, estimated freely. Several
rules look at each kind of junk from different sides, so that one wrong accusation
is outvoted where the others speak for the text. Votes form a table of patterns,
at most 3**RULES whatever the input, so EM runs on exact counts of patterns over
all documents; the posterior of a pattern then decides its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_chunk, stored
from .words import Words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: (name, good if the value is at most, bad if it is above) on a share per word, line or byte
RULES = (
    ("symbols", 0.02, 0.10),  # characters of #*$%&|<> per word
    ("shouting", 0.20, 0.50),  # ASCII capitals per ASCII letter
    ("repeats", 0.10, 0.30),  # words in repeated 3-word windows
    ("lines", 0.10, 0.40),  # repeated lines
    ("bare", 0.08, 0.25),  # words without a letter (an ASCII letter or a byte above 127)
    ("marks", 0.10, 0.30),  # exclamation marks per word
    ("unlettered", 0.12, 0.25),  # bytes of words that are neither letters nor digits
    ("doubled", 0.02, 0.10),  # equal neighbours that are neither letters nor digits, per word
    ("endless", 30.0, 60.0),  # words per end of a sentence (a word that ends in .?!)
    ("odd", 0.12, 0.30),  # words that are not letters and digits with at most one of .,;:?! after them
)
_IS = {name: np.zeros(256, bool) for name in ("symbol", "upper", "letter", "lead", "bang", "mark", "stop", "after", "sign")}
_IS["symbol"][list(b"#*$%&|<>")] = True
_IS["upper"][65:91] = True
_IS["letter"][[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_IS["lead"][:] = True
_IS["lead"][128:192] = False
_IS["bang"][33] = True
_IS["mark"][[k for k in range(33, 127) if not chr(k).isalnum()]] = True
_IS["sign"][[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_IS["stop"][list(b".?!")] = True
_IS["after"][list(b".,;:?!")] = True
FEATURES = (*BASE, "n_lines", "n_upper", "n_letters", "n_bare", "n_bangs", "word_bytes", "n_signs", "n_doubled", "n_ends", "n_plain")


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every document in a piece of a batch."""
    w = Words(data, offsets)
    docs = len(offsets) - 1
    out = {"n_words": w.count.astype(np.int64)}
    lead = np.concatenate([[0], np.cumsum(_IS["lead"][data])])
    letter = np.concatenate([[0], np.cumsum(_IS["letter"][data])])
    out["word_chars"] = np.bincount(w.doc, lead[w.end] - lead[w.start], docs).astype(np.int64)
    out["n_bare"] = np.bincount(w.doc, letter[w.end] == letter[w.start], docs).astype(np.int64)
    out["n_symbols"] = _per_doc(_IS["symbol"][data], offsets)
    out["n_upper"], out["n_letters"], out["n_bangs"] = (_per_doc(_IS[k][data], offsets) for k in ("upper", "letter", "bang"))
    sign = np.concatenate([[0], np.cumsum(_IS["sign"][data])])
    wide, last = w.end - w.start, data[w.end - 1]
    out["n_signs"] = np.bincount(w.doc, sign[w.end] - sign[w.start], docs).astype(np.int64)
    out["word_bytes"] = np.bincount(w.doc, wide, docs).astype(np.int64)
    out["n_ends"] = np.bincount(w.doc, _IS["stop"][last], docs).astype(np.int64)
    out["n_plain"] = np.bincount(w.doc, (sign[w.end] > sign[w.start]) & (sign[w.end] - sign[w.start] >= wide - _IS["after"][last]), docs).astype(np.int64)
    twice = np.zeros(len(data), bool)
    twice[1:] = (data[1:] == data[:-1]) & _IS["mark"][data[1:]]
    twice[offsets[:-1][offsets[:-1] < len(data)]] = False
    out["n_doubled"] = _per_doc(twice, offsets)
    # lines with a word: a line is its bytes, hashed; the first of equal lines of a document counts as none
    stops = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], stops + 1]))
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data))[: len(begin)]
    end = end - (data[np.maximum(end - 1, 0)] == 10)
    row = np.searchsorted(offsets, begin, "right") - 1
    solid = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end, row = begin[solid], end[solid], row[solid]
    raw = data.tobytes()
    seen: set = set()
    again = np.zeros(len(begin), bool)
    last = -1
    for k, (a, b, r) in enumerate(zip(begin.tolist(), end.tolist(), row.tolist(), strict=True)):
        if r != last:
            seen, last = set(), r
        line = raw[a:b]
        again[k] = line in seen
        seen.add(line)
    out["n_lines"] = np.bincount(row, minlength=docs)
    out["n_dup_lines"] = np.bincount(row, again, docs).astype(np.int64)
    # words that some repeated window of three covers
    at, h = w.grams(3)
    mark = np.zeros(len(w.hash) + 3, np.int64)
    if len(at):
        key = h ^ (w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = np.zeros(len(at), bool)
        hit[by[1:][same]] = True
        hit[by[:-1][same]] = True
        for k in range(3):
            mark[at[hit] + k] = 1
    out["n_repeat_words"] = np.bincount(w.doc, mark[: len(w.hash)], docs).astype(np.int64)
    return out


def counted(docs: DataFrame, key: str, text: str) -> DataFrame:
    kind = dict(docs.dtypes)[key]

    def run(batches):
        def work(rows, data, offsets):
            f = features(data, offsets)
            return pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(f[n].astype(np.int64)) for n in FEATURES)], names=[key, *FEATURES])

        yield from by_chunk(batches, text, work)

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} long" for n in FEATURES))


def voted(features: DataFrame) -> DataFrame:
    """Adds a column per rule."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    outside = lambda a, b: F.col(b) - F.col(a)
    value = {
        "unlettered": F.coalesce(F.try_divide(outside("n_signs", "word_bytes"), F.col("word_bytes")), F.lit(0.0)),
        "doubled": share("n_doubled", "n_words"),
        "endless": F.col("n_words") / (F.col("n_ends") + 1),
        "odd": F.coalesce(F.try_divide(outside("n_plain", "n_words"), F.col("n_words")), F.lit(0.0)),
        "symbols": share("n_symbols", "n_words"), "shouting": share("n_upper", "n_letters"), "repeats": share("n_repeat_words", "n_words"), "lines": share("n_dup_lines", "n_lines"), "bare": share("n_bare", "n_words"), "marks": share("n_bangs", "n_words"),
    }
    return features.withColumns({f"vote_{n}": F.when(value[n] <= good, 1).when(value[n] > bad, -1).otherwise(0) for n, good, bad in RULES})


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray, np.ndarray]:
    """(prior, accuracy[rule, good/bad], posterior of each pattern).

    Only the start tells good from bad: 0.9 right on good documents and 0.6 on bad
    ones. Accuracies move freely from there; a beta prior worth ten votes of the
    start's rates keeps rules that hardly vote defined.
    """
    start = np.array([0.9, 0.6])
    prior, accuracy = 0.8, np.tile(start, (votes.shape[1], 1))
    good, bad = votes > 0, votes < 0
    posterior = np.full(len(votes), prior)
    for _ in range(rounds):
        a, b = np.log(accuracy), np.log(1 - accuracy)
        lift = np.log(prior / (1 - prior)) + good @ (a[:, 0] - b[:, 1]) + bad @ (b[:, 0] - a[:, 1])
        new = 1 / (1 + np.exp(-lift))
        done = np.abs(new - posterior).max(initial=0) < 1e-9
        posterior = new
        if done:
            break
        p, q = counts * posterior, counts * (1 - posterior)
        prior = float((p.sum() + 8) / (counts.sum() + 10))
        accuracy = np.stack([(p @ good + 10 * start[0]) / (p @ (good | bad) + 10), (q @ bad + 10 * start[1]) / (q @ (good | bad) + 10)], 1)
    return prior, accuracy, posterior


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """A row per document: the counts, base_failed, posterior, kept; ``kept`` needs base_failed false and a posterior of ``threshold``.

    A null or empty text has no words and fails; rows may repeat, each counts; an
    empty table gives no rows; other columns are not read; rows of a null key are
    documents too and keep it. Texts are read once: their counts are stored, from
    which patterns and then verdicts follow. A column of the key's type named like
    one of the counts is no matter, as only the key is taken along.
    """
    names = [f"vote_{n}" for n, _, _ in RULES]
    votes = voted(stored(counted(docs, key, text), "counts"))
    found = votes.groupBy(*names).count().collect()  # patterns of votes: at most 3**RULES, a few hundred in practice
    table = np.array([[r[n] for n in names] for r in found], np.int64).reshape(-1, len(names))
    _, _, posterior = expectation_maximisation(table, np.array([r["count"] for r in found], float))
    digits = [3**k for k in range(len(names))]
    rows = [(int((row + 1) @ digits), float(p)) for row, p in zip(table, posterior, strict=True)]
    verdicts = docs.sparkSession.createDataFrame(rows, "pattern int, posterior double")  # a row per pattern found, 3**RULES at most
    pattern = sum(((F.col(n) + 1) * d for n, d in zip(names, digits, strict=True)), F.lit(0)).cast("int")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = votes.withColumn("pattern", pattern).join(F.broadcast(verdicts), "pattern").withColumn("base_failed", failed)
    return out.select(key, *BASE, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"), "posterior")
