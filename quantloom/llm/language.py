"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads the bytes of a text, blanks and all, in both directions, labels
every byte position with a language or with NONE, and a document pools the
log-probabilities of all its positions. So that many positions advance together, a
text is read in windows of WINDOW positions; the states run in over CONTEXT bytes
before and after each window, so words, characters and window borders cut nothing.
NONE stands for text of no known language: it learns from windows with their
letters in disorder, runs of printable characters, code-like runs and words of
random alphabets, all made from the training windows by fixed draws.

Training is backpropagation through time with Adam, on a bounded sample of
labelled documents: at most SAMPLE_DOCS a language, the least hashes of their ids,
and of each at most SAMPLE_WINDOWS stretches of STRETCH bytes from places drawn
over its whole text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, by_chunk, chunks, tidily, utf8

HIDDEN, STEPS, BATCH = 8, 300, 192
SAMPLE_DOCS, SAMPLE_WINDOWS, STRETCH = 300, 24, 64
WINDOW, CONTEXT, ROWS = 512, 24, 1024  # positions, bytes on either side, windows that advance together
CHUNK = 1 << 20  # text bytes of one pass
NONE = "none"
ODDS = 20.0  # a text is rejected where NONE is more than so many times as likely as the best language
LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gru(x: np.ndarray, u: np.ndarray, keep: bool = False):
    """States after every step. x: (steps, batch, 3 * hidden) inputs already projected; gates in the order update, reset, new."""
    n = u.shape[0]
    h = np.zeros((x.shape[1], n), x.dtype)
    out, saved = np.empty((x.shape[0], x.shape[1], n), x.dtype), []
    for t in range(x.shape[0]):
        a = h @ u
        gates = _sigmoid(x[t, :, : 2 * n] + a[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(x[t, :, 2 * n :] + r * a[:, 2 * n :])
        if keep:
            saved.append((h, z, r, new, a[:, 2 * n :]))
        h = new + z * (h - new)
        out[t] = h
    return (out, saved) if keep else out


def gru_back(d_out: np.ndarray, saved: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by the inputs and by ``u``, through time."""
    n = u.shape[0]
    d_x, d_u, d_h = np.empty((len(saved), d_out.shape[1], 3 * n), u.dtype), np.zeros_like(u), np.zeros_like(d_out[0])
    for t in range(len(saved) - 1, -1, -1):
        h, z, r, new, a = saved[t]
        d_h = d_h + d_out[t]
        d_new = d_h * (1 - z) * (1 - new * new)
        d_z = d_h * (h - new) * z * (1 - z)
        d_r = d_new * a * r * (1 - r)
        d_x[t] = np.concatenate([d_z, d_r, d_new], 1)
        d_a = np.concatenate([d_z, d_r, d_new * r], 1)
        d_u += h.T @ d_a
        d_h = d_h * z + d_a @ u.T
    return d_x, d_u


def _by_byte(out: np.ndarray, s: np.ndarray, dx: np.ndarray) -> None:
    """Sums the gradients of equal bytes."""
    where = s.ravel()
    for c in range(out.shape[1]):
        out[:, c] = np.bincount(where, dx[:, :, c].ravel(), len(out))


class Network:
    """Weights ``w``: projected inputs by byte and recurrences for both directions, output matrix and bias; outputs are the labels and NONE."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        n, k = HIDDEN, len(labels) + 1
        make = lambda *s, by=1.0: (rng.standard_normal(s) * by).astype(np.float32)
        self.labels = labels
        self.w = [make(256, 3 * n, by=0.3), make(n, 3 * n, by=n**-0.5), make(256, 3 * n, by=0.3), make(n, 3 * n, by=n**-0.5), make(2 * n, k, by=0.2), np.zeros(k, np.float32)]

    def positions(self, words: np.ndarray) -> np.ndarray:
        """Log-probabilities (steps, words, labels) for words of one length, one per row of bytes."""
        forth, u, back, v, out, bias = self.w
        s = words.T
        both = np.concatenate([gru(forth[s], u), gru(back[s[::-1]], v)[::-1]], 2)
        y = both @ out + bias
        y -= y.max(2, keepdims=True)
        return y - np.log(np.exp(y).sum(2, keepdims=True))

    def gradients(self, words: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        forth, u, back, v, out, bias = self.w
        s = words.T
        hf, sf = gru(forth[s], u, True)
        hb, sb = gru(back[s[::-1]], v, True)
        both = np.concatenate([hf, hb[::-1]], 2)
        y = both @ out + bias
        y -= y.max(2, keepdims=True)
        p = np.exp(y)
        p /= p.sum(2, keepdims=True)
        size = p.shape[0] * p.shape[1]
        rows = np.arange(len(target))
        loss = -float(np.log(p[:, rows, target] + 1e-12).mean())
        p[:, rows, target] -= 1
        p /= size
        d_both = p @ out.T
        n = HIDDEN
        d_forth, d_back = np.zeros_like(forth), np.zeros_like(back)
        dx, du = gru_back(d_both[:, :, :n], sf, u)
        _by_byte(d_forth, s, dx)
        dx, dv = gru_back(d_both[::-1, :, n:], sb, v)
        _by_byte(d_back, s[::-1], dx)
        return loss, [d_forth, du, d_back, dv, both.reshape(-1, 2 * n).T @ p.reshape(-1, p.shape[2]), p.sum((0, 1))]

    def fit(self, words: list[bytes], target: np.ndarray, weight: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Minibatches hold words of one length, drawn by weight."""
        rng = np.random.default_rng(seed)
        length = np.array([len(w) for w in words])
        groups = []
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            groups.append((np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(-1, n), target[at], np.cumsum(weight[at])))
        mass = np.cumsum([g[2][-1] * g[0].shape[1] for g in groups])
        mean, square = [np.zeros_like(x) for x in self.w], [np.zeros_like(x) for x in self.w]
        for step in range(1, steps + 1):
            bytes_of, label, total = groups[int(np.searchsorted(mass, rng.random() * mass[-1]))]
            at = np.minimum(np.searchsorted(total, rng.random(BATCH) * total[-1]), len(total) - 1)
            _, g = self.gradients(bytes_of[at], label[at])
            rate = 0.02 * min(1, step / 20) * (1 - 0.9 * step / steps)
            for w, d, m, s in zip(self.w, g, mean, square, strict=True):
                m += 0.1 * (d - m)
                s += 0.01 * (d * d - s)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


class Scorer:
    """Sums of the positions' log-probabilities by document."""

    def __init__(self, net: Network):
        n = HIDDEN
        forth, u, back, v, out, bias = net.w
        half = np.ones(3 * n, np.float32)
        half[: 2 * n] = 0.5  # a sigmoid is a tanh of half its argument
        self.sides = [(np.ascontiguousarray((table * half).T), np.ascontiguousarray((x * half).T)) for table, x in ((forth, u), (back, v))]
        self.out, self.bias = np.ascontiguousarray(out.T), bias[:, None]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(documents, labels and NONE)."""
        size = np.diff(offsets)
        count = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(size)), count)
        first = offsets[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
        last = np.minimum(first + WINDOW, offsets[doc + 1])
        begin, end = np.maximum(first - CONTEXT, offsets[doc]), np.minimum(last + CONTEXT, offsets[doc + 1])
        order = np.argsort(begin - end, kind="stable")  # longest first, so those still running are the first ones
        sums = np.zeros((len(size), len(self.bias)))
        for lo in range(0, len(order), ROWS):
            at = order[lo : lo + ROWS]
            got = self._windows(data, begin[at], end[at] - begin[at], first[at] - begin[at], last[at] - begin[at])
            for k in range(len(self.bias)):
                sums[:, k] += np.bincount(doc[at], got[k], len(size))
        return sums

    def _windows(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        n, steps, rows = HIDDEN, int(length[0]), len(begin)
        running = np.searchsorted(-length, -np.arange(steps), "left")  # rows longer than t
        forth = np.empty((steps, n, rows), np.float32)
        state = np.zeros((n, rows), np.float32)
        for t in range(steps):
            m = running[t]
            _step(self.sides[0], state[:, :m], data[begin[:m] + t])
            forth[t, :, :m] = state[:, :m]
        state[:] = 0
        sums = np.zeros((len(self.bias), rows))
        left, right = np.ascontiguousarray(self.out[:, :n]), np.ascontiguousarray(self.out[:, n:])
        for t in range(steps - 1, -1, -1):
            m = running[t]
            _step(self.sides[1], state[:, :m], data[begin[:m] + t])
            y = left @ forth[t, :, :m] + right @ state[:, :m] + self.bias
            y -= y.max(0)
            y -= np.log(np.exp(y).sum(0))
            sums[:, :m] += y * ((first[:m] <= t) & (t < last[:m]))
        return sums


def _step(side: tuple[np.ndarray, np.ndarray], state: np.ndarray, byte: np.ndarray) -> None:
    """One step of a direction for all rows at once, in place; gates as in :func:`gru`."""
    n = len(state)
    x = np.take(side[0], byte, axis=1)
    a = side[1] @ state
    gates = x[: 2 * n]
    gates += a[: 2 * n]
    np.tanh(gates, out=gates)
    gates *= np.float32(0.5)
    gates += np.float32(0.5)
    new = a[2 * n :]
    new *= gates[n:]
    new += x[2 * n :]
    np.tanh(new, out=new)
    state -= new
    state *= gates[:n]
    state += new


def fold(key) -> int:
    return zlib.crc32(str(key).encode()) % 4


def _stretches(batches):
    """(lang, n, key, text) to (lang, n, windows: one after the other, size): places drawn over the whole text, by the key."""
    for b in batches:
        data, off = utf8(b.column(3))
        cut, size = [], []
        for i, key in enumerate(b.column(2).to_pylist()):
            n = int(off[i + 1] - off[i])
            wide = min(n, STRETCH)
            room = n - wide + 1
            drawn = np.random.default_rng(zlib.crc32(key.encode())).integers(0, room, SAMPLE_WINDOWS) if room > SAMPLE_WINDOWS else np.arange(room)
            cut.append(b"".join(data[off[i] + s : off[i] + s + wide].tobytes() for s in drawn) if wide else b"")
            size.append(wide)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cut, pa.binary()), pa.array(size, pa.int32())], names=["lang", "n", "cut", "size"])


def nonsense(windows: list[bytes], seed: int = 5) -> list[bytes]:
    """Text of no language, a window for each of ``windows`` and of its length: letters in disorder, printable characters, code-like runs, words of random alphabets."""
    rng = np.random.default_rng(seed)
    code = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", np.uint8)
    out = []
    for k, w in enumerate(windows):
        s = np.frombuffer(w, np.uint8).copy()
        if k % 4 == 0:
            solid = np.flatnonzero(s != 32)
            s[solid] = s[rng.permutation(solid)]
        elif k % 4 == 1:
            s[:] = rng.integers(32, 127, len(s))
        elif k % 4 == 2:
            s[:] = code[rng.integers(0, (16, 36, 62, len(code))[int(rng.integers(4))], len(s))]
        else:
            points = int(rng.integers(0x180, 0xD700)) + rng.integers(0, 48, len(s))
            points[rng.random(len(s)) < 0.15] = 32
            s = np.frombuffer("".join(map(chr, points)).encode()[: len(s)], np.uint8)
        out.append(s.tobytes())
    return out


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """Fit on documents with a language and a text whose crc32(key as text) mod 4 is not 2; None where there is none."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(lang).alias("lang"), F.col(key).cast("string").alias("k"), F.col(text).alias("text"))
    rows = rows.filter(F.crc32(F.encode("k", "UTF-8")) % 4 != 2)
    counts = {r[0]: r["count"] for r in rows.groupBy("lang").count().collect()}  # languages: few
    if not counts:
        return None
    # about four times the sample by hash, from columns without text; then exactly the least hashes
    share = F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 4 * SAMPLE_DOCS / n))))
    draw = F.pmod(F.xxhash64("k"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    near = rows.withColumn("h", draw).filter(F.col("h") <= F.element_at(share, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("h", "k", F.xxhash64("text"))
    sample = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE_DOCS).select("lang", "n", "k", "text")
    cut = sample.mapInArrow(_stretches, "lang string, n int, cut binary, size int")
    labels = sorted(counts)
    windows, target = [], []
    for r in sorted(cut.collect(), key=lambda r: (r[0], r[1])):  # SAMPLE_DOCS * SAMPLE_WINDOWS * STRETCH bytes a language at most
        for at in range(0, len(r[2]), max(r[3], 1)):
            windows.append(bytes(r[2][at : at + r[3]]))
            target.append(labels.index(r[0]))
    net = Network(labels)
    if windows:
        other = nonsense(windows)
        target = np.array([*target, *[len(labels)] * len(other)])
        windows = windows + other
        weight = np.ones(len(windows))
        for c in range(len(labels) + 1):  # each language weighs the same, and so does NONE
            weight[target == c] /= max((target == c).sum(), 1)
        net.fit(windows, target, weight)
    return net


def _predictions(net: Network | None, key: str):
    """An Arrow worker that gives (key, held_out, lang_pred, score, recognised)."""

    def run(batches):
        scorer = Scorer(net) if net else None

        def work(rows, data, offsets):
            n = rows.num_rows
            names, score, known = ["und"] * n, np.zeros(n), np.zeros(n, bool)
            if scorer:
                mean = scorer(data, offsets) / np.maximum(np.diff(offsets), 1)[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = mean[:, :-1].argmax(1)
                plain = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])[offsets]
                for i in range(n):
                    if plain[i + 1] > plain[i] or LETTER.search(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace").replace("\ufffd", " ")):
                        names[i], score[i], known[i] = net.labels[best[i]], p[i, best[i]], ODDS * p[i, best[i]] >= p[i, -1]
            keys = rows.column(0)
            held = [k is not None and fold(k) == 2 for k in keys.to_pylist()]
            return pa.RecordBatch.from_arrays([keys, pa.array(held), pa.array(names), pa.array(score), pa.array(known)], names=[key, "held_out", "lang_pred", "score", "recognised"])

        yield from by_chunk(batches, "text", work, CHUNK)

    return run


def keep_recognised(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a letter and is recognised: NONE at most ODDS times as likely as the best language. No shuffle, no join.

    A null or empty text goes; repeated rows are judged alike; where nothing could
    be learned (``net`` None) no row is recognised.
    """

    def run(batches):
        predict = _predictions(net, "key")
        for whole in batches:
            _, off = utf8(whole.column(whole.schema.get_field_index(text)))
            for i, j in chunks(off, CHUNK):  # what is held at a time is a piece, not the batch
                b = whole.slice(i, j - i)
                view = pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in (key, text)], names=["key", "text"])
                known = [x for p in predict([view]) for x in p.column(4).to_pylist()]
                yield b.filter(pa.array(known, pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(tidily(run), docs.schema)


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", net: Network | None = None) -> DataFrame:
    """key, held_out, lang_pred, score, recognised of every row; trains on ``docs`` unless ``net`` is given.

    ``score`` is the pooled probability of ``lang_pred`` among all languages and
    NONE; ``recognised`` tells that NONE is at most ODDS times as likely. A null text, or one
    without a letter, is ``und`` with score 0 and not recognised, and so is every
    text where nothing can be learned (no labelled rows, an empty table). A null
    key counts as not held out. Repeated rows give a row each; other columns are
    not read. No shuffle of texts.
    """
    net = net or train(docs, key, text, lang)
    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(tidily(_predictions(net, key)), f"{key} {kind}, held_out boolean, lang_pred string, score double, recognised boolean")
