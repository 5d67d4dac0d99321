"""Language scores against a network run position by position, and verdicts of rules that are often wrong."""

import numpy as np

from quantloom.llm import language, weak_quality


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def slow_states(table, u, text):
    n = u.shape[0]
    h, out = np.zeros(n), []
    for byte in text:
        x, a = table[byte].astype(float), h @ u.astype(float)
        z, r = sigmoid(x[:n] + a[:n]), sigmoid(x[n : 2 * n] + a[n : 2 * n])
        new = np.tanh(x[2 * n :] + r * a[2 * n :])
        h = z * h + (1 - z) * new
        out.append(h)
    return out


def slow_score(net, text):
    """Sum of every position's log-probabilities, each window read alone with its run-in."""
    forth, u, back, v, w, bias = net.w
    total = np.zeros(len(bias))
    for first in range(0, len(text), language.WINDOW):
        last = min(first + language.WINDOW, len(text))
        begin, end = max(first - language.CONTEXT, 0), min(last + language.CONTEXT, len(text))
        piece = text[begin:end]
        ahead, behind = slow_states(forth, u, piece), slow_states(back, v, piece[::-1])[::-1]
        for t in range(first - begin, last - begin):
            y = np.concatenate([ahead[t], behind[t]]) @ w.astype(float) + bias
            total += y - y.max() - np.log(np.exp(y - y.max()).sum())
    return total


def test_scores_of_whole_texts(monkeypatch):
    monkeypatch.setattr(language, "WINDOW", 40)
    monkeypatch.setattr(language, "CONTEXT", 9)
    net = language.Network(["aa", "bb", "cc"])
    texts = [b"", b"x", "Grüße an alle, die hier lesen: 42 Zeilen!".encode(), b"the rain in spain stays mainly in the plain " * 4, bytes(range(1, 256)), b" " * 90]
    off = np.cumsum([0, *map(len, texts)])
    got = language.Scorer(net)(np.frombuffer(b"".join(texts), np.uint8), off)
    for t, row in zip(texts, got, strict=True):
        want = slow_score(net, t)
        assert np.allclose(row, want, rtol=2e-4, atol=2e-3)
        if t and np.sort(want)[-1] - np.sort(want)[-2] > 0.1:
            assert row.argmax() == want.argmax()


def test_two_bad_votes_may_stay_and_one_may_go(spark, monkeypatch):
    """Two rules accuse three good documents in ten at random, three others agree on junk: the former's votes weigh little, one of the latter's much."""
    rng = np.random.default_rng(4)
    plain = dict.fromkeys(weak_quality.FEATURES, 0) | {"n_words": 100, "word_chars": 500, "word_bytes": 500, "n_signs": 480, "n_letters": 480, "n_lines": 5, "n_ends": 8, "n_plain": 95}
    bad = {"marks": {"n_bangs": 60}, "shouting": {"n_upper": 400}, "symbols": {"n_symbols": 30}, "bare": {"n_bare": 40}, "doubled": {"n_doubled": 30}}
    unsure = {"symbols": {"n_symbols": 5}, "bare": {"n_bare": 15}, "doubled": {"n_doubled": 5}}

    def made(*parts):
        return plain | {k: v for p in parts for k, v in p.items()}

    rows = []
    for k in range(3000):
        junk = k % 5 == 0
        parts = [bad[r] for r in ("marks", "shouting") if rng.random() < 0.3]
        if junk:
            parts += [(bad if rng.random() < 0.85 else unsure)[r] for r in ("symbols", "bare", "doubled")]
        rows.append((k, made(*parts)))
    rows.append((9000, made(bad["marks"], bad["shouting"])))
    rows.append((9001, made(bad["symbols"], unsure["bare"], unsure["doubled"])))
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in weak_quality.FEATURES)
    frame = spark.createDataFrame([(k, *(f[n] for n in weak_quality.FEATURES)) for k, f in rows], schema)
    monkeypatch.setattr(weak_quality, "counted", lambda docs, key, text: docs)
    got = {r.doc_id: r for r in weak_quality.quality(frame).collect()}
    assert got[9000].kept and not got[9001].kept and not got[9001].base_failed
    kept = [got[k].kept for k, _ in rows[:3000]]
    assert sum(kept[k] for k in range(3000) if k % 5) > 2350 and sum(kept[k] for k in range(0, 3000, 5)) < 20


def test_null_keys_and_clashing_names(spark):
    text = "A calm sentence about nothing much stands here for once. " * 8
    rows = [(None, text, 1, 2), (None, "x x x x x x", 1, 2), (4, None, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, lang_pred int")
    got = weak_quality.quality(docs).collect()
    assert sorted((r.doc_id is None, r.n_words) for r in got) == [(False, 0), (True, 6), (True, 80)]
    clash = spark.createDataFrame([(None, text, "en", 1, True), (None, text, "en", 1, True), *((k, text, "en", 0, False) for k in range(6))], "doc_id long, text string, lang string, lang_pred int, held_out boolean")
    seen = language.identify(clash).collect()
    assert len(seen) == 8 and {r.lang_pred for r in seen} == {"en"}
