"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quantloom.llm import bpe, common, components, files, huffman, language, near_dup, packing, secret_scan, suffix, vptree, warc, weak_quality

JSON = P.path("byte_bpe_50k.json")
LONG = " ".join(f"w{k % 977} x{k % 13}" for k in range(40_000))
ROWS = [(1, "alpha beta gamma delta epsilon", "en"), (2, None, "en"), (3, "", "de"), (4, LONG, "en"), (5, "alpha beta gamma delta epsilon", None), (5, "alpha beta gamma delta epsilon", None), (6, "\x00 ünï 🙂 'tis", "fr"), (None, "no key here", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, lang, "s", 7, 1.5, "x") for k, t, lang in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, node long, score double, other string")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter("false")


def ids_of(text):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, docs, nothing, monkeypatch):
    monkeypatch.setattr(huffman, "FILE_BYTES", 20_000)
    rows = huffman.read_token_files(huffman.write_token_files(docs, JSON, P.PATTERN, 50_257)).orderBy("start").collect()
    place = 0
    for r, (k, t, _) in zip(rows, sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        want = [*ids_of(t), 0]
        assert tuple(r) == (k, place, len(want), crc(want))
        place += len(want)
    assert huffman.read_token_files(huffman.write_token_files(nothing, JSON, P.PATTERN, 50_257)).count() == 0


def test_packing(docs, nothing, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_BYTES", 40_000)
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in packing.pack_by_curve(docs, JSON, P.PATTERN, length=64).collect():
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for k, t, _ in ROWS:
        want = [*ids_of(t), 1]
        mine = sorted(pieces[k], key=lambda r: (r.start, r.sequence_id))
        assert sum(r.length for r in mine) == len(want) * (2 if k == 5 else 1)
        assert all(r.doc_tokens == len(want) and r.ids_crc32 == crc(want[r.start : r.start + r.length]) for r in mine)
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 64 or at & (at - 1) == 0
    assert packing.pack_by_curve(nothing, JSON, P.PATTERN).count() == 0


def test_byte_bpe(docs, nothing):
    got = {(r.doc_id, r.n_tokens): r for r in bpe.bpe_digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for k, t, _ in ROWS:
        ids = ids_of(t)
        r = got[(k, len(ids))]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.bpe_digests(nothing, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def passage(seed, n):
    return "".join(chr(97 + c) for c in np.random.default_rng(seed).integers(0, 26, n))


def removed(rows):
    seen, out = set(), []
    for key, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((key, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("wide", [4096, 1])
def test_suffix_removal(spark, nothing, monkeypatch, wide):
    monkeypatch.setattr(suffix, "WIDE", wide)
    p, q = passage(1, 150), passage(2, 230)
    rows = [(1, p), (2, "x" + p + "y"), (3, q[:99]), (4, q), (5, q + q), (6, "z" * 400), (7, ""), (8, None), (9, "é" * 80 + p[:100] + "é" * 60), (10, q[:150] + p[20:])]
    docs = spark.createDataFrame([(k, t, "a", 1) for k, t in rows], "doc_id long, text string, other string, key int")
    got = sorted(tuple(r) for r in suffix.digests(docs).collect())
    assert got == removed(rows)
    kept = {r.doc_id: r for r in suffix.remove_repeats(docs).collect()}
    assert kept[2].kept == "xy" and kept[2].other.key == 1
    assert suffix.remove_repeats(nothing).count() == 0


def test_rows_that_repeat_key_and_text_are_one_document(spark):
    once, other = ("".join(np.random.default_rng(n).choice(list("abcdefgh"), n)) for n in (400, 300))
    rows = [(5, once), (5, once), (9, "ZZ" + once), (9, other), (9, other), (3, once[50:200] + other[:150]), (None, other), (None, other)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    # null sorts first; 3 holds 150 bytes of the null key's text; 5 repeats 150 of 3
    assert got == sorted([(5, 400, 150), (5, 400, 150), (9, 402, 400), (9, 300, 300), (9, 300, 300), (3, 300, 150), (None, 300, 0), (None, 300, 0)], key=str)


def test_a_passage_of_every_text(spark, monkeypatch):
    """One passage in 20,000 texts: it stays in the first, and its anchors get a few rows a task."""
    rng = np.random.default_rng(6)
    passage = "".join(rng.choice(list("abcdefghij"), 150))
    rows = spark.range(0, 20_000, 1, 4).selectExpr("id * 7 % 20011 doc_id", f"concat(sha2(string(id), 256), '{passage}', sha2(string(id + 1000000), 256)) text")
    out = suffix.remove_repeats(rows)
    first = rows.agg({"doc_id": "min"}).first()[0]
    assert [r.doc_id for r in out.filter("n_removed = 0").collect()] == [first]
    assert out.filter("n_removed between 150 and 170").count() == 19_999
    seen = suffix._Seen()
    one = np.ones(1, np.uint64)
    keys = rng.permutation(20_000)
    left = sum(not seen.earlier(one, one, np.array([k]), np.zeros(1, np.uint32), np.zeros(1, np.int32))[0] for k in keys)
    assert left < 60  # the running minima of a random order


def test_suffix_removal_of_a_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 1000)
    rows = [(1, passage(5, 7000)), (2, passage(6, 300) + passage(5, 7000)[900:5200] + passage(7, 250))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r)[1:4] for r in suffix.digests(docs).orderBy("doc_id").collect()] == [r[1:4] for r in removed(rows)]


def test_suffix_removal_of_a_text_over_two_chunks(spark):
    """Larger than the workers' own CHUNK_BYTES: the text repeats itself across pieces, others before and after it repeat parts of it."""
    body = passage(11, (2 << 20) + 5000)
    whole = body[:1_000_000] + passage(12, 300) + body[1_000_000:] + body[700_000:700_900] + "x" + body[2_000_000:2_000_500] + body[:150]
    rows = [(1, passage(13, 120) + body[1_500_000:1_500_400]), (2, whole), (3, passage(14, 90) + body[50:450] + "y" + passage(12, 300)), (4, body[2_090_000:2_090_700])]
    want = removed(rows)
    assert [r[2] > 0 for r in want] == [False, True, True, True]
    assert [tuple(r) for r in suffix.digests(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == want


def test_pieces_carry_the_mark_of_their_text():
    text = passage(15, 3 * suffix.CHUNK_BYTES)
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text])], names=["key", "text"])
    data = np.frombuffer(text.encode(), np.uint8)
    mark = suffix._marks(data, np.array([0, len(data)])).tolist()
    assert [m.tolist() for _, m, *_ in suffix._rows(batch)] == [mark] * 3


def jaccard_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    name = list(range(len(rows)))

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                name[root(i)] = root(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[root(i)].append(k)
    return {k: (len(sets[i]), min(least[root(i)])) for i, (k, _) in enumerate(rows)}


@pytest.mark.parametrize("branch, family", [(8192, 512), (4, 512), (4, 3)])
def test_near_duplicates(spark, docs, nothing, monkeypatch, branch, family):
    monkeypatch.setattr(near_dup, "BRANCH", branch)  # both are read by the driver
    monkeypatch.setattr(near_dup, "FAMILY", family)
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(60)]
        for _ in range(8):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, 60))] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows) + 1, " ".join(w)))
    rows += [(900, "one two"), (901, "One  TWO"), (902, ""), (903, None), (904, " \n"), (905, "common line of many documents " + passage(9, 30)), (906, "common line of many documents " + passage(8, 40))]
    table = spark.createDataFrame([(k, t, 5, 0) for k, t in rows], "doc_id long, text string, node int, component int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(table, shingle=4).collect()}
    assert got == jaccard_components(rows, 4, 80)
    if branch == 8192:
        odd = near_dup.near_duplicates(docs).collect()
        assert len(odd) == len(ROWS) and all(r.kept for r in odd if r.doc_id is None)
        assert {r.component_id for r in odd if r.doc_id in (1, 5)} == {1}
        assert near_dup.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("links", [1_000_000, 7])
def test_components(spark, monkeypatch, links):
    monkeypatch.setattr(components, "LINKS", links)  # of a task: few, so that star steps are needed
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert {got[k] for k in range(1, 41)} == {1} and {got[k] for k in (90, 95, 100)} == {90}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_secrets(spark, docs, nothing):
    key40 = "Ab1" + "cD2+" * 9 + "e"
    rows = [(1, f"x AKIA{'B' * 16} secret: '{key40}' https://api.example.com/v1 token=ab token = abcdef {'0af' * 9}"), (2, f"{key40} https://api.example.com"), (3, None), (4, "🙂 PASSWORD:=hunter22 api_key=\"abc.def-12\""), (5, "token=token:abcdefgh"), (6, f"account = acme {key40}")]
    got = {r.doc_id: r for r in secret_scan.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (2, 1, 1)
    assert "key40" in got[1].spans and "address" in got[1].spans
    assert got[2].spans == "" and got[3].spans == ""
    assert got[4].spans == "assign:2:20,assign:21:40" and got[5].n_assign == 0
    assert got[6].spans.startswith("account:0:14,key40:15")
    text = {r.doc_id: r.text for r in secret_scan.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert text[4] == '🙂 [secret] [secret]"'
    assert key40 not in text[1] and text[2] == rows[1][1] and text[3] is None
    assert secret_scan.digests(docs).count() == len(ROWS) and secret_scan.digests(nothing).count() == 0


def test_secrets_of_a_long_text_and_clashing_names(spark):
    """Thousands of spans: positions by a plain search; linked parts where their scopes meet."""
    rng = np.random.default_rng(3)
    parts = []
    for k in range(6000):
        parts.append("".join(rng.choice(list("0123456789abcdef"), 30)) if k % 3 else f"é{k} " + "x" * 700 * (k % 2) + f" user: bobby{k} " + ("x" * 700 if k % 2 else "password = secretword"))
    text = " ".join(parts)
    rows = [(1, text, "a", 1, None), (2, None, "b", 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, base int, _hex string")
    got = {r.doc_id: r for r in secret_scan.digests(docs).collect()}
    hexes = [m.span() for m in re.finditer("[0-9a-f]{24,}", text)]
    assigns = [m.span() for m in re.finditer(secret_scan.ASSIGN, text)]
    accounts = [m.span() for m in re.finditer(secret_scan.ACCOUNT, text)]
    near = [x for x in accounts if any(o[0] < x[1] + secret_scan.SCOPE and x[0] < o[1] + secret_scan.SCOPE for o in assigns)]
    want = sorted([(*x, "hex") for x in hexes] + [(*x, "assign") for x in assigns] + [(*x, "account") for x in near])
    assert 0 < len(near) < len(accounts)
    assert got[1].spans == ",".join(f"{k}:{a}:{b}" for a, b, k in want) and (got[1].n_hex, got[1].n_assign) == (len(hexes), len(assigns))
    masked = {r.doc_id: r for r in secret_scan.redacted(docs).collect()}
    out, place = "", 0
    for a, b, _ in want:
        out, place = out + text[place:a] + "[secret]", b
    assert masked[1].text == out + text[place:] and masked[1].spans == "a" and masked[1].base == 1 and masked[2].text is None
    assert secret_scan.scan(docs).columns == ["doc_id", "text", "_hex", "base", "spans"]


def test_secret_keys_next_to_an_equals_sign(spark):
    key40, access = "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY", "AKIA" + "B" * 16
    before = ("aws_secret_access_key=", "SecretAccessKey=", "key=", "x==", "aws_secret_access_key = ", "k: '")
    rows = [(i, f"{access} {b}{key40}") for i, b in enumerate(before)]
    rows += [(10, f"{access} k={key40}= https://api.example.com/v1"), (11, f"{access} k={key40}A"), (12, f"{access} k=A{key40}"), (13, f"{access} {'z1' * 20}=B"), (14, f"k={key40}"), (15, f"account=acme key={key40}\nother={key40}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans.split(",") for r in secret_scan.digests(docs).collect()}
    masked = {r.doc_id: r.text for r in secret_scan.redacted(docs).collect()}
    for i, b in enumerate(before):
        at = len(access) + 1 + len(b)
        assert spans[i] == ["access:0:20", f"key40:{at}:{at + 40}"] and masked[i] == f"[secret] {b}[secret]"
    assert spans[10] == ["access:0:20", "key40:23:63", "address:65:91"]
    assert spans[11] == spans[12] == spans[13] == ["access:0:20"] and spans[14] == [""]
    assert masked[15] == "[secret] key=[secret]\nother=[secret]"


def test_quality(docs, nothing, spark):
    good = " ".join(f"word{k}" for k in range(80))
    bad = " ".join(f"word{k}&&&" for k in range(80))
    table = spark.createDataFrame([(k, good if k % 3 else bad) for k in range(60)] + [(99, "short"), (100, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in weak_quality.quality(table).collect()}
    assert all(got[k].kept == bool(k % 3) for k in range(60))
    accused = " ".join(f"word{k}" for k in range(80)) + " word1 word2 word3 word4" * 12  # one rule speaks against it, the others outvote that
    many = spark.createDataFrame([(k, good if k % 3 else bad, 0) for k in range(600)] + [(700, accused, 1), (700, accused, 1), (701, good * 3000, 2)], "doc_id long, text string, posterior int")
    more = {r.doc_id: r for r in weak_quality.quality(many).collect()}
    assert more[700].n_repeat_words > 0.3 * more[700].n_words and more[700].kept and not more[0].kept and more[701].n_words == 240_000 - 2999
    assert got[99].base_failed and got[100].base_failed and not got[100].kept
    assert weak_quality.quality(docs).count() == len(ROWS) and weak_quality.quality(nothing).count() == 0


def test_language(spark, docs, nothing):
    rng = np.random.default_rng(0)
    parts = {"en": ["the", "ing", "tion", "and", "er"], "fr": ["eau", "ment", "que", "ée", "oi"], "de": ["sch", "ung", "keit", "ö", "ein"]}
    rows = []
    for k in range(240):
        lang = ("en", "fr", "de")[k % 3]
        rows.append((k, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(30)), lang))
    rows += [(1000, None, "en"), (1001, "123 !!", "fr"), (1002, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(table).collect()}
    held = [k for k, _, _ in rows if k < 240 and zlib.crc32(str(k).encode()) % 4 == 2]
    assert held and all(got[k].held_out for k in held)
    assert np.mean([got[k].lang_pred == rows[k][2] for k in held]) > 0.95
    assert got[1000].lang_pred == got[1001].lang_pred == got[1002].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}
    net = language.train(table)
    others = ["Привет, как дела сегодня", "xkcd bfgt zzqw plkj vvbx", "aGVsbG8gd29ybGQhIHRoaXMgaXMg", rows[0][1], rows[1][1] + " 12", "the " * 20_000, None, ""]
    odd = spark.createDataFrame([(k, t, "x", k) for k, t in enumerate(others)], "doc_id long, text string, score string, key int")
    kept = language.keep_recognised(odd, net).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4, 5] and kept[0].score == "x"
    assert language.identify(nothing).count() == 0 and language.identify(docs).count() == len(ROWS)


@pytest.mark.parametrize("zip64", [False, True])
def test_archives(spark, zip64):
    big, other = "é" * 700, "b" * 1200
    rows = [(1, "http://a", big), (5, "http://b\r\n", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (7, "u", None), (8, "u", other), (8, "u", other), (None, "u", big), (9, "u", "")]
    pages = spark.createDataFrame([(k, u, h, "x", 1, None, 2, 3) for k, u, h in rows], "page_id long, url string, html string, digest string, response int, payload string, key int, size int")
    manifest = warc.write_archives(pages, zip64=zip64)
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    assert {k: (by[k][0].record_type, by[k][0].refers_to) for k in (1, 3, 5, None)} == {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), None: ("revisit", 5)}
    assert all(by[k][0].record_type == "response" for k in (2, 4, 7, 9)) and [r.record_type for r in by[8]] == ["response"] * 2
    for k, _, h in rows:
        raw = (h or "").encode()
        assert all(r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha1(raw).hexdigest() for r in by[k])
        assert all(r.payload == raw for r in by[k] if r.record_type == "response")
    assert warc.read_archives(warc.write_archives(pages.filter("false"))).count() == 0
    import zipfile

    for r in manifest.collect():
        with zipfile.ZipFile(r.archive.removeprefix("file:")) as z:  # another reader agrees
            assert z.testzip() is None and z.namelist() == [warc.WARC_NAME, warc.INDEX_NAME]


def test_vector_search(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 6)).astype(np.float32)
    x[40] = x[41]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(500, None), (520, [0.0] * 6), (540, [float("nan")] * 6), (560, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (580, []), (600, [1.0, 2.0]), (None, [1.0] * 6)]
    got = defaultdict(list)
    for r in vptree.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    assert sorted(got) == list(range(0, 400, 20))
    for k, found in got.items():
        score = x.astype(float) @ x[k].astype(float)
        want = sorted((i for i in range(400) if i != k), key=lambda i: (-round(score[i], 9), i))[:20]
        assert [r.vec_id for r in found] == want and [r.rank for r in found] == list(range(1, 21))
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert vptree.search(few).count() == 3 and vptree.search(few.filter("false")).count() == 0


def test_ranges_of_binary_columns():
    a = common.binary_array(np.arange(6, dtype="<u2"), np.array([4, 0, 8]))
    data, off = common.utf8(a.slice(1))
    assert data.view("<u2").tolist() == [2, 3, 4, 5] and off.tolist() == [0, 0, 8]
    assert files._at("file:/tmp/x")[1] == "/tmp/x"
