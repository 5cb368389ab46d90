"""Edge cases that every operator meets, and each against a brute-force version on small tables."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from textlode.llm import common, decontamination, fingerprints, licenses, mph, near_dedup, packing, quality, queries, secrets, substrings, token_files, toxicity
from textlode.llm.common import documents, shared_dir, windows
from textlode.llm.components import components
from textlode.llm.tokens import Encoder

P = pytest.importorskip("public_tokenizers")
LONG = "lorem ipsum dolor " * 30_000
ROWS = [(1, "one two three four"), (2, None), (3, ""), (None, "text of nobody"), (None, None), (4, "one two three four"), (4, "one two three four"), (4, "another text"), (5, LONG), (6, "é\U0001f600 \n\n x")]


def table(spark, rows):
    """documents with extra columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = {c: F.lit(7) for c in ("row", "key", "fp", "x", "y", "score", "held_out", "component", "part", "ids", "line", "lower", "spans", "n_chars", "predicted", "same", "free")}
    return df.withColumns(extra)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 40)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near the old river bank today"), (2, None), (None, "x y"), (3, ""), (1, "repeat of one")], "item_id long, text string")


def read_back(docs, spark):
    folder = shared_dir(spark) + f"/t-{random.random()}"
    os.makedirs(folder.removeprefix("file://"))
    rows = token_files.write(docs, folder, P.path("word_bpe_49k.json"), False, 1, 2)
    token_files.write_index(rows, folder, 2)
    return token_files.read(token_files.find(token_files.numbered(docs), folder), folder)


OPERATORS = {
    "quality": lambda d, labels, bench: quality.score(d, labels),
    "secrets": lambda d, labels, bench: secrets.redact(d),
    "fingerprints": lambda d, labels, bench: fingerprints.compare(d),
    "toxicity": lambda d, labels, bench: toxicity.score(d, labels),
    "substrings": lambda d, labels, bench: substrings.remove(d),
    "decontamination": lambda d, labels, bench: decontamination.search(d, bench),
    "token_files": lambda d, labels, bench: read_back(d, d.sparkSession),
    "licenses": lambda d, labels, bench: licenses.scan(d, licenses.frequencies(d)),
    "near_dedup": lambda d, labels, bench: near_dedup.link(d),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
def test_a_row_for_each_row(spark, labels, bench, name, rows):
    out = OPERATORS[name](table(spark, rows), labels, bench).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows)


@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
def test_stages_keep_columns(spark, labels, bench, rows):
    docs = table(spark, rows)
    for out in (toxicity.accept(docs, labels), near_dedup.keep_one(docs), decontamination.clean(docs, bench), secrets.redact(docs)):
        assert out.columns == docs.columns
        assert out.count() <= len(rows)
    # nulls and "" are one text here; each repeated text stays once
    assert near_dedup.keep_one(docs).count() == len({r[1] or "" for r in rows})


@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_equal_those_of_the_whole_text(name, spaced):
    e = Encoder(P.path(name), spaced, most=50)
    rng = random.Random(3)
    texts = [None, "", " ", "a  b   c", "x\n \ny\t", "İ ß’s don't I'll", "a\x1c b \x85 c", "<|endoftext|> x", "naïve—test … ok"]
    texts += ["".join(rng.choice(["ab", " ", "  ", "\n", ".", "'s", "É", "9", "́", "Wort", "\U0001f600", "\t"]) for _ in range(60)) for _ in range(60)]
    ids, at = e.batch(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids, t


class Counting:
    """A tokenizer that counts the words it is sent."""

    def __init__(self, inner, words):
        self.inner, self.words = inner, words

    def encode_batch_fast(self, texts, **options):
        self.words.update(w.strip("Ġ") for t in texts for w in t.split())
        return self.inner.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_common_words_stay_known(name, spaced):
    """Also where rare words fill the memory many times over; ids stay those of the whole text, with punctuation and capitals."""
    e, words, rng = Encoder(P.path(name), spaced, most=500), Counter(), random.Random(4)
    plain = e.tokenizer
    for k, v in list(vars(e).items()):
        if hasattr(v, "encode_batch_fast"):
            setattr(e, k, Counting(v, words))
    letters = "abcdefghijklmnopqrstuvwxyz"
    common = ["q" + "".join(rng.choices(letters, k=6)) for _ in range(100)]
    odd = ["É", "Éa,", "İ", "ıx.", "ſ", "ǆ…", "µm", "a_b", "it's", "(x)", "--", "9", "x\u0301", "日本", "ɐ", "ª).", "Ⱥ", ""]
    for _ in range(30):
        rare = ["".join(rng.choices(letters, k=8)) + rng.choice(["", ".", "),"]) for _ in range(600)]
        texts = [" ".join(rng.sample([*common, *rare], 700)), "x " + " ".join(common)]
        texts += [" ".join(rng.choices([*odd, *(w.title() for w in odd)], k=5)) for _ in range(20)]
        ids, at = e.batch(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t
    assert sum(words[w] for w in common) < 10 * len(common)  # in 30 calls


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    index = mph.build(keys)
    assert sorted(mph.slots(index, keys).tolist()) == list(range(len(keys)))
    assert len(mph.slots(mph.build(keys[:0]), keys)) == len(keys)


def test_token_files_round_trip_and_strangers(spark, sf):
    docs = documents(spark, sf)
    t = Encoder(P.path("word_bpe_49k.json"), False).tokenizer
    before = 0
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_token_files"](spark, sf).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = t.encode(r["text"], add_special_tokens=False).ids + [1]
        x = got[r["doc_id"]]
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)
    folder = shared_dir(spark) + "/strangers"
    os.makedirs(folder.removeprefix("file://"))
    token_files.write_index(token_files.write(docs, folder, P.path("word_bpe_49k.json"), False, 1, 2), folder, 2)
    assert token_files.find(spark.range(10_000, 11_000).selectExpr("id AS doc_id", "0 AS copy"), folder).count() == 0


def test_packing_loses_no_id_and_pads_nothing(spark, sf):
    t = Encoder(P.path("byte_bpe_50k.json"), True).tokenizer
    rows = queries.QUERIES["op6_packing"](spark, sf).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d in documents(spark, sf).collect():
        ids, at = t.encode(d["text"], add_special_tokens=False).ids + [1], 0
        for r in sorted(by_doc[d["doc_id"]], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0


@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
def test_packing_of_odd_rows(spark, rows):
    """Each row's ids lie in its pieces, once, also where doc_ids are null or repeat."""
    t = Encoder(P.path("byte_bpe_50k.json"), True).tokenizer
    want, got = Counter(), Counter()
    for d, text in rows:
        want[d] += len(t.encode(text or "", add_special_tokens=False).ids) + 1
    for r in packing.pack(table(spark, rows), P.path("byte_bpe_50k.json"), True, 1).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_ranges_part_keys_evenly(spark):
    rng = random.Random(2)
    rows = [(rng.choice([5, 5, rng.randrange(100)]), rng.randrange(1000), rng.randrange(1, 50)) for _ in range(3000)]
    parts = common.ranges(spark.createDataFrame(rows, "a long, b long, weight long"), 10)
    part = parts.of(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    weights = np.bincount(part, [r[2] for r in rows])
    assert len(parts) == 10 and weights.max() < 1.2 * weights.sum() / 10
    by = sorted(zip([r[:2] for r in rows], part.tolist(), strict=True))
    assert [p for _, p in by] == sorted(part.tolist())


def test_hilbert_is_a_curve():
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    order = np.argsort(packing.hilbert(grid, 4))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [1, 10_000])
def test_simhash(spark, sf, monkeypatch, hot):
    """Fingerprints and components, against all pairs of distinct fingerprints."""
    monkeypatch.setattr(common, "HOT", hot)
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_near_dedup"](spark, sf).collect()}
    for r in documents(spark, sf).collect():
        assert got[r["doc_id"]]["fingerprint"] == f"{brute_fingerprint(r['text']):016x}"
    fps = {d: int(r["fingerprint"], 16) for d, r in got.items()}
    left, want = set(fps), {}
    while left:
        todo = [min(left)]
        least = todo[0]
        left.discard(least)
        while todo:
            x = todo.pop()
            want[x] = least
            near = {y for y in left if (fps[x] ^ fps[y]).bit_count() <= 2}
            left -= near
            todo += near
    assert {d: r["component_id"] for d, r in got.items()} == want


@pytest.mark.parametrize("group", [2, 256])
def test_links_give_the_components_of_all_pairs(spark, monkeypatch, group):
    """With a small GROUP every level of signatures is used."""
    monkeypatch.setattr(near_dedup, "GROUP", group)
    rng = random.Random(group)
    values = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(14):
            values.add(x)
            for _ in range(rng.choice([1, 2, 3])):
                x ^= 1 << rng.randrange(64)
    values = sorted(values)
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    want = {}
    for v in values:
        want.setdefault(find(v), set()).add(v)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = {}
    for r in components(near_dedup.edges(df)).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(map(signed, g)) for g in want.values() if len(g) > 1)


@pytest.mark.parametrize("hot", [1, 10_000])
def test_components_of_a_long_path(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1000), (5000, 4000)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(e).collect()}
    assert got == {i: 0 for i in range(201)} | {5000: 4000, 4000: 4000}


def brute_removed(docs):
    words = {d: (t or "").encode().split() for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][i : i + 50]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = len(w), len(gone), hashlib.sha256(kept).hexdigest()
    return out


def naive_factors(block, w):
    """Greedy factors of w against contexts: the first context and place that has the window, as far as both go along."""
    out, i = [], 0
    while i < len(w):
        at = next(((c, p) for c, (_, _, other) in enumerate(block) for p in range(len(other)) if other[p] == w[i]), None)
        if at is None:
            i += 1
            continue
        row, start, other = block[at[0]]
        n = 1
        while i + n < len(w) and at[1] + n < len(other) and w[i + n] == other[at[1] + n]:
            n += 1
        out.append((i, n, row, start + at[1]))
        i += n
    return out


def test_factors_equal_a_naive_parse():
    rng = np.random.default_rng(3)
    for _ in range(200):
        block, known = substrings.Block(), []
        for row in range(rng.integers(1, 6)):
            w = rng.integers(0, 6, rng.integers(1, 12)).astype(np.uint64)
            block.add(row, 10 * row, w)
            known.append((row, 10 * row, w.tolist()))
        w = rng.integers(0, 8, rng.integers(1, 15)).astype(np.uint64)
        got = block.parse(w)
        assert got == naive_factors(known, w.tolist())
        covered = {i + k for i, n, _, _ in got for k in range(n)}
        assert covered == {i for i, x in enumerate(w.tolist()) if any(x in k for _, _, k in known)}  # nothing is lost at factors' boundaries


@pytest.mark.parametrize("hot", [1, 1000])
def test_substrings_equal_brute_force(spark, monkeypatch, hot):
    """Shared passages of 49, 50 and more words, at edges, with edits, repeats within a text, and copies; HOT of 1 makes keys of two rows hot."""
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(substrings, "CROWD", hot)
    rng = random.Random(hot)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta".split()) + str(rng.randrange(40))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = word()
            parts += [word() for _ in range(rng.choice([0, 3, 60]))] + p
        docs.append((d, " ".join(parts)))
    docs += [(100, docs[3][1]), (101, docs[3][1].replace(" ", "\n")), (102, "same " * 130), (103, "same " * 50), (104, None)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in substrings.remove(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_removed(docs)


@pytest.mark.parametrize("hot", [1, 1000])
def test_substrings_of_repeated_rows(spark, monkeypatch, hot):
    """Rows that repeat in doc_id and text, null doc_ids with one text, and a copy of these in a smaller row."""
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(substrings, "CROWD", hot)
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(7, "x " + text)] * 5 + [(None, text)] * 4 + [(3, text[:300])] + [(8, "y " + text[-200:])] * 2
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(text[:300].split()) - 1  # its last word is cut
    removed = {(r[0], r[1]): r[2] for r in got}
    assert len(got) == 4 and removed[7, 121] in (n, n + 1) and removed[None, 120] == 120 and removed[3, n + 1] == 0


def test_window_hashes_hang_on_their_values_alone():
    h = np.random.default_rng(0).integers(0, 1 << 63, 300).astype(np.uint64)
    both = np.concatenate([h, h])
    assert (windows(both, 50)[:251] == windows(both, 50)[300:551]).all() and len(set(windows(h, 50).tolist())) == 251


BASE = [
    ("assign", re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute_secrets(text):
    out = [(k, *m.span()) for k, rx, ok in BASE for m in rx.finditer(text or "") if ok(m)]
    return sorted(out, key=lambda f: (f[1], ["assign", "access", "hex"].index(f[0])))


def test_secrets(spark, sf):
    texts = ["password:token:abcdefgh", "PassWord = 'x' token=\"abc\" API_KEY: abcdef", "é" * 5 + 'token = "' + "0f" * 20 + '"', "AKIA" * 8, "apikey==abcdef", "toKen:abcdef", "f" * 24 + "g" + "0" * 23, None]
    texts += [r["text"] for r in documents(spark, sf).collect()]
    for t in texts:
        assert [f for f in secrets.scan(t) if f[0] in secrets.BASE] == brute_secrets(t)
    body = "a1B2" * 7 + "Zz"
    good = b"ghp_" + body.encode() + secrets._crc62(body.encode())
    assert ("github", 2, 42) in secrets.scan("x " + good.decode()) and secrets.scan("x ghp_" + body + "000000") == []
    der = b"\x30\x82" + (40_000).to_bytes(2, "big") + bytes(range(256)) * 156 + bytes(64)
    for n in (64, 76):
        key = base64.b64encode(der).decode()
        key = "\n".join(key[i : i + n] for i in range(0, len(key), n))
        pem = f"-----BEGIN RSA PRIVATE KEY-----\n{key}\n-----END RSA PRIVATE KEY-----"
        assert ("pem", 2, 2 + len(pem)) in secrets.scan("x " + pem + " y") and not [f for f in secrets.scan(pem[:-30]) if f[0] == "pem"]
    assert [f[0] for f in secrets.scan("iban: GB82WEST12345698765432 card 4111 1111 1111 1111 card 4111 1111 1111 1112")] == ["iban", "card"]
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_secret_scan"](spark, sf).collect()}
    for r in documents(spark, sf).collect():
        base, x = brute_secrets(r["text"]), got[r["doc_id"]]
        assert (x["n_assign"], x["n_access"], x["n_hex"]) == tuple(sum(f[0] == k for f in base) for k in ("assign", "access", "hex"))
        assert x["base_sha256"] == hashlib.sha256(secrets.joined(base).encode()).hexdigest() and x["spans"] == secrets.joined(secrets.scan(r["text"]))
    one = secrets.redact(table(spark, [(1, "a token = abcdef z"), (2, None)])).orderBy("doc_id").collect()
    assert one[0]["text"] == "a <ASSIGN> z" and one[0]["n_chars"] == 12 and one[1]["text"] is None


def test_fingerprints_add_up():
    of = fingerprints.Fingerprint.of
    assert of("a b c d\nx y z") == of("x y z\na b c d") != of("a b c d\nx y")
    assert str(of("a b c") + of("x y")) == str(of("a b c\nx y")) and of("a b c\nx y") - of("x y") == of("a b c")
    assert of(None).likeness(of("")) == 1.0
    for text in ("a b c\nx y", "lorem ipsum dolor " * 50_000, "-"):
        again = fingerprints.Fingerprint.parse(str(of(text)))
        assert str(again) == str(of(text)) and (again.lanes == of(text).lanes).all()


def test_fingerprints_of_long_repetitive_texts():
    of, text = fingerprints.Fingerprint.of, "lorem ipsum dolor " * 70_000
    half = fingerprints.edited(text, "one two three four five six " * 60_000)
    assert 0.4 < of(text).likeness(of(half)) < 1 and of(text).likeness(of("one two three four")) < 0.4


def test_each_fingerprint_row_meets_the_next(spark):
    """Nulls, ties and repeats over many small ranges: by doc_id, nulls first, then by hash of the text."""
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 2, 2, 2, *range(40)]), rng.choice([None, "", *(f"w{i} x y" for i in range(30))])) for _ in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = docs.withColumn("h", F.xxhash64("text")).orderBy(F.col("doc_id").asc_nulls_first(), "h", "text").collect()
    want = []
    for r, n in zip(order, order[1:] + order[:1], strict=True):
        changed = fingerprints.edited(r["text"] or "", n["text"] or "")
        want.append((r["doc_id"], len(r["text"] or ""), hashlib.sha256(changed.encode()).hexdigest()))
    got = [tuple(r)[:3] for r in fingerprints.compare(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_fingerprints_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in documents(spark, sf).collect()}
    order = sorted(docs)
    rows = {r["doc_id"]: r for r in queries.QUERIES["op3_fingerprints"](spark, sf).collect()}
    for d, n in zip(order, order[1:] + order[:1], strict=True):
        text = docs[d]
        k = len(text) // 2
        changed = text[: len(text) - k] + docs[n][:k]
        r = rows[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == str(fingerprints.Fingerprint.of(text)) and r["edited_fingerprint"] == str(fingerprints.Fingerprint.of(changed))
        a, b = (fingerprints.Fingerprint.parse(r[c]) for c in ("fingerprint", "edited_fingerprint"))
        assert r["near_edited"] == a.likeness(b) and r["near_next"] == a.likeness(fingerprints.Fingerprint.parse(rows[n]["fingerprint"]))
    near = [r["near_edited"] > r["near_next"] for r in rows.values() if r["n_chars"] > 200]
    assert sum(near) > 0.95 * len(near)


def test_nearest_examples_equal_brute_force():
    rng = np.random.default_rng(5)
    vectors = [(sorted(set(rng.integers(0, 40, rng.integers(1, 8)).tolist())),) for _ in range(700)]
    vectors = [(v, rng.integers(1, 4, len(v)).tolist()) for (v,) in vectors]
    index = toxicity.Index(vectors, [0] * 700, list(range(700)), rng.random(40) + 0.5)
    full = np.zeros((700, 40))
    for i, (t, c) in enumerate(vectors):
        t, w = index.weights(t, c)
        full[i, t] = w
    for i in range(0, 700, 7):
        cosine = full @ full[i]
        want = np.lexsort((np.arange(700), -np.round(cosine, 12)))[:15]
        found, got = index.nearest(*vectors[i])
        want = want[cosine[want] > 0]
        assert found.tolist() == want.tolist() and np.allclose(got, cosine[want])


def test_searches_of_many_vectors_equal_brute_force():
    """Copies are held once and ties go to the smaller number; more examples than a block, more terms than are held as a matrix."""
    rng = np.random.default_rng(8)
    vectors = [(sorted(set(np.minimum(rng.zipf(1.3, 12), 599).tolist())),) for _ in range(900)]
    vectors = [(v, rng.integers(1, 4, len(v)).tolist()) for (v,) in vectors] + [([3, 5], [1, 2])] * 300
    index = toxicity.Index(vectors, [0] * 1200, list(range(1200)), rng.random(600) + 0.5)
    assert index.n == len({str(v) for v in vectors})
    full = np.zeros((1200, 600))
    for i, (t, c) in enumerate(vectors):
        t, w = index.weights(t, c)
        full[i, t] = w
    asked = [*range(0, 900, 9), 1000, 1100]
    for i, (found, got) in zip(asked, index.search([vectors[i] for i in asked], 16), strict=True):
        cosine = full @ full[i]
        want = np.lexsort((np.arange(1200), -np.round(cosine, 12)))[:16]
        want = want[cosine[want] > 0]
        assert found.tolist() == want.tolist() and np.allclose(got, cosine[want])


@pytest.mark.parametrize("opened", [0.0, 1.0])
@pytest.mark.parametrize("k,n", [(16, 6000), (16, 300), (300, 900)])
def test_searches_with_and_without_bounds_equal_brute_force(opened, k, n):
    """More and fewer blocks than k, and k above a block's size; floors from a block before are kept."""
    rng = np.random.default_rng(9)
    vectors = [sorted(set(np.minimum(rng.zipf(1.3, 10), 599).tolist())) for _ in range(n)]
    vectors = [(v, rng.integers(1, 4, len(v)).tolist()) for v in vectors]
    index = toxicity.Index(vectors, [0] * n, list(range(n)), rng.random(600) + 0.5)
    full = np.zeros((n, 600))
    for i, (t, c) in enumerate(vectors):
        t, w = index.weights(t, c)
        full[i, t] = w
    asked = list(range(0, n, n // 60))
    least = rng.random(len(asked)) * (rng.random(len(asked)) < 0.5)
    index.opened = opened
    for i, floor, (found, got) in zip(asked, least, index.search([vectors[i] for i in asked], k, least), strict=True):
        cosine = full @ full[i]
        want = np.lexsort((np.arange(n), -np.round(cosine, 12)))[:k]
        want = want[(cosine[want] > 0) & (cosine[want] >= floor + 1e-4)]
        assert found[: len(want)].tolist() == want.tolist() and np.allclose(got[: len(want)], cosine[want])


def test_blocks_of_examples_leave_one_result(spark):
    """What the disk holds does not grow with the number of blocks."""
    known = [(i, f"{'fair' if i % 3 else 'foul'} word{i % 40}") for i in range(200)]
    docs, labels = table(spark, known), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in known], "doc_id long, toxic int")
    at = common.shared_dir(spark).removeprefix("file://")
    before = {x for x in os.listdir(at) if x.startswith("toxicity-nearest")}
    assert toxicity.score(docs, labels, block=30).count() == 200
    assert len({x for x in os.listdir(at) if x.startswith("toxicity-nearest")} - before) == 1


def test_blocks_of_examples_add_no_tables_and_no_shuffles(spark):
    """Vectors are shuffled and written once, however many blocks of examples there are; indexes are deleted."""
    known = [(i, f"{'fair' if i % 3 else 'foul'} word{i % 40}") for i in range(200)]
    docs, labels = table(spark, known), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in known], "doc_id long, toxic int")
    at, tables, jobs = common.shared_dir(spark).removeprefix("file://"), [], []
    for block in (10_000, 20):
        before = len(common._SCRATCH)
        spark.sparkContext.setJobGroup(f"blocks of {block}", "")
        assert toxicity.score(docs, labels, block=block).count() == 200
        tables.append(len(common._SCRATCH) - before)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"blocks of {block}")))
    assert tables[0] == tables[1] and jobs[0] == jobs[1]
    assert not [x for x in os.listdir(at) if x.startswith("toxicity-index")]


def test_tasks_hold_few_vectors_at_a_time(spark, monkeypatch):
    """A task's vectors are searched for in several parts, each against all blocks, with the same result."""
    rng = random.Random(4)
    vectors = [toxicity.packed({t: rng.randint(1, 3) for t in rng.sample(range(30), 4)}) for _ in range(60)]
    folder = common.scratch(spark, "toxicity-test")
    os.makedirs(folder.removeprefix("file://"))
    weight, parts = np.linspace(0.5, 2, 30), (vectors[:25], vectors[25:50], vectors[50:])
    for i, some in enumerate(parts):
        index = toxicity.Index([toxicity.unpacked(v) for v in some], [i] * len(some), [100 * i + j for j in range(len(some))], weight)
        token_files._write(f"{folder}/{i}.npz", index.dumped())
        token_files._write(f"{folder}/{i}.hashes", np.array([xxhash.xxh64_intdigest(v) for v in some], np.uint64).tobytes())
    rows = spark.createDataFrame([(v, 1, 0, 0) for v in vectors] + [(b"", 1, 0, 0)], "v binary, n long, own long, ones long").repartition(1)
    whole = toxicity.Index([toxicity.unpacked(v) for v in vectors], [0] * 60, [100 * i + j for i, some in enumerate(parts) for j in range(len(some))], weight)
    monkeypatch.setattr(toxicity, "HELD", 7)
    monkeypatch.setattr(toxicity, "QUERIES", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = {bytes(r["v"]): r for r in toxicity.nearest_of_all(rows, folder, len(parts), weight).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[b""]["names"] == [] and len(got) == len({*vectors, b""})
    for v in vectors:
        found, cosines = whole.nearest(*toxicity.unpacked(v), toxicity.K + 1)
        assert got[v]["names"] == whole.names[found].tolist() and np.allclose(got[v]["cosines"], cosines)
        assert [n for n, same in zip(got[v]["names"], got[v]["sames"], strict=True) if same] == [n for n, x in zip(whole.names.tolist(), vectors, strict=True) if x == v]


def test_packed_vectors_come_back():
    for v in ({}, {0: 1}, {70_000: 3}, {1: 70_000, 2: 300}, {255: 1, 256: 255, 600: 256}, {i: 1 for i in range(500)}):
        ids, counts = toxicity.unpacked(toxicity.packed(v))
        assert dict(zip(ids.tolist(), counts.tolist(), strict=True)) == v and sorted(v) == ids.tolist()


@pytest.mark.parametrize("name,label,least", [("op1_quality", "quality", 0.95), ("op4_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES[name](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(F.col(label).isNotNull()).collect()
    assert sum(r["predicted"] == r[label] for r in rows) >= least * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_all_labelled_rows_are_learnt_from(spark):
    """Scores, calibration and the nearest examples do not hang on how many examples a task holds at a time."""
    rng = random.Random(6)
    known = [(i, " ".join(rng.choices(["foul", "vile"] if i % 3 == 0 else ["fair", "kind"], k=3) + rng.choices([f"w{n}" for n in range(30)], k=5))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in known], "doc_id long, toxic int")
    docs = spark.createDataFrame([*known, (900, "foul kind w1"), (901, None), (902, "nothing")], "doc_id long, text string")
    a, b = ({r["doc_id"]: r for r in toxicity.score(docs, labels, "toxic", 0.5, most).collect()} for most in (40, 10_000))
    assert len(a) == 303 and a.keys() == b.keys()
    for i, r in a.items():
        assert (r["predicted"], r["evidence"]) == (b[i]["predicted"], b[i]["evidence"]) and abs(r["score"] - b[i]["score"]) < 1e-9


def test_nothing_is_rejected_without_labels(spark, labels, bench):
    docs = table(spark, ROWS)
    assert toxicity.accept(docs, labels.limit(0)).count() == len(ROWS)
    assert decontamination.clean(docs, bench.limit(0)).count() == len(ROWS)


def test_toxic_rows_take_no_other_row_along(spark):
    """A toxic and a clean row under a null doc_id, and under a repeated one."""
    known = [(i, f"{'fair' if i % 3 else 'foul'} word{i}") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in known], "doc_id long, toxic int")
    rows = [(None, "foul a"), (None, "fair b"), (None, "fair c"), (900, "foul d"), (900, "fair e"), (901, None), (901, "foul f"), (902, "foul g"), (902, "foul g")]
    docs = table(spark, known + rows)
    kept = [(r["doc_id"], r["text"]) for r in toxicity.accept(docs, labels).where("doc_id IS NULL OR doc_id >= 900").collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if not (r[1] or "").startswith("foul")], key=str)


def test_benchmark_passages_are_found(spark):
    """Against five-word runs, counted by brute force; the clean documents stay."""
    sf = "/root/testdata/sf0.001"
    items = {r["item_id"]: decontamination.words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    runs = {}
    for i, w in items.items():
        for k in range(len(w) - 4):
            runs.setdefault(tuple(w[k : k + 5]), set()).add(i)
    got = {r["doc_id"]: r["contaminated"] for r in queries.QUERIES["op7_decontamination"](spark, sf).collect()}
    for d in documents(spark, sf).collect():
        w, hits = decontamination.words(d["text"]), {}
        for k in range(len(w) - 4):
            for i in runs.get(tuple(w[k : k + 5]), ()):
                hits[i] = hits.get(i, 0) + 1
        share = max((n / (len(items[i]) - 4) for i, n in hits.items()), default=0)
        assert got[d["doc_id"]] == int(share > 0.5), (d["doc_id"], share)


def test_paraphrase_needs_its_answer(spark):
    item = " ".join(f"w{i}" for i in range(30))
    half = lambda answer: " ".join(f"w{i}" if i % 2 or answer and i > 25 else f"z{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "x " * 50 + item), (2, "y " * 50 + half(True)), (3, "y " * 50 + half(False)), (4, "q " * 90)], "doc_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontamination.search(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_paraphrases_without_their_rare_words_are_found(spark):
    """Items whose rarest 35% of words are replaced, set into real text: brute-force LCS over every passage of 500 documents."""
    sf, rng = "/root/testdata/sf0.01", random.Random(2)
    items = {r["item_id"]: decontamination.words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = [decontamination.words(r["text"])[:400] for r in documents(spark, sf).orderBy("doc_id").limit(500).collect()]
    df = {}
    for t in texts:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    planted = {}
    for k, (i, own) in enumerate(3 * list(items.items())):
        gone = set(sorted(range(len(own)), key=lambda p: (df.get(own[p], 0), rng.random()))[: int(0.35 * len(own))])
        at = rng.randrange(len(texts[k]) + 1)
        texts[k] = texts[k][:at] + [f"new{rng.randrange(9**9)}" if p in gone else w for p, w in enumerate(own)] + texts[k][at:]
        planted[k] = i
    holds, by = set(), {}
    for i, own in items.items():
        for w in own:
            by.setdefault(w, set()).add(i)
    for k, t in enumerate(texts):
        for i, own in items.items():
            n, mine = len(own), np.array([i in by.get(w, ()) for w in t], bool)
            for start in decontamination.passages(len(t)).tolist():
                lo, hi = max(0, start - n), start + decontamination.PASSAGE + n
                row = t[lo:hi]
                if k not in holds and mine[lo:hi].sum() >= n / 2 and (Counter(row) & Counter(own)).total() >= n / 2:
                    best = np.zeros(n + 1, int)
                    for w in row:  # by the textbook
                        best[1:] = np.maximum.accumulate(np.where(np.array(own) == w, best[:-1] + 1, best[1:]))
                    told = any(row[x : x + 4] == own[-4:] for x in range(len(row)))
                    if best[-1] >= 0.65 * n or (told and best[-1] >= 0.5 * n):
                        holds.add(k)
    assert set(planted) <= holds
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {r["doc_id"] for r in decontamination.search(docs, bench).where("contaminated = 1").collect()}
    assert got <= holds
    assert len(got) >= 0.95 * len(holds)  # a few have a cosine below COSINE


@pytest.mark.parametrize("items", [1, 10_000])
def test_blocks_of_items_change_nothing(spark, monkeypatch, items):
    """Repeated rows stay, an item without an id is searched, and it does not matter how many items a task is sent."""
    monkeypatch.setattr(decontamination, "ITEMS", items)
    text = lambda n, k: " ".join(f"{'abcd'[k]}{i}" for i in range(n))
    bench = spark.createDataFrame([(9, text(20, 0)), (None, text(25, 1)), (4, text(20, 0)), (7, "")], "item_id long, text string")
    rows = [(1, "x " * 40 + text(20, 0)), (1, "x " * 40 + text(20, 0)), (None, text(25, 1) + " y" * 30), (None, None), (2, "z " * 50)]
    got = [(r["doc_id"], r["contaminated"], r["item_id"]) for r in decontamination.search(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 4), (1, 1, 4), (None, 1, None), (None, 0, None), (2, 0, None)], key=str)


def test_the_space_is_fitted_on_every_document(spark):
    """What is found hangs on texts, not on which doc_ids they have; A'(A left) is that of all passages, also of long texts."""
    sf = "/root/testdata/sf0.01"
    docs, bench = documents(spark, sf).select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    a, b = ({r["doc_id"] % 10**6: r for r in decontamination.search(docs.withColumn("doc_id", F.col("doc_id") + n), bench).collect()} for n in (0, 10**6))
    assert a.keys() == b.keys() and any(r["lcs"] for r in a.values())
    for i, r in a.items():
        assert (r["contaminated"], r["item_id"]) == (b[i]["contaminated"], b[i]["item_id"]) and abs(r["cosine"] - b[i]["cosine"]) < 1e-4
    rng = np.random.default_rng(3)
    texts = [rng.integers(-1, 50, n).astype("<i4") for n in (0, 1, 16, 17, 33, 1024, 1040, 1041, 3000)]
    idf, left = rng.random(50) + 0.5, rng.standard_normal((50, 7))
    every = np.zeros((0, 50))
    for t in texts:
        rows = np.array([np.bincount(t[s : s + 32][t[s : s + 32] >= 0], minlength=50) for s in decontamination.passages(len(t)).tolist()]) * idf
        every = np.vstack([every, rows / np.maximum(np.sqrt((rows**2).sum(1, keepdims=True)), 1e-9)])
    rows = spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "ids binary")
    assert np.allclose(decontamination._summed(rows, idf, left), every.T @ (every @ left), atol=1e-3)


def test_no_pair_that_shares_common_words_is_left_out():
    """near() against the longest common subsequence of every item with every passage."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    draw = lambda n: rng.choices(words, weights, k=n)
    bench = decontamination.Benchmark([(i, " ".join(draw(rng.choice([1, 3, 10, 30, 70])))) for i in range(30)])
    terms = decontamination.Terms(bench.vocabulary)
    texts = [terms.of(" ".join(draw(rng.choice([0, 1, 17, 200])))) for _ in range(40)]
    bench.weigh({t: sum(t in x for x in texts) for t in range(len(bench.vocabulary))}, len(texts))
    searcher = decontamination.Searcher(bench, np.ones((len(bench.vocabulary), 1)))  # each cosine of a passage with a term is 1
    got = searcher.candidates(texts)
    assert searcher.search(texts) == list(map(searcher.best, texts, got))
    for t, ids in enumerate(texts):
        assert searcher.candidates([ids])[0].keys() <= got[t].keys()
        for i, own in enumerate(bench.rows):
            for start in decontamination.passages(len(ids)).tolist():
                row = ids[max(0, start - len(own)) : start + decontamination.PASSAGE + len(own)].tolist()
                term = (ids[start : start + decontamination.PASSAGE] >= 0).any()
                if term and decontamination.lcs(bench.masks[i], len(own), row) >= decontamination.COMMON * len(own):
                    assert (i, start) in got[t]


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_license_join_equals_brute_force(spark):
    """Templates with words left out, in any order and wrapped over lines, at any place of a text."""
    rng = random.Random(1)
    needed, reach = licenses._needed(licenses.TEMPLATES), licenses.REACH
    texts = [None, "", "one"]
    for _ in range(150):
        _, words, _ = rng.choice(needed)
        kept = [w for w in words if rng.random() < rng.choice([0.7, 0.85, 1.0])]
        rng.shuffle(kept)
        some = lambda: [f"n{rng.randrange(9)}" for _ in range(rng.randrange(3 * reach))]
        all_words = some() + kept + some() + ["Under", "the", "MIT", "License"] * rng.randrange(2) + some()
        texts.append("".join(w + rng.choice([" ", " ", "\n", ". ", "-"]) for w in all_words))
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), {"the": 5, "license": 3}).collect()
    assert sum(r["labels"] != r["base_labels"] for r in rows) > 20
    for r in rows:
        w = re.findall("[0-9a-z]+", (texts[r["doc_id"]] or "").lower())
        blocks = [set(w[i : i + 2 * reach]) for i in range(0, len(w), reach)]
        want = {label for label, words, need in needed if any(len(b & set(words)) >= need for b in blocks)}
        want |= {k for k, p in licenses.PHRASES.items() if f" {p} " in " " + " ".join(w) + " "}
        assert r["labels"] == ",".join(sorted(want)) and r["n_words"] == len(w)


def test_wrapped_license_texts_are_found(spark):
    """As they stand in files: wrapped at some 70 columns, behind comment marks, amid code."""
    texts = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:",
        "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0",
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
        "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or",
        "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "": "This file is free of charge. You may use it and copy it, and the license is not here.",
    }
    for before in (0, 37, 79, 101):
        rows = [(i, "int x = 1;\n" * before + "".join(f" * {line}\n" for line in t.split("\n")) + "return y;\n" * 60) for i, t in enumerate(texts.values())]
        got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), {}).collect()}
        assert [got[i] for i in range(len(texts))] == list(texts)


def test_pipeline(spark, sf):
    docs = documents(spark, sf)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secret_scan", "packing"]
    out = corpus_pipeline.run(spark, sf)
    ids = {r[0] for r in out.select("doc_id").distinct().collect()}
    toxic = {r["doc_id"] for r in queries.QUERIES["op4_toxicity"](spark, sf).where("predicted = 1").collect()}
    assert ids and not ids & toxic and ids <= {r[0] for r in docs.select("doc_id").collect()}
    bad = {r["doc_id"] for r in queries.QUERIES["op7_decontamination"](spark, sf).where("contaminated = 1").collect()}
    assert not ids & bad
