import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmill.llm import bpe, decontaminate, hashing, jpeg, langid, lattice, neardup, queries, secrets, substrings, token_counts, toxicity
from quillmill.llm.common import remainder

SF = "/root/testdata/sf0.001"
#: Null id, null and empty texts, white space alone, repeated rows, a shared id; a column whose name clashes.
ODD = [(1, None, "a", "z"), (2, "", "a", "z"), (3, " \t\n", None, "z"), (None, "one two three four five six", "b", "z"), (4, "Word", "b", "z"), (4, "Word", "b", "z"), (5, "word", "a", "z"), (5, "other text here", "a", "z"), (6, "ä" * 5000 + " x", "a", "z")]
SHAPE = "doc_id long, text string, source string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SHAPE)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


# ---- media


def test_payloads_come_back():
    rng = random.Random(1)
    payloads = [rng.randbytes(64 * rng.randint(1, 40)) for _ in range(30)] + [b"\xff" * 640, bytes(64), rng.randbytes(64 * 8192)]
    found = jpeg.thumbnails(jpeg.pack(payloads))
    assert [b"".join(g.tobytes() for *_, g in f) for f in found] == payloads
    assert len(found[-1]) == 2
    with pytest.raises(ValueError):
        jpeg.pack([b"x"])


def bits_of(value, n):
    return [(value >> i) & 1 for i in reversed(range(n))]


def plain_jpeg(blocks, order, tall, wide, restart=0, sampling=((1, 1),)):
    """A slow encoder: blocks is a list of (component, [64 coefficients]) in scan order, units of ``order`` blocks."""
    dc = {s: (s, 4) for s in range(12)}
    symbols = sorted({0, 0xF0} | {r << 4 | s for r in range(16) for s in range(1, 6)})
    ac = {s: (i, 8) for i, s in enumerate(symbols)}
    out, bits, last = bytearray(), [], Counter()

    def flush():
        nonlocal bits
        bits += [1] * (-len(bits) % 8)
        for i in range(0, len(bits), 8):
            b = int("".join(map(str, bits[i : i + 8])), 2)
            out.append(b)
            if b == 255:
                out.append(0)
        bits = []

    def number(v, s):
        return bits_of(v if v > 0 else v + (1 << s) - 1, s)

    for n, (comp, coef) in enumerate(blocks):
        unit = n // order
        if restart and n % order == 0 and unit and unit % restart == 0:
            flush()
            out += bytes([255, 0xD0 + (unit // restart - 1) % 8])
            last.clear()
        d = coef[0] - last[comp]
        last[comp] = coef[0]
        s = abs(d).bit_length()
        bits += bits_of(*dc[s]) + number(d, s)
        run = 0
        end = max((i for i in range(1, 64) if coef[i]), default=0)
        for v in coef[1 : end + 1]:
            if not v:
                run += 1
                continue
            while run > 15:
                bits += bits_of(*ac[0xF0])
                run -= 16
            s = abs(v).bit_length()
            bits += bits_of(*ac[run << 4 | s]) + number(v, s)
            run = 0
        if end < 63:
            bits += bits_of(*ac[0])
    flush()
    seg = lambda m, b: bytes([255, m]) + (len(b) + 2).to_bytes(2, "big") + b
    counts = lambda n, k: bytes([n if i == k else 0 for i in range(1, 17)])
    frame = b"\x08" + tall.to_bytes(2, "big") + wide.to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling))
    scan = bytes([len(sampling)]) + b"".join(bytes([k + 1, 0]) for k in range(len(sampling))) + b"\0\x3f\0"
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + b"\x10" * 64) + seg(0xC4, b"\0" + counts(12, 4) + bytes(range(12))) + seg(0xC4, b"\x10" + counts(len(symbols), 8) + bytes(symbols)) + (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"") + seg(0xC0, frame) + seg(0xDA, scan) + bytes(out) + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 3])
def test_images_with_ac_coefficients_and_subsampling(restart):
    rng = random.Random(restart)
    coefs = lambda: [rng.randint(-60, 60)] + [rng.choice([0] * 9 + [rng.randint(-20, 20)]) for _ in range(63)]
    grey = [(0, coefs()) for _ in range(4 * 3)]
    colour = [(k, coefs()) for _ in range(2 * 2) for k in (0, 0, 0, 0, 1, 2)]
    a, b = jpeg.thumbnails([plain_jpeg(grey, 1, 24, 32, restart), plain_jpeg(colour, 6, 32, 32, restart, ((2, 2), (1, 1), (1, 1)))])
    level = lambda c: min(255, max(0, (c[0] * 16 + 4 >> 3) + 128))
    assert a[0][2].ravel().tolist() == [level(c) for _, c in grey]
    luma = [level(c) for k, c in colour if k == 0]
    want = np.zeros((4, 4), int)
    for u in range(4):
        for j in range(4):
            want[2 * (u // 2) + j // 2, 2 * (u % 2) + j % 2] = luma[4 * u + j]
    assert b[0][2].tolist() == want.tolist()


def test_broken_images_are_null(spark):
    good = jpeg.pack([bytes(range(64))])[0]
    df = spark.createDataFrame([(1, good), (2, good[:-9]), (3, None), (4, b"GIF"), (5, good.replace(b"\xff\xc0", b"\xff\xc2"))], "doc_id long, media binary")
    got = {r.doc_id: r.width for r in jpeg.image_features(df).collect()}
    assert got == {1: 512, 2: None, 3: None, 4: None, 5: None}


def test_op1(spark, texts):
    for r in queries.op1_jpeg(spark, SF).collect():
        raw = jpeg.padded(texts[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))


def test_media_of_odd_texts(spark, odd):
    got = jpeg.digest(odd).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_sha256) for r in got) == sorted((i or 0, len((t or "").encode()), hashlib.sha256(jpeg.padded((t or "").encode())).hexdigest()) for i, t, *_ in ODD)
    assert len({r.media_sha256 for r in got if r.n_bytes == 0}) == 1 and jpeg.digest(odd.limit(0)).count() == 0


# ---- language and toxicity


def test_op2_holds_out(spark, docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in queries.op2_compression_langid(spark, SF).collect() if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.9 * len(held)


def test_language_of_odd_texts(spark, odd, docs):
    model = langid.fit(docs, remainder("doc_id", 5) != 0)
    got = langid.classify(odd, model).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(r.lang_pred != "und" and 0 <= r.score <= 1 for r in got if r.doc_id in (4, 5, 6))
    assert langid.keep_known(odd, model, 0.005).count() == len(ODD) - 4  # the long run of one letter is in no language
    none = langid.fit(docs.limit(0), remainder("doc_id", 5) != 0)
    assert {r.lang_pred for r in langid.classify(odd, none).collect()} == {"und"}


def test_language_by_plain_compression(spark, docs):
    import zstandard

    model = langid.fit(docs, remainder("doc_id", 5) != 0)

    def size(text, content):
        raw, total = text.lower().encode(), 0
        for i in range(0, len(raw), 1024):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=6)
            total += len(zstandard.ZstdCompressor(level=6, dict_data=dictionary, write_content_size=False).compress(raw[i : i + 1024]))
        return total

    for r in langid.classify(docs.where("doc_id % 9 = 0"), model).join(docs.select("doc_id", "text"), "doc_id").collect():
        got = sorted((size(r.text, c), k) for k, c in enumerate(model.content))
        assert (r.lang_pred, r.score) == (model.names[got[0][1]], pytest.approx(1 - got[0][0] / got[1][0])) or not r.text


def all_segments(scores):
    """Maximal scoring segments by the definition: the best one, then the best in what is left on either side."""
    if not scores:
        return []
    total, _, i, j = max((sum(scores[i:j]), i - j, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))
    if total <= 0:
        return []
    return [(a, b) for a, b in all_segments(scores[:i])] + [(i, j)] + [(a + j, b + j) for a, b in all_segments(scores[j:])]


def test_segments_by_definition():
    rng = random.Random(4)
    for _ in range(60):
        hot = {f"w{i}": rng.choice([0.5, 1.25, 3.0]) + rng.random() / 64 for i in range(4)}
        tokens = [rng.choice([*hot, "-", "-", "-"]) for _ in range(rng.randint(0, 14))]
        table = toxicity.WordScores({f"{w} ": s for w, s in hot.items()})
        got = toxicity.segments(tokens, table, -0.7)
        assert [(a, b) for a, b, _ in got] == all_segments([hot.get(t, -0.7) for t in tokens])


def test_toxicity_learns_and_survives(spark, odd):
    rows = [(i, f"calm words number{i} here " * 20 + ("you vile scoundrel vile " * 4 if i % 8 == 0 else ""), int(i % 8 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, remainder("doc_id", 4) != 2)
    truth = {i: y for i, _, y in rows}
    got = toxicity.scan(docs, model).collect()
    assert all(r.predicted == truth[r.doc_id] for r in got)
    assert all(0 <= r.score <= 1 for r in toxicity.scan(odd, model).collect())
    blank = toxicity.fit(docs, labels.limit(0), remainder("doc_id", 4) != 2)
    assert len({r.score for r in toxicity.scan(odd, blank).collect()}) == 1


def test_op3_on_held_out_rows(spark):
    """Some labels are noise: marked texts without any marked word. Measured: area 0.9085, 99 of 120 found, 12 of 870 wrongly."""
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op3_segment_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    hot, cold = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in hot for b in cold) / (len(hot) * len(cold))
    assert hot and auc >= 0.88 and sum(s >= 0.3 for s in cold) <= 0.03 * len(cold)


def test_toxicity_of_no_documents(spark, odd):
    labels = spark.createDataFrame([(4, 1), (6, 0)], "doc_id long, toxic int")
    empty = odd.limit(0)
    assert toxicity.scan(empty, toxicity.fit(empty, labels, remainder("doc_id", 4) != 9)).count() == 0


# ---- language model


def test_lattice_sums_all_segmentations():
    pieces = (lattice.MARK, "a", "b", "ab", lattice.MARK + "a", "ba")
    model = lattice.Pieces(pieces, tuple(math.log(x) for x in (0.1, 0.2, 0.15, 0.1, 0.1, 0.05)), (math.log(0.3 / 256),) * 256, math.log(0.001))
    use = lattice.Lattice(model)

    def total(word):
        if not word:
            return 1.0
        spelled = math.exp(use.spelled(word[0])) * total(word[1:])
        return spelled + sum(math.exp(p) * total(word[len(x) :]) for x, p in zip(pieces, model.logs) if word.startswith(x))

    words = ["a", "ab", "abba", "é", "aabb"]
    want = [math.log(total(lattice.MARK + w)) for w in words]
    assert use.log_probabilities([w.encode() for w in [*words, *words]])[:5] == pytest.approx(want)
    assert [use.one(lattice.MARK + w) for w in words] == pytest.approx(want)
    uses, spent = use.expected([b"ab", b"ab"], np.ones(2))
    assert uses.sum() > 0 and spent.sum() > 0


def test_op4(spark, docs, texts):
    split = {i: t.encode().lower().split() for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in split}
    seen = Counter(w for i, x in split.items() if not held[i] for w in x)
    ends = sum(not h for h in held.values())
    n, v = sum(seen.values()) + ends, len(seen) + 1
    d = lattice.with_hold_out(docs, remainder("doc_id", 7) == 2)
    for r in lattice.score(d, lattice.fit(d), shipped_words=50).collect():  # most words go by the join
        x = split[r.doc_id]
        base = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in x) + math.log10((ends + 1) / (n + v + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(x) + 1, sum(seen[w] > 0 for w in x) + 1, n)
        assert r.base_score == pytest.approx(base) and r.score < 0


def test_op4_scores_are_the_words_own(spark, docs, texts):
    d = lattice.with_hold_out(docs, remainder("doc_id", 7) == 2)
    corpus = lattice.fit(d)
    known = {bytes(r.word): r.log10_p for r in corpus.words.collect()}
    for r in lattice.score(d, corpus, shipped_words=50).collect():
        assert r.score == pytest.approx(corpus.end_log10 + sum(known[w] for w in texts[r.doc_id].encode().lower().split()))
    assert sum(10**x for x in known.values()) + 10**corpus.end_log10 <= 1 + 1e-9


def test_language_model_of_odd_texts(spark, odd):
    d = lattice.with_hold_out(odd, remainder("doc_id", 7) == 2)
    got = lattice.score(d, lattice.fit(d)).collect()
    assert len(got) == len(ODD) and all(r.n_tokens == 1 for r in got if r.doc_id in (1, 2, 3)) and all(math.isfinite(r.score) for r in got)
    empty = d.limit(0)
    assert lattice.score(empty, lattice.fit(empty)).count() == 0


# ---- benchmark and secrets


def test_op5(spark, texts):
    import re

    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
    grams = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = find(r.text or "")
        for i in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[i : i + 10]), set()).add(str(r.item_id))
    for r in queries.op5_decontaminate(spark, SF).collect():
        w, hit, items = find(texts[r.doc_id]), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    items |= grams[g]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_decontamination_of_odd_texts(spark, odd, limit):
    bench = spark.createDataFrame([(1, "Word!"), (2, "two three four"), (3, None), (4, "")], "item_id long, text string")
    got = decontaminate.report(odd, bench, broadcast_bytes=limit).collect()
    assert sorted((r.doc_id or 0, r.n_hit, tuple(r["items"])) for r in got) == [(0, 3, ("2",)), (1, 0, ()), (2, 0, ()), (3, 0, ()), (4, 1, ("1",)), (4, 1, ("1",)), (5, 0, ()), (5, 1, ("1",)), (6, 0, ())]
    left = decontaminate.clean(odd, bench, broadcast_bytes=limit).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left if r.text and len(r.text) < 99) == [(0, "one five six"), (3, " \t\n"), (5, "other text here")]
    assert decontaminate.report(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.report(odd.limit(0), bench).count() == 0


def test_secrets(spark):
    key, wide, own = "AKIA" + "Z" * 16, "abcdef0123456789abcdef", "Zx9" + "qR7" * 8
    rows = [(i, f'É token = "{wide}" x', f"s{i}") for i in range(4)] + [(9, f"password: {key}; secret=short {own}", "s1"), (9, f"password: {key}; secret=short {own}", "s1"), (10, None, "s1"), (11, "token: secret: abcdefghijklmnopqr", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.report(df).collect()}
    assert got[0].spans == f"assign:2:{11 + len(wide)},hex:11:{11 + len(wide)}" and (got[0].n_live, got[0].n_example) == (0, 2)
    assert got[9].spans.startswith("assign:0:30,access:10:30,random:") and got[9].n_live == 3
    assert got[10].spans == "" and got[11].n_assign == 0
    masked = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert masked[9] == "password: [secret]; secret=short [secret]" and masked[0] == rows[0][1]
    assert secrets.report(df).count() == len(rows)


BASE = [
    ("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", r"(AKIA[A-Z0-9]+)", 18),
    ("hex", r"([0-9a-f]+)", 16),
]


def test_op6_by_plain_patterns(spark, texts):
    import re

    for r in queries.op6_secret_ownership(spark, SF).collect():
        found = []
        for k, (kind, pattern, least) in enumerate(BASE):
            found += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, texts[r.doc_id], re.I | re.A if kind == "assign" else re.A) if len(m[1]) >= least]
        shown = [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest() and set(shown) <= set(r.spans.split(",") if r.spans else [])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[2] == kind for x in found) for kind, *_ in BASE)


def test_secrets_of_odd_texts(spark, odd):
    got = secrets.report(odd).collect()
    assert len(got) == len(ODD) and all((r.spans, r.n_live, r.n_example) == ("", 0, 0) for r in got)
    assert sorted((r.doc_id or 0, r.text or "") for r in secrets.redact(odd).collect()) == sorted((i or 0, t or "") for i, t, *_ in ODD)
    assert secrets.report(odd.limit(0)).count() == secrets.redact(odd.limit(0)).count() == 0
    long = spark.createDataFrame([(None, "x " * 200_000 + 'token="abcdefghijkl0123456789"', None)], "doc_id long, text string, source string")
    assert secrets.report(long).first().spans == "assign:400000:400029"


# ---- near duplicates


def test_signatures_follow_the_definition():
    values = np.sort(np.random.default_rng(1).integers(0, 2**63, 20, dtype=np.uint64))
    want = np.full(128, np.iinfo(np.uint64).max, np.uint64)
    for rank in range(128):
        seed = hashing.mix(values ^ np.uint64(0xA0761D6478BD642F))
        at = (seed + np.uint64(rank) * ((seed >> np.uint64(16)) & np.uint64(127) | np.uint64(1))) & np.uint64(127)
        part = hashing.mix(seed + np.uint64((rank + 1) * 0xE7037ED1A0B428DB % 2**64)) >> np.uint64(24)
        for k, x in zip(at, np.uint64(rank << 40) | part):
            want[int(k)] = min(want[int(k)], x)
    assert neardup.signatures(values, np.array([0, 20]))[0].tolist() == want.tolist()


def linked(texts, size=2):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        return i if root[i] == i else top(root[i])

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_op7(spark, texts):
    want = linked(texts)
    got = queries.op7_superminhash(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_texts_and_chains(spark, odd):
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 999)}" for _ in range(60)]
    rows = {}
    for i in range(40):  # a chain of edits: neighbours are linked, ends are not
        rows[100 + i] = " ".join(base)
        base[rng.randrange(60)] = f"w{rng.randint(0, 999)}"
    got = {r.doc_id: r.component_id for r in neardup.link(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in linked(rows).items()}
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.link(odd).collect()]
    assert len(found) == len(ODD) and (None, 5, None, True) in found and found.count((4, 1, 4, True)) == 2 and (5, 1, 4, False) in found
    assert neardup.link(odd.limit(0)).count() == 0


def thue_morse(n):
    plain = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return plain, plain.translate(str.maketrans("ab", "ba"))


def test_words_of_a_regular_build_are_told_apart(spark):
    one, other = thue_morse(1024)
    same = " ".join(f"w{i}" for i in range(17))
    df = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.link(df).collect()} == {1: 1, 2: 2}
    df = spark.createDataFrame([(1, f"{same} {one} {same}"), (2, f"{same} {other} {same}")], "doc_id long, text string")
    assert [r.n_removed for r in substrings.remove_repeats(df).collect()] == [0, 0]


@pytest.mark.parametrize("tile", [16, 1024])
def test_near_duplicates_around_the_threshold(spark, tile):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = {}
    for i in range(500):  # most pairs have a similarity from 0.7 to 0.9
        words = list(base)
        for at in rng.sample(range(80), rng.choice([1, 2, 3, 4, 4, 5, 5, 6])):
            words[at] = f"x{rng.randint(0, 40)}"
        rows[i] = " ".join(words)
    want = linked(rows)
    assert len({c for _, c in want.values()}) > 20
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.link(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), tile=tile).collect()}
    assert got == want


def test_ids_of_any_type(spark, odd):
    named = odd.withColumn("doc_id", F.concat(F.lit("d-"), F.col("doc_id").cast("string")))
    bench = spark.createDataFrame([("q", "two three four")], "item_id string, text string")
    found = {(r.doc_id, r.component_id) for r in neardup.link(named).collect()}
    assert ("d-5", "d-4") in found and (None, None) in found and ("d-2", "d-2") in found
    assert neardup.keep_one(named).where("doc_id = 'd-4'").count() == 1
    assert {r.doc_id: r.n_hit for r in decontaminate.report(named, bench).collect()}[None] == 3
    assert decontaminate.clean(named, bench).count() == len(ODD) and secrets.report(named).count() == len(ODD) and secrets.redact(named).columns == named.columns
    d = lattice.with_hold_out(named, remainder("doc_id", 7) == 2)
    assert lattice.score(d, lattice.fit(d)).count() == len(ODD) == substrings.remove_repeats(named).count() == jpeg.digest(named).count()


# ---- tokens


def test_trees_encode_as_the_whole():
    rng = random.Random(2)
    whole = bpe.Codec(open(bpe.default_vocabulary(), "rb").read(), bpe.default_pattern())
    tree = bpe.Codec(open(bpe.default_vocabulary(), "rb").read(), bpe.default_pattern(), leaf=3)
    for _ in range(3000):
        text = "".join(rng.choice("ab'slerv  \n\t1.é中\x1c ") for _ in range(rng.randint(0, 40)))
        ids = tree.encode(text)
        assert ids == whole.plain(text) and tree.decode(ids).decode() == text


def test_op8_and_odd_texts(spark, texts, odd):
    plain = bpe.Codec(open(bpe.default_vocabulary(), "rb").read(), bpe.default_pattern()).plain
    for r in queries.op8_byte_bpe(spark, SF).collect():
        ids = plain(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    back = sorted((r.doc_id or 0, r.text) for r in bpe.decode(bpe.encode(odd)).collect())
    assert back == sorted((i or 0, t or "") for i, t, *_ in ODD)


def test_token_histogram(spark, texts):
    plain = bpe.Codec(open(bpe.default_vocabulary(), "rb").read(), bpe.default_pattern()).plain
    sizes = sorted(len(plain(t)) for t in texts.values())
    sums = queries.op9_token_counts(spark, SF).cache()
    for r in sums.collect():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (sizes.count(r.length), sum(s >= r.length for s in sizes), sum(s for s in sizes if s >= r.length))
        assert (r.truncated_total, r.cut_docs, r.rank_at_most) == (sum(min(s, r.length) for s in sizes), sum(s > r.length for s in sizes), sum(s <= r.length for s in sizes))
    got = {r.q: r.length for r in token_counts.quantiles(sums, [0.5, 1.0]).collect()}
    assert got == {0.5: sizes[math.ceil(0.5 * len(sizes)) - 1], 1.0: sizes[-1]}
    assert token_counts.truncated_totals(sums, [100]).first().truncated_total == sum(min(s, 100) for s in sizes)


def test_tokens_of_odd_texts(spark, odd):
    assert bpe.round_trip(odd.limit(0)).count() == bpe.encode(odd.limit(0)).count() == token_counts.suffix_sums(token_counts.histogram(odd.limit(0))).count() == 0
    plain = bpe.Codec(open(bpe.default_vocabulary(), "rb").read(), bpe.default_pattern()).plain
    sizes = Counter(len(plain(t or "")) for _, t, *_ in ODD)
    assert {r.length: r.n_docs for r in token_counts.histogram(odd).collect()} == sizes
    assert [r.text for r in bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()] == [""]
    other = r"\s+|\S+"
    assert {r.doc_id: r.n_tokens for r in bpe.encode(odd, pattern=other).collect()}[2] == 0


# ---- substrings


@pytest.mark.parametrize("window", [4, 7, 8])
def test_repeats_against_brute_force(spark, window):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 25))) if rng.random() < 0.95 else None) for i in range(50)] + [(3, "a b c d e f g h i j k")] * 2 + [(None, "q r s t u v w x y z")]
    seen = Counter()
    for _, t in rows:
        w = (t or "").split()
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    want = []
    for d, t in rows:
        w = (t or "").split()
        hit = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        want.append((d or -1, len(w), len(hit), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in hit).encode()).hexdigest()))
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect()
    flat = lambda rs: sorted((str(d), n, k, h) for d, n, k, h in rs)
    assert flat((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == flat((d, *rest) for (d, _), (_, *rest) in zip(rows, want))


def test_repeats_of_odd_texts(spark, odd):
    got = substrings.remove_repeats(odd).collect()
    assert len(got) == len(ODD) and all(r.n_removed == 0 for r in got)
    assert substrings.remove_repeats(odd.limit(0)).count() == 0


# ---- whole jobs


def test_last_round_takes_pairs_of_one_shared_band(spark):
    core = [f"c5x{i}" for i in range(8)]  # the least shingle is one of these in all texts
    texts = [" ".join([*core, *(f"f{k}x{i}" for i in range(3))]) for k in range(60)] + [" ".join([*core, "p", "q", "r", x]) for x in "st"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # a signature of one place in one band: a pair can share one band at most, and none of the leaders is like it
    got = {r.doc_id: r.component_id for r in neardup.link(docs, places=1, bands=1, leaders=2, tile=7).collect()}
    assert got[60] == got[61] == 60 and all(got[k] == k for k in range(60))


def test_all_sampled_texts_serve_in_the_dictionary(spark):
    docs = spark.createDataFrame([(i, "a" * 900 + f" t{i} " * 200, "x") for i in range(100)], "doc_id long, text string, lang string")
    content = langid.fit(docs, F.lit(True), dict_bytes=8000).content[0]
    assert len(content) <= 8000 and content.count(b"\n") >= 60
    assert sum(f" t{i} ".encode() in content for i in range(100)) > 30
    assert langid._joined([b"abcdef", b"z", b"ghijkl"], 11) == b"abc\nz\nghi"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    show = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert show(got) == show(want)


# ---- pipeline


def test_pipeline_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "near-duplicates", "benchmark decontamination", "secret scan", "byte-level BPE"]
    now, kept = docs, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SF)
        if k < 4:
            assert out.columns == docs.columns
        kept.append(out.count())
        now = out
    assert kept == sorted(kept, reverse=True) and kept[1] >= 0.95 * kept[0]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == sorted(r.doc_id for r in now.select("doc_id").collect())


def test_pipeline_of_odd_rows(spark, docs):
    plain = " ".join(docs.where("lang = 'en' AND length(text) > 3000").orderBy("doc_id").first().text.split()[:60])
    rows = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (None, plain, "en", None, 24), (10**6 + 2, plain, "en", "s", 1), (10**6 + 2, plain, "en", "s", 1), (10**6 + 3, "12345 !", "en", "s", 7), (10**6 + 4, " ".join(random.Random(3).choices(plain.split(), k=30_000)), "en", "s", 9)]
    full = docs.limit(20).unionByName(spark.createDataFrame(rows, docs.schema)).withColumn("component", F.lit("kept")).withColumn("mark", F.lit(1))
    now = full
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, SF)
        if k < 4:
            assert now.columns == full.columns and now.where("component <> 'kept' OR mark <> 1").count() == 0
        left = [r.doc_id for r in now.select("doc_id").collect() if r.doc_id is None or r.doc_id >= 10**6]
        # texts without a letter go by language; of the equal ones the least id stays, once
        assert sorted(x for x in left if x) == ([10**6 + 2, 10**6 + 2, 10**6 + 4] if k == 0 else [10**6 + 2, 10**6 + 4]) and left.count(None) == (k == 0)
    now = full.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0
