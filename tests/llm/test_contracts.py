"""Each operator against a plain, slow version written from its contract, on real and odd rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from cloakwork.llm import decontaminate, pages, personal, rules, simhash, substrings, tokens, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "δelta", "e", "über", "12", "x9"]) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of sf0.001 and odd ones: null, empty, spaces, one word, long, copies, near copies, repeats inside."""
    real = pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]]
    items = pd.read_parquet(f"{SF}/benchmark.parquet").text.tolist()
    rng = random.Random(3)
    base, passage = fill(rng, 220), fill(rng, 60)
    near = base.split(" ")
    odd = [None, "", " \t\n ", "one", "a b", "a b c d", base, base, base.replace("alpha", "ALPHA"), " ".join([*near[:100], "changed", *near[101:]])]
    odd += [fill(rng, 30) + " " + passage + " " + fill(rng, 30) for _ in range(4)]
    odd += [passage + " tail", passage + "\n" + passage, "same " * 300, fill(rng, 20) + "\x85\xa0 \x1c" + fill(rng, 50), "<|endoftext|> a 漢字 😀 text́", "x" * 5000]
    odd += [fill(rng, 15) + " " + t.upper() + " " + fill(rng, 5) for t in items[:6]] + [" ".join(re.findall(r"\S+", items[7])[3:14]), fill(rng, 20_000), "line a b\nline a b\n\nline a b\n#*$%"]
    odd += ["mail a.b@c.d.e and x@y and @z.q 1.2.3.4.5.6.7.8 999.1.1.1 01.02.03.004 10.0.0.255", "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 41111111111111110000", "call +1 (415) 555-2671 or +12 34 or +4 9 (0) 30 1234567890123456 iban DE89 3704 0044 0532 0130 00 end", 'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" ssn 123-45-6789 😀 a@b.c']
    frame = pd.concat([real, pd.DataFrame({"doc_id": range(10_000, 10_000 + len(odd)), "text": odd})], ignore_index=True)
    rows = [(int(i), t if isinstance(t, str) else None) for i, t in zip(frame.doc_id, frame.text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("fp", "n", "path", "key", "words", "rule", "mh", "w")})
    return df.repartition(5), dict(rows)


def test_simhash(docs):
    df, rows = docs

    def print_of(text):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = WORD.findall(text)
        if not w:
            return 0
        grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
        h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    ids = sorted(rows)
    p = {i: print_of(rows[i]) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (p[a] ^ p[b]).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.report(df).collect()}
    assert got == {i: (f"{p[i]:016x}", find(i)) for i in ids}
    split = {r.doc_id: r.component_id for r in simhash.report(df, simhash.Settings(group=2, hot=8)).collect()}
    assert split == {i: find(i) for i in ids}  # more blocks and split groups change nothing
    kept = sorted(r.doc_id for r in simhash.keep_first(df.union(df.filter("doc_id < 7"))).collect())
    assert kept == sorted(set(find(i) for i in ids))


def test_keep_first_chooses_rows(spark):
    rng = random.Random(5)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (5, c), (5, d), (5, d), (None, d), (7, e), (6, e), (6, a + " ")]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text.strip()) for r in got) == Counter([(6, a), (None, b), (5, c), (5, d), (6, e)])


def test_simhash_close_codes(spark):
    rng = random.Random(5)
    codes = [0, 2**64 - 1]
    for _ in range(40):
        c = rng.getrandbits(64)
        codes += [c] + [c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))) for _ in range(12)]
    codes = sorted(set(codes))
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    root = {c: c for c in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(codes):
        for j in range(i):
            if (a ^ codes[j]).bit_count() <= 4:
                x, y = find(signed[i]), find(signed[j])
                root[max(x, y)] = min(x, y)
    for s in (simhash.Settings(), simhash.Settings(hot=6), simhash.Settings(group=1)):
        df = spark.createDataFrame([(c,) for c in signed], "fp long").repartition(3)
        found = {r.u: r.root for r in simhash.components(simhash.links(df, s)).collect()}
        assert {c: found.get(c, c) for c in signed} == {c: find(c) for c in signed}


def test_decontaminate(spark, docs):
    df, rows = docs
    items = [(r.item_id, r.text) for r in pd.read_parquet(f"{SF}/benchmark.parquet").itertuples()] + [(900, None), (901, "!!"), (902, "Alpha1 beta2"), (903, rows[10_006][:400])]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    lengths = {len(w) for w in windows}

    def want(text):
        w, hit, found = cut(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (at := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= at
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)

    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("gram", F.lit("clash"))
    expected = {i: want(t) for i, t in rows.items()}
    assert sum(x[4] for x in expected.values()) > 6
    for s in (decontaminate.Settings(), decontaminate.Settings(broadcast_windows=3)):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(df, bench, s).collect()}
        assert got == expected
    kept = decontaminate.drop_contaminated(df, bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in expected.items() if not x[4]) and kept.columns == df.columns
    assert {r.contaminated for r in decontaminate.report(df, bench.limit(0)).collect()} == {False}
    assert decontaminate.report(df.limit(0), bench).count() == 0
    cleaned = {r.doc_id: r.cleaned for r in decontaminate.cut_spans(df, bench).collect()}
    assert all(not want(cleaned[i])[4] or x[4] for i, x in expected.items()) and cleaned[10_006] != rows[10_006]


def test_warc(spark):
    real = [(r.page_id, r.url, r.html) for r in pd.read_parquet(f"{SF}/pages.parquet").itertuples()]
    odd = [(900, "u\r\nx", None), (901, None, ""), (902, "u", "same é"), (903, "u", "same é"), (12_000, "u", real[0][2]), (904, "u", "y" * 3_000_000)]
    rows = real + odd
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1)).withColumn("refers_to", F.lit("clash")).repartition(3)
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    for least in (0, 10):
        want = set()
        for i, _, h in rows:
            p, f = (h or "").encode(), first[h or ""]
            copy = f != i and len(p) >= least
            want.add((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if copy else "response", f if copy else None))
        got = [tuple(r) for r in warc.round_trip(df, warc.Settings(revisit_from=least, file_bytes=50_000)).collect()]
        assert len(got) == len(rows) and set(got) == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_repeated_ids(spark):
    rows = [(3, "u", "A"), (7, "v", "A"), (7, "v", "B"), (2, "w", "C"), (8, "x", "A"), (8, "x", "C")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = [(3, "A", "response", None), (7, "A", "revisit", 3), (7, "B", "response", None), (2, "C", "response", None), (8, "A", "revisit", 3), (8, "C", "revisit", 2)]
    sha = {x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode() for x in "ABC"}
    assert Counter((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter((i, sha[x], k, f) for i, x, k, f in want)


def test_warc_salvage():
    import io

    records = [warc.record("response", f"urn:x-page:{i}", "http://a/", b"HTTP/1.1 200 OK\r\n\r\n" + bytes([65 + i]) * (200 + i)) for i in range(6)]
    for packed in (True, False):
        parts = [warc.member(r) if packed else r for r in records]
        starts = [sum(map(len, parts[:i])) for i in range(7)]
        whole = b"".join(parts)
        assert [r.headers["warc-record-id"][-2] for r in warc.read(io.BytesIO(whole))] == list("012345")
        bad = bytearray(whole)
        bad[starts[1] + len(parts[1]) // 2] ^= 0x55  # a flipped byte in one, the next cut in half
        cut = bytes(bad[: starts[4] - len(parts[3]) // 2]) + b"noise WARC/1.0 \x1f\x8b\x08 noise" + bytes(bad[starts[4] :])
        got = list(warc.read(io.BytesIO(cut)))
        assert [r.headers["warc-record-id"][-2] for r in got if not r.gap] == list("0245")
        gaps = [(r.offset, r.length) for r in got if r.gap]
        assert gaps[0] == (starts[1], len(parts[1])) and gaps[1][0] == starts[3]
        assert sum(r.length for r in got) == len(cut)
        assert [bool(r.gap) for r in warc.read(io.BytesIO(whole[: starts[2] + 50]))] == [False, False, True]
    assert list(warc.read(io.BytesIO(b""))) == [] and [r.gap != "" for r in warc.read(io.BytesIO(b"junk" * 1000))] == [True]


def test_rules(spark, docs):
    df, rows = docs
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    def want(t):
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        seen, dup = set(), 0
        for x in t.split("\n"):
            dup += bool(WORD.search(x)) and x in seen
            seen.add(x)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)

    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.judge(df, labels).collect()}
    assert got == {i: want(t) for i, t in rows.items()}
    assert rules.repeated_words([str(i % 3000) for i in range(40_000)]) == 40_000 and rules.repeated_words([str(i) for i in range(9000)]) == 0
    for none in (labels.limit(0), labels.withColumn("quality", F.lit(None).cast("int"))):
        assert all(r.kept == (not r.base_failed) for r in rules.judge(df, none).collect())
    assert rules.judge(df.limit(0), labels).count() == 0


def test_personal(docs):
    df, rows = docs

    def luhn(d):
        x = [int(c) for c in d[::-1]]
        return (sum(x[::2]) + sum(sum(divmod(2 * c, 10)) for c in x[1::2])) % 10 == 0

    pattern = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(re.sub("[ -]", "", v)) <= 19 and luhn(re.sub("[ -]", "", v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
    }

    def want(t):
        spans = {k: [m.span() for m in re.finditer(p, t or "") if ok(m[0])] for k, (p, ok) in pattern.items()}
        joined = ",".join(f"{k}:{a}:{b}" for k in pattern for a, b in spans[k])
        return *(len(spans[k]) for k in pattern), hashlib.sha256(joined.encode()).hexdigest(), joined

    found = personal.detect(df).collect()
    for r in found:
        *counts, sha, joined = want(rows[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256] == [*counts, sha], rows[r.doc_id]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        assert len(r.found) == len(list(filter(None, r.spans.split(","))))
    assert sum(r.n_card for r in found) and sum(r.n_phone for r in found) and sum(r.n_email for r in found) and sum(r.n_ip for r in found)
    kinds = {x.kind for r in found for x in r.found}
    assert {"iban", "secret", "ssn"} <= kinds
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("ab1.@+- (2") for _ in range(rng.randrange(40)))
        base = [(k, a, b) for k, a, b, _ in personal.find(t) if k in personal.BASE]
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in base) == want(t)[-1], t


def test_personal_ends_of_own_kinds():
    for text, value in (("DE89370400440532013000 BIC COBADEFFXXX", "DE89370400440532013000"), ("to DE89 3704 0044 0532 0130 00 EUR 250", "DE89 3704 0044 0532 0130 00"), ("NO93 8601 1117 947 X", "NO93 8601 1117 947")):
        assert [text[a:b] for k, a, b, _ in personal.find(text) if k == "iban"] == [value]
    assert not [x for x in personal.find("DE89370400440532013001 and DE893704004405320130001") if x[0] == "iban"]
    for name in ("access_token=", "client_secret: "):
        assert [x[0] for x in personal.find(name + "a1B2c3D4e5F6g7H8i9")] == ["secret"]


def test_tokens(spark, docs):
    df, rows = docs
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    library = Tokenizer.from_file(path)
    want, start = {}, 0
    for i in sorted(rows):
        ids = [*library.encode(rows[i] or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.report(df, tokens.Settings(path, shard_rows=40, shard_tokens=5000)).collect()}
    assert got == want
    assert tokens.report(df.limit(0), tokens.Settings(path)).count() == 0


def test_wavelet_matrix():
    import numpy as np

    from cloakwork.llm import wavelet

    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (9, 2), (5000, 300), (300_000, 70_000)):
        ids = rng.integers(0, top, n)
        planes, listed = wavelet.decode_file(wavelet.encode(ids, [(7, n)]))
        assert (planes.decode() == ids).all() and listed == [(7, n)]
        for i in rng.integers(0, n, 20) if n else []:
            assert planes.access(int(i)) == ids[i]
            token = int(ids[i])
            places = np.flatnonzero(ids == token)
            assert planes.count(token) == len(places) and planes.rank(token, int(i)) == (places < i).sum()
            assert planes.select(token, int((places < i).sum())) == i
        if 0 < n <= 5000:
            assert planes.occurrences(int(ids[0])) == np.flatnonzero(ids == ids[0]).tolist() and planes.count(top + 9) == 0
    blob = wavelet.encode(rng.integers(0, 9, 100), [])
    for bad in (blob[:-1], blob[:40] + bytes([blob[40] ^ 1]) + blob[41:], b""):
        with pytest.raises(ValueError):
            wavelet.decode_file(bad)


def brute_repeats(rows, window):
    """Rows: (key, text)."""
    count = Counter()
    cut = {k: WORD.findall(t or "") for k, t in rows}
    for k, _ in rows:
        w = cut[k]
        for i in range(len(w) - window + 1):
            count[tuple(w[i : i + window])] += 1
    out = {}
    for k, w in cut.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out[k] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def test_substrings(docs):
    df, rows = docs
    want = brute_repeats(list(rows.items()), 35)
    for s in (substrings.Settings(), substrings.Settings(hot=1, segment=8, shard_words=3000)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(df, s).collect()}
        assert got == want
    assert substrings.report(df.limit(0)).count() == 0
    one = df.filter("doc_id = 10006")
    assert [r.n_removed for r in substrings.report(one).collect()] == [0]
    assert [r.n_removed for r in substrings.report(one.union(one)).collect()] == [220, 220]  # rows that repeat


def test_fm_index():
    import numpy as np
    import pyarrow as pa

    from cloakwork.llm.fmindex import Index

    rng = np.random.default_rng(4)
    for top, n, length, depth in ((3, 400, 7, 8), (50, 3000, 3, 4), (2, 900, 12, 16), (2, 5, 4, 8)):
        text = np.concatenate([rng.integers(1, top, n), rng.integers(1, top, 30) if n > 30 else [1], [0]]).astype(np.int64)
        text = np.concatenate([[0], text, text[-200:], rng.integers(1, top, 40), [0]]).astype(np.int64)
        times = np.where((np.cumsum(text == 0) == text.tolist().count(0) - 1) & (text > 0), 3, 1)  # the last text stands for three
        folded = np.flatnonzero(times > 1)
        words = pa.array([f"w{i}" for i in range(int(text.max()))])
        index, vocabulary = Index.load(Index.build(text, times, depth).save(words))
        assert vocabulary.cast(pa.string()).equals(words)
        stops = [i for i in range(len(text)) if text[i]]
        grams = [Counter() for _ in range(depth + 1)]
        for k in range(1, depth + 1):
            for e in stops:
                gram = tuple(text[e - k + 1 : e + 1])
                if e - k + 1 >= 0 and 0 not in gram:
                    grams[k][gram] += int(times[e - k + 1])
        query = np.concatenate([text, [-1], rng.integers(1, top + 1, 50)])
        query[query > text.max()] = -1
        ends = np.flatnonzero(query > 0)
        for least in (1, 2, 4):
            want = []
            for e in ends:
                m = 0
                while m < min(depth, e + 1) and query[e - m] > 0 and grams[m + 1][tuple(query[e - m : e + 1])] >= least:
                    m += 1
                want.append(m)
            assert index.matched(query, ends, np.full(len(ends), depth), least).tolist() == want
        starts = np.array([e - length + 1 for e in stops if e - length + 1 >= 0 and 0 not in text[e - length + 1 : e + 1]])
        want = [grams[length][tuple(text[a : a + length])] > 1 for a in starts]
        new = np.flatnonzero(np.diff(starts, prepend=-9) != 1)
        assert index.repeated(text, starts[new], np.diff(np.append(new, len(starts))), length).tolist() == want
        assert len(folded)
    with pytest.raises(ValueError):
        Index.load(Index.build(text, times, 4).save(words)[:-1])


def test_pages(spark):
    article = ["A title, with & sign", "First paragraph, long enough to count as running text; it has commas, and more.", "Second one, also long enough, with a link inside and 1 < 2 here."]
    page = """<!doctype html><html><head><title>t</title><script>if(a<b){"</p>"}</script></head><body class="x"><header><h2>Site</h2></header>
      <nav><ul><li><a href=/a>Menu, item</a></ul></nav><div id="cookie-notice">We use cookies, lots.</div>{open}<h1>A title,&nbsp; with &amp; sign</h1>
      <p>First paragraph, long <b>enough</b> to count as running text;\n it has commas, and more.<p>Second one, also long enough, with <a href="x>y">a link</a> inside and 1 < 2 here.</p>
      <aside>Ad, buy now</aside><form><p>Your mail</p></form>{close}<div class="user-comments"><p>A reader, says, things, at, length, here.</p></div><footer><p>&copy; me</p></footer></body></html>"""
    rows = []
    for i, (a, b) in enumerate([("<article>", "</article>"), ('<div class="post-12"><div class="body">', "</div></div>"), ("<main>", "</main>"), ("<article>", "")]):
        for j in range(3):
            rows.append((10 * i + j, f"http://www.h{i}.org/{j}", page.replace("{open}", a).replace("{close}", b)))
    rows += [(90, None, None), (91, "http://h0.org/z", ""), (92, "x", "just text & more"), (93, "http://h0.org/q", "<p>only, this one"), (94, "http://h0.org", "<" * 50), (95, "y", "<!-- " * 2000), (96, "z", "<div>" * 5000 + "deep, text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("winner", F.lit(1)).withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in pages.extract(df).collect()}
    for i in [10 * i + j for i in range(4) for j in range(3)]:
        assert got[i].text.split("\n") == article, i
    assert got[90].text == "" and got[91].text == "" and got[92].text == "just text & more" and got[93].text == "only, this one" and got[96].text == "deep, text"
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == len(rows)
    assert pages.extract(df.limit(0)).count() == 0


def test_pages_split_articles():
    long = [f"Sentence {i} of the text, long enough to count as running text, with commas, and more of it." for i in range(8)]
    para = ["".join(f"<p>{x}</p>" for x in part) for part in (long[:3], long[3:])]
    frame = "<html><body><nav><a href=/>Menu, item</a></nav>{}<div class=comments><p>A reader, says, things.</p></div><footer>me</footer></body></html>"
    for inner, want in (
        (f"<article><h1>Title</h1><div class=body>{para[0]}{para[1]}</div></article>", ["Title", *long]),
        (f"<article><div class=intro>{para[0]}</div><div class=text>{para[1]}</div></article>", long),
        (f"<div class=post><h1>Title</h1><div class=body>{para[0]}{para[1]}</div></div>", ["Title", *long]),
        (f"<section class=a>{para[0]}</section><section class=b>{para[1]}</section>", long),
    ):
        assert pages.main_text(frame.format(inner)).split("\n") == want, inner
    menu = "<div class=box><ul>" + "<li><a href=/x>Somewhere else</a></li>" * 5 + f"</ul><div class=body>{para[0]}{para[1]}</div></div>"
    assert pages.main_text(frame.format(menu)).split("\n") == long


def test_pages_many_open_elements():
    long = [f"Sentence {i} of the text, long enough to count as running text, with commas, and more of it." for i in range(6)]
    body = "<div class=part><p>" + "</p></div><div class=part><p>".join(long) + "</p></div>"
    for before in ("<div>" * 600 + "x" + "</div>" * 600, "<font>" * 600, "<b><span>" * 400):
        page = f"<html><body><article>{before}{body}<nav><p>Menu, of, the, site</p></nav><div class=comments><p>A reader, says.</p></div><p>The end, of it.</p></article><footer>me</footer></body></html>"
        got = pages.main_text(page).split("\n")
        assert [x for x in got if x != "x"] == [*long, "The end, of it."]
