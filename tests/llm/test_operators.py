"""The corpus operators against brute force, round trips and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.llm import chat_format, decontaminate, license_scan, mpegts, near_dedup, packing, pieces, quality, toxicity, url_filter, warc
from loomwork.llm.common import pick, stage
from loomwork.llm.components import components
from loomwork.llm.license_texts import catalogue

DOCS = "doc_id long, text string"
LONG = "The quick brown fox jumps over the lazy dog and then " * 400
ODD = [(1, None), (2, ""), (3, "one"), (4, "Two words"), (5, "  \t\n "), (6, LONG), (6, LONG), (None, "no id here"), (7, "Ünï cödé 😀 ÀÉ"), (8, "a b c d e f g h i j")]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names differ in case or are those of results."""
    df = spark.createDataFrame(ODD, DOCS)
    return df.select("doc_id", F.col("text"), F.lit(0.5).alias("score"), F.lit("x").alias("TEXT"), F.lit(1).alias("n_words"))


def texts(df):
    return pick(df, "doc_id", "text")


# --- WARC ---


def test_warc(spark, tmp_path):
    big, other = "x" * 1500, "é" * 800
    rows = [(1, "http://a/", big), (5, "http://a/\r\nX: y", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (6, "ü", other), (7, "u", None), (8, "u", ""), (9, "u", other), (9, "u", other), (None, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("HTML"))
    warc.write_archive(df, f"file://{tmp_path}/w")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.parse_records(warc.read_records(spark, f"file://{tmp_path}/w")).collect()]
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == data and r[0] is not None]
        revisit = len(data) >= 1000 and i != max(same)
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert spark.read.parquet(f"file://{tmp_path}/w/payloads").count() == len({(r[2] or "") for r in rows})
    warc.write_archive(df.where("false"), f"file://{tmp_path}/e")
    assert warc.parse_records(warc.read_records(spark, f"file://{tmp_path}/e")).count() == 0
    records = [bytes(r.record) for r in warc.read_records(spark, f"file://{tmp_path}/w").collect()]
    assert all(b"\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in r for r in records)


# --- MPEG transport streams ---


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 40_000), st.integers(0, 5))
def test_stream_round_trip(n, seed):
    data = mpegts.padded(random.Random(seed).randbytes(n))
    media = mpegts.mux(data)
    payload, facts, units = mpegts.demux(media)
    assert payload == data and len(media) % 188 == 0
    assert [u[0] for u in units] == [3600 * k for k in range(len(units))] and [u[2] for u in units] == [k % 8 == 0 for k in range(len(units))]
    assert facts["units"] == -(-len(data) // mpegts.UNIT_BYTES) and facts["random_access"] == -(-facts["units"] // mpegts.EVERY)


def test_damaged_streams_are_refused():
    media = bytearray(mpegts.mux(b"x" * 5000))
    for change in (lambda m: m[: -188], lambda m: m[: 188 * 4] + m[188 * 5 :], lambda m: bytes([0]) + m[1:], lambda m: m[:12] + bytes([m[12] ^ 1]) + m[13:], lambda m: b""):
        with pytest.raises(ValueError):
            mpegts.demux(bytes(change(bytes(media))))


def test_streams_that_the_standard_allows():
    data = mpegts.padded(random.Random(1).randbytes(30_000))
    media = mpegts.mux(data)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    null = b"\x47\x1f\xff\x10" + b"\xff" * 184
    other = b"\x47\x42\x00\x10" + b"\x00" * 184
    own = lambda p: p[1] & 0x1F == 1 and p[2] == 0
    out, last = [], None
    for n, p in enumerate(packets):
        out += [null] * (n % 3 == 0) + [p] + [p] * (n % 5 == 4)  # some packets twice
        last = p if own(p) else last
        if last and n % 7 == 0:  # an adaptation field only; the counter stays
            out.append(last[:1] + bytes([last[1] & 0x1F, last[2], 0x20 | last[3] & 15, 183, 0]) + b"\xff" * 182)
    payload, _, units = mpegts.demux(b"".join([other, *out]))
    assert payload == data and len(units) == len(mpegts.demux(media)[2])
    # a program map that reaches over two packets, with another stream before the one that is read
    body = b"\xe1\x00\xf0\x00" + b"\x1b\xe2\x00\xf0\xb4" + bytes(180) + b"\x06\xe1\x00\xf0\x00"
    section = mpegts._section(2, 1, body)
    first = mpegts._head(0x1000, True, 1, 0) + section[:184]
    second = mpegts._head(0x1000, False, 1, 1) + section[184:].ljust(184, b"\xff")
    maps = [p for p in packets if p[1] & 0x1F == 0x10]
    long = [x for p in packets for x in (([first, second] if p is maps[0] else []) if p in maps else [p])]
    assert mpegts.demux(b"".join(long))[0] == data


def test_access_units(spark):
    df = spark.createDataFrame([(1, "x" * 100_000), (2, None), (2, "")], DOCS)
    stored = mpegts.store_streams(df)
    units = mpegts.access_units(stored).collect()
    assert [(r.unit, r.pts, r.random_access) for r in sorted(units, key=lambda r: r.unit) if r.doc_id == 1] == [(k, 3600 * k, k % 8 == 0) for k in range(13)]
    media = {r.doc_id: r.media for r in stored.collect()}
    for r in units:  # what begins there is the stream's packet that starts a unit
        p = media[r.doc_id][188 * r.packet : 188 * r.packet + 188]
        assert p[1] & 0x40 and p[1] & 0x1F == 1 and bool(p[5] & 0x40) == r.random_access
    assert mpegts.read_streams(mpegts.store_streams(df.where("false"))).count() == 0 and mpegts.access_units(stored.where("false")).count() == 0


def test_streams(spark, odd):
    rows = mpegts.read_streams(mpegts.store_streams(odd)).collect()
    want = []
    for i, t in ODD:
        raw = (t or "").encode()
        data = raw + b"\0" * ((64 - len(raw) % 64) % 64 if raw else 64)
        want.append((str(i), len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id == 6}) == 1


# --- packing ---


def test_packing(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(odd.repartition(3), path).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    whole = {}
    for i, x in ODD:
        whole[i] = [*t.encode(x or "", add_special_tokens=False).ids, 2]
    assert sum(r.length for r in rows) == sum(len(whole[i]) for i, _ in ODD)
    for r in rows:
        ids = np.array(whole[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert (r.ids_crc32, r.doc_tokens, r.ids) == (zlib.crc32(ids), len(whole[r.doc_id]), ids)
        assert 0 <= r.offset and r.offset + r.length <= 4096
    for s in {r.sequence_id for r in rows}:
        pieces = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
    last = max(r.sequence_id for r in rows)
    assert all(sum(r.length for r in rows if r.sequence_id == s) == 4096 for s in range(last))
    assert packing.pack(odd.where("false"), path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.sampled_from(["", " don't'd, WORLD!! ", "Ünï,cödé. ", "<|endoftext|>", " <|ENDOFTEXT|>,x", "B À <|endoftext|> Word, É.", "\x1c\x85  á "]))
def test_word_encoder_is_exact(text, more):
    own = pieces.encoder(public_tokenizers.path("word_bpe_49k.json"))
    text = (text + more).encode("utf-8", "ignore").decode()
    want = own.tokenizer.encode(text, add_special_tokens=False).ids
    assert own.cut and np.frombuffer(own.encode(text), own.type).tolist() == np.frombuffer(own.encode(text), own.type).tolist() == want


# --- classifiers ---


def corpus(spark, n=300):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    rows = []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(5, 200))
        toxic, low = i % 5 == 0, i % 7 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["Idiot", "moron,", "scum."]))
        if low:
            w = [x + "$$$" for x in w]
        rows.append((i, " ".join(w), int(not low), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").cache()


def test_classifiers(spark, odd):
    data = corpus(spark)
    docs, labels = data.select("doc_id", "text"), data.select("doc_id", "quality", "toxic", F.lit("x").alias("Quality2"))
    truth = data.toPandas().set_index("doc_id")
    for module, label, run, folds, fold in ((toxicity, "toxic", toxicity.score_toxicity, 4, 2), (quality, "quality", quality.score_quality, 5, 0)):
        model = module.train(docs, labels)
        got = run(docs, model).toPandas().set_index("doc_id")
        assert [bool(x) for x in got["held_out"]] == [zlib.crc32(str(i).encode()) % folds == fold for i in got.index]
        assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
        held = got[got["held_out"]].join(truth[label].rename("truth"))
        rare = int(label == "toxic")  # the class that a constant answer would miss
        found, right = held[held["predicted"] == rare], held[held["truth"] == rare]
        assert len(right) > 5 and (right["predicted"] == rare).mean() > 0.85 and (found["truth"] == rare).mean() > 0.85
        rows = run(odd, model).collect()
        assert len(rows) == len(ODD) and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
        one = module.train(docs, labels.where(f"{label} = 1"))
        assert run(docs, one).where("predicted = 0").count() == 0
        assert run(docs.where("false"), module.train(docs, labels.where("false"))).count() == 0
        keep = toxicity.without_toxic if module is toxicity else quality.with_quality
        for none in (labels.where("false"), labels.where(f"{label} = 1"), labels.where(f"{label} = 0")):  # nothing to tell apart: all stay
            assert keep(odd, module.train(docs, none)).count() == len(ODD)
        assert keep(odd.where("false"), model).count() == 0
    kept = toxicity.without_toxic(odd, toxicity.train(docs, labels))
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_factorization_machine_learns_pairs():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2, 4000), rng.integers(0, 2, 4000)
    rows = [toxicity.terms_of(" ".join(["base"] + ["insult"] * x + ["groups"] * y)) for x, y in zip(a, b)]
    model = toxicity.fit(rows, (a & b).astype(float))
    both, one, none = model.score(["base insult groups", "base insult", "base"])
    assert both > 0.8 and one < 0.2 and none < 0.2


def test_factorization_machine_learns_pairs_without_marginal_effect():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2, 4000), rng.integers(0, 2, 4000)
    other = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(2000)]
    made = [" ".join(["base"] + ["insult"] * x + ["groups"] * y + list(rng.choice(other, 30))) for x, y in zip(a, b)]
    truth = a ^ b
    model = toxicity.fit([toxicity.terms_of(t) for t in made[:3000]], truth[:3000].astype(float))
    assert ((model.score(made[3000:]) >= 0.5) == truth[3000:]).mean() > 0.9


def test_quality_reads_whole_words_and_vocabulary():
    assert quality.shape_of("x" * 100 + "$$$7") == "a$$0"
    assert set(quality.ngrams_of("字" * 64 + "。A")) != set(quality.ngrams_of("字" * 64))
    rng = np.random.default_rng(1)
    good, spam = ([f"{c}{a}{b}" for a in "abcdefgh" for b in "klmnopqr"] for c in "xy")
    truth = rng.integers(0, 2, 600)
    made = [" ".join(rng.choice(good if t else spam, 30)) for t in truth]
    model = quality.fit([quality.ngrams_of(t) for t in made[:400]], truth[:400].astype(float))
    assert ((model.score(made[400:]) >= 0.5) == truth[400:]).mean() > 0.95


# --- license scans ---


def test_windows_hold_templates_that_repeat_shingles():
    matcher = license_scan.Matcher([(n, t) for n, texts in catalogue().items() for t in texts], license_scan.PERCENT)
    texts = [t.encode() for texts in catalogue().values() for t in texts]
    hashes, n = license_scan._hashes(texts, {})
    sizes = {k: size for size, tables in matcher.classes.items() for _, _, templates in tables for k in templates.tolist()}
    assert all(n[k] <= sizes[k] < 2 * n[k] for k in range(len(texts))) and any(len(matcher.sets[k]) < n[k] for k in range(len(texts)))



def in_a_stretch(text, template, length, percent=80):
    """Does some stretch of `length` consecutive shingles, or the whole text, hold enough of the template? Shares no code with the operator."""
    shingles = lambda t: [tuple(w) for w in (lambda w: [w[i : i + 5] for i in range(len(w) - 4)])(re.findall(r"[a-z0-9\x80-\U0010ffff]+", lowered(t)))]
    have, want = shingles(text), set(shingles(template))
    return any(100 * len(want & set(have[i : i + length])) >= percent * len(want) for i in range(max(1, len(have) - length + 1))) if have else False


def test_license_scan_equals_brute_force(spark):
    """Whatever is in S shingles in a row must be found, and what isn't even in 2S in a row must not be."""
    short = {n: [t for t in ts if len(t) < 3000][-3:] for n, ts in catalogue().items()}
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choices([f"w{i}" for i in range(300)], k=n))
    rows = []
    for ts in short.values():
        for t in ts:
            words = t.split()
            for kind in range(3):
                w = list(words)
                for _ in range(kind * len(w) // 40):  # edits that leave some above and some below the threshold
                    w[rng.randrange(len(w))] = "edited"
                cut = rng.randrange(len(w)) if kind == 2 and rng.random() < 0.3 else 0  # and halves
                rows.append((len(rows), filler(rng.randint(0, 400)) + " " + " ".join(w[cut:]) + " " + filler(rng.randint(0, 90))))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, filler(500)), (len(rows) + 3, "four words are few")]
    names = sorted(short)
    seen = 0
    for name in names:  # one license at a time, so that no rival hides another
        got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(spark.createDataFrame(rows, DOCS).repartition(2), {name: short[name]}).collect()} if name in names[::6] else None
        if got is None:
            continue
        for i, text in rows:
            size = {t: 1 << (len({tuple(x) for x in zip(*[re.findall(r"[a-z0-9]+", t.lower())[k:] for k in range(5)])}) - 1).bit_length() for t in short[name]}
            if any(in_a_stretch(text or "", t, size[t]) for t in short[name]):
                assert got[i] == name, (i, name)
                seen += 1
            elif not any(in_a_stretch(text or "", t, 2 * size[t]) for t in short[name]):
                assert got[i] == "", (i, name)
    assert seen > 10


def test_license_scan_tells_licenses_apart(spark, odd):
    every = catalogue()
    texts = [(name, t) for name, ts in every.items() for t in ts]
    rows = [(i, "before it stand some words " + t + " and after it some more words") for i, (_, t) in enumerate(texts)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    for i, (name, text) in enumerate(texts):
        assert name in got[i].licenses.split(","), (name, text[:80])
    bsd = next(i for i, (n, t) in enumerate(texts) if n == "BSD-3-Clause" and "Neither the name" in t)
    gpl = next(i for i, (n, t) in enumerate(texts) if n == "GPL-3.0" and t.startswith("This program is free"))
    assert (got[bsd].licenses, got[gpl].licenses) == ("BSD-3-Clause", "GPL-3.0")
    assert license_scan.scan_licenses(odd).count() == len(ODD) and license_scan.scan_licenses(odd.where("false")).count() == 0
    twice = license_scan.scan_licenses(spark.createDataFrame([(1, texts[0][1]), (1, texts[0][1]), (None, texts[0][1])], DOCS)).collect()
    assert len(twice) == 3 and len({r.licenses for r in twice}) == 1
    with pytest.raises(ValueError):
        license_scan.Matcher([("x", "too few words")], 80)


# --- decontamination ---

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute_hits(docs, items):
    windows = []
    for i, t in items:
        w = WORD.findall(lowered(t))
        n = min(10, len(w))
        windows += [(str(i) if i is not None else "null", tuple(w[k : k + n])) for k in range(len(w) - n + 1)] if n else []
    out = []
    for i, t in docs:
        w = WORD.findall(lowered(t))
        hit, found = set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found.add(item)
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def random_docs(seed, vocabulary, n, most):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, most)))) for i in range(n)]


@pytest.mark.parametrize("short", [False, True])
def test_decontamination_equals_brute_force(spark, short):
    items = [(9, "The Quick brown fox, jumps over the lazy dog and then"), (10, "a b " * 12), (2, None), (9, "x " * 10)] + random_docs(1, "abc", 6, 14)
    items = items + [(30, "Two words"), (31, "one")] if short else [x for x in items if len((x[1] or "").split()) == 0 or len(x[1].split()) >= 10]
    docs = ODD + random_docs(2, "abc", 25, 60) + [(50, "x " * 30), (51, "é " * 10 + "THE quick brown fox jumps over the lazy dog AND then é")]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    for block in (500_000, 7):
        got = decontaminate.decontaminate(df, bench, block).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute_hits(docs, items)
    clean = decontaminate.clean_documents(df, bench)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(x[0] for x in brute_hits(docs, items) if not x[5])
    assert decontaminate.decontaminate(df, bench.where("false")).where("contaminated").count() == 0


# --- URL filters ---


def test_url_filter(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    urls = [None, "", "no scheme", "http://example.com/en/x", "HTTP://WWW.EXAMPLE.COM/en/x?y", "http://example.com", "http://a.net/es/", "http://net/fr/a#b", "http://a.net/de/", "http://xcom/", "http://example.com/EN/", "http://é.com/é", "http://" + "a." * 300 + "com/en/", "http://example.com/en/x", "http://a.b.example.com/en/" + "x" * 5000, "://x.com/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(3, urls[3])]
    df = spark.createDataFrame(rows, "page_id long, url string").select("*", F.lit(1).alias("rule"), F.lit("").alias("URL"))
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect())
    want = []
    for i, u in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = lowered(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
        want.append((i, host, path, rule, verdict))
    assert [tuple(map(str, x)) for x in got] == sorted(tuple(map(str, x)) for x in want) or sorted(tuple(map(str, x)) for x in got) == sorted(tuple(map(str, x)) for x in want)


# --- near duplicates ---


def brute_components(docs, shingle):
    sets_ = {}
    for n, (i, t) in enumerate(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets_[n] = frozenset(tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)) if len(w) >= shingle else frozenset([tuple(w)] if w else [])
    label = {n: n for n in sets_}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets_:
        for b in sets_:
            if a < b and sets_[a] and sets_[b] and docs[a][0] is not None and docs[b][0] is not None:
                common = len(sets_[a] & sets_[b])
                if 100 * common >= 80 * (len(sets_[a]) + len(sets_[b]) - common):
                    x, y = find(a), find(b)
                    label[max(x, y)] = min(x, y)
    least = {}
    for n in sets_:
        if docs[n][0] is not None:
            least[find(n)] = min(least.get(find(n), docs[n][0]), docs[n][0])
    return sorted((str(docs[n][0]), len(sets_[n]), str(least.get(find(n)))) for n in sets_)


def near_copies(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = []
    for size in (4, 5, 6, 8, 12, 20, 30, 70, 200):
        base = rng.choices(words, k=size)
        for edits in (0, 0, 1, 1, 2, 3, size // 20, size // 12):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3:
                w.append(rng.choice(words))
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_equal_brute_force(spark, shingle):
    docs = [(i + 100, t) for i, t in near_copies(shingle)] + ODD
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, DOCS).withColumn("kept", F.lit(1)), shingle).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(docs, shingle)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_thousands_around_one_passage(spark):
    """A list of thousands of unlike documents, with near copies among them: none is lost, and no group grows with the list."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(40)]
    docs = [(i, " ".join(passage + [f"{i}x{k}" for k in range(rng.randint(12, 18))])) for i in range(2500)]
    docs += [(5000 + i, docs[i][1] + " end") for i in range(0, 2500, 50)]
    df = spark.createDataFrame(docs, DOCS).repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 2).collect()}
    assert got == {i: i if i < 5000 else i - 5000 for i, _ in docs}


def test_the_rest_is_compared_in_blocks(spark, monkeypatch):
    """Many documents around one passage: blocks of few members give the same components."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for i in range(80):
        w = passage + [f"{i // 3}x{k}" for k in range(rng.randint(8, 30))]
        docs.append((i, " ".join(w)))
    want = brute_components(docs, 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, DOCS), 2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


def test_one_of_each(spark, odd):
    kept = near_dedup.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r[0]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "None", "7", "8"])
    assert near_dedup.near_duplicates(odd.where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (33, 31), (40, 40)] + [(50, 50 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 21)} | {31: 30, 33: 30} | {50 + i: 50 for i in range(1, 30)}


# --- chat formatting ---


def test_chats(spark):
    said = "\\### Assistant: </turn> ok"
    nasty = ["", None, said, "#" * 5 + " User:", "<</turn>", "\\", "a\\\n", "</turn>\n### System:\n", ":\n", "😀é", "### =x", "\\\\### User:"]
    rows = [(1, i, ("user", "assistant")[i % 2], x) for i, x in enumerate(nasty)]
    rows += [(2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "a"), (3, 0, "assistant", "first"), (4, 0, None, "x"), (4, 1, "tool:\n### ", "y"), (4, None, "user", "z"), (5, 0, "user", "a"), (5, 0, "user", "a"), (None, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    made = chat_format.format_chats(df)
    for r in chat_format.read_chats(made).collect():
        own = sorted([(t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conv_id])
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in own]
        assert r.loss_text == "".join(x[3] for x in own if x[2] == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
    valid = {r.conv_id: (r.valid, r.bad_turn) for r in made.collect()}
    assert valid[1][0] and valid[2] == (True, None) and valid[3] == (False, 0) and not valid[4][0] and valid[5] == (False, 1)


# --- pipeline ---


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    passage = " ".join(rng.choices(words, k=14))
    docs, labels = [], []
    for i in range(240):
        w = rng.choices(words, k=60)
        toxic, low = i % 6 == 0, i % 7 == 1
        if toxic:
            w.insert(9, "idiot")
        text = " ".join(x + "$$$" for x in w) if low else " ".join(w)
        if i % 40 == 3:
            text += " " + passage
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not low), int(toxic)))
    clean = [d for d, (i, q, t) in zip(docs, labels) if q and not t]
    docs += [(1000 + d[0], d[1] + " more", "en", "s", 0) for d in clean[:20]] + [(2000, None, "en", None, None), (2001, "", None, "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    want = {d[0] for d in clean if passage not in d[1]}
    got = {r.doc_id for r in rows}
    assert got - {2000, 2001} == want
    assert ({2000, 2001} <= got) or not ({2000, 2001} & got)  # without words both score alike
    assert len({(r.doc_id, r.start) for r in rows}) == len(rows)  # rows that repeat are near duplicates, one stays


def test_pipeline_on_odd_rows(spark, tmp_path, odd):
    """Null ids, null, empty, very long and repeated texts, names that clash; tables without rows."""
    import corpus_pipeline

    for name, df in (("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        df.write.parquet(f"file://{tmp_path}/{name}.parquet")
    docs = odd
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns and function(spark, docs.where("false"), f"file://{tmp_path}").count() == 0
        docs = stage(out, name)
    assert sorted(str(r[0]) for r in docs.collect()) == sorted({str(i) for i, _ in ODD})  # nothing to judge by: only the repeat goes
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, f"file://{tmp_path}").collect()
    assert {str(r.doc_id) for r in rows} == {str(i) for i, _ in ODD}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), f"file://{tmp_path}").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "decontamination", "packing"]


# --- empty tables and very long texts of the native operators ---


def test_empty_tables(spark):
    rules = spark.createDataFrame([("com", "/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert url_filter.judge_urls(pages.where("false"), rules).count() == 0
    assert [tuple(r) for r in url_filter.judge_urls(pages, rules.where("false")).select("page_id", "rule").collect()] == [(1, None)]
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    made = chat_format.format_chats(turns)
    assert made.count() == 0 and chat_format.read_chats(made.select("conv_id", "formatted", "segments")).count() == 0
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontaminate.decontaminate(docs, items).count() == 0
    assert [r.contaminated for r in decontaminate.decontaminate(spark.createDataFrame([(1, "one two three")], DOCS), items.where("false")).collect()] == [False]


def test_very_long_chat(spark):
    text = "</turn> \\ ### User: " * 60_000
    made = chat_format.format_chats(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string"))
    row = chat_format.read_chats(made.select("conv_id", "formatted", "segments")).collect()[0]
    assert [(t.role, t.text) for t in row.turns] == [("user", text), ("assistant", text)] and row.loss_text == text
