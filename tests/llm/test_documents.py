"""Scores, rules, token counts, decontamination, archives, mixing and the pipeline."""

from __future__ import annotations

import collections
import gzip
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import frame
from tessera.llm import _linear, decontamination, mixing, quality_classifier, quality_rules, queries, token_counts, toxicity, warc

SMALL, FOLDER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def auc(good, bad):
    both = np.concatenate((good, bad))
    rank = both.argsort().argsort()
    return (rank[: len(good)].sum() - len(good) * (len(good) - 1) / 2) / len(good) / len(bad)


@pytest.mark.parametrize(("module", "label"), [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, module, label):
    got = module.query(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(got.loc[got[label] == 1, "score"].to_numpy(), got.loc[got[label] == 0, "score"].to_numpy()) > 0.85
    assert got.score.between(0, 1).all()


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_scores_of_edges(spark, module):
    docs = frame(spark, [(1, "good words here and there " * 3), (2, "idiot bad &&& !!!"), (3, None), (4, ""), (4, "")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    fitted = module.fit(docs, labels)
    out = module.score(docs, *fitted) if module is toxicity else module.classify(docs, fitted)
    assert out.count() == 5 and out.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and out.where("score is null").count() == 0
    assert module.fit(docs.limit(0), labels) is not None


def test_dual_coordinate_descent():
    rows = [np.array([0, 1]), np.array([0, 2]), np.array([3, 1]), np.array([3, 2])]
    y = np.array([1, 1, 0, 0])
    w, b = _linear.dual_coordinate_descent(rows, y, np.ones(4), cost=10.0, epochs=500)
    margins = np.array([w[r].sum() + b for r in rows]) * np.where(y > 0, 1, -1)
    assert (margins > 0.98).all() and abs(w[0] + w[3]) < 0.05
    ratio = _linear.log_count_ratio(rows, y, 4)
    assert ratio[0] > 0 > ratio[3] and abs(ratio[1]) < 1e-9


def test_restoration(spark):
    counts = np.ones((toxicity.STATES, toxicity.STATES))
    for word in ("idiot", "worthless", "stupid", "moron", "trash"):
        for a, b in zip(f"{{{word}", f"{word}{{", strict=True):
            counts[ord(a) - 97, ord(b) - 97] += 50
    channel = toxicity.Channel((toxicity.log_bigrams(counts),))
    for seen, meant in (("1d10t", "idiot"), ("an i d i o t", "anidiot"), ("w.o.r.t.h.l.e.s.s", "worthless"), ("stuuuupiiid", "stupid"), ("m0r0n", "moron"), ("tr@$h", "trash"), ("plain words, kept.", "plain words, kept."), ("", "")):
        assert toxicity.restore(seen, channel)[0].replace(" ", "") == meant.replace(" ", ""), seen


def toxic_channel(*learned):
    """A channel that has learned words, and a model with a weight of 1 for each."""
    counts = np.ones((toxicity.STATES, toxicity.STATES))
    for word in learned:
        for a, b in zip(f"{{{word}", f"{word}{{", strict=True):
            counts[ord(a) - 97, ord(b) - 97] += 50
    text = np.frombuffer(" ".join(learned).encode(), np.uint8)
    start, end, _ = toxicity.B.spans(text, np.array([0, len(text)]), toxicity.B.IS_SPACE)
    hashes = toxicity.B.span_hash(toxicity.B.prefix_hash(text), start, end)
    channel = toxicity.Channel((toxicity.log_bigrams(counts),), np.sort(hashes), max(map(len, learned)))
    return channel, dict(zip(learned, toxicity.ids_of(hashes).tolist(), strict=True))


def found(channel, text):
    data = np.frombuffer(text.encode(), np.uint8)
    return set(toxicity.features_of(channel)(data, np.array([0, len(data)]))[0].tolist())


def test_long_spaced_runs():
    """A toxic word is found wherever it stands in a long run of spaced letters, whatever follows it."""
    channel, ids = toxic_channel("idiot", "scum")
    for before in range(1, 40):
        run = "e" + "n r" * before
        assert ids["idiot"] in found(channel, " ".join((run + "idiot" + "than").replace(" ", ""))), before
        assert ids["scum"] in found(channel, " ".join((run + "scum" + "than").replace(" ", ""))), before
    assert toxicity.restore("x." * 60 + "i.d.1.o.t", channel)[0].replace(" ", "").endswith("idiot")
    assert not {*ids.values()} & found(channel, " ".join("enrenrenr" * 9))


def test_narrow_obfuscations():
    """Doubled letters, one separator inside, and a word in two fragments."""
    channel, ids = toxic_channel("idiot", "stupid", "trash", "worthless")
    for seen, meant in (("ttrraasshh", "trash"), ("stuupid", "stupid"), ("id.iot", "idiot"), ("tra-sh", "trash"), ("idi ot", "idiot"), ("tra sh", "trash"), ("worth less", "worthless"), ("id i0t", "idiot"), ("st uu pid", "stupid")):
        assert ids[meant] in found(channel, f"so {seen} then"), seen
    for plain in ("letter button well-known", "the rash", "an idea or other", "3.5 per cent"):
        assert not {*ids.values()} & found(channel, plain), plain


def test_viterbi_is_best():
    r = np.random.default_rng(2)
    logp = toxicity.log_bigrams(r.integers(0, 20, (toxicity.STATES, toxicity.STATES)))
    for text in (b"a1b", b"00", b"a.b", b"aab", b"$t"):
        span = np.frombuffer(text, np.uint8)[None]
        got = toxicity.viterbi(span, np.array([len(text)]), logp[None])[0, 0]
        best = {0: {toxicity.OTHER: (0.0, "")}}
        paths = [(0.0, toxicity.OTHER, "")]
        for i, c in enumerate(text):
            own = toxicity._STATE[c]
            new = []
            for s, last, out in paths:
                letter = own < toxicity.OTHER
                if not letter:
                    new.append((s + toxicity.DROP_SEPARATOR, last, out))
                elif i and text[i - 1] == c:
                    new.append((s + toxicity.DROP_REPEAT, last, out))
                new.append((s + logp[last, own] + (0 if letter else toxicity.KEEP_SEPARATOR), own, out + (chr(own + 97) if letter else " ")))
                new += [(s + logp[last, ord(x) - 97] + toxicity.LEET, ord(x) - 97, out + x) for x in toxicity.IMITATES.get(chr(c), "")]
            paths = new
        assert best and bytes(got[got > 0]).decode() == max(paths)[2]


def measures(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count = collections.Counter(tri)
    hit = {k + i for k, t in enumerate(tri) if count[t] > 1 for i in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_rules(spark, corpus):
    texts = [*corpus, (100, "a a a a a"), (101, "a b c a b c d a b c"), (102, "x\n\nx\n x\nx"), (103, "#$ %%% <b>")]
    got = quality_rules.judge(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        n = measures(dict(texts)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)
    assert quality_rules.judge(frame(spark, [])).count() == 0


def test_jensen_shannon(spark):
    js = lambda p, q: spark.range(1).select(quality_rules.jensen_shannon(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d")).first()["d"]
    assert js([1, 2], [2, 4]) == pytest.approx(0, abs=1e-7) and js([5, 0], [0, 9]) == pytest.approx(1) and js([0, 0], [1, 1]) is None


def test_rules_are_native(spark):
    plan = quality_rules.query(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens(spark, corpus, rule):
    coder, lengths = token_counts.encoder()
    expected = {}
    for i, t in corpus:
        data = (t or "").encode()
        ends, at = [], 0
        for x in coder.encode_ordinary(t or ""):
            at += lengths[x]
            ends.append(int(at))
        assert at == len(data)
        cuts = [0, *(k + 1 for k, b in enumerate(data) if b == 10)]
        spans = [(a, b) for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True) if a < b] or [(0, 0)]
        for k, (a, b) in enumerate(spans):
            n = 0.0
            for s, e in zip([0, *ends[:-1]], ends, strict=False):
                n += {"first": a <= s < b, "last": a < e <= b, "share": max(0, min(e, b) - max(s, a)) / (e - s)}[rule]
            expected[i, k] = pytest.approx(n)
    got = {(r.doc_id, r.section): r.n_tokens for r in token_counts.attribute(frame(spark, corpus), rule=rule).collect()}
    assert got == expected
    assert token_counts.attribute(frame(spark, [])).count() == 0


def test_tokens_of_given_sections(spark):
    docs = spark.createDataFrame([(1, "é one two", [(0, 3), None, (2, 99), (5, 5)]), (2, None, [(0, 4)])], "doc_id long, text string, s array<struct<start:int,end:int>>")
    got = token_counts.attribute(docs, "s").collect()
    assert [(r.doc_id, r.section, r.start, r.n_bytes) for r in got] == [(1, 0, 0, 4), (1, 1, 3, 7), (1, 2, 6, 0), (2, 0, 0, 0)]
    with pytest.raises(ValueError, match="rule"):
        token_counts.attribute(docs, rule="none")


def test_decontamination(spark, words):
    r = random.Random(4)
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, line(r.choice((0, 1, 3, 9, 10, 11, 25)))) for k in range(12)] + [(12, None), (None, line(4)), (13, "A b-C")]
    texts = [(i, f"{line(20)}, {(items[i % 12][1] or 'x').upper()}! {line(10)}") for i in range(24)] + [(50, None), (51, ""), (52, "-- a B c. --")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x for x in decontamination.report(frame(spark, texts), bench).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    for i, t in texts:
        w, hit, found = split(t), set(), set()
        for k, it in items:
            v = split(it)
            n = min(10, len(v))
            for a in range(len(v) - n + 1 if n and k is not None else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        found.add(str(k))
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
        shown = [split(t[s.start : s.end]) for s in got[i].spans]
        assert sum(map(len, shown)) == len(hit)
    blocks = decontamination.find(frame(spark, texts), bench, block_chars=50)
    assert {x.doc_id: x["items"] for x in blocks.collect()} == {x.doc_id: x["items"] for x in decontamination.find(frame(spark, texts), bench).collect()}
    clean = decontamination.clean(frame(spark, texts), bench)
    assert clean.columns == frame(spark, []).columns and {x.doc_id for x in clean.collect()} == {i for i, x in got.items() if not x.contaminated}
    assert decontamination.report(frame(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_archives(spark, tmp_path):
    body = "<p>" + "é" * 100
    pages = [(1, "https://www.Example.com/a?b=1#c", body), (2, "http://example.com/a?b=1", body), (3, "http://example.com/z", "short"), (4, "not a url", "short"), (5, None, None), (6, "http://b.example.com/", "y" * 5000), (6, "http://b.example.com/", "y" * 5000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    captures = warc.write_archives(df, f"file://{tmp_path}")
    directory = warc.write_index(captures, f"file://{tmp_path}", block=2)
    got = sorted(map(tuple, warc.read_records(warc.lookup(directory, df.select(warc.url_key(F.col("url")).alias("key")))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    expected = sorted(((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if i == 2 else "response", 1 if i == 2 else None) for i, _, h in pages), key=str)
    assert got == expected
    def found(*keys):
        return warc.lookup(directory, spark.createDataFrame([(k,) for k in keys], "key string"))

    assert sorted(r.page_id for r in found("com,example)/a?b=1").collect()) == [1, 2] and found("com,example)/b", None).collect() == [] and [r.page_id for r in found("").collect()] == [5]
    pair = {r.page_id: (r.record_type, r.html) for r in warc.read_records(found("com,example)/a?b=1")).collect()}
    assert pair == {1: ("response", body), 2: ("revisit", None)} and [r.html for r in warc.read_records(found("com,example,b)/")).collect()] == ["y" * 5000] * 2
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("*.warc.gz"))
    assert whole.count(b"WARC/1.1\r\n") == len(pages) + whole.count(b"WARC-Type: warcinfo\r\n")
    names = [x.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for x in whole.split(b"WARC/1.1\r\n")[1:]]
    refers = whole.split(b"WARC-Refers-To: ")[1].split(b"\r\n")[0]
    assert refers in names and b"WARC-Refers-To-Target-URI: https://www.Example.com/a?b=1#c\r\n" in whole
    assert all(zlib.decompressobj().decompress(p.read_bytes()) for p in tmp_path.glob("*.cdx.gz"))
    empty = warc.write_index(warc.write_archives(df.limit(0), f"file://{tmp_path}/e"), f"file://{tmp_path}/e")
    assert warc.read_records(warc.lookup(empty, df.select(F.col("url").alias("key")))).count() == 0


def fill(sizes, repeats=3):
    """Targets by repeated sharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > repeats * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = repeats * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing(spark, words, seed):
    r = random.Random(seed)
    names = [None, "a", "b", "ü", "Z", "c"]
    texts, sources = [], {}
    for i in range(150):
        sources[i] = r.choice(names if i % 3 else ["a", "b"])
        texts.append((i, r.choice(["", None, " ".join(["w"] * r.randint(1, 40))])))
    docs = frame(spark, texts, sources)
    got = mixing.mix(docs, bucket_rows=7).collect()
    sizes = collections.Counter({s: 0 for s in sources.values()})
    for i, t in texts:
        sizes[sources[i]] += len(WORD.findall(t or ""))
    goal = fill(sizes)
    taken = collections.Counter()
    for x in got:
        s = sources[x.doc_id]
        assert x.source_size == sizes[s] and x.target == pytest.approx(goal[s]) and x.taken <= 3 * x.size and (not x.size or x.taken % x.size == 0)
        taken[s] += x.taken
    assert sum(taken.values()) <= sum(sizes.values()) and all(abs(taken[s] - goal[s]) <= 80 for s in goal)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(5), bucket_rows=3).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.queries()[name](spark, SMALL)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(show(r[n]) for n in names) for r in df.collect()) == sorted(tuple(map(show, r)) for r in cursor.fetchall())


def test_pipeline(spark):
    import corpus_pipeline
    from tests.llm.test_dedup import later_lines, near_groups

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    frames = {"": docs}
    last = docs
    for name, stage in corpus_pipeline.STAGES:
        last = stage(spark, last, SMALL).persist()
        frames[name] = last
        if name != "mix":
            assert last.columns == docs.columns
    rows = {k: {r.doc_id: r for r in f.collect()} for k, f in frames.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    good = [i for i in rows[""] if labels.get(i) == 1]
    assert sum(i in rows["quality"] for i in good) >= 0.97 * len(good) and len(rows["quality"]) < len(rows[""])
    before = [(i, r.text) for i, r in rows["quality"].items()]
    gone = later_lines(before, least=1)
    for i, t in before:
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert (rows["lines"][i].text == kept) if i in rows["lines"] else not WORD.search(kept)
    near = near_groups([(i, r.text) for i, r in rows["lines"].items()], 5, 80)
    assert set(rows["near_copies"]) == set(near.values())
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    hit = {r.doc_id for r in decontamination.report(frames["near_copies"], bench).where("contaminated").collect()}
    assert set(rows["decontaminate"]) == set(rows["near_copies"]) - hit
    mixed = {r.doc_id: r.copies for r in mixing.mix(frames["decontaminate"]).where("copies > 0").collect()}
    assert {i: r.copies for i, r in rows["mix"].items()} == mixed


def test_archives_of_odd_pages(spark, tmp_path):
    """Clashing columns, a very long payload, equal keys over several blocks, rows without an id."""
    big = "z" * 3_000_000
    rows = [(i, "http://a.com/x", big if i % 3 == 0 else f"page {i} " * 20, "file", 7, "d") for i in range(12)] + [(None, "http://a.com/x", big, "file", 7, "d")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, file string, offset int, digest string")
    directory = warc.write_index(warc.write_archives(df, f"file://{tmp_path}"), f"file://{tmp_path}", block=2)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_records(warc.lookup(directory, df.select(warc.url_key(F.col("url")).alias("key")))).collect()), key=str)
    size = {i: len(h) for i, _, h, *_ in rows}
    expected = [(i, "revisit" if i is not None and i % 3 == 0 and i else "response", 0 if i is not None and i % 3 == 0 and i else None, size[i]) for i, *_ in rows]
    assert got == sorted(expected, key=str)
