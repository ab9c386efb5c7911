"""Mixing, chat formatting, url filters, top-k, fingerprints, near duplicates and toxicity against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from vexel.llm import chat, fingerprint, mixing, near_dup, topk, toxicity, urls

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


# -- mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """By the rule itself: share, cap, share the excess among the others, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        t = {s: most * sizes[s] for s in capped} | {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        over = {s for s in open_ if t[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return t
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 3, "d": 50, None: 7}, {"x": 5}, {"a": 0, "b": 0}, {"a": 0, "b": 9, "z": 1}, {"é": 4, "z": 4, "Z": 4, "": 2}])
def test_targets(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = targets(sizes)
    assert {r.source: round(r.target, 6) for r in got} == {s: round(float(t), 6) for s, t in want.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutations(spark, n):
    p = mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(99).cast("long"))
    got = [r.p for r in spark.range(n).select(p.alias("p")).collect()]
    assert sorted(got) == list(range(n))
    assert n < 64 or got != list(range(n))


def mixed_docs(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([0, 1, 50, 300, 2000])) for i in range(400)]
    rows += [(7000, "hot", 40)] * 300 + [(None, "a", 12)] * 3
    return spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(5)


def test_mix_meets_targets_and_limits(spark):
    df = mixed_docs(spark)
    m = mixing.mix(df, ["doc_id"], block=32, shard_slots=64)
    rows = mixing.taken(m, ["doc_id"]).collect()
    assert len(rows) == df.count()
    assert all(r.taken <= 3 * r["size"] for r in rows)
    sums = Counter()
    for r in rows:
        sums[r.source] += r.taken
    for s in m.sources.collect():
        assert abs(sums[s.source] - s.target) <= 3 * 32 + 32
    # each place of each shard is filled once
    slots = m.slots.collect()
    assert len({(s.shard, s.place) for s in slots}) == len(slots) and max(s.place for s in slots) < 64
    # slots are as the counts say, which are the shards' draws conditioned on the targets
    held = Counter((s.shard, s.rank) for s in slots)
    counts = m.counts.collect()
    assert {(c.shard, c.rank): c.blocks for c in counts if c.blocks} == dict(held)
    drawn, blocks, by_source = Counter(), Counter(), Counter()
    for c in counts:
        drawn[c.shard] += c.drawn
        blocks[c.shard] += c.blocks
        by_source[c.rank] += c.blocks
    assert drawn == blocks and all(n == 64 for k, n in drawn.items() if k != max(drawn))
    assert by_source == {s["rank"]: s.n_slots for s in m.sources.collect() if s.n_slots}


def test_draws_are_multinomial_and_little_is_drawn_anew(spark):
    sources = spark.createDataFrame([(1, 0, 50_000), (2, 50_000, 30_000), (3, 80_000, 20_000)], "rank int, first_slot long, n_slots long")
    counts = mixing.drawn_counts(sources, 1000, 5).collect()
    per = {r: [c.drawn for c in counts if c["rank"] == r] for r in (1, 2, 3)}
    for r, p in ((1, 0.5), (2, 0.3), (3, 0.2)):
        got = np.array(per[r])
        assert abs(got.mean() - 1000 * p) < 8
        # the variance of binomial draws, within the error of a hundred shards
        assert 0.6 < got.var() / (1000 * p * (1 - p)) < 1.6
        assert sum(c.blocks for c in counts if c["rank"] == r) == 100_000 * p
    assert sum(abs(c.blocks - c.drawn) for c in counts) < 2000
    assert all(sum(c.blocks for c in counts if c.shard == s) == 1000 for s in range(100))


def test_mix_is_the_same_again_however_rows_are_dealt(spark):
    key = lambda rows: sorted(map(str, rows))
    a = mixing.taken(mixing.mix(mixed_docs(spark), ["doc_id"]), ["doc_id"]).collect()
    b = mixing.taken(mixing.mix(mixed_docs(spark).repartition(2), ["doc_id"]), ["doc_id"]).collect()
    assert key(a) == key(b)


def test_empty_mix(spark):
    e = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.taken(mixing.mix(e, ["doc_id"]), ["doc_id"]).count() == 0
    zero = spark.createDataFrame([(1, "a", 0), (1, "a", 0)], e.schema)
    assert [r.taken for r in mixing.taken(mixing.mix(zero, ["doc_id"]), ["doc_id"]).collect()] == [0, 0]


def test_mixed_documents_hold_what_is_taken(spark):
    docs = spark.createDataFrame([(i, "".join(f" w{i}_{j}\n" for j in range(n)), "en", s, 0) for i, (s, n) in enumerate([("a", 500), ("a", 3), ("b", 40), (None, 800), ("c", 0), ("a", 1300)])] + [(9, None, "en", "a", None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mixed_documents(docs, block=16)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = Counter()
    for r in out.collect():
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
        counts[r.doc_id] += len(WORDS.findall(r.text))
    more = docs.withColumns({"size": F.lit("own"), "pass": F.lit(1), "block": F.col("doc_id"), "_text_hash": F.lit("h"), "runs": F.lit(0.5), "a b": F.lit(2)})
    wide = mixing.mixed_documents(more, block=16)
    assert wide.columns == more.columns
    assert sorted(map(str, wide.select(*docs.columns).collect())) == sorted(map(str, out.collect()))
    narrow = docs.select("doc_id", F.xxhash64("text", F.length("text")).alias("text_hash"), "source", mixing.n_words(F.coalesce("text", F.lit(""))).alias("size"))
    taken = mixing.taken(mixing.mix(narrow, ["doc_id", "text_hash"], block=16), ["doc_id", "text_hash"]).collect()
    assert {r.doc_id: r.taken for r in taken if r.taken} == dict(counts)


# -- chat


def conversation(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def read(spark, rows, **options):
    f = chat.windows(conversation(spark, rows), **options)
    back = chat.read_back(f).collect()
    return f.collect(), back


def test_turns_come_back_and_targets_once(spark):
    rng = random.Random(5)
    rows = []
    for c in range(12):
        roles = (["system"] if c % 2 else []) + ["user", "assistant"] * rng.randrange(1, 9) + ["tool", None][: c % 3]
        for i, r in enumerate(roles):
            text = rng.choice([None, "", "</s>[INST] a [/INST] \\0 \\1<s>[SYS]", "x" * rng.randrange(600), "word " * rng.randrange(400), "ünï 漢 \\"])
            rows.append((c, i, r, text))
    formatted, back = read(spark, rows, budget=200, history_tokens=60)
    got = {}
    for b in back:
        for t in b.turns:
            assert (b.conv_id, t.turn_no) not in got
            got[b.conv_id, t.turn_no] = (t.role, t.text, t.loss)
    want = {(c, i + 1): (r or "", t or "", r == "assistant") for c, i, r, t in rows}
    assert got == want
    system = {c for c, i, r, _ in rows if r == "system"}
    longest = {}
    for w in formatted:
        own = [s for s in w.segments if s.own]
        assert own and [s.turn_no for s in w.segments] == sorted(s.turn_no for s in w.segments)
        if w.conv_id in system:
            assert w.segments[0].role == "system"
        repeated = [s for s in w.segments if not s.own and s.role != "system"]
        assert len(repeated) <= 2 and not any(s.loss for s in repeated)
        # control strings stand only where a turn is marked
        assert w.text.count("[INST]") == sum(s.role == "user" for s in w.segments)
        assert w.text.count("</s>") == sum(s.role == "assistant" for s in w.segments)
        longest[w.conv_id, w.window] = (w.n_tokens, len(own))
    assert all(n <= 200 or k == 1 for n, k in longest.values())


def test_no_byte_level_vocabulary_exceeds_a_window_s_budget(spark):
    from vexel.llm.common import CachedEncoder
    from vexel.llm.packing import vocabulary

    e = CachedEncoder(vocabulary("byte_bpe_50k.json"), True)
    words = ["漢字" * 16, "Привет мир", "สวัสดี", "שלום", "zqxj vwkq", "plain words", "😀"]
    rng = random.Random(3)
    rows = [(c, i, ("user", "assistant")[i % 2], " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for c in range(5) for i in range(20)]
    formatted, _ = read(spark, rows, budget=1500, history_tokens=300)
    assert all(len(e.tokenizer.encode(w.text, add_special_tokens=False).ids) <= w.n_tokens for w in formatted)
    assert all(w.n_tokens <= 1500 or sum(s.own for s in w.segments) == 1 for w in formatted)


def test_counted_tokens_choose_the_spans(spark):
    rows = [(1, i, "user", "x" * 500, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long").withColumn("no", F.lit("own"))
    assert chat.windows(df, budget=100, history_tokens=10, tokens="n").count() == 1
    assert chat.windows(df, budget=100, history_tokens=10).count() == 10


def test_ties_repeats_and_null_conversations(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "assistant", "x"), (None, 1, "user", "y")]
    _, back = read(spark, rows)
    got = {b.conv_id: [(t.role, t.text) for t in b.turns] for b in back}
    assert got == {1: [("user", "a"), ("user", "a"), ("user", "b")], None: [("assistant", "x"), ("user", "y")]}
    assert read(spark, []) == ([], [])


def test_op3_digests(spark):
    import pandas as pd

    c = pd.read_parquet(f"{SF}/conversations.parquet").sort_values(["conv_id", "turn"])
    got = {r.conv_id: r for r in chat.op3_chat_format(spark, SF).collect()}
    own = "</s>[INST] ok [/INST]"
    groups = {k: list(zip(g.role, g.text)) for k, g in c.groupby("conv_id")} | {-7: [("user", own), ("assistant", own)]}
    assert set(got) == set(groups)
    for k, turns in groups.items():
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


# -- urls


def judged(url, rules, default="allow"):
    m = re.search(r"^.*?://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for v, h, p in rules:
        if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p) and host:
            key = (len(h) + len(p), len(h), v)
            best = max(best or (key, h + p), (key, h + p))
    return host, path, best and best[1], best[0][2] if best else default


def test_url_rules_against_brute_force(spark):
    rng = random.Random(6)
    rules = [*urls.RULES, ("block", "b.c", ""), ("allow", "b.c", "/x"), ("block", "b.c", "/x"), ("block", "b.c", "/x/y/z"), ("allow", "a.b.c", "/x/yy"), ("block", None, "/"), ("allow", "d", None)]
    hosts = ["com", "example.com", "WWW.example.com", "xexample.com", "a.b.c", "b.c", "z.a.b.c", "net", "m.net", "", "..b.c", "b.c."]
    paths = ["", "/", "/en", "/en/", "/en/1", "/es/", "/x", "/xq", "/x/y/z/w", "/x/yy", "/x/y", "//x", "/fr/?a=/es/"]
    rows = [f"{rng.choice(['http', '', 'x://y'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q#f', '#/en/', ':80/'])}" for _ in range(300)]
    rows += [None, "", "no scheme", "http:/x", "a://b\nc.b.c/x", rows[0], rows[0]]
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(rows)], "page_id long, url string, verdict string")
    got = urls.judge(df, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(rows[r.page_id], rules), rows[r.page_id]


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "verdict string, host string, path string")
    pages = spark.createDataFrame([("http://a/b",)], "url string")
    assert [tuple(r) for r in urls.judge(pages, none).collect()] == [("http://a/b", "a", "/b", None, "allow")]
    assert urls.judge(pages.limit(0), none).count() == 0


# -- top-k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=6) * 50).round().tolist()) for i in range(700)]
    rows[13] = (13, rows[40][1])
    rows += [(2000 + i, rows[60][1]) for i in range(12)] + [(50, [0.0] * 6), (3, [9.0, 1.0]), (100, None), (150, [math.nan] + [0.0] * 5), (None, [1.0] * 6), (5000, [1e300, 0.0, 0.0, 0.0, 0.0, 0.0]), (5050, [-1e300, 1.0, 1.0, 1.0, 1.0, 1.0]), (5100, [0.5, 2.0]), (5150, [])]
    df = spark.createDataFrame(rows, "id long, e array<double>").repartition(6)
    df = df.unionByName(df.where("id in (50, 60, 100, 7)")).unionByName(spark.createDataFrame([(50, [1.0] * 6)], df.schema))
    q = df.select("id", topk.quantized(F.col("e")).alias("vector"), F.lit(1).alias("key"), F.lit("x").alias("times")).cache()
    got = Counter((r.query_id, r["rank"], r.id, r.score) for r in topk.top_k(q, F.col("id") % 50 == 0, 5, cell_bytes=4000).collect())
    v = [(r.id, r.vector) for r in q.collect() if r.id is not None and r.vector is not None]
    most, want = (1 << 63) - 1, Counter()
    for n, (i, x) in enumerate(v):
        if i % 50 == 0:
            every = sorted((-max(-most, min(most, sum(a * b for a, b in zip(x, y)))), j) for m, (j, y) in enumerate(v) if m != n and len(y) == len(x))[:5]
            want.update((i, r + 1, j, -s) for r, (s, j) in enumerate(every))
    assert got == want


def test_lists_are_read_until_outsiders_cannot_qualify():
    rng = np.random.default_rng(8)
    v = np.floor(rng.normal(size=(4000, 32)) * 256).astype(np.int64)
    # some candidates that no other comes near
    v[:10] = np.sign(v[0]) * 2000 + v[:10]
    ids, keys, once = rng.permutation(4000), np.arange(4000), np.ones(4000, np.int64)
    asked = [0, 3, 500, 501]
    for block in (100, 1000, 4000):
        for some in (asked, asked[:2]):
            known, reads, entries = {}, 0, 0
            for a in range(0, 4000, block):
                lists = topk.Lists(keys[a : a + block], ids[a : a + block], once[a : a + block], v[a : a + block])
                lists.best(some, v[some], 7, known)
                reads, entries = reads + lists.reads, entries + lists.entries
            for q in some:
                s = v @ v[q]
                want = sorted((-int(x), int(i)) for x, i, k in zip(s, ids, keys) if k != q)[:7]
                assert [x[:2] for x in known[q]] == want
            assert reads <= entries
            if len(some) == 2:
                # once the ten are known, each block's lists are left long before their ends
                assert reads < 0.6 * entries


def test_repeated_candidates_fill_as_many_ranks():
    lists = topk.Lists(np.array([0, 1, 2]), np.array([5, 4, 4]), np.array([3, 1, 1]), np.array([[2], [1], [2]]))
    known = {}
    lists.best([9, 0], np.array([[1], [1]]), 3, known)
    assert known[9] == [(-2, 4, 2, 1), (-2, 5, 0, 3)] and known[0] == [(-2, 4, 2, 1), (-2, 5, 0, 2)]


def test_top_k_of_nothing(spark):
    e = spark.createDataFrame([], "id long, vector array<long>")
    assert topk.top_k(e, F.col("id") > 0, 5).count() == 0


# -- fingerprints


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(9)
    texts = ["", "a", "ab", "héllo wörld " * 40, "héllo wörld " * 39 + "x", "z" * 300_000] + ["".join(rng.choice("abc dé") for _ in range(rng.randrange(900))) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(100, None, None), (5, "tie", None), (5, "tie", None), (None, "last", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(7)
    got = fingerprint.fingerprints(df).collect()
    assert len(got) == len(rows)
    # the order among equal ids is the operator's own; all others are fixed
    by_id = {r.doc_id: r for r in got if r.doc_id != 5}
    known = {i: t or "" for i, t, _ in rows if i != 5}
    order = sorted((i for i in known if i is not None), reverse=True) + [None]
    for a, b in zip(order, order[1:] + order[:1]):
        if a in (6, 5) or b == 5:
            continue
        t, n = known[a], known[b]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        d = [fingerprint.digest(np.frombuffer(x.encode(), np.uint8)) for x in (t, e, n)]
        r = by_id[a]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), d[0].hex(), d[1].hex())
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(d[0], d[1]), fingerprint.likeness(d[0], d[2]))
        assert 0 <= r.near_next <= 1
    assert len({r.fingerprint for r in got if r.doc_id == 5 and r.n_chars == 3}) == 1


def test_one_and_no_document(spark):
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one[0].near_next == 1
    assert fingerprint.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_workers_write_the_fingerprints(spark, monkeypatch, tmp_path):
    """No files of Hadoop's, for each of which an executor starts a process that counts its memory twice, and none left over."""
    from vexel.operators import scratch

    monkeypatch.setattr(scratch, "scratch_dir", lambda spark: f"file://{tmp_path}")
    rows = [(i % 97 if i % 11 else None, None if i % 13 == 0 else "é" * (i % 40)) for i in range(300)]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert Counter(r.doc_id for r in got.collect()) == Counter(i for i, _ in rows)
    files = sorted(p.name for p in tmp_path.glob("fingerprints-*/*"))
    assert files and all(re.fullmatch(r"part-\d{6}\.parquet", x) for x in files), files


def test_cut_mapped_is_the_mapped_table(spark):
    from vexel.operators.scratch import cut_mapped

    def odd(batches):
        for b in batches:
            yield b.filter(pc.equal(pc.bit_wise_and(b.column(0), 1), 1))

    df = spark.range(0, 1000, 1, 7).selectExpr("id", "if(id % 3 = 0, null, concat('t', id)) AS t")
    got = cut_mapped(df, odd, "id long, t string", "odd")
    assert sorted(got.collect()) == sorted(df.where("id % 2 = 1").collect()) and got.dtypes == df.dtypes
    none = cut_mapped(df.where("id < 0"), odd, "id long, t string", "odd")
    assert none.collect() == [] and none.dtypes == df.dtypes


def test_counts_do_not_depend_on_parts():
    data = np.random.default_rng(1).integers(0, 256, fingerprint._PART * 2 + 77).astype(np.uint8)
    part = fingerprint._PART
    try:
        whole = fingerprint.bucket_counts(data)
        fingerprint._PART = 1000
        # six triplets a window, of which the first reach two bytes ahead and the last four
        n = len(data)
        assert (fingerprint.bucket_counts(data) == whole).all() and whole.sum() == (n - 2) + 2 * (n - 3) + 3 * (n - 4)
    finally:
        fingerprint._PART = part


# -- near duplicates


def components(rows, k, threshold=80):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        w = WORDS.findall(re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= threshold * len(x | y) > 0 for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def near_rows(n_groups=25, seed=10):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(n_groups):
        base = [word() for _ in range(rng.randrange(20, 150))]
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            t = list(base)
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.4:
                t = t + passage
            rows.append((" " if rng.random() < 0.5 else "\n").join(t).title() if rng.random() < 0.2 else " ".join(t))
    rng.shuffle(rows)
    out = list(enumerate(rows))
    return out + [(900, None), (901, ""), (902, "two words"), (903, "Two  words"), (904, " "), (905, rows[0]), (906, rows[0]), (None, rows[1]), (None, "x"), (907, rows[2] + " "), (3, rows[3])]


@pytest.mark.parametrize(("k", "node_rows"), [(4, 20_000), (5, 20_000), (4, 12)])
def test_near_duplicates_against_brute_force(spark, k, node_rows):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string").repartition(5)
    got = near_dup.near_duplicates(df.select("doc_id", "text"), k=k, node_rows=node_rows).collect()
    want = components(rows, k)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_a_large_group_of_copies_of_copies(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(rng.randrange(1, 8)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(df, k=4).collect()
    assert {r.doc_id: r.component_id for r in got} == components(rows, 4)


def test_intersections_in_blocks_are_exact():
    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(150)]
    old = near_dup._BLOCK_BYTES, near_dup._BLOCK_ROWS
    try:
        near_dup._BLOCK_BYTES, near_dup._BLOCK_ROWS = 1, 32
        got = near_dup._linked(sets, 60)
    finally:
        near_dup._BLOCK_BYTES, near_dup._BLOCK_ROWS = old
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if n and 100 * n >= 60 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got.tolist() == [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("cell", [1, 300, 10**9])
def test_clusters_are_confirmed_in_cells(spark, cell):
    rows = near_rows(12, seed=21)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(df, k=4, cell_hashes=cell).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == components(rows, 4)


def test_recall_through_levels():
    """Planted pairs at the threshold among strangers that share half of their tokens with all: each node is branched on
    down to small leaves, and the pairs that share a leaf in any of the trees are found."""
    rng = np.random.default_rng(31)
    pairs, n = 400, 2400
    common = rng.integers(0, 1 << 32, near_dup.TOKENS, dtype=np.uint32)
    sig = rng.integers(0, 1 << 32, (n, near_dup.TOKENS), dtype=np.uint32)
    sig = np.where(rng.random(sig.shape) < 0.5, common, sig)
    for i in range(pairs):
        same = rng.permutation(near_dup.TOKENS) < 0.8 * near_dup.TOKENS
        sig[2 * i + 1][same] = sig[2 * i][same]
        sig[2 * i + 1][~same] = rng.integers(0, 1 << 32, (~same).sum(), dtype=np.uint32)
    found, depths, old = set(), [], near_dup.LEAF_ROWS
    clusters = near_dup._clusters

    def seen(ids, s, least):
        # a pair that shares a leaf is compared exhaustively there
        here = set(ids.tolist())
        found.update(i for i in range(pairs) if 2 * i in here and 2 * i + 1 in here)
        return iter(())

    try:
        near_dup.LEAF_ROWS, near_dup._clusters = 20, seen
        for tree, p in near_dup.root_positions(0.8, near_dup.RECALL):
            for token in np.unique(sig[:, p]):
                rows = np.flatnonzero(sig[:, p] == token)
                if len(rows) > 1:
                    list(near_dup._branch(rows, sig[rows], int(token) * 96 + p + tree, 0, 0.8))
    finally:
        near_dup.LEAF_ROWS, near_dup._clusters = old, clusters
    assert len(found) / pairs >= 0.99


def test_tokens_of_large_sets_do_not_crowd():
    import pyarrow as pa

    texts = [" ".join(f"w{i}_{j}" for j in range(1500)) for i in range(8)]
    run = {}

    class Frame:
        def select(self, *a):
            return self

        def mapInArrow(self, f, schema):
            run["f"] = f

    old, near_dup.spread = near_dup.spread, lambda df: df
    try:
        near_dup.sketches(Frame(), 4, [0, 5])
    finally:
        near_dup.spread = old
    (b,) = run["f"](iter([pa.RecordBatch.from_arrays([pa.array(range(8), pa.int64()), pa.array(texts)], names=["doc_id", "text"])]))
    tokens = np.concatenate([np.frombuffer(x, "<u4") for x in b.column(3).to_pylist()])
    assert 0.4 < tokens.mean() / (1 << 32) < 0.6
    assert all(len(x) == 16 for x in b.column(4).to_pylist())


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.id: r.component for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == 0 for i in range(61)) and got[200] == got[150] == 100


def test_no_documents_and_no_links(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = near_dup.near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2)]


def test_deduplicated_keeps_one_a_group(spark):
    rows = [(i, t, "l", "s", 0) for i, t in near_rows(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = near_dup.deduplicated(docs, k=5)
    want = components([(r[0], r[1]) for r in rows], 5)
    assert left.columns == docs.columns
    assert sorted({r.doc_id for r in left.collect() if r.doc_id is not None}) == sorted(set(want.values()))


# -- toxicity


def labelled(spark, n=500, seed=13):
    rng = random.Random(seed)
    bad = ["grolm", "vexing", "zupf"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randrange(5, 60))]
        toxic, junk = i % 7 == 0, i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", ".", "ness", ","])
        text = (" ### " if junk else " ").join(words)
        docs.append((i, text, "own"))
        if i < n * 0.7:
            labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_chain_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    df = spark.createDataFrame([*docs, (9000, None, None), (9001, "", None), (9002, "Grolm! " * 5, None)], "doc_id long, text string, toxic string")
    y = spark.createDataFrame([*labels, (0, 1, None), (None, 0, 1), (8888, 0, 1)], "doc_id long, quality int, toxic int")
    m = toxicity.train(toxicity.training_sample(df, y), [n for n, _ in toxicity.CHAIN])
    got = {r.doc_id: r for r in toxicity.scored(df.select("doc_id", "text", "toxic"), m).collect()}
    assert len(got) == len(docs) + 3
    held = [i for i, _, _ in docs if i >= 350]
    hits = sum(got[i].toxic == (i % 7 == 0) for i in held)
    assert hits / len(held) >= 0.95
    assert sum(got[i].low_quality == (i % 5 == 0) for i in held) / len(held) >= 0.95
    assert got[9002].toxic and not got[9000].toxic and not got[9001].toxic
    assert all(0 <= r.p_toxic <= 1 for r in got.values())


@pytest.mark.parametrize("rows", [[], [(1, 1, 0), (2, 1, 0)], [(1, None, None)]])
def test_labels_of_one_class_reject_nothing(spark, rows):
    df = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, None)], "doc_id long, text string")
    y = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    m = toxicity.train(toxicity.training_sample(df, y), ["low_quality", "toxic"])
    got = toxicity.scored(df, m, prefix="_").collect()
    assert len(got) == 3 and not any(r._toxic or r._low_quality for r in got)


def test_chain_is_the_same_however_rows_are_dealt(spark):
    docs, labels = labelled(spark, 200)
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names, found = ["low_quality", "toxic"], []
    for n in (1, 5):
        df = spark.createDataFrame(docs[:: 1 if n == 1 else -1], "doc_id long, text string, own string").repartition(n)
        m = toxicity.train(toxicity.training_sample(df, y.repartition(n)), names)
        found.append(sorted((r.doc_id, r.p_low_quality, r.p_toxic, r.toxic) for r in toxicity.scored(df, m).collect()))
    assert found[0] == found[1]


def test_scores_against_the_formula(spark):
    """Probabilities worked out text by text: features as a set of hashed beginnings of words, the chain link by link."""
    import pyarrow as pa

    docs, labels = labelled(spark, 150)
    df = spark.createDataFrame([*docs, (9000, None, None), (9001, "", None)], "doc_id long, text string, own string")
    m = toxicity.train(toxicity.training_sample(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), ["low_quality", "toxic"])
    got = {r.doc_id: r for r in toxicity.scored(df, m).collect()}
    number = {int(f): i for i, f in enumerate(m.features)}
    for i, text, _ in [*docs, (9000, None, None), (9001, "", None)]:
        words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")
        hashes = {int(h) for w in words for h in toxicity.hashed(toxicity.Words(pa.array([w]), space=toxicity.NOT_LETTERS))[0]}
        n, inside = len((text or "").encode()), sum(len(w.encode()) for w in words)
        measures = np.array([math.log1p(n), math.log1p(len(words)), min(20, inside / max(1, len(words))), 1 - inside / max(1, n)])
        earlier = []
        for link in m.models:
            z = link.bias + sum(link.weights[number[h]] for h in hashes if h in number) + float(link.dense @ [*(measures - m.center) / m.spread, *earlier])
            earlier.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        assert np.allclose([got[i].p_low_quality, got[i].p_toxic], earlier, atol=1e-9)
        assert got[i].toxic == (got[i].p_toxic >= m.models[1].threshold)


def test_folds_do_not_leak(spark):
    """Labels by chance, and words that each stand in a few texts only: models that had seen a row's label could tell it."""
    rng = random.Random(17)
    docs = [(i, " ".join(f"w{rng.randrange(150)}" for _ in range(25))) for i in range(600)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i, _ in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    old, toxicity.LEAST_RATIO = toxicity.LEAST_RATIO, 0.5
    try:
        m = toxicity.train(toxicity.training_sample(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), ["low_quality", "toxic"])
    finally:
        toxicity.LEAST_RATIO = old
    # out-of-fold probabilities that tell nothing have their best F1 where nearly all rows are taken
    taken = sum(r.toxic for r in toxicity.scored(df, m).collect())
    assert len(m.features) > 20 and (taken > 400 or m.models[1].threshold < 0.45)


def test_no_documents_are_scored(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    m = toxicity.train(toxicity.training_sample(empty, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")), ["low_quality", "toxic"])
    assert toxicity.scored(empty, m).count() == 0


def test_sample_is_bounded(spark):
    docs, labels = labelled(spark)
    s = toxicity.training_sample(spark.createDataFrame(docs, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), train_rows=50)
    assert s.count() == 50


# -- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = p.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns and 0 < clean.count() <= docs.count()
    once = p.drop_near_duplicates(spark, clean, SF)
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert sorted(r.doc_id for r in once.collect()) == sorted(set(components(rows, 5).values()))
    mixed = p.mix_sources(spark, once, SF)
    assert mixed.columns == docs.columns and mixed.count() > 0
    cut = p.pack_sequences(spark, mixed, SF).collect()
    lengths = Counter()
    for r in cut:
        lengths[r.sequence_id] += r.length
    assert all(n == 2048 for k, n in lengths.items() if k != max(lengths))
