"""Text kernels, tokenizers, packing, token files and token counts."""

import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vexel.llm import packing, rollup, tokenfile
from vexel.llm.common import CachedEncoder, Words, slices
from vexel.llm.packing import vocabulary

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = ["a", "b's", "Word", " ", "\n", "  ", "\t", "x!", "é", " ", "\x1c", "12", "<|endoftext|>", "I'll", "Σ", "́", "漢字", "　", "\r\n", "...", ""]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_words_are_those_of_the_pattern():
    t = [*texts(300), None, ""]
    w = Words(pa.array(t), lower=False)
    for i, x in enumerate(t):
        got = [bytes(w.data[a:b]).decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])]
        assert got == WORDS.findall(x or "")


def test_equal_words_have_equal_hashes():
    w = Words(pa.array(["one Two one", "TWO \0 \0\0"]))
    h = w.hashes()
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 4
    assert w.hashes(2)[1] == Words(pa.array(["tw"])).hashes()[0]


def test_slices_cover_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * 1000, "z"])], names=["t"])
    assert [s.num_rows for s in slices(b, 0, 15)] == [2, 1, 1]


@pytest.mark.parametrize(("name", "keep"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_ids_are_the_library_s(name, keep):
    e = CachedEncoder(vocabulary(name), keep, most=100_000)
    for seed in range(3):
        t = texts(1500, seed)
        ids, off = e.encode(t)
        for i, x in enumerate(e.tokenizer.encode_batch(t, add_special_tokens=False)):
            assert list(ids[off[i] : off[i + 1]]) == x.ids, t[i]
        assert (e.count(t) == np.diff(off)).all()


def test_folded_texts_share_chunks_and_keep_their_ids():
    """One chunk for a word in any case, before a sign or a line's end, and the library's ids of whole texts."""
    e = CachedEncoder(vocabulary("word_bpe_49k.json"), False)
    e.encode(["Some words, SOME words.\nSome\twords! some Words; and"])
    assert sorted(e.numbers) == ["!", ",", ".", ";", "and", "some", "words"]
    latin = [chr(i) for i in range(256)]
    rng = random.Random(5)
    t = [f"{a}{x}{b}" for x in latin for a in ("a", "B", "1", ".", " ", "é", "'") for b in (", c", ". ", "! ?", "\nD", "s, ", "T;")]
    t += ["".join(rng.choice([*latin, *"aB1.,;:!?' \n", ", ", "'S, "]) for _ in range(40)) for _ in range(1500)]
    t += ["<|STARTOFTEXT|>, A", "<|startoftext|>, A", "H\u0331, h\u0331.", "ΟΔΟΣ, \nΣ. ", "İ, I\u0307. ", "A\u030a, B", "x\n\u0308, y", "ſ, ẞ. K"]
    ids, off = e.encode(t)
    for i, x in enumerate(e.tokenizer.encode_batch(t, add_special_tokens=False)):
        assert list(ids[off[i] : off[i + 1]]) == x.ids, t[i]


def test_latin_texts_are_cut_into_the_pattern_s_pieces():
    """One chunk for a word before any sign or line's end, none looked for twice, and the library's ids of whole texts."""
    e = CachedEncoder(vocabulary("byte_bpe_50k.json"), True)
    e.encode(["Some words, some words.\nSome words!! 12 words"])
    assert sorted([*e.numbers, *(" " + k for k in e.spaced)]) == ["\n", " 12", " some", " words", "!!", ",", ".", "Some"]
    latin = [chr(i) for i in range(256)]
    rng = random.Random(6)
    t = [f"{a}{x}{b}" for x in latin for a in ("a", "1", ".", " ", "  ", "\n", "é", "'", "\x1c", "\xa0") for b in ("", "b", " b", "2", ", ", "\n\n", "  c", "'s", "'LL", "\x85")]
    t += ["".join(rng.choice([*latin, *"aB1.,'   \n\n", "'re", "'ve", "'d", "<|", "|>"]) for _ in range(40)) for _ in range(3000)]
    # beyond Latin-1, with a special token, and chunks of both kinds in one batch
    t += ["Σα, 漢字. words", "a<|endoftext|> words, b", "ſ2²Ⅷ, x", "“words”, it’s  so", "y" * 300 + " " + "漢" * 300 + ", words", "<|<|endoftext|>", "<|", ""]
    ids, off = e.encode(t)
    for i, x in enumerate(e.tokenizer.encode_batch(t, add_special_tokens=False)):
        assert list(ids[off[i] : off[i + 1]]) == x.ids, t[i]
    assert (e.count(t) == np.diff(off)).all()


def test_other_special_tokens_and_patterns_are_not_cut_into_pieces(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    t = ["Some</s>words, </s>", "</s>", "some words,\nsome  more 12", "it's </ s>"]
    for change in ("special", "pattern"):
        v = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
        if change == "special":
            v.add_special_tokens(["</s>"])
        else:
            v.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        v.save(str(tmp_path / f"{change}.json"))
        e = CachedEncoder(str(tmp_path / f"{change}.json"), True)
        assert e.whole is None
        if change == "special":
            ids, off = e.encode(t)
            assert [list(ids[off[i] : off[i + 1]]) for i in range(len(t))] == [x.ids for x in v.encode_batch(t, add_special_tokens=False)]


def docs_frame(spark):
    rows = [(i, x) for i, x in enumerate(texts(60))] + [(None, "null id"), (3, None), (3, None), (77, "long words " * 3000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def brute_ids(text, name):
    e = CachedEncoder(vocabulary(name), True)
    return [*e.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_packing_holds_every_id_once(spark):
    df = docs_frame(spark)
    cut = packing.pack(df, vocabulary("byte_bpe_50k.json"), sequence=64).cache()
    rows = cut.collect()
    total = 0
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.length > 0
        total += r.length
    want = sum(len(brute_ids(t, "byte_bpe_50k.json")) for _, t in df.collect())
    assert total == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, v in by_sequence.items():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at == 64 or k == max(by_sequence)
    whole = b"".join(r.ids for r in sorted((r for r in rows if r.doc_id == 77), key=lambda r: r.start))
    assert np.frombuffer(whole, "<u4").tolist() == brute_ids("long words " * 3000, "byte_bpe_50k.json")
    d = {(r.doc_id, r.start, r.sequence_id): r for r in packing.digests(cut).collect()}
    for r in rows:
        assert d[r.doc_id, r.start, r.sequence_id].ids_crc32 == zlib.crc32(r.ids)
    s = packing.sequences(cut, 64).collect()
    assert all(len(x.ids) == 256 for x in s) and sum(x.n_tokens for x in s) == want


def test_memory_is_bounded_by_bytes_and_long_chunks_are_not_kept():
    e = CachedEncoder(vocabulary("byte_bpe_50k.json"), True, most=60_000)
    rng = random.Random(2)
    for _ in range(30):
        t = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)) + " " + "y" * 5000]
        ids, _ = e.encode(t)
        assert ids.tolist() == e.tokenizer.encode(t[0], add_special_tokens=False).ids
        assert e.bytes <= 60_000 + 200 * 250 + 40_000
        assert all(len(k) < 256 for d in (e.numbers, e.spaced) for k in d)


def test_extra_columns_take_no_part(spark):
    df = docs_frame(spark)
    more = df.selectExpr("*", "1 as part", "'x' as ids", "doc_id as start", "2 as n_tokens", "'y' as file")
    path = vocabulary("byte_bpe_50k.json")
    key = lambda rows: sorted(map(str, rows))
    assert packing.digests(packing.pack(more, path)).agg({"length": "sum"}).collect() == packing.digests(packing.pack(df, path)).agg({"length": "sum"}).collect()
    counted = rollup.token_counts(more, path)
    assert "text" not in counted.columns and key(counted.select("doc_id", "n_tokens").collect()) == key(rollup.token_counts(df, path).select("doc_id", "n_tokens").collect())


def test_packing_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, ids int"), vocabulary("byte_bpe_50k.json")).count() == 0


def test_files_round_trip(spark, tmp_path):
    df = docs_frame(spark)
    folder = f"file://{tmp_path}/ids"
    files = tokenfile.write_files(df, folder, vocabulary("word_bpe_49k.json"), False)
    got = tokenfile.read_files(spark, files).collect()
    e = CachedEncoder(vocabulary("word_bpe_49k.json"), False)
    want = sorted(((i is not None, i or 0), [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in df.collect())
    have = sorted(((r.doc_id is not None, r.doc_id or 0), np.frombuffer(r.ids, "<u4").tolist()) for r in got)
    assert have == want
    at, last = 0, -1
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (r.doc_id is None and last == -1 or r.doc_id >= last)
        at, last = at + r.n_tokens, -1 if r.doc_id is None else r.doc_id
        assert r.ids_crc32 == zlib.crc32(r.ids)
    again = tokenfile.write_files(df, folder, vocabulary("word_bpe_49k.json"), False)
    assert sum(f[3] for f in again) == sum(f[3] for f in files)


def test_empty_table_to_files(spark, tmp_path):
    files = tokenfile.write_files(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/e", vocabulary("word_bpe_49k.json"), False)
    assert tokenfile.read_files(spark, files).count() == 0


def test_the_least_id_is_no_null(spark, tmp_path):
    df = spark.createDataFrame([(-(1 << 63), "a", 1), (None, "b", 2), (0, None, 3)], "doc_id long, text string, part int")
    files = tokenfile.write_files(df, f"file://{tmp_path}/n", vocabulary("word_bpe_49k.json"), False)
    assert [r.doc_id for r in sorted(tokenfile.read_files(spark, files).collect(), key=lambda r: r.start)] == [None, -(1 << 63), 0]


def sample_file(n=50, frame=400):
    out = io.BytesIO()
    w = tokenfile.Writer(out, frame_bytes=frame)
    for i in range(n):
        w.add(i, np.arange(i, dtype="<u4").tobytes())
    w.close()
    return out.getvalue()


def test_reader_decompresses_only_what_is_asked_for():
    r = tokenfile.Reader(io.BytesIO(sample_file()))
    assert np.frombuffer(r.ids(r.find(40)[0]), "<u4").tolist() == list(range(40))
    assert r.frames_read == 1 and len(r.packed) > 5


def test_frames_are_plain_zstandard():
    import zstandard

    data = sample_file()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain == b"".join(np.arange(i, dtype="<u4").tobytes() for i in range(50))


def test_damage_is_found():
    data = bytearray(sample_file())
    rng = random.Random(3)
    for _ in range(200):
        bad = bytearray(data)
        bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        try:
            r = tokenfile.Reader(io.BytesIO(bytes(bad)))
            got = [bytes(r.ids(i)) for i in range(len(r))]
        except Exception:
            continue
        assert got == [np.arange(i, dtype="<u4").tobytes() for i in range(50)]
    with pytest.raises(ValueError):
        tokenfile.Reader(io.BytesIO(b"short"))


CHANGES = "op string, source string, lang string, version string, tokens long, old_tokens long"


def test_rollup_sums_signed_changes_once(spark, tmp_path):
    r = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    a = spark.createDataFrame([("insert", "s", "en", "1", 10, None), ("insert", "s", "en", "1", 5, None), ("insert", None, None, "1", None, None)], CHANGES)
    b = spark.createDataFrame([("delete", "s", "en", "1", 5, None), ("revise", "s", "en", "1", 12, 10)], CHANGES)
    assert r.commit("a", a) and not r.commit("a", a) and r.commit("b", b)
    want = {("s", "en", "1", 1, 12), (None, None, "1", 1, 0)}
    assert {tuple(x) for x in r.totals().collect()} == want
    r.compact()
    assert not r.commit("b", b) and {tuple(x) for x in r.totals().collect()} == want
    assert r.commit("c", spark.createDataFrame([("delete", "s", "en", "1", 12, None)], CHANGES))
    assert {tuple(x) for x in r.totals().collect()} == {(None, None, "1", 1, 0)}
    r.compact()
    assert r.batches() == ["a", "b", "c"] and r.totals().count() == 1


def test_a_crash_within_compaction_counts_nothing_twice(spark, tmp_path):
    r = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    one = lambda n: spark.createDataFrame([("insert", "s", "en", "1", n, None)], CHANGES)
    r.commit("a", one(10))
    r.compact()
    r.commit("b", one(5))
    sweep, r._sweep = r._sweep, lambda: None
    r.compact()
    want = {("s", "en", "1", 2, 15)}
    # the old base and batch b are still there beside the new base that holds them
    assert len(r._complete("base-")) == 2 and r._complete("batch-") == ["b"]
    assert {tuple(x) for x in r.totals().collect()} == want and r.batches() == ["a", "b"]
    assert not r.commit("a", one(10)) and not r.commit("b", one(5))
    # a base without its mark of completion counts nothing
    (tmp_path / "r" / "base-x").mkdir()
    assert {tuple(x) for x in r.totals().collect()} == want
    r._sweep = sweep
    r.commit("c", one(1))
    r.compact()
    assert len(r._complete("base-")) == 1 and r._complete("batch-") == [] and r.batches() == ["a", "b", "c"]
    assert {tuple(x) for x in r.totals().collect()} == {("s", "en", "1", 3, 16)}
    r.compact()
    assert {tuple(x) for x in r.totals().collect()} == {("s", "en", "1", 3, 16)}


def test_unfinished_batch_is_overwritten(spark, tmp_path):
    r = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    left = tmp_path / "r" / "batch-a"
    left.mkdir(parents=True)
    (left / "part-x.parquet").write_bytes(b"half")
    assert r.batches() == []
    assert r.commit("a", spark.createDataFrame([("insert", "s", "en", "1", 1, None)], CHANGES))
    assert r.totals().collect()[0].n_tokens == 1


def test_unknown_change_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="no such op"):
        rollup.signed(spark.createDataFrame([("upsert", "s", "en", "1", 1, None)], CHANGES)).collect()


def test_op8_against_brute_force(spark):
    import pandas as pd

    d = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    e = CachedEncoder(vocabulary("byte_bpe_50k.json"), True)
    keep = d.sort_values("doc_id").drop_duplicates("text")
    want = {}
    for s, lang, t in zip(keep.source, keep.lang, keep.text):
        for v, n in (("words", len(WORDS.findall(t))), ("bpe-50k", len(e.tokenizer.encode(t, add_special_tokens=False).ids) + 1)):
            a, b = want.get((s, lang, v), (0, 0))
            want[s, lang, v] = (a + 1, b + n)
    got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.op8_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
