"""The dealt operators: edge cases, ties, repeated rows, clashing names, and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import base, bpe, chat, jaccard, langid, media, packing, pii, sharding, topk, warc
from factloom.llm.registry import QUERIES, SQL

TEXTS = [None, "", " ", "a", "The cat sat.", "The cat sat.", "é" * 3, "😀 <|endoftext|> \x00\x1f", "x" * 9000, "word " * 4000, "-"]
DOCS = "doc_id long, text string, lang string, source string, shard int, start string, node int, key string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, repeated rows, and names that operators use themselves."""
    rows = [(i, t, "en", "s", 1, "z", 2, "k") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(name, QUERIES[name], SQL[name])


# media


def padded(text):
    b = (text or "").encode()
    return b + b"\0" * ((-len(b)) % 64 or (0 if b else 64))


def test_media_round_trip(docs, empty):
    rows, store = media.write_store(docs)
    found = rows.join(media.media_features(media.read_store(store)).dropDuplicates(["media_id"]), "media_id").collect()
    assert len(found) == docs.count()
    expected = sorted((str(r.doc_id), len((r.text or "").encode()), hashlib.sha256(padded(r.text)).hexdigest(), zlib.crc32(padded(r.text)[-64:])) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_sha256.hex(), r.tail_crc32) for r in found) == expected
    rows, store = media.write_store(empty)
    assert rows.count() == 0 and media.read_store(store).count() == 0


def test_shared_passages_are_stored_once(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    texts = [f"{i} " * 50 + passage + str(i) for i in range(6)] + [passage + passage, "".join(rng.choice("xyz é") for _ in range(1_500_000))]
    rows, store = media.write_store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    stored = store.collect()
    owned = [bytes(p.digest) for r in stored for p in r.plan if p["from"] == p.seq]
    assert len(owned) == len(set(owned)) == len({bytes(p.digest) for r in stored for p in r.plan})
    sizes = [len(padded(t)) for t in texts]
    assert sum(len(r.own) for r in stored) < sum(sizes) - 5 * 5000
    assert {media.from_media(bytes(r.media))[1] for r in media.read_store(store).collect()} == {padded(t) for t in texts}


def test_full_marks_change_nothing(spark, monkeypatch):
    """A filter that hits everything sends all media through the joins: the store's chunks stay the same."""
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    texts = [f"{i} " * 40 + (passage if i % 3 else "") + "".join(rng.choice("xyz") for _ in range(3000)) for i in range(12)]
    df = spark.createDataFrame(list(enumerate(texts + texts[:2])), "doc_id long, text string")
    whole = lambda: sorted((bytes(r.media_id), [(p["from"], bytes(p.owner or b""), p.at) for p in r.plan], tuple(r.wanted or ()), bytes(r.own)) for r in media.write_store(df)[1].collect())
    few = whole()
    monkeypatch.setattr(media, "marks_of", lambda keys: media.Marks(np.full(16, (1 << 64) - 1, np.uint64)))
    assert whole() == few and len(few) == 12


def test_the_store_is_read_without_the_texts(spark, tmp_path):
    """The texts are gone before reading; a damaged chunk is refused, whether it is the media's own or another's."""
    import shutil

    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    texts = [(i, passage + f" {i}") for i in range(3)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    rows, store = media.write_store(spark.read.parquet(str(tmp_path / "docs")))
    shutil.rmtree(tmp_path / "docs")
    by_id = {bytes(r.media_id): bytes(r.media) for r in media.read_store(store).collect()}
    assert {r.doc_id: media.from_media(by_id[bytes(r.media_id)])[1] for r in rows.collect()} == {i: padded(t) for i, t in texts}
    damaged = [(r.media_id, r.plan, r.wanted, bytes([r.own[0] ^ 1]) + bytes(r.own[1:]) if r.wanted else r.own) for r in store.collect()]
    with pytest.raises(Exception, match="is damaged"):
        media.read_store(spark.createDataFrame(damaged, store.schema)).collect()


def test_repeated_rows_share_a_media(spark):
    """Each media is stored and rebuilt once, and each chunk asked for once, however often its row repeats."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    rows = [(1, passage + " one")] * 4 + [(2, passage + " two")] * 3 + [(None, passage)] * 2
    ids, store = media.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert ids.count() == len(rows) and store.count() == media.read_store(store).count() == 3
    wanted = [r.wanted for r in store.collect() if r.wanted]
    assert wanted and all(len(w) == len(set(w)) for w in wanted)


@pytest.mark.parametrize("size", [0, 1, 255, 256, 10_000, 100_000])
def test_cuts_are_bounded_and_whole(size):
    data = random.Random(size).randbytes(size)
    lengths = media.cut(data)
    assert sum(lengths) == size and all(n <= media.MOST for n in lengths) and all(n >= media.LEAST for n in lengths[:-1])
    assert media.cut(b"\0" * size) == media.cut(b"\0" * size)


def test_gear_hash_is_the_running_one():
    data, gear = random.Random(5).randbytes(3000), media.gear().tolist()
    h, cuts, last = 0, [], 0
    for i, b in enumerate(data):
        h = (h << 1) + gear[b] & 0xFFFFFFFF
        if h >> 22 == 0 and i + 1 - last >= media.LEAST:
            cuts.append(i + 1 - last)
            last = i + 1
    assert media.cut(data) == cuts + ([len(data) - last] if last < len(data) else [])


def test_damage_is_found(spark):
    text = "x y z " * 500
    m = media.to_media(text.encode())
    with pytest.raises(ValueError):
        media.from_media(m[:-1])


def test_media_query_equals_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op1_content_defined_chunks"](spark, data).collect()}
    assert len(got) == len(rows)
    for r in rows:
        p, g = padded(r.text), got[r.doc_id]
        want = (len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p) + media.HEADER, hashlib.sha256(media.to_media((r.text or "").encode())).hexdigest())
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32, g.media_bytes, g.media_sha256) == want
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(p, p[1:], strict=False))
        assert g.feature == f"sum={sum(p)} min={min(p)} max={max(p)} crossings={crossings}"


# sharding


def test_sharding_edges(docs, empty):
    out = sharding.assign_shards(docs.drop("shard"), "doc_id", [1.0] * 4, ["text"])
    rows = out.collect()
    assert len(rows) == docs.count() and "start" in out.columns
    for s in range(4):
        own = sorted(r.slot for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert sharding.assign_shards(empty.drop("shard"), "doc_id", [1.0] * 4).count() == 0


def test_repeated_records_are_numbered_by_their_count(spark):
    """Most rows under one key, and rows that repeat whole: gapless slots, and no window holds the key."""
    rows = [(None, "same")] * 900 + [(7, f"t{i}") for i in range(900)] + [(i, "x") for i in range(200)]
    out = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", [1.0, 2.0], ["text"]).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted((str(k), t) for k, t in rows)
    for s in range(2):
        own = sorted(r.slot for r in out if r["shard"] == s)
        assert own == list(range(len(own)))


def test_spread_deals_hot_keys_out(spark):
    rows = spark.range(8000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.lit("t").alias("text")).coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition
    try:
        sizes = [r["n"] for r in base.spread(rows).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 8000 and max(sizes) < 1.2 * 8000 / 4
    pieces = packing.pack(rows, packing.word_bpe_path(), with_ids=False).collect()
    assert sorted(r.sequence_id for r in pieces) == list(range(len(pieces)))


def test_few_records_move_and_weights_hold(spark):
    keys = spark.range(20_000).select(sharding.rendezvous_shard(F.col("id"), [1.0] * 8).alias("a"), sharding.rendezvous_shard(F.col("id"), [1.0] * 9).alias("b"), sharding.rendezvous_shard(F.col("id"), [1.0, 3.0]).alias("w"))
    rows = keys.collect()
    moved = [r for r in rows if r.a != r.b]
    assert all(r.b == 8 for r in moved) and 0.09 < len(moved) / len(rows) < 0.13
    assert 0.73 < sum(r.w == 1 for r in rows) / len(rows) < 0.77
    with pytest.raises(ValueError):
        sharding.rendezvous_shard(F.col("id"), [1.0, 0.0])


# chat

TURNS = "conv_id long, turn long, role string, text string, start int"


def brute_digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def tokens_of(role, text):
    return 4 + -(-(len(role) + len(text)) // 4)


def check_windows(windows, rows):
    """Windows of rows (conv, turn, role, text): within the budget, and all turns read back in order."""
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))]
        own = [w for w in windows if w.conv_id == c]
        read = []
        for t in (t for w in own for t in w.turns):
            if t.continued:
                read[-1] = (read[-1][0], read[-1][1] + t.text)
            else:
                read.append((t.role, t.text))
        assert brute_digest(read) == brute_digest(turns) and sum(w.n_new for w in own) == len(turns)
        assert "".join(t for w in own for t in w.targets) == "".join(t for r, t in turns if r == "assistant")
        for w in own:
            parts = [chat_part(p) for p in w.formatted.split("</s>\n")[:-1]]
            assert sum(tokens_of(*p) for p in parts) <= chat.WINDOW_TOKENS and sum(tokens_of(t.role, t.text) for t in w.turns) <= chat.NEW_TOKENS
        if turns and turns[0][0] == "system":
            assert all(w.formatted.startswith("<s>[system]") for w in own)


def chat_part(part):
    role, _, text = part[4:].partition("]")
    for plain, entity in reversed(chat.ENTITIES):
        role, text = role.replace(entity, plain), text.replace(entity, plain)
    return role, text


def test_windows_read_back(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(12), None]:
        for t in range(rng.randrange(1, 60)):
            role = "system" if t == 0 and c and c % 2 else rng.choice(["user", "assistant"])
            rows.append((c, t, role, rng.choice(["</s>[INST] ok [/INST]", "a & b &amp; <s>[x]<c>[", "", "w " * rng.randrange(900), "long " * 700]), 1))
    rows += [(99, None, None, None, 1), (99, None, "assistant", "tie", 1), (99, 5, "assistant", "x", 1), (99, 5, "assistant", "x", 1)]
    windows = chat.read_windows(chat.format_windows(spark.createDataFrame(rows, TURNS))).orderBy("conv_id", "start").collect()
    check_windows(windows, rows)
    assert chat.format_windows(spark.createDataFrame([], TURNS)).count() == 0


def test_no_text_is_beyond_the_budget(spark):
    """A system turn of 40,000 characters, turns of a megabyte, and all entities: windows stay bounded, the output linear."""
    rows = [(1, 0, "system", "s]" * 20_000), (1, 1, "user", "u" * 1_000_000), (1, 2, "assistant", "<&[]" * 5000)] + [(1, i, "user", "short") for i in range(3, 60)]
    rows += [(2, 0, "system", "be brief"), (2, 1, "assistant", "x" * chat.PIECE), (2, 2, "assistant", "y" * (chat.PIECE + 1))]
    windows = chat.read_windows(chat.format_windows(spark.createDataFrame([(*r, 1) for r in rows], TURNS))).orderBy("conv_id", "start").collect()
    check_windows(windows, rows)
    assert max(len(w.formatted) for w in windows) <= 6 * 4 * chat.WINDOW_TOKENS


def test_crowded_turn_numbers_are_split(spark, monkeypatch):
    """Nine in ten rows have no turn number, or one and the same, and many repeat whole: order and budget hold, and no block holds them."""
    monkeypatch.setattr(chat, "CROWDED", 20)
    rng = random.Random(8)
    rows = [(1, None, "user", f"{rng.choice('abcdef') * 9}{i % 40}") for i in range(300)] + [(1, 7, "assistant", "same " * 30)] * 200
    rows += [(1, i, "user", f"t{i}") for i in range(30)] + [(2, 3, "assistant", "same")] * 5
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], TURNS)
    check_windows(chat.read_windows(chat.format_windows(df)).orderBy("conv_id", "start").collect(), rows)
    placed = chat.blocks_of_turns(df.select(F.struct("conv_id").alias("conv"), "turn", "role", "text"))
    assert placed.groupBy("conv", "block").count().agg(F.max("count")).first()[0] <= 40


def test_prefix_sums_over_blocks(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(700)]
    placed = chat.positions(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("pos").collect()
    assert [r.pos for r in placed] == list(range(700)) and [r.text for r in placed] == [f"t{i}" for i in range(700)]
    assert all(b.before == a.before + a.tokens for a, b in zip(placed, placed[1:], strict=False))


# tokens


@pytest.fixture(scope="module")
def odd():
    return [t or "" for t in TEXTS] + ["\x1c\x1d x\x85y\xa0 z　 q  \t\n", "'s'S ''s don't", "漢字 👍🏽 ﬁ é", "ab" * 3000, "İ Σς ſ K ĲŒ ŉ", " " * 999 + "a", "<|startoftext|>Hi", "a,b. c. d,", "x.. y,. _. 'll"]


def test_bpe_equals_the_library(odd):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.byte_bpe_path()), bpe.load(bpe.byte_bpe_path())
    for t in odd:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids, t[:30]
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_table_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 500)
    own = bpe.Bpe(bpe.byte_bpe_path())
    text = "one two three four five six one two " + "x" * 100_000
    assert own.decode(own.encode(text)) == text and len(own.kept) <= 4 and max(map(len, own.kept)) <= bpe.LONGEST


def test_bpe_table(docs, empty):
    out = bpe.encode_decode(docs, bpe.byte_bpe_path())
    assert sorted((str(r.doc_id), r.decoded) for r in out.collect()) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert bpe.encode_decode(empty, bpe.byte_bpe_path()).count() == 0


def test_word_tokenizer_equals_the_library(odd, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.word_bpe_path())
    for most in (packing.KEPT_BYTES, 1000):
        monkeypatch.setattr(packing, "KEPT_BYTES", most)
        own = packing.WordTokenizer(packing.word_bpe_path())
        for t in odd + odd:
            assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:30]


@pytest.mark.parametrize("length", [1, 2, 3, 4095, 4096, 4097, 8192, 12_345])
def test_binary_pieces(length):
    pieces = packing.binary_pieces(length)
    assert pieces[0][0] == 0 and sum(n for _, n in pieces) == length
    assert all(n & (n - 1) == 0 and n <= 4096 for _, n in pieces)
    assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False))


def test_packing(docs, empty):
    rows = packing.pack(docs, packing.word_bpe_path()).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    by = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in by] == sorted((r.length for r in rows), reverse=True)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert sum(r.start == 0 for r in rows) == docs.count()
    assert packing.pack(empty, packing.word_bpe_path()).count() == 0


def test_bpe_query_equals_the_library(spark, data):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.byte_bpe_path())
    library.no_truncation()
    library.no_padding()
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op4_bpe_encode_decode"](spark, data).collect()}
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got.pop(r.doc_id) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert not got


def test_packing_query_equals_the_library(spark, data):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.word_bpe_path())
    library.no_truncation()
    library.no_padding()
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op5_binary_packing"](spark, data).collect()
    want = []
    for r in rows:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(r.doc_id, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids), 0) for s, n in packing.binary_pieces(len(ids))]
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in got) == sorted(want)
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))


# search


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    base[100:200] = base[100]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, []), (905, [1.0, 2.0]), (950, [3.0, 1.0]), (None, [1.0] * 8), (7, [0.5] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = topk.top_k(topk.sound_vectors(df, "id", "v"), F.col("vec_id") % 50 == 0, 5, block_rows=40).collect()
    sound = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, qv in ((i, v) for i, v in sound if i % 50 == 0):
        want = sorted((-int(qv @ v), i) for i, v in sound if i != q and len(v) == len(qv))[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want, q
    none = spark.createDataFrame([], "id long, v array<float>")
    assert topk.top_k(topk.sound_vectors(none, "id", "v"), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_large_components_are_exact(spark, duck):
    """Components beyond 2^25, 2^40 and 64 bits after scaling take part like all others."""
    rows = [(0, [1.0, 2.0]), (1, [200_000.0, 1.0]), (2, [3.0, 1.0]), (50, [3e30, -7.0]), (3, [-5e30, 1.0]), (4, [2.5e12, 1e12]), (100, [-1e300, 1.0]), (5, [1.7e308, 3.0]), (0, [1.0, 2.0]), (6, [1e-9, -1e-9]), (7, [4e30, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("x", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("part", F.lit(None))
    got = topk.top_k(topk.sound_vectors(df, "id", "v"), F.col("vec_id") % 50 == 0, 5).collect()
    exact = [(i, [topk.exact_row(np.array([c]))[0] for c in v]) for i, v in rows]
    for q in (0, 50, 100):
        qv = next(v for i, v in exact if i == q)
        want = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in exact if i != q)[:5]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [(r.score, r.vec_id) for r in own] == [(max(topk.LEAST, min(topk.MOST, -s)), i) for s, i in want], q
    small = [(i, v) for i, v in rows[:3]]
    duck.execute("create or replace temp view embeddings as select * from (values (0, [1.0, 2.0]), (1, [200000.0, 1.0]), (2, [3.0, 1.0])) t(vec_id, embedding)")
    try:
        by_sql = sorted(duck.execute(topk.OP6_SQL).fetchall())
    finally:
        duck.execute("drop view temp.embeddings")
    few = topk.top_k(topk.sound_vectors(spark.createDataFrame(small, "vec_id long, embedding array<float>"), "vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in few) == by_sql and len(by_sql) == 2


# language


def test_language_of_held_out_rows(spark, data):
    rows = langid_rows(spark, data)
    own = [r for r in rows if r.held_out and r.n_chars > 50]
    assert sum(r.lang_pred == r.lang for r in own) / len(own) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def langid_rows(spark, data):
    truth = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang", "n_chars")
    return QUERIES["op7_language_mixture"](spark, data).join(truth, "doc_id").collect()


def brute_mixture(text, counts):
    """Prediction and score by plain loops over trigram counts of each language."""
    def grams(t):
        letters = "".join(c if c.isalpha() else " " for c in t.lower())
        if not letters.strip():
            return []
        padded = re.sub(" +", " ", f" {letters} ")
        out = []
        for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
            a, b, c = (0 if x == " " else ord(x) for x in (a, b, c))
            h = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) % 2**64
            out.append((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64 >> 49)
        return out

    if isinstance(counts, list):  # training texts: (language, text)
        totals = {}
        for language, t in counts:
            totals.setdefault(language, {})
            for g in grams(t):
                totals[language][g] = totals[language].get(g, 0) + 1
        return totals
    own = grams(text or "")
    if not own:
        return "und", 0.0, []
    names = sorted(counts)
    sums = {n: sum(counts[n].values()) + 0.2 * langid.FEATURES for n in names}
    like = lambda n, g: (counts[n].get(g, 0) + 0.2) / sums[n]

    def em(languages):
        share = {n: 1 / len(languages) for n in languages}
        for _ in range(langid.ROUNDS):
            new = dict.fromkeys(languages, 0.0)
            for g in own:
                whole = sum(share[n] * like(n, g) for n in languages)
                for n in languages:
                    new[n] += share[n] * like(n, g) / whole / len(own)
            done = max(abs(new[n] - share[n]) for n in languages) < 1e-3
            share = new
            if done:
                break
        return share, sum(math.log(sum(share[n] * like(n, g) for n in languages)) for g in own)

    first = em(names)[0]
    order = sorted(names, key=lambda n: -first[n])
    sets = []
    for k in range(1, len(order) + 1):
        if k > 1 and first[order[k - 1]] < langid.SHARE:
            break
        share, fit = em(order[:k])
        sets.append((fit - langid.PENALTY * math.log(len(own) + 1) * k, -k, share))
    share = max(sets, key=lambda x: x[:2])[2]
    best = min(share, key=lambda n: (-share[n], n))
    return best, min(1.0, share[best]), sorted(share)


def test_language_query_equals_brute_force(spark, data):
    """Every document of the query against loops over the trigrams of the rows that may be learned from."""
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    counts = brute_mixture(None, [(r.lang, r.text) for r in rows if r.lang is not None and r.text is not None and not held[r.doc_id]])
    got = {r.doc_id: r for r in QUERIES["op7_language_mixture"](spark, data).collect()}
    assert len(got) == len(rows)
    short = [r for r in rows if len(r.text or "") < 3000]
    assert len(short) > 100
    for r in short:
        lang, score, kept = brute_mixture(r.text, counts)
        g = got[r.doc_id]
        assert (g.held_out, g.lang_pred, g.lang_set) == (held[r.doc_id], lang, kept) and abs(g.score - score) < 2e-3, r.doc_id


def test_score_is_refitted_on_the_kept_set():
    """Two languages of which the penalty keeps one: its proportion is 1, whatever the first mixture said."""
    buckets = np.unique(langid.trigram_buckets("abc abd"))
    model = langid.model_of({"aa": (buckets, np.full(len(buckets), 20_000)), "bb": (buckets, np.full(len(buckets), 19_900))})
    assert langid.infer(model, "abc abd") == ("aa", 1.0, ["aa"])


def test_every_label_is_learned(spark, monkeypatch):
    """300 labels, most of one row: each can be predicted; counts are emitted while they are made."""
    monkeypatch.setattr(langid, "HELD_LANGUAGES", 7)
    rng = random.Random(9)
    words = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for i in range(300)}
    rows = [(i, " ".join(w), k) for i, (k, w) in enumerate(words.items())] * 2 + [(1000 + i, " ".join(words["l007"]), "l007") for i in range(50)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), "lang", "text", "doc_id")
    assert model.languages == sorted(words)
    assert [langid.infer(model, " ".join(w[::-1]))[0] for w in words.values()] == list(words)
    dense = model.likelihood(np.arange(langid.FEATURES))
    assert dense.shape == (langid.FEATURES, 300) and np.allclose(dense.sum(0), 1, atol=1e-3)


def test_language_edges(spark, docs, empty):
    model = langid.train(spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "x", None), (4, None, "fr")], "doc_id long, text string, lang string"), "lang", "text", "doc_id")
    assert model.languages == ["de", "en"]
    assert langid.infer(model, None) == ("und", 0.0, []) and langid.infer(model, "12 -- 😀") == ("und", 0.0, [])
    assert langid.infer(model, "the dog and the cat ")[0] == "en"
    mixed = langid.infer(model, "the cat and the dog " * 20 + "der hund und die katze " * 20)
    assert mixed[2] == ["de", "en"]
    clash = docs.withColumn("score", F.lit("old"))
    assert langid.identify(clash, model).count() == docs.count()
    assert langid.identify(empty, model).count() == 0
    assert langid.train(empty, "lang", "text", "doc_id").languages == []
    assert langid.identify(docs, langid.model_of({})).filter("lang_pred <> 'und'").count() == 0


# near duplicates


def brute_classes(texts, width, share):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        n = min(width, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and share[1] * len(a & b) >= share[0] * len(a | b) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return [len(s) for s in sets], root


@pytest.mark.parametrize(("width", "share"), [(4, (85, 100)), (5, (80, 100))])
def test_classes_against_brute_force(spark, width, share, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # several blocks in a cluster
    monkeypatch.setattr(jaccard, "CLUSTER", 8)  # and clusters that share a task, or don't
    monkeypatch.setattr(jaccard, "SMALL", 6)  # and frequent n-grams
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    base = [word() for _ in range(60)]
    texts = []
    for _ in range(70):  # near copies at all distances
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(60)] = word()
        texts.append(" ".join(w))
    passage = " ".join(word() for _ in range(20))
    texts += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(20)]
    texts += [None, "", " \t ", "One two", "one TWO", "one two three", "Ünì Ünì Ünì Ünì ünì", texts[0], texts[0].upper(), "a b c d", "a  b\nc d", "a b c d e"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.set_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", width, share).collect()}
    sizes, roots = brute_classes(texts, width, share)
    assert got == {i: (n, r) for i, (n, r) in enumerate(zip(sizes, roots, strict=True))}


def test_classes_edges(docs, empty):
    out = jaccard.set_classes(docs, "doc_id", "text").collect()
    assert len(out) == docs.count() and {r.component_id for r in out if r.doc_id in (4, 5)} == {4}
    assert jaccard.set_classes(empty, "doc_id", "text").count() == 0


def test_repeated_rows_are_one_node(spark):
    """Rows that repeat key and text, and keys that repeat with other texts: links count sets."""
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[: 60 - k], *["x"] * k]) for k in range(4)]
    rows = [(1, near[0])] * 5 + [(2, near[1])] * 3 + [(2, near[2])] * 2 + [(None, near[3]), (None, near[3]), (3, "alone in the world it is"), (3, "alone in the world it is")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.set_classes(docs, "doc_id", "text").collect()
    sets = {t: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for _, t in rows}
    links = {t: sum(u != t and 100 * len(s & o) >= 85 * len(s | o) for u, o in sets.items()) for t, s in sets.items()}
    expected = [(d, len(sets[t]), 3 if d == 3 else 1, links[t]) for d, t in rows]
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id, r.links) for r in got) == sorted((str(d), *x) for d, *x in expected)


def test_overlaps_are_sums_of_fragments(monkeypatch):
    """Partial overlaps of every fragment, as a matrix and as pairs, sum up to the overlaps of whole sets."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, (1 << 64) - 1, 300, np.uint64)
    sets = [np.unique(pool[rng.integers(0, 300, 120)]) for _ in range(9)]
    key = np.sort(pool[:80] >> np.uint64(64 - jaccard.KEY_BITS))
    order = jaccard.Order(256, np.zeros(1 << 10, np.uint8), key, np.arange(8, 88))
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    fragments = sorted({f for s in sets for f in order.fragments(s).tolist()})
    assert len(fragments) > 8
    position = np.lexsort((pool, order.classes(pool)))  # the order's fragments are contiguous
    assert (np.diff(order.fragments(pool)[position]) >= 0).all()
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    whole, pairs = np.zeros((9, 9), int), np.zeros((9, 9), int)
    for f in fragments:
        cut = [s[order.fragments(s) == f] for s in sets]
        whole += jaccard.overlaps(cut, list(cut))
        a, b, n = jaccard.meeting_pairs(np.zeros(9, int), cut)
        pairs[a, b] += n
    assert whole.tolist() == want
    assert all(pairs[i, j] == want[i][j] for i in range(9) for j in range(i + 1, 9))


def test_a_passage_in_most_documents(spark):
    """A boilerplate passage that two thirds of all documents hold ties none of them that isn't near another."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    texts = [passage + " " + " ".join(word() for _ in range(rng.randrange(30, 200))) for _ in range(160)] + [" ".join(word() for _ in range(80)) for _ in range(60)]
    texts += [texts[3] + " tail", texts[200] + " tail", passage, passage + " x"]
    out = jaccard.set_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()
    sizes, roots = brute_classes(texts, 4, (85, 100))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == {i: x for i, x in enumerate(zip(sizes, roots, strict=True))}


# personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for number, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(digits)))
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), number, m.end()))
    return sorted(out)


PII_TEXTS = [
    None, "", "a@b.c+x@d.e @d.e x@y..z a@b.c@d.e", "1.2.3.4.5 256.1.1.1 1.2.3.0004 1..2.3.4", "9" * 20_000, "4111 1111 1111 1111- 4111111111111112", "+1 (222) 333-4444 +12 +1" + "(" * 50,
    "😀a@b.co 😀4111111111111111", "a." * 9000 + "@", "1-" * 9000, "123-45-6789 call 555-123-4567 joe (at) mail (dot) com password=abc12345x", "plain words only",
]


def test_base_spans_against_brute_force(spark):
    rng = random.Random(9)
    texts = PII_TEXTS + ["".join(rng.choice("a1.@ -+()9") for _ in range(200)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, _ = pii.find_spans(df)
    for r in found.collect():
        assert [(s.start, s.kind, s.end) for s in r._spans if s.base] == brute_base(texts[r.doc_id] or ""), texts[r.doc_id]
        assert not any(a is not b and a.base and not b.base and a.start < b.end and b.start < a.end for a in r._spans for b in r._spans)


def test_redaction_and_edges(spark, docs, empty):
    df = spark.createDataFrame([(1, "mail me: anna@x.org or +1 (222) 333-4444!"), (2, "clean"), (3, None)], "doc_id long, text string")
    found, model = pii.find_spans(df)
    assert {r.doc_id: r.text for r in pii.redact(found).collect()} == {1: "mail me: [EMAIL] or [PHONE]!", 2: "clean", 3: None}
    assert 0.5 < model.reliability["gazetteer"] < 1
    assert pii.find_spans(docs)[0].count() == docs.count() and pii.find_spans(empty)[0].count() == 0


def test_long_secrets_and_spelled_addresses_are_whole(spark):
    rng = random.Random(4)
    token = "".join(rng.choice("abcXYZ0189_-./+") for _ in range(1000))
    local, domain = "anna." * 20 + "bell", " (dot) ".join(["mail", "b" * 70, *"cdefghij"])
    rows = [("token=", f"{token}"), ("", f"{local} (at) {domain}"), ("password: ", "abc12345x"), ("secret=", "k9" * 20_000), ("", "joe (at) mail" + " (dot) a" * 5000)]
    df = spark.createDataFrame([(i, f"see {head}{body} there, and on") for i, (head, body) in enumerate(rows)], "doc_id long, text string")
    found = pii.candidates(df)
    wide = found.withColumn("_spans", F.filter("_spans", lambda s: s["kind"].isin(pii.KINDS.index("secret"), pii.KINDS.index("email_spelled"))))
    assert {r.doc_id: [s.surface for s in r._spans] for r in wide.collect()} == {i: [head + body] for i, (head, body) in enumerate(rows)}
    kinds = ["SECRET", "EMAIL_SPELLED", "SECRET", "SECRET", "EMAIL_SPELLED"]
    assert {r.doc_id: r.text for r in pii.redact(wide).collect()} == {i: f"see [{k}] there, and on" for i, k in enumerate(kinds)}


def test_base_of_the_query_equals_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op9_weak_supervision_pii"](spark, data).collect()}
    assert len(got) == len(rows)
    names = list(BASE)
    for r in rows:
        spans, g = brute_base(r.text or ""), got[r.doc_id]
        written = [f"{names[k]}:{s}:{e}" for s, k, e in spans]
        assert [g[f"n_{k}"] for k in names] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert g.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest() and set(written) <= set(g.spans.split(",")) | {""}


def test_many_hits_in_one_text(spark):
    """Spans and redaction of a text with tens of thousands of hits, over several pieces of the running sums."""
    n = 12_000
    df = spark.createDataFrame([(1, "é 1.2.3.4 password=abc12345x a@b.co\n" * n)], "doc_id long, text string")
    found, _ = pii.find_spans(df)
    r = pii.redact(found).first()
    assert [(s.start, s.kind, s.end) for s in r._spans if s.base] == brute_base(df.first().text) and len(r._spans) == 3 * n
    assert r.text == "é [IP] [SECRET] [EMAIL]\n" * n


def test_labelers_are_told_apart():
    """A labeler that votes at random is trusted less than two that agree with the truth."""
    rng = random.Random(1)
    counts: dict = {}
    for _ in range(4000):
        truth = rng.random() < 0.5
        vote = lambda right: (1 if truth else -1) * (1 if rng.random() < right else -1)
        pattern = (vote(0.95), vote(0.9), vote(0.5), vote(0.9), 0)
        counts[pattern] = counts.get(pattern, 0) + 1
    accuracy, share, _ = pii.estimate([(0, v, n) for v, n in sorted(counts.items())])
    assert accuracy[0] > 0.9 and accuracy[2] < 0.6 and abs(share[0] - 0.5) < 0.05


# archives


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(7)
    page = lambda: "<p>" + "".join(rng.choice("abc <>é") for _ in range(rng.randrange(3000))) + "</p>"
    rows = [(i, f"http://x/{i}", page(), 1) for i in range(200)]
    rows += [(300, None, rows[5][2], 1), (2, "u", rows[9][2], 1), (301, "u\r\nX: y", "short", 1), (302, "u", "short", 1), (303, "u", None, 1), (None, "u", rows[5][2], 1), (None, "u", "z" * 500, 1), (7, "u", rows[7][2], 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive int")
    archives = warc.write_archives(pages)
    got = warc.read_archives(archives).collect()
    assert len(got) == len(rows)
    least: dict = {}
    for i, _, html, _ in rows:
        if i is not None and html and len(html.encode()) >= 100:
            least[html] = min(i, least.get(html, i))
    want = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        first = least.get(html) if len(data) >= 100 else None
        again = first is not None and i != first
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=lambda r: r[:4])
    for n, r in enumerate(archives.collect()):
        (tmp_path / f"{n}.warc.zst").write_bytes(bytes(r["data"]))
    assert warc.read_files(spark, str(tmp_path)).count() == len(rows)
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_reading_takes_time_in_proportion():
    """The bytes that a frame leaves unused are less than a piece, however long the archive is."""
    rng = random.Random(2)
    payloads = [rng.randbytes(rng.choice([10, 3000, 40_000])) for _ in range(3000)]
    data = warc.write_archive([warc.write_record("response", i, "u", hashlib.sha256(p).hexdigest(), len(p), None, p) for i, p in enumerate(payloads)])
    import time

    began = time.perf_counter()
    first = [r["payload"] for r, _ in zip(warc.read_archive(data), range(300), strict=False)]
    tenth = time.perf_counter() - began
    assert first == payloads[:300] and [r["payload"] for r in warc.read_archive(data)] == payloads
    assert time.perf_counter() - began - tenth < 40 * tenth + 2


def test_archive_has_a_dictionary_and_a_frame_for_each_record():
    import zstandard

    payloads = [f"<html><body>{i} common words in every page {'abc ' * 900}{i * 7}</body></html>".encode() for i in range(60)]
    records = [warc.write_record("response", i, "u", hashlib.sha256(p).hexdigest(), len(p), None, p) for i, p in enumerate(payloads)]
    data = warc.write_archive(records)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert [r["payload"] for r in warc.read_archive(data)] == payloads
    size = int.from_bytes(data[4:8], "little")
    assert data[8:12] == (0xEC30A437).to_bytes(4, "little")
    small = zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    packed = data[:4] + len(small).to_bytes(4, "little") + small + data[8 + size :]
    assert sum(1 for _ in warc.read_archive(packed)) == 60  # the dictionary may be compressed itself


@pytest.mark.parametrize("change", [lambda d: d[:-3], lambda d: d[:20], lambda d: d[:-20] + bytes([d[-20] ^ 1]) + d[-19:]])
def test_damaged_archives_are_refused(change):
    payload = b"p" * 400
    records = [warc.write_record("response", i, "u", hashlib.sha256(payload).hexdigest(), len(payload), None, payload) for i in range(3)]
    with pytest.raises(warc.BadRecord):
        list(warc.read_archive(change(warc.write_archive(records))))


@pytest.mark.parametrize(
    "record",
    [b"HTTP/1.1\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n", b"WARC/1.1\r\nbroken\r\n\r\n", b"WARC/1.1\r\nWARC-Type: other\r\nContent-Length: 1\r\n\r\na\r\n\r\n"],
)
def test_bad_records_are_refused(record):
    with pytest.raises(warc.BadRecord):
        warc.read_record(record)
