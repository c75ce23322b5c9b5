"""The operators for training data against brute force, an exact round trip, or known cases."""

import base64
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dumpquarry.llm import bpe, mojibake, packing, queries, sampling

DOCS = "doc_id long, text string, lang string, doc string"


# --- fixed-size sample


def brute_reservoir_counts(n, k, runs, buffer):
    seen = Counter()
    for seed in range(runs):
        g = sampling.GeometricFile(k, np.random.default_rng(seed), buffer)
        for chunk in np.array_split(np.arange(n), 5):
            g.add(chunk)
        held = g.sample()
        assert len(set(held.tolist())) == min(k, n)
        seen.update(held.tolist())
    return seen


@pytest.mark.parametrize(("n", "k", "buffer"), [(60, 10, 3), (200, 16, 16), (50, 40, 7), (30, 10, 1)])
def test_geometric_file_is_uniform(n, k, buffer):
    runs = 3000
    seen = brute_reservoir_counts(n, k, runs, buffer)
    expected = runs * k / n
    chi2 = sum((seen[i] - expected) ** 2 / expected for i in range(n)) / (1 - k / n)
    assert chi2 < n - 1 + 5 * math.sqrt(2 * (n - 1))


def test_geometric_file_on_disk_equals_memory(tmp_path):
    a = sampling.GeometricFile(500, np.random.default_rng(7), 32)
    b = sampling.GeometricFile(500, np.random.default_rng(7), 32, str(tmp_path), memory_records=10)
    for chunk in np.array_split(np.arange(20_000), 9):
        a.add(chunk)
        b.add(chunk)
    assert b.path and b.path.exists()
    assert sorted(a.sample().tolist()) == sorted(b.sample().tolist())
    assert not b.path.exists()


def test_geometric_file_short_and_empty():
    g = sampling.GeometricFile(100, np.random.default_rng(1))
    assert len(g.sample()) == 0
    g = sampling.GeometricFile(100, np.random.default_rng(1))
    g.add(np.arange(7))
    assert sorted(g.sample().tolist()) == list(range(7))


def test_merge_is_weighted_by_population():
    counts = Counter()
    for seed in range(2000):
        rng = np.random.default_rng(seed)
        merged = sampling.merge_samples([90, 10], [rng.choice(90, 10, replace=False), 90 + np.arange(10)], 10, rng)
        assert len(set(merged.tolist())) == 10
        counts["b"] += int((merged >= 90).sum())
    assert abs(counts["b"] / 2000 - 1.0) < 0.1


def test_shares_beyond_numpy():
    got = sampling.shares([3_000_000_000, 1_000_000_000], 400, np.random.default_rng(3))
    assert sum(got) == 400 and 250 < got[0] < 350
    assert sampling.shares([2, 3], 9, np.random.default_rng(3)) == [2, 3]


def test_sample_ignores_repeats_nulls_and_extra_columns(spark):
    rows = [(i % 500, "x") for i in range(3000)] + [(7, "hot")] * 3000 + [(None, "y")]
    df = spark.createDataFrame(rows, "id long, shard string").withColumnRenamed("shard", "population")
    got = [r.id for r in sampling.fixed_size_sample(df, "id", 50).collect()]
    assert len(got) == 50 == len(set(got)) and None not in got
    again = [r.id for r in sampling.fixed_size_sample(df, "id", 50).collect()]
    assert sorted(got) == sorted(again)
    assert sampling.fixed_size_sample(df.limit(0), "id", 50).collect() == []
    few = sampling.fixed_size_sample(df.where("id < 5"), "id", 50).collect()
    assert sorted(r.id for r in few) == [0, 1, 2, 3, 4]


def test_sample_is_uniform_over_ids_whatever_their_rows(spark):
    df = spark.range(40).selectExpr("id", "explode(sequence(0, case when id < 4 then 30 else 0 end)) as n")
    seen = Counter()
    runs = 60
    for seed in range(runs):
        seen.update(r.id for r in sampling.fixed_size_sample(df, "id", 10, seed=seed).collect())
    assert all(2 <= seen[i] <= 32 for i in range(40)) and sum(seen.values()) == runs * 10
    assert 30 <= sum(seen[i] for i in range(4)) <= 90


def test_sample_size_holds_for_any_number_of_partitions(spark):
    df = spark.range(0, 3000, 1, 150)
    for rows in (df, df.repartition(150, "id")):
        got = [r.id for r in sampling.fixed_size_sample(rows, "id", 50).collect()]
        assert len(got) == 50 == len(set(got))


def test_p1_sample_has_100_ids_whatever_partitions_aqe_begins_with(spark, tmp_path):
    for table, n in (("posts", 3000), ("users", 2000)):
        spark.range(n).write.parquet(f"{tmp_path}/{table}.parquet")
    aqe = "spark.sql.adaptive."
    confs = {"coalescePartitions.initialPartitionNum": "150", "coalescePartitions.parallelismFirst": "false", "coalescePartitions.minPartitionSize": "1b", "advisoryPartitionSizeInBytes": "1b"}
    for name, value in confs.items():
        spark.conf.set(aqe + name, value)
    try:
        rows = [(r.table_name, r.id) for r in queries.p1_sample(spark, str(tmp_path)).collect()]
    finally:
        for name in confs:
            spark.conf.unset(aqe + name)
    assert len(set(rows)) == len(rows) and Counter(t for t, _ in rows) == {"posts": 100, "users": 100}


def test_sample_is_uniform_over_several_merges(spark, monkeypatch):
    monkeypatch.setattr(sampling, "FAN_IN", 2)
    df = spark.range(0, 40, 1, 7).where("id < 4 or id % 2 = 0")  # shards of unequal population
    seen = Counter()
    runs = 60
    for seed in range(runs):
        seen.update(r.id for r in sampling.fixed_size_sample(df, "id", 11, seed=seed).collect())
    assert len(seen) == 22 and sum(seen.values()) == runs * 11
    assert all(12 <= n <= 48 for n in seen.values())


# --- encoding


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute_merge(e, piece):
    """Scan all pairs for the smallest rank, merge its leftmost place, begin again."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        ranked = [(e.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(ranked)
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [e.ranks[p] for p in parts]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_the_library(text):
    import tiktoken

    e = bpe.encoder(bpe.VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    ids = e.encode(text)
    assert ids == own.encode_ordinary(text)
    assert e.decode(ids).decode() == text


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_segment_tree_equals_brute_force(piece):
    e = bpe.encoder(bpe.VOCABULARY)
    assert e.merge(piece) == brute_merge(e, piece)


def test_long_pretokens(reference):
    e = bpe.encoder(bpe.VOCABULARY)
    for text in ("a" * 50_000, " " * 20_001, "ab" * 9_999, "é" * 5_000, "".join(random.Random(5).choices("abcdefgh", k=30_000))):
        assert e.encode(text) == reference.encode_ordinary(text)


def test_encode_corpus(spark, reference):
    texts = ["Hello world", None, "", " ", "<|endoftext|> x", "naïve ’s 你好\r\n\t🇵🇱", "Hello world"]
    df = spark.createDataFrame([(i, t, None, "z") for i, t in enumerate(texts)] + [(None, "a", None, None)], DOCS).withColumnRenamed("doc", "ids")
    got = bpe.encode_corpus(df).collect()
    assert len(got) == 8
    for r in got:
        assert list(r.ids) == (reference.encode_ordinary(texts[r.doc_id] or "") if r.doc_id is not None else reference.encode_ordinary("a"))
    assert bpe.encode_corpus(df.limit(0)).collect() == []
    assert {r.doc_id: r.tokens for r in bpe.count_tokens(df).collect()}[1] == 0


# --- packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_packing_keeps_capacity_and_items(sizes):
    inside = packing.best_two_fit(sizes, 50)
    assert len(inside) == len(sizes)
    used = Counter()
    for s, c in zip(sizes, inside):
        used[c] += s
    assert all(v <= 50 for v in used.values())
    # never worse than one container more than twice the least possible
    assert len([v for v in used.values() if v]) <= 2 * math.ceil(sum(sizes) / 50) + 1


def test_two_fit_beats_plain_greedy():
    # greedy puts 6 and 3 together (1 unused); the 3 gives way to 2 + 2
    inside = packing.best_two_fit([6, 3, 2, 2], 10)
    assert inside[0] == inside[2] == inside[3] != inside[1]


def test_pack(spark):
    rows = [(1, 2048), (2, 5000), (3, 0), (4, None), (5, 1), (6, 2047), (6, 10)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, tokens long, container_id string")
    got = packing.pack(df).collect()
    assert [(r.piece, r.tokens) for r in sorted(got, key=lambda r: r.piece) if r.doc_id == 2] == [(0, 2048), (1, 2048), (2, 904)]
    used = Counter()
    for r in got:
        used[r.container_id] += r.tokens
    assert max(used.values()) <= 2048 and sum(used.values()) == 2048 + 5000 + 1 + 2047 + 10
    assert len(got) == 9 and all(r.container_id is not None for r in got)
    assert packing.pack(df.limit(0)).collect() == []
    many = packing.pack(df, shard_items=2).collect()
    assert sum(r.tokens for r in many) == sum(used.values())


# --- wrong encodings

PROPER = [
    "It’s 30 × slower on the café tenant’s copy than on ours, naïve as that sounds.",
    "The old importer showed “Ã©” wherever the source had “é”; that was fixed.",
    "Test data for the decoder: `â€œ`, `Ð¿`, `Å‚`, `ï»¿`; keep these literals as they are.",
    "If a value shows the sign � then the byte was lost.",
    "a client displays Â£ instead of £ — our file is right.",
    "¤ ¦ § ¬ ± µ ¶ · Ø Þ ß ð ÷ ø þ ™ ‰ †",
    "Ãnamar, Ðorvald, Þura, Åse, Øyvor, Çelma, Ñuria.",
    "SUPRESSÃO, SEÇÃO, AÇÃO, NÃO; ÂNGULO, ÊXITO.",
    "├── comments\n│   ├── depth\n└── sessions",
    "école, über, ñ",
    "zero​width‍join﻿ 🇵🇱🏳️‍🌈🧵 １２３ ﬁle ⅷ ²",
    "Повторный запуск занял 42 минуты. Таблица восстановлена.",
    "テーブルを復元しましたが、行が見つかりません。",
    "Ödeme kayıtlarının güncellenmesi sürdü. Çığ, şişe.",
    "Należy usunąć zduplikowane zgłoszenia i ponownie wczytać plik.",
    "Où se trouve la référence créée le mois dernier ?",
    "नमस्ते สวัสดี مرحبا שלום",
]
SPOILT = [
    ("Die frühere Spalte entfällt für größere Mandanten.", "utf_8", "cp1252"),
    ("Les données dupliquées ont été supprimées.", "utf_8", "cp437"),
    ("Повторный запуск занял 42 минуты.", "utf_8", "cp866"),
    ("Значение не должно меняться", "cp1251", "latin_1"),
    ("Należy usunąć zduplikowane zgłoszenia.", "utf_8", "mac_roman"),
    ("Straße und Größe stehen jetzt in media.", "cp1252", "mac_roman"),
]


@pytest.mark.parametrize("text", PROPER)
def test_proper_texts_are_no_cases(text):
    assert mojibake.examine(text, False)[0] is False
    assert mojibake.cost(text) == 0


@pytest.mark.parametrize(("text", "written", "wrong"), SPOILT)
def test_spoilt_texts_are_found_and_restored(text, written, wrong):
    spoilt = text.encode(written).decode(wrong)
    found, restored, used = mojibake.examine("As said before.\n" + spoilt, True)
    assert found and used
    assert restored == "As said before.\n" + text


def test_twice_spoilt_and_lossy():
    text = "Ein Zeichen fehlt: größer"
    twice = text.encode().decode("cp1252").encode().decode("cp1252")
    assert mojibake.examine(twice, True)[1] == text
    assert mojibake.examine("The reviewer�s note", False)[0]


def test_garbled(spark):
    texts = [None, "", " ", "plain", "It’s fine", "Itâ€™s not", "x" * 50_000 + " cafÃ©", "Itâ€™s not"]
    df = spark.createDataFrame([(i, t, None, "z") for i, t in enumerate(texts)] + [(7, "Itâ€™s not", None, None)], DOCS).withColumnRenamed("doc", "restored")
    assert sorted(r.doc_id for r in mojibake.garbled(df).collect()) == [5, 6, 7]
    restored = {r.doc_id: r.restored for r in mojibake.garbled(df, restore=True).collect()}
    assert restored[5] == "It’s not" and restored[6].endswith(" café")
    assert mojibake.garbled(df.limit(0)).collect() == []


def test_queries_are_registered():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("text", ["фбвмйгб чпууфбопчмеоб, оп ч оек ое ичбфбеф уфтпл.", "ч ЧЕТУЙЙ 0.3.4 ЙУРТБЧМЕОБ ПЫЙВЛБ РТЙ ЮФЕОЙЙ ЛМАЮЕК", "The reviewerís note:", "loadsγçª Fixed", "Proszê sprawdziæ, dlaczego ma b³êdn± warto¶æ.", "Ödeme kayýtlarýnýn sürdü."])
def test_single_byte_mixups_are_found(text):
    assert mojibake.examine(text, False)[0]


def test_mixed_languages_are_no_case():
    assert not mojibake.examine("values changed between the loads… İki kopya arasında 56 kayıt farkı var, bu oldukça şaşırtıcı.", False)[0]


def test_lower_case_after_the_damage():
    spoilt = "Häufig genügt es, Schlüssel zu prüfen".encode().decode("cp1252").lower()
    assert mojibake.examine(spoilt, True)[1] == "häufig genügt es, schlüssel zu prüfen"
