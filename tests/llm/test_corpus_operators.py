"""Decontamination, token files, sharding, mixing, chat, near duplicates and the pipeline against brute force."""

import hashlib
import itertools
import re
import uuid
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from edge_rows import PROSE, ROWS, SCHEMA, edge_docs, no_docs, rows_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stockroom.llm import (
    chat_format, decontamination, jaccard_join, mixing, quality_rules, queries, shared_tokens, sharding, token_files,
)
from stockroom.llm.components import components
from stockroom.session import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def tiny(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


# decontamination


def brute_hits(text, items):
    words = ITEM_WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, content in items:
        own = ITEM_WORD.findall((content or "").translate(LOWER))
        k = min(10, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(item)
    listed = ",".join(sorted(str(i) for i in found if i is not None))
    n_items = len({i for i in found if i is not None})
    return len(words), hit, n_items, hashlib.sha256(listed.encode()).hexdigest()


ITEMS = [
    (1, "Three, four FIVE six seven eight nine ten eleven twelve thirteen"),
    (10, "three four five six seven eight nine ten eleven twelve"),
    (2, "no id"),
    (3, "a"),
    (4, None),
    (5, "..."),
    (6, "SPAM spam"),
    (None, "dup id"),
    (7, "ünïcode nb"),
    (7, "Ünïcode nb"),
]


@pytest.mark.parametrize("broadcast", [decontamination.MAX_BROADCAST, 0])
def test_decontamination_equals_brute_force(spark, broadcast):
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontamination.report(edge_docs(spark), benchmark, max_broadcast=broadcast)
    want = []
    for r in ROWS:
        n, hit, items, digest = brute_hits(r[1], ITEMS)
        want.append((r[0], n, len(hit), items, digest, len(hit) > 0))
    assert rows_of(got) == sorted(want, key=repr)


def test_removal(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    kept = decontamination.remove(edge_docs(spark), benchmark)
    clean = [r for r in ROWS if not brute_hits(r[1], ITEMS)[1]]
    assert rows_of(kept) == sorted(clean, key=repr)
    cut = decontamination.remove(edge_docs(spark), benchmark, spans=True)
    want = []
    for r in ROWS:
        hit = brute_hits(r[1], ITEMS)[1]
        place = itertools.count()
        text = r[1] and re.sub(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lambda m: "" if next(place) in hit else m[0], r[1])  # noqa: B023
        want.append((r[0], text, *r[2:]))
    assert rows_of(cut) == sorted(want, key=repr)


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.report(no_docs(spark), none).collect() == []
    assert not any(r.contaminated for r in decontamination.report(edge_docs(spark), none).collect())
    assert decontamination.remove(edge_docs(spark), none).count() == len(ROWS)


# token files


def test_token_files_equal_the_library(spark, tiny):
    library = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    for docs in (edge_docs(spark), tiny, no_docs(spark)):
        path = f"{shared_folder(spark)}/test-tokens-{uuid.uuid4().hex}"
        token_files.write(docs, path)
        segments = token_files.read(spark, path)
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
        want, start, every = [], 0, []
        for known, doc, text in rows:
            ids = [*library.encode(text, add_special_tokens=False).ids, 1]
            want.append((doc if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start, every = start + len(ids), every + ids
        assert rows_of(token_files.digests(segments)) == sorted(want, key=repr)
        assert sorted(x for r in token_files.documents(segments).collect() for x in r.ids) == sorted(every)
        asked = list(range(0, len(every), 997))
        places = spark.createDataFrame([(p,) for p in asked], "position bigint")
        found = {r.position: r.token for r in token_files.tokens_at(segments, places).collect()}
        assert found == {p: every[p] for p in asked}


def test_repeated_positions_and_rows_of_one_id(spark, tmp_path, monkeypatch):
    """Small ranges and segments: rows of one id spread over ranges, and positions asked more than once."""
    monkeypatch.setattr(token_files, "RANGE_BYTES", 500)
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 64)
    texts = [f"{k:03} words of text {k * k}" for k in range(120)] + ["same text"] * 5 + [None]
    rows = [(None if k % 3 else 7, t) for k, t in enumerate(texts)]
    path = str(tmp_path / "ids")
    token_files.write(spark.createDataFrame(rows, "doc_id bigint, text string"), path)
    segments = token_files.read(spark, path)
    assert segments.select("range_no").distinct().count() > 4
    ordered = sorted(rows, key=lambda r: (r[0] is not None, (r[1] or "").encode()))
    known = token_files.encoder(token_files.VOCABULARY)
    ids = [list(e) + [1] for e in known.encode([t or "" for _, t in ordered])]
    every = [int(t) for part in ids for t in part]
    starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    got = sorted(token_files.documents(segments).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.ids) for r in got] == [(d, s, i) for (d, _), s, i in zip(ordered, starts, ids, strict=True)]
    asked = [0, 0, 5, len(every) - 1, len(every), -1, None, 300, 300, 300]
    places = spark.createDataFrame([(p,) for p in asked], "position bigint")
    found = Counter((r.position, r.token) for r in token_files.tokens_at(segments, places).collect())
    assert found == Counter((p, every[p]) for p in asked if p is not None and 0 <= p < len(every))


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_give_every_token(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
    codes = token_files.encode_codes(ids)
    assert (token_files.decode_codes(codes, n) == ids).all()
    assert [token_files.token_at(codes, i) for i in range(n)] == ids.tolist()


def test_word_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_files.WordEncoder, "GENERATION", 20)
    encoder = token_files.WordEncoder(token_files.VOCABULARY)
    texts = [r[1] or "" for r in ROWS] * 2
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert [encoder.encode([t])[0].tolist() for t in texts] == want


# sharding


def shards_are_lawful(rows, n_shards):
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    counts = [len(by_shard[s]) for s in range(n_shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_shards_keep_groups_and_split_only_the_large(spark):
    rows = [(i, f"text {i}") for i in range(400)] + [(1000 + i, f"pair {i // 3}") for i in range(90)]
    rows += [(2000 + i, "hot") for i in range(250)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sharding.report(docs).collect()
    shards_are_lawful(got, 16)
    texts = dict(rows)
    homes = defaultdict(set)
    for r in got:
        homes[texts[r.doc_id]].add(r.shard)
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id].encode()))
    assert len(homes["hot"]) <= 8
    assert sum(len(v) > 1 for t, v in homes.items() if t != "hot") <= 1
    cut = sharding.cut_links(sharding.report(docs)).collect()[0]
    assert cut.links == 250 * 249 // 2 + 30 * 3 and cut.kept + cut.cut == cut.links


def test_shards_keep_groups_where_every_document_has_a_copy(spark):
    pairs = [(i, f"pair {i // 2}") for i in range(600)] + [(1000 + i, f"six {i // 6}") for i in range(102)]
    thousands = [(i, f"hot {i // 300}") for i in range(2400)] + [(9000 + i, f"text {i}") for i in range(48)]
    for rows, most in ((pairs, 1), (thousands, 3)):
        got = sharding.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        shards_are_lawful(got, 16)
        texts, homes = dict(rows), defaultdict(set)
        for r in got:
            homes[texts[r.doc_id]].add(r.shard)
        assert sum(len(v) > most for v in homes.values()) < 16


def test_quotas_hold_and_swaps_are_granted():
    rng = np.random.default_rng(8)
    for _ in range(300):
        k = int(rng.integers(1, 8))
        load = rng.integers(0, 50, k).tolist()
        capacity = [n + int(rng.choice([0, 0, 5])) for n in load]
        wishes = {(i, j): int(rng.integers(1, 20)) for i in range(k) for j in range(k) if i != j and rng.random() < 0.4}
        wishes = {(i, j): n for (i, j), n in wishes.items() if n <= load[i]}
        flow = sharding.granted(wishes, load, capacity)
        assert all(0 <= flow[p] <= wishes[p] for p in wishes)
        for s in range(k):
            after = load[s] + sum(n for (_, j), n in flow.items() if j == s) - sum(n for (i, _), n in flow.items() if i == s)
            assert after <= capacity[s]
    assert sharding.granted({(0, 1): 5, (1, 2): 5, (2, 0): 5}, [9, 9, 9], [9, 9, 9]) == {(0, 1): 5, (1, 2): 5, (2, 0): 5}
    assert sharding.granted({(0, 1): 5, (1, 0): 3}, [9, 9], [9, 9]) == {(0, 1): 3, (1, 0): 3}


@pytest.mark.parametrize("kind", ["few links", "pairs only", "thousands", "hot"])
def test_every_round_keeps_more_links(spark, kind):
    """Cut links fall from round to round, and end near what packing whole groups would cut."""
    rng = np.random.default_rng(9)
    sizes = {
        "few links": rng.integers(2, 9, 60).tolist(),
        "pairs only": [2] * 400,
        "thousands": [300] * 8 + [7] * 20,
        "hot": [900, 40, 40] + [3] * 100,
    }[kind]
    free = {"few links": 900, "hot": 700}.get(kind, 0)
    total = sum(sizes) + free
    capacity = [total // 16 + (s < total % 16) for s in range(16)]
    starts = np.cumsum([0, *sizes])[:-1].tolist()
    groups = spark.createDataFrame(
        [(f"t{k}", s, n) for k, (s, n) in enumerate(zip(starts, sizes, strict=True))], "text_key string, start bigint, n bigint"
    )
    history = []
    cells = sharding.settled(sharding.dealt_cells(groups, 16), capacity, history).collect()
    assert all(a <= b for a, b in itertools.pairwise(history)) and history[-1] > history[0]
    held, by_group = Counter(), defaultdict(list)
    for r in cells:
        held[r.shard] += r.n
        by_group[r.text_key].append(r.n)
    assert all(held[s] <= capacity[s] for s in range(16))
    assert {g: sum(v) for g, v in by_group.items()} == {f"t{k}": n for k, n in enumerate(sizes)}
    # a group that fits a shard is seldom split; one that does not fills shards
    split = [g for g, v in by_group.items() if len(v) > 1 and sum(v) <= capacity[0]]
    assert len(split) <= 16
    for v in by_group.values():
        assert sum(v) <= capacity[0] or len(v) <= sum(v) // capacity[0] + 8


def test_sharding_takes_edge_rows(spark):
    docs = edge_docs(spark)
    got = sharding.report(docs).collect()
    shards_are_lawful(got, 16)
    want = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(want, key=repr)
    whole = sharding.shard(docs)
    assert whole.columns == [*(c for c in docs.columns if c != "shard"), "shard", "slot"]
    shards_are_lawful(whole.collect(), 16)
    assert rows_of(whole.drop("shard", "slot")) == rows_of(docs.drop("shard"))
    assert sharding.report(no_docs(spark)).collect() == []


# mixing


def water_levels(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while len(stopped) < len(names):
        rest = [s for s in names if s not in stopped]
        rate = (total - sum(stopped.values())) / sum(weight[s] for s in rest)
        above = [s for s in rest if rate * weight[s] > 3 * sizes[s]]
        if not above:
            return {s: stopped.get(s, rate * weight[s]) for s in names}
        stopped |= {s: 3 * sizes[s] for s in above}
    return stopped


def mixing_is_lawful(docs, got):
    size = lambda t: len(WORD.findall(t or ""))
    sizes, largest = defaultdict(int), defaultdict(int)
    rows = docs.select("doc_id", "text", "source").collect()
    for r in rows:
        sizes[r.source] += size(r.text)
        largest[r.source] = max(largest[r.source], size(r.text))
    want = water_levels(sizes)
    assert sorted(((r.doc_id, size(r.text)) for r in rows), key=repr) == sorted(((r.doc_id, r["size"]) for r in got), key=repr)
    taken, by_target = defaultdict(int), defaultdict(set)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"] and (r.taken == 0 or r.taken % r["size"] == 0)
        taken[round(r.target, 6), r.source_size] += r.taken
    for s, target in want.items():
        by_target[round(target, 6), sizes[s]].add(s)
    assert set(taken) == set(by_target)
    for key, sources in by_target.items():
        assert abs(taken[key] - key[0] * len(sources)) <= sum(largest[s] for s in sources)


def test_mixing_meets_its_targets(spark, tiny):
    for docs in (edge_docs(spark), tiny):
        got = mixing.report(docs)
        mixing_is_lawful(docs, got.collect())
        assert rows_of(got) == rows_of(mixing.report(docs))
    assert mixing.report(no_docs(spark)).collect() == []


def misses(got):
    """By how much each target is missed, of targets that one source has."""
    taken, share = defaultdict(int), defaultdict(set)
    for r in got:
        taken[r.target, r.source_size] += r.taken
        share[r.target, r.source_size].add(r.target)
    return {key: abs(n - key[0]) for key, n in taken.items()}


def test_mixing_misses_a_target_by_a_small_document(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    for seed in (7, 8):
        for (target, _), miss in misses(mixing.report(docs, seed).collect()).items():
            assert miss < 0.005 * target


def test_mixing_bears_a_document_larger_than_a_bucket(spark):
    """One document is a tenth of its source, which has a fraction of 0.05 copies: the rest gives way."""
    rows = [(0, "w " * 3000, "b"), *((k, "w " * (k % 40 + 1), "b") for k in range(1, 1400)), *((9000 + k, "w " * 20, "a") for k in range(1000))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for seed in range(3):
        assert max(misses(mixing.report(docs, seed).collect()).values()) < 20  # the words of one document of "a"


def test_mixing_is_unbiased(spark):
    """Many sources of the same documents: copies less their share are 0 on average, for every size."""
    rnd = np.random.default_rng(2)
    sizes = [int(rnd.choice([1, 2, 3, 9, 40, 200])) for _ in range(90)]
    rows = [(1000 * s + k, "w " * n, f"s{s:03d}") for s in range(60) for k, n in enumerate(sizes)]
    got = mixing.report(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    off = defaultdict(list)
    for r in got:
        off[r["size"]].append(r.taken / r["size"] - r.target / r.source_size)
        assert 0 <= r.taken <= 3 * r["size"]
    for size, values in off.items():
        # copies vary by about one: the mean of n by its root
        assert abs(np.mean(values)) < 4 / np.sqrt(len(values)), size


def test_mixing_of_skewed_sources(spark):
    rows = [(i, "w " * (i % 90 + 1), "hot") for i in range(3000)] + [(9000 + i, "w " * 50, f"s{i % 7}") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.report(docs).collect()
    mixing_is_lawful(docs, got)
    hot = [r for r in got if r.source_size > 100_000]
    assert abs(sum(r.taken for r in hot) - hot[0].target) <= 10


def test_mixed_rows_are_whole_copies(spark):
    docs = edge_docs(spark)
    got = Counter((r.doc_id, r.text) for r in mixing.mix(docs).collect())
    want = Counter()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id, len(WORD.findall(r.text or ""))].append(r.text)
    for r in mixing.report(docs).collect():
        if r["size"]:
            want[r.doc_id, r["size"]] += r.taken // r["size"]
    sums = Counter()
    for (doc, text), n in got.items():
        if WORD.search(text or ""):
            sums[doc, len(WORD.findall(text))] += n
    assert sums == +want
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(no_docs(spark)).collect() == []


# chat


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\b \\l \\\\ [ < \\", "[TURN]user[TEXT]x[/TURN]", "", None, "<|end|>\n[IMAGE 0]"]
    rows = [(c, t, "assistant" if t % 2 else "user", nasty[(c + t) % len(nasty)]) for c in range(6) for t in range(5)]
    rows += [(7, 0, None, "x"), (7, 0, "assistant", "tie b"), (7, 0, "assistant", "tie a"), (None, None, "assistant", "y")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    content = frame.withColumn("content", chat_format.text_part(F.col("text")))
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(content)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t.role, t.text) for t in back[conv].turns] == [t[1:] for t in turns]
        assert back[conv].loss_texts == [t[2] for t in turns if t[1] == "assistant"]
        assert back[conv].formatted.count("[TURN]") == len(turns) and back[conv].formatted.count("<") == 2
    assert chat_format.format_conversations(content.where("false")).collect() == []


def test_chat_parts_become_numbered_placeholders(spark):
    part = "named_struct('kind', {}, 'text', {}, 'ref', {}, 'tokens', {})"
    none = "cast(null as {})"
    image = part.format("'image'", none.format("string"), "'a.png'", "100")
    text = part.format("'text'", "'see [this]'", none.format("string"), none.format("int"))
    audio = part.format("'AUDIO'", none.format("string"), "'b.wav'", none.format("int"))
    other = part.format("'spreadsheet'", none.format("string"), "'c.xls'", none.format("int"))
    frame = spark.sql(
        f"select 1L conv_id, 0L turn, 'user' role, array({image}, {text}, {audio}) content "
        f"union all select 1L, 1L, 'assistant', array({text}, {other})"
    )
    row = chat_format.format_conversations(frame).collect()[0]
    assert row.formatted == (
        "<s>[TURN]user[TEXT][IMAGE 0]see \\bthis][AUDIO 1][/TURN]"
        "[TURN]assistant[TEXT]see \\bthis][DOCUMENT 2][/TURN]</s>"
    )
    assert [(a.turn_no, a.kind, a.ref, a.tokens) for a in row.attachments] == [
        (0, "image", "a.png", 100), (0, "audio", "b.wav", 750), (1, "document", "c.xls", 1024),
    ]
    assert row.expanded_tokens == 1874


# near duplicates


def brute_components(rows, width=3, percent=90):
    def shingles(text):
        w = WORD.findall((text or "").translate(LOWER))
        if len(w) < width:
            return frozenset([tuple(w)]) if w else frozenset()
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (doc, _) in enumerate(rows):
        ids[find(k)].append(doc)
    least = lambda v: min((i for i in v if i is not None), default=None)
    return [(doc, len(sets[k]), least(ids[find(k)]) if sets[k] else doc) for k, (doc, _) in enumerate(rows)]


def edited(n, edits, seed, words=300):
    """Texts that differ from one base in some words each."""
    rng = np.random.default_rng(seed)
    base = [f"b{seed}x{k}" for k in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits + 1)):
            own[at] = f"e{k}y{at}"
        out.append(" ".join(own))
    return out


def test_joins_equal_brute_force(spark, tiny):
    texts = edited(150, 8, 1) + edited(40, 6, 2, 60) + edited(30, 3, 3, 12) + [f"common line here now. only {k} here" for k in range(90)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(r[0], r[1]) for r in ROWS]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for frame in (docs, tiny):
        want = brute_components([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()])
        assert rows_of(jaccard_join.report(frame)) == sorted(want, key=repr)


@pytest.mark.parametrize("hot", [jaccard_join.HOT, 6])
def test_joins_with_small_limits_lose_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 3)
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "COUNTED", 500)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 2000)
    monkeypatch.setattr(jaccard_join, "MAX_BROADCAST", 0)
    monkeypatch.setattr(shared_tokens, "GATHERED", 1000)
    rows = list(enumerate(edited(120, 9, 4) + edited(20, 2, 5, 30)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    linked = jaccard_join.link(docs, max_frequent=5).select("doc_id", "n_shingles", "component_id")
    assert rows_of(linked) == sorted(brute_components(rows), key=repr)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_a_common_phrase_is_refined(spark, monkeypatch, width, percent):
    """Most texts share a phrase and nothing else, so its lists are long and say nothing; some are near copies."""
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 6)
    monkeypatch.setattr(jaccard_join, "MAX_FREQUENT", 2)
    monkeypatch.setattr(shared_tokens, "BUCKET", 1 << 10)
    rng = np.random.default_rng(11)
    phrase = [f"p{k}" for k in range(9)]
    texts = []
    for k in range(700):
        own = [f"w{k}x{m}" for m in range(rng.integers(4, 30))]
        at = int(rng.integers(0, len(own)))
        texts.append(own[:at] + phrase + own[at:])
        if k % 5 == 0:
            near = list(texts[-1])
            near[int(rng.integers(0, len(near)))] = "changed"
            texts.append(near)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + list(enumerate(edited(40, 3, 12, 60), start=5000))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    depths = []
    judged = shared_tokens._judged
    monkeypatch.setattr(shared_tokens, "_judged", lambda long, m, depth: depths.append(depth) or judged(long, m, depth))
    linked = jaccard_join.link(docs, percent, 2, width).select("doc_id", "n_shingles", "component_id")
    assert rows_of(linked) == sorted(brute_components(rows, width, percent), key=repr)
    assert max(depths) > 1


def test_very_large_intersections_are_exact():
    both = np.arange(800_001, dtype=np.uint64)
    sets = [both, np.concatenate([both, np.arange(10**7, 10**7 + 88_890, dtype=np.uint64)])]
    sizes = np.array([len(x) for x in sets])
    assert 100 * len(both) == 90 * (sizes[1] - 1)
    assert jaccard_join._linked(sizes, sets, 90, None) == [0, 1]
    assert jaccard_join._linked(sizes - [0, 1], [both, sets[1][:-1]], 90, None) == [0, 0]


def test_one_of_each_component_stays(spark):
    kept = jaccard_join.first_of_each(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    ids = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    # 5 and 6 equal 4 but for case, 8 is near 7; -5 stands for two texts; texts without words stay
    gone = {(5, PROSE * 3), (6, (PROSE * 3).upper()), (8, ROWS[8][1])}
    assert ids == sorted({(r[0], r[1]) for r in ROWS} - gone, key=repr)
    assert jaccard_join.first_of_each(no_docs(spark)).collect() == []


def brute_first(rows, width, percent):
    """The lowest id of each component, of texts with ``width`` words or more."""
    sets = {}
    for doc, text in rows:
        w = WORD.findall(text.translate(LOWER))
        sets[doc] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    root = {d: d for d in sets}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {d: low if r == high else r for d, r in root.items()}
    return sorted(set(root.values()))


@pytest.mark.parametrize("long_list", [jaccard_join.LONG_LIST, 3])
def test_width_and_percent_are_parameters(spark, monkeypatch, long_list):
    monkeypatch.setattr(jaccard_join, "LONG_LIST", long_list)
    texts = edited(60, 9, 6) + edited(60, 14, 7, 200) + edited(40, 3, 8, 40) + edited(30, 2, 9, 12)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    firsts = {}
    for width, percent in ((5, 80), (3, 90)):
        kept = jaccard_join.first_of_each(docs, percent, width)
        firsts[width] = sorted(r.doc_id for r in kept.collect())
        assert firsts[width] == brute_first(rows, width, percent)
    assert firsts[5] != firsts[3]


def test_the_pipeline_drops_copies_with_more_words_or_separate_edits(spark, small):
    long = [f"w{k}" for k in range(400)]
    short = [f"v{k}" for k in range(200)]
    four = [f"e{k}" if k in (30, 70, 110, 150) else w for k, w in enumerate(short)]
    other = [f"e{k}" if k % 20 == 9 else w for k, w in enumerate(short)]
    texts = [long, [*long, *(f"x{k}" for k in range(60))], short, four, other]
    rows = [(k, " ".join(t), "a") for k, t in enumerate(texts)]
    kept = corpus_pipeline.keep_first_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string, source string"), small)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4]


def test_components_of_chains_and_stars(spark):
    edges = [(k + 1, k) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(200, 200), (301, 300), (300, 301)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    roots = {r.node: r.root for r in found.collect()}
    assert roots == {**{k: 0 for k in range(61)}, **{100 + k: 100 for k in range(40)}, 200: 200, 300: 300, 301: 300}


# pipeline


def test_pipeline_equals_brute_force(spark, small, tiny):
    model = quality_rules.fit(tiny, queries.quality_labels(spark, small))
    good = {r.doc_id for r in quality_rules.judge(tiny, model).where("kept").collect()}
    rows = sorted((r.doc_id, r.text, r.source) for r in tiny.collect() if r.doc_id in good)
    width, percent = corpus_pipeline.NEAR_WIDTH, corpus_pipeline.NEAR_PERCENT
    first = {d for d, _, c in brute_components([r[:2] for r in rows], width, percent) if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = [r for r in rows if r[0] in first and not brute_hits(r[1], items)[1]]
    kept = spark.createDataFrame(clean, "doc_id bigint, text string, source string")
    copies = {r.doc_id: r.taken // r["size"] for r in mixing.report(kept).collect() if r["size"]}
    got = corpus_pipeline.run(spark, small).collect()
    shards_are_lawful(got, 16)
    assert Counter(r.doc_id for r in got) == +Counter(copies)
    texts = {r[0]: r[1] for r in rows}
    assert all(r.text == texts[r.doc_id] for r in got)


def test_near_stage_equals_brute_force_on_five_words(spark, small, tiny):
    rows = [(r.doc_id, r.text) for r in tiny.collect() if len(WORD.findall(r.text or "")) >= 5]
    kept = corpus_pipeline.keep_first_copies(spark, tiny.where(F.col("doc_id").isin([d for d, _ in rows])), small)
    assert sorted(r.doc_id for r in kept.collect()) == brute_first(rows, 5, 80)


def test_stages_keep_the_columns(spark, small):
    docs = edge_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        assert stage(spark, spark.createDataFrame([], SCHEMA), small).collect() == [], name


def test_sql_of_the_queries(spark, small):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, small)
        want = con.execute(sql).to_arrow_table().select(got.columns)
        assert rows_of(got) == sorted((tuple(r.values()) for r in want.to_pylist()), key=repr), name
