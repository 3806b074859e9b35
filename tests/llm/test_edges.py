"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

from __future__ import annotations

import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ctxpress.llm import chat_format, context_mixing, decontaminate, length_histogram, near_dedup, packing, quality, resharding, token_files, toxicity
from ctxpress.llm.common import fold, materialize, work_dir

LONG = " ".join(f"word{i * 7919 % 5003}" for i in range(60_000))
SAME = "one two three four five six seven eight nine ten eleven twelve thirteen"
#: Names that operators use inside for columns of their own.
CLASH = {"shard": "x", "length": "y", "component": "z", "n_tokens": 5, "block": 1.5, "kept": True}


def rows_of(*pairs):
    return [(d, t, "en", s, *CLASH.values()) for d, t, s in pairs]


@pytest.fixture(scope="module")
def frames(spark):
    schema = "doc_id long, text string, lang string, source string, shard string, length string, component string, n_tokens int, block double, kept boolean"
    rows = rows_of(
        (1, None, None), (2, "", "a"), (3, "  \n\t ", "a"), (4, LONG, "b"), (5, SAME, "b"), (6, SAME, None), (6, SAME, None), (7, SAME + "\n", "b"),
        (None, SAME, "c"), (None, None, None), (8, "é" * 50_000, "a"), (9, "a\x00b   ퟿", "a"), (10, "short", "a"),
    )
    full = materialize(spark.createDataFrame(rows, schema), "edges")
    return full, full.where("false")


def test_token_files(spark, frames):
    full, empty = frames
    back = token_files.read_token_files(token_files.write_token_files(full, work_dir(spark), file_tokens=1000)).orderBy("start").collect()
    assert len(back) == full.count()
    ids = [r["doc_id"] for r in back]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    at = 0
    for r in back:
        assert r["start"] == at
        at += r["n_tokens"]
    assert next(r["n_tokens"] for r in back if r["doc_id"] == 1) == 1
    assert token_files.read_token_files(token_files.write_token_files(empty, work_dir(spark))).count() == 0


def test_lm_scores(spark, frames):
    full, empty = frames
    rows = context_mixing.score(full, fold(7) == 2).collect()
    assert len(rows) == full.count() and all(r["score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert len({r["score"] for r in rows if r["doc_id"] in (5, 6, 7)}) == 1  # equal words, equal scores
    assert context_mixing.score(empty, fold(7) == 2).count() == 0
    assert context_mixing.score(full.where("doc_id = 5"), F.lit(True)).first()["n_known"] == 0  # nothing to learn from


def test_chat_format(spark):
    hard = "~0 <|end|> ~a <|turn|>user<|text|> </s> \n"
    rows = [(1, 0, "user", hard, 7), (1, 1, "user", None, 7), (1, 2, "assistant", hard, 7), (1, 2, "assistant", hard, 7), (1, None, None, "x", 7), (None, 0, "assistant", "", 7), (2, 0, "assistant", LONG, 7)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    back = {r["conv_id"]: r for r in chat_format.parse_conversations(chat_format.masked_text(chat_format.format_conversations(talk))).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("", "x"), ("user", hard), ("user", ""), ("assistant", hard), ("assistant", hard)]
    assert back[1]["loss_text"] == hard + hard and back[None]["loss_text"] == "" and back[2]["loss_text"] == LONG
    wrong = chat_format.format_conversations(talk).withColumn("loss_mask", F.transform("loss_mask", lambda p: F.struct(p["n"].alias("n"), (~p["loss"]).alias("loss"))))
    assert {r["conv_id"]: r["loss_text"] for r in chat_format.masked_text(wrong).collect()}[1] != hard + hard  # the mask decides
    formatted = {r["conv_id"]: r for r in chat_format.format_conversations(talk).collect()}
    r, at, masked = formatted[1], 0, []
    for run in r["loss_mask"]:
        masked += [r["formatted"][at : at + run["n"]]] * run["loss"]
        at += run["n"]
    assert at == len(r["formatted"]) and len(masked) == 2 and len(set(masked)) == 1 and "<|" not in masked[0]
    assert r["formatted"].count(chat_format.TURN) == 3  # neighbours of one role share a turn
    assert chat_format.format_conversations(talk.where("false")).count() == 0


def test_quality(spark, frames):
    full, empty = frames
    kept = quality.quality_filter(full)
    assert kept.columns == full.columns and {r["doc_id"] for r in kept.collect()} >= {5, 6, 7}
    assert kept.where("doc_id = 6").count() == 2 and kept.where("doc_id in (1, 2, 3, 10)").count() == 0
    assert quality.quality_filter(empty).count() == 0


def test_quality_hosts(spark):
    good = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bad = "# $ % & | < > * # $ % & alpha beta gamma delta"
    rows = [(i, good if i % 50 else bad, "large") for i in range(1000)] + [(2000 + i, bad, "spam") for i in range(300)] + [(5000, good, "spam"), (6000, bad, "new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert got[5000]["__ctx_verdict"] == "blocked" and not got[5000]["__ctx_kept"]
    assert got[1]["__ctx_kept"] and got[1]["__ctx_verdict"] != "blocked"
    assert got[6000]["__ctx_rate"] < 0.9  # one failure of one is shrunk towards the prior


def test_beta_quantile():
    rng = __import__("random").Random(2)
    for mean, strength in ((0.1, 30.0), (0.5, 2.0), (0.02, 1000.0), (0.6, 1.0)):
        drawn = sorted(rng.betavariate(mean * strength, (1 - mean) * strength) for _ in range(20_000))
        for q in (0.25, 0.75):
            assert quality.beta_quantile(mean, strength, q) == pytest.approx(drawn[int(q * 20_000)], abs=0.02)


def test_verdicts_differ_between_hosts(spark):
    """``kept`` follows a plain recomputation of rates and verdicts, and the same failing text stays or goes by its host."""
    good, bad = " ".join(f"word{i}" for i in range(20)), "# $ % & | < > * alpha beta gamma delta epsilon zeta eta theta"
    failing = {f"h{k}": 4 * k for k in range(12)}
    rows = [(1000 * int(h[1:]) + i, bad if i < n else good, h) for h, n in failing.items() for i in range(200)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    rates = [n / 200 for n in failing.values()]
    mean = sum(rates) / 12
    spread = sum((r - mean) ** 2 for r in rates) / 12 - mean * (1 - mean) / 200
    strength = min(1000.0, max(1.0, mean * (1 - mean) / spread - 1))
    cut = quality.beta_quantile(mean, strength, 0.75)
    verdict = {h: "watched" if (n + mean * strength) / (200 + strength) >= cut else "trusted" for h, n in failing.items()}
    assert set(verdict.values()) == {"watched", "trusted"}
    for d, text, h in rows:
        assert got[d]["__ctx_verdict"] == verdict[h] and got[d]["__ctx_kept"] == (text == good or verdict[h] == "trusted")


def test_reshard(spark, frames):
    full, empty = frames
    layout = resharding.with_slots(resharding.reshard(full, f"{work_dir(spark)}/{uuid.uuid4().hex}", 4, 3))
    assert layout.count() == full.count() and set(layout.columns) == set(full.columns) | {"moved", "slot"}
    for _, slots in layout.groupBy("shard").agg(F.collect_list("slot").alias("s")).collect():
        assert sorted(slots) == list(range(len(slots)))
    assert resharding.reshard(empty, f"{work_dir(spark)}/{uuid.uuid4().hex}", 4, 3).count() == 0


def test_flow_is_cheapest():
    import itertools

    for old, new in (([5, 3, 0], [4, 4, 4]), ([7, 1], [2, 6, 9]), ([4, 4, 4], [12]), ([0, 9], [3, 3, 3])):
        flow = resharding.min_cost_flow(old, new)
        assert [sum(r) for r in flow] == old and all(sum(r[j] for r in flow) <= c for j, c in enumerate(new))
        moved = sum(x for i, r in enumerate(flow) for j, x in enumerate(r) if i != j)
        stay = itertools.product(*(range(min(o, new[i] if i < len(new) else 0) + 1) for i, o in enumerate(old)))
        assert sum(old) - moved == max(sum(s) for s in stay)
    with pytest.raises(ValueError):
        resharding.min_cost_flow([5], [4])


def test_toxicity(spark, frames):
    full, empty = frames
    labels = spark.createDataFrame([(5, 1, 1), (6, 1, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for docs, known in ((full, labels), (full, labels.where("false")), (empty, labels)):
        kept = toxicity.toxicity_filter(docs, known)
        assert kept.columns == full.columns and kept.count() <= docs.count()
    assert toxicity.toxicity_filter(full, labels.where("false")).count() == full.count()


def test_near_duplicates(spark, frames):
    full, empty = frames
    rows = near_dedup.near_duplicates(full).collect()
    assert len(rows) == full.count()
    by = {r["doc_id"]: r["component"] for r in rows if r["doc_id"] is not None}
    assert by[5] == by[6] == by[7] and by[1] == by[2] and by[5] != by[4] and by[3] != by[10]
    kept = near_dedup.near_dedup_filter(full)
    assert kept.columns == full.columns and kept.count() == len({r["component"] for r in rows})
    assert near_dedup.near_dedup_filter(empty).count() == 0


def test_near_duplicate_chains_in_one_bucket(spark):
    """Large groups of near copies of several kinds lose no link, though their buckets hold many texts."""
    base = [f"w{i}" for i in range(60)]
    texts = []
    for kind in range(3):
        for k in range(66):
            words = [f"{kind}{w}" for w in base]
            words[k % 60] = f"x{k}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # one changed word of 60 touches five of 56 shingles: 51 / 61 for two copies changed at the same place, less otherwise
    from tests.llm.test_contracts import classes, j_p, shingle_counts

    sets = [shingle_counts(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if a // 66 == b // 66 and len(sets[a].keys() & sets[b].keys()) > 40 and j_p(sets[a], sets[b]) >= 0.8]
    want = classes(range(len(texts)), links)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert links and got == want


def test_components(spark):
    import random

    from ctxpress.llm.components import connected
    from tests.llm.test_contracts import classes

    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 440)] + [(500, 600 + k) for k in range(50)]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    table = spark.createDataFrame(edges, "a long, b long")
    for few in (0, 10**6):
        got = {r["node"]: r["component"] for r in connected(table, work_dir(spark), few=few).collect()}
        assert got == classes(nodes, [e for e in edges if e[0] != e[1]])
        assert connected(table.where("false"), work_dir(spark), few=few).count() == 0


def test_length_histogram(spark, frames):
    full, empty = frames
    limits = length_histogram.limit_table(length_histogram.length_histogram(full))
    lengths = sorted(r["n_tokens"] - 1 for r in token_files.read_token_files(token_files.write_token_files(full, work_dir(spark))).collect())
    for limit in (0, 1, 3, 500, 10**6):
        want = {"docs_within": sum(n <= limit for n in lengths), "tokens_within": sum(n for n in lengths if n <= limit), "truncated_tokens": sum(min(n, limit) for n in lengths)}
        assert length_histogram.answer(limits, limit) == want
    assert length_histogram.quantile(limits, 0.5) == lengths[-(-len(lengths) // 2) - 1]
    assert length_histogram.limit_table(length_histogram.length_histogram(empty)).count() == 0


def test_packing(spark, frames):
    full, empty = frames
    rows = packing.pack_documents(full, capacity=256).collect()
    held = {}
    for r in rows:
        held[r["sequence_id"]] = held.get(r["sequence_id"], 0) + r["length"]
        assert 1 <= r["length"] <= 256
    assert max(held.values()) <= 256 and sum(r["length"] for r in rows if r["doc_id"] == 1) == 1
    assert packing.pack_documents(empty).count() == 0


def test_genetic_search_improves_on_best_fit():
    """Crossover and migration reach packings that decreasing best fit misses."""
    import random

    rng, gained = random.Random(3), 0
    for seed in range(6):
        lengths = [rng.randint(100, 500) for _ in range(120)]
        first = packing.best_fit(lengths, 1000)
        best = packing.evolve(lengths, [], seed, 1000, generations=20)
        assert sorted(i for b in best for i in b) == list(range(120)) and all(sum(lengths[i] for i in b) <= 1000 for b in best)
        assert packing.lower_bound(lengths, 1000) <= len(best) <= len(first)
        gained += len(first) - len(best)
        again = packing.evolve(lengths, [best], seed + 1, 1000)
        assert len(again) <= len(best)


def test_decontaminate(spark, frames):
    full, empty = frames
    items = spark.createDataFrame([(1, SAME), (1, "not in any"), (2, None), (None, SAME), (3, "short"), (4, "word7919 none such words here at all")], "item_id long, text string")
    hits = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(full, items).collect()}
    assert hits == {(5, 1), (6, 1), (7, 1), (10, 3)}
    kept = decontaminate.decontaminate(full, items)
    assert kept.columns == full.columns
    assert kept.count() == full.count() - 5 and decontaminate.decontaminate(full, items.where("false")).count() == full.count()
    assert decontaminate.decontaminate(empty, items).count() == 0


def test_fold(spark):
    import zlib

    got = spark.range(20).select("id", fold(7, "id").alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in got)


def test_near_duplicates_weigh_repeats_by_count(spark):
    def counts(text):
        words = text.split()
        return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))

    def j_p(a, b):
        return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in a.keys() | b.keys()) for x in a.keys() & b.keys())

    shared = " ".join([f"s{i}" for i in range(100)] * 8)
    texts = [shared + " " + " ".join(f"{own}{i}" for i in range(n)) for own, n in (("a", 60), ("b", 60), ("c", 900))]
    texts += [" ".join([f"s{i}" for i in range(100)] * 3) + " " + " ".join(f"d{i}" for i in range(20))]
    sets = [counts(t) for t in texts]
    links = {(i, k) for i in range(4) for k in range(i) if j_p(sets[i], sets[k]) >= 0.8}
    assert (1, 0) in links and not any(2 in pair for pair in links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got[1] == got[0] == 0 and got[2] == 2
    assert (got[3] == 0) == any(3 in pair for pair in links)


def test_linked_against_every_pair():
    """Bounds and early merging change no component: sets of very different sizes, repeats, scaled copies, 1 to 9 shared labels."""
    import numpy as np

    from tests.llm.test_contracts import classes

    rng = np.random.default_rng(5)
    for trial in range(6):
        base = [rng.choice(400, 40, replace=False) for _ in range(4)]
        sets = []
        for k in range(60):
            codes = base[k % 4].copy()
            codes[: rng.integers(0, 7)] = rng.choice(np.arange(400, 900), 1)
            codes = np.unique(codes)
            weights = np.ones(len(codes)) if trial % 2 else rng.integers(1, 4, len(codes)).astype(float) ** (k % 3)
            sets.append((codes.astype(np.uint64), weights * (1 + k % 5)))
        ends = np.cumsum([len(c) for c, _ in sets])
        labels = np.arange(60)
        start = labels.copy()
        found = near_dedup.linked(np.concatenate([c for c, _ in sets]), np.concatenate([w for _, w in sets]), ends, labels, list(range(60)), lambda c: np.arange(60), 0.8)
        every = [(a, b) for a in range(60) for b in range(a) if near_dedup.probability_jaccard(sets[a], sets[b]) >= 0.8]
        want = classes(range(60), every)
        assert classes(range(60), [(int(a), int(b)) for a, b in found]) == want and set(found) <= set(every) | {(b, a) for a, b in every}
        assert len({*labels.tolist()}) == len({*want.values()}) < 60 and (start == np.arange(60)).all()


def test_blocks_of_a_bucket_change_nothing(spark):
    """Blocks of a few bytes and of megabytes give the same groups."""
    texts = []
    for k in range(40):
        words = [f"w{i}" for i in range(60)]
        for j in range(k % 5):
            words[(k * 7 + j) % 60] = f"x{k}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    for size in (100, 1 << 22):
        seen.append({r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs, bytes_a_block=size).collect()})
    assert seen[0] == seen[1] and 1 < len(set(seen[0].values())) < 40
