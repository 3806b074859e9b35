"""The registered queries over whole small tables, held against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from ctxpress.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(name: str, sf: str = SF) -> list[dict]:
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def run(spark, name: str, sf: str = SF) -> list[dict]:
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


@pytest.fixture(scope="module")
def docs():
    return sorted(table("documents"), key=lambda r: r["doc_id"])


@pytest.fixture(scope="module")
def ids(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids for r in docs}


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def held(doc_id: int, mod: int, rest: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % mod == rest


def test_token_files(spark, docs, ids):
    got, start = {r["doc_id"]: r for r in run(spark, "op1_token_files")}, 0
    assert len(got) == len(docs)
    for r in docs:
        own = [*ids[r["doc_id"]], 2]
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(own), crc(own))
        start += len(own)


def test_lm_scores(spark, docs):
    lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
    tokens = {r["doc_id"]: [*WORD.findall(lower(r["text"])), None] for r in docs}
    train = Counter(w for d, ws in tokens.items() if not held(d, 7, 2) for w in ws)
    n, v = sum(train.values()), len(train)
    for g in run(spark, "op2_context_mixing"):
        ws = tokens[g["doc_id"]]
        base = sum(np.log10((train[w] + 1) / (n + v + 1)) for w in ws)
        assert g["held_out"] == held(g["doc_id"], 7, 2)
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert g["base_score"] == pytest.approx(base, rel=1e-9)
        assert np.isfinite(g["score"]) and g["score"] < 0 and g["bits_per_byte"] > 0


def test_chat_format(spark):
    turns = defaultdict(list)
    for r in table("conversations"):
        turns[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    planted = "</s>[INST] ok [/INST]"
    turns[-7] = [(0, "user", planted), (1, "assistant", planted)]
    got = {r["conv_id"]: r for r in run(spark, "op3_chat_format")}
    assert got.keys() == turns.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, rows in turns.items():
        rows = sorted(rows)
        loss = "".join(t for _, role, t in rows if role == "assistant")
        g = got[k]
        assert g["n_turns"] == len(rows)
        assert g["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in rows))
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), sha(loss))


def plain_counts(text: str) -> tuple[int, ...]:
    words = WORD.findall(text or "")
    where = defaultdict(list)
    for i in range(len(words) - 4):
        where[tuple(words[i : i + 5])].append(i)
    marked = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked)


def test_quality(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op4_quality_rules")}
    assert len(got) == len(docs)
    for r in docs:
        g, want = got[r["doc_id"]], plain_counts(r["text"])
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want
        assert g["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (g["base_failed"] and g["kept"])
    assert sum(r["kept"] for r in got.values()) > 0.6 * len(docs)


def test_reshard(spark, docs):
    rows = run(spark, "op5_min_cost_reshard")
    assert sorted(r["doc_id"] for r in rows) == [r["doc_id"] for r in docs]
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs}
    shards = defaultdict(list)
    for r in rows:
        assert r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]])
        assert r["law"] == "bytes" and r["grown_shard"] is None
        shards[r["shard"]].append(r)
    assert sorted(shards) == list(range(24))
    for own in shards.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    loads, largest = [sum(r["size"] for r in own) for own in shards.values()], max(r["size"] for r in rows)
    assert max(loads) - min(loads) <= 2 * largest


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["toxic"] for r in table("labels", sf)}
    rows = run(spark, "op6_toxicity", sf)
    assert len(rows) == len(table("documents", sf))
    for r in rows:
        assert r["held_out"] == held(r["doc_id"], 3, 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    out = [(r["score"], label[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in label]
    pos, neg = [s for s, y, _ in out if y], [s for s, y, _ in out if not y]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    hits = sum(y and p for _, y, p in out)
    assert auc > 0.85
    assert hits / len(pos) > 0.6 and sum(p and not y for _, y, p in out) <= max(1, 0.02 * len(neg))


def shingle_counts(text: str) -> Counter:
    words = WORD.findall(text or "")
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def j_p(a: Counter, b: Counter) -> float:
    a, b = ({x: n for x, n in c.items()} for c in (a, b))
    total = 0.0
    for x in a.keys() & b.keys():
        total += 1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in a.keys() | b.keys())
    return total


def classes(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates(spark, docs):
    sets = {r["doc_id"]: shingle_counts(r["text"]) for r in docs}
    texts = {r["doc_id"]: r["text"] or "" for r in docs}
    keys = sorted(sets)
    links = []
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if texts[a] == texts[b] or (small and len(sets[a].keys() & sets[b].keys()) >= 0.5 * large and j_p(sets[a], sets[b]) >= 0.8):
                links.append((a, b))
    want = classes(keys, links)
    assert {r["doc_id"]: r["class_id"] for r in run(spark, "op7_prob_min_hash")} == want


def test_length_histogram(spark, ids):
    lengths = [len(x) for x in ids.values()]
    rows = run(spark, "op8_length_histogram")
    assert {r["context_limit"]: r["n_docs"] for r in rows} == Counter(lengths)
    for r in rows[:: max(1, len(rows) // 20)]:
        limit = r["context_limit"]
        within = [n for n in lengths if n <= limit]
        assert (r["docs_within"], r["tokens_within"]) == (len(within), sum(within))
        assert (r["docs_beyond"], r["tokens_beyond"]) == (len(lengths) - len(within), sum(lengths) - sum(within))
        assert r["truncated_tokens"] == sum(min(n, limit) for n in lengths)
        assert r["quantile"] == pytest.approx(len(within) / len(lengths))


def check_packing(rows, ids):
    per, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        per[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert per.keys() == ids.keys()
    total = 0
    for d, pieces in per.items():
        own, at = [*ids[d], 0], 0
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert len(pieces) == -(-len(own) // 2048) and all(r["length"] == 2048 for r in pieces[1:])
        for r in pieces:
            assert r["start"] == at and r["ids_crc32"] == crc(own[at : at + r["length"]])
            at += r["length"]
        assert at == len(own)
        total += at
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    return len(sequences), total


def test_packing(spark, ids):
    n, total = check_packing(run(spark, "op9_best_fit_packing"), ids)
    assert n <= 1.02 * total / 2048 + 1


def test_containment(spark, docs):
    import duckdb

    items = {r["item_id"]: set(shingle_counts(r["text"])) for r in table("benchmark")}
    want = set()
    for r in docs:
        own = set(shingle_counts(r["text"]))
        want |= {(r["doc_id"], k, len(s), len(s & own)) for k, s in items.items() if s and len(s & own) / len(s) >= 0.8}
    got = run(spark, "op10_minhash_containment")
    assert want and {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in got} == want
    for name in ("documents", "benchmark"):
        duckdb.sql(f"create or replace view {name} as from '{SF}/{name}.parquet'")
    rows = duckdb.sql(ORACLE_SQL["op10_minhash_containment"]).fetchall()
    assert sorted(rows) == sorted((r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"], r["containment"]) for r in got)
