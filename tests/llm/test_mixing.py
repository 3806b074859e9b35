"""The mixing model against a plain loop over bits, and held-out scores against the base score."""

from __future__ import annotations

import math

import numpy as np
import pytest

from ctxpress.llm.mixing import BUCKETS, GATES, Mixer, SpellingModel, Statistics, Tree, WordModel


def trained():
    rng = np.random.default_rng(3)
    documents = [(np.append(rng.zipf(1.5, n).clip(2, 39), 1).astype(np.int64), int(k % 3)) for k, n in enumerate([0, 1, 5, 300, 40, 700])]
    model = WordModel([5, 6, *range(60, 22, -1)], 14)
    tally, found = model.tally(), []
    for symbols, cls in documents:
        place, classes = np.arange(len(symbols)), np.full(len(symbols), cls)
        model.learn(tally, symbols, place, classes)
        found.append(model.steps(symbols, model.contexts(symbols, place, classes))[:3])
    model.settle(tally)
    counts = [c.copy() for c in model.mixer.counts]
    slots = [np.concatenate([f[0][p] for f in found]) for p in range(4)]
    bits = np.concatenate([f[1] for f in found])
    for own, slot in zip(counts, slots, strict=True):  # what learn and settle count is each bit once
        assert np.array_equal(own, np.bincount(slot * 2 + bits, minlength=len(own)))
    model.mixer.fit(slots, bits, np.concatenate([f[2] for f in found]))
    model.mixer.seal()
    return model, documents


def plain(model: WordModel, symbols: np.ndarray, cls: int, block: int = 128) -> float:
    """One document, bit by bit in Python floats."""
    m, total = model.mixer, 0.0
    weights, refine = m.weights.astype(float), m.refine.astype(float)
    contexts = model.contexts(symbols, np.arange(len(symbols)), np.full(len(symbols), cls))
    for lo in range(0, len(symbols), block):
        seen, step, cells = {}, {}, {}
        for k in range(lo, min(lo + block, len(symbols))):
            slots, bits, depths, _ = model.steps(symbols[k : k + 1], [c[k : k + 1] for c in contexts])
            for j, (bit, depth) in enumerate(zip(bits.tolist(), depths.tolist(), strict=True)):
                x = [float(m.tables[p][slots[p][j]]) for p in range(4)] + [0.3]
                g, row = depth * 4 + int(m.sightings[slots[m.known][j]]), depth >> 1
                z = min(7.999, max(-7.999, sum(weights[i][g] * x[i] for i in range(5))))
                p, at = 1 / (1 + math.exp(-z)), (z + 8) * (BUCKETS - 1) / 16
                low, part = int(at), at - int(at)
                final = min(1 - 1e-6, max(1e-6, (p + refine[row][low] * (1 - part) + refine[row][low + 1] * part) / 2))
                total += math.log10(final if bit else 1 - final)
                seen[g] = seen.get(g, 0) + 1
                step[g] = [a + (bit - p) * b for a, b in zip(step.get(g, [0.0] * 5), x, strict=True)]
                cell = (row, low + (part > 0.5))
                n, ones = cells.get(cell, (0, 0))
                cells[cell] = (n + 1, ones + bit)
        for g, s in step.items():
            for i in range(5):
                weights[i][g] += 0.01 / math.sqrt(seen[g]) * s[i]
        for (row, k), (n, ones) in cells.items():
            refine[row][k] += min(0.5, 0.005 * n) * (ones / n - refine[row][k])
    return total


def test_against_a_plain_loop():
    model, documents = trained()
    assert model.mixer.weights.shape[1] == GATES
    got = model.log10(documents)
    for value, (symbols, cls) in zip(got, documents, strict=True):
        assert value == pytest.approx(plain(model, symbols, cls), rel=1e-3)
    for most in (128, 256, 10_000):  # whatever is coded at a time
        assert np.array_equal(model.log10(documents, most=most), got)
    assert model.log10(documents[::-1])[::-1] == pytest.approx(got, abs=0)


def test_probabilities_of_all_symbols_sum_to_one():
    model, _ = trained()
    ends = [10 ** model.log10([(np.array([k]), 0)])[0] for k in range(40)]
    assert sum(ends) == pytest.approx(1, abs=1e-4)


def test_tree_is_optimal_for_powers_of_two():
    tree = Tree([1, 1, 2, 4, 8])
    assert tree.length.tolist() == [4, 4, 3, 2, 1]
    assert Tree([3]).length.tolist() == [0]


def test_word_order_counts():
    """The text is coded in order: shuffled words have another probability."""
    model, documents = trained()
    symbols, cls = documents[3]
    mixed = np.append(np.random.default_rng(1).permutation(symbols[:-1]), 1)
    assert model.log10([(mixed, cls)])[0] != model.log10([(symbols, cls)])[0]


def test_spelling():
    model = SpellingModel(14)
    words, cls = [b"abc", b"abd", "é".encode(), b"a" * 300], np.array([0, 1, 2, 0])
    slots, bit, depth, word = model.steps(words, cls)
    assert np.bincount(word).tolist() == [8 * (len(w) + 1) for w in words]
    model.mixer.learn(slots, bit)
    model.mixer.seal()
    once = model.log10(words, cls)
    assert (once < 0).all() and model.log10(words[1:2], cls[1:2])[0] == once[1] and len(model.log10([], cls[:0])) == 0


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    from ctxpress.llm.context_mixing import op2_context_mixing

    rows = op2_context_mixing(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_weights_are_those_of_all_training_rows(spark):
    """However small the sample that training starts from, the weights end near those of all rows: 0.2 % apart, 3.4 % with the sample alone."""
    from ctxpress.llm.common import fold, read
    from ctxpress.llm.context_mixing import score

    docs = read(spark, "/root/testdata/sf0.01", "documents")
    few, many = (score(docs, fold(7) == 2, sample_tokens=n, sample_words=w).agg({"score": "sum"}).first()[0] for n, w in ((3_000, 300), (60_000, 6_000)))
    assert few == pytest.approx(many, rel=1e-2)


def test_statistics_are_sums_over_bits():
    """Maps, slopes and refinement against a plain loop; the slopes go to 0."""
    rng = np.random.default_rng(5)
    mixer, bit, depth = Mixer((50, 400), known=1), rng.integers(0, 2, 3000), rng.integers(0, 8, 3000)
    slots = [(rng.integers(0, n // 2, 3000) * 2 + (rng.random(3000) < 0.1 + 0.8 * bit)) for n in mixer.sizes]
    mixer.learn(slots, bit)
    left_out, whole, parts = mixer.left_out(), Statistics.none(3), Statistics.none(3)
    left_out.gather(whole, slots, bit, depth)
    for lo in range(0, 3000, 700):
        own = Statistics.none(3)
        left_out.gather(own, [s[lo : lo + 700] for s in slots], bit[lo : lo + 700], depth[lo : lo + 700])
        parts.add(own.tobytes())
    for a, b in zip(whole.parts(), parts.parts(), strict=True):
        assert b == pytest.approx(a, rel=1e-3, abs=1e-2)
    slope = np.zeros((GATES, 3))
    for k in range(3000):
        n = [(mixer.counts[p][2 * s[k]] - (bit[k] == 0), mixer.counts[p][2 * s[k] + 1] - (bit[k] == 1)) for p, s in enumerate(slots)]
        x = [float(mixer._stretched(p, np.array([a]), np.array([b]))[0]) for p, (a, b) in enumerate(n)] + [0.3]
        g = depth[k] * 4 + int(mixer._sighted(np.array([sum(n[1])]))[0])
        slope[g] += (bit[k] - 1 / (1 + math.exp(-sum(mixer.weights[i][g] * x[i] for i in range(3))))) * np.array(x)
    assert whole.slope == pytest.approx(slope, rel=1e-2, abs=0.2)
    assert whole.hits.sum() == 3000 and whole.ones.sum() == bit.sum()
    sums, found = [np.abs(whole.slope).sum()], whole
    for _ in range(6):  # Newton steps, from weights that nothing was fitted to
        mixer.move(found)
        found = Statistics.none(3)
        left_out.gather(found, slots, bit, depth)
        sums.append(np.abs(found.slope).sum())
    assert sums[1] < 0.5 * sums[0] and sums[-1] < 0.01 * sums[0]


def test_sums_take_equal_bits_once():
    """Bits that tokens or words share are looked up once, and the counts are those of every bit."""
    rng = np.random.default_rng(7)
    symbols, place, cls = np.append(rng.zipf(1.3, 4000).clip(2, 39), 1), np.arange(4001), np.zeros(4001, np.int64)
    model = WordModel([5, 6, *range(60, 22, -1)], 14)
    words = sorted({bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in rng.integers(1, 50, 900)})
    classes, spelling = rng.integers(0, 2, len(words)), SpellingModel(14)
    for every, once, sizes in (
        (model.steps(symbols, model.contexts(symbols, place, cls)), list(model.all_bits([model.keys(symbols, place, cls)])), model.mixer.sizes),
        (spelling.steps(words, classes), list(spelling.all_bits(words, classes)), spelling.mixer.sizes),
    ):
        assert sum(len(bit) for _, bit, _, _ in once) < 0.9 * len(every[1])
        assert sum(int(times.sum()) for *_, times in once) == len(every[1])
        for p, n in enumerate(sizes):
            counts = np.zeros(2 * n, np.int64)
            for slots, bit, _, times in once:
                np.add.at(counts, slots[p] * 2 + bit, times)
            assert np.array_equal(counts, np.bincount(every[0][p] * 2 + every[1], minlength=2 * n))


def test_words_and_symbols_of_texts():
    """Words are cut and counted by Arrow as ``tokens`` cuts them."""
    import pyarrow as pa

    from ctxpress.llm.context_mixing import ESCAPE, Vocabulary, _count_words, _words, raw_class, tokens

    texts = ["", " ", " a  B\x0b\x1cc\x85 d ", "É é É", "\x00a \x00 a", "Ab\u3000c İ\n"]
    words, sizes = _words(pa.array(texts))
    assert sizes.tolist() == [len(tokens(t)) for t in texts] and words.to_pylist() == [w for t in texts for w in tokens(t)]
    warm = pa.table({"word": pa.array([b"b"]), "count": [1], "n_main": [1], "cls": [0]})
    symbols, rows = Vocabulary([(b"a", 3), (b"d", 1)], 6, 9, warm).symbols(words)
    assert symbols.tolist() == [{b"a": 2, b"d": 3}.get(w, ESCAPE) for w in words.to_pylist()]
    assert rows.tolist() == [0 if w == b"b" else -1 for w in words.to_pylist()]
    rows = [r for most in (2, 100) for b in _count_words(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]), most) for r in b.to_pylist()]
    for word in set(words.to_pylist()):
        for cls in {raw_class(t) for t in texts}:
            own = sum(tokens(t).count(word) for t in texts if raw_class(t) == cls)
            assert sum(r["n"] for r in rows if (r["word"], r["cls"]) == (word, cls)) == 2 * own


def test_looked_up_words_score_as_joined_ones(spark):
    """Whether a rare word meets its counts in a broadcast table or in the join, the scores are the same."""
    from ctxpress.llm.common import fold, read
    from ctxpress.llm.context_mixing import score

    docs = read(spark, "/root/testdata/sf0.001", "documents")
    joined, looked = ({r["doc_id"]: r for r in score(docs, fold(7) == 2, hot_words=500, warm_words=n).collect()} for n in (0, 1_000))
    for k, r in joined.items():
        assert (looked[k]["n_tokens"], looked[k]["n_known"]) == (r["n_tokens"], r["n_known"])
        assert (looked[k]["base_score"], looked[k]["score"]) == pytest.approx((r["base_score"], r["score"]), rel=1e-9)


def test_training_holds_its_keys_once():
    """Memory to take equal bits of many tokens once: that of the keys, not that of several arrays as long."""
    import tracemalloc

    rng = np.random.default_rng(11)
    model, n = WordModel([5, 6, *range(60, 22, -1)], 14), 1 << 20
    symbols, place, cls = rng.integers(2, 40, n), 1 << rng.integers(0, 40, n), rng.integers(0, 64, n)
    keys = [k.copy() for k in np.array_split(model.keys(symbols, place, cls), 32)]
    tracemalloc.start()
    found = sum(int(times.sum()) for *_, times in model.all_bits(keys, most=10_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == int(model.tree.length.take(symbols).sum())
    assert peak < 2 * 8 * n


def test_counting_holds_distinct_words():
    """Memory to count a task's words: that of the distinct words of each 1000 texts."""
    import tracemalloc

    import pyarrow as pa

    from ctxpress.llm.context_mixing import _count_words

    texts = [" ".join(f"w{k % 500}" for k in range(n, n + 150)) for n in range(8_000)]
    batch, usual = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), pa.default_memory_pool()
    pool = pa.proxy_memory_pool(usual)
    tracemalloc.start()
    pa.set_memory_pool(pool)
    try:
        rows = [r for b in _count_words(iter([batch])) for r in b.to_pylist()]
    finally:
        pa.set_memory_pool(usual)
        peak = tracemalloc.get_traced_memory()[1] + pool.max_memory()
        tracemalloc.stop()
    assert sum(r["n"] for r in rows if r["word"][:1] == b"w") == 8_000 * 150
    assert len(rows) == 501 and peak < 30e6


def test_a_task_gives_memory_back():
    """Batches pass unchanged, and what was freed goes back to the system, also if a task fails."""
    import psutil

    from ctxpress.llm.common import giving_back

    def run(batches):
        blocks = [bytearray(60_000) for _ in range(2_000)]  # below the size that the allocator maps, so it keeps them
        keep.extend(bytearray(1_000) for _ in range(50))
        yield from batches
        del blocks
        if failing:
            raise ValueError

    keep: list = []
    for failing in (False, True):
        before, got = psutil.Process().memory_info().rss, []
        try:
            for x in giving_back(run)(iter([1, 2, 3])):
                got.append(x)
        except ValueError:
            assert failing
        assert got == [1, 2, 3] and psutil.Process().memory_info().rss < before + 40e6
