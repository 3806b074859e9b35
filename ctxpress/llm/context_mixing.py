"""Operator 2: language-model scoring by online logistic context mixing.

A text is coded token by token, in order. Every token is a symbol: one of the ``hot_words`` most frequent words, the end,
or an escape. The symbol's bits, along a Huffman path, are predicted from hashed contexts that reach across words (class,
the word before, place in the text), combined by gated weights and refined by an adaptive map (``mixing.py``);
weights and map go on learning within the document. A word behind an escape is coded by its frequency among the rarer
words of the class and of the corpus, a word never seen by its spelling, mixed bit by bit as well. The class (the group of
the text's most frequent character beyond ASCII) is coded first, so the score is the probability of the whole text.

All counts cover all training documents. Words are summed by key; the word table grows with the corpus and stays
distributed. Context tables have about as many slots as there are training tokens, at most ``2**20`` each (a memory bound:
beyond it contexts share slots). The tree, the slots' predictions and the spelling model are broadcast: their size is
bounded by ``hot_words`` and the slots. The maps of small counts are learnt from the counts of all training documents.
The weights and refinement that documents start from take one Newton step over the bits of all training documents and of
all rare words; a bounded sample (``sample_tokens``, ``sample_words``) only gives the point that the step starts from.
The sums are the same in any split into tasks up to rounding.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxpress.llm.common import fold, giving_back, materialize, partitions, read, work_dir
from ctxpress.llm.mixing import MOST_KEYS, LeftOut, SpellingModel, Statistics, WordModel, runs, slot_bits

END = b"\n"
ESCAPE, STOP = 0, 1
CLASSES = 64
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ASCII = bytes(range(128))


def tokens(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case; the end is not among them."""
    return text.encode("utf-8").translate(_LOWER).split()


def raw_class(text: str) -> int:
    """0, or 1 to 255 by the most frequent character beyond ASCII if it makes up 1 % of the text."""
    other = text.encode("utf-8").translate(None, _ASCII).decode("utf-8")
    if 100 * len(other) < len(text) or not other:
        return 0
    _, top = max((n, c) for c, n in Counter(other).items())
    return 1 + zlib.crc32(top.encode("utf-8")) % 255


# --- counting ---------------------------------------------------------------------------------------------------

_COUNT = pa.schema([("cls", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (see ``tokens``) as bytes, one behind the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
    real = pc.binary_length(words).to_numpy() > 0  # blanks at the ends of a text leave an empty piece
    if not real.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
        words = words.filter(pa.array(real))
    return words.cast(pa.binary()), sizes


def _grouped(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of some keys, sorted, and how many there are of each, or the sum of their ``times``."""
    order = None if times is None else np.argsort(keys, kind="stable")
    keys = np.sort(keys) if order is None else keys.take(order)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.diff(first, append=len(keys)) if order is None else np.add.reduceat(times.take(order), first)


def _count_words(batches, most: int = 1 << 21):
    """Rows (raw class, word, n), summed over about ``most`` words of a task at a time. In place of a word, END and the
    class count its texts, and END, the class and a character bucket which characters they hold. What is held meanwhile are
    the distinct words of every 1000 texts, not the words."""
    held, special, size = [], Counter(), 0  # of 1000 texts: words, keys (class, word), times

    def out():
        coded = pa.concat_arrays([words for words, _, _ in held]).dictionary_encode()
        index, starts = coded.indices.to_numpy().astype(np.int64), np.cumsum([0, *(len(words) for words, _, _ in held)])
        keys = np.concatenate([keys >> 32 << 32 | index.take((keys & 0xFFFFFFFF) + lo) for (_, keys, _), lo in zip(held, starts)])
        keys, times = _grouped(keys, np.concatenate([times for _, _, times in held]))
        words = coded.dictionary.take(pa.array(keys & 0xFFFFFFFF))
        names = pa.concat_arrays([pa.array([w for _, w in special], pa.binary()), words])
        cls = np.concatenate([np.array([c for c, _ in special], np.int64), keys >> 32])
        n = np.concatenate([np.array(list(special.values()), np.int64), times])
        held.clear(), special.clear()
        return pa.RecordBatch.from_arrays([pa.array(cls, pa.int32()), names, pa.array(n, pa.int64())], schema=_COUNT)

    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            texts = batch.column(0).slice(lo, 1000)
            own = []
            for text in texts.to_pylist():
                cls = raw_class(text)
                own.append(cls)
                special[cls, END + bytes([cls])] += 1
                if cls:
                    other = text.encode("utf-8").translate(None, _ASCII).decode("utf-8")
                    for c, n in Counter(other).items():
                        special[cls, END + bytes([cls, zlib.crc32(c.encode("utf-8")) % 255])] += n
            words, sizes = _words(texts)
            coded = words.dictionary_encode()
            held.append((coded.dictionary, *_grouped(np.repeat(np.array(own, np.int64), sizes) << 32 | coded.indices.to_numpy().astype(np.int64))))
            size += len(words)
            if size >= most:
                yield out()
                size = 0
    if held:
        yield out()


def group_classes(rows: list[tuple[int, bytes, int]]) -> dict[int, int]:
    """raw class -> class below CLASSES, from the summed (END...) rows: raw classes whose texts hold the same characters
    (cosine 0.5 or more with a more frequent one) are one; what exceeds the number shares the last."""
    docs, vectors = Counter(), {}
    for cls, word, n in rows:
        if len(word) == 2:
            docs[cls] += n
        else:
            vectors.setdefault(cls, np.zeros(256))[word[2]] += n
    found, heads = {0: 0}, []
    for cls, _ in sorted(docs.items(), key=lambda x: (-x[1], x[0])):
        if cls == 0:
            continue
        v = vectors[cls] / np.linalg.norm(vectors[cls])
        near = [k for k, h in heads if float(v @ h) >= 0.5]
        if not near:
            heads.append((min(len(heads) + 1, CLASSES - 1), v))
        found[cls] = near[0] if near else heads[-1][0]
    return found


@dataclass
class Corpus:
    """Bounded figures of the training corpus: N and V, documents by class, and of the words that are not hot: tokens (in
    all and by class), words seen once, and the tokens to be expected of words seen before."""

    n: int
    v: int
    classes: dict[int, int]
    docs: list[int]
    rare: int
    rare_by_class: list[int]
    once: int
    again: int

    @property
    def new(self) -> float:
        """Share of escapes that lead to a word never seen, after Good and Turing."""
        return (self.once + 1) / (self.once + self.again + 1) if self.rare else 1.0

    def base(self, count):
        return np.log10((count + 1) / (self.n + self.v + 1))

    def log10_class(self, cls: int) -> float:
        return float(np.log10((self.docs[cls] + 1) / (sum(self.docs) + CLASSES)))

    def log10_rare(self, cls: np.ndarray, in_class: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of a rare word behind an escape: four parts its share in the class, one part its share in the corpus."""
        sizes = np.maximum(np.array(self.rare_by_class, float)[cls], 1)
        return np.log10(np.maximum(1 - self.new, 1e-9) * (0.8 * in_class / sizes + 0.2 * count / max(self.rare, 1)))


class Vocabulary:
    """Hot words as symbols (``ESCAPE``, ``STOP``, then words by frequency) with their counts in the corpus, and of the
    most frequent other words what a join would give (table of word, count, n_main, cls)."""

    def __init__(self, words: list[tuple[bytes, int]], ends: int, rare: int, warm: pa.Table | None = None):
        self.n_hot, more = len(words), [] if warm is None else warm.column("word").cast(pa.binary()).chunks
        self.words = pa.concat_arrays([pa.array([w for w, _ in words], pa.binary()), *more])
        self.warm = [] if warm is None else [warm.column(c).to_numpy() for c in ("count", "n_main", "cls")]
        self.counts = np.array([0, ends, *(c for _, c in words)], np.int64)
        self.weights = [rare + 1, ends + 1, *(c for _, c in words)]  # of the tree

    def symbols(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of each word, and its row among the warm words (-1: none)."""
        found = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()
        hot = (found >= 0) & (found < self.n_hot)
        return np.where(hot, found + 2, ESCAPE), np.where(found >= self.n_hot, found - self.n_hot, -1)


# --- training ---------------------------------------------------------------------------------------------------

_PART = 1 << 16  # counts of a row


def _summed(rows: DataFrame, learn, mixer) -> None:
    """Fills the counts of ``mixer`` with the sum of what ``learn(batches)`` (a mixer) counts in each task. A row holds
    ``_PART`` counts; as many rows as the tables have reach the driver, whatever the corpus."""
    spark = rows.sparkSession

    def rows_of(parts):
        for part, row in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(row)], pa.int32()), pa.array([pa.compress(row, "zstd", asbytes=True)], pa.binary())], names=["part", "n", "data"])

    def row_of(n, data):
        return np.frombuffer(pa.decompress(data, 4 * n, "zstd"), np.int32)

    def partial(batches):
        own = learn(batches)
        parts = ((p << 16 | k // _PART, counts[k : k + _PART]) for p, counts in enumerate(own.counts) for k in range(0, len(counts), _PART))
        yield from rows_of((part, row) for part, row in parts if row.any())

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = row_of(n, data)
                sums[part] = sums[part] + row if part in sums else row
        yield from rows_of(sums.items())

    kinds = "part int, n int, data binary"
    done = rows.mapInArrow(giving_back(partial), kinds).repartition(partitions(spark), "part").mapInArrow(total, kinds)
    for r in done.collect():
        p, k = r["part"] >> 16, (r["part"] & 0xFFFF) * _PART
        mixer.counts[p][k : k + r["n"]] = row_of(r["n"], bytes(r["data"]))


_CODED = "uid long, doc_id long, held boolean, size long, cls int, symbols binary, known long, base double, full double, others array<struct<word:binary,n:long>>"


def _slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20):
    """``batch`` in parts of about ``most`` bytes of a text column."""
    ends, lo = np.cumsum(pc.binary_length(batch.column(column)).to_numpy().astype(np.int64)), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most)))
        yield batch.slice(lo, hi - lo)
        lo = hi


def code_texts(lean: DataFrame, corpus: Corpus, vocabulary: Vocabulary, at: str) -> DataFrame:
    """Each document of ``lean`` (doc_id, held, text) once as symbols (unsigned 16 bits), class, what its warm words come to
    (see ``Vocabulary``), and its other words with their numbers: training and scoring read this instead of the texts."""
    spark = lean.sparkSession
    shared = spark.sparkContext.broadcast((corpus, vocabulary))

    def run(batches):
        from pyspark import TaskContext

        corpus, vocabulary = shared.value
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in _slices(batch, 2):
                n, texts = part.num_rows, part.column(2)
                cls = np.array([corpus.classes.get(raw_class(text), 0) for text in texts.to_pylist()])
                words, sizes = _words(texts)
                found, warm = vocabulary.symbols(words)
                ends, symbols = np.cumsum(sizes + 1), np.full(len(words) + n, STOP, "<u2")
                doc = np.repeat(np.arange(n), sizes)
                symbols[np.arange(len(words)) + doc] = found
                symbols = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, 2 * ends).astype(np.int32)), pa.py_buffer(symbols)])
                near = np.flatnonzero(warm >= 0)
                in_doc, met = doc[near], [column[warm[near]] for column in vocabulary.warm] or [warm[near]] * 3
                full = corpus.log10_rare(cls[in_doc], np.where(cls[in_doc] == met[2], met[1], 0), met[0])
                known, base, full = np.bincount(in_doc, minlength=n), np.bincount(in_doc, corpus.base(met[0]), n), np.bincount(in_doc, full, n)
                escaped = np.flatnonzero((found == ESCAPE) & (warm < 0))
                rare = words.take(pa.array(escaped)).dictionary_encode()
                keys, times = _grouped(doc[escaped] << 32 | rare.indices.to_numpy().astype(np.int64))
                others = pa.StructArray.from_arrays([rare.dictionary.take(pa.array(keys & 0xFFFFFFFF)), pa.array(times, pa.int64())], names=["word", "n"])
                others = pa.ListArray.from_arrays(pa.array(np.searchsorted(keys >> 32, np.arange(n + 1)), pa.int32()), others)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + n)), part.column(0), part.column(1), pc.binary_length(texts).cast(pa.int64()), pa.array(cls, pa.int32()), symbols, pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64()), others],
                    names=["uid", "doc_id", "held", "size", "cls", "symbols", "known", "base", "full", "others"],
                )
                uid += n

    coded = materialize(lean.select("doc_id", "held", "text").mapInArrow(giving_back(run), _CODED), "coded", at)
    shared.destroy()
    return coded


def _moved(rows: DataFrame, bits_of, mixer, left_out: LeftOut) -> None:
    """Moves weights and refinement of ``mixer`` by the sums over the bits (slots, bit, depth, times) that ``bits_of(batches)``
    yields in all tasks. A task sends some 10 to 20 kB to the driver."""
    inputs, shared = len(mixer.weights), rows.sparkSession.sparkContext.broadcast(left_out)

    def partial(batches):
        own, left_out = Statistics.none(inputs), shared.value
        for slots, bit, depth, times in bits_of(batches):
            left_out.gather(own, slots, bit, depth, times)
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["data"])

    total = Statistics.none(inputs)
    for r in rows.mapInArrow(giving_back(partial), "data binary").collect():
        total.add(bytes(r["data"]))
    shared.destroy()
    mixer.move(total)


def _pieces(batches, most: int = 100_000):
    """(symbols, place, class of each token) for runs of the coded documents in ``batches`` (symbols, cls)."""
    held, size = [], 0

    def out():
        symbols = np.concatenate([s for s, _, _ in held])
        return symbols, np.concatenate([p for _, p, _ in held]), np.concatenate([np.full(len(s), c) for s, _, c in held])

    for batch in batches:
        for raw, cls in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            symbols = np.frombuffer(raw, "<u2").astype(np.int64)
            for k in range(0, len(symbols), most):  # at each cut of a long text one word is counted after the end
                part = symbols[k : k + most]
                held.append((part, np.arange(k, k + len(part)), cls))
                size += len(part)
                if size >= most:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


def train_words(coded: DataFrame, corpus: Corpus, vocabulary: Vocabulary, sample_tokens: int) -> WordModel:
    """Context counts and maps over all ``coded`` documents; weights and refinement start from a bounded sample of them,
    picked by hash, and take one Newton step over all."""
    spark = coded.sparkSession
    bits = slot_bits(corpus.n)
    model = WordModel(vocabulary.weights, bits)
    shared = spark.sparkContext.broadcast((model.weights, model.tree))

    def learn(batches):
        weights, tree = shared.value
        model = WordModel(weights, bits, tree)
        tally = model.tally()
        for symbols, place, cls in _pieces(batches):
            model.learn(tally, symbols, place, cls)
        model.settle(tally)
        return model.mixer

    _summed(coded.select("symbols", "cls"), learn, model.mixer)
    turn = F.xxhash64("symbols", "cls")
    share = min(1.0, 2 * sample_tokens / max(1, corpus.n))
    sample = coded.select("symbols", "cls", turn.alias("turn")).where(F.pmod("turn", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    room = F.sum(F.length("symbols")).over(Window.orderBy("turn", "symbols", "cls").rowsBetween(Window.unboundedPreceding, -1))
    # about twice sample_tokens enter the window; rows that begin within sample_tokens reach the driver, each cut to that length
    rows = sample.withColumn("before", F.coalesce(room, F.lit(0))).where(F.col("before") < 2 * sample_tokens).select(F.substring("symbols", 1, 2 * sample_tokens), "cls").collect()
    found, size = [], 0
    for raw, cls in rows:
        symbols = np.frombuffer(bytes(raw), "<u2").astype(np.int64)[: sample_tokens - size]
        size += len(symbols)
        found.append(model.steps(symbols, model.contexts(symbols, np.arange(len(symbols)), np.full(len(symbols), cls)))[:3])

    def bits_of(batches):
        weights, tree = shared.value
        model, held = WordModel(weights, bits, tree), []
        for symbols, place, cls in _pieces(batches):
            held.append(model.keys(symbols, place, cls))
            if sum(map(len, held)) >= MOST_KEYS:
                yield from model.all_bits(held)
                held = []
        if held:
            yield from model.all_bits(held)

    _fit(model.mixer, found, coded.select("symbols", "cls"), bits_of)
    shared.destroy()
    return model


def _fit(mixer, found: list, rows: DataFrame, bits_of) -> None:
    """Fits maps on all counts, weights and refinement on the bits ``found`` of a bounded sample and then on those of all
    ``rows``, and replaces counts by predictions."""
    if found:
        slots = [np.concatenate([f[0][p] for f in found]) for p in range(len(mixer.sizes))]
        left_out = mixer.fit(slots, np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found]))
        _moved(rows, bits_of, mixer, left_out)
    mixer.seal()


def train_spelling(words: DataFrame, n_words: int, sample_words: int) -> SpellingModel:
    """Slot counts and maps over all distinct ``words`` (word, cls); weights and refinement start from a bounded sample,
    picked by hash, and take one Newton step over all."""
    bits = slot_bits(4 * n_words)
    words = words.select("word", "cls")

    def bits_of(batches):
        model = SpellingModel(bits)
        for batch in batches:
            names, cls = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in runs(names, 500_000):
                yield from model.all_bits(names[lo:hi], cls[lo:hi])

    def learn(batches):
        model = SpellingModel(bits)
        for batch in batches:
            names, cls = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in runs(names, 500_000):
                for slots, bit, _, times in model.all_bits(names[lo:hi], cls[lo:hi]):
                    model.mixer.learn(slots, bit, times)
        return model.mixer

    model = SpellingModel(bits)
    _summed(words, learn, model.mixer)
    sample = words.orderBy(F.xxhash64("word"), "word").limit(sample_words).select(F.substring("word", 1, 64).alias("word"), "cls").collect()  # sample_words rows
    names, cls = [bytes(r["word"]) for r in sample], np.array([r["cls"] for r in sample], np.int64)
    _fit(model.mixer, [model.steps(names[lo:hi], cls[lo:hi])[:3] for lo, hi in runs(names, 50_000)], words, bits_of)
    return model


# --- scoring ----------------------------------------------------------------------------------------------------

def _table(rows: DataFrame) -> pa.Table | None:
    """The rows as an Arrow table (None: no rows), which reaches the driver in a few packed pieces."""

    def pack(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["data"])

    found = [pa.ipc.open_stream(bytes(r["data"])).read_all() for r in rows.mapInArrow(pack, "data binary").collect()]
    return pa.concat_tables(found).combine_chunks() if found else None


def _least(rare: DataFrame, most: int) -> int:
    """The least count that at most ``most`` words reach."""
    least = (1 << 62) + 1
    for r in rare.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("count")).limit(most + 1).collect():  # a row a count
        most -= r["n"]
        if most < 0:
            break
        least = r["count"]
    return least


def train(lean: DataFrame, at: str, hot_words: int = 65_000, warm_words: int = 131_000, sample_tokens: int = 60_000, sample_words: int = 6_000):
    """Corpus, vocabulary, both models, the table (word, count, n_main, cls) of rare words but warm ones, all learnt from the rows of ``lean``
    (doc_id, held, text) that are not held out, and all rows coded."""
    counted = lean.where("not held").select("text").mapInArrow(giving_back(_count_words), "cls int, word binary, n long")
    # one shuffle serves both sums; a task sends each word once for every 300 000 distinct ones, so no key is large
    sums = counted.repartition("word").groupBy("word", "cls").agg(F.sum("n").alias("n"))
    words = sums.groupBy("word").agg(F.sum("n").alias("count"), F.max(F.col("n") * 256 + F.col("cls")).alias("main"))
    words = materialize(words.sortWithinPartitions("word"), "words", at)  # words side by side share the most bits
    special = F.substring("word", 1, 1) == F.lit(bytearray(END))
    ends = [(bytes(r["word"])[1], bytes(r["word"]), r["count"]) for r in words.where(special).collect()]  # at most 256 * 256 rows
    classes, docs = group_classes(ends), Counter()
    for cls, word, n in ends:
        if len(word) == 2:
            docs[classes[cls]] += n
    of = F.create_map(*(F.lit(x) for pair in classes.items() for x in pair))[F.pmod("main", F.lit(256)).cast("int")]
    words = words.where(~special).select("word", "count", F.floor(F.col("main") / 256).alias("n_main"), of.alias("cls"))
    hot = [(bytes(r["word"]), r["count"]) for r in words.where("count > 1").orderBy(F.desc("count"), "word").limit(hot_words).collect()]  # hot_words rows
    if hot:
        last, least = hot[-1]
        rare = words.where((F.col("count") < least) | ((F.col("count") == least) & (F.col("word") > F.lit(bytearray(last)))))
    else:
        rare = words
    one = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("count") == 1), F.count_if(F.col("count") == 2)).first()
    n, v, once, twice = one
    by = {r["cls"]: r for r in rare.groupBy("cls").agg(F.sum("n_main").alias("n"), F.sum("count").alias("count")).collect()}  # CLASSES rows
    n_rare, n_docs = sum(r["count"] for r in by.values()), sum(docs.values())
    in_class = [by[c]["n"] if c in by else 0 for c in range(CLASSES)]
    corpus = Corpus(n + n_docs, v + (n_docs > 0), classes, [docs[c] for c in range(CLASSES)], n_rare, in_class, once, max(n_rare - once, 2 * twice))
    least = _least(rare, warm_words)
    vocabulary = Vocabulary(hot, n_docs, n_rare, _table(rare.where(F.col("count") >= least).select("word", "count", "n_main", "cls")))  # warm_words rows
    coded = code_texts(lean, corpus, vocabulary, at)
    model = train_words(coded.where("not held"), corpus, vocabulary, sample_tokens)
    spelling = train_spelling(rare, v, sample_words)
    return corpus, vocabulary, model, spelling, rare.where(F.col("count") < least), coded


def score(docs: DataFrame, held_out, **how) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of ``docs``.

    ``held_out`` (condition on doc_id): rows that are not learnt from. Null texts are empty and hold the end alone.
    Repeated rows all count and are all scored; equal texts have equal scores. Without training rows every word is new
    and spelled by the untrained model. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    at = work_dir(spark)
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    corpus, vocabulary, model, spelling, rare, coded = train(lean, at, **how)
    shared = spark.sparkContext.broadcast((corpus, vocabulary.counts, model))

    def mixed(batches):
        """What the symbols of each document come to; another word counts in n_tokens only."""
        corpus, counts, model = shared.value
        base_of = corpus.base(counts)
        base_of[ESCAPE] = 0.0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                cls = part.column(4).to_pylist()
                documents = [(np.frombuffer(s, "<u2").astype(np.int64), c) for s, c in zip(part.column(5).to_pylist(), cls, strict=True)]
                coded = model.log10(documents) + [corpus.log10_class(c) for c in cls]
                sizes = np.array([len(s) for s, _ in documents], np.int64)
                escapes = np.array([np.count_nonzero(s == ESCAPE) for s, _ in documents], np.int64)
                base = np.array([base_of[s].sum() for s, _ in documents]) + part.column(7).to_numpy()
                coded += part.column(8).to_numpy()
                known = sizes - escapes - int(not counts[STOP]) + part.column(6).to_numpy()
                more = [pa.array(x) for x in (sizes, known, base, coded)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), *more], names=["uid", "doc_id", "held", "size", "n_tokens", "n_known", "base", "full"])

    sums = "n_tokens long, n_known long, base double, full double"
    whole = coded.select("uid", "doc_id", "held", "size", "cls", "symbols", "known", "base", "full").mapInArrow(giving_back(mixed), f"uid long, doc_id long, held boolean, size long, {sums}")
    # the rare words of a partition are far fewer than the rows that meet them, which need no order
    met = coded.select("uid", "cls", F.explode("others").alias("x")).select("uid", "cls", "x.word", "x.n").join(rare.withColumnRenamed("cls", "main").hint("shuffle_hash"), "word", "left")
    in_class = F.when(F.col("cls") == F.col("main"), F.col("n_main")).otherwise(0)  # of the class that has most of a word
    met = met.select("uid", "cls", "word", "n", F.coalesce("count", F.lit(0)).alias("count"), in_class.cast("long").alias("in_class"))
    speller = spark.sparkContext.broadcast((corpus, spelling))

    def finish(batches):
        """What the words behind escapes come to."""
        corpus, spelling = speller.value
        for batch in batches:
            cls, times, count, in_class = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 3, 4, 5))
            full, new = corpus.log10_rare(cls, in_class, np.maximum(count, 1)), np.flatnonzero(count == 0)
            if len(new):
                full[new] = np.log10(corpus.new) + spelling.log10(batch.column(2).take(pa.array(new)).to_pylist(), cls[new])
            more = [pa.array(x) for x in (times * (count > 0), times * corpus.base(count), times * full)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *more], names=["uid", "n_known", "base", "full"])

    others = met.mapInArrow(finish, "uid long, n_known long, base double, full double")
    empty = {"doc_id": "long", "held": "boolean", "size": "long", "n_tokens": "long"}
    others = others.select("uid", *(F.lit(None).cast(t).alias(c) for c, t in empty.items()), "n_known", "base", "full")
    out = whole.unionByName(others).groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("held").alias("held_out"), F.max("size").alias("size"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "full")))
    bits = -F.col("full") / float(np.log10(2)) / F.greatest("size", F.lit(1))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("full").alias("score"), bits.alias("bits_per_byte"))


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents").select("doc_id", "text"), fold(7) == 2)
