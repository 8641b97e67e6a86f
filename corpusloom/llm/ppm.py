"""Prediction by partial matching over bytes, next to a unigram baseline over words.

The trie has the symbols that follow every context of up to ``ORDER`` bytes in the training texts. A byte is
predicted by its longest known context; where that context has not seen it, an escape (distinct symbols
over all occurrences plus distinct symbols) leads to the context one byte shorter, with the symbols of the
longer one excluded. The trie is pretrained: scoring does not change it, so each byte's code length follows
from the ORDER + 1 bytes that end there. Texts start after ``ORDER`` start marks and end with an end mark;
neither mark is a byte of UTF-8.

What a task needs is bounded. Words with a share of at least ``HOT_SHARE`` of all tokens, 1 / HOT_SHARE
at most, are broadcast; the rest, none of which is a hot key, is joined. All contexts of a position share its last
two bytes, so a trie of more than ``MODEL_ROWS`` leaves is cut by these into shards. Tasks build the shards and write them
below the checkpoint root, and the tasks that score read them there; the driver sees names, totals, frequent words and the
65,536 counts of two bytes at most. Each shard is a pass over the texts, stored with their row numbers, and
one sum by row at the end gives the same scores as a trie in one piece.

Nulls: a null text is empty (one token, the end). A row without doc_id is learned from and not held out.
Without training rows every byte has the probability of 1 in 256. Repeated rows each count. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tasks import map_batches, per_task, small_batches, texts
from corpusloom.session import scratch_path, store
from corpusloom.sources.files import file_system

ORDER = 5
START, END = 0xFE, 0xFF
HOT_SHARE = 2.0**-20
MODEL_ROWS = 4_000_000
SYMBOLS = 256
#: The token that ends every text; no word is empty.
END_TOKEN = b""
_HELD_WORDS, _HELD_GRAMS, _RUN = 200_000, 1_000_000, 1 << 19


def held_out():
    """Rows that are scored without having been learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def _mask(size: int) -> np.int64:
    return np.int64((1 << 8 * size) - 1)


def grams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The (ORDER + 1)-byte windows that end on each byte or end mark; windows per text."""
    lead, stop = bytes([START]) * ORDER, bytes([END])
    data = np.frombuffer(b"".join([x for p in parts for x in (lead, p, stop)]), np.uint8)
    windows = np.zeros(max(0, len(data) - ORDER), np.int64)
    for k in range(ORDER + 1):
        windows <<= np.int64(8)
        windows |= data[k : k + len(windows)]
    return windows[data[ORDER:] != START], np.array([len(p) + 1 for p in parts], np.int64)


def _runs(batch):
    """Lower-case texts of a batch, about ``_RUN`` bytes at a time, with the row they start at."""
    held, size, first = [], 0, 0
    for k, text in enumerate(texts(batch)):
        held.append(lowered(text))
        size += len(held[-1])
        if size >= _RUN:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


@per_task
class _Learn:
    """Counts words and windows of a partition; large holdings leave as partial counts."""

    def __init__(self):
        _BUILT.clear()
        self.words, self.keys, self.counts, self.held = Counter(), [], [], 0

    def _grams(self):
        if self.keys:
            keys, counts = _summed(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.held = [keys], [counts], len(keys)

    def _columns(self, grams: bool, words: bool) -> dict:
        keys = self.keys[0] if grams and self.keys else np.zeros(0, np.int64)
        counts = self.counts[0] if grams and self.keys else np.zeros(0, np.int64)
        found = list(self.words.items()) if words else []
        if grams:
            self.keys, self.counts, self.held = [], [], 0
        if words:
            self.words = Counter()
        times = pa.array([n for _, n in found], pa.int64())
        return {
            "gram": pa.concat_arrays([pa.array(keys), pa.nulls(len(found), pa.int64())]),
            "word": pa.concat_arrays([pa.nulls(len(keys), pa.binary()), pa.array([w for w, _ in found], pa.binary())]),
            "n": pa.concat_arrays([pa.array(counts), times]),
        }

    def __call__(self, batch) -> dict:
        for _, parts in _runs(batch):
            for part in parts:
                self.words.update(part.split())
            self.words[END_TOKEN] += len(parts)
            keys, counts = np.unique(grams(parts)[0], return_counts=True)
            self.keys.append(keys)
            self.counts.append(counts.astype(np.int64))
            self.held += len(keys)
            if self.held > _HELD_GRAMS:
                self._grams()
        much_grams, much_words = self.held > _HELD_GRAMS // 2 and len(self.keys) == 1, len(self.words) > _HELD_WORDS
        return self._columns(much_grams, much_words) if much_grams or much_words else {}

    def finish(self):
        self._grams()
        yield self._columns(True, True)


class Lookup:
    """Positions of known keys; an open-addressed table over int64 keys, all in numpy."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, probe = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slots[probe] < 0
            self.slots[probe[free]] = left[free]
            lost = self.slots[probe] != left
            left, probe = left[lost], (probe[lost] + 1) & (len(self.slots) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 where it is not known."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        probe = self._home(keys)
        found = self.slots[probe]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            probe[open_] = (probe[open_] + 1) & (len(self.slots) - 1)
            found[open_] = self.slots[probe[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != keys[open_])]
        return found


def build(leaves: np.ndarray, counts: np.ndarray, low: np.ndarray, low_counts: np.ndarray) -> list[dict]:
    """Symbols and contexts of every order, the empty context first.

    ``leaves`` are windows of ORDER + 1 bytes that share a shard; ``low`` are all windows of two bytes, from which
    orders 0 and 1 come, as they are common to all shards.
    """
    levels: list[dict] = []
    for order in range(ORDER + 1):
        source, n = (low, low_counts) if order < 2 else (leaves, counts)
        symbols, n = _summed(source & _mask(order + 1), n)
        contexts, first = np.unique(symbols >> np.int64(8), return_index=True)
        level = {"symbols": symbols, "n": n, "contexts": contexts}
        level["total"] = np.add.reduceat(n, first) if len(first) else n
        level["kinds"] = np.diff(np.append(first, len(symbols)))
        if order and len(first):
            shorter = levels[-1]
            at = np.searchsorted(shorter["symbols"], symbols & _mask(order))
            level["excluded"] = np.add.reduceat(shorter["n"][at], first)
        else:
            level["excluded"] = np.zeros(len(contexts), np.int64)
        levels.append(level)
    top = levels[-1]
    n, sizes = top.pop("n"), (top["total"] + top["kinds"]).repeat(top["kinds"])
    top["direct"] = np.log10(n / sizes) if len(n) else np.zeros(1)
    keys = ("symbols", "contexts", "direct")
    return [{name: x if name in keys else _narrow(x) for name, x in level.items()} for level in levels]


def _narrow(counts: np.ndarray) -> np.ndarray:
    """The same counts in the smallest signed type that has room for all of them."""
    largest = int(counts.max(initial=0))
    return counts.astype(next(t for t in (np.int16, np.int32, np.int64) if largest <= np.iinfo(t).max))


class Trie:
    """Code lengths of windows under a built model."""

    def __init__(self, levels: list[dict]):
        self.levels = levels
        self.symbols = [Lookup(x["symbols"]) for x in levels]
        self.contexts = [Lookup(x["contexts"]) for x in levels]
        self.direct = levels[-1]["direct"]

    def log10(self, windows: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each window, given the bytes before it."""
        found = self.symbols[-1].find(windows)
        out = np.where(found >= 0, self.direct[found], 0.0)
        left = np.flatnonzero(found < 0)
        if not len(left):
            return out
        keys, back = np.unique(windows[left], return_inverse=True)
        out[left] = self._escaped(keys)[back]
        return out

    def _escaped(self, windows: np.ndarray) -> np.ndarray:
        """The same by the full walk from the longest context down."""
        out, left = np.zeros(len(windows)), np.arange(len(windows))
        mass, kinds = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
        for order in range(ORDER, -1, -1):
            level, window = self.levels[order], windows[left]
            context = self.contexts[order].find((window >> np.int64(8)) & _mask(order))
            known = np.flatnonzero(context >= 0)
            at, rows = context[known], left[known]
            # Sums are taken in 64 bits: both subtrahends are.
            total = level["total"][at] - mass[rows]
            fresh = level["kinds"][at] - kinds[rows]
            symbol = self.symbols[order].find(window[known] & _mask(order + 1))
            seen = symbol >= 0
            if seen.any():  # never at the longest context, whose symbols are answered directly
                out[rows[seen]] += np.log10(level["n"][symbol[seen]] / (total + fresh)[seen])
            away = ~seen & (fresh > 0)
            out[rows[away]] += np.log10(fresh[away] / (total + fresh)[away])
            mass[rows], kinds[rows] = level["excluded"][at], level["kinds"][at]
            done = np.zeros(len(left), bool)
            done[known[seen]] = True
            left = left[~done]
        out[left] -= np.log10(np.maximum(1, SYMBOLS - kinds[left]))
        return out


_BUILT: dict = {}


def write_model(leaves: DataFrame, shards: int, low, folder: str) -> dict[int, str]:
    """Build every shard in a task of its own and write it below ``folder``; the file of each shard that has leaves.

    A partition is one shard, about ``MODEL_ROWS`` leaves, and arrives in batches without being sorted or held by the JVM.
    A repeated task writes a file of its own.
    """

    def built(batches):
        gram, n, shard = [], [], None
        for batch in batches:
            gram.append(batch.column("gram").to_numpy())
            n.append(batch.column("n").to_numpy())
            shard = batch.column("shard")[0] if len(batch) else shard
        if shard is None:
            return
        leaves = np.concatenate(gram), np.concatenate(n)
        del gram, n
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        with system.open_output_stream(f"{base}/{name}") as out:
            pickle.dump(build(*leaves, *low.value), out, protocol=5)
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_pydict({"shard": [shard.as_py()], "name": [name]}, pa.schema([("shard", pa.int32()), ("name", pa.string())]))

    dealt = leaves.withColumn("shard", _shard_column(shards).cast("int")).repartitionById(shards, F.col("shard"))
    return dict(map(tuple, store(dealt.mapInArrow(built, "shard int, name string"), "ppm-model").collect()))


def _trie(folder: str, name: str | None, low) -> Trie:
    """The trie of a shard, kept while a worker process goes from task to task; without a name one without leaves."""
    key = folder, name
    if key not in _BUILT:
        _BUILT.clear()
        if name is None:
            nothing = np.zeros(0, np.int64)
            levels = build(nothing, nothing, *low.value)
        else:
            system, base = file_system(folder)
            with system.open_input_stream(f"{base}/{name}") as data:
                levels = pickle.load(data)
            pa.default_memory_pool().release_unused()
        _BUILT[key] = Trie(levels)
    return _BUILT[key]


def shard_of(windows, shards: int):
    """The shard of a window: a digest of the last two bytes of its context."""
    return ((windows >> 8 & 0xFFFF) * 40503 >> 4) % shards


@per_task
class _Score:
    """Code length of each text over the windows of one shard; word sums in the first shard."""

    def __init__(self, folder: str, name: str | None, low, words, shard: int, shards: int):
        self.trie, self.words = _trie(folder, name, low), words and words.value
        self.shard, self.shards = shard, shards

    def __call__(self, batch) -> dict:
        out: dict[str, list] = {name: [] for name in ("score", "n_tokens", "n_known", "logs")}
        rare, times, ends = [], [], [0]
        for _, parts in _runs(batch):
            windows, sizes = grams(parts)
            logs = np.zeros(len(windows))
            mine = slice(None) if self.shards == 1 else np.flatnonzero(shard_of(windows, self.shards) == self.shard)
            logs[mine] = self.trie.log10(windows[mine])
            out["score"] += np.add.reduceat(logs, np.cumsum(sizes) - sizes).tolist()
            for part in parts if self.words is not None else ():
                counted = self._words(part, rare, times)
                ends.append(len(rare))
                for name, value in zip(("n_tokens", "n_known", "logs"), counted):
                    out[name].append(value)
        if self.words is None:
            return {"row": batch.column("row"), "score": out["score"]}
        pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], ["word", "times"])
        own = {c: batch.column(c) for c in ("row", "doc_id", "held_out")}
        return out | own | {"rare": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)}

    def _words(self, part: bytes, rare: list, times: list) -> tuple[int, int, float]:
        """Tokens, hot tokens and their log sum; the other words go to the lists with their counts."""
        known, logs, tokens = 0, 0.0, part.split()
        found = Counter(tokens)
        found[END_TOKEN] = 1
        get = self.words.get
        for word, n in found.items():
            if (log := get(word)) is None:
                rare.append(word)
                times.append(n)
            else:
                known += n
                logs += n * log
        return len(tokens) + 1, known, logs


def learn(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, n) and (word, c) over all training rows."""
    training = docs.where(~held_out()).select("text")
    with small_batches(docs.sparkSession):
        partial = store(map_batches(training, _Learn, "gram long, word binary, n long"), "ppm-counts")
    leaves = partial.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n"))
    words = partial.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c"))
    return store(leaves, "ppm-trie"), store(words, "ppm-words")


def score(docs: DataFrame, model_rows: int = MODEL_ROWS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    leaves, words = learn(docs)
    tokens, kinds = [x or 0 for x in words.agg(F.sum("c"), F.count("*")).first()]
    rows = leaves.count()
    hot = words.where(F.col("c") >= tokens * HOT_SHARE).toArrow()
    logs = np.log10(hot.column("c").to_numpy().astype(float) + 0.5).tolist()
    hot_words = spark.sparkContext.broadcast(dict(zip(hot.column("word").to_pylist(), logs)))
    pairs = leaves.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("g")).agg(F.sum("n").alias("n")).toArrow()
    low = spark.sparkContext.broadcast([c.to_numpy().astype(np.int64) for c in pairs.columns])
    shards = max(1, -(-rows // model_rows))
    folder, sums = scratch_path(spark, "ppm-shards"), scratch_path(spark, "ppm-sums")
    files = write_model(leaves, shards, low, folder)
    chosen = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out().alias("held_out"), "text")
    if shards > 1:  # all passes have to know a row by the same number
        chosen = store(chosen, "ppm-texts")
    fields = "row long, score double"
    more = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double"
    more += ", rare array<struct<word: binary, times: long>>"
    with small_batches(spark):
        scored = store(
            map_batches(chosen, _Score, f"{fields}, {more}", folder, files.get(0), low, hot_words, 0, shards), "ppm-scores"
        )
        for shard in range(1, shards):
            args = (folder, files.get(shard), low, None, shard, shards)
            map_batches(chosen.select("row", "text"), _Score, fields, *args).write.mode("append").parquet(sums)
    if shards > 1:
        rest = spark.read.schema(fields).parquet(sums).groupBy("row").agg(F.sum("score").alias("rest"))
        scored = scored.join(rest, "row", "left").withColumn("score", F.col("score") + F.col("rest")).drop("rest")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    known = rare.join(words, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_logs"),
        F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("rare_known"),
    )
    scale = float(np.log10(tokens + 0.5 * (kinds + 1)))
    return scored.drop("rare").join(known, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * scale).alias("base_score"),
        "score",
    )


def _shard_column(shards: int):
    """``shard_of`` as a column over ``gram``."""
    last = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    return F.shiftright(last * 40503, 4) % shards
