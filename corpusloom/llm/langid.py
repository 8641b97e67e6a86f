"""Language identification by words first, backing off to character n-grams.

Training counts words and padded character n-grams per language. A word scores by the logarithm of
its relative frequency in each language; a word no language knows falls back to the mean over its longest
n-grams that any language knows, one character shorter at a time. A text's language has the best mean over its
words; the score is that language's share after exponentiation over the words' total.

The model is fitted on the ``SAMPLE_ROWS`` labelled training rows that come first by hash of doc_id, and holds every
word and n-gram of theirs; the sample is what bounds it.

Nulls: a null or letterless text gives ``und`` with score 0. Rows without doc_id or lang are not
learned from. Ties go to the language that is first by name. A table without training rows predicts ``und``.
Repeated rows give a row each; other columns are kept where ``predict`` is asked to.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tasks import map_batches, per_task, texts
from corpusloom.session import store

SAMPLE_ROWS = 20_000
LONGEST = 5
UNKNOWN = "und"
#: Log10 given to a language that lacks an entry others have; lower where an entry is as rare as that.
PENALTY = -7.0
#: A text is rejected when no language has this share.
SURE = 0.5
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: ASCII characters other than lower-case letters become blanks.
_BLANKS = {c: " " for c in range(128) if not chr(c).islower()}
_CACHE = 1 << 17


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    low = text.lower()
    return low.translate(_BLANKS).split() if low.isascii() else _WORD.findall(low)


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _word_counts(batch) -> dict:
    counts: dict = {}
    for lang, text in zip(batch.column("lang").to_pylist(), texts(batch)):
        counts.setdefault(lang, Counter()).update(words_of(text))
    rows = [(lang, word, n) for lang, found in counts.items() for word, n in found.items()]
    return {"lang": [r[0] for r in rows], "entry": [r[1] for r in rows], "n": [r[2] for r in rows]}


def _gram_counts(batch) -> dict:
    counts: dict = {}
    for lang, word, n in zip(*[batch.column(c).to_pylist() for c in ("lang", "entry", "n")]):
        for size in range(1, LONGEST + 1):
            found = counts.setdefault((lang, size), {})
            for gram in grams_of(word, size):
                found[gram] = found.get(gram, 0) + n
    rows = [(lang, size, gram, n) for (lang, size), found in counts.items() for gram, n in found.items()]
    return {name: [r[k] for r in rows] for k, name in enumerate(("lang", "size", "entry", "n"))}


def held_out() -> F.Column:
    """Rows whose labels and texts are never learned from; also true without doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Counts per language on executors; they come back as a model.

    It has ``langs``, and for every place ``sizes`` (0: words, else the length of n-grams), ``entries`` and
    ``rows``, the log frequency in each language.
    """
    labelled = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(~held_out())
    chosen = labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = labelled.join(store(chosen, "langid-sample"), "doc_id").select("lang", "text")
    words = map_batches(sample, _word_counts, "lang string, entry string, n long")
    words = store(words.groupBy("lang", "entry").agg(F.sum("n").alias("n")), "langid-words")
    # N-grams are cut once from each distinct word, weighted with its count.
    grams = map_batches(words, _gram_counts, "lang string, size int, entry string, n long")
    grams = grams.groupBy("lang", "size", "entry").agg(F.sum("n").alias("n"))
    counts = words.select("lang", F.lit(0).alias("size"), "entry", "n").unionByName(grams)
    counts = store(counts, "langid-counts")
    return _model(counts.toArrow().sort_by([("size", "ascending"), ("entry", "ascending"), ("lang", "ascending")]))


def _model(counts: pa.Table) -> dict:
    """Log frequencies from the counts of (lang, size, entry), sorted by size and entry."""
    langs = sorted(set(counts.column("lang").to_pylist()))
    if not langs:
        return {"langs": [], "sizes": np.zeros(0, np.int8), "entries": pa.array([], pa.string()), "rows": np.zeros((0, 0))}
    lang = pc.index_in(counts.column("lang"), pa.array(langs)).to_numpy()
    size, n = counts.column("size").to_numpy().astype(np.int64), counts.column("n").to_numpy().astype(float)
    entry = counts.column("entry").combine_chunks()
    fresh = np.ones(len(size), bool)
    fresh[1:] = (np.diff(size) != 0) | pc.not_equal(entry[1:], entry[:-1]).to_numpy(zero_copy_only=False)
    group = lang * (LONGEST + 1) + size
    share = np.log10(n / np.bincount(group, n)[group])
    rows = np.full((int(fresh.sum()), len(langs)), min(PENALTY, share.min() - 1))
    rows[np.cumsum(fresh) - 1, lang] = share
    return {"langs": langs, "sizes": size[fresh].astype(np.int8), "entries": entry.filter(pa.array(fresh)), "rows": rows}


@per_task
class _Identify:
    """Scores texts; words met before are remembered as rows of one table, renewed when it is full."""

    def __init__(self, model, keep: bool):
        self.keep = keep
        self.langs, sizes, entries, self.rows = [model.value[k] for k in ("langs", "sizes", "entries", "rows")]
        self.unknown = float(self.rows.min()) if len(self.rows) else PENALTY
        ends = np.searchsorted(sizes, np.arange(LONGEST + 2)).tolist()
        places = [dict(zip(entries[a:b].to_pylist(), range(a, b))) for a, b in zip(ends, ends[1:])]
        self.words, self.grams = places[0], places[1:]
        # Words met only here come after the model's rows.
        self.met, self.base, self.filled = {}, len(sizes), len(sizes)

    def backed_off(self, words: list[str]) -> np.ndarray:
        """Per word the mean over its longest known n-grams."""
        places, sizes = [], []
        for word in words:
            found: list = []
            for size in range(min(LONGEST, len(word) + 2), 0, -1):
                get = self.grams[size - 1].get
                if found := [p for g in grams_of(word, size) if (p := get(g)) is not None]:
                    break
            places += found
            sizes.append(len(found))
        rows, counts = np.full((len(words), len(self.langs)), self.unknown), np.array(sizes)
        known = np.flatnonzero(counts)
        if len(known):
            ends = np.cumsum(counts[known])
            rows[known] = np.add.reduceat(self.rows[places], ends - counts[known]) / counts[known, None]
        return rows

    def rows_of(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies for each of these different words."""
        places = list(map(self.words.get, words))
        away = [k for k, place in enumerate(places) if place is None]
        if self.filled > self.base and self.filled + len(away) > self.base + _CACHE:
            self.met, self.filled = {}, self.base
        new = []
        for k in away:
            if (place := self.met.get(words[k])) is None:
                new.append(k)
            else:
                places[k] = place
        if new:
            unseen, end = [words[k] for k in new], self.filled + len(new)
            if end > len(self.rows):
                more = np.zeros((max(len(self.rows), end - len(self.rows)), len(self.langs)))
                self.rows = np.concatenate([self.rows, more])
            self.rows[self.filled : end] = self.backed_off(unseen)
            self.met.update(zip(unseen, range(self.filled, end)))
            for k, place in zip(new, range(self.filled, end)):
                places[k] = place
            self.filled = end
        return self.rows[places]

    def score(self, text: str) -> tuple[str, float]:
        found = Counter(words_of(text))
        if not found or not self.langs:
            return UNKNOWN, 0.0
        weight = np.fromiter(found.values(), float, len(found))
        total = weight @ self.rows_of(list(found))
        best = int(total.argmax())
        share = 1.0 / np.exp(np.maximum((total - total[best]) * math.log(10), -700)).sum()
        return self.langs[best], float(share)

    def __call__(self, batch) -> dict:
        results = [self.score(t) for t in texts(batch)]
        kept = {c: batch.column(c) for c in batch.schema.names if self.keep or c != "text"}
        return kept | {"lang_pred": [r[0] for r in results], "score": [r[1] for r in results]}


def predict(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` plus lang_pred and score; a map without shuffle."""
    columns = list(dict.fromkeys([*keep, "text"]))
    chosen = docs.select(columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in chosen.schema.fields if "text" in keep or f.name != "text"]
    schema = type(chosen.schema)(fields).add("lang_pred", "string").add("score", "double")
    return map_batches(chosen, _Identify, schema, shared, "text" in keep)


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """Documents whose language is found with a share of at least ``SURE``; all columns stay.

    Columns pass by position, so none of their names can clash with the two new ones.
    """
    names = [c if c == "text" else f"_{k}" for k, c in enumerate(docs.columns)]
    found = predict(docs.toDF(*names), fit(docs), names)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= SURE))
    return kept.select(names).toDF(*docs.columns)
