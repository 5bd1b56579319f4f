"""Benchmark decontamination by latent semantic retrieval.

The benchmark's passages are the query set. Their words are the vocabulary; inverse document frequencies are counted
over all documents. A randomised SVD, computed by Spark from partial products, gives the latent space of the
benchmark's TF-IDF passages. Every window of every document is folded into it, and items whose cosine with a
window reaches ``COSINE`` are candidates. So are items that the cosine misses (their words are in many documents, or the
window has heavier words beside them) but of whose rarest words the window and its surroundings have as many as
any leak must have: a leak lacks at most a fifth of the item's words, so this count loses none. All
candidates are verified. A candidate is a leak if the longest common subsequence of words covers
``MIN_LCS`` of the item within that window and its surroundings, and the item's answer (its last sentence) is there
too, so edited and paraphrased passages are found and passages that share common words only are not.

Words outside the vocabulary can't match any item, so documents are stored once as vocabulary ids and their
places, and nothing else is read later. Items are taken in blocks of ``BLOCK_ITEMS``: vocabulary and model of a
block are bounded and travel to the tasks. Search is a narrow map over the documents, nothing is shuffled.

Recall: the leaks are those of brute force over all windows and items, whatever their cosine; the tests compare them.

Defined results: null and empty texts, and null or blank items, are in no pair. Items of fewer than ``MIN_WORDS`` words
must occur word for word. The cosine of an item whose words are in all documents is 0. Rows with a null id are searched too and reported with a null id; repeated rows
are reported once per row by ``leaks`` and once in all by the query. Empty tables give an empty table.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import slices, stored, table

BLOCK_ITEMS = 512
RANK = 64
#: Columns of the random test matrix beyond the rank.
EXTRA = 16
IDF_POWER = 1.5
COSINE = 0.75
MIN_LCS = 0.8
MIN_ANSWER = 0.5
MIN_WORDS = 8
ANSWER_WORDS = 4
SMALLEST_WINDOW = 32
#: Matches asked of an item's rarest words, beyond those that a leak may lack.
RARE_WORDS = 4
#: Items whose rarest words are counted at one time: no word of a text has more matches than this.
COUNTED_ITEMS = 64
#: Windows start at multiples of this many words.
CELL = SMALLEST_WINDOW // 4
_STRIP = ".,;:!?\"'()[]{}#*$%&|<>"
_KNOWN_WORDS = 1_000_000
#: Words of a part of a long text, and vocabulary words that are folded in at one time.
PART_WORDS = 30_000
BATCH_WORDS = 30_000



class _Ids(dict):
    """The ids of words as they are spelt, each normalised once. Arrow looks up ASCII words among ``words``."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.words = pa.array(list(vocabulary), pa.string())

    def __missing__(self, word: str) -> int:
        bare = normal(word)
        found = self[word] = self.vocabulary.get(bare, -1) if bare else _NO_WORD
        return found


#: Per worker: the vocabulary seen last and the ids of raw words.
_known: dict = {"of": None, "ids": {}}


def normal(word: str) -> str:
    """A word without case and outer punctuation."""
    return word.lower().strip(_STRIP)


def item_words(text: str | None) -> list[str]:
    return [w for w in map(normal, (text or "").split()) if w]


def answer_words(text: str | None) -> list[str]:
    """The words of the last sentence, or of the last ``ANSWER_WORDS`` words if that is more."""
    words = (text or "").split()
    ends = [i for i, w in enumerate(words[:-1]) if re.search(r"[.!?][\"')\]]*$", w)]
    start = min(ends[-1] + 1 if ends else 0, max(0, len(words) - ANSWER_WORDS))
    return item_words(" ".join(words[start:]))


class Items:
    """A block of items: their vocabulary, ids, answers and window sizes."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        kept = [(i, item_words(t), answer_words(t)) for i, t in rows]
        kept = [k for k in kept if k[1]]
        self.item_ids = [k[0] for k in kept]
        self.vocabulary: dict[str, int] = {}
        for _, words, _ in kept:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.ids = [[self.vocabulary[w] for w in words] for _, words, _ in kept]
        self.answers = [[self.vocabulary[w] for w in words] for _, _, words in kept]
        self.window = [max(SMALLEST_WINDOW, 1 << (len(x) - 1).bit_length()) for x in self.ids]

    def matrix(self, idf: np.ndarray, chosen=None) -> np.ndarray:
        """TF-IDF rows of unit length, for all items or those chosen."""
        rows = range(len(self.ids)) if chosen is None else chosen
        out = np.zeros((len(rows), len(self.vocabulary)))
        for r, i in enumerate(rows):
            np.add.at(out[r], self.ids[i], 1)
        out *= idf**IDF_POWER
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


#: Marks that stand alone are no words and have no place, in documents as in items.
_NO_WORD = -2
TOKENS = "doc_id long, row long, n_words int, ids array<int>, gaps array<int>"


def _places(texts: pa.Array, known: _Ids) -> list[pa.Array]:
    """Per text: its number of words, the ids of those in the vocabulary, and their places as differences."""
    words = pc.utf8_split_whitespace(texts)
    bounds = words.offsets.to_numpy()
    bare = pc.ascii_trim(pc.ascii_lower(words.values), characters=_STRIP)
    ids = pc.fill_null(pc.index_in(bare, value_set=known.words), -1).to_numpy().copy()
    ids[pc.binary_length(bare).to_numpy() == 0] = _NO_WORD
    other = np.flatnonzero(~pc.string_is_ascii(words.values).to_numpy(zero_copy_only=False))
    ids[other] = [known[w] for w in words.values.take(pa.array(other)).to_pylist()]
    passed = np.concatenate([[0], np.cumsum(ids != _NO_WORD)])
    before, found = passed[bounds], np.flatnonzero(ids >= 0)
    cuts, at = np.searchsorted(found, bounds), passed[found]
    gaps = np.diff(at, prepend=0)
    filled = np.flatnonzero(np.diff(cuts))
    gaps[cuts[filled]] = at[cuts[filled]] - before[filled]
    offsets = pa.array(cuts, pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (ids[found], gaps)]
    return [pa.array(np.diff(before), pa.int32()), *lists]


def tokens(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """Vocabulary words of every document and their places, as differences. ``row``: a hash of the text."""

    name = uuid.uuid4().hex

    def run(batches):
        if _known["of"] != name:
            _known.update(of=name, ids=_Ids(vocabulary))
        known = _known["ids"]
        for part in slices(batches):
            if len(known) > _KNOWN_WORDS:
                known.clear()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *_places(part.column(2), known)], names=names)

    names = ["doc_id", "row", "n_words", "ids", "gaps"]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("row"), text.alias("text"))
    return stored(rows.mapInArrow(run, TOKENS), "tokens")


def inverse_frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """ln(documents / documents with the word), over all documents; at most ``size`` counts reach the driver."""
    each = rows.select(F.explode(F.array_distinct("ids")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    counts, total = np.zeros(size), rows.count()
    for r in each.collect():
        counts[r["id"]] = r["n"]
    return np.log((1 + total) / (1 + counts))


def latent_space(spark, items: Items, idf: np.ndarray, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """(vocabulary, rank) right singular vectors of the TF-IDF passages, by a distributed randomised SVD.

    With a random matrix W, Spark sums AᵀA W over parts of the passages; its orthonormal basis Q spans the
    leading space. A second sum gives (AQ)ᵀ(AQ), whose eigenvectors turn Q into singular vectors.
    """
    size, n = len(items.vocabulary), len(items.ids)
    width = min(rank + EXTRA, n, size)

    def summed(block, shape) -> np.ndarray:
        """The sum of ``block(rows)`` over all passages: partial sums per task, then per row of the result."""

        def run(batches):
            total = np.zeros(shape)
            for batch in batches:
                total += block(items.matrix(idf, batch.column(0).to_pylist()))
            arrays = [pa.array(np.arange(shape[0])), *(pa.array(total[:, c]) for c in range(shape[1]))]
            yield pa.RecordBatch.from_arrays(arrays, names=["r", *(f"c{c}" for c in range(shape[1]))])

        schema = "r long, " + ", ".join(f"c{c} double" for c in range(shape[1]))
        parts = spark.range(0, n, 1, max(1, n // 64)).mapInArrow(run, schema)
        rows = parts.groupBy("r").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(shape[1])]).collect()
        return np.array([r[1:] for r in sorted(rows)])

    test = np.random.default_rng(seed).standard_normal((size, width))
    basis, _ = np.linalg.qr(summed(lambda a: a.T @ (a @ test), (size, width)))
    gram = summed(lambda a: (a @ basis).T @ (a @ basis), (width, width))
    _, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return basis @ vectors[:, ::-1][:, :rank]


def common_subsequence(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, a bit per word of the item."""
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        if m := where.get(w):
            u = row & m
            row = (row + u) | (row - u)
    return len(item) - (row & full).bit_count()


def rarest(words: list[int], idf: np.ndarray) -> tuple[list[int], int]:
    """The rarest words of an item, and how many of their occurrences any leak has.

    A leak lacks at most ``missing`` places of the item. Words are taken until they make up some places more, so
    each leak matches the rest of these places, each by a word of its own.
    """
    short = len(words) < MIN_WORDS
    missing = 0 if short else int((1 - MIN_LCS) * len(words) + 1e-6)
    counts, chosen, places = Counter(words), [], 0
    for w in sorted(counts, key=lambda w: (-idf[w], w)):
        if places >= missing + (1 if short else RARE_WORDS):
            break
        chosen.append(w)
        places += counts[w]
    return chosen, places - missing


def word_for_word(item: list[int], ids: list[int], at: list[int]) -> bool:
    n = len(item)
    return any(ids[i : i + n] == item and at[i + n - 1] - at[i] == n - 1 for i in range(len(ids) - n + 1))


class Searcher:
    """Finds the items of a block in documents given as vocabulary ids and places."""

    def __init__(self, items: Items, idf: np.ndarray, space: np.ndarray, cosine: float = COSINE):
        self.items, self.cosine = items, cosine
        #: The last row stands for places without a vocabulary word.
        self.words = np.pad(space * (idf**IDF_POWER)[:, None], ((0, 1), (0, 0))).astype("f4")
        vectors = (items.matrix(idf) @ space).astype("f4")
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 1e-6)
        self.sets = [frozenset(x) for x in items.ids]
        self.classes = []
        for window in sorted(set(items.window)):
            own = np.flatnonzero(np.array(items.window) == window)
            self.classes.append((window, own, vectors[own].T.copy()))
        rare = [rarest(x, idf) for x in items.ids]
        self.window, self.need = np.array(items.window), np.array([n for _, n in rare])
        #: Per group of items: where the items of each vocabulary word begin, and the items.
        self.rare = []
        for lo in range(0, len(rare), COUNTED_ITEMS):
            pairs = np.array([(w, i) for i, (words, _) in enumerate(rare[lo : lo + COUNTED_ITEMS], lo) for w in words])
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            self.rare.append((np.searchsorted(pairs[:, 0], np.arange(len(idf) + 1)), pairs[:, 1]))

    def find(self, docs: list[tuple[np.ndarray, np.ndarray, int]]):
        """(document, item, first word, cosine, subsequence share, answer share): the best leak per document and item.

        ``docs``: vocabulary ids, their places and the number of words of each text. Long texts are searched
        in parts that overlap by two of the largest windows.
        """
        parts, size, reach = [], 0, 2 * self.classes[-1][0]
        best: dict[tuple[int, int], tuple] = {}
        for d, (ids, at, n) in enumerate(docs):
            for origin in range(0, max(1, n - reach), PART_WORDS):
                length = min(n - origin, PART_WORDS + reach)
                lo, hi = np.searchsorted(at, [origin, origin + length])
                if hi > lo:
                    parts.append((d, origin, ids[lo:hi], at[lo:hi] - origin, length))
                    size += hi - lo
                if size >= BATCH_WORDS:
                    self._search(parts, best)
                    parts, size = [], 0
        if parts:
            self._search(parts, best)
        for (d, item), (share, answer, cosine, first) in best.items():
            yield d, item, first, cosine, share, answer

    def _counted(self, ids: np.ndarray, at: np.ndarray, base: np.ndarray):
        """(item, part, first, last place) of as many of an item's rarest words as a leak has, within a window and its surroundings."""
        out = []
        for begin, items in self.rare:
            n = begin[ids + 1] - begin[ids]
            word = np.repeat(np.arange(len(ids)), n)
            item = items[np.repeat(begin[ids], n) + np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)]
            order = np.argsort(item, kind="stable")
            item, place = item[order], at[word[order]]
            last = np.arange(len(item)) + self.need[item] - 1
            first = np.flatnonzero(last < len(item))
            last = last[first]
            part = np.searchsorted(base, place[first], "right") - 1
            # A window has a step, a quarter of it, on either side.
            close = place[last] - place[first] < self.window[item[first]] * 3 // 2
            same = (item[first] == item[last]) & close
            same &= part == np.searchsorted(base, place[last], "right") - 1
            out.append((item[first][same], part[same], place[first][same] - base[part[same]], place[last][same] - base[part[same]]))
        return [np.concatenate(c) for c in zip(*out)]

    def _search(self, parts, best) -> None:
        """Fold all windows of the parts into the latent space at once; verify what is near and what has the rarest words."""
        widest = self.classes[-1][0]
        lengths = np.array([p[4] for p in parts])
        # Parts lie on one line, a window or more apart, at multiples of the widest window.
        ends = np.cumsum((lengths // widest + 2) * widest)
        base = np.concatenate([[0], ends[:-1]])
        ids = np.concatenate([p[2] for p in parts])
        at = np.concatenate([p[3] + b for p, b in zip(parts, base)])
        # Sums of the vectors of every eight places, then running sums of those: windows are differences.
        line = np.full(ends[-1], len(self.words) - 1)
        line[at] = ids
        running = np.zeros((ends[-1] // CELL + 1, self.words.shape[1]), "f4")
        for column in line.reshape(-1, CELL).T:
            running[1:] += self.words.take(column, axis=0)
        np.cumsum(running, axis=0, out=running)
        counted, text = self._counted(ids, at, base), ids.tolist()
        for window, own, vectors in self.classes:
            # Windows lie a quarter window apart; the last one reaches the end of the text.
            step = window // 4
            counts = np.maximum(1, -(-(lengths - window) // step) + 1)
            offset = np.cumsum(counts) - counts
            part = np.repeat(np.arange(len(parts)), counts)
            first = (np.arange(len(part)) - np.repeat(offset, counts)) * step
            lo = (base[part] + first) // CELL
            v = running[lo + window // CELL] - running[lo]
            norm = np.sqrt(np.einsum("ij,ij->i", v, v))
            near = (v @ vectors) >= (self.cosine * np.maximum(norm, 1e-3))[:, None]
            w, j = np.divmod(np.flatnonzero(near), len(own))
            # The windows that have these words, themselves or in their surroundings.
            item, of, begin, end = (c[self.window[counted[0]] == window] for c in counted)
            low = np.maximum((end - window - step) // step + 1, 0)
            high = np.minimum(begin // step + 1, counts[of] - 1)
            n = np.maximum(high - low + 1, 0)
            more = np.repeat(offset[of] + low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs = np.unique(np.r_[j * len(part) + w, np.repeat(np.searchsorted(own, item), n) * len(part) + more])
            j, w = np.divmod(pairs, len(part))
            cosine = np.einsum("ij,ij->i", v[w], vectors.T[j]) / np.maximum(norm[w], 1e-3)
            # Neighbouring windows of an item are a run. What all of it lacks, each of its windows lacks.
            fresh = (np.diff(j, prepend=-1) != 0) | (np.diff(w, prepend=-1) != 1) | (np.diff(part[w], prepend=-1) != 0)
            starts = np.flatnonzero(fresh)
            stops = np.append(starts[1:], len(w))[: len(starts)]
            places = base[part[w]] + first[w]
            from_, to = np.searchsorted(at, places - step), np.searchsorted(at, places + window + step)
            runs = (own[j[starts]], starts, stops, from_[starts], to[stops - 1])
            for item, start, stop, left, right in zip(*(x.tolist() for x in runs)):
                if self._lacks(item, text[left:right]):
                    continue
                for k in sorted(range(start, stop), key=lambda k: -cosine[k]):
                    d, origin = parts[part[w[k]]][:2]
                    old = best.get((d, item))
                    if old is not None and old[0] == 1.0 and old[1] == 1.0:
                        break
                    new = self._verify(item, text[from_[k] : to[k]], at[from_[k] : to[k]])
                    if new is not None:
                        new = (*new, float(cosine[k]), int(first[w[k]]) + origin)
                        best[d, item] = new if old is None else max(old, new)

    def _lacks(self, item: int, near: list[int]) -> bool:
        """Whether more words of the item are missing than a leak may lack."""
        n = len(self.items.ids[item])
        return len(self.sets[item].difference(near)) > (0 if n < MIN_WORDS else (1 - MIN_LCS) * n + 1e-9)

    def _verify(self, item: int, near: list[int], at: np.ndarray) -> tuple[float, float] | None:
        """(subsequence share, answer share) if this is a leak. Cheap bounds come first: a word that is missing can't be common."""
        words, answer = self.items.ids[item], self.items.answers[item]
        if len(words) < MIN_WORDS:
            return (1.0, 1.0) if word_for_word(words, near, at.tolist()) else None
        if self._lacks(item, near):
            return None
        share = common_subsequence(words, near) / len(words)
        if share < MIN_LCS - 1e-9:
            return None
        said = common_subsequence(answer, near) / len(answer)
        return (share, said) if said >= MIN_ANSWER else None


LEAK = "doc_id long, row long, item_id long, start long, cosine double, lcs double, answer double"


def _blocks(benchmark: DataFrame, size: int):
    """The items in blocks of at most ``size``, by item id: the stated query set."""
    last = None
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    rows = rows.filter(F.col("item_id").isNotNull()).groupBy("item_id", "text").agg(F.lit(1))
    while True:
        after = rows if last is None else rows.filter(F.struct("item_id", "text") > F.struct(*map(F.lit, last)))
        block = [(r["item_id"], r["text"]) for r in after.orderBy("item_id", "text").limit(size).collect()]
        if block:
            yield block
            last = block[-1]
        if len(block) < size:
            return


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Every leak of an item in a row of ``docs`` (doc_id, text), see LEAK. ``row`` is a hash of the text."""
    spark, out = docs.sparkSession, None
    for block in _blocks(benchmark, BLOCK_ITEMS):
        items = Items(block)
        if not items.ids:
            continue
        rows = tokens(docs, items.vocabulary)
        idf = inverse_frequencies(rows, len(items.vocabulary))
        searcher = Searcher(items, idf, latent_space(spark, items, idf), cosine)
        found = stored(rows.mapInArrow(_search(searcher), LEAK), "leaks")
        out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], LEAK)


def _search(searcher: Searcher):
    names = [x.split()[0] for x in LEAK.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.float64()] * 3

    def run(batches):
        for part in slices(batches):
            doc, row, n, ids, gaps = (part.column(i) for i in range(5))
            texts = [
                (i.values.to_numpy(), np.cumsum(g.values.to_numpy()), size)
                for i, g, size in zip(ids, gaps, n.to_pylist())
            ]
            rows = [
                (doc[d].as_py(), row[d].as_py(), searcher.items.item_ids[item], first, *scores)
                for d, item, first, *scores in searcher.find(texts)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), kinds)], names=names)

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any leak, with the columns of ``docs``."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("_dc_doc"), F.col("row").alias("_dc_row")).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    same = F.col("doc_id").eqNullSafe(F.col("_dc_doc")) & (F.xxhash64(text) == F.col("_dc_row"))
    return docs.join(stored(bad, "leaking"), same, "left_anti")


def op6(spark, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.max(F.struct("lcs", "answer", "cosine", "start")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("b.lcs").alias("lcs"), F.col("b.answer").alias("answer"), F.col("b.cosine").alias("cosine"), F.col("b.start").alias("start")
    )
