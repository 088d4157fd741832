"""Documents that hold benchmark items: latent semantic retrieval, then subsequence and answer checks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import free_name, map_slices, split_words, table
from shelfwise.llm.token_counts import runs

#: Items with fewer words than this are too short for a share of them: they are found as whole sequences of words.
MIN_WORDS = 5
#: Share of an item's words, in order, that makes a document contaminated; and that does so if the answer is there whole.
SIMILAR, PARAPHRASED = 0.8, 0.6
#: Fewest words of an answer: sentences from the end of an item until there are so many.
ANSWER_WORDS = 3
#: Least cosine of a candidate window in latent space.
COSINE = 0.4
RANK, OVERSAMPLED = 256, 8
#: Words of a block; windows are runs of blocks.
BLOCK = 32
#: Items longer than this are retrieved by passages of this many words.
PASSAGE = 128
#: Terms in more than this share of documents count only for items that have little else.
COMMON = 0.1
#: Passages whose vectors are made and sent together, and in one scan of the documents; a scan's vectors take so many bytes at most.
TOGETHER, IN_SCAN = 256, 4096
SCAN_BYTES = 256 << 20
#: Texts whose distinct words are looked up together.
ROWS = 512
#: Words of a document that are looked at together, besides what reaches into the next ones; more where an item is longer.
SEGMENT = 1 << 15
REMEMBERED = 500_000
#: Stretches without white space in which dropping all but letters and digits leaves one word: signs below U+0250, but for U+0130, which becomes two.
SIMPLE = r"^[\x21-\x7E\x{A1}-\x{12F}\x{131}-\x{24F}]*$"


def plain(word: str) -> str:
    """Letters and digits, lower-cased."""
    return "".join(filter(str.isalnum, word.lower()))


def words(text: str | None) -> list[str]:
    return [w for w in map(plain, (text or "").split()) if w]


def answer(text: str | None) -> list[str]:
    """The words of the last sentences of an item, as many sentences as it takes for ANSWER_WORDS words."""
    found: list[str] = []
    for sentence in reversed(re.split(r"[.!?\n]+", text or "")):
        found = words(sentence) + found
        if len(found) >= ANSWER_WORDS:
            break
    return found


class TermIds(dict):
    """Numbers of the words that stand between two blanks of a text: -1 if the benchmark hasn't a word; none if nothing is left of it.

    Stretches of SIMPLE signs are one word, looked up all at once; others are remembered one by one.
    """

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.words, self.numbers = pa.array(vocabulary, pa.string()), np.array([*vocabulary.values(), -1], np.int32)

    def __missing__(self, stretch: str) -> list[int]:
        if len(self) > REMEMBERED:
            self.clear()
        found = [self.vocabulary.get(bare, -1) for bare in words(stretch)]
        if len(stretch) <= 64:
            self[stretch] = found
        return found

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts one after another, and where each text's begin and the last ones end."""
        ends, places, distinct = split_words(texts)
        simple = pc.match_substring_regex(distinct, SIMPLE).to_numpy(zero_copy_only=False)
        bare = pc.utf8_lower(distinct.filter(pa.array(simple)))
        signs = pc.match_substring_regex(bare, r"[^\p{L}\p{N}]")
        bare = pc.replace_with_mask(bare, signs, pc.replace_substring_regex(bare.filter(signs), r"[^\p{L}\p{N}]+", ""))
        known = self.numbers[pc.fill_null(pc.index_in(bare, self.words), len(self.words)).to_numpy()]
        others = [self[stretch] for stretch in distinct.filter(pa.array(~simple)).to_pylist()]
        sizes = np.empty(len(distinct), np.int64)
        sizes[simple], sizes[~simple] = pc.binary_length(bare).to_numpy() > 0, [len(own) for own in others]
        begins, numbers = np.cumsum(sizes) - sizes, np.empty(int(sizes.sum()), np.int32)
        numbers[begins[simple & (sizes > 0)]] = known[sizes[simple] > 0]
        numbers[runs(begins[~simple], sizes[~simple])] = np.fromiter(chain.from_iterable(others), np.int32)
        own = sizes[places]
        after = np.concatenate(([0], np.cumsum(own)))
        return numbers[runs(begins[places], own)], after[ends]


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and the number of documents."""
    sent = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(vocabulary)})

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, total, rows = TermIds(sent.value), np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.column(0).slice(at, ROWS)
                numbers, ends = ids.texts(part)
                held = np.flatnonzero(numbers >= 0)
                pairs = (np.searchsorted(ends, held, "right") - 1) * len(vocabulary) + numbers[held]
                total += np.bincount(np.unique(pairs) % len(vocabulary), minlength=len(vocabulary))
                rows += len(part)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": [*used.tolist(), -1], "n": [*total[used].tolist(), rows]})

    parts = docs.select(F.col("text").cast("string")).mapInArrow(count, "term bigint, n bigint")
    found = dict(parts.groupBy("term").agg(F.sum("n")).collect())  # a row for each benchmark term
    return np.array([found.get(k, 0) for k in range(len(vocabulary))], np.float64), found.get(-1, 0)


def randomised_svd(passages: DataFrame, terms: int, rank: int, seed: int = 0) -> np.ndarray:
    """The right singular vectors (terms x rank) of the matrix whose rows are ``passages (ids, values)``, as int32 and float32 bytes.

    A random matrix is multiplied by A'A twice, with an orthonormal basis taken in
    between, and A'A is solved within the basis. Tasks multiply the rows they have;
    only their sums, of terms x rank numbers, come to the driver, one at a time.
    """
    spark, width = passages.sparkSession, rank + OVERSAMPLED

    def product(right: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(right)

        def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((terms, width))
            for batch in batches:
                for ids, values in zip(batch.column("ids").to_pylist(), batch.column("values").to_pylist()):
                    ids, values = np.frombuffer(ids, np.int32), np.frombuffer(values, np.float32).astype(float)
                    total[ids] += np.outer(values, values @ sent.value[ids])
            yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

        out = np.zeros((terms, width))
        for row in passages.mapInArrow(task, "part binary").toLocalIterator():
            out += np.frombuffer(row["part"]).reshape(terms, width)
        return out

    basis = np.random.default_rng(seed).standard_normal((terms, width))
    for _ in range(2):
        basis = np.linalg.qr(product(basis))[0]
        basis = np.pad(basis, ((0, 0), (0, width - basis.shape[1])))  # fewer terms than columns
    values, turn = np.linalg.eigh(basis.T @ product(basis))
    best = [k for k in np.argsort(values)[::-1][:rank] if values[k] > 1e-9 * max(values.max(), 1e-30)]
    return basis @ turn[:, best]


def common_length(masks: dict[int, int], size: int, ids: Iterable[int]) -> int:
    """Length of the longest common subsequence of a sequence of ``size`` words, given as bit masks by word, and ``ids``."""
    row = full = (1 << size) - 1
    for k in ids:
        hit = row & masks.get(k, 0)
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


class Item:
    """What checking a candidate needs: the item's words as numbers, bit masks of them, its answer."""

    def __init__(self, item_id: int | None, ids: list[int], wanted: list[int]):
        self.item_id, self.size, self.answer = item_id, len(ids), wanted
        self.masks: dict[int, int] = {}
        for k, word in enumerate(ids):
            self.masks[word] = self.masks.get(word, 0) | 1 << k
        self.times = {word: mask.bit_count() for word, mask in self.masks.items()}
        self.words = frozenset(self.masks)

    def may_be_in(self, present: set[int]) -> bool:
        """False if too few of the item's words are present at all, in whatever order."""
        return sum(map(self.times.__getitem__, self.words & present)) >= PARAPHRASED * self.size

    def similarity(self, ids: list[int]) -> float:
        """Share of the item found in ``ids``; 0 if that is too little."""
        share = common_length(self.masks, self.size, ids) / self.size
        if share >= SIMILAR:
            return share
        n = len(self.answer)
        if share >= PARAPHRASED and n >= ANSWER_WORDS and any(ids[k:k + n] == self.answer for k in range(len(ids) - n + 1)):
            return share
        return 0.0


class Searcher:
    """Up to TOGETHER passages: for each of their terms its products with all passages and its latent vector.

    ``terms`` are the numbers of the passages' terms, in order; ``basis`` has a row for each.
    """

    def __init__(self, passages: list[tuple[Item, list[int]]], terms: np.ndarray, weights: np.ndarray, basis: np.ndarray):
        self.items, self.terms = [item for item, _ in passages], terms
        self.latent = (weights[terms][:, None] * basis).astype(np.float32)
        vectors = np.array([self.latent[np.searchsorted(terms, ids)].sum(axis=0) for _, ids in passages])
        self.lengths = np.maximum(np.linalg.norm(vectors, axis=1), 1e-6)
        self.table = np.ascontiguousarray(self.latent @ (vectors / self.lengths[:, None]).T)
        spans = np.array([-(-(len(ids) + len(ids) // 4 - 1) // BLOCK) + 1 for _, ids in passages])
        self.spans = [(int(w), np.flatnonzero(spans == w)) for w in np.unique(spans)]

    @property
    def bytes(self) -> int:
        return self.latent.nbytes + self.table.nbytes

    @property
    def reach(self) -> int:
        """Words around a place that a search there may look at."""
        return max((max(w * BLOCK, s + s // 4 + BLOCK) for w, which in self.spans for s in (self.items[k].size for k in which)), default=0)

    def search(self, ids: np.ndarray, positions: np.ndarray, found: dict[int, float]) -> None:
        """Put the items that ``ids`` holds into ``found``, by place in ``items``; ``positions`` are those of weighted terms.

        Terms that no passage here has add nothing to any product, nor to a latent vector.

        Products with the passages add up over words, so windows are sums of
        blocks. The length of a window's latent vector, and so the cosine, is
        worked out where the product reaches COSINE times the passage's own length.
        """
        place = np.minimum(np.searchsorted(self.terms, ids[positions]), len(self.terms) - 1)
        here = self.terms[place] == ids[positions]
        blocks, terms = positions[here] // BLOCK, place[here]
        if not len(terms):
            return
        first = np.flatnonzero(np.diff(blocks, prepend=-1))
        window, width = np.zeros((len(ids) // BLOCK + 1, len(self.items)), np.float32), 1
        window[blocks[first]] = np.add.reduceat(self.table[terms], first, axis=0)
        sums = window.copy()
        for span, which in self.spans:
            for k in range(width, min(span, len(sums))):  # a window that reaches beyond the end is a shorter one
                window[:len(sums) - k] += sums[k:]
            width, last = span, -1
            part = window[:, which] if len(which) < len(self.items) else window
            for at, k in np.argwhere(part > COSINE * self.lengths[which]).tolist():
                if at != last:
                    last = at
                    a, b = np.searchsorted(blocks, (at, at + span))
                    norm = float(np.linalg.norm(self.latent[terms[a:b]].sum(axis=0)))
                    around: dict[int, tuple[list[int], set[int]]] = {}
                item = int(which[k])
                best, size = found.get(item, 0.0), self.items[item].size
                if best >= 1.0 or part[at, k] < COSINE * norm:
                    continue
                reach = max(span * BLOCK, size + size // 4 + BLOCK)  # a passage of a long item: look around it
                if reach not in around:
                    near = ids[max(0, at * BLOCK - reach + span * BLOCK):at * BLOCK + reach].tolist()
                    around[reach] = near, set(near)
                near, present = around[reach]
                if self.items[item].may_be_in(present):
                    share = self.items[item].similarity(near)
                    if share > best:
                        found[item] = share


class ShortItems:
    """Items of fewer than MIN_WORDS words, found by their rarest word as whole sequences."""

    def __init__(self, items: list[tuple[int | None, list[int]]], frequency: np.ndarray):
        self.by_word: dict[int, list[tuple[int | None, list[int], int]]] = {}
        self.anchors = np.zeros(len(frequency) + 1, bool)  # the last one stands for words that are no terms
        for item_id, ids in items:
            at = min(range(len(ids)), key=lambda k: (frequency[ids[k]], k))
            self.by_word.setdefault(ids[at], []).append((item_id, ids, at))
            self.anchors[ids[at]] = True

    def search(self, ids: np.ndarray, hits: dict) -> None:
        if not self.by_word:
            return
        for at in np.flatnonzero(self.anchors[ids]).tolist():
            for item_id, own, k in self.by_word[int(ids[at])]:
                if at >= k and ids[at - k:at - k + len(own)].tolist() == own:
                    hits[item_id] = 1.0


def searchers(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> tuple[list[str], np.ndarray, list[Searcher], ShortItems]:
    """The benchmark's terms, their TF-IDF weights (0: not looked at), its searchers and its short items.

    The benchmark is a stated query set and doesn't grow with the documents; it is
    worked through in groups of TOGETHER passages, whose matrices have the terms of
    those passages only. Weights use counts over all documents.
    """
    rows = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).collect()
    rows = sorted((r for r in rows if words(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    texts = [words(text) for _, text in rows]
    vocabulary = sorted({w for text in texts for w in text})
    if not vocabulary:
        return [], np.zeros(0), [], ShortItems([], np.zeros(0))
    number = {w: k for k, w in enumerate(vocabulary)}
    frequency, n = document_frequencies(docs, vocabulary)
    idf = np.log(1.0 + n / np.maximum(frequency, 1.0)) + 1e-3
    weighted = frequency <= COMMON * n
    passages, short = [], []
    for (item_id, text), own in zip(rows, texts):
        ids = [number[w] for w in own]
        if len(ids) < MIN_WORDS:
            short.append((item_id, ids))
            continue
        square = idf[ids] ** 2
        if square[weighted[ids]].sum() < 0.5 * square.sum():
            weighted[ids] = True
        item = Item(item_id, ids, [number[w] for w in answer(text)])
        step = PASSAGE // 2
        passages += [(item, ids[at:at + PASSAGE]) for at in range(0, max(1, len(ids) - step), step)]
    weights, out = np.where(weighted, idf, 0.0), []
    for at in range(0, len(passages), TOGETHER):
        part = passages[at:at + TOGETHER]
        terms, vectors = np.unique(np.concatenate([ids for _, ids in part])), []
        for _, ids in part:
            used, count = np.unique(ids, return_counts=True)
            vectors.append((np.searchsorted(terms, used).astype(np.int32).tobytes(), (count * weights[used]).astype(np.float32).tobytes()))
        frame = spark.createDataFrame(vectors, "ids binary, values binary")
        out.append(Searcher(part, terms, weights, randomised_svd(frame, len(terms), min(RANK, len(part)))))
    return vocabulary, weights, out, ShortItems(short, frequency)


def in_scans(groups: list[Searcher]) -> list[list[Searcher]]:
    """Groups that go to all tasks together: IN_SCAN passages and SCAN_BYTES at most, but one group at least."""
    scans: list[list[Searcher]] = [[]]
    for group in groups:
        if scans[-1] and (len(scans[-1]) * TOGETHER >= IN_SCAN or sum(g.bytes for g in scans[-1]) + group.bytes > SCAN_BYTES):
            scans.append([])
        scans[-1].append(group)
    return scans


def with_items(docs: DataFrame, benchmark: DataFrame, items: str = "item_ids", similarity: str = "similarity") -> DataFrame:
    """``docs`` with the ids of the benchmark items that a text holds (sorted) and the largest share of an item found.

    Items of fewer than MIN_WORDS words are found where their words stand in order
    and side by side; null items and those without a word are not looked for. A null
    or empty text holds none. Items with equal texts are all named. An empty benchmark
    gives empty lists.
    """
    spark = docs.sparkSession
    vocabulary, weights, groups, short = searchers(spark, docs, benchmark)
    out, names = docs, []
    for k, scan in enumerate(in_scans(groups)):
        brief = short if k == 0 else ShortItems([], np.zeros(len(vocabulary)))
        terms = sorted({t for group in scan for t in group.terms.tolist()} | {t for found in brief.by_word.values() for _, ids, _ in found for t in ids})
        sent = spark.sparkContext.broadcast(({vocabulary[t]: t for t in terms}, weights, scan, brief))
        # segments overlap by the longest item's reach, so one of them holds it whole
        overlap = max((max(group.reach, 2 * BLOCK * max(w for w, _ in group.spans)) for group in scan), default=0) + BLOCK
        step = max(SEGMENT, overlap)

        def work(part: pa.RecordBatch, sent=sent, overlap=overlap, step=step, state: dict = {}) -> list:  # noqa: B006 one for each task
            terms, weights, scan, brief = sent.value
            numbers, ends = state.setdefault("ids", TermIds(terms)).texts(part.column("text"))
            useful = np.concatenate((weights > 0, [False]))[numbers]  # -1 is the last one
            rows = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                hits: dict = {}
                brief.search(numbers[a:b], hits)
                for at in range(a, b, step):
                    own = numbers[at:min(b, at + step + overlap)]
                    positions = np.flatnonzero(useful[at:at + len(own)])
                    for group in scan if len(positions) else ():
                        found: dict[int, float] = {}
                        group.search(own, positions, found)
                        for item, share in found.items():
                            key = group.items[item].item_id
                            hits[key] = max(share, hits.get(key, 0.0))
                rows.append((sorted(hits, key=lambda i: (i is None, i)), max(hits.values(), default=0.0)))
            return list(zip(*rows)) or [[], []]

        names.append((free_name(out, f"{items}_{k}"), free_name(out, f"{similarity}_{k}")))
        out = map_slices(out, work, f"{names[-1][0]} array<bigint>, {names[-1][1]} double", keep=True, rows=ROWS)
    joined = F.array_sort(F.array_distinct(F.concat(*[F.col(a) for a, _ in names])))
    best = F.greatest(*[F.col(b) for _, b in names]) if len(names) > 1 else F.col(names[0][1])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], joined.alias(items), best.alias(similarity))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, contaminated, n_items, item_ids, similarity)`` for each row of ``docs``; repeated rows stay, other columns are ignored."""
    small = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = with_items(small, benchmark)
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").alias("n_items"), "item_ids", "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    items, similarity = free_name(docs, "_items"), free_name(docs, "_similarity")
    return with_items(docs, benchmark, items, similarity).where(F.size(items) == 0).drop(items, similarity)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in every document."""
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
