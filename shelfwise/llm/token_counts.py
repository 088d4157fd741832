"""Token counts of documents: the pieces of each distinct pre-token are counted once, then summed by frequency."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import sha256
from itertools import chain
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import map_slices, settle, split_words, table

LIMIT = 2048
#: Longest pre-token that is its own key; of longer ones the key is a digest, and the text moves once for each task.
OWN_KEY = 40
#: Pre-tokens whose counts are sent to all tasks, the most frequent ones: at most so many, each of OWN_KEY characters or a digest.
COMMON = 1 << 16
#: Distinct pre-tokens, and bytes of them, that a task holds before it passes its counts on.
HELD, HELD_BYTES = 500_000, 1 << 25
#: Texts whose distinct words are cut together.
ROWS = 1024
#: How the word tokenizers cut lower-cased text, and the texts that need nothing else before: letters below U+0250, but
#: for U+0130, which becomes two, and no white space beyond ASCII's. There composing changes nothing.
WORD_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIMPLE = r"^[\x00-\x{84}\x{86}-\x{9F}\x{A1}-\x{12F}\x{131}-\x{24F}]*$"


class Cut(NamedTuple):
    """Texts as words, and distinct words as pre-tokens.

    The words of text k are ``places[ends[k]:ends[k + 1]]``; the pre-tokens of word
    w are ``ids[begins[w]:begins[w + 1]]``, places in ``pre_tokens``.
    """

    ends: np.ndarray
    places: np.ndarray
    begins: np.ndarray
    ids: np.ndarray
    pre_tokens: pa.Array


class PreTokens:
    """Cuts texts into pre-tokens as a tokenizer file of the ``tokenizers`` library says, and counts their pieces.

    Special strings inside a text are one token each, as is the library's default;
    among the pre-tokens they stand behind a blank. Where the tokenizer drops white space and joins nothing across it, a text is
    first split at blanks, so that each distinct word is cut once; simple words are
    cut all at once by a regular expression, others by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        if not path.endswith(".json"):
            raise ValueError("pre-tokens need a .json file of the tokenizers library")
        self.tokenizer, spec = Tokenizer.from_file(path), json.loads(Path(path).read_text("utf-8"))
        added = spec["added_tokens"]
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError("special strings that depend on what stands beside them are not supported")
        strings = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, strings))})") if strings else None
        self.special_ids = {f" {a['content']}": a["id"] for a in added}
        self.by_words = all(self._library(f"a{blank}b") == ["a", "b"] for blank in " \n\t\r")
        patterns = [str(x.get("pattern", {}).get("Regex")) for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.simple = self.by_words and WORD_CUT in patterns and "Lowercase" in json.dumps(spec["normalizer"])
        self.memo: dict[str, list[str]] = {}

    def _library(self, text: str) -> list[str]:
        """Pre-tokens as they stand in the normalised text."""
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        text = normal.normalize_str(text) if normal else text
        return [text[a:b] for _, (a, b) in cut.pre_tokenize_str(text)] if cut else [text] if text else []

    def _cut_one(self, word: str) -> list[str]:
        found = self.memo.get(word)
        if found is None:
            found = []
            for k, part in enumerate(self.special.split(word) if self.special else [word]):
                found += [f" {part}"] if k % 2 else self._library(part) if part else []
            if len(self.memo) > HELD // 4:
                self.memo.clear()
            if len(word) <= OWN_KEY:
                self.memo[word] = found
        return found

    def cut(self, texts: pa.Array) -> Cut:
        if self.by_words:
            ends, places, words = split_words(texts)
        else:
            coded = pc.fill_null(texts, "").dictionary_encode()
            ends, places, words = np.arange(len(texts) + 1), coded.indices.to_numpy(), coded.dictionary
        simple = np.zeros(len(words), bool)
        if self.simple and len(words):
            simple = pc.match_substring_regex(words, SIMPLE).to_numpy(zero_copy_only=False)
            if self.special:
                simple = simple & ~pc.match_substring_regex(words, self.special.pattern).to_numpy(zero_copy_only=False)
        lower = pc.utf8_lower(words)
        whole = simple & pc.match_substring_regex(lower, r"^\p{Ll}*$").to_numpy(zero_copy_only=False)  # one pre-token
        mixed, hard = simple & ~whole, ~simple
        spaced = pc.replace_substring_regex(lower.filter(pa.array(mixed)), f"({WORD_CUT})", r"\1 ")
        quick = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(spaced))
        slow = [self._cut_one(word) for word in words.filter(pa.array(hard)).to_pylist()]
        flat = pa.concat_arrays([lower.filter(pa.array(whole)), quick.flatten(), pa.array(chain.from_iterable(slow), pa.string())])
        sizes = np.ones(len(words), np.int64)
        sizes[mixed], sizes[hard] = np.diff(quick.offsets.to_numpy()), [len(own) for own in slow]
        turn = np.concatenate([np.flatnonzero(kind) for kind in (whole, mixed, hard)])  # the order in which words lie in flat
        begins = np.concatenate(([0], np.cumsum(sizes)))
        coded, ids = flat.dictionary_encode(), np.empty(len(flat), np.int64)
        ids[runs(begins[turn], sizes[turn])] = coded.indices.to_numpy()
        return Cut(ends, places, begins, ids, coded.dictionary)

    def token_ids(self, pre_token: str) -> list[int]:
        """The ids of a pre-token, given as it stands in the normalised text."""
        if pre_token in self.special_ids:
            return [self.special_ids[pre_token]]
        cut, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        own = [pre_token]
        if cut and not (pre_token.isascii() and pre_token.isprintable() and " " not in pre_token):  # those are written as other signs
            own = [piece for piece, _ in cut.pre_tokenize_str(pre_token)]
        return [token.id for piece in own if piece for token in model.tokenize(piece)]


def runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each of ``begins`` on, as many as ``sizes`` says, one run after another."""
    after = np.cumsum(sizes)
    return np.repeat(begins - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)


@cache
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def keys_of(pre_tokens: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Keys of pre-tokens, and the texts of those that are not their own key (others null).

    A long one's key is " " and a digest; no short pre-token is as long as that.
    """
    long = pc.greater(pc.utf8_length(pre_tokens), OWN_KEY)
    if not pc.any(long).as_py():
        return pre_tokens, pa.nulls(len(pre_tokens), pa.string())
    digests = [" " + sha256(p.encode()).hexdigest() for p in pre_tokens.filter(long).to_pylist()]
    return pc.replace_with_mask(pre_tokens, long, pa.array(digests, pa.string())), pc.if_else(long, pre_tokens, pa.scalar(None, pa.string()))


def vocabulary(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(key, n, pieces)`` for each distinct pre-token of ``docs (text)``: occurrences, and tokens it becomes.

    Tasks count before anything moves; each distinct pre-token is encoded once.
    """

    def merged_counts(parts: list[pa.Table]) -> pa.Table:
        grouped = pa.concat_tables(parts).group_by("key").aggregate([("pre_token", "max"), ("n", "sum")])
        return grouped.rename_columns({"pre_token_max": "pre_token", "n_sum": "n"}).select(["key", "pre_token", "n"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, parts = pre_tokens(tokenizer), []
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                cut = cutter.cut(batch.column(0).slice(at, ROWS))
                words = np.bincount(cut.places, minlength=len(cut.begins) - 1)
                n = np.bincount(cut.ids, np.repeat(words, np.diff(cut.begins)), len(cut.pre_tokens)).astype(np.int64)
                keys, texts = keys_of(cut.pre_tokens)
                parts.append(pa.table({"key": keys, "pre_token": texts, "n": n}).filter(pc.not_equal(keys, "")))
                if sum(p.num_rows for p in parts) > HELD or sum(p.nbytes for p in parts) > HELD_BYTES:
                    parts = [merged_counts(parts)]
                    if parts[0].num_rows > HELD // 2 or parts[0].nbytes > HELD_BYTES // 2:
                        yield from parts.pop().to_batches()
        if parts:
            yield from merged_counts(parts).to_batches()

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "key string, pre_token string, n bigint")
    merged = counted.groupBy("key").agg(F.sum("n").alias("n"), F.max("pre_token").alias("pre_token"))
    merged = merged.select("key", "n", F.coalesce("pre_token", "key").alias("pre_token"))

    def encode(part: pa.RecordBatch) -> list:
        cutter = pre_tokens(tokenizer)
        return [part.column(0), part.column(1), [len(cutter.token_ids(p)) for p in part.column(2).to_pylist()]]

    return settle(map_slices(merged, encode, "key string, n bigint, pieces bigint"), "pre-tokens")


def common_from(words: DataFrame, most: int = COMMON) -> int:
    """The least number of occurrences that ``most`` pre-tokens or fewer reach."""
    steps = words.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least"))
    total, least = 0, 1 << 62
    for row in sorted(steps.collect(), key=lambda r: -r["step"]):  # 8 for each power of two: some hundred rows
        total += row["words"]
        if total > most:
            break
        least = row["least"]
    return least


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, most: int = COMMON) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of ``docs``.

    A document's pre-tokens and their frequencies meet the counts in two ways: the
    most frequent pre-tokens, at most ``most``, are looked up where the document
    lies, which also takes the hot keys out of the join; the others become rows
    and are joined by equality. No ids are kept and nothing is cut off. A null or
    empty text has 0 bytes and 0 tokens; repeated rows are counted each for itself;
    a null doc_id stays null; other columns are ignored; an empty table gives an
    empty result.
    """
    small = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = vocabulary(small, tokenizer)
    least = common_from(words, most)
    common = words.where(F.col("n") >= least).select("key", "pieces").toArrow()  # ``most`` rows at most
    known = pa.concat_arrays([pa.array([""]), *common.column("key").chunks]), np.concatenate(([0], common.column("pieces").to_numpy(), [0]))
    sent = small.sparkSession.sparkContext.broadcast(known)

    def look_up(part: pa.RecordBatch) -> list:
        known, pieces = sent.value
        cut = pre_tokens(tokenizer).cut(part.column("text"))
        keys = keys_of(cut.pre_tokens)[0]
        at = pc.fill_null(pc.index_in(keys, known), len(known)).to_numpy()
        rare = at == len(known)
        totals = np.concatenate(([0], np.cumsum(pieces[at[cut.ids]])))
        own = totals[cut.begins[1:]] - totals[cut.begins[:-1]]
        totals = np.concatenate(([0], np.cumsum(own[cut.places])))
        # pre-tokens to be joined: (text, pre-token) for each occurrence, then counted
        loose = np.concatenate(([0], np.cumsum(rare[cut.ids])))
        loose = (loose[cut.begins[1:]] > loose[cut.begins[:-1]])[cut.places]
        spots = np.flatnonzero(loose)
        held = cut.places[spots]
        sizes = (cut.begins[1:] - cut.begins[:-1])[held]
        ids, rows = cut.ids[runs(cut.begins[held], sizes)], np.repeat(np.searchsorted(cut.ends, spots, "right") - 1, sizes)
        pairs, times = np.unique((rows * len(rare) + ids)[rare[ids]], return_counts=True)
        ends = pa.array(np.searchsorted(pairs, np.arange(part.num_rows + 1) * len(rare)), pa.int32())
        return [
            part.column("doc_id"), part.column("n_bytes"), totals[cut.ends[1:]] - totals[cut.ends[:-1]],
            pa.ListArray.from_arrays(ends, keys.take(pa.array(pairs % max(1, len(rare))))), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64())),
        ]

    sized = small.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    ddl = "doc_id bigint, n_bytes bigint, known bigint, keys array<string>, times array<bigint>"
    # numbered in a table of its own, so that a repeated task can't number rows anew
    rows = settle(map_slices(sized, look_up, ddl, rows=ROWS).withColumn("row", F.monotonically_increasing_id()), "token-sums")
    whole = rows.where(F.size("keys") == 0).select("doc_id", "n_bytes", F.col("known").alias("n_tokens"))
    loose = rows.where(F.size("keys") > 0).select("row", "doc_id", "n_bytes", "known", F.explode(F.arrays_zip("keys", "times")).alias("at"))
    rare = words.where(F.col("n") < least).select("key", "pieces")
    joined = loose.select("row", "doc_id", "n_bytes", "known", F.col("at.keys").alias("key"), F.col("at.times").alias("times")).join(rare, "key")
    summed = joined.groupBy("row", "doc_id", "n_bytes", "known").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    out = whole.union(summed.select("doc_id", "n_bytes", F.col("known") + F.col("more")))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
