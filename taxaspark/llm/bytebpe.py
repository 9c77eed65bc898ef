"""Byte-level BPE as Spark higher-order functions: ranked merges folded over the bytes of distinct words.

A word is an array of byte tokens; ``aggregate`` merges the adjacent pair of least rank again and again. The rank map is
a literal: the sparse matrix (left token, right token) -> merged token with its rows shifted into one array, so that a
pair's rank takes two array reads. All words of the corpus are counted, and the frequent short ones, up to
``DICTIONARY``, are folded once each into a dictionary in the shared folder, which each worker reads; the other distinct
words are folded once for each block of documents that has them. Both give the same ids, so the dictionary's bound is one
of memory, not of results. Tasks in Python only split texts into words and put the words' ids together. A fold's arrays
are copied at each merge, so words above ``LONG`` bytes are merged along a heap in the task instead, in n log n steps.
Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import regex
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.llm.common import let, release_memory, stored, text_or_empty
from taxaspark.llm.encoding import ODD_SPACE, batches_of

#: Most words in the dictionary, and the most characters of one: some 120 MB in a worker at most.
DICTIONARY, SHORT = 600_000, 24
#: Bytes up to which a word is folded by Spark.
LONG = 256
#: Characters of texts whose words are folded together, and distinct words that a task counts before it hands them on.
BLOCK, COUNTED = 1 << 21, 300_000
#: Bits of a token id, the id that stands for no token, and bits of a place in a word that Spark folds.
WIDTH = 20
NO_RANK, PLACE = (1 << WIDTH) - 1, 8
#: The pattern whose matches never go on over a single space, or line break, between two other characters.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The entry of no pair: its left token is none.
EMPTY = NO_RANK << WIDTH


def rank_file(path: str) -> dict[bytes, int]:
    """Token -> rank of a rank file (base64 token and rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def pairs_of(ranks: dict[bytes, int]) -> dict[int, int]:
    """Pair of token ids (left << WIDTH | right) -> id of the token that has the bytes of both."""
    return {ranks[t[:i]] << WIDTH | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


def shifted_rows(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """(shift, entries): the entry (left << WIDTH | merged) of a pair is at shift[left] + right; other places hold other lefts, or ``EMPTY``.

    Rows go, longest first, to the first place after the last row of like length where all their entries fit.
    """
    rows: dict[int, list[tuple[int, int]]] = {}
    for pair, merged in pairs.items():
        rows.setdefault(pair >> WIDTH, []).append((pair & (1 << WIDTH) - 1, merged))
    most = max((p >> WIDTH for p in pairs), default=0) + 1
    shift, table = [0] * most, np.full(4 * len(pairs) + (1 << WIDTH), EMPTY, np.int64)
    free, used, at, held = np.ones(len(table), bool), 0, 0, 0
    for left in sorted(rows, key=lambda x: (-len(rows[x]), x)):
        right = np.array(sorted(rows[left]), np.int64)
        steps = right[:, 0] - right[0, 0]
        at, held = (at if len(right).bit_length() == held else 0), len(right).bit_length()
        while True:
            open_ = at + np.flatnonzero(free[at : at + 128])
            fits = free[open_[:, None] + steps].all(axis=1)
            if fits.any():
                place = at = int(open_[np.argmax(fits)])
                break
            at += 128
        spots = place + right[:, 0] - right[0, 0]
        free[spots], table[spots], shift[left] = False, left << WIDTH | right[:, 1], place - int(right[0, 0])
        used = max(used, int(spots[-1]) + 1)
    return shift, table[:used].tolist()


def _literal(values: list[int], kind: str) -> Column:
    """An array literal; the optimizer folds the text into it once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


class Ranks:
    """Column expressions over a rank file."""

    def __init__(self, path: str):
        ranks = rank_file(path)
        self.shift, self.table = shifted_rows(pairs_of(ranks))
        self.bytes = [ranks.get(bytes([b]), -1) for b in range(256)]
        tokens = [""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            tokens[r] = token.decode("latin-1")
        self.tokens = "Ā".join(tokens)

    def bound(self, use: Callable[[Column, Column, Column], Column]) -> Column:
        """``use`` of the literals: displacements, entries, tokens of bytes."""
        return let(_literal(self.shift, "int"), lambda d: let(_literal(self.table, "long"), lambda e: let(_literal(self.bytes, "int"), lambda b: use(d, e, b))))

    def merged(self, shift: Column, table: Column, left: Column, right: Column) -> Column:
        """The token that a pair merges into, which is its rank too; ``NO_RANK`` for a pair that doesn't merge.

        An entry of another left token keeps some of its upper bits, so it is above any token.
        """
        entry = F.get(table, F.get(shift, left) + right)
        return F.least(entry.bitwiseXOR(F.shiftleft(left.cast("long"), WIDTH)), F.lit(NO_RANK))

    def fold(self, shift: Column, table: Column, single: Column, word: Column) -> Column:
        """Ids of a word that isn't empty, array<int>: its tokens after all ranked merges.

        The fold's one array has an element for each token: the rank of its pair with the next token, its first byte's
        place in the word, the token itself; so the least element is the first pair of least rank.
        """
        token = lambda x: x.bitwiseAND(F.lit(NO_RANK)).cast("int")
        rest = (1 << WIDTH + PLACE) - 1
        places = rest - NO_RANK

        def ranked(left: Column, right: Column) -> Column:
            return F.shiftleft(self.merged(shift, table, left, right), WIDTH + PLACE)

        def step(acc: Column, _: Column) -> Column:
            def at(v: Column) -> Column:
                merged = F.shiftright(v, WIDTH + PLACE).cast("int")

                def joined(i: Column) -> Column:  # elements i and i + 1 become one
                    left = F.get(acc, i - 1)
                    one = ranked(merged, token(F.get(acc, i + 2))).bitwiseOR(v.bitwiseAND(F.lit(rest - NO_RANK))).bitwiseOR(merged.cast("long"))
                    before = ranked(token(left), merged).bitwiseOR(left.bitwiseAND(F.lit(rest)))
                    after = F.slice(acc, i + 3, F.size(acc))
                    return F.when(i == 0, F.concat(F.array(one), after)).otherwise(F.concat(F.slice(acc, F.lit(1), i - 1), F.array(before, one), after))

                return F.when(merged == NO_RANK, acc).otherwise(let(F.size(F.filter(acc, lambda x: x.bitwiseAND(F.lit(places)) < v.bitwiseAND(F.lit(places)))), joined))

            return let(F.array_min(acc), at)

        def ids(p: Column) -> Column:
            start = F.transform(p, lambda x, i: ranked(x, F.get(p, i + 1)).bitwiseOR(F.shiftleft(i, WIDTH).cast("long")).bitwiseOR(x.cast("long")))
            return F.transform(F.aggregate(F.slice(p, F.lit(2), F.size(p)), start, step), token)

        latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")  # a character for each byte
        return let(F.transform(F.split(latin, ""), lambda c: F.get(single, F.ascii(c))), ids)

    def folded(self, words: Column) -> Column:
        """Ids of each word of an array."""
        return self.bound(lambda d, e, b: F.transform(words, lambda w: self.fold(d, e, b, w)))


@lru_cache(maxsize=2)
def ranks_of(path: str) -> Ranks:
    """The expressions over a rank file, made once."""
    return Ranks(path)


@lru_cache(maxsize=1)
def _ranks(path: str) -> dict[bytes, int]:
    return rank_file(path)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by ranked merges along a heap, first pair first among equal ranks."""
    n = len(word)
    after, before, end = array("l", range(1, n + 1)), array("l", range(-1, n - 1)), array("l", range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or end[j] != stop:
            continue
        gone[j], end[i], after[i] = 1, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
            k = after[j]
            if (r := ranks.get(word[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


def _pieces(text: str, pattern: str) -> list[str] | None:
    """The text cut at its spaces and before its line breaks, if that is no place within a match; pieces may still hold other white space.

    All pieces but the first lack the space before them, unless they begin with a line break.
    """
    if pattern != SPACED or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
        return None
    return text.replace("\n", " \n").split(" ")


def _as_found(piece: str) -> str:
    return piece if piece[:1] == "\n" else " " + piece


def _one_word(piece: str) -> bool:
    """Whether a piece is one word for certain: letters that every version of Unicode has."""
    return piece.isalpha() and (piece.isascii() or max(piece) < "ɐ")


def _count(batches, pattern: str):
    """Short words and their numbers; a word may come more than once. Each distinct piece of texts is split once for many."""
    words_of, words, pieces = regex.compile(pattern).findall, Counter(), Counter()

    def rows() -> pa.RecordBatch:
        had = words.get
        for piece, n in pieces.items():
            for w in (" " + piece,) if _one_word(piece) else words_of(_as_found(piece)):
                words[w] = had(w, 0) + n
        short = [w for w in words if len(w) <= SHORT]
        out = pa.RecordBatch.from_arrays([pa.array(short, pa.string()), pa.array([words[w] for w in short], pa.int64())], ["w", "n"])
        words.clear()
        pieces.clear()
        return out

    for batch in batches:
        for t in batch["text"].to_pylist():
            own = _pieces(t, pattern)
            if own is None or ODD_SPACE.search(own[0]):
                words.update(words_of(t))
            else:
                words.update(words_of(own[0]))
                pieces.update(own[1:])
            if len(words) + len(pieces) > COUNTED:
                yield rows()
    yield rows()
    release_memory()


def dictionary(texts: DataFrame, pattern: str, ranks: Ranks, limit: int = DICTIONARY) -> DataFrame:
    """w, ids of the most frequent short words of ``texts`` (text), stored.

    All short words are counted; those at least as frequent as a cutoff that at most ``limit`` words reach come in.
    """
    counts = stored(texts.mapInArrow(partial(_count, pattern=pattern), "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    steps = F.floor(F.ln(F.col("n").cast("double")) / 0.02)
    sizes = sorted(((r["s"], r["k"]) for r in counts.groupBy(steps.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    total, cut = 0, float("inf")
    for s, k in sizes:
        if total + k > limit:
            break
        total, cut = total + k, s
    frequent = counts.filter(steps >= F.lit(cut))
    n = 4 * frequent.sparkSession.sparkContext.defaultParallelism
    return stored(frequent.repartition(n, "w").select("w", ranks.bound(lambda d, e, b: ranks.fold(d, e, b, F.col("w"))).alias("ids")), "dictionary")


def _stored(files: tuple[str, ...], column: str) -> pa.ChunkedArray:
    """A column of the stored dictionary, in the order of its files."""
    parts = []
    for f in files:
        system, path = fs.FileSystem.from_uri(f)
        parts += pq.read_table(path, filesystem=system, columns=[column])[column].chunks
    return pa.chunked_array(parts, pa.string() if column == "w" else pa.list_(pa.int32()))


@lru_cache(maxsize=1)
def _numbers(files: tuple[str, ...]) -> dict[str, int]:
    """Number of each of the dictionary's words."""
    return {w: i for i, w in enumerate(_stored(files, "w").to_pylist())} if files else {}


@lru_cache(maxsize=1)
def _known_ids(files: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of ids, ids one after the other) of the dictionary's words."""
    if not files:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    ids = _stored(files, "ids").combine_chunks()
    return pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64), ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)


BLOCKS = "docs array<long>, counts array<int>, refs binary, words array<string>, long array<array<int>>"


def _split(batches, pattern: str, files: tuple[str, ...], path: str):
    """A row for each block of documents.

    ``refs``: the words of its texts, ``counts`` of them for each of ``docs``: numbers in the dictionary, and beyond them
    in ``words``, the block's other distinct words, and in ``long``, the ids of those that Spark doesn't fold.
    """
    words_of, known = regex.compile(pattern).findall, _numbers(files)
    for batch in batches:
        texts, docs = batch["text"].to_pylist(), batch["doc_id"].to_pylist()
        for a, b in batches_of(texts, 100_000, BLOCK):
            counts, refs, others = [], [], {}
            for t in texts[a:b]:
                own = words_of(t)
                found = np.fromiter(map(known.get, own, repeat(-1)), np.int32, len(own))
                for i in np.flatnonzero(found < 0).tolist():
                    found[i] = len(known) + others.setdefault(own[i], len(others))
                counts.append(len(own))
                refs.append(found)
            words = list(others)
            long = np.fromiter((len(w) * 4 > LONG and len(w.encode()) > LONG for w in words), bool, len(words))
            flat = np.concatenate([np.zeros(0, np.int32), *refs])
            if long.any():  # the long ones come last
                place = np.empty(len(words), np.int32)
                place[np.argsort(long, kind="stable")] = np.arange(len(words), dtype=np.int32)
                beyond = flat >= len(known)
                flat[beyond] = len(known) + place[flat[beyond] - len(known)]
            merged = [merge_long(words[i].encode(), _ranks(path)) for i in np.flatnonzero(long)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([docs[a:b]], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([flat.astype("<i4").tobytes()], pa.binary()), pa.array([[w for w, x in zip(words, long.tolist()) if not x]], pa.list_(pa.string())), pa.array([merged], pa.list_(pa.list_(pa.int32())))],
                ["docs", "counts", "refs", "words", "long"],
            )
    release_memory()


def _gathered(which: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, items) of the runs ``which`` among the runs of ``sizes`` items each in ``flat``."""
    starts, n = np.cumsum(sizes) - sizes, sizes[which]
    ends = np.cumsum(n)
    return n, flat[np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=1)
def _token_texts(path: str) -> tuple[pa.Array, pa.Array]:
    """(bytes of each token, its id in decimal after a space), by id."""
    ranks = rank_file(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, r in ranks.items():
        tokens[r] = token
    return pa.array(tokens, pa.binary()), pa.array([b" %d" % i for i in range(len(tokens))], pa.binary())


def _strung(items: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The items of the ids between neighbouring ``ends``, each run's concatenated: what they hold lies in one buffer already."""
    taken = items.take(pa.array(ids))
    offsets = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset :][ends]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), taken.buffers()[2]])


def _assemble(batches, files: tuple[str, ...], path: str | None = None) -> Iterator[pa.RecordBatch]:
    """doc_id, ids of each document of the blocks: the ids of its words one after the other; with a rank file, their text (after a space) and bytes too."""
    sizes, flat = _known_ids(files)
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            own = [(np.diff(x.offsets.to_numpy()).astype(np.int64), x.flatten().to_numpy(zero_copy_only=False).astype(np.int32)) for x in (one["ids"].flatten(), one["long"].flatten())]
            n, ids = _gathered(np.frombuffer(one["refs"][0].as_py(), "<i4").astype(np.int64), np.concatenate([sizes, *[x for x, _ in own]]), np.concatenate([flat, *[x for _, x in own]]))
            ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(one["counts"].flatten().to_numpy(), dtype=np.int64)])]
            out = {"doc_id": one["docs"].flatten(), "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))}
            if path is not None:
                tokens, decimal = _token_texts(path)
                out |= {"written": _strung(decimal, ids, ends).view(pa.string()), "decoded": _strung(tokens, ids, ends)}
            yield pa.RecordBatch.from_pydict(out)
    release_memory()


def encode(docs: DataFrame, ranks_path: str, pattern: str, limit: int = DICTIONARY, strings: bool = False) -> DataFrame:
    """doc_id, ids of every whole text; a null text is empty and has no ids.

    ``strings``: also what the ids are as text, ``written`` (in decimal, joined by one space), and the bytes they decode
    to, ``decoded``; for all tokens of a block that is quicker than by column expressions.

    Repeated rows are encoded one by one; an empty table gives no rows; other columns aren't read, whatever their names.
    Texts and words may be of any length; a task's memory follows the longest one.
    """
    ranks = ranks_of(ranks_path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    known = dictionary(rows.select("text"), pattern, ranks, limit)
    files = tuple(sorted(known.inputFiles()))
    blocks = rows.mapInArrow(partial(_split, pattern=pattern, files=files, path=ranks_path), BLOCKS)
    folded = blocks.select("docs", "counts", "refs", "long", ranks.folded(F.col("words")).alias("ids"))
    out = folded.mapInArrow(partial(_assemble, files=files, path=ranks_path if strings else None), "doc_id long, ids array<int>" + (", written string, decoded binary" if strings else ""))
    return out.withColumn("written", F.ltrim("written")) if strings else out


def decode(ids: Column, ranks: Ranks) -> Column:
    """The bytes of ``ids``: their tokens' bytes concatenated. An id that isn't in the vocabulary gives nothing."""
    tokens = F.split(F.lit(ranks.tokens), "Ā")
    return F.encode(let(tokens, lambda t: F.array_join(F.transform(ids, lambda i: F.get(t, i)), "")), "ISO-8859-1")
