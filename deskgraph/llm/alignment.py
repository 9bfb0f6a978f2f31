"""Alignment of two tokenizers' ids over the same bytes.

Both tokenizers cut space+text into tokens that together hold all its bytes.  The cumulative byte ends of either side are
the keys of a dictionary from end to token number; the ends that both dictionaries hold, sorted, slice the two id lists
into groups.  Inside a group every A and B token whose byte ranges overlap are linked.

A chunk is a run of white space and the run of other characters after it.  Neither tokenizer joins tokens across the start of
a chunk, so a chunk's end is an end of both.  Chunks are aligned once for each worker and kept; of more than
``CACHED_CHUNKS`` the half used most stays.  Texts for which that does not hold (characters that the piece vocabulary
joins with white space, white space beyond ASCII, bytes that do not come back) are aligned as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskgraph.llm.common import stored, worker_cache
from deskgraph.llm.merges import byte_letters, ranked

CACHED_CHUNKS = 400_000
BATCH_CHARS = 2_000_000
#: Id pairs whose counts every task may hold (24 bytes each); beyond that many the counts are joined instead.
HELD_PAIRS = 4_000_000
#: White space of ASCII; other kinds are treated with the whole text.
WHITE = ("", " ", "\t", "\n", "\v", "\f", "\r")
CHUNK = r"[ \t\n\v\f\r]*[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+"
WIDE_SPACE = "\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"

ALIGNED = "row_key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links struct<a: array<int>, b: array<int>, times: array<int>>"


def align(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """Where the groups end, as numbers of A and B tokens: one pair for each byte end that both sides hold."""
    after_a = {end: i for i, end in enumerate(ends_a, 1)}
    after_b = {end: i for i, end in enumerate(ends_b, 1)}
    return [(after_a[end], after_b[end]) for end in sorted(after_a.keys() & after_b.keys())]


def linked(ends_a: list[int], ends_b: list[int], low: tuple[int, int], high: tuple[int, int]) -> list[tuple[int, int]]:
    """(A token, B token) of one group, by number, whose byte ranges overlap.  Takes as many steps as it has links."""
    (i, j), (last_i, last_j) = low, high
    if last_i - i == 1 or last_j - j == 1:  # one token on a side overlaps all of the other
        return [(x, y) for x in range(i, last_i) for y in range(j, last_j)]
    found = []
    while i < last_i and j < last_j:
        found.append((i, j))
        # byte-sharing neighbours: go on with the side that ends first, with both at a common end
        a, b = ends_a[i], ends_b[j]
        i, j = i + (a <= b), j + (b <= a)
    return found


class Tokens:
    """The two tokenizers of one worker: ids of space+text, byte strings of ids, and what chunks may be cut."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        size = self.a.get_vocab_size(with_added_tokens=True)
        letters = byte_letters()
        self.bytes_a = [b""] * size
        for name, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.long_a, self.long_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        self.blank = self.b.piece_to_id("▁")
        joins = any("▁" in p.lstrip("▁") for p in pieces)
        odd = "".join(sorted({re.escape(c) for p in pieces for c in p if c.isspace()}))
        self.whole_only = re.compile(f"[{odd}{WIDE_SPACE}▁]") if not joins else re.compile("")
        self.plain = ranked(self.a, path_a) if self.a.normalizer is None else None

    def ids_a(self, chunks: list[str]) -> list[list[int]]:
        if self.plain is not None and all(c.isascii() or max(c) < "\u0250" for c in chunks):
            return [self.plain.encode_ordinary(c) for c in chunks]
        return [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]

    def ids_b(self, chunks: list[str]) -> list[list[int] | None]:
        """Ids of chunks as they are in a text: B adds its space only where a text starts, in place of the chunk's own."""
        found = self.b.encode([c[1:] if c[0] == " " else c for c in chunks])
        for k, c in enumerate(chunks):
            if c == " ":
                found[k] = [self.blank]
            elif c[0] != " ":
                found[k] = found[k][1:] if found[k][0] == self.blank else None
        return found

    def entries(self, chunks: list[str], a: list[list[int]], b: list[list[int] | None]) -> "Entries":
        """The groups as text, the counts and the links of each chunk; nothing for one whose bytes do not come back.

        The chunks are aligned as one run of bytes: a chunk's end is an end of both sides.
        """
        bodies = [c.encode() for c in chunks]
        name_a, name_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        good = [
            bool(x and y) and b"".join(map(name_a, x)) == body and b"".join(map(name_b, y)) == body
            for x, y, body in zip(a, b, bodies, strict=True)
        ]
        ids_a = [i for x, g in zip(a, good, strict=True) if g for i in x]
        ids_b = [i for x, g in zip(b, good, strict=True) if g for i in x]
        ends_a = list(accumulate(map(self.long_a.__getitem__, ids_a)))
        ends_b = list(accumulate(map(self.long_b.__getitem__, ids_b)))
        stops = accumulate(len(x) for x, g in zip(bodies, good, strict=True) if g)
        groups, sizes, links, parts = [], [], [], []
        stop, i, j, first, linked_before = next(stops, 0), 0, 0, (0, 0), 0
        for x, y in align(ends_a, ends_b):
            if x - i == 1 and y - j == 1:
                parts.append(f"{ids_a[i]}|{ids_b[j]}")
                links.append(ids_a[i] << 32 | ids_b[j])
            else:
                parts.append(f"{','.join(map(str, ids_a[i:x]))}|{','.join(map(str, ids_b[j:y]))}")
                links += [ids_a[p] << 32 | ids_b[q] for p, q in linked(ends_a, ends_b, (i, j), (x, y))]
            i, j = x, y
            if ends_a[x - 1] == stop:
                groups.append(";".join(parts))
                sizes.append((x - first[0], y - first[1], len(parts), len(links) - linked_before))
                parts.clear()
                stop, first, linked_before = next(stops, 0), (x, y), len(links)
        if not all(good):
            told, counts = iter(groups), iter(sizes)
            groups = [next(told) if g else "" for g in good]
            sizes = [next(counts) if g else (0, 0, 0, 0) for g in good]
        return groups, sizes, links

    def whole(self, text: str) -> "Entries":
        """The text as one chunk."""
        (a,) = (e.ids for e in self.a.encode_batch_fast([" " + text], add_special_tokens=False))
        return self.entries([" " + text], [a], [self.b.encode(text) or [self.blank]])


Entries = tuple[list[str], list[tuple[int, int, int, int]], list[int]]
class Memory:
    """Chunks a worker has aligned, by number: texts of groups, and links and counts as flat arrays."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes, self.links = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
        self.starts, self.used = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def add(self, chunks: list[str], entries: Entries) -> None:
        """A chunk whose bytes do not come back is told from others by its sizes of zero."""
        groups, sizes, links = entries
        self.number.update(zip(chunks, range(len(self.groups), len(self.groups) + len(chunks)), strict=True))
        self.groups += groups
        self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int64).reshape(-1, 4)])
        self.links = np.concatenate([self.links, np.array(links, np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[:, 3])])
        self.used = np.concatenate([self.used, np.zeros(len(groups), np.int64)])

    def shrink(self, most: int) -> "Memory":
        """The ``most`` chunks used most often, with their uses halved."""
        kept = np.sort(np.argsort(-self.used, kind="stable")[:most])
        names = list(self.number)
        out = Memory()
        for i in kept.tolist():
            out.number[names[i]] = len(out.groups)
            out.groups.append(self.groups[i])
        out.sizes, out.used = self.sizes[kept], self.used[kept] // 2
        out.links = self.links[places(self.starts[kept], out.sizes[:, 3])]
        out.starts = np.concatenate([[0], np.cumsum(out.sizes[:, 3])])
        return out


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


Aligned = tuple[list[str], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]


def aligner(path_a: str, path_b: str, cached: int = CACHED_CHUNKS) -> Callable[[list[str]], Aligned]:
    """Texts to their groups as text, their counts (n_a, n_b, n_groups, n_links), and their distinct links with how often each occurs.

    A link is a number, the A id times 2^32 plus the B id.  An empty text, or one whose bytes do not come back, has none.
    """
    held = worker_cache(f"alignment:{path_a}:{path_b}")
    if "tokens" not in held:
        held.update(tokens=Tokens(path_a, path_b), memory=Memory())
    tokens = held["tokens"]
    cut = re.compile(CHUNK).findall
    simple = re.compile(r"[ \t\n\v\f\r]{2}|[\t\v\f\r]|[ \n]\Z").search

    def name(chunk: str) -> str:
        """One space before other characters is left out, one line end stays, any other white space is marked by a tab."""
        if chunk[1:2] not in WHITE and chunk[0] in " \n":
            return chunk[1:] if chunk[0] == " " else chunk
        return "\t" + chunk

    def pieces(text: str) -> list[str]:
        """Names of the chunks of space+text."""
        if simple(" " + text):
            return list(map(name, cut(" " + text)))
        return text.replace("\n", " \n").split(" ")

    def learn(missing: list[str], memory: Memory) -> None:
        for low in range(0, len(missing), 16_384):
            part = missing[low : low + 16_384]
            chunks = [c[1:] if c[0] == "\t" else c if c[0] == "\n" else " " + c for c in part]
            memory.add(part, tokens.entries(chunks, tokens.ids_a(chunks), tokens.ids_b(chunks)))

    def run(texts: list[str]) -> Aligned:
        if len(held["memory"].number) > cached:
            held["memory"] = held["memory"].shrink(cached // 2)
        memory = held["memory"]
        rows = [[] if not t or tokens.whole_only.search(t) else pieces(t) for t in texts]
        missing = list(set().union(*rows).difference(memory.number))
        if missing:
            learn(missing, memory)
        numbers = [list(map(memory.number.__getitem__, row)) for row in rows]
        counts = np.array([len(n) for n in numbers])
        flat = np.fromiter((i for row in numbers for i in row), np.int64, counts.sum())
        memory.used += np.bincount(flat, minlength=len(memory.used))
        sizes, row = memory.sizes[flat], np.repeat(np.arange(len(texts)), counts)
        totals = np.zeros((len(texts), 4), np.int64)
        np.add.at(totals, row, sizes)
        lost = np.zeros(len(texts), bool)
        lost[row[sizes[:, 0] == 0]] = True
        links, owner = memory.links[places(memory.starts[flat], sizes[:, 3])], np.repeat(row, sizes[:, 3])
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        groups, pairs = [], []
        for k, text in enumerate(texts):
            if text and (lost[k] or not counts[k]):  # aligned as a whole, or not at all
                (told,), (totals[k],), own = tokens.whole(text)
            else:
                told, own = ";".join(map(memory.groups.__getitem__, numbers[k])), links[bounds[k] : bounds[k + 1]]
            groups.append(told)
            pairs.append(np.unique(np.asarray(own, np.int64), return_counts=True))
        return groups, totals, pairs

    return run


def alignments(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """Per row: row_key, doc_id, n_a, n_b, n_groups, n_links, the groups as text, and distinct links with how often they occur.

    A is the byte-level vocabulary file, B the piece model.  Texts that are null, empty or of which a side's tokens do not give back all bytes
    have no tokens: zeros, an empty text and no links.  Very long texts are whole; memory grows with the longest
    one.  Repeated rows, also of one or of no doc_id, are rows of their own; an empty table gives no rows; other columns are
    not read.  ``row_key`` numbers rows by task, so store the result before two readers rely on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        work = aligner(path_a, path_b)
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                texts, chars = [], 0
                while low + len(texts) < batch.num_rows and (not texts or chars < BATCH_CHARS) and len(texts) < 256:
                    texts.append(batch.column(1)[low + len(texts)].as_py() or "")
                    chars += len(texts[-1])
                yield aligned_batch(key, batch.column(0).slice(low, len(texts)), work(texts))
                low, key = low + len(texts), key + len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ALIGNED)


def aligned_batch(key: int, ids: pa.Array, found: Aligned) -> pa.RecordBatch:
    groups, totals, packed = found
    offsets = pa.array(np.cumsum([0, *(len(p) for p, _ in packed)]), pa.int32())
    pairs, times = (np.concatenate([x[k] for x in packed]) for k in (0, 1))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (pairs >> 32, pairs & 0xFFFFFFFF, times)]
    links = pa.StructArray.from_arrays(lists, names=["a", "b", "times"])
    columns = [ids.cast(pa.int64()), *(pa.array(c) for c in totals.T.copy()), pa.array(groups, pa.string()), links]
    names = ["row_key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(key, key + len(groups))), *columns], names=names)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, documents (how many rows hold the pair linked), best (it is the most of its a, ties included)."""
    pair = F.explode(F.arrays_zip("links.a", "links.b"))
    counts = aligned.select(pair.alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("documents"))
    counts = stored(counts, "pairs")
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return counts.join(most, "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """``aligned`` (stored) without links, with n_best and count_sum over each row's links.

    The table of pairs is as large as the vocabularies allow, whatever the number of documents.  Up to
    ``held_pairs`` of them go to every task as three arrays; more are joined, row by link.
    """
    counts = stored(counts, "pair-counts")
    kept = [c for c in aligned.columns if c != "links"]
    if counts.count() > held_pairs:
        link = F.explode(F.arrays_zip("links.a", "links.b", "links.times"))
        sums = (
            aligned.select("row_key", link.alias("l")).select("row_key", "l.*").join(counts, ["a", "b"])
            .groupBy("row_key")
            .agg(
                F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"),
                F.sum(F.col("times") * F.col("documents")).alias("count_sum"),
            )
        )
        filled = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
        return aligned.drop("links").join(sums, "row_key", "left").select(*kept, *filled)
    table = counts.toArrow()
    pairs = (table["a"].to_numpy().astype(np.int64) << 32) | table["b"].to_numpy()
    order = np.argsort(pairs)
    sent = aligned.sparkSession.sparkContext.broadcast(
        (pairs[order], table["documents"].to_numpy()[order], table["best"].to_numpy(zero_copy_only=False)[order])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, documents, best = sent.value
        for batch in batches:
            links = batch.column(batch.schema.get_field_index("links"))
            a, b, times = (links.field(n) for n in ("a", "b", "times"))
            sizes = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.searchsorted(known, (a.flatten().to_numpy().astype(np.int64) << 32) | b.flatten().to_numpy())
            times, starts = times.flatten().to_numpy().astype(np.int64), np.cumsum(sizes) - sizes
            sums = []
            for value in (times * best[place], times * documents[place]):
                total = np.concatenate([[0], np.cumsum(value)])
                sums.append(pa.array(total[starts + sizes] - total[starts], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + sums, names=[*kept, "n_best", "count_sum"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name != "links")
    return aligned.mapInArrow(run, f"{shape}, n_best long, count_sum long")


def scored_links(docs: DataFrame, path_a: str, path_b: str, text: str = "text", held_pairs: int = HELD_PAIRS, digest: bool = True) -> DataFrame:
    """Alignment of every row with its links' corpus-wide counts: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    With ``digest`` the groups are stored as their SHA-256 (empty without tokens), which keeps the stored table small.
    """
    aligned = alignments(docs, path_a, path_b, text)
    if digest:
        aligned = aligned.withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    aligned = stored(aligned, "aligned")
    return with_counts(aligned, pair_counts(aligned), held_pairs).drop("row_key")
